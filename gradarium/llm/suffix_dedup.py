"""Removal of long repeats across documents by a logarithmic family of sparse suffix arrays.

A suffix is sampled where the fingerprint of its first 24 bytes is the least in some 50-byte string (a minimizer), so
each 50-byte string of any document holds exactly one sampled value, and equal strings hold equal ones. About one
suffix in 14 is sampled. Neighbouring strings with the same value form a stretch of at most 76 bytes. Stretches whose
value occurs in one document only can't repeat; the others meet in buckets as bytes, where suffix arrays in the order
of bytes find the long matches. Fingerprints choose what is compared; what is removed is decided by bytes alone.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from gradarium.llm.common import fingerprints, mixed, prefix_sums, semi_join, shared_dir, slices, stored, utf8

LENGTH, ANCHOR = 50, 24
#: Neighbouring strings that can share a sampled place, and the bytes that they cover.
STARTS = LENGTH - ANCHOR + 1
WIDTH = STARTS - 1 + LENGTH
#: Records that a task gathers before it sorts them and sends them on: places, and stretches with their bytes.
GATHER, GATHER_STRETCHES = 1_000_000, 250_000
#: Bytes of text whose sampled places meet in one bucket, and stretches that do, about: numbers of buckets follow from
#: what is counted.
BUCKET_BYTES, BUCKET_STRETCHES = 16_000_000, 250_000
#: A value in more stretches than this, and than a millionth of all, is hot: its strings meet by their own hash.
HOT = 50_000
#: Batches in which a bucket's suffixes enter its index family.
BATCHES = 8
#: Bytes of spans that may be broadcast to the documents; beyond it the join shuffles.
BROADCAST_BYTES = 64_000_000
#: Places of one value among those that a task has gathered, above which a level keeps them beside its ranges.
MANY = 16
#: Stands for a null doc_id, which is greater than any other.
LAST = np.iinfo(np.int64).max
#: Bytes of a text that are read at a time.
PIECE = 500_000

SENT = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("rows", pa.binary())])
SENT_SQL = "kind int, bucket int, rows binary"
#: Kinds of messages: what is to be compared; spans of removed strings; stretches to be compared; hot values; values
#: whose places levels keep beside their ranges.
COMPARE, REMOVED, ASKED, HOT_VALUES, BESIDE = 0, 1, 2, 3, 4
#: A level: a record for each range of values, and places of a value that are kept beside it (bucket is null).
LEVEL_SQL = "bucket int, value long, n long, rows binary"
LEVEL = pa.schema([("bucket", pa.int32()), ("value", pa.int64()), ("n", pa.int64()), ("rows", pa.binary())])


# ---- columns of whole numbers as bytes ----


def encode(*columns: np.ndarray) -> bytes:
    """Columns as byte planes under zstd; the first is sorted and held as differences."""
    n, parts = len(columns[0]), []
    for k, c in enumerate(columns):
        c = c.astype(np.int64).view(np.uint64)
        if not k and n:
            c = np.concatenate([c[:1], c[1:] - c[:-1]])
        planes = np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(n, 8).T)
        kept = max([i + 1 for i in range(8) if planes[i].any()], default=0)
        parts += [bytes([kept]), planes[:kept].tobytes()]
    return n.to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def decode(raw: bytes, n_columns: int) -> list[np.ndarray]:
    n, body, at, out = int.from_bytes(raw[:8], "little"), zstandard.ZstdDecompressor().decompress(raw[8:]), 0, []
    for k in range(n_columns):
        kept = body[at]
        planes = np.zeros((8, n), np.uint8)
        planes[:kept] = np.frombuffer(body, np.uint8, kept * n, at + 1).reshape(kept, n)
        at += 1 + kept * n
        c = np.ascontiguousarray(planes.T).view("<u8").reshape(n).astype(np.uint64)
        out.append((np.cumsum(c, dtype=np.uint64) if not k else c).view(np.int64))
    return out


def decode_all(table: pa.Table, kind: int, n_columns: int) -> list[np.ndarray]:
    kinds = table.column("kind").to_numpy()
    found = [decode(r.as_py(), n_columns) for r, k in zip(table.column("rows"), kinds, strict=True) if k == kind]
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * n_columns


def message(kind: int, bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row for each bucket; within it rows are sorted by the first column (as an unsigned number)."""
    if not len(bucket):
        return
    order = np.lexsort((columns[0].view(np.uint64), bucket))
    bucket, columns = bucket[order], [c[order] for c in columns]
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    rows = [encode(*[c[a:b] for c in columns]) for a, b in zip(start, np.append(start[1:], len(bucket)), strict=True)]
    yield pa.record_batch([pa.array(np.full(len(start), kind, np.int32)), pa.array(bucket[start].astype(np.int32)), pa.array(rows, pa.binary())], schema=SENT)


def pass_on(table: pa.Table, kind: int) -> list[pa.RecordBatch]:
    rows = table.filter(pc.equal(table["kind"], kind)).select(SENT.names)
    return [pa.record_batch([c.combine_chunks() for c in rows.columns], schema=SENT)]


def by_hash(value: np.ndarray, n: int) -> np.ndarray:
    return (((value.view(np.uint64) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def by_doc(doc: np.ndarray, n: int) -> np.ndarray:
    return by_hash(mixed(doc.view(np.uint64)), n)


# ---- stretches of strings that share a sampled suffix ----


def least_in_windows(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[p : p + width] for each p (the end is cut off)."""
    done = 1
    while done < width:
        step = min(done, width - done)
        y = x.copy()
        np.minimum(x[:-step], x[step:], out=y[:-step])
        x, done = y, done + step
    return x


def segments(ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(i, j, a, b): bytes a to b hold the texts i to j - 1, or a part of the long text i. Parts overlap so that every
    50-byte string starts in exactly one of them and lies in it."""
    for i, j in slices(ends, PIECE):
        if ends[j] - ends[i] <= PIECE + LENGTH:
            yield i, j, int(ends[i]), int(ends[j])
        else:
            for a in range(int(ends[i]), int(ends[j]) - LENGTH + 1, PIECE):
                yield i, j, a, min(int(ends[j]), a + PIECE + LENGTH - 1)


def anchors(data: np.ndarray) -> np.ndarray:
    """The fingerprint of the 24 bytes from each place on."""
    place = np.arange(max(0, len(data) - ANCHOR + 1))
    return fingerprints(prefix_sums(data), place, place + ANCHOR)


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts that lie one after the other: (value, text, first, n) of each stretch of n neighbouring 50-byte strings
    with the same least fingerprint; `first` counts from data's begin. A longer run of the same value is cut."""
    n, none = len(data), (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    if n < LENGTH:
        return none
    least = least_in_windows(anchors(data), STARTS)[: n - LENGTH + 1]
    size = np.diff(ends)
    room = np.repeat(np.maximum(ends[1:] - LENGTH, ends[:-1] - 1), size)[: n - LENGTH + 1]  # last start in the text
    text = np.repeat(np.arange(len(size)), size)[: n - LENGTH + 1]
    start = np.flatnonzero(np.arange(n - LENGTH + 1) <= room)
    if not len(start):
        return none
    own, of = least[start], text[start]
    new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (of[1:] != of[:-1])))
    count = np.diff(np.append(new, len(start)))
    parts = -(-count // STARTS)
    within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    new, count = np.repeat(new, parts), np.repeat(count, parts)
    return mixed(own[new] ^ np.uint64(0x5851F42D4C957F2D)), of[new], start[new] + STARTS * within, np.minimum(count - STARTS * within, STARTS)


def bytes_of(data: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows of WIDTH bytes, each one more than in the text so that none is zero, with zeros behind the stretch: their
    order is that of the suffixes, cut off where the stretch ends."""
    place = np.arange(WIDTH)
    at = np.minimum(first[:, None] + place, len(data) - 1)
    return np.where(place < (n + LENGTH - 1)[:, None], data[at] + np.uint8(1), np.uint8(0)).view(f"S{WIDTH}").ravel()


def matrix(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(len(keys), keys.dtype.itemsize)


# ---- the index family ----


class SuffixIndexFamily:
    """Suffix arrays in the order of bytes, whose sizes grow geometrically.

    Batches come in the order of their documents. A batch's suffixes are sorted into an array of their own, which is
    merge-scanned against each array of the family: the longest common prefix with the suffix that follows in the array
    tells how far the match goes. A suffix that an older one matches in its whole length is found; the others enter.
    Arrays of about equal size are merged, so a suffix is rewritten as often as the logarithm of the number of batches.
    """

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def add(self, keys: np.ndarray, age: np.ndarray) -> np.ndarray:
        """keys: suffixes (without zero bytes) in ascending order of age, all older ones having been added before. True
        where a suffix of smaller age begins with the whole key."""
        order = np.argsort(keys, kind="stable")
        k, a = keys[order], age[order]
        head = np.append(True, k[1:] != k[:-1])[: len(k)]
        at = np.flatnonzero(head)
        own = k[at]
        length = np.char.str_len(own) if len(own) else at
        known = np.zeros(len(own), bool)
        for level in self.levels:
            known |= common_prefix(own, level[np.minimum(np.searchsorted(level, own), len(level) - 1)]) >= length
        if not known.all():
            self.levels.append(own[~known])
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            both = np.concatenate([self.levels.pop(), self.levels.pop()])
            both.sort(kind="stable")  # two sorted runs
            self.levels.append(both)
        group = np.cumsum(head) - 1
        found = np.zeros(len(k), bool)
        found[order] = known[group] | (a > a[at][group]) if len(k) else found
        return found


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of each pair of suffixes."""
    if not len(a):
        return np.zeros(0, np.int64)
    differ = matrix(a) != matrix(b)
    return np.where(differ.any(1), differ.argmax(1), a.dtype.itemsize)


def in_batches(keys: np.ndarray, age: np.ndarray) -> np.ndarray:
    """What a family finds of keys in ascending order of age, added batch by batch; an age is never divided."""
    family, found = SuffixIndexFamily(), np.zeros(len(age), bool)
    if len(age):
        cuts = np.unique([0, *np.searchsorted(age, age[np.linspace(0, len(age) - 1, BATCHES + 1).astype(int)[1:-1]]), len(age)])
        for a, b in zip(cuts, cuts[1:], strict=False):
            found[a:b] = family.add(keys[a:b], age[a:b])
    return found


def found_strings(value: np.ndarray, age: np.ndarray, row: np.ndarray, first: np.ndarray, n: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first, n) of the runs of strings that are also in a smaller document, among the stretches of a bucket.

    Stretches that an older one holds in their whole length are found by a family over the stretches. Of the others,
    those whose value stands in several different stretches differ from these somewhere, as at the edges of a repeat:
    every one of their strings enters a second family as a suffix of its own."""
    order = np.argsort(age, kind="stable")
    value, age, row, first, n, keys = (x[order] for x in (value, age, row, first, n, keys))
    found = in_batches(keys, age)
    left = np.flatnonzero(~found)
    left = left[np.lexsort((keys[left], value[left]))]
    v, k = value[left], keys[left]
    other = (v[1:] == v[:-1]) & (k[1:] != k[:-1])
    group = np.cumsum(np.append(0, v[1:] != v[:-1])[: len(v)])
    mixed_ = np.sort(left[np.bincount(group[1:][other], minlength=len(v) + 1)[group] > 0])
    count = n[mixed_]
    of = np.repeat(mixed_, count)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    strings = np.lib.stride_tricks.sliding_window_view(matrix(keys), LENGTH, axis=1)[of, offset] if len(of) else np.zeros((0, LENGTH), np.uint8)
    again = in_batches(np.ascontiguousarray(strings).view(f"S{LENGTH}").ravel(), age[of])
    runs = spans_of_starts(row[of[again]], (first[of] + offset)[again])
    return tuple(np.concatenate([x[found], y]) for x, y in zip((row, first, n), runs, strict=True))


def ages(doc: np.ndarray, row: np.ndarray, since: int = 0) -> np.ndarray:
    """Numbers in the order of the rows' documents: by doc_id, where rows of one doc_id tie. Rows without a doc_id
    (row < 0) are documents of their own and come last, by row number. Rows from 0 to since - 1 are of earlier batches:
    all of one age, before the others. They compare within this call's rows only."""
    tie, new = np.where(row < 0, -row, 0), (row < 0) | (row >= since)
    if not tie.any() and new.all():
        return doc
    doc = np.where(new, doc, 0)
    order = np.lexsort((tie, doc, new))
    d, t, w = doc[order], tie[order], new[order]
    out = np.zeros(len(doc), np.int64)
    out[order] = np.cumsum(np.append(False, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (w[1:] != w[:-1])))
    return out


def spans_of_starts(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first, n) of runs of neighbouring starts."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1))[: len(doc)])
    last = np.append(new[1:], len(doc)) - 1
    return doc[new], start[new], (start[last] - start[new] + 1) if len(new) else start[:0]


# ---- messages between tasks ----


def place_messages(n_buckets: int, n_homes: int):
    """The sampled places of all texts to buckets by value. A value in several rows of what a task has gathered is known
    to be shared: its stretches are asked for at once, and a single record tells the bucket, so a frequent value sends
    one record a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def send() -> Iterator[pa.RecordBatch]:
            value, row, first, n = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((row, value))
            value, row, first, n = value[order], row[order], first[order], n[order]
            head = np.append(True, value[1:] != value[:-1])
            group = np.cumsum(head) - 1
            shared = (np.bincount(group[1:], weights=~head[1:] & (row[1:] != row[:-1]), minlength=group[-1] + 1) > 0)[group] if len(value) else head[:0]
            yield from message(ASKED, by_doc(row[shared], n_homes), [row[shared], first[shared], n[shared]])
            one, count = np.flatnonzero(shared & head), np.bincount(group)
            columns = [(value[~shared], value[one]), (np.ones((~shared).sum(), np.int64), count[group[one]]), (row[~shared], np.full(len(one), -1)), (first[~shared], np.zeros(len(one), np.int64)), (n[~shared], np.zeros(len(one), np.int64))]
            value, *rest = (np.concatenate(c) for c in columns)
            yield from message(COMPARE, by_hash(value, n_buckets), [value.view(np.int64), *rest])

        for batch in batches:
            row = batch.column(0).to_numpy(zero_copy_only=False)
            data, ends = utf8(batch.column(1))
            for i, j, a, b in segments(ends):
                value, of, first, n = stretches(data[a:b], np.clip(ends[i : j + 1], a, b) - a)
                held.append((value, row[i:j][of], first + a - ends[i:j][of], n))
                if sum(len(h[0]) for h in held) >= GATHER:
                    yield from send()
        if held:
            yield from send()

    return run


def shared_places(n_homes: int, hot: int, since: int = 0):
    """Of each bucket the stretches whose value is in several rows, one of them `since` or later, and those of these
    values that are in more than `hot` stretches."""

    def run(table: pa.Table) -> pa.Table:
        out = pass_on(table, ASKED)
        value, count, row, first, n = decode_all(table, COMPARE, 5)
        order = np.lexsort((row, value))
        value, count, row, first, n = (x[order] for x in (value, count, row, first, n))
        if len(value):
            head = np.append(True, value[1:] != value[:-1])
            group = np.cumsum(head) - 1
            size = group[-1] + 1
            many = np.bincount(group, weights=row < 0, minlength=size) + np.bincount(group[1:], weights=~head[1:] & (row[1:] != row[:-1]), minlength=size)
            many[np.bincount(group, weights=(row == -1) | (row >= since), minlength=size) == 0] = 0
            beside = np.unique(value[(many[group] > 0) & (row == -2)])
            out += message(BESIDE, np.zeros(len(beside), np.int64), [beside])
            asked = (many[group] > 0) & (row >= 0)
            out += message(ASKED, by_doc(row[asked], n_homes), [row[asked], first[asked], n[asked]])
            warm = value[head][(many > 0) & (np.bincount(group, weights=count) > hot)]
            out += message(HOT_VALUES, np.zeros(len(warm), np.int64), [warm])
        return pa.Table.from_batches(out, SENT)

    return run


def asked_by_row(table: pa.Table) -> pa.Table:
    """One record for each row number: its stretches that are to be compared, in order."""
    row, first, n = decode_all(table, ASKED, 3)
    order = np.lexsort((first, row))
    row, first, n = row[order], first[order], n[order]
    cut = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
    ends = np.append(cut[1:], len(row))[: len(cut)]
    spans = [encode(first[x:y], n[x:y]) for x, y in zip(cut, ends, strict=True)]
    return pa.table([pa.array(row[cut], pa.int64()), pa.array(ends - cut, pa.int64()), pa.array(spans, pa.binary())], ["__row", "__n", "__spans"])


def stretch_messages(n_buckets: int, n_homes: int, hot: np.ndarray, since: int = 0):
    """The bytes of the asked stretches, to buckets by value; those of hot values as single strings, by their own hash.
    A stretch that a smaller document of what the task has gathered has too is settled and never sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def send() -> Iterator[pa.RecordBatch]:
            value, doc, row, first, n, keys = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            age = ages(doc, row, since)
            order = np.argsort(age, kind="stable")
            order = order[np.argsort(keys[order], kind="stable")]
            k, a = keys[order], age[order]
            head = np.append(True, k[1:] != k[:-1])[: len(k)]
            settled = np.zeros(len(k), bool)
            settled[order] = a > a[np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))]
            yield from message(REMOVED, by_doc(row[settled], n_homes), [row[settled], first[settled], n[settled]])
            sent = order[~settled[order]]
            bucket = by_hash(value[sent], n_buckets)
            sent = sent[np.argsort(bucket, kind="stable")]
            bucket = np.sort(bucket)
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
            rows = []
            for x, y in zip(cut, np.append(cut[1:], len(bucket))[: len(cut)], strict=True):
                own = sent[x:y]
                m = matrix(keys[own])
                numbers = encode(doc[own], (value[own] & np.uint64(0xFFFFFFFF)).view(np.int64), row[own], first[own], n[own])
                rows.append(len(numbers).to_bytes(8, "little") + numbers + zstandard.ZstdCompressor(level=1).compress(m[m > 0].tobytes()))
            if rows:
                yield pa.record_batch([pa.array(np.full(len(rows), COMPARE, np.int32)), pa.array(bucket[cut].astype(np.int32)), pa.array(rows, pa.binary())], schema=SENT)

        for batch in batches:
            doc, row = (batch.column(i).fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            data, ends = utf8(batch.column(2))
            asked = [decode(x, 2) for x in batch.column(3).to_pylist()]
            for i, j, a, b in segments(ends):
                own = [(first + ends[t] - a, n, t) for t, (first, n) in enumerate(asked[i:j], i)]
                first, n, of = (np.concatenate(c) for c in zip(*[(x, m, np.full(len(x), t)) for x, m, t in own], strict=True))
                inside = (first >= 0) & (first <= b - a - LENGTH)
                first, n, of = first[inside], n[inside], of[inside]
                if not len(first):
                    continue
                part = data[a:b]
                value = mixed(least_at(part, first) ^ np.uint64(0x5851F42D4C957F2D))
                warm = np.isin(value, hot)
                if warm.any():
                    k = n[warm]
                    at = np.repeat(first[warm] - np.cumsum(k) + k, k) + np.arange(k.sum())
                    strings = mixed(fingerprints(prefix_sums(part), at, at + LENGTH) ^ np.uint64(0xA0761D6478BD642F))
                    value, first, of, n = np.concatenate([value[~warm], strings]), np.concatenate([first[~warm], at]), np.concatenate([of[~warm], np.repeat(of[warm], k)]), np.concatenate([n[~warm], np.ones(len(at), np.int64)])
                held.append((value, doc[of], row[of], first + a - ends[of], n, bytes_of(part, first, n)))
                if sum(len(h[0]) for h in held) >= GATHER_STRETCHES:
                    yield from send()
        if held:
            yield from send()

    return run


def least_at(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The least fingerprint in the string that begins at each place."""
    value = anchors(data)
    out = value[first]
    for k in range(1, STARTS):
        np.minimum(out, value[first + k], out=out)
    return out


def merge_scan(n_homes: int, since: int = 0):
    """The index families of a bucket: out come the spans of strings that a smaller document has."""

    def run(table: pa.Table) -> pa.Table:
        out, found = pass_on(table, REMOVED), []
        for raw in table.filter(pc.equal(table["kind"], COMPARE)).column("rows").to_pylist():
            cut = 8 + int.from_bytes(raw[:8], "little")
            columns = decode(raw[8:cut], 5)
            m = np.zeros((len(columns[0]), WIDTH), np.uint8)
            m[np.arange(WIDTH) < (columns[4] + LENGTH - 1)[:, None]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[cut:]), np.uint8)
            found.append((*columns, m.view(f"S{WIDTH}").ravel()))
        if found:
            doc, value, row, first, n, keys = (np.concatenate(c) for c in zip(*found, strict=True))
            spans = found_strings(value, ages(doc, row, since), row, first, n, keys)
            out += message(REMOVED, by_doc(spans[0], n_homes), list(spans))
        return pa.Table.from_batches(out, SENT)

    return run


def spans_by_row(kind: int):
    """One record for each row number: its spans of string starts, merged where they touch."""

    def run(table: pa.Table) -> pa.Table:
        row, first, n = decode_all(table, kind, 3)
        order = np.lexsort((first, row))
        row, first, n = row[order], first[order], n[order]
        numbers, rows = [], []
        if len(row):
            reach = first + n
            new_row = np.append(True, row[1:] != row[:-1])
            # furthest end so far in the row's text: ends are moved up by a number of the row that no end can cross
            lift = (np.cumsum(new_row) - 1) * (int(reach.max()) + 1)
            furthest = np.maximum.accumulate(reach + lift) - lift
            new = np.flatnonzero(new_row | np.append(True, first[1:] > furthest[:-1]))
            last = np.append(new[1:], len(row)) - 1
            d, a, m = row[new], first[new], furthest[last] - first[new]
            cut = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            for x, y in zip(cut, np.append(cut[1:], len(d)), strict=True):
                numbers.append(int(d[x]))
                rows.append(encode(a[x:y], m[x:y]))
        return pa.table([pa.array(numbers, pa.int64()), pa.array(rows, pa.binary())], ["__row", "__spans"])

    return run


def removed_bytes(first: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of bytes that the strings cover."""
    begin, end = first, np.minimum(first + n - 1 + LENGTH, size)
    begin, end = begin[begin < size], end[begin < size]
    new = np.flatnonzero(np.append(True, begin[1:] > end[:-1])[: len(begin)])
    return begin[new], end[np.append(new[1:], len(begin)) - 1] if len(new) else end[:0]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, ends = utf8(batch.column(1))
        rows = []
        for k, spans in enumerate(batch.column(2).to_pylist()):
            text = data[ends[k] : ends[k + 1]]
            begin, end = removed_bytes(*decode(spans, 2), len(text)) if spans is not None else ((), ())
            digest, at = hashlib.sha256(), 0
            for a, b in zip(begin, end, strict=True):
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            rows.append((len(text), int(sum(end) - sum(begin)), len(begin), digest.hexdigest(), [x for ab in zip(begin, end, strict=True) for x in map(int, ab)]))
        n, out, spans, sha, runs = zip(*rows, strict=True) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(out, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(runs, pa.list_(pa.int64()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "runs"])


# ---- levels of a stored family ----


def level_messages(n_buckets: int):
    """The sampled places of texts, to buckets by value, less the stretches whose strings are all removed, as an older
    document holds these, and less those that are equal to another one of what a task has gathered. Of a value with
    many places the bucket gets one record (of row -2) from each task; the places are kept beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def send() -> Iterator[pa.RecordBatch]:
            value, row, first, n, keys = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((keys, value))
            value, row, first, n, keys = (x[order] for x in (value, row, first, n, keys))
            new = np.append(True, (value[1:] != value[:-1]) | (keys[1:] != keys[:-1]))[: len(value)]
            value, row, first, n = value[new].view(np.int64), row[new], first[new], n[new]
            start = np.flatnonzero(np.append(True, value[1:] != value[:-1])[: len(value)])
            count = np.diff(np.append(start, len(value)))
            big = np.flatnonzero(count > MANY)
            few = np.repeat(count <= MANY, count)
            none = np.zeros(len(big), np.int64)
            columns = zip((value[start[big]], count[big], none - 2, none, none), (value[few], np.ones(few.sum(), np.int64), row[few], first[few], n[few]), strict=True)
            columns = [np.concatenate(c) for c in columns]
            for m in message(COMPARE, by_hash(columns[0], n_buckets), columns):
                yield pa.record_batch([m.column(1), pa.nulls(len(m), pa.int64()), pa.nulls(len(m), pa.int64()), m.column(2)], schema=LEVEL)
            if len(big):
                parts = [slice(start[g], start[g] + count[g]) for g in big]
                parts = [(x, np.argsort(row[x], kind="stable")) for x in parts]
                rows = [encode(row[x][o], first[x][o], n[x][o]) for x, o in parts]
                yield pa.record_batch([pa.nulls(len(big), pa.int32()), pa.array(value[start[big]]), pa.array(count[big], pa.int64()), pa.array(rows, pa.binary())], schema=LEVEL)

        for batch in batches:
            row = batch.column(0).to_numpy(zero_copy_only=False)
            data, ends = utf8(batch.column(1))
            spans = [decode(x, 2) if x is not None else (np.zeros(0, np.int64),) * 2 for x in batch.column(2).to_pylist()]
            for i, j, a, b in segments(ends):
                part = data[a:b]
                value, of, first, n = stretches(part, np.clip(ends[i : j + 1], a, b) - a)
                # removed starts in the order of data: the last span that begins before a stretch must reach over it
                begin, size = (np.concatenate(c) for c in zip(*[(x + ends[t], m) for t, (x, m) in enumerate(spans[i:j], i)], strict=True))
                reach = np.append(begin + size, 0)[np.searchsorted(begin, first + a, "right") - 1]
                kept = reach < first + a + n
                value, of, first, n = value[kept], of[kept], first[kept], n[kept]
                if len(value):
                    held.append((value, row[i:j][of], first + a - ends[i:j][of], n, bytes_of(part, first, n)))
                if sum(len(h[0]) for h in held) >= GATHER_STRETCHES:
                    yield from send()
        if held:
            yield from send()

    return run


def into_buckets(n_buckets: int, sent: bool):
    """The records of levels, whose buckets may be fewer, to the buckets of this run, as messages or as records of a
    level. Both are ranges of values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                columns = decode(raw, 5)
                for m in message(COMPARE, by_hash(columns[0], n_buckets), columns):
                    nulls = pa.nulls(len(m), pa.int64())
                    yield m if sent else pa.record_batch([m.column(1), nulls, nulls, m.column(2)], schema=LEVEL)

    return run


def merged_level(table: pa.Table) -> pa.Table:
    """One record for each bucket: its places in the order of their values."""
    columns = [np.concatenate(c) for c in zip(*[decode(raw, 5) for raw in table.column("rows").to_pylist()], strict=True)]
    order = np.lexsort((columns[3], columns[2], columns[0].view(np.uint64)))
    rows = encode(*[c[order] for c in columns])
    return pa.table([table.column("bucket")[:1], pa.nulls(1, pa.int64()), pa.array([len(order)], pa.int64()), pa.array([rows], pa.binary())], LEVEL.names)


def level_of(records: DataFrame) -> DataFrame:
    """A level of records that may have many of a bucket."""
    ranges = records.where(F.col("bucket").isNotNull()).groupBy("bucket").applyInArrow(merged_level, LEVEL_SQL)
    return ranges.unionByName(records.where(F.col("bucket").isNull()))


def values_beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            yield pa.record_batch([pa.array(decode(raw, 1)[0])], ["value"])


def asked_beside(n_homes: int):
    """Stretches of values whose places stand beside the ranges of a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                row, first, n = decode(raw, 3)
                yield from message(ASKED, by_doc(row, n_homes), [row, first, n])

    return run


# ---- jobs ----


def _numbered(docs: DataFrame, text: str, doc_id: str, since: int) -> DataFrame:
    """(row, held): doc_id and text of each row, with unique numbers from since."""
    if not isinstance(docs.schema[doc_id].dataType, IntegralType):
        raise TypeError(f"{doc_id} must be a whole number")
    row = (F.monotonically_increasing_id() + F.lit(since)).alias("row")
    return docs.select(row, F.struct(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).alias("held"))


def _joined(held: DataFrame, spans: DataFrame, how: str, broadcast_bytes: int, since: int = 0) -> DataFrame:
    """doc_id, row, text and spans of the rows (all, or those that have some). Rows of this batch without a doc_id have
    negative numbers."""
    number = F.when(F.col("held.doc_id").isNull() & (F.col("row") >= since), -1 - F.col("row")).otherwise(F.col("row"))
    size = spans.agg(F.coalesce(F.sum(F.octet_length("__spans") + 24), F.lit(0))).first()[0]
    rows = held.join(F.broadcast(spans) if size <= broadcast_bytes else spans.hint("merge"), F.col("row") == F.col("__row"), how)
    return rows.select("held.doc_id", number.alias("row"), "held.text", "__spans")


def _spans(held: DataFrame, n_bytes: int, broadcast_bytes: int, hot: int, since: int = 0, older: DataFrame | None = None, levels: DataFrame | None = None) -> DataFrame:
    """(__row, __spans) of the rows of held that repeat an older document: one of held, or, where levels (rows) are
    given, one of `older`, to whose rows the levels point and whose numbers are below since."""
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(parts, n_bytes // BUCKET_BYTES)
    n_homes = max(8, n_buckets // 4)  # what is found about rows goes there: a bucket sends at most so many messages
    places = held.select("row", "held.text").mapInArrow(place_messages(n_buckets, n_homes), SENT_SQL)
    texts = held
    if levels is not None:
        ranges = levels.where(F.col("bucket").isNotNull()).select("rows")
        places = places.unionByName(ranges.mapInArrow(into_buckets(n_buckets, True), SENT_SQL))
        texts = held.unionByName(older)
    shared = stored(places.groupBy("bucket").applyInArrow(shared_places(n_homes, max(hot, n_bytes // (14 * 1_000_000)), since), SENT_SQL), "shared")
    asked = shared.where(F.col("kind") == ASKED)
    if levels is not None:
        values = stored(shared.where(F.col("kind") == BESIDE).select("rows").mapInArrow(values_beside, "value long"), "beside")
        beside = semi_join(levels.where(F.col("bucket").isNull()), values, "value", values.count()).select("rows")
        asked = asked.unionByName(beside.mapInArrow(asked_beside(n_homes), SENT_SQL))
    asked = stored(asked.groupBy("bucket").applyInArrow(asked_by_row, "__row long, __n long, __spans binary"), "asked")
    warm = [decode(r[0], 1)[0] for r in shared.where(F.col("kind") == HOT_VALUES).select("rows").collect()]  # a million values at most
    warm = np.concatenate([np.zeros(0, np.int64), *warm]).view(np.uint64)
    n_buckets = max(parts, asked.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0] // BUCKET_STRETCHES)
    sent = _joined(texts, asked, "inner", broadcast_bytes, since).mapInArrow(stretch_messages(n_buckets, n_homes, warm, since), SENT_SQL)
    found = stored(sent.groupBy("bucket").applyInArrow(merge_scan(n_homes, since), SENT_SQL), "found")
    spans = found.where(F.col("kind") == REMOVED).groupBy("bucket").applyInArrow(spans_by_row(REMOVED), "__row long, __spans binary")
    spans = spans.select(F.when(F.col("__row") < 0, -1 - F.col("__row")).otherwise(F.col("__row")).alias("__row"), "__spans")
    return stored(spans, "spans")


def _bytes(texts: DataFrame) -> int:
    return texts.agg(F.coalesce(F.sum(F.octet_length("held.text")), F.lit(0))).first()[0]


def _rest(held: DataFrame, spans: DataFrame, broadcast_bytes: int) -> DataFrame:
    rows = _joined(held, spans, "left", broadcast_bytes).select("doc_id", "text", "__spans")
    return rows.mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, runs array<long>")


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", broadcast_bytes: int = BROADCAST_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, runs): what is left of each text without the bytes that lie
    in a 50-byte string which also starts in a document with a smaller doc_id. runs: begin and end of each removed run.

    1. Every task sends the sampled places of its documents to buckets by value; stretches whose value is in one row
       only are done with.
    2. The bytes of the other stretches meet in buckets by value, less those that a task can settle itself. Each bucket
       adds them to its index family in the order of doc_id, batch by batch: what a smaller document has is found by
       the common prefix with its neighbour in the suffix arrays.
    3. Spans are merged for each document and applied to its text.
    A value that very many documents share is sent once from each task; the strings around a hot one are dealt out by
    their own hash, so no bucket holds them all. Buckets follow the counted bytes and stretches. Hot values, at most a
    million, are the only thing that reaches the driver. Nothing is removed that isn't equal byte for byte.

    A null text is empty. doc_id is a whole number, other types raise. Rows with the same doc_id don't match each
    other, but each loses only what its own text repeats. Rows without a doc_id are documents of their own, greater
    than all with one; among them the row number decides, which is given once and stored with the texts. A text of any
    length is read in pieces. Other columns are not read. No rows: none.
    """
    held = stored(_numbered(docs, text, doc_id, 0), "numbered")
    spans = _spans(held, _bytes(held), broadcast_bytes, hot)
    return _rest(held, spans, broadcast_bytes)


STATE = "version long, next_row long, n_bytes long, level string, n long, place long, texts array<string>"


class StoredFamily:
    """A family of sparse suffix arrays in a shared folder, to which batches of documents are added one after the other.

    A level is a table of sampled places, (value, row, first, n) in the order of values, cut into ranges of values, and
    the names of the tables that hold the texts to which its places point. A batch's places are an array of the same
    kind: it is merge-scanned with all levels, range by range. Where values agree, the bytes of both sides meet as
    suffixes, and common prefixes decide. Then the batch's places, less the stretches that older documents hold, are
    stored as a level; levels of about equal size are merged, so a place is rewritten as often as the logarithm of the
    number of batches and there are about as many levels.

    A batch is judged against all documents of earlier batches, whatever their doc_ids, and against those of its own
    with smaller ones. So batches in ascending order of doc_id lose the same bytes as one run over all of them.
    Nulls, ties, repeats and long texts: as in remove_repeats. An empty batch changes nothing.

    The folder's state is a small table for each version, written last: where an addition fails, the next one begins at
    the version before it. Additions must come one at a time. Tables of earlier versions aren't deleted.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/suffixes-{uuid.uuid4().hex}"
        self.version = self.next_row = self.n_bytes = 0
        #: (table, number of places, tables of texts), the largest level first.
        self.levels: list[tuple[str, int, list[str]]] = []
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            states = spark.read.schema(STATE).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(f"{self.path}/state")
            newest = states.agg(F.max("version")).first()[0]
            rows = states.where(F.col("version") == newest).orderBy("place").collect() if newest else []  # a row for each level
            if rows:
                self.version, self.next_row, self.n_bytes = rows[0].version, rows[0].next_row, rows[0].n_bytes
                self.levels = [(r.level, r.n, list(r.texts)) for r in rows]

    def _table(self, df: DataFrame, name: str) -> str:
        name = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _read(self, names: list[str], schema: str) -> DataFrame:
        """Tables of the folder as one."""
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def add_batch(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", broadcast_bytes: int = BROADCAST_BYTES, hot: int = HOT) -> DataFrame:
        """Add docs and return what is left of each of them, as remove_repeats does."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        since, texts = self.next_row, "row long, held struct<doc_id: long, text: string>"
        name = self._table(_numbered(docs, text, doc_id, since), "texts")
        held = self._read([name], texts)
        last, n_bytes = held.agg(F.max("row"), F.coalesce(F.sum(F.octet_length("held.text")), F.lit(0))).first()
        total = self.n_bytes + n_bytes
        older = levels = None
        if self.levels:
            older = self._read([t for _, _, own in self.levels for t in own], texts)
            levels = self._read([level for level, _, _ in self.levels], LEVEL_SQL)
        spans = _spans(held, total, broadcast_bytes, hot, since, older, levels)
        result = _rest(held, spans, broadcast_bytes)
        if last is None:
            return result
        n_buckets = max(parts, total // BUCKET_BYTES)
        places = _joined(held, spans, "left", broadcast_bytes, last + 1).select("row", "text", "__spans").mapInArrow(level_messages(n_buckets), LEVEL_SQL)
        level = self._table(level_of(stored(places, "places")), "level")
        n = self._read([level], "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        kept, tables, names = list(self.levels), [level], [name]
        while kept and kept[-1][1] <= 2 * n:
            table, size, own = kept.pop()
            n, tables, names = n + size, [table, *tables], [*own, *names]
        if len(tables) > 1:
            records = self._read(tables, LEVEL_SQL)
            ranges = records.where(F.col("bucket").isNotNull()).select("rows").mapInArrow(into_buckets(n_buckets, False), LEVEL_SQL)
            level = self._table(level_of(ranges.unionByName(records.where(F.col("bucket").isNull()))), "level")
        kept.append((level, n, names))
        state = [(self.version + 1, last + 1, total, t, size, k, own) for k, (t, size, own) in enumerate(kept)]
        self.spark.createDataFrame(state, STATE).coalesce(1).write.json(f"{self.path}/state/{self.version + 1}")
        self.version, self.next_row, self.n_bytes, self.levels = self.version + 1, last + 1, total, kept
        return result
