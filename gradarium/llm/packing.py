"""Packing token pieces into sequences: linear grouping, configurations of few sizes, best fit for the rest."""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradarium.llm.common import n_slices, salted_rank, stored, text_batches

CAPACITY, END_ID = 1024, 2
#: Numbers of groups and least lengths of a "large" piece that are tried; the plan with fewest sequences is taken.
GROUPS, LARGE = (16, 32, 64, 128), (64, 160, 320)
#: Distinct words whose ids a task keeps; then it starts anew, so memory is bounded.
KEPT_WORDS = 300_000

PIECES = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
NAMES = ["doc_id", *[n for n, _ in PIECES]]


# ---- tokens ----


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable character: itself, or one from U+0100 on in byte order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


def load_encoding(tokenizer_json: str) -> tiktoken.Encoding:
    """The tokenizer's vocabulary as byte ranks, for text between added tokens."""
    with open(tokenizer_json, encoding="utf-8") as f:
        model = json.load(f)["model"]
    byte = _byte_of_char()
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte for c in token)}
    special = {t for t in ranks if t.startswith(b"<|") and t.endswith(b"|>")}
    return tiktoken.Encoding("byte_bpe", pat_str=WORDS, mergeable_ranks={t: i for t, i in ranks.items() if t not in special}, special_tokens={})


#: Fixed value: how this vocabulary's tokenizer cuts text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of code points below 256, for Python's faster re.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
LATIN_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def added_tokens_of(tokenizer_json: str) -> dict[str, int]:
    """The tokens that the tokenizers library finds in a text before it cuts words, with their ids."""
    with open(tokenizer_json, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens with single_word, lstrip or rstrip are not supported")
    return {t["content"]: t["id"] for t in added}


@lru_cache(maxsize=1)
def _loaded(tokenizer_json: str, changed: int) -> tuple[tiktoken.Encoding, dict[str, int]]:
    """The vocabulary and the added tokens, once in a Python worker: the memory of one that a task lets go doesn't come back
    whole, so a worker would grow with its tasks. `changed` tells a file that was written anew."""
    return load_encoding(tokenizer_json), added_tokens_of(tokenizer_json)


def encoder(tokenizer_json: str) -> Callable[[str], bytes]:
    """text -> the ids that the tokenizers library gives it, as unsigned little-endian 32-bit words. The file's added
    tokens (<|endoftext|>) are found in the text first and keep their ids."""
    encoding, added_ids = _loaded(tokenizer_json, os.stat(tokenizer_json).st_mtime_ns)
    split = re.compile(LATIN_WORDS).findall

    class Words(dict):
        def __missing__(self, word: str) -> bytes:
            ids = np.array(encoding.encode_ordinary(word), "<u4").tobytes()
            if len(self) >= KEPT_WORDS:
                self.clear()
            if len(word) <= 40:
                self[word] = ids
            return ids

    words = Words()

    def encode(text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return np.array(encoding.encode_ordinary(text), "<u4").tobytes()
        return b"".join(map(words.__getitem__, split(text)))

    added = {t: np.array([i], "<u4").tobytes() for t, i in added_ids.items()}
    if not added:
        return encode
    cut_at = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split

    def encode_with_added(text: str) -> bytes:
        parts = cut_at(text)
        return b"".join(added[p] if k % 2 else encode(p) for k, p in enumerate(parts)) if len(parts) > 1 else encode(text)

    return encode_with_added


def cut(n: int, capacity: int = CAPACITY) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all have `capacity` ids but the first, which may be shorter."""
    first = n if n <= capacity else n % capacity or capacity
    yield 0, first
    for start in range(first, n, capacity):
        yield start, capacity


def pieces(docs: DataFrame, tokenizer_json: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document, with a checksum of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_json), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for i, body in enumerate(batch.column(1)):
                ids = encode(body.as_py() or "") + end
                rows += [(i, k, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)])) for k, (a, n) in enumerate(cut(len(ids) // 4, capacity))]
            if rows:
                at, *columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *[pa.array(c, t) for c, (_, t) in zip(columns, PIECES, strict=True)]], NAMES)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# ---- the plan, from a histogram of lengths ----


def _grouped_runs(counts: np.ndarray, n_groups: int, least: int) -> list[list]:
    """Runs [how many sequences, lengths in each, space left] for the pieces of at least `least` ids.

    Linear grouping: from the longest on, equal numbers of pieces form a group, and all are taken to be as long as
    its longest. Configurations: the longest group left is completed to the fullest sequence (a knapsack over the
    few sizes), as often as its groups last. Then actual lengths replace the rounded ones.
    """
    capacity = len(counts) - 1
    lengths = [n for n in range(capacity, least - 1, -1) if counts[n]]
    total = int(sum(counts[n] for n in lengths))
    if not total:
        return []
    per_group = -(-total // n_groups)
    groups: list[list[list[int]]] = []  # each: [length, how many], longest first
    room = 0
    for n in lengths:
        left = int(counts[n])
        while left:
            if not room:
                groups.append([])
                room = per_group
            t = min(left, room)
            groups[-1].append([n, t])
            left, room = left - t, room - t
    sizes = [g[0][0] for g in groups]
    stock = [sum(t for _, t in g) for g in groups]
    runs: list[list] = []
    for g in range(len(groups)):
        while stock[g]:
            used = _complete(sizes, stock, g, capacity)
            times = min(stock[k] // c for k, c in used.items())
            slots = [k for k, c in sorted(used.items()) for _ in range(c)]
            for k, c in used.items():
                stock[k] -= c * times
            while times:
                # from both ends of a group, so that a sequence's lengths vary little from their mean
                t = times
                need: dict[int, int] = {}
                for k in slots:
                    need[k] = need.get(k, 0) + 1
                for k, c in need.items():
                    t = min(t, max(1, groups[k][-1][1] // c)) if groups[k][-1][1] >= c else 1
                taken = []
                for k in slots:
                    left = t
                    while left and groups[k]:
                        if groups[k][-1][1] >= left:
                            taken.append(groups[k][-1][0])
                            groups[k][-1][1] -= left
                            left = 0
                        else:  # only with t = 1: cannot happen, a length with no piece left is dropped below
                            groups[k].pop()
                    if groups[k] and not groups[k][-1][1]:
                        groups[k].pop()
                runs.append([t, taken, capacity - sum(taken)])
                times -= t
    return runs


def _complete(sizes: list[int], stock: list[int], first: int, capacity: int) -> dict[int, int]:
    """Group -> pieces of the fullest sequence that holds a piece of `first`; later groups in stock may join."""
    room = capacity - sizes[first]
    best: list[tuple[int, int] | None] = [None] * (room + 1)  # fill -> (group, fill before)
    uses: list[dict[int, int]] = [{} for _ in range(room + 1)]
    reached = [False] * (room + 1)
    reached[0] = True
    for k in range(first, len(sizes)):
        own, size = stock[k] - (k == first), sizes[k]
        if own <= 0 or size > room:
            continue
        for fill in range(room - size + 1):
            to = fill + size
            if reached[fill] and not reached[to] and uses[fill].get(k, 0) < own:
                reached[to], best[to] = True, (k, fill)
                uses[to] = uses[fill] | {k: uses[fill].get(k, 0) + 1}
    fill = max(i for i in range(room + 1) if reached[i])
    return {first: 1} | {k: c + (k == first) for k, c in uses[fill].items()}


def _best_fit(runs: list[list], counts: np.ndarray, below: int) -> list[list]:
    """Pieces shorter than `below`, longest first, into the least space that holds them, many sequences at a time."""
    capacity = len(counts) - 1
    by_space: dict[int, list[list]] = {}
    for r in runs:
        by_space.setdefault(r[2], []).append(r)
    spaces = sorted(by_space)
    done: list[list] = []

    def put(run: list) -> None:
        if run[2] == 0:
            done.append(run)
        elif run[2] in by_space:
            by_space[run[2]].append(run)
        else:
            by_space[run[2]] = [run]
            bisect.insort(spaces, run[2])

    for n in range(min(below, len(counts)) - 1, 0, -1):
        left = int(counts[n])
        while left:
            at = bisect.bisect_left(spaces, n)
            if at == len(spaces):
                c = min(left, capacity // n)
                run = [left // c, [n] * c, capacity - c * n]
                left -= run[0] * c
                put(run)
                continue
            space = spaces[at]
            run = by_space[space].pop()
            if not by_space[space]:
                del by_space[space], spaces[at]
            t = min(run[0], left)
            c = min(space // n, max(1, left // t)) if t == run[0] else 1
            if t < run[0]:
                put([run[0] - t, run[1], space])
            put([t, [*run[1], *[n] * c], space - c * n])
            left -= t * c
    return done + [r for rs in by_space.values() for r in rs]


def plan(counts: np.ndarray) -> np.ndarray:
    """Rows (length, first rank, base sequence, offset), sorted: the pieces of a length with ranks from `first rank`
    up to the next row's go to sequences base, base + 1, ... at `offset`. counts[n]: pieces of n ids.
    It needs no more than the histogram, so its size depends on the capacity, not on the number of documents."""
    best: list[list] | None = None
    for least in LARGE:
        for n_groups in GROUPS:
            runs = _best_fit(_grouped_runs(counts, n_groups, least), counts, least)
            if best is None or sum(r[0] for r in runs) < sum(r[0] for r in best):
                best = runs
    rows, rank, base = [], np.zeros(len(counts), np.int64), 0
    for times, lengths, _ in best or []:
        offset = 0
        for n in lengths:
            rows.append((n, rank[n], base, offset))
            rank[n] += times
            offset += n
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer_json: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): a row for each piece of each document.

    Pieces are tokenized once, into a stored table. The driver sees a histogram of their lengths (at most `capacity`
    rows) and plans from it; each piece then finds its place by its rank among the pieces of its length. Ranks are
    taken in slices of a hash whose number follows the pieces, so that a frequent length meets no single task.
    A null text is an empty one: the end id alone. A doc_id of any type stays as it is, null too. Repeated rows are
    documents of their own; a text of any length is tokenized whole. Added tokens of the file (<|endoftext|>) that a
    text spells get their ids, as in the tokenizers library. No rows give no rows. Other columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    with text_batches(docs.sparkSession):
        cut_up = stored(pieces(docs, tokenizer_json, text, doc_id, capacity).withColumn("__h", F.xxhash64(F.col("doc_id").cast("string"), "piece", "ids_crc32")), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in cut_up.groupBy("length").count().collect():  # at most `capacity` rows
        counts[n] = c
    steps = plan(counts)
    sliced = cut_up.withColumn("__slice", F.pmod("__h", F.lit(n_slices(int(counts.max())))))
    ranked = salted_rank(sliced, ["length"], "__slice", [F.col("__h"), F.col("doc_id"), F.col("piece")], "__rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (steps[:, 0] << 44) + steps[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            row = steps[np.searchsorted(keys, (length.astype(np.int64) << 44) + rank, "right") - 1] if b.num_rows else np.zeros((0, 4), np.int64)
            placed = [pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in NAMES], *placed], [*NAMES, "sequence_id", "offset"])

    return ranked.select(*NAMES, "__rank").mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
