"""N-gram Jaccard join: globally ordered n-gram sets, candidates below trie nodes, overlaps counted along a trie."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradarium.llm.common import anti_join, mixed, numbered, semi_join, slices, stored, text_batches, utf8
from gradarium.llm.suffix_dedup import COMPARE, SENT, SENT_SQL, by_doc, by_hash, decode_all, message

#: N-grams that a task gathers before it sorts them and sends them on.
GATHER = 500_000
#: Bits of an n-gram's fingerprint in the first, coarse count; equal ones there are a superset of equal n-grams.
COARSE_BITS = 40
#: N-grams that meet in one bucket, about: the number of buckets follows from the counted n-grams.
BUCKET = 2_000_000
#: Sets that meet one other set in one task; a set with more candidates is copied to several tasks.
GROUP = 200
#: A pair with the n-grams of both is about as much to read as so many narrow rows.
PAIR = 20
#: A set's parity map has so many words of 64 bits.
MAPS = 4
SETS = "doc long, n long, grams binary, kept long, " + ", ".join(f"m{k} long" for k in range(MAPS))
#: Bytes of whole texts whose n-grams are made at a time: numpy holds about sixty bytes for each.
READ = 250_000
#: Bytes of a long text that are read at a time, and the places in a word that have random numbers of their own in a table.
PIECE, PLACES = 500_000, 64
SIZE = 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


# ---- sets ----


@lru_cache(maxsize=4)
def _numbers(seed: int) -> np.ndarray:
    """A random number for each byte at each of PLACES places."""
    return mixed(np.arange(PLACES * 256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def word_values(data: np.ndarray, ends: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, text) of each word of texts that lie one after the other. A word is a run without white space,
    A-Z lower-cased. Its hash sums up a random number for each pair of byte and place, so no word has a pattern that
    another undoes. Bytes are read PIECE at a time, whatever the length of texts and words."""
    numbers, sums, sizes, texts = _numbers(seed), [], [], []
    inside = False
    for lo in range(0, len(data), PIECE):
        piece = _LOWER[data[lo : lo + PIECE]]
        word = ~_SPACE[piece]
        cut = np.zeros(len(piece) + 1, bool)
        a, b = np.searchsorted(ends, [lo, lo + len(piece)])
        cut[ends[a:b] - lo] = True
        place = np.flatnonzero(word)
        if not len(place):
            inside = False
            continue
        first = word & ~np.append(False, word[:-1]) | word & cut[:-1]
        goes_on = inside and word[0] and not cut[0]
        first[0] |= word[0]
        start = np.flatnonzero(first)
        of = np.cumsum(first)[place] - 1
        at = place - start[of]
        if goes_on:
            at[of == 0] += sizes[-1][-1]
        own = numbers[(at % PLACES) * 256 + piece[place]]
        far = at >= PLACES
        if far.any():
            own[far] = mixed(own[far] + (at[far] // PLACES).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        bounds = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        sum_, size = np.add.reduceat(own, bounds), np.diff(np.append(bounds, len(of)))
        if goes_on:
            sums[-1][-1:] += sum_[:1]
            sizes[-1][-1:] += size[:1]
            sum_, size, start = sum_[1:], size[1:], start[1:]
        if len(sum_):
            sums.append(sum_)
            sizes.append(size)
            texts.append(np.searchsorted(ends, start + lo, "right") - 1)
        inside = bool(word[-1])
    if not sums:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return mixed(np.concatenate(sums) + np.concatenate(sizes).astype(np.uint64)), np.concatenate(texts)


def ngram_sets(data: np.ndarray, ends: np.ndarray, n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram) of the distinct n-grams of each text, in this order, as 64-bit fingerprints. Texts lie one after
    the other; fewer than n words are one n-gram."""
    value, text = word_values(data, ends, seed)
    count = np.bincount(text, minlength=len(ends) - 1)
    last = np.cumsum(count)

    def joined(at: np.ndarray, k: int) -> np.ndarray:
        h = np.full(len(at), k, np.uint64)
        for i in range(k):
            h = mixed(h * np.uint64(0x9FB21C651E98DF25) + value[at + i])
        return h

    whole = np.flatnonzero(np.arange(len(value)) + n <= last[text]) if len(value) else np.zeros(0, np.int64)
    grams, of = [joined(whole, n)], [text[whole]]
    for k in range(1, n):
        few = np.flatnonzero(count == k)
        grams.append(joined(last[few] - k, k))
        of.append(few)
    gram, of = np.concatenate(grams), np.concatenate(of)
    order = np.lexsort((gram, of))
    gram, of = gram[order], of[order]
    new = np.append(True, (gram[1:] != gram[:-1]) | (of[1:] != of[:-1]))[: len(gram)]
    return of[new], gram[new]


def _each(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers of a run of texts, text, n-gram) of a number and a text column. From here on a document is a row."""
    for batch in batches:
        doc = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        data, ends = utf8(batch.column(1))
        for i, j in slices(ends, READ):
            yield doc[i:j], *ngram_sets(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], n)


def _signatures(n: int):
    """Of each text, with its row number and doc_id, the size of its set and two sums over it, equal for equal sets. The
    sums are of two independent hashes of the n-grams: 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8(batch.column(1))
            for i, j in slices(ends, READ):
                part, at = data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
                found = []
                for seed in (1, 2):
                    of, gram = ngram_sets(part, at, n, seed)
                    size = np.bincount(of, minlength=j - i)
                    sums = np.append(np.uint64(0), np.cumsum(mixed(gram)))
                    cut = np.append(0, np.cumsum(size))
                    found += [size.astype(np.int64), (sums[cut[1:]] - sums[cut[:-1]]).view(np.int64)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), *map(pa.array, (found[0], found[1], found[3]))], ["doc", "doc_id", "n", "s1", "s2"])

    return run


# ---- which sets can have a partner at all ----


def _sent(n: int, n_homes: int, messages):
    """Sizes of sets to their homes, and what `messages` makes of (n-gram, doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        sizes: list[tuple[np.ndarray, np.ndarray]] = []

        def send() -> Iterator[pa.RecordBatch]:
            gram, doc = (np.concatenate(c) for c in zip(*held, strict=True))
            of, size = (np.concatenate(c) for c in zip(*sizes, strict=True))
            held.clear()
            sizes.clear()
            some = size > 0
            yield from message(SIZE, by_doc(of[some], n_homes), [of[some], size[some]])
            yield from messages(gram, doc)

        for doc, of, gram in _each(batches, n):
            held.append((gram, doc[of]))
            sizes.append((doc, np.bincount(of, minlength=len(doc))))
            if sum(len(h[0]) for h in held) >= GATHER:
                yield from send()
        if held:
            yield from send()

    return run


def _coarse(n: int, n_buckets: int, n_homes: int):
    return _sent(n, n_homes, lambda gram, doc: message(COMPARE, by_hash(gram, n_buckets), [(gram >> np.uint64(64 - COARSE_BITS)).view(np.int64), doc]))


def _passed_on(table: pa.Table, kind: int) -> pa.RecordBatch:
    rows = table.filter(pc.equal(table["kind"], kind)).select(SENT.names)
    return pa.record_batch([c.combine_chunks() for c in rows.columns], schema=SENT)


def _group(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (key, doc) without repeats, and in how many documents each row's key is."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))[: len(key)]
    key, doc = key[new], doc[new]
    group = np.cumsum(np.append(False, key[1:] != key[:-1])[: len(key)])
    return key, doc, np.bincount(group)[group] if len(group) else group


def _count_shared(n_homes: int):
    """For each document: how many of its n-grams in this bucket another document has."""

    def run(table: pa.Table) -> pa.Table:
        key, doc = decode_all(table, COMPARE, 2)
        _, doc, df = _group(key, doc)
        docs, count = np.unique(doc[df > 1], return_counts=True)
        return pa.Table.from_batches([_passed_on(table, SIZE), *message(COMPARE, by_doc(docs, n_homes), [docs, count])], SENT)

    return run


def _sum_shared(num: int, den: int):
    """Documents whose shared n-grams are enough for the threshold with any partner."""

    def run(table: pa.Table) -> pa.Table:
        doc, size = decode_all(table, SIZE, 2)
        shared_doc, count = decode_all(table, COMPARE, 2)
        docs, at = np.unique(np.concatenate([doc, shared_doc]), return_inverse=True)
        n = np.zeros(len(docs), np.int64)
        np.maximum.at(n, at[: len(doc)], size)
        shared = np.zeros(len(docs), np.int64)
        np.add.at(shared, at[len(doc) :], count)
        return pa.table([pa.array(docs[(den * shared >= num * n) & (shared > 0)], pa.int64())], ["doc"])

    return run


# ---- globally ordered sets ----


def _exact(n: int, n_buckets: int, n_homes: int):
    return _sent(n, n_homes, lambda gram, doc: message(COMPARE, by_hash(gram, n_buckets), [gram.view(np.int64), doc]))


def _frequencies(n_homes: int):
    """n-grams in two documents or more, with their frequency, back to their documents."""

    def run(table: pa.Table) -> pa.Table:
        key, doc = decode_all(table, COMPARE, 2)
        key, doc, df = _group(key, doc)
        many = df > 1
        return pa.Table.from_batches([_passed_on(table, SIZE), *message(COMPARE, by_doc(doc[many], n_homes), [doc[many], key[many], df[many]])], SENT)

    return run


def prefix_size(n: int, num: int, den: int) -> int:
    """A set of n n-grams shares one of its first so many with any partner, in the global order."""
    return n - -(-num * n // den) + 1


def parity_map(gram: np.ndarray) -> list[int]:
    """64 * MAPS bits as numbers: whether an odd number of the n-grams fall on each. Bits in which the maps of two sets differ
    are at most the n-grams in which the sets do."""
    odd = np.bincount((gram & (64 * MAPS - 1)).astype(np.int64), minlength=64 * MAPS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _ordered(num: int, den: int):
    """A set as its size n and its shared n-grams by (frequency, fingerprint); those that no other set has come first
    in the order and are only counted. A set whose prefix holds none of the shared ones has no partner."""

    def run(table: pa.Table) -> pa.Table:
        doc, size = decode_all(table, SIZE, 2)
        n_of: dict[int, int] = {}
        for d, s in zip(doc.tolist(), size.tolist(), strict=True):
            n_of[d] = max(n_of.get(d, 0), s)
        d, gram, df = decode_all(table, COMPARE, 3)
        order = np.lexsort((gram.view(np.uint64), df, d))
        d, gram = d[order], gram[order]
        start = np.flatnonzero(np.append(True, d[1:] != d[:-1])[: len(d)])
        rows = []
        for a, b in zip(start, np.append(start[1:], len(d))[: len(start)], strict=True):
            n = n_of[int(d[a])]
            if prefix_size(n, num, den) > n - (b - a):
                rows.append((int(d[a]), n, gram[a:b].tobytes(), b - a, *parity_map(gram[a:b])))
        columns = zip(*rows, strict=True) if rows else [()] * (4 + MAPS)
        kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * (1 + MAPS)]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], SETS.replace(" long", "").replace(" binary", "").split(", "))

    return run


def _prefixes(num: int, den: int):
    """(gram, doc, n, at) of the shared n-grams in each set's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, n, raw in zip(*[c.to_pylist() for c in b.columns], strict=True):
                gram = np.frombuffer(raw, np.int64)
                alone = n - len(gram)
                gram = gram[: prefix_size(n, num, den) - alone]
                k = len(gram)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.full(k, doc)), pa.array(np.full(k, n)), pa.array(alone + np.arange(k))], ["gram", "doc", "n", "at"])

    return run


# ---- overlaps along a trie ----


class Trie:
    """Globally ordered sets of n-grams as a trie: sorted paths, from their most frequent n-gram on, and how long each
    agrees with the one before it. A node is a range of sorted sets; its children begin where neighbours part."""

    def __init__(self, sets: list[tuple[int, np.ndarray]]):
        paths = [np.ascontiguousarray(g[::-1]) for _, g in sets]
        self.order = sorted(range(len(sets)), key=lambda i: paths[i].tobytes())
        self.paths = [paths[i] for i in self.order]
        self.length = np.array([len(p) for p in self.paths])
        self.size = np.array([sets[i][0] for i in self.order])
        self.agree = np.zeros(len(sets), np.int64)
        for i in range(1, len(sets)):
            a, b = self.paths[i - 1], self.paths[i]
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[:k] != b[:k])
            self.agree[i] = differ[0] if len(differ) else k
        self.cut = 0  # sets below the nodes where the last traversals turned back

    def similar(self, pivot: np.ndarray, n_pivot: int, num: int, den: int) -> np.ndarray:
        """Which sets are similar to the pivot. The overlap with the pivot is counted once for all sets below a node;
        where it and the most that can follow miss the threshold for each of them, the whole subtree is left."""
        pivot = np.sort(pivot)
        out = np.zeros(len(self.paths), bool)
        if not len(self.paths) or not len(pivot):
            return out
        stack = [(0, len(self.paths), 0, 0)]
        while stack:
            lo, hi, depth, overlap = stack.pop()
            need = -(-num * (n_pivot + int(self.size[lo:hi].min())) // (num + den))
            longest = int(self.length[lo:hi].max())
            if overlap + min(longest - depth, len(pivot) - overlap) < need:
                self.cut += hi - lo
                continue
            end = int(self.agree[lo + 1 : hi].min()) if hi - lo > 1 else len(self.paths[lo])
            if end > depth:
                edge = self.paths[lo][depth:end]
                at = np.minimum(np.searchsorted(pivot, edge), len(pivot) - 1)
                overlap += int((pivot[at] == edge).sum())
                if overlap + min(longest - end, len(pivot) - overlap) < need:
                    self.cut += hi - lo
                    continue
            while lo < hi and self.length[lo] == end:  # sets that end at this node come first
                out[self.order[lo]] = den * overlap >= num * (n_pivot + int(self.size[lo]) - overlap)
                lo += 1
            if lo < hi:
                starts = [lo, *(lo + 1 + np.flatnonzero(self.agree[lo + 1 : hi] == end)).tolist(), hi]
                stack += [(a, b, end, overlap) for a, b in zip(starts, starts[1:], strict=False)]
        return out


def trie_overlaps(pivot: np.ndarray, n_pivot: int, sets: list[tuple[int, np.ndarray]], num: int, den: int) -> np.ndarray:
    """Which of the sets (size, ordered shared n-grams) are similar to the pivot."""
    return Trie(sets).similar(pivot, n_pivot, num, den)


def _verify(num: int, den: int):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        pivot = np.frombuffer(right["a_grams"].iloc[0], np.int64)
        sets = [(int(n), np.frombuffer(g, np.int64)) for n, g in zip(left["b_n"], left["b_grams"], strict=True)]
        similar = trie_overlaps(pivot, int(right["a_n"].iloc[0]), sets, num, den)
        return pd.DataFrame({"a": left["a"][similar], "b": left["b"][similar]})

    return run


def similar_pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int, about: int) -> DataFrame:
    """The similar ones of the distinct pairs (a, b), about so many: the candidates of a meet it in groups of about GROUP."""
    pairs = stored(pairs.distinct(), "pairs", about)
    n_pairs = pairs.count()
    parts = stored(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts")), "pivots", n_pairs)
    placed = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
    left = placed.join(sets.select("doc", "n", "grams").toDF("b", "b_n", "b_grams"), "b")
    right = parts.join(sets.select("doc", "n", "grams").toDF("a", "a_n", "a_grams"), "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return stored(left.groupBy("a", "part").cogroup(right.groupBy("a", "part")).applyInPandas(_verify(num, den), "a long, b long"), "links", PAIR * n_pairs)


def components(links: DataFrame) -> DataFrame:
    """(doc, label) of the ends of links (a, b): the smallest doc that each can reach. Labels spread along links and
    then jump to their label's label, so rounds grow with the logarithm of a component's width."""
    n = 2 * links.count()
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", n)
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("doc"), F.least("a", "m").alias("label")), "labels", n)
    while True:
        near = both.join(labels.withColumnRenamed("doc", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels["doc"] == near["a"]).select("doc", F.col("label").alias("old"), F.least("label", "near").alias("l"))
        spread = stored(spread, "spread", n)
        jump = labels.select(F.col("doc").alias("l"), F.col("label").alias("far"))
        new = stored(spread.join(jump, "l", "left").select("doc", "old", F.least("l", F.coalesce("far", "l")).alias("label")), "labels", n)
        if not new.where("label < old").limit(1).count():
            return new.select("doc", "label")
        labels = new.select("doc", "label")


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (doc, label) after more links (a, b): only the labels that these touch spread anew."""
    n = links.count()
    by = lambda end: labels.select(F.col("doc").alias(end), F.col("label").alias(f"l{end}"))
    ends = links.join(by("a"), "a", "left").join(by("b"), "b", "left")
    ends = stored(ends.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")), "ends", n)
    moved = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("doc").alias("label"), F.col("label").alias("to"))
    all_ = labels.unionByName(ends.select(F.col("a").alias("doc"), F.col("la").alias("label"))).unionByName(ends.select(F.col("b").alias("doc"), F.col("lb").alias("label"))).distinct()
    return stored(all_.join(moved, "label", "left").select("doc", F.coalesce("to", "label").alias("label")), "labels", labels.count() + 2 * n)


def _below(num: int, den: int):
    """Of each set at a trie node (the level-th common n-gram of it and a similar set stands at place `at`), the nodes
    further down at level `to` that both can share: the to-th common n-gram is one of a few, since each that is passed
    over is missed, and no set can miss more than its size less the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, range_, doc, label, n, at, level, to, raw in zip(*[c.to_pylist() for c in b.columns], strict=True):
                gram = np.frombuffer(raw, np.uint64)
                alone = n - len(gram)
                first = at + to - level
                place = np.arange(first - alone, min(n + -num * n // den + to - alone, len(gram)))
                k = len(place)
                below = mixed(np.full(k, node, np.int64).view(np.uint64) * np.uint64(0x9FB21C651E98DF25) + gram[place]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(below), *[pa.array(np.full(k, x)) for x in (range_, doc, label, n)], pa.array(alone + place), pa.array(np.full(k, to)), pa.array(np.full(k, node))], ["node", "range", "doc", "label", "n", "at", "level", "above"])

    return run


def _open_nodes(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, k, most): nodes whose sets have several labels, with their number and the label of most."""
    counts = rows.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("c"))
    found = counts.groupBy(*by).agg(F.sum("c").alias("k"), F.count(F.lit(1)).alias("labels"), F.max(F.struct("c", "label"))["label"].alias("most"))
    return found.where("labels > 1").drop("labels")


def candidates_below(rows: DataFrame, sets: DataFrame, num: int, den: int, width: float) -> DataFrame:
    """Candidate pairs (a, b) with different labels among rows (node, range, doc, label, n, at, level): at the nodes
    themselves, or, where more than GROUP sets with several labels stand at a node, at nodes further down the trie, a
    quarter of the least overlap at a time, as long as that at least halves the pairs. Every similar pair stands
    together at one node of each level, so none is lost whichever is taken. Sets at a node have sizes of two ranges."""
    pairs = None
    for quarter in (1, 2, 3, 4):
        n_rows = rows.count()
        nodes = stored(_open_nodes(rows, ["node"]), "nodes", n_rows)
        here = stored(rows.join(nodes, "node"), "at_nodes", n_rows)
        least = F.ceil(F.lit(num) * F.floor(F.exp((F.col("range") - 1) * F.lit(width)) * F.lit(1 - 1e-9)) / F.lit(den))
        to = F.greatest(F.col("level") + 1, F.floor(least * quarter / 4))
        big, below = here.withColumn("to", to.cast("long")).where((F.col("k") > GROUP) & (F.col("to") <= least)), None
        if quarter < 4 and big.limit(1).count():
            down = big.join(sets.select("doc", "grams"), "doc").select("node", "range", "doc", "label", "n", "at", "level", "to", "grams")
            below = stored(down.mapInArrow(_below(num, den), "node long, range long, doc long, label long, n long, at long, level long, above long"), "below")
            less = _open_nodes(below, ["above", "node"]).groupBy("above").agg(F.sum(F.col("k") * (F.col("k") - 1)).alias("pairs"))
            left = big.select("node", "k").distinct().join(less.withColumnRenamed("above", "node"), "node", "left")
            better = stored(left.where(F.coalesce("pairs", F.lit(0)) * 2 <= F.col("k") * (F.col("k") - 1)).select("node"), "better", n_rows)
            here = here.join(better, "node", "left_anti")
        # bounds for the case that the node is all that both have in common so far: sizes, and what can follow
        # a pair meets at the node of the greater of its ranges only
        here = here.withColumn("own", F.floor(F.log(F.col("n").cast("double")) / F.lit(width)))
        # what two sets can have in common, given in how many bits their maps differ
        here = here.join(sets.drop("n", "grams"), "doc")
        differ = " + ".join(f"bit_count(x.m{k} ^ y.m{k})" for k in range(MAPS))
        x, y = here.where("label != most").alias("x"), here.alias("y")
        fits = "greatest(x.own, y.own) = x.range and x.label != y.label and (y.label = y.most or x.doc < y.doc) and {den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n) and ({num} + {den}) * (x.level + least(x.n - x.at, y.n - y.at) - 1) >= {num} * (x.n + y.n) and ({num} + {den}) * (x.kept + y.kept - ({differ})) >= 2 * {num} * (x.n + y.n)".format(num=num, den=den, differ=differ)
        own = x.join(y, F.col("x.node") == F.col("y.node")).where(fits).select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"))
        pairs = own if pairs is None else pairs.unionByName(own)
        if below is None or not better.limit(1).count():
            break
        rows = stored(below.join(better.withColumnRenamed("node", "above"), "above").drop("above").distinct(), "rows_below", below.count())
    return pairs


def _linked(held: DataFrame, n: int, num: int, den: int, text: str, doc_id: str) -> DataFrame:
    """(row, doc_id, n_shingles, least) of the rows of a table made by `numbered`; least: (no_id, doc_id, row) of the
    smallest row that links reach, null for a row without a word."""
    spark = held.sparkSession
    own = held.select(F.col("row").alias("doc"), F.col("held").getField(text).alias("text"), F.col("held").getField(doc_id).alias("doc_id"))
    kind = own.schema["doc_id"].dataType.simpleString()
    with text_batches(spark):
        signed = stored(own.mapInArrow(_signatures(n), f"doc long, doc_id {kind}, n long, s1 long, s2 long"), "signatures")
    own = own.drop("doc_id")
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("doc").alias("row"))).alias("least")
    classes = stored(signed.where("n > 0").groupBy("s1", "s2", "n").agg(smallest).withColumn("rep", F.col("least.row")), "classes", signed.count())
    n_reps, n_grams = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # n-grams meet in n_buckets, what is found about rows in n_homes: a bucket sends at most n_homes messages
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_grams // BUCKET)
    n_homes = max(8, n_buckets // 4)

    def buckets(rows: DataFrame, send, meet, home, schema: str, name: str) -> DataFrame:
        there = rows.mapInArrow(send, SENT_SQL).groupBy("bucket").applyInArrow(meet, SENT_SQL)
        with text_batches(spark):
            return stored(there.groupBy("bucket").applyInArrow(home, schema), name, n_grams // PAIR)

    reps = classes.select(F.col("rep").alias("doc"))
    rows = semi_join(own, reps, "doc", n_reps)
    able = buckets(rows, _coarse(n, n_buckets, n_homes), _count_shared(n_homes), _sum_shared(num, den), "doc long", "able")
    rows = semi_join(own, able, "doc", able.count())
    sets = buckets(rows, _exact(n, n_buckets, n_homes), _frequencies(n_homes), _ordered(num, den), SETS, "sets")
    prefixes = stored(sets.select("doc", "n", "grams").mapInArrow(_prefixes(num, den), "gram long, doc long, n long, at long"), "prefixes")

    # a set of n meets those of num/den * n to den/num * n: pivots are chosen in ranges of sizes of that width
    width, n_prefixes = float(np.log(den / num)) or 1.0, prefixes.count()
    ranged = prefixes.withColumn("range", F.floor(F.log(F.col("n").cast("double")) / width))
    # the pivot is the set with the fewest rare n-grams: an original rather than one of its altered copies
    central = F.min(F.struct("at", "doc"))["doc"].alias("a")
    pivots = stored(ranged.groupBy("gram", "range").agg(central, F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "pivots", n_prefixes)
    first = similar_pairs(ranged.join(pivots, ["gram", "range"]).where("a <> doc").select("a", F.col("doc").alias("b")), sets, num, den, n_prefixes)
    labels = components(first)

    # ranges of two similar sets differ by one at most, so they meet in the greater: each set stands in its own and the next
    labelled = ranged.join(labels, "doc", "left").withColumn("range", F.explode(F.array("range", F.col("range") + 1)))
    labelled = labelled.select(F.xxhash64("gram", "range").alias("node"), "range", "doc", F.coalesce("label", "doc").alias("label"), "n", "at", F.lit(1).cast("long").alias("level"))
    second = similar_pairs(candidates_below(stored(labelled, "labelled", 2 * n_prefixes), sets, num, den, width), sets, num, den, 2 * n_prefixes)
    labels = (joined_labels(labels, second) if second.limit(1).count() else labels).withColumnRenamed("doc", "rep")

    named = classes.join(labels, "rep", "left").select("s1", "s2", F.col("n").alias("size"), "least", "label")
    named = stored(named, "named", n_reps)
    firsts = stored(named.where("label is not null").groupBy("label").agg(F.min("least").alias("first")), "firsts", n_reps)
    named = named.join(firsts, "label", "left").select("s1", "s2", "size", F.coalesce("first", "least").alias("least"))
    out = signed.join(named, (signed["s1"] == named["s1"]) & (signed["s2"] == named["s2"]) & (signed["n"] == named["size"]), "left")
    return out.select(F.col("doc").alias("row"), "doc_id", F.col("n").alias("n_shingles"), "least")


def similarity_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id): documents link when their sets of n-word shingles have a Jaccard similarity
    of num / den at least; component_id is the smallest doc_id that links reach.

    1. Rows are numbered and stored once. Rows with equal sets form a class; the number of its smallest row stands for
       it from here on.
    2. A class stays if enough of its n-grams are in another one for any partner to reach the threshold.
    3. N-grams are ordered by document frequency, then fingerprint. Similar sets share one in their prefixes.
    4. Each prefix n-gram names a pivot, its set with the fewest rare n-grams, in each range of sizes; all sets with that n-gram are put into a trie, which is
       traversed with the pivot: overlaps are shared along it, subtrees that can't reach the threshold are left. Sets
       that link to a pivot are in one component whatever else holds between them.
    5. N-grams whose sets are still in several components are nodes of the trie over all prefixes: pairs across
       components are compared, and where many sets stand at a node, only those that also meet further down. Pairs whose
       sizes, places or parity maps show that too little can be common never leave the node.
       So large groups of near copies cost a comparison a member, and no link between components is lost.
    Shingles are compared by 64-bit fingerprints (for a pair of sets of k shingles each, the chance that two that differ
    agree is below k * k / 2^64), equal sets by 128 bits.

    A text that is null or has no word has n_shingles 0 and links with nothing: component_id is its doc_id. Each row is
    a document of its own, also where doc_ids repeat or are null; doc_ids may be of any type with an order. A null
    doc_id is greater than all others, so component_id is null where no row of a component has one. Texts and words of
    any length are read in pieces. Other columns are not read. No rows: none.
    """
    held = numbered(docs.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id")), "numbered")
    component = F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return _linked(held, n, num, den, "text", "doc_id").select("doc_id", "n_shingles", component.alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each group that links, directly or through others: that with the smallest doc_id (null is
    greater than all), and of several with it that with the smallest row number. Rows without a word all stay."""
    held = numbered(docs, "numbered")
    found = _linked(held, n, num, den, text, doc_id)
    dropped = stored(found.where("row != least.row").select(F.col("row").alias("__dropped")), "near_copies", held.count())
    return anti_join(held, dropped, "row", "__dropped").select("held.*")
