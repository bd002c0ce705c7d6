"""Hard negatives by an inverted multi-index: two half-space codebooks, cells visited by a multi-sequence heap."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradarium.llm.common import stored
from gradarium.llm.vectors import SLACK, cells_met, exact_type, first_k, ids_of, meetings, unpacked, whole_vectors, width_of

#: Rows by which the codebooks are fitted at most (those of least hash); every row is indexed.
SAMPLE_ROWS = 20_000
#: Centroids of a half at most, groups of them; a block is a pair of groups, its rows meet queries together.
CENTROIDS, GROUPS = 32, 4
#: Components that a task holds at most; rows of the cells that the heap has named before their products are taken.
COMPONENTS, VISIT = 2**21, 512
FOUND = "q_row long, q_id long, top long, score long, id long, row long"
ALL = np.iinfo(np.int64).max


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, the group of each) by k-means from spread-out starts; alike centroids are in one group."""
    rng, x = np.random.default_rng(0), x.astype(np.float64)
    if not len(x) or not x.shape[1]:
        return np.zeros((1, x.shape[1])), np.zeros(1, np.int64)
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < k and far.max() > 0:
        chosen.append(int(rng.choice(len(x), p=far / far.sum())))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    c = x[chosen]
    for _ in range(rounds):
        near = nearest(x, c)[0]
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, d], len(c)) for d in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    axis = np.linalg.svd(c - c.mean(0), full_matrices=False)[2][0]
    c = c[np.argsort(c @ axis, kind="stable")]
    return c, np.arange(len(c)) * GROUPS // max(len(c), GROUPS)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest centroid, its distance) of each row."""
    near = np.argmin((c**2).sum(1) - 2 * (x @ c.T), 1) if x.shape[1] else np.zeros(len(x), np.int64)
    return near, np.sqrt(((x - c[near]) ** 2).sum(1))


def half_bounds(q: np.ndarray, halves: list[tuple]) -> list[np.ndarray]:
    """For each half: what the product of a query's half with a row of each half-cell is at most: with the centroid, and the
    query's length times the radius."""
    out, at = [], 0
    for c, radius, _ in halves:
        own = q[:, at : at + c.shape[1]].astype(np.float64)
        reach = np.sqrt((own**2).sum(1))[:, None] * np.where(radius < 0, 0, radius)
        out.append(np.where(radius < 0, -np.inf, own @ c.T + reach + SLACK * np.sqrt((own**2).sum(1))[:, None] * np.sqrt((c**2).sum(1)) + SLACK * reach))
        at += c.shape[1]
    return out


def multi_sequence(one: np.ndarray, two: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) of all pairs by falling sum: a heap holds a place of each started row of the table of sums."""
    a, b = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
    heap = [(-(one[a[0]] + two[b[0]]), 0, 0)]
    while heap:
        s, i, j = heapq.heappop(heap)
        yield -s, a[i], b[j]
        if j + 1 < len(b):
            heapq.heappush(heap, (-(one[a[i]] + two[b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(one[a[i + 1]] + two[b[0]]), i + 1, 0))


class Cells:
    """Rows of one block by their cells."""

    def __init__(self, table: pa.Table, width: int):
        one, two = table.column("c1").to_numpy(), table.column("c2").to_numpy()
        self.one, a = np.unique(one, return_inverse=True)
        self.two, b = np.unique(two, return_inverse=True)
        cell = a * len(self.two) + b
        order = np.argsort(cell, kind="stable")
        self.ends = np.searchsorted(cell[order], np.arange(len(self.one) * len(self.two) + 1))
        self.x, self.ids, self.rows = unpacked(table.column("v"), width)[order], ids_of(table)[order], table.column("row").to_numpy()[order]
        self.known, self.label = table.column("id").is_valid().to_numpy()[order], table.column("label").to_numpy()[order]
        self.most = float(np.sqrt((self.x.astype(np.float64) ** 2).sum(1)).max())

    def search(self, q: np.ndarray, own: int, label: int, same: bool, windows: list[tuple[int, int]], s1: np.ndarray, s2: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, scores) for each window (low, high): the first k rows of the same label (but the query's own), or of
        another label, whose score is within it. Cells come by falling bound; a window is certified once the bound is below
        its low end, or below its k-th score."""
        kind = exact_type(float(np.sqrt((q.astype(np.float64) ** 2).sum())) * self.most)
        x, low = q.astype(kind), [w[0] for w in windows]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(windows)
        gathered: list[tuple[int, int]] = []
        size = 0

        def look() -> None:
            at = np.concatenate([np.arange(a, b) for a, b in gathered])
            at = at[(self.label[at] == label) == same]
            at = at[self.rows[at] != own]
            s = (self.x[at].astype(kind) @ x).astype(np.int64)
            for w, (_, high) in enumerate(windows):
                fine = (s >= low[w]) & (s <= high)
                if fine.any():
                    p, v = np.append(found[w][0], at[fine]), np.append(found[w][1], s[fine])
                    first = first_k(np.zeros(len(p), np.int8), v, self.ids[p], self.rows[p], k)
                    found[w] = p[first], v[first]
                    if len(first) == k:
                        low[w] = max(low[w], int(v[first[-1]]))

        for bound, i, j in multi_sequence(s1[self.one], s2[self.two]):
            if bound + 0.5 < min(low):  # every window is certified
                break
            c = i * len(self.two) + j
            a, b = self.ends[c], self.ends[c + 1]
            if a < b:
                gathered.append((a, b))
                size += b - a
                if size >= VISIT:
                    look()
                    gathered, size = [], 0
        if gathered:
            look()
        return found


def hard_negatives(rows: DataFrame, is_anchor: Column, label: Column, k: int = 5, n_positives: int = 5, low: int = 80, high: int = 100, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) by inner products of the vectors
    floor(scale * x): an anchor's positives are its first n_positives other rows of the same label; for each of them the
    first k rows of another label whose score is from `low` to `high` hundredths of the positive's. Higher scores come
    first, of equal ones the smaller id.

    The halves of all vectors have a codebook each (k-means over SAMPLE_ROWS rows at most), and every row lies in the cell
    of its two nearest centroids. A row's score is at most the sum of two half bounds, each a product with a centroid plus
    the length times that half-cell's radius, so a heap over two sorted lists visits cells by falling bound and stops when
    no window can change: results are exact. Blocks of cells are dealt out, in slices if they are large, and an anchor goes
    to the blocks whose bound reaches what it already has.

    Rows with a null label or vector, or a component that is null or not finite, take no part; shorter vectors are as if
    they ended in zeros. Rows that share an id, or have none, are rows of their own; a null id comes after all others. An
    anchor without positives, or whose windows are empty (as for scores below zero), gives no rows, nor does an empty table.
    Other columns don't matter, whatever their names."""
    width = width_of(rows, vector)
    columns = {"id": F.col(key).cast("long"), "label": label.cast("long"), "anchor": F.coalesce(is_anchor, F.lit(False))}
    base = stored(whole_vectors(rows.where(label.isNotNull()), vector, columns, scale, width), "negatives-vectors")
    sample = base.orderBy(F.xxhash64("v"), "row").select("v").limit(SAMPLE_ROWS).toArrow()
    x = unpacked(sample.column("v"), width) if sample.num_rows else np.zeros((0, width), np.int32)
    half = width // 2
    books = [codebook(x[:, :half], CENTROIDS), codebook(x[:, half:], CENTROIDS)]

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(batch.column("v"), width).astype(np.float64)
            (c1, d1), (c2, d2) = nearest(x[:, :half], books[0][0]), nearest(x[:, half:], books[1][0])
            block = books[0][1][c1] * GROUPS + books[1][1][c2]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c.astype(np.int32)) for c in (c1, c2, block)], pa.array(d1), pa.array(d2)], [*batch.schema.names, "c1", "c2", "block", "d1", "d2"])

    schema = base.withColumns({c: F.lit(0) for c in ("c1", "c2", "block")} | {c: F.lit(0.0) for c in ("d1", "d2")}).schema
    index = stored(base.mapInArrow(indexed, schema), "negatives-index")
    halves = []
    for (c, group), n, d in zip(books, ("c1", "c2"), ("d1", "d2"), strict=True):
        radius = np.full(len(c), -1.0)  # of half-cells without rows
        for r in index.groupBy(n).agg(F.max(d).alias("d")).collect():  # a row for each centroid
            radius[r[0]] = r.d
        halves.append((c, radius, group))
    counts = dict(index.groupBy("block").count().collect())  # at most GROUPS x GROUPS
    most = max(1, COMPONENTS // max(1, width))
    slices = np.array([-(-counts.get(b, 0) // most) for b in range(GROUPS * GROUPS)])
    first = np.cumsum(slices) - slices
    n_cells, n_anchors = int(slices.sum()), index.where("anchor").count()
    literal = lambda v: F.element_at(F.array(*[F.lit(int(i)) for i in v]), F.col("block") + 1)
    cells = index.withColumn("cell", (literal(first) + F.pmod(F.xxhash64("row"), F.greatest(literal(slices), F.lit(1)))).cast("int"))
    cells = cells.select("cell", "row", "id", "label", "v", "c1", "c2")

    def block_bounds(q: np.ndarray) -> np.ndarray:
        one, two = half_bounds(q, halves)
        best = [np.stack([s[:, h[2] == g].max(1, initial=-np.inf) for g in range(GROUPS)], 1) for s, h in ((one, halves[0]), (two, halves[1]))]
        return np.where(slices > 0, (best[0][:, :, None] + best[1][:, None, :]).reshape(len(q), -1), -np.inf)

    def sent(best_only: bool):
        """Each anchor to one slice of its most promising block, or to all slices of the blocks that reach its least end."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bounds = block_bounds(unpacked(batch.column("v"), width))
                if best_only:
                    block = bounds.argmax(1)
                    cell = first[block] + batch.column("row").to_numpy() % np.maximum(slices[block], 1)
                    yield batch.append_column("cell", pa.array(cell.astype(np.int32)))
                    continue
                least = np.array([min(x) for x in batch.column("lows").to_pylist()], np.float64)
                for b in np.flatnonzero(slices):
                    mine = batch.filter(pa.array(bounds[:, b] + 0.5 >= least))
                    for s in range(slices[b] if mine.num_rows else 0):
                        yield mine.append_column("cell", pa.array(np.full(mine.num_rows, first[b] + s, np.int32)))

        return run

    def answer(same: bool, n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, queries in meetings(batches):
                held = Cells(table, width) if table is not None else held
                q, out = unpacked(queries.column("v"), width), []
                s1, s2 = half_bounds(q, halves)
                own, labels = queries.column("row").to_numpy(), queries.column("label").to_numpy()
                lows, highs, tops = (queries.column(c).to_pylist() for c in ("lows", "highs", "tops"))
                for i in range(len(q)):
                    windows = list(zip(lows[i], highs[i], strict=True))
                    for top, (place, score) in zip(tops[i], held.search(q[i], own[i], labels[i], same, windows, s1[i], s2[i], n), strict=True):
                        out.append((np.full(len(place), i), np.full(len(place), top), place, score))
                of, top, place, score = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.record_batch([pa.array(own[of]), queries.column("id").take(pa.array(of)), pa.array(top), pa.array(score), pa.array(held.ids[place], mask=~held.known[place]), pa.array(held.rows[place])], ["q_row", "q_id", "top", "score", "id", "row"])

        return run

    def met(queries: DataFrame, same: bool, n: int, best_only: bool = False) -> DataFrame:
        dealt = queries.mapInArrow(sent(best_only), queries.withColumn("cell", F.lit(0)).schema)
        return cells_met(cells, dealt, n_anchors, max(1, n_cells), answer(same, n), FOUND)

    def ranked(found: DataFrame, n: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("q_row", "top").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row"))
        return found.withColumn("rank", rank).where(F.col("rank") <= n)

    def windowed(queries: DataFrame, lows: Column, highs: Column, tops: Column) -> DataFrame:
        return queries.select("row", "id", "label", "v", *[c.cast("array<long>").alias(n) for n, c in (("lows", lows), ("highs", highs), ("tops", tops))])

    anchors = index.where("anchor").select("row", "id", "label", "v")
    whole = F.array(F.lit(ALL))
    seeds = met(windowed(anchors, F.array(F.lit(-ALL)), whole, whole), True, n_positives, best_only=True)
    least = stored(seeds.groupBy("q_row").agg(F.when(F.count(F.lit(1)) == n_positives, F.min("score")).alias("least")), "negatives-least")
    known = anchors.join(least, anchors["row"] == least["q_row"], "left")
    found = met(windowed(known, F.array(F.coalesce("least", F.lit(-ALL))), whole, whole), True, n_positives)
    positives = stored(ranked(found, n_positives), "negatives-positives")
    usable = positives.where("score >= 0").groupBy("q_row").agg(F.array_sort(F.collect_set("score")).alias("tops"))  # n_positives at most
    share = lambda s, part: s.cast("decimal(20,0)") * F.lit(part) / F.lit(100)
    lows, highs = F.transform("tops", lambda s: F.ceil(share(s, low)).cast("long")), F.transform("tops", lambda s: F.floor(share(s, high)).cast("long"))
    negatives = ranked(met(windowed(anchors.join(usable, anchors["row"] == usable["q_row"]), lows, highs, F.col("tops")), False, k), k)
    pairs = positives.select("q_row", F.col("id").alias("positive_id"), F.col("row").alias("positive_row"), F.col("score").alias("top"))
    out = negatives.join(pairs, ["q_row", "top"])
    return out.select(F.col("q_id").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), F.col("top").alias("positive_score"), F.col("score").alias("negative_score"), F.col("q_row").alias("anchor_row"), "positive_row", F.col("row").alias("negative_row"))
