"""Exact search of the greatest inner products over vectors grouped by length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradarium.llm.common import stored
from gradarium.llm.vectors import SLACK, cells_met, exact_type, first_k, ids_of, meetings, unpacked, whole_vectors, width_of

#: Components of a bucket at most, which bounds what a task holds; vectors of one run within it, that share a threshold.
COMPONENTS, RUN = 2**21, 2048
#: Small tables are cut into so many buckets of this many rows at least, so that they are more than one task.
SMALL_BUCKETS, SMALL_ROWS = 16, 1024
#: Marks of lengths that the driver holds, whatever the number of buckets.
MARKS = 4096
#: Queries that a bucket answers together; coordinates that a query looks at; queries on which a run's threshold is tuned.
BLOCK, FOCUS, TUNED_ON = 512, 4, 16
#: Coordinate pruning must leave fewer than this share of a run, else products of all its rows are quicker.
SHARE = 0.125
FOUND = "q_row long, q_id long, score long, id long, row long"


class Run:
    """Vectors of similar length, the longest first, with their sorted coordinates."""

    def __init__(self, x: np.ndarray, norm: np.ndarray):
        self.x, self.norm, self.most = x, norm, float(norm[0])
        unit = x / np.maximum(norm, 1e-300)[:, None]
        self.order = np.argsort(unit, 0).T  # by coordinate
        self.sorted = np.take_along_axis(unit.T, self.order, 1)

    def near(self, unit: np.ndarray, cosine: float) -> np.ndarray:
        """Rows whose cosine with the unit vector may reach c = `cosine`: at each of its largest coordinates q, a row's own
        must lie within q c +- sqrt((1 - c^2)(1 - q^2)), with no upper end where q >= c and no lower one where -q >= c."""
        focus = np.argpartition(-np.abs(unit), min(FOCUS, len(unit)) - 1)[:FOCUS]
        q = unit[focus]
        wide = np.sqrt(max(0.0, 1 - cosine * cosine) * np.maximum(0.0, 1 - q * q)) + 1e-9
        low, high = np.where(-q >= cosine - 1e-9, -2.0, q * cosine - wide), np.where(q >= cosine - 1e-9, 2.0, q * cosine + wide)
        ends = [(np.searchsorted(self.sorted[f], a, "left"), np.searchsorted(self.sorted[f], b, "right")) for f, a, b in zip(focus, low, high, strict=True)]
        seen = np.zeros(len(self.norm), np.int8)
        for f, (a, b) in zip(focus, ends, strict=True):
            seen[self.order[f, a:b]] += 1
        return np.flatnonzero(seen == len(focus))

    def tuned(self, units: np.ndarray, cosines: np.ndarray) -> float:
        """The least local threshold from which coordinates leave less than SHARE of the rows, measured on some queries."""
        at = np.linspace(0, len(units) - 1, min(TUNED_ON, len(units))).astype(int)
        cut = 2.0
        for i in at[np.argsort(-cosines[at])]:
            if len(self.near(units[i], cosines[i])) >= SHARE * len(self.norm):
                return cut
            cut = cosines[i]
        return cut


class Bucket:
    """Rows of one length bucket; search() is exact."""

    def __init__(self, rows: pa.Table, width: int):
        norm = rows.column("norm").to_numpy()
        order = np.argsort(-norm, kind="stable")
        self.ids, self.rows = ids_of(rows)[order], rows.column("row").to_numpy()[order]
        self.known = rows.column("id").is_valid().to_numpy()[order]
        x, norm = unpacked(rows.column("v"), width)[order], norm[order]
        self.runs = [Run(x[a : a + RUN], norm[a : a + RUN]) for a in range(0, len(x), RUN)]
        self.first = np.arange(0, len(x), RUN)

    def search(self, q: np.ndarray, norm: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, score): the first k rows but its own of each query whose score is `least` or more."""
        unit, least = q / np.maximum(norm, 1e-300)[:, None], least.astype(np.float64).copy()
        of, place, score = (np.zeros(0, np.int64) for _ in range(3))
        for run, first in zip(self.runs, self.first, strict=True):
            bound = norm * run.most * (1 + SLACK) + 0.5
            alive = np.flatnonzero(least <= bound)
            if not len(alive):
                break  # later runs are shorter
            local = np.where(least > 0.5, (least - 0.5) / np.maximum(norm * run.most, 1e-300), 0.0)[alive] * (1 - SLACK)
            kind = exact_type(float(norm.max()) * run.most)
            cut = run.tuned(unit[alive], local) if len(q[0]) and local.max() > 0 else 2.0
            hits = []
            for i, c in zip(alive[local >= cut], local[local >= cut], strict=True):  # by coordinates
                near = run.near(unit[i], c)
                s = run.x[near].astype(kind) @ q[i].astype(kind)
                hits.append((np.full(len(near), i), near, s))
            by_length = alive[local < cut]
            if len(by_length):
                need = ((least[by_length] - 0.5) / np.maximum(norm[by_length], 1e-300)).min() * (1 - SLACK)
                upto = len(run.norm) if need <= 0 else int(np.searchsorted(-run.norm, -need, "right"))
                s = q[by_length].astype(kind) @ run.x[:upto].T.astype(kind)
                if upto > k and np.isneginf(least[by_length]).any():  # k others reach the (k + 1)th greatest
                    least[by_length] = np.maximum(least[by_length], np.partition(s, upto - k - 1, 1)[:, upto - k - 1])
                i, j = np.nonzero(s >= least[by_length][:, None])
                hits.append((by_length[i], j, s[i, j]))
            n_of, n_place, n_score = (np.concatenate(c) for c in zip(*hits, strict=True))
            fine = (n_score >= least[n_of]) & (self.rows[first + n_place] != own[n_of])
            of, place, score = np.append(of, n_of[fine]), np.append(place, first + n_place[fine]), np.append(score, n_score[fine].astype(np.int64))
            kept = first_k(of, score, self.ids[place], self.rows[place], k)
            of, place, score = of[kept], place[kept], score[kept]
            full = np.flatnonzero(np.bincount(of, minlength=len(q)) == k)
            if len(full):
                least[full] = np.maximum(least[full], score[np.searchsorted(of, full, "right") - 1])
        return of, place, score


def top_products(rows: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, id, score): for each row where is_query holds the k other rows (all, if fewer) of the greatest inner
    product of the vectors floor(scale * x), ranked from 1, equal scores by the smaller id.

    Vectors are grouped into buckets by falling length. Each query first meets one of the longest buckets, which gives it
    a score that its k best reach; it is then sent to the buckets that are long enough for it. There, runs of similar
    length have a local cosine threshold for each query: where it is high (tuned for each run on some queries) the query's
    largest coordinates choose the rows to verify, else their length does and products are taken as a matrix.

    Null vectors, and those with a null or a number that is not finite, take no part; shorter vectors are as if they ended
    in zeros; an empty one has the score 0 with all. Rows that share an id, or have none, are rows of their own: a row
    without id is no query unless is_query says so, and comes after others of its score. An empty table gives no rows.
    Scores beyond 64 bits are refused. Other columns don't matter, whatever their names."""
    width = width_of(rows, vector)
    base = stored(whole_vectors(rows, vector, {"id": F.col(key).cast("long"), "query": F.coalesce(is_query, F.lit(False))}, scale, width), "topk-vectors")
    n, n_queries = base.agg(F.count(F.lit(1)), F.count_if("query")).first()
    most = max(1, COMPONENTS // max(1, width))
    wanted = max(1, -(-n // most), min(SMALL_BUCKETS, n // SMALL_ROWS))
    placed = stored(base.repartitionByRange(wanted, F.desc("norm"), "row").withColumn("cell", F.spark_partition_id()), "topk-buckets")
    n_cells = (placed.agg(F.max("cell")).first()[0] or 0) + 1
    step = -(-n_cells // MARKS)
    marks = sorted(placed.groupBy(F.floor(F.col("cell") / step).alias("mark")).agg(F.max("norm")).collect())
    longest, last = np.array([m[1] for m in marks]), np.array([min((m[0] + 1) * step, n_cells) - 1 for m in marks])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, queries in meetings(batches):
            bucket = Bucket(table, width) if table is not None else bucket
            q, norm, own = unpacked(queries.column("v"), width), queries.column("norm").to_numpy(), queries.column("row").to_numpy()
            least = queries.column("least").to_numpy(zero_copy_only=False)
            for a in range(0, len(q), BLOCK):
                of, place, score = bucket.search(q[a : a + BLOCK], norm[a : a + BLOCK], own[a : a + BLOCK], least[a : a + BLOCK], k)
                yield pa.record_batch([pa.array(own[a + of]), queries.column("id").take(pa.array(a + of)), pa.array(score), pa.array(bucket.ids[place], mask=~bucket.known[place]), pa.array(bucket.rows[place])], ["q_row", "q_id", "score", "id", "row"])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query to every bucket that is long enough for it."""
        for batch in batches:
            norm, least = batch.column("norm").to_numpy(), batch.column("least").to_numpy(zero_copy_only=False)
            need = np.where(least <= 0.5, -np.inf, (least - 0.5) / np.maximum(norm, 1e-300) * (1 - SLACK))
            upto = np.append(-1, last)[np.searchsorted(-longest, -need, "right")]
            for cell in range(int(upto.max(initial=-1)) + 1):
                mine = batch.filter(pa.array(upto >= cell))
                yield mine.append_column("cell", pa.array(np.full(mine.num_rows, cell, np.int32)))

    queries = placed.where("query").select("row", "id", "norm", "v")
    first = queries.withColumns({"cell": F.pmod(F.xxhash64("row"), F.lit(max(1, n_cells // 4))).cast("int"), "least": F.lit(float("-inf"))})
    cells = placed.select("cell", "row", "id", "norm", "v")
    seeds = cells_met(cells.where(F.col("cell") < max(1, n_cells // 4)), first, n_queries, n_cells, answer, FOUND)
    least = stored(seeds.groupBy("q_row").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).cast("double").alias("least")), "topk-least")
    known = queries.join(least, queries["row"] == least["q_row"], "left").select("row", "id", "norm", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    found = cells_met(cells, known.mapInArrow(sent, known.withColumn("cell", F.lit(0)).schema), n_queries, n_cells, answer, FOUND)
    rank = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q_id").alias("query_id"), "rank", "id", "score", "q_row", "row")
