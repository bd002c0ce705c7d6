"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradarium.llm.common import n_slices, salted_rank, stored

SEED = 20240229
#: Virtual partitions: the matrix has at most this many rows, however many partitions the input has.
PARTITIONS = 1024


def hypergeometric(good: int, bad: int, n: int, u: float) -> int:
    """How many of n rows drawn without replacement are among `good`, the others among `bad`: the inverse of the
    distribution function at u. The chances are built outwards from the mode by the ratio of neighbours, so they are
    exact to rounding for populations of any size; the work grows with the standard deviation."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    whole = good + bad
    mode = min(max((n + 1) * (good + 1) // (whole + 2), low), high)
    p = good / whole
    wide = int(10 * (n * p * (1 - p) * ((whole - n) / max(whole - 1, 1))) ** 0.5) + 50
    while True:  # the chances fall off on both sides of the mode: what lies beyond a chance of e^-60 has none
        a, b = max(low, mode - wide), min(high, mode + wide)
        x = np.arange(a, b, dtype=np.float64)
        steps = np.log(good - x) + np.log(n - x) - np.log(x + 1) - np.log((bad - n) + x + 1)  # log of P(x + 1) / P(x)
        up, down = np.cumsum(steps[mode - a :]), np.cumsum(-steps[: mode - a][::-1])[::-1]
        logs = np.concatenate([down, [0.0], up])
        if (a == low or logs[0] < -60) and (b == high or logs[-1] < -60):
            break
        wide *= 2
    chances = np.cumsum(np.exp(logs))
    return a + int(np.searchsorted(chances, u * chances[-1], "right").clip(0, len(chances) - 1))


def communication_matrix(rows: np.ndarray, columns: np.ndarray, seed: int = SEED) -> np.ndarray:
    """How many rows each partition sends to each shard, drawn as a uniform random permutation would have it.

    Row by row: a partition's counts are multivariate hypergeometric given what the shards still lack.
    """
    random, lack = np.random.Generator(np.random.PCG64(seed)), [int(c) for c in columns]
    out = np.zeros((len(rows), len(columns)), np.int64)
    for i, n in enumerate(rows):
        left, others = int(n), sum(lack)
        for j, own in enumerate(lack):
            others -= own
            out[i, j] = hypergeometric(own, others, left, random.random())
            left -= int(out[i, j])
        lack = [own - int(x) for own, x in zip(lack, out[i], strict=True)]
    return out


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with size and text_crc32, which shard() needs of the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"size": F.octet_length(body).cast("long") + 16, "text_crc32": F.crc32(body)})


def shard(docs: DataFrame, n_shards: int = 40, doc_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Rows of measured() with law, shard, slot and grown_shard; columns with these names are replaced. Whatever other
    columns docs has go along, the text among them unless it is dropped.

    The law is `rows`: shard sizes differ by one at most, and every assignment with these sizes is equally likely.
    Rows of a partition are permuted by a seeded hash, the matrix says how many of them go to each shard, and a
    second hash permutes each shard: slot is the place there, from 0 without gaps. Only the counts of at most 1024
    virtual partitions reach the driver. Ranks are taken in slices of a hash whose number follows the rows, so no task
    holds a whole shard. The text itself is read by measured() only, whatever its length.
    A null text has size 16 and crc 0; nulls, repeated rows and equal texts are rows like any other; rows that tie
    in everything may swap places. grown_shard is null under this law. No rows give no rows.
    """
    docs = docs.drop("law", "shard", "slot", "grown_shard")
    by = F.xxhash64(F.col(doc_id).cast("string"), F.col("text_crc32"), F.lit(seed))
    rows = stored(docs.withColumns({"__h": by, "__part": F.spark_partition_id() % PARTITIONS}), "shard_rows")
    counts = {r[0]: r[1] for r in rows.groupBy("__part").count().collect()}  # at most 1024 rows
    parts = sorted(counts)
    total = sum(counts.values())
    sizes = np.array([total // n_shards + (j < total % n_shards) for j in range(n_shards)], np.int64)
    matrix = communication_matrix(np.array([counts[p] for p in parts]), sizes, seed)
    ends = [(p, [int(x) for x in np.cumsum(m)]) for p, m in zip(parts, matrix, strict=True)]
    plan = F.broadcast(docs.sparkSession.createDataFrame(ends, "__part int, __ends array<long>"))  # at most 1024 rows
    rows = rows.withColumn("__slice", F.pmod("__h", F.lit(n_slices(total, len(parts)))))
    rows = salted_rank(rows, ["__part"], "__slice", [F.col("__h"), F.col(doc_id)], "__rank")
    sent = rows.join(plan, "__part").withColumn("shard", F.size(F.filter("__ends", lambda e: e <= F.col("__rank"))))
    again = F.xxhash64(F.col("__h"), F.lit(seed + 1))
    sent = sent.withColumns({"__h": again, "__slice": F.pmod(again, F.lit(n_slices(total, n_shards)))})
    sent = salted_rank(sent, ["shard"], "__slice", [F.col("__h"), F.col(doc_id)], "slot")
    return sent.select(*docs.columns, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
