"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of all contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Rows of 8-byte keys that may be broadcast (16 MB); beyond it the same join shuffles.
BROADCAST_ROWS = 2_000_000
#: Bytes that Spark hands to a Python task at a time where rows hold texts; its own limit counts rows, however long.
BATCH_BYTES = 1_000_000
#: Rows that a file of a narrow intermediate table has at least, where it is known how many there are.
FILE_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a session in one process makes its own, as in
    tests; on a cluster that is an error, since executors would write to their own disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends, later jobs survive lost executors.

    rows, for narrow tables: how many there are at most. They are written by as many tasks as there are cores, or more where
    files would have more than FILE_ROWS rows, and not by a task and a file for each of hundreds of near-empty partitions: a
    local file costs an executor processes of its own (chmod, twice a file), each of which begins as a copy of it."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that start inside hand texts to Python about BATCH_BYTES at a time, and a longer text alone: both ends hold a
    batch whole, the JVM in buffers of up to twice its size outside the heap. What the session itself has set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """(row, held): each row of docs as a struct with a unique number from 0, stored once so that it stays the same in
    all later jobs. Numbers say nothing about the order of doc_ids."""
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(c) for c in docs.columns]).alias("held")), name)


def semi_join(df: DataFrame, keys: DataFrame, on: str, n_keys: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose key is in keys: by broadcast while the counted keys are few, else by shuffle."""
    return df.join(F.broadcast(keys) if n_keys <= limit else keys.hint("merge"), on, "left_semi")


def anti_join(df: DataFrame, keys: DataFrame, on: str, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose `on` is not among the keys, which must be a stored table: by broadcast while they are few."""
    keys = F.broadcast(keys) if keys.count() <= limit else keys.hint("merge")
    return df.join(keys, df[on] == keys[key], "left_anti")


def n_slices(rows: int, groups: int = 1, most: int = 500_000) -> int:
    """Into how many slices groups of about equal size are cut so that a slice has about `most` rows."""
    return max(1, -(-rows // (max(1, groups) * most)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def salted_rank(df: DataFrame, keys: list[str], salt: str, order: list[Column], out: str) -> DataFrame:
    """Rank from 0 within keys, by (salt, order), without a task for each key: rows are ranked in each
    (keys, salt) and moved up by the rows of the smaller salts. Keys and salt must not be null."""
    both = [*keys, salt]
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = df.groupBy(*both).agg(F.count(F.lit(1)).alias("__n")).select(*both, before.alias("__start"))
    own = F.row_number().over(Window.partitionBy(*both).orderBy(*order)) - 1
    return df.withColumn(out, own.cast("long")).join(starts, both).withColumn(out, F.col(out) + F.col("__start")).drop("__start")


# ---- bytes of a text column, in numpy ----

#: An odd base and its inverse modulo 2^64: prefix sums of byte * BASE^i give the fingerprint of any substring.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (splitmix64's finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[0] = 0; (S[b] - S[a]) * BASE^-a is the fingerprint of data[a:b]."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][:-1], out=sums[1:])
    return sums


def fingerprints(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * powers(len(sums))[1][start])


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and n + 1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(ends: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about `most` bytes; a longer text is a run of its own."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        yield i, j
        i = j
