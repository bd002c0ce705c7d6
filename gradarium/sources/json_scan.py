"""Large JSON objects read in byte ranges: a file is many tasks, and an entry of it is a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a range: what a task reads at a time.
RANGE = 16 * 2**20
#: Tasks at most; a task reads its ranges one after the other.
TASKS = 20_000
QUOTE, SLASH, OPEN, CLOSE, COMMA = b'"\\', b"\\", b"{[", b"}]", b","


def opened(path: str) -> pa.NativeFile:
    uri = f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path
    store, name = fs.FileSystem.from_uri(uri)
    return store.open_input_file(name)


def slashes_before(f: pa.NativeFile, start: int) -> int:
    """How many backslashes end right before a place."""
    n, at = 0, start
    while at:
        size = min(4096, at)
        block = f.read_at(size, at - size)
        own = size - len(block.rstrip(SLASH))
        n, at = n + own, at - size
        if own < size:
            break
    return n


def quotes_of(data: np.ndarray, before: int) -> np.ndarray:
    """Places of the quotes that begin or end a string: those behind an even number of backslashes, `before` of which may
    stand right before the data."""
    quote = np.flatnonzero(data == ord('"'))
    other = np.flatnonzero(data != ord("\\"))
    k = np.searchsorted(other, quote) - 1  # the last byte before it that is no backslash
    run = np.where(k >= 0, quote - 1 - other[np.maximum(k, 0)], quote + before)
    return quote[run % 2 == 0]


def structure(data: np.ndarray, before: int, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of brackets and commas outside of strings, what each adds to the depth, places of quotes)."""
    quotes = quotes_of(data, before)
    step = np.zeros(256, np.int8)
    step[list(OPEN)], step[list(CLOSE)], step[list(COMMA)] = 1, -1, 2
    kind = step[data]
    at = np.flatnonzero(kind)
    at = at[(np.searchsorted(quotes, at) + inside) % 2 == 0]
    add = kind[at].astype(np.int64)
    return at, np.where(add == 2, 0, add), quotes


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range how many quotes it has, and what it adds to the depth if it begins outside or inside of a string."""
    for batch in batches:
        for path, start, end in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            with opened(path) as f:
                data, before = np.frombuffer(f.read_at(end - start, start), np.uint8), slashes_before(f, start)
            out, into, quotes = (*[int(structure(data, before, inside)[1].sum()) for inside in (False, True)], len(quotes_of(data, before)))
            yield pa.record_batch([pa.array([x]) for x in (path, start, end, quotes, out, into)], ["path", "start", "end", "quotes", "out", "into"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the file's object whose opening bracket or comma lies in the range, each as an object of its own. The last
    one may end in ranges further on, which are read until it does."""
    for batch in batches:
        for path, start, end, inside, depth in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            with opened(path) as f:
                held, first, at, rows, size = b"", None, start, [], f.size()
                while at < size and (at < end or first is not None):
                    stop = end if at < end else min(at + end - start, size)
                    raw = f.read_at(stop - at, at)
                    places, add, quotes = structure(np.frombuffer(raw, np.uint8), slashes_before(f, at), inside)
                    level = depth + np.cumsum(add)
                    # an entry ends where depth 1 has a comma or ends; it begins where depth 1 begins or has a comma
                    edge = (level == 1) & (add == 0) | (level == 1) & (add == 1) | (level == 0) & (add == -1)
                    for p, opens in zip(places[edge].tolist(), (level[edge] == 1).tolist(), strict=True):
                        if first is not None:
                            body = held + raw[first:p]
                            held, first = b"", None
                            if body.strip():
                                rows.append("{" + body.decode() + "}")
                        if at + p >= end and at >= end:
                            break
                        if opens:
                            first = p + 1
                    if first is not None:
                        held, first = held + raw[first:], 0
                    inside, depth, at = (inside + len(quotes)) % 2 == 1, int(level[-1]) if len(level) else depth, stop
                    if at >= end and first is None:
                        break
                yield pa.record_batch([pa.array([path] * len(rows), pa.string()), pa.array(rows, pa.string())], ["path", "entry"])


def json_entries(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """(path, entry): a row for each entry of the JSON objects in files (or globs), as the text of an object with that entry
    alone. A file is read in ranges of bytes by many tasks, twice: whether a range begins in a string, and how deep, follows
    from counts of the ranges before it, which are a row each. Entries are not parsed; repeated keys are rows of their own.
    Files are UTF-8, not compressed, and lie where pyarrow's file systems reach."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))))
    tasks = min(max(1, ranges.count()), TASKS)  # a number of our own: to Spark the rows look too small to be spread
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("end")).repartition(tasks)
    told = ranges.mapInArrow(_summaries, "path string, start long, end long, quotes long, out long, into long")
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    told = told.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside"), F.col("into")).otherwise(F.col("out"))).over(earlier), F.lit(0)))
    spread = told.select("path", "start", "end", "inside", "depth").repartition(tasks)
    return spread.mapInArrow(_entries, "path string, entry string")
