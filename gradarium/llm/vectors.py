"""Whole-number vectors of embeddings, their exact inner products, and queries that meet rows in cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries that meet the rows of one cell in one task; more are dealt out to copies of the cell.
CHUNK = 65_536
#: Bounds that are computed in floating point are lowered by this share and by half of a whole score.
SLACK = 1e-12


def scaled(column: pa.Array, scale: float, shift: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which vectors take part, floor(scale * x) + shift of these as a matrix of `width` columns). Null vectors and those
    that hold a null or a number that isn't finite take no part; a vector that is shorter is as if it ended in zeros."""
    m, sizes = len(column), pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    of, first = np.repeat(np.arange(m), sizes), np.cumsum(sizes) - sizes
    good = column.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(of, ~np.isfinite(x), m) == 0)
    out = np.zeros((m, width))
    mine = good[of]
    out[of[mine], (np.arange(len(x)) - first[of])[mine]] = x[mine]
    out = np.floor(scale * out[good])
    if len(out) and width and np.abs(out).max() >= 2**31 - abs(shift):
        raise ValueError(f"components times {scale} must be below 2^31")
    return good, out.astype(np.int64) + shift


def width_of(rows: DataFrame, vector: str) -> int:
    """The length of the longest vector."""
    return rows.agg(F.max(F.size(vector))).first()[0] or 0


def whole_vectors(rows: DataFrame, vector: str, columns: dict[str, Column], scale: float, width: int) -> DataFrame:
    """(row, *columns, v, norm): rows whose vector takes part, with a unique number, floor(scale * x) as 32-bit numbers and
    its length. Write the result before its numbers are used."""
    held = rows.select(F.monotonically_increasing_id().alias("row"), *[c.alias(n) for n, c in columns.items()], F.col(vector).alias("v"))
    schema = held.withColumns({"v": F.lit(b""), "norm": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = scaled(batch.column(batch.num_columns - 1), scale, 0, width)
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], packed(x), pa.array(np.sqrt((x.astype(np.float64) ** 2).sum(1)))], schema.names)

    return held.mapInArrow(run, schema)


def packed(x: np.ndarray) -> pa.Array:
    m, raw = len(x), np.ascontiguousarray(x, np.int32)
    return pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(np.arange(m + 1, dtype=np.int32) * (4 * x.shape[1])), pa.py_buffer(raw.tobytes())])


def unpacked(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The matrix of 32-bit numbers of a column made by packed()."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.int32) if raw else np.zeros(0, np.int32))[column.offset * width : (column.offset + len(column)) * width].reshape(len(column), width)


def exact_type(most: float) -> type:
    """A type in which sums of products are exact whose absolute parts add up to `most` at most."""
    if most < 2**23:
        return np.float32
    if most < 2**52:
        return np.float64
    if most < 2**62:
        return np.int64
    raise ValueError("inner products don't fit into 64 bits")


def ids_of(batch: pa.RecordBatch | pa.Table, name: str = "id") -> np.ndarray:
    """Ids for comparisons: a null comes after all others."""
    return pc.fill_null(batch.column(name), np.iinfo(np.int64).max).to_numpy().astype(np.int64)


def first_k(of: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each `of`, by falling score, then id, then row."""
    order = np.lexsort((rows, ids, -score, of))
    new = np.append(True, of[order][1:] != of[order][:-1])[: len(order)]
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(new, at, 0)) < k]


# ---- queries and rows that meet in cells ----


def cells_met(rows: DataFrame, queries: DataFrame, n_queries: int, n_cells: int, answer: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """answer() over the rows of each cell, followed by the queries sent to it: rows have kind 0, queries kind 1, and both a
    cell. At most about CHUNK queries meet one copy of a cell; more meet further copies in other tasks. A task holds the
    rows of one cell, whose number the caller bounds, while its queries stream by."""
    chunks = max(1, -(-n_queries // CHUNK))
    left = rows.withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))), "kind": F.lit(0)})
    right = queries.withColumns({"chunk": F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"), "kind": F.lit(1)})
    both = left.unionByName(right, allowMissingColumns=True).repartition(min(2 * n_cells * chunks, 8192), "cell", "chunk")
    return both.sortWithinPartitions("cell", "chunk", "kind").mapInArrow(answer, schema)


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table | None, pa.RecordBatch]]:
    """(rows of a cell, or None if they are those of the last time; queries) of batches sorted by cell, chunk and kind.
    Queries without rows in their cell are left out."""
    key, held, told = None, [], False
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, chunk, kind = (batch.column(c).to_numpy() for c in ("cell", "chunk", "kind"))
        cut = np.flatnonzero((cell[1:] != cell[:-1]) | (chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])) + 1
        for a, b in zip([0, *cut], [*cut, len(cell)], strict=True):
            if (cell[a], chunk[a]) != key:
                key, held, told = (cell[a], chunk[a]), [], False
            part = batch.slice(a, b - a)
            if kind[a] == 0:
                held.append(part)
            elif held:
                yield None if told else pa.Table.from_batches(held).combine_chunks(), part
                told = True
