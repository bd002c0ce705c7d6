"""Exact order statistics of many columns at once, without moving their values: histograms of radix digits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counts that a pass may send to the driver (8 bytes each), the least and most bits of a digit, and how many values the
#: last pass may fetch instead of counting them: all bounds of what the driver holds, whatever the number of rows.
COUNTS, LEAST_BITS, MOST_BITS, FETCHED = 2**19, 5, 16, 2**18
WORD = 64


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """A batch's arrays as a matrix of doubles, nulls within as NaN. A null array or one of another length is refused: its
    values would move to other rows and features."""
    sizes = pc.list_value_length(column)
    if column.null_count or pc.any(pc.not_equal(sizes, width)).as_py():
        odd = "null" if column.null_count else sorted(set(pc.unique(sizes).to_pylist()) - {width})[0]
        raise ValueError(f"every row must have an array of {width} features, found {odd}")
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), width)


def ordered_keys(x: np.ndarray) -> np.ndarray:
    """64-bit words in the order of the doubles; both zeros have one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def doubles_of(keys: np.ndarray) -> np.ndarray:
    keys = np.asarray(keys, np.uint64)
    return np.where(keys >> np.uint64(63), keys & np.uint64((1 << 63) - 1), ~keys).view(np.float64)


def width_of(rows: DataFrame, x: str) -> int:
    """Features of the first row; that all rows have as many is checked wherever they are read."""
    first = rows.select(F.size(x)).first()
    if first is None or (first[0] or 0) < 1:
        raise ValueError("features must not be null or empty, and two rows are needed")
    return first[0]


def counted(rows: DataFrame, x: str, width: int, place: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """How often each of `size` places occurs among place(keys of a batch): tasks add up one array each, and only what is
    not zero in it is exchanged and summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(place(ordered_keys(matrix_of(batch.column(0), width))), minlength=size)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["at", "c"])

    found = rows.select(x).mapInArrow(run, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("at").to_numpy()] = found.column("c").to_numpy()
    return out


def ends_of(rows: DataFrame, x: str, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of rows, least and most value of each feature). Null and NaN are refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, least, most = 0, np.full(width, np.inf), np.full(width, -np.inf)
        for batch in batches:
            if batch.num_rows:
                values = matrix_of(batch.column(0), width)
                if np.isnan(values).any():
                    raise ValueError("features must not be null or NaN")
                m, least, most = m + len(values), np.minimum(least, values.min(0)), np.maximum(most, values.max(0))
        if m:
            yield pa.record_batch([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, m)), pa.array(least + 0.0), pa.array(most + 0.0)], ["j", "m", "least", "most"])

    parts = rows.select(x).mapInArrow(run, "j int, m long, least double, most double")
    found = parts.groupBy("j").agg(F.sum("m").alias("m"), F.min("least").alias("least"), F.max("most").alias("most")).toArrow()
    if not found.num_rows:
        return 0, np.zeros(width), np.zeros(width)
    order = np.argsort(found.column("j").to_numpy())
    return int(found.column("m")[0].as_py()), found.column("least").to_numpy()[order], found.column("most").to_numpy()[order]


def at_ranks(rows: DataFrame, x: str, width: int, ranks: list[int], least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """values[j, t]: the value at ranks[t], from 0, of feature j in ascending order, exactly as a sort would give it.

    Values are read as order-preserving words. A pass counts the next digit of the words that share what is known of a
    wanted one; the count that reaches the rank gives the digit. What least and most agree on needs no pass, digits are
    as wide as COUNTS allows, and once few words are left in all intervals these are fetched. Passes only read: rows are
    never exchanged, and their number depends on the width of a double, not on the rows."""
    n_ranks = len(ranks)
    low, high = ordered_keys(least), ordered_keys(most)
    differ = low ^ high
    known = WORD - max(int(d).bit_length() for d in differ)  # leading bits in which all values of a feature agree
    mask = np.uint64(((1 << known) - 1) << (WORD - known)) if known else np.uint64(0)
    prefix = np.repeat((low & mask)[:, None], n_ranks, 1)
    left = np.tile(np.array(ranks, np.int64), (width, 1))  # rank among the words with the prefix
    inside = np.full((width, n_ranks), np.iinfo(np.int64).max)
    bits = int(np.clip(np.log2(COUNTS / (width * n_ranks)), LEAST_BITS, MOST_BITS))
    while known < WORD:
        if inside.max() < np.iinfo(np.int64).max and inside.sum() <= FETCHED:
            return fetched(rows, x, width, prefix, known, left)
        digit = min(bits, WORD - known)
        shift, cells = np.uint64(WORD - known - digit), 1 << digit

        def place(keys: np.ndarray, prefix=prefix, known=known, shift=shift, cells=cells) -> np.ndarray:
            out = []
            for t in range(n_ranks if known else 1):
                cell = (keys ^ prefix[:, t]) >> shift
                own = cell < np.uint64(cells)
                out.append((cell.astype(np.int64) + (np.arange(width) * n_ranks + t) * cells)[own])
            return np.concatenate(out)

        counts = counted(rows, x, width, place, width * n_ranks * cells).reshape(width, n_ranks, cells)
        if not known:
            counts[:, 1:] = counts[:, :1]  # one histogram serves all ranks at first
        upto = counts.cumsum(2)
        found = (upto <= left[:, :, None]).sum(2)
        left -= np.take_along_axis(upto - counts, found[:, :, None], 2)[:, :, 0]
        inside = np.take_along_axis(counts, found[:, :, None], 2)[:, :, 0]
        prefix = prefix | (found.astype(np.uint64) << shift)
        known += digit
    return doubles_of(prefix)


def fetched(rows: DataFrame, x: str, width: int, prefix: np.ndarray, known: int, left: np.ndarray) -> np.ndarray:
    """The same from the words that still share a prefix, of which there are few."""
    n_ranks, shift = prefix.shape[1], np.uint64(WORD - known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = ordered_keys(matrix_of(batch.column(0), width))
                for t in range(n_ranks):
                    i, j = np.nonzero((keys >> shift) == (prefix[:, t] >> shift))
                    yield pa.record_batch([pa.array(j * n_ranks + t), pa.array(doubles_of(keys[i, j]))], ["at", "v"])

    found = rows.select(x).mapInArrow(run, "at long, v double").toArrow()
    at, v = found.column("at").to_numpy(), found.column("v").to_numpy()
    order = np.lexsort((v, at))
    first = np.searchsorted(at[order], np.arange(width * n_ranks))
    return v[order][first + left.ravel()].reshape(width, n_ranks)
