"""Feature contract, exact trimmed ranges and equal-width bins."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradarium.functions.expressions import bin_of, signed_label
from gradarium.operators import selection


def feature_rows(df: DataFrame, label: Column | str, features: list[str] | str, row_id: str | None = None) -> tuple[DataFrame, list]:
    """(rows (row_id, y, x array<double>), the two classes in ascending order). Features are numeric columns or one
    array column. Raises unless there are exactly two classes; null labels are refused."""
    label = F.col(label) if isinstance(label, str) else label
    x = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*[F.col(c).cast("double") for c in features])
    rows = df.select((F.col(row_id) if row_id else F.lit(None).cast("long")).alias("row_id"), label.alias("label"), x.alias("x"))
    classes = [r[0] for r in rows.select("label").distinct().limit(3).collect()]
    if len(classes) != 2 or None in classes:
        raise ValueError(f"two classes are needed, found {classes if len(classes) < 3 else 'more'}")
    classes.sort()
    return rows.select("row_id", signed_label(F.col("label"), classes).alias("y"), "x"), classes


def find_ranges(rows: DataFrame, outliers_ratio: float = 0.05, x: str = "x") -> list[tuple[int, float, float]]:
    """(j, lo, hi) of each feature of the array column x: the values at ranks ceil(r m) and floor((1 - r) m), from 0, of
    its m ascending values; least and greatest if these are not ascending, or if r is 0.

    Exact, by a few passes that count digits (see selection.at_ranks): values are not exchanged, and the driver sees counts
    whose number is bounded. Null arrays, arrays of several lengths, null and NaN are refused, as is one row, whose trimmed
    rank does not exist."""
    if not 0 <= outliers_ratio <= 0.25:
        raise ValueError("outliers_ratio must be from 0 to 0.25")
    rows = rows.select(F.col(x).cast("array<double>").alias("x"))
    width = selection.width_of(rows, "x")
    m, lo, hi = selection.ends_of(rows, "x", width)
    if m < 2:
        raise ValueError("two rows are needed")
    if outliers_ratio:
        trimmed = selection.at_ranks(rows, "x", width, [math.ceil(outliers_ratio * m), math.floor((1.0 - outliers_ratio) * m)], lo, hi)
        fine = trimmed[:, 0] < trimmed[:, 1]
        lo, hi = np.where(fine, trimmed[:, 0], lo), np.where(fine, trimmed[:, 1], hi)
    return [(j, float(lo[j]), float(hi[j])) for j in range(width)]


def range_table(spark: SparkSession, ranges: list[tuple[int, float, float]]) -> DataFrame:
    return spark.createDataFrame(ranges, "j int, lo double, hi double")


def bin_rows(rows: DataFrame, ranges: list[tuple[int, float, float]], n_bins: int) -> DataFrame:
    """(row_id, y, bins array<tinyint>): one pass, with the ranges as one constant array."""
    lo, hi = (F.array(*[F.lit(float(r[k])) for r in sorted(ranges)]) for k in (1, 2))
    bounded = F.zip_with(lo, hi, lambda a, b: F.struct(a.alias("lo"), b.alias("hi")))
    bins = F.zip_with("x", bounded, lambda x, r: bin_of(x, r["lo"], r["hi"], n_bins).cast("tinyint"))
    return rows.select("row_id", "y", bins.alias("bins"))


STATE_SCHEMA = "y tinyint, bins binary, margin double"


def bin_state(rows: DataFrame, ranges: list[tuple[int, float, float]], n_bins: int) -> DataFrame:
    """(y, bins, margin) of rows (y, x): the same bins as bytes, one a feature, and a margin of 0. This is what rounds
    read: a row is as many bytes as features and goes to numpy without being unpacked."""
    lo, hi = (np.array([r[k] for r in sorted(ranges)], np.float64) for k in (1, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, m = batch.column(1), batch.num_rows
            if not m:
                continue
            x = selection.matrix_of(values, len(lo))
            with np.errstate(divide="ignore", invalid="ignore"):
                place = np.floor(n_bins * (x - lo) / (hi - lo))
            bins = np.where(hi > lo, np.clip(place, 0, n_bins - 1), 0).astype(np.uint8)
            raw = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(np.arange(m + 1, dtype=np.int32) * len(lo)), pa.py_buffer(bins.tobytes())])
            yield pa.record_batch([batch.column(0), raw, pa.array(np.zeros(m))], ["y", "bins", "margin"])

    return rows.select("y", "x").mapInArrow(run, STATE_SCHEMA)
