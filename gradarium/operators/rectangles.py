"""Rectangle features of gray images: templates, catalogue, integral images, features in windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradarium.operators import kernels

#: The side of a square that covers half of the unit square, and the place that centres it.
SIDE = 0.5**0.5
MIDDLE = (1 - SIDE) / 2
#: The white part (row, column, height, width) of the nine templates in the unit square.
TEMPLATES = (
    (0.0, 0.0, 0.5, 1.0),  # top half
    (0.0, 0.0, 1.0, 0.5),  # left half
    (0.25, 0.0, 0.5, 1.0),  # middle band, lying
    (0.0, 0.25, 1.0, 0.5),  # middle band, standing
    (MIDDLE, MIDDLE, SIDE, SIDE),  # centre
    (0.0, 0.0, SIDE, SIDE),  # top left
    (0.0, 1 - SIDE, SIDE, SIDE),  # top right
    (1 - SIDE, 0.0, SIDE, SIDE),  # bottom left
    (1 - SIDE, 1 - SIDE, SIDE, SIDE),  # bottom right
)


def _axis(spark: SparkSession, name: str, low: int, high: int) -> DataFrame:
    return spark.range(low, high).select(F.col("id").cast("int").alias(name))


def catalogue(spark: SparkSession, s: int = 5, p: int = 5) -> DataFrame:
    """(f, t, s_j, s_k, p_j, p_k) and the unit boxes bg and white: 9 s^2 (2p - 1)^2 features, numbered in that nesting.
    A table of parameters: its size does not depend on any data."""
    axes = [_axis(spark, "t", 0, len(TEMPLATES)), _axis(spark, "s_j", 0, s), _axis(spark, "s_k", 0, s), _axis(spark, "p_j", 1 - p, p), _axis(spark, "p_k", 1 - p, p)]
    rows = axes[0]
    for a in axes[1:]:
        rows = rows.crossJoin(a)
    wide = 2 * p - 1
    number = (((F.col("t") * s + F.col("s_j")) * s + F.col("s_k")) * wide + F.col("p_j") + p - 1) * wide + F.col("p_k") + p - 1
    side = lambda i: F.lit(0.25) + F.col(f"s_{i}") * (0.5 / (s - 1) if s > 1 else 0.0)
    shift = lambda i: (F.lit(1.0) - side(i)) / (2 * p - 2) if p > 1 else F.lit(0.0)
    start = lambda i: F.lit(0.5) + F.col(f"p_{i}") * shift(i) - side(i) / 2
    white = F.array(*[F.array(*map(F.lit, w)) for w in TEMPLATES])
    rows = rows.withColumns({"f": number, "__w": white[F.col("t")], "__j": start("j"), "__k": start("k"), "__h": side("j"), "__v": side("k")})
    bg = F.array("__j", "__k", "__h", "__v")
    box = F.array(F.col("__w")[0] * F.col("__h") + F.col("__j"), F.col("__w")[1] * F.col("__v") + F.col("__k"), F.col("__w")[2] * F.col("__h"), F.col("__w")[3] * F.col("__v"))
    return rows.select("f", "t", "s_j", "s_k", "p_j", "p_k", bg.alias("bg"), box.alias("white"))


def pixels(images: DataFrame) -> DataFrame:
    """(img_id, j, k, v) of images (img_id, h, w, pixels): a row for each pixel, by rows."""
    at = images.select("img_id", "w", F.posexplode("pixels").alias("at", "v"))
    return at.select("img_id", F.floor(F.col("at") / F.col("w")).cast("int").alias("j"), (F.col("at") % F.col("w")).cast("int").alias("k"), "v")


def integral(pixel_rows: DataFrame) -> DataFrame:
    """(img_id, j, k, ii): the sum of all pixels above and left of each, itself included, by two running sums."""
    across = F.sum(F.col("v").cast("long")).over(Window.partitionBy("img_id", "j").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    down = F.sum("__row").over(Window.partitionBy("img_id", "k").orderBy("j").rowsBetween(Window.unboundedPreceding, 0))
    return pixel_rows.select("img_id", "j", "k", across.alias("__row")).select("img_id", "j", "k", down.alias("ii"))


def integral_arrays(images: DataFrame) -> DataFrame:
    """images with ii array<long>, an integral image of each row by two cumulative sums, without a shuffle and in time
    linear in the pixels; empty for a null or empty image. Pixels that are null or not h * w are refused."""
    schema = images.withColumn("ii", F.array().cast("array<long>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [np.zeros(0, np.int64) if p is None else kernels.integral(p)[1:, 1:].ravel().astype(np.int64) for _, p in kernels.images_of(batch)]
            ends = pa.array(np.cumsum([0, *map(len, sums)]), pa.int32())
            ii = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *sums])))
            yield pa.RecordBatch.from_arrays([*batch.columns, ii], schema.names)

    return images.mapInArrow(run, schema)


def rectangle_sum(ii: Column, width: Column, j1: Column, k1: Column, j2: Column, k2: Column) -> Column:
    """Sum of the pixels from (j1, k1) to (j2, k2), ends included, of an integral image held as an array by rows."""
    at = lambda j, k: F.when((j < 0) | (k < 0), F.lit(0).cast("long")).otherwise(F.element_at(ii, (F.greatest(j, F.lit(0)) * width + F.greatest(k, F.lit(0)) + 1).cast("int")))
    return at(j2, k2) - at(j1 - 1, k2) - at(j2, k1 - 1) + at(j1 - 1, k1 - 1)


def scaled_boxes(features: DataFrame, scales: DataFrame) -> DataFrame:
    """(s, f, bg, white): unit boxes times each scale's height and width, cut to whole pixels. Both sides are
    parameters."""
    side = F.array("h", "w", "h", "w")
    cut = lambda c: F.zip_with(c, side, lambda a, b: (a * b).cast("smallint"))
    return features.crossJoin(scales.select("s", "h", "w")).select("s", "f", cut("bg").alias("bg"), cut("white").alias("white"))


def box_value(ii: Column, width: Column, j0: Column, k0: Column, bg: Column, white: Column) -> Column:
    """Mean of the white part less mean of the black part, cut to a whole number, of boxes (j, k, height, width) in a window
    at (j0, k0). A part without area gives 0."""

    def total(box: Column) -> tuple[Column, Column]:
        j, k = j0 + box[0], k0 + box[1]
        return rectangle_sum(ii, width, j, k, j + box[2] - 1, k + box[3] - 1), box[2].cast("long") * box[3]

    (whole, area), (lit, part) = total(bg), total(white)
    return F.when((part > 0) & (area > part), (lit / part - (whole - lit) / (area - part)).cast("smallint")).otherwise(F.lit(0).cast("smallint"))


def window_features(windows: DataFrame, boxes: DataFrame, images: DataFrame) -> DataFrame:
    """(img_id, s, j0, k0, f, value): the box_value of each feature in each window.

    windows (img_id, s, j0, k0), boxes from scaled_boxes (a parameter table, broadcast), images with ii."""
    rows = windows.select("img_id", "s", "j0", "k0").join(images.select("img_id", "w", "ii"), "img_id").join(F.broadcast(boxes), "s")
    value = box_value(F.col("ii"), F.col("w"), F.col("j0"), F.col("k0"), F.col("bg"), F.col("white"))
    return rows.select("img_id", "s", "j0", "k0", "f", value.alias("value"))


def window_arrays(images: DataFrame, features: DataFrame) -> DataFrame:
    """(img_id, nth, window, x array<double>): the values of all features, in the order of their numbers, in each of an
    image's own `windows`, an array of structs that have j, k, h and w. Boxes of the catalogue, cut to each window's size,
    are constants; windows are looked at inside the image's row. A null or empty image, or no window, gives no rows."""
    units = features.select("f", "bg", "white").orderBy("f").collect()  # parameters
    unit_bg, unit_white = (np.array([r[c] for r in units], np.float64).reshape(-1, 4) for c in ("bg", "white"))
    rows = images.select("img_id", "h", "w", "pixels", "windows")
    schema = rows.select("img_id", F.lit(0).alias("nth"), F.col("windows")[0].alias("window"), F.array().cast("array<double>").alias("x")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, image in kernels.images_of(batch):
                windows = batch.column(4)[i].values
                if image is None or not windows:
                    continue
                at = np.stack([windows.field(c).to_numpy() for c in "jkhw"], 1).astype(np.int64)
                x, m = kernels.window_values(kernels.integral(image), at, unit_bg, unit_white), len(at)
                values = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * len(units), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(m, i))), pa.array(np.arange(m, dtype=np.int32)), windows, values], schema.names)

    return rows.mapInArrow(run, schema)
