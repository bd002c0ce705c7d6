"""Sources: labelled matrices, annotations, noise and random data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradarium.functions.expressions import portable_uniform
from gradarium.sources.json_scan import json_entries

#: Shares of blue, green and red in a gray level.
GRAY = np.array([0.114, 0.587, 0.299])


def matrix(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """A labelled matrix in any format that Spark reads (parquet, orc, json, csv with a schema)."""
    return spark.read.format(format).options(**options).load(path)


def one_vs_rest(df: DataFrame, label: str, positive) -> DataFrame:
    """df with y: +1 for one class, -1 for the rest."""
    return df.withColumn("y", F.when(F.col(label) == F.lit(positive), F.lit(1)).otherwise(F.lit(-1)).cast("tinyint"))


def flattened(df: DataFrame, nested: str, levels: int, out: str = "x") -> DataFrame:
    """df with an array of arrays (levels deep) as one array of doubles, in row order."""
    c = F.col(nested)
    for _ in range(levels - 1):
        c = F.flatten(c)
    return df.withColumn(out, c.cast("array<double>"))


def with_noise(df: DataFrame, row_id: str, values: str, span: int = 256, seed: int = 0) -> DataFrame:
    """df whose array `values` is averaged with uniform noise in [0, span): floor((x + noise) / 2). The noise depends
    on the row id and the place only."""
    noise = lambda i: F.floor(portable_uniform(F.col(row_id), i, F.lit(seed)) * span)
    return df.withColumn(values, F.transform(values, lambda x, i: F.floor((x + noise(i)) / 2)))


def random_matrix(spark: SparkSession, rows: int, columns: int, most: float = 1.0, whole: bool = False, seed: int = 0) -> DataFrame:
    """(row_id, y, x): values uniform below `most`, labels -1 or +1, the same in any partitioning."""
    value = lambda j: portable_uniform(F.col("row_id"), j, F.lit(seed)) * most
    x = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: F.floor(value(j)).cast("double") if whole else value(j))
    y = F.floor(portable_uniform(F.col("row_id"), F.lit("y"), F.lit(seed)) * 2) * 2 - 1
    return spark.range(rows).select(F.col("id").alias("row_id"), y.cast("tinyint").alias("y"), x.alias("x"))


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of image files; globs list folders."""
    return spark.read.format("binaryFile").load(path)


def gray_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, h, w, pixels array<smallint> by rows) of image files, decoded by Spark's image source. Colours become gray
    levels with the usual weights; a fourth channel is left out. Files that are no images are dropped."""

    @F.pandas_udf("array<smallint>")
    def gray(data: pd.Series, channels: pd.Series) -> pd.Series:
        out = []
        for raw, n in zip(data, channels, strict=True):
            p = np.frombuffer(raw, np.uint8).reshape(-1, int(n)).astype(np.float64)
            out.append((np.rint(p[:, :3] @ GRAY) if n >= 3 else p[:, 0]).astype(np.int16))
        return pd.Series(out)

    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return rows.select(F.col("origin").alias("path"), F.col("height").alias("h"), F.col("width").alias("w"), gray("data", "nChannels").alias("pixels"))


def mosaics(tiles: DataFrame, tall: int, wide: int) -> DataFrame:
    """(img_id, h, w, pixels) of images put together from tall x wide tiles (img_id, h, w, pixels) of one size: tile n lies
    in image n // (tall * wide), by rows; places without a tile are 0. An image gathers its own tiles, whose number is a
    parameter. Of tiles with one number any may show."""
    own = tiles.select(F.floor(F.col("img_id") / (tall * wide)).alias("image"), F.struct((F.col("img_id") % (tall * wide)).cast("int").alias("at"), "h", "w", "pixels").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = batch.column(1)[i].values
                h, w = held.field("h")[0].as_py(), held.field("w")[0].as_py()
                grid = np.zeros((tall * wide, h, w), np.int16)
                grid[held.field("at").to_numpy()] = held.field("pixels").flatten().to_numpy(zero_copy_only=False).reshape(-1, h, w)
                flat = grid.reshape(tall, wide, h, w).transpose(0, 2, 1, 3).ravel()
                pixels = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([tall * h], pa.int32()), pa.array([wide * w], pa.int32()), pixels], ["img_id", "h", "w", "pixels"])

    return own.groupBy("image").agg(F.collect_list("t").alias("tiles")).mapInArrow(run, "img_id long, h int, w int, pixels array<smallint>")


def ellipse_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(file, image, nth, major, minor, angle, cx, cy) of annotation files: a path, a count, then so many lines of
    ellipses (five numbers and a flag). Lines of an ellipse follow the nearest path line before them."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    return ellipses(lines)


def ellipses(lines: DataFrame) -> DataFrame:
    """The same from lines (file, at, line)."""
    number = r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
    is_ellipse = F.col("line").rlike(rf"^\s*(?:{number}\s+){{5}}{number}\s*$")
    is_image = ~is_ellipse & ~F.col("line").rlike(r"^\s*\d*\s*$")
    own = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("image", F.last(F.when(is_image, F.trim("line")), ignorenulls=True).over(own)).where(is_ellipse)
    parts = F.split(F.trim("line"), r"\s+")
    nth = F.row_number().over(Window.partitionBy("file", "image").orderBy("at")) - 1
    return rows.select("file", "image", nth.alias("nth"), *[parts[k].cast("double").alias(n) for k, n in enumerate(("major", "minor", "angle", "cx", "cy"))])


def ellipse_targets(ellipse_rows: DataFrame) -> DataFrame:
    """Square boxes of side 1.5 * major around the ellipse's centre: j, k, h, w, all cut towards zero."""
    side = (F.col("major") * 1.5).cast("int")
    start = lambda c: (F.col(c) - side * 0.5).cast("int")
    return ellipse_rows.withColumns({"h": side, "w": side, "j": start("cy"), "k": start("cx")})


def box_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(image, nth, label, x, y, bw, bh) of JSON files {image: {bboxes: [[x, y, w, h]], labels: [..]}}, each read by many
    tasks."""
    return boxes_of_json(json_entries(spark, path), "entry")


def boxes_of_json(df: DataFrame, column: str) -> DataFrame:
    parsed = F.from_json(F.col(column), "map<string, struct<bboxes: array<array<double>>, labels: array<string>>>")
    rows = df.select(F.explode(parsed).alias("image", "a")).select("image", F.posexplode(F.arrays_zip(F.col("a.bboxes").alias("box"), F.col("a.labels").alias("label"))).alias("nth", "z"))
    return rows.select("image", "nth", F.col("z.label").alias("label"), *[F.col("z.box")[k].alias(n) for k, n in enumerate(("x", "y", "bw", "bh"))])


def box_targets(boxes: DataFrame, label: str, height: Column, width: Column) -> DataFrame:
    """Square boxes of the larger side around the centres of boxes with this label: j, k, h, w in pixels. Places are moved
    by half of what the unrounded sides differ; everything is rounded last, half to even."""
    h, w = F.col("bh") * height, F.col("bw") * width
    side = F.greatest(h, w)
    start = lambda at, own: F.rint(at + (own - side) * 0.5).cast("int")
    return boxes.where(F.col("label") == label).withColumns({"h": F.rint(side).cast("int"), "w": F.rint(side).cast("int"), "j": start(F.col("y") * height, h), "k": start(F.col("x") * width, w)})
