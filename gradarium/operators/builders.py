"""Labelled feature rows from images and annotations: positives around targets, negatives drawn beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradarium.operators.detection import head_tail_split, negative_windows, valid_targets
from gradarium.operators.rectangles import window_arrays
from gradarium.sources import readers


def examples(images: DataFrame, targets: DataFrame, features: DataFrame, negatives: int, rounded: bool = False, least_relative: float = 0.075, most_iou: float = 0.5) -> DataFrame:
    """(img_id, nth, y, j, k, h, w, x): the features x, in the order of their numbers, of each valid target (y = 1) and of
    `negatives` windows of each image (y = -1) that overlap none of its valid targets by most_iou. nth numbers an image's
    positives, then its negatives. images (img_id, h, w, pixels), targets (img_id, nth, j, k, h, w).

    An image's windows are gathered into one array, and features are taken inside its row, in numpy: neither the image nor
    its integral image is copied to windows. Boxes of the catalogue are a constant of the plan."""
    frames = images.select("img_id", F.col("h").alias("height"), F.col("w").alias("width"))
    good = valid_targets(targets.select("img_id", "nth", *"jkhw").join(frames, "img_id"), least_relative)
    window = lambda y, at: F.struct(F.lit(-y).alias("order"), F.col(at).cast("long").alias("at"), F.lit(y).alias("y"), *[F.col(c).cast("int").alias(c) for c in "jkhw"])
    drawn = negative_windows(frames, good, negatives, most_iou=most_iou, rounded=rounded) if negatives else None
    both = good.select("img_id", window(1, "nth").alias("v"))
    both = both.unionByName(drawn.select("img_id", window(-1, "draw").alias("v"))) if negatives else both
    gathered = both.groupBy("img_id").agg(F.array_sort(F.collect_list("v")).alias("windows"))  # an image's own windows
    rows = window_arrays(gathered.join(images.select("img_id", "h", "w", "pixels"), "img_id"), features)
    return rows.select("img_id", "nth", F.col("window.y").cast("tinyint").alias("y"), *[F.col(f"window.{c}").alias(c) for c in "jkhw"], "x")


def stem(path: Column, folders: int) -> Column:
    """The last parts of a path, as many as an annotation names, without the ending."""
    return F.regexp_replace(F.element_at(F.regexp_extract_all(path, F.lit(rf"((?:[^/]+/){{{folders}}}[^/]+)$"), F.lit(1)), 1), r"\.[^./]+$", "")


def ellipse_examples(spark: SparkSession, image_path: str, annotation_path: str, features: DataFrame, negatives: int, folders: int, last_train: int = 9) -> DataFrame:
    """examples() of images named by ellipse files, with is_train: folds 1 to last_train, the fold being the number in the
    annotation file's name. Images that no file names are left out, img_id is the name."""
    found = readers.ellipse_targets(readers.ellipse_annotations(spark, annotation_path)).withColumn("img_id", F.col("image"))
    fold = F.regexp_extract(F.element_at(F.split("file", "/"), -1), r"(\d+)", 1).cast("int")
    named = found.select("img_id", fold.alias("fold")).distinct()
    images = readers.gray_images(spark, image_path).withColumn("img_id", stem(F.col("path"), folders)).drop("path").join(named.select("img_id"), "img_id", "left_semi")
    return examples(images, found, features, negatives).join(named, "img_id").withColumn("is_train", F.col("fold") <= last_train)


def box_examples(spark: SparkSession, image_path: str, annotation_path: str, label: str, features: DataFrame, negatives: int, train_ratio: float = 0.75) -> DataFrame:
    """examples() of images named by JSON files of boxes with this label, with is_train: the first train_ratio of the
    rows in the order of image and window."""
    boxes = readers.box_annotations(spark, annotation_path).withColumnRenamed("image", "img_id")
    images = readers.gray_images(spark, image_path).withColumn("img_id", stem(F.col("path"), 0)).drop("path").join(boxes.select("img_id").distinct(), "img_id", "left_semi")
    placed = boxes.join(images.select("img_id", F.col("h").alias("height"), F.col("w").alias("width")), "img_id")
    found = readers.box_targets(placed, label, F.col("height"), F.col("width"))
    return head_tail_split(examples(images, found, features, negatives, rounded=True), train_ratio, "img_id", "nth")
