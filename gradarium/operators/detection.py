"""Sliding windows, detections and their suppression."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradarium.functions.expressions import iou_sizes
from gradarium.functions.ordering import running_sums
from gradarium.operators import kernels
from gradarium.operators.boosting import BoostedModel
from gradarium.operators.rectangles import scaled_boxes


def scales(spark: SparkSession, n: int = 9, height: int = 96, width: int = 96, growth: float = 1.2, jump: float = 0.05) -> DataFrame:
    """(s, h, w, dj, dk): sizes and steps of the windows, rounded half to even. A parameter table."""
    by = F.pow(F.lit(float(growth)), F.col("id"))
    sized = spark.range(n).select(F.col("id").cast("int").alias("s"), F.rint(height * by).cast("int").alias("h"), F.rint(width * by).cast("int").alias("w"))
    step = lambda c: F.greatest(F.rint(F.col(c) * F.lit(float(jump))).cast("int"), F.lit(1))
    return sized.select("s", "h", "w", step("h").alias("dj"), step("w").alias("dk"))


def sliding_windows(frames: DataFrame, sized: DataFrame) -> DataFrame:
    """(img_id, s, j0, k0, h, w) for frames (img_id, height, width): steps are centred in what a frame leaves over.
    Scales that don't fit give nothing."""
    rows = frames.select("img_id", "height", "width").join(F.broadcast(sized), (F.col("h") <= F.col("height")) & (F.col("w") <= F.col("width")))
    starts = lambda room, d: F.sequence(F.floor((room % d) / 2).cast("int"), room, d)
    rows = rows.withColumn("j0", F.explode(starts(F.col("height") - F.col("h"), F.col("dj"))))
    return rows.withColumn("k0", F.explode(starts(F.col("width") - F.col("w"), F.col("dk")))).select("img_id", "s", "j0", "k0", "h", "w")


FOUND = "array<struct<s: int, j: int, k: int, h: int, w: int, score: double>>"


def detections_in_rows(images: DataFrame, features: DataFrame, sized: DataFrame, models: dict[str, BoostedModel], timed: bool = False) -> DataFrame:
    """(img_id, model, found array<struct<s, j, k, h, w, score>>), with the seconds that the integral image and the windows
    took if they are to be timed, a row for each image and model: windows of the images
    (img_id, h, w, pixels) whose score is above the model's threshold, in the order of scale, row and column. Feature
    numbers of all models are those of the catalogue `features`. A null or empty image has no windows.

    An image is one row with one integral image for all models, made and scored in numpy by the task that holds it: the
    image is never copied to its windows, nothing is shuffled, and images may come as a stream. A window is left once its
    rounds to come cannot lift it above the threshold. Boxes of the selected features are constants of the plan."""
    used = sorted({r[1] for m in models.values() for r in m.rows})
    scales_ = [(r.s, r.h, r.w, r.dj, r.dk) for r in sorted(sized.select("s", "h", "w", "dj", "dk").collect())]
    boxes = {(b.s, b.f): (b.bg, b.white) for b in scaled_boxes(features.where(F.col("f").isin(used)), sized).collect()}  # selected features x scales
    cascades = {}
    for name, m in models.items():
        bg, white = (np.array([[boxes[s[0], r[1]][k] for r in m.rows] for s in scales_], np.int64).reshape(len(scales_), len(m.rows), 4) for k in (0, 1))
        cascades[name] = kernels.Cascade(scales_, bg, white, np.array([r[2] for r in m.rows]), np.array([r[3] for r in m.rows]), np.array([r[5] for r in m.rows]), m.threshold)
    kind = images.schema["img_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, names, sizes, windows, scores, took = [], [], [], [np.zeros((0, 5), np.int64)], [np.zeros(0)], []
            for i, image in kernels.images_of(batch):
                began = time.perf_counter()
                ii = kernels.integral(image) if image is not None else None
                ready = time.perf_counter()
                gray = image is not None and 0 <= image.min() and image.max() <= kernels.GRAY
                for name, cascade in cascades.items():
                    start = time.perf_counter()
                    found, score = cascade.detected(ii, gray) if ii is not None else (windows[0], scores[0])
                    took.append((ready - began, time.perf_counter() - start))
                    of.append(i)
                    names.append(name)
                    sizes.append(len(score))
                    windows.append(found)
                    scores.append(score)
            flat = pa.StructArray.from_arrays([*[pa.array(c) for c in np.ascontiguousarray(np.concatenate(windows).T.astype(np.int32))], pa.array(np.concatenate(scores))], [*"sjkhw", "score"])
            found = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), flat)
            seconds = [pa.array(np.array(took).reshape(-1, 2)[:, k]) for k in (0, 1)] if timed else []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(names, pa.string()), found, *seconds], ["img_id", "model", "found", "integral_s", "windows_s"][: 3 + len(seconds)])

    rows = images.select("img_id", "h", "w", "pixels")
    return rows.mapInArrow(run, f"img_id {kind.simpleString()}, model string, found {FOUND}" + (", integral_s double, windows_s double" if timed else ""))


def detect(images: DataFrame, features: DataFrame, sized: DataFrame, models: BoostedModel | dict[str, BoostedModel]) -> DataFrame:
    """(img_id, s, j, k, h, w, score) of one model, with a column model for several: a row for each detection of
    detections_in_rows()."""
    many = isinstance(models, dict)
    rows = detections_in_rows(images, features, sized, models if many else {"": models})
    rows = rows.select("img_id", "model", F.explode("found").alias("d"))
    return rows.select("img_id", *(["model"] if many else []), "d.*")


def above(scored: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Detections: windows whose score is strictly above the threshold."""
    return scored.where(F.col("score") > threshold)


def clusters(boxes: np.ndarray, least: float, drop_last: bool = False) -> list[np.ndarray]:
    """Greedy clusters of boxes (j, k, h, w), the best first: the first box left takes all later ones that overlap it by an
    IoU of `least` or more."""
    j, k, h, w = boxes.T.astype(np.float64)
    area, left, out = h * w, np.arange(len(boxes)), []
    while len(left):
        if drop_last and len(left) == 1:
            break
        i, rest = left[0], left[1:]
        dj = np.minimum(j[rest] + h[rest], j[i] + h[i]) - np.maximum(j[rest], j[i])
        dk = np.minimum(k[rest] + w[rest], k[i] + w[i]) - np.maximum(k[rest], k[i])
        both = np.maximum(dj, 0) * np.maximum(dk, 0)
        near = both / (area[rest] + area[i] - both) >= least
        out.append(left[np.append(True, near)])
        left = rest[~near]
    return out


def _kept(boxes: np.ndarray, score: np.ndarray, least: float, average: bool, drop_last: bool) -> tuple[np.ndarray, np.ndarray]:
    found = clusters(boxes, least, drop_last)
    if average:
        return np.array([np.rint(boxes[c].mean(0)) for c in found]).reshape(-1, 4), np.array([score[c].mean() for c in found])
    head = np.array([c[0] for c in found], np.int64)
    return boxes[head], score[head]


def suppress(detections: DataFrame, least: float = 0.25, average: bool = False, drop_last: bool = False) -> DataFrame:
    """(img_id, j, k, h, w, score), with model if detections have it: greedy suppression within each image (and model),
    best score first; ties by scale, row and column where the scale s is known, else by place and size. Boxes that overlap
    the best by an IoU of `least` or more join its cluster. The cluster is its best box, or with average the rounded
    mean box and mean score. drop_last: a last box alone in its cluster is not returned.

    Order decides here, so an image is looked at as a whole, which is bounded by its windows; images are sorted within
    the tasks they are dealt out to, and stream through them one after the other."""
    keys = ["img_id", *(["model"] if "model" in detections.columns else [])]
    places = ["s", "j", "k"] if "s" in detections.columns else list("jkhw")
    rows = detections.select(*keys, *[F.col(c).cast("int").alias(c) for c in dict.fromkeys([*places, *"jkhw"])], F.col("score").cast("double").alias("score"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, F.desc("score"), *places).select(*keys, *"jkhw", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table) -> pa.RecordBatch:
            boxes = np.stack([table.column(c).to_numpy() for c in "jkhw"], 1)
            score, new = table.column("score").to_numpy(), starts(table)
            parts = [_kept(boxes[a:b], score[a:b], least, average, drop_last) for a, b in zip(new, np.append(new[1:], len(score)), strict=True)]
            of = np.repeat(new, [len(p[1]) for p in parts])
            out = np.concatenate([p[0] for p in parts]).astype(np.int32)
            columns = [table.column(c).take(pa.array(of)).combine_chunks() for c in keys] + [pa.array(np.ascontiguousarray(c)) for c in out.T] + [pa.array(np.concatenate([p[1] for p in parts]))]
            return pa.RecordBatch.from_arrays(columns, [*keys, *"jkhw", "score"])

        def starts(table: pa.Table) -> np.ndarray:
            new = np.zeros(table.num_rows, bool)
            new[0] = True
            for c in keys:
                v = table.column(c).to_pandas().to_numpy()
                new[1:] |= v[1:] != v[:-1]
            return np.flatnonzero(new)

        held: pa.Table | None = None
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
                last = int(starts(held)[-1])  # this image may go on
                if last:
                    yield done(held.slice(0, last))
                    held = held.slice(last)
        if held is not None:
            yield done(held)

    schema = rows.select(*keys, *"jkhw", "score").schema
    return rows.mapInArrow(run, schema)


def suppress_in_rows(rows: DataFrame, least: float = 0.25, average: bool = False, drop_last: bool = False) -> DataFrame:
    """The same for the rows of detections_in_rows(): an image's detections already lie in one row, so nothing is
    shuffled and images may come as a stream. The best score comes first, of equal ones the window that comes first."""
    names = ["img_id", "model", *"jkhw", "score"]
    kind = rows.schema["img_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(2)
            flat, sizes = found.flatten(), np.array([len(x) if x.is_valid else 0 for x in found])
            boxes = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in "jkhw"], 1) if len(flat) else np.zeros((0, 4), np.int32)
            score = flat.field("score").to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
            parts, at = [], 0
            for n in sizes:
                order = at + np.argsort(-score[at : at + n], kind="stable")
                parts.append(_kept(boxes[order], score[order], least, average, drop_last))
                at += n
            of = pa.array(np.repeat(np.arange(len(sizes)), [len(p[1]) for p in parts]))
            out = np.concatenate([np.zeros((0, 4)), *[p[0] for p in parts]]).astype(np.int32)
            columns = [batch.column(0).take(of), batch.column(1).take(of), *[pa.array(np.ascontiguousarray(c)) for c in out.T], pa.array(np.concatenate([np.zeros(0), *[p[1] for p in parts]]))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select("img_id", "model", "found").mapInArrow(run, f"img_id {kind}, model string, j int, k int, h int, w int, score double")


def rescaled(detections: DataFrame, scale: Column | float) -> DataFrame:
    """Boxes in the coordinates of the original frame, rounded half to even."""
    by = scale if isinstance(scale, Column) else F.lit(float(scale))
    return detections.withColumns({c: F.rint(F.col(c) * by).cast("int") for c in "jkhw"})


def overlapping_pairs(boxes: DataFrame, least: float = 0.25) -> DataFrame:
    """(img_id, a, b, iou) of boxes (img_id, box, j, k, h, w) of one image with box a before b and an IoU of `least` at
    least. Boxes of an image meet only where they share a cell of a coarse grid, so far boxes are never compared."""
    image = Window.partitionBy("img_id")
    cell = F.greatest(F.max("h").over(image), F.max("w").over(image))
    placed = boxes.withColumn("__c", cell)
    cells = placed.withColumn("__j", F.explode(F.sequence(F.floor(F.col("j") / F.col("__c")), F.floor((F.col("j") + F.col("h") - 1) / F.col("__c"))))).withColumn("__k", F.explode(F.sequence(F.floor(F.col("k") / F.col("__c")), F.floor((F.col("k") + F.col("w") - 1) / F.col("__c")))))
    a, b = cells.alias("a"), cells.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("img_id", "__j", "__k")]
    corner = lambda side: tuple(F.col(f"{side}.{c}") for c in "jkhw")
    pairs = a.join(b, [*on, F.col("a.box") < F.col("b.box")]).select("a.img_id", F.col("a.box").alias("a"), F.col("b.box").alias("b"), iou_sizes(corner("a"), corner("b")).alias("iou"))
    return pairs.where(F.col("iou") >= least).distinct()


# ---- targets and negatives ----


def valid_targets(targets: DataFrame, least_relative: float = 0.075) -> DataFrame:
    """Targets (height, width, j, k, h, w) that lie in their image and are tall enough."""
    inside = (F.col("j") >= 0) & (F.col("k") >= 0) & (F.col("j") + F.col("h") <= F.col("height")) & (F.col("k") + F.col("w") <= F.col("width"))
    return targets.where(inside & (F.col("h") / F.col("height") >= least_relative))


def negative_windows(images: DataFrame, targets: DataFrame, per_image: int, draws: int = 20, most_iou: float = 0.5, rounded: bool = False, most_rounds: int = 100) -> DataFrame:
    """(img_id, draw, j, k, h, w): square windows of 0.1 to 0.5 of the height (cut to a whole number, or rounded) at places
    drawn by a hash, whose IoU with every target of the image is below most_iou; the first `per_image` of them.

    An image meets its own targets in one row, and its task draws `draws` windows at a time until it has enough. An image
    that has too few after most_rounds times has no room for more: it returns those it has, see short_images()."""
    own = targets.groupBy("img_id").agg(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in "jkhw"])).alias("targets"))  # an image's own
    rows = images.select("img_id", F.col("height").cast("int"), F.col("width").cast("int")).join(own, "img_id", "left").withColumn("name", F.col("img_id").cast("string"))
    whole = np.rint if rounded else np.floor

    def uniform(name: str, first: int, what: str) -> np.ndarray:
        """portable_uniform() of a run of draws."""
        return np.array([int(hashlib.md5(f"{name}/{d}/{what}".encode()).hexdigest()[:12], 16) for d in range(first, first + draws)]) / 2.0**48

    def clear(box: np.ndarray, taken: np.ndarray) -> np.ndarray:
        (j, k, h, w), (a, b, c, d) = box.T[:, :, None], taken.T[:, None, :]
        both = np.maximum(np.minimum(j + h, a + c) - np.maximum(j, a), 0) * np.maximum(np.minimum(k + w, b + d) - np.maximum(k, b), 0)
        return (both / (h * w + c * d - both) < most_iou).all(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, found = [], [np.zeros((0, 5), np.int64)]
            for i, (height, width, name) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("height", "width", "name")], strict=True)):
                held = batch.column("targets")[i]
                taken = np.stack([held.values.field(c).to_numpy() for c in "jkhw"], 1).astype(np.int64) if held.is_valid else np.zeros((0, 4), np.int64)
                have = 0
                for first in range(0, most_rounds * draws, draws):
                    if have == per_image or not height or not width:
                        break
                    side = np.maximum(whole((0.1 + uniform(name, first, "side") * 0.4) * height), 1).astype(np.int64)
                    j, k = (np.floor(uniform(name, first, c) * (room - side + 1)).astype(np.int64) for c, room in (("j", height), ("k", width)))
                    box = np.stack([j, k, side, side], 1)
                    fine = np.flatnonzero(clear(box, taken))[: per_image - have]
                    found.append(np.column_stack([first + fine, box[fine]]))
                    of += [i] * len(fine)
                    have += len(fine)
            columns = np.concatenate(found).T.astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("img_id").take(pa.array(of, pa.int64())), *map(pa.array, np.ascontiguousarray(columns))], ["img_id", "draw", *"jkhw"])

    kind = images.schema["img_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"img_id {kind}, draw int, j int, k int, h int, w int")


def short_images(images: DataFrame, windows: DataFrame, per_image: int) -> DataFrame:
    """(img_id, found): the images for which negative_windows() found too few windows."""
    found = windows.groupBy("img_id").agg(F.count(F.lit(1)).alias("__found"))
    counted = images.select("img_id").join(found, "img_id", "left").select("img_id", F.coalesce("__found", F.lit(0)).alias("found"))
    return counted.where(F.col("found") < per_image)


def head_tail_split(rows: DataFrame, ratio: float, *order: str) -> DataFrame:
    """rows with is_train: the first round(ratio * m) rows in the given order, ranked in ranges of it."""
    one = rows.withColumn("__one", F.lit(1).cast("long"))
    ranked = running_sums(one, [], [F.col(c) for c in order], {"__rank": "__one"})
    m = F.broadcast(rows.agg(F.rint(F.count(F.lit(1)) * F.lit(float(ratio))).alias("__head")))  # one row
    return ranked.crossJoin(m).withColumn("is_train", F.col("__rank") <= F.col("__head")).drop("__one", "__rank", "__head")


def fold_split(rows: DataFrame, fold: Column, last_train: int = 9) -> DataFrame:
    """rows with is_train: folds 1 to last_train."""
    return rows.withColumn("is_train", fold <= last_train)
