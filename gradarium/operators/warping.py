"""Images at another size or angle, and variants of them: each image is worked on inside its row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradarium.functions.expressions import portable_uniform
from gradarium.operators import kernels


def each_image(images: DataFrame, change: Callable[[np.ndarray, dict], np.ndarray], extra: list[str] | None = None, whole: bool = True) -> DataFrame:
    """images with h, w and pixels of change(image, values of the extra columns); other columns stay. whole: pixels are rounded
    half to even and kept within 0 and 255, else they are doubles. Null and empty images stay as they are."""
    kind = "array<smallint>" if whole else "array<double>"
    names, extra = images.columns, extra or []
    schema = images.withColumns({"h": F.col("h").cast("int"), "w": F.col("w").cast("int"), "pixels": F.col("pixels").cast(kind)}).schema
    at = {c: names.index(c) for c in ("h", "w", "pixels")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = {c: batch.column(names.index(c)).to_pylist() for c in extra}
            h, w = (batch.column(at[c]).to_pylist() for c in ("h", "w"))
            pixels: list = [None if not batch.column(at["pixels"])[i].is_valid else [] for i in range(batch.num_rows)]
            for i, image in kernels.images_of(batch):
                if image is not None:
                    out = change(image, {c: v[i] for c, v in values.items()})
                    h[i], w[i] = out.shape
                    pixels[i] = (np.clip(np.rint(out), 0, 255).astype(np.int16) if whole else out.astype(np.float64)).ravel()
            columns = list(batch.columns)
            columns[at["h"]], columns[at["w"]] = pa.array(h, pa.int32()), pa.array(w, pa.int32())
            columns[at["pixels"]] = pa.array(pixels, pa.list_(pa.int16() if whole else pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return images.mapInArrow(run, schema)


def resized(images: DataFrame, height: int = 480, kind: str = "linear", whole: bool = True) -> DataFrame:
    """images at a height, the width in proportion (rounded half to even, 1 at least), with scale: what detection.rescaled()
    multiplies boxes by to have them in the original frame. kind: see kernels.resized()."""
    if height < 1 or kind not in ("linear", "area"):
        raise ValueError("height must be 1 or more, kind linear or area")
    change = lambda p, _: kernels.resized(p, height, max(1, int(np.rint(p.shape[1] * height / p.shape[0]))), kind)
    return each_image(images.withColumn("scale", F.col("h") / F.lit(float(height))), change, whole=whole)


def turned(images: DataFrame, degrees: float, whole: bool = True) -> DataFrame:
    """images turned counter-clockwise in a frame that holds all of them."""
    return each_image(images, lambda p, _: kernels.turned(p, degrees), whole=whole)


def sharpened(images: DataFrame, whole: bool = True) -> DataFrame:
    return each_image(images, lambda p, _: kernels.stencilled(p, kernels.SHARPER), whole=whole)


def softened(images: DataFrame, whole: bool = True) -> DataFrame:
    return each_image(images, lambda p, _: kernels.stencilled(p, kernels.SOFTER), whole=whole)


def augmented(images: DataFrame, copies: int, seed: int = 0, brightest: int = 40) -> DataFrame:
    """`copies` variants of each image with their number in `variant`, from 0: each is mirrored or not, brighter or darker by
    up to `brightest` levels, and sharpened, softened or neither, as hashes of img_id, the number and the seed say, the same
    in any partitioning."""
    drawn = images.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    u = lambda what: portable_uniform(F.col("img_id"), F.col("variant"), F.lit(seed), F.lit(what))
    drawn = drawn.withColumns({"__mirror": u("mirror") < 0.5, "__light": F.floor(u("light") * (2 * brightest + 1)) - brightest, "__stencil": F.floor(u("stencil") * 3)})

    def change(p: np.ndarray, v: dict) -> np.ndarray:
        out = p[:, ::-1] if v["__mirror"] else p
        out = out.astype(np.float64) + v["__light"]
        return out if v["__stencil"] == 2 else kernels.stencilled(out, (kernels.SHARPER, kernels.SOFTER)[v["__stencil"]])

    extra = ["__mirror", "__light", "__stencil"]
    return each_image(drawn, change, extra).drop(*extra)
