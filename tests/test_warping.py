import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradarium.operators import detection, kernels, warping


def slow_linear(p, height, width):
    h, w = p.shape
    out = np.zeros((height, width))
    for j in range(height):
        for k in range(width):
            y, x = min(max((j + 0.5) * h / height - 0.5, 0), h - 1), min(max((k + 0.5) * w / width - 0.5, 0), w - 1)
            a, b = math.floor(y), math.floor(x)
            c, d = min(a + 1, h - 1), min(b + 1, w - 1)
            out[j, k] = (p[a, b] * (1 - (x - b)) + p[a, d] * (x - b)) * (1 - (y - a)) + (p[c, b] * (1 - (x - b)) + p[c, d] * (x - b)) * (y - a)
    return out


def slow_area(p, height, width):
    h, w = p.shape
    cover = lambda i, n, to: [max(0.0, min((i + 1) * n / to, q + 1) - max(i * n / to, q)) for q in range(n)]
    return np.array([[np.array(cover(j, h, height)) @ p @ np.array(cover(k, w, width)) / (h / height * w / width) for k in range(width)] for j in range(height)])


@pytest.mark.parametrize("shape", [(7, 5), (1, 1), (1, 6), (9, 1), (12, 12)])
def test_resizing_equals_direct_formulas(shape):
    p = np.random.default_rng(1).integers(0, 256, shape)
    for height, width in ((14, 10), (3, 2), (1, 1), (12, 12), (5, 17), (31, 4)):
        assert kernels.resized(p, height, width) == pytest.approx(slow_linear(p, height, width))
        assert kernels.resized(p, height, width, "area") == pytest.approx(slow_area(p, height, width))
    assert (kernels.resized(p, *shape) == p).all() and kernels.resized(p, *shape, "area") == pytest.approx(p)


def slow_turn(p, degrees):
    h, w = p.shape
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    height, width = math.ceil(abs(h * c) + abs(w * s) - 1e-9), math.ceil(abs(w * c) + abs(h * s) - 1e-9)
    at = lambda j, k: p[j, k] if 0 <= j < h and 0 <= k < w else 0.0
    out = np.zeros((height, width))
    for j in range(height):
        for k in range(width):
            y, x = j - (height - 1) / 2, k - (width - 1) / 2
            v, u = y * c + x * s + (h - 1) / 2, x * c - y * s + (w - 1) / 2
            if -1 < v < h and -1 < u < w:
                a, b = math.floor(v), math.floor(u)
                out[j, k] = sum(at(a + m, b + n) * (v - a if m else 1 - (v - a)) * (u - b if n else 1 - (u - b)) for m in (0, 1) for n in (0, 1))
    return out


@pytest.mark.parametrize("shape", [(4, 7), (1, 1), (5, 5), (1, 6)])
def test_turning(shape):
    p = np.random.default_rng(2).integers(1, 256, shape)
    for quarter in range(-4, 5):
        assert (kernels.turned(p, 90.0 * quarter) == np.rot90(p, quarter)).all()
    for degrees in (10.0, 33.3, -45.0, 121.0, 200.5, 359.0):
        assert kernels.turned(p, degrees) == pytest.approx(slow_turn(p, degrees), abs=1e-6)


def test_stencils():
    p = np.random.default_rng(3).integers(0, 256, (6, 4))
    wide = np.pad(p, 1, mode="reflect")
    for stencil in (kernels.SHARPER, kernels.SOFTER):
        want = [[(wide[j : j + 3, k : k + 3] * stencil).sum() for k in range(4)] for j in range(6)]
        assert kernels.stencilled(p, stencil) == pytest.approx(np.array(want))
    assert kernels.stencilled(np.array([[7]]), kernels.SOFTER) == pytest.approx(np.array([[7.0]]))


def test_images_change_inside_their_rows(spark):
    rng = np.random.default_rng(4)
    pictures = {i: rng.integers(0, 256, s) for i, s in enumerate([(10, 8), (3, 5), (1, 1)])}
    rows = [(i, *p.shape, p.ravel().tolist(), "x") for i, p in pictures.items()] + [(8, None, None, None, "y"), (9, 0, 0, [], "z")]
    df = spark.createDataFrame(rows, "img_id long, h int, w int, pixels array<int>, other string").repartition(3)
    out = {r.img_id: r for r in warping.resized(df, 6).collect()}
    for i, p in pictures.items():
        r = out[i]
        assert (r.h, r.w, r.other, r.scale) == (6, max(1, round(p.shape[1] * 6 / p.shape[0])), "x", p.shape[0] / 6)
        assert r.pixels == np.rint(kernels.resized(p, r.h, r.w)).astype(int).ravel().tolist()
    assert out[8].pixels is None and out[9].pixels == [] and len(out) == 5
    boxes = spark.createDataFrame([(0, 1, 2, 3, 4)], "img_id long, j int, k int, h int, w int").join(warping.resized(df, 6).select("img_id", "scale"), "img_id")
    assert [detection.rescaled(boxes, F.col("scale")).first()[c] for c in "jkhw"] == [round(v * 10 / 6) for v in (1, 2, 3, 4)]
    turned = {r.img_id: r for r in warping.turned(df, 90).collect()}
    assert turned[0].pixels == np.rot90(pictures[0]).ravel().tolist() and turned[0].h == 8
    soft = {r.img_id: r for r in warping.softened(df.where("h > 1")).collect()}
    assert soft[0].pixels == np.rint(kernels.stencilled(pictures[0], kernels.SOFTER)).astype(int).ravel().tolist()
    for bad in ({"height": 0}, {"kind": "cubic"}):
        with pytest.raises(ValueError):
            warping.resized(df, **bad)


def test_variants_are_drawn_by_hash(spark):
    p = np.random.default_rng(5).integers(60, 190, (6, 7))
    df = spark.createDataFrame([(i, 6, 7, p.ravel().tolist()) for i in range(6)], "img_id long, h int, w int, pixels array<int>")
    one = sorted(map(tuple, ((r.img_id, r.variant, *r.pixels) for r in warping.augmented(df, 5, seed=3).collect())))
    two = sorted(map(tuple, ((r.img_id, r.variant, *r.pixels) for r in warping.augmented(df.repartition(4), 5, seed=3).collect())))
    assert one == two and len(one) == 30 and len({v[2:] for v in one}) > 20
    other = sorted((r.img_id, r.variant, *r.pixels) for r in warping.augmented(df, 5, seed=4).collect())
    assert other != one
    allowed = set()
    for mirror in (p, p[:, ::-1]):
        for light in range(-40, 41):
            for s in (kernels.SHARPER, kernels.SOFTER, np.array([[1.0]])):
                allowed.add(tuple(np.clip(np.rint(kernels.stencilled(mirror + light, s)), 0, 255).astype(int).ravel()))
    assert all(v[2:] in allowed for v in one)
