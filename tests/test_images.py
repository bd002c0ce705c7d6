import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradarium.operators import builders, detection, kernels, rectangles
from gradarium.operators.boosting import BoostedModel
from gradarium.sources import readers, sinks


def test_known_numbers_of_windows_and_features(spark):
    frame = spark.createDataFrame([(1, 480, 640)], "img_id long, height int, width int")
    assert detection.sliding_windows(frame, detection.scales(spark, 9, 96, 96)).count() == 22278
    assert detection.sliding_windows(frame, detection.scales(spark, 12, 64, 64)).count() == 64173
    features = rectangles.catalogue(spark, 5, 5)
    assert features.count() == 18225 == features.agg(F.max("f")).first()[0] + 1
    assert rectangles.catalogue(spark, 1, 1).count() == 9


@pytest.fixture(scope="module")
def pictures():
    rng = np.random.default_rng(1)
    return {i: rng.integers(0, 256, (h, w)) for i, (h, w) in enumerate([(6, 9), (1, 4), (5, 1), (12, 12)])}


def frame_of(spark, pictures):
    return spark.createDataFrame([(i, *p.shape, p.ravel().tolist()) for i, p in pictures.items()], "img_id long, h int, w int, pixels array<int>")


def test_integral_images(spark, pictures):
    df = frame_of(spark, pictures)
    arrays = {r.img_id: r.ii for r in rectangles.integral_arrays(df).collect()}
    got = {(r.img_id, r.j, r.k): r.ii for r in rectangles.integral(rectangles.pixels(df)).collect()}
    for i, p in pictures.items():
        want = p.cumsum(0).cumsum(1)
        assert arrays[i] == want.ravel().tolist()
        assert all(got[i, j, k] == want[j, k] for j in range(p.shape[0]) for k in range(p.shape[1]))


def test_rectangles_at_edges(spark, pictures):
    rows = rectangles.integral_arrays(frame_of(spark, {3: pictures[3]}))
    p = pictures[3]
    for box in ((0, 0, 11, 11), (0, 0, 0, 0), (0, 3, 5, 11), (4, 0, 11, 2), (11, 11, 11, 11)):
        j1, k1, j2, k2 = box
        got = rows.select(rectangles.rectangle_sum(F.col("ii"), F.col("w"), *map(F.lit, box))).first()[0]
        assert got == p[j1 : j2 + 1, k1 : k2 + 1].sum()


def test_features_equal_numpy(spark, pictures):
    features = rectangles.catalogue(spark, 2, 2)
    sized = spark.createDataFrame([(0, 10, 10, 1, 1), (1, 12, 12, 1, 1)], "s int, h int, w int, dj int, dk int")
    images = frame_of(spark, {3: pictures[3]})
    windows = detection.sliding_windows(images.select("img_id", F.col("h").alias("height"), F.col("w").alias("width")), sized)
    got = rectangles.window_features(windows, rectangles.scaled_boxes(features, sized), rectangles.integral_arrays(images)).collect()
    unit = {r.f: (r.bg, r.white) for r in features.collect()}
    p, side = pictures[3], {0: 10, 1: 12}
    assert len(got) == len(unit) * (9 + 1)
    for r in got:
        (a, b, c, d), (e, f, g, h) = ([int(v * side[r.s]) for v in box] for box in unit[r.f])
        whole, white = p[r.j0 + a : r.j0 + a + c, r.k0 + b : r.k0 + b + d], p[r.j0 + e : r.j0 + e + g, r.k0 + f : r.k0 + f + h]
        want = int(white.sum() / white.size - (whole.sum() - white.sum()) / (whole.size - white.size)) if white.size and whole.size > white.size else 0
        assert r.value == want


def test_detection_equals_features_and_scores(spark, pictures):
    features, sized = rectangles.catalogue(spark, 2, 2), spark.createDataFrame([(0, 9, 9, 1, 1), (1, 12, 12, 1, 2)], "s int, h int, w int, dj int, dk int")
    images = frame_of(spark, pictures)
    rng = np.random.default_rng(0)
    rows = [(t, int(f), -60.0, 60.0, 1.0, rng.normal(size=8).tolist()) for t, f in enumerate((40, 3, 200, 40))]
    model = BoostedModel(rows=rows, classes=[-1, 1], features=[], array_column="x", n_bins=8, threshold=-3.0)
    got = {(r.img_id, r.s, r.j, r.k): r.score for r in detection.detect(images, features, sized, model).collect()}
    windows = detection.sliding_windows(images.select("img_id", F.col("h").alias("height"), F.col("w").alias("width")), sized)
    values = rectangles.window_features(windows, rectangles.scaled_boxes(features.where("f in (3, 40, 200)"), sized), rectangles.integral_arrays(images))
    by_window = {}
    for r in values.collect():
        by_window.setdefault((r.img_id, r.s, r.j0, r.k0), {})[r.f] = r.value
    want = {}
    for key, v in by_window.items():
        score = sum(logits[min(7, max(0, int(np.floor(8 * (v[f] + 60) / 120))))] for _, f, _, _, _, logits in rows)
        if score > -3.0:
            want[key] = score
    assert got.keys() == want.keys() and len(want) > 3 and all(got[k] == pytest.approx(want[k]) for k in want)


def test_early_exit_changes_nothing(monkeypatch):
    rng = np.random.default_rng(11)
    image = rng.integers(0, 256, (70, 90))
    scales_ = [(0, 20, 20, 2, 3), (1, 31, 40, 4, 4), (2, 90, 20, 1, 1)]
    rounds = 60
    side = [np.array([s[1], s[2], s[1], s[2]]) for s in scales_]
    unit = np.stack([rng.random(rounds) * 0.4, rng.random(rounds) * 0.4, 0.1 + rng.random(rounds) * 0.5, 0.1 + rng.random(rounds) * 0.5], 1)
    inner = unit * [1, 1, 0.5, 0.6] + np.stack([unit[:, 2] * 0.2, unit[:, 3] * 0.3, np.zeros(rounds), np.zeros(rounds)], 1)
    bg, white = (np.stack([(u * s).astype(int) for s in side]) for u in (unit, inner))
    lo, hi = np.full(rounds, -40.0), np.where(np.arange(rounds) % 9, 40.0, -40.0)
    logits = rng.normal(size=(rounds, 8))
    for threshold in (-1e9, 0.0, 12.0, 1e9):
        found, score = kernels.Cascade(scales_, bg, white, lo, hi, logits, threshold).detected(kernels.integral(image), True)
        want = []
        for p, (s, h, w, dj, dk) in enumerate(scales_):
            for j in range((70 - h) % dj // 2, 70 - h + 1, dj):
                for k in range((90 - w) % dk // 2, 90 - w + 1, dk):
                    total = 0.0
                    for t in range(rounds):
                        (a, b, c, d), (e, f, g, i) = bg[p, t], white[p, t]
                        whole, lit = image[j + a : j + a + c, k + b : k + b + d], image[j + e : j + e + g, k + f : k + f + i]
                        v = int(lit.sum() / lit.size - (whole.sum() - lit.sum()) / (whole.size - lit.size)) if lit.size and whole.size > lit.size else 0
                        total += logits[t, min(7, max(0, math.floor(8 * (v + 40) / 80))) if hi[t] > lo[t] else 0]
                    if total > threshold:
                        want.append((s, j, k, h, w, total))
            if threshold < 0:
                break
        mine = [(*map(int, r), float(v)) for r, v in zip(found, score, strict=True) if threshold >= 0 or r[0] == 0]
        assert mine == want and (len(want) > 5 or threshold > 100)
    for dtype, big in ((np.int16, 30_000), (np.uint8, 255)):
        p = rng.integers(0, big, (9, 13)).astype(dtype)
        assert (kernels.integral(p)[1:, 1:] == p.astype(np.int64).cumsum(0).cumsum(1)).all()


def test_images_without_pixels_and_odd_ones(spark):
    features, sized = rectangles.catalogue(spark, 2, 1), detection.scales(spark, 2, 4, 4, 1.3, 0.5)
    model = BoostedModel(rows=[(0, 3, -9.0, 9.0, 1.0, [1.0] * 8)], classes=[-1, 1], features=[], array_column="x", n_bins=8)
    schema = "img_id string, h int, w int, pixels array<int>"
    none = spark.createDataFrame([("a", None, None, None), ("b", 0, 0, []), ("c", 4, 4, [9] * 16)], schema)
    assert [(r.img_id, len(r.found)) for r in detection.detections_in_rows(none, features, sized, {"m": model}).orderBy("img_id").collect()] == [("a", 0), ("b", 0), ("c", 1)]
    assert [r.ii for r in rectangles.integral_arrays(none).orderBy("img_id").collect()][:2] == [[], []]
    assert detection.detections_in_rows(none.where("h > 9"), features, sized, {"m": model}).count() == 0
    wide = spark.createDataFrame([("d", 4, 4, [3000, 5] * 8)], schema)  # more than eight bits
    assert detection.detect(wide, features, sized, model).first().score == 1.0
    for bad in ((4, 4, [1] * 15), (4, 4, [None] * 16), (None, 4, [1] * 4)):
        with pytest.raises(Exception, match="pixels"):
            detection.detect(spark.createDataFrame([("x", *bad)], schema), features, sized, model).collect()


def test_mosaics(spark):
    rng = np.random.default_rng(1)
    tiles = {i: rng.integers(0, 256, (2, 3)) for i in (0, 1, 2, 5, 6, 13)}
    rows = spark.createDataFrame([(i, 2, 3, t.ravel().tolist()) for i, t in tiles.items()], "img_id long, h int, w int, pixels array<int>").repartition(3)
    got = {r.img_id: np.array(r.pixels).reshape(r.h, r.w) for r in readers.mosaics(rows, 2, 3).collect()}
    assert set(got) == {0, 1, 2}
    for n, picture in got.items():
        want = np.zeros((4, 9), int)
        for i, t in tiles.items():
            if i // 6 == n:
                want[i % 6 // 3 * 2 :, i % 3 * 3 :][:2, :3] = t
        assert (picture == want).all()


def greedy(boxes, least):
    def iou(a, b):
        dj, dk = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        both = max(dj, 0) * max(dk, 0)
        return both / (a[2] * a[3] + b[2] * b[3] - both)

    left, out = sorted(boxes, key=lambda b: (-b[4], b[:4])), []
    while left:
        own = [left[0]] + [b for b in left[1:] if iou(left[0], b) >= least]
        out.append(own)
        left = [b for b in left if b not in own]
    return out


def test_suppression(spark):
    rng = np.random.default_rng(4)
    boxes = {i: sorted({(*map(int, rng.integers(0, 40, 2)), *map(int, rng.integers(5, 20, 2)), float(np.round(rng.random(), 2))) for _ in range(n)}) for i, n in ((1, 60), (2, 1), (3, 2))}
    df = spark.createDataFrame([(i, *b) for i, bs in boxes.items() for b in bs], "img_id long, j int, k int, h int, w int, score double")
    best = sorted((r.img_id, r.j, r.k, r.h, r.w, r.score) for r in detection.suppress(df).collect())
    assert best == sorted((i, *c[0]) for i, bs in boxes.items() for c in greedy(bs, 0.25))
    mean = sorted((r.img_id, r.j, r.k, r.h, r.w, round(r.score, 9)) for r in detection.suppress(df, average=True).collect())
    assert mean == sorted((i, *[round(float(np.mean([b[k] for b in c]))) for k in range(4)], round(float(np.mean([b[4] for b in c])), 9)) for i, bs in boxes.items() for c in greedy(bs, 0.25))
    assert detection.suppress(df.where("img_id = 2"), drop_last=True).count() == 0
    assert detection.suppress(df.where("img_id = 2")).count() == 1
    pairs = {(r.img_id, r.a, r.b) for r in detection.overlapping_pairs(df.withColumn("box", F.monotonically_increasing_id())).collect()}
    assert all(i == 1 or len(boxes[i]) > 1 for i, _, _ in pairs)


def test_negatives_and_targets(spark):
    images = spark.createDataFrame([(i, 200, 300) for i in range(5)], "img_id long, height int, width int")
    targets = spark.createDataFrame([(i, 20, 20, 120, 120) for i in range(5)], "img_id long, j int, k int, h int, w int")
    rows = detection.negative_windows(images, targets, per_image=4, most_iou=0.2).collect()
    assert len(rows) == 20 and rows == detection.negative_windows(images.repartition(3), targets, 4, most_iou=0.2).orderBy("img_id", "draw").collect() or sorted(rows) == sorted(detection.negative_windows(images.repartition(3), targets, 4, most_iou=0.2).collect())
    for r in rows:
        dj, dk = min(r.j + r.h, 140) - max(r.j, 20), min(r.k + r.w, 140) - max(r.k, 20)
        both = max(dj, 0) * max(dk, 0)
        assert both / (r.h * r.w + 14400 - both) < 0.2 and 20 <= r.h <= 100 and r.j + r.h <= 200 and r.k + r.w <= 300
    t = spark.createDataFrame([(100, 100, 0, 0, 10, 10), (100, 100, -1, 0, 10, 10), (100, 100, 95, 0, 10, 10), (100, 100, 0, 0, 7, 7)], "height int, width int, j int, k int, h int, w int")
    assert detection.valid_targets(t).count() == 1


def test_annotations(spark, tmp_path):
    (tmp_path / "fold.txt").write_text("2002/08/img_1\n2\n67.5 44.2 -1.4 105.2 87.2 1\n41.9 23.1 1.4 184.0 129.3  1\n2002/08/img_2\n1\n10 5 0.1 50 60 1\n")
    rows = readers.ellipse_targets(readers.ellipse_annotations(spark, str(tmp_path / "fold.txt"))).orderBy("image", "nth").collect()
    assert [(r.image, r.nth, r.h, r.j, r.k) for r in rows] == [("2002/08/img_1", 0, 101, 36, 54), ("2002/08/img_1", 1, 62, 98, 153), ("2002/08/img_2", 0, 15, 52, 42)]
    (tmp_path / "a.json").write_text('{"x1": {"bboxes": [[0.1, 0.2, 0.3, 0.1], [0, 0, 0.5, 0.5]], "labels": ["palm", "no_gesture"]}}')
    boxes = readers.box_annotations(spark, str(tmp_path / "a.json"))
    assert boxes.count() == 2
    box = readers.box_targets(boxes, "palm", F.lit(100), F.lit(200)).collect()
    assert [(r.image, r.h, r.w, r.j, r.k) for r in box] == [("x1", 60, 60, -5, 20)]


def test_targets_are_cut_and_rounded_at_the_end(spark):
    rows = spark.createDataFrame([(67.5, 50.2, 50.9), (10.0, 50.0, 6.6), (10.0, 6.6, 50.0), (10.0, 6.0, 50.0)], "major double, cx double, cy double")
    got = [(r.h, r.j, r.k) for r in readers.ellipse_targets(rows).collect()]
    assert got == [(int(1.5 * m), int(y - 0.5 * int(1.5 * m)), int(x - 0.5 * int(1.5 * m))) for m, x, y in ((67.5, 50.2, 50.9), (10.0, 50.0, 6.6), (10.0, 6.6, 50.0), (10.0, 6.0, 50.0))]
    assert got[1][1] == 0 and got[3][2] == -1  # -0.9 is cut to 0, -1.5 to -1
    box = spark.createDataFrame([("a", 0, "palm", 0.031, 0.027, 0.106, 0.104)], "image string, nth int, label string, x double, y double, bw double, bh double")
    r = readers.box_targets(box, "palm", F.lit(100), F.lit(100)).first()
    assert (r.h, r.j, r.k) == (11, 3, 3)


def test_negatives_go_on_until_there_are_enough(spark):
    images = spark.createDataFrame([(i, 100, 100) for i in range(6)], "img_id long, height int, width int")
    crowd = spark.createDataFrame([(i, 10 * a, 10 * b, 28, 28) for i in range(6) for a in range(8) for b in range(8)], "img_id long, j int, k int, h int, w int")
    few = detection.negative_windows(images, crowd, 4, draws=4, most_iou=0.2).collect()
    assert all(sum(r.img_id == i for r in few) == 4 for i in range(6)) and max(r.draw for r in few) >= 4
    whole = detection.negative_windows(images, crowd, 4, draws=400, most_iou=0.2).collect()
    assert sorted(few) == sorted(whole)
    full = spark.createDataFrame([(0, 0, 0, 9, 9)], "img_id long, j int, k int, h int, w int")
    some = detection.negative_windows(images.where("img_id < 2"), full, 3, draws=2, most_iou=0.0, most_rounds=2)  # nothing is below 0 beside a target
    assert {r.img_id for r in some.collect()} == {1}
    assert [tuple(r) for r in detection.short_images(images.where("img_id < 2"), some, 3).collect()] == [(0, 0)]


def test_examples_from_images_and_annotations(spark, tmp_path):
    rng = np.random.default_rng(9)
    (tmp_path / "im" / "a").mkdir(parents=True)
    shapes = {"one": (60, 80), "two": (50, 50)}
    pixels = {n: rng.integers(0, 256, (*s, 3)).astype(np.uint8) for n, s in shapes.items()}
    for n, p in pixels.items():  # a bitmap: rows from the bottom up, padded to four bytes, blue first
        h, w, _ = p.shape
        lines = b"".join(r.tobytes() + b"\0" * (-3 * w % 4) for r in p[::-1])
        (tmp_path / "im" / "a" / f"{n}.bmp").write_bytes(b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(lines), 0, 0, 54, 40, w, h, 1, 24, 0, len(lines), 0, 0, 0, 0) + lines)
    gray = {r.path.split("/")[-1]: np.array(r.pixels).reshape(r.h, r.w) for r in readers.gray_images(spark, f"{tmp_path}/im/a").collect()}
    for n, p in pixels.items():
        assert (gray[f"{n}.bmp"] == np.rint(p.astype(float) @ [0.114, 0.587, 0.299])).all()
    (tmp_path / "fold-03.txt").write_text("a/one\n2\n20 10 0.1 40 30 1\n20 10 0.1 5 30 1\n")
    (tmp_path / "fold-10.txt").write_text("a/two\n1\n12 5 0.1 25 25 1\n")
    features = rectangles.catalogue(spark, 2, 1)
    unit = {r.f: (r.bg, r.white) for r in features.collect()}

    def value(p, r, f):
        (a, b, c, d), (e, g, u, v) = ([int(x * s) for x, s in zip(box, (r.h, r.w, r.h, r.w), strict=True)] for box in unit[f])
        whole, white = p[r.j + a : r.j + a + c, r.k + b : r.k + b + d], p[r.j + e : r.j + e + u, r.k + g : r.k + g + v]
        return int(white.sum() / white.size - (whole.sum() - white.sum()) / (whole.size - white.size)) if white.size and whole.size > white.size else 0

    rows = builders.ellipse_examples(spark, f"{tmp_path}/im/a", f"{tmp_path}/fold-*.txt", features, 3, folders=1).collect()
    assert sorted((r.img_id, r.nth, r.y, r.is_train) for r in rows) == [(n, k, 1 if k == 0 else -1, n == "a/one") for n in ("a/one", "a/two") for k in range(4)]
    assert {(r.img_id, r.j, r.k, r.h) for r in rows if r.y == 1} == {("a/one", 15, 25, 30), ("a/two", 16, 16, 18)}
    for r in rows:
        p = gray[r.img_id[2:] + ".bmp"].astype(int)
        assert r.x == [value(p, r, f) for f in sorted(unit)]
    (tmp_path / "b.json").write_text('{"one": {"bboxes": [[0.2, 0.2, 0.3, 0.3], [0, 0, 0.2, 0.2]], "labels": ["palm", "none"]}, "two": {"bboxes": [[0.1, 0.1, 0.5, 0.4]], "labels": ["palm"]}}')
    rows = builders.box_examples(spark, f"{tmp_path}/im/a", f"{tmp_path}/b.json", "palm", features, 3).orderBy("img_id", "nth").collect()
    assert [r.is_train for r in rows] == [True] * 6 + [False] * 2 and [r.y for r in rows] == [1, -1, -1, -1] * 2
    assert [(r.j, r.k, r.h) for r in rows if r.y == 1] == [(9, 16, 24), (2, 5, 25)]


def test_sources(spark):
    a, b = (readers.random_matrix(spark, 50, 4, 62, True, seed=3).repartition(n).orderBy("row_id").collect() for n in (1, 7))
    assert a == b and {r.y for r in a} == {-1, 1} and all(0 <= v < 62 and v == int(v) for r in a for v in r.x)
    nested = spark.createDataFrame([(1, [[1, 2], [3, 4]])], "id int, m array<array<int>>")
    assert readers.flattened(nested, "m", 2).first().x == [1.0, 2.0, 3.0, 4.0]


def test_tables_round_trip_and_folders_are_listed(spark, tmp_path):
    df = readers.random_matrix(spark, 30, 5, seed=2).withColumn("part", F.col("row_id") % 2)
    for fmt in ("parquet", "orc"):
        sinks.save_table(df, f"{tmp_path}/{fmt}", fmt, partition_by=["part"])
        back = readers.matrix(spark, f"{tmp_path}/{fmt}", fmt).select("row_id", "y", "x").orderBy("row_id").collect()
        assert back == df.select("row_id", "y", "x").orderBy("row_id").collect()
    with pytest.raises(Exception, match="already exists"):
        sinks.save_table(df, f"{tmp_path}/orc", "orc")
    for n in ("a.bin", "b.bin", "c.txt"):
        (tmp_path / n).write_bytes(n.encode())
    assert {(r.path.split("/")[-1], bytes(r.content)) for r in readers.image_files(spark, f"{tmp_path}/*.bin").collect()} == {("a.bin", b"a.bin"), ("b.bin", b"b.bin")}
