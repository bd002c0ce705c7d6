import numpy as np
import pytest
from pyspark.sql import functions as F

from gradarium.operators.boosting import BoostedBins
from gradarium.operators import detection, rectangles
from gradarium.operators.boosting import BoostedModel
from gradarium.operators.experiments import CLASSIFIERS, grid_name, random_grid, run_grid
from gradarium.streaming import streams


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, "a" if i % 3 else "b", float((i * 37) % 11), 1 if (i * 37) % 11 > 5 else 0) for i in range(120)], "id long, name string, v double, y int")


def test_stream_equals_batch(spark, rows, tmp_path):
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    model = BoostedBins(rounds=2, n_bins=4).fit(rows, "y", ["v"])
    scored = streams.score_stream(source, {"one": model, "short": model.truncated(1)})
    streams.run_available(scored, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = spark.read.schema(scored.schema).parquet(f"{tmp_path}/out")
    want = streams.score_stream(rows, {"one": model, "short": model.truncated(1)})
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 240


def test_moving_average_with_state(spark, rows, tmp_path):
    for k in range(3):  # files in the order of the rows, one a batch
        rows.where(F.floor(F.col("id") / 40) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = streams.moving_average_stream(source, "name", "id", "v")
    streams.run_available(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = {r.order: (r.ema, r.n, r.total) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()}
    batch = {r.id: r.ema for r in streams.moving_average(rows, "name", "id", "v").collect()}
    state = {}
    for r in sorted(rows.collect()):
        a, n, t = state.get(r.name, (0.0, 0, 0.0))
        a, n, t = 0.9 * a + 0.1 * r.v, n + 1, t + r.v
        state[r.name] = (a, n, t)
        assert batch[r.id] == pytest.approx(a / (1 - 0.9**n)) == got[r.id][0]
        assert got[r.id][1:] == (n, pytest.approx(t))


def test_moving_average_of_a_trigger_in_any_order_is_merged_from_blocks(spark, tmp_path):
    rng = np.random.default_rng(8)
    n = 4000
    key, x = rng.choice(["hot"] * 9 + ["b"], n), rng.normal(size=n)
    df = spark.createDataFrame([(int(i), str(k), float(v)) for i, (k, v) in enumerate(zip(key, x, strict=True))], "id long, name string, v double")
    for a, b in ((0, 2500), (2500, n)):  # two triggers of a few files in any order of rows
        df.where(f"id >= {a} and id < {b}").repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        out = streams.moving_average_stream(source, "name", "id", "v", block=16)
        streams.run_available(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = {r.order: (r.ema, r.n, r.total) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()}
    state, want = {}, {}
    for i, (k, v) in enumerate(zip(key, x, strict=True)):
        a, c, t = state.get(k, (0.0, 0, 0.0))
        state[k] = a, c, t = 0.9 * a + 0.1 * v, c + 1, t + v
        want[i] = (a / (1 - 0.9**c), c, t)
    assert len(got) == n and all(got[i] == (pytest.approx(want[i][0]), want[i][1], pytest.approx(want[i][2])) for i in range(n))


def test_moving_average_of_batches_goes_on_from_its_state(spark, tmp_path):
    rng = np.random.default_rng(5)
    n = 900
    key, x = rng.choice(["hot"] * 7 + ["b", "c"], n), rng.normal(size=n) * 100
    key[:300] = np.where(key[:300] == "c", "b", key[:300])  # a key that comes later, one that stays away
    key[600:] = np.where(key[600:] == "b", "hot", key[600:])
    df = spark.createDataFrame([(int(i), str(k), float(v), 7) for i, (k, v) in enumerate(zip(key, x, strict=True))], "id long, name string, v double, extra int")
    put = lambda a, b: df.where(f"id >= {a} and id < {b}").repartition(3).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put(0, 300)
    put(300, 450)
    source = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    first = streams.moving_average_batches(source(), "name", "id", "v", f"{tmp_path}/run").count()
    put(450, 900)
    rows = streams.moving_average_batches(source(), "name", "id", "v", f"{tmp_path}/run").collect()
    state, want = {}, {}
    for i, (k, v) in enumerate(zip(key, x, strict=True)):
        a, c, t = state.get(k, (0.0, 0, 0.0))
        state[k] = a, c, t = 0.9 * a + 0.1 * v, c + 1, t + v
        want[i] = (a / (1 - 0.9**c), c, t)
    assert first == 450 and len(rows) == n
    for r in rows:
        assert (r.ema, r.n, r.total) == (pytest.approx(want[r.id][0]), want[r.id][1], pytest.approx(want[r.id][2])) and r.extra == 7


def test_moving_average_of_a_hot_key_over_many_ranges(spark):
    rng = np.random.default_rng(0)
    key, x = rng.choice(["hot"] * 8 + ["b", "c"], 3000), rng.normal(size=3000) * 100
    df = spark.createDataFrame([(int(i), str(k), float(v), 7) for i, (k, v) in enumerate(zip(key, x, strict=True))], "id long, name string, v double, n int").repartition(5)
    got = {r.id: r.ema for r in streams.moving_average(df, "name", "id", "v").collect()}
    state, want = {}, {}
    for i, (k, v) in enumerate(zip(key, x, strict=True)):
        a, n = state.get(k, (0.0, 0))
        a, n = 0.9 * a + 0.1 * v, n + 1
        state[k] = (a, n)
        want[i] = a / (1 - 0.9**n)
    assert got == pytest.approx(want, rel=1e-9, abs=1e-9)
    assert streams.folded(np.arange(2000.0), 5.0, 0.5)[-1] == pytest.approx(1998.0) and streams.folded(np.array([1.0, 2.0]), 0.0, 0.0).tolist() == [1.0, 2.0]


def test_images_are_detected_in_a_stream_by_several_models(spark, tmp_path):
    rng = np.random.default_rng(3)
    frames = spark.createDataFrame([(i, 16, 20, rng.integers(0, 256, 320).tolist()) for i in range(12)], "img_id long, h int, w int, pixels array<int>")
    frames.repartition(3).write.parquet(f"{tmp_path}/in")
    features, sized = rectangles.catalogue(spark, 2, 1), detection.scales(spark, 3, 8, 8, 1.3, 0.2)
    model = lambda t, seed: BoostedModel(rows=[(k, f, -40.0, 40.0, 1.0, np.random.default_rng(seed + k).normal(size=8).tolist()) for k, f in enumerate((5, 11, 30))], classes=[-1, 1], features=[], array_column="x", n_bins=8, threshold=t)
    models = {"a": model(0.5, 1), "b": model(1.0, 7), "none": model(99.0, 1)}
    source = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = streams.detect_stream(source, features, sized, models)
    streams.run_available(found, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = sorted(map(tuple, spark.read.schema(found.schema).parquet(f"{tmp_path}/out").collect()))
    want = []
    for name in "ab":
        single = detection.suppress(detection.detect(frames, features, sized, models[name]), average=True)
        want += [(r.img_id, name, r.j, r.k, r.h, r.w, r.score) for r in single.collect()]
    assert got == sorted(want) and len(want) > 12
    both = detection.suppress(detection.detect(frames, features, sized, models), average=True)
    assert sorted((r.img_id, r.model, r.j, r.k, r.h, r.w, r.score) for r in both.collect()) == sorted(want)


def test_grid(spark, rows):
    df = rows.withColumn("x", F.array("v", F.lit(1.0))).withColumn("y", F.col("y") * 2 - 1)
    out = run_grid(spark, {"d": (df.where("id < 90"), df.where("id >= 90"))}, "y", "x", [1, 2], [8], CLASSIFIERS).collect()
    assert len(out) == 2 * len(CLASSIFIERS) * 9
    assert {r.metric for r in out} == {"time_fit", *[f"{m}_{p}" for m in ("time_predict", "acc", "sensitivity", "far") for p in ("train", "test")]}
    assert all(0 <= r.value <= 1 for r in out if "time" not in r.metric) and all(r.value >= (0.4 if r.classifier == "leafwise_trees" else 0.8) for r in out if "acc" in r.metric)  # two small steps from the prior
    assert all(r.ratio >= 1 for r in out)
    small = random_grid(spark, [(3, 40, 20)], [1], [4]).collect()
    assert {r.data_name for r in small} == {"3-40-20"} and len(small) == 9
    names = [grid_name(spark, "random", {"rounds": [1, k], "seed": 0}) for k in (2, 2, 3)]
    assert names[0] == names[1] != names[2] and names[0].startswith("random_") and len(names[0]) == 17
