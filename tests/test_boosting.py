import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradarium.functions.expressions import bin_of, experiment_code, experiment_stamp, iou_corners, iou_sizes, logit, number_or_null, polynomial_hash, whole_or_null
from gradarium.operators import selection
from gradarium.operators.binning import feature_rows, find_ranges
from gradarium.operators.boosting import BoostedBins, BoostedModel
from gradarium.operators.metrics import accuracies, precision_threshold, roc_points


def numpy_fit(x, y, rounds, b=8, r=0.05, most=2.0):
    """An independent model: explicit weights, a direct error."""
    m, n = x.shape
    lo, hi, bins = np.zeros(n), np.zeros(n), np.zeros((m, n), int)
    for j in range(n):
        s = np.sort(x[:, j])
        lo[j], hi[j] = s[math.ceil(r * m)], s[math.floor((1 - r) * m)]
        if lo[j] >= hi[j]:
            lo[j], hi[j] = s[0], s[-1]
        if hi[j] > lo[j]:
            bins[:, j] = np.clip(np.floor(b * (x[:, j] - lo[j]) / (hi[j] - lo[j])), 0, b - 1)
    w, out = np.full(m, 1 / m), []
    for _ in range(rounds):
        best = None
        for j in range(n):
            p, q = np.bincount(bins[:, j], w * (y > 0), b), np.bincount(bins[:, j], w * (y < 0), b)
            with np.errstate(divide="ignore", invalid="ignore"):
                v = np.where(p == q, 0, np.where(p == 0, -most, np.where(q == 0, most, np.clip(0.5 * np.log(p / q), -most, most))))
            err = float((w * np.exp(-y * v[bins[:, j]])).sum())
            if best is None or round(err, 13) < round(best[1], 13):
                best = (j, err, v)
        j, err, v = best
        w = w * np.exp(-y * v[bins[:, j]]) / err
        assert abs(w.sum() - 1) < 1e-9 and err <= 1 + 1e-12
        out.append((j, err, v))
    return out, bins


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    y = np.where(x[:, 0] + 0.7 * x[:, 3] ** 2 + rng.normal(scale=0.5, size=300) > 0.5, 1, -1)
    x = np.column_stack([x, x[:, 3], np.full(300, 2.0)])  # the same feature twice, a constant one
    df = spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (c, r) in enumerate(zip(y, x, strict=True))], "id long, y int, x array<double>")
    return df.repartition(3), x, y


def test_fit_equals_numpy(data):
    df, x, y = data
    model = BoostedBins(rounds=20).fit(df, "y", "x")
    want, bins = numpy_fit(x, y, 20)
    assert [r[1] for r in model.rows] == [j for j, _, _ in want]
    for r, (_, err, v) in zip(model.rows, want, strict=True):
        assert r[4] == pytest.approx(err, abs=1e-9) and r[5] == pytest.approx(list(v), abs=1e-9)
    scores = np.array([r.score for r in model.transform(df).orderBy("id").collect()])
    assert scores == pytest.approx(sum(v[bins[:, j]] for j, _, v in want), abs=1e-9)
    assert model.truncated(7).rows == model.rows[:7]
    assert "rounds=20" in model.describe() and model.describe(verbose=True).count("\n") == 21


def test_stages_equal_shorter_models(data, spark):
    df, _, y = data
    model = BoostedBins(rounds=12).fit(df, "y", "x").with_threshold(0.05)
    stages = [12, 1, 5, 5]
    rows = model.staged(df.withColumn("other", F.lit("a")), stages).collect()
    figures = {r.rounds: r for r in model.staged_figures(df, "y", stages).collect()}
    assert set(figures) == {1, 5, 12} and len(rows) == 300
    for k, t in enumerate((1, 5, 12)):
        short = model.truncated(t).transform(df)
        score = {r.id: (r.score, r.prediction) for r in short.collect()}
        assert all(r.scores[k] == score[r.id][0] for r in rows)
        want = accuracies(short, []).first()
        f = figures[t]
        assert f.m == 300 and (f.accuracy, f.sensitivity, f.far) == pytest.approx((want.accuracy, want.sensitivity, want.far))
    columns = df.select("y", *[F.col("x")[k].alias(f"c{k}") for k in range(7)])
    named = BoostedBins(rounds=4).fit(columns, "y", [f"c{k}" for k in range(7)])
    assert named.staged_figures(columns, F.when(F.col("c0") > 0, F.col("y")), [4]).first().m == int((data[1][:, 0] > 0).sum())
    one_class = named.staged_figures(columns.where("y = 1"), "y", [2]).first()
    assert one_class.far is None and one_class.accuracy == one_class.sensitivity
    for bad in ([], [0], [13]):
        with pytest.raises(ValueError, match="stages"):
            model.staged(df, bad)


def test_many_rounds_score_alike(data, spark):
    df, _, _ = data
    model = BoostedBins(rounds=2).fit(df, "y", "x")
    long = BoostedModel(**{**model.__dict__, "rows": model.rows * 40})
    rows = df.select("x", model.score().alias("a"), long.score().alias("b")).collect()
    assert [r.b for r in rows] == pytest.approx([40 * r.a for r in rows])


def test_model_round_trip(data, spark, tmp_path):
    df, _, _ = data
    model = BoostedBins(rounds=3).fit(df, "y", "x").with_threshold(0.3)
    model.save(spark, f"{tmp_path}/m")
    assert BoostedModel.load(spark, f"{tmp_path}/m") == model


def test_validation(spark):
    for bad in ({"rounds": 0}, {"n_bins": 0}, {"n_bins": 33}, {"outliers_ratio": 0.3}, {"logit_max": 0.0}, {"logit_max": 9.0}):
        with pytest.raises(ValueError):
            BoostedBins(**bad)
    one = spark.createDataFrame([(1, 1.0), (1, 2.0)], "y int, a double")
    three = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 0.0)], "y int, a double")
    for df in (one, three, one.where("a > 5")):
        with pytest.raises(ValueError):
            feature_rows(df, "y", ["a"])
    with pytest.raises(Exception, match="two rows"):
        find_ranges(spark.createDataFrame([([1.0],)], "x array<double>"))
    with pytest.raises(Exception, match="null or NaN"):
        find_ranges(spark.createDataFrame([([1.0],), ([None],)], "x array<double>"))


@pytest.mark.parametrize("bad", [[None], [[1.0, 2.0, 3.0]], [[1.0]], [[1.0, None]], [[1.0, math.nan]], [[]]])
def test_odd_feature_arrays_are_refused(spark, bad):
    rows = [(k % 2, [float(k), 1.0]) for k in range(40)]
    for place in (0, 25):
        df = spark.createDataFrame(rows[:place] + [(0, x) for x in bad] + rows[place:], "y int, x array<double>").coalesce(1)
        for ratio in (0.0, 0.05):
            with pytest.raises(Exception, match="features"):
                BoostedBins(rounds=1, outliers_ratio=ratio).fit(df, "y", "x")
    columns = spark.createDataFrame([(k % 2, float(k), None if k == 3 else 1.0) for k in range(40)], "y int, a double, b double")
    with pytest.raises(Exception, match="null or NaN"):
        BoostedBins(rounds=1).fit(columns, "y", ["a", "b"])


def test_selection_equals_a_sort(spark, monkeypatch):
    rng = np.random.default_rng(7)
    m = 3000
    columns = [
        rng.normal(size=m), rng.integers(0, 3, m).astype(float), np.zeros(m), np.full(m, -2.5), np.where(rng.random(m) < 0.5, -0.0, 0.0),
        rng.normal(size=m) * 10.0 ** rng.integers(-300, 300, m), np.where(rng.random(m) < 0.4, np.inf, -np.inf), np.where(rng.random(m) < 0.5, 5e-324, -5e-324),
        1.0 + rng.integers(0, 40, m) * 2.0**-52, np.where(rng.random(m) < 0.9, 7.0, rng.normal(size=m)), np.sort(rng.random(m)), np.where(np.arange(m) == 5, 1e308, -1e308),
    ]
    x = np.stack(columns, 1)
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(5)
    ranks, ordered = [0, 1, 150, 1499, 2850, 2999], np.sort(x, 0)
    for counts, fetch in ((2**19, 2**18), (2**19, 0), (2**8, 500), (2**8, 0)):
        monkeypatch.setattr(selection, "COUNTS", counts)
        monkeypatch.setattr(selection, "FETCHED", fetch)
        rows, least, most = selection.ends_of(df, "x", x.shape[1])
        assert rows == m and (least == ordered[0]).all() and (most == ordered[-1]).all()
        got = selection.at_ranks(df, "x", x.shape[1], ranks, least, most)
        assert (got == ordered[ranks].T).all() and not np.signbit(got[4]).any()
    keys = selection.ordered_keys(ordered[:, 5])
    assert (np.diff(keys.astype(object)) >= 0).all() and (selection.doubles_of(keys) == ordered[:, 5]).all()


def test_ranges_and_bins(spark):
    columns = [float(v) for v in range(100)], [5.0] * 100, [5.0] * 98 + [1.0, 9.0]
    rows = spark.createDataFrame([(list(v),) for v in zip(*columns, strict=True)], "x array<double>")
    assert find_ranges(rows) == [(0, 5.0, 95.0), (1, 5.0, 5.0), (2, 1.0, 9.0)]
    assert find_ranges(rows, 0.0) == [(0, 0.0, 99.0), (1, 5.0, 5.0), (2, 1.0, 9.0)]
    values = spark.createDataFrame([(v,) for v in (-1e9, 0.0, 0.99, 1.0, 7.99, 8.0, 1e9)], "x double")
    assert [r[0] for r in values.select(bin_of(F.col("x"), 0.0, 8.0, 8)).collect()] == [0, 0, 0, 1, 7, 7, 7]
    assert [r[0] for r in values.select(bin_of(F.col("x"), 3.0, 3.0, 8)).collect()] == [0] * 7


def test_logit(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.3, 0.3), (1.0, math.e), (9e9, 1.0)], "p double, n double")
    assert [r[0] for r in df.select(logit(F.col("p"), F.col("n"), 2.0)).collect()] == pytest.approx([0, 2, -2, 0, -0.5, 2])


def test_threshold_is_strict_and_figures(spark):
    df = spark.createDataFrame([(1, 0.0, [0.0]), (-1, 0.0, [0.0])], "y int, s double, x array<double>")
    model = BoostedModel(rows=[(0, 0, 0.0, 1.0, 1.0, [0.0] * 8)], classes=[-1, 1], features=["x[0]"], array_column="x", n_bins=8)
    scored = model.transform(df)
    assert [r.prediction for r in scored.collect()] == [-1, -1]
    assert accuracies(scored, []).first().asDict() == {"accuracy": 0.5, "sensitivity": 0.0, "far": 0.0}


def test_roc_and_precision_threshold(spark):
    rng = np.random.default_rng(2)
    y, s = rng.choice([-1, 1], 400), np.round(rng.normal(size=400), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, score double").repartition(4)
    points, fp, tp = [(0, 0)], 0, 0
    steps = [((y[s == v] == -1).sum(), (y[s == v] == 1).sum(), v) for v in sorted(set(s), reverse=True)]
    kept = []
    for k, (n, p, v) in enumerate(steps):
        fp, tp = fp + n, tp + p
        if k + 1 == len(steps) or (steps[k + 1][0], steps[k + 1][1]) != (n, p):
            points.append((int(fp), int(tp)))
            kept.append((v, int(fp), int(tp)))
    roc = roc_points(df)
    assert [(r.fp, r.tp) for r in roc.orderBy("rank").collect()] == points
    kept = [(v, t / (t + f)) for v, f, t in kept if f]
    i = max(range(len(kept)), key=lambda k: (round(kept[k][1], 12), -k))
    want = kept[i][0] if i == 0 else 0.25 * kept[i][0] + 0.75 * kept[i - 1][0]
    assert precision_threshold(roc).first().threshold == pytest.approx(want)


def test_boxes_and_text(spark):
    one = spark.range(1)
    lit = lambda *c: tuple(map(F.lit, c))
    got = one.select(iou_corners(lit(0, 0, 9, 9), lit(0, 0, 9, 9)), iou_sizes(lit(0, 0, 10, 10), lit(10, 0, 10, 10)), iou_sizes(lit(0, 0, 10, 10), lit(5, 0, 10, 10)), iou_sizes(lit(5, 0, 10, 10), lit(0, 0, 10, 10))).first()
    assert list(got) == pytest.approx([1.0, 0.0, 1 / 3, 1 / 3])
    text = "some experiment 17"
    h = 0
    for c in text:
        h = h * 31 + ord(c)
    assert one.select(experiment_stamp(F.lit(text), 4, F.lit("2024-02-03").cast("date"))).first()[0] == f"{str(h % 2**32 % 10**4).zfill(4)}_20240203"
    assert list(one.select(whole_or_null(F.lit("12")), whole_or_null(F.lit("x")), number_or_null(F.lit("1.5")), number_or_null(F.lit("None"))).first()) == [12, None, 1.5, None]
    row = one.select(polynomial_hash(F.lit(text)), experiment_code(F.lit(text), 10)).first()
    assert row[0] == h % 2**32 and row[1] == str(h % 2**32 % 10**10).zfill(10)
