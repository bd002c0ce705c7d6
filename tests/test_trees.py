import numpy as np
import pytest
from pyspark.sql import functions as F

from gradarium.operators import trees
from gradarium.operators.binning import find_ranges
from gradarium.operators.experiments import staged_grid
from gradarium.operators.trees import LeafwiseTrees, TreeModel


def slow_fit(bins, y, rounds, leaves, b, rate, l2, least):
    """Best-first trees, one split at a time, every histogram counted anew from rows."""
    margin = np.full(len(y), np.log((y > 0).sum() / (y < 0).sum()))
    found = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - (y > 0), p * (1 - p)
        parts, splits = [np.arange(len(y))], []
        while len(parts) < leaves:
            options = []
            for k, rows in enumerate(parts):
                for j in range(bins.shape[1]):
                    for cut in range(b - 1):
                        low = bins[rows, j] <= cut
                        if least <= low.sum() <= len(rows) - least:
                            worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
                            options.append((worth(rows[low]) + worth(rows[~low]) - worth(rows), k, j, cut))
            best = max((o[0] for o in options), default=0)
            if best <= 1e-12:
                break
            near = [o for o in options if o[0] >= best * (1 - 1e-10)]
            _, k, j, cut = min(near, key=lambda o: (min(parts[o[1]]), o[2], o[3])) if len({o[1] for o in near}) > 1 else min(near, key=lambda o: o[2:])
            rows = parts.pop(k)
            low = bins[rows, j] <= cut
            parts += [rows[low], rows[~low]]
            splits.append((j, cut, int(low.sum()), int((~low).sum())))
        for rows in parts:
            margin[rows] += -g[rows].sum() / (h[rows].sum() + l2) * rate
        found.append(splits)
    return margin, found


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 4))
    y = np.where((x[:, 0] > 0.3) ^ (x[:, 2] * x[:, 1] > 0.2) ^ (rng.random(500) < 0.1), 1, -1)
    x = np.column_stack([x, x[:, 0], np.full(500, 3.0)])
    df = spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (c, r) in enumerate(zip(y, x, strict=True))], "id long, y int, x array<double>").repartition(4)
    ranges = find_ranges(df)
    lo, hi = (np.array([r[k] for r in ranges]) for k in (1, 2))
    with np.errstate(invalid="ignore"):
        bins = np.where(hi > lo, np.clip(np.floor(8 * (x - lo) / (hi - lo)), 0, 7), 0).astype(int)
    return df, x, y, bins


@pytest.mark.parametrize(("rounds", "leaves", "least", "l2", "cells", "cut"), [(3, 7, 20, 1.0, 2**22, 16), (4, 12, 5, 0.0, 1, 1), (2, 200, 30, 0.5, 2**22, 16), (2, 2, 1, 1.0, 100, 16)])
def test_trees_equal_a_slow_fit(data, monkeypatch, rounds, leaves, least, l2, cells, cut):
    monkeypatch.setattr(trees, "CELLS", cells)
    monkeypatch.setattr(trees, "CUT", cut)
    df, _, y, bins = data
    model = LeafwiseTrees(rounds, leaves, 8, 0.3, l2, least).fit(df, "y", "x")
    margin, splits = slow_fit(bins, y, rounds, leaves, 8, 0.3, l2, least)
    got = {r.id: (r.score, r.prediction) for r in model.transform(df).collect()}
    assert [got[i][0] for i in range(500)] == pytest.approx(list(margin), abs=1e-8)
    assert [sum(f >= 0 for f in t.feature) for t in model.trees[1:]] == [len(s) for s in splits]
    for t, own in zip(model.trees[1:], splits, strict=True):
        assert sorted((f, c) for f, c in zip(t.feature, t.cut, strict=True) if f >= 0) == sorted((j, c) for j, c, _, _ in own)
        assert 4 not in t.feature and 5 not in t.feature  # a repeated feature loses the tie, a constant one has no split


def test_siblings_are_subtracted_not_counted(data, monkeypatch):
    df, _, _, _ = data
    asked = []
    whole = trees.node_histograms
    monkeypatch.setattr(trees, "node_histograms", lambda *a: asked.append(a[-1]) or whole(*a))
    LeafwiseTrees(1, 16, 8, least_rows=10).fit(df, "y", "x")
    assert len(asked) <= 9 and sum(len(a) for a in asked[1:]) <= 30  # a pass a level, not one a split


def test_model_of_named_columns_and_round_trip(data, spark, tmp_path):
    df, _, y, _ = data
    columns = df.select("id", F.when(F.col("y") > 0, "yes").otherwise("no").alias("label"), *[F.col("x")[k].alias(f"c{k}") for k in range(6)])
    model = LeafwiseTrees(5, 8, 8, 0.5).fit(columns, "label", [f"c{k}" for k in range(6)])
    model.save(spark, f"{tmp_path}/m")
    back = TreeModel.load(spark, f"{tmp_path}/m")
    assert back == model
    rows = back.transform(columns).collect()
    right = np.mean([(r.prediction == "yes") == (y[r.id] > 0) for r in rows])
    assert right > 0.75 and {r.prediction for r in rows} == {"yes", "no"}
    for bad in ({"rounds": 0}, {"leaves": 1}, {"n_bins": 1}, {"n_bins": 257}, {"learning_rate": 0}, {"l2": -1}, {"least_rows": 0}):
        with pytest.raises(ValueError):
            LeafwiseTrees(**bad)


def test_rows_that_nothing_splits(spark):
    df = spark.createDataFrame([(k % 2, [1.0, 2.0]) for k in range(30)], "y int, x array<double>")
    model = LeafwiseTrees(2, 4, 8).fit(df, "y", "x")
    assert all(r.score == 0.0 for r in model.transform(df).collect()) and all(len(t.feature) == 1 for t in model.trees)


def test_staged_grid(data, spark):
    df, _, _, _ = data
    out = staged_grid(spark, {"d": (df.where("id < 400"), df.where("id >= 400"))}, "y", "x", [1, 3, 6], [4, 8]).collect()
    assert len(out) == 12 and {(r.n_bins, r.rounds, r.part) for r in out} == {(b, t, p) for b in (4, 8) for t in (1, 3, 6) for p in ("train", "test")}
    assert all(r.m == (400 if r.part == "train" else 100) and 0.4 < r.accuracy <= 1 for r in out)
