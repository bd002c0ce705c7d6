"""Search, hard negatives and whitening against brute force in whole numbers."""

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradarium.llm import hard_negatives, topk_search, vectors, whitening
from gradarium.llm.queries import op13_whitening

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, row string, v int, norm string, cell string, kind double, score string, rank int"


def table(spark, rows, parts=3):
    """Rows (vec_id, vector, label) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, x, c, "r", 1, "n", "c", 0.5, "s", 9) for i, x, c in rows], SCHEMA).repartition(parts)


def rows_of(seed, n=400, width=6, lengths=(0.2, 1.0, 3.0)):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, width)) * rng.choice(lengths, (n, 1))).astype(np.float32)
    x[50:60] = x[50]  # repeated vectors tie
    x[60:64] = 0
    out = [(i, [float(v) for v in r], int(rng.integers(0, 3))) for i, r in enumerate(x)]
    odd = [(1000, None, 1), (1001, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (1050, [NAN] * width, 1), (1100, [INF] + [0.0] * (width - 1), 2), (1150, [1.0, 2.0], 1), (1200, [], 0), (None, [1.0] * width, 1), (None, [1.0] * width, 2), (50, [0.5] * width, 0), (1250, [0.25] * width, None)]
    return out + odd


def whole(rows):
    """(place, id, integers, label) of those that take part; shorter ones end in zeros."""
    width = max((len(x) for _, x, _ in rows if x is not None), default=0)
    good = [(i, x, c) for i, x, c in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    return [(k, i, [math.floor(256 * float(np.float32(v))) for v in x] + [0] * (width - len(x)), c) for k, (i, x, c) in enumerate(good)]


def order(r):
    return (-r[0], r[1] is None, r[1] or 0)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def slow_search(rows, k=5, each=50):
    held, out = whole(rows), []
    for p, i, x, _ in held:
        if i is not None and i % each == 0:
            best = sorted(((dot(x, y), j) for q, j, y, _ in held if q != p), key=order)[:k]
            out += [(i, n + 1, j, s) for n, (s, j) in enumerate(best)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "limits"), [(0, {}), (1, {"COMPONENTS": 120, "RUN": 7, "BLOCK": 3}), (2, {"COMPONENTS": 600, "RUN": 16, "SHARE": 0.9, "MARKS": 2})])
def test_search_equals_brute_force(spark, monkeypatch, seed, limits):
    for name, value in limits.items():
        monkeypatch.setattr(topk_search, name, value)
    if seed:
        monkeypatch.setattr(vectors, "CHUNK", 3)
    rows = rows_of(seed)
    got = topk_search.top_products(table(spark, rows), F.col("vec_id") % 50 == 0).select("query_id", "rank", "id", "score").collect()
    assert sorted(map(tuple, got), key=str) == slow_search(rows)


def test_search_of_few_rows(spark):
    few = [(0, [1.0, 0.0], 0), (50, [0.5, 0.5], 0), (7, [-1.0, 0.0], 1)]
    for rows in ([], few[:1], few, [(0, None, 0)], [(0, [], 0), (50, [], 1)]):
        got = topk_search.top_products(table(spark, rows, 1), F.col("vec_id") % 50 == 0).select("query_id", "rank", "id", "score").collect()
        assert sorted(map(tuple, got), key=str) == slow_search(rows)
    with pytest.raises(Exception, match="2\\^31"):
        topk_search.top_products(table(spark, [(0, [1e30], 0)], 1), F.lit(True)).collect()


def test_buckets_prune_by_length_and_by_coordinates():
    rng = np.random.default_rng(5)
    x = rng.integers(-256, 257, (3000, 8))
    x[:1000] *= 20
    norm = np.sqrt((x.astype(float) ** 2).sum(1))
    order_ = np.argsort(-norm)
    run = topk_search.Run(x[order_[:2048]], norm[order_[:2048]])
    unit = run.x / run.norm[:, None]
    for i in (0, 5, 2000):
        for cosine in (0.3, 0.8, 0.97):
            near = set(run.near(unit[i], cosine).tolist())
            assert set(np.flatnonzero(unit @ unit[i] >= cosine).tolist()) <= near
    assert len(run.near(unit[3], 0.97)) < 200  # coordinates leave few at a high threshold
    assert run.tuned(unit[:16], np.full(16, 0.97)) <= 0.97 < run.tuned(unit[:16], np.full(16, 0.1))


@pytest.mark.parametrize("share", [0.0, 0.3, 2.0])
def test_a_bucket_alone_equals_brute_force(monkeypatch, share):
    """With runs of a few rows and any mixture of the two ways to prune; tasks have the module's own settings."""
    monkeypatch.setattr(topk_search, "RUN", 40)
    monkeypatch.setattr(topk_search, "SHARE", share)
    rng = np.random.default_rng(int(share * 10))
    for width, n in ((3, 500), (8, 300), (1, 90), (4, 3)):
        x = rng.integers(-200, 201, (n, width)) // rng.choice([1, 3, 50], (n, 1))
        x[: n // 4] = x[0]
        ids = rng.permutation(n)
        norm = np.sqrt((x.astype(float) ** 2).sum(1))
        rows = pa.table({"row": np.arange(n), "id": ids, "norm": norm, "v": vectors.packed(x)})
        bucket = topk_search.Bucket(rows, width)
        q, own = x[::3], np.arange(n)[::3]
        for start in (-math.inf, float(np.median(x @ x.T)), 1.0):
            of, place, score = bucket.search(q, norm[::3], own, np.full(len(q), start), 5)
            got = sorted((int(i), -int(s), int(bucket.ids[p])) for i, p, s in zip(of, place, score, strict=True))
            want = [(i, *r) for i in range(len(q)) for r in sorted((-int(s), int(j)) for c, (s, j) in enumerate(zip(x @ q[i], ids, strict=True)) if c != own[i] and s >= start)[:5]]
            assert got == sorted(want)


def slow_negatives(rows, k=5, n_positives=5, low=80, high=100, each=100):
    held = [(p, i, x, (c + 1) % 10 if i is not None and i % 7 == 0 else c) for p, i, x, c in whole(rows) if c is not None]
    out = []
    for p, i, x, c in held:
        if i is None or i % each:
            continue
        scored = sorted(((dot(x, y), j, d) for q, j, y, d in held if q != p), key=order)
        for ps, pos, _ in [s for s in scored if s[2] == c][:n_positives]:
            fine = [s for s in scored if s[2] != c and low * ps <= 100 * s[0] <= high * ps][:k]
            out += [(i, pos, n + 1, neg, ps, ns) for n, (ns, neg, _) in enumerate(fine)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "limits", "window"), [(0, {}, (80, 100)), (3, {"COMPONENTS": 200, "VISIT": 1, "CENTROIDS": 5, "SAMPLE_ROWS": 30}, (80, 100)), (4, {"VISIT": 20, "GROUPS": 2}, (33, 95))])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, seed, limits, window):
    for name, value in limits.items():
        monkeypatch.setattr(hard_negatives, name, value)
    if seed:
        monkeypatch.setattr(vectors, "CHUNK", 2)
    rows = rows_of(seed)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0, label, low=window[0], high=window[1])
    got = got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    want = slow_negatives(rows, low=window[0], high=window[1])
    assert sorted(map(tuple, got), key=str) == want and len(want) > 20


def test_hard_negatives_of_few_rows(spark):
    few = [(0, [1.0, 0.0], 0), (100, [0.5, 0.5], 0), (3, [0.5, 0.25], 1), (4, [-1.0, 0.0], 0)]
    for rows in ([], few[:1], few, [(0, None, 0)], [(0, [1.0], None)], [(0, [], 0), (100, [], 0), (5, [], 1)], [(0, [2.0], 0), (100, [1.0], 0), (5, [1.5], 3)]):
        got = hard_negatives.hard_negatives(table(spark, rows, 1), F.col("vec_id") % 100 == 0, F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
        got = got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
        assert sorted(map(tuple, got), key=str) == slow_negatives(rows)


def test_heap_visits_all_cells_by_falling_bound():
    rng = np.random.default_rng(2)
    one, two = rng.integers(0, 9, 7).astype(float), rng.integers(0, 9, 5).astype(float)
    seen = list(hard_negatives.multi_sequence(one, two))
    assert sorted((i, j) for _, i, j in seen) == [(i, j) for i in range(7) for j in range(5)]
    assert all(a[0] >= b[0] for a, b in zip(seen, seen[1:], strict=False)) and all(s == one[i] + two[j] for s, i, j in seen)


def test_half_bounds_hold_and_certify():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 300
    x = np.rint(centres[rng.integers(0, 12, 2000)] + rng.normal(size=(2000, 8)) * 10).astype(np.int32)
    books = [hard_negatives.codebook(x[:, :4], 16), hard_negatives.codebook(x[:, 4:], 16)]
    halves, cells = [], []
    for (c, group), part in zip(books, (x[:, :4], x[:, 4:]), strict=True):
        near, far = hard_negatives.nearest(part.astype(float), c)
        radius = np.full(len(c), -1.0)
        np.maximum.at(radius, near, far)
        halves.append((c, radius, group))
        cells.append(near)
    q = x[:5]
    s1, s2 = hard_negatives.half_bounds(q, halves)
    bound, score = s1[:, cells[0]] + s2[:, cells[1]], q.astype(float) @ x.T
    assert (bound >= score).all()
    best = np.sort(score, 1)[:, -5]
    assert (np.count_nonzero(bound >= best[:, None], 1) < 1000).all()  # clustered halves leave most rows unseen


def exact_covariance(x):
    n, width = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(width)]
    return n, sums, [[Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n**3) for j in range(width)] for i in range(width)]


def test_whitening_equals_a_plain_solution(spark):
    rows = rows_of(6, n=300, lengths=(0.2, 0.3))
    held = whole(rows)
    ints = [[math.floor(1024 * float(np.float32(v))) + 100_000 for v in [*x, *[0.0] * (6 - len(x))]] for _, x, _ in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    n, sums, cov = exact_covariance(ints)
    assert len(held) == n
    got = whitening.whiten(table(spark, rows), {"vec_id": F.col("vec_id")}).collect()
    assert len(got) == n * 6 and {r.component for r in got} == set(range(1, 7)) and {r.n for r in got} == {n}
    values, vectors_ = np.linalg.eigh(np.array([[float(v) for v in r] for r in cov]))
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    deviation = defaultdict(list)
    for (i, _, _), x in zip([r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])], ints, strict=True):
        deviation[i].append((sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), x))
    trace = sum(cov[d][d] for d in range(6))
    for r in got:
        assert r.deviation in [d for d, _ in deviation[r.vec_id]] and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / float(trace), rel=1e-9)
        near = [abs((np.array(x) - np.array(sums) / n) @ vectors_[:, r.component - 1] / math.sqrt(values[r.component - 1])) for d, x in deviation[r.vec_id] if d == r.deviation]
        assert any(abs(r.whitened) == pytest.approx(v, rel=1e-6, abs=1e-7) for v in near)
    again = whitening.whiten(table(spark, rows, 7), {"vec_id": F.col("vec_id")}).collect()
    assert sorted((r.vec_id or -1, r.component, r.deviation, round(r.whitened, 9)) for r in got) == sorted((r.vec_id or -1, r.component, r.deviation, round(r.whitened, 9)) for r in again)


def test_whitening_of_odd_tables(spark):
    run = lambda rows: whitening.whiten(table(spark, rows, 1), {"vec_id": F.col("vec_id"), "label": F.col("label")}).collect()
    assert run([]) == [] == run([(1, None, 1)]) == run([(1, [], 1), (2, [], 1)]) == run([(1, [NAN], 0)])
    one = run([(1, [0.5, 0.25], 1)])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = run([(1, [0.5, 1.0], 1), (2, [0.5, 0.0], 1), (2, [0.5, 0.0], None)])
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)} and all(r.identity_error < 1e-12 for r in flat)
    assert {(r.component, r.explained) for r in flat} == {(1, 1.0), (2, 0.0)}
    far = run([(1, [1000.0, 0.0], 1), (2, [-1000.0, 0.5], 1)])
    assert {r.n for r in far} == {2} and all(r.deviation == 2048000**2 + 512**2 for r in far)


@pytest.mark.parametrize("spread", [1e-3, 1e-9, 1e-13, 0.0])
def test_refinement_of_clustered_eigenvalues(spread):
    rng, wide = np.random.default_rng(1), whitening.WIDE
    n = 40
    values = np.array([3.0 + spread * k for k in range(5)] + [1.0 + spread * k for k in range(5)] + list(rng.random(n - 12)) + [0.0, 0.0], wide)
    q = np.linalg.qr(rng.normal(size=(n, n)))[0].astype(wide)
    for _ in range(3):
        q = whitening.times(q, 1.5 * np.eye(n, dtype=wide) - whitening.times(q.T, q) / 2)
    a = whitening.times(q * values, q.T.copy())
    a = (a + a.T) / 2
    found, x = whitening.eigen(a)
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-16
    assert np.abs(whitening.times(x.T, x) - np.eye(n)).max() < 1e-16 and np.abs(whitening.times(a, x) - x * found).max() < 1e-16
    if spread >= 1e-9:  # told apart: each vector is the one that was planted
        order_ = np.argsort(-values)
        assert all(abs(abs(float(q[:, o] @ x[:, k])) - 1) < 1e-15 for k, o in enumerate(order_[:10]))


def test_sliced_products_are_exact_to_the_higher_precision():
    rng = np.random.default_rng(2)
    a, b = (rng.normal(size=(30, 30)).astype(whitening.WIDE) * 2.0 ** rng.integers(-8, 8, (30, 30)) for _ in range(2))
    a[3] = 0
    exact = np.array([[sum(Fraction(*map(int, v.as_integer_ratio())) * Fraction(*map(int, w.as_integer_ratio())) for v, w in zip(r, c, strict=True)) for c in b.T] for r in a])
    got = whitening.times(a, b)
    size = float(np.abs(a).max() * np.abs(b).max()) * 30
    assert max(abs(float(Fraction(*map(int, g.as_integer_ratio())) - e)) for g, e in zip(got.ravel(), exact.ravel(), strict=True)) < 1e-18 * size


def test_query_on_given_vectors(spark):
    rows = op13_whitening(spark, "/root/testdata/sf0.001").collect()
    assert {r.component for r in rows} == set(range(1, 9)) and len(rows) == 8 * rows[0].n
    assert max(r.identity_error for r in rows) < 1e-6
