import random
import re

import numpy as np
import pytest

from gradarium.llm import ngram_join
from gradarium.llm.ngram_join import drop_near_copies, similarity_components, trie_overlaps


def shingles(text, n):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(docs, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and den * both >= num * (len(a) + len(b) - both):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def corpus(seed, n=160):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(80)]
    prose = lambda k: [r.choice(vocabulary) for _ in range(k)]
    boiler, docs = prose(40), []
    for i in range(n):
        w = prose(r.choice([0, 1, 2, 3, 4, 5, 8, 12, 30, 80, 200]))
        if r.random() < 0.3:
            w += boiler
        if docs and r.random() < 0.7:
            w = list(r.choice(docs)[1])
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                if w:
                    at = r.randrange(len(w))
                    w[at : at + r.choice([0, 1])] = [r.choice(vocabulary).upper()]
        docs.append((9000 - 7 * i, w))
    return [(i, r.choice([" ", "\n", "  \t"]).join(w)) for i, w in docs] + [(3, None), (4, ""), (5, " \n"), (6, "One"), (8, "one")]


@pytest.mark.parametrize(("seed", "n", "num"), [(1, 4, 85), (2, 5, 80), (3, 4, 85)])
def test_equals_brute_force(spark, seed, n, num, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP", 3)
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, label int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity_components(df, n, num).collect()}
    assert got == brute(docs, n, num, 100)


def test_chain_and_nulls(spark):
    w = [f"w{i}" for i in range(60)]
    chain = [(100 - k, " ".join(w[:k] + [f"x{i}" for i in range(k, 60)])) for k in range(60)]
    df = spark.createDataFrame([*chain, (None, "lonely text of some words"), (None, "lonely text of some words"), (1, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    got = similarity_components(df).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id and r.doc_id > 1} == {i: c for i, (_, c) in brute(chain, 4, 85, 100).items()}
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert [r.component_id for r in got if r.doc_id == 1] == [1, 1]
    assert similarity_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_keep_their_links(spark):
    w = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(w)), (1, " ".join(w)), (2, " ".join([*w[:99], "x"])), (2, " ".join([*w[:99], "x"]))]
    got = similarity_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert [(r.n_shingles, r.component_id) for r in got] == [(97, 1)] * 4


def test_one_of_each_group_stays(spark):
    docs = corpus(5)
    df = spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id long, text string, lang string")
    want = {i for i, (_, c) in brute(docs, 5, 80, 100).items() if i == c}
    out = drop_near_copies(df)
    assert {r.doc_id for r in out.collect()} == want and out.columns == ["doc_id", "text", "lang"]


def test_rows_without_id_or_with_one_id_link_by_their_own_text(spark):
    u, v, x = ([f"{c}{i}" for i in range(60)] for c in "uvx")
    near = lambda w: " ".join([*w[:59], "end"])
    t = " ".join
    # 1 and 2 are each near a null-id row, 3 and 4 near a row with id 9; two null-id rows are near each other only
    rows = [(1, t(u)), (2, t(v)), (None, near(u)), (None, near(v)), (None, t(x)), (None, near(x)), (None, t(x))]
    y, z = ([f"{c}{i}" for i in range(60)] for c in "yz")
    rows += [(3, t(y)), (4, t(z)), (9, near(y)), (9, near(z))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.component_id is None else r.component_id) for r in similarity_components(df).collect())
    assert got == [(-1, -1), (-1, -1), (-1, -1), (-1, 1), (-1, 2), (1, 1), (2, 2), (3, 3), (4, 4), (9, 3), (9, 4)]
    left = drop_near_copies(df, 4, 85, 100).collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == [1, 2, 3, 4]
    assert [r.text[:2] for r in left if r.doc_id is None] == ["x0"]


def test_words_that_undo_polynomials_and_words_across_pieces(spark, monkeypatch):
    t = "a"
    while len(t) < 4096:
        t += t.translate(str.maketrans("ab", "ba"))
    docs = [(k, x) for k, x in enumerate([t[:1024], t[1024:2048], t[:2048], t[2048:], t, t.upper(), "b" + t, "a b", "ab"])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in similarity_components(df).collect()} == brute(docs, 4, 85, 100)
    r = random.Random(1)
    texts = ["".join(r.choice("aB é\n") for _ in range(r.randint(0, 400))) for _ in range(40)]
    raw = [x.encode() for x in texts]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    whole = ngram_join.ngram_sets(data, ends, 2)
    for size in (1, 7, 50):
        monkeypatch.setattr(ngram_join, "PIECE", size)
        assert all((a == b).all() for a, b in zip(whole, ngram_join.ngram_sets(data, ends, 2), strict=True))
    assert np.bincount(whole[0], minlength=40).tolist() == [len(shingles(x, 2)) for x in texts]


def test_boilerplate_makes_few_candidates(spark, monkeypatch):
    """Rows that share passages of a pool in ever other choices stand at the same nodes: below them few still meet."""
    r = random.Random(4)
    pool = [[f"p{k}w{i}" for i in range(12)] for k in range(80)]
    docs = [(k, " ".join(w for p in sorted(r.sample(range(80), 5)) for w in pool[p])) for k in range(1500)]
    held = ngram_join.numbered(spark.createDataFrame(docs, "doc_id long, text string"), "t")
    seen, old = [], ngram_join.candidates_below

    def counted(*of):
        out = ngram_join.stored(old(*of).distinct(), "pairs")
        seen.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "candidates_below", counted)
    want = {i: c for i, (_, c) in brute(docs, 4, 85, 100).items()}
    for group in (10**6, 20):
        monkeypatch.setattr(ngram_join, "GROUP", group)
        got = ngram_join._linked(held, 4, 85, 100, "text", "doc_id").collect()
        assert {x.doc_id: x.least.doc_id for x in got} == want
    assert seen[1] <= seen[0] < 1500 * 1499 / 2 / 100


@pytest.mark.parametrize("n_docs", [200, 400])
def test_templates_make_few_candidates(spark, monkeypatch, n_docs):
    """Texts of twelve phrases with two variants each, hardly any of them similar: pairs don't grow with their square."""
    r = random.Random(n_docs)
    phrases = [[" ".join(f"{chr(97 + k)}{v}{r.randint(0, 9**6)}" for _ in range(8)) for v in (0, 1)] for k in range(12)]
    docs = [(i, " ".join(r.choice(p) for p in phrases)) for i in range(n_docs)]
    docs += [(n_docs + i, t[: t.rindex(" ")] + " end") for i, t in docs[:40]]  # a word of each of these is another
    asked = []
    whole = ngram_join.similar_pairs
    monkeypatch.setattr(ngram_join, "similar_pairs", lambda pairs, *a: asked.append(pairs.distinct().count()) or whole(pairs, *a))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in similarity_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs, 4, 85, 100)
    assert sum(asked) <= 20 * len(docs), asked


def test_parity_maps_bound_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (np.unique(rng.integers(-(2**63), 2**63 - 1, int(rng.integers(1, 400)))) for _ in range(2))
        b = np.unique(np.append(b, a[: int(rng.integers(0, len(a) + 1))]))
        x, y = ngram_join.parity_map(a), ngram_join.parity_map(b)
        bits = sum((int(i) ^ int(j)).bit_count() if (int(i) ^ int(j)) >= 0 else ((int(i) ^ int(j)) & (2**64 - 1)).bit_count() for i, j in zip(x, y, strict=True))
        assert len(x) == ngram_join.MAPS and bits <= len(np.setxor1d(a, b))


def test_trie_leaves_whole_subtrees():
    far = np.arange(1000, 1200, dtype=np.int64)
    sets = [(200, np.concatenate([np.arange(k, k + 20), far[20:]]).astype(np.int64)) for k in range(0, 400, 20)]
    trie = ngram_join.Trie(sets)
    assert not trie.similar(np.arange(200, dtype=np.int64), 200, 85, 100).any() and trie.cut == len(sets)
    assert trie.similar(sets[3][1], 200, 85, 100).sum() == sum(len(np.intersect1d(s, sets[3][1])) >= 184 for _, s in sets)


def test_trie_counts_exactly():
    rng = np.random.default_rng(3)
    base = rng.permutation(500)[:200].astype(np.int64)
    sets = []
    for _ in range(80):
        keep = np.sort(rng.permutation(200)[: rng.integers(1, 201)])
        s = base[keep]
        sets.append((len(s) + int(rng.integers(0, 10)), s))
    got = trie_overlaps(base, 210, sets, 85, 100)
    want = [100 * len(s) >= 85 * (210 + n - len(s)) for n, s in sets]
    assert got.tolist() == want


def test_small_tables_are_few_files(spark, monkeypatch):
    import os
    from urllib.parse import urlparse

    from gradarium.llm.common import stored

    files = {}

    def watched(df, name, *rows):
        out = stored(df, name, *rows)
        files.setdefault(name, []).append(len(out.inputFiles()))
        assert all(os.path.exists(urlparse(f).path) for f in out.inputFiles())
        return out

    monkeypatch.setattr(ngram_join, "stored", watched)
    docs = corpus(4, 60)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for (k, _), v in zip(kept.items(), ("40", "false"), strict=True):
            spark.conf.set(k, v)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == brute(docs, 4, 85, 100)
    few = ("able", "pairs", "links", "classes", "edges", "labels", "spread", "nodes", "at_nodes", "labelled", "named", "firsts")
    assert {n: c for n, c in files.items() if n in few and max(c) > spark.sparkContext.defaultParallelism} == {}
    assert {"edges", "labels", "spread", "nodes"} <= set(files)
    monkeypatch.setattr("gradarium.llm.common.FILE_ROWS", 10)
    assert len(stored(spark.range(1000, numPartitions=200), "t", 1000).inputFiles()) == 100


def test_a_task_holds_little_beside_its_texts():
    import tracemalloc

    import pyarrow as pa

    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(5000)]
    made = lambda: pa.array([" ".join(r.choices(words, k=2000)) for _ in range(70)])
    batches = [pa.RecordBatch.from_arrays([pa.array(range(100 * k, 100 * k + 70)), made(), pa.array(["x"] * 70)], ["doc", "text", "doc_id"]) for k in range(15)]
    for run, most in ((ngram_join._exact(5, 50, 8), 60), (ngram_join._signatures(5), 25)):
        tracemalloc.start()
        try:
            sent = sum(b.num_rows for b in run(iter(batches)))
            peak = tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()
        assert sent and peak < most, peak
