import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from gradarium.llm import suffix_dedup
from gradarium.llm.suffix_dedup import LENGTH, StoredFamily, SuffixIndexFamily, decode, encode, remove_repeats


def brute(docs):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256)."""
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - LENGTH + 1):
            w = b[p : p + LENGTH]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - LENGTH + 1):
            if first[b[p : p + LENGTH]] < i:
                gone[p : p + LENGTH] = b"\1" * LENGTH
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def corpus(seed=1, n=150):
    r = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "é", "ñu", "st", " ", ". "]
    prose = lambda k: "".join(r.choice(syllables) for _ in range(k))
    passages = [prose(60) for _ in range(6)]
    docs = []
    for i in range(n):
        t = prose(r.randint(0, 300))
        if r.random() < 0.5:
            p = r.choice(passages)
            a, b = sorted(r.sample(range(len(p)), 2))
            at = r.randint(0, len(t))
            t = t[:at] + p[a:b] + t[at:]
        if docs and r.random() < 0.3:
            t = list(r.choice(docs)[1] or "")
            for _ in range(r.randint(0, 3)):
                if t:
                    t[r.randrange(len(t))] = r.choice("xyz")
            t = "".join(t)
        docs.append((i * 3 - 20, t))
    docs += [(5000, None), (5001, ""), (5002, "a" * 500), (5003, "b" + "a" * 300), (5004, "ab" * 200), (5005, "ab" * 30), (5006, "x" * 49), (5007, "x" * 50), (5008, "x" * 50)]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize(("broadcast_bytes", "hot"), [(1 << 30, 50_000), (0, 3)])
def test_equals_brute_force(spark, broadcast_bytes, hot):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, rows string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, broadcast_bytes=broadcast_bytes, hot=hot).collect()}
    assert got == brute(docs)


def test_empty_table_and_null_ids(spark):
    with pytest.raises(TypeError):
        remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = "q" * 30 + "w" * 40
    rows = remove_repeats(spark.createDataFrame([(None, t), (7, t), (7, t)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in rows) == [(-1, 70), (7, 0), (7, 0)]


def test_rows_without_id_or_with_one_id_are_judged_by_their_own_text(spark):
    r = random.Random(4)
    a, b, c, d = ("".join(r.choice("abcdefgh ") for _ in range(120)) for _ in range(4))
    rows = [(1, a), (None, a + b), (None, c), (None, c), (2**63 - 1, d), (None, d), (5, a), (5, b + "!")]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    # of the two rows with c one stays whole; b of the null-id row is in the smaller document 5
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_bytes, x.n_removed) for x in got) == [(-1, 120, 0), (-1, 120, 120), (-1, 120, 120), (-1, 240, 240), (1, 120, 0), (5, 120, 120), (5, 121, 0), (2**63 - 1, 120, 0)]


def by_bucket(sent, run, of=None):
    table = pa.Table.from_batches(list(sent), suffix_dedup.SENT)
    if of is not None:
        table = table.filter(pc.equal(table["kind"], of))
    return [run(table.filter(pc.equal(table["bucket"], b))) for b in pc.unique(table["bucket"]).to_pylist()]


def in_one_process(docs, hot):
    """remove_repeats without Spark: the same functions, one after the other."""
    S = suffix_dedup
    ids, texts = [i for i, _ in docs], [t for _, t in docs]
    place = lambda x, y: pa.record_batch([pa.array(range(x, y), pa.int64()), pa.array(texts[x:y], pa.string())], ["row", "text"])
    cuts = [0, len(docs) // 3, len(docs) // 2, len(docs)]
    sent = [m for x, y in zip(cuts, cuts[1:], strict=False) for m in S.place_messages(5, 3)(iter([place(x, y)]))]
    shared = [m for t in by_bucket(sent, S.shared_places(3, hot)) for m in t.to_batches()]
    asked = {r["__row"]: r["__spans"] for t in by_bucket(shared, S.asked_by_row, S.ASKED) for r in t.to_pylist()}
    warm = np.concatenate([np.zeros(0, np.int64), *[decode(r["rows"], 1)[0] for m in shared for r in m.to_pylist() if r["kind"] == S.HOT_VALUES]]).view(np.uint64)
    sent = []
    for x, y in zip(cuts, cuts[1:], strict=False):
        own = [k for k in range(x, y) if k in asked]
        batch = pa.record_batch([pa.array([ids[k] for k in own], pa.int64()), pa.array(own, pa.int64()), pa.array([texts[k] for k in own], pa.string()), pa.array([asked[k] for k in own], pa.binary())], ["doc_id", "row", "text", "spans"])
        sent += S.stretch_messages(4, 3, warm)(iter([batch])) if own else []
    found = [m for t in by_bucket(sent, S.merge_scan(3)) for m in t.to_batches()]
    spans = {r["__row"]: r["__spans"] for t in by_bucket(found, S.spans_by_row(S.REMOVED), S.REMOVED) for r in t.to_pylist()}
    out = {}
    for k, (i, t) in enumerate(docs):
        raw = (t or "").encode()
        begin, end = S.removed_bytes(*decode(spans[k], 2), len(raw)) if k in spans else ((), ())
        kept, at = b"", 0
        for a, b in zip(begin, end, strict=True):
            kept, at = kept + raw[at:a], b
        out[i] = (len(raw), int(sum(end) - sum(begin)), len(begin), hashlib.sha256(kept + raw[at:]).hexdigest())
    return out, len(warm)


@pytest.mark.parametrize(("bits", "piece", "hot"), [(64, 1_000_000, 10**6), (3, 1_000_000, 10**6), (64, 130, 10**6), (64, 1_000_000, 2), (4, 200, 5)])
def test_weak_hashes_pieces_and_hot_values_change_nothing(monkeypatch, bits, piece, hot):
    strong = suffix_dedup.fingerprints
    monkeypatch.setattr(suffix_dedup, "fingerprints", lambda *x: strong(*x) & np.uint64((1 << bits) - 1))
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    docs = corpus(3)
    got, n_hot = in_one_process(docs, hot)
    assert got == brute(docs) and (hot > 100 or n_hot)


def test_family_is_geometric_and_finds_every_earlier_suffix():
    r = random.Random(0)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 9))) for _ in range(1000)]
    age = np.sort([r.randrange(200) for _ in texts])
    keys = np.array(texts, "S12")
    family, found = SuffixIndexFamily(), []
    cuts = np.unique(np.searchsorted(age, [0, 20, 30, 70, 71, 120, 200]))
    for a, b in zip(cuts, cuts[1:], strict=False):
        older = len(np.concatenate(found)) if found else 0
        found.append(family.add(keys[a:b], age[a:b]))
        sizes = [len(x) for x in family.levels]
        assert all(x > 2 * y for x, y in zip(sizes, sizes[1:], strict=False)) and all((np.sort(x) == x).all() for x in family.levels)
        for k in range(a, b):  # an older batch may hold it as a prefix, the own one as a whole
            assert found[-1][k - a] == (any(t.startswith(texts[k]) for t in texts[:older]) or any(t == texts[k] for t, x in zip(texts[a:b], age[a:b], strict=True) if x < age[k]))
    a, b = np.array([b"abc", b"abc", b"", b"xy"], "S5"), np.array([b"abd", b"abc", b"a", b"zz"], "S5")
    assert suffix_dedup.common_prefix(a, b).tolist() == [2, 5, 0, 0]


@pytest.mark.parametrize(("many", "broadcast_bytes", "hot"), [(16, 1 << 30, 50_000), (0, 0, 3)])
def test_batches_of_a_stored_family_equal_one_run(spark, tmp_path, monkeypatch, many, broadcast_bytes, hot):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    docs = sorted(corpus(7, 120))
    cuts, got, path = [0, 10, 30, 90, 90, 95, len(docs)], {}, f"file://{tmp_path}/family"
    for a, b in zip(cuts, cuts[1:], strict=False):
        family = StoredFamily(spark, path)  # each batch finds the levels that the one before has stored
        df = spark.createDataFrame(docs[a:b][::-1], "doc_id long, text string").repartition(3)
        got |= {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in family.add_batch(df, broadcast_bytes=broadcast_bytes, hot=hot).collect()}
        sizes = [n for _, n, _ in family.levels]
        assert all(x > 2 * y for x, y in zip(sizes, sizes[1:], strict=False))
        for table, n, _ in family.levels:
            assert n == sum(r.n for r in spark.read.parquet(f"{path}/{table}").select("n").collect() if r.n)
    assert got == brute(docs)
    assert 1 < len(sizes) < 5 and family.version == 5


def test_earlier_batches_are_older_whatever_their_ids(spark):
    r = random.Random(6)
    a, b, c = ("".join(r.choice("abcdefgh ") for _ in range(90)) for _ in range(3))
    family = StoredFamily(spark)
    assert family.add_batch(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    first = family.add_batch(spark.createDataFrame([(9, a), (None, b), (10, None)], "doc_id long, text string")).collect()
    assert sorted(x.n_removed for x in first) == [0, 0, 0]
    rows = [(-(2**63), a), (None, "x" + b), (9, c), (9, c), (None, c), (1, a[:60] + b[30:])]
    got = family.add_batch(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id or 0, x.n_bytes, x.n_removed) for x in got) == [(-(2**63), 90, 90), (0, 90, 90), (0, 91, 90), (1, 120, 120), (9, 90, 0), (9, 90, 0)]
    with pytest.raises(TypeError):
        family.add_batch(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_columns_round_trip():
    a = np.sort(np.random.default_rng(1).integers(-(2**62), 2**62, 1000))
    b = np.arange(1000) % 7
    for x, y in zip(decode(encode(a, b), 2), (a, b), strict=True):
        assert (x == y).all()
    assert [len(x) for x in decode(encode(a[:0], b[:0]), 2)] == [0, 0]
    assert suffix_dedup.LENGTH == 50
