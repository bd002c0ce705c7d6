"""Operators that DataFrames, SQL or small brute-force versions describe."""

import hashlib
import html
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradarium.llm import exact_dedup, html_extract, langid, mixing, packing, quality, sharding, url_filter
from gradarium.llm.dom import Page, decode
from gradarium.llm.gru import ByteGRU
from gradarium.llm.page_templates import Maker
from gradarium.llm.quotient_filter import CountingQuotientFilter

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=0, n=200):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 8))) for _ in range(60)]
    out = []
    for i in range(n):
        if out and r.random() < 0.4:
            t = out[r.randrange(len(out))][1]
        else:
            t = r.choice([" ", "\n", "  \t"]).join(r.choice(words) for _ in range(r.choice([0, 1, 3, 60, 400])))
        out.append((i, t, r.choice(["en", "fr", None]), r.choice(["hot", "hot", "hot", "a", "b", "ü", "", None]), len(t or "")))
    out += [(900, None, None, None, None), (901, "", "en", "a", 0), (902, " \n ", "en", "a", 3), (903, "x " * 5000, "en", "hot", 1), (7, out[7][1], *out[7][2:])]
    r.shuffle(out)
    return out


# ---- 1 ----


def test_exact_dedup(spark):
    rows = [*corpus(), (None, "only", None, None, None), (None, "only", None, None, None)]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], EMPTY + ", kept int, n int").repartition(4)
    for limit in (10**6, 0):
        out = exact_dedup.exact_dedup(df, broadcast_rows=limit)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n", "keep_id", "group_size", "kept", "text_sha256"]
        for r in out.collect():
            g = groups[norm(r.text)]
            least = min((i for i in g if i is not None), default=None)
            assert (r.keep_id, r.group_size) == (least, len(g)) and (not r.kept or r.doc_id == least)
            assert r.text_sha256 == hashlib.sha256(norm(r.text).encode()).hexdigest()
        assert out.count() == len(rows) and out.where("kept").count() == len(groups)
    stays = exact_dedup.drop_exact_copies(df)
    assert stays.columns == df.columns and stays.count() == len(groups) and {r.doc_id for r in stays.collect()} == {min((i for i in g if i is not None), default=None) for g in groups.values()}
    assert exact_dedup.exact_dedup(spark.createDataFrame([], EMPTY)).count() == 0


@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 20), max_size=60), min_size=1, max_size=5), st.integers(20, 64))
@settings(max_examples=60, deadline=None)
def test_quotient_filters_merge_without_loss(parts, bits):
    parts = [[v & ((1 << bits) - 1) for v in p] for p in parts]
    filters = [CountingQuotientFilter.from_bytes(CountingQuotientFilter.of(np.array(p, np.uint64), bits).to_bytes()) for p in parts]
    merged = CountingQuotientFilter.from_bytes(CountingQuotientFilter.merged(filters).to_bytes())
    assert dict(zip(merged.values.tolist(), merged.counts.tolist(), strict=True)) == Counter(v for p in parts for v in p)


# ---- 3 ----


def test_main_text_of_new_pages(spark):
    maker, want = Maker(4321), {}
    rows = []
    for i in range(80):
        h = maker.page()
        _, label, page = html_extract.labelled_page(h)
        want[i] = html_extract.page_text(page, label > 0)
        rows.append((i, f"http://x/{i}", re.sub(r' data-main="."', "", h), "old"))
    df = spark.createDataFrame([*rows, (500, None, None, None), (501, "u", "", "")], "page_id long, url string, html string, text string").repartition(3)
    got = {r.page_id: r for r in html_extract.main_text(df).collect()}
    assert sum(got[i].text == want[i] for i in want) >= 0.9 * len(want)
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[500].text == got[501].text == ""
    assert html_extract.main_text(df.where("page_id < 0")).count() == 0


def test_pages_of_odd_form():
    trees = html_extract.trained()
    page = '<html><body><nav><a href=x>Home</a></nav><script>a("</p>")</script><article><h1>T &amp; U</h1><p>One <b>two</b>three.<br>Four\n five.<p>Six &lt;7&gt; and some more words, to be sure.<!-- no --></article><footer>&copy; all rights</footer>'
    assert html_extract.extract([page], trees) == ["T & U One twothree. Four five. Six <7> and some more words, to be sure."]
    assert html_extract.extract(["just text, no markup", "<p>a<p>b", "a < b and <", "<div><div>" * 300, '<p title="x>y">z</p>'], trees)[0] == "just text, no markup"


def test_given_pages_against_a_plain_reading():
    """The pages of the test data hold one article each: its text by regular expressions and the html module."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    told = [h for h in pages if h and len(re.findall(r"<article[ >]", h)) == 1]
    want = []
    for h in told:
        body = re.search(r"<article[^>]*>(.*)</article>", h, re.S)[1]
        body = re.sub(r"<!--.*?-->", "", body, flags=re.S)
        blocks = re.split(r"</?(?:p|h[1-6]|div|br|ul|li|blockquote)(?: [^>]*)?>", body)
        want.append(" ".join(" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)) for b in blocks).split()))
    got = html_extract.extract(told, html_extract.trained())
    assert len(told) > 100 and sum(a == b for a, b in zip(got, want, strict=True)) >= 0.99 * len(told)


def test_time_grows_with_the_page_alone():
    trees = html_extract.trained()
    for page in ("<center>" * 60_000 + "x", "<div><p>" + "<center>" * 60_000 + "x", "<ul><li>" + "<dl>" * 20_000 + "<li>x", "<a <b " * 100_000, '<a title="x ' * 50_000, "<table>" * 20_000 + "<td>" * 20_000, "word " * 200_000, "<!" * 100_000):
        began = time.perf_counter()
        html_extract.extract([page], trees)
        assert time.perf_counter() - began < 20, page[:20]
    assert html_extract.extract(["<article><p>One two three four five.</p><script src=/a/>var secret=1;</script><p>Six seven eight.</p></article>"], trees) == ["One two three four five. Six seven eight."]


def test_time_of_odd_repeats_is_linear():
    rng = random.Random(3)
    odd = ["<!", "<!-", "<!--", "<![", "<?", "<a", "<a ", '<a "', "<a '", "</", "</a", "<a>", "<!-->", '"', "'<", "<a/", "<!--<!", "<script", "</script", "<p>", "</p>", "<a x='"] + ["".join(rng.choice("<!-[?>\"' a/") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    for x in odd:
        for end in ("", ">"):
            took = []
            for n in (50_000, 100_000):
                page, began = (x * n)[:n] + end, time.process_time()
                Page(page)
                took.append(time.process_time() - began)
            assert took[1] < 3 * took[0] + 0.5, (x, end, took)


def test_nothing_is_kept_below_a_dropped_node():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        parent = [-1, *[int(rng.integers(0, k)) for k in range(1, n)]]
        margin, own = rng.normal(size=n) * 3, rng.integers(0, 200, n).astype(float)
        kept = decode(parent, own, margin)
        assert kept[0] and all(kept[parent[k]] for k in range(1, n) if kept[k])
        if n <= 10:
            score = lambda c: sum((-np.logaddexp(0, -margin[k]) if c[k] else -np.logaddexp(0, margin[k])) * (1 + own[k] / 40) for k in range(n))
            fits = [c for m in range(2**n) if (c := [m >> k & 1 for k in range(n)])[0] and all(c[parent[k]] or not c[k] for k in range(1, n))]
            assert score(kept) == pytest.approx(max(map(score, fits)))
    assert Page("").text == [0]


# ---- 4 ----


def test_packing_is_an_exact_round_trip(spark):
    r = random.Random(1)
    rows = [(i, t, *_) for i, t, *_ in corpus(3)] + [(1000, "word " * 3000, None, None, None), (1001, "日本語 テスト é ½ ² \x1c\x85\xa0 it's  we'll\n\n x", None, None, None), (1002, "<|endoftext|> a", None, None, None)]
    df = spark.createDataFrame(rows, EMPTY).repartition(4)
    got = packing.pack(df, TOKENIZER).collect()
    as_text = packing.pack(df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), TOKENIZER)
    assert as_text.schema["doc_id"].dataType.simpleString() == "string" and as_text.where("doc_id is null").count() == 0
    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = Counter()
    by_doc = {}
    for i, t, *_ in rows:
        by_doc[i] = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        ids[i] += 1
    pieces, places = {}, {}
    for p in got:
        own = np.array(by_doc[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()
        assert p.length <= 1024 and zlib.crc32(own) == p.ids_crc32
        pieces.setdefault(p.doc_id, []).append((p.piece, p.start, p.length))
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert pieces.keys() == by_doc.keys()
    for i, ps in pieces.items():
        n, want = len(by_doc[i]), []
        first = n if n <= 1024 else n % 1024 or 1024
        want = [(0, 0, first), *[(k, first + (k - 1) * 1024, 1024) for k in range(1, 1 + (n - first) // 1024)]]
        assert sorted(ps) == sorted(want * ids[i])
    for ps in places.values():
        at = 0
        for offset, n in sorted(ps):
            assert offset == at
            at += n
        assert at <= 1024
    total = sum(len(v) * ids[i] for i, v in by_doc.items())
    assert len(places) <= 1.05 * -(-total // 1024) + 1
    assert packing.pack(spark.createDataFrame([], EMPTY), TOKENIZER).count() == 0 and r


def test_added_tokens_keep_their_ids_in_query_and_pipeline(spark, tmp_path):
    import corpus_pipeline
    from gradarium.llm.queries import QUERIES

    end = "<|endoftext|>"
    texts = [end, f"a{end}b  {end}\n{end}{end} it's", f"日本 {end} テスト", "<|endoftext |> <|endoftext|", "plain text", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    want = {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids.items()}
    assert ids[0] == [50256, 2]
    for out in (QUERIES["op4_best_fit_packing"](spark, str(tmp_path)), corpus_pipeline.pack_sequences(spark, df, "")):
        assert {r.doc_id: (r.length, r.ids_crc32) for r in out.collect()} == want


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_ids_are_those_of_the_tokenizer(text):
    if not hasattr(test_ids_are_those_of_the_tokenizer, "pair"):
        t = Tokenizer.from_file(TOKENIZER)
        test_ids_are_those_of_the_tokenizer.pair = (t, packing.encoder(TOKENIZER))
    t, encode = test_ids_are_those_of_the_tokenizer.pair
    for x in (text, "".join(chr(ord(c) % 256) for c in text)):
        assert np.frombuffer(encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 1023), max_size=300))
@settings(max_examples=60, deadline=None)
def test_plan_holds_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=1025)
    steps, used = packing.plan(counts), {}
    for k, (n, rank, base, offset) in enumerate(steps.tolist()):
        end = steps[k + 1][1] if k + 1 < len(steps) and steps[k + 1][0] == n else counts[n]
        for i in range(end - rank):
            used.setdefault(base + i, []).append((offset, n))
    assert Counter(n for u in used.values() for _, n in u) == Counter(lengths)
    for u in used.values():
        at = 0
        for offset, n in sorted(u):
            assert offset == at
            at += n
        assert at <= 1024
    if lengths:
        assert len(used) <= 11 / 9 * -(-sum(lengths) // 1024) * 2 + 1


# ---- 5 ----


def waterfill(sizes, weights):
    share, open_ = 1.5 * sum(sizes.values()), dict(weights)
    target = {}
    while open_:
        unit = (share - sum(target.values())) / sum(open_.values())
        above = [s for s, w in open_.items() if w * unit >= 2 * sizes[s]]
        if not above:
            return target | {s: w * unit for s, w in open_.items()}
        for s in above:
            target[s] = 2.0 * sizes[s]
            del open_[s]
    return target


def test_mix(spark):
    rows = corpus(5, 900)
    df = spark.createDataFrame([(*r, 5) for r in rows], EMPTY + ", size int").repartition(4)
    out = mixing.mix_sources(df).collect()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    ordered = sorted((s for s in sizes if s is not None)) + [None]
    target = waterfill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(ordered)})
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for s, t in target.items():
        biggest = max((r.size for r in out if r.source == s), default=0)
        assert abs(taken[s] - t) <= 0.05 * t + 2 * biggest
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in out)
    assert sum(r.copies for r in out) == mixing.mixed_documents(df).count() and mixing.mixed_documents(df).columns == df.columns
    assert mixing.mix_sources(spark.createDataFrame([], EMPTY)).count() == 0
    assert [r.taken for r in mixing.mix_sources(spark.createDataFrame([(1, None, None, None, None)], EMPTY)).collect()] == [0]


# ---- 7 ----


def test_quality_counts(spark):
    rows = corpus(6) + [(2000, "a b c a b c\n" * 3 + "x # $ <>\n \n", "en", "a", 0), (2001, "w1 w2 w3 w4 " * 30, "en", "a", 0)]
    out = quality.quality(spark.createDataFrame([(*r, "n") for r in rows], EMPTY + ", n_words string").repartition(3)).collect()
    assert len(out) == len(rows)
    for r in out:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeat = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(repeat))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeat) > 50 * len(w)) and not (r.base_failed and r.kept)
    kept = sorted((r.doc_id for r in out if r.kept))
    assert kept == sorted(r.doc_id for r in quality.keep_good(spark.createDataFrame(rows, EMPTY)).collect())
    assert quality.quality(spark.createDataFrame([], EMPTY)).count() == 0


def test_rules_are_ordered_by_rejection_per_cost_of_what_is_left(spark):
    r = random.Random(3)
    for _ in range(30):
        n = r.randint(1, 5)
        texts = [tuple(r.random() < 0.3 for _ in range(n)) for _ in range(50)]
        costs = [r.choice([0.1, 0.2, 1.0]) for _ in range(n)]
        order = quality.rule_order(Counter(texts), costs)
        assert sorted(k for k, _ in order) == list(range(n))
        for place, (k, hits) in enumerate(order):
            left = [t for t in texts if not any(t[j] for j, _ in order[:place])]
            gain = {j: sum(t[j] for t in left) / costs[j] for j, _ in order[place:]}
            assert hits == sum(t[k] for t in left) and gain[k] == max(gain.values())
    order = quality.ordered_rules(spark.createDataFrame(corpus(6), EMPTY))
    assert {x.name for x, _, _ in order} == {x.name for x in quality.RULES} and all(c > 0 for _, c, _ in order)
    assert len(quality.ordered_rules(spark.createDataFrame([], EMPTY))) == len(quality.RULES)
    known = quality.ordered_rules(spark.createDataFrame(corpus(6), EMPTY), known=True)
    assert {x.name for x, _, _ in known} == {x.name for x in quality.RULES}
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    seen = [int(r.t[1:]) for r in quality.sampled(many, "text", 500).collect()]
    assert 300 < len(seen) < 700 and max(seen) > 18_000 and min(seen) < 2000  # from all of the table


# ---- 8 ----


def test_gradients():
    rng, net = np.random.default_rng(0), ByteGRU(3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 256, (5, 6)).astype(np.uint8), rng.integers(0, 3, 5)
    _, g = net.gradients(x, y)
    for name, v in net.p.items():
        at = tuple(int(rng.integers(0, n)) for n in v.shape) if name != "E" else (1, int(x[2, 3]), 5)
        old, e = v[at], 1e-3
        v[at] = old + e
        up = net.gradients(x, y)[0]
        v[at] = old - e
        down = net.gradients(x, y)[0]
        v[at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * e), abs=2e-3)


def slow_probabilities(net, data):
    """One byte after the other, in plain loops over the definition."""
    k, p = net.hidden, net.p
    states = []
    for d, row in ((0, data), (1, data[::-1])):
        h, own = np.zeros(k), []
        for b in row:
            e = p["E"][d][b].astype(float)
            zr = 1 / (1 + np.exp(-(e[: 2 * k] + h @ p["U"][d])))
            c = np.tanh(e[2 * k :] + (zr[k:] * h) @ p["V"][d])
            h = zr[:k] * h + (1 - zr[:k]) * c
            own.append(h)
        states.append(own if d == 0 else own[::-1])
    logits = np.concatenate([np.array(states[0]), np.array(states[1])], 1) @ p["W"] + p["b"]
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def slow_document(net, data):
    """Windows of the definition, each with what surrounds it, one after the other."""
    own = []
    for s in range(0, len(data), langid.WINDOW):
        a, e = max(0, s - langid.CONTEXT), min(len(data), s + langid.WINDOW)
        own.append(slow_probabilities(net, data[a : e + langid.CONTEXT])[s - a : e - a])
    return np.concatenate(own).mean(0)


def test_every_byte_is_labelled_as_by_a_slow_pass():
    r = random.Random(2)
    texts = [("aa", "ka lo mi ren " * 20), ("bb", "sch ung ver ü " * 20)]
    model = langid.train(texts)
    docs = ["k", "ka lo 12 !!", "ver ü " * 100, "x" * 1024, "".join(r.choice(["ka lo ", "ung ü ", "7"]) for _ in range(900)), "ka " * 3000]
    langs, scores = langid.score_texts(pa.array([*docs, None, "", "12 !"]), model)
    assert langs[-3:] == ["und"] * 3
    for t, lang, score in zip(docs, langs, scores, strict=False):
        want = slow_document(model.network, t.encode())
        assert score == pytest.approx(want.max(), abs=1e-5) and lang == model.languages[int(want.argmax())]
    whole = slow_probabilities(model.network, docs[-1].encode()).mean(0)  # one language: windows and an unbroken pass agree
    assert scores[5] == pytest.approx(whole.max(), abs=2e-3)


def test_language_id(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 150)
    r = random.Random(3)
    syllables = {"aa": "ka lo mi ren".split(), "bb": "sch ung ver ü".split()}
    rows = [(i, " ".join("".join(r.choices(syllables[k], k=r.randint(1, 4))) for _ in range(r.randint(3, 80))), k) for i in range(300) for k in [r.choice(["aa", "bb"])]]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 !! —", "bb"), (903, "ka" * 500, None)]
    df = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, lang string, score double").repartition(3)
    got = {x.doc_id: x for x in langid.identify(df).collect()}
    assert len(got) == len(rows)
    for i, t, lang in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1
        if i >= 900 and i != 903:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    held = [x for x in got.values() if x.held_out and x.doc_id < 900]
    assert sum(x.lang_pred == x.lang for x in held) >= 0.95 * len(held)
    assert langid.identify(df.where("doc_id < 0")).count() == 0


def test_training_reads_anywhere_in_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 50)
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 4)
    text = {"aa": "".join(f"{k:05d}," for k in range(4000)), "bb": "b" * 10}
    rows = [(i, text[k], k) for i in range(40) for k in text] + [(50, None, "aa"), (51, "x", None), (52, "", "bb")]
    drawn = langid.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", "doc_id")
    own = [t for lang, t in drawn if lang == "aa"]
    assert len(own) >= 50 * langid.ROWS // 2 and all(len(t) == langid.LENGTH for t in own)
    at = [text["aa"].index(t) for t in own]
    assert min(at) < 1500 and max(at) > 22_000 and len({a // 2400 for a in at}) == 10
    assert {t for lang, t in drawn if lang == "bb"} == {"b" * 10}


def test_windows_of_the_given_long_texts(spark, monkeypatch):
    """Windows against one unbroken pass over texts of 1.5 to 60 kB: the same languages, the same scores."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(langid.training_sample(docs, "text", "lang", "doc_id"))
    length = F.octet_length("text")
    texts = [r.text for lo, hi, n in ((1500, 4000, 20), (4000, 12_000, 10), (12_000, 60_000, 4)) for r in docs.where((length > lo) & (length <= hi)).orderBy(F.xxhash64("text")).limit(n).collect()]
    windows = langid.score_texts(pa.array(texts), model)
    monkeypatch.setattr(langid, "WINDOW", 10**9)
    whole = langid.score_texts(pa.array(texts), model)
    assert len(texts) >= 24 and windows[0] == whole[0]
    assert max(abs(a - b) for a, b in zip(windows[1], whole[1], strict=True)) < 2e-3


# ---- 9 ----


def test_sharding(spark):
    rows = corpus(8, 500)
    for n, parts in ((40, 5), (7, 1), (600, 3)):
        df = spark.createDataFrame(rows, EMPTY).repartition(parts)
        out = sharding.shard(sharding.measured(df), n).collect()
        assert len(out) == len(rows)
        sizes = Counter(r.shard for r in out)
        assert max(sizes.values()) - min([*sizes.values(), 0 if len(sizes) < n else len(rows)]) <= 1 and set(sizes) <= set(range(n))
        for s, c in sizes.items():
            assert sorted(r.slot for r in out if r.shard == s) == list(range(c))
        for r in out:
            b = (r.text or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 16, zlib.crc32(b), "rows", None)
    assert sharding.shard(sharding.measured(spark.createDataFrame([], EMPTY))).count() == 0


@pytest.mark.parametrize(("n", "most"), [(7, 500_000), (40, 500_000), (5, 20)])
def test_sharding_equals_a_slow_shuffle(spark, tmp_path, monkeypatch, n, most):
    """The same hashes, drawn and permuted row by row: of the partitions in turn as many rows as the matrix says go to each
    shard in the order of a hash, and each shard is ordered by a second one."""
    monkeypatch.setattr(sharding, "n_slices", lambda rows, groups: max(1, -(-rows // (groups * most))))
    rows = [(i, t, k) for k, (i, t, *_) in enumerate(corpus(8, 300))]
    spark.createDataFrame(rows, "doc_id long, text string, k long").repartition(3).write.parquet(f"{tmp_path}/docs")
    df = sharding.measured(spark.read.parquet(f"{tmp_path}/docs"))
    h = F.xxhash64(F.col("doc_id").cast("string"), F.col("text_crc32"), F.lit(sharding.SEED))
    hashed = df.withColumns({"part": F.spark_partition_id(), "h": h, "again": F.xxhash64(h, F.lit(sharding.SEED + 1))}).collect()
    parts, total = sorted({r.part for r in hashed}), len(hashed)
    sizes = np.array([total // n + (j < total % n) for j in range(n)])
    matrix = sharding.communication_matrix(np.array([sum(r.part == p for r in hashed) for p in parts]), sizes)
    slots = [sharding.n_slices(total, len(parts)), sharding.n_slices(total, n)]
    shards = [[] for _ in range(n)]
    for p, counts in zip(parts, matrix, strict=True):
        own = sorted((r for r in hashed if r.part == p), key=lambda r: (r.h % slots[0], r.h, r.doc_id))
        for shard, count in enumerate(counts):
            shards[shard] += own[:count]
            own = own[count:]
    want = {(r.doc_id, r.h, shard, slot) for shard, own in enumerate(shards) for slot, r in enumerate(sorted(own, key=lambda r: (r.again % slots[1], r.again, r.doc_id)))}
    by_k = {r.k: r.h for r in hashed}
    got = sharding.shard(df, n).collect()
    assert {(r.doc_id, by_k[r.k], r.shard, r.slot) for r in got} == want and len(got) == total


def test_communication_matrix_is_hypergeometric():
    rows, columns = np.array([30, 0, 50, 20]), np.array([34, 33, 33])
    draws = np.stack([sharding.communication_matrix(rows, columns, seed) for seed in range(2000)])
    assert (draws.sum(1) == columns).all() and (draws.sum(2) == rows).all() and (draws >= 0).all()
    assert draws.mean(0) == pytest.approx(np.outer(rows, columns) / 100, abs=0.25)
    p = 0.34
    assert draws[:, 0, 0].var() == pytest.approx(30 * p * (1 - p) * 70 / 99, rel=0.15)
    for good, bad, n in ((7, 5, 4), (60, 1, 40), (3, 200, 150), (5, 5, 10)):
        whole = math.comb(good + bad, n)
        chances = [math.comb(good, x) * math.comb(bad, n - x) / whole for x in range(max(0, n - bad), min(n, good) + 1)]
        for u in np.linspace(0, 0.9999, 97):
            got = sharding.hypergeometric(good, bad, n, float(u)) - max(0, n - bad)
            assert sum(chances[:got]) - 1e-9 <= u <= sum(chances[: got + 1]) + 1e-9
    good, bad, n = 3 * 10**11, 7 * 10**11, 2 * 10**9  # no normal in its place: moments of populations above 1e9
    rng = np.random.default_rng(1)
    far = np.array([sharding.hypergeometric(good, bad, n, rng.random()) for _ in range(400)], float)
    sd = (n * 0.3 * 0.7 * (1 - n / 10**12)) ** 0.5
    assert abs(far.mean() - 0.3 * n) < 5 * sd / 20 and far.std() == pytest.approx(sd, rel=0.15)
    big = sharding.communication_matrix(np.array([3 * 10**9, 10**9]), np.array([2 * 10**9, 2 * 10**9]))
    assert (big.sum(1) == [3 * 10**9, 10**9]).all() and (big.sum(0) == 2 * 10**9).all()


# ---- 10 ----


def test_url_filter(spark):
    hosts = ["example.org", "a.example.org", "ORG", "x.COM", "com", "xcom", "casino.net", "my-casino-win.net", "casinos.net", "free-bets.example.net", "www.xxx.net", "porn-site.info", "a.de"]
    paths = ["", "/", "/es/1", "/en/1", "/en/12?x=/fr/", "/fr/a#b", "/de/", "/wp-login.php", "/wp-login.phpx", "/a/phishing/b", "#top", "?q=casino"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + ["", "no scheme/fr/", "a://b://org/", "http:///x", "HTTP://A.ORG/"]
    rows = [(i, u, "") for i, u in enumerate(urls)] + [(999, None, ""), (0, urls[0], "")]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, rule string")).collect()
    assert len(got) == len(rows)
    for r in got:
        u = r.url or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(h + p, v) for v, h, p in url_filter.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        if rule is None:
            verdict = "block" if any(re.search(p, u.lower()) for p in url_filter.PATTERNS) else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict), u
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_index_holds_a_rule_under_its_rarest_token():
    index = url_filter.rarest_token_index(("/common-rare/", "/common-odd/", r"/(aa|bb)/"), {"common": 9, "rare": 1, "odd": 2})
    assert index == {"rare": ["/common-rare/"], "odd": ["/common-odd/"], "aa": [r"/(aa|bb)/"], "bb": [r"/(aa|bb)/"]}
    with pytest.raises(ValueError):
        url_filter.pattern_rule(r"[0-9]+")


def test_choices_and_what_may_be_left_out():
    clauses = lambda p: {frozenset(c) for c in url_filter.pattern_rule(p).clauses}
    assert clauses(r"(/(aa|bb)/)?/foo/") == {frozenset(["foo"])}
    assert clauses(r"/foo/|/bar-baz/") in ({frozenset(["foo", "bar"])}, {frozenset(["foo", "baz"])})
    assert clauses(r"//(escort|escorts)[.]") == {frozenset(["escort", "escorts"])}
    assert clauses(r"/x(a|b)y?/") == {frozenset(["xa", "xb", "xay", "xby"])} and clauses(r"/x(a|b)/foo/") >= {frozenset(["foo"])}
    assert clauses(r"(/ad/)+[a-z]") == {frozenset(["ad"])}
    for p in ("foo|bar", "foo", "/foo", "/foo.*", "/(foo/)?", "/foo[0-9]*/", "(?:/a/|b)", "/[ab]{2}/", "/foo(?=x)", "/fo.o/", r"/foo\B/"):
        with pytest.raises(ValueError):
            url_filter.pattern_rule(p)


_ATOM = st.sampled_from(["foo", "bar", "x", "7", "/", "-", ".", r"\.", "[.-]", "[a-f]", "[0-9]+", "[^/]*", "x?", "$", "^", r"\b", r"\w", "a|b", "(?!x)"])
_PATTERN = st.recursive(_ATOM, lambda p: st.one_of(st.lists(p, min_size=2, max_size=4).map("".join), st.lists(p, min_size=2, max_size=3).map(lambda x: f"({'|'.join(x)})"), st.tuples(p, st.sampled_from(["?", "*", "+", "{2}", "??"])).map(lambda x: f"(?:{x[0]}){x[1]}")), max_leaves=8)


@settings(max_examples=600, deadline=None)
@given(_PATTERN, st.lists(st.text(alphabet="fobar/x7-._a", max_size=14), min_size=1, max_size=12), st.randoms())
def test_index_against_plain_patterns(pattern, urls, rng):
    try:
        index = url_filter.PatternIndex(url_filter.rarest_token_index((pattern, "/common/")))
    except ValueError:
        return
    near = ["".join(rng.choice(["/foo/", "bar", "-", "x", "/7/", "/", ".", "foo", "a", "b"]) for _ in range(rng.randint(1, 6))) for _ in range(30)]
    for u in [*urls, *near]:
        assert index.blocks(u) == bool(re.search(pattern, u, re.ASCII) or re.search("/common/", u)), (pattern, u)


def test_urls_run_only_the_rules_their_tokens_fetch(spark):
    patterns = tuple(f"/bad{k}/x[0-9]+" for k in range(20_000))
    index = url_filter.PatternIndex(url_filter.rarest_token_index(patterns))
    assert index.blocks("http://a/bad77/x1") and not index.blocks("http://a/bad78/y1") and index.ran == 2
    assert not index.blocks("http://a/" + "plain/" * 100_000) and index.ran == 2
    df = spark.createDataFrame([(k, f"http://h/bad{k}/{'x' if k % 2 else 'y'}5") for k in range(0, 20_000, 97)], "page_id long, url string")
    assert all((r.verdict == "block") == (r.page_id % 2 == 1) for r in url_filter.filter_urls(df, rules=(), patterns=patterns).collect())


def test_texts_and_urls_of_any_length(spark):
    long = " ".join(f"ka{i % 977}lo" for i in range(150_000)) + "\n#"
    df = spark.createDataFrame([(1, long, "aa", "s", 1), (2, "ka lo mi", "aa", "s", 1), (3, None, None, None, 1)], EMPTY)
    assert {r.doc_id: r.size for r in mixing.mix_sources(df).collect()} == {1: 150_001, 2: 3, 3: 0}
    counts = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_repeat_words) for r in quality.quality(df).collect()}
    assert counts == {1: (150_001, len(long) - 150_000, 1, 150_000), 2: (3, 6, 0, 0), 3: (0, 0, 0, 0)}
    model = langid.train([("aa", "ka lo mi ren " * 20), ("bb", "sch ung ver ü " * 20)])
    told = {r.doc_id: r.lang_pred for r in langid.identify(df, model=model).collect()}
    assert told == {1: "aa", 2: "aa", 3: "und"}
    url = "http://a.net/" + "x-" * 300_000 + "/phishing/"
    pages = spark.createDataFrame([(1, url), (2, url + "?"), (3, url[:-1])], "page_id long, url string")
    assert [r.verdict for r in url_filter.filter_urls(pages).orderBy("page_id").collect()] == ["block", "block", "allow"]
