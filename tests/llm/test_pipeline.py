"""The pipeline's stages, each against a brute-force version on its own input."""

import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_ngram_join import brute  # noqa: E402

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held, outs = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, held, SF)
        if k < 4:
            assert out.columns == docs.columns
        rows = out.collect()
        outs.append(rows)
        held = spark.createDataFrame(rows, out.schema).repartition(3)
    start = docs.collect()
    good, exact, near, mixed, packed = outs
    assert {r.doc_id for r in good} < {r.doc_id for r in start} and len(good) > 0.7 * len(start)
    assert all(len(words(r.text)) >= 50 for r in good)
    norm = lambda r: re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
    least = {}
    for r in good:
        least[norm(r)] = min(least.get(norm(r), r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(least.values())
    want = brute([(r.doc_id, r.text) for r in exact], 5, 80, 100)
    assert sorted(r.doc_id for r in near) == sorted(i for i, (_, c) in want.items() if i == c)
    total = sum(len(words(r.text)) for r in near)
    assert 1.3 * total < sum(len(words(r.text)) for r in mixed) < 1.7 * total
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in near} and {r.doc_id for r in packed} == {r.doc_id for r in mixed}
    assert sum(r.piece == 0 for r in packed) == len(mixed)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0


def test_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_nulls_ties_repeats_long_texts_and_clashing_names(spark):
    prose = " ".join(f"w{i}" for i in range(300))
    other = " ".join(f"v{i}" for i in range(300))
    long = " ".join(f"long{i}" for i in range(30_000))
    rows = [(1, prose, "a"), (1, prose, "a"), (None, prose, None), (None, other, "a"), (None, other, "a"), (2, other + " end", None), (3, None, "a"), (4, "", "a"), (5, long, "b"), (6, long + " x", "b")]
    clash = "row long, held int, n int, kept boolean, size string, component_id int, piece int, told int"
    df = spark.createDataFrame([(*r, 1, 2, 3, True, "s", 4, 5, 6) for r in rows], f"doc_id long, text string, source string, {clash}").repartition(3)
    held, left = df, []
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, held, "")
        assert out.columns == df.columns
        rows = out.collect()
        held = spark.createDataFrame(rows, df.schema)
        left.append(sorted((str(r.doc_id), (r.text or "")[:2]) for r in rows))
    good, exact, near, _ = left
    assert len(good) == 8 and exact == [("1", "w0"), ("2", "v0"), ("5", "lo"), ("6", "lo"), ("None", "v0")]
    assert near == [("1", "w0"), ("2", "v0"), ("5", "lo")]
    packed = corpus_pipeline.pack_sequences(spark, held, "").collect()
    assert {(r.doc_id) for r in packed} <= {1, 2, 5}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.where("doc_id > 99"), "").count() == 0


def test_texts_reach_python_in_batches_of_bounded_bytes(spark, monkeypatch):
    from gradarium.llm.common import BATCH_BYTES

    key, most = "spark.sql.execution.arrow.maxBytesPerBatch", 3 * BATCH_BYTES // 2
    frame = type(spark.range(0))
    map_in_arrow, read = frame.mapInArrow, spark.sparkContext.accumulator(0)

    def counted(self, func, schema, *args, **more):
        def run(batches):
            def each():
                for b in batches:
                    if b.nbytes > most:
                        raise ValueError(f"a batch of {b.nbytes} bytes")
                    read.add(b.nbytes)
                    yield b

            yield from func(each())

        return map_in_arrow(self, run, schema, *args, **more)

    monkeypatch.setattr(frame, "mapInArrow", counted)
    text = F.concat_ws(" ", F.sequence(F.col("doc_id") * 1000, F.col("doc_id") * 1000 + 999))
    docs = spark.range(2500, numPartitions=1).withColumnRenamed("id", "doc_id").select("doc_id", text.alias("text"), F.lit("a").alias("source"))
    for stage in (corpus_pipeline.near_copies, corpus_pipeline.pack_sequences):
        read.value = 0
        assert stage(spark, docs, "").select("doc_id").distinct().count() == 2500
        assert read.value > 3 * BATCH_BYTES and spark.conf.get(key, None) is None
    spark.conf.set(key, str(BATCH_BYTES // 2))
    most = BATCH_BYTES
    try:
        assert corpus_pipeline.pack_sequences(spark, docs, "").count() >= 2500 and spark.conf.get(key) == str(BATCH_BYTES // 2)
    finally:
        spark.conf.unset(key)


def test_a_worker_keeps_one_vocabulary(tmp_path):
    import os
    import shutil

    import public_tokenizers

    from gradarium.llm import packing

    path = str(tmp_path / "t.json")
    shutil.copy(public_tokenizers.path("byte_bpe_50k.json"), path)
    packing._loaded.cache_clear()
    one, two = packing.encoder(path), packing.encoder(path)
    assert one("a b") == two("a b") and packing._loaded.cache_info().misses == 1
    os.utime(path, ns=(1, 1))
    packing.encoder(path)
    assert packing._loaded.cache_info().misses == 2
