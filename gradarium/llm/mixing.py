"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradarium.llm.common import SPACE, let, stored

#: Weights by the rank of a source's name, repeating.
WEIGHTS = (3, 1, 2)
#: The mix holds SHARE[0] / SHARE[1] of all words; a source gives at most MOST times its size.
SHARE, MOST = (3, 2), 2
#: Sources that may be broadcast; beyond it the join with documents shuffles.
FEW_SOURCES = 10_000


def n_words(text: Column) -> Column:
    def inner(parts: Column) -> Column:
        return F.size(parts) - (parts[0] == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")

    return let(F.split(F.coalesce(text, F.lit("")), SPACE), inner).cast("long")


def draw(doc_id: Column, text: Column) -> Column:
    """A whole number below 2^52, by a hash of doc_id and text."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("/"), F.coalesce(text, F.lit("")))), 1, 13), 16, 10).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) of rows (source, size).

    Targets share SHARE of all words by weight; those above MOST times their source's size stop there and the
    excess goes to the others by weight, until none is above. Every round is a global sum and a filter over the
    table of sources, which is numbered by range partitions, so no single task holds all sources.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = stored(sizes.withColumn("__last", F.col("source").isNull()).repartitionByRange("__last", "source").withColumn("__part", F.spark_partition_id()), "sources")
    w = Window.partitionBy("__part").orderBy("__last", "source")
    first = ranged.groupBy("__part").count().withColumn("__first", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = (F.row_number().over(w) - 1 + F.col("__first")) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank + 1).cast("int"))
    sources = ranged.join(F.broadcast(first.drop("count")), "__part").select("source", "source_size", weight.cast("long").alias("w"))
    sources = stored(sources, "weights")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    # what is left to share is left / (SHARE[1] * weights) for a weight of 1: whole numbers, so both engines agree
    left, weights, is_open = SHARE[0] * total, -1, F.lit(True)
    while True:
        row = sources.where(is_open).agg(F.sum("w").alias("w"), F.sum("source_size").alias("s")).first()
        if not row.w or row.w == weights:
            break
        stopped = sources.where(~is_open).agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
        left, weights = SHARE[0] * total - SHARE[1] * MOST * stopped, row.w
        wide = "decimal(38,0)"
        is_open = (F.lit(SHARE[1] * MOST).cast("decimal(4,0)") * F.col("source_size").cast("decimal(19,0)") * F.lit(weights).cast("decimal(14,0)")).cast(wide) > (F.col("w").cast("decimal(4,0)") * F.lit(left).cast("decimal(20,0)")).cast(wide)
    shared = (F.col("w") * F.lit(left)).cast("double") / F.lit(SHARE[1] * max(weights, 1)).cast("double")
    return sources.select("source", "source_size", F.when(is_open, shared).otherwise((F.col("source_size") * MOST).cast("double")).alias("target"))


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """docs with size, source_size, target, copies and taken; columns of docs with these names are replaced.

    Words are aggregated for each source, its rate is target / source_size, and each document is taken floor(rate)
    times plus one more copy if its draw, a hash of doc_id and text as a number in [0, 1), is below frac(rate): a
    Bernoulli copy that depends on nothing but the document and its source's rate. Sources are a small table that is
    joined to the documents, which are never shuffled while there are at most FEW_SOURCES sources.
    A null text has size 0, a null source is a source of its own (the last), a null doc_id draws as ''. Rows that tie
    in doc_id and text draw alike, each is a document of its own. A source without words has target 0 and rate 0.
    Texts of any length are counted whole. No rows give no rows.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    sized = docs.withColumn("size", n_words(F.col(text)))
    targets = stored(source_targets(sized.select(F.col(source).alias("source"), "size")), "targets")
    few = targets.count() <= FEW_SOURCES
    targets = targets.withColumnRenamed("source", "__source")
    rows = sized.join(F.broadcast(targets) if few else targets, F.col(source).eqNullSafe(F.col("__source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    more = draw(F.col(doc_id), F.col(text)) / F.lit(2.0**52) < rate - F.floor(rate)
    rows = rows.withColumn("copies", F.floor(rate).cast("long") + more.cast("long"))
    return rows.select(*docs.columns, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mix itself: each document as often as mix_sources takes it, with the columns of docs, whatever their names."""
    held = docs.select(F.col(text).alias("text"), F.col(source).alias("source"), F.col(doc_id).alias("doc_id"), F.struct(*[F.col(c) for c in docs.columns]).alias("__row"))
    taken = mix_sources(held).where("copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")


ORACLE = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || coalesce(text, '')), 1, 13))::BIGINT AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM d GROUP BY source),
o AS (SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(source_size) OVER (ORDER BY source_size / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
    sum(w) OVER (ORDER BY source_size / w, w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM s),
c AS (SELECT CAST(3 * total - 4 * stopped AS BIGINT) AS left_over, CAST(weights AS BIGINT) AS weights FROM o
    WHERE 4 * source_size * weights > w * (3 * total - 4 * stopped) ORDER BY stopped, weights DESC LIMIT 1),
t AS (SELECT s.source, s.source_size, CASE WHEN 4 * s.source_size * coalesce(c.weights, 1) > s.w * coalesce(c.left_over, 0)
    THEN CAST(s.w * c.left_over AS DOUBLE) / CAST(2 * c.weights AS DOUBLE) ELSE CAST(2 * s.source_size AS DOUBLE) END AS target FROM s LEFT JOIN c ON true),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, d.h / 4503599627370496.0::DOUBLE AS u,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM r
"""
