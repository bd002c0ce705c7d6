"""The registered queries of the core, each with the SQL that computes the same from the base tables."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradarium.functions import expressions as E
from gradarium.functions.ordering import shared_dir, written
from gradarium.operators import binning, boosting, builders, detection, metrics, rectangles, trees, warping
from gradarium.sources import readers, sinks
from gradarium.sources.json_scan import json_entries
from gradarium.streaming import frames, streams

ROUNDS, BINS, TRIM, MOST = 3, 8, 0.05, 2.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query and, if SQL can express it, its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sign(condition):
    return F.when(condition, F.lit(-1)).otherwise(F.lit(1))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumn("y", sign(F.col("label") < 5))


# ---- SQL of boosting ----


def ranges_sql(long: str, r: float = TRIM) -> str:
    return f"""ranked AS (SELECT j, x, row_number() OVER (PARTITION BY j ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY j) AS m FROM {long}),
trimmed AS (SELECT j, min(x) AS least, max(x) AS most, max(CASE WHEN k = ceil({r}::DOUBLE * m) THEN x END) AS lo0, max(CASE WHEN k = floor((1.0::DOUBLE - {r}::DOUBLE) * m) THEN x END) AS hi0 FROM ranked GROUP BY j),
ranges AS (SELECT j, CASE WHEN lo0 < hi0 THEN lo0 ELSE least END AS lo, CASE WHEN lo0 < hi0 THEN hi0 ELSE most END AS hi FROM trimmed)"""


def bin_sql(x: str, b: int = BINS) -> str:
    return f"CAST(CASE WHEN hi > lo THEN greatest(0, least({b - 1}, floor({b}.0::DOUBLE * ({x} - lo) / (hi - lo)))) ELSE 0 END AS INTEGER)"


def logit_sql(most: float = MOST) -> str:
    return f"CASE WHEN wp = wn THEN 0.0::DOUBLE WHEN wp <= 0 THEN -{most}::DOUBLE WHEN wn <= 0 THEN {most}::DOUBLE ELSE greatest(-{most}::DOUBLE, least({most}::DOUBLE, 0.5::DOUBLE * ln(wp / wn))) END"


_EMBEDDED = """e AS (SELECT vec_id, CASE WHEN label < 5 THEN -1 ELSE 1 END AS y, embedding FROM embeddings),
long AS (SELECT vec_id, y, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM e)"""


def boosting_sql(rounds: int, before: str = _EMBEDDED, head: str = "WITH ") -> str:
    """CTEs up to s0 .. s{rounds - 1}: (j, err) of each round, h0 ..: (j, b, l) responses, and w{rounds}: the weights."""
    parts = [
        before,
        ranges_sql("long"),
        f"binned AS MATERIALIZED (SELECT vec_id, y, long.j, {bin_sql('x')} AS b FROM long JOIN ranges USING (j))",
        "w0 AS (SELECT vec_id, 1.0::DOUBLE / (SELECT count(*) FROM e) AS w FROM e)",
    ]
    for t in range(rounds):
        parts += [
            f"g{t} AS MATERIALIZED (SELECT j, b, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS wp, sum(CASE WHEN y = -1 THEN w ELSE 0 END) AS wn FROM binned JOIN w{t} USING (vec_id) GROUP BY j, b)",
            f"h{t} AS MATERIALIZED (SELECT j, b, wp, wn, {logit_sql()} AS l FROM g{t})",
            f"s{t} AS MATERIALIZED (SELECT j, sum(wp * exp(-l) + wn * exp(l)) AS err FROM h{t} GROUP BY j ORDER BY round(err, 13), j LIMIT 1)",
            f"w{t + 1} AS MATERIALIZED (SELECT vec_id, w * exp(-y * l) / err AS w FROM w{t} JOIN binned USING (vec_id) JOIN s{t} USING (j) JOIN h{t} USING (j, b))",
        ]
    return head + ",\n".join(parts)


def scores_sql(rounds: int) -> str:
    terms = " UNION ALL ".join(f"SELECT vec_id, coalesce(l, 0) AS l FROM binned JOIN s{t} USING (j) LEFT JOIN h{t} USING (j, b)" for t in range(rounds))
    return f"{boosting_sql(rounds)},\nscored AS (SELECT vec_id, sum(l) AS score FROM ({terms}) GROUP BY vec_id)"


def _model(spark: SparkSession, sf_dir: str, rounds: int = ROUNDS) -> boosting.BoostedModel:
    return boosting.BoostedBins(rounds, BINS, TRIM, MOST).fit(embeddings(spark, sf_dir), "y", "embedding")


def _scored(spark: SparkSession, sf_dir: str, rounds: int = ROUNDS) -> DataFrame:
    return _model(spark, sf_dir, rounds).transform(embeddings(spark, sf_dir))


@query(
    boosting_sql(ROUNDS)
    + "\n"
    + " UNION ALL ".join(f"SELECT {t} AS t, j, round(err, 6) AS err, b, round(l, 6) AS l FROM s{t} JOIN h{t} USING (j)" for t in range(ROUNDS))
)
def fit_boosted_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of three rounds: feature, error and responses of its bins (those that hold rows)."""
    rows = _model(spark, sf_dir).table(spark).select("t", "j", F.round("err", 6).alias("err"), F.posexplode("logits").alias("b", "l"))
    return rows.select("t", "j", "err", F.col("b").cast("int").alias("b"), F.round("l", 6).alias("l"))


@query("WITH long AS (SELECT CAST(unnest(range(0, len(embedding))) AS INTEGER) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),\n" + ranges_sql("long") + "\nSELECT j, lo, hi FROM ranges")
def ranges_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = binning.feature_rows(embeddings(spark, sf_dir), "y", "embedding")
    return binning.range_table(spark, binning.find_ranges(rows, TRIM))


_LINEITEM = "WITH long AS (SELECT j, x FROM (SELECT unnest([0, 1, 2, 3]) AS j, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM lineitem)),\n"


@query(_LINEITEM + ranges_sql("long", 0.1) + "\nSELECT CAST(j AS INTEGER) AS j, lo, hi FROM ranges")
def ranges_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of tall numeric columns with many equal values."""
    x = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return binning.range_table(spark, binning.find_ranges(table(spark, sf_dir, "lineitem").select(x.alias("x")), 0.1))


@query("SELECT CAST(0 AS INTEGER) AS j, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer")
def ranges_untrimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.range_table(spark, binning.find_ranges(table(spark, sf_dir, "customer").select(F.array("c_acctbal").alias("x")), 0.0))


@query(
    "WITH long AS (SELECT p_partkey, unnest([0, 1]) AS j, unnest([CAST(p_size AS DOUBLE), p_retailprice]) AS x FROM part),\n"
    + ranges_sql("long")
    + f"\nSELECT p_partkey, CAST(long.j AS INTEGER) AS j, {bin_sql('x')} AS b FROM long JOIN ranges USING (j)"
)
def bins_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("x", F.array(F.col("p_size").cast("double"), F.col("p_retailprice")))
    binned = binning.bin_rows(part.withColumnsRenamed({"p_partkey": "row_id"}).withColumn("y", F.lit(1)), binning.find_ranges(part, TRIM), BINS)
    return binned.select(F.col("row_id").alias("p_partkey"), F.posexplode("bins").alias("j", "b")).withColumn("b", F.col("b").cast("int"))


def _first_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = binning.feature_rows(embeddings(spark, sf_dir), "y", "embedding")
    ranges = binning.find_ranges(rows, TRIM)
    return boosting.histogram(binning.bin_state(rows, ranges, BINS), len(ranges), BINS, log_norm=math.log(rows.count()))


@query(boosting_sql(1) + "\nSELECT j, b, round(wp, 9) AS wp, round(wn, 9) AS wn, round(l, 9) AS l FROM h0")
def weighted_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of both classes and response of each feature and bin in the first round."""
    h = _first_histogram(spark, sf_dir).withColumn("l", E.logit(F.col("wp"), F.col("wn"), MOST))
    return h.select("j", F.col("b").cast("int").alias("b"), *[F.round(c, 9).alias(c) for c in ("wp", "wn", "l")])


@query(boosting_sql(1) + "\nSELECT j, round(sum(wp * exp(-l) + wn * exp(l)), 9) AS err FROM h0 GROUP BY j")
def exponential_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosting.feature_errors(_first_histogram(spark, sf_dir), MOST, BINS).select("j", F.round("err", 9).alias("err"))


@query(boosting_sql(1) + "\nSELECT j, round(err, 9) AS err FROM s0")
def best_feature_first_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosting.best_feature(boosting.feature_errors(_first_histogram(spark, sf_dir), MOST, BINS)).select("j", F.round("err", 9).alias("err"))


@query(scores_sql(ROUNDS) + "\nSELECT vec_id, round(score, 6) AS score, CASE WHEN score > 0 THEN 1 ELSE -1 END AS prediction FROM scored")
def score_and_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("vec_id", F.round("score", 6).alias("score"), "prediction")


@query(scores_sql(2) + "\nSELECT vec_id, round(score, 6) AS score FROM scored")
def truncated_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of three rounds, cut to its first two."""
    return _model(spark, sf_dir).truncated(2).transform(embeddings(spark, sf_dir)).select("vec_id", F.round("score", 6).alias("score"))


@query(
    scores_sql(ROUNDS)
    + """,
p AS (SELECT vec_id % 4 = 0 AS is_test, y, CASE WHEN score > 0 THEN 1 ELSE -1 END AS prediction FROM scored JOIN e USING (vec_id))
SELECT is_test, round(avg(CAST(y = prediction AS INTEGER)), 9) AS accuracy, round(avg(CASE WHEN y = 1 THEN CAST(y = prediction AS INTEGER) END), 9) AS sensitivity,
    round(1.0::DOUBLE - avg(CASE WHEN y = -1 THEN CAST(y = prediction AS INTEGER) END), 9) AS far FROM p GROUP BY is_test"""
)
def accuracy_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).withColumn("is_test", F.col("vec_id") % 4 == 0)
    return metrics.accuracies(scored, ["is_test"]).select("is_test", *[F.round(c, 9).alias(c) for c in ("accuracy", "sensitivity", "far")])


_STAGES = (1, 2, 4, 7)


def _staged_sql() -> str:
    """Scores of each stage from its own rounds."""
    parts = " UNION ALL ".join(f"SELECT {n} AS rounds, vec_id, l FROM (" + " UNION ALL ".join(f"SELECT vec_id, coalesce(l, 0) AS l FROM binned JOIN s{t} USING (j) LEFT JOIN h{t} USING (j, b)" for t in range(n)) + ")" for n in _STAGES)
    return f"""{boosting_sql(max(_STAGES))},
staged AS (SELECT rounds, vec_id, sum(l) AS score FROM ({parts}) GROUP BY ALL),
p AS (SELECT rounds, y, round(score, 12) > 0 AS above FROM staged JOIN e USING (vec_id))
SELECT CAST(rounds AS INTEGER) AS rounds, count(*) AS m, round(avg(CAST((y = 1) = above AS INTEGER)), 9) AS accuracy, round(avg(CASE WHEN y = 1 THEN CAST(above AS INTEGER) END), 9) AS sensitivity, round(avg(CASE WHEN y = -1 THEN CAST(above AS INTEGER) END), 9) AS far FROM p GROUP BY 1"""


@query(_staged_sql())
def staged_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, sensitivity and false alarm rate by the number of rounds, from one fit and one pass."""
    figures = _model(spark, sf_dir, max(_STAGES)).staged_figures(embeddings(spark, sf_dir), "y", list(_STAGES))
    return figures.select("rounds", "m", *[F.round(c, 9).alias(c) for c in ("accuracy", "sensitivity", "far")])


_TREES, _LEAVES, _RATE, _L2, _LEAST = 2, 4, 0.3, 1.0, 20


def _trees_sql() -> str:
    """Trees grown one split at a time: of all splits of all leaves the one of greatest gain, until there are enough."""
    parts = [_EMBEDDED, ranges_sql("long"), f"binned AS MATERIALIZED (SELECT vec_id, y, long.j, {bin_sql('x')} AS b FROM long JOIN ranges USING (j))"]
    parts.append("m0 AS MATERIALIZED (SELECT vec_id, y, ln((SELECT count(*) FROM e WHERE y = 1) / (SELECT count(*) FROM e WHERE y = -1)) AS margin FROM e)")
    for t in range(_TREES):
        parts.append(f"g{t} AS MATERIALIZED (SELECT vec_id, p - CAST(y = 1 AS INTEGER) AS g, p * (1 - p) AS h FROM (SELECT vec_id, y, 1 / (1 + exp(-margin)) AS p FROM m{t}))")
        parts.append(f"n{t}_0 AS (SELECT vec_id, 0 AS leaf FROM e)")
        for k in range(1, _LEAVES):
            parts += [
                f"c{t}_{k} AS (SELECT leaf, j, b, sum(g) AS g, sum(h) AS h, count(*) AS c FROM binned JOIN g{t} USING (vec_id) JOIN n{t}_{k - 1} USING (vec_id) GROUP BY leaf, j, b)",
                f"l{t}_{k} AS (SELECT leaf, j, b, sum(g) OVER o AS gl, sum(h) OVER o AS hl, sum(c) OVER o AS cl, sum(g) OVER a AS gw, sum(h) OVER a AS hw, sum(c) OVER a AS cw FROM c{t}_{k} WINDOW o AS (PARTITION BY leaf, j ORDER BY b), a AS (PARTITION BY leaf, j))",
                f"p{t}_{k} AS MATERIALIZED (SELECT leaf, j, b FROM (SELECT *, gl * gl / (hl + {_L2}) + (gw - gl) * (gw - gl) / (hw - hl + {_L2}) - gw * gw / (hw + {_L2}) AS gain FROM l{t}_{k} WHERE cl >= {_LEAST} AND cw - cl >= {_LEAST}) WHERE gain > 1e-12 ORDER BY round(gain, 9) DESC, leaf, j, b LIMIT 1)",
                f"n{t}_{k} AS MATERIALIZED (SELECT n.vec_id, CASE WHEN n.leaf = p.leaf AND x.b > p.b THEN {k} ELSE n.leaf END AS leaf FROM n{t}_{k - 1} n LEFT JOIN p{t}_{k} p ON true LEFT JOIN binned x ON x.vec_id = n.vec_id AND x.j = p.j)",
            ]
        parts.append(f"v{t} AS (SELECT leaf, -sum(g) / (sum(h) + {_L2}) * {_RATE} AS v FROM n{t}_{_LEAVES - 1} JOIN g{t} USING (vec_id) GROUP BY leaf)")
        parts.append(f"m{t + 1} AS MATERIALIZED (SELECT vec_id, y, margin + v AS margin FROM m{t} JOIN n{t}_{_LEAVES - 1} USING (vec_id) JOIN v{t} USING (leaf))")
    return "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, round(margin, 6) AS score, CASE WHEN margin > 0 THEN 1 ELSE -1 END AS prediction FROM m{_TREES}"


@query(_trees_sql())
def leafwise_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two trees of four leaves each, grown leaf by leaf, score the embeddings they were fitted on."""
    rows = embeddings(spark, sf_dir)
    model = trees.LeafwiseTrees(_TREES, _LEAVES, BINS, _RATE, _L2, _LEAST, TRIM).fit(rows, "y", "embedding")
    return model.transform(rows).select("vec_id", F.round("score", 6).alias("score"), "prediction")


@query("SELECT quality AS y, count(*) AS n, count(*) / sum(count(*)) OVER () AS prior FROM labels GROUP BY quality")
def class_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_priors(table(spark, sf_dir, "labels").select(F.col("quality").alias("y")))


_ROC_SQL = """,
v AS (SELECT round(score, 6) AS threshold, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = -1) AS n FROM scored JOIN e USING (vec_id) GROUP BY 1),
c AS (SELECT *, row_number() OVER o AS rank, sum(p) OVER o AS tp, sum(n) OVER o AS fp, lead(p) OVER o AS np, lead(n) OVER o AS nn FROM v WINDOW o AS (ORDER BY threshold DESC)),
roc AS (SELECT rank, threshold, CAST(fp AS BIGINT) AS fp, CAST(tp AS BIGINT) AS tp FROM c WHERE np IS NULL OR np <> p OR nn <> n UNION ALL SELECT 0, NULL, 0, 0),
whole AS (SELECT sum(n) AS N1, sum(p) AS P1 FROM v)"""


@query(scores_sql(ROUNDS) + _ROC_SQL + "\nSELECT rank, threshold, fp, tp, round(fp / N1, 9) AS fpr, round(tp / P1, 9) AS tpr FROM roc, whole")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    roc = metrics.roc_points(_scored(spark, sf_dir), digits=6)
    return roc.select("rank", F.when(F.col("rank") > 0, F.col("threshold")).alias("threshold"), "fp", "tp", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query(
    scores_sql(ROUNDS)
    + _ROC_SQL
    + """,
q AS (SELECT rank, threshold, tp / (tp + fp) AS precision, lag(threshold) OVER (ORDER BY rank) AS before, lag(tp / (tp + fp)) OVER (ORDER BY rank) AS p0 FROM roc WHERE fp > 0)
SELECT rank, round(CASE WHEN before IS NULL THEN precision ELSE 0.25 * precision + 0.75 * p0 END, 9) AS precision, round(CASE WHEN before IS NULL THEN threshold ELSE 0.25 * threshold + 0.75 * before END, 9) AS threshold FROM q ORDER BY round(precision, 12) DESC, rank LIMIT 1"""
)
def threshold_by_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = metrics.precision_threshold(metrics.roc_points(_scored(spark, sf_dir), digits=6))
    return best.select("rank", F.round("precision", 9).alias("precision"), F.round("threshold", 9).alias("threshold"))


@query("SELECT event_type, user_id % 10 AS part, max(value) AS value, max(max(value)) OVER (PARTITION BY event_type) / max(value) AS ratio FROM events GROUP BY 1, 2")
def max_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 10).alias("part")).agg(F.max("value").alias("value"))
    return metrics.max_ratios(measured, ["event_type"])


@query("SELECT doc_id, CASE WHEN quality = (SELECT min(quality) FROM labels) THEN -1 ELSE 1 END AS y FROM labels")
def label_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("x", F.array(F.col("doc_id").cast("double")))
    rows, _ = binning.feature_rows(labels, "quality", "x", row_id="doc_id")
    return rows.select(F.col("row_id").alias("doc_id"), F.col("y").cast("int").alias("y"))


@query("SELECT l_returnflag, CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END AS y, count(*) AS n FROM lineitem GROUP BY 1, 2")
def one_vs_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.one_vs_rest(table(spark, sf_dir, "lineitem"), "l_returnflag", "R")
    return rows.groupBy("l_returnflag", F.col("y").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))


# ---- images: embeddings as 8 x 8 gray images ----


def _gray(rows: DataFrame, *keep: str) -> DataFrame:
    gray = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 1) * 128))).cast("smallint"))
    return rows.select(F.col("vec_id").alias("img_id"), F.lit(8).alias("h"), F.lit(8).alias("w"), gray.alias("pixels"), *keep)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gray(table(spark, sf_dir, "embeddings"))


_PIXELS = """WITH px AS (SELECT vec_id AS img_id, CAST(place // 8 AS INTEGER) AS j, CAST(place % 8 AS INTEGER) AS k, CAST(greatest(0, least(255, floor((x + 1) * 128))) AS BIGINT) AS v
    FROM (SELECT vec_id, unnest(range(0, 64)) AS place, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)),
ii AS (SELECT img_id, j, k, CAST(sum(r) OVER (PARTITION BY img_id, k ORDER BY j) AS BIGINT) AS ii FROM (SELECT img_id, j, k, sum(v) OVER (PARTITION BY img_id, j ORDER BY k) AS r FROM px))"""


@query(_PIXELS + "\nSELECT img_id, j, k, ii FROM ii")
def integral_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rectangles.integral(rectangles.pixels(images(spark, sf_dir)))


@query(_PIXELS + "\nSELECT img_id, CAST(sum(v) FILTER (j BETWEEN 2 AND 5 AND k BETWEEN 0 AND 3) AS BIGINT) AS middle_left, CAST(sum(v) AS BIGINT) AS whole FROM px GROUP BY img_id")
def rectangle_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rectangles.integral_arrays(images(spark, sf_dir))
    total = lambda *c: rectangles.rectangle_sum(F.col("ii"), F.col("w"), *map(F.lit, c))
    return rows.select("img_id", total(2, 0, 5, 3).alias("middle_left"), total(0, 0, 7, 7).alias("whole"))


_SIZES = ((0, 6), (1, 8))
_TEMPLATES_SQL = "SELECT unnest(range(0, 9)) AS t, " + ", ".join(f"unnest([{', '.join(f'{w[k]!r}::DOUBLE' for w in rectangles.TEMPLATES)}]) AS {n}" for k, n in enumerate("abcd"))


@query(
    _PIXELS
    + f""",
t AS ({_TEMPLATES_SQL}),
z AS (SELECT unnest([0, 1]) AS s, unnest([6, 8]) AS size),
box AS (SELECT s, t AS f, size, a * 0.25::DOUBLE + 0.375::DOUBLE AS j, b * 0.25::DOUBLE + 0.375::DOUBLE AS k, c * 0.25::DOUBLE AS h, d * 0.25::DOUBLE AS w FROM t, z),
cut AS (SELECT s, f, floor(size * 0.375) AS bj, floor(size * 0.25) AS bh, floor(size * j) AS j, floor(size * k) AS k, floor(size * h) AS h, floor(size * w) AS w FROM box),
win AS (SELECT img_id, s, CAST(j0 AS INTEGER) AS j0, CAST(k0 AS INTEGER) AS k0 FROM (SELECT DISTINCT img_id FROM px), z, (SELECT unnest(range(0, 3)) AS j0) a, (SELECT unnest(range(0, 3)) AS k0) b WHERE j0 <= 8 - size AND k0 <= 8 - size),
sums AS (SELECT win.img_id, win.s, j0, k0, f, bh * bh AS area, h * w AS part, sum(v) AS whole, coalesce(sum(v) FILTER (px.j >= j0 + cut.j AND px.j < j0 + cut.j + cut.h AND px.k >= k0 + cut.k AND px.k < k0 + cut.k + cut.w), 0) AS white
    FROM win JOIN cut USING (s) JOIN px ON px.img_id = win.img_id AND px.j >= j0 + bj AND px.j < j0 + bj + bh AND px.k >= k0 + bj AND px.k < k0 + bj + bh GROUP BY ALL)
SELECT img_id, s, j0, k0, CAST(f AS BIGINT) AS f, CAST(CASE WHEN part > 0 AND area > part THEN trunc(white / part - (whole - white) / (area - part)) ELSE 0 END AS INTEGER) AS value FROM sums"""
)
def rectangle_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine templates at one size and place in all windows of two scales of every image."""
    features = rectangles.catalogue(spark, 1, 1).select(F.col("t").cast("long").alias("f"), "bg", "white")
    sized = F.broadcast(spark.createDataFrame([(s, n, n, 1, 1) for s, n in _SIZES], "s int, h int, w int, dj int, dk int"))
    pictures = images(spark, sf_dir)
    windows = detection.sliding_windows(pictures.select("img_id", F.col("h").alias("height"), F.col("w").alias("width")), sized)
    out = rectangles.window_features(windows, rectangles.scaled_boxes(features, sized), rectangles.integral_arrays(pictures))
    return out.withColumn("value", F.col("value").cast("int"))


# ---- windows and boxes: parts as frames, events as boxes ----

_FRAMES_SQL = "frames AS (SELECT p_partkey AS img_id, 100 + p_size AS height, 120 + p_size AS width FROM part)"


def frame_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("img_id"), (F.col("p_size") + 100).alias("height"), (F.col("p_size") + 120).alias("width"))


@query(
    f"""WITH {_FRAMES_SQL},
z AS (SELECT s, CAST(round_even(48 * 1.2::DOUBLE ** s, 0) AS INTEGER) AS h FROM (SELECT unnest(range(0, 4)) AS s)),
d AS (SELECT s, h, CAST(round_even(h * 0.25::DOUBLE, 0) AS INTEGER) AS d FROM z),
r AS (SELECT img_id, s, h, d, height - h AS rj, width - h AS rk FROM frames, d WHERE h <= height AND h <= width),
j AS (SELECT *, unnest(range(CAST(((rj % d) // 2) AS BIGINT), CAST(rj + 1 AS BIGINT), CAST(d AS BIGINT))) AS j0 FROM r),
k AS (SELECT *, unnest(range(CAST(((rk % d) // 2) AS BIGINT), CAST(rk + 1 AS BIGINT), CAST(d AS BIGINT))) AS k0 FROM j)
SELECT img_id, CAST(s AS INTEGER) AS s, count(*) AS n, CAST(sum(j0) AS BIGINT) AS j_sum, CAST(max(k0) AS INTEGER) AS k_last FROM k GROUP BY 1, 2"""
)
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = detection.sliding_windows(frame_sizes(spark, sf_dir), detection.scales(spark, 4, 48, 48, 1.2, 0.25))
    return windows.groupBy("img_id", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("j0").alias("j_sum"), F.max("k0").alias("k_last"))


#: Boxes of events: 40 at most in an image of 200 x 200, so images don't grow with the table.
_BOXES_SQL = """boxes AS (SELECT event_id // 40 AS img_id, event_id AS box, CAST(floor(value * 7) % 150 AS INTEGER) AS j, CAST(user_id * 13 % 150 AS INTEGER) AS k,
    CAST(20 + event_id % 7 * 5 AS INTEGER) AS h, CAST(20 + user_id % 5 * 6 AS INTEGER) AS w, value AS score FROM events)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.floor(F.col("event_id") / 40).alias("img_id"),
        F.col("event_id").alias("box"),
        (F.floor(F.col("value") * 7) % 150).cast("int").alias("j"),
        (F.col("user_id") * 13 % 150).cast("int").alias("k"),
        (F.col("event_id") % 7 * 5 + 20).cast("int").alias("h"),
        (F.col("user_id") % 5 * 6 + 20).cast("int").alias("w"),
        F.col("value").alias("score"),
    )


_IOU_SQL = "(dj * dk) / (ah * aw + bh * bw - dj * dk)::DOUBLE"


@query(
    f"""WITH {_BOXES_SQL},
p AS (SELECT a.img_id, a.box AS a, b.box AS b, a.h AS ah, a.w AS aw, b.h AS bh, b.w AS bw, least(a.j + a.h, b.j + b.h) - greatest(a.j, b.j) AS dj, least(a.k + a.w, b.k + b.w) - greatest(a.k, b.k) AS dk
    FROM boxes a JOIN boxes b ON a.img_id = b.img_id AND a.box < b.box)
SELECT img_id, a, b, round({_IOU_SQL}, 9) AS iou FROM p WHERE dj > 0 AND dk > 0 AND {_IOU_SQL} >= 0.25"""
)
def overlapping_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.overlapping_pairs(boxes(spark, sf_dir)).withColumn("iou", F.round("iou", 9))


_DETECTED = "score > 100"


def _greedy_sql() -> str:
    """Greedy clusters by recursion: each step the best box left of every image takes those that overlap it."""
    return f"""WITH RECURSIVE {_BOXES_SQL},
det AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY score DESC, j, k, h, w) AS n FROM boxes WHERE {_DETECTED}),
pairs AS (SELECT * FROM (SELECT a.img_id, a.n AS a, b.n AS b, a.h AS ah, a.w AS aw, b.h AS bh, b.w AS bw, least(a.j + a.h, b.j + b.h) - greatest(a.j, b.j) AS dj, least(a.k + a.w, b.k + b.w) - greatest(a.k, b.k) AS dk
    FROM det a JOIN det b ON a.img_id = b.img_id AND a.n < b.n) WHERE dj > 0 AND dk > 0 AND {_IOU_SQL} >= 0.25),
near AS (SELECT img_id, a, list(b) AS taken FROM pairs GROUP BY img_id, a),
step AS (SELECT img_id, [CAST(0 AS BIGINT)] AS heads, list(n ORDER BY n) AS left_over, CAST(NULL AS BIGINT[]) AS own FROM det GROUP BY img_id
    UNION ALL SELECT s.img_id, list_append(heads, left_over[1]), list_filter(left_over[2:], lambda x: NOT list_contains(coalesce(taken, []), x)),
        list_prepend(left_over[1], list_filter(left_over[2:], lambda x: list_contains(coalesce(taken, []), x))) FROM step s LEFT JOIN near ON near.img_id = s.img_id AND near.a = s.left_over[1] WHERE len(left_over) > 0),
clusters AS (SELECT img_id, own[1] AS head, unnest(own) AS n FROM step WHERE own IS NOT NULL)"""


@query(_greedy_sql() + "\nSELECT det.img_id, j, k, h, w, score FROM det JOIN clusters c ON c.img_id = det.img_id AND c.head = det.n AND c.n = det.n")
def suppress_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.suppress(detection.above(boxes(spark, sf_dir), 100.0))


_CLUSTER_MEANS = "\nSELECT det.img_id, CAST(round_even(avg(j), 0) AS INTEGER) AS j, CAST(round_even(avg(k), 0) AS INTEGER) AS k, CAST(round_even(avg(h), 0) AS INTEGER) AS h, CAST(round_even(avg(w), 0) AS INTEGER) AS w, round(avg(score), 6) AS score FROM det JOIN clusters c ON c.img_id = det.img_id AND c.n = det.n GROUP BY det.img_id, c.head"


@query(_greedy_sql() + _CLUSTER_MEANS)
def suppress_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.suppress(detection.above(boxes(spark, sf_dir), 100.0), average=True).withColumn("score", F.round("score", 6))


def _detected_sql() -> str:
    """The features of all windows, a model trained on those of the whole images, its scores, greedy clusters."""
    values = (
        _PIXELS.removeprefix("WITH ")
        + f""",
t AS ({_TEMPLATES_SQL}),
feat AS (SELECT (t * 2 + sj) * 2 + sk AS f, a, b, c, d, 0.25::DOUBLE + sj * 0.5::DOUBLE AS h, 0.25::DOUBLE + sk * 0.5::DOUBLE AS v FROM t, (SELECT unnest([0, 1]) AS sj), (SELECT unnest([0, 1]) AS sk)),
z AS (SELECT unnest([0, 1]) AS s, unnest([6, 8]) AS size),
cut AS (SELECT s, f, trunc(size * (0.5::DOUBLE - h / 2)) AS bj, trunc(size * (0.5::DOUBLE - v / 2)) AS bk, trunc(size * h) AS bh, trunc(size * v) AS bw,
    trunc(size * (a * h + (0.5::DOUBLE - h / 2))) AS wj, trunc(size * (b * v + (0.5::DOUBLE - v / 2))) AS wk, trunc(size * (c * h)) AS wh, trunc(size * (d * v)) AS ww FROM feat, z),
win AS (SELECT img_id, s, size, CAST(j0 AS INTEGER) AS j0, CAST(k0 AS INTEGER) AS k0 FROM (SELECT DISTINCT img_id FROM px), z, (SELECT unnest(range(0, 3)) AS j0) x, (SELECT unnest(range(0, 3)) AS k0) y WHERE j0 <= 8 - size AND k0 <= 8 - size),
sums AS (SELECT win.img_id, s, j0, k0, f, bh * bw AS area, wh * ww AS part, coalesce(sum(v) FILTER (px.j >= j0 + bj AND px.j < j0 + bj + bh AND px.k >= k0 + bk AND px.k < k0 + bk + bw), 0) AS whole,
    coalesce(sum(v) FILTER (px.j >= j0 + wj AND px.j < j0 + wj + wh AND px.k >= k0 + wk AND px.k < k0 + wk + ww), 0) AS white FROM win JOIN cut USING (s) JOIN px ON px.img_id = win.img_id GROUP BY ALL),
vals AS MATERIALIZED (SELECT img_id, s, j0, k0, f, CASE WHEN part > 0 AND area > part THEN trunc(white / part - (whole - white) / (area - part)) ELSE 0 END AS value FROM sums),
e AS (SELECT vec_id, CASE WHEN label < 5 THEN -1 ELSE 1 END AS y FROM embeddings),
long AS MATERIALIZED (SELECT img_id AS vec_id, y, CAST(f AS INTEGER) AS j, CAST(value AS DOUBLE) AS x FROM vals JOIN e ON e.vec_id = vals.img_id WHERE s = 1)"""
    )
    terms = " UNION ALL ".join(f"SELECT img_id, s, j0, k0, coalesce(l, 0) AS l FROM (SELECT v.*, c.j, {bin_sql('value')} AS b FROM vals v JOIN s{t} c ON c.j = v.f JOIN ranges r ON r.j = v.f) LEFT JOIN h{t} USING (j, b)" for t in range(ROUNDS))
    det = f"""scored AS (SELECT img_id, s, j0, k0, sum(l) AS score FROM ({terms}) GROUP BY ALL),
det AS MATERIALIZED (SELECT img_id, j0 AS j, k0 AS k, size AS h, size AS w, score, row_number() OVER (PARTITION BY img_id ORDER BY round(score, 9) DESC, s, j0, k0) AS n FROM scored JOIN z USING (s) WHERE round(score, 12) > 0)"""
    greedy = _greedy_sql()
    return boosting_sql(ROUNDS, values, "WITH RECURSIVE ") + ",\n" + det + ",\n" + greedy[greedy.index("pairs AS") :] + _CLUSTER_MEANS


def _axis_sql(n: int, to: int, name: str) -> str:
    """Two pixels and a share for each place along an axis."""
    at = f"greatest(0, least({n - 1}, (i + 0.5::DOUBLE) * ({n}::DOUBLE / {to}) - 0.5::DOUBLE))"
    return f"{name} AS (SELECT i, lo, least(lo + 1, {n - 1}) AS hi, p - lo AS u FROM (SELECT i, p, least(CAST(floor(p) AS INTEGER), {n - 2}) AS lo FROM (SELECT i, {at} AS p FROM (SELECT unnest(range(0, {to})) AS i))))"


@query(
    _PIXELS
    + f""",
{_axis_sql(8, 13, "a")},
d AS (SELECT img_id, list(v ORDER BY j, k) AS p FROM px GROUP BY img_id),
r AS (SELECT img_id, y.i AS j, x.i AS k, (p[y.lo * 8 + x.lo + 1] * (1 - y.u) + p[y.hi * 8 + x.lo + 1] * y.u) * (1 - x.u) + (p[y.lo * 8 + x.hi + 1] * (1 - y.u) + p[y.hi * 8 + x.hi + 1] * y.u) * x.u AS v FROM d, a y, a x)
SELECT img_id, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, round(v, 6) AS v, 8 / 13::DOUBLE AS scale FROM r"""
)
def resized_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image at a height of 13 pixels."""
    rows = warping.resized(images(spark, sf_dir), 13, whole=False)
    return rectangles.pixels(rows).withColumns({"v": F.round("v", 6), "scale": F.lit(8 / 13)})


@query(
    _PIXELS
    + """,
w AS (SELECT unnest([0, -1, 0, 1, 0]) AS dj, unnest([0, 0, -1, 0, 1]) AS dk, unnest([5, -1, -1, -1, -1]) AS f),
n AS (SELECT img_id, j, k, f, CASE WHEN abs(j + dj) > 7 THEN 6 ELSE abs(j + dj) END AS nj, CASE WHEN abs(k + dk) > 7 THEN 6 ELSE abs(k + dk) END AS nk FROM px, w)
SELECT n.img_id, n.j, n.k, CAST(greatest(0, least(255, sum(f * v))) AS INTEGER) AS v FROM n JOIN px ON px.img_id = n.img_id AND px.j = nj AND px.k = nk GROUP BY 1, 2, 3"""
)
def sharpened_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image through a stencil of its neighbours, mirrored at the border."""
    return rectangles.pixels(warping.sharpened(images(spark, sf_dir))).withColumn("v", F.col("v").cast("int"))


@query(_PIXELS + "\nSELECT img_id, CAST(7 - k AS INTEGER) AS j, CAST(j AS INTEGER) AS k, CAST(v AS INTEGER) AS v FROM px")
def turned_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image turned by a right angle."""
    return rectangles.pixels(warping.turned(images(spark, sf_dir), 90.0)).withColumn("v", F.col("v").cast("int"))


def _two_scales(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, n, n, 1, 1) for s, n in _SIZES], "s int, h int, w int, dj int, dk int")


def _image_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, boosting.BoostedModel]:
    """A catalogue of features and a model of three rounds over their values in the whole images."""
    features = rectangles.catalogue(spark, 2, 1)
    whole = F.array(F.struct(F.lit(0).alias("j"), F.lit(0).alias("k"), "h", "w"))
    rows = _gray(embeddings(spark, sf_dir), "y").withColumnRenamed("img_id", "id")
    train = rectangles.window_arrays(rows.withColumns({"img_id": F.struct("id", "y"), "windows": whole}), features).select("img_id.y", "x")
    train = written(train)  # a fit reads its rows several times
    return features, boosting.BoostedBins(ROUNDS, BINS, TRIM, MOST).fit(train, "y", "x")


@query(_detected_sql())
def detect_in_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pipeline: rectangle features of every image train a model; its selected features score all windows of two
    scales of the images; detections are suppressed by averaging."""
    features, model = _image_model(spark, sf_dir)
    found = detection.detect(images(spark, sf_dir), features, _two_scales(spark), model)
    return detection.suppress(found, average=True).withColumn("score", F.round("score", 6))


@query(_detected_sql().replace("SELECT det.img_id, CAST", "SELECT det.img_id, 'three' AS model, CAST"))
def detect_in_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same images as a stream of files; detections of an image are suppressed in its row."""
    features, model = _image_model(spark, sf_dir)
    stream = _stream(spark, sf_dir, "embeddings")
    found = streams.detect_stream(_gray(stream), features, _two_scales(spark), {"three": model})
    return _streamed(spark, found.withColumn("score", F.round("score", 6)))


def _u(what: str) -> str:
    return f"(('0x' || substr(md5(CAST(img_id AS VARCHAR) || '/' || CAST(draw AS VARCHAR) || '/{what}'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


#: Frames are mosaics of so many tiles of 8 x 8 pixels: 480 x 640.
_TALL, _WIDE = 60, 80


def _frames_detected_sql() -> str:
    """The model of _detected_sql(), its boxes at nine scales, and four corners of each from the mosaics' integral image."""
    head = _detected_sql()
    model = head[: head.index("scored AS (")]
    terms = " UNION ALL ".join(f"SELECT img_id, s, size, j0, k0, coalesce(l, 0) AS l FROM (SELECT v.*, c.j, {bin_sql('value')} AS b FROM fvals v JOIN s{t} c ON c.j = v.f JOIN ranges r ON r.j = v.f) LEFT JOIN h{t} USING (j, b)" for t in range(ROUNDS))
    corner = lambda j, k, h, w: " + ".join(f"{sign}(SELECT ii FROM fi WHERE fi.img_id = x.img_id AND fi.j = {a} AND fi.k = {b})" for sign, a, b in (("", f"j0 + {j} + {h}", f"k0 + {k} + {w}"), ("-", f"j0 + {j}", f"k0 + {k} + {w}"), ("-", f"j0 + {j} + {h}", f"k0 + {k}"), ("", f"j0 + {j}", f"k0 + {k}")))
    return (
        model
        + f"""fid AS (SELECT DISTINCT vec_id // {_TALL * _WIDE} AS img_id FROM embeddings),
fpx AS (SELECT vec_id // {_TALL * _WIDE} AS img_id, vec_id % {_TALL * _WIDE} // {_WIDE} * 8 + place // 8 AS j, vec_id % {_WIDE} * 8 + place % 8 AS k, CAST(greatest(0, least(255, floor((x + 1) * 128))) AS BIGINT) AS v FROM (SELECT vec_id, unnest(range(0, 64)) AS place, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)),
fall AS (SELECT g.img_id, g.j, g.k, coalesce(v, 0) AS v FROM (SELECT img_id, a.j, b.k FROM fid, (SELECT unnest(range(0, {8 * _TALL})) AS j) a, (SELECT unnest(range(0, {8 * _WIDE})) AS k) b) g LEFT JOIN fpx USING (img_id, j, k)),
fi AS MATERIALIZED (SELECT img_id, j + 1 AS j, k + 1 AS k, sum(r) OVER (PARTITION BY img_id, k ORDER BY j) AS ii FROM (SELECT img_id, j, k, sum(v) OVER (PARTITION BY img_id, j ORDER BY k) AS r FROM fall)
    UNION ALL SELECT img_id, 0, unnest(range(0, {8 * _WIDE} + 1)), 0 FROM fid UNION ALL SELECT img_id, unnest(range(1, {8 * _TALL} + 1)), 0, 0 FROM fid),
fz AS (SELECT s, CAST(round_even(96 * 1.2::DOUBLE ** s, 0) AS BIGINT) AS size FROM (SELECT unnest(range(0, 9)) AS s)),
fd AS (SELECT s, size, CAST(round_even(size * 0.05::DOUBLE, 0) AS BIGINT) AS d FROM fz),
fwin AS (SELECT img_id, s, size, j0, unnest(range(({8 * _WIDE} - size) % d // 2, {8 * _WIDE} - size + 1, d)) AS k0 FROM (SELECT *, unnest(range(({8 * _TALL} - size) % d // 2, {8 * _TALL} - size + 1, d)) AS j0 FROM fid, fd WHERE size <= {8 * _TALL})),
chosen AS ({" UNION ".join(f"SELECT j AS f FROM s{t}" for t in range(ROUNDS))}),
fcut AS (SELECT s, f, trunc(size * (0.5::DOUBLE - h / 2)) AS bj, trunc(size * (0.5::DOUBLE - v / 2)) AS bk, trunc(size * h) AS bh, trunc(size * v) AS bw,
    trunc(size * (a * h + (0.5::DOUBLE - h / 2))) AS wj, trunc(size * (b * v + (0.5::DOUBLE - v / 2))) AS wk, trunc(size * (c * h)) AS wh, trunc(size * (d * v)) AS ww FROM feat, fz WHERE f IN (SELECT f FROM chosen)),
fx AS (SELECT * FROM fwin JOIN fcut USING (s)),
fsums AS (SELECT img_id, s, size, j0, k0, f, bh * bw AS area, wh * ww AS part, {corner("bj", "bk", "bh", "bw")} AS whole, {corner("wj", "wk", "wh", "ww")} AS white FROM fx x),
fvals AS MATERIALIZED (SELECT img_id, s, size, j0, k0, f, CASE WHEN part > 0 AND area > part THEN trunc(white / part - (whole - white) / (area - part)) ELSE 0 END AS value FROM fsums),
fscored AS (SELECT img_id, s, size, j0, k0, sum(l) AS score FROM ({terms}) GROUP BY ALL)
SELECT img_id, CAST(s AS INTEGER) AS s, CAST(j0 AS INTEGER) AS j, CAST(k0 AS INTEGER) AS k, CAST(size AS INTEGER) AS h, CAST(size AS INTEGER) AS w, round(score, 6) AS score FROM fscored WHERE round(score, 9) > 0"""
    )


@query(_frames_detected_sql())
def detect_in_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as mosaics of 480 x 640 pixels, each with 22,278 windows of nine scales: those above a threshold."""
    features, model = _image_model(spark, sf_dir)
    mosaics = readers.mosaics(images(spark, sf_dir), _TALL, _WIDE)
    found = detection.detect(mosaics, features, detection.scales(spark), model)
    return found.withColumn("score", F.round("score", 6))


def _examples_sql() -> str:
    """Targets and drawn windows of all images, and the features of a catalogue of two sizes and places in each."""
    iou = "(dj * dk) / (ah * aw + bh * bw - dj * dk)::DOUBLE"
    return (
        _PIXELS
        + f""",
t AS ({_TEMPLATES_SQL}),
axis AS (SELECT s, p, 0.25::DOUBLE + s * 0.5::DOUBLE AS side FROM (SELECT unnest([0, 1]) AS s), (SELECT unnest([-1, 0, 1]) AS p)),
place AS (SELECT *, 0.5::DOUBLE + p * ((1.0::DOUBLE - side) / 2) - side / 2 AS start FROM axis),
feat AS (SELECT (((t * 2 + y.s) * 2 + x.s) * 3 + y.p + 1) * 3 + x.p + 1 AS f, y.start AS bj, x.start AS bk, y.side AS bh, x.side AS bw, a * y.side + y.start AS wj, b * x.side + x.start AS wk, c * y.side AS wh, d * x.side AS ww FROM t, place y, place x),
img AS (SELECT DISTINCT img_id FROM px),
tgt AS (SELECT img_id, CAST(0 AS BIGINT) AS o, CAST(img_id % 2 AS INTEGER) AS j, CAST(img_id % 4 AS INTEGER) AS k, CAST(img_id % 3 + 3 AS INTEGER) AS h, CAST(img_id % 3 + 3 AS INTEGER) AS w FROM img),
good AS (SELECT * FROM tgt WHERE j + h <= 8 AND k + w <= 8),
d0 AS (SELECT img_id, draw FROM img, (SELECT unnest(range(0, 200)) AS draw)),
d1 AS (SELECT img_id, draw, CAST(greatest(floor((0.1::DOUBLE + {_u("side")} * 0.4::DOUBLE) * 8), 1) AS INTEGER) AS h FROM d0),
d2 AS (SELECT *, h AS w, CAST(floor({_u("j")} * (8 - h + 1)) AS INTEGER) AS j, CAST(floor({_u("k")} * (8 - h + 1)) AS INTEGER) AS k FROM d1),
hit AS (SELECT DISTINCT img_id, draw FROM (SELECT a.img_id, a.draw, a.h AS ah, a.w AS aw, b.h AS bh, b.w AS bw, least(a.j + a.h, b.j + b.h) - greatest(a.j, b.j) AS dj, least(a.k + a.w, b.k + b.w) - greatest(a.k, b.k) AS dk FROM d2 a JOIN good b ON a.img_id = b.img_id)
    WHERE dj > 0 AND dk > 0 AND {iou} >= 0.5),
neg AS (SELECT img_id, draw, j, k, h, w FROM (SELECT d2.*, row_number() OVER (PARTITION BY d2.img_id ORDER BY d2.draw) AS n FROM d2 ANTI JOIN hit USING (img_id, draw)) WHERE n <= 3),
win AS (SELECT *, CAST(row_number() OVER (PARTITION BY img_id ORDER BY y DESC, o) - 1 AS INTEGER) AS nth FROM (SELECT img_id, 1 AS y, o, j, k, h, w FROM good UNION ALL SELECT img_id, -1, draw, j, k, h, w FROM neg)),
cut AS (SELECT win.*, f, j + trunc(h * bj) AS b1, k + trunc(w * bk) AS b2, trunc(h * bh) AS b3, trunc(w * bw) AS b4, j + trunc(h * wj) AS w1, k + trunc(w * wk) AS w2, trunc(h * wh) AS w3, trunc(w * ww) AS w4 FROM win, feat),
e AS (SELECT img_id, list(v ORDER BY j, k) AS p FROM px GROUP BY img_id),
total AS (SELECT c.img_id, nth, y, j, k, h, w, f, b3 * b4 AS area, w3 * w4 AS part,
    list_sum(list_filter(p, lambda v, i: (i - 1) // 8 >= b1 AND (i - 1) // 8 < b1 + b3 AND (i - 1) % 8 >= b2 AND (i - 1) % 8 < b2 + b4)) AS whole,
    list_sum(list_filter(p, lambda v, i: (i - 1) // 8 >= w1 AND (i - 1) // 8 < w1 + w3 AND (i - 1) % 8 >= w2 AND (i - 1) % 8 < w2 + w4)) AS white FROM cut c JOIN e USING (img_id))
SELECT img_id, nth, CAST(y AS INTEGER) AS y, j, k, h, w, CAST(f AS INTEGER) AS f, CAST(CASE WHEN part > 0 AND area > part THEN trunc(white / part - (whole - white) / (area - part)) ELSE 0 END AS DOUBLE) AS value FROM total"""
    )


@query(_examples_sql())
def window_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled feature rows of every image: a target, and three negatives that overlap it by less than half."""
    pictures = images(spark, sf_dir)
    size = (F.col("img_id") % 3 + 3).cast("int")
    targets = pictures.select("img_id", F.lit(0).alias("nth"), (F.col("img_id") % 2).cast("int").alias("j"), (F.col("img_id") % 4).cast("int").alias("k"), size.alias("h"), size.alias("w"))
    rows = builders.examples(pictures, targets, rectangles.catalogue(spark, 2, 2), 3)
    return rows.select("img_id", "nth", F.col("y").cast("int").alias("y"), *"jkhw", F.posexplode("x").alias("f", "value"))


@query(scores_sql(80) + "\nSELECT vec_id, round(score, 6) AS score, CASE WHEN score > 0 THEN 1 ELSE -1 END AS prediction FROM scored")
def score_long_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighty rounds on the embeddings: margins are written down on the way, and the score is folded over a constant."""
    return _scored(spark, sf_dir, 80).select("vec_id", F.round("score", 6).alias("score"), "prediction")


@query(f"WITH {_BOXES_SQL} SELECT box, CAST(round_even(j * 1.5::DOUBLE, 0) AS INTEGER) AS j, CAST(round_even(k * 1.5::DOUBLE, 0) AS INTEGER) AS k, CAST(round_even(h * 1.5::DOUBLE, 0) AS INTEGER) AS h, CAST(round_even(w * 1.5::DOUBLE, 0) AS INTEGER) AS w FROM boxes")
def rescaled_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.rescaled(boxes(spark, sf_dir), 1.5).select("box", *"jkhw")


@query(f"WITH {_BOXES_SQL} SELECT box FROM boxes WHERE j + h <= 180 AND k + w <= 170 AND h / 180 >= 0.15")
def valid_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = boxes(spark, sf_dir).withColumns({"height": F.lit(180), "width": F.lit(170)})
    return detection.valid_targets(sized, 0.15).select("box")


@query(
    f"""WITH {_BOXES_SQL},
img AS (SELECT DISTINCT img_id FROM boxes),
d0 AS (SELECT img_id, draw FROM img, (SELECT unnest(range(0, 400)) AS draw)),
d1 AS (SELECT img_id, draw, CAST(greatest(floor((0.1::DOUBLE + {_u("side")} * 0.4::DOUBLE) * 200), 1) AS INTEGER) AS h FROM d0),
d2 AS (SELECT *, h AS w, CAST(floor({_u("j")} * (200 - h + 1)) AS INTEGER) AS j, CAST(floor({_u("k")} * (200 - h + 1)) AS INTEGER) AS k FROM d1),
hit AS (SELECT DISTINCT d.img_id, d.draw FROM (SELECT a.img_id, a.draw, a.h AS ah, a.w AS aw, b.h AS bh, b.w AS bw, least(a.j + a.h, b.j + b.h) - greatest(a.j, b.j) AS dj, least(a.k + a.w, b.k + b.w) - greatest(a.k, b.k) AS dk
    FROM d2 a JOIN boxes b ON a.img_id = b.img_id) d WHERE dj > 0 AND dk > 0 AND {_IOU_SQL} >= 0.3),
c AS (SELECT d2.*, row_number() OVER (PARTITION BY d2.img_id ORDER BY d2.draw) AS n FROM d2 ANTI JOIN hit USING (img_id, draw))
SELECT img_id, CAST(draw AS INTEGER) AS draw, j, k, h, w FROM c WHERE n <= 5"""
)
def negative_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = boxes(spark, sf_dir)
    pictures = targets.select("img_id").distinct().withColumns({"height": F.lit(200), "width": F.lit(200)})
    return detection.negative_windows(pictures, targets, per_image=5, draws=10, most_iou=0.3)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= round_even(0.75::DOUBLE * (SELECT count(*) FROM orders), 0) AS is_train FROM orders")
def head_tail_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.head_tail_split(table(spark, sf_dir, "orders"), 0.75, "o_orderdate", "o_orderkey").select("o_orderkey", "is_train")


@query("SELECT vec_id % 10 < 9 AS is_train, count(*) AS n FROM embeddings GROUP BY 1")
def fold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detection.fold_split(embeddings(spark, sf_dir), F.col("vec_id") % 10 + 1)
    return rows.groupBy("is_train").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT vec_id, place, floor((floor((x + 1) * 128) + floor(('0x' || substr(md5(CAST(vec_id AS VARCHAR) || '/' || CAST(place AS VARCHAR) || '/7'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE * 256)) / 2)::BIGINT AS v FROM (SELECT vec_id, CAST(unnest(range(0, 64)) AS INTEGER) AS place, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
)
def noisy_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 128)).alias("x"))
    return readers.with_noise(rows, "vec_id", "x", 256, 7).select("vec_id", F.posexplode("x").alias("place", "v"))


# ---- scalar functions ----


@query("SELECT p_partkey, regexp_replace(translate('a' || chr(9) || p_name || '   ' || p_type || chr(10), chr(10) || chr(9), ''), ' +', ' ', 'g') AS name FROM part")
def cleaned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("a\t"), "p_name", F.lit("   "), "p_type", F.lit("\n"))
    return table(spark, sf_dir, "part").select("p_partkey", E.clean_name(raw).alias("name"))


@query(
    """WITH h AS (SELECT c_custkey, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(c_name, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) AS code FROM customer)
SELECT c_custkey, code, lpad(CAST(code % 10000000000 AS VARCHAR), 10, '0') AS padded FROM h"""
)
def name_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", E.polynomial_hash(c).alias("code"), E.experiment_code(c, 10).alias("padded"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


# ---- streams ----


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path if _is_folder(spark, path) else f"{path[: -len('.parquet')]}.parque[t]")


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _streamed(spark: SparkSession, stream: DataFrame) -> DataFrame:
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    streams.run_available(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query(scores_sql(ROUNDS) + "\nSELECT vec_id, 'three' AS model, round(score, 6) AS score, CASE WHEN score > 0 THEN 1 ELSE -1 END AS prediction FROM scored")
def stream_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model fitted on the table scores the same table as a stream of files."""
    scored = streams.score_stream(_stream(spark, sf_dir, "embeddings"), {"three": _model(spark, sf_dir)})
    return _streamed(spark, scored.select("vec_id", "model", F.round("score", 6).alias("score"), "prediction"))


@query(
    f"""WITH {_BOXES_SQL} SELECT CAST(img_id AS VARCHAR) AS image, CAST(row_number() OVER (PARTITION BY img_id ORDER BY box) - 1 AS INTEGER) AS nth, CASE WHEN box % 3 = 0 THEN 'palm' ELSE 'no "}}{{' END AS label,
    k / 200::DOUBLE AS x, j / 200::DOUBLE AS y, w / 200::DOUBLE AS bw, h / 200::DOUBLE AS bh FROM boxes"""
)
def scanned_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of all images as annotations in files of one JSON object each, read back in ranges of 64 kB."""
    folder = f"{shared_dir(spark)}/annotations-{uuid.uuid4().hex}"
    part = lambda c: F.col(c) / F.lit(200.0)
    own = boxes(spark, sf_dir).select("img_id", F.struct("box", F.array(*map(part, "kjwh")).alias("b"), F.when(F.col("box") % 3 == 0, "palm").otherwise('no "}{').alias("l")).alias("v"))
    lists = own.groupBy("img_id").agg(F.array_sort(F.collect_list("v")).alias("v"))  # an image's own boxes
    sinks.save_json_objects(lists.select("img_id", F.to_json(F.struct(F.col("v.b").alias("bboxes"), F.col("v.l").alias("labels"))).alias("a")), "img_id", "a", folder)
    return readers.boxes_of_json(json_entries(spark, f"{folder}/part-*", 65_536), "entry")


@query(
    """WITH px AS (SELECT vec_id // 100 AS frame, vec_id % 100 // 10 * 8 + place // 8 AS j, vec_id % 10 * 8 + place % 8 AS k, CAST(greatest(0, least(255, floor((x + 1) * 128))) AS BIGINT) AS v FROM (SELECT vec_id, unnest(range(0, 64)) AS place, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings))
SELECT frame, CAST(j AS INTEGER) AS j, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (79 - k)) AS BIGINT) AS moment FROM px WHERE v > 0 GROUP BY 1, 2"""
)
def mirrored_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mosaics of the embeddings as picture files that come as a stream of frames, sixteen a batch, mirrored: of each line the sum of
    its pixels, and the sum weighted by their new places."""
    folder = f"{shared_dir(spark)}/frames-{uuid.uuid4().hex}"
    frames.write_frames(readers.mosaics(images(spark, sf_dir), 10, 10), f"{folder}/in")
    stream = frames.frame_stream(spark, f"{folder}/in", 16, mirror=True)
    streams.run_until_quiet(stream, f"{folder}/out", f"{folder}/checkpoint")
    rows = rectangles.pixels(spark.read.schema(stream.schema).parquet(f"{folder}/out").withColumnRenamed("frame", "img_id")).where("v > 0")
    return rows.groupBy(F.col("img_id").alias("frame"), "j").agg(F.sum("v").alias("total"), F.sum(F.col("v").cast("long") * F.col("k")).alias("moment"))


_EMA_SQL = """WITH r AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
s AS (SELECT event_id, event_type, n, list(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 400 PRECEDING AND CURRENT ROW) AS seen FROM r)
SELECT event_id, event_type, round(list_reduce(list_prepend(0.0::DOUBLE, seen), lambda a, x: 0.9::DOUBLE * a + 0.1::DOUBLE * x) / (1 - 0.9::DOUBLE ** n), 6) AS ema FROM s"""


@query(_EMA_SQL)
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.moving_average(table(spark, sf_dir, "events"), "event_type", "event_id", "value")
    return rows.select("event_id", "event_type", F.round("ema", 6).alias("ema"))


@query("SELECT event_type AS key, count(*) AS rows, max(row_number) AS n, round(sum(value), 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS row_number FROM events) GROUP BY 1")
def stream_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that the stateful stream keeps for each key."""
    out = _streamed(spark, streams.moving_average_stream(_stream(spark, sf_dir, "events"), "event_type", "event_id", "value"))
    return out.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


_TOTALS_SQL = _EMA_SQL.replace("SELECT event_id, event_type, value, row_number()", "SELECT event_id, event_type, value, CAST(sum(value) OVER (PARTITION BY event_type ORDER BY event_id) AS DOUBLE) AS total, row_number()").replace("SELECT event_id, event_type, n, list", "SELECT event_id, event_type, n, total, list").replace("SELECT event_id, event_type, round", "SELECT event_id, event_type, n, round(total, 3) AS total, round")


@query(_TOTALS_SQL)
def moving_average_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same averages with numbers and totals of the rows so far, from a stream whose batches are folded in ranges."""
    folder = f"{shared_dir(spark)}/averages-{uuid.uuid4().hex}"
    rows = streams.moving_average_batches(_stream(spark, sf_dir, "events"), "event_type", "event_id", "value", folder)
    return rows.select("event_id", "event_type", "n", F.round("total", 3).alias("total"), F.round("ema", 6).alias("ema"))
