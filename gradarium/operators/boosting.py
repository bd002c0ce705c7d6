"""Real AdaBoost over clipped half log-odds in bins: one Spark job a round, the model a small table."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradarium.functions.expressions import bin_of, logit
from gradarium.functions.ordering import written
from gradarium.operators.binning import STATE_SCHEMA, bin_state, feature_rows, find_ranges
from gradarium.operators.selection import matrix_of

#: A round's choice: argmin of the error, then of the feature's number. Sums of doubles in another order differ behind
#: so many digits, so features that hold the same tie there.
TIE_DIGITS = 13
#: Rounds after which the margin is written down, so that expressions stay short.
CUT = 16
MODEL_SCHEMA = "t int, j int, lo double, hi double, err double, logits array<double>"


def histogram(state: DataFrame, n_features: int, n_bins: int, since: list[tuple[int, list[float]]] | None = None, log_norm: float = 0.0) -> DataFrame:
    """(j, b, wp, wn): weights of both classes in each bin of each feature, of a table made by bin_state. Weights are
    exp(-y * margin - log_norm), the margin being that of the table plus the responses `since` (feature, logits).

    Each task counts its rows into one array of features x bins x classes, whatever their number; only these partial
    histograms are exchanged, so rows are never multiplied by features."""
    since, size = since or [], 2 * n_features * n_bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        place = np.arange(n_features, dtype=np.int64) * 2 * n_bins
        for y, margin, bins in state_arrays(batches, n_features):
            w = np.exp(-y * with_responses(margin, bins, since) - log_norm)
            step = max(1, 2_000_000 // n_features)
            for k in range(0, len(y), step):
                cell = bins[k : k + step] + place + (y[k : k + step] > 0)[:, None] * n_bins
                total += np.bincount(cell.ravel(), np.repeat(w[k : k + step], n_features), size)
        wn, wp = total.reshape(n_features, 2, n_bins).transpose(1, 0, 2)
        j, b = np.nonzero(wn + wp)
        yield pa.record_batch([pa.array(j.astype(np.int32)), pa.array(b.astype(np.int8)), pa.array(wp[j, b]), pa.array(wn[j, b])], ["j", "b", "wp", "wn"])

    parts = state.mapInArrow(run, "j int, b tinyint, wp double, wn double")
    return parts.groupBy("j", "b").agg(F.sum("wp").alias("wp"), F.sum("wn").alias("wn"))


def state_arrays(batches: Iterator[pa.RecordBatch], n_features: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(y, margin, bins as a matrix) of batches of bin_state's rows."""
    for batch in batches:
        if batch.num_rows:
            y, margin, bins = (batch.column(batch.schema.get_field_index(c)) for c in ("y", "margin", "bins"))
            raw = np.frombuffer(bins.buffers()[2], np.uint8)
            first = np.frombuffer(bins.buffers()[1], np.int32)[bins.offset]
            yield y.to_numpy().astype(np.float64), margin.to_numpy(), raw[first : first + len(y) * n_features].reshape(len(y), n_features)


def with_responses(margin: np.ndarray, bins: np.ndarray, since: list[tuple[int, list[float]]]) -> np.ndarray:
    for j, logits in since:
        margin = margin + np.asarray(logits)[bins[:, j]]
    return margin


def moved_on(state: DataFrame, n_features: int, since: list[tuple[int, list[float]]]) -> DataFrame:
    """The table with the responses added to its margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, margin, bins in state_arrays([batch], n_features):
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(with_responses(margin, bins, since))], ["y", "bins", "margin"])

    return state.select("y", "bins", "margin").mapInArrow(run, STATE_SCHEMA)


def feature_errors(hist: DataFrame, logit_max: float, n_bins: int) -> DataFrame:
    """(j, err, logits): the exponential error of each feature in closed form from its histogram. A bin without rows
    has response 0."""
    cells = hist.withColumn("l", logit(F.col("wp"), F.col("wn"), logit_max))
    err = F.sum(F.col("wp") * F.exp(-F.col("l")) + F.col("wn") * F.exp(F.col("l"))).alias("err")
    found = F.map_from_entries(F.collect_list(F.struct(F.col("b").cast("int"), "l")))
    by_feature = cells.groupBy("j").agg(err, found.alias("m"))
    return by_feature.select("j", "err", F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0.0))).alias("logits"))


def best_feature(errors: DataFrame) -> DataFrame:
    """The row of least error; of equal ones the feature that comes first."""
    best = errors.agg(F.min(F.struct(F.round("err", TIE_DIGITS).alias("e"), "j", "err", "logits")).alias("s"))
    return best.where("s is not null").select(F.col("s.j").alias("j"), F.col("s.err").alias("err"), F.col("s.logits").alias("logits"))


def best_of_histogram(cells: pa.Table, logit_max: float, n_bins: int) -> tuple[int, float, list[float]]:
    """best_feature(feature_errors(..)) of a histogram that the driver holds: features x bins numbers, however many
    rows it counts. It saves a round two exchanges of next to no data."""
    j, b, wp, wn = (cells.column(c).to_numpy() for c in ("j", "b", "wp", "wn"))
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = np.clip(0.5 * np.log(wp / wn), -logit_max, logit_max)
    l = np.where(wp == wn, 0.0, np.where(wp <= 0, -logit_max, np.where(wn <= 0, logit_max, inner)))  # noqa: E741
    err = np.bincount(j, wp * np.exp(-l) + wn * np.exp(l))
    best = int(np.argmin(np.round(err, TIE_DIGITS)))
    logits = np.zeros(n_bins)
    logits[b[j == best]] = l[j == best]
    return best, float(err[best]), logits.tolist()


def chosen(values: list[float], place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, map(float, values))), place.cast("int") + 1)


@dataclass
class BoostedBins:
    """Settings. fit() makes a BoostedModel."""

    rounds: int = 256
    n_bins: int = 8
    outliers_ratio: float = 0.05
    logit_max: float = 2.0

    def __post_init__(self) -> None:
        for fine, said in ((self.rounds >= 1, "rounds must be 1 or more"), (1 <= self.n_bins <= 32, "n_bins must be from 1 to 32"), (0 <= self.outliers_ratio <= 0.25, "outliers_ratio must be from 0 to 0.25"), (0 < self.logit_max <= 8, "logit_max must be above 0 and at most 8")):
            if not fine:
                raise ValueError(said)

    def fit(self, df: DataFrame, label: Column | str, features: list[str] | str) -> BoostedModel:
        """Ranges, bins (written once), then the rounds. Only ranges and histograms reach the driver: their size is that
        of the model's inputs, features x bins, not of the data. A round is one pass over the bins, a byte each. df itself is
        read about seven times, so write it down first where its features are dear to compute."""
        rows, classes = feature_rows(df, label, features)
        ranges = find_ranges(rows, self.outliers_ratio)
        n = len(ranges)
        state = written(bin_state(rows, ranges, self.n_bins))
        m = state.count()
        by_j = {j: (lo, hi) for j, lo, hi in ranges}
        names = features if isinstance(features, list) else [f"{features}[{j}]" for j in range(n)]
        settings = asdict(self) | {"rows": m, "features": n}
        model = BoostedModel(rows=[], classes=classes, features=names, array_column=features if isinstance(features, str) else None, n_bins=self.n_bins, settings=settings)
        # weights are exp(-y * margin) / (m * product of errors): the margin is kept, never the weights
        log_norm, since = math.log(m), []
        for t in range(self.rounds):
            if len(since) == CUT:
                state, since = written(moved_on(state, n, since)), []
            j, err, logits = best_of_histogram(histogram(state, n, self.n_bins, since, log_norm).toArrow(), self.logit_max, self.n_bins)
            model.rows.append((t, j, *map(float, by_j[j]), err, logits))
            since.append((j, logits))
            log_norm += math.log(err)
        return model


@dataclass
class BoostedModel:
    """rows: (t, j, lo, hi, err, logits). The first t rounds are a model of their own."""

    rows: list[tuple]
    classes: list
    features: list[str]
    array_column: str | None
    n_bins: int
    threshold: float = 0.0
    settings: dict = field(default_factory=dict)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, MODEL_SCHEMA)

    def describe(self, verbose: bool = False) -> str:
        """The estimator's settings and what was fitted, as text; verbose adds a line for each round."""
        s = {k: v for k, v in self.settings.items() if k in BoostedBins.__dataclass_fields__}
        lines = [f"BoostedBins({', '.join(f'{k}={v}' for k, v in s.items())})", f"classes {self.classes}, features {len(self.features)}, distinct selected {len({r[1] for r in self.rows})}, rounds {len(self.rows)}, threshold {self.threshold}"]
        if verbose:
            lines += [f"round {t}: {self.features[j]} in [{lo}, {hi}], error {err:.6g}, logits {[round(v, 4) for v in logits]}" for t, j, lo, hi, err, logits in self.rows]
        return "\n".join(lines)

    def truncated(self, rounds: int) -> BoostedModel:
        if not 1 <= rounds <= len(self.rows):
            raise ValueError("rounds must be from 1 to the model's rounds")
        return replace(self, rows=self.rows[:rounds])

    def _value(self, j: int) -> Column:
        return F.element_at(F.col(self.array_column), j + 1) if self.array_column else F.col(self.features[j])

    def score(self) -> Column:
        """Sum of the chosen responses. It reads the selected features only. Up to 64 rounds are an expression each;
        more are folded over one constant array, so the plan stays small."""
        if len(self.rows) <= 64:
            total = F.lit(0.0)
            for _, j, lo, hi, _, logits in self.rows:
                total = total + chosen(logits, bin_of(self._value(j), lo, hi, self.n_bins))
            return total
        used = sorted({r[1] for r in self.rows})
        x = F.array(*[self._value(j).cast("double") for j in used])
        steps = [{"i": used.index(r[1]) + 1, "lo": r[2], "hi": r[3], "l": r[5]} for r in self.rows]
        constant = F.from_json(F.lit(json.dumps(steps)), "array<struct<i:int,lo:double,hi:double,l:array<double>>>")
        return F.transform(F.array(x), lambda v: F.aggregate(constant, F.lit(0.0), lambda s, m: s + F.element_at(m["l"], bin_of(F.element_at(v, m["i"]), m["lo"], m["hi"], self.n_bins) + 1)))[0]

    def transform(self, df: DataFrame) -> DataFrame:
        """df with score and prediction: the greater class where the score is above the threshold. Works on streams."""
        missing = set([self.array_column] if self.array_column else self.features) - set(df.columns)
        if missing:
            raise ValueError(f"features are missing: {sorted(missing)}")
        scored = df.withColumn("score", self.score())
        return scored.withColumn("prediction", F.when(F.col("score") > self.threshold, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0])))

    def staged(self, df: DataFrame, stages: list[int]) -> DataFrame:
        """df with scores array<double>: the score after each number of rounds in `stages`, in one pass over the selected
        features, equal to truncated(t).score() for each t."""
        cut = self._stages(stages)
        names = [*df.columns, "scores"]
        used = self._used()
        rows = df.withColumn("__x", F.array(*[self._value(j).cast("double") for j in used]))
        schema = df.withColumn("scores", F.array().cast("array<double>")).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = batch.num_rows
                scores = self.running_scores(matrix_of(batch.column(batch.num_columns - 1), len(used)), cut)
                values = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * len(cut), pa.int32()), pa.array(scores.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], names)

        return rows.mapInArrow(run, schema)

    def staged_figures(self, df: DataFrame, y: Column | str, stages: list[int]) -> DataFrame:
        """(rounds, m, accuracy, sensitivity, far) of df for the models of so many rounds each, in one pass: tasks count
        hits of both classes at every stage, and only these counts are exchanged. y is -1 or 1, a null y is not counted."""
        cut, used = self._stages(stages), self._used()
        rows = df.select((F.col(y) if isinstance(y, str) else y).cast("int").alias("y"), F.array(*[self._value(j).cast("double") for j in used]).alias("x")).where("y is not null")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((4, len(cut)), np.int64)
            for batch in batches:
                positive = batch.column(0).to_numpy() > 0
                above = self.running_scores(matrix_of(batch.column(1), len(used)), cut) > self.threshold
                total += np.stack([above[positive].sum(0), (~above[~positive]).sum(0), np.full(len(cut), positive.sum()), np.full(len(cut), (~positive).sum())])
            yield pa.record_batch([pa.array(np.array(cut, np.int32)), *[pa.array(t) for t in total]], ["rounds", "tp", "tn", "p", "n"])

        counts = rows.mapInArrow(run, "rounds int, tp long, tn long, p long, n long").groupBy("rounds").agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "p", "n")])
        share = lambda a, b: F.when(b > 0, a / b)
        return counts.select("rounds", (F.col("p") + F.col("n")).alias("m"), share(F.col("tp") + F.col("tn"), F.col("p") + F.col("n")).alias("accuracy"), share(F.col("tp"), F.col("p")).alias("sensitivity"), share(F.col("n") - F.col("tn"), F.col("n")).alias("far"))

    def _stages(self, stages: list[int]) -> list[int]:
        if not stages or min(stages) < 1 or max(stages) > len(self.rows):
            raise ValueError("stages must be from 1 to the model's rounds")
        return sorted(set(stages))

    def _used(self) -> list[int]:
        return sorted({r[1] for r in self.rows})

    def running_scores(self, x: np.ndarray, stages: list[int]) -> np.ndarray:
        """(rows x stages) of the values x of the selected features, in the order of their numbers: rounds are added one
        after the other, so a stage has the very sum that a shorter model has."""
        used = self._used()
        score, out = np.zeros(len(x)), np.empty((len(x), len(stages)))
        for t in range(stages[-1]):
            _, j, lo, hi, _, logits = self.rows[t]
            with np.errstate(invalid="ignore"):
                place = np.floor(self.n_bins * (x[:, used.index(j)] - lo) / (hi - lo)) if hi > lo else np.zeros(len(x))
            score += np.array(logits)[np.clip(place, 0, self.n_bins - 1).astype(np.int64)]
            if t + 1 in stages:
                out[:, stages.index(t + 1)] = score
        return out

    def with_threshold(self, threshold: float) -> BoostedModel:
        return replace(self, threshold=float(threshold))

    # ---- storage ----

    def save(self, spark: SparkSession, path: str) -> None:
        """One row of JSON that any reader of text can open."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedModel:
        held = json.loads(spark.read.text(path).first()[0])
        held["rows"] = [tuple(r) for r in held["rows"]]
        return cls(**held)
