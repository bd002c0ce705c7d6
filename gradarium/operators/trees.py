"""Gradient boosted trees over binned features, grown leaf by leaf: the comparator of the boosted bins."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradarium.functions.ordering import written
from gradarium.operators.binning import STATE_SCHEMA, bin_state, feature_rows, find_ranges
from gradarium.operators.boosting import state_arrays
from gradarium.operators.selection import matrix_of

#: Trees after which margins are written down; cells of histograms that one pass may ask for; gains that differ by a
#: smaller share are ties.
CUT, CELLS, TIE = 16, 2**22, 1e-10


@dataclass
class Tree:
    """Nodes from 0, the root: rows whose bin of the feature is `cut` or less go left; a leaf has feature -1 and a value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        left = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, left, left + 1
        for _ in range(2):
            for column, start in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
                column.append(start)
        return left, left + 1

    def leaves_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row: all rows go down one level at a time."""
        feature, cut, left, right = (np.array(c) for c in (self.feature, self.cut, self.left, self.right))
        node = np.zeros(len(bins), np.int64)
        moving = np.arange(len(bins)) if feature[0] >= 0 else np.zeros(0, np.int64)
        while len(moving):
            at = node[moving]
            node[moving] = np.where(bins[moving, feature[at]] <= cut[at], left[at], right[at])
            moving = moving[feature[node[moving]] >= 0]
        return node

    def responses(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves_of(bins)]


def node_histograms(state: DataFrame, width: int, n_bins: int, since: list[Tree], tree: Tree, wanted: list[tuple[int, int, int, bool]]) -> list[np.ndarray]:
    """For each wanted (leaf, feature, cut, left) the sums (3, features, bins) of gradients, curvatures and rows over those
    rows of a leaf that would go to that side of a split; a feature of -1 means the whole leaf. The margin is that of the
    table and of the trees since. Tasks add up arrays whose size doesn't depend on their rows; only these are exchanged."""
    size = width * n_bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(wanted), 3, size))
        place = np.arange(width, dtype=np.int64) * n_bins
        for y, margin, bins in state_arrays(batches, width):
            for t in since:
                margin = margin + t.responses(bins)
            p = 1 / (1 + np.exp(-margin))
            g, h, leaf = p - (y > 0), p * (1 - p), tree.leaves_of(bins)
            for k, (node, feature, cut, left) in enumerate(wanted):
                mine = np.flatnonzero((leaf == node) & ((bins[:, feature] <= cut) == left) if feature >= 0 else leaf == node)
                step = max(1, 2_000_000 // width)
                for a in range(0, len(mine), step):
                    rows = mine[a : a + step]
                    cell = (bins[rows] + place).ravel()
                    total[k] += [np.bincount(cell, np.repeat(w[rows], width), size) for w in (g, h, np.ones(len(y)))]
        k, cell = np.nonzero(total[:, 2])
        yield pa.record_batch([pa.array(k.astype(np.int32)), pa.array(cell.astype(np.int32)), *[pa.array(total[k, c, cell]) for c in range(3)]], ["k", "cell", "g", "h", "c"])

    parts = state.mapInArrow(run, "k int, cell int, g double, h double, c double")
    found = parts.groupBy("k", "cell").agg(*[F.sum(c).alias(c) for c in "ghc"]).toArrow()
    out = np.zeros((len(wanted), 3, size))
    for c, name in enumerate("ghc"):
        out[found.column("k").to_numpy(), c, found.column("cell").to_numpy()] = found.column(name).to_numpy()
    return list(out.reshape(len(wanted), 3, width, n_bins))


@dataclass
class Leaf:
    """A node that can still be split, its histogram and its best split."""

    node: int
    hist: np.ndarray
    gain: float = 0.0
    feature: int = -1
    cut: int = 0
    children: tuple[np.ndarray, np.ndarray] | None = None

    def choose(self, l2: float, least_rows: int) -> Leaf:
        """The split of greatest gain; of ties the first feature, then the first cut."""
        low = self.hist.cumsum(2)[:, :, :-1]
        whole = self.hist[:, :1].sum(2, keepdims=True)
        high = whole - low
        worth = lambda s: s[0] ** 2 / (s[1] + l2)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((low[2] >= least_rows) & (high[2] >= least_rows), worth(low) + worth(high) - worth(whole), 0.0)
        best = float(gain.max(initial=0.0))
        if best > 1e-12:
            first = int(np.flatnonzero(gain.ravel() >= best * (1 - TIE))[0])
            self.gain, (self.feature, self.cut) = best, map(int, divmod(first, gain.shape[1]))
        return self

    def smaller(self) -> tuple[int, int, int, bool]:
        """What to count: the side of the split that has fewer rows."""
        left = self.hist[2, self.feature, : self.cut + 1].sum()
        return self.node, self.feature, self.cut, bool(2 * left <= self.hist[2, self.feature].sum())


@dataclass
class LeafwiseTrees:
    """Settings. fit() makes a TreeModel by Newton steps on the logistic loss."""

    rounds: int = 100
    leaves: int = 31
    n_bins: int = 32
    learning_rate: float = 0.1
    l2: float = 1.0
    least_rows: int = 20
    outliers_ratio: float = 0.05

    def __post_init__(self) -> None:
        for fine, said in ((self.rounds >= 1, "rounds must be 1 or more"), (self.leaves >= 2, "leaves must be 2 or more"), (2 <= self.n_bins <= 256, "n_bins must be from 2 to 256"), (self.learning_rate > 0, "learning_rate must be above 0"), (self.l2 >= 0, "l2 must be 0 or more"), (self.least_rows >= 1, "least_rows must be 1 or more")):
            if not fine:
                raise ValueError(said)

    def fit(self, df: DataFrame, label: Column | str, features: list[str] | str) -> TreeModel:
        """Ranges and bins as for the boosted bins, then the trees. The leaf of greatest gain is split next. A pass counts,
        for every leaf that may be split next, the smaller side of its split; the other side is the leaf's histogram less
        that. So a tree takes about as many passes as it has levels, and rows of larger sides are not counted at all."""
        rows, classes = feature_rows(df, label, features)
        ranges = find_ranges(rows, self.outliers_ratio)
        width = len(ranges)
        state = written(bin_state(rows, ranges, self.n_bins))
        counts = dict(state.groupBy("y").count().collect())
        start = float(np.log(counts[1] / counts[-1]))
        trees: list[Tree] = [Tree(value=[start])]
        since = [*trees]
        for _ in range(self.rounds):
            if len(since) > CUT:
                state, since = written(_moved_on(state, width, since)), []
            trees.append(self._grown(state, width, since))
            since.append(trees[-1])
        names = features if isinstance(features, list) else [f"{features}[{j}]" for j in range(width)]
        used = sorted({f for t in trees for f in t.feature if f >= 0})
        return TreeModel(trees, {j: ranges[j][1:] for j in used}, classes, names, features if isinstance(features, str) else None, self.n_bins, asdict(self))

    def _grown(self, state: DataFrame, width: int, since: list[Tree]) -> Tree:
        tree, most = Tree(), max(1, CELLS // (width * self.n_bins))
        leaves = [Leaf(0, node_histograms(state, width, self.n_bins, since, tree, [(0, -1, 0, True)])[0]).choose(self.l2, self.least_rows)]
        while len(leaves) < self.leaves:
            able = sorted((x for x in leaves if x.gain > 0), key=lambda x: -x.gain)
            if not able:
                break
            best = min((x for x in able if x.gain >= able[0].gain * (1 - TIE)), key=lambda x: x.node)
            if best.children is None:  # count for all that may come next
                near = [best, *[x for x in able if x.children is None and x is not best]][: min(most, self.leaves - len(leaves))]
                for x, own in zip(near, node_histograms(state, width, self.n_bins, since, tree, [x.smaller() for x in near]), strict=True):
                    x.children = (own, x.hist - own) if x.smaller()[3] else (x.hist - own, own)
            nodes = tree.split(best.node, best.feature, best.cut)
            leaves.remove(best)
            leaves += [Leaf(n, h).choose(self.l2, self.least_rows) for n, h in zip(nodes, best.children, strict=True)]
        for x in leaves:
            g, h, _ = x.hist[:, 0].sum(1)
            tree.value[x.node] = float(-g / (h + self.l2) * self.learning_rate) if h + self.l2 > 0 else 0.0
        return tree


def _moved_on(state: DataFrame, width: int, since: list[Tree]) -> DataFrame:
    """The table with the trees' responses added to its margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, margin, bins in state_arrays([batch], width):
                for t in since:
                    margin = margin + t.responses(bins)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(margin)], ["y", "bins", "margin"])

    return state.select("y", "bins", "margin").mapInArrow(run, STATE_SCHEMA)


@dataclass
class TreeModel:
    """Trees, the first of which is a constant, and the ranges of the features that they use."""

    trees: list[Tree]
    ranges: dict[int, tuple[float, float]]
    classes: list
    features: list[str]
    array_column: str | None
    n_bins: int
    settings: dict = field(default_factory=dict)

    def bins_of(self, x: np.ndarray) -> np.ndarray:
        """Bins of the used features, at the places of their numbers (others are left out of the matrix's rows)."""
        lo, hi = (np.array([self.ranges[j][k] for j in self.ranges]) for k in (0, 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            place = np.floor(self.n_bins * (x - lo) / (hi - lo))
        out = np.zeros((len(x), max(self.ranges, default=0) + 1), np.uint8)
        out[:, list(self.ranges)] = np.where(hi > lo, np.clip(place, 0, self.n_bins - 1), 0)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """df with score, the log odds of the greater class, and prediction. Works on streams; only used features are read."""
        used = list(self.ranges)
        value = lambda j: F.element_at(self.array_column, j + 1) if self.array_column else F.col(self.features[j])
        rows = df.withColumn("__x", F.array(*[value(j).cast("double") for j in used]).cast("array<double>"))
        schema = df.withColumn("score", F.lit(0.0)).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = self.bins_of(matrix_of(batch.column(batch.num_columns - 1), len(used)))
                score = np.sum([t.responses(bins) for t in self.trees], 0)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], schema.names)

        scored = rows.mapInArrow(run, schema)
        return scored.withColumn("prediction", F.when(F.col("score") > 0, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0])))

    def save(self, spark: SparkSession, path: str) -> None:
        """One row of JSON that any reader of text can open."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeModel:
        held = json.loads(spark.read.text(path).first()[0])
        held["trees"] = [Tree(**t) for t in held["trees"]]
        held["ranges"] = {int(j): tuple(r) for j, r in held["ranges"].items()}
        return cls(**held)
