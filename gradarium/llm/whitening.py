"""Whitening of embeddings: an exact distributed covariance, float32 eigenvectors refined by matrix products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradarium.llm.vectors import scaled, width_of

#: The higher precision of the refinement (64 bits of mantissa on common machines), rounds at most, and after how many of
#: them clusters that are still unresolved are rotated.
WIDE, ROUNDS, SUB_SOLVES = np.longdouble, 12, 3
EPS = float(np.finfo(WIDE).eps)


def slices_of(m: np.ndarray, axis: int, bits: int) -> list[np.ndarray]:
    """Doubles of `bits` bits each, on one grid a row (or column), that sum up to m to more than its precision."""
    out, rest = [], m
    for _ in range(1 - (-np.finfo(WIDE).nmant // bits)):
        most = np.abs(rest).max(axis, keepdims=True).astype(np.float64)
        grid = np.exp2(np.floor(np.log2(np.where(most > 0, most, 1.0))) + 1 - bits).astype(WIDE)
        part = np.rint(rest / grid) * grid
        out.append(part.astype(np.float64))
        rest = rest - part
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in the higher precision from products of doubles, each of which is exact: slices have so few bits that their
    sums of products stay within a double's."""
    bits = max(4, (52 - int(np.ceil(np.log2(max(2, a.shape[1]))))) // 2 - 1)
    left, right = slices_of(a, 1, bits), slices_of(b, 0, bits)
    total = np.zeros((a.shape[0], b.shape[1]), WIDE)
    for k in reversed(range(len(left))):  # the smallest first
        for i in range(k + 1):
            total += (left[i] @ right[k - i]).astype(WIDE)
    return total


def refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One iteration of Ogita and Aishima over approximate eigenvectors x of the symmetric a, in products of matrices of
    the higher precision: (corrected x, eigenvalues, which pairs are too close to be told apart, size of the correction)."""
    r = np.eye(len(a), dtype=WIDE) - times(x.T, x)
    s = times(x.T, times(a, x))
    value = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(value)
    norm = lambda m: float(np.sqrt((m.astype(np.float64) ** 2).sum()))
    close = 2 * (norm(off) + norm(a) * norm(r))
    gap = value[None, :] - value[:, None]
    apart = np.abs(gap) > close
    with np.errstate(divide="ignore", invalid="ignore"):
        e = np.where(apart, (s + value[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return x + times(x, e), value, ~apart, norm(e)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as columns) of a symmetric matrix in the higher precision. Starts from float32
    eigenvectors; eigenvalues that stay too close to be told apart form a cluster, and its small matrix, shifted by the
    cluster's mean so that nothing cancels, is solved by itself to rotate the cluster's vectors, which are then refined
    like the others. Vectors of equal eigenvalues are some orthonormal basis."""
    size = float(np.abs(a).max()) if a.size else 0.0
    if not size:
        return np.zeros(len(a), WIDE), np.eye(len(a), dtype=WIDE)
    a = a.astype(WIDE) / WIDE(size)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)[:, ::-1]
    before = np.inf
    for k in range(ROUNDS):
        x, value, close, moved = refined(a, x)
        if moved < 16 * len(a) * EPS or k > SUB_SOLVES and moved > before / 2:
            break
        before = moved
        if k in (1, SUB_SOLVES):
            for group in clusters(value, close):
                x = sub_solved(a, x, group)
    for _ in range(2):  # close pairs may have left each other's right angle: the nearest orthonormal basis
        x = times(x, 1.5 * np.eye(len(a), dtype=WIDE) - times(x.T, x) / 2)
    value = (x * times(a, x)).sum(0) / (x * x).sum(0)
    order = np.argsort(-value, kind="stable")
    return value[order] * WIDE(size), x[:, order] / np.sqrt((x[:, order] ** 2).sum(0))


def clusters(value: np.ndarray, close: np.ndarray) -> list[np.ndarray]:
    """Groups of neighbouring eigenvalues that are linked by `close`, of two at least."""
    order = np.argsort(-value, kind="stable")
    new = np.append(True, ~close[order[1:], order[:-1]])
    return [g for g in np.split(order, np.flatnonzero(new)[1:]) if len(g) > 1]


def sub_solved(a: np.ndarray, x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """x with the vectors of a cluster rotated to the eigenvectors of their own small matrix."""
    own = x[:, group]
    image = times(a, own)
    middle = ((own * image).sum(0) / (own * own).sum(0)).mean()
    small = times(own.T, image - middle * own)
    most = np.abs(small).max()
    if most > 0:
        turn = np.linalg.eigh(((small + small.T) / (2 * most)).astype(np.float64))[1][:, ::-1]
        x = x.copy()
        x[:, group] = times(own, turn.astype(WIDE))
    return x


def wide(value: int) -> np.longdouble:
    """A whole number of any size, rounded once to the higher precision."""
    high = float(value)
    return WIDE(high) + WIDE(float(value - int(high)))


@dataclass
class Whitening:
    """What fit_whitening() found: n rows, whole-number sums of each dimension, the covariance's eigenvalues and vectors, its
    trace; identity_error is filled in by checked()."""

    scale: float
    shift: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def width(self) -> int:
        return len(self.sums)

    def whitened(self, x: np.ndarray, most: int) -> np.ndarray:
        """Rows of whole numbers projected on the first components, over the roots of the eigenvalues; NaN where an
        eigenvalue is not above what rounding leaves of zero."""
        middle = [round(s / self.n) if self.n < 2**53 else s // self.n for s in self.sums]
        rest = np.array([float(WIDE(wide(s - self.n * c)) / WIDE(self.n)) for s, c in zip(self.sums, middle, strict=True)])
        root = np.sqrt(np.where(self.usable[:most], self.values[:most], np.nan).astype(np.float64))
        return ((x - np.array(middle, np.int64)) - rest) @ self.vectors[:, :most].astype(np.float64) / root

    @property
    def usable(self) -> np.ndarray:
        return self.values > self.width * 2.0**-50 * max(float(self.values[0]), 0.0) if self.width else np.zeros(0, bool)


def partial_products(batches: Iterator[pa.RecordBatch], scale: float, shift: int, centre: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(i, j, p) with i <= j: sums of the products of centred whole numbers over a task's rows, exact. Blocks are so short
    that no sum of doubles leaves the whole numbers that doubles hold."""
    width = len(centre)
    total = np.zeros((width, width), np.int64)
    for batch in batches:
        x = scaled(batch.column(0), scale, shift, width)[1] - centre
        most = int(np.abs(x).max(initial=1)) ** 2
        if most >= 2**52:
            raise ValueError("components are too far from their mean for exact products")
        step = max(1, min(4096, 2**52 // most))
        for k in range(0, len(x), step):
            part = x[k : k + step].astype(np.float64)
            total += (part.T @ part).astype(np.int64)
    i, j = np.triu_indices(width)
    yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "p"])


def fit_whitening(rows: DataFrame, vector: str = "embedding", scale: float = 1024.0, shift: int = 100_000) -> Whitening:
    """The covariance (divisor n) of floor(scale * x) + shift over all vectors that take part, and its eigenvectors.

    One pass sums the dimensions; another centres rows at the nearest whole numbers to the means and sums products. Both
    are whole numbers and exact, so the covariance is known as a fraction whatever the partitioning, and is rounded once,
    to the higher precision. Tasks exchange sums, whose number follows the dimensions; the driver sees a matrix of them."""
    held, width = rows.select(vector), width_of(rows, vector)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 1, np.int64)
        for batch in batches:
            x = scaled(batch.column(0), scale, shift, width)[1]
            total += np.append(x.sum(0), len(x))
        yield pa.record_batch([pa.array(np.arange(width + 1, dtype=np.int32)), pa.array(total)], ["i", "s"])

    found = dict(held.mapInArrow(sums, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)"))).collect())
    found = {i: int(s) for i, s in found.items()}
    n, total = found.get(width, 0), [found.get(i, 0) for i in range(width)]
    if not n:
        return Whitening(scale, shift, 0, total, np.zeros(width, WIDE), np.eye(width, dtype=WIDE), 0.0)
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    products = held.mapInArrow(lambda b: partial_products(b, scale, shift, centre), "i int, j int, p long")
    cov = np.zeros((width, width), WIDE)
    off = [s - n * int(c) for s, c in zip(total, centre, strict=True)]
    trace = 0
    for i, j, p in products.groupBy("i", "j").agg(F.sum(F.col("p").cast("decimal(38,0)"))).collect():
        exact = n * int(p) - off[i] * off[j]
        cov[i, j] = cov[j, i] = wide(exact) / WIDE(n) / WIDE(n)
        trace += exact if i == j else 0
    values, vectors = eigen(cov)
    return Whitening(scale, shift, n, total, values, vectors, float(wide(trace) / WIDE(n) / WIDE(n)))


def checked(model: Whitening, rows: DataFrame, vector: str = "embedding", most: int = 8) -> Whitening:
    """The model with identity_error: the largest entry of (covariance of the whitened rows - identity), from a pass of its
    own over all rows; components whose eigenvalue is zero are left out of it."""
    k = min(most, model.width)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = model.whitened(scaled(batch.column(0), model.scale, model.shift, model.width)[1], k)
            w = np.append(np.nan_to_num(w), np.ones((len(w), 1)), 1)
            total += w.T @ w
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], ["i", "j", "p"])

    if model.n:
        total = np.zeros((k + 1, k + 1))
        for i, j, p in rows.select(vector).mapInArrow(moments, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p")).collect():
            total[i, j] = p
        mean = total[:k, k] / model.n
        fine = model.usable[:k]
        error = np.abs(total[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k))[np.ix_(fine, fine)]
        model.identity_error = float(error.max()) if error.size else None
    return model


def whiten(rows: DataFrame, keys: dict[str, Column], vector: str = "embedding", scale: float = 1024.0, shift: int = 100_000, most: int = 8) -> DataFrame:
    """(*keys, component, n, deviation, whitened, explained, identity_error): a row for each vector that takes part and each
    of the first `most` components (all, if the vectors are shorter), numbered from 1 by falling eigenvalue.

    Null vectors, and those with a null or a number that is not finite, take no part; shorter vectors are as if they ended
    in zeros. Keys may be null or repeat: each row is its own. Where an eigenvalue is zero (a dimension without spread,
    fewer rows than components) whitened is null; where all are, explained and identity_error are null as well. deviation
    is null where it does not fit into 64 bits. An empty table, or one of empty vectors, gives no rows. Other columns don't
    matter, whatever their names. Rows are read and never exchanged."""
    model = checked(fit_whitening(rows, vector, scale, shift), rows, vector, most)
    k = min(most, model.width)
    held = rows.select(*[c.alias(n) for n, c in keys.items()], F.col(vector).alias("__v"))
    explained = [float(v / WIDE(model.trace)) if model.trace else None for v in model.values[:k]]

    def deviations(x: np.ndarray) -> pa.Array:
        """Sums of (n x - s)^2, in 64 bits where these suffice."""
        off = [s for s in model.sums]
        most_off = max((abs(model.n * int(v) - s) for row in (x.max(0), x.min(0)) for v, s in zip(row, off, strict=True)), default=0)
        if most_off**2 * len(off) < 2**62 and max(map(abs, off)) < 2**62:
            d = x * model.n - np.array(off, np.int64)
            return pa.array((d * d).sum(1))
        exact = [sum((model.n * int(v) - s) ** 2 for v, s in zip(row, off, strict=True)) for row in x]
        return pa.array([d if d < 2**63 else None for d in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = scaled(batch.column(batch.num_columns - 1), scale, shift, model.width)
            kept, m = batch.filter(pa.array(good)), len(x)
            if not m:
                continue
            again = pa.array(np.repeat(np.arange(m), k))
            white = model.whitened(x, k).ravel()
            out = [c.take(again) for c in kept.columns[:-1]]
            out += [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), deviations(x).take(again), pa.array(white, mask=np.isnan(white))]
            out += [pa.array(explained * m, pa.float64()), pa.array([model.identity_error] * (m * k), pa.float64())]
            yield pa.RecordBatch.from_arrays(out, schema.names)

    extra = {"component": F.lit(1), "n": F.lit(1).cast("long"), "deviation": F.lit(None).cast("long"), "whitened": F.lit(None).cast("double"), "explained": F.lit(None).cast("double"), "identity_error": F.lit(None).cast("double")}
    schema = held.drop("__v").select("*", *[c.alias(n) for n, c in extra.items()]).schema
    return held.where(F.lit(k > 0 and model.n > 0)).mapInArrow(run, schema)
