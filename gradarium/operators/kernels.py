"""Rectangle features of whole images in numpy: what tasks do with the images of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Window starts and rounds that are looked at together: their corner sums stay in a core's cache.
WINDOWS, STEP = 2048, 16
#: Values of features that have their responses looked up; images of more than 8 bits are binned by the formula.
GRAY = 255


def images_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray | None]]:
    """(row, image as a matrix or None) of a batch with h, w and pixels by rows. A null or empty image is None; null
    pixels, or a number of them other than h * w, are refused."""
    h, w, pixels = (batch.column(batch.schema.get_field_index(c)) for c in ("h", "w", "pixels"))
    for i in range(batch.num_rows):
        size = len(pixels[i].values) if pixels[i].is_valid else 0
        if not size:
            yield i, None
            continue
        values, shape = pixels[i].values, (h[i].as_py(), w[i].as_py())
        if None in shape or shape[0] * shape[1] != size or values.null_count:
            raise ValueError(f"an image of {shape[0]} x {shape[1]} has {size} pixels, {values.null_count} of them null")
        yield i, values.to_numpy().reshape(shape)


def integral(image: np.ndarray) -> np.ndarray:
    """Sums of all pixels above and left of each place, with a row and a column of zeros before them: (h + 1) x (w + 1)."""
    most = int(np.abs(image).max(initial=0)) * image.size
    out = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.int32 if most < 2**31 else np.int64)
    np.cumsum(image, 0, dtype=out.dtype, out=out[1:, 1:])
    np.cumsum(out[1:, 1:], 1, out=out[1:, 1:])
    return out


def blended(n: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of `to` places along n pixels the two pixels around its centre, and the share of the second."""
    at = np.clip((np.arange(to) + 0.5) * (n / to) - 0.5, 0, n - 1)
    low = np.minimum(at.astype(np.int64), max(n - 2, 0))
    return low, np.minimum(low + 1, n - 1), at - low


def resized(image: np.ndarray, height: int, width: int, kind: str = "linear") -> np.ndarray:
    """The image at another size, one axis after the other. linear: each place blends the two pixels around its centre, the
    border going on; area: the mean over what a place covers, for smaller images."""
    out = image.astype(np.float64)
    for axis, to in ((0, height), (1, width)):
        n = out.shape[axis]
        if kind == "linear":
            low, high, share = blended(n, to)
            share = share[:, None] if axis == 0 else share
            out = out.take(low, axis) * (1 - share) + out.take(high, axis) * share
        elif kind == "area":
            sums = np.insert(out.cumsum(axis), 0, 0, axis)
            edge = np.arange(to + 1) * n / to
            low = np.minimum(edge.astype(np.int64), n - 1)
            share = (edge - low)[:, None] if axis == 0 else edge - low
            out = np.diff(sums.take(low, axis) * (1 - share) + sums.take(low + 1, axis) * share, axis=axis) * (to / n)
        else:
            raise ValueError("kind must be linear or area")
    return out


def turned(image: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned counter-clockwise about its centre, in a frame that holds all of it; places outside are 0. Each
    place is looked up in the image, between its four neighbours."""
    h, w = image.shape
    angle = np.deg2rad(degrees)
    cos, sin = (np.rint(v) if abs(v - np.rint(v)) < 1e-12 else v for v in (np.cos(angle), np.sin(angle)))
    height, width = (int(np.ceil(v - 1e-9)) for v in (abs(h * cos) + abs(w * sin), abs(w * cos) + abs(h * sin)))
    y, x = np.arange(height)[:, None] - (height - 1) / 2, np.arange(width)[None, :] - (width - 1) / 2
    j, k = y * cos + x * sin + (h - 1) / 2, x * cos - y * sin + (w - 1) / 2
    padded = np.zeros((h + 2, w + 2))
    padded[1:-1, 1:-1] = image
    inside = (j > -1) & (j < h) & (k > -1) & (k < w)
    j, k = np.where(inside, j, 0) + 1, np.where(inside, k, 0) + 1
    a, b = np.floor(j + 1e-9).astype(np.int64), np.floor(k + 1e-9).astype(np.int64)
    u, v = np.maximum(j - a, 0), np.maximum(k - b, 0)
    near = lambda r, c: padded[np.minimum(r, h + 1), np.minimum(c, w + 1)]
    value = (near(a, b) * (1 - v) + near(a, b + 1) * v) * (1 - u) + (near(a + 1, b) * (1 - v) + near(a + 1, b + 1) * v) * u
    return np.where(inside, value, 0.0)


#: Stencils whose weights add up to 1: a place and its eight neighbours.
SHARPER = np.array([[0.0, -1.0, 0.0], [-1.0, 5.0, -1.0], [0.0, -1.0, 0.0]])
SOFTER = np.full((3, 3), 1 / 9)


def stencilled(image: np.ndarray, stencil: np.ndarray) -> np.ndarray:
    """Each place as the weighted sum of what is around it; beyond the border the image is mirrored, without its edge line
    twice (a single line stands for itself)."""
    a, b = (n // 2 for n in stencil.shape)
    j, k = ([abs(i) if n > 1 else 0 for i in range(-r, n + r)] for n, r in ((image.shape[0], a), (image.shape[1], b)))
    fold = lambda i, n: np.array([min(v, 2 * (n - 1) - v) if n > 1 else 0 for v in i]).clip(0)
    wide = image.astype(np.float64)[np.ix_(fold(j, image.shape[0]), fold(k, image.shape[1]))]
    return np.einsum("jkab,ab->jk", np.lib.stride_tricks.sliding_window_view(wide, stencil.shape), stencil)


def corners(box: np.ndarray, stride: int) -> np.ndarray:
    """The four flat offsets of boxes (j, k, height, width) in an integral image of so many columns: their sum is
    a - b - c + d."""
    j, k, h, w = np.moveaxis(np.asarray(box, np.int64), -1, 0)
    return np.stack([(j + h) * stride + k + w, j * stride + k + w, (j + h) * stride + k, j * stride + k])


def usable(bg: np.ndarray, white: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(areas of the white and of the black part, where both are above zero); 1 where they are not."""
    area, part = bg[..., 2] * bg[..., 3], white[..., 2] * white[..., 3]
    fine = (part > 0) & (area > part)
    return np.where(fine, part, 1), np.where(fine, area - part, 1), fine


def values_at(flat: np.ndarray, start: np.ndarray, bg: np.ndarray, white: np.ndarray, part: np.ndarray, rest: np.ndarray, fine: np.ndarray) -> np.ndarray:
    """The features' values in windows that begin at flat places: whole numbers, mean of the white part less mean of the
    black one, cut towards zero. bg and white are corner offsets (4, features, 1 or windows)."""
    total = lambda c: flat[start + c[0]] - flat[start + c[1]] - flat[start + c[2]] + flat[start + c[3]]
    whole, lit = total(bg), total(white)
    return np.where(fine, (lit / part - (whole - lit) / rest).astype(np.int32), 0)


def window_values(ii: np.ndarray, windows: np.ndarray, unit_bg: np.ndarray, unit_white: np.ndarray) -> np.ndarray:
    """(windows x features) values of features given by boxes in the unit square, in windows (j, k, height, width)."""
    out, flat, stride = np.empty((len(windows), len(unit_bg))), ii.ravel(), ii.shape[1]
    shapes, of = np.unique(windows[:, 2:], axis=0, return_inverse=True)
    for k, (h, w) in enumerate(shapes):  # boxes are cut once for each size
        side = np.array([h, w, h, w], np.float64)
        bg, white = (unit_bg * side).astype(np.int64), (unit_white * side).astype(np.int64)
        part, rest, fine = (c[:, None] for c in usable(bg, white))
        mine = np.flatnonzero(of == k)
        start = windows[mine, 0] * stride + windows[mine, 1]
        step = max(1, 2**19 // max(1, len(mine)))
        for a in range(0, len(unit_bg), step):
            b = slice(a, a + step)
            out[mine, b] = values_at(flat, start, corners(bg[b], stride)[..., None], corners(white[b], stride)[..., None], part[b], rest[b], fine[b]).T
    return out


class Cascade:
    """A boosted model over windows of several scales: rounds (box, lo, hi, logits), and for each scale (s, h, w, dj, dk) the
    boxes bg and white of its rounds, cut to whole pixels."""

    def __init__(self, scales: list[tuple[int, int, int, int, int]], bg: np.ndarray, white: np.ndarray, lo: np.ndarray, hi: np.ndarray, logits: np.ndarray, threshold: float):
        self.scales, self.bg, self.white, self.threshold = scales, bg, white, threshold
        self.lo, self.hi, self.logits = lo[:, None], hi[:, None], logits
        best = logits.max(1)
        #: What all rounds from the k-th on can still add to a score.
        self.still = np.append(np.cumsum(best[::-1])[::-1], 0.0)
        self.table = self.responses(np.arange(-GRAY, GRAY + 1)[None, :].repeat(len(lo), 0), slice(None))

    def responses(self, value: np.ndarray, rounds: slice) -> np.ndarray:
        lo, hi, n = self.lo[rounds], self.hi[rounds], self.logits.shape[1]
        with np.errstate(divide="ignore", invalid="ignore"):
            place = np.floor(n * (value - lo) / (hi - lo))
        place = np.where(hi > lo, np.clip(place, 0, n - 1), 0).astype(np.int64)
        return np.take_along_axis(self.logits[rounds], place, 1)

    def detected(self, ii: np.ndarray, gray: bool) -> tuple[np.ndarray, np.ndarray]:
        """(windows (s, j, k, h, w), scores) above the threshold, in the order of scale, row and column.

        Rounds are added in their order, some at a time; a window is left as soon as the greatest responses of all rounds
        to come could not lift it above the threshold. Those that remain have their whole score."""
        height, width, stride = ii.shape[0] - 1, ii.shape[1] - 1, ii.shape[1]
        found, scores, flat = [np.zeros((0, 5), np.int64)], [np.zeros(0)], ii.ravel()
        slack = 1e-9 * (1 + np.abs(self.logits).max(1, initial=0).sum())
        for p, (s, h, w, dj, dk) in enumerate(self.scales):
            if h > height or w > width:
                continue
            j0, k0 = (np.arange((room % d) // 2, room + 1, d) for room, d in ((height - h, dj), (width - w, dk)))
            start = (j0[:, None] * stride + k0).ravel()
            bg, white = corners(self.bg[p], stride)[..., None], corners(self.white[p], stride)[..., None]
            part, rest, fine = (c[:, None] for c in usable(self.bg[p], self.white[p]))
            for a in range(0, len(start), WINDOWS):
                at = start[a : a + WINDOWS]
                score = np.zeros(len(at))
                t = 0
                while t < len(self.lo) and len(at):
                    rounds = slice(t, t + max(STEP, STEP * WINDOWS // 8 // len(at)))  # few windows, more rounds
                    value = values_at(flat, at, bg[:, rounds], white[:, rounds], part[rounds], rest[rounds], fine[rounds])
                    if gray:
                        own = np.take_along_axis(self.table[rounds], value + GRAY, 1)
                    else:
                        own = self.responses(value, rounds)
                    for line in own:
                        score += line
                    t = min(rounds.stop, len(self.lo))
                    alive = score + self.still[t] > self.threshold - slack if t < len(self.lo) else score > self.threshold
                    if not alive.all():
                        at, score = at[alive], score[alive]
                if len(at):
                    found.append(np.stack([np.full(len(at), s), at // stride, at % stride, np.full(len(at), h), np.full(len(at), w)], 1))
                    scores.append(score)
        return np.concatenate(found), np.concatenate(scores)
