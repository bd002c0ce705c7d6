"""Column expressions of the boosted bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_of(x: Column, lo: Column | float, hi: Column | float, n_bins: int) -> Column:
    """Place of x among n_bins bins of equal width from lo to hi, from 0; outside values fall into the end bins. A
    range without width has bin 0 only. Computed in double and clamped before it is narrowed."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    place = F.floor(F.lit(float(n_bins)) * (x.cast("double") - lo) / (hi - lo))
    return F.when(hi > lo, F.greatest(F.lit(0), F.least(F.lit(n_bins - 1), place))).otherwise(F.lit(0)).cast("int")


def logit(wp: Column, wn: Column, most: float) -> Column:
    """Half the log odds of the two weights, within -most and most; 0 where both are equal (or both zero)."""
    clipped = F.greatest(F.lit(-most), F.least(F.lit(most), F.lit(0.5) * F.ln(wp / wn)))
    return F.when(wp == wn, F.lit(0.0)).when(wp <= 0, F.lit(-most)).when(wn <= 0, F.lit(most)).otherwise(clipped)


def signed_label(label: Column, classes: list) -> Column:
    """-1 for the smaller of the two classes, +1 for the other."""
    return F.when(label == F.lit(classes[0]), F.lit(-1)).otherwise(F.lit(1)).cast("tinyint")


def clean_name(name: Column) -> Column:
    """Without line feeds and tabs, and with single spaces."""
    return F.regexp_replace(F.translate(name, "\n\t", ""), " +", " ")


def polynomial_hash(text: Column) -> Column:
    """Base-31 polynomial over the code points, modulo 2^32."""
    step = lambda h, c: F.pmod(h * F.lit(31).cast("long") + F.ascii(c).cast("long"), F.lit(4294967296).cast("long"))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), step)


def experiment_code(text: Column, digits: int) -> Column:
    """The last `digits` decimal digits of polynomial_hash, with leading zeros."""
    return F.lpad(F.pmod(polynomial_hash(text), F.lit(10**digits).cast("long")).cast("string"), digits, "0")


def experiment_stamp(text: Column, digits: int = 10, day: Column | None = None) -> Column:
    """experiment_code and the day as YYYYMMDD, joined by an underscore."""
    return F.concat(experiment_code(text, digits), F.lit("_"), F.date_format(F.current_date() if day is None else day, "yyyyMMdd"))


def whole_or_null(text: Column) -> Column:
    """The whole number that a text spells, else null."""
    return text.try_cast("bigint")


def number_or_null(text: Column) -> Column:
    """The number that a text spells, else null."""
    return text.try_cast("double")


def portable_uniform(*keys: Column) -> Column:
    """A number in [0, 1) from the keys by MD5, the same in any engine and partitioning."""
    digest = F.md5(F.concat_ws("/", *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


# ---- boxes ----


def iou_corners(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of boxes (j1, k1, j2, k2) whose ends belong to them."""
    dj = F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + 1
    dk = F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + 1
    both = F.when((dj > 0) & (dk > 0), dj * dk).otherwise(F.lit(0))
    area = lambda c: (c[2] - c[0] + 1) * (c[3] - c[1] + 1)
    return both.cast("double") / (area(a) + area(b) - both)


def iou_sizes(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """The same for boxes (j, k, height, width)."""
    corners = lambda c: (c[0], c[1], c[0] + c[2] - 1, c[1] + c[3] - 1)
    return iou_corners(corners(a), corners(b))
