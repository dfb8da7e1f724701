"""Box geometry, text predicates and one-dimensional folds as Column expressions: no Python runs in them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Four columns of a box with y upwards."""

    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*[F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")])

    @property
    def width(self) -> Column:
        return F.greatest(self.x1 - self.x0, F.lit(0.0))

    @property
    def height(self) -> Column:
        return F.greatest(self.y1 - self.y0, F.lit(0.0))

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def cx(self) -> Column:
        return (self.x0 + self.x1) / 2

    @property
    def cy(self) -> Column:
        return (self.y0 + self.y1) / 2


def intersection(a: Box, b: Box) -> Column:
    """Area in common."""
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is nothing."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def iou(a: Box, b: Box) -> Column:
    both = intersection(a, b)
    return share(both, a.area + b.area - both)


def containment(inner: Box, outer: Box) -> Column:
    """The share of the inner box that the outer one covers."""
    return share(intersection(inner, outer), inner.area)


def least_area_overlap(a: Box, b: Box) -> Column:
    return share(intersection(a, b), F.least(a.area, b.area))


def x_iou(a: Box, b: Box) -> Column:
    both = F.greatest(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.lit(0.0))
    return share(both, a.width + b.width - both)


def y_gap(a: Box, b: Box) -> Column:
    """Free height between two boxes, 0 if they meet."""
    return F.greatest(F.greatest(a.y0, b.y0) - F.least(a.y1, b.y1), F.lit(0.0))


def nested(child: Box, parent: Box) -> Column:
    """A table in a cell of another: .85 contained, .03 to .55 of its area, 2500 square units and 36 a side at least."""
    ratio = share(child.area, parent.area)
    return (containment(child, parent) >= 0.85) & ratio.between(0.03, 0.55) & (child.area >= 2500) & (child.width >= 36) & (child.height >= 36)


def centre_in(inner: Box, outer: Box, pad: float = 1.0) -> Column:
    return inner.cx.between(outer.x0 - pad, outer.x1 + pad) & inner.cy.between(outer.y0 - pad, outer.y1 + pad)


def turned(x: Column, y: Column, box: Box, rotate: Column) -> tuple[Column, Column]:
    """A point of a page turned by 90, 180 or 270 degrees, upright."""
    return (
        F.when(rotate == 90, y - box.y0 + box.x0).when(rotate == 180, box.x0 + box.x1 - x).when(rotate == 270, box.y1 - y + box.x0).otherwise(x),
        F.when(rotate == 90, box.x1 - x + box.y0).when(rotate == 180, box.y0 + box.y1 - y).when(rotate == 270, x - box.x0 + box.y0).otherwise(y),
    )


# Folds


def cluster_1d(values: Column, tolerance: float) -> Column:
    """Means of clusters of sorted values: a value joins while it is within tolerance of the running mean."""
    empty = F.lit(None).cast("array<struct<m:double,n:int>>")
    start = F.coalesce(empty, F.array().cast("array<struct<m:double,n:int>>"))

    def add(s, x):
        last = F.try_element_at(s, F.lit(-1))
        joined = F.struct(((last["m"] * last["n"] + x) / (last["n"] + 1)).alias("m"), (last["n"] + 1).cast("int").alias("n"))
        own = F.struct(x.cast("double").alias("m"), F.lit(1).alias("n"))
        return F.when((F.size(s) > 0) & (F.abs(x - last["m"]) <= tolerance), F.concat(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(s, F.array(own)))

    return F.aggregate(F.array_sort(values), start, add, lambda s: F.transform(s, lambda c: c["m"]))


def upper_median(values: Column, default: float) -> Column:
    """The element n // 2 of the sorted values."""
    s = F.array_sort(values)
    return F.coalesce(F.try_element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int")), F.lit(default))


def regularity(edges: Column) -> Column:
    """1 less half the coefficient of variation of the gaps between sorted edges."""
    s = F.array_sort(edges)
    gaps = F.zip_with(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), lambda b, a: b - a)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda x, y: x + y)
    mean = total(gaps) / F.size(gaps)
    var = total(F.transform(gaps, lambda g: (g - mean) * (g - mean))) / F.size(gaps)
    return F.when(F.size(s) < 3, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - 0.5 * F.sqrt(var) / mean))


def grid_boxes(xs: Column, ys: Column, least: float = 3.0) -> Column:
    """Cells between sorted distinct edges, row 0 on top: array<struct<row, col, x0, y0, x1, y1>>, without those thinner than ``least``."""

    def gaps(edges: Column) -> Column:
        s = F.array_sort(F.array_distinct(edges))
        return F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    wide, tall = gaps(xs), F.reverse(gaps(ys))
    every = F.flatten(F.transform(tall, lambda y, r: F.transform(wide, lambda x, c: F.struct(r.alias("row"), c.alias("col"), x["a"].alias("x0"), y["a"].alias("y0"), x["b"].alias("x1"), y["b"].alias("y1")))))
    return F.filter(every, lambda b: (b["x1"] - b["x0"] >= least) & (b["y1"] - b["y0"] >= least))


def alignment(values: Column, anchors: Column, tolerance: float) -> Column:
    """The share of values within tolerance of an anchor."""
    near = F.filter(values, lambda v: F.exists(anchors, lambda a: F.abs(v - a) <= tolerance))
    return share(F.size(near).cast("double"), F.size(values).cast("double"))


def steady(counts: Column) -> Column:
    """The share of rows whose filled cells are within one of the upper median's."""
    usual = upper_median(counts, 0)
    return share(F.size(F.filter(counts, lambda n: F.abs(n - usual) <= 1)).cast("double"), F.size(counts).cast("double"))


def composed(text: Column) -> Column:
    """NFKC; no SQL function has it, so it runs in Python, in Arrow batches, and only where it is asked for."""
    import pandas as pd

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return nfkc(text)


# Text of cells


def has_digit(text: Column) -> Column:
    return F.length(F.translate(text, "0123456789", "")) < F.length(text)


def digit_led(text: Column) -> Column:
    """Density A: a digit, and digits not fewer than letters, without $ % ( ) and commas."""
    # Deleting characters is far cheaper than matching them: letters are looked for only where something else than ASCII signs is left.
    bare = F.translate(F.trim(text), "$%(),", "")
    rest = F.translate(bare, "0123456789", "")
    digits = F.length(bare) - F.length(rest)
    letters = F.when(F.translate(rest, ".+-/:;!?*#&_ ", "") == "", 0).otherwise(F.length(F.regexp_replace(rest, r"\P{L}", "")))
    return (digits >= 1) & (digits >= letters)


def number_only(text: Column) -> Column:
    """Density B: nothing but digits, signs, points, commas and spaces, and a digit."""
    rest = F.translate(text, "0123456789", "")
    return (F.length(rest) < F.length(text)) & (F.translate(rest, ".,+- ", "") == "")


def numberish(text: Column) -> Column:
    """Density E: an amount with signs, currency, brackets or per cent, or a lone dash."""
    return F.trim(text).rlike(r"^(?:[-–—]|[(+-]*[$€£]?\s*[0-9][0-9,. ]*%?\)?)$")


def punctuation_share(text: Column) -> Column:
    return share(F.length(F.regexp_replace(text, r"[^.,;:!?]", "")).cast("double"), F.length(text).cast("double"))


def runs_with_digit(text: Column) -> Column:
    """Density D, an aggregate: the share of runs that have a digit."""
    return F.avg(has_digit(text).cast("double"))


def signs_of_solid(text: Column) -> Column:
    """The other punctuation density, an aggregate: signs among all characters that are not space."""
    signs = F.sum(F.length(F.regexp_replace(text, r"[^.,;:!?]", "")))
    return signs / F.greatest(F.lit(1), F.sum(F.length(F.regexp_replace(text, r"\s", ""))))


def hex_share(text: Column) -> Column:
    return share(F.length(F.regexp_replace(text, r"[^0-9a-fA-F]", "")).cast("double"), F.length(text).cast("double"))


def caption(text: Column) -> Column:
    return F.lower(F.trim(text)).rlike(r"^(table|figure|fig\.|exhibit|chart)\s*[0-9ivx]+")


def soft_number(text: Column) -> Column:
    """A cell's number whatever its grouping, currency and brackets; null if it isn't one."""
    bare = F.regexp_replace(F.trim(text), r"[$€£,% ]", "")
    negative = bare.rlike(r"^\(.*\)$")
    value = F.regexp_replace(bare, r"[()]", "").try_cast("double") if hasattr(Column, "try_cast") else F.regexp_replace(bare, r"[()]", "").cast("double")
    return F.when(negative, -value).otherwise(value)


def normal_text(text: Column) -> Column:
    """Line ends and runs of spaces made one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), r"[ \t\x0B\f]+", " "))


def normal_cell(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "), r"\s*_\s*", "_"))
