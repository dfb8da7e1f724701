"""Text of pages from positioned runs: bands, spaces, lines, columns and reading order, as DataFrame expressions.

All state is per page: runs are placed once by (doc_id, page), and the folds over
a page's sorted runs stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import upper_median

PAGE = ("doc_id", "page")


def _sorted_runs(runs: DataFrame, include_invisible: bool = True) -> DataFrame:
    """Per page the runs from top to bottom, left to right, and the upper median of the font sizes."""
    own = runs if include_invisible else runs.where(~F.col("invisible"))
    run = F.struct((-(F.col("y0") + F.col("y1")) / 2).alias("ny"), "x0", "ord", "x1", "y0", "y1", "text", "font_size")
    return own.groupBy(*PAGE).agg(F.sort_array(F.collect_list(run)).alias("r"), F.collect_list("font_size").alias("sizes")).select(*PAGE, "r", upper_median(F.col("sizes"), 12.0).alias("fs"))


def lines(runs: DataFrame, include_invisible: bool = True) -> DataFrame:
    """doc_id, page, line, x0, x1, y, text: runs of a band whose gap is no gutter, spaces put where words part."""
    r, tolerance = _sorted_runs(runs, include_invisible), F.greatest(F.col("fs"), F.lit(1.0))
    # A band is anchored at its first run; a line also ends at a gutter of 2 * .375 of the font size.
    start = F.struct(F.lit(None).cast("double").alias("band"), F.lit(0).alias("b"), F.array().cast("array<int>").alias("ids"))

    def band(s, x):
        same = F.coalesce(F.abs(-x["ny"] - s["band"]) <= 0.25 * tolerance, F.lit(False))
        b = F.when(same, s["b"]).otherwise(s["b"] + 1)
        return F.struct(F.when(same, s["band"]).otherwise(-x["ny"]).alias("band"), b.alias("b"), F.concat(s["ids"], F.array(b)).alias("ids"))

    ids = F.aggregate("r", start, band, lambda s: s["ids"])
    banded = r.select(*PAGE, "fs", F.explode(F.arrays_zip(F.col("r").alias("r"), ids.alias("b"))).alias("z")).select(*PAGE, "fs", F.col("z.b").alias("band"), "z.r.*")
    from pyspark.sql import Window

    w = Window.partitionBy(*PAGE, "band").orderBy("x0", "ord")
    right = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("x0") - right
    before = F.lag("text").over(w)
    one = F.greatest(F.col("fs"), F.lit(1.0))
    breaks = F.coalesce((gap >= 0.75 * one) | (gap < -0.5 * one), F.lit(True))
    spaced = F.coalesce((gap > 0.125 * one) & (gap <= 3 * one) & ~before.endswith(" ") & ~F.col("text").startswith(" "), F.lit(False))
    cut = banded.withColumn("_new", breaks.cast("int")).withColumn("_space", F.when(spaced, " ").otherwise(""))
    numbered = cut.withColumn("part", F.sum("_new").over(w))
    piece = F.struct("x0", "ord", F.concat(F.when(F.col("_new") == 1, "").otherwise(F.col("_space")), "text").alias("t"))
    return numbered.groupBy(*PAGE, "band", "part").agg(
        F.min("x0").alias("x0"),
        F.max("x1").alias("x1"),
        F.min("y0").alias("y0"),
        F.max("y1").alias("y1"),
        F.first("fs").alias("fs"),
        F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["t"]), "").alias("text"),
    )


def page_text(runs: DataFrame, pages: DataFrame, include_invisible: bool = True) -> DataFrame:
    """doc_id, page, text, two_columns: lines in reading order. Of a page in two columns, lines over both come first, then left, then right."""
    from pyspark.sql import Window

    found = lines(runs, include_invisible).join(pages.select(*PAGE, F.col("x0").alias("px0"), F.col("x1").alias("px1")), list(PAGE))
    middle, width = (F.col("px0") + F.col("px1")) / 2, F.col("px1") - F.col("px0")
    spans = (F.col("x1") - F.col("x0")) >= 0.8 * width
    side = F.when(spans, 0).when(F.col("x1") <= middle, 1).when(F.col("x0") >= middle, 2).otherwise(0)
    by_page = Window.partitionBy(*PAGE)
    sided = found.withColumn("side", side)
    wide = lambda k: F.count(F.when((F.col("side") == k) & (F.col("x1") - F.col("x0") >= 3 * F.col("fs")), 1)).over(by_page)
    two = sided.withColumn("two", (wide(1) >= 2) & (wide(2) >= 2))
    line = F.struct(F.when(F.col("two"), F.col("side")).otherwise(0).alias("class"), "band", "part", "text")
    return two.groupBy(*PAGE).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: F.rtrim(x["text"])), "\n").alias("text"),
        F.first("two").alias("two_columns"),
    )


def paint_text(runs: DataFrame) -> DataFrame:
    """doc_id, page, text: runs one after another as they are drawn."""
    return runs.groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda r: r["text"]), "").alias("text"))
