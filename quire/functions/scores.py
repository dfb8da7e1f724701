"""Scores of found tables from their cells, as Column expressions over one aggregate per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import caption, digit_led, has_digit, hex_share, punctuation_share, share


def features(cells: DataFrame, key: list[str]) -> DataFrame:
    """Per table of cells (key, row, col, text): size, fill, mean lengths, shares of numbers, capitals of the header, hex and punctuation."""
    text = F.trim(F.coalesce("text", F.lit("")))
    full = text != ""
    head = full & (F.col("row") == 0)
    mean = lambda c, when=full: F.coalesce(F.avg(F.when(when, c)), F.lit(0.0))
    return cells.groupBy(*key).agg(
        (F.max("row") + 1).cast("int").alias("rows"),
        (F.max("col") + 1).cast("int").alias("cols"),
        share(F.count_if(full).cast("double"), F.count("*").cast("double")).alias("fill"),
        mean(F.length(text)).alias("mean_chars"),
        mean(F.octet_length(text)).alias("mean_bytes"),
        mean(digit_led(text).cast("double")).alias("numeric"),
        mean(has_digit(text).cast("double")).alias("with_digit"),
        mean(F.length(F.regexp_replace(text, r"\P{L}", "")) / F.length(text), head).alias("header_alpha"),
        mean((hex_share(text) >= 0.9).cast("double")).alias("hex"),
        mean(punctuation_share(text)).alias("punctuation"),
        F.max(F.coalesce((F.col("row") == 0) & caption(text), F.lit(False))).alias("has_caption"),
    )


def between01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def data_score(borderless: Column | None = None) -> Column:
    """How much a table is one of data: header words, fill, usual lengths and shares of numbers, usual size; hex dumps lose."""
    num, chars, cols, rows = F.col("numeric"), F.col("mean_chars"), F.col("cols"), F.col("rows")
    numbers = F.when(num.between(0.15, 0.85), 1.0).when(num > 0.85, 0.35).otherwise(0.2)
    total = (
        0.30 * F.col("header_alpha")
        + 0.20 * F.col("fill")
        + 0.15 * between01(1 - F.abs(chars - 12) / 40)
        + 0.15 * numbers
        + 0.10 * F.when(cols.between(3, 12), 1.0).otherwise(0.3)
        + 0.10 * F.when(rows.between(3, 80), 1.0).otherwise(0.2)
    )
    total = total * (1 - 0.75 * F.col("hex")) * F.when((chars < 3.5) & (num > 0.7), 0.35).otherwise(1.0)
    if borderless is not None:
        total = total * F.when(borderless & (F.col("hex") > 0.4), 0.4).otherwise(1.0)
    return between01(total)


def form_score() -> Column:
    """How much a table is a form: empty, without numbers, short, and large only if it is sparse."""
    size = (
        F.when((F.col("fill") >= 0.55) & (F.col("cols") >= 3), 0.0)
        .when((F.col("rows") >= 15) | (F.col("rows") * F.col("cols") >= 60), 0.35)
        .when(F.col("rows") >= 8, 0.15)
        .otherwise(0.0)
    )
    short = F.least(F.col("mean_chars") / 40, F.lit(1.0))
    return between01(0.30 * between01(1 - F.col("fill")) + 0.30 * between01(1 - F.col("numeric")) + 0.15 * (1 - short) + 0.25 * size + 0.10)


def strong_lattice(confidence: float = 0.65) -> Column:
    """A ruled table sure enough to own its place: three columns, or two that are wide and tall."""
    ok = (F.col("method") == "lattice") & (F.col("rows") >= 2) & (F.col("confidence") >= confidence) & ~F.array_contains("notes", "weak_edges")
    return ok & ((F.col("cols") >= 3) | ((F.col("cols") == 2) & (F.col("x1") - F.col("x0") >= 140) & (F.col("rows") >= 4)))


def solid_lattice(confidence: float = 0.55, empty: float = 0.90) -> Column:
    return (F.col("method") == "lattice") & ~F.array_contains("notes", "weak_edges") & (F.col("rows") >= 2) & (F.col("cols") >= 2) & (F.col("confidence") >= confidence) & (1 - F.col("fill") < empty)


def scrubbed(tables: DataFrame, most: int = 8, least: float = 0.54) -> DataFrame:
    """Documents with more than ``most`` tables keep the best ``most`` that score enough; needs doc_id and score."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id")
    ranked = tables.withColumn("_n", F.count("*").over(w)).withColumn("_ok", F.col("score") >= least)
    ranked = ranked.withColumn("_k", F.row_number().over(w.orderBy(F.desc("_ok"), F.desc("score"), *[F.asc(c) for c in tables.columns if c in ("page", "ord", "id")])))
    return ranked.where((F.col("_n") <= most) | (F.col("_ok") & (F.col("_k") <= most))).drop("_n", "_ok", "_k")
