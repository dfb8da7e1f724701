"""A corpus of documents with known tables: families of layouts in parameter sweeps, one row a document, drawn where it is read.

``specs`` lists (family, variant); ``draw`` makes a document's pages and says how
many tables they hold. ``counts`` draws and reads all of them in one Spark job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .writer import Page, document, table

Made = tuple[list[Page], int]
FAMILIES: dict[str, tuple[Callable[[int], Made], int]] = {}
_NAMES = ["Alder", "Birch", "Cedar", "Dogwood", "Elm", "Fir", "Ginkgo", "Hazel", "Ivy", "Juniper", "Kapok", "Larch", "Maple", "Nutmeg", "Oak"]


def family(variants: int) -> Callable:
    def keep(f: Callable[[int], Made]) -> Callable[[int], Made]:
        FAMILIES[f.__name__.lstrip("_")] = (f, variants)
        return f

    return keep


def data(rows: int, cols: int, seed: int = 0) -> list[list[str]]:
    """A header and rows of a name and numbers."""
    head = ["Item", *[f"Year {2010 + c}" for c in range(cols - 1)]]
    return [head, *[[f"{_NAMES[(r + seed) % len(_NAMES)]} {r}", *[f"{(r + 1) * (c + 3) * 17 % 1000}.{(r + c) % 10}" for c in range(cols - 1)]] for r in range(rows)]]


def edges(cols: int, x0: float = 50, x1: float = 550) -> list[float]:
    return [x0 + (x1 - x0) / cols * k for k in range(cols + 1)]


def _prose(p: Page, top: float, lines: int, x: float = 60) -> None:
    for k in range(lines):
        p.text(x, top - 14 * k, "A line of running text that goes on over most of the width of its page.")


# Basic


@family(3)
def text_only(v: int) -> Made:
    p = Page()
    _prose(p, 720, 10 + 10 * v)
    return [p], 0


@family(2)
def two_columns(v: int) -> Made:
    p = Page()
    for k in range(12 + 8 * v):
        p.text(60, 720 - 14 * k, "left column text that is prose")
        p.text(320, 720 - 14 * k, "right column text that is prose")
    return [p], 0


@family(2)
def many_pages(v: int) -> Made:
    pages = []
    for k in range(10 + 20 * v):
        p = Page()
        p.text(60, 700, f"Page {k + 1}")
        pages.append(p)
    return pages, 0


@family(4)
def ruled(v: int) -> Made:
    p = Page()
    table(p, data(5 + 3 * v, 3 + v), edges(3 + v))
    return [p], 1


@family(4)
def borderless(v: int) -> Made:
    p = Page()
    table(p, data(6 + 3 * v, 3 + v), edges(3 + v), style="borderless")
    return [p], 1


@family(2)
def mixed(v: int) -> Made:
    p = Page()
    _prose(p, 750, 3)
    table(p, data(6, 4), edges(4), top=680)
    _prose(p, 500, 4 + v)
    return [p], 1


@family(3)
def rotated(v: int) -> Made:
    p = Page(rotate=90 * (v + 1))
    if v == 1:
        table(p, data(6, 4), edges(4))
        return [p], 1
    # Drawn so that it stands upright when the page is turned.
    q = Page(rotate=0)
    table(q, data(6, 4), edges(4))
    return [q], 1


# Stress


@family(2)
def bank_statement(v: int) -> Made:
    p = Page()
    _prose(p, 760, 2)
    rows = [["Date", "Details", "Debit", "Credit", "Balance"]] + [[f"2024-01-{k + 1:02d}", f"Payment {_NAMES[k % 15]}", f"{k * 7}.10" if k % 2 else "", "" if k % 2 else f"{k * 9}.20", f"{1000 + k * 3}.00"] for k in range(18 + 8 * v)]
    table(p, rows, [50, 130, 300, 380, 460, 550], top=700, pitch=16)
    return [p], 1


@family(2)
def side_by_side(v: int) -> Made:
    p = Page()
    table(p, data(6 + v, 3), edges(3, 50, 280))
    table(p, data(6 + v, 3, 4), edges(3, 330, 560))
    return [p], 2


@family(2)
def dense_numbers(v: int) -> Made:
    p = Page()
    table(p, data(24 + 6 * v, 8), edges(8), pitch=14, size=7)
    return [p], 1


@family(2)
def invoice(v: int) -> Made:
    p = Page()
    rows = [["SKU", "Item", "Count", "Price", "Sum"]] + [[f"A{100 + k}", _NAMES[k], str(k + 1), f"{k + 2}.50", f"{(k + 1) * (k + 2.5):.2f}"] for k in range(6 + 4 * v)]
    table(p, rows, edges(5), top=640)
    _prose(p, 740, 3)
    return [p], 1


@family(2)
def footnotes(v: int) -> Made:
    p = Page()
    table(p, data(7 + v, 4), edges(4), style="borderless")
    p.text(50, 740 - 18 * (9 + v) - 20, "1) Figures are rounded to one place.")
    return [p], 1


# Hard


@family(3)
def stacked(v: int) -> Made:
    p = Page()
    table(p, data(5, 3 + v % 2), edges(3 + v % 2))
    table(p, data(5, 5, 3), edges(5), top=560)
    if v == 2:
        table(p, data(4, 6, 5), edges(6), top=380)
    return [p], 2 + (v == 2)


@family(2)
def multipage(v: int) -> Made:
    pages = []
    for k in range(2 + v):
        p = Page()
        table(p, [data(1, 4)[0], *[[f"{_NAMES[(k + r) % 15]} {k}.{r}", str(k * 100 + r), f"{r}.5", "7"] for r in range(36 if k < 1 + v else 6)]], edges(4))
        pages.append(p)
    return pages, 2 + v


@family(2)
def page_border(v: int) -> Made:
    p = Page()
    for a in ((20, 20, 590, 20), (20, 770, 590, 770), (20, 20, 20, 770), (590, 20, 590, 770)):
        p.line(*a)
    if v:
        p.line(20, 90, 590, 90)
    table(p, data(7, 4), edges(4, 60, 540), top=700)
    return [p], 1


@family(2)
def wide(v: int) -> Made:
    p = Page()
    table(p, data(8, 10 + 3 * v), edges(10 + 3 * v, 30, 580), size=6)
    return [p], 1


@family(2)
def decoration(v: int) -> Made:
    p = Page()
    for k in range(3 + v):
        p.line(50, 760 - 6 * k, 550, 760 - 6 * k)
    table(p, data(7, 4), edges(4), top=680)
    return [p], 1


# Precision, sensing and competition


@family(2)
def painted(v: int) -> Made:
    p = Page()
    table(p, data(6 + 2 * v, 4), edges(4), style="painted")
    return [p], 1


@family(2)
def filled(v: int) -> Made:
    p = Page()
    table(p, data(6 + 2 * v, 4), edges(4), style="filled")
    return [p], 1


@family(2)
def columns_only(v: int) -> Made:
    p = Page()
    table(p, data(7 + 3 * v, 4), edges(4), style="columns")
    return [p], 1


@family(2)
def partly_ruled(v: int) -> Made:
    p = Page()
    rows = data(7 + v, 4)
    low = 740 - 18 * len(rows)
    for a in ((50, 740, 550, 740), (50, low, 550, low), (50, low, 50, 740), (50, 722, 550, 722)):
        p.line(*a)
    table(p, rows, edges(4), style="none")
    return [p], 1


@family(2)
def glued(v: int) -> Made:
    p = Page()
    table(p, data(9 + 3 * v, 4)[1:], edges(4), style="glued")
    return [p], 1


@family(2)
def form_boxes(v: int) -> Made:
    p = Page()
    rows = [["Social security number", ""], ["Accounting method", ""], ["Business address", ""], ["", ""]][: 3 + v]
    table(p, rows, [50, 300, 550], pitch=30)
    return [p], 0


@family(2)
def numbered_list(v: int) -> Made:
    p = Page()
    for k in range(8 + 4 * v):
        p.text(60, 720 - 16 * k, f"{k + 1}.")
        p.text(90, 720 - 16 * k, "an item of a list that is a sentence of some length")
    return [p], 0


@family(2)
def underlines(v: int) -> Made:
    p = Page()
    for k in range(8 + 4 * v):
        p.text(60, 720 - 18 * k, "A heading or a line of text that is underlined")
        p.line(60, 717 - 18 * k, 300, 717 - 18 * k)
    return [p], 0


@family(3)
def ruled_and_borderless(v: int) -> Made:
    p = Page()
    table(p, data(6, 4), edges(4))
    table(p, data(8 + v, 5, 2), edges(5), top=520, style="borderless")
    return [p], 2


@family(2)
def many_small(v: int) -> Made:
    p = Page()
    n = 3 + v
    for k in range(n):
        table(p, data(3, 3 + k, k), edges(3 + k), top=740 - 170 * k)
    return [p], n


def specs() -> list[tuple[str, int]]:
    return [(name, v) for name, (_, n) in FAMILIES.items() for v in range(n)]


def draw(name: str, variant: int) -> tuple[bytes, int]:
    """(the document, its number of tables on pages)."""
    pages, n = FAMILIES[name][0](variant)
    return document(pages, name), n


def expected() -> list[tuple[str, int, int]]:
    return [(name, v, FAMILIES[name][0](v)[1]) for name, v in specs()]


def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [draw(f, v) for f, v in zip(b.column("family").to_pylist(), b.column("variant").to_pylist())]
        yield pa.record_batch({"doc_id": b.column("doc_id"), "content": pa.array([c for c, _ in made], pa.binary())})


def documents(spark: SparkSession) -> DataFrame:
    """doc_id (family/variant), content."""
    rows = spark.createDataFrame(specs(), "family string, variant int").withColumn("doc_id", F.concat_ws("/", "family", F.col("variant").cast("string")))
    return rows.repartition(spark.sparkContext.defaultParallelism).select("doc_id", "family", "variant").mapInArrow(_draw, "doc_id string, content binary")


def counts(spark: SparkSession, name: str = "auto") -> DataFrame:
    """family, variant, expected, found: tables on pages of every document."""
    from ..plans import tables as T
    from ..plans.options import preset

    want = spark.createDataFrame(expected(), "family string, variant int, expected int")
    got = T.tables(documents(spark), preset(name)).groupBy("doc_id").agg(F.count("*").cast("int").alias("found"))
    own = F.concat_ws("/", "family", F.col("variant").cast("string"))
    return want.withColumn("doc_id", own).join(got, "doc_id", "left").select("family", "variant", "expected", F.coalesce("found", F.lit(0)).alias("found"))
