"""Rows rendered as PDF documents inside Arrow batches, for round trips."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import BATCH, small_batches
from .writer import Page, document, table, text_width

#: Rows on a page, and their height; the header is repeated on each.
PER_PAGE, PITCH = 12, 18.0
#: Rows of a batch that are Python objects at once.
ROWS = 64


def _pages(rows: list[list[str]], header: list[str] | None, style: str, per_page: int, pitch: float) -> list[Page]:
    body = per_page - bool(header)
    cols = max(map(len, rows), default=1)
    xs = [40 + (532 / cols) * k for k in range(cols + 1)]
    pages = []
    for lo in range(0, max(1, len(rows)), body):
        p = Page()
        table(p, ([header] if header else []) + rows[lo : lo + body], xs, pitch=pitch, style="ruled" if style == "gated" else style)
        if style == "gated":
            for a in ((15, 15, 597, 15), (15, 777, 597, 777), (15, 15, 15, 777), (597, 15, 597, 777)):
                p.line(*a)
            table(p, [["Social security number", ""], ["Accounting method", ""], ["Business address", ""]], [40, 300, 572], top=180, pitch=40)
        pages.append(p)
    return pages


def _made(df: DataFrame, draw: Callable[[dict], bytes]) -> DataFrame:
    """doc_id, content of rows that are drawn."""
    small_batches(df.sparkSession)
    return df.mapInArrow(_kernel(draw), "doc_id string, content binary")


def _kernel(draw: Callable[[dict], bytes]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, made, size = [], [], 0
            for lo in range(0, len(b), ROWS):
                for r in b.slice(lo, ROWS).to_pylist():
                    ids.append(r["doc_id"])
                    made.append(draw(r))
                    size += len(made[-1])
                    if size >= BATCH:
                        yield pa.record_batch({"doc_id": pa.array(ids, pa.string()), "content": pa.array(made, pa.binary())})
                        ids, made, size = [], [], 0
            if made:
                yield pa.record_batch({"doc_id": pa.array(ids, pa.string()), "content": pa.array(made, pa.binary())})

    return run


def grids(df: DataFrame, header: list[str] | None = None, style: str = "ruled", per_page: int = PER_PAGE, pitch: float = PITCH) -> DataFrame:
    """doc_id, content of (doc_id, rows array<array<string>>)."""
    return _made(df.select("doc_id", "rows"), lambda r: document(_pages(r["rows"], header, style, per_page, pitch)))


def prose(df: DataFrame) -> DataFrame:
    """doc_id, content of (doc_id, lines array<string>)."""

    def draw(r: dict) -> bytes:
        pages = []
        for lo in range(0, max(1, len(r["lines"])), 44):
            p = Page(900)
            for k, line in enumerate(r["lines"][lo : lo + 44]):
                p.text(72, 740 - 16 * k, line)
            pages.append(p)
        return document(pages)

    return _made(df.select("doc_id", "lines"), draw)


def words(df: DataFrame) -> DataFrame:
    """The same as ``prose`` with every word drawn on its own, a space apart."""

    def draw(r: dict) -> bytes:
        pages = []
        for lo in range(0, max(1, len(r["lines"])), 44):
            p = Page(900)
            for k, line in enumerate(r["lines"][lo : lo + 44]):
                x = 72.0
                for w in line.split(" "):
                    p.text(x, 740 - 16 * k, w)
                    x += text_width(w + " ", 10)
            pages.append(p)
        return document(pages)

    return _made(df.select("doc_id", "lines"), draw)


#: Lines of a page in two columns, and the fewest for which a second is begun.
COLUMN_LINES, COLUMN_LEAST = 88, 8


def columns(df: DataFrame) -> DataFrame:
    """Lines in two columns, drawn row by row: left, right, left, ...; a page of few lines has one column."""

    def draw(r: dict) -> bytes:
        pages = []
        for lo in range(0, max(1, len(r["lines"])), COLUMN_LINES):
            p, own = Page(), r["lines"][lo : lo + COLUMN_LINES]
            for k, line in enumerate(own):
                row, right = (k // 2, k % 2) if len(own) >= COLUMN_LEAST else (k, 0)
                p.text(330 if right else 40, 740 - 16 * row, line)
            pages.append(p)
        return document(pages)

    return _made(df.select("doc_id", "lines"), draw)


def drawn(df: DataFrame, draw: Callable[[dict], bytes]) -> DataFrame:
    """doc_id, content of rows with a doc_id, each drawn by a function of its columns."""
    return _made(df, draw)


def objects(df: DataFrame) -> DataFrame:
    """doc_id, content of (doc_id, title, names array<string>): a link, a field and an outline entry for each name."""

    def draw(r: dict) -> bytes:
        p = Page()
        p.text(72, 700, r["title"])
        p.links += [f"https://example.com/{n}" for n in r["names"]]
        p.images["Im0"] = (2, 2, bytes([0, 255, 255, 0]))
        return document([p], r["title"], r["names"], [(n, n.lower()) for n in r["names"]])

    return _made(df.select("doc_id", "title", "names"), draw)


def collected(df: DataFrame, doc_id, order: list[str], columns: list) -> DataFrame:
    """doc_id, rows: the columns of each document's rows as text, in order."""
    row = F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return df.groupBy(doc_id.cast("string").alias("doc_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, row.alias("row")))), lambda r: r["row"]).alias("rows"))
