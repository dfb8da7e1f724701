"""One object for a collection of documents, and its SQL functions.

``Documents.open(spark, path)`` gives DataFrames of whatever the files hold;
``register(spark)`` adds the table functions ``pdf_pages(content)`` and
``pdf_tables(content, preset)`` to SQL, for LATERAL joins with any table that has
a document's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import tables as T
from .plans.options import TableOptions, TextOptions, preset
from .sources import pdf
from .sources.objects import Limits
from .sources.renderer import Renderer


@dataclass(frozen=True)
class Documents:
    """Documents as rows (doc_id, content); every method is a plan, and nothing is opened before its result is asked for."""

    rows: DataFrame
    limits: Limits = field(default_factory=Limits)
    renderer: Renderer | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, limits: Limits = Limits(), renderer: Renderer | None = None) -> Documents:
        """The PDF files under a path; doc_id is a file's own path."""
        return cls(pdf.load(spark, path), limits, renderer)

    def _extracted(self, *parts: str) -> DataFrame:
        return pdf.extract(self.rows, parts, self.limits)

    def info(self) -> DataFrame:
        """doc_id, n_pages, version, title, rotations."""
        return T.info(self.rows, self.limits)

    def meta(self) -> DataFrame:
        """doc_id, title, author, producer, version, n_pages."""
        return pdf.meta(self._extracted())

    def page_count(self) -> DataFrame:
        return self.meta().select("doc_id", "n_pages")

    def pages(self) -> DataFrame:
        """doc_id, page, media box, crop, rotate."""
        return pdf.relation(self._extracted(), "pages")

    def page(self, index: int) -> DataFrame:
        """The pages of one number, from 0."""
        return self.pages().where(F.col("page") == index)

    def runs(self, page: int | None = None) -> DataFrame:
        found = pdf.relation(self._extracted("runs"), "runs")
        return found if page is None else found.where(F.col("page") == page)

    def font_names(self) -> DataFrame:
        """doc_id, page, font_name: the fonts that pages draw with."""
        return self.runs().select("doc_id", "page", "font_name").distinct()

    def rules(self) -> DataFrame:
        return pdf.relation(self._extracted("rules"), "rules")

    def segments(self) -> DataFrame:
        """Rules with is_flat, is_tall and length; a rule is one of both if it is short."""
        flat, tall = F.abs(F.col("y1") - F.col("y0")), F.abs(F.col("x1") - F.col("x0"))
        return self.rules().withColumns({"is_flat": flat <= 2.0, "is_tall": tall <= 2.0, "length": F.sqrt(flat * flat + tall * tall)})

    def placements(self) -> DataFrame:
        return pdf.relation(self._extracted("runs"), "placements")

    def warnings(self) -> DataFrame:
        return pdf.relation(self._extracted("runs", "rules"), "warnings")

    def text(self, options: TextOptions = TextOptions()) -> DataFrame:
        """doc_id, page, text."""
        return T.text(self.rows, options, self.limits)

    def images(self) -> DataFrame:
        return pdf.relation(self._extracted("objects"), "images")

    def links(self) -> DataFrame:
        return pdf.relation(self._extracted("objects"), "links")

    def fields(self) -> DataFrame:
        return pdf.relation(self._extracted("objects"), "fields")

    def outline(self) -> DataFrame:
        return pdf.outline(self._extracted("objects"))

    def tables(self, options: TableOptions | str = "auto") -> DataFrame:
        return T.tables(self.rows, _options(options), self.limits, self.renderer)

    def stitched(self, options: TableOptions | str = "auto") -> DataFrame:
        return T.logical(self.rows, _options(options), self.limits, self.renderer)

    def cells(self, options: TableOptions | str = "auto") -> DataFrame:
        return T.cells(self.tables(options))

    def errors(self) -> DataFrame:
        """doc_id, code, message of what can't be read."""
        return pdf.errors(self._extracted())


def _options(options: TableOptions | str) -> TableOptions:
    return preset(options) if isinstance(options, str) else options


class _Pages:
    def eval(self, content: bytes) -> Iterator[tuple]:
        got = pdf.read("", content, Limits(), frozenset(("runs",)))
        for p in got.get("pages") or []:
            own = [r["text"] for r in got["runs"] if r["page"] == p["page"]]
            yield p["page"], p["rotate"], len(own), "".join(own)


class _Cells:
    def eval(self, content: bytes, name: str) -> Iterator[tuple]:
        for t in T.fragments(content, preset(name)):
            for c in t["cells"]:
                yield t["page"], t["ord"], t["method"], float(t["confidence"]), c["row"], c["col"], c["text"]


def register(spark: SparkSession) -> None:
    """Adds pdf_pages and pdf_tables to the session's SQL; a document that can't be read has no rows there."""
    spark.udtf.register("pdf_pages", F.udtf(_Pages, returnType="page int, rotate int, n_runs int, text string"))
    spark.udtf.register("pdf_tables", F.udtf(_Cells, returnType="page int, ord int, method string, confidence double, row int, col int, text string"))
