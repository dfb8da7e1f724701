"""Tables of PDF collections as DataFrames, and the sinks: JSON, TSV, text and info.

Detection runs where the document is opened, in one Arrow kernel per partition:
no shuffle, and stitching sees all pages of a document. ``page`` filters may only
be pushed into it when stitching is off; ``pages_of`` does that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import layout
from ..operators.router import PAGE_AREA, scrubbed
from ..operators.tables import logical_tables, page_tables, stitch
from ..sources import pdf
from ..sources.batches import small_batches
from ..sources.objects import Limits
from ..sources.renderer import Renderer, rendered_rules, wants_render
from .options import TableOptions, TextOptions

CELL = "struct<row:int,col:int,rowspan:int,colspan:int,x0:double,y0:double,x1:double,y1:double,text:string,header:boolean>"
TABLE = f"struct<table_id:string,page:int,ord:int,method:string,confidence:double,rows:int,cols:int,x0:double,y0:double,x1:double,y1:double,fill:double,edge_score:double,joints:int,logical:int,continues:boolean,continued:boolean,notes:array<string>,pages:array<int>,cells:array<{CELL}>>"
SCHEMA = f"doc_id string, code string, message string, fragments array<{TABLE}>, logical_tables array<{TABLE}>"
#: Cells of an output batch.
CELLS = 5_000


def _named(found: list[dict], doc_id: str) -> list[dict]:
    return [t | {"ord": i, "table_id": hashlib.sha1(f"{doc_id}\0{t['page']}\0{i}".encode()).hexdigest(), "pages": t.get("pages", [t["page"]])} for i, t in enumerate(found)]


def _row(doc_id: str, content: bytes | None, options: TableOptions, limits: Limits, pages: frozenset | None, renderer: Renderer | None) -> dict:
    """A document's fault, or its tables on pages and its logical tables."""
    got = pdf.read(doc_id, content, limits, frozenset(("runs", "rules")))
    if got.get("code"):
        return {"doc_id": doc_id, "code": got["code"], "message": got["message"], "fragments": [], "logical_tables": []}
    runs, rules = {}, {}
    for r in got["runs"]:
        runs.setdefault(r["page"], []).append(r)
    for r in got["rules"]:
        rules.setdefault(r["page"], []).append((r["x0"], r["y0"], r["x1"], r["y1"], r["source"]))
    found = []
    for p in got["pages"]:
        if pages is None or p["page"] in pages:
            own = rules.get(p["page"], [])
            if renderer and wants_render(options, runs.get(p["page"], []), own):
                own = rendered_rules(renderer, content or b"", p, own)
            area = abs((p["x1"] - p["x0"]) * (p["y1"] - p["y0"]))
            found += page_tables(p["page"], runs.get(p["page"], []), own, options, area if area > 1 else PAGE_AREA)
    heights = {p["page"]: p["y1"] - p["y0"] for p in got["pages"]}
    found = stitch(found, heights, options.knobs) if options.stitch else [t | {"logical": i, "continues": False, "continued": False} for i, t in enumerate(found)]
    whole = logical_tables(found, options.knobs) if options.stitch else found
    whole = scrubbed(whole, options.knobs) if options.forms else whole
    return {"doc_id": doc_id, "fragments": _named(found, doc_id), "logical_tables": _named(whole, doc_id)}


def fragments(content: bytes | None, options: TableOptions, limits: Limits = Limits()) -> list[dict]:
    """The tables of one document's pages, outside Spark."""
    return _row("", content, options, limits, None, None)["fragments"] if options.detect else []


def _kernel(options: TableOptions, limits: Limits, pages: frozenset | None, schema: pa.Schema, renderer: Renderer | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for doc_id, content in zip(b.column("doc_id").to_pylist(), b.column("content")):
                held.append(_row(doc_id, content.as_py(), options, limits, pages, renderer))
                size += sum(len(t["cells"]) for t in held[-1]["fragments"]) + 1
                if size >= CELLS:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)

    return run


def detected(docs: DataFrame, options: TableOptions, limits: Limits = Limits(), pages: frozenset | None = None, renderer: Renderer | None = None) -> DataFrame:
    """A row per document of (doc_id, content), opened once: code and message if it can't be read, fragments and logical_tables."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "content")
    if not options.detect:  # nothing is opened
        none = F.array().cast(f"array<{TABLE}>")
        return own.select("doc_id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("message"), none.alias("fragments"), none.alias("logical_tables"))
    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))
    small_batches(docs.sparkSession)
    return own.mapInArrow(_kernel(options, limits, pages, schema, renderer), SCHEMA)


def tables(docs: DataFrame, options: TableOptions, limits: Limits = Limits(), renderer: Renderer | None = None) -> DataFrame:
    """A row per table fragment of (doc_id, content); ``errors`` has what could not be read."""
    return detected(docs, options, limits, renderer=renderer).select("doc_id", F.inline("fragments"))


def logical(docs: DataFrame, options: TableOptions, limits: Limits = Limits(), renderer: Renderer | None = None) -> DataFrame:
    """A row per logical table: fragments of following pages joined; of documents with many only what is surely data."""
    return detected(docs, options, limits, renderer=renderer).select("doc_id", F.inline("logical_tables"))


def errors(found: DataFrame) -> DataFrame:
    """doc_id, code, message of the documents of ``detected`` that could not be read."""
    return found.where("code is not null").select("doc_id", "code", "message")


def pages_of(docs: DataFrame, options: TableOptions, pages: list[int], limits: Limits = Limits()) -> DataFrame:
    """Tables of some pages. Without stitching only those pages are searched; with it the filter comes after."""
    if not options.stitch:
        return detected(docs, options, limits, frozenset(pages)).select("doc_id", F.inline("fragments"))
    return tables(docs, options, limits).where(F.col("page").isin(pages))


def cells(found: DataFrame) -> DataFrame:
    """A row per cell."""
    return found.select("doc_id", "table_id", "page", F.inline("cells"))


# Sinks


def _grid(rows: Column, cols: Column, cells: Column) -> Column:
    """Rows of cell texts; spans aren't repeated, and line ends and tabs are spaces. Cells are looked up by place, so the work is linear in them."""
    clean = lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), r"[\n\t]", " ")
    up = lambda n: F.sequence(F.lit(0), n - 1)
    # Of cells at one place the last counts; their order is that of rows and columns.
    place = lambda c: c["row"] * cols + c["col"]
    texts = F.aggregate(
        F.array_sort(F.transform(cells, lambda c, i: F.struct(place(c).alias("at"), i.alias("i"), clean(c["text"]).alias("text")))),
        F.struct(F.lit(-1).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, c: F.struct(
            c["at"].alias("at"),
            F.when(c["at"] == s["at"], F.concat(F.slice(s["out"], 1, F.size(s["out"]) - 1), F.array(c["text"])))
            .otherwise(F.concat(s["out"], F.array_repeat(F.lit(""), c["at"] - s["at"] - 1), F.array(c["text"])))
            .alias("out"),
        ),
        lambda s: F.concat(s["out"], F.array_repeat(F.lit(""), rows * cols - 1 - s["at"])),
    )
    return F.transform(F.array(texts), lambda flat: F.transform(up(rows), lambda r: F.slice(flat, r * cols + 1, cols)))[0]


def tsv(found: DataFrame) -> DataFrame:
    """doc_id, page, ord, tsv."""
    return found.select("doc_id", "page", "ord", F.array_join(F.transform(_grid(F.col("rows"), F.col("cols"), F.col("cells")), lambda r: F.array_join(r, "\t")), "\n").alias("tsv"))


def json(found: DataFrame, confidence: bool = True) -> DataFrame:
    """doc_id, json: each document's tables in order."""
    own = [F.round("confidence", 4).alias("confidence")] if confidence else []
    one = F.struct("ord", "page", "method", *own, "rows", "cols", "logical", _grid(F.col("rows"), F.col("cols"), F.col("cells")).alias("grid"))
    return found.groupBy("doc_id").agg(F.to_json(F.struct(F.count("*").alias("n_tables"), F.sort_array(F.collect_list(one)).alias("tables"))).alias("json"))


def text(docs: DataFrame, options: TextOptions = TextOptions(), limits: Limits = Limits()) -> DataFrame:
    """doc_id, page, text of every page with any."""
    got = pdf.extract(docs, ("runs",), limits)
    runs = pdf.relation(got, "runs")
    runs = runs if options.forms else runs.where(~F.col("in_form"))
    runs = runs if options.invisible else runs.where(~F.col("invisible"))
    if not options.reading_order:
        return layout.paint_text(runs)
    return layout.page_text(runs, pdf.relation(got, "pages")).select("doc_id", "page", "text")


def document_text(docs: DataFrame, options: TableOptions, limits: Limits = Limits()) -> DataFrame:
    """doc_id, text: pages, then their tables as TSV, then the logical tables if there are more or fewer of them."""
    pages = text(docs, limits=limits).select("doc_id", F.lit(0).alias("kind"), "page", F.lit(0).alias("ord"), "text")
    both = detected(docs, options, limits)
    line = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col("page"), F.col("ord"), F.col("tsv").alias("text"))
    parts = [tsv(both.where("code is null").select("doc_id", F.inline(name))).groupBy("doc_id").agg(F.collect_list(line(kind)).alias(name)) for kind, name in ((1, "fragments"), (2, "logical_tables"))]
    found = parts[0].join(parts[1], "doc_id", "left")
    rest = F.when(F.size("fragments") == F.size("logical_tables"), F.array().cast(parts[1].schema["logical_tables"].dataType)).otherwise(F.col("logical_tables"))
    tables_ = found.select("doc_id", F.inline(F.concat("fragments", F.coalesce(rest, F.array().cast(parts[1].schema["logical_tables"].dataType)))))
    every = F.sort_array(F.collect_list(F.struct("kind", "page", "ord", "text")))
    return pages.unionByName(tables_).groupBy("doc_id").agg(F.array_join(F.transform(every, lambda p: p["text"]), "\n\n").alias("text"))


def envelope(docs: DataFrame, options: TableOptions, name: str = "auto", limits: Limits = Limits()) -> DataFrame:
    """doc_id, json: pages with text and tables, objects, tables, logical tables and counts of each document."""
    got = pdf.extract(docs, ("objects",), limits).where("code is null")
    both = detected(docs, options, limits).where("code is null").select("doc_id", "fragments", "logical_tables")
    texts = text(docs, limits=limits).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page", "text"))).alias("texts"))
    whole = got.join(both, "doc_id", "left").join(texts, "doc_id", "left")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(whole.schema[c].dataType))
    short = lambda t: F.struct(t["page"].alias("page"), t["method"].alias("method"), t["confidence"].alias("confidence"), t["rows"].alias("rows"), t["cols"].alias("cols"), t["logical"].alias("logical"), t["cells"].alias("cells"))
    fragments, logical_ = F.transform(none("fragments"), short), F.transform(none("logical_tables"), short)
    page = lambda p: F.struct(
        p["page"].alias("index"),
        p["rotate"].alias("rotate"),
        F.coalesce(F.try_element_at(F.col("texts"), p["page"]), F.lit("")).alias("text"),
        F.filter(fragments, lambda t: t["page"] == p["page"]).alias("tables"),
    )
    roots = F.when(F.lit(options.stitch), logical_).otherwise(fragments)
    return whole.select(
        "doc_id",
        F.to_json(
            F.struct(
                F.lit(1).alias("schema_version"),
                F.col("n_pages").alias("page_count"),
                "version",
                F.lit(options.detect).alias("tables_enabled"),
                F.lit(name).alias("table_preset"),
                F.lit(options.stitch).alias("stitch_multipage"),
                F.transform("pages", page).alias("pages"),
                F.size(none("images")).alias("image_count"),
                none("images").alias("images"),
                F.transform(none("links"), lambda x: x["uri"]).alias("links"),
                F.transform(none("fields"), lambda x: F.concat_ws("=", x["name"], x["value"])).alias("form_fields"),
                none("outline").alias("outline"),
                roots.alias("tables"),
                F.size(roots).alias("table_count"),
                logical_.alias("logical_tables"),
                F.size(fragments).alias("page_table_count"),
            )
        ).alias("json"),
    )


def info(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_pages, version, title and the first five rotations."""
    return pdf.extract(docs, (), limits).where("code is null").select("doc_id", "n_pages", "version", "title", F.transform(F.slice("pages", 1, 5), lambda p: p["rotate"]).alias("rotations"))


def evidence(found: DataFrame) -> DataFrame:
    """Per page the number of tables, by method, and what they are."""
    label = F.concat_ws(" ", "method", F.concat_ws("x", "rows", "cols"))
    return found.groupBy("doc_id", "page").agg(
        F.count("*").alias("n_tables"),
        *[F.count_if(F.col("method") == m).alias(f"n_{m}") for m in ("lattice", "hybrid", "network")],
        F.sort_array(F.collect_list(label)).alias("tables"),
    )
