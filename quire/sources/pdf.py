"""PDF collections as DataFrames: one kernel opens a document once and gives every relation.

``load`` reads files with Spark's binaryFile source; ``extract`` turns
(doc_id, content) into one row per document with nested relations, of which the
relation functions explode what they need. Only wanted parts are computed. A
document that can't be read is an error row, never a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import small_batches
from .content import interpret
from .objects import Document, Limits, PdfError
from .raster import image_rules, merged

RUN = "struct<page:int,ord:int,text:string,x0:double,y0:double,x1:double,y1:double,font_name:string,font_size:double,mapping_confidence:double,metrics_confidence:double,invisible:boolean,in_form:boolean>"
RULE = "struct<page:int,ord:int,x0:double,y0:double,x1:double,y1:double,source:string>"
PAGE = "struct<page:int,x0:double,y0:double,x1:double,y1:double,crop:array<double>,rotate:int>"
PLACEMENT = "struct<page:int,ord:int,name:string,ctm:array<double>>"
IMAGE = "struct<page:int,name:string,width:int,height:int>"
SCHEMA = (
    f"doc_id string, code string, message string, version string, title string, author string, producer string, n_pages int, pages array<{PAGE}>, runs array<{RUN}>, rules array<{RULE}>, "
    f"placements array<{PLACEMENT}>, images array<{IMAGE}>, links array<struct<page:int,uri:string>>, fields array<struct<ord:int,name:string,value:string>>, outline array<string>, "
    "warnings array<struct<page:int,message:string>>"
)
PARTS = ("runs", "rules", "objects")


def load(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), content, length of the files under a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("doc_id"), "content", "length")


def upright(x: float, y: float, box: tuple, rotate: int) -> tuple[float, float]:
    """A point of a rotated page where it stands when the page is turned upright."""
    x0, y0, x1, y1 = box
    return {90: (y - y0 + x0, x1 - x + y0), 180: (x0 + x1 - x, y0 + y1 - y), 270: (y1 - y + x0, x - x0 + y0)}.get(rotate, (x, y))


def _turned(r: dict | tuple, box: tuple, rotate: int):
    xy = (r["x0"], r["y0"], r["x1"], r["y1"]) if isinstance(r, dict) else r[:4]
    (a, b), (c, d) = upright(xy[0], xy[1], box, rotate), upright(xy[2], xy[3], box, rotate)
    new = (min(a, c), min(b, d), max(a, c), max(b, d))
    return r | dict(zip(("x0", "y0", "x1", "y1"), new)) if isinstance(r, dict) else (*new, *r[4:])


def read(doc_id: str, content: bytes | None, limits: Limits, parts: frozenset) -> dict:
    """All relations of one document as a row."""
    row: dict = {"doc_id": doc_id}
    try:
        doc = Document(content or b"", limits)
        pages = doc.pages()
        row |= doc.meta() | {"version": doc.version, "n_pages": len(pages)}
        lists: dict[str, list] = {k: [] for k in ("pages", "runs", "rules", "placements", "images", "links", "warnings")}
        for k, p in enumerate(pages):
            box = p["media_box"]
            lists["pages"].append({"page": k, **dict(zip(("x0", "y0", "x1", "y1"), box)), "crop": list(p["crop_box"]) if p["crop_box"] else None, "rotate": p["rotate"]})
            if parts & {"runs", "rules"}:
                found = interpret(doc, p)
                if "rules" in parts and found.placements:
                    found.rules = merged(found.rules, [r for n, m in found.placements for r in image_rules(doc, p["resources"], n, m)])
                if p["rotate"] in (90, 180, 270):
                    found.runs, found.rules = [_turned(r, box, p["rotate"]) for r in found.runs], [_turned(r, box, p["rotate"]) for r in found.rules]
                lists["runs"] += [{"page": k, "ord": i, **r} for i, r in enumerate(found.runs)]
                lists["rules"] += [{"page": k, "ord": i, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "source": source} for i, (x0, y0, x1, y1, source) in enumerate(found.rules)]
                lists["placements"] += [{"page": k, "ord": i, "name": n, "ctm": [float(v) for v in m]} for i, (n, m) in enumerate(found.placements)]
                lists["warnings"] += [{"page": k, "message": w} for w in found.warnings] + ([] if found.runs else [{"page": k, "message": "no text runs extracted"}])
            if "objects" in parts:
                lists["images"] += [{"page": k, **i} for i in doc.images(p["resources"])]
                lists["links"] += [{"page": k, "uri": u} for u in doc.links(p["page"])]
        if "objects" in parts:
            row["fields"] = [{"ord": i, "name": n, "value": v} for i, (n, v) in enumerate(doc.fields())]
            row["outline"] = doc.outline()
        row |= lists
    except PdfError as e:
        row |= {"code": e.code, "message": str(e)}
    except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError, OverflowError) as e:
        row |= {"code": "damaged", "message": f"{type(e).__name__}: {e}"}
    return row


def _kernel(limits: Limits, parts: frozenset, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").cast(pa.string()).to_pylist()
            for k, content in enumerate(b.column("content")):
                row = read(ids[k], content.as_py(), limits, parts)
                yield pa.RecordBatch.from_pylist([{n: row.get(n) for n in schema.names}], schema)

    return run


def extract(docs: DataFrame, parts: tuple[str, ...] = PARTS, limits: Limits = Limits()) -> DataFrame:
    """One row per document of (doc_id, content) with its nested relations; ``parts`` names what is computed."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(_kernel(limits, frozenset(parts), schema), SCHEMA)


def relation(extracted: DataFrame, name: str) -> DataFrame:
    """pages, runs, rules, placements, images, links, fields, warnings: a row each with its doc_id."""
    return extracted.select("doc_id", F.inline(name))


def errors(extracted: DataFrame) -> DataFrame:
    return extracted.where("code is not null").select("doc_id", "code", "message")


def meta(extracted: DataFrame) -> DataFrame:
    return extracted.where("code is null").select("doc_id", "title", "author", "producer", "version", "n_pages")


def outline(extracted: DataFrame) -> DataFrame:
    return extracted.select("doc_id", F.posexplode("outline").alias("ord", "title"))
