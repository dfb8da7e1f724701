"""``python -m quire extract PATH`` and ``python -m quire info PATH``: text, tables or facts of PDF files on standard output."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import tables as T
from .plans.options import PRESETS, chosen, page_range
from .sources import pdf
from .sources.renderer import CommandRenderer


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("quire", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract")
    e.add_argument("path")
    e.add_argument("--format", choices=("text", "json", "tsv", "evidence"), default="text")
    e.add_argument("--preset", choices=sorted(PRESETS))
    e.add_argument("--hq", action="store_true")
    e.add_argument("--tables", action="store_true", help="the preset auto")
    e.add_argument("--tuning", default="")
    e.add_argument("--pages", help="1-based, like 1-3,5")
    sub.add_parser("info").add_argument("path")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    docs = pdf.load(spark, a.path)
    if a.command == "info":
        for r in T.info(docs).orderBy("doc_id").toLocalIterator():
            print(r["doc_id"], f"pages {r['n_pages']}", f"version {r['version']}", f"title {r['title'] or ''}", f"rotations {list(r['rotations'])}", sep="\t")
        return 0
    options = chosen(a.preset, a.hq, a.tables, a.tuning)
    renderer = CommandRenderer() if options.render or options.auto_render else None
    both = T.detected(docs, options, renderer=renderer).persist()  # a document is opened once for its tables and its fault
    found = both.select("doc_id", F.inline("fragments"))
    if a.pages:
        most = T.info(docs).agg(F.max("n_pages")).first()[0] or 0
        found = T.pages_of(docs, options, page_range(a.pages, most))
    if a.format == "text":
        for r in T.document_text(docs, options).orderBy("doc_id").toLocalIterator():
            print(r["text"])
    elif a.format == "json":
        name = a.preset or ("high_quality" if a.hq else "auto" if a.tables else "off")
        for r in T.envelope(docs, options, name).orderBy("doc_id").toLocalIterator():
            print(r["json"])
    elif a.format == "tsv":
        for r in T.tsv(found).orderBy("doc_id", "page", "ord").toLocalIterator():
            print(r["tsv"], end="\n\n")
    else:
        for r in T.evidence(found).orderBy("doc_id", "page").toLocalIterator():
            print(r["doc_id"], r["page"] + 1, r["n_tables"], ", ".join(r["tables"]), sep="\t")
    faults = T.errors(both) if options.detect else pdf.errors(pdf.extract(docs, ()))
    for r in faults.toLocalIterator():
        print(f"{r['doc_id']}: {r['code']}: {r['message']}")
    both.unpersist()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
