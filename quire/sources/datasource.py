"""``spark.read.format("quire_pdf")``: pages of PDF files as rows, and files that can't be read as rows with a code.

Columns: path, page, text, n_runs, n_rules, rotate, code, message. Paths may be of
any file system that pyarrow knows (local, hdfs://, s3://, gs://): they are listed
where the query is planned and opened where it runs.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .objects import Limits
from .pdf import read


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class PdfSource(DataSource):
    """Options: path (a file, a folder, searched to any depth, or a pattern), filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "quire_pdf"

    def schema(self) -> str:
        return "path string, page int, text string, n_runs int, n_rules int, rotate int, code string, message string"

    def reader(self, schema) -> DataSourceReader:
        return PdfReader(self.options)


def _place(path: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    if "://" in path and not path.startswith("file://"):
        return FileSystem.from_uri(path)
    return LocalFileSystem(), path.removeprefix("file://")


def listed(path: str) -> list[str]:
    """The PDF files of a path in order; without a match, none."""
    from pyarrow.fs import FileSelector, FileType

    fs, own = _place(path)
    scheme = path.partition("://")[0] + "://" if "://" in path and not path.startswith("file://") else ""
    if any(c in own for c in "*?["):
        folder = own[: min(own.index(c) for c in "*?[" if c in own)].rpartition("/")[0] or "."
        found = [f.path for f in fs.get_file_info(FileSelector(folder, recursive=True, allow_not_found=True)) if f.type == FileType.File and fnmatch.fnmatch(f.path, own)]
    elif (info := fs.get_file_info(own)).type == FileType.Directory:
        found = [f.path for f in fs.get_file_info(FileSelector(own, recursive=True)) if f.type == FileType.File and f.path.lower().endswith(".pdf")]
    else:
        found = [own] if info.type == FileType.File else []
    return sorted(scheme + f for f in found)


class PdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.each = listed(options.get("path", "")), max(1, int(options.get("filesPerPartition", 64)))

    def partitions(self) -> list[InputPartition]:
        return [_Files(self.paths[i : i + self.each]) for i in range(0, len(self.paths), self.each)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            fs, own = _place(path)
            try:
                with fs.open_input_stream(own) as f:
                    content = f.read()
            except OSError as e:
                yield path, None, None, None, None, None, "unreadable", str(e)
                continue
            got = read(path, content, Limits(), frozenset(("runs", "rules")))
            if got.get("code"):
                yield path, None, None, None, None, None, got["code"], got["message"]
                continue
            texts: dict[int, list[str]] = {}
            rules: dict[int, int] = {}
            for r in got["runs"]:
                texts.setdefault(r["page"], []).append(r["text"])
            for r in got["rules"]:
                rules[r["page"]] = rules.get(r["page"], 0) + 1
            for p in got["pages"]:
                runs = texts.get(p["page"], [])
                yield path, p["page"], "".join(runs), len(runs), rules.get(p["page"], 0), p["rotate"], None, None
