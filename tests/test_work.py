"""How much is done for a page, in calls, which unlike seconds are the same everywhere."""

import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from quire.plans import tables
from quire.plans.options import preset
from quire.plans.tables import fragments
from quire.sources import fonts, pdf, raster, render
from quire.sources.batches import BATCH
from quire.sources.objects import Limits
from quire.sources.writer import document


def calls(f, *args):
    """A function's result and the calls, of Python and C functions, that it made."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        out = f(*args)
    finally:
        sys.setprofile(None)
    return out, n


def test_painted_lines_are_not_sought_row_by_row():
    px = np.full((440, 1068), 255, np.uint8)
    for y in range(1, 440, 36):
        px[y : y + 2] = 0
    for x in (1, 267, 533, 799, 1065):
        px[:, x : x + 2] = 0
    found, n = calls(raster.grid_lines, px)
    assert [r for r in found if r[1] == r[3]] == [(0, y + 1.0, 1068, y + 1.0) for y in range(1, 440, 36)]
    assert [r for r in found if r[0] == r[2]] == [(x + 1.0, 0, x + 1.0, 440) for x in (1, 267, 533, 799, 1065)]
    assert n < 2000


def drawn(style):
    return document(render._pages([[str(k), "F", f"{k}.25", "3-MEDIUM"] for k in range(12)], None, style, 12, 18.0))


@pytest.mark.parametrize("style, name, most", [("ruled", "full", 20_000), ("columns", "lattice_only", 11_000), ("filled", "lattice_only", 13_000), ("ruled", "lattice_only", 13_000)])
def test_a_page_is_read_in_few_calls(style, name, most):
    fragments(drawn(style), preset(name))
    found, n = calls(fragments, drawn(style), preset(name))
    assert [c["text"] for c in found[0]["cells"]] == [x for k in range(12) for x in (str(k), "F", f"{k}.25", "3-MEDIUM")]
    assert n < most, n


def test_fonts_of_equal_bytes_are_read_once_and_others_apart():
    one = drawn("ruled")
    other = one.replace(b"/Widths [278", b"/Widths [279", 1)
    width = lambda content: pdf.read("", content, Limits(), frozenset(("runs",)))["runs"][0]["x1"]
    spaced = one.replace(b"278 278 355 556", b"278 278 355 999", 1).replace(b"556 556 556", b"999 999 999")
    assert width(one) == width(other) == width(one) != width(spaced)
    fonts._FONTS.clear()
    read, before = calls(pdf.read, "", one, Limits(), frozenset(("runs",)))
    again, after = calls(pdf.read, "", one, Limits(), frozenset(("runs",)))
    assert again == read and after < before


def test_drawn_documents_leave_a_worker_in_small_batches():
    rows = pa.record_batch({"doc_id": [str(k) for k in range(300)], "n": list(range(300))})
    out = list(render._kernel(lambda r: bytes([r["n"] % 256]) * 50_000)(iter([rows])))
    assert max(b.nbytes for b in out) < BATCH + 60_000
    assert [(i, c[0], len(c)) for b in out for i, c in zip(b["doc_id"].to_pylist(), b["content"].to_pylist())] == [(str(k), k % 256, 50_000) for k in range(300)]


def test_found_tables_leave_a_worker_in_small_batches():
    schema = to_arrow_schema(StructType([StructField("doc_id", StringType()), StructField("fragments", ArrayType(StructType([StructField("cells", ArrayType(StructType([StructField("text", StringType())])))])))]))
    docs = pa.record_batch({"doc_id": [str(k) for k in range(300)], "content": [drawn("ruled")] * 300})
    out = list(tables._kernel(preset("lattice_only"), Limits(), None, schema, None)(iter([docs])))
    assert sum(len(b) for b in out) == 300 and max(len(b) for b in out) <= 110
