"""The object layer, fonts, content and detectors on documents made here."""

import base64
import zlib
from dataclasses import fields

import pytest

from quire.operators import refine, router
from quire.operators.stream import stream
from quire.operators.tables import areas, cell_text, clusters, is_prose, logical_tables, page_tables, split_sides, stitch
from quire.plans.options import ALIASES, Knobs, TableOptions, as_row, chosen, page_range, preset, tuned, with_settings
from quire.sources import fonts
from quire.sources.content import interpret
from quire.sources.objects import END, Document, Keyword, Lexer, Limits, Name, PdfError, Ref, Stream
from quire.sources.pdf import PARTS, read
from quire.sources.raster import merged
from quire.sources.writer import Page, document, table

ROWS = [["Key", "A", "B", "C"]] + [[f"k{i}", str(i), str(i * 10), f"{i * 1.5:.2f}"] for i in range(6)]
XS = [72, 150, 250, 350, 450]


def one(*pages, **more):
    return read("d", document(pages, **more), Limits(), frozenset(PARTS))


def detect(page, name="auto", **more):
    got = one(page, **more)
    return page_tables(0, got["runs"], [(r["x0"], r["y0"], r["x1"], r["y1"], r["source"]) for r in got["rules"]], preset(name))


def grid(t):
    return [[next((c["text"] for c in t["cells"] if (c["row"], c["col"]) == (r, k)), None) for k in range(t["cols"])] for r in range(t["rows"])]


def test_lexer():
    lex = Lexer(b"% note\n-1.5 +3 .5 4. /A#20B /N(a(b)\\)\\101\\\nc) <48 65 6> [1 2 R 3 0 R] << /K [true null] /D << /E 1 >> >> Tj")
    got = []
    while (x := lex.next()) is not END:
        got.append(x)
    assert got == [-1.5, 3, 0.5, 4.0, Name("A B"), Name("N"), b"a(b))Ac", b"He`", [Ref(1, 2), Ref(3, 0)], {"K": [True, None], "D": {"E": 1}}, Keyword("Tj")]


@pytest.mark.parametrize("name, made", [("FlateDecode", zlib.compress), ("ASCIIHexDecode", lambda d: d.hex().encode() + b">"), ("ASCII85Decode", lambda d: base64.a85encode(d) + b"~>"), ("RunLengthDecode", lambda d: bytes([len(d) - 1]) + d + b"\x80"), ("LZWDecode", lambda d: b"\x80\x0b\x60\x50\x22\x0c\x0c\x85\x01")])
def test_filters(name, made):
    doc = Document(document([Page()]))
    want = b"-----A---B" if name == "LZWDecode" else b"hello hello hello"
    assert doc.decode(Stream({"Filter": Name(name)}, made(want)))[: len(want)] in (want, bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66]))


def test_predictors_and_unknown_filters():
    doc = Document(document([Page()]))
    rows = bytes([2, 1, 2, 3, 2, 1, 1, 1])
    assert doc.decode(Stream({"Filter": [Name("FlateDecode")], "DecodeParms": [{"Predictor": 12, "Columns": 3}]}, zlib.compress(rows))) == bytes([1, 2, 3, 2, 3, 4])
    with pytest.raises(PdfError, match="DCTDecode"):
        doc.decode(Stream({"Filter": Name("DCTDecode")}, b""))


def test_limits():
    with pytest.raises(PdfError) as e:
        Document(document([Page()]), Limits(file_bytes=10))
    assert e.value.code == "limit_file_bytes"
    doc = Document(document([Page()]))
    with pytest.raises(PdfError) as e:
        doc.decode(Stream({"Filter": Name("FlateDecode")}, zlib.compress(bytes(5_000_000))))
    assert e.value.code == "limit_ratio"


def test_damaged_and_hostile_files():
    assert one(Page(), encrypt=True)["code"] == "encrypted"
    assert read("x", b"", Limits(), frozenset())["code"] == "not_pdf"
    assert read("x", None, Limits(), frozenset())["code"] == "not_pdf"
    whole = document([Page(), Page()], outline=["a"])
    cut = whole[: whole.rfind(b"xref\n0")]
    assert read("x", cut, Limits(), frozenset(PARTS))["n_pages"] == 2
    looped = whole.replace(b"/Title (a)", b"/Title (a) /Next %d 0 R" % 99)
    assert Document(looped).outline() == ["a"]
    p = Page()
    p.forms["F"] = b"/F Do 0 0 m 50 0 l S"
    p.raw(b"/F Do")
    assert len(one(p)["rules"]) == 1 and one(p)["warnings"]


def test_object_and_cross_reference_streams():
    inner = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>"), (3, b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 200 100] /Rotate 90 >>")]
    head, body = b"", b""
    for n, x in inner:
        head += b"%d %d " % (n, len(body))
        body += x + b" "
    packed = zlib.compress(head + body)
    out = b"%PDF-1.5\n"
    at4 = len(out)
    out += b"4 0 obj\n<< /Type /ObjStm /N 3 /First %d /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n" % (len(head), len(packed), packed)
    at5 = len(out)
    table_ = b"".join(bytes([k]) + a.to_bytes(2, "big") + bytes([b]) for k, a, b in [(0, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, at4, 0), (1, at5, 0)])
    out += b"5 0 obj\n<< /Type /XRef /Size 6 /W [1 2 1] /Root 1 0 R /Length %d >>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % (len(table_), table_, at5)
    doc = Document(out)
    assert doc.version == "1.5" and doc.pages()[0]["media_box"] == (0, 0, 200, 100) and doc.pages()[0]["rotate"] == 90


def test_fonts():
    f = fonts.Font(differences={65: "eacute", 66: "uni20AC", 67: "nosuch"}, unicode={68: "xyz"})
    assert [f.char(c) for c in (65, 66, 67, 68, 97, 0xE9, 1)] == [("é", 1.0), ("€", 1.0), (fonts.LOST, 0.0), ("xyz", 1.0), ("a", 1.0), ("é", 0.85), (fonts.LOST, 0.0)]
    m = fonts.to_unicode_map(b"2 beginbfchar <01> <0041> <02> <D83DDE00> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange")
    assert m == {1: "A", 2: "😀", 16: "a", 17: "b", 18: "c"}
    assert fonts.resolve({"B": f, "A": f}, "ABC+B")[0] == "B" and fonts.resolve({"B": f, "A": f}, "Z")[0] == "A"


def test_font_fallbacks():
    f = fonts.Font(wide=True, widths={65: 0.0}, ranges=[(1, 9, 250.0), (5, 20, 300.0)], default_width=1000.0)
    assert f.codes(b"\0A\0B\x07") == [65, 66, 7] and [f.width(c) for c in (65, 7, 12, 99)] == [0.0, 250.0, 300.0, 1000.0]
    g = fonts.Font(widths={65: 0.0, 66: 600.0})
    assert [g.width(c) for c in (65, 66, 67)] == [500.0, 600.0, 500.0]
    doc = Document(document([Page()]))
    broken = {"Type": Name("Font"), "Subtype": Name("Type0"), "DescendantFonts": [{"W": [1, 2, "x"]}]}
    named = fonts.page_fonts(doc, {"Font": {}}, {"Font": {"B": broken, "A": {"FirstChar": 65, "Widths": [700]}}})
    assert set(named) == {"A", "B"} and named["A"].width(65) == 700 and named["B"].char(65) == ("A", 1.0)
    assert set(fonts.page_fonts(doc, None)) == {"F1"}


def test_dashes_without_end():
    p = Page()
    p.raw(b"[0.01 0.01] 0 d 0 50 m 600 50 l S [2 1] 0 d 0 70 m 300 70 l S")
    rules = one(p)["rules"]
    assert len(rules) == 100 and {r["y0"] for r in rules} == {70}


def test_forms_use_names_of_their_page():
    inner, p = Page(), Page()
    p.forms["A"] = b"/B Do"
    p.forms["B"] = b"BT /F1 10 Tf 50 200 Td (deep) Tj ET"
    p.raw(b"/A Do")
    assert [r["text"] for r in one(p)["runs"]] == ["deep"]


def test_content_operators():
    p = Page()
    p.raw(b"q 1 0 0 1 10 20 cm 0 0 m 100 0 l S Q [10 5] 0 d 0 50 m 40 50 l S [] 0 d 0 0 20 2 re f 0 0 m 5 5 9 9 20 0 c S 0 60 30 10 re W n 0 65 m 90 65 l S")
    p.raw(b"BT /F1 10 Tf 3 Tr 50 200 Td (hid) Tj 0 Tr 14 TL (a) ' [(b) -500 (c)] TJ ET BI EI")
    got = one(p)
    assert [(r["x0"], r["y0"], r["x1"], r["source"]) for r in got["rules"]] == [(10, 20, 110, "stroke"), (0, 50, 10, "dash"), (15, 50, 25, "dash"), (30, 50, 40, "dash"), (0, 1, 20, "fill"), (0, 65, 30, "stroke")]
    assert [(r["text"], r["invisible"], r["metrics_confidence"]) for r in got["runs"]] == [("hid", True, 0.9), ("a", False, 0.9), ("bc", False, 0.95)]
    assert got["runs"][1]["y0"] < got["runs"][0]["y0"] and any("BI" in w["message"] for w in got["warnings"])
    doc = Document(document([p]), Limits(page_ops=3))
    assert "more operators" in interpret(doc, doc.pages()[0]).warnings[0]


def test_rotation_turns_pages_upright():
    p = Page(rotate=90)
    p.text(100, 200, "x")
    r = one(p)["runs"][0]
    assert (round(r["x0"]), round(r["y1"])) == (198, 512)


def test_document_objects():
    p = Page()
    p.links += ["http://a", "http://b"]
    p.images["I"] = (3, 2, bytes(6))
    got = one(p, title="T", outline=["one", "two"], fields=[("n", "v"), ("n", "w"), ("m", "")])
    assert [u["uri"] for u in got["links"]] == ["http://a", "http://b"] and got["title"] == "T" and got["outline"] == ["one", "two"]
    assert [(f["name"], f["value"]) for f in got["fields"]] == [("n", "v"), ("m", "")] and got["images"] == [{"page": 0, "name": "I", "width": 3, "height": 2}]


@pytest.mark.parametrize("style, method", [("ruled", "lattice"), ("filled", "lattice"), ("borderless", "network")])
def test_tables(style, method):
    p = Page()
    table(p, ROWS, XS, style=style)
    (t,) = detect(p)
    assert t["method"] == method and grid(t) == ROWS and detect(p, "off") == []
    assert all(c["header"] == (c["row"] == 0 or c["row"] == 1) for c in t["cells"])


def test_table_in_a_form():
    inner, p = Page(), Page()
    table(inner, ROWS, XS)
    p.forms["G"] = b"\n".join(o for o in inner.out if b" S" in o)
    p.raw(b"/G Do")
    table(p, ROWS, XS, style="borderless")
    assert [t["method"] for t in detect(p)] == ["lattice"]


def test_partly_ruled():
    p = Page()
    for a in ((70, 740, 520, 740), (70, 560, 520, 560), (70, 560, 70, 740), (70, 715, 520, 715)):
        p.line(*a)
    table(p, ROWS, [80, 180, 260, 340, 420], style="none")
    (t,) = detect(p)
    assert t["method"] == "hybrid" and grid(t) == ROWS


def test_spans():
    p = Page()
    for y in (700, 660, 620, 580):
        p.line(100, y, 400, y)
    for x in (100, 400):
        p.line(x, 580, x, 700)
    for x in (200, 300):
        p.line(x, 580, x, 660)
    p.text(110, 676, "wide")
    for k in range(3):
        p.text(110 + 100 * k, 636, f"c{k}")
        p.text(110 + 100 * k, 596, f"{k}5")
    (t,) = detect(p, "lattice_only")
    assert [(c["row"], c["col"], c["colspan"], c["text"]) for c in t["cells"]] == [(0, 0, 3, "wide"), *[(1, k, 1, f"c{k}") for k in range(3)], *[(2, k, 1, f"{k}5") for k in range(3)]]


def cells_of(texts, **more):
    """A table of texts as a candidate, cells 50 x 20 from (0, 0) down."""
    cells = [{"row": r, "col": c, "rowspan": 1, "colspan": 1, "x0": 50.0 * c, "y0": -20.0 * r - 20, "x1": 50.0 * c + 50, "y1": -20.0 * r, "text": x, "header": r == 0} for r, row in enumerate(texts) for c, x in enumerate(row)]
    full = sum(bool(c["text"]) for c in cells) / len(cells)
    t = {"page": 0, "method": "lattice", "confidence": 0.9, "rows": len(texts), "cols": len(texts[0]), "x0": 0.0, "y0": -20.0 * len(texts), "x1": 50.0 * len(texts[0]), "y1": 0.0, "fill": full, "edge_score": 1.0, "joints": 20, "notes": [], "cells": cells}
    return t | more


DATA = [["Name", "Count", "Price"], *[[f"item {i}", str(i * 7), f"{i}.50"] for i in range(1, 8)]]


def test_gates():
    k = preset("auto").knobs
    f = lambda t: router.facts(t)
    data, empty = cells_of(DATA), cells_of([["", "", "x"], ["", "", ""], ["", "", ""]])
    notice = cells_of([[f"a long line of words about rule {'x' * i}", "and some more of such words here"] for i in range(9)])
    tax = cells_of([["Social security number", ""], ["Name", "x"], ["Accounting method", "cash"]])
    assert not router.chrome(data, f(data)) and router.chrome(empty, f(empty)) and router.chrome(notice, f(notice)) and router.chrome(tax, f(tax))
    assert not router.chrome(empty | {"notes": ["raster"]}, f(empty))
    assert router.tax_form(f(tax)) and not router.tax_form(f(data))
    assert router.strong_lattice(data, k) and not router.strong_lattice(data | {"notes": ["weak_edges"]}, k) and router.solid_ruled(data, f(data), k)
    tall = cells_of([[f"r{i}", str(i)] for i in range(25)], notes=["densified"])
    assert not router.solid_ruled(tall, f(tall), k)
    flow = data | {"method": "network"}
    assert router.borderless_passes(flow, f(flow), k, True) and router.borderless_passes(flow, f(flow), k, False)
    words = cells_of([["some words in a row", "other words of it"]] * 5, method="network")
    assert not router.borderless_passes(words, f(words), k, True) and not router.borderless_passes(flow | {"confidence": 0.3}, f(flow), k, True)
    strip = cells_of([["Department of the Treasury", "OMB No. 1"], ["a", "1"], ["b", "2"], ["c", "3"]], method="network")
    assert not router.borderless_passes(strip, f(strip), k, True)
    kept = router.without_forms([data, flow, empty, words, tax], k)
    assert kept == [data, flow, tax]  # a full grid, of which chrome() has rid the page before
    assert router.data_score(data, f(data)) > 0.5 > router.data_score(empty, f(empty)) and router.form_score(empty, f(empty)) > router.form_score(data, f(data))
    hexes = cells_of([["0x1f", "a0b1", "ffee"]] * 6)
    towns = cells_of([["Name", "Town", "Count"], *[[f"Person {i}", "Northport", f"{i} units"] for i in range(8)]])
    assert not router.plausible(hexes, f(hexes)) and router.plausible(towns, f(towns))
    assert len(router.scrubbed([towns] * 9 + [hexes], k)) == 8 and len(router.scrubbed([hexes] * 8, k)) == 8 and router.scrubbed([hexes] * 9, k) == []


def test_relations_of_candidates():
    k = preset("auto").knobs
    data = cells_of(DATA)
    move = lambda t, dx, dy, **more: t | {"x0": t["x0"] + dx, "x1": t["x1"] + dx, "y0": t["y0"] + dy, "y1": t["y1"] + dy} | more
    hybrid, flow = data | {"method": "hybrid", "confidence": 0.8}, data | {"method": "network", "confidence": 0.9}
    assert router.without_ruled_twins([data, hybrid, move(hybrid, 400, 0)]) == [data, move(hybrid, 400, 0)]
    assert router.without_sparse_ruled([hybrid | {"fill": 0.3}, flow]) == [flow] and router.without_sparse_ruled([hybrid, flow]) == [hybrid, flow]
    assert router.without_wide_hybrids([hybrid | {"cols": 15}, flow]) == [flow]
    strip = data | {"cols": 2, "rows": 9}
    wide = flow | {"cols": 5}
    assert router.demoted_slices([strip, wide]) == [wide] and router.demoted_slices([move(strip, 0, 400), wide]) == [move(strip, 0, 400), wide]
    corner = data | {"cols": 2, "rows": 3, "x1": 40.0, "y0": -60.0}
    assert router.demoted_slices([corner, wide])[0]["confidence"] == pytest.approx(0.405)
    assert router.under_ruled(flow, [data]) and not router.under_ruled(flow | {"x1": 600.0, "x0": -100.0}, [data])
    small = move(flow, 0, -400, rows=2, x1=30.0)
    assert router.without_subordinate([flow, small, move(small, 200, 0)]) == [flow] and router.without_subordinate([flow, small]) == [flow, small]
    low = move(data, 0, -165)
    (one_,) = router.stacked([data, low])
    assert one_["rows"] == 15 and one_["cells"][-1]["row"] == 14 and len(router.stacked([data, move(data, 0, -400)])) == 2
    # Regions: a ruled one owns its place, a nested one stays, stacked ones are one region and give one table.
    inner = move(cells_of(DATA[:4], joints=9), 30, -40)
    outer = cells_of([[f"label {r}{c}" for c in range(6)] for r in range(12)])
    assert router.nested(inner, outer, router.Policy()) and {t["rows"] for t in router.routed([outer, inner, flow], k)} == {12, 4}
    p = router.Policy.of(k)
    merged_ = router.merged([router.proposal(data, 0, 484704, p), router.proposal(low, 1, 484704, p)], p)
    assert len(merged_) == 1 and merged_[0].sources == (0, 1) and router.emitted([data, low | {"confidence": 0.95}], merged_)[0]["confidence"] == 0.95
    assert not router.passes_gate(router.proposal(data | {"joints": 2}, 0, 484704, p), p)


def test_pages_of_several_tables():
    p = Page()
    table(p, ROWS, XS)
    table(p, [["P", *r[1:]] for r in ROWS], XS, top=400, style="borderless")
    found = detect(p)
    assert [(t["method"], grid(t)[0][0]) for t in found] == [("lattice", "Key"), ("network", "P")]
    # A frame around the page is no table, and what stands in it still is one.
    q = Page()
    for a in ((20, 20, 590, 20), (20, 770, 590, 770), (20, 20, 20, 770), (590, 20, 590, 770), (20, 400, 590, 400)):
        q.line(*a)
    table(q, ROWS, XS, style="borderless")
    assert [(t["rows"], t["cols"]) for t in detect(q)] == [(7, 4)]


def test_repairs():
    k = Knobs()
    assert refine.apart([0, 1, 10, 11.5], 3) == [0, 11.5] and refine.apart([0, 10, 20], 3) == [0, 10, 20]
    assert [refine.grows(*n, k) for n in ((4, 6), (10, 20), (5, 9), (10, 40), (3, 3))] == [True, False, True, True, False]
    t = cells_of([["a", "", "1", ""], ["b", "", "2", ""], ["c", "", "3", "x"]])
    u = refine.without_empty_columns(t)
    assert u["cols"] == 3 and grid(u)[2] == ["c", "3", "x"] and refine.without_empty_columns(cells_of(DATA))["cols"] == 3
    spread = refine.spread_tokens(cells_of([["1 2 3", "", ""], ["label", "4 5", ""], ["x", "y", "z"]]))
    assert grid(spread) == [["1", "2", "3"], ["label", "4", "5"], ["x", "y", "z"]]
    assert grid(refine.spread_tokens(cells_of([["Speed limit 50", ""], ["a", "b"]])))[0] == ["Speed limit", "50"]
    assert refine.split_words("NetIncomeTotal of 2020") == ["Net", "Income", "Total", "of", "2020"]
    run = {"x0": 0.0, "x1": 90.0, "y0": 0.0, "y1": 10.0, "font_size": 10.0, "text": "YearCountPrice"}
    assert [r["text"] for r in refine.unglued_header([run], 3)] == ["Year", "Count", "Price"] and refine.unglued_header([run], 8) == [run]
    lines = [[{"x0": 0.0, "x1": 100.0, "y0": 50.0 + d, "y1": 60.0, "font_size": 10.0, "text": "x"}] for d in (0, 0.5, 1.0)]
    assert refine.without_baselines([(0, 50, 90, 50), (0, 300, 90, 300), (5, 0, 5, 90)], lines, 10.0, 2.0) == [(0, 300, 90, 300), (5, 0, 5, 90)]


def test_columns_beside_a_frame():
    p = Page()
    table(p, [r[1:] for r in ROWS], XS[1:])
    for i, r in enumerate(ROWS):
        p.text(XS[0] + 3, 740 - 18 * i - 13, r[0])
    (t,) = detect(p, "lattice_only")
    assert "outer_columns" in t["notes"] and grid(t) == ROWS


def test_whitespace_detector():
    p = Page()
    table(p, ROWS, XS, style="borderless")
    got = one(p)
    (t,) = stream(0, got["runs"], Knobs())
    assert t["method"] == "stream" and grid(t) == ROWS
    q = Page()
    for i in range(8):
        q.text(72, 700 - 14 * i, f"word{'s' * (i % 3)}")
        q.text(300, 700 - 14 * i, f"other{'s' * (i % 2)}")
    assert stream(0, one(q)["runs"], Knobs()) == [] and stream(0, [], Knobs()) == []


def test_areas():
    line = lambda y, xs: [{"x0": float(x), "x1": x + 20.0, "y0": y - 5.0, "y1": y + 5.0, "font_size": 10.0, "text": "x"} for x in xs]
    rows = [line(700 - 14 * i, (50, 150, 250)) for i in range(5)] + [line(600 - 14 * i, (60, 200)) for i in range(5)]
    assert [len(a) for a in areas(rows, 10.0, Knobs())] == [5, 5]
    same = [line(700 - 14 * i, (50, 150, 250)) for i in range(5)] + [line(600 - 14 * i, (50, 150, 250)) for i in range(5)]
    assert [len(a) for a in areas(same, 10.0, Knobs())] == [10]
    far = [line(700 - 14 * i, (50, 150, 250)) for i in range(5)] + [line(300 - 14 * i, (50, 150, 250)) for i in range(5)]
    assert [len(a) for a in areas(far, 10.0, Knobs())] == [5, 5] and areas([], 10.0, Knobs()) == []


def test_prose_and_lists_are_no_tables():
    p = Page()
    for i in range(12):
        p.text(72, 700 - 14 * i, "A long line of prose that goes on over the whole width of the page and on.")
    assert detect(p) == [] and is_prose(["1.", "word", "2.", "word"], Knobs()) and is_prose([], Knobs())


def test_side_by_side_and_choice():
    cells = [{"row": r, "col": c, "rowspan": 1, "colspan": 1, "x0": 50.0 * c, "y0": -20.0 * r, "x1": 50.0 * c + 50, "y1": 20 - 20.0 * r, "text": "" if c == 2 else f"{r}{c}", "header": False} for r in range(3) for c in range(5)]
    t = {"page": 0, "method": "lattice", "confidence": 0.9, "rows": 3, "cols": 5, "x0": 0.0, "y0": -40.0, "x1": 250.0, "y1": 20.0, "notes": [], "cells": cells}
    a, b = split_sides(t, Knobs())
    assert (a["cols"], b["cols"]) == (2, 2) and grid(b) == [["03", "04"], ["13", "14"], ["23", "24"]]
    inner, more = t | {"method": "network", "x0": 10.0, "x1": 240.0}, {"fill": 0.8, "edge_score": 1.0, "joints": 12}
    assert [x["method"] for x in router.suppressed([inner | more, t | more], Knobs())] == ["lattice"]
    many = [t | more | {"y0": 200.0 * i, "y1": 200.0 * i + 60} for i in range(20)]
    assert len(router.routed(many, preset("auto").knobs)) == 12


def test_stitching():
    p, q = Page(), Page()
    table(p, [ROWS[0]] + [[f"p{i}", "1", "2", "3"] for i in range(36)], XS)
    table(q, [ROWS[0]] + [[f"q{i}", "1", "2", "3"] for i in range(5)], XS)
    got = one(p, q)
    found = [t for k in (0, 1) for t in page_tables(k, [r for r in got["runs"] if r["page"] == k], [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in got["rules"] if r["page"] == k], preset("auto"))]
    linked = stitch(found, {0: 792, 1: 792}, Knobs())
    assert [t["logical"] for t in linked] == [0, 0] and linked[0]["continues"] and linked[1]["continued"]
    (whole,) = logical_tables(linked, Knobs())
    assert whole["rows"] == 42 and grid(whole)[-1][0] == "q4" and whole["pages"] == [0, 1]


def test_small_parts():
    assert clusters([0, 1.5, 3.0, 10], 2) == [0.75, 3.0, 10]
    run = lambda x, y, t: {"x0": x, "x1": x + 5, "y0": y, "y1": y + 10, "text": t}
    assert cell_text([run(0, 0, "ued"), run(0, 20, "contin-"), run(9, 0, "x")]) == "continued x"


def test_options():
    assert page_range("1-3,2,5", 5) == [0, 1, 2, 1, 4]
    for bad in ("0", "4-2", "6", "x", "1-"):
        with pytest.raises(ValueError):
            page_range(bad, 5)
    assert set(ALIASES.values()) <= {f.name for f in fields(Knobs)} | {f.name for f in fields(TableOptions)}
    many = with_settings(preset("auto"), {"lattice_v_span_frac": 0.5, "use_engine_v2": 0, "min_table_confidence": 0.6})
    assert (many.knobs.v_span, many.router, many.knobs.min_confidence_hybrid) == (0.5, False, 0.6)
    with pytest.raises(ValueError):
        with_settings(preset("auto"), {"use_engine_v2": 2})
    o = tuned(preset("auto"), "snap=3; min_joints:5")
    assert o.knobs.snap == 3 and o.knobs.min_joints == 5 and as_row(o)["snap"] == 3
    for bad in ("nope=1", "min_joints=1.5", "snap=inf", "snap"):
        with pytest.raises(ValueError):
            tuned(o, bad)
    assert chosen("fast", True, True).auto_render is False and chosen(high_quality=True, auto=True) == preset("high_quality") and not chosen().detect


def test_missing_row_lines_and_painted_lines():
    for style in ("columns", "painted"):
        p = Page()
        table(p, ROWS, XS, style=style)
        (t,) = detect(p, "lattice_only")
        assert grid(t) == ROWS and ("densified" in t["notes"]) == (style == "columns")


def test_a_painted_table_beside_drawn_lines():
    p = Page()
    table(p, ROWS, XS)
    table(p, [["P", *r[1:]] for r in ROWS], XS, top=400, style="painted")
    assert [(t["method"], grid(t)) for t in detect(p, "lattice_only")] == [("lattice", ROWS), ("lattice", [["P", *r[1:]] for r in ROWS])]
    # A grid that is drawn and painted has its lines once.
    q = Page()
    table(q, ROWS, XS)
    drawn = len(one(q)["rules"])
    table(q, ROWS, XS, style="painted")
    assert len(one(q)["rules"]) == drawn and [grid(t)[0][1] for t in detect(q, "lattice_only")] == ["A A"]


def test_merged_rules():
    drawn = [(0, 10, 100, 10, "stroke"), (50, 0, 50, 40, "stroke")]
    again, longer, other = (1, 11, 99, 11, "raster"), (0, 10, 150, 10, "raster"), (50, 10, 80, 10.5, "raster")
    assert merged(drawn, [again, longer, longer, other]) == [*drawn, longer]
    assert merged([], [again, again]) == [again] and merged(drawn, [(10, 14, 40, 14, "raster")]) == [*drawn, (10, 14, 40, 14, "raster")]


def test_glued_rows():
    p = Page()
    table(p, [[f"row {chr(97 + i)}", str(1000 + i), f"{i}.5", "7"] for i in range(8)], XS, style="glued")
    (t,) = detect(p)
    assert t["cols"] == 4 and grid(t)[2] == ["row c", "1002", "2.5", "7"]


def test_token_splits_and_footers():
    assert refine.split_tokens("201920202021 1.2343.456 12,3454,567 x") == ["2019", "2020", "2021", "1.234", "3.456", "12,345", "4,567", "x"]
    p = Page()
    table(p, ROWS + [["Total", "", "", "99"]], XS, style="ruled")
    (t,) = detect(p)
    assert t["rows"] in (7, 8)
    cells = [{"row": r, "col": c, "rowspan": 1, "colspan": 1, "x0": 0.0, "y0": -r * 10.0, "x1": 1.0, "y1": 10 - r * 10.0, "text": f"{r}{c}" if r < 5 else ("Total" if c == 4 else "9" if c == 5 else ""), "header": False} for r in range(6) for c in range(6)]
    cut = refine.without_footer({"rows": 6, "cols": 6, "cells": cells, "notes": [], "y0": -50.0})
    assert cut["rows"] == 5 and cut["y0"] == -40
