"""A small PDF writer, which renders rows as pages for tests and queries."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Sequence


def _escaped(text: str) -> bytes:
    raw = text.encode("cp1252", "replace")
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


class Page:
    """Drawing commands of one page."""

    def __init__(self, width: float = 612, height: float = 792, rotate: int = 0):
        self.width, self.height, self.rotate, self.out, self.links, self.forms, self.images = width, height, rotate, [], [], {}, {}

    def text(self, x: float, y: float, text: str, size: float = 10) -> None:
        self.out.append(b"BT /F1 %g Tf %g %g Td %s Tj ET" % (size, x, y, _escaped(text)))

    def line(self, x0: float, y0: float, x1: float, y1: float) -> None:
        self.out.append(b"%g %g m %g %g l S" % (x0, y0, x1, y1))

    def bar(self, x: float, y: float, w: float, h: float) -> None:
        self.out.append(b"%g %g %g %g re f" % (x, y, w, h))

    def raw(self, data: bytes) -> None:
        self.out.append(data)


def table(page: Page, rows: Sequence[Sequence[str]], xs: Sequence[float], top: float = 740, pitch: float = 18, size: float = 9, style: str = "ruled") -> None:
    """Rows in columns that start at xs (one more than columns); styles: ruled, filled, painted (an image of the lines), columns (no lines between rows), glued (a row is one string), borderless."""
    if style == "painted":
        _painted(page, xs, [top - pitch * k for k in range(len(rows) + 1)])
    ys = [top - pitch * k for k in range(len(rows) + 1)]
    for y in ys:
        if style == "ruled" or style == "columns" and y in (ys[0], ys[-1]):
            page.line(xs[0], y, xs[-1], y)
        elif style == "filled":
            page.bar(xs[0], y - 0.5, xs[-1] - xs[0], 1)
    for x in xs:
        if style in ("ruled", "columns"):
            page.line(x, ys[0], x, ys[-1])
        elif style == "filled":
            page.bar(x - 0.5, ys[-1], 1, ys[0] - ys[-1])
    for r, row in enumerate(rows):
        if style == "glued":
            page.text(xs[0] + 3, ys[r + 1] + pitch / 2 - 0.3 * size, " ".join(row), size)
            continue
        for c, cell in enumerate(row):
            if cell:
                page.text(xs[c] + 3, ys[r + 1] + pitch / 2 - 0.3 * size, cell, size)


def _painted(page: Page, xs: Sequence[float], ys: Sequence[float], scale: int = 2) -> None:
    """The lines of a grid as a grey image, two pixels a point, placed over it."""
    wide, high = int((xs[-1] - xs[0]) * scale) + 2 * scale, int((ys[0] - ys[-1]) * scale) + 2 * scale
    at = lambda v: int(round(v * scale))
    between, line = bytearray(b"\xff" * wide), bytearray(b"\xff" * wide)
    for row in (between, line):
        for x in xs:
            row[at(x - xs[0]) : at(x - xs[0]) + 2] = b"\0\0"
    line[: at(xs[-1] - xs[0]) + 2] = bytes(at(xs[-1] - xs[0]) + 2)
    rows = [between] * (at(ys[0] - ys[-1]) + 2) + [b"\xff" * wide] * (high - at(ys[0] - ys[-1]) - 2)
    for y in ys:
        k = at(ys[0] - y)
        rows[k] = rows[k + 1] = line
    name = f"Grid{len(page.images)}"
    page.images[name] = (wide, high, b"".join(rows))
    page.raw(b"q %g 0 0 %g %g %g cm /%s Do Q" % (wide / scale, high / scale, xs[0] - 0.5, ys[-1] - 2 + 0.5, name.encode()))


#: Widths of Helvetica in thousandths, from code 32.
HELVETICA = [278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278] + [556] * 10 + [278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584, 350] + [556] * 128


def text_width(text: str, size: float) -> float:
    """How far a text reaches in the font of ``document``."""
    return sum(HELVETICA[c - 32] if 32 <= c < 256 else 500 for c in text.encode("cp1252", "replace")) * size / 1000


def _lzw(data: bytes) -> bytes:
    """Codes of 9 bits, the table cleared before they would need more."""
    bits, n = 0, 0
    for k, b in enumerate(data):
        for code in ((256, b) if k % 200 == 0 else (b,)):
            bits, n = bits << 9 | code, n + 9
    bits, n = bits << 9 | 257, n + 9
    return (bits << -n % 8).to_bytes((n + 7) // 8, "big")


def _run_length(data: bytes) -> bytes:
    return b"".join(bytes([len(p) - 1]) + p for p in (data[k : k + 128] for k in range(0, len(data), 128))) + b"\x80"


def _up(data: bytes, columns: int = 8) -> bytes:
    """Rows less the row above each, deflated."""
    data = data.ljust(-(-len(data) // columns) * columns)
    rows = [bytes(columns), *(data[k : k + columns] for k in range(0, len(data), columns))]
    return zlib.compress(b"".join(b"\2" + bytes((b - a) & 255 for a, b in zip(up, row)) for up, row in zip(rows, rows[1:])))


def _deflated(data: bytes) -> bytes:
    """Large data, which here are images of lines, at a level that takes a third of the time."""
    return zlib.compress(data, 3 if len(data) > 1 << 16 else -1)


#: A filter's way in, its name and its parameters.
FILTERS = {
    "Flate": (_deflated, b"FlateDecode", b"null"),
    "FlateUp": (_up, b"FlateDecode", b"<< /Predictor 12 /Columns 8 >>"),
    "ASCIIHex": (lambda d: d.hex().encode() + b">", b"ASCIIHexDecode", b"null"),
    "ASCII85": (lambda d: base64.a85encode(d) + b"~>", b"ASCII85Decode", b"null"),
    "RunLength": (_run_length, b"RunLengthDecode", b"null"),
    "LZW": (_lzw, b"LZWDecode", b"null"),
}


class File:
    """Objects that become a file with a classic cross-reference table."""

    def __init__(self):
        self.objects: list[bytes] = []

    def add(self, body: bytes) -> int:
        self.objects.append(body)
        return len(self.objects)

    def stream(self, data: bytes, extra: bytes = b"", filters: Sequence[str] = ("Flate",)) -> int:
        """A stream through filters, of which the first is undone first."""
        for name in reversed(filters):
            data = FILTERS[name][0](data)
        if filters:
            names, parms = b" ".join(b"/" + FILTERS[f][1] for f in filters), [FILTERS[f][2] for f in filters]
            extra += b" /Filter [%s]" % names if len(filters) > 1 else b" /Filter " + names
            if any(p != b"null" for p in parms):
                extra += b" /DecodeParms " + (parms[0] if len(parms) == 1 else b"[%s]" % b" ".join(parms))
        return self.add(b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), extra, data))

    def bytes(self, trailer: bytes) -> bytes:
        out, places = bytearray(b"%PDF-1.4\n"), []
        for k, body in enumerate(self.objects, 1):
            places.append(len(out))
            out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
        start = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(self.objects) + 1)
        out += b"".join(b"%010d 00000 n \n" % p for p in places)
        out += b"trailer\n<< /Size %d %s >>\nstartxref\n%d\n%%%%EOF\n" % (len(self.objects) + 1, trailer, start)
        return bytes(out)


def nested(groups: Sequence[tuple[int, Sequence[tuple[str, int | None]]]]) -> bytes:
    """A page tree of groups (their rotation, pages of a text and a rotation of their own): the root has the box, a group the fonts and its
    rotation, and every page its content in two streams."""
    f = File()
    root = f.add(b"")
    font = f.add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>")
    kids = []
    for rotate, pages in groups:
        node, own = f.add(b""), []
        for text, turned in pages:
            parts = [f.stream(b"BT /F1 10 Tf 50 100 Td"), f.stream(_escaped(text) + b" Tj ET")]
            more = b"" if turned is None else b" /Rotate %d" % turned
            own.append(f.add(b"<< /Type /Page /Parent %d 0 R /Contents [%s]%s >>" % (node, b" ".join(b"%d 0 R" % p for p in parts), more)))
        f.objects[node - 1] = b"<< /Type /Pages /Parent %d 0 R /Kids [%s] /Count %d /Rotate %d /Resources << /Font << /F1 %d 0 R >> >> >>" % (root, b" ".join(b"%d 0 R" % k for k in own), len(own), rotate, font)
        kids.append(node)
    f.objects[root - 1] = b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 400 300] >>" % (b" ".join(b"%d 0 R" % k for k in kids), sum(len(p) for _, p in groups))
    return f.bytes(b"/Root %d 0 R" % f.add(b"<< /Type /Catalog /Pages %d 0 R >>" % root))


def in_fonts(text: str) -> bytes:
    """A text three times under codes of its own: by glyph names, by a two-byte font with a map to Unicode, by a one-byte font with one."""
    f = File()
    code = {c: k for k, c in enumerate(sorted(set(text)), 1)}
    names = b" ".join(b"/uni%04X" % ord(c) for c in code)
    pairs = lambda form: b"".join(form % (k, ord(c)) for c, k in code.items())
    single = b"%d beginbfrange\n" % len(code) + b"".join(b"<%02x> <%02x> <%04x>\n" % (k, k, ord(c)) for c, k in code.items()) + b"endbfrange"
    fonts = [
        f.add(b"<< /Type /Font /Subtype /Type1 /BaseFont /A /Encoding << /Differences [1 %s] >> /FirstChar 1 /Widths [%s] >>" % (names, b" ".join([b"450"] * len(code)))),
        f.add(b"<< /Type /Font /Subtype /Type0 /BaseFont /B /Encoding /Identity-H /ToUnicode %d 0 R /DescendantFonts [<< /Type /Font /Subtype /CIDFontType2 /DW 600 >>] >>" % f.stream(b"%d beginbfchar\n%sendbfchar" % (len(code), pairs(b"<%04x> <%04x>\n")))),
        f.add(b"<< /Type /Font /Subtype /Type1 /BaseFont /C /ToUnicode %d 0 R /FontDescriptor << /MissingWidth 700 >> >>" % f.stream(single)),
    ]
    shown = [bytes(code[c] for c in text).hex(), b"".join(b"\0" + bytes([code[c]]) for c in text).hex(), bytes(code[c] for c in text).hex()]
    content = b"\n".join(b"BT /F%d 10 Tf 50 %d Td <%s> Tj ET" % (k, 700 - 20 * k, h.encode()) for k, h in enumerate(shown))
    own = b" ".join(b"/F%d %d 0 R" % (k, n) for k, n in enumerate(fonts))
    tree = len(f.objects) + 2
    page = b"<< /Type /Page /Parent %d 0 R /MediaBox [0 0 612 792] /Contents %d 0 R /Resources << /Font << %s >> >> >>" % (tree + 1, tree - 1, own)
    f.stream(content)
    kid = f.add(page)
    f.add(b"<< /Type /Pages /Kids [%d 0 R] /Count 1 >>" % kid)
    return f.bytes(b"/Root %d 0 R" % f.add(b"<< /Type /Catalog /Pages %d 0 R >>" % (kid + 1)))


def document(pages: Sequence[Page], title: str = "", outline: Sequence[str] = (), fields: Sequence[tuple[str, str]] = (), compress: bool = True, encrypt: bool = False, filters: Sequence[str] = ("Flate",)) -> bytes:
    """The file's bytes; ``filters`` are those of its streams, unless it isn't compressed."""
    file = File()
    objects, add = file.objects, file.add

    def stream(data: bytes, extra: bytes = b"") -> int:
        return file.stream(data, extra, filters if compress else ())

    widths = b" ".join(b"%d" % w for w in HELVETICA)
    font = add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding /FirstChar 32 /LastChar 255 /Widths [%s] >>" % widths)
    tree = add(b"")
    kids = []
    for p in pages:
        named = {k: stream(d, b" /Type /XObject /Subtype /Form /BBox [0 0 %g %g]" % (p.width, p.height)) for k, d in p.forms.items()}
        named |= {k: stream(d, b" /Type /XObject /Subtype /Image /Width %d /Height %d /BitsPerComponent 8 /ColorSpace /DeviceGray" % (w, h)) for k, (w, h, d) in p.images.items()}
        xobjects = b" /XObject << %s >>" % b" ".join(b"/%s %d 0 R" % (k.encode(), n) for k, n in named.items()) if named else b""
        annots = [add(b"<< /Type /Annot /Subtype /Link /Rect [0 0 1 1] /A << /S /URI /URI %s >> >>" % _escaped(u)) for u in p.links]
        more = b" /Annots [%s]" % b" ".join(b"%d 0 R" % a for a in annots) if annots else b""
        body = stream(b"\n".join(p.out))
        kids.append(add(b"<< /Type /Page /Parent %d 0 R /MediaBox [0 0 %g %g] /Rotate %d /Contents %d 0 R /Resources << /Font << /F1 %d 0 R >>%s >>%s >>" % (tree, p.width, p.height, p.rotate, body, font, xobjects, more)))
    objects[tree - 1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids))
    more = b""
    if outline:
        first = len(objects) + 2
        add(b"<< /Type /Outlines /First %d 0 R >>" % first)
        more += b" /Outlines %d 0 R" % (first - 1)
        for k, t in enumerate(outline):
            add(b"<< /Title %s%s >>" % (_escaped(t), b" /Next %d 0 R" % (first + k + 1) if k + 1 < len(outline) else b""))
    if fields:
        own = [add(b"<< /FT /Tx /T %s /V %s >>" % (_escaped(n), _escaped(v))) for n, v in fields]
        more += b" /AcroForm << /Fields [%s] >>" % b" ".join(b"%d 0 R" % f for f in own)
    root = add(b"<< /Type /Catalog /Pages %d 0 R%s >>" % (tree, more))
    info = add(b"<< /Title %s /Producer (quire) >>" % _escaped(title))
    return file.bytes(b"/Root %d 0 R /Info %d 0 R%s" % (root, info, b" /Encrypt << /Filter /Standard >>" if encrypt else b""))
