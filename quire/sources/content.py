"""Content streams: operators to text runs, ruling lines and image placements."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace

from .fonts import Font, page_fonts, resolve
from .objects import END, Document, Keyword, Lexer, Name, PdfError, Stream

Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: A stroke counts as a rule if it is this close to an axis, this long, and this long after clipping.
AXIS, LEAST, LEAST_CLIPPED = 1.5, 2.0, 1.0
#: A filled shape no thicker than this is a rule along its middle.
THIN = 3.5
FORM_DEPTH, FORM_COUNT = 4, 32
#: An operator with what most have before it: a name, up to eight numbers, a string. What is written otherwise goes through the lexer.
_OPERATION = re.compile(
    rb"[\t\n\f\r ]*+(?:/([^\0\t\n\f\r ()<>\[\]{}/%#]++)[\t\n\f\r ]++)?+((?:[+-]?(?:\d+\.?\d*|\.\d+)[\t\n\f\r ]++){0,8}+)"
    rb"(?:\(([^()\\\r]*+)\)[\t\n\f\r ]*+)?+([A-Za-z'\"][^\0\t\n\f\r ()<>\[\]{}/%]*+)"
)
_VALUES = frozenset((b"true", b"false", b"null"))
IGNORED = frozenset("g G rg RG k K cs CS sc SC scn SCN sh ri gs i j J M w d0 d1 BX EX BMC BDC EMC MP DP".split())


def concat(a: Matrix, b: Matrix) -> Matrix:
    """First a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def apply(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


@dataclass
class State:
    ctm: Matrix = UNIT
    clip: tuple[float, float, float, float] | None = None
    dash: tuple[tuple[float, ...], float] = ((), 0.0)
    font: str | None = None
    size: float = 0.0
    char: float = 0.0
    word: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    mode: int = 0


@dataclass
class Found:
    """What a page's content has."""

    runs: list[dict] = field(default_factory=list)
    rules: list[tuple[float, float, float, float, str]] = field(default_factory=list)
    placements: list[tuple[str, Matrix]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


class Machine:
    """The operators of one page."""

    def __init__(self, doc: Document, resources, forms_text: bool = False):
        self.doc, self.found, self.forms, self.forms_text = doc, Found(), 0, forms_text
        self.ops, self.resources = doc.limits.page_ops, resources
        self.run(doc_bytes=None, resources=resources, state=State(), depth=0)

    def run(self, doc_bytes: bytes | None, resources, state: State, depth: int, busy: frozenset = frozenset()) -> None:
        if doc_bytes is None:
            return
        doc, found = self.doc, self.found
        fonts: dict[str, Font] | None = None
        stack: list[State] = []
        tm = lm = UNIT
        in_text = False
        paths: list[list[tuple[float, float]]] = []
        boxes: list[bool] = []
        pending_clip = False
        lex, args = Lexer(doc_bytes), []

        def show(parts: list, metrics: float) -> None:
            nonlocal tm, fonts
            if not in_text:
                return
            fonts = page_fonts(doc, resources, self.resources) if fonts is None else fonts
            name, font = resolve(fonts, state.font)
            start = concat(tm, state.ctm)
            text, sure, box = [], 1.0, None
            for part in parts:
                if isinstance(part, (int, float)):
                    tm = concat((1, 0, 0, 1, -part / 1000 * state.size * state.scale, 0), tm)
                    metrics = min(metrics, 0.95)
                    continue
                if not isinstance(part, bytes):
                    continue
                low, high = state.rise + font.descent / 1000 * state.size, state.rise + font.ascent / 1000 * state.size
                at, along = concat(tm, state.ctm), 0.0
                before = along
                if font.wide or part[:2] == b"\xfe\xff":
                    for code in font.codes(part):
                        c, conf = font.char(code)
                        sure = min(sure, conf)
                        before = along
                        along += font.width(code) / 1000 * state.size * state.scale + state.char + (state.word if c == " " or code == 32 and not font.wide else 0)
                        text.append(c)
                else:
                    chars, sures, all_sure = font.chars()
                    steps = font.steps(state.size, state.scale, state.char, state.word)
                    for code in part:
                        before = along
                        along += steps[code]
                    text += [chars[code] for code in part]
                    if rest := part.translate(None, all_sure):
                        sure = min(sure, *[sures[code] for code in rest])
                if along or before or text:
                    # Glyphs of a string stand on one line: its box is that of its ends.
                    if at[1] == at[2] == 0:
                        xs, ys = [at[0] * x + at[4] for x in (0.0, before, along)], [at[3] * y + at[5] for y in (state.rise, low, high)]
                    else:
                        points = [apply(at, x, y) for x in (0.0, before, along) for y in (state.rise, low, high)]
                        xs, ys = [p[0] for p in points], [p[1] for p in points]
                    if box:
                        xs, ys = [*xs, box[0], box[2]], [*ys, box[1], box[3]]
                    box = (min(xs), min(ys), max(xs), max(ys))
                    tm = concat((1, 0, 0, 1, along, 0), tm)
            if box:
                size = max(abs(math.sqrt(abs(start[0] * start[3] - start[1] * start[2])) * state.size), 1e-3)
                found.runs.append({"text": "".join(text), "x0": box[0], "y0": box[1], "x1": box[2], "y1": box[3], "font_name": name, "font_size": size, "mapping_confidence": sure, "metrics_confidence": metrics, "invisible": state.mode == 3, "in_form": depth > 0})

        def rule(a: tuple[float, float], b: tuple[float, float], source: str) -> None:
            (x0, y0), (x1, y1) = a, b
            if abs(x1 - x0) <= AXIS and abs(y1 - y0) <= AXIS and source == "stroke":
                return
            flat = abs(y1 - y0) <= AXIS
            if not flat and abs(x1 - x0) > AXIS or max(abs(x1 - x0), abs(y1 - y0)) < (LEAST_CLIPPED if source == "dash" else LEAST):
                return
            x0, x1, y0, y1 = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
            if c := state.clip:
                if flat:
                    x0, x1 = max(x0, c[0]), min(x1, c[2])
                    inside = c[1] - AXIS <= (y0 + y1) / 2 <= c[3] + AXIS
                else:
                    y0, y1 = max(y0, c[1]), min(y1, c[3])
                    inside = c[0] - AXIS <= (x0 + x1) / 2 <= c[2] + AXIS
                if not inside or (x1 - x0 if flat else y1 - y0) < LEAST_CLIPPED:
                    return
            if flat:
                y0 = y1 = (y0 + y1) / 2
            else:
                x0 = x1 = (x0 + x1) / 2
            found.rules.append((x0, y0, x1, y1, source))

        def stroke() -> None:
            dashes, phase = state.dash
            dashes = dashes * 2 if len(dashes) % 2 else dashes
            for path in paths:
                for a, b in zip(path, path[1:]):
                    length = math.dist(a, b)
                    if not dashes or sum(dashes) <= 0 or length == 0:
                        rule(a, b, "stroke")
                        continue
                    # Of a pattern without a piece long enough nothing is left; another has a bounded number of pieces a length.
                    at, k = (-(phase % sum(dashes)), 0) if max(dashes[::2]) >= LEAST_CLIPPED else (length, 0)
                    while at < length:
                        s, e = max(at, 0), min(at + dashes[k % len(dashes)], length)
                        if k % 2 == 0 and e - s >= LEAST_CLIPPED:
                            p, q = ((a[0] + (b[0] - a[0]) * t / length, a[1] + (b[1] - a[1]) * t / length) for t in (s, e))
                            rule(p, q, "dash")
                        at += dashes[k % len(dashes)]
                        k += 1

        def fill() -> None:
            for path in paths:
                if len(path) < 3:
                    continue
                xs, ys = [p[0] for p in path], [p[1] for p in path]
                x0, x1, y0, y1 = min(xs), max(xs), min(ys), max(ys)
                if y1 - y0 <= THIN and x1 - x0 >= LEAST and x1 - x0 > y1 - y0:
                    rule((x0, (y0 + y1) / 2), (x1, (y0 + y1) / 2), "fill")
                elif x1 - x0 <= THIN and y1 - y0 >= LEAST:
                    rule(((x0 + x1) / 2, y0), ((x0 + x1) / 2, y1), "fill")

        def close() -> None:
            if paths and len(paths[-1]) > 1 and paths[-1][0] != paths[-1][-1]:
                paths[-1].append(paths[-1][0])

        def finish() -> None:
            nonlocal pending_clip
            if pending_clip and (points := [p for path in paths for p in path]):
                xs, ys = [p[0] for p in points], [p[1] for p in points]
                own, c = (min(xs), min(ys), max(xs), max(ys)), state.clip
                state.clip = own if c is None else (max(own[0], c[0]), max(own[1], c[1]), min(own[2], c[2]), min(own[3], c[3]))
            pending_clip = False
            paths.clear()
            boxes.clear()

        common = _OPERATION.match
        while True:
            if not args and (m := common(doc_bytes, lex.at)) and m[4] not in _VALUES:
                lex.at = m.end()
                name, numbers, shown, word = m.groups()
                n = [float(w) if b"." in w else int(w) for w in numbers.split()]
                a, op = n, word.decode("latin-1")
                if name is not None:
                    a = [Name(name.decode("latin-1")), *a]
                if shown is not None:
                    a = [*a, shown]
            else:
                if (x := lex.next()) is END:
                    break
                if not isinstance(x, Keyword):
                    args.append(x)
                    if len(args) > 4096:
                        args.clear()
                    continue
                op, a, n = str(x), args, [v for v in args if isinstance(v, (int, float)) and not isinstance(v, bool)]
                args = []
            self.ops -= 1
            if self.ops < 0:
                found.warnings.append("the page has more operators than allowed")
                return
            if op == "Tj" and a:
                show(a[-1:], 0.9)
            elif op == "BT":
                in_text, tm, lm = True, UNIT, UNIT
            elif op == "ET":
                in_text = False
            elif op == "Tf" and len(a) == 2 and n:
                state.font, state.size = str(a[0]), float(n[0])
            elif op in ("Td", "TD") and len(n) == 2:
                if op == "TD":
                    state.leading = -n[1]
                tm = lm = concat((1, 0, 0, 1, n[0], n[1]), lm)
            elif op == "q":
                stack.append(replace(state))
            elif op == "Q":
                if stack:
                    state = stack.pop()
            elif op == "cm" and len(n) == 6:
                state.ctm = concat(tuple(n), state.ctm)
            elif op == "m" and len(n) == 2:
                paths.append([apply(state.ctm, *n)])
            elif op == "l" and len(n) == 2:
                if paths:
                    paths[-1].append(apply(state.ctm, *n))
            elif op == "re" and len(n) == 4:
                u, v, w, h = n
                corners = [apply(state.ctm, *p) for p in ((u, v), (u + w, v), (u + w, v + h), (u, v + h))]
                paths.append([*corners, corners[0]])
            elif op == "h":
                close()
            elif op in ("c", "v", "y"):
                if paths:
                    paths.pop()
                paths.append([])
                if len(n) >= 2:
                    paths[-1].append(apply(state.ctm, *n[-2:]))
            elif op in ("S", "s", "B", "B*", "b", "b*", "f", "F", "f*", "n"):
                if op in ("S", "s", "B", "B*", "b", "b*"):
                    stroke()
                if op in ("f", "F", "f*", "B", "B*", "b", "b*"):
                    fill()
                finish()
            elif op in ("W", "W*"):
                pending_clip = True
            elif op == "d" and a and isinstance(a[0], list):
                state.dash = (tuple(float(v) for v in a[0] if isinstance(v, (int, float))), float(n[0]) if n else 0.0)
            elif op in ("Tc", "Tw", "TL", "Ts", "Tz", "Tr") and n:
                setattr(state, {"Tc": "char", "Tw": "word", "TL": "leading", "Ts": "rise", "Tz": "scale", "Tr": "mode"}[op], n[0] / 100 if op == "Tz" else int(n[0]) if op == "Tr" else n[0])
            elif op == "Tm" and len(n) == 6:
                tm = lm = tuple(float(v) for v in n)
            elif op == "T*":
                tm = lm = concat((1, 0, 0, 1, 0, -state.leading), lm)
            elif op in ("'", '"') and a:
                tm = lm = concat((1, 0, 0, 1, 0, -state.leading), lm)
                show(a[-1:], 0.9)
            elif op == "TJ" and a and isinstance(a[-1], list):
                show(a[-1], 1.0)
            elif op == "Do" and a:
                self.xobject(str(a[-1]), resources, state, depth, busy)
            elif op not in IGNORED:
                found.warnings.append(f"unknown operator {op[:20]}")

    def named(self, resources, kind: str) -> dict:
        res = self.doc.get(resources)
        found = self.doc.get(res.get(kind)) if isinstance(res, dict) else None
        return found if isinstance(found, dict) else {}

    def xobject(self, name: str, resources, state: State, depth: int, busy: frozenset) -> None:
        # A form's own names come first, then its page's.
        ref = next((r for some in (resources, self.resources) if (r := self.named(some, "XObject").get(name)) is not None), None)
        x = self.doc.get(ref)
        if not isinstance(x, Stream) or x.info.get("Subtype") != "Form":
            self.found.placements.append((name, state.ctm))
            return
        key = getattr(ref, "number", id(x))
        if depth >= FORM_DEPTH or key in busy or self.forms >= FORM_COUNT:
            self.found.warnings.append("a form is nested too deep, in itself, or one too many")
            return
        self.forms += 1
        m = self.doc.get(x.info.get("Matrix"))
        m = tuple(float(v) for v in map(self.doc.get, m)) if isinstance(m, list) and len(m) == 6 else UNIT
        try:
            self.run(self.doc.decode(x), x.info.get("Resources", resources), replace(state, ctm=concat(m, state.ctm)), depth + 1, busy | {key})
        except PdfError as e:
            self.found.warnings.append(str(e))


def interpret(doc: Document, page: dict) -> Found:
    """Runs, rules, placements and warnings of a page from ``Document.pages``."""
    machine = Machine(doc, page["resources"])
    try:
        data = doc.contents(page["page"])
    except PdfError as e:
        machine.found.warnings.append(str(e))
        return machine.found
    machine.run(data, page["resources"], State(), 0)
    return machine.found
