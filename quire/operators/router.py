"""From a page's candidates to its tables: gates against false ones, the exclusive router, the clean-up after it.

Plain Python over the few candidates of one page, called where the page is
detected. A candidate is a table dict (``tables.py``); a proposal is a region with
scores and the numbers of the candidates behind it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from ..plans.options import Knobs, TableOptions

RULED, PARTIAL, BORDERLESS = "ruled", "partial", "borderless"
KIND = {"lattice": RULED, "hybrid": PARTIAL, "network": BORDERLESS, "stream": BORDERLESS}
PRIORITY = {RULED: 3, PARTIAL: 2, BORDERLESS: 1}
RANK = {"lattice": 4, "hybrid": 3, "network": 2, "stream": 1}
#: Usual distance of lines, by which stacked regions are judged, and the area of a page of unknown size.
LINE_GAP, PAGE_AREA = 12.0, 612.0 * 792.0

_TAX = tuple(
    "(ssn)|(ein)|accounting method|social security|business address|employer id|schedule d|schedule c|form 1099|omb no.|enter code from instructions|"
    "profit or loss from business|principal business or profession|long-term transactions|short-term transactions|cost (or other basis)|proceeds (sales price)|"
    "totals for all long-term|totals for all short-term".split("|")
)
_GAINS = ("schedule d", "cost (or other basis)", "proceeds (sales price)", "adjustments to gain or loss")
_FIELDS = (*_GAINS, "(ein)", "(ssn)", "capital gain or (loss)", "employer id", "social security", "enter code from instructions")
_OFFICE = ("irs use only", "omb no.", "internal revenue", "department of the treasury")
_NOTICE = ("fips", "withdrawn", "series/number", "warning notice", "name of standard")
_WORKSHEET = (*_TAX, "department of the treasury", "irs use only", "withdrawn", "warning notice", "name of standard", "adjustments to gain or loss", "capital gain or (loss)")


# Boxes


def width(t: dict) -> float:
    return abs(t["x1"] - t["x0"])


def height(t: dict) -> float:
    return abs(t["y1"] - t["y0"])


def size(t: dict) -> float:
    return width(t) * height(t)


def meet(a: dict, b: dict) -> float:
    return max(0.0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])) * max(0.0, min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]))


def iou(a: dict, b: dict) -> float:
    both = meet(a, b)
    whole = size(a) + size(b) - both
    return both / whole if whole > 0 else 0.0


def inside(a: dict, b: dict) -> float:
    """The share of a that lies in b."""
    return meet(a, b) / max(size(a), 1.0)


def shared(a: dict, b: dict) -> float:
    """The share of the smaller that lies in the larger."""
    return meet(a, b) / max(min(size(a), size(b)), 1.0)


def in_order(found: list[dict]) -> list[dict]:
    """From the top, then from the left."""
    return sorted(found, key=lambda t: (-t["y1"], t["x0"]))


# What a table's cells say


@dataclass(frozen=True)
class Facts:
    """Counts and means over the cells that have text."""

    filled: int
    fill: float
    empty: float
    digit_led: float
    number_only: float
    chars: float
    octets: float
    header: float
    hex: float
    code: float
    punctuation: float
    words: str
    dotted: int
    caption: bool


def _count(text: str, of: bytes) -> int:
    """How many of a text's characters are among some of ASCII."""
    raw = text.encode()
    return len(raw) - len(raw.translate(None, of))


def _digit_led(text: str) -> bool:
    s = text.strip("$%(),")
    digits = _count(s, b"0123456789")
    return digits >= 1 and digits >= sum(map(str.isalpha, s))


_AMOUNT = re.compile(r"[0-9.,+\- ]+")


def _number_only(text: str) -> bool:
    s = text.strip("$%()")
    return bool(_AMOUNT.fullmatch(s)) and any(map(str.isdigit, s))


def _hexlike(solid: str) -> bool:
    return len(solid) >= 2 and _count(solid, b"0123456789abcdefABCDEFx{}") > 0.7 * len(solid.encode())


def _codelike(text: str, solid: str) -> bool:
    return _count(text, b"=[]{}\\`|;") > 0.08 * max(1, len(solid)) or any(s in text for s in ("==", "->", "()"))


def facts(t: dict) -> Facts:
    cells = t["cells"]
    return _facts(t["rows"] * t["cols"], tuple([c["text"] for c in cells]), tuple([i for i, c in enumerate(cells) if c["row"] == 0]))


@lru_cache(32)
def _facts(slots: int, texts: tuple[str, ...], top: tuple[int, ...]) -> Facts:
    """A page's few candidates are asked for again by each gate."""
    full = [s for x in texts if (s := x.strip())]
    n = max(1, len(full))
    mean = lambda test: sum(map(test, full)) / n
    blank = len(texts) - len(full)
    head = [s for i in top if (s := texts[i].strip())]
    alpha = [s for s in head if sum(map(str.isalpha, s)) >= max(2, 1 + _count(s, b"0123456789"))]
    solids = ["".join(s.split()) for s in full]
    solid = "".join(solids)
    return Facts(
        filled=len(full),
        fill=len(full) / max(1, len(texts)),
        empty=0.5 if not texts else blank / (max(1, slots) if len(texts) >= slots else len(texts)),
        digit_led=mean(_digit_led),
        number_only=mean(_number_only),
        chars=sum(map(len, full)) / n,
        octets=sum(len(s.encode()) for s in full) / n,
        header=len(alpha) / len(head) if head else 0.0,
        hex=sum(map(_hexlike, solids)) / n,
        code=sum(map(_codelike, full, solids)) / n,
        punctuation=_count(solid, b".,;:!?") / len(solid) if solid else 0.0,
        words=" ".join([x.lower() for x in texts]),
        dotted=sum(". ." in s or s.count(".") >= 3 for s in full),
        caption=" ".join(head).lower().startswith(("fig.", "figure ", "table ", "listing ")),
    )


def first_words(t: dict, n: int) -> str:
    return " ".join(c["text"].lower() for c in t["cells"][:n])


def between01(x: float) -> float:
    return max(0.0, min(1.0, x))


def data_score(t: dict, f: Facts) -> float:
    """How much a table is one of data: header words, fill, usual lengths, shares of numbers and size; hex dumps lose."""
    numbers = 1.0 if 0.15 <= f.number_only <= 0.85 else 0.35 if f.number_only > 0.85 else 0.2
    total = 0.30 * f.header + 0.20 * f.fill + 0.15 * between01(1 - abs(f.octets - 12) / 40) + 0.15 * numbers
    total += 0.10 * (1.0 if 3 <= t["cols"] <= 12 else 0.3) + 0.10 * (1.0 if 3 <= t["rows"] <= 80 else 0.2)
    total *= 1 - 0.75 * f.hex
    if f.octets < 3.5 and f.number_only > 0.7:
        total *= 0.35
    if t["method"] in ("network", "stream") and f.hex > 0.4:
        total *= 0.4
    return between01(total)


def form_score(t: dict, f: Facts) -> float:
    """How much a table is a form: empty, without numbers, of short texts; its size counts only if it is sparse."""
    large = 0.0 if f.fill >= 0.55 and t["cols"] >= 3 else 0.35 if t["rows"] >= 15 or t["rows"] * t["cols"] >= 60 else 0.15 if t["rows"] >= 8 else 0.0
    return between01(0.30 * (1 - f.fill) + 0.30 * (1 - f.number_only) + 0.15 * (1 - min(f.octets / 40, 1.0)) + 0.25 * large + 0.10)


def plausible(t: dict, f: Facts) -> bool:
    """Whether a table of a document with too many still looks like one of data."""
    cols = t["cols"]
    return not (
        f.hex >= 0.40
        or f.code >= 0.28
        or (f.octets >= 50 and cols <= 3)
        or (f.octets < 8 and cols >= 5)
        or (f.header < 0.25 and cols >= 3)
        or f.caption
        or (cols >= 6 and f.number_only < 0.12 and f.octets > 18)
    )


def scrubbed(tables: list[dict], k: Knobs) -> list[dict]:
    """A document's tables; of more than ``overseg`` only the best that are surely data, ``overseg`` at most (``logical_cap`` 0: no other limit)."""
    if len(tables) <= max(1, k.overseg):
        return tables
    least = min(k.min_data_score + 0.12, 0.85)
    seen = [(t, facts(t)) for t in tables]
    kept = [(data_score(t, f), i) for i, (t, f) in enumerate(seen) if plausible(t, f)]
    best = sorted((s for s in kept if s[0] >= least), key=lambda s: (-s[0], s[1]))
    most = max(1, k.overseg) if k.logical_cap == 0 else min(k.logical_cap, max(1, k.overseg))
    return [tables[i] for i in sorted(i for _, i in best[:most])]


# Gates


def is_weak(t: dict) -> bool:
    return "weak_edges" in t["notes"]


def is_borderless(t: dict) -> bool:
    return t["method"] in ("network", "stream")


def is_raster(t: dict) -> bool:
    return "raster" in t["notes"]


def strong_lattice(t: dict, k: Knobs) -> bool:
    """A ruled table sure enough to own its place: of three columns, or of two that are wide and tall."""
    if t["method"] != "lattice" or t["rows"] < 2 or t["confidence"] < k.strong_lattice or is_weak(t):
        return False
    return t["cols"] >= 3 or t["cols"] == 2 and width(t) >= 140 and t["rows"] >= 4


def solid_ruled(t: dict, f: Facts, k: Knobs) -> bool:
    """A ruled table that owns its page; few columns whose rows came from lines of text do not."""
    if t["method"] != "lattice" or is_weak(t) or min(t["rows"], t["cols"]) < 2 or t["confidence"] < min(k.min_confidence_lattice, 0.55) or f.empty >= 0.90:
        return False
    return not (t["cols"] <= k.safe_cols and t["rows"] >= k.safe_rows and "densified" in t["notes"])


def chrome(t: dict, f: Facts) -> bool:
    """Page frames, form boxes and notices that are ruled, but no tables."""
    if t["method"] != "lattice" or is_raster(t):
        return False
    rows, cols, weak = t["rows"], t["cols"], is_weak(t)
    return (
        (f.empty >= 0.88 and f.digit_led < 0.12 and f.filled <= 6)
        or (rows <= 3 and cols <= 3 and f.filled <= 2 and f.digit_led < 0.15)
        or (cols == 2 and f.chars >= 28 and f.digit_led < 0.12 and rows >= 8)
        or (f.empty >= 0.55 and cols >= 6 and (weak or t["edge_score"] < 0.55))
        or (f.dotted >= 4 and weak and f.empty >= 0.40)
        or (f.digit_led < 0.40 and any(w in f.words for w in _FIELDS))
    )


def tax_form(f: Facts) -> bool:
    hits = sum(w in f.words for w in _TAX)
    return hits >= 1 and f.digit_led < 0.45 or hits >= 2 and f.digit_led < 0.55


def office_strip(t: dict) -> bool:
    words = first_words(t, 12)
    return t["rows"] <= 8 and any(w in words for w in _OFFICE)


def notice(t: dict, f: Facts) -> bool:
    hits = 0
    for c in t["cells"][:24]:
        s = c["text"].lower()
        hits += s.startswith(("1.", "2.")) or any(w in s for w in _NOTICE)
    return hits >= 2 and f.digit_led < 0.25


def borderless_passes(t: dict, f: Facts, k: Knobs, recall: bool) -> bool:
    """Whether a borderless candidate is a table; ``recall``: its page has no ruled one, so structure may make up for length."""
    rows, cols, conf = t["rows"], t["cols"], t["confidence"]
    if rows < 3 or cols < 2 or f.filled < 6 and rows * cols < 12 or notice(t, f) or tax_form(f):
        return False
    if not recall:
        if f.chars >= 0.55 * k.prose_chars and f.digit_led < 0.25 or f.chars >= 28 and f.digit_led < 0.15:
            return False
        return conf >= k.min_confidence_network and not (cols == 2 and f.digit_led < 0.12 and f.chars > 12)
    structured = cols >= 3 and rows >= 4 and f.filled >= 8
    numeric = f.digit_led >= 0.30 and cols >= 3 and rows >= 4
    dense = cols >= 4 and rows >= 6 and f.filled >= 24 and max(t["fill"], f.filled / max(1, rows * cols)) >= 0.55 and f.chars < 48
    least = 0.48 if numeric or dense else min(0.85 * k.min_confidence_network, 0.55) if structured else k.min_confidence_network
    if conf < least or office_strip(t):
        return False
    if not dense and not numeric:
        if rows >= 20 and cols >= 6:
            return False
        if rows * cols >= 200 and not (cols >= 5 and t["fill"] >= 0.45 and conf >= 0.75 and f.chars < 40):
            return False
        if f.chars >= 0.90 * k.prose_chars and f.digit_led < 0.12 and not structured:
            return False
    if cols <= 2 and f.chars >= 0.50 * k.prose_chars and f.digit_led < 0.20:
        return False
    return not (cols == 2 and f.digit_led < 0.12 and f.chars > 14)


def apart_from_ruled(t: dict, f: Facts, ruled: list[dict]) -> bool:
    """A dense numeric borderless table that stands clear of all ruled ones of its page."""
    if t["cols"] < 4 or t["rows"] < 6 or f.digit_led < 0.28 or t["confidence"] < 0.65 or width(t) < 120 or height(t) < 80:
        return False
    for o in ruled:
        tall = max(0.0, min(t["y1"], o["y1"]) - max(t["y0"], o["y0"]))
        wide = max(0.0, min(t["x1"], o["x1"]) - max(t["x0"], o["x0"]))
        beside = tall > 0.5 * min(height(t), height(o)) and wide > 0.5 * min(width(t), width(o))
        if beside or iou(t, o) >= 0.18 or inside(t, o) >= 0.30 or inside(o, t) >= 0.40:
            return False
    return True


def without_forms(found: list[dict], k: Knobs) -> list[dict]:
    """Vetoes of forms, worksheets and prose; what merely resembles a form loses confidence."""
    out = []
    for t in found:
        f = facts(t)
        form = form_score(t, f)
        if _is_form(t, f, form, k):
            continue
        if not _is_data(t, f) and form >= 0.50:
            t = t | {"confidence": round(between01(t["confidence"] * (1 - 0.60 * form)), 6), "notes": [*t["notes"], "form_like"]}
        if t["confidence"] >= max(0.7 * k.min_confidence_lattice, 0.45):
            out.append(t)
    return out


def _dense_stream(t: dict, f: Facts) -> bool:
    return is_borderless(t) and f.fill >= 0.55 and t["cols"] >= 4 and t["rows"] >= 6 and f.octets < 48 and t["confidence"] >= 0.55


def _full_lattice(t: dict, f: Facts) -> bool:
    return t["method"] == "lattice" and f.fill >= 0.50 and t["cols"] >= 2 and t["rows"] >= 3 and not is_weak(t)


def _is_data(t: dict, f: Facts) -> bool:
    rows, cols, num = t["rows"], t["cols"], f.number_only
    ruled = t["method"] == "lattice"
    wide = ruled and cols >= 6 and rows >= 3 and not is_weak(t) and t["edge_score"] >= 0.80 and f.fill >= 0.18 and (num >= 0.08 or f.octets < 80)
    painted = ruled and is_raster(t) and min(rows, cols) >= 2 and not is_weak(t)
    return (
        (f.fill >= 0.45 and num >= 0.15 and min(rows, cols) >= 2 and f.octets < 40)
        or (num >= 0.35 and cols >= 3 and f.octets < 35)
        or (ruled and f.fill >= 0.5 and cols >= 2 and num >= 0.1)
        or _full_lattice(t, f)
        or wide
        or painted
        or _dense_stream(t, f)
    )


def _is_form(t: dict, f: Facts, form: float, k: Knobs) -> bool:
    rows, cols, num = t["rows"], t["cols"], f.number_only
    data = _is_data(t, f)
    if not data and form >= 0.52 and num < 0.20:
        return True
    if is_borderless(t):
        dense = _dense_stream(t, f)
        structured = cols >= 3 and rows >= 4 and f.fill >= 0.35 and (rows <= 25 or dense or f.fill >= 0.60 and cols >= 4)
        worksheet = any(w in first_words(t, 40) for w in _WORKSHEET)
        if not dense and (
            (rows >= 20 and cols >= 6 and form >= 0.35 and (f.fill < 0.50 or num < 0.08))
            or (rows * cols >= 200 and form >= 0.30 and (f.fill < 0.50 or num < 0.10 and f.octets > 30))
            or (form >= 0.48 and num < 0.20 and not structured)
        ):
            return True
        if (
            (f.octets >= 0.50 * k.prose_chars and num < 0.22 and cols <= 3)
            or (form >= 0.55 and num < 0.25 and cols <= 3)
            or (f.fill < 0.40 and rows <= 5 and num < 0.30 and cols <= 3)
            or (cols <= 2 and rows <= 12 and num < 0.15 and f.octets > 8)
            or (worksheet and (num < 0.45 or rows <= 16 or f.fill < 0.70))
        ):
            return True
    elif t["method"] == "lattice":
        if num < 0.40 and any(w in first_words(t, 30) for w in _GAINS):
            return True
        if not data and (f.fill < 0.22 and num < 0.10 and rows * cols >= 8 or form >= 0.60 and f.fill < 0.50 and num < 0.18 and cols >= 4):
            return True
        if is_weak(t) and not is_raster(t) and f.fill < 0.20 and num < 0.15 and rows * cols >= 40:
            return True
    return not data and rows * cols >= 40 and num < 0.12 and f.octets < 12 and f.punctuation < 0.05 and form >= 0.55


# Relations between candidates


def without_ruled_twins(found: list[dict]) -> list[dict]:
    """Partly ruled candidates that a ruled one largely covers, or that cover one, go."""
    ruled = [t for t in found if t["method"] == "lattice"]
    return [t for t in found if t["method"] != "hybrid" or not any(inside(t, o) >= 0.50 or inside(o, t) >= 0.50 or iou(t, o) >= 0.40 for o in ruled)]


def without_sparse_ruled(found: list[dict]) -> list[dict]:
    """Ruled candidates go that are sparser, or of far more columns, than a sure borderless one of the same place."""
    sure = [t for t in found if is_borderless(t) and t["cols"] >= 3 and t["rows"] >= 4 and t["confidence"] >= 0.65 and t["fill"] >= 0.55]

    def loses(t: dict, o: dict) -> bool:
        if shared(t, o) < 0.40 and iou(t, o) < 0.30:
            return False
        odd = t["cols"] >= 1.5 * o["cols"] + 1 or 0 < t["fill"] < o["fill"] - 0.12
        return odd and (t["confidence"] + 0.05 < o["confidence"] or o["fill"] >= 0.70)

    return [t for t in found if is_borderless(t) or not any(loses(t, o) for o in sure)]


def without_wide_hybrids(found: list[dict]) -> list[dict]:
    """Partly ruled candidates of 14 columns on go beside a borderless one of fewer columns and enough rows."""
    flows = [t for t in found if is_borderless(t)]
    return [
        t
        for t in found
        if t["method"] != "hybrid" or t["cols"] < 14 or not any(o["cols"] < t["cols"] and o["rows"] >= int(0.5 * t["rows"]) and (iou(o, t) >= 0.25 or shared(o, t) >= 0.35) for o in flows)
    ]


def _demoted(t: dict, factor: float, note: str) -> dict:
    return t | {"confidence": round(t["confidence"] * factor, 6), "notes": [*t["notes"], note]}


def demoted_slices(found: list[dict]) -> list[dict]:
    """Narrow ruled strips in the place of a wide borderless table go; small ruled corners of large tables lose confidence."""
    corner = lambda t: t["method"] == "lattice" and t["cols"] <= 2 and t["rows"] <= 4
    near = lambda t, o: shared(t, o) >= 0.25 or iou(t, o) >= 0.20
    if len(found) < 2:
        return found
    wide = [t for t in found if is_borderless(t) and t["cols"] >= 4 and t["rows"] >= 4 and t["confidence"] >= 0.55]
    if not wide:
        large = any(t["cols"] >= 4 and t["rows"] >= 3 for t in found)
        return [_demoted(t, 0.45, "corner") if large and corner(t) else t for t in found]
    kept = [t for t in found if not (t["method"] == "lattice" and t["cols"] <= 2 and t["rows"] >= 8 and any(near(t, o) for o in wide))]
    flows = [t for t in kept if is_borderless(t) and t["cols"] >= 4 and t["rows"] >= 3]
    return [_demoted(t, 0.45, "corner") if corner(t) and any(size(o) >= 2 * size(t) and near(t, o) for o in flows) else t for t in kept]


def under_ruled(t: dict, ruled: list[dict]) -> bool:
    """Whether a borderless candidate is one with a ruled table: mostly inside it, or of its place and not twice as large."""
    for o in ruled:
        if (shared(t, o) >= 0.40 or iou(t, o) >= 0.35) and (inside(t, o) >= 0.55 or size(t) <= 2 * size(o)):
            return True
    return False


def touches(t: dict, others: list[dict]) -> bool:
    return any(shared(o, t) >= 0.40 or iou(o, t) >= 0.35 for o in others)


def without_subordinate(found: list[dict]) -> list[dict]:
    """Of three or more borderless tables of a page those go that are small and short beside the largest."""
    flows = [t for t in found if is_borderless(t)]
    if len(flows) < 3:
        return found
    largest, tallest = max(map(size, flows)), max(t["rows"] for t in flows)
    return [t for t in found if not is_borderless(t) or size(t) >= 0.45 * largest or 10 * t["rows"] >= 7 * tallest]


def stacked(found: list[dict]) -> list[dict]:
    """Ruled tables of equal columns one close under another become one; a repeated header is dropped."""
    out: list[dict] = []
    for t in sorted(found, key=lambda t: (-t["y1"], t["x0"])):
        up = out[-1] if out else None
        if up is None or {up["method"], t["method"]} != {"lattice"} or up["cols"] != t["cols"] or up["cols"] < 2 or up["rows"] + t["rows"] > 100:
            out.append(t)
            continue
        gap, row = up["y0"] - t["y1"], max(height(up) / max(1, up["rows"]), 4.0)
        wide = max(0.0, min(up["x1"], t["x1"]) - max(up["x0"], t["x0"])) / max(1.0, min(width(up), width(t)))
        ratio = max(width(up), width(t)) / max(1.0, min(width(up), width(t)))
        if not (-2 <= gap <= 2.5 * row and wide >= 0.70 and ratio <= 1.25):
            out.append(t)
            continue
        first = lambda x: [c["text"].strip().lower() for c in sorted(x["cells"], key=lambda c: c["col"]) if c["row"] == 0]
        skip = 1 if all(first(up)) and first(up) == first(t) else 0
        cells = up["cells"] + [c | {"row": c["row"] - skip + up["rows"], "header": False} for c in t["cells"] if c["row"] >= skip]
        out[-1] = up | {
            "cells": cells,
            "rows": up["rows"] + t["rows"] - skip,
            "x0": min(up["x0"], t["x0"]),
            "x1": max(up["x1"], t["x1"]),
            "y0": min(up["y0"], t["y0"]),
            "y1": max(up["y1"], t["y1"]),
            "fill": sum(bool(c["text"]) for c in cells) / len(cells),
            "confidence": round(0.98 * max(up["confidence"], t["confidence"]), 6),
            "notes": [*up["notes"], "stacked"],
        }
    return out


# The router


@dataclass(frozen=True)
class Policy:
    """What a region has to have, and what owns what."""

    min_joints: int = 5
    min_area: float = 5e-4
    whitespace: float = 0.90
    own_iou: float = 0.15
    own_inside: float = 0.85
    own_pad: float = 2.0
    ruled_lines: float = 0.55
    partial_lines: float = 0.25
    borderless_text: float = 0.50
    nms_iou: float = 0.60
    nested_most: float = 0.55
    nested_least: float = 0.03
    nested_area: float = 2500.0
    nested_side: float = 36.0

    @classmethod
    def of(cls, k: Knobs) -> Policy:
        area = max(k.min_area / PAGE_AREA, 1e-5) if k.min_area > 0 else cls.min_area
        return cls(min_joints=max(k.min_joints, 4), whitespace=max(0.5, min(0.99, k.max_empty)), min_area=area, own_iou=k.own_iou, own_inside=k.own_containment, nms_iou=k.nms_iou)


@dataclass(frozen=True)
class Proposal:
    kind: str
    x0: float
    y0: float
    x1: float
    y1: float
    lines: float
    text: float
    joints: int
    area: float
    whitespace: float
    sources: tuple[int, ...] = field(default=())

    @property
    def box(self) -> dict:
        return {"x0": self.x0, "y0": self.y0, "x1": self.x1, "y1": self.y1}

    @property
    def prior(self) -> float:
        return 0.6 * self.lines + 0.4 * self.text


def proposal(t: dict, source: int, page_area: float, p: Policy) -> Proposal:
    """A candidate as a region: lines from its edges, text from its fill or confidence, joints as counted or the least that pass."""
    kind = KIND[t["method"]]
    conf, fill = t["confidence"], t["fill"]
    lines = between01(max(t["edge_score"], conf)) if kind != BORDERLESS else 0.0
    text = between01(conf if kind == BORDERLESS else fill if fill > 0 else 0.5 * conf)
    joints = {RULED: t["joints"] or p.min_joints, PARTIAL: t["joints"] or max(2, t["rows"] + t["cols"]), BORDERLESS: 0}[kind]
    blank = min(1 - fill, max(0.0, p.whitespace - 0.01)) if fill > 0 else 0.0
    return Proposal(kind, t["x0"], t["y0"], t["x1"], t["y1"], lines, text, joints, between01(size(t) / max(1.0, page_area)), blank, (source,))


def nested(a: dict, b: dict, p: Policy) -> bool:
    """Whether one box is a table within the other: inside it, clearly smaller, and no mere corner."""
    small, large = (a, b) if size(a) <= size(b) else (b, a)
    part = max(size(small), 1e-3)
    ratio = part / max(size(large), 1e-3)
    return meet(a, b) / part >= p.own_inside and p.nested_least <= ratio <= p.nested_most and part >= p.nested_area and min(width(small), height(small)) >= p.nested_side


def _both_nested(a: dict, b: dict, p: Policy) -> bool:
    """Nested tables both of which have lines: text of a frame that is found without its lines is the same table again."""
    return not is_borderless(a) and not is_borderless(b) and nested(a, b, p)


def merged(found: list[Proposal], p: Policy, gap: float = LINE_GAP, x_share: float = 0.60) -> list[Proposal]:
    """Regions of one kind, or ruled and partly ruled, close above each other become one, until nothing changes; nested ones stay two."""
    while True:
        rest, out, changed = sorted(found, key=lambda r: (-r.y1, r.x0)), [], False
        while rest:
            own, left = rest[0], []
            for o in rest[1:]:
                upper, lower = (own, o) if own.y1 >= o.y1 else (o, own)
                both = max(0.0, min(own.x1, o.x1) - max(own.x0, o.x0))
                whole = (own.x1 - own.x0) + (o.x1 - o.x0) - both
                close = own.kind == o.kind or BORDERLESS not in (own.kind, o.kind)
                if close and whole > 0 and both / whole >= x_share and upper.y0 - lower.y1 <= 1.5 * gap and not nested(own.box, o.box, p):
                    own = Proposal(
                        own.kind if PRIORITY[own.kind] >= PRIORITY[o.kind] else o.kind,
                        min(own.x0, o.x0), min(own.y0, o.y0), max(own.x1, o.x1), max(own.y1, o.y1),
                        max(own.lines, o.lines), max(own.text, o.text), max(own.joints, o.joints), max(own.area, o.area), min(own.whitespace, o.whitespace),
                        tuple(dict.fromkeys(own.sources + o.sources)),
                    )
                    changed = True
                else:
                    left.append(o)
            out.append(own)
            rest = left
        found = out
        if not changed:
            return found


def passes_gate(r: Proposal, p: Policy) -> bool:
    if r.kind == RULED:
        return r.joints >= p.min_joints and r.area >= p.min_area and r.whitespace < p.whitespace and r.lines >= p.ruled_lines
    return r.lines >= p.partial_lines if r.kind == PARTIAL else r.text >= p.borderless_text


def owns(owner: Proposal, r: Proposal, p: Policy) -> bool:
    """Whether an accepted region keeps another out; borderless ones own nothing, nested tables with lines are let in."""
    a, o = r.box, {"x0": owner.x0 - p.own_pad, "y0": owner.y0 - p.own_pad, "x1": owner.x1 + p.own_pad, "y1": owner.y1 + p.own_pad}
    if owner.kind == BORDERLESS or r.kind != BORDERLESS and nested(a, o, p):
        return False
    both = meet(a, o)
    return iou(a, o) >= p.own_iou or both >= p.own_inside * size(a) > 0 or both >= p.own_inside * size(o) > 0


def partition(found: list[Proposal], p: Policy) -> list[Proposal]:
    """Regions that pass their gate, by kind, prior and area, each unless an earlier one owns its place or is nearly the same."""
    kept: list[Proposal] = []
    for r in sorted((r for r in found if passes_gate(r, p)), key=lambda r: (-PRIORITY[r.kind], -r.prior, r.area)):
        if any(owns(o, r, p) for o in kept):
            continue
        if any(o.kind == r.kind and iou(r.box, o.box) >= p.nms_iou and not nested(r.box, o.box, p) for o in kept):
            continue
        kept.append(r)
    return kept


def quality(t: dict) -> float:
    total = 0.55 * t["confidence"] + 0.25 * (t["fill"] or 0.5) + 0.20 * (t["edge_score"] or 0.5)
    return total * (0.85 if is_weak(t) else 1.0)


def emitted(found: list[dict], accepted: list[Proposal]) -> list[dict]:
    """One table for each region: the best of its candidates that no other region has taken."""
    used: set[int] = set()
    out = []
    for r in accepted:
        free = [i for i in r.sources if i not in used]
        if free:
            best = max(free, key=lambda i: (quality(found[i]), RANK[found[i]["method"]]))
            used.add(best)
            out.append(found[best])
    return out


def cleaned(kept: list[dict], k: Knobs, p: Policy) -> list[dict]:
    """After routing: no twins, stacked ruled tables joined, borderless ones only beside ruled ones they stand clear of, no two of one place."""
    if len(kept) < 2:
        return kept
    kept = stacked(without_ruled_twins(kept))
    ruled = [t for t in kept if solid_ruled(t, facts(t), k)]
    spared = lambda t: "clear_of_ruled" in t["notes"] or "for_wide_hybrid" in t["notes"]
    if ruled:
        kept = [t for t in kept if not is_borderless(t) or spared(t) or apart_from_ruled(t, facts(t), ruled)]
    else:
        kept = [t for t in kept if not is_borderless(t) or "for_wide_hybrid" in t["notes"] or borderless_passes(t, facts(t), k, True)]
        kept = without_subordinate(kept)
    out: list[dict] = []
    for t in sorted(kept, key=lambda t: -quality(t)):
        if not any(not _both_nested(t, o, p) and (iou(t, o) >= 0.35 or shared(t, o) >= 0.50) for o in out):
            out.append(t)
    return out


def routed(found: list[dict], k: Knobs, page_area: float = PAGE_AREA) -> list[dict]:
    """Candidates above their floors, as regions merged and partitioned; tables from the top, as many as a page may have."""
    found = above_floor(found, k)
    p = Policy.of(k)
    regions = partition(merged([proposal(t, i, page_area, p) for i, t in enumerate(found)], p), p)
    kept = cleaned(emitted(found, regions), k, p)
    return in_order(kept)[: k.tables_per_page]


def above_floor(found: list[dict], k: Knobs) -> list[dict]:
    floors = {"lattice": k.min_confidence_lattice, "hybrid": k.min_confidence_hybrid}
    return [t for t in found if t["confidence"] >= floors.get(t["method"], k.min_confidence_network)]


def suppressed(found: list[dict], k: Knobs) -> list[dict]:
    """The older choice: by method and quality, each unless it lies in, or overlaps, one before it; nested tables stay."""
    p, out = Policy(), []
    for t in sorted(above_floor(found, k), key=lambda t: (-RANK[t["method"]], -quality(t))):
        if any(inside(t, o) >= k.nms_inside and not _both_nested(t, o, p) for o in out):
            continue
        out = [o for o in out if RANK[o["method"]] > RANK[t["method"]] or inside(o, t) < k.nms_inside or _both_nested(o, t, p)]
        if not any(not _both_nested(o, t, p) and (shared(o, t) >= 0.28 or iou(o, t) >= 0.35) for o in out):
            out.append(t)
    return in_order(out[: k.tables_per_page])


def marked(t: dict, *notes: str) -> dict:
    return t | {"notes": [*t["notes"], *notes]}


def candidates(ruled: list[dict], partial: list[dict], flows: list[dict], classic: list[dict], options: TableOptions) -> list[dict]:
    """A page's candidates after the gates of their detectors: ruled ones first, others as far as those leave room."""
    k = options.knobs
    found = [t for t in ruled if not chrome(t, facts(t))]
    strong = [t for t in found if strong_lattice(t, k)]
    solid = [t for t in found if solid_ruled(t, facts(t), k)]
    owned = options.exclusive and bool(strong or solid)
    own = strong or (solid if owned else [])
    lattices = list(found)
    found += [t for t in partial if not touches(t, own)]
    recall = not owned and not lattices
    added = 0
    for t in flows:
        f = facts(t)
        if not borderless_passes(t, f, k, recall):
            continue
        if owned:
            if not apart_from_ruled(t, f, lattices):
                continue
            t = marked(t, "clear_of_ruled")
        elif strong and touches(t, strong):
            if options.exclusive and under_ruled(t, strong):
                continue
            t = _demoted(t, 0.50, "under_ruled")
        if strong and t["cols"] == 2 and f.digit_led < 0.10:
            t = _demoted(t, 0.40, "weak_columns")
        found.append(t)
        added += 1
    small = not strong and not solid and all(t["cols"] <= 2 or width(t) < 140 for t in lattices)
    if options.classic and not added and (not found or small or recall and not solid):
        for t in classic:
            enough = t["cols"] >= (2 if recall else 3) and t["rows"] >= (3 if recall else 4)
            if enough and borderless_passes(t, facts(t), k, recall) and not any(inside(t, o) >= 0.55 or inside(o, t) >= 0.55 or iou(t, o) >= 0.40 for o in found):
                found.append(marked(t, "classic"))
    exploded = any(t["method"] == "hybrid" and t["cols"] >= 14 and t["rows"] >= 10 for t in found)
    if exploded and not any(is_borderless(t) and 3 <= t["cols"] <= 12 and t["rows"] >= 4 for t in found):
        for t in flows or (classic if options.classic else []):
            f = facts(t)
            if 3 <= t["cols"] <= 14 and t["rows"] >= 8 and t["confidence"] >= 0.50 and f.filled >= 20 and not notice(t, f) and not tax_form(f):
                found.append(marked(t, "for_wide_hybrid"))
    return without_wide_hybrids(without_sparse_ruled(without_ruled_twins(found)))


def after_forms(found: list[dict], flows: list[dict], k: Knobs) -> list[dict]:
    """Where the veto of forms took the ruled tables that had kept out borderless ones: large numeric ones come back."""
    if any(is_borderless(t) or t["method"] == "lattice" and solid_ruled(t, facts(t), k) for t in found):
        return found
    for t in flows:
        f = facts(t)
        if t["cols"] >= 8 and t["rows"] >= 10 and t["confidence"] >= 0.70 and f.digit_led >= 0.40 and f.chars <= 28 and f.filled >= 40 and borderless_passes(t, f, k, True):
            found = [*found, marked(t, "after_forms")]
    return found

