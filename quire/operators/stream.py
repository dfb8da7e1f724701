"""The whitespace detector: borderless tables from gaps alone, where the network detector finds none. Plain Python, called in Arrow kernels."""

from __future__ import annotations

import re

from ..plans.options import Knobs
from .tables import _regularity, _table, clusters, grid_cells, text_lines, upper_median

_MARK = re.compile(r"^(?=.*\d)[\d.)(\- ]{1,6}$")


def _y(line: list[dict]) -> float:
    return sum((r["y0"] + r["y1"]) / 2 for r in line) / len(line)


def _anchors(lines: list[list[dict]], near: float, least: float) -> list[float]:
    """Left edges that a share of the lines has."""
    lefts = clusters([r["x0"] for line in lines for r in line], near)
    return [x for x in lefts if sum(any(abs(r["x0"] - x) <= 1.5 * near for r in line) for line in lines) >= least * len(lines)]


def alike(a: list[float], b: list[float], tolerance: float) -> bool:
    """Whether two sets of columns are one: of a number, three at least, and four in five in place."""
    if len(a) != len(b) or len(a) < 3:
        return False
    free, hits = list(b), 0
    for x in a:
        near = min(free, key=lambda y: abs(x - y))
        if abs(x - near) <= tolerance:
            free.remove(near)
            hits += 1
        if not free:
            break
    return hits >= 0.8 * len(a)


def areas(lines: list[list[dict]], size: float, k: Knobs) -> list[list[list[dict]]]:
    """Lines of several runs, from the top, cut at wide gaps; neighbours of the same columns are joined again."""
    gap, near = max(k.gap_sizes * size, k.gap_least), max(0.55 * size, 4.0)
    cut: list[list[list[dict]]] = []
    for line in lines:
        if cut and _y(cut[-1][-1]) - _y(line) <= gap:
            cut[-1].append(line)
        else:
            cut.append([line])
    out: list[list[list[dict]]] = []
    for part in cut:
        if out and alike(_anchors(out[-1], near, 0.30), _anchors(part, near, 0.30), 1.25 * near):
            out[-1] = out[-1] + part
        else:
            out.append(part)
    return out


def stream(page: int, runs: list[dict], k: Knobs) -> list[dict]:
    """Tables of the areas of a page; if none has one, of the whole page."""
    usual = upper_median([r["font_size"] for r in runs], 10.0)
    body = [r for r in runs if r["text"].strip() and r["font_size"] <= 1.3 * usual + 0.5]
    if len(body) < 6:
        return []
    size = upper_median([r["font_size"] for r in body], 10.0)
    multi = [line for line in text_lines(body, max(0.55 * size, 3.0)) if len(line) >= 2]
    found = [t for part in areas(multi, size, k) if len(part) >= max(3, k.min_lines) for t in region(page, part, size, k)]
    return found or region(page, multi, size, k)


def region(page: int, lines: list[list[dict]], size: float, k: Knobs) -> list[dict]:
    """The table of an area: columns that a third of its lines share, cut in the gaps, over the longest unbroken block of lines."""
    least, near = max(3, k.min_lines), max(0.55 * size, 4.0)
    if len(lines) < least:
        return []
    anchors = sorted(_anchors(lines, near, 0.35))
    if len(anchors) < 2:
        return []
    gaps = [(a["x1"] + b["x0"]) / 2 for line in lines for a, b in zip(line, line[1:]) if b["x0"] - a["x1"] > 0.7 * size]
    xs = [anchors[0] - 0.3 * size]
    for a, b in zip(anchors, anchors[1:]):
        between = (a + b) / 2
        xs.append(min((g for g in gaps if abs(g - between) < 2 * near), key=lambda g: abs(g - between), default=between))
    xs.append(max([anchors[-1] + 4 * size, *(r["x1"] for line in lines for r in line if r["x0"] >= anchors[-1] - near)]))
    body = [line for line in lines if sum(any(abs(r["x0"] - a) <= 1.5 * near for a in anchors) for r in line) >= 2]
    blocks: list[list[list[dict]]] = []
    for line in body:
        if blocks and _y(blocks[-1][-1]) - _y(line) < 3.5 * size:
            blocks[-1].append(line)
        else:
            blocks.append([line])
    block = max(blocks, key=len, default=[])
    if len(block) < least:
        return []
    mids = [_y(line) for line in block]
    ys = [mids[-1] - 0.65 * size, *[(a + b) / 2 for a, b in zip(mids[::-1], mids[-2::-1])], mids[0] + 0.65 * size]
    cells = grid_cells(xs, ys, [r for line in block for r in line])
    rows, cols = len(ys) - 1, len(xs) - 1
    texts = [c["text"] for c in cells if c["text"]]
    fill = len(texts) / max(1, len(cells))
    per_row = [sum(bool(c["text"]) for c in cells if c["row"] == r) for r in range(rows)]
    widths = sorted(b - a for a, b in zip(xs, xs[1:]))
    apart = min(1.0, widths[0] / max(1.0, 4 * size))
    if len(texts) < 4 or fill < k.stream_fill or sum(n >= 2 for n in per_row) < least or rows < 3 or cols < 2 or apart < k.column_gap:
        return []
    starts = [r["x0"] for line in lines for r in line]
    aligned = sum(any(abs(x - a) <= near for a in anchors) for x in starts) / len(starts)
    if _rejected(cells, texts, rows, cols, fill, aligned, k):
        return []
    usual = max(set(per_row), key=per_row.count)
    steady = sum(abs(n - usual) <= 1 for n in per_row) / rows
    confidence = 0.30 * apart + 0.25 * steady + 0.20 * fill + 0.15 * aligned + 0.10 * min(1.0, len(cells) / 6)
    return [_table(page, "stream", confidence, xs, ys, cells, notes=[f"regularity {_regularity(ys):.2f}"])] if confidence >= k.min_confidence_network else []


def _rejected(cells: list[dict], texts: list[str], rows: int, cols: int, fill: float, aligned: float, k: Knobs) -> bool:
    """Paragraphs, lists of marks and of words, and text that aligns by chance."""
    chars = sum(map(len, texts)) / len(texts)
    solid = [c for t in texts for c in t if not c.isspace()]
    signs = sum(c in ".,;:!?" for c in solid) / max(1, len(solid))
    digit_led = lambda t: sum(c.isdigit() for c in t) >= max(1, sum(map(str.isalpha, t)))
    numeric = sum(map(digit_led, texts)) / len(texts)
    first = [c["text"] for c in cells if c["col"] == 0 and c["text"]]
    marks = sum(bool(_MARK.match(t)) for t in first) / max(1, len(first))
    if cols == 2 and numeric < 0.10:
        by = {(c["row"], c["col"]): c["text"] for c in cells}
        word = lambda t: len(t) <= 28 and not digit_led(t) and sum(map(str.isalpha, t)) >= 2
        both = [(by.get((r, 0)), by.get((r, 1))) for r in range(rows)]
        both = [p for p in both if p[0] and p[1]]
        if both and sum(word(a) and word(b) for a, b in both) >= 0.70 * len(both):
            return True
    return (
        (cols <= 2 and chars >= k.prose_chars and numeric < 0.25)
        or (cols <= 3 and marks >= 0.5 and chars > 20)
        or (cols == 2 and marks >= 0.4 and chars > 28)
        or (marks >= 0.5 and len(first) >= 3 and numeric < 0.25 and chars > 18)
        or (signs > 0.12 and (chars > 40 and cols <= 3 and numeric < 0.15 or aligned < 0.55))
        or (cols >= 5 and fill < 0.35 and numeric < 0.12)
    )
