"""Repairs of found tables: missing row and column lines, glued numbers, totals and footnotes under a table."""

from __future__ import annotations

import re
import statistics

from ..plans.options import Knobs

_NUMBER = re.compile(r"^[-–(+$€£]*\d[\d,.]*[)%]?$|^[-–—]$")
_TOTALS = re.compile(r"^(?:sub-?total|total|grand total|tax|vat|shipping|balance due|amount due|discount)\b", re.I)
_YEARS, _DECIMALS, _THOUSANDS = re.compile(r"(?:(?:19|20)\d\d){2,}"), re.compile(r"(?:-?\d{1,3}\.\d{3}){2,}"), re.compile(r"\d{1,3}(?:,\d{3})+\d{1,3}(?:,\d{3})+")
_FOOTNOTE = re.compile(r"^(?:\(?\d{1,2}[).]|\*+|†|note:|source:)\s*\S", re.I)


def is_number(token: str) -> bool:
    return bool(_NUMBER.match(token))


def split_tokens(text: str) -> list[str]:
    """A cell's numbers apart where they are glued: 20192020, 1.2343.456, 1,2343,456; other text by its spaces."""
    out: list[str] = []
    for t in text.split():
        if len(t) < 8 or not t[-1].isdecimal():  # the shortest of them, and how they end
            out.append(t)
        elif _YEARS.fullmatch(t):
            out += re.findall(r"\d{4}", t)
        elif _DECIMALS.fullmatch(t):
            out += re.findall(r"-?\d{1,3}\.\d{3}", t)
        elif _THOUSANDS.fullmatch(t) and (parts := re.findall(r"\d{1,3}(?:,\d{3})+(?=\d|$)", t)) and "".join(parts) == t:
            out += parts
        else:
            out.append(t)
    return out


def glued(run: dict) -> bool:
    """A run of a row's cells: a label and numbers, or numbers alone, three tokens at least, most of them numbers."""
    tokens = split_tokens(run["text"])
    if len(tokens) < 3:
        return False
    numbers = sum(map(is_number, tokens))
    return numbers >= 2 and 2 * numbers >= len(tokens) and is_number(tokens[-1])


def split_run(run: dict) -> list[dict]:
    """Runs of a glued run's parts, placed by their share of its characters; words before the numbers stay together."""
    tokens = split_tokens(run["text"])
    k = next((i for i, t in enumerate(tokens) if all(map(is_number, tokens[i:]))), len(tokens))
    parts = ([" ".join(tokens[:k])] if k else []) + tokens[k:]
    text, at, out = run["text"], 0, []
    width = (run["x1"] - run["x0"]) / max(1, len(text))
    for p in parts:
        start = text.find(p.split()[0], at)
        start = at if start < 0 else start
        at = start + len(p)
        out.append(run | {"text": p, "x0": run["x0"] + width * start, "x1": min(run["x1"], run["x0"] + width * at)})
    return out


def unglued(runs: list[dict]) -> list[dict]:
    """Runs with wide glued ones split, if three of them agree on their number of parts."""
    wide = [r for r in runs if glued(r)]
    if len(wide) < 3:
        return runs
    usual = statistics.mode(len(split_run(r)) for r in wide)
    same = [id(r) for r in wide if len(split_run(r)) == usual]
    if len(same) < 3:
        return runs
    chosen = set(same)
    return [p for r in runs for p in (split_run(r) if id(r) in chosen else [r])]


def mid(r: dict) -> float:
    return (r["y0"] + r["y1"]) / 2


def _centre(band: list[dict]) -> float:
    return sum(map(mid, band)) / len(band)


def grows(before: int, after: int, k: Knobs) -> bool:
    """Whether so many rows from text in place of the drawn ones are recovery, not wrapped lines: a few, or far more, or of few."""
    if after <= before or after > k.max_rows:
        return False
    growth = after / max(1, before)
    small = after - before <= k.y_small_delta or growth <= k.y_small_growth
    return small or before < k.y_least_rows or not k.y_wrap_from < growth < k.y_wrap_to


def row_edges(ys: list[float], bands: list[list[dict]], size: float, k: Knobs) -> list[float]:
    """The edges with one more between each two text bands that none parts, if the bands are a regular grid's; else as they are."""
    multi = [b for b in bands if len(b) >= 2]
    mids = sorted(map(_centre, multi))
    mids = [m for m in mids if ys[0] < m < ys[-1]]
    rows = len(ys) - 1
    if len(mids) < 3 or len(mids) <= rows or len(mids) > k.max_rows:
        return ys
    gaps = [b - a for a, b in zip(mids, mids[1:])]
    if min(gaps) < 1.02 * size:
        return ys
    # Lines of one cell that wrap: one run of several in most bands.
    if sum(len(b) for b in multi) < 2 * len(multi):
        return ys
    out = [ys[0]]
    for a, b in zip(mids, mids[1:]):
        own = [y for y in ys[1:-1] if a < y < b]
        out += own or [(a + b) / 2]
    return [*out, ys[-1]]


def is_prose_grid(rows: int, cols: int, runs: list[dict], k: Knobs) -> bool:
    """Many columns, few drawn rows and few numbers: the drawn rows are the rows, and text between them is wrapped."""
    full = [r["text"] for r in runs if r["text"].strip()]
    numeric = sum(any(c in "0123456789" for c in t) for t in full) / max(1, len(full))
    return cols >= k.y_prose_cols and k.y_prose_least <= rows <= k.y_prose_most and numeric < k.y_prose_numeric


def fewer_rows(ys: list[float], bands: list[list[dict]], k: Knobs) -> list[float]:
    """The edges between text bands in place of drawn ones that are far denser: underlines and double rules."""
    rows = len(ys) - 1
    inside = [b for b in bands if ys[0] < _centre(b) < ys[-1]]
    multi = sorted(_centre(b) for b in inside if len(b) >= 2)
    if rows < 3 or len(multi) < 3 or len(inside) >= 2 * len(multi):
        return ys
    if rows < len(multi) * max(k.overdense, 1.15) or rows <= 1.25 * len(inside) + 2:
        return ys
    made = apart([ys[0], *((a + b) / 2 for a, b in zip(multi, multi[1:])), ys[-1]], 0.85 * k.min_cell)
    return made if 2 <= len(made) - 1 < rows else ys


def apart(edges: list[float], least: float) -> list[float]:
    """Rising edges at least so far apart; the last stays where it is."""
    out: list[float] = []
    for e in sorted(edges):
        if not out or e - out[-1] >= least:
            out.append(e)
    last = max(edges, default=0.0)
    if out and last - out[-1] > 1e-3:
        out[-1] = last
    return out


def column_edges(xs: list[float], anchors: list[float], size: float, k: Knobs) -> list[float]:
    """The edges with one more before each text column that none parts; as they are if that makes far too many."""
    inside = [a for a in anchors if xs[0] < a < xs[-1]]
    if len(inside) <= len(xs) - 1 or len(inside) > k.max_cols:
        return xs
    new = [a - 0.3 * size for a in inside if not any(a - 1.5 * size <= x <= a + 0.2 * size for x in xs)]
    cols, more = len(xs) - 1, len(xs) - 1 + len(new)
    if more > k.x_most and more > cols * k.x_factor + k.x_add:
        return xs
    return sorted([*xs, *new])


def outer_columns(xs: list[float], runs: list[dict], ys: list[float], k: Knobs) -> list[float]:
    """The edges with columns of text beside the frame: left edges of short or numeric runs that enough bands of the frame's rows share."""
    pad = max(k.min_cell, 2.0)
    own = [r for r in runs if r["text"].strip() and ys[0] - pad <= mid(r) <= ys[-1] + pad]
    if len(xs) < 2 or len(own) < 6:
        return xs
    size = sorted(r["font_size"] for r in own)[len(own) // 2] or 10.0
    near, line = max(0.5 * size, k.min_cell), max(0.5 * size, 2.0)
    cols, wide = len(xs) - 1, max(1.0, xs[-1] - xs[0])
    reach = min(max(k.x_outside * wide, 4 * k.min_cell), max(wide, 8 * k.min_cell))
    short = [r for r in own if len(r["text"].strip()) <= k.x_short or any(c in "0123456789" for c in r["text"])]
    lefts = means([r["x0"] for r in (short if len(short) >= 4 else own)], near)
    bands = means([mid(r) for r in own], line)
    if len(bands) < 4:
        return xs
    least = max(2, -(-len(bands) // (4 if cols <= 3 else 3)))
    places = [(round(mid(r) / line), r["x0"], mid(r)) for r in own]

    def hits(x: float) -> int:
        return sum(any(abs(y - b) <= line and abs(x0 - x) <= near for _, x0, y in places) for b in bands)

    outside = [x for x in lefts if (x < xs[0] - 0.5 * k.min_cell or x > xs[-1] + 0.5 * k.min_cell) and 0.35 * k.min_cell <= max(xs[0] - x, x - xs[-1]) <= reach and hits(x) >= least]
    left, right = sorted(x for x in outside if x < xs[0]), sorted(x for x in outside if x > xs[-1])
    out = list(xs)
    if left:
        # The frame's own left edge parts the last of them from the table.
        out = [left[0] - max(k.min_cell, 0.8 * size), *((a + b) / 2 for a, b in zip(left, left[1:])), *out]
    if right:
        end = max(r["x1"] for r in own if r["x0"] >= right[-1] - near)
        out += [*((a + b) / 2 for a, b in zip(right, right[1:])), max(end, right[-1]) + k.min_cell]
    return out if len(out) > len(xs) and len(out) - 1 <= k.max_cols else xs


def means(values: list[float], tolerance: float) -> list[float]:
    """Means of runs of sorted values within tolerance of the running mean."""
    out: list[list[float]] = []
    for v in sorted(values):
        if out and abs(v - out[-1][0]) <= tolerance:
            m, n = out[-1]
            out[-1] = [(m * n + v) / (n + 1), n + 1]
        else:
            out.append([v, 1])
    return [m for m, _ in out]


def without_baselines(rules: list[tuple], lines: list[list[dict]], size: float, snap: float) -> list[tuple]:
    """Rules without the horizontal ones that three lines of text stand on for half their length: underlines, not edges."""
    near = max(0.35 * size, 1.5)
    if len(lines) < 3:
        return rules
    feet = [(sum(r["y0"] for r in line) / len(line), min(r["x0"] for r in line), max(r["x1"] for r in line)) for line in lines]

    def edge(r: tuple) -> bool:
        if abs(r[3] - r[1]) > snap:
            return True
        y, long = (r[1] + r[3]) / 2, max(1.0, r[2] - r[0])
        return sum(abs(f - y) <= near and min(b, r[2]) - max(a, r[0]) >= 0.5 * long for f, a, b in feet) < 3

    return [r for r in rules if edge(r)]


def without_empty_columns(t: dict) -> dict:
    """Of four columns on, inner ones without any text go; spans over them shrink."""
    cols = t["cols"]
    if cols < 4 or t["rows"] < 2:
        return t
    used = {c["col"] + i for c in t["cells"] if c["text"] for i in range(c["colspan"])}
    kept = [c for c in range(cols) if c in (0, cols - 1) or c in used]
    if len(kept) == cols or len(kept) < 2:
        return t
    place = {c: i for i, c in enumerate(kept)}
    cells = [c | {"col": place[c["col"]], "colspan": max(1, sum(c["col"] + i in place for i in range(c["colspan"])))} for c in t["cells"] if c["col"] in place]
    return t | {"cells": cells, "cols": len(kept), "fill": sum(bool(c["text"]) for c in cells) / len(cells), "notes": [*t["notes"], "empty_columns"]}


_THRESHOLD = re.compile(r"^(.*[^\W\d_].*?)\s+((?:[<>≤≥=]\s*)?[-+]?\d[\d.,]*\s*%?)$")


def spread_tokens(t: dict) -> dict:
    """Rows whose numbers stand in one cell beside empty ones have them put apart: a whole row in one cell, a label with a
    threshold, or numbers that spill to the right, or to both sides."""
    rows: dict[int, dict[int, dict]] = {}
    for c in t["cells"]:
        if c["colspan"] == 1 and c["rowspan"] == 1:
            rows.setdefault(c["row"], {})[c["col"]] = c
    new: dict[tuple[int, int], str] = {}
    for row, own in rows.items():
        if len(own) != t["cols"]:
            continue
        texts = [own[c]["text"] for c in range(t["cols"])]
        if (made := _spread_row(texts)) != texts:
            new |= {(row, c): x for c, x in enumerate(made)}
    if not new:
        return t
    cells = [c | {"text": new.get((c["row"], c["col"]), c["text"])} for c in t["cells"]]
    return t | {"cells": cells, "fill": sum(bool(c["text"]) for c in cells) / len(cells)}


def _spread_row(texts: list[str]) -> list[str]:
    out, n = list(texts), len(texts)
    full = [i for i, x in enumerate(out) if x]
    if n == 2 and full == [0] and (m := _THRESHOLD.match(out[0])):
        return [m[1], m[2]]
    for src in full:
        tokens = split_tokens(out[src])
        if len(tokens) < 2 or 2 * sum(map(is_number, tokens)) <= len(tokens):
            continue
        if full == [src] and n - 1 <= len(tokens) <= n:
            start = 0 if len(tokens) == n else min(max(0, src - (len(tokens) - 1) // 2), n - len(tokens))
            return [""] * start + tokens + [""] * (n - start - len(tokens))
        right = next((i for i in range(src + 1, n) if out[i]), n)
        if right - src >= len(tokens):
            out[src : src + len(tokens)] = tokens
            continue
        label = next((i for i in range(n) if not out[i] or i == src), n)
        free = [i for i in range(label, n) if not out[i] or i == src]
        if len(free) >= len(tokens):
            out[src] = ""
            for i, x in zip(free, tokens):
                out[i] = x
    return out


def split_words(text: str) -> list[str]:
    """A header's words apart where capitals show that they are glued: NetIncomeTotal; others by their spaces."""
    return [w for t in text.split() for w in (re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+|[^\w\s]+", t) if re.search(r"[a-z][A-Z]", t) else [t])]


def unglued_header(line: list[dict], columns: int) -> list[dict]:
    """A header line of one run with as many words as its table has columns, or one fewer, as runs of a word each."""
    if len(line) != 1 or columns < 3:
        return line
    run, words = line[0], split_words(line[0]["text"])
    if not columns - 1 <= len(words) <= columns or any(map(is_number, words)):
        return line
    step, shift = (run["x1"] - run["x0"]) / columns, columns - len(words)
    return [run | {"text": w, "x0": run["x0"] + step * (i + shift), "x1": run["x0"] + step * (i + shift + 0.9)} for i, w in enumerate(words)]


def without_footer(t: dict) -> dict:
    """Without totals rows at its foot (a label and few amounts under a wider body) and numbered notes."""
    rows: dict[int, list[dict]] = {}
    for c in t["cells"]:
        if c["text"]:
            rows.setdefault(c["row"], []).append(c)
    last = t["rows"]
    while last > 3:
        own = sorted(rows.get(last - 1, []), key=lambda c: c["col"])
        first = own[0]["text"] if own else ""
        totals = own and len(own) <= max(2, t["cols"] // 2 - 1) and any(_TOTALS.match(c["text"]) for c in own) and t["cols"] >= 4
        note = len(own) == 1 and t["cols"] >= 2 and _FOOTNOTE.match(first) and not is_number(first)
        if not (totals or note):
            break
        last -= 1
    if last == t["rows"]:
        return t
    cells = [c for c in t["cells"] if c["row"] + c["rowspan"] <= last]
    if not cells:
        return t
    return t | {"rows": last, "cells": cells, "y0": min(c["y0"] for c in cells), "notes": [*t["notes"], "footer"]}
