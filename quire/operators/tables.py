"""Tables of one page and of one document: detectors, choice among them and stitching. Plain Python, called in Arrow kernels.

A table is a dict: page, method, confidence, rows, cols, x0, y0, x1, y1, fill,
edge_score, joints, notes and cells; a cell: row, col, rowspan, colspan, x0, y0,
x1, y1, text, header. Row 0 is the top one.
"""

from __future__ import annotations

import re
import statistics
from bisect import bisect_left, bisect_right
from collections import defaultdict

from ..plans.options import Knobs, TableOptions
from . import refine, router

Rule = tuple[float, float, float, float]


clusters = refine.means


def upper_median(values: list[float], default: float) -> float:
    return sorted(values)[len(values) // 2] if values else default


def _joined(rules: list[tuple[float, float, float]], k: Knobs) -> list[tuple[float, float, float]]:
    """(place, from, to) lines: collinear within snap, joined over gaps of twice that."""
    lines: list[list] = []
    for at, a, b in sorted(rules):
        if lines and abs(at - lines[-1][0] / lines[-1][1]) <= k.snap:
            lines[-1][0] += at
            lines[-1][1] += 1
            lines[-1][2].append((a, b))
        else:
            lines.append([at, 1, [(a, b)]])
    out = []
    for total, n, parts in lines:
        parts.sort()
        a, b = parts[0]
        for c, d in parts[1:]:
            if c <= b + 2 * k.snap:
                b = max(b, d)
            else:
                out.append((total / n, a, b))
                a, b = c, d
        out.append((total / n, a, b))
    return out


def cell_text(runs: list[dict]) -> str:
    """Runs of a cell from top to bottom: a new line is a space, after a hyphen nothing."""
    if len(runs) < 2:
        return runs[0]["text"].strip() if runs else ""
    out, last = "", None
    for r in sorted(runs, key=lambda r: (-round((r["y0"] + r["y1"]) / 2, 1), r["x0"])):
        y = (r["y0"] + r["y1"]) / 2
        if last is None:
            out = r["text"].strip()
        elif abs(last - y) > 2:
            out = out[:-1] + r["text"].strip() if out.endswith("-") else f"{out} {r['text'].strip()}"
        else:
            out = f"{out} {r['text'].strip()}"
        last = y
    return out.strip()


def _covered(lines: list[tuple[float, float, float]], at: float, a: float, b: float, k: Knobs) -> bool:
    """Whether lines at a place cover enough of a side."""
    lo = bisect_left(lines, (at - 1.5 * k.snap,))
    got = 0.0
    for place, c, d in lines[lo:]:
        if place > at + 1.5 * k.snap:
            break
        got += max(0.0, min(b, d) - max(a, c))
    return b > a and got >= k.edge_cover * (b - a)


def _place(edges: list[float], v: float) -> int:
    """The interval of rising edges with v; -1: none."""
    i = bisect_right(edges, v) - 1
    return i if 0 <= i < len(edges) - 1 else -1


def _table(page: int, method: str, confidence: float, xs: list[float], ys: list[float], cells: list[dict], **more) -> dict:
    filled = sum(bool(c["text"]) for c in cells)
    return {"page": page, "method": method, "confidence": round(min(confidence, 1.0), 6), "rows": len(ys) - 1, "cols": len(xs) - 1, "x0": xs[0], "y0": ys[0], "x1": xs[-1], "y1": ys[-1], "fill": filled / max(1, len(cells)), "edge_score": 0.0, "joints": 0, "notes": [], "cells": cells} | more


def _regularity(edges: list[float]) -> float:
    gaps = [b - a for a, b in zip(edges, edges[1:])]
    return 1.0 if len(gaps) < 2 else max(0.0, 1 - 0.5 * statistics.pstdev(gaps) / statistics.mean(gaps))


def grid_cells(xs: list[float], ys: list[float], runs: list[dict], right: set | None = None, below: set | None = None) -> list[dict]:
    """Cells of a grid with text; empty cells join over missing edges ((row, col) in right or below: the edge is missing)."""
    rows, cols = len(ys) - 1, len(xs) - 1
    texts = defaultdict(list)
    for r in runs:
        c, j = _place(xs, (r["x0"] + r["x1"]) / 2), _place(ys, (r["y0"] + r["y1"]) / 2)
        if c >= 0 and j >= 0:
            texts[rows - 1 - j, c].append(r)
    if not right and not below:
        return [
            {"row": r, "col": c, "rowspan": 1, "colspan": 1, "x0": xs[c], "y0": ys[rows - r - 1], "x1": xs[c + 1], "y1": ys[rows - r], "text": (text := cell_text(texts[r, c]) if (r, c) in texts else ""), "header": r == 0 or r == 1 and bool(text)}
            for r in range(rows)
            for c in range(cols)
        ]
    taken: set[tuple[int, int]] = set()
    cells = []
    for r in range(rows):
        for c in range(cols):
            if (r, c) in taken:
                continue
            wide = 1
            while right and (r, c + wide - 1) in right and c + wide < cols and (r, c + wide) not in taken:
                wide += 1
            tall = 1
            while below and r + tall < rows and all((r + tall - 1, c + i) in below and (r + tall, c + i) not in taken for i in range(wide)) and all((r + tall, c + i) in right for i in range(wide - 1)):
                tall += 1
            own = [(r + i, c + j) for i in range(tall) for j in range(wide)]
            taken.update(own)
            text = cell_text([x for p in own for x in texts[p]])
            cells.append({"row": r, "col": c, "rowspan": tall, "colspan": wide, "x0": xs[c], "y0": ys[rows - r - tall], "x1": xs[c + wide], "y1": ys[rows - r], "text": text, "header": r == 0 or r == 1 and bool(text)})
    return cells


def lattice(page: int, runs: list[dict], rules: list[tuple], options: TableOptions) -> list[dict]:
    """Ruled tables: joints of horizontal and vertical lines, their components, a grid for each; a rule may name its source."""
    k = options.knobs
    painted = [r for r in rules if len(r) > 4 and r[4] == "raster"]
    if painted:
        size = upper_median([r["font_size"] for r in runs], 10.0)
        rules = refine.without_baselines(rules, text_lines(runs, max(0.35 * size, 2.5)), size, k.snap)
    h = _joined([((r[1] + r[3]) / 2, r[0], r[2]) for r in rules if abs(r[3] - r[1]) <= k.snap and r[2] - r[0] >= k.min_segment], k)
    v = _joined([((r[0] + r[2]) / 2, r[1], r[3]) for r in rules if abs(r[2] - r[0]) <= k.snap and r[3] - r[1] >= k.min_segment], k)
    if len(h) < 2 or len(v) < 2:
        return []
    v.sort()
    parent = list(range(len(h) + len(v)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    joints = []
    for i, (y, a, b) in enumerate(h):
        for j in range(bisect_left(v, (a - k.joint_gap,)), len(v)):
            x, c, d = v[j]
            if x > b + k.joint_gap:
                break
            if c - k.joint_gap <= y <= d + k.joint_gap:
                joints.append((i, j))
                p, q = find(i), find(len(h) + j)
                parent[max(p, q)] = min(p, q)
    groups = defaultdict(list)
    for i, j in joints:
        groups[find(i)].append((i, j))
    parts = [g for g in groups.values() if len(g) >= k.min_joints]
    boxes = [(min(v[j][0] for _, j in g), min(h[i][0] for i, _ in g), max(v[j][0] for _, j in g), max(h[i][0] for i, _ in g)) for g in parts]

    def beside(n: int) -> list[dict]:
        """Runs that stand in no other component."""
        return [r for r in runs if not any(m != n and b[0] <= (r["x0"] + r["x1"]) / 2 <= b[2] and b[1] <= refine.mid(r) <= b[3] for m, b in enumerate(boxes))]

    out = [t for n, g in enumerate(parts) if (t := _ruled(page, g, h, v, runs, painted, options, free=beside(n) if len(parts) > 1 else runs))]
    if not out and len(parts) == 1:
        # One component whose lines stop short of each other: all lines, snapped, as one grid.
        every = [(i, j) for i in range(len(h)) for j in range(len(v))]
        whole = _ruled(page, every, h, v, runs, painted, options, [p for p, _, _ in v], [p for p, _, _ in h])
        out = [router.marked(whole, "snapped")] if whole else []
    return out


def _supported(lines: list[tuple], hits: dict, keys: set, whole: float, least: float, k: Knobs) -> list[float]:
    """Places of lines that have enough joints over enough of the extent."""
    by = defaultdict(set)
    means = clusters([lines[x][0] for x in keys], k.snap)
    for x in keys:
        by[min(range(len(means)), key=lambda m: abs(means[m] - lines[x][0]))] |= hits[x]
    return [means[m] for m, s in sorted(by.items()) if len(s) >= k.joints_per_line and max(s) - min(s) >= least * whole]


def _ruled(page: int, group: list, h: list, v: list, runs: list[dict], painted: list, options: TableOptions, xs: list | None = None, ys: list | None = None, free: list[dict] | None = None) -> dict | None:
    """The table of a component of joints; ``xs`` and ``ys``: its edges, if not found by joints; ``free``: the runs of no other
    component, whose lines and columns may be its own, too."""
    k = options.knobs
    hs, vs = {i for i, _ in group}, {j for _, j in group}
    on_v, on_h = defaultdict(set), defaultdict(set)
    for i, j in group:
        on_v[j].add(h[i][0])
        on_h[i].add(v[j][0])
    tall = max(h[i][0] for i in hs) - min(h[i][0] for i in hs)
    wide = max(v[j][0] for j in vs) - min(v[j][0] for j in vs)
    box = (min(v[j][0] for j in vs), min(h[i][0] for i in hs), max(v[j][0] for j in vs), max(h[i][0] for i in hs))
    own = [r for r in painted if r[2] >= box[0] - k.snap and r[0] <= box[2] + k.snap and r[3] >= box[1] - k.snap and r[1] <= box[3] + k.snap]
    is_painted = 2 * len(own) > len(hs) + len(vs)
    if xs is None or ys is None:
        spans = (k.raster_v_span, k.raster_h_span) if is_painted else (k.v_span, k.h_span)
        xs, ys = _supported(v, on_v, vs, tall, spans[0], k), _supported(h, on_h, hs, wide, spans[1], k)
        long = clusters([h[i][0] for i in hs if h[i][2] - h[i][1] >= k.long_h_width * wide], k.snap)
        ys = long if len(long) >= k.long_h_ratio * max(1, len(ys)) else ys
    xs, ys = refine.apart(xs, k.min_cell), refine.apart(ys, k.min_cell)
    notes = ["raster"] if is_painted else []
    ruled = (len(xs), len(ys))
    if len(xs) > 1 and len(ys) > 1 and options.densify:
        free = runs if free is None else free
        inside = [r for r in free if xs[0] <= (r["x0"] + r["x1"]) / 2 <= xs[-1] and ys[0] <= (r["y0"] + r["y1"]) / 2 <= ys[-1]]
        size = upper_median([r["font_size"] for r in inside], 10.0)
        bands = text_lines(inside, 0.35 * size)
        if options.collapse and len(fewer := refine.fewer_rows(ys, bands, k)) < len(ys):
            ys, notes = fewer, [*notes, "collapsed"]
        if not refine.is_prose_grid(len(ys) - 1, len(xs) - 1, inside, k):
            more = refine.row_edges(ys, bands, size, k)
            ys = more if refine.grows(len(ys) - 1, len(more) - 1, k) else ys
        if len(xs) <= 3 and len(bands) >= 3:
            xs = refine.column_edges(xs, _columns(bands, size, k), size, k)
        around = refine.outer_columns(xs, free, ys, k)
        if len(around) > len(xs):
            xs, notes = around, [*notes, "outer_columns"]
    rows, cols = len(ys) - 1, len(xs) - 1
    if rows < 1 or cols < 1 or rows > k.max_rows or cols > k.max_cols or rows * cols < 2:
        return None
    own_h, own_v = sorted(h[i] for i in hs), sorted(v[j] for j in vs)
    right, below, covered = set(), set(), 0
    # A side is asked for once, though two cells have it.
    flat = [[_covered(own_h, y, a, b, k) for a, b in zip(xs, xs[1:])] for y in reversed(ys)]
    for r in range(rows):
        upright = [_covered(own_v, x, ys[rows - 1 - r], ys[rows - r], k) for x in xs]
        for c in range(cols):
            covered += upright[c] + upright[c + 1] + flat[r][c] + flat[r + 1][c]
            if not upright[c + 1] and c + 1 < cols and ruled[0] == len(xs):
                right.add((r, c))
            # Beside the frame nothing is drawn, and nothing is missing.
            if not flat[r + 1][c] and r + 1 < rows and ruled[1] == len(ys) and box[0] - k.snap <= xs[c] and xs[c + 1] <= box[2] + k.snap:
                below.add((r, c))
    cells = grid_cells(xs, ys, runs, right, below)
    filled = sum(bool(c["text"]) for c in cells)
    fill, edge = filled / len(cells), covered / (4 * rows * cols)
    box_area = (xs[-1] - xs[0]) * (ys[-1] - ys[0])
    regular = (_regularity(xs) + _regularity(ys)) / 2
    density = min(1.0, len(group) / max(1, (rows + 1) * (cols + 1)))
    confidence = 0.30 * regular + 0.25 * edge + 0.20 * fill + 0.15 * density + 0.10 * min(1.0, rows * cols / 12)
    if box_area < k.min_area:
        return None
    if is_painted and not filled:
        # All ink is in the image: the lines alone say what it is.
        confidence = 0.40 * regular + 0.35 * edge + 0.15 * density + 0.10 * min(1.0, rows * cols / 12)
    elif fill < k.min_fill or filled < min(k.min_filled, 2 * max(rows, cols)) or 1 - fill > k.max_empty:
        return None
    elif min(rows, cols) < k.tiny_side and filled < min(k.tiny_filled, rows * cols):
        return None
    notes += (["weak_edges"] if edge < k.weak_edge else []) + (["densified"] if ruled != (len(xs), len(ys)) else [])
    found = _trimmed(_table(page, "lattice", confidence, xs, ys, cells, edge_score=edge, joints=len(group), notes=notes))
    return refine.spread_tokens(refine.without_empty_columns(found))


def _trimmed(t: dict) -> dict:
    """Without empty rows and columns at its border; of five columns on, one empty outer column may stay."""
    used = [c for c in t["cells"] if c["text"]]
    if not used:
        return t
    r0, r1 = min(c["row"] for c in used), max(c["row"] + c["rowspan"] for c in used)
    c0, c1 = min(c["col"] for c in used), max(c["col"] + c["colspan"] for c in used)
    if t["cols"] >= 5:
        c0, c1 = max(0, c0 - 1), min(t["cols"], c1 + 1)
    if (r0, c0, r1, c1) == (0, 0, t["rows"], t["cols"]):
        return t
    cells = []
    for c in t["cells"]:
        a, b = max(c["row"], r0), min(c["row"] + c["rowspan"], r1)
        d, e = max(c["col"], c0), min(c["col"] + c["colspan"], c1)
        if a < b and d < e:
            cells.append(c | {"row": a - r0, "rowspan": b - a, "col": d - c0, "colspan": e - d, "header": a == r0})
    box = {"x0": min(c["x0"] for c in cells), "y0": min(c["y0"] for c in cells), "x1": max(c["x1"] for c in cells), "y1": max(c["y1"] for c in cells)}
    return t | box | {"rows": r1 - r0, "cols": c1 - c0, "cells": cells, "fill": len(used) / len(cells)}


def text_lines(runs: list[dict], tolerance: float) -> list[list[dict]]:
    """Lines of runs by running-mean height, from the top, each from the left."""
    out: list[list] = []
    for r in sorted(runs, key=lambda r: (-(r["y0"] + r["y1"]) / 2, r["x0"])):
        y = (r["y0"] + r["y1"]) / 2
        if out and abs(out[-1][0] - y) <= tolerance:
            m, own = out[-1]
            own.append(r)
            out[-1][0] = m + (y - m) / len(own)
        else:
            out.append([y, [r]])
    return [sorted(own, key=lambda r: r["x0"]) for _, own in out]


def _columns(lines: list[list[dict]], size: float, k: Knobs) -> list[float]:
    """Left edges of columns that enough lines share, with a clear gap before each."""
    lefts = clusters([r["x0"] for line in lines for r in line], max(3.0, 0.6 * size))
    support = [sum(any(abs(r["x0"] - a) <= max(3.0, 0.8 * size) for r in line) for line in lines) for a in lefts]
    kept = [a for a, s in zip(lefts, support) if s >= max(2, k.anchor_support * len(lines))]
    out: list[float] = []
    for a in kept:
        if not out or a - out[-1] >= max(8.0, 1.2 * size):
            out.append(a)
    return out


def is_prose(texts: list[str], k: Knobs) -> bool:
    """Long cells, list marks or one column of sentences: no table."""
    filled = [t for t in texts if t]
    if not filled:
        return True
    if sum(map(len, filled)) / len(filled) > k.prose_chars:
        return True
    listed = sum(bool(re.match(r"^(?:\d{1,2}[.)]|[•\-–*])$", t)) for t in filled)
    return listed >= 0.4 * len(filled)


def _line_y(line: list[dict]) -> float:
    return sum(map(refine.mid, line)) / len(line)


def _lefts_of(lines: list[list[dict]], size: float, k: Knobs) -> list[float]:
    """Left edges that a third of the lines share; lines of three runs on count first."""
    near = max(0.75 * size, 3.0)

    def shared_by(some: list[list[dict]]) -> list[float]:
        lefts = clusters([r["x0"] for line in some for r in line], near)
        return [x for x in lefts if sum(any(abs(r["x0"] - x) <= near for r in line) for line in some) >= max(1, k.anchor_support * len(some))]

    rich = [line for line in lines if len(line) >= 3]
    found = shared_by(rich) if len(rich) >= 2 else []
    return found if len(found) >= 3 else shared_by(lines)


def same_columns(a: list[float], b: list[float], tolerance: float) -> bool:
    """Whether two areas' columns go together: of a number, and half of them, two at least, in place."""
    if len(a) != len(b) or len(a) < 2:
        return False
    free, hits = list(b), 0
    for x in a:
        near = min(free, key=lambda y: abs(x - y), default=None)
        if near is not None and abs(x - near) <= tolerance:
            free.remove(near)
            hits += 1
    return hits >= 2 and 2 * hits >= len(a)


def areas(lines: list[list[dict]], size: float, k: Knobs) -> list[list[list[dict]]]:
    """Lines of a page's tables, from the top: cut at wide gaps always, at moderate ones where the columns change; neighbours
    of the same columns are joined again, also over up to three lines of others, never over a wide gap."""
    if not lines:
        return []
    ys = [_line_y(line) for line in lines]
    steps = [a - b for a, b in zip(ys, ys[1:]) if a - b > 0.5]
    pitch = upper_median(steps, 1.5 * size)
    soft = max(1.6 * pitch, 0.35 * k.gap_sizes * size, 0.5 * k.gap_least, 1.1 * size)
    hard = max(6 * pitch, 3 * soft, 4 * size)
    near = max(0.75 * size, 3.0)
    like = lambda a, b: same_columns(_lefts_of(a, size, k), _lefts_of(b, size, k), near)
    cut = [[lines[0]]]
    for i in range(1, len(lines)):
        gap = ys[i - 1] - ys[i]
        if gap >= hard or gap > soft and not like(lines[max(0, i - 4) : i], lines[i : i + 4]):
            cut.append([])
        cut[-1].append(lines[i])
    apart = lambda a, b: _line_y(a[-1]) - _line_y(b[0]) >= hard

    def joined(parts: list) -> list:
        out: list = []
        for p in parts:
            if out and not apart(out[-1], p) and like(out[-1], p):
                out[-1] = out[-1] + p
            else:
                out.append(p)
        return out

    cut = joined(cut)
    for _ in range(8):
        out, i, changed = [], 0, False
        while i < len(cut):
            if i + 2 < len(cut) and len(cut[i + 1]) <= 3 and not apart(cut[i], cut[i + 2]) and like(cut[i], cut[i + 2]):
                out.append(cut[i] + cut[i + 1] + cut[i + 2])
                i, changed = i + 3, True
            else:
                out.append(cut[i])
                i += 1
        cut = joined(out)
        if not changed:
            break
    return cut


def _near_joined(columns: list[float], lines: list[list[dict]], size: float) -> list[float]:
    """Columns that stand far closer than usual become one, where more lines have it."""
    near = max(0.75 * size, 3.0)
    gaps = [b - a for a, b in zip(columns, columns[1:])]
    least = max(0.5 * max(upper_median(gaps, 0.0), 2 * near), near)
    support = lambda x: sum(any(abs(r["x0"] - x) <= 1.2 * near for r in line) for line in lines)
    out: list[tuple[float, int]] = []
    for x in columns:
        s = support(x)
        if out and len(columns) >= 3 and x - out[-1][0] <= least:
            y, t = out[-1]
            out[-1] = ((y + x) / 2 if s == t else x if s > t else y, s + t)
        else:
            out.append((x, s))
    return [x for x, _ in out]


def network(page: int, runs: list[dict], k: Knobs) -> list[dict]:
    """Borderless tables: areas of lines with several runs whose left edges agree."""
    size = upper_median([r["font_size"] for r in runs], 10.0)
    body = [r for r in runs if r["font_size"] <= k.body_size * size + 0.5 and r["text"].strip()]
    if len(body) < 6:
        return []
    extent = max(r["x1"] for r in body) - min(r["x0"] for r in body)
    lines = text_lines(body, 0.35 * size)
    usual = max((len(line) for line in lines), default=0)
    multi = [line for line in lines if len(line) >= 2]
    if len(multi) < k.min_lines:
        return []
    heads = {id(line): refine.unglued_header(line, usual) for line in lines if len(line) == 1}
    out = []
    for block in areas(multi, size, k):
        if len(block) < k.min_lines:
            continue
        anchors = _near_joined(_columns(block, size, k), block, size)
        if len(anchors) < 2:
            continue
        top = _line_y(block[0])
        above = [line for line in lines if len(line) == 1 and 0 < _line_y(line) - top <= 2 * size]
        if above and len(heads[id(above[-1])]) > 1:
            block = [heads[id(above[-1])], *block]
        right = max(r["x1"] for line in block for r in line)
        if extent > 0 and right - anchors[0] < 0.15 * extent:
            continue
        edges = [anchors[0] - 1.0]
        for a, b in zip(anchors, anchors[1:]):
            before = [r["x1"] for line in block for r in line if a - size <= r["x0"] < b - 0.5 * size and r["x1"] < b]
            edges.append((max([*before, a]) + b) / 2)
        edges.append(right + 1.0)
        mids = [_line_y(line) for line in block]
        bottoms = [mids[0] + size, *[(a + b) / 2 for a, b in zip(mids, mids[1:])], mids[-1] - size]
        ys = bottoms[::-1]
        cells = grid_cells(edges, ys, [r for line in block for r in line])
        filled = sum(bool(c["text"]) for c in cells) / len(cells)
        if filled < k.stream_fill or len(ys) - 1 > 4 * k.max_rows or is_prose([c["text"] for c in cells], k):
            continue
        confidence = min(0.95, 0.55 + 0.25 * filled + 0.10 * min(1, (len(edges) - 1) / 6) + 0.10 * min(1, (len(ys) - 1) / 20))
        out.append(_trimmed(_table(page, "network", confidence, edges, ys, cells)))
    return _flows_joined(out, 8 * size)


def _flows_joined(found: list[dict], gap: float) -> list[dict]:
    """Borderless tables of the same columns close above each other become one."""
    out: list[dict] = []
    for t in sorted(found, key=lambda t: -t["y1"]):
        up = out[-1] if out else None
        if up and up["cols"] == t["cols"] and 0 <= up["y0"] - t["y1"] <= gap and same_columns(_lefts(up), _lefts(t), 12.0) and len(_lefts(up)) == up["cols"]:
            cells = up["cells"] + [c | {"row": c["row"] + up["rows"], "header": False} for c in t["cells"]]
            box = {"x0": min(up["x0"], t["x0"]), "x1": max(up["x1"], t["x1"]), "y0": t["y0"]}
            out[-1] = up | box | {"cells": cells, "rows": up["rows"] + t["rows"], "fill": sum(bool(c["text"]) for c in cells) / len(cells), "notes": [*up["notes"], "stacked"]}
        else:
            out.append(t)
    return out


def hybrid(page: int, runs: list[dict], rules: list[Rule], k: Knobs) -> list[dict]:
    """Partly ruled tables: a frame of which three sides are drawn; columns from text and rules, rows from rules or lines."""
    if len(rules) < 3:
        return []
    x0, x1 = min(r[0] for r in rules), max(r[2] for r in rules)
    y0, y1 = min(r[1] for r in rules), max(r[3] for r in rules)
    if x1 - x0 < k.frame_least or y1 - y0 < k.frame_least:
        return []
    h = sorted(_joined([((r[1] + r[3]) / 2, r[0], r[2]) for r in rules if r[2] - r[0] >= k.min_segment and abs(r[3] - r[1]) <= k.snap], k))
    v = sorted(_joined([((r[0] + r[2]) / 2, r[1], r[3]) for r in rules if r[3] - r[1] >= k.min_segment and abs(r[2] - r[0]) <= k.snap], k))

    def cover(lines, at, a, b) -> float:
        return min(1.0, sum(max(0.0, min(b, d) - max(a, c)) for p, c, d in lines if abs(p - at) <= 1.5 * k.snap) / (b - a))

    sides = [cover(v, x0, y0, y1), cover(v, x1, y0, y1), cover(h, y0, x0, x1), cover(h, y1, x0, x1)]
    if sum(s >= k.frame_side for s in sides) < 3 and sum(sides) < k.frame_sum:
        return []
    inside = [r for r in runs if x0 - 1 <= (r["x0"] + r["x1"]) / 2 <= x1 + 1 and y0 - 1 <= (r["y0"] + r["y1"]) / 2 <= y1 + 1]
    size = upper_median([r["font_size"] for r in inside], 10.0)
    lines = text_lines(inside, 0.35 * size)
    anchors = _columns(lines, size, k)
    xs = clusters([x0, x1, *[p for p, c, d in v if d - c >= 0.6 * (y1 - y0)]], k.snap)
    xs = sorted([*xs, *[a - 2 for a in anchors[1:] if all(abs(a - 2 - x) > size for x in xs)]])
    inner = [p for p, c, d in h if d - c >= 0.6 * (x1 - x0)]
    mids = [sum((r["y0"] + r["y1"]) / 2 for r in line) / len(line) for line in lines]
    ys = clusters([y0, y1, *inner], k.snap)
    if len(ys) - 1 < len(lines):
        ys = sorted({y0, y1, *[(a + b) / 2 for a, b in zip(mids, mids[1:])]})
    if len(ys) - 1 < 3 or len(xs) - 1 < 2 or len(xs) - 1 > k.max_cols:
        return []
    cells = grid_cells(xs, ys, inside)
    fill = sum(bool(c["text"]) for c in cells) / len(cells)
    if fill < 0.2 or is_prose([c["text"] for c in cells], k):
        return []
    confidence = 0.4 * sum(sides) / 4 + 0.35 * fill + 0.25 * (_regularity(xs) + _regularity(ys)) / 2
    if len(ys) > 3 and len(xs) > 3:
        confidence = max(confidence, k.hybrid_floor)
    found = _trimmed(_table(page, "hybrid", confidence, xs, ys, cells, edge_score=sum(sides) / 4))
    return [found] if min(found["rows"], found["cols"]) >= 2 else []


def split_sides(t: dict, k: Knobs) -> list[dict]:
    """Two tables where an almost empty column is a gutter between them."""
    widths = defaultdict(float)
    used = defaultdict(int)
    for c in t["cells"]:
        if c["colspan"] == 1:
            widths[c["col"]] = c["x1"] - c["x0"]
            used[c["col"]] += bool(c["text"])
    if t["cols"] < 5 or t["rows"] < 2:
        return [t]
    usual = upper_median(list(widths.values()), 0.0)
    for col in range(2, t["cols"] - 2):
        if used[col] <= k.gutter_fill * t["rows"] and not used[col] and widths[col] >= max(k.gutter, k.gutter_ratio * usual):
            sides = []
            for lo, hi in ((0, col), (col + 1, t["cols"])):
                cells = [c | {"col": c["col"] - lo} for c in t["cells"] if lo <= c["col"] and c["col"] + c["colspan"] <= hi]
                if not cells:
                    return [t]
                box = {"x0": min(c["x0"] for c in cells), "x1": max(c["x1"] for c in cells)}
                sides.append(t | box | {"cells": cells, "cols": hi - lo, "notes": [*t["notes"], "split"]})
            return sides
    return [t]


def page_tables(page: int, runs: list[dict], rules: list[tuple], options: TableOptions, page_area: float = router.PAGE_AREA) -> list[dict]:
    """A page's tables: the detectors' candidates, gates, repairs, and the choice among them."""
    if not options.detect:
        return []
    from .stream import stream

    k = options.knobs
    rules = rules if options.raster else [r for r in rules if len(r) < 5 or r[4] != "raster"]
    runs = refine.unglued(runs)
    flows = network(page, runs, k) if options.network else []
    classic = stream(page, runs, k) if options.classic else []
    found = router.candidates(lattice(page, runs, rules, options) if options.lattice else [], hybrid(page, runs, rules, k) if options.hybrid else [], flows, classic, options)
    if options.split:
        found = [s for t in found for s in split_sides(t, k)]
    if options.forms:
        found = router.after_forms(router.without_forms(found, k), flows, k)
    found = router.demoted_slices(found)
    kept = router.routed(found, k, page_area) if options.router else router.suppressed(found, k)
    return [refine.without_footer(t) for t in kept]


def header_of(t: dict) -> list[str]:
    return [" ".join(c["text"].lower().split()) for c in sorted((c for c in t["cells"] if c["row"] == 0), key=lambda c: c["col"])]


def _lefts(t: dict) -> list[float]:
    by: dict[int, float] = {}
    for c in t["cells"]:
        by[c["col"]] = min(by.get(c["col"], c["x0"]), c["x0"])
    return [by[c] for c in sorted(by)]


def same_header(a: list[str], b: list[str]) -> float:
    return sum(x == y or bool(x and y and (x in y or y in x)) for x, y in zip(a, b)) / max(len(a), len(b), 1)


def stitch_score(a: dict, b: dict, k: Knobs) -> float:
    """How well b, on the page after, goes on with a; 0: not at all."""
    if a["cols"] != b["cols"] or a["cols"] < 2:
        return 0.0
    x, y = _lefts(a), _lefts(b)
    dx = sum(abs(p - q) for p, q in zip(x, y)) / max(1, len(x)) if len(x) == len(y) else 1e9
    if dx > k.stitch_dx:
        return 0.0
    alike = same_header(header_of(a), header_of(b))
    if alike >= k.stitch_header:
        return 0.6 + 0.4 * alike
    if a["cols"] >= 3 and a["rows"] >= 4 and b["rows"] >= 2 and dx <= 0.7 * k.stitch_dx:
        return 0.55
    return 0.0


def stitch(tables: list[dict], heights: dict[int, float], k: Knobs) -> list[dict]:
    """Tables with logical ids: fragments at the foot of a page and the head of the next that go together share one."""
    by_page = defaultdict(list)
    for i, t in enumerate(tables):
        by_page[t["page"]].append(i)
    follows: dict[int, int] = {}
    for p, own in by_page.items():
        h = heights.get(p, 792.0)
        low = [i for i in own if tables[i]["y0"] < k.stitch_band * h or (tables[i]["y0"] + tables[i]["y1"]) / 2 < k.stitch_reach * h]
        g = heights.get(p + 1, 792.0)
        high = [i for i in by_page.get(p + 1, ()) if tables[i]["y1"] > (1 - k.stitch_band) * g or (tables[i]["y0"] + tables[i]["y1"]) / 2 > (1 - k.stitch_reach) * g]
        pairs = sorted(((stitch_score(tables[i], tables[j], k), i, j) for i in low for j in high), key=lambda s: (-s[0], s[1], s[2]))
        used: set[int] = set()
        for s, i, j in pairs:
            if s > 0 and i not in follows and j not in used:
                follows[i] = j
                used.add(j)
    before = {j: i for i, j in follows.items()}
    out, n = [dict(t, logical=-1, continues=i in follows, continued=i in before) for i, t in enumerate(tables)], 0
    for i in range(len(out)):
        if i not in before:
            j: int | None = i
            while j is not None:
                out[j]["logical"] = n
                j = follows.get(j)
            n += 1
    return out


def logical_tables(tables: list[dict], k: Knobs) -> list[dict]:
    """One table per logical id: bodies one under another, a repeated header once."""
    chains = defaultdict(list)
    for t in tables:
        chains[t["logical"]].append(t)
    out = []
    for n, chain in sorted(chains.items()):
        chain.sort(key=lambda t: t["page"])
        first = chain[0]
        cells, rows = [dict(c) for c in first["cells"]], first["rows"]
        for t in chain[1:]:
            if t["cols"] != first["cols"]:
                continue
            skip = 1 if same_header(header_of(first), header_of(t)) >= 0.85 else 0
            cells += [c | {"row": c["row"] - skip + rows, "header": False} for c in t["cells"] if c["row"] >= skip]
            rows += t["rows"] - skip
        out.append(first | {"cells": cells, "rows": rows, "logical": n, "pages": [t["page"] for t in chain], "confidence": min(t["confidence"] for t in chain)})
    return out
