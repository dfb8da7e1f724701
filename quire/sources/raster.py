"""Ruling lines of painted images: grey values, ink, directional opening, runs and the gate that a grid has to pass."""

from __future__ import annotations

import numpy as np

from .content import Matrix, apply
from .objects import Document, PdfError, Stream

DARK_MEAN, RADIUS, BIAS = 90, 6, 12
KERNEL_SHARE, KERNEL_LEAST, KERNEL_MOST = 35, 15, 80
LEAST_SIDE, GAP, LEAST_JOINTS = 40, 4, 6
#: Points within which a painted line is a drawn one again.
SNAP = 2.0


def grey(doc: Document, image: Stream) -> np.ndarray | None:
    """(height, width) grey values of an 8-bit grey or RGB image; None for others."""
    info = {k: doc.get(v) for k, v in image.info.items()}
    w, h, bits, space = info.get("Width"), info.get("Height"), info.get("BitsPerComponent", 8), info.get("ColorSpace")
    n = {"DeviceGray": 1, "DeviceRGB": 3}.get(space if isinstance(space, str) else "", 0)
    if not isinstance(w, int) or not isinstance(h, int) or bits != 8 or not n:
        return None
    try:
        data = doc.decode(image)
    except PdfError:
        return None
    if len(data) < w * h * n:
        return None
    px = np.frombuffer(data, np.uint8, w * h * n)
    if n == 1:
        return px.reshape(h, w)
    px = px.reshape(h, w, n).astype(np.uint32)
    return ((px[:, :, 0] * 30 + px[:, :, 1] * 59 + px[:, :, 2] * 11) // 100).astype(np.uint8)


def _window(x: np.ndarray, down: bool) -> np.ndarray:
    """Sums of 2 * RADIUS + 1 values that follow each other, down or across, by doubling."""
    part = (lambda y, lo, n: y[lo : lo + n]) if down else (lambda y, lo, n: y[:, lo : lo + n])
    n, out, at, have = 2 * RADIUS + 1, None, 0, 1
    left = x.shape[not down]
    most = left - n + 1
    while True:
        if n & have:
            own = part(x, at, most)
            out, at = own if out is None else out + own, at + have
        if 2 * have > n:
            return out
        left -= have
        x = part(x, 0, left) + part(x, have, left)
        have *= 2


def ink(px: np.ndarray) -> np.ndarray:
    """Pixels darker than their surroundings; a mostly dark image is turned round, lone pixels go."""
    if px.sum(dtype=np.int64) / px.size < DARK_MEAN:
        px = 255 - px
    # A window's sum, and so much times a pixel and the bias, stay below 65,536; v < sum / k² - bias in whole numbers.
    v = px.astype(np.uint16)
    sums = _window(_window(np.pad(v, RADIUS, mode="edge"), True), False)
    mask = (v + BIAS) * (2 * RADIUS + 1) ** 2 < sums
    around = np.pad(mask, 1)
    beside = around[:, :-2] | around[:, 2:]
    three = beside | around[:, 1:-1]
    return mask & (beside[1:-1] | three[:-2] | three[2:])


def _runs(mask: np.ndarray, least: int) -> dict[int, list[tuple[int, int]]]:
    """Per row its runs of ink over small gaps, long enough to be a line."""
    wide = mask.shape[1]
    at = np.flatnonzero(mask)
    if not len(at):
        return {}
    row = at // wide
    cut = np.flatnonzero((np.diff(at) > GAP) | (np.diff(row) > 0))
    first, last = np.r_[0, cut + 1], np.r_[cut, len(at) - 1]
    long = at[last] + 1 - at[first]
    found: dict[int, list[tuple[int, int]]] = {}
    for i in np.flatnonzero((long >= least) & ((last - first + 1) / long >= 0.72)).tolist():
        y = int(row[first[i]])
        a = int(at[first[i]]) - y * wide
        found.setdefault(y, []).append((a, a + int(long[i])))
    return found


def _lines(mask: np.ndarray) -> list[tuple[float, int, int]]:
    """(row, from, to) of horizontal lines: rows of ink that touch and overlap are one line."""
    least = int(min(max(mask.shape[1] // KERNEL_SHARE, KERNEL_LEAST), KERNEL_MOST))
    open_: list[list] = []
    done: list[list] = []
    found = _runs(mask, least)
    # Rows that have runs, and those at which a line ends.
    for y in sorted({k for y in found for k in (y, y + 1, y + 2)}):
        new = []
        for a, b in found.get(y, ()):
            for o in open_:
                if o[1] >= y - 1 and a < o[3] and b > o[2]:
                    o[1], o[2], o[3] = y, min(a, o[2]), max(b, o[3])
                    break
            else:
                new.append([y, y, a, b])
        open_ += new
        done += [o for o in open_ if o[1] < y - 1]
        open_ = [o for o in open_ if o[1] >= y - 1]
    return [((o[0] + o[1] + 1) / 2, o[2], o[3]) for o in done + open_ if o[1] - o[0] < 6]


def is_grid(h: list, v: list) -> bool:
    """Three lines each way and six crossings, every line in two of them."""
    hits_h, hits_v, n = [0] * len(h), [0] * len(v), 0
    for i, (y, a, b) in enumerate(h):
        for j, (x, c, d) in enumerate(v):
            if a - GAP <= x <= b + GAP and c - GAP <= y <= d + GAP:
                hits_h[i] += 1
                hits_v[j] += 1
                n += 1
    return n >= LEAST_JOINTS and sum(k >= 2 for k in hits_h) >= 3 and sum(k >= 2 for k in hits_v) >= 3


def grid_lines(px: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Lines (x0, y0, x1, y1) in pixels, rows from the top; none unless they make a grid."""
    mask = ink(px)
    h, v = _lines(mask), _lines(mask.T)
    return [(x0, y, x1, y) for y, x0, x1 in h] + [(x, y0, x, y1) for x, y0, y1 in v] if is_grid(h, v) else []


def seeds(px: np.ndarray, least: float = 5e-4) -> list[tuple[int, int, int, int]]:
    """Boxes (x0, y0, x1, y1) in pixels of lines that touch: where a grid may be, of so much of the image at least."""
    mask = ink(px)
    boxes = [(x0, int(y), x1, int(y) + 1) for y, x0, x1 in _lines(mask)] + [(int(x), y0, int(x) + 1, y1) for x, y0, y1 in _lines(mask.T)]
    parent = list(range(len(boxes)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (a, b, c, d) in enumerate(boxes):
        for j in range(i):
            e, f, g, h = boxes[j]
            if a - GAP <= g and e <= c + GAP and b - GAP <= h and f <= d + GAP:
                parent[find(i)] = find(j)
    groups: dict[int, list] = {}
    for i, box in enumerate(boxes):
        groups.setdefault(find(i), []).append(box)
    out = [(min(b[0] for b in g), min(b[1] for b in g), max(b[2] for b in g), max(b[3] for b in g)) for g in groups.values()]
    return sorted(b for b in out if (b[2] - b[0]) * (b[3] - b[1]) >= least * px.size)


def image_rules(doc: Document, resources, name: str, ctm: Matrix) -> list[tuple[float, float, float, float, str]]:
    """Rules that an image paints, in page space; none unless they make a grid."""
    res = doc.get(resources)
    named = doc.get(res.get("XObject")) if isinstance(res, dict) else None
    image = doc.get((named or {}).get(name))
    px = grey(doc, image) if isinstance(image, Stream) and image.info.get("Subtype") == "Image" else None
    if px is None or min(px.shape) < LEAST_SIDE:
        return []
    high, wide = px.shape
    out = []
    for a0, b0, a1, b1 in grid_lines(px):
        (x0, y0), (x1, y1) = apply(ctm, a0 / wide, 1 - b0 / high), apply(ctm, a1 / wide, 1 - b1 / high)
        out.append((min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1), "raster"))
    return out


def merged(drawn: list[tuple], painted: list[tuple]) -> list[tuple]:
    """Drawn rules and the painted ones that none before covers within SNAP; one that reaches further stays, as lines are joined later."""
    out, lines = list(drawn), {}

    def parts(r: tuple) -> tuple[bool, float, float, float]:
        return (True, (r[1] + r[3]) / 2, r[0], r[2]) if r[2] - r[0] >= r[3] - r[1] else (False, (r[0] + r[2]) / 2, r[1], r[3])

    def keep(r: tuple) -> None:
        flat, at, a, b = parts(r)
        if min(r[2] - r[0], r[3] - r[1]) <= SNAP:
            lines.setdefault((flat, int(at // SNAP)), []).append((at, a, b))

    for r in drawn:
        keep(r)
    for r in painted:
        flat, at, a, b = parts(r)
        near = [x for k in (-1, 0, 1) for x in lines.get((flat, int(at // SNAP) + k), ())]
        if not any(abs(x - at) <= SNAP and c - SNAP <= a and b <= d + SNAP for x, c, d in near):
            out.append(r)
            keep(r)
    return out
