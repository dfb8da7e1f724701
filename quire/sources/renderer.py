"""Pages drawn by a program outside, for lines that no operator of the page says: a plug-in point, its caps, and one for command-line tools.

A renderer is any object with ``render(content, page, dpi)``, which gives the page
as grey pixels (rows from the top) or None; it must be picklable, as it runs where
documents are opened. Without one, and where a program fails, nothing is drawn.
"""

from __future__ import annotations

import re
import shutil
import subprocess
import tempfile
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

import numpy as np

from .raster import grid_lines, merged

DPI, MOST_DPI, MOST_PIXELS, SECONDS, MOST_PAGES = 150, 200, 40_000_000, 5.0, 50


class Renderer(Protocol):
    def render(self, content: bytes, page: int, dpi: int) -> np.ndarray | None: ...


class NoRenderer:
    """Draws nothing."""

    def render(self, content: bytes, page: int, dpi: int) -> np.ndarray | None:
        return None


@dataclass(frozen=True)
class CommandRenderer:
    """The first of the programs that is installed; a document's pages beyond ``pages`` aren't drawn."""

    programs: tuple[str, ...] = ("pdftoppm", "mutool", "gs")
    seconds: float = SECONDS
    pages: int = MOST_PAGES

    def available(self) -> str | None:
        return next((p for p in self.programs if shutil.which(p)), None)

    def command(self, program: str, source: str, target: str, page: int, dpi: int) -> list[str]:
        one = str(page + 1)
        return {
            "pdftoppm": ["pdftoppm", "-gray", "-singlefile", "-r", str(dpi), "-f", one, "-l", one, source, target.removesuffix(".pgm")],
            "mutool": ["mutool", "draw", "-q", "-c", "gray", "-F", "pgm", "-r", str(dpi), "-o", target, source, one],
            "gs": ["gs", "-q", "-dBATCH", "-dNOPAUSE", "-dSAFER", "-sDEVICE=pgmraw", f"-r{dpi}", f"-dFirstPage={one}", f"-dLastPage={one}", f"-sOutputFile={target}", source],
        }[program]

    def render(self, content: bytes, page: int, dpi: int) -> np.ndarray | None:
        program = self.available()
        if program is None or page >= self.pages:
            return None
        with tempfile.TemporaryDirectory() as folder:
            source, target = Path(folder, "in.pdf"), Path(folder, "out.pgm")
            source.write_bytes(content)
            try:
                subprocess.run(self.command(program, str(source), str(target), page, min(dpi, MOST_DPI)), timeout=self.seconds, check=True, capture_output=True)
                return read_pgm(target.read_bytes())
            except (OSError, subprocess.SubprocessError, ValueError):
                return None


def read_pgm(data: bytes) -> np.ndarray:
    """Grey pixels of a binary PGM."""
    m = re.match(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data)
    if not m or int(m[3]) != 255:
        raise ValueError("no 8-bit PGM")
    wide, high = int(m[1]), int(m[2])
    if wide * high > MOST_PIXELS:
        raise ValueError("more pixels than allowed")
    return np.frombuffer(data, np.uint8, wide * high, m.end()).reshape(high, wide)


def within_caps(page: dict, dpi: int = DPI) -> bool:
    """Whether a page, drawn, has no more pixels than allowed."""
    return dpi <= MOST_DPI and abs((page["x1"] - page["x0"]) * (page["y1"] - page["y0"])) * (dpi / 72) ** 2 <= MOST_PIXELS


def _clusters(values: list[float], gap: float) -> int:
    n, last = 0, None
    for v in sorted(values):
        if last is None or v - last > gap:
            n += 1
        last = v
    return n


def wants_render(options, runs: list[dict], rules: list[tuple]) -> bool:
    """Whether a page is worth drawing: always if asked; else where text stands in columns and hardly a line is drawn."""
    if options.render:
        return True
    flat = sum(abs(r[3] - r[1]) <= 2 for r in rules)
    tall = sum(abs(r[2] - r[0]) <= 2 for r in rules)
    if not options.auto_render or flat >= 4 and tall >= 3 or flat + tall >= 6:
        return False
    return len(runs) >= 12 and _clusters([r["x0"] for r in runs], 12.0) >= 4


def rendered_rules(renderer: Renderer, content: bytes, page: dict, rules: list[tuple]) -> list[tuple]:
    """The page's rules and those of its drawing that are new."""
    px = renderer.render(content, page["page"], DPI) if within_caps(page) else None
    if px is None or not px.size or px.size > MOST_PIXELS:
        return rules
    high, wide = px.shape
    x, y = (page["x1"] - page["x0"]) / wide, (page["y1"] - page["y0"]) / high
    made = [(page["x0"] + a * x, page["y1"] - d * y, page["x0"] + c * x, page["y1"] - b * y, "raster") for a, b, c, d in grid_lines(px)]
    return merged(rules, made)
