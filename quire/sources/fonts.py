"""Fonts of a page: codes to characters with a confidence, and widths."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .objects import KNOWN, Document, Name, PdfError, Ref, Stream

LOST = "�"
_GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "quoteright": "’", "quoteleft": "‘",
    "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "minus": "−", "period": ".", "slash": "/", "colon": ":", "semicolon": ";",
    "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_",
    "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "quotedblleft": "“",
    "quotedblright": "”", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "Euro": "€", "sterling": "£", "yen": "¥", "cent": "¢", "degree": "°", "section": "§",
    "paragraph": "¶", "copyright": "©", "registered": "®", "trademark": "™", "plusminus": "±", "multiply": "×", "divide": "÷", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ",
    "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "aring": "å", "Aring": "Å", "ccedilla": "ç", "Ccedilla": "Ç", "ntilde": "ñ", "Ntilde": "Ñ", "dagger": "†", "guillemotleft": "«",
    "guillemotright": "»", "mu": "µ", "nbspace": "\xa0", "exclamdown": "¡", "questiondown": "¿",
}
_GLYPHS |= dict(zip("zero one two three four five six seven eight nine".split(), "0123456789"))
_MARKS = {"acute": "aáeéiíoóuúyýAÁEÉIÍOÓUÚ", "grave": "aàeèiìoòuùAÀEÈIÌOÒUÙ", "circumflex": "aâeêiîoôuûAÂEÊIÎOÔUÛ", "dieresis": "aäeëiïoöuüAÄEËIÏOÖUÜ", "tilde": "aãoõAÃOÕ"}
_GLYPHS |= {base + mark: made for mark, pairs in _MARKS.items() for base, made in zip(pairs[::2], pairs[1::2])}


def glyph(name: str) -> str | None:
    """The character of a glyph name."""
    if name in _GLYPHS:
        return _GLYPHS[name]
    if len(name) == 1:
        return name
    if m := re.match(r"uni([0-9A-F]{4})$|u([0-9A-F]{4,6})$", name):
        return chr(int(m[1] or m[2], 16))
    return None


def to_unicode_map(cmap: bytes) -> dict[int, str]:
    """Codes to text of a ToUnicode map: bfchar pairs and bfrange triples."""
    text = cmap.decode("latin-1")
    out: dict[int, str] = {}

    def chars(h: str) -> str:
        return bytes.fromhex(h if len(h) % 2 == 0 else h + "0").decode("utf-16-be", "replace")

    for block in re.findall(r"beginbfchar(.*?)endbfchar", text, re.S):
        for a, b in re.findall(r"<\s*([0-9A-Fa-f]+)\s*>\s*<\s*([0-9A-Fa-f]+)\s*>", block):
            out[int(a, 16)] = chars(b)
    for block in re.findall(r"beginbfrange(.*?)endbfrange", text, re.S):
        for a, b, c in re.findall(r"<\s*([0-9A-Fa-f]+)\s*>\s*<\s*([0-9A-Fa-f]+)\s*>\s*<\s*([0-9A-Fa-f]+)\s*>", block):
            first, last, start = int(a, 16), int(b, 16), chars(c)
            if 0 <= last - first < 10_000 and start:
                for k in range(last - first + 1):
                    out[first + k] = start[:-1] + chr(min(ord(start[-1]) + k, 0x10FFFF))
    return out


@dataclass
class Font:
    """One font; Type0 fonts have two-byte codes."""

    wide: bool = False
    differences: dict[int, str] = field(default_factory=dict)
    unicode: dict[int, str] = field(default_factory=dict)
    widths: dict[int, float] = field(default_factory=dict)
    ranges: list[tuple[int, int, float]] = field(default_factory=list)
    default_width: float = 500.0
    ascent: float = 800.0
    descent: float = -200.0
    _chars: tuple | None = field(default=None, repr=False, compare=False)
    _steps: dict[tuple, list[float]] = field(default_factory=dict, repr=False, compare=False)

    def char(self, code: int) -> tuple[str, float]:
        """(text, confidence)."""
        if code in self.unicode:
            return self.unicode[code], 1.0
        if self.wide:
            return (chr(code), 0.3) if 32 <= code < 0xD800 or 0xE000 <= code <= 0xFFFF else (LOST, 0.0)
        if code in self.differences:
            c = glyph(self.differences[code])
            return (c, 1.0) if c else (LOST, 0.0)
        if 32 <= code < 127 or code in (9, 10, 13):
            return chr(code), 1.0
        return (chr(code), 0.85) if code >= 0xA0 else (LOST, 0.0)

    def width(self, code: int) -> float:
        if (w := self.widths.get(code)) is not None and (w > 0 or self.wide):
            return w
        for a, b, w in self.ranges:
            if a <= code <= b:
                return w
        return self.default_width

    def chars(self) -> tuple[list[str], list[float], bytes]:
        """Characters and confidences of a one-byte font's codes, and the codes that are sure; made once."""
        if self._chars is None:
            every = [self.char(code) for code in range(256)]
            self._chars = [c for c, _ in every], [p for _, p in every], bytes(code for code, (_, p) in enumerate(every) if p == 1.0)
        return self._chars

    def steps(self, size: float, scale: float, char: float, word: float) -> list[float]:
        """How far each code of a one-byte font moves on, under a text state."""
        key = (size, scale, char, word)
        if (known := self._steps.get(key)) is None:
            if len(self._steps) >= 16:
                self._steps.clear()
            known = self._steps[key] = [self.width(code) / 1000 * size * scale + char + (word if c == " " or code == 32 else 0) for code, c in enumerate(self.chars()[0])]
        return known

    def codes(self, data: bytes) -> list[int]:
        if self.wide or data[:2] == b"\xfe\xff":
            data = data[2:] if data[:2] == b"\xfe\xff" else data
            return [data[i] << 8 | data[i + 1] for i in range(0, len(data) - 1, 2)] + list(data[len(data) // 2 * 2 :])
        return list(data)


def _metrics(doc: Document, font: Font, descriptor) -> None:
    d = doc.get(descriptor)
    if isinstance(d, dict):
        for key, name in (("Ascent", "ascent"), ("Descent", "descent")):
            v = doc.get(d.get(key))
            if isinstance(v, (int, float)) and v:
                setattr(font, name, float(v))
        if isinstance(w := doc.get(d.get("MissingWidth")), (int, float)):
            font.default_width = float(w)


def load(doc: Document, x) -> Font:
    """A font from its dictionary; what is broken in it falls back to Latin."""
    info = doc.get(x)
    font = Font()
    if not isinstance(info, dict):
        return font
    s = doc.get(info.get("ToUnicode"))
    if isinstance(s, Stream):
        try:
            font.unicode = to_unicode_map(doc.decode(s))
        except PdfError:
            pass
    if info.get("Subtype") == "Type0":
        font.wide, font.default_width = True, 1000.0
        kids = doc.get(info.get("DescendantFonts"))
        own = doc.get(kids[0]) if isinstance(kids, list) and kids else None
        if isinstance(own, dict):
            _metrics(doc, font, own.get("FontDescriptor"))
            font.default_width = float(doc.get(own.get("DW")) or 1000)
            w, k = doc.get(own.get("W")) or [], 0
            while k + 1 < len(w):
                first, second = doc.get(w[k]), doc.get(w[k + 1])
                if isinstance(second, list):
                    font.widths |= {first + j: float(v) for j, v in enumerate(map(doc.get, second)) if isinstance(v, (int, float))}
                    k += 2
                elif k + 2 < len(w):
                    font.ranges.append((first, second, float(doc.get(w[k + 2]))))
                    k += 3
                else:
                    break
        return font
    _metrics(doc, font, info.get("FontDescriptor"))
    first, widths = doc.get(info.get("FirstChar")) or 0, doc.get(info.get("Widths"))
    if isinstance(widths, list):
        font.widths = {first + k: float(w) for k, w in enumerate(map(doc.get, widths[:256])) if isinstance(w, (int, float))}
    encoding = doc.get(info.get("Encoding"))
    if isinstance(encoding, dict):
        code = 0
        for item in doc.get(encoding.get("Differences")) or []:
            item = doc.get(item)
            if isinstance(item, int):
                code = item
            elif isinstance(item, Name):
                font.differences[code] = str(item)
                code += 1
    return font


#: Fonts by their dictionaries' identity, which objects.known keeps from file to file; only of those that refer to nothing else.
_FONTS: dict[int, tuple[dict, Font]] = {}


def _alone(x) -> bool:
    """Whether nothing in it is a reference."""
    if isinstance(x, dict):
        return all(map(_alone, x.values()))
    return all(map(_alone, x)) if isinstance(x, list) else not isinstance(x, Ref)


def _loaded(doc: Document, x) -> Font:
    """A font, or a plain Latin one where its dictionary is broken."""
    info = doc.get(x)
    if (seen := _FONTS.get(id(info))) and seen[0] is info:
        return seen[1]
    try:
        font = load(doc, info)
    except (PdfError, ValueError, TypeError, AttributeError, IndexError):
        return Font()
    if isinstance(info, dict) and _alone(info):
        if len(_FONTS) >= KNOWN:
            _FONTS.clear()
        _FONTS[id(info)] = info, font
    return font


def page_fonts(doc: Document, *resources) -> dict[str, Font]:
    """The fonts of the first resources that name any: a form's or page's own, then what it inherits; else one plain Latin font."""
    for own in resources:
        res = doc.get(own)
        named = doc.get(res.get("Font")) if isinstance(res, dict) else None
        if isinstance(named, dict) and named:
            return {name: _loaded(doc, x) for name, x in named.items()}
    return {"F1": Font()}


def resolve(fonts: dict[str, Font], name: str | None) -> tuple[str, Font]:
    """By name, without a subset's prefix, else the first by name."""
    if name in fonts:
        return name, fonts[name]
    bare = name.split("+", 1)[1] if name and "+" in name else None
    if bare in fonts:
        return bare, fonts[bare]
    first = min(fonts) if fonts else "Helvetica"
    return first, fonts.get(first) or Font()
