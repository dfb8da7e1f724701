"""Token ids of many texts with a public tokenizer, each distinct unit of a slice encoded once.

Byte-pair encoding never crosses a pre-token, and pre-tokens of both supported
files can be cut at ASCII white space, so a text's ids are the concatenated ids
of its units; distinct units (by a 64-bit hash of their bytes) are encoded by
the tokenizers library, kept in a bounded cache, and gathered with numpy. Texts
in which other Unicode white space or the string of a special token could move a
boundary are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

from . import words as W

#: Units kept by a worker, at about 40 bytes; a full cache starts again.
CACHE = 1_500_000
#: Units encoded in one call.
CALL = 20_000
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; it is never copied."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@dataclass
class Ids:
    """Ids of texts lo to hi - 1 of a batch; those of text i are ids[bounds[i - lo] : bounds[i - lo + 1]]."""

    lo: int
    hi: int
    ids: np.ndarray
    bounds: np.ndarray


def _odd_space(d: np.ndarray) -> np.ndarray:
    """Places of white space outside ASCII, in UTF-8 bytes."""
    p = np.flatnonzero(d >= 0xC2)
    p = p[p + 1 < len(d)]
    b0, b1 = d[p], d[p + 1]
    b2 = d[np.minimum(p + 2, len(d) - 1)]
    odd = (b0 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0)) | (b0 == 0xE1) & (b1 == 0x9A) & (b2 == 0x80) | (b0 == 0xE3) & (b1 == 0x80) & (b2 == 0x80)
    odd |= (b0 == 0xE2) & ((b1 == 0x80) & ((b2 <= 0x8A) | (b2 == 0xA8) | (b2 == 0xA9) | (b2 == 0xAF)) | (b1 == 0x81) & (b2 == 0x9F))
    return p[odd]


class Encoder:
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them; a special token's string in a text is that token."""

    def __init__(self, path: str, keeps_space: bool, end_id: int):
        """keeps_space: units carry one space before them and other white space is tokens, too."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keeps_space, self.end_id = keeps_space, end_id
        self._clear()

    def _clear(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes in order, and the slot of each
        self.at, self.len = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _specials(self, d: np.ndarray) -> np.ndarray:
        """Places of the first two bytes of special tokens' strings."""
        starts = {s[:2] for s in self.special if len(s) > 1}
        found = [p for s in starts for p in [np.flatnonzero((d[:-1] == s[0]) & (d[1:] == s[1]))] if len(p)]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def _units(self, d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(d)
        inside = ~W._SPACE[d]
        edge = np.zeros(n + 1, bool)
        edge[o] = True
        opens, closes = inside.copy(), inside.copy()
        if n:
            opens[1:] &= ~inside[:-1] | edge[1:-1]
            closes[:-1] &= ~inside[1:] | edge[1:-1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        if not self.keeps_space or not n:
            return start, end
        # A unit takes the space before it; what is left of a run of white space before text is its head and its last character.
        spaced = (start > 0) & (d[np.maximum(start - 1, 0)] == 32) & ~edge[start]
        unit = start - spaced
        gap_opens, gap_closes = ~inside, ~inside
        gap_opens = gap_opens.copy()
        gap_closes = gap_closes.copy()
        gap_opens[1:] &= inside[:-1] | edge[1:-1]
        gap_closes[:-1] &= inside[1:] | edge[1:-1]
        g0, g1 = np.flatnonzero(gap_opens), np.flatnonzero(gap_closes) + 1
        followed = ~edge[g1]  # by a word of the same text
        last_is_space = d[g1 - 1] == 32
        head_end = np.where(followed, g1 - 1, g1)
        lone = followed & ~last_is_space
        s = np.concatenate([unit, g0, g1[lone] - 1])
        e = np.concatenate([end, head_end, g1[lone]])
        s, e = s[s < e], e[s < e]
        order = np.argsort(s, kind="stable")
        return s[order], e[order]

    def __call__(self, column: pa.Array) -> Iterator[Ids]:
        data, offsets = W.raw(column)
        for lo, hi in W.slices(offsets):
            a = offsets[lo]
            d, o = data[a : offsets[hi]], offsets[lo : hi + 1] - a
            start, end = self._units(d, o)
            doc = np.searchsorted(o, start, side="right") - 1
            whole = np.zeros(hi - lo, bool)
            if len(odd := np.concatenate([_odd_space(d), self._specials(d)])):
                whole[np.searchsorted(o, odd, side="right") - 1] = True
                keep = ~whole[doc]
                start, end, doc = start[keep], end[keep], doc[keep]
            slots = self._slots(d, start, end)
            size = self.len[slots].astype(np.int64)
            extra: dict[int, list[int]] = {}
            if whole.any():
                rows = np.flatnonzero(whole)
                extra = dict(zip(rows.tolist(), self._batch([d[o[i] : o[i + 1]].tobytes().decode() for i in rows])))
            counts = np.bincount(doc, weights=size, minlength=hi - lo).astype(np.int64)
            for i, ids in extra.items():
                counts[i] = len(ids)
            bounds = np.concatenate([[0], np.cumsum(counts + 1)])
            out = np.full(bounds[-1], self.end_id, np.int32)
            # Where each unit's ids go: after those of its text's units before it.
            before = np.cumsum(size) - size
            first = np.searchsorted(doc, np.arange(hi - lo))
            base = before[np.minimum(first, max(len(before) - 1, 0))] if len(before) else np.zeros(hi - lo, np.int64)
            to = bounds[doc] + before - base[doc]
            total = int(size.sum())
            shift = np.repeat(self.at[slots] - before, size)
            place = np.arange(total)
            ids = self.flat[place + shift]
            out[place + np.repeat(to - before, size)] = ids
            for i, some in extra.items():
                out[bounds[i] : bounds[i] + len(some)] = some
            yield Ids(lo, hi, out, bounds)
        W.trim()

    def _slots(self, d: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(d)
        up, down = W._power(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(W._TABLE[d] * up[:n], out=sums[1:], dtype=np.uint64)
        h = W.mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        u, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self._clear()
        place = np.searchsorted(self.known, u)
        near = np.minimum(place, max(len(self.known) - 1, 0))
        hit = (self.known[near] == u) & (place < len(self.known)) if len(self.known) else np.zeros(len(u), bool)
        found = np.where(hit, self.slot[near], -1) if len(self.known) else np.full(len(u), -1, np.int32)
        if len(new := np.flatnonzero(~hit)):
            raw = d.tobytes()
            s, e = start[at[new]].tolist(), end[at[new]].tolist()
            lens, flat = [], []
            for lo in range(0, len(s), CALL):
                made = self._batch([raw[i:j].decode() for i, j in zip(s[lo : lo + CALL], e[lo : lo + CALL])])
                lens.append(np.fromiter(map(len, made), np.int32, len(made)))
                flat.append(np.fromiter((x for m in made for x in m), np.int32, int(lens[-1].sum())))
            lens = np.concatenate(lens)
            k = len(self.len)
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(lens, dtype=np.int64) - lens])
            self.flat = np.concatenate([self.flat, *flat])
            self.len = np.concatenate([self.len, lens])
            found[new] = slots = np.arange(k, k + len(new), dtype=np.int32)
            self.known = np.insert(self.known, place[new], u[new])
            self.slot = np.insert(self.slot, place[new], slots)
        return found[inverse]


@cache
def encoder(path: str, keeps_space: bool, end_id: int) -> Encoder:
    """One encoder a worker process, so tasks that follow each other share its cache; it goes when the worker begins other work."""
    return Encoder(path, keeps_space, end_id)


W.other_work.append(encoder.cache_clear)
