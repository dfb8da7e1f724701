"""The coder of operator 7: adaptive context mixing and range coding of token ids, many blocks in step.

A segment holds the ids of whole documents in blocks of BLOCK ids (the last is
shorter). Every block is coded on its own: its model starts afresh and its code
has a CRC-32 of its ids. Ids are predicted by orders 2, 1 and 0:

- order 2: the id that followed the last occurrence of the last two ids,
- order 1: the id that followed the last occurrence of the last id,
- order 0: the id most frequent in the block so far; then how long ago the id last
  occurred, as a power of two and a rest,
- else the id itself, evenly among all.

Which of the five it is gets coded with a mix of two adaptive distributions, one
by what orders 2 and 1 propose and whether they agree, one by what the last id was
coded as. The mix has a weight of its own in every block, which moves towards the
distribution that has coded the block's last ids in fewer bits. Counts, weights and
quantised frequencies are renewed after runs of up to RUN ids; within a run coding
is shifts and products. The range coder keeps 56 bits and writes 16 at a time;
carries are settled at the end. All arithmetic is in integers, so a segment reads
the same everywhere. Blocks are independent, so numpy codes LANES of them in step.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

BLOCK, LANES, RUN = 4096, 2048, 64
MAGIC = b"QTK2"
_U = np.uint64
_TOP, _MASK = _U(1 << 40), _U((1 << 40) - 1)
_12, _16, _40 = _U(12), _U(16), _U(40)
#: Stands for no id; vocabularies are smaller.
_NONE = 65_535
_IDS, _PAIRS = 10, 11
_SLOT = (np.arange(65_536, dtype=np.int64) * 0x9E3779B1 >> 9) & ((1 << _IDS) - 1)
_MODES, _CONTEXTS, _POWERS = 5, 4, 13
_TOTAL = 1 << 12
_LOG2 = np.floor(np.log2(np.maximum(np.arange(BLOCK + 1), 1))).astype(np.int64)
#: Bits of a frequency, in 1/64.
_BITS = np.array([round(64 * math.log2(max(f, 1))) for f in range(_TOTAL + 1)], np.int64)


class CorruptBlock(ValueError):
    """A block whose ids don't match its checksum, or a segment of another format."""


def _shares(counts: np.ndarray) -> np.ndarray:
    """Counts as shares of _TOTAL along the last axis."""
    return (counts << 12) // counts.sum(axis=-1, keepdims=True)


def _bounds(shares: np.ndarray) -> np.ndarray:
    """Rising bounds from 0 to _TOTAL along the first axis, for shares along the last; each has one at least."""
    n = shares.shape[-1]
    out = np.zeros((n + 1, *shares.shape[:-1]), np.int32)
    for k in range(n - 1):
        out[k + 1] = out[k] + 1 + (shares[..., k] * (_TOTAL - 2 * n) >> 12)
    out[n] = _TOTAL
    return out


class _Model:
    """Predictions and mixed frequencies of every lane; a step is a few operations over whole arrays of the lanes that go on."""

    def __init__(self, lanes: int):
        self.lanes, self.rows = lanes, np.arange(lanes)
        self.ids, self.pairs = self.rows << _IDS, self.rows << _PAIRS
        # An id's or a pair's tag, and what followed it; an id, its count and its last place.
        self.after = np.full(lanes << _IDS, 0xFFFFFFFF, np.uint32)
        self.after_pair = np.full(lanes << _PAIRS, 0xFFFFFFFF, np.uint32)
        self.seen = np.full(lanes << _IDS, _NONE << 32, np.int64)
        self.last, self.before = np.full(lanes, _NONE, np.int64), np.full(lanes, _NONE, np.int64)
        self.top, self.top_count = np.full(lanes, _NONE, np.int64), np.zeros(lanes, np.int64)
        self.coded = np.full(lanes, _MODES - 1, np.int64)
        self.by_context = np.full((lanes, _CONTEXTS, _MODES), 8, np.int64)
        self.by_coded = np.full((lanes, _MODES, _MODES), 8, np.int64)
        self.by_power = np.full((lanes, _POWERS), 8, np.int64)
        self.weight = np.full(lanes, 128, np.int64)
        self.said: list[np.ndarray] = []
        self.powers_said: list[np.ndarray] = []
        self._renew()

    def _renew(self) -> None:
        self.context_shares, self.coded_shares = _shares(self.by_context), _shares(self.by_coded)
        w = self.weight[:, None, None, None]
        mixed = (w * self.context_shares[:, :, None, :] + (256 - w) * self.coded_shares[:, None, :, :]) >> 8
        self.modes = _bounds(mixed).reshape(_MODES + 1, -1)
        self.powers = _bounds(_shares(self.by_power))

    def propose(self, n: int) -> None:
        """Sets c2, c1, c0, what orders 2, 1 and 0 predict for the next id of the first n lanes, and ``at``, the place of its mode's bounds."""
        a, b = self.last[:n], self.before[:n]
        self.slot = self.ids[:n] + _SLOT.take(a)
        e = self.after.take(self.slot).astype(np.int64)
        self.c1 = c1 = np.where(e >> 16 == a, e & 0xFFFF, _NONE)
        u = (b * 0x9E3779B1 + a * 0x85EBCA6B) & 0xFFFFFFFF
        self.pair, self.tag = self.pairs[:n] + (u >> 32 - _PAIRS), (u >> 4) & 0xFFFF
        e = self.after_pair.take(self.pair).astype(np.int64)
        self.c2 = c2 = np.where(e >> 16 == self.tag, e & 0xFFFF, _NONE)
        self.c0 = self.top[:n]
        context = np.where(c2 == _NONE, c1 != _NONE, 3 - (c2 == c1))
        self.at = (self.rows[:n] * _CONTEXTS + context) * _MODES + self.coded[:n]

    def count(self, t: int, x: np.ndarray) -> np.ndarray:
        """Counts ids x at step t; gives the steps back to their last occurrence, 0: none that the slots know."""
        n = len(x)
        slot = self.ids[:n] + _SLOT.take(x)
        e = self.seen.take(slot)
        known = e >> 32 == x
        count = np.where(known, (e >> 16) & 0xFFFF, 0) + 1
        self.seen[slot] = (x << 32) | (count << 16) | t
        more = count >= self.top_count[:n]
        self.top = np.concatenate([np.where(more, x, self.top[:n]), self.top[n:]]) if n < self.lanes else np.where(more, x, self.top)
        np.maximum(self.top_count[:n], count, out=self.top_count[:n])
        return np.where(known, t - (e & 0xFFFF), 0)

    def learn(self, t: int, x: np.ndarray, mode: np.ndarray) -> None:
        n = len(x)
        self.after[self.slot] = (self.last[:n] << 16) | x
        self.after_pair[self.pair] = (self.tag << 16) | x
        self.before[:n] = self.last[:n]
        self.last[:n] = x
        self.coded[:n] = mode
        self.said.append(self.at * _MODES + mode)
        if t in (15, 31) or t % RUN == RUN - 1:
            self._adapt()

    def _adapt(self) -> None:
        joint = np.bincount(np.concatenate(self.said), minlength=self.lanes * _CONTEXTS * _MODES * _MODES).reshape(self.lanes, _CONTEXTS, _MODES, _MODES)
        contexts, coded = joint.sum(axis=2), joint.sum(axis=1)
        gain = (contexts * _BITS.take(self.context_shares)).sum(axis=(1, 2)) - (coded * _BITS.take(self.coded_shares)).sum(axis=(1, 2))
        self.weight = np.clip(self.weight + np.clip(gain >> 5, -32, 32), 16, 240)
        self.by_context += 24 * contexts - (self.by_context >> 2)
        self.by_coded += 24 * coded - (self.by_coded >> 2)
        if self.powers_said:
            self.by_power += 24 * np.bincount(np.concatenate(self.powers_said), minlength=self.lanes * _POWERS).reshape(self.lanes, _POWERS)
            self.by_power -= self.by_power >> 2
        for f in (self.by_context, self.by_coded, self.by_power):
            np.maximum(f, 3, out=f)
        self.said, self.powers_said = [], []
        self._renew()


def _encode_lanes(ids: np.ndarray, lengths: np.ndarray, vocabulary: int) -> list[bytes]:
    """ids: (lanes, steps), lanes in falling order of length; what follows a lane's length is ignored."""
    lanes, steps = ids.shape
    columns = np.ascontiguousarray(ids.T)
    model, words = _Model(lanes), steps // 2 + 4 * RUN
    low_all, range_all = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 56, np.uint64)
    out, used = np.zeros((lanes, words), np.uint32), np.zeros(lanes, np.int64)
    live = np.searchsorted(-lengths, -np.arange(steps), side="left")  # lanes longer than t
    for t in range(steps):
        n = int(live[t])
        x, low, span = columns[t, :n].astype(np.int64), low_all[:n], range_all[:n]
        model.propose(n)
        c0 = model.c0
        back = model.count(t, x)
        mode = np.where(x == model.c2, 0, np.where(x == model.c1, 1, np.where(x == c0, 2, 4 - (back > 0))))
        flat, k = model.modes.reshape(-1), mode * model.modes.shape[1] + model.at
        first = flat.take(k)
        r = span >> _12
        low += r * first.astype(np.uint64)
        r *= (flat.take(k + model.modes.shape[1]) - first).astype(np.uint64)
        recent = mode == 3
        power = _LOG2.take(back)
        k = power * lanes + model.rows[:n]
        flat = model.powers.reshape(-1)
        first = np.where(recent, flat.take(k), 0)
        freq = np.where(recent, flat.take(k + lanes) - first, _TOTAL)
        r >>= _12
        low += r * first.astype(np.uint64)
        r *= freq.astype(np.uint64)
        any_ = mode == 4
        r >>= np.where(recent, power, np.where(any_, 16, 0)).astype(np.uint64)
        low += r * np.where(recent, back - (1 << power), np.where(any_, x, 0)).astype(np.uint64)
        span[:] = r
        while len(small := np.flatnonzero(span < _TOP)):
            v, place = low[small], used[small]
            out[small, place] = v >> _40  # up to 17 bits: the carry is settled at the end
            used[small] = place + 1
            low[small] = (v & _MASK) << _16
            span[small] <<= _16
        if len(s := np.flatnonzero(recent)):
            model.powers_said.append(s * _POWERS + power[s])
        model.learn(t, x, mode)
        if t % RUN == RUN - 1 and int(used.max()) + 3 * RUN + 8 > words:
            words += words // 2
            out = np.pad(out, ((0, 0), (0, words - out.shape[1])))
    rows = np.arange(lanes)
    for _ in range(4):
        out[rows, used] = low_all >> _40
        used += 1
        low_all = (low_all & _MASK) << _16
    carry = np.zeros(lanes, np.uint32)
    for j in range(int(used.max()) - 1, -1, -1):
        v = out[:, j] + carry
        carry = np.where(j < used, v >> 16, 0).astype(np.uint32)
        out[:, j] = v & 0xFFFF
    return [out[i, : used[i]].astype(">u2").tobytes() for i in range(lanes)]


def _decode_lanes(blobs: list[bytes], lengths: np.ndarray, vocabulary: int) -> np.ndarray:
    lanes, steps = len(blobs), int(lengths.max())
    width = max((len(b) for b in blobs), default=0) // 2 + 8
    data, code_all = np.zeros((lanes, width), np.uint16), np.zeros(lanes, np.uint64)
    for i, b in enumerate(blobs):
        code_all[i] = int.from_bytes(b[:7].ljust(7, b"\0"), "big")
        rest = np.frombuffer(b[7:] + b"\0" * ((len(b) - 7) % 2), ">u2") if len(b) > 7 else ()
        data[i, : len(rest)] = rest
    range_all, read = np.full(lanes, 1 << 56, np.uint64), np.zeros(lanes, np.int64)
    model = _Model(lanes)
    past = np.zeros((steps, lanes), np.uint16)
    live = np.searchsorted(-lengths, -np.arange(steps), side="left")
    one = _U(1)
    for t in range(steps):
        n = int(live[t])
        code, span = code_all[:n], range_all[:n]
        model.propose(n)
        width_ = model.modes.shape[1]
        flat, at = model.modes.reshape(-1), model.at
        r = span >> _12
        where = np.minimum(code // r, _U(_TOTAL - 1)).astype(np.int32)
        mode = (where >= flat.take(at + width_)).astype(np.int64)
        for m in range(2, _MODES):
            mode += where >= flat.take(at + m * width_)
        k = mode * width_ + at
        first = flat.take(k)
        code -= r * first.astype(np.uint64)
        r *= (flat.take(k + width_) - first).astype(np.uint64)
        r >>= _12
        bits = np.where(mode == 4, _16, _U(0))
        s = np.flatnonzero(mode == 3)
        freq = np.full(n, _TOTAL, np.uint64)
        if len(s):
            own, bounds = r[s], model.powers[:, s]
            place = np.minimum(code[s] // own, _U(_TOTAL - 1)).astype(np.int32)
            power = (place >= bounds[1:]).sum(axis=0)
            cell = power * len(s) + np.arange(len(s))
            lo = bounds.reshape(-1).take(cell)
            code[s] -= own * lo.astype(np.uint64)
            freq[s] = bounds.reshape(-1).take(cell + len(s)) - lo
            bits[s] = power
            model.powers_said.append(s * _POWERS + power)
        r *= freq
        r >>= bits
        rest = np.minimum(code // r, (one << bits) - one)
        code -= r * rest
        span[:] = r
        x = np.where(mode == 0, model.c2, np.where(mode == 1, model.c1, np.where(mode == 2, model.c0, rest.astype(np.int64))))
        if len(s):
            # A corrupt code may point before the block; the checksum tells.
            x[s] = past.reshape(-1).take(np.maximum(t - (1 << power) - x[s], 0) * lanes + s)
        past[t, :n] = x
        model.count(t, x)
        while len(small := np.flatnonzero(span < _TOP)):
            place = read[small]
            code[small] = (code[small] << _16) | data[small, np.minimum(place, width - 1)]
            read[small] = place + 1
            span[small] <<= _16
        model.learn(t, x, mode)
    return past.T


def encode(ids: np.ndarray, counts: np.ndarray, doc_ids: list[int | None], vocabulary: int) -> bytes:
    """One segment: the ids of documents one after another, ``counts`` of each; ids are below 65535."""
    if vocabulary > _NONE:
        raise ValueError("a vocabulary of 65535 ids at most")
    lengths = np.full(-(-len(ids) // BLOCK), BLOCK, np.int64)
    if len(lengths):
        lengths[-1] = len(ids) - BLOCK * (len(lengths) - 1)
    blocks: list[bytes] = []
    for lo in range(0, len(lengths), LANES):
        own = lengths[lo : lo + LANES]
        some = np.zeros((len(own), int(own.max())), np.uint16)
        flat = ids[lo * BLOCK : lo * BLOCK + int(own.sum())]
        some.ravel()[: len(flat)] = flat  # only the last lane may be short
        blocks += _encode_lanes(some, own, vocabulary)
    sums = [zlib.crc32(ids[i * BLOCK : i * BLOCK + BLOCK].astype("<u4").tobytes()) for i in range(len(lengths))]
    table = struct.pack("<4sIII", MAGIC, vocabulary, len(doc_ids), len(blocks))
    docs = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes() + counts.astype("<u8").tobytes()
    index = np.array([len(b) for b in blocks], "<u4").tobytes() + lengths.astype("<u4").tobytes() + np.array(sums, "<u4").tobytes()
    head = zlib.compress(docs + index, 6)
    return table + struct.pack("<II", len(head), zlib.crc32(head)) + head + b"".join(blocks)


def decode(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """(ids, counts, doc ids) of a segment; raises CorruptBlock."""
    if blob[:4] != MAGIC:
        raise CorruptBlock("not a token segment")
    _, vocabulary, n, k = struct.unpack_from("<4sIII", blob)
    size, crc = struct.unpack_from("<II", blob, 16)
    head = blob[24 : 24 + size]
    if zlib.crc32(head) != crc:
        raise CorruptBlock("the directory")
    head = zlib.decompress(head)
    raw, null, counts = np.frombuffer(head, "<i8", n), np.frombuffer(head, "u1", n, 8 * n), np.frombuffer(head, "<u8", n, 9 * n).astype(np.int64)
    sizes, lengths, sums = (np.frombuffer(head, "<u4", k, 17 * n + 4 * k * i).astype(np.int64) for i in range(3))
    at = 24 + size + np.concatenate([[0], np.cumsum(sizes)])
    ids = np.zeros(int(lengths.sum()), np.uint32)
    to = np.concatenate([[0], np.cumsum(lengths)])
    for lo in range(0, k, LANES):
        hi = min(lo + LANES, k)
        some = _decode_lanes([blob[at[i] : at[i + 1]] for i in range(lo, hi)], lengths[lo:hi], vocabulary)
        for i in range(lo, hi):
            own = ids[to[i] : to[i + 1]]
            own[:] = some[i - lo, : lengths[i]]
            if zlib.crc32(own.astype("<u4").tobytes()) != sums[i]:
                raise CorruptBlock(f"block {i}")
    return ids, counts, [None if z else int(d) for d, z in zip(raw, null)]
