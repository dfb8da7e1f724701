"""Operator 4: exact n-gram Jaccard self-join, size-aware heavy-light.

A document is the set of its distinct 3-word shingles; two documents link when
100 * intersection >= 70 * union. Documents of the same set are one class (its
hash is the class id ``cid``), so copies never meet as pairs.

Light sets (at most ``x`` shingles, x chosen by cost from the size histogram)
are joined by enumerating the subsets of a fixed size that a link must share.
Heavy sets are joined by scanning inverted lists: with every set in the same
order, rarest shingle first, a link shares k shingles among the first
n - ceil(.7 n) + k of the larger and the first n - ceil(1.4 n / 1.7) + k of the
smaller set; k is a twelfth of the smaller set. The order comes from a count
sketch of fixed size (SKETCH cells) over all documents; a collision costs time,
never a link. A shingle whose cell exceeds the mean cell by HOT, or by four
times the mean where that is more, has its list split into pairs of blocks, so
no list lies in one task; at any size of the input few cells do.

Classes of near copies share most of their lists, so that a family of f classes
would meet as f * f pairs in each of them. Therefore classes of equal least and
greatest shingle hash, under one of LEVELS orders of the hashes, are one unit
where they are many (GROUP) and alike by the next order, too (DENSE); any other
class is a unit of its own. Lists hold each unit once, with the least and greatest
of its members' bounds, and candidates are pairs of units: a unit shares what its
members share, so none is lost, whatever the units are.

Candidates are verified exactly, class by class, and so are all pairs within a
unit. They are routed by the smallest unit they meet, so a family's sets are
fetched once, not once a pair; families and units are cut into blocks of BLOCK
shingles. Verification gives, per class, the number of linked documents and one
edge to a local root; components come from the edges by alternating star
contractions, with checkpoints between rounds.

Defined cases: a null text counts as empty; a document without words has no
shingle, no link and itself as component; with fewer words than a shingle the
whole sequence is the one shingle; repeated rows are documents of their own and
link; a null doc_id is counted but never names a component of others; an empty
table gives an empty result. A very long text is read whole, alone in its slice;
its set travels as one value, so it has to stay under 2 GB (250 million
shingles). ``jaccard_join`` reads doc_id and text alone, so other columns may
have any name; ``keep_first`` returns all columns as they are. Sets and shingles
are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Saver, saver
from .sketch import sum_parts, to_parts
from .words import mix, raw, shingles, trim, words

PERCENT, SHINGLE = 70, 3
SKETCH = 1 << 22
HOT = 20_000
#: Rows of sorted signatures, and pairs found in them, that a worker holds at once; classes it remembers.
WINDOW, FOUND, SEEN = 250_000, 400_000, 250_000
BLOCK = 500_000
#: Signature rows of a task: the fewer tasks a pair's shingles spread over, the fewer rows count them, and the more memory a sort takes.
TASK_ROWS = 1_500_000
MAX_LIGHT = 8
#: Classes that share a unit: at least GROUP; two of them agree in the next order with this probability, .25 at a Jaccard of .5.
GROUP, DENSE = 16, 0.25
#: Odd factors of the hashes, one per order; the largest units, of which every worker holds the ids: 2 MB.
LEVELS = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)
MAX_UNITS = 250_000
#: Bits of the filter that keeps sets without candidates from being fetched: at most 4 MB, whatever the input.
MAX_FILTER_BITS = 1 << 25


def least_overlap(n: int, m: int) -> int:
    """The fewest common shingles of a link between sets of n and m."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def shared_needed(n):
    """k: how many shingles of its prefix a link of a smaller set of n must share; prefixes are longer by k - 1."""
    return np.maximum(1, n // 12)


def _class_ids(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sizes = np.diff(bounds)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return mix((sums[bounds[1:]] - sums[bounds[:-1]]) + sizes.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, first row, shingle hashes, bounds, class ids) slice by slice."""
    for b in batches:
        for w in words(b.column("text")):
            h, bounds = shingles(w, SHINGLE)
            yield b, w.lo, h, bounds, _class_ids(h, bounds)


def _alike(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per set and order, the id of the unit it may be in; 0 for small sets."""
    size = np.diff(bounds)
    out = np.zeros((len(size), len(LEVELS)), np.int64)
    use = size > 0
    if use.any():
        at = bounds[:-1][use]
        for i, factor in enumerate(LEVELS):
            x = h * factor
            ends = mix(np.minimum.reduceat(x, at)) + np.maximum.reduceat(x, at) * np.uint64(3) + np.uint64(i)
            out[use, i] = np.where(size[use] > MAX_LIGHT, mix(ends), np.uint64(0)).view(np.int64)
    return out


def _unit(alike: np.ndarray, cid: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The first of its ids that is in ``groups`` (sorted); else the class itself."""
    unit, own = cid.copy(), np.ones(len(cid), bool)
    if len(groups):
        for level in alike.T:
            hit = own & (groups[np.minimum(np.searchsorted(groups, level), len(groups) - 1)] == level)
            unit[hit] = level[hit]
            own &= ~hit
    return unit


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document (doc_id, cid, n, ids of units), and per task its part of the sketch."""
    sketch = np.zeros(SKETCH, np.uint32)
    for b, lo, h, bounds, cid in _sets(batches):
        np.add.at(sketch, (h & np.uint64(SKETCH - 1)).astype(np.int64), np.uint32(1))
        k, alike = len(cid), _alike(h, bounds)
        yield pa.record_batch(
            {"doc_id": b.column("doc_id").slice(lo, k).cast(pa.int64()), "cid": pa.array(cid), "n": pa.array(np.diff(bounds).astype(np.int32))}
            | {f"u{i}": pa.array(np.ascontiguousarray(u)) for i, u in enumerate(alike.T)}
            | {"chunk": pa.nulls(k, pa.int32()), "part": pa.nulls(k, pa.binary())}
        )
    blobs = to_parts(sketch)
    k = len(blobs)
    yield pa.record_batch(
        {"doc_id": pa.nulls(k, pa.int64()), "cid": pa.nulls(k, pa.int64()), "n": pa.nulls(k, pa.int32())}
        | {f"u{i}": pa.nulls(k, pa.int64()) for i in range(len(LEVELS))}
        | {"chunk": pa.array(range(k), pa.int32()), "part": pa.array(blobs, pa.binary())}
    )


def light_boundary(histogram: dict[int, int], mean_list: float) -> int:
    """The largest size whose subsets cost less than scanning its lists: per set, the subsets against list entries met."""
    x = 0
    for n in range(1, MAX_LIGHT + 1):
        subsets = sum(math.comb(n, -(-PERCENT * m // 100)) for m in range(n, min(n * 100 // PERCENT, MAX_LIGHT) + 1))
        prefix = n - -(-PERCENT * n // 100) + 1
        if histogram.get(n, 0) and subsets > prefix * (2 + mean_list):
            break
        x = n
    return x


def _signatures(sketch: np.ndarray, x: int, groups: np.ndarray) -> Callable:
    """Signature rows: key, unit, and side, n, pos (-1: a subset) in one number."""
    block = int(max(HOT, 4 * sketch.mean()))
    floor = int(sketch.mean())

    def of(h: np.ndarray, unit: int) -> list[tuple]:
        n, out = len(h), []
        load = sketch[(h & np.uint64(SKETCH - 1)).astype(np.int64)]
        if n <= x:
            for m in range(n, min(n * 100 // PERCENT, x) + 1):
                # A link between sizes n <= m shares ceil(.7 m) shingles; the larger set has the subsets of that size, too.
                c = -(-PERCENT * m // 100)
                for some in combinations(h, c):
                    out.append((int(mix(np.array([sum(int(v) for v in some) + c & (1 << 64) - 1], np.uint64))[0]), -1, n, -1))
        if n * 100 >= PERCENT * (x + 1):
            order = np.lexsort((h, load))[: n - -(-PERCENT * n // 100) + int(shared_needed(n))]
            for pos, k in enumerate(order):
                key = int(h[k])
                if load[k] > floor + block:
                    blocks = (int(load[k]) - floor) // block + 1
                    own = int(unit) % blocks
                    for other in range(blocks):
                        a, b = min(own, other), max(own, other)
                        out.append((int(mix(np.array([key + a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1], np.uint64))[0]), -1 if a == b else int(own == b), n, pos))
                else:
                    out.append((key, -1, n, pos))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, _, h, bounds, cids in _sets(batches):
            size, units = np.diff(bounds), _unit(_alike(h, bounds), cids, groups)
            first = np.zeros(len(cids), bool)
            for i, c in enumerate(cids):
                if size[i] and c not in seen:
                    first[i] = True
                    seen.add(c)
            if len(seen) > SEEN:
                seen.clear()
            load = sketch[(h & np.uint64(SKETCH - 1)).astype(np.int64)]
            doc = np.repeat(np.arange(len(cids)), size)
            is_hot = np.zeros(len(cids), bool)
            is_hot[doc[load > floor + block]] = True
            plain = first & ~is_hot & (size > MAX_LIGHT)
            # Most documents: no hot shingle, no small set. One sort by (document, load, hash) for all.
            use = plain[doc]
            d, l, v = doc[use], load[use], h[use]
            order = np.lexsort((v, l, d))
            d, v = d[order], v[order]
            counts = np.where(plain, size, 0)
            pos = np.arange(len(d)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
            n = size[d]
            keep = pos < n - -(-PERCENT * n // 100) + shared_needed(n)
            d, v, pos, n = d[keep], v[keep], pos[keep], n[keep]
            yield _rows(v.view(np.int64), np.full(len(v), -1, np.int8), units[d], n, pos)
            for i in np.flatnonzero(first & ~plain):
                if rows := of(h[bounds[i] : bounds[i + 1]], units[i]):
                    k, s, m, p = zip(*rows)
                    yield _rows(np.array(k, np.uint64).view(np.int64), np.array(s, np.int8), np.full(len(k), units[i]), np.array(m), np.array(p))

    return run


def _rows(key, side, unit, n, pos) -> pa.RecordBatch:
    # side, n and pos in one number: fewer bytes to shuffle.
    packed = (n.astype(np.int64) << 32) | ((pos.astype(np.int64) + 1) << 2) | (side.astype(np.int64) + 1)
    return pa.record_batch({"key": pa.array(key), "unit": pa.array(unit), "at": pa.array(packed)})


def _counted(p: np.ndarray) -> np.ndarray:
    """Columns (a, b, n, count), one per pair with its least n and the sum of its counts."""
    order = np.lexsort((p[1], p[0]))
    p = p[:, order]
    at = np.flatnonzero(np.r_[True, (p[0, 1:] != p[0, :-1]) | (p[1, 1:] != p[1, :-1])])
    out = p[:, at]
    out[2] = np.minimum.reduceat(p[2], at)
    out[3] = np.add.reduceat(p[3], at)
    return out


def _pairs(x: int) -> Callable:
    """Pairs (a, b, n, shared) of units, the smaller id first, from rows sorted by key; n is the least size that shared."""

    def made(p: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"a": pa.array(p[0]), "b": pa.array(p[1]), "n": pa.array(p[2].astype(np.int32)), "shared": pa.array(p[3].astype(np.int32))})

    def among(key, unit, at) -> Iterator[pa.RecordBatch]:
        new = np.r_[True, key[1:] != key[:-1]]
        several = ~(new & np.r_[new[1:], True])  # most keys have one row
        key, unit, at = key[several], unit[several], at[several]
        if not len(key):
            return
        # One row per key and unit: of its classes, and of copies read by several tasks.
        order = np.lexsort((at, unit, key))
        key, unit, at = key[order], unit[order], at[order]
        n, pos, side = at >> 32, ((at >> 2) & ((1 << 30) - 1)) - 1, (at & 3) - 1
        once = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])])
        # The smallest and the largest set, the most that may be left to share, whether one is in a smaller set's prefix.
        high = n[np.r_[once[1:], len(n)] - 1]
        left_over = np.maximum.reduceat(n - pos, once)
        index = n - -(-2 * PERCENT * n // (100 + PERCENT)) + shared_needed(n)
        early = np.logical_or.reduceat((pos < index) | (pos < 0), once)
        key, unit, n, pos, side = key[once], unit[once], n[once], pos[once], side[once]
        order = np.lexsort((unit, n, key))
        key, unit, n, pos, side, high, left_over, early = (v[order] for v in (key, unit, n, pos, side, high, left_over, early))
        last = np.flatnonzero(np.r_[key[1:] != key[:-1], True])
        left = np.repeat(last, np.diff(np.r_[-1, last])) - np.arange(len(key))  # rows of the key after this one
        live, found, step = np.flatnonzero((left > 0) & (early | (high > n))), [], 1
        waiting = 0
        while len(live):
            a, b = live, live + step
            near = high[a] * 100 >= PERCENT * n[b]
            live, a, b = live[near], a[near], b[near]  # later rows of the key are larger still
            need = -(-PERCENT * (n[a] + n[b]) // (100 + PERCENT))
            most = np.minimum(left_over[a], left_over[b]) > need - shared_needed(np.minimum(high[a], high[b]))
            ok = (early[a] | (early[b] & (high[a] > n[b]))) & ((side[a] < 0) | (side[a] != side[b]))
            ok &= np.where(pos[a] < 0, pos[b] < 0, (pos[b] >= 0) & (np.maximum(high[a], high[b]) > x) & most)
            if ok.any():
                a, b = a[ok], b[ok]
                found.append(np.stack([np.minimum(unit[a], unit[b]), np.maximum(unit[a], unit[b]), n[a], np.ones(len(a), np.int64)]))
                waiting += len(a)
                if waiting > FOUND:
                    found = [_counted(np.concatenate(found, 1))]
                    waiting = found[0].shape[1]
                    if waiting > FOUND // 2:  # the sum of a pair's counts is taken after the shuffle
                        yield made(found[0])
                        found, waiting = [], 0
            step += 1
            live = live[left[live] >= step]
        if found:
            yield made(_counted(np.concatenate(found, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        held: list[list[np.ndarray]] = []
        for b in batches:
            held.append([b.column(i).to_numpy() for i in range(3)])
            if sum(len(p[0]) for p in held) < WINDOW:
                continue
            rows = [np.concatenate([r, *(p[i] for p in held)]) for i, r in enumerate(rest)]
            held = []
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last key may go on
            rest = [r[cut:] for r in rows]
            if cut:
                yield from among(*[r[:cut] for r in rows])
        rows = [np.concatenate([r, *(p[i] for p in held)]) for i, r in enumerate(rest)]
        if len(rows[0]):
            yield from among(*rows)
        trim()

    return run


def _wanted_sets(bits: np.ndarray) -> Callable:
    mask = np.uint64(len(bits) * 8 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, _, h, bounds, cids in _sets(batches):
            place = cids.view(np.uint64) & mask
            hit = (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
            use = [i for i in np.flatnonzero(hit) if bounds[i + 1] > bounds[i] and cids[i] not in seen and not seen.add(cids[i])]
            if len(seen) > SEEN:
                seen.clear()
            yield pa.record_batch({"cid": pa.array(cids[use]), "s": pa.array([h[bounds[i] : bounds[i + 1]].tobytes() for i in use], pa.binary())})

    return run


def _filter_bits(cids: DataFrame, rows: int) -> np.ndarray:
    """A bitmap over class ids, of a size that follows ``rows`` up to MAX_FILTER_BITS."""
    n = min(MAX_FILTER_BITS, max(1 << 16, 1 << (16 * max(rows, 1) - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n // 8, np.uint8)
        for b in batches:
            place = b.column(0).to_numpy().view(np.uint64) & np.uint64(n - 1)
            np.bitwise_or.at(bits, (place >> np.uint64(3)).astype(np.int64), (1 << (place & np.uint64(7))).astype(np.uint8))
        yield pa.record_batch({"bits": pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())})

    total = np.zeros(n // 8, np.uint8)
    for r in cids.coalesce(16).mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return total


def _verify(keys: tuple, pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """Per class of a bucket: the documents linked in it, and the root of its local component."""

    def made(cid, n_linked, root) -> pa.Table:
        return pa.table({"cid": pa.array(cid, pa.int64()), "n_linked": pa.array(n_linked, pa.int64()), "root": pa.array(root, pa.int64())})

    if not pairs.num_rows or not sets.num_rows:
        return made([], [], [])
    once = np.unique(sets["cid"].to_numpy(), return_index=True)[1]  # copies read by several tasks
    unit, part = sets["unit"].to_numpy()[once], sets["part"].to_numpy()[once]
    order = np.lexsort((part, unit))
    once, unit, part = once[order], unit[order], part[order]
    cid, copies, column = sets["cid"].to_numpy()[once], sets["copies"].to_numpy()[once], sets["s"].combine_chunks().take(pa.array(once))
    cuts = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (part[1:] != part[:-1]), True])
    rows = {(int(unit[lo]), int(part[lo])): (int(lo), int(hi)) for lo, hi in zip(cuts[:-1], cuts[1:])}
    data, offsets = raw(column)
    size = np.diff(offsets) // 8
    start = np.concatenate([[0], np.cumsum(size)])
    code = np.unique(np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.uint64), return_inverse=True)[1].astype(np.int32)
    marked = np.zeros(int(code.max()) + 1, np.int32)
    meet: dict[tuple[int, int], set[tuple[int, int]]] = {}
    for a, b, i, j in zip(*(pairs[c].to_pylist() for c in ("a", "b", "pa", "pb"))):
        if (a, i) in rows and (b, j) in rows:
            meet.setdefault(rows[a, i], set()).add(rows[b, j])
    linked, parent = np.zeros(len(cid), np.int64), np.arange(len(cid))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    for (lo, hi), others in meet.items():
        for i in range(lo, hi):
            own = code[start[i] : start[i + 1]]
            marked[own] = 1
            for j, end in others:
                if j == lo:
                    j = i + 1  # of a block with itself, each pair once
                if j + 1 == end:
                    both = np.count_nonzero(marked[code[start[j] : start[end]]])
                elif j < end:
                    both = np.add.reduceat(marked[code[start[j] : start[end]]], start[j:end] - start[j])
                else:
                    continue
                use = j + np.flatnonzero(100 * both >= PERCENT * (size[i] + size[j:end] - both))
                if len(use):
                    linked[i] += copies[use].sum()
                    linked[use] += copies[i]
                    roots = {find(k) for k in np.unique(parent[use])} | {find(i)}
                    least = min(roots)
                    parent[list(roots)] = least
                    parent[use] = least
            marked[own] = 0
    use = np.flatnonzero(linked)
    out = made(cid[use], linked[use], cid[[find(i) for i in use]] if len(use) else [])
    trim()
    return out


def components(edges: DataFrame, save: Saver) -> DataFrame:
    """(v, label) of the nodes of undirected edges (u, v): alternating large and small stars until nothing changes."""
    e = save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        last, e = e, save(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        save.drop(last)
        now = tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
        if now == before:
            return e.select(F.col("u").alias("v"), F.col("v").alias("label")).unionByName(e.select("v", F.col("v").alias("label")).distinct())
        before = now


def _groups(classes: DataFrame, ids: list[str]) -> np.ndarray:
    """The ids of units, sorted: of many classes, of which enough pairs agree in the next order, too."""
    seen = classes.where(F.col("n") > MAX_LIGHT).select(F.explode(F.array(*[F.struct(F.col(u).alias("g"), F.col(v).alias("other")) for u, v in zip(ids, ids[1:] + ids[:1])])).alias("e"))
    count = seen.groupBy("e.g", "e.other").agg(F.count("*").cast("double").alias("c")).groupBy("g").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("agree"))
    found = count.where((F.col("m") >= GROUP) & (F.col("agree") >= DENSE * F.col("m") * F.col("m"))).orderBy(F.desc("m"), "g").limit(MAX_UNITS)
    return np.sort(np.array([r["g"] for r in found.select("g").collect()], np.int64))


def _with_unit(groups: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            alike = np.stack([b.column(f"u{i}").to_numpy() for i in range(len(LEVELS))], 1)
            unit = _unit(alike, b.column("cid").to_numpy(), groups)
            yield pa.record_batch({"cid": b.column("cid"), "unit": pa.array(unit), "copies": b.column("copies"), "first": b.column("first"), "n": b.column("n")})

    return run


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    save = saver(spark)
    ids = [f"u{i}" for i in range(len(LEVELS))]
    profile = save(docs.mapInArrow(_profile, f"doc_id bigint, cid bigint, n int, {', '.join(f'{u} bigint' for u in ids)}, chunk int, part binary"))
    own = profile.where("chunk is null").select("doc_id", "cid", "n", *ids)
    sketch = sum_parts(profile.where("chunk is not null").select("chunk", "part"), SKETCH)
    histogram = {r["n"]: r["count"] for r in own.where(F.col("n") <= MAX_LIGHT).groupBy("n").count().collect()}
    x = light_boundary(histogram, float(sketch.mean()))
    classes = save(own.where("n > 0").groupBy("cid").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.min("n").alias("n"), *[F.min(u).alias(u) for u in ids]))
    groups = _groups(classes, ids)
    units = save(classes.mapInArrow(_with_unit(groups), "cid bigint, unit bigint, copies bigint, first bigint, n int"))
    save.drop(classes)
    # A set has .3 n + n / 12 rows.
    rows = 0.4 * (own.agg(F.sum("n")).first()[0] or 0)
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))
    signatures = docs.mapInArrow(_signatures(sketch, x, groups), "key bigint, unit bigint, at bigint")
    sizes = units.groupBy("unit").agg(F.count("*").alias("members"), F.sum("n").alias("weight"))
    pairs = save(
        signatures.repartition(tasks, "key")
        .sortWithinPartitions("key")
        .mapInArrow(_pairs(x), "a bigint, b bigint, n int, shared int")
        .groupBy("a", "b")
        .agg(F.sum("shared").alias("shared"), F.min("n").alias("n"))
        .where(F.col("shared") >= F.greatest(F.lit(1), F.floor(F.col("n") / 12)))
        .select("a", "b")
        .unionByName(sizes.where("members > 1").select(F.col("unit").alias("a"), F.col("unit").alias("b")))
    )
    ends = pairs.select(F.explode(F.array("a", "b")).alias("unit"), F.least("a", "b").alias("m"))
    lead = save(ends.groupBy("unit").agg(F.min("m").alias("lead")).join(sizes, "unit").withColumn("parts", F.ceil(F.col("weight") / BLOCK)))
    n_wanted, weight = lead.agg(F.coalesce(F.sum("members"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    blocks = lead.groupBy("lead").agg(F.ceil(F.sum("weight") / BLOCK).alias("blocks"))
    homes = lead.join(blocks, "lead").select("unit", "parts", "lead", "blocks")
    buckets = max(1, math.ceil(2 * weight / BLOCK))
    at = lambda c: homes.select(F.col("unit").alias(c), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"p{c}"), F.struct("lead", F.pmod(F.pmod("unit", F.col("blocks")) + F.col(f"p{c}"), F.col("blocks")).alias("block")).alias(f"{c}_home"))
    routed = save(
        pairs.join(at("a"), "a")
        .join(at("b"), "b")
        .where("a <> b or pa <= pb")
        .select("a", "b", "pa", "pb", F.pmod(F.xxhash64(F.least("a_home", "b_home"), F.greatest("a_home", "b_home")), F.lit(buckets)).alias("bucket"))
    )
    needed = routed.select(F.col("bucket").alias("place"), F.explode(F.array(F.struct(F.col("a").alias("unit"), F.col("pa").alias("part")), F.struct(F.col("b").alias("unit"), F.col("pb").alias("part")))).alias("e")).select("place", "e.*").distinct()
    wanted = units.join(lead.select("unit", "parts"), "unit").select("cid", "unit", F.pmod("cid", F.col("parts")).alias("part"), "copies")
    bits = _filter_bits(wanted.select("cid"), n_wanted)
    sets = docs.mapInArrow(_wanted_sets(bits), "cid bigint, s binary")
    fetched = needed.join(wanted, ["unit", "part"]).join(sets, "cid")
    checked = save(
        routed.groupBy("bucket").cogroup(fetched.groupBy("place")).applyInArrow(_verify, "cid bigint, n_linked bigint, root bigint")
    )
    save.drop(pairs, lead, routed)
    label = components(checked.select(F.col("cid").alias("u"), F.col("root").alias("v")), save)
    named = units.join(label.withColumnRenamed("v", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    roots = named.groupBy("label").agg(F.min("first").alias("component"))
    links = checked.groupBy("cid").agg(F.sum("n_linked").alias("n_linked"))
    found = named.join(roots, "label").join(links, "cid", "left").select("cid", "component", (F.col("copies") - 1 + F.coalesce("n_linked", F.lit(0))).alias("n_similar"))
    return own.join(found, "cid", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"),
        F.coalesce("component", "doc_id").alias("component_id"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the smallest doc_id.

    Of repeated rows one stays; different texts of one doc_id that aren't in a
    component with a smaller one all stay, and so do rows without doc_id.
    """
    kept = jaccard_join(docs.select("doc_id", "text")).where(F.col("component_id") == F.col("doc_id")).select("doc_id").distinct()
    # The join places rows by doc_id, which serves the removal of repeats, too.
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id is null"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 70 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce((SELECT n FROM n WHERE n.doc_id = d.doc_id), 0) AS n_shingles, (SELECT count(*) FROM e WHERE e.a = d.doc_id) AS n_similar, least(doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), doc_id)) AS component_id FROM d
"""
