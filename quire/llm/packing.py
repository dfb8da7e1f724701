"""Operator 9: best-fit packing by a grouping genetic algorithm on islands.

Documents are tokenised whole; only those over CAPACITY tokens are cut, into
pieces of CAPACITY, and full pieces are sequences of their own. The others are
packed by islands of about ISLAND pieces, drawn by hash. An island's population
starts from best-fit decreasing, perturbed orders of it and its immigrants. A
crossover injects the well-filled bins of one parent whole into another, drops
the bins that hold a duplicate and best-fits the displaced pieces; a mutation
empties the worst and some random bins and best-fits their pieces.

Islands hold different pieces, but pieces of one length are interchangeable, so
an elite bin migrates as its lengths: after each of EPOCHS the best-filled bins of
an island's elite go to the next island on a ring, MIGRANTS at most, where an
immigrant individual takes every bin that its own pieces can fill and best-fits
the rest. The elite itself stays and starts the island's next epoch.

After the last epoch bins filled to the brim are settled. The pieces of the
others, a few an island, are drawn anew into fewer islands, which settle all.

Defined cases: a null or empty text is its end id alone; repeated rows are
packed each, spread over islands by a random draw beside the hash; a null doc_id
is carried through; very long documents become many full pieces and one rest; an
empty table gives an empty result; other columns are not read, whatever they are
called.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saver
from .tokens import WORD_BPE, encoder, tokenizer_path

CAPACITY, END_ID = 4096, 1
ISLAND, EPOCHS, MIGRANTS = 4000, 2, 400
POPULATION, GENERATIONS, MUTATED = 6, 6, 0.05
#: Free tokens with which a bin still counts as full before the last round.
BRIM = 2
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Pieces on islands: without nulls, which pandas would make fractions of the ids.
PLACED = f"{PIECES}, has_id boolean, row bigint, island bigint, bin bigint"
_MIGRANT = -2


def _cut(path: str, capacity: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, False, END_ID)
        for b in batches:
            for r in encode(b.column("text")):
                raw = memoryview(r.ids.astype("<u4")).cast("B")
                rows = []
                for i in range(r.hi - r.lo):
                    a, e = int(r.bounds[i]), int(r.bounds[i + 1])
                    for k, s in enumerate(range(a, e, capacity)):
                        t = min(s + capacity, e)
                        rows.append((i, k, s - a, t - s, zlib.crc32(raw[4 * s : 4 * t])))
                doc, piece, start, length, crc = map(np.array, zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
                yield pa.record_batch(
                    {
                        "doc_id": b.column("doc_id").slice(r.lo, r.hi - r.lo).take(pa.array(doc)).cast(pa.int64()),
                        "piece": pa.array(piece.astype(np.int32)),
                        "start": pa.array(start.astype(np.int64)),
                        "length": pa.array(length.astype(np.int64)),
                        "ids_crc32": pa.array(crc.astype(np.int64)),
                    }
                )

    return run


class Bins:
    """Bins under best fit: a bit set of the free room that occurs, and the bins of each room."""

    def __init__(self, capacity: int):
        self.capacity, self.bits, self.of, self.bins = capacity, 0, {}, []

    def put(self, item: int, length: int) -> None:
        rest = self.bits >> length
        if rest:
            room = length + (rest & -rest).bit_length() - 1
            some = self.of[room]
            b = some.pop()
            if not some:
                self.bits &= ~(1 << room)
        else:
            room, b = self.capacity, len(self.bins)
            self.bins.append([])
        self.bins[b].append(item)
        self._has(b, room - length)

    def add(self, items: list[int], room: int) -> None:
        self.bins.append(items)
        self._has(len(self.bins) - 1, room)

    def _has(self, b: int, room: int) -> None:
        if room:
            self.of.setdefault(room, []).append(b)
            self.bits |= 1 << room


def best_fit(order: list[int], lengths: list[int], capacity: int, start: Bins | None = None) -> list[list[int]]:
    bins = start or Bins(capacity)
    for i in order:
        bins.put(i, lengths[i])
    return bins.bins


def crossover(one: list[list[int]], other: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """``one`` with the well-filled bins of ``other``; what they displace is best-fitted."""
    fill = [sum(lengths[i] for i in b) for b in other]
    order = sorted(range(len(other)), key=lambda b: -fill[b])
    injected = [b for b in order[: len(order) // 2] if fill[b] >= capacity - BRIM]
    held = {i for b in injected for i in other[b]}
    bins, displaced = Bins(capacity), []
    for b in injected:
        bins.add(list(other[b]), capacity - fill[b])
    for b in one:
        if held.isdisjoint(b):
            bins.add(list(b), capacity - sum(lengths[i] for i in b))
        else:
            displaced += [i for i in b if i not in held]
    displaced.sort(key=lambda i: -lengths[i])
    return best_fit(displaced, lengths, capacity, bins)


def mutate(bins: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """The emptiest and some random bins are dissolved and their pieces best-fitted again."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: fill[b])
    gone = set(order[: max(1, int(MUTATED * len(bins)))]) | {b for b in range(len(bins)) if rng.random() < MUTATED}
    kept, loose = Bins(capacity), []
    for b in range(len(bins)):
        if b in gone:
            loose += bins[b]
        else:
            kept.add(list(bins[b]), capacity - fill[b])
    loose.sort(key=lambda i: -lengths[i] * rng.uniform(0.9, 1))
    return best_fit(loose, lengths, capacity, kept)


def immigrant(patterns: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """An individual of bins known by their lengths, as far as own pieces fill them; the rest is best-fitted."""
    of: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        of.setdefault(n, []).append(i)
    bins = Bins(capacity)
    for pattern in patterns:
        need: dict[int, int] = {}
        for n in pattern:
            need[n] = need.get(n, 0) + 1
        if all(len(of.get(n, ())) >= k for n, k in need.items()):
            bins.add([of[n].pop() for n in pattern], capacity - sum(pattern))
    left = sorted((i for some in of.values() for i in some), key=lambda i: -lengths[i])
    return best_fit(left, lengths, capacity, bins)


def evolve(lengths: list[int], capacity: int = CAPACITY, seed: int = 0, start: list[list[list[int]]] | None = None) -> list[list[int]]:
    """The fittest grouping found, from ``start`` (individuals) and own ones: fewest bins, then the most bins filled to the brim."""
    rng = random.Random(seed)
    down = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    least = -(-sum(lengths) // capacity)

    def fitness(bins: list[list[int]]) -> tuple[int, int]:
        return len(bins), -sum(sum(lengths[i] for i in b) >= capacity - BRIM for b in bins)

    def settled(bins: list[list[int]]) -> bool:
        return len(bins) == least and -fitness(bins)[1] >= len(bins) - 1

    population = [*(start or []), best_fit(down, lengths, capacity)]
    if any(settled(p) for p in population):
        return min(population, key=fitness)
    while len(population) < POPULATION:
        order = sorted(down, key=lambda i: -lengths[i] * rng.uniform(0.7, 1))
        population.append(best_fit(order, lengths, capacity))
    for _ in range(GENERATIONS):
        population.sort(key=fitness)
        if settled(population[0]):
            break
        a, b = population[0], population[1 + rng.randrange(len(population) - 1)]
        population[-1] = crossover(a, b, lengths, capacity)
        population[-2] = crossover(b, a, lengths, capacity)
        population[-3] = mutate(a, lengths, capacity, rng)
    return min(population, key=fitness)


def _in_order(g: pd.DataFrame) -> pd.DataFrame:
    return g.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)


def _epoch(capacity: int, epoch: int, islands: int) -> Callable:
    """Pieces (bin: the elite's of the last epoch, -1 before the first) and migrants of an island, to both of the next epoch in one table."""

    def run(key, g: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        g = _in_order(g)
        island, lengths = int(key[0]), g["length"].astype(int).tolist()
        start: list[list[list[int]]] = []
        if len(g) and g["bin"].iloc[0] >= 0:
            start.append([list(x) for x in g.groupby("bin").indices.values()])
        if len(m):
            start.append(immigrant([list(map(int, p)) for p in m["pattern"]], lengths, capacity))
        bins = evolve(lengths, capacity, island * 1000 + epoch, start)
        own = np.full(len(g), -1, np.int64)
        for k, b in enumerate(bins):
            own[b] = k
        g = g.assign(bin=own, pattern=None)
        best = sorted(bins, key=lambda b: -sum(lengths[i] for i in b))[:MIGRANTS]
        if islands < 2 or epoch == EPOCHS - 1:
            return g
        sent = pd.DataFrame({c: np.zeros(len(best), g[c].dtype) for c in g.columns if c != "pattern"})
        return pd.concat([g, sent.assign(island=(island + 1) % islands, bin=_MIGRANT, pattern=[[lengths[i] for i in b] for b in best])], ignore_index=True)

    return run


def _settle(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = _in_order(g)
        lengths = g["length"].astype(int).tolist()
        own = np.zeros(len(g), np.int64)
        for k, b in enumerate(evolve(lengths, capacity, int(g["island"].iloc[0]))):
            own[b] = k
        return g.assign(bin=own)

    return run


def _numbered(pieces: DataFrame, base: int) -> DataFrame:
    """Pieces with sequence_id from (island, bin), and their offset in it."""
    place = Window.partitionBy("island", "bin").orderBy(F.desc("length"), "doc_id", "piece", "row")
    return pieces.select(
        F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id"),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.lit(base << 60) + F.shiftleft(F.col("island").cast("bigint"), 16) + F.col("bin")).alias("sequence_id"),
        (F.sum("length").over(place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of ``docs`` (doc_id, text)."""
    save = saver(docs.sparkSession)
    pieces = save(docs.select("doc_id", "text").mapInArrow(_cut(path or tokenizer_path(WORD_BPE), capacity), PIECES))
    # Full pieces are numbered by partition and row, beside the islands' numbers.
    full = pieces.where(F.col("length") == capacity).select("*", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    named = [F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "piece", "start", "length", "ids_crc32", F.col("doc_id").isNotNull().alias("has_id")]
    rest = save(pieces.where(F.col("length") < capacity).select(*named, F.monotonically_increasing_id().alias("row")))
    islands = max(1, math.ceil(rest.count() / ISLAND))
    draw = lambda n, salt: F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row", F.lit(salt)), F.lit(n))
    own = rest.withColumn("island", draw(islands, 0)).withColumn("bin", F.lit(-1).cast("bigint"))
    schema = f"{PLACED}, pattern array<bigint>"
    migrants = None
    for epoch in range(EPOCHS if islands > 1 else 1):
        came = (own.select("island", F.lit(None).cast("array<bigint>").alias("pattern")).limit(0) if migrants is None else migrants).groupBy("island")
        both = save(own.groupBy("island").cogroup(came).applyInPandas(_epoch(capacity, epoch, islands), schema))
        own, migrants = both.where(F.col("bin") >= 0).drop("pattern"), both.where(F.col("bin") == _MIGRANT).select("island", "pattern")
    if islands == 1:
        return full.unionByName(_numbered(own, 0))
    # Bins to the brim are settled; what is left, a few bins an island, is packed together.
    filled = own.groupBy("island", "bin").agg((F.sum("length") >= capacity - BRIM).alias("is_full"))
    marked = save(own.join(filled, ["island", "bin"]).select(*own.columns, "is_full"))
    loose = marked.where("not is_full").drop("is_full", "bin")
    again = max(1, math.ceil(loose.count() / ISLAND))
    last = loose.withColumn("island", draw(again, 1)).groupBy("island").applyInPandas(_settle(capacity), PLACED)
    return full.unionByName(_numbered(marked.where("is_full"), 0)).unionByName(_numbered(save(last), 1))
