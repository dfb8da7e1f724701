"""Operator 8: I-Match document fingerprints.

A document's terms are its distinct lower-cased words whose inverse document
frequency lies in a band; document frequencies come from a count sketch of fixed
size over all documents. FAMILIES randomised lexicons are drawn; lexicon k of
level L is a random 2**-L of all terms, and level L + 1 is a subset of level L.
A fingerprint holds, per family, the hash of all the document's terms in the
lexicon, sorted and distinct, at LEVELS levels: the one at which TERMS to
2 * TERMS of its terms are expected, and those above it. A lexicon without a
term of the document has no hash.

The likeness of two fingerprints is the share of lexicons with equal hashes
among those of common levels in which either has a term; texts whose numbers of
terms differ more than eightfold have no common level and are not alike. Equal texts have
equal fingerprints. A single hash over the whole band would differ after any
edit, and so do the denser lexicons after a large one; the sparse ones still
agree where half of a text is new.

The comparison with the next document needs documents in order: they are cut
into ranges of doc_id by quantiles, and each range also gets the first document
of the next one, so texts are shuffled once.

Defined cases: a null text counts as empty; an empty text has a fingerprint of
no terms, which is like itself only; a text without terms in the band uses all
its terms; a very long text is read whole, alone in its slice; rows of one doc_id follow each other by the hash of their text; a null
doc_id sorts first; a single document is its own next; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts, small_batches, text_of
from .sketch import sum_parts, to_parts
from .words import TERM_BREAKS, mix, terms, words

SKETCH = 1 << 22
FAMILIES, LEVELS = 24, 3
#: Fewest terms expected in the larger lexicon of a document.
TERMS = 2
#: The band: ln(documents / document frequency). Its upper end drops what occurs in too few documents to tell
#: families of texts apart; below some two million documents that is a single one.
LOW_IDF, HIGH_IDF, FEWEST = 3.0, 14.0, 2
_SEEDS = np.random.default_rng(8).integers(1, 1 << 63, FAMILIES, dtype=np.uint64)
SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch, n = np.zeros(SKETCH, np.uint32), 0
    for b in batches:
        for w in words(b.column(0), breaks=TERM_BREAKS):
            t, _ = terms(w)
            np.add.at(sketch, (t & np.uint64(SKETCH - 1)).astype(np.int64), np.uint32(1))
            n += w.hi - w.lo
    parts = to_parts(sketch)
    yield pa.record_batch({"chunk": pa.array([*range(len(parts)), -1], pa.int32()), "part": pa.array([*parts, n.to_bytes(8, "big")], pa.binary())})


def band(sketch: np.ndarray, documents: int, low: float = LOW_IDF, high: float = HIGH_IDF) -> np.ndarray:
    """Which sketch cells hold terms of the band. Terms of one or two documents are rare, not common, in however few documents."""
    most, least = max(documents * math.exp(-low), FEWEST), max(documents * math.exp(-high), FEWEST if documents > 2 * FEWEST else 1)
    return (sketch <= most) & (sketch >= least)


def level(terms_: np.ndarray) -> np.ndarray:
    """The level of the larger lexicon for texts of so many terms."""
    return np.maximum(np.floor(np.log2(np.maximum(terms_, 1) / TERMS)), 0).astype(np.int64)


def fingerprints(column: pa.Array, in_band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level, hashes): per text the level of its larger lexicons and FAMILIES x LEVELS 32-bit hashes, 0 for no term."""
    out, levels = np.zeros((len(column), FAMILIES, LEVELS), np.uint32), np.zeros(len(column), np.int64)
    for w in words(column, breaks=TERM_BREAKS):
        t, bounds = terms(w)
        doc = np.repeat(np.arange(w.hi - w.lo), np.diff(bounds))
        keep = in_band[(t & np.uint64(SKETCH - 1)).astype(np.int64)]
        has = np.bincount(doc[keep], minlength=w.hi - w.lo) > 0
        keep |= ~has[doc]
        t, doc = t[keep], doc[keep]
        if not len(t):
            continue
        start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        size = np.diff(np.r_[start, len(t)])
        own = level(size)
        levels[w.lo + doc[start]] = own
        masks = [np.repeat((np.uint64(1) << (own + k).astype(np.uint64)) - np.uint64(1), size) for k in range(LEVELS)]
        for f, seed in enumerate(_SEEDS):
            x = mix(t ^ seed)
            # A sum of mixed hashes of distinct terms is the hash of their sorted list.
            y = x * np.uint64(0x9E3779B97F4A7C15)
            for k, mask in enumerate(masks):
                held = x & mask == 0
                sums = np.add.reduceat(np.where(held, y, np.uint64(0)), start)
                some = np.logical_or.reduceat(held, start)
                out[w.lo + doc[start], f, k] = np.where(some, (mix(sums) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), 0)
    return levels, out


def likeness(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of fingerprints in step: equal hashes among the lexicons of common levels in which either text has a term."""
    (la, a), (lb, b) = one, other
    alike = np.zeros(len(la))
    for shift in range(1 - LEVELS, LEVELS):
        rows = np.flatnonzero(lb - la == shift)
        if len(rows):
            x, y = a[rows][:, :, max(shift, 0) : LEVELS + min(shift, 0)], b[rows][:, :, max(-shift, 0) : LEVELS - max(shift, 0)]
            used = ((x != 0) | (y != 0)).sum(axis=(1, 2))
            same = ((x == y) & (x != 0)).sum(axis=(1, 2))
            # Texts without terms are like each other only.
            none = ~a[rows].any(axis=(1, 2)) & ~b[rows].any(axis=(1, 2))
            alike[rows] = np.where(none, 1.0, same / np.maximum(used, 1))
    return alike


def _hex(f: tuple[np.ndarray, np.ndarray]) -> list[str]:
    return [f"{k:02x}" + row.tobytes().hex() for k, row in zip(f[0].tolist(), f[1].astype(">u4"))]


def _rows(f: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return f[0][at], f[1][at]


def _compare(in_band: np.ndarray) -> Callable:
    """From rows (part, doc_id, guest, text) in order: each row but the guests, beside the row after it in its part."""
    most = 4 << 20

    def rows(held: list[tuple]) -> pa.RecordBatch:
        texts = [h[3] for h in held]
        own = fingerprints(pa.array(texts, pa.large_string()), in_band)
        pairs = [i for i in range(len(held) - 1) if held[i][0] == held[i + 1][0] and not held[i][2]]
        edited = []
        for i in pairs:
            a, b = texts[i], texts[i + 1]
            half = len(a) // 2
            edited.append(a[: len(a) - half] + b[:half])
        other = fingerprints(pa.array(edited, pa.large_string()), in_band)
        p = np.array(pairs, np.int64)
        return pa.record_batch(
            {
                "doc_id": pa.array([held[i][1] for i in pairs], pa.int64()),
                "n_chars": pa.array([len(texts[i]) for i in pairs], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                "fingerprint": pa.array(_hex(_rows(own, p)), pa.string()),
                "edited_fingerprint": pa.array(_hex(other), pa.string()),
                "near_edited": pa.array(likeness(_rows(own, p), other), pa.float64()),
                "near_next": pa.array(likeness(_rows(own, p), _rows(own, p + 1)), pa.float64()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*[b.column(i).to_pylist() for i in range(3)], b.column(3)):
                held.append((*row[:3], row[3].as_py()))
                size += len(held[-1][3])
                if size > most and len(held) > 1:
                    yield rows(held)
                    held, size = held[-1:], len(held[-1][3])
        if len(held) > 1:
            yield rows(held)

    return run


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    counted = own.select("text").mapInArrow(_count, "chunk int, part binary").persist()
    documents = sum(int.from_bytes(r["part"], "big") for r in counted.where("chunk < 0").select("part").toLocalIterator())
    in_band = band(sum_parts(counted.where("chunk >= 0"), SKETCH), documents)
    counted.unpersist()
    n = shuffle_parts(spark)
    cuts = sorted({int(x) for x in own.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []
    # A binary search over the cuts, as an expression.
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(_place(cuts, 0, len(cuts)))
    placed = own.select(part.cast("int").alias("part"), "doc_id", F.xxhash64("text").alias("tie"), "text")
    first = placed.groupBy("part").agg(F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), "tie")).alias("k")).orderBy("part").collect()  # n rows at most
    if not first:
        return spark.createDataFrame([], SCHEMA)
    # The first document of each range is also sent to the range before it, and the very first to the last.
    ranges = [r["part"] for r in first]
    guests = spark.createDataFrame(
        [(ranges[i - 1], r["part"], r["k"][0], r["k"][1]) for i, r in enumerate(first)], "to int, part int, id bigint, tie bigint"
    )
    sent = (
        placed.join(F.broadcast(guests), ["part", "tie"])
        .where(F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("id"))
        .dropDuplicates(["to"])
        .select(F.col("to").alias("part"), "doc_id", "tie", "text", F.lit(True).alias("guest"))
    )
    every = placed.withColumn("guest", F.lit(False)).unionByName(sent)
    # A range a task: hashing the numbers of the ranges would put several into one.
    ordered = every.repartitionByRange(len(ranges), "part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "tie")
    return ordered.select("part", "doc_id", "guest", "text").mapInArrow(_compare(in_band), SCHEMA)


def _place(cuts: list[int], lo: int, hi: int):
    """The number of cuts at or below doc_id."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(F.col("doc_id") < cuts[mid], _place(cuts, lo, mid)).otherwise(_place(cuts, mid + 1, hi))
