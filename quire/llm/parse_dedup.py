"""Operator 5: removal of repeated 50-byte strings by prefix-free parsing.

A rolling hash of GRAM bytes triggers phrases: the trigger of a 50-byte window
is the leftmost smallest of the hashes in it, so it depends on the window alone,
and the windows of one trigger are a run of starts; the bytes they span are a
phrase. Phrases overlap, so each window lies whole in exactly one, and none is
a prefix of another's windows: equal windows are found among phrases of equal
trigger, wherever they stand.

1. A window holds SIDE bytes before its trigger or SIDE bytes after it, so the
   trigger with either side is counted: per slice of texts and bucket a packed
   list of 32-bit rests, then a bitmap over all of those in more than one
   document, two bits each. It grows with the bytes of text from FILTER_BITS to
   MAX_FILTER_BITS. A false hit costs a row, never a match.
2. Phrases, cut to the windows of the sides in the bitmap, are sent to their
   trigger. Of phrases that a slice repeats, the bytes go once.
3. Per trigger the distinct phrases are the dictionary, and the occurrences of a
   phrase, in doc_id order, are its place in the parse. The suffixes of the
   dictionary's phrases that are windows are put in order: by their first eight
   bytes, then by the hash of all 50, which brings equal ones together.
4. Dictionary and parse combine: a string first occurs in the smallest of the
   documents in which the phrases that have it first occur. An occurrence of a phrase
   in a later document than its first is covered whole; in the first one, the
   windows are covered whose string occurs in a smaller document.
5. Covered runs return to their documents, which are cut and hashed.

What the parse's own suffixes would add is the order of matches longer than a
phrase. A byte is judged by 50-byte strings, each whole in one phrase, so the
parse is used for its occurrences and isn't sorted.

Defined cases: a null text counts as empty; texts under 50 bytes have no window;
rows of equal doc_id and text are one document, and rows of one doc_id never
cover each other; a null doc_id counts as the smallest; an empty table gives an
empty result; a very long text is parsed in pieces of 8 MB that share 49 bytes;
other columns are not read, whatever they are called. Windows are compared by
64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import row_key, saver, shuffle_parts

WINDOW, GRAM = 50, 20
SIDE = (WINDOW - GRAM) // 2
#: Bits of the bitmap, one for 8 bytes of text between these bounds: at most 64 MB, which every worker holds.
FILTER_BITS, MAX_FILTER_BITS = 1 << 27, 1 << 29
LEAST = -(1 << 63)
_PIECE = 8 << 20


def _triggers(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple]:
    """Of the phrases of a slice: (batch, bytes, prefix sums, row, place in its text, place in the bytes, windows, place of the trigger, its hash)."""
    for b in batches:
        data, offsets = W.raw(b.column(column))
        for lo, hi in W.slices(offsets):
            begin, end = offsets[lo], offsets[hi]
            # A very long text is cut into pieces that share WINDOW - 1 bytes.
            for at in range(begin, max(end - WINDOW + 1, begin + 1), _PIECE):
                d = data[at : min(at + _PIECE + WINDOW - 1, end)]
                n = len(d) - WINDOW + 1
                if n <= 0:
                    continue
                up, down = W._power(len(d) + 1)
                sums = np.zeros(len(d) + 1, np.uint64)
                np.cumsum(W._TABLE[d] * up[: len(d)], out=sums[1:], dtype=np.uint64)
                grams = len(d) - GRAM + 1
                h = W.mix((sums[GRAM:] - sums[:-GRAM]) * down[:grams])
                key = (h & ~np.uint64((1 << 24) - 1)) | np.arange(grams, dtype=np.uint64)
                for step in (1, 2, 4, 8):
                    key = np.minimum(key[:-step], key[step:])
                key = np.minimum(key[: n], key[WINDOW - GRAM + 1 - 16 :][: n])
                place = (key & np.uint64((1 << 24) - 1)).astype(np.int64)
                row = np.searchsorted(offsets[lo : hi + 1], np.arange(at, at + n), side="right") - 1 + lo
                inside = np.arange(at, at + n) + WINDOW <= offsets[row + 1]
                new = np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])]
                start = np.flatnonzero(new)
                count = np.diff(np.r_[start, n])
                use = inside[start]
                start, count = start[use], count[use]
                yield b, d, sums, row[start], at + start - offsets[row[start]], start, count, place[start], h[place[start]]


def _sides(d: np.ndarray, sums: np.ndarray, start: np.ndarray, count: np.ndarray, gram: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(phrases that have windows with it, its hash there) of the side before the trigger and of that after it."""
    _, down = W._power(len(d) + 1)
    middle = gram - SIDE
    before, after = np.flatnonzero(start <= middle), np.flatnonzero(start + count - 1 >= middle)
    a, b = gram[before], gram[after]
    left = W.mix((sums[a + GRAM] - sums[a - SIDE]) * down[a - SIDE] + np.uint64(1))
    right = W.mix((sums[b + GRAM + SIDE] - sums[b]) * down[b] + np.uint64(2))
    return [(before, left), (after, right)]


def filter_bits(text_bytes: int) -> int:
    return min(MAX_FILTER_BITS, max(FILTER_BITS, 1 << (max(text_bytes // 8, 1) - 1).bit_length()))


def _places(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of a hash, and the 32 bits after it."""
    shift = np.uint64(64 - buckets.bit_length() + 1)
    return (h >> shift).astype(np.int64), (h >> (shift - np.uint64(32))).astype(np.uint32)


def _cells(rest: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a rest in its bucket's part of ``size`` bits."""
    down = np.uint32(32 - size.bit_length() + 1)
    return (rest >> down).astype(np.int64), (rest * np.uint32(0x9E3779B1) >> down).astype(np.int64)


def _count(buckets: int) -> Callable:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, d, sums, row, _, start, count, gram, _ in _triggers(batches, "text"):
            (before, left), (after, right) = _sides(d, sums, start, count, gram)
            h, row = np.concatenate([left, right]), np.concatenate([row[before], row[after]])
            # A hash twice: it is in two documents of the slice.
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            first = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
            h = h[first]
            rank = np.arange(len(h)) - np.searchsorted(h, h)
            h = h[rank < 2]
            bucket, rest = _places(h, buckets)
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(cut))
            yield pa.record_batch({"bucket": pa.array(used.astype(np.int32)), "rests": pa.array([rest[cut[k] : cut[k + 1]].tobytes() for k in used], pa.binary())})

    return run


def _shared(size: int) -> Callable:
    def run(key, table):
        r = np.sort(np.frombuffer(b"".join(table["rests"].to_pylist()), np.uint32))
        twice = r[1:][r[1:] == r[:-1]]
        hit = np.zeros(size, np.uint8)
        for cells in _cells(twice, size):
            hit[cells] = 1
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "hits": pa.array([np.packbits(hit).tobytes()], pa.binary())})

    return run


def _phrases(hits: np.ndarray, buckets: int = 256) -> Callable:
    size = 8 * len(hits) // buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, d, sums, row, pos, start, count, gram, h in _triggers(batches, "text"):
            hit = []
            for where, side in _sides(d, sums, start, count, gram):
                bucket, rest = _places(side, buckets)
                both = np.ones(len(side), np.uint8)
                for cell in _cells(rest, size):
                    cell += bucket * size
                    both &= hits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)
                own = np.zeros(len(h), bool)
                own[where] = both & 1
                hit.append(own)
            use = np.flatnonzero(hit[0] | hit[1])
            if not len(use):
                continue
            # Windows of a side that no other document has are left out.
            first = np.where(hit[0], start, np.maximum(start, gram - SIDE))
            last = np.where(hit[1], start + count - 1, np.minimum(start + count - 1, gram - SIDE))
            pos, start, count = pos + first - start, first, last - first + 1
            row, pos, start, count, h = row[use], pos[use], start[use], count[use], h[use]
            doc = b.column("doc").to_numpy()[row]
            key = b.column("key").to_numpy()[row]
            end = start + count + WINDOW - 1
            _, down = W._power(len(d) + 1)
            whole = W.mix((sums[end] - sums[start]) * down[start] + count.astype(np.uint64))
            # Of a phrase that the slice repeats, only that of the smallest document goes with its bytes; the others are covered if theirs is larger.
            order = np.lexsort((pos, doc, whole))
            w, dd = whole[order], doc[order]
            lead = np.r_[True, w[1:] != w[:-1]]
            least = dd[np.flatnonzero(lead)][np.cumsum(lead) - 1]
            covered = np.empty(len(order), bool)
            covered[order] = dd > least
            spread = W.mix(key.view(np.uint64) + pos.astype(np.uint64))
            raw = d.tobytes()
            bytes_ = [None if c else raw[s:e] for c, s, e in zip(covered.tolist(), start.tolist(), end.tolist())]
            yield pa.record_batch(
                {
                    "trigger": pa.array(np.where(covered, spread, h).view(np.int64)),
                    "doc": pa.array(doc),
                    "key": pa.array(key),
                    "pos": pa.array(pos),
                    "n": pa.array(count.astype(np.int32)),
                    "phrase": pa.array(bytes_, pa.binary()),
                }
            )

    return run


def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, start, end): covered runs, from phrases sorted by trigger and document."""
    seen, seen_head, seen_doc, seen_trigger = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), None

    def out(key, start, end) -> pa.RecordBatch:
        return pa.record_batch({"key": pa.array(key, pa.int64()), "start": pa.array(start, pa.int64()), "end": pa.array(end, pa.int64())})

    for b in batches:
        trigger, doc, key, pos, n = (b.column(i).to_numpy() for i in range(5))
        own = b.column(5).is_valid().to_numpy(zero_copy_only=False)
        yield out(key[~own], pos[~own], pos[~own] + n[~own] + WINDOW - 1)
        data, offsets = W.raw(b.column(5).filter(pa.array(own)))
        trigger, doc, key, pos, n = trigger[own], doc[own], key[own], pos[own], n[own].astype(np.int64)
        if not len(n):
            continue
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        up, down = W._power(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(W._TABLE[data] * up[: len(data)], out=sums[1:], dtype=np.uint64)
        # The dictionary: each distinct phrase once, by its first occurrence, which is in its smallest document.
        whole = W.mix((sums[offsets[1:]] - sums[offsets[:-1]]) * down[offsets[:-1]] ^ trigger.view(np.uint64)) + n.astype(np.uint64)
        _, lead_row, phrase = np.unique(whole, return_index=True, return_inverse=True)
        least = doc[lead_row]
        later = doc > least[phrase]
        yield out(key[later], pos[later], pos[later] + n[later] + WINDOW - 1)
        # Its suffixes.
        size = n[lead_row]
        word = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        i = offsets[:-1][lead_row][word] + at
        h = W.mix((sums[i + WINDOW] - sums[i]) * down[i])
        head = np.zeros(len(i), np.uint64)
        for k in range(8):
            head = (head << np.uint64(8)) | data[i + k]
        d, own_trigger = least[word], trigger[lead_row]
        # What earlier batches saw of the trigger that goes on.
        if seen_trigger is None or seen_trigger != trigger[0]:
            seen, seen_head, seen_doc = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        every, heads, every_doc = np.concatenate([seen, h]), np.concatenate([seen_head, head]), np.concatenate([seen_doc, d])
        order = np.lexsort((every, heads))
        s = every[order]
        lead = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (heads[order][1:] != heads[order][:-1])])
        place = np.empty(len(s), np.int64)
        place[order] = np.repeat(np.arange(len(lead)), np.diff(np.r_[lead, len(s)]))
        first = np.minimum.reduceat(every_doc[order], lead)
        covered = first[place[len(seen) :]] < d
        goes_on = np.concatenate([np.full(len(seen), trigger[0] == trigger[-1]), own_trigger[word] == trigger[-1]])
        keep = order[lead][goes_on[order[lead]]]
        seen, seen_head, seen_doc, seen_trigger = every[keep], heads[keep], first[place[keep]], trigger[-1]
        new_word = np.r_[True, word[1:] != word[:-1]]
        begins = np.flatnonzero(covered & (new_word | np.r_[True, ~covered[:-1]]))
        ends = np.flatnonzero(covered & (np.r_[new_word[1:], True] | np.r_[~covered[1:], True]))
        # The parse: each occurrence in a phrase's first document has its runs.
        rows = np.flatnonzero(~later)
        runs = np.bincount(word[begins], minlength=len(size))
        from_ = np.concatenate([[0], np.cumsum(runs)])[:-1]
        many = runs[phrase[rows]]
        row = np.repeat(rows, many)
        run = np.repeat(from_[phrase[rows]], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        yield out(key[row], pos[row] + at[begins[run]], pos[row] + at[ends[run]] + WINDOW)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = W.raw(b.column("text"))
        spans = b.column("spans").to_pylist()
        rows = []
        for i, found in enumerate(spans):
            own = data[offsets[i] : offsets[i + 1]]
            runs: list[list[int]] = []
            for s in sorted((s["start"], s["end"]) for s in found or ()):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
            digest, at = hashlib.sha256(), 0
            for s, e in runs:
                digest.update(own[at:s])
                at = e
            digest.update(own[at:])
            rows.append((len(own), sum(e - s for s, e in runs), len(runs), digest.hexdigest()))
        n_bytes, removed, n_spans, sha = zip(*rows) if rows else [()] * 4
        yield pa.record_batch(
            {
                "doc_id": b.column("doc_id"),
                "n_bytes": pa.array(n_bytes, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(n_spans, pa.int64()),
                "kept_sha256": pa.array(sha, pa.string()),
            }
        )


def covered_runs(docs: DataFrame) -> DataFrame:
    """(key, start, end) in bytes: runs to remove from each row of ``docs`` (doc_id, text), which may touch or overlap."""
    spark = docs.sparkSession
    n = shuffle_parts(spark)
    buckets = 1 << min(20, max(8, (4 * n - 1).bit_length()))
    own = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST)).alias("doc"), row_key("doc_id", "text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    lists = own.select("text").mapInArrow(_count(buckets), "bucket int, rests binary")
    bits = filter_bits(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    rows = lists.groupBy("bucket").applyInArrow(_shared(bits // buckets), "bucket int, hits binary").toLocalIterator()
    hits = np.zeros(bits // 8, np.uint8)
    size = len(hits) // buckets
    for r in rows:
        hits[r["bucket"] * size : (r["bucket"] + 1) * size] = np.frombuffer(r["hits"], np.uint8)
    phrases = own.mapInArrow(_phrases(hits, buckets), "trigger bigint, doc bigint, key bigint, pos bigint, n int, phrase binary")
    return phrases.repartition(n, "trigger").sortWithinPartitions("trigger", "doc").mapInArrow(_cover, "key bigint, start bigint, end bigint")


def parse_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    save = saver(docs.sparkSession)
    spans = save(covered_runs(docs)).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    whole = docs.withColumn("key", row_key("doc_id", "text")).join(spans, "key", "left")
    return whole.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "spans").mapInArrow(
        _cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )


SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents), h AS (SELECT doc_id, t, hex(t) AS x, octet_length(t) AS n FROM d),
w AS (SELECT doc_id, pos, hash(t[pos + 1:pos + 50]) AS k FROM (SELECT doc_id, t, unnest(range(0, n - 49)) AS pos FROM h WHERE n >= 50)),
f AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k HAVING count(*) > 1),
g AS (SELECT doc_id, pos FROM w JOIN f ON w.k = f.k AND f.first < w.doc_id),
m AS (SELECT doc_id, pos, CASE WHEN pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 OR lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) IS NULL THEN 1 ELSE 0 END AS opens FROM g),
i AS (SELECT doc_id, pos, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM m),
u AS (SELECT doc_id, run, min(pos) AS s, max(pos) + 50 AS e FROM i GROUP BY ALL),
v AS (SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM u),
k AS (SELECT h.doc_id, string_agg(substr(x, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS head, max(e) AS last, count(*) AS n_spans, sum(e - s) AS gone FROM v JOIN h ON v.doc_id = h.doc_id GROUP BY h.doc_id)
SELECT h.doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM h LEFT JOIN k ON h.doc_id = k.doc_id
"""
