"""Operator 6: benchmark decontamination by a size-partitioned MinHash containment search, in SQL functions only.

A test item is the set of the n-word shingles of its lower-cased words (letters
and digits). Items are partitioned by size: those of 2**c to 2**(c + 1) - 1
shingles are class c. An item's sketch has the s smallest hashes of its set,
s = n - ceil(t n) + 1 by its size n.

1. Search: the documents' shingles are joined with the sketches alone, and a
   document that shares a hash with a sketch is a candidate for that item. A
   document that holds the share t of an item misses at most n - ceil(t n) of its
   shingles, so it shares one of any s: no pair is lost at any length of the
   document, where banded signatures would lose short items in long documents.
   While the sketches' shingles begin with few pairs of words (MAX_STARTS, none of
   one word), only the document's runs that begin with such a pair are hashed.
2. Verification: a candidate's whole sets are intersected, which gives the exact
   containment. Documents without candidates are not read for it.

Sketches and item sets are broadcast while few (counted first,
MAX_BROADCAST_ROWS), and joined by a shuffle beyond that; the same holds for the
candidates' documents.

Defined cases: null texts count as empty; an item or document without words
matches nothing; an item of fewer than SHINGLE words is one shingle of all its
words; repeated shingles count once; rows of equal doc_id and text give one
pair; a null doc_id is carried through; several texts of an item_id are one item,
and items without item_id are not searched for; empty tables give no pairs; a very long
text is one row with all its shingles (Spark's limit: 2 GB a row). Only doc_id
and text, item_id and text are read; ``decontaminate`` returns all columns as
they are, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Saver, row_key, saver

SHINGLE = 5
THRESHOLD = 0.5
#: 24 bytes a row: 48 MB at most are broadcast.
MAX_BROADCAST_ROWS = 2_000_000
#: With many more, most runs would begin like some shingle, and hashing each of them costs less.
MAX_STARTS = 100_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def _hash(w: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(w, at + j) for j in range(n)])


def _shingles(w: Column, n: int) -> Column:
    """Hashes of the runs of n words; empty where there are fewer."""
    return F.when(
        F.size(w) >= n,
        F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: _hash(w, i, n)),
    ).otherwise(F.array().cast("array<bigint>"))


def item_sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per item and shingle: item_id, ns (lengths of its shingles), size_class, n_shingles, rank, sh, in_sketch."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).dropDuplicates()
    n = F.least(F.size("w"), F.lit(SHINGLE))
    hashes = reduce(lambda other, k: F.when(n == k, _shingles(F.col("w"), k)).otherwise(other), range(1, SHINGLE), _shingles(F.col("w"), SHINGLE))
    texts = w.where("item_id is not null").select("item_id", n.alias("n"), hashes.alias("s"))
    # The texts of one item_id are one item, their shingles one set.
    sets = texts.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("s"), F.collect_set("n").alias("ns"))
    size = F.size("s")
    return sets.select(
        "item_id",
        "ns",
        F.floor(F.log2(size.cast("double"))).cast("int").alias("size_class"),
        size.alias("n_shingles"),
        F.posexplode("s").alias("rank", "sh"),
    ).withColumn("in_sketch", F.col("rank") <= F.col("n_shingles") - F.ceil(F.lit(threshold) * F.col("n_shingles")))


def starts(items: DataFrame, sketches: DataFrame) -> DataFrame:
    """Distinct (pair, n): the hash of the first two words of each shingle in a sketch, and its length; one-word shingles have none."""
    w = items.where("item_id is not null").select(words(F.col("text")).alias("w")).where(F.size("w") > 1).distinct()
    n = F.least(F.size("w"), F.lit(SHINGLE))
    runs = w.select("w", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("pos"))
    own = runs.select(_pair(), "n", _run(range(2, SHINGLE + 1)))
    return own.join(sketches.where("in_sketch").select("sh"), "sh", "left_semi").select("pair", "n").distinct()


def _pair() -> Column:
    return F.xxhash64(F.get("w", F.col("pos")), F.get("w", F.col("pos") + 1)).alias("pair")


def _run(lengths: Iterable[int]) -> Column:
    """The hash of the n (a column) words from ``pos``."""
    return F.coalesce(*[F.when(F.col("n") == k, _hash(F.col("w"), F.col("pos"), k)) for k in lengths]).alias("sh")


def candidates(docs: DataFrame, sketches: DataFrame, rows: int, lengths: list[int], begin: DataFrame | None = None) -> DataFrame:
    """Distinct (_key, item_id, size_class) of documents (_key, w) that share a hash with the sketch of an item; begin: their starts, where few."""
    side = sketches.where("in_sketch").select("item_id", "size_class", "sh")
    side = F.broadcast(side) if rows <= MAX_BROADCAST_ROWS else side
    if begin is None:
        hashes = docs.select("_key", F.explode(_document_shingles(lengths)).alias("sh"))
    else:
        # Exploding an array of it binds ``w``: filters on it would else be pushed down and split the text again.
        bound = docs.select("_key", F.explode(F.array("w")).alias("w")).where(F.size("w") > 1)
        places = bound.select("_key", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 2)).alias("pos"))
        found = places.select("_key", "w", "pos", _pair()).join(F.broadcast(begin), "pair").where(F.col("pos") + F.col("n") <= F.size("w"))
        hashes = found.select("_key", _run(lengths))
    return (
        hashes.join(side, "sh")
        # Combined map-side: what a document shares with a sketch twice goes before anything is shuffled.
        .groupBy("_key", "item_id", "size_class")
        .agg(F.lit(1).alias("one"))
        .select("_key", "item_id", "size_class")
    )


def _document_shingles(lengths: list[int]) -> Column:
    return F.concat(*[_shingles(F.col("w"), k) for k in lengths]) if lengths else F.array().cast("array<bigint>")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, save: Saver | None = None) -> DataFrame:
    """Pairs (doc_id, item_id) with the share of the item's shingles that the document holds, ``threshold`` or more."""
    save = save or saver(docs.sparkSession)
    sketches = save(item_sketches(items, threshold))
    rows, lengths = sketches.count(), sorted(r["n"] for r in sketches.select(F.explode("ns").alias("n")).distinct().collect())  # at most SHINGLE rows
    texts = docs.select("doc_id", row_key("doc_id", "text").alias("_key"), "text")
    begin = save(starts(items, sketches)) if lengths and lengths[0] > 1 else None
    begin = begin if begin is not None and begin.count() <= MAX_STARTS else None
    found = save(candidates(texts.select("_key", words(F.col("text")).alias("w")), sketches, rows, lengths, begin))
    sets = sketches.groupBy("item_id").agg(F.first("n_shingles").alias("n_shingles"), F.collect_list("sh").alias("s"))
    sets = F.broadcast(sets) if rows <= MAX_BROADCAST_ROWS else sets
    # A document with several candidates is read and hashed once.
    keys = found.select("_key").distinct()
    keys = F.broadcast(keys) if found.count() <= MAX_BROADCAST_ROWS else keys
    some = texts.join(keys, "_key", "left_semi").dropDuplicates(["_key"]).select("doc_id", "_key", words(F.col("text")).alias("w"))
    own = some.select("doc_id", "_key", _document_shingles(lengths).alias("d"))
    shared = (
        own.join(found, "_key").join(sets, "item_id").select("doc_id", "_key", "item_id", "size_class", "n_shingles", F.size(F.array_intersect("s", "d")).cast("long").alias("shared"))
    )
    return shared.where(F.col("shared") >= F.ceil(F.lit(threshold) * F.col("n_shingles"))).select(
        "doc_id",
        "_key",
        "item_id",
        "size_class",
        F.col("n_shingles").cast("long").alias("n_shingles"),
        "shared",
        (F.col("shared") / F.col("n_shingles")).alias("containment"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no test item."""
    found = contaminated(docs.select("doc_id", "text"), items, threshold).select("_key").distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), row_key("doc_id", "text").alias("_key"))
    return whole.join(found, "_key", "left_anti").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


SQL = f"""
WITH iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), {SHINGLE}) AS n FROM iw WHERE len(w) > 0),
ish AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS sh FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
isz AS (SELECT item_id, count(*) AS n_shingles FROM ish GROUP BY item_id),
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
dn AS (SELECT doc_id, w, n FROM dw, (SELECT DISTINCT n FROM i) WHERE len(w) >= n),
dsh AS (SELECT DISTINCT doc_id, n, array_to_string(w[p:p + n - 1], ' ') AS sh FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dn)),
m AS (SELECT d.doc_id, s.item_id, count(*) AS shared FROM dsh d JOIN ish s ON d.n = s.n AND d.sh = s.sh GROUP BY ALL)
SELECT doc_id, m.item_id, CAST(floor(log2(n_shingles)) AS INTEGER) AS size_class, n_shingles, shared, shared / n_shingles AS containment
FROM m JOIN isz ON m.item_id = isz.item_id WHERE shared >= ceil({THRESHOLD} * n_shingles)
"""
