"""Operator 10: line deduplication by overlapping three-line windows.

Every run of three consecutive lines of a document is a window. A window that
has occurred before, in the order (doc_id, line number), is a repeat; all lines
that repeats cover are removed, so overlapping repeats merge. The first
occurrence stays.

Repeated windows are found by a map-side combined aggregate and saved with the
number of their occurrences. Those in more than one of HOT_SHARE of all repeats
(HOT_LEAST at least) number fewer than HOT_SHARE, so they are broadcast; the
occurrences of the others meet them by a shuffled join, in which no key is hot.

Defined cases: a null text counts as empty; a text of fewer than three lines has
no window and stays as it is; rows of equal doc_id and text are one document and
all get its result; a null doc_id sorts first; an empty table gives an empty
result; a very long text is cut in time linear in its lines, its windows being
rows of their own. Other columns pass through, whatever they are called; where
one is called n_lines or n_removed, ours gets underscores after its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, row_key, saver

WINDOW = 3
HOT_LEAST, HOT_SHARE = 100_000, 10_000


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def covered_lines(docs: DataFrame) -> DataFrame:
    """(_key, _covered): the numbers of the lines to remove, for documents (doc_id, text) that have any."""
    lines = docs.select("doc_id", row_key("doc_id", "text").alias("_key"), _lines(F.col("text")).alias("_l")).where(F.size("_l") >= WINDOW)

    def digest(i):
        own = [F.get("_l", i + j) for j in range(WINDOW)]
        return F.struct(i.alias("pos"), F.xxhash64(*own).alias("h"), F.xxhash64(F.lit(1), *own).alias("g"))

    windows = lines.select("doc_id", "_key", F.explode(F.transform(F.sequence(F.lit(0), F.size("_l") - WINDOW), digest)).alias("w")).select(
        "doc_id", "_key", "w.pos", "w.h", "w.g"
    )
    place = F.struct("doc_id", "_key", "pos")
    save = saver(docs.sparkSession)
    # One row per window text, combined map-side, so a window in a third of all documents is no hot group.
    repeated = save(
        windows.groupBy("h", "g")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
        .where(~F.col("first").eqNullSafe(F.col("last")))
        .select("h", "g", "first", "n")
    )
    total = repeated.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(HOT_LEAST, total // HOT_SHARE)
    rest = repeated.where(~hot).select("h", "g", F.col("first").alias("one"))
    if repeated.where(hot).isEmpty():
        found = windows.join(rest, ["h", "g"]).withColumnRenamed("one", "first")
    else:
        # Fewer than HOT_SHARE rows. Their occurrences keep what they found and join nothing, spread by place.
        known = windows.join(F.broadcast(repeated.where(hot).select("h", "g", "first")), ["h", "g"], "left")
        spread = known.withColumn("h", F.when(F.col("first").isNull(), F.col("h")).otherwise(F.xxhash64("_key", "pos")))
        spread = spread.withColumn("g", F.when(F.col("first").isNull(), F.col("g")).otherwise(~F.col("g")))
        found = spread.join(rest, ["h", "g"], "left").withColumn("first", F.coalesce("first", "one")).where("first is not null")
    later = found.where(~place.eqNullSafe(F.col("first")))
    return (
        later.select("_key", F.explode(F.sequence(F.col("pos"), F.col("pos") + WINDOW - 1)).alias("n"))
        .groupBy("_key")
        .agg(F.collect_set("n").alias("_covered"))
    )


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with its text cut, and n_lines and n_removed. Needs doc_id and text."""
    n_lines = free_name(docs.columns, "n_lines")
    n_removed = free_name(docs.columns, "n_removed")
    covered = covered_lines(docs.select("doc_id", "text"))
    # Columns of the input may have any name, so they travel in a struct.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), row_key("doc_id", "text").alias("_key")).join(covered, "_key", "left")
    lines = _lines(F.col("_row.text"))
    # The lines are bound once, and array_except looks numbers up by hash: linear in the lines.
    kept = F.transform(
        F.array(lines),
        lambda own: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("_covered")), lambda i: F.get(own, i)), "\n"),
    )[0]
    text = F.when(F.col("_covered").isNull(), F.col("_row.text")).otherwise(kept)
    made = whole.select("_row", text.alias("_text"), F.size(lines).cast("long").alias("_lines"), F.coalesce(F.size("_covered"), F.lit(0)).cast("long").alias("_removed"))
    return made.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != "text"], F.col("_text").alias("text"), F.col("_lines").alias(n_lines), F.col("_removed").alias(n_removed))


SQL = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS k
      FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM l WHERE len(ls) >= 3)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS n FROM w),
c AS (SELECT doc_id, list(DISTINCT p) AS covered FROM (SELECT doc_id, unnest(range(pos, pos + 3)) AS p FROM r WHERE n > 1) GROUP BY doc_id),
e AS (SELECT doc_id, ls, unnest(range(0, len(ls))) AS p FROM l),
t AS (SELECT e.doc_id, string_agg(e.ls[e.p + 1], chr(10) ORDER BY e.p) FILTER (WHERE c.covered IS NULL OR NOT list_contains(c.covered, e.p)) AS text,
             count(*) AS n_lines, count(*) FILTER (WHERE c.covered IS NOT NULL AND list_contains(c.covered, e.p)) AS n_removed
      FROM e LEFT JOIN c ON e.doc_id = c.doc_id GROUP BY e.doc_id)
SELECT doc_id, coalesce(text, '') AS text, n_lines, n_removed FROM t
"""
