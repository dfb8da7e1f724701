"""A training corpus from raw documents: rejected, repeated and leaked texts go, the rest is packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's documents. All but the last keep the
columns of ``documents``.

Defined cases, of every stage: an empty table gives an empty result. A null text
counts as empty: it is scored as such, has no line to remove, is like no other
document, holds no test item, and is packed as its end id. A null doc_id is kept:
it is never learned from, sorts first among repeated lines, and stays beside
near copies. Repeated rows are one document to line dedup; one of them stays after
the Jaccard join. Ties go to the smaller doc_id. A very long text is one row in every
stage, read whole (Spark's limit: 2 GB a value). Other columns than doc_id and
text pass through, whatever they are called; n_chars, where there is one, follows
the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from quire.llm.common import saver, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; every document stays, and n_chars follows its text."""
    cut = line_dedup.line_dedup(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return jaccard_join.keep_first(docs)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, with their sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", remove_repeated_lines),
    ("ngram_jaccard_join", remove_near_duplicates),
    ("benchmark_decontamination", remove_benchmark_leaks),
    ("best_fit_packing", pack_sequences),
]

#: Neither the network nor the packing can be written in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote goes when the next one has, and the last goes at the end of the program."""
    docs, saves = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        save = saver(spark)
        docs_before, docs = docs, save(made)
        if saves:
            saves[-1].drop(docs_before)
        saves.append(save)
    return docs
