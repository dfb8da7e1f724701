"""The ``opN_<name>`` queries and the SQL that checks those which SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_text, imatch, jaccard_join, line_dedup, packing, parse_dedup, pii, quality, token_files
from .common import checkpoint_dir, table

#: The key of the synthetic tables' query; data of people needs a secret one.
QUERY_KEY = "of no secrecy"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op5_parse_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_dedup.parse_dedup(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_key")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/quire-tokens-{uuid.uuid4().hex}"
    token_files.write_segments(table(spark, sf_dir, "documents"), folder)
    return token_files.read_segments(spark, folder)


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_table(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op") and n[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_jaccard_join": jaccard_join.SQL,
        "op5_parse_dedup": parse_dedup.SQL,
        "op6_benchmark_decontamination": decontaminate.SQL,
        "op10_line_dedup": line_dedup.SQL,
    }
