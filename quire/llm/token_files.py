"""Operator 7: token ids of a corpus as compressed, checksummed binary segments.

Texts are tokenised whole, an end id follows each, and ranges of documents in
doc_id order become segments (``token_coder``: adaptive context mixing of orders
0 to 2 under a range coder, in independent blocks). Segments are rows
(range, number, documents, ids, segment) of a Parquet folder, so that Spark's
committer makes them survive lost executors; each blob stands for itself.

Defined cases: a null or empty text is its end id alone; rows of one doc_id
follow each other by the hash of their text; a null doc_id sorts first and is
kept; a document is never cut between segments, so a segment is as long as
SEGMENT or its longest document, and its compressed bytes have to stay under 2 GB
(a text of some 4 GB); an empty table writes no segment; other columns are not
read, whatever they are called.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import token_coder
from .common import small_batches
from .tokens import BYTE_BPE, encoder, tokenizer_path
from .words import trim

END_ID, VOCABULARY = 2, 50_257
#: Ids after which a segment ends: the coder's lanes, all full.
SEGMENT = token_coder.BLOCK * token_coder.LANES
#: Bytes of text of a range: about a segment's, as full lanes cost least; of a small input, which then goes to all cores.
RANGE, LEAST_RANGE = 20 << 20, 4 << 20
SCHEMA = "range int, number int, documents bigint, ids bigint, segment binary"


def _write(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        encode = encoder(path, True, END_ID)
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        docs: list[int | None] = []
        size = 0

        def segment() -> pa.RecordBatch:
            nonlocal number, size
            blob = token_coder.encode(np.concatenate(ids), np.concatenate(counts), docs, VOCABULARY)
            row = {"range": [part], "number": [number], "documents": [len(docs)], "ids": [size], "segment": [blob]}
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            number, size = number + 1, 0
            ids.clear(), counts.clear(), docs.clear()
            trim()  # the coder's tables are of sizes that would stay with the worker
            return pa.record_batch({k: pa.array(v, t) for (k, v), t in zip(row.items(), types)})

        for b in batches:
            for r in encode(b.column("text")):
                if size and size + len(r.ids) > SEGMENT:
                    yield segment()
                ids.append(r.ids.astype(np.uint16))  # below 65,535
                counts.append(np.diff(r.bounds))
                docs += b.column("doc_id").slice(r.lo, r.hi - r.lo).to_pylist()
                size += len(r.ids)
        if docs:
            yield segment()

    return run


def write_segments(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Writes ``docs`` (doc_id, text) as segments in ascending doc_id order."""
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / RANGE), min(spark.sparkContext.defaultParallelism, math.ceil(size / LEAST_RANGE)))
    ranges = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )
    ranges.mapInArrow(_write(path or tokenizer_path(BYTE_BPE)), SCHEMA).write.parquet(folder)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for base, blob in zip(b.column("base").to_pylist(), b.column("segment")):
            ids, counts, docs = token_coder.decode(blob.as_py())
            trim()
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            end = np.cumsum(counts)
            start = end - counts
            yield pa.record_batch(
                {
                    "doc_id": pa.array(docs, pa.int64()),
                    "start": pa.array(start + base),
                    "n_tokens": pa.array(counts),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(start.tolist(), end.tolist())], pa.int64()),
                }
            )


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the segments."""
    small_batches(spark)
    rows = spark.read.schema(SCHEMA).parquet(folder)
    # One small row per segment goes through the window.
    order = Window.orderBy("range", "number").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.select("range", "number", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("base"))
    return rows.join(bases, ["range", "number"]).select("base", "segment").mapInArrow(_read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
