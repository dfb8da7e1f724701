"""Structured Streaming: files that arrive in a folder become rows of tables; a document is a row, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.options import TableOptions
from ..plans.tables import cells, tables

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """doc_id, content of new files under a folder."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_per_trigger).load(path).select(F.col("path").alias("doc_id"), "content")


def write_cells(docs: DataFrame, options: TableOptions, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends the cells of each file's tables to Parquet, exactly once by the checkpoint."""
    return cells(tables(docs, options)).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
