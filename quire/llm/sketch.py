"""Count sketches of fixed size: summed in chunks over the cluster, small enough to ship to every worker."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNKS = 16


def to_parts(sketch: np.ndarray) -> list[bytes]:
    """A task's sketch in CHUNKS compressed parts; none if it is empty."""
    size = len(sketch) // CHUNKS
    return [zlib.compress(sketch[i * size : (i + 1) * size].tobytes(), 1) for i in range(CHUNKS)] if sketch.any() else []


def _add(table: pa.Table) -> pa.Table:
    total: np.ndarray | int = 0
    for blob in table["part"]:
        total = total + np.frombuffer(zlib.decompress(blob.as_py()), np.uint32).astype(np.uint64)
    most = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
    return pa.table({"chunk": table["chunk"][:1], "part": pa.array([zlib.compress(most.tobytes(), 1)], pa.binary())})


def sum_parts(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' sketches, from rows (chunk, part); first in 64 groups, then together. The driver gets 4 * size bytes."""
    once = parts.groupBy("chunk", F.pmod(F.xxhash64("part"), F.lit(64)).alias("g")).applyInArrow(_add, "chunk int, part binary")
    rows = {r["chunk"]: zlib.decompress(r["part"]) for r in once.groupBy("chunk").applyInArrow(_add, "chunk int, part binary").collect()}
    none = bytes(4 * size // CHUNKS)
    return np.frombuffer(b"".join(rows.get(i, none) for i in range(CHUNKS)), np.uint32)
