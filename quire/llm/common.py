"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import itertools
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.batches import small_batches as small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row's identifying columns; null and "" differ.

    Rows that agree in all of the columns share a key and get the same result,
    so repeated rows and null ids need no special case.
    """
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.xxhash64(*parts)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, or with underscores after it where a column of the input has it; Spark's names differ by more than case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names.

    Without the setting, a session on one machine (master ``local``, as in tests)
    gets a folder of its own; on a cluster its executors couldn't see each
    other's files there, so that is an error.
    """
    sc = spark.sparkContext
    said = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not said:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        said = tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", said)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(said)
    return said


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001 - the session has ended; its folder goes with it
        pass


#: Folders of savers whose session still runs, for the end of the program.
_left: dict[str, SparkSession] = {}


@atexit.register
def _remove_left() -> None:
    for path, spark in list(_left.items()):
        _remove(spark, path)


class Saver:
    """Writes DataFrames to the shared checkpoint folder and reads them back.

    This cuts lineage in a form that outlives executors. ``drop`` removes what no
    later step reads; what a result still reads goes at the end of the program.
    """

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark, self.base, self.count = spark, f"{checkpoint_dir(spark)}/quire-{uuid.uuid4().hex}", itertools.count()
        self.paths: dict[int, str] = {}
        _left[self.base] = spark

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{next(self.count)}"
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(saved)] = path
        return saved

    def drop(self, *saved: DataFrame) -> None:
        for df in saved:
            _remove(self.spark, self.paths.pop(id(df)))


def saver(spark: SparkSession) -> Saver:
    return Saver(spark)
