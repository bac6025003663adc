"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airseries.session import ensure_checkpoint_dir, ship_package


def prepare(spark: SparkSession) -> None:
    """Make the package importable in Python workers and the shared folder known."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read again.

    Cuts the lineage with files every executor can read: a lost executor costs
    a re-read, never the rows."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """A text column with NULL read as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


_HELD: dict = {}


def hold(owner: str, forget) -> None:
    """Called when a task starts: what this reused worker remembers of other operators is let go,
    ``forget`` being how to do so with the caller's own memory later."""
    if others := [o for o in _HELD if o != owner]:
        for other in others:
            _HELD.pop(other)()
        gc.collect()
        let_go()
    _HELD[owner] = forget


def let_go() -> None:
    """Hands what a worker has freed back to the system: workers wait for their next task with it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


class Scratch:
    """Intermediate tables of one operator; ``drop`` deletes them once they have been read for the last time."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        ensure_checkpoint_dir(self.spark)
        path = f"{self.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes the tables of these names (all, if none is given)."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        gone = [p for p in self.paths if not names or p.rsplit("/", 1)[1].rsplit("-", 1)[0] in names]
        for p in gone:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
            self.paths.remove(p)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished exchanges now, not at its next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
