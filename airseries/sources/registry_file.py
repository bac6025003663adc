"""JSON file registry. The reference keeps one JSON array rewritten on
every append; here each append writes JSON lines into a folder of its own below
the registry folder (no read-modify-write), and reads accept both layouts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

ENTRY_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("horizon_hours", T.IntegerType()),
    T.StructField("rmse", T.DoubleType()),
    T.StructField("r2", T.DoubleType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("status", T.StringType()),
    T.StructField("trained_at", T.StringType()),
])

_STORED = T.StructType([*ENTRY_SCHEMA.fields, T.StructField("seq", T.StructType([
    T.StructField("append", T.LongType()), T.StructField("n", T.LongType())]))])


def entries(df: DataFrame, status: str = "inactive", trained_at: dt.datetime | None = None) -> DataFrame:
    """Registry entries from metric rows: RMSE to 2 and R^2 to 3 digits."""
    ts = (trained_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).isoformat()
    return df.select("model_name", F.col("horizon_hours").cast("int"), F.bround("rmse", 2).alias("rmse"),
                     F.bround("r2", 3).alias("r2"), F.col("features"),
                     F.lit(status).alias("status"), F.lit(ts).alias("trained_at"))


def append_entries(df: DataFrame, path: str, order=("horizon_hours", "model_name")) -> None:
    """Append entries with an ascending ``seq``: the number of the append, then
    the place in it (by ``order``; the entries of one append are one training
    run's models, a handful)."""
    from airseries.sources.tables import claim, exists
    spark = df.sparkSession
    last = _stored(spark, path).agg(F.max("seq.append")).first()[0] if exists(spark, path) else None
    # every append has a number and a folder of its own, also when several run at once
    while not claim(spark, f"{path}/_appends/{(last or 0) + 1:012d}", ""):
        last = (last or 0) + 1
    nth = F.row_number().over(Window.orderBy(*[F.asc_nulls_last(c) for c in order]))
    numbered = df.select(*ENTRY_SCHEMA.fieldNames(), F.struct(
        F.lit((last or 0) + 1).cast("long").alias("append"), nth.cast("long").alias("n")).alias("seq"))
    numbered.write.mode("append").json(f"{path}/n{(last or 0) + 1:012d}")


def _stored(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """The entries of all appends, and of files written straight into the folder."""
    return spark.read.schema(_STORED).option("multiLine", multiline).option("recursiveFileLookup", True).json(path)


def read_entries(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Entries with a ``position`` that rises in the order they were appended, so
    "later entry wins" is well defined. Entries without a sequence (one JSON
    array written elsewhere) come first, by their place in the file."""
    df = _stored(spark, path, multiline)
    return df.withColumn("position", F.struct(
        F.coalesce(F.col("seq.append"), F.lit(0)).alias("append"),
        F.coalesce(F.col("seq.n"), F.monotonically_increasing_id()).alias("n"))).drop("seq")
