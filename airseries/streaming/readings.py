"""Structured Streaming landing of hourly readings.

Readings are maxima and minima per (series, hour), which merge exactly, so the
stream keeps no state and needs no watermark: each micro-batch is aggregated
by itself inside ``foreachBatch`` and its partial readings are merged when read.
No event is late: the landed readings do not depend on how the files fall
into batches.

A micro-batch overwrites its own ``batch=<id>`` directory, so a retried batch
replaces its own output (idempotent). ``compact_readings`` folds all batches so
far into one table, so that reading does not grow with the number of batches
ever landed. Checkpoints and outputs live under the cluster's
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from airseries.functions.aqi import aqi_pm25, classify_aqi
from airseries.functions.calendar import hour_floor
from airseries.sources.tables import exists, overwrite_table, read_table

def hourly_readings(events: DataFrame, key: str = "event_type", ts: str = "ts", value: str = "value") -> DataFrame:
    """Events -> one reading per (series, hour): max/min of the value and the
    max of the ``k`` property. Partial aggregates of the same hour merge."""
    return events.groupBy(F.col(key).alias("series_id"), hour_floor(ts).alias("datetime")).agg(
        F.max(value).alias("pm2_5"), F.min(value).alias("pm10"),
        F.max(F.get_json_object("props", "$.k").cast("int")).alias("nitrogen_dioxide"))


def score(readings: DataFrame) -> DataFrame:
    """Row-wise AQI index and category; valid on batch and streaming frames."""
    return (readings.withColumn("aqi_pm25", aqi_pm25("pm2_5"))
                    .withColumn("category", classify_aqi("aqi_pm25")["category"]))


def batch_writer(path: str):
    """foreachBatch function: the readings of a micro-batch overwrite ``path/batch=<id>``."""
    def write(df: DataFrame, batch_id: int) -> None:
        hourly_readings(df).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


# How each landed column merges across emissions of the same (series, hour).
READING_MERGE = {"pm2_5": F.max, "pm10": F.min, "nitrogen_dioxide": F.max}


def merge_readings(spark: SparkSession, path: str, keys=("series_id", "datetime"),
                   merge: dict | None = None) -> DataFrame:
    """Exact readings of everything landed: each column merged with its own
    aggregate (max of maxima, min of minima) over the batches behind the last
    compaction and, if there is one, the compacted table."""
    merge = merge or READING_MERGE
    cols = [*keys, *merge]
    df, done = spark.read.parquet(path), f"{path}-compacted"
    if exists(spark, done):
        upto, base = _compacted(spark, done)
        df = df.where(F.col("batch") > upto).select(*cols).unionByName(base.select(*cols))
    return df.groupBy(*keys).agg(*[fn(c).alias(c) for c, fn in merge.items()])


def _compacted(spark: SparkSession, done: str) -> tuple[int, DataFrame]:
    base = read_table(spark, done, require_rows=False)
    return base.agg(F.max("upto")).first()[0], base


def compact_readings(spark: SparkSession, path: str) -> None:
    """Folds all batches landed so far into a new version of the compacted table;
    the batch folders stay (a retried batch may still be rewritten)."""
    last = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    overwrite_table(merge_readings(spark, path).withColumn("upto", F.lit(last).cast("long")), f"{path}-compacted")


def stream_dir(spark: SparkSession, name: str) -> str:
    from airseries.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex[:12]}"


def land_events(spark: SparkSession, events_dir: str, schema, out: str | None = None,
                max_files_per_trigger: int | None = None, glob: str | None = None) -> str:
    """Run the landing stream over everything available now and return the
    output folder; read ``<out>/data`` with ``merge_readings`` (then ``score``)."""
    out = out or stream_dir(spark, "readings")
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    q = (reader.parquet(events_dir).writeStream.foreachBatch(batch_writer(f"{out}/data"))
               .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return out
