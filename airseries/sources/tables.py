"""Table scans and sinks (S5-S10): parquet tables with versioned atomic
overwrite, appends, CSV export/import.

A version is published by a pointer record that is created only if no other writer has
created it (``claim``). ``overwrite_table`` replaces whatever is there and takes the next
free number; ``update_table`` changes what is there: its transition is replayed on the
newer version when another writer was first, so concurrent updates are all kept. A
version is one folder, or a manifest that names a folder per day (``overwrite_days``,
``replace_days``): replacing days writes those days only. Readers see a version whole.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

CURRENT = "_current"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, by the file system that owns it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


_POINTER = "path string, seq long, written_at string, manifest boolean"
#: How often an update is replayed on a newer version before it gives up.
RETRIES = 20


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with its whole text, unless it exists: of several writers one gets True.

    The text is written beside it and moved in one step that fails on an existing file: a
    hard link on a local file system, a rename without overwrite elsewhere (atomic where
    the file system's rename is)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    draft = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            jvm.java.nio.file.Files.createLink(*[jvm.java.io.File(p.toUri().getPath()).toPath() for p in (at, draft)])
        else:
            keep = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
            keep[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(draft, at, keep)
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(draft, False)


def _pointer(spark: SparkSession, base: str):
    """The newest pointer (path, seq, manifest), None for a table without versions. A pointer
    folder that is there but cannot be read is an error, never "no version"."""
    if not exists(spark, f"{base}/{CURRENT}"):
        return None
    row = spark.read.schema(_POINTER).option("mode", "FAILFAST").json(f"{base}/{CURRENT}").orderBy(
        F.desc_nulls_last("seq"), F.desc("path")).first()
    if row is None or row["path"] is None:
        raise RuntimeError(f"{base}: the version pointer is empty")
    return row


def _publish(spark: SparkSession, base: str, path: str, seq: int, manifest: bool = False) -> bool:
    """Make a written version the ``seq``-th one; False if another writer has made its own."""
    text = json.dumps({"path": path, "seq": seq, "written_at": dt.datetime.now(dt.timezone.utc).isoformat(), "manifest": manifest})
    return claim(spark, f"{base}/{CURRENT}/v{seq:012d}.json", text)


def _publish_next(spark: SparkSession, base: str, path: str, manifest: bool = False) -> None:
    """Publish a replacement of everything: after whatever version is the newest by then."""
    while True:
        now = _pointer(spark, base)
        if _publish(spark, base, path, (now["seq"] or 0) + 1 if now else 1, manifest):
            return


def _read_version(spark: SparkSession, pointer) -> DataFrame:
    if not pointer["manifest"]:
        return spark.read.parquet(pointer["path"])
    days = spark.read.parquet(pointer["path"])
    paths = [r["path"] for r in days.select("path").distinct().collect()]  # one entry a day
    schema = spark.read.parquet(f"{pointer['path']}-schema").schema
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, require_rows: bool = True) -> DataFrame:
    """Scan a table (its current version when versioned); error if empty."""
    pointer = _pointer(spark, path)
    df = _read_version(spark, pointer) if pointer else spark.read.parquet(path)
    if require_rows and df.isEmpty():
        raise RuntimeError(f"table {path} is empty")
    return df


def _new_version(base: str, version: str | None = None) -> str:
    return version or dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:8]


def overwrite_table(df: DataFrame, base: str, partition_by=None, version: str | None = None) -> str:
    """Replace-all without a window where the table is missing: write a
    new version directory, then publish a pointer record naming it (readers
    take the pointer with the highest sequence number, which does not depend
    on any writer's clock). Older versions stay until cleaned up."""
    path = f"{base}/v={_new_version(base, version)}"
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)
    _publish_next(df.sparkSession, base, path)
    return path


def update_table(spark: SparkSession, base: str, transition: Callable[[DataFrame | None], DataFrame]) -> DataFrame:
    """Read, change, publish, without losing another writer's change: ``transition`` gets the
    current version (None for a table without one) and gives the next; if another
    version was published meanwhile it is run again on that one. Returns what was published."""
    for _ in range(RETRIES):
        now = _pointer(spark, base)
        if now is None and exists(spark, base) and not _only_drafts(spark, base):
            raise RuntimeError(f"{base} holds files but no version")
        df = transition(_read_version(spark, now) if now else None)
        path = f"{base}/v={_new_version(base)}"
        df.write.mode("errorifexists").parquet(path)
        if _publish(spark, base, path, (now["seq"] or 0) + 1 if now else 1):
            return spark.read.parquet(path)
        _delete(spark, path)  # never published
    raise RuntimeError(f"{base}: {RETRIES} other versions came first")


def _only_drafts(spark: SparkSession, base: str) -> bool:
    """Whether a folder holds nothing but versions that were never published."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    listed = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return all(f.getPath().getName().startswith(("v=", "_", ".")) for f in listed)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _write_days(df: DataFrame, base: str, order: str) -> tuple[str, DataFrame]:
    """Rows in one folder a day, and the manifest rows (day, path) of the days that have any."""
    path = f"{base}/v={_new_version(base)}"
    day = F.coalesce(F.to_date(F.col(order)).cast("string"), F.lit("none"))
    df.withColumn("_day", day).write.mode("errorifexists").partitionBy("_day").parquet(path)
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    names = [f.getPath().getName() for f in listed if f.isDirectory()]
    rows = [(n.split("=", 1)[1], f"{path}/{n}") for n in names if n.startswith("_day=")]
    return path, spark.createDataFrame(rows, "day string, path string")


def _publish_days(days: DataFrame, schema_of: DataFrame, base: str, seq: int | None) -> bool:
    """Write a manifest and publish it: as the ``seq``-th version, or after whatever is newest."""
    spark = days.sparkSession
    path = f"{base}/_manifests/{_new_version(base)}"
    days.coalesce(1).write.mode("errorifexists").parquet(path)
    schema_of.limit(0).write.mode("errorifexists").parquet(f"{path}-schema")
    if seq is None:
        _publish_next(spark, base, path, manifest=True)
        return True
    return _publish(spark, base, path, seq, manifest=True)


def overwrite_days(df: DataFrame, base: str, order: str = "datetime") -> None:
    """Replace-all as a manifest of day folders (rows without a time have a folder of their own)."""
    _, days = _write_days(df, base, order)
    _publish_days(days, df, base, None)


def replace_days(spark: SparkSession, base: str, build: Callable[[DataFrame], tuple[DataFrame, list[str]]],
                 order: str = "datetime") -> int:
    """A version in which some days are written anew and all others are the folders they were.

    ``build`` gets the current version and gives the rows of the days it replaces and the
    names of those days; it is run again if another version was published meanwhile. A table
    that is one folder is read as it is and becomes a manifest. Returns the days written."""
    for _ in range(RETRIES):
        now = _pointer(spark, base)
        old = _read_version(spark, now)
        rows, touched = build(old)
        if now["manifest"]:
            days = spark.read.parquet(now["path"])
        else:
            untouched = old.where(~F.coalesce(F.to_date(F.col(order)).cast("string"), F.lit("none")).isin(touched))
            _, days = _write_days(untouched, base, order)
        path, fresh = _write_days(rows.select(*old.columns), base, order)
        kept = days.where(~F.col("day").isin(touched)) if touched else days
        if _publish_days(kept.unionByName(fresh), old, base, (now["seq"] or 0) + 1):
            return fresh.count()
        _delete(spark, path)
    raise RuntimeError(f"{base}: {RETRIES} other versions came first")


def append_table(df: DataFrame, path: str, partition_by=None) -> None:
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)


def enrich_features(df: DataFrame, city: str, created_at) -> DataFrame:
    """Leading ``city``, ``datetime``, ``aqi`` defaults, then the row's
    own columns (which override the defaults, NULL included), then
    ``created_at``."""
    lead = [F.col("city") if "city" in df.columns else F.lit(city).alias("city"),
            F.col("datetime") if "datetime" in df.columns else F.lit(None).cast("timestamp_ntz").alias("datetime"),
            F.col("aqi") if "aqi" in df.columns else F.lit(None).cast("double").alias("aqi")]
    rest = [F.col(c) for c in df.columns if c not in ("city", "datetime", "aqi", "created_at")]
    return df.select(*lead, *rest, F.lit(created_at).cast("timestamp_ntz").alias("created_at"))


def forecast_documents(forecasts: DataFrame, key=("series_id", "horizon", "model_version", "generated_at")) -> DataFrame:
    """Nest flat forecasts into one document per run with
    ``predictions: array<struct<datetime, predicted_aqi>>`` ordered by time
    (a document holds one run's horizon, so its array is bounded)."""
    key = list(key)
    return forecasts.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("datetime", "predicted_aqi"))).alias("predictions"))


def unnest_documents(docs: DataFrame) -> DataFrame:
    rest = [c for c in docs.columns if c != "predictions"]
    return docs.select(*rest, F.inline("predictions"))


def flat_forecasts(pred: DataFrame, horizon: int, generated_at) -> DataFrame:
    """``datetime, predicted_aqi`` plus ``horizon`` and ``generated_at``."""
    return pred.select("datetime", "predicted_aqi").withColumns(
        {"horizon": F.lit(horizon), "generated_at": F.lit(generated_at).cast("timestamp_ntz")})


def export_csv(df: DataFrame, path: str) -> None:
    """Header row, no index column."""
    df.write.mode("overwrite").option("header", True).csv(path)


def import_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """With a schema (production) or with inference (exploration)."""
    r = spark.read.option("header", True)
    return r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)


def append_features(df: DataFrame, path: str, city: str, created_at, partition_by=None) -> None:
    """Enrich (``enrich_features``) and append to the feature table."""
    append_table(enrich_features(df, city, created_at), path, partition_by)
