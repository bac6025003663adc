"""Columnar hourly payloads (``hourly{time[], <var>[]...}``) <-> rows, and
the backfill chunk plan (S1-S4)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

TIME_FORMAT = "yyyy-MM-dd'T'HH:mm"


def payload_schema(variables, extra: T.StructType | None = None) -> T.StructType:
    hourly = T.StructType([T.StructField("time", T.ArrayType(T.StringType()))] +
                          [T.StructField(v, T.ArrayType(T.DoubleType())) for v in variables])
    fields = list(extra.fields) if extra else []
    return T.StructType(fields + [T.StructField("hourly", hourly)])


def flatten_hourly(df: DataFrame, variables=None, keep=None) -> DataFrame:
    """One row per array position: ``time`` parsed to ``datetime``
    (TIMESTAMP_NTZ; unparseable -> NULL), arrays aligned by position
    (shorter arrays pad with NULL), NaN -> NULL. A requested variable whose
    member array is missing becomes a typed NULL column. Rows whose
    ``hourly`` is NULL produce nothing."""
    if "hourly" not in df.columns:
        raise ValueError("payload has no 'hourly' member")
    present = df.schema["hourly"].dataType.fieldNames()
    variables = list(variables) if variables is not None else [f for f in present if f != "time"]
    keep = [c for c in (keep if keep is not None else df.columns) if c != "hourly"]
    have = [v for v in variables if v in present]
    # arrays_zip is NULL if any input is NULL: a member missing from one
    # payload becomes an empty array, i.e. NULL at every position.
    types = {f.name: f.dataType for f in df.schema["hourly"].dataType.fields}
    zipped = F.arrays_zip(F.col("hourly.time").alias("time"),
                          *[F.coalesce(F.col(f"hourly.{v}"), F.array().cast(types[v])).alias(v) for v in have])
    rows = df.filter(F.col("hourly").isNotNull()).select(*keep, F.inline(zipped))
    cols = [F.col(c) for c in keep] + [F.col("time").try_cast("timestamp_ntz").alias("datetime")]
    for v in variables:
        if v in have:
            x = F.col(v).cast("double")
            cols.append(F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x).alias(v))
        else:
            cols.append(F.lit(None).cast("double").alias(v))
    return rows.select(*cols)


def to_payload(readings: DataFrame, variables, key="series_id", order="datetime") -> DataFrame:
    """Rows -> one payload per (series, day), arrays ordered by time. The
    input is hourly readings, so a group is one series-day of at most 24
    rows and the collected arrays stay bounded whatever the table size."""
    day = F.to_date(F.col(order)).alias("day")
    g = readings.groupBy(key, day).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("t"), *[F.col(v) for v in variables]))).alias("_a"))
    def field(name):
        return lambda x: x[name]

    hourly = F.struct(F.transform("_a", lambda x: F.date_format(x["t"], TIME_FORMAT)).alias("time"),
                      *[F.transform("_a", field(v)).alias(v) for v in variables])
    return g.select(key, "day", hourly.alias("hourly"))


def read_payloads(spark: SparkSession, paths, variables, extra: T.StructType | None = None,
                  multiline: bool = True) -> DataFrame:
    """One ``read.json`` over all chunk files with an explicit schema
    (no inference pass); chunks without ``hourly`` are skipped; error if
    nothing was landed. ``multiline``: one document per file (API chunks)
    or JSON lines (many payloads per file)."""
    raw = spark.read.schema(payload_schema(variables, extra)).option("multiLine", multiline).json(paths)
    landed = raw.filter(F.col("hourly").isNotNull())
    if landed.limit(1).count() == 0:
        raise RuntimeError("no payload chunk holds hourly data")
    return flatten_hourly(landed, variables)


def plan_backfill(ranges: DataFrame, start: str = "start", end: str = "end", key="series_id",
                  span_days: int = 10) -> DataFrame:
    """S3: split each ``[start, end)`` into inclusive windows of up to
    ``span_days + 1`` days: ``chunk_end = least(chunk_start + span, end)``,
    next start = chunk_end + 1 day. Empty ranges give no rows."""
    step = span_days + 1
    r = ranges.filter(F.col(start) < F.col(end))
    starts = F.sequence(F.col(start), F.date_sub(F.col(end), 1), F.expr(f"INTERVAL {step} DAYS"))
    p = r.select(key, F.posexplode(starts).alias("chunk", "chunk_start"), F.col(end).alias("_end"))
    return p.select(key, "chunk", "chunk_start",
                    F.least(F.date_add("chunk_start", span_days), F.col("_end")).alias("chunk_end"))


def backfill_ranges(spark: SparkSession, series, days: int, today: dt.date) -> DataFrame:
    """Ranges ``[today - days, today)`` for a DataFrame of series ids."""
    return series.select("series_id", F.lit(today - dt.timedelta(days=days)).alias("start"),
                         F.lit(today).alias("end"))


def land_chunks(spark: SparkSession, paths, variables, extra: T.StructType | None = None,
                multiline: bool = True) -> DataFrame:
    """Stack every landed backfill chunk (one scan over all files);
    chunks without ``hourly`` are skipped, nothing landed is an error."""
    return read_payloads(spark, paths, variables, extra, multiline)
