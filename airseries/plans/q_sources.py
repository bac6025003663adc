"""Queries for payload sources, backfill plans, forecast documents and joins
(S1-S3, S8, J1-J3)."""

from pyspark.sql import functions as F

from airseries.operators import joins as J
from airseries.operators.features import latest_rows, tail_rows
from airseries.plans import fixtures as fx
from airseries.plans.catalog import register
from airseries.sources import payload as PL
from airseries.sources import tables as TB


@register("s1_flatten_hourly", fx.ctes("readings") + "SELECT series_id, datetime, pm2_5, pm10 FROM readings")
def s1_flatten_hourly(spark, sf_dir):
    pay = PL.to_payload(fx.readings(spark, sf_dir), ["pm2_5", "pm10"])
    return PL.flatten_hourly(pay, ["pm2_5", "pm10"], keep=["series_id"])


@register("s2_flatten_variable_list", fx.ctes("readings") + """
SELECT series_id, CAST(datetime AS DATE) AS day, datetime, pm10, CAST(NULL AS DOUBLE) AS ozone FROM readings""")
def s2_flatten_variable_list(spark, sf_dir):
    pay = PL.to_payload(fx.readings(spark, sf_dir), ["pm2_5", "pm10"])
    return PL.flatten_hourly(pay, ["pm10", "ozone"])


@register("s3_plan_backfill", fx.ctes("readings") + """,
rng AS (SELECT series_id, CAST(min(datetime) AS DATE) AS start, CAST(max(datetime) AS DATE) AS "end"
        FROM readings GROUP BY 1)
SELECT series_id, CAST(chunk AS INTEGER) AS chunk, CAST(chunk_start AS DATE) AS chunk_start,
       least(CAST(chunk_start AS DATE) + 10, "end") AS chunk_end
FROM (SELECT series_id, "end",
             unnest(generate_series(CAST(start AS TIMESTAMP), CAST("end" AS TIMESTAMP) - INTERVAL 1 DAY,
                                    INTERVAL 11 DAY)) AS chunk_start,
             generate_subscripts(generate_series(CAST(start AS TIMESTAMP), CAST("end" AS TIMESTAMP) - INTERVAL 1 DAY,
                                    INTERVAL 11 DAY), 1) - 1 AS chunk
      FROM rng WHERE start < "end")""")
def s3_plan_backfill(spark, sf_dir):
    r = fx.readings(spark, sf_dir).groupBy("series_id").agg(
        F.to_date(F.min("datetime")).alias("start"), F.to_date(F.max("datetime")).alias("end"))
    return PL.plan_backfill(r)


@register("s8_forecast_documents", fx.ctes("readings") + """
SELECT series_id, 1 AS horizon, 'persistence_h1' AS model_version, CAST(date_trunc('day', datetime) AS TIMESTAMP) AS generated_at,
       CAST(row_number() OVER (PARTITION BY series_id, date_trunc('day', datetime) ORDER BY datetime) - 1 AS INTEGER) AS position,
       datetime + INTERVAL 24 HOUR AS datetime, pm2_5 AS predicted_aqi
FROM readings""")
def s8_forecast_documents(spark, sf_dir):
    """A document per series and day of generation (24 hourly values at most),
    unnested with each value's place in its document."""
    r = fx.readings(spark, sf_dir)
    flat = r.select("series_id", F.lit(1).alias("horizon"), F.lit("persistence_h1").alias("model_version"),
                    F.to_date("datetime").cast("timestamp_ntz").alias("generated_at"),
                    (F.col("datetime") + F.expr("INTERVAL 24 HOURS")).alias("datetime"),
                    F.col("pm2_5").alias("predicted_aqi"))
    docs = TB.forecast_documents(flat)
    rest = [c for c in docs.columns if c != "predictions"]
    return docs.select(*rest, F.posexplode("predictions").alias("position", "_p")).select(*rest, "position", "_p.*")


@register("j1_align_weather", fx.ctes("readings", "weather") + """
SELECT r.series_id, r.datetime, r.pm2_5, w.temperature_2m
FROM readings r LEFT JOIN weather w ON r.series_id = w.series_id AND r.datetime = w.datetime""")
def j1_align_weather(spark, sf_dir):
    r = fx.readings(spark, sf_dir).select("series_id", "datetime", "pm2_5")
    return J.align_weather(r, fx.weather(spark, sf_dir))


@register("j2_union_history_forecast", fx.ctes("history") + """
SELECT series_id, datetime, pm2_5, pm10, false AS is_forecast FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY datetime DESC) AS rn FROM history) WHERE rn <= 24
UNION ALL
SELECT series_id, datetime, NULL AS pm2_5, pm10, true AS is_forecast FROM future""")
def j2_union_history_forecast(spark, sf_dir):
    h = tail_rows(fx.history(spark, sf_dir).select("series_id", "datetime", "pm2_5", "pm10"), 24)
    f = fx.future(spark, sf_dir).select("series_id", "datetime", "pm10")
    return J.union_history_forecast(h, f)


@register("j3_feature_model_grid", fx.ctes("readings", "registry") + """
SELECT l.series_id, l.datetime, l.pm2_5, m.horizon, m.model_name, m.artifact
FROM (SELECT series_id, max(datetime) AS datetime, arg_max(pm2_5, datetime) AS pm2_5 FROM readings GROUP BY 1) l
JOIN (SELECT horizon, arg_min(model_name, rmse) AS model_name, arg_min(artifact, rmse) AS artifact
      FROM registry WHERE is_best GROUP BY 1) m ON true""")
def j3_feature_model_grid(spark, sf_dir):
    latest = latest_rows(fx.readings(spark, sf_dir).select("series_id", "datetime", "pm2_5"))
    reg = fx.registry(spark, sf_dir).filter(F.col("is_best"))
    best = reg.groupBy("horizon").agg(F.min_by(F.struct("model_name", "artifact"), "rmse").alias("m")) \
              .select("horizon", "m.*")
    return J.feature_model_grid(latest, best, [1, 2, 3]) \
            .select("series_id", "datetime", "pm2_5", "horizon", "model_name", "artifact")


# ---- streaming landing -------------------------------------------------------------

from airseries.plans.sqlgen import aqi_sql, cat6_sql  # noqa: E402


@register("st1_stream_hourly_readings", fx.ctes("readings") + f"""
SELECT series_id, datetime, pm2_5, pm10, nitrogen_dioxide, aqi_pm25, {cat6_sql('aqi_pm25', 0)} AS category
FROM (SELECT *, {aqi_sql('pm2_5')} AS aqi_pm25 FROM readings)""")
def st1_stream_hourly_readings(spark, sf_dir):
    """Events streamed through the stateless hourly landing job (file source,
    availableNow trigger, idempotent foreachBatch sink)."""
    from airseries.streaming import land_events, merge_readings, score
    ev = fx.table(spark, sf_dir, "events")
    out = land_events(spark, sf_dir, ev.schema, glob="events.parquet")
    return score(merge_readings(spark, f"{out}/data"))


# ---- sinks round-tripped through the shared folder ------------------------------------

import uuid  # noqa: E402

from airseries.plans.sqlgen import sround  # noqa: E402
from airseries.sources import registry_file as RF  # noqa: E402

GEN_AT = "2024-02-01 00:00:00"


def _scratch(spark, name):
    from airseries.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex[:12]}"


@register("s6_versioned_overwrite_read", fx.ctes("readings") + "SELECT * REPLACE (pm2_5 + 1 AS pm2_5) FROM readings")
def s6_versioned_overwrite_read(spark, sf_dir):
    """Two versions of the whole table written, the second with changed values;
    the reader resolves the newest pointer."""
    base = _scratch(spark, "readings")
    r = fx.readings(spark, sf_dir)
    TB.overwrite_table(r, base, version="v1")
    TB.overwrite_table(r.withColumn("pm2_5", F.col("pm2_5") + 1), base, version="v2")
    return TB.read_table(spark, base)


@register("s7_enrich_features", fx.ctes("readings") + f"""
SELECT 'Anytown' AS city, datetime, CAST(NULL AS DOUBLE) AS aqi, series_id, pm2_5, pm10, nitrogen_dioxide,
       TIMESTAMP '{GEN_AT}' AS created_at FROM readings""")
def s7_enrich_features(spark, sf_dir):
    return TB.enrich_features(fx.readings(spark, sf_dir), "Anytown", GEN_AT)


@register("s7_append_features", fx.ctes("readings") + "\nUNION ALL\n".join(f"""
SELECT 'Anytown' AS city, datetime, CAST(NULL AS DOUBLE) AS aqi, series_id, pm2_5, pm10, nitrogen_dioxide,
       TIMESTAMP '{at}' AS created_at FROM readings WHERE {cond}""" for at, cond in (
    (GEN_AT, "datetime < TIMESTAMP '2024-01-15'"), ("2024-02-02 00:00:00", "datetime >= TIMESTAMP '2024-01-15'"))))
def s7_append_features(spark, sf_dir):
    """Two appends to the feature table, read back."""
    r = fx.readings(spark, sf_dir)
    path = _scratch(spark, "features")
    first = F.col("datetime") < F.lit("2024-01-15").cast("timestamp_ntz")
    TB.append_features(r.where(first), path, "Anytown", GEN_AT)
    TB.append_features(r.where(~first), path, "Anytown", "2024-02-02 00:00:00")
    return TB.read_table(spark, path)


@register("s9_flat_forecasts", fx.ctes("readings") + f"""
SELECT datetime + INTERVAL 72 HOUR AS datetime, pm2_5 AS predicted_aqi, 3 AS horizon,
       TIMESTAMP '{GEN_AT}' AS generated_at FROM readings""")
def s9_flat_forecasts(spark, sf_dir):
    r = fx.readings(spark, sf_dir)
    pred = r.select((F.col("datetime") + F.expr("INTERVAL 72 HOURS")).alias("datetime"),
                    F.col("pm2_5").alias("predicted_aqi"))
    return TB.flat_forecasts(pred, 3, GEN_AT)


@register("s10_csv_round_trip", fx.ctes("readings") + "SELECT * FROM readings")
def s10_csv_round_trip(spark, sf_dir):
    path = _scratch(spark, "csv")
    r = fx.readings(spark, sf_dir)
    TB.export_csv(r, path)
    return TB.import_csv(spark, path, schema=r.schema)


@register("s11_registry_file_round_trip", fx.ctes("registry") + f"""
SELECT model_name, CAST(horizon * 24 AS INTEGER) AS horizon_hours, {sround('rmse', 2, True)} AS rmse,
       {sround('r2', 3, True)} AS r2, CASE WHEN status = 'production' THEN 'active' ELSE 'inactive' END AS status,
       '{GEN_AT.replace(' ', 'T')}' AS trained_at
FROM registry""")
def s11_registry_file_round_trip(spark, sf_dir):
    import datetime as dt
    path = _scratch(spark, "registry-file")
    reg = fx.registry(spark, sf_dir).withColumn("horizon_hours", F.col("horizon") * 24)
    at = dt.datetime.fromisoformat(GEN_AT)
    RF.append_entries(RF.entries(reg.filter(F.col("status") == "production"), "active", at), path)
    RF.append_entries(RF.entries(reg.filter(F.col("status") != "production"), "inactive", at), path)
    return RF.read_entries(spark, path).drop("position", "features")


@register("s11_r9_load_active_after_appends", fx.ctes("registry") + f""",
f AS (SELECT model_name, CAST(horizon * 24 AS INTEGER) AS horizon_hours, {sround('rmse', 2, True)} AS rmse,
             ascii(model_name) % 4 AS nth FROM registry)
SELECT horizon_hours, arg_max(model_name, lpad(CAST(nth AS VARCHAR), 2, '0') || model_name) AS model_name,
       arg_max(rmse, lpad(CAST(nth AS VARCHAR), 2, '0') || model_name) AS rmse
FROM f GROUP BY 1""")
def s11_r9_load_active_after_appends(spark, sf_dir):
    """Four appends to the file registry, read back: the entry appended last wins."""
    import datetime as dt
    from airseries.operators import registry as R
    path = _scratch(spark, "registry-appends")
    reg = fx.registry(spark, sf_dir).withColumn("horizon_hours", F.col("horizon") * 24)
    for n in range(4):
        part = reg.filter(F.ascii("model_name") % 4 == n)
        RF.append_entries(RF.entries(part, "active", dt.datetime.fromisoformat(GEN_AT)), path)
    return R.load_active(RF.read_entries(spark, path)).select("horizon_hours", "model_name", "rmse")


@register("s4_land_chunks_round_trip", fx.ctes("readings") + "SELECT series_id, datetime, pm2_5, pm10 FROM readings")
def s4_land_chunks_round_trip(spark, sf_dir):
    """Daily payload documents written as JSON (plus one empty chunk per
    series without ``hourly``), landed back with one scan."""
    from pyspark.sql import types as T
    path = _scratch(spark, "payloads")
    pay = PL.to_payload(fx.readings(spark, sf_dir), ["pm2_5", "pm10"])
    empty = pay.select("series_id", "day", F.lit(None).cast(pay.schema["hourly"].dataType).alias("hourly")) \
               .dropDuplicates(["series_id"])
    pay.unionByName(empty).write.json(path)
    extra = T.StructType([T.StructField("series_id", T.StringType())])
    return PL.land_chunks(spark, path, ["pm2_5", "pm10"], extra, multiline=False)


from airseries.plans.catalog import ORACLE as _ORACLE  # noqa: E402


@register("j1_align_weather_checked_broadcast", _ORACLE["j1_align_weather"])
def j1_align_weather_checked_broadcast(spark, sf_dir):
    """J1 with the weather side broadcast only behind a row-count check."""
    r = fx.readings(spark, sf_dir).select("series_id", "datetime", "pm2_5")
    return J.align_weather(r, fx.weather(spark, sf_dir), broadcast_max_rows=1_000_000)
