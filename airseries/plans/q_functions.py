"""Queries for scalar functions."""

from pyspark.sql import functions as F

from airseries.functions import aqi as A
from airseries.functions import calendar as C
from airseries.functions import transforms as T
from airseries.operators.features import latest_rows
from airseries.plans import fixtures as fx
from airseries.plans.catalog import register
from airseries.plans.sqlgen import (advisory_sql, aqi_sql, cat5_sql, cat6_sql, r6, sround)


@register("m1_aqi_pm25_raw", f"""
SELECT event_id, value AS pm2_5, {aqi_sql('value')} AS aqi FROM events""")
def m1_aqi_pm25_raw(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events")
    return ev.select("event_id", F.col("value").alias("pm2_5"), A.aqi_pm25("value").alias("aqi"))


@register("m2_add_aqi_column", fx.ctes("readings") + f"""
SELECT series_id, datetime, pm2_5, {aqi_sql('pm2_5')} AS aqi_pm25 FROM readings""")
def m2_add_aqi_column(spark, sf_dir):
    r = fx.readings(spark, sf_dir).select("series_id", "datetime", "pm2_5")
    return A.add_aqi_column(r)


@register("m3_classify_aqi", fx.ctes("readings") + f"""
SELECT series_id, datetime, aqi, {cat6_sql('aqi', 0)} AS category, {cat6_sql('aqi', 1)} AS symbol
FROM (SELECT series_id, datetime, {aqi_sql('pm2_5')} AS aqi FROM readings)""")
def m3_classify_aqi(spark, sf_dir):
    r = fx.readings(spark, sf_dir).select("series_id", "datetime", A.aqi_pm25("pm2_5").alias("aqi"))
    return r.select("series_id", "datetime", "aqi", A.classify_aqi("aqi").alias("c")) \
            .select("series_id", "datetime", "aqi", "c.category", "c.symbol")


@register("m4_classify_aqi_5", fx.ctes("readings") + f"""
SELECT series_id, datetime, aqi, {cat5_sql('aqi')} AS category
FROM (SELECT series_id, datetime, {aqi_sql('pm2_5')} AS aqi FROM readings)""")
def m4_classify_aqi_5(spark, sf_dir):
    r = fx.readings(spark, sf_dir).select("series_id", "datetime", A.aqi_pm25("pm2_5").alias("aqi"))
    return r.withColumn("category", A.classify_aqi_5("aqi"))


@register("m5_advisory", fx.ctes("readings") + f"""
SELECT series_id, max_aqi, {advisory_sql('max_aqi')} AS advisory
FROM (SELECT series_id, max({aqi_sql('pm2_5')}) AS max_aqi FROM readings GROUP BY 1)""")
def m5_advisory(spark, sf_dir):
    r = fx.readings(spark, sf_dir)
    m = r.groupBy("series_id").agg(F.max(A.aqi_pm25("pm2_5")).alias("max_aqi"))
    return m.withColumn("advisory", A.advisory("max_aqi"))


@register("m6_time_features", fx.ctes("readings") + """
SELECT series_id, TRY_CAST(ts_text AS TIMESTAMP) AS datetime,
       CAST(hour(TRY_CAST(ts_text AS TIMESTAMP)) AS INTEGER) AS hour,
       CAST(day(TRY_CAST(ts_text AS TIMESTAMP)) AS INTEGER) AS day,
       CAST(month(TRY_CAST(ts_text AS TIMESTAMP)) AS INTEGER) AS month,
       CAST(isodow(TRY_CAST(ts_text AS TIMESTAMP)) - 1 AS INTEGER) AS dayofweek
FROM (SELECT series_id,
             CASE WHEN nitrogen_dioxide % 10 = 0 THEN 'not a time'
                  ELSE strftime(datetime, '%Y-%m-%dT%H:%M') END AS ts_text
      FROM readings)""")
def m6_time_features(spark, sf_dir):
    r = fx.readings(spark, sf_dir)
    txt = (F.when(F.col("nitrogen_dioxide") % 10 == 0, F.lit("not a time"))
            .otherwise(F.date_format("datetime", "yyyy-MM-dd'T'HH:mm")))
    s = r.select("series_id", txt.alias("datetime"))
    return C.add_time_features(s, "datetime")


@register("m7_extra_calendar", fx.ctes("readings") + """
SELECT series_id, datetime, CAST(day(datetime) AS INTEGER) AS day_of_month,
       CAST(weekofyear(datetime) AS INTEGER) AS week_of_year FROM readings""")
def m7_extra_calendar(spark, sf_dir):
    r = fx.readings(spark, sf_dir).select("series_id", "datetime")
    return C.add_time_features(r, "datetime", parts=("day_of_month", "week_of_year"))


def _cyc(part, period, name):
    return (f"{r6(f'sin(2 * pi() / {period} * CAST({part} AS DOUBLE))')} AS {name}_sin, "
            f"{r6(f'cos(2 * pi() / {period} * CAST({part} AS DOUBLE))')} AS {name}_cos")


@register("m8_cyclical", fx.ctes("readings") + f"""
SELECT series_id, datetime, {_cyc('hour(datetime)', 24, 'hour')}, {_cyc('isodow(datetime) - 1', 7, 'dow')},
       {_cyc('month(datetime)', 12, 'month')}
FROM readings""")
def m8_cyclical(spark, sf_dir):
    r = fx.readings(spark, sf_dir).select("series_id", "datetime")
    out = C.cyclical(r, "datetime", which=("hour", "dow", "month"))
    return out.select("series_id", "datetime",
                      *[F.round(c, 6).alias(c) for c in out.columns if c.endswith(("_sin", "_cos"))])


@register("m9_interactions", fx.ctes("readings") + f"""
SELECT series_id, datetime, {r6('pm2_5 * pm10')} AS pm2_5_x_pm10,
       {r6('pm2_5 * nitrogen_dioxide')} AS pm2_5_x_nitrogen_dioxide FROM readings""")
def m9_interactions(spark, sf_dir):
    r = fx.readings(spark, sf_dir)
    out = T.add_interactions(r, [("pm2_5", "pm10"), ("pm2_5", "nitrogen_dioxide")])
    return out.select("series_id", "datetime",
                      *[F.round(c, 6).alias(c) for c in ("pm2_5_x_pm10", "pm2_5_x_nitrogen_dioxide")])


@register("m10_inverse_log", fx.ctes("readings") + f"""
SELECT series_id, datetime, {r6('exp(ln(1 + pm2_5)) - 1')} AS pm2_5_back,
       {r6('exp(pm10 / 100) - 1')} AS expm1_pm10 FROM readings""")
def m10_inverse_log(spark, sf_dir):
    r = fx.readings(spark, sf_dir)
    return r.select("series_id", "datetime",
                    F.round(T.inverse_log(F.log1p("pm2_5")), 6).alias("pm2_5_back"),
                    F.round(T.inverse_log(F.col("pm10") / 100), 6).alias("expm1_pm10"))


@register("m11_forecast_date_round", fx.ctes("readings") + f"""
SELECT series_id, h AS horizon, {sround('pm2_5 * CAST(0.5 AS DOUBLE) + pm10 * CAST(0.25 AS DOUBLE)', 2, True)} AS value,
       strftime(CAST(datetime AS DATE) + h, '%Y-%m-%d') AS date
FROM (SELECT series_id, arg_max(pm2_5, datetime) AS pm2_5, arg_max(pm10, datetime) AS pm10,
             max(datetime) AS datetime FROM readings GROUP BY 1),
     (SELECT unnest([1, 2, 3]) AS h)""")
def m11_forecast_date_round(spark, sf_dir):
    last = latest_rows(fx.readings(spark, sf_dir))
    grid = last.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in (1, 2, 3)])))
    return grid.select("series_id", "horizon",
                       T.round_prediction(F.col("pm2_5") * 0.5 + F.col("pm10") * 0.25).alias("value"),
                       T.forecast_date(F.col("datetime"), "horizon").alias("date"))


@register("m12_model_version", fx.ctes("registry") + """
SELECT model_name, horizon,
       coalesce(CASE WHEN status = 'production' THEN 'v_' || run_id END,
                model_name || '_h' || CAST(horizon AS VARCHAR)) AS model_version,
       strftime(registered_at, '%Y-%m-%d_%H-%M-%S') AS stamp
FROM registry""")
def m12_model_version(spark, sf_dir):
    reg = fx.registry(spark, sf_dir)
    stored = F.when(F.col("status") == "production", F.concat(F.lit("v_"), F.col("run_id")))
    return reg.select("model_name", "horizon",
                      T.model_version(stored, "model_name", "horizon").alias("model_version"),
                      T.version_stamp("registered_at").alias("stamp"))


@register("m13_strength_flag", fx.ctes("registry") + """
SELECT model_name, horizon, r2, coalesce(r2, 0) > 0.8 AS strong FROM registry""")
def m13_strength_flag(spark, sf_dir):
    reg = fx.registry(spark, sf_dir)
    return reg.select("model_name", "horizon", "r2", T.strength_flag("r2").alias("strong"))
