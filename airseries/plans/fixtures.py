"""Series fixtures derived from the ``events`` test table, in Spark and as the
matching DuckDB SQL (used by the oracle queries as CTEs).

Derivations use only exact aggregates (max, min, arg-min), so Spark and the
SQL oracle start from bit-identical inputs.
"""

from __future__ import annotations

from pyspark.sql import Window, DataFrame, SparkSession, functions as F

from airseries.functions.calendar import hour_floor
from airseries.plans.presets import TRAINING, TRAINING_FEATURES
from airseries.plans.sqlgen import sround

SPLIT_AT = "2024-01-28 00:00:00"

# Fixed coefficients of the literal linear model (forecast / attribution fixtures).
LINEAR_MODEL = {
    "intercept": 2.5,
    "hour": 0.125,
    "day": -0.25,
    "month": 0.5,
    "lag_1": 0.5,
    "lag_3": 0.125,
    "lag_6": 0.0625,
    "roll_mean_6": 0.25,
    "roll_mean_12": 0.0625,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ readings

def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return (ev.groupBy(F.col("event_type").alias("series_id"), hour_floor("ts").alias("datetime"))
              .agg(F.max("value").alias("pm2_5"), F.min("value").alias("pm10"),
                   F.max(F.get_json_object("props", "$.k").cast("int")).alias("nitrogen_dioxide")))


READINGS_SQL = """readings AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS datetime,
         max(value) AS pm2_5, min(value) AS pm10,
         max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS nitrogen_dioxide
  FROM events GROUP BY 1, 2)"""


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load-bench variant: one series per user, raw timestamps, event_id tie-break."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").cast("string").alias("series_id"), "event_id",
                     F.col("ts").alias("datetime"), F.col("value").alias("pm2_5"))


RAW_READINGS_SQL = """raw_readings AS (
  SELECT CAST(user_id AS VARCHAR) AS series_id, event_id, ts AS datetime, value AS pm2_5
  FROM events)"""


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather of all events, an hour later: hours without one before them have none."""
    ev = table(spark, sf_dir, "events")
    hour = hour_floor("ts") + F.expr("INTERVAL 1 HOUR")
    return (ev.groupBy(F.col("event_type").alias("series_id"), hour.alias("datetime"))
              .agg(F.max("value").alias("temperature_2m")))


WEATHER_SQL = """weather AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) + INTERVAL 1 HOUR AS datetime, max(value) AS temperature_2m
  FROM events GROUP BY 1, 2)"""


def history(spark, sf_dir):
    return readings(spark, sf_dir).filter(F.col("datetime") < F.lit(SPLIT_AT).cast("timestamp_ntz"))


def future(spark, sf_dir):
    return readings(spark, sf_dir).filter(F.col("datetime") >= F.lit(SPLIT_AT).cast("timestamp_ntz"))


HISTORY_SQL = f"""history AS (SELECT * FROM readings WHERE datetime < TIMESTAMP '{SPLIT_AT}'),
future AS (SELECT * FROM readings WHERE datetime >= TIMESTAMP '{SPLIT_AT}')"""


# ------------------------------------------------------------------ registry

def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate row per (event_type, user_id % 3 + 1)."""
    ev = table(spark, sf_dir, "events")
    g = (ev.groupBy(F.col("event_type").alias("model_name"),
                    (F.col("user_id") % 3 + 1).cast("int").alias("horizon"))
           .agg(F.max("value").alias("rmse"), F.min("value").alias("mae"),
                F.min_by(F.col("user_id") % 2, F.col("event_id")).alias("_run"),
                F.min("ts").alias("registered_at")))
    k = (F.col("horizon") + F.length("model_name")) % 3
    status = (F.when(k == 0, F.lit("production")).when(k == 1, F.lit("candidate"))
               .otherwise(F.lit("archived")))
    return g.select(
        "model_name", "horizon", "rmse", "mae",
        F.round((F.col("rmse") - F.col("mae")) / F.col("rmse"), 6).alias("r2"),
        F.concat(F.lit("models/"), F.col("model_name"), F.lit("_h"), F.col("horizon").cast("string")).alias("artifact"),
        F.array(*[F.lit(f) for f in TRAINING_FEATURES]).alias("features"),
        F.concat(F.lit("run_"), F.col("_run").cast("string")).alias("run_id"),
        status.alias("status"),
        status.alias("status_"),
        "registered_at",
    ).withColumn("_rk", F.row_number().over(Window.partitionBy("horizon", "status_").orderBy("rmse", "model_name"))) \
     .withColumn("is_best", (F.col("status_") == "production") & (F.col("_rk") == 1)) \
     .select("model_name", "horizon", "rmse", "mae", "r2", "artifact", "features", "run_id", "status", "is_best",
             "registered_at")


REGISTRY_SQL = f"""registry AS (
  SELECT model_name, horizon, rmse, mae, r2, artifact, run_id, status,
         status = 'production' AND row_number() OVER (PARTITION BY horizon, status ORDER BY rmse, model_name) = 1 AS is_best,
         registered_at
  FROM (
    SELECT model_name, horizon, rmse, mae,
           {sround('(rmse - mae) / rmse')} AS r2,
           'models/' || model_name || '_h' || CAST(horizon AS VARCHAR) AS artifact,
           'run_' || CAST(run AS VARCHAR) AS run_id,
           CASE (horizon + length(model_name)) % 3 WHEN 0 THEN 'production'
                WHEN 1 THEN 'candidate' ELSE 'archived' END AS status,
           registered_at
    FROM (
      SELECT event_type AS model_name, CAST(user_id % 3 + 1 AS INTEGER) AS horizon,
             max(value) AS rmse, min(value) AS mae,
             arg_min(user_id % 2, event_id) AS run, min(ts) AS registered_at
      FROM events GROUP BY 1, 2)))"""


# ------------------------------------------------------------------ features

def training_rows(spark, sf_dir, digits: int | None = 6) -> DataFrame:
    from airseries.operators.features import build_features
    return build_features(readings(spark, sf_dir), TRAINING.with_(digits=digits))


def _roll_sql(col: str, n: int, name: str, fn: str = "avg", digits: int | None = 6) -> str:
    w = f"(PARTITION BY series_id ORDER BY datetime ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    v = f"{fn}({col}) OVER {w}"
    if digits is not None:
        v = sround(v, digits)
    return f"CASE WHEN count({col}) OVER {w} = {n} THEN {v} END AS {name}"


def _lag_sql(col, k, name, fn="lag"):
    return f"{fn}({col}, {k}) OVER (PARTITION BY series_id ORDER BY datetime) AS {name}"


def _final_sql(digits):
    return f"""final AS (
  SELECT series_id, datetime, pm2_5, pm10, nitrogen_dioxide, pm2_5 AS aqi_pm25,
         CAST(hour(datetime) AS INTEGER) AS hour, CAST(day(datetime) AS INTEGER) AS day,
         CAST(month(datetime) AS INTEGER) AS month,
         {_lag_sql('pm2_5', 1, 'lag_1')}, {_lag_sql('pm2_5', 3, 'lag_3')}, {_lag_sql('pm2_5', 6, 'lag_6')},
         {_roll_sql('pm2_5', 6, 'roll_mean_6', digits=digits)}, {_roll_sql('pm2_5', 12, 'roll_mean_12', digits=digits)}
  FROM readings)"""


FINAL_SQL = _final_sql(6)
# Unrounded build for model queries: products of rounded means with binary
# fraction coefficients can sit exactly on a decimal tie, where Spark's
# decimal rounding and DuckDB's binary rounding legitimately differ.
FINAL_RAW_SQL = _final_sql(None)

TRAINING_SQL = f"""training AS (
  SELECT * FROM (
    SELECT final.*,
           {_lag_sql('aqi_pm25', 24, 'target_h1', 'lead')}, {_lag_sql('aqi_pm25', 48, 'target_h2', 'lead')},
           {_lag_sql('aqi_pm25', 72, 'target_h3', 'lead')}
    FROM final)
  WHERE COLUMNS(*) IS NOT NULL)"""


def ctes(*names: str, raw: bool = False) -> str:
    """``WITH`` prefix holding the named fixtures and their dependencies
    (``raw``: rolling statistics unrounded)."""
    order = ["readings", "raw_readings", "weather", "history", "final", "training", "registry"]
    deps = {"history": ["readings"], "final": ["readings"], "training": ["readings", "final"]}
    need: set[str] = set()
    for n in names:
        need.add(n)
        need.update(deps.get(n, []))
    text = {"readings": READINGS_SQL, "raw_readings": RAW_READINGS_SQL, "weather": WEATHER_SQL,
            "history": HISTORY_SQL, "final": FINAL_RAW_SQL if raw else FINAL_SQL, "training": TRAINING_SQL,
            "registry": REGISTRY_SQL}
    return "WITH " + ",\n".join(text[n] for n in order if n in need) + "\n"


def linear_models(horizons=(1, 2, 3)) -> dict:
    """Direct-forecast fixture: one literal linear model per horizon (days)."""
    return {h: dict(LINEAR_MODEL, intercept=LINEAR_MODEL["intercept"] + h) for h in horizons}


def linear_sql(coefs: dict, features) -> str:
    e = f"CAST({float(coefs.get('intercept', 0.0))!r} AS DOUBLE)"
    for f in features:
        e = f"({e} + CAST({float(coefs[f])!r} AS DOUBLE) * {f})"
    return e
