"""Queries for registry transitions (R1-R11) over the registry fixture."""

from pyspark.sql import functions as F

from airseries.operators import registry as R
from airseries.operators.metrics import regression_metrics
from airseries.plans import fixtures as fx
from airseries.plans.catalog import register
from airseries.plans.sqlgen import r6, sround

COLS = ["model_name", "horizon", "rmse", "mae", "r2", "artifact", "run_id", "status", "is_best", "registered_at"]
SQLCOLS = ", ".join(COLS)
NEW_AT = "2024-02-01 00:00:00"


def _reg(spark, sf_dir):
    return fx.registry(spark, sf_dir).drop("features")


def _proj(df):
    return df.select(*COLS)


def _flags(win_cond: str, other_cond: str, status_other: str = "'archived'"):
    return (f"CASE WHEN {win_cond} THEN 'production' WHEN {other_cond} THEN {status_other} ELSE status END AS status, "
            f"CASE WHEN {win_cond} THEN true WHEN {other_cond} THEN false ELSE is_best END AS is_best")


# ---- R1 ---------------------------------------------------------------------------

@register("r1_register_candidates", fx.ctes("training", "registry") + f"""
SELECT {SQLCOLS} FROM registry
UNION ALL
SELECT 'persist_' || series_id AS model_name, 1 AS horizon,
       {r6('sqrt(avg(power(target_h1 - lag_1, 2)))')} AS rmse, {r6('avg(abs(target_h1 - lag_1))')} AS mae,
       {r6('1 - sum(power(target_h1 - lag_1, 2)) / (var_pop(target_h1) * count(*))')} AS r2,
       NULL AS artifact, 'run_new' AS run_id, 'candidate' AS status, false AS is_best,
       TIMESTAMP '{NEW_AT}' AS registered_at
FROM training GROUP BY series_id""")
def r1_register_candidates(spark, sf_dir):
    t = fx.training_rows(spark, sf_dir).select("series_id", F.col("target_h1").alias("y"), F.col("lag_1").alias("p"))
    m = regression_metrics(t, by="series_id", digits=6)
    new = m.select(F.concat(F.lit("persist_"), "series_id").alias("model_name"), F.lit(1).alias("horizon"),
                   "rmse", "mae", "r2", F.lit("run_new").alias("run_id"))
    return _proj(R.register_candidates(_reg(spark, sf_dir), new, NEW_AT))


# ---- R2 / R3 ------------------------------------------------------------------------

@register("r2_promote_run", fx.ctes("registry") + f""",
r AS (SELECT *,
        row_number() OVER (PARTITION BY horizon ORDER BY (coalesce(run_id = 'run_1', false) = false),
                                                         rmse ASC NULLS LAST, model_name) AS rk,
        max(CAST(coalesce(run_id = 'run_1', false) AS INTEGER)) OVER (PARTITION BY horizon) = 1 AS touched
      FROM registry)
SELECT model_name, horizon, rmse, mae, r2, artifact, run_id,
       {_flags("touched AND rk = 1 AND run_id = 'run_1'", "touched AND status = 'production'")}, registered_at
FROM r""")
def r2_promote_run(spark, sf_dir):
    return _proj(R.promote_run(_reg(spark, sf_dir), "run_1"))


def _promote_best_sql(h=None):
    scope = "true" if h is None else f"horizon = {h}"
    return fx.ctes("registry") + f""",
r AS (SELECT *,
        row_number() OVER (PARTITION BY horizon ORDER BY (coalesce(status = 'candidate', false) = false),
                                                         rmse ASC NULLS LAST, model_name) AS rk,
        (max(CAST(coalesce(status = 'candidate', false) AS INTEGER)) OVER (PARTITION BY horizon) = 1)
          AND {scope} AS has
      FROM registry)
SELECT model_name, horizon, rmse, mae, r2, artifact, run_id,
       {_flags("has AND rk = 1", "has")}, registered_at
FROM r"""


@register("r3_promote_best_all", _promote_best_sql())
def r3_promote_best_all(spark, sf_dir):
    return _proj(R.promote_best(_reg(spark, sf_dir)))


@register("r3_promote_best_h2", _promote_best_sql(2))
def r3_promote_best_h2(spark, sf_dir):
    return _proj(R.promote_best(_reg(spark, sf_dir), horizon=2))


# ---- R4 / R5 / R8 -------------------------------------------------------------------

NEW_ROWS_SQL = f"""new_rows AS (
  SELECT 'ensemble' AS model_name, horizon, min(rmse) AS rmse, min(mae) AS mae, max(r2) AS r2,
         'models/ensemble_h' || CAST(horizon AS VARCHAR) AS artifact, 'run_new' AS run_id,
         'production' AS status, true AS is_best, TIMESTAMP '{NEW_AT}' AS registered_at
  FROM registry WHERE horizon IN (1, 3) GROUP BY horizon)"""


def _new_rows(reg):
    g = reg.filter(F.col("horizon").isin(1, 3)).groupBy("horizon").agg(
        F.min("rmse").alias("rmse"), F.min("mae").alias("mae"), F.max("r2").alias("r2"))
    return g.select(F.lit("ensemble").alias("model_name"), "horizon", "rmse", "mae", "r2",
                    F.concat(F.lit("models/ensemble_h"), F.col("horizon").cast("string")).alias("artifact"),
                    F.lit("run_new").alias("run_id"),
                    F.lit(NEW_AT).cast("timestamp_ntz").alias("registered_at"))


def _publish_sql(keep_status: bool, extra_new="", extra_old=""):
    status = "status" if keep_status else \
        "CASE WHEN horizon IN (SELECT horizon FROM new_rows) AND status = 'production' THEN 'archived' ELSE status END"
    return fx.ctes("registry") + f""", {NEW_ROWS_SQL}
SELECT model_name, horizon, rmse, mae, r2, artifact, run_id, {status} AS status,
       CASE WHEN horizon IN (SELECT horizon FROM new_rows) THEN false ELSE is_best END AS is_best,
       registered_at{extra_old}
FROM registry
UNION ALL SELECT {SQLCOLS}{extra_new} FROM new_rows"""


@register("r4_publish_archive", _publish_sql(False))
def r4_publish_archive(spark, sf_dir):
    reg = _reg(spark, sf_dir)
    return _proj(R.publish(reg, _new_rows(reg)))


@register("r5_publish_keep_status", _publish_sql(True))
def r5_publish_keep_status(spark, sf_dir):
    reg = _reg(spark, sf_dir)
    return _proj(R.publish(reg, _new_rows(reg), keep_status=True))


@register("r8_register_version", _publish_sql(
    True, extra_new=", strftime(registered_at, '%Y-%m-%d_%H-%M-%S') AS version",
    extra_old=", CAST(NULL AS VARCHAR) AS version"))
def r8_register_version(spark, sf_dir):
    from airseries.functions.transforms import version_stamp
    reg = _reg(spark, sf_dir)
    new = _new_rows(reg).withColumn("version", version_stamp("registered_at"))
    return R.publish(reg, new, keep_status=True).select(*COLS, "version")


# ---- R6 ---------------------------------------------------------------------------------

@register("r6_rollback", fx.ctes("registry") + f""",
r AS (SELECT *, coalesce(horizon = 2 AND run_id = 'run_0', false) AS hit,
             row_number() OVER (PARTITION BY horizon ORDER BY (coalesce(horizon = 2 AND run_id = 'run_0', false) = false),
                                rmse ASC NULLS LAST, model_name) AS rk
      FROM registry)
SELECT model_name, horizon, rmse, mae, r2, artifact, run_id, status,
       CASE WHEN hit AND rk = 1 THEN true WHEN horizon = 2 THEN false ELSE is_best END AS is_best, registered_at
FROM r""")
def r6_rollback(spark, sf_dir):
    return _proj(R.rollback(_reg(spark, sf_dir), 2, "run_0"))


SERIES_COLS = ["series_id", *COLS]
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
_PER_SERIES = f"""per_series AS (
  SELECT s.series_id, r.* FROM registry r, (SELECT DISTINCT event_type AS series_id FROM events) s
  WHERE NOT (s.series_id = 'view' AND r.run_id = 'run_0'))"""


def _per_series(spark, sf_dir):
    """The registry once per series; the series 'view' has no row of run_0."""
    names = F.array(*[F.lit(x) for x in EVENT_TYPES])
    both = _reg(spark, sf_dir).select(F.explode(names).alias("series_id"), "*")
    return both.filter(~((F.col("series_id") == "view") & (F.col("run_id") == "run_0")))


@register("r6_rollback_per_series", fx.ctes("registry") + f""", {_PER_SERIES},
r AS (SELECT *, coalesce(horizon = 2 AND run_id = 'run_0', false) AS hit,
             row_number() OVER (PARTITION BY series_id, horizon ORDER BY (coalesce(horizon = 2 AND run_id = 'run_0', false) = false),
                                rmse ASC NULLS LAST, model_name) AS rk,
             max(CAST(coalesce(horizon = 2 AND run_id = 'run_0', false) AS INTEGER)) OVER (PARTITION BY series_id, horizon) AS touched
      FROM per_series)
SELECT series_id, model_name, horizon, rmse, mae, r2, artifact, run_id, status,
       CASE WHEN hit AND rk = 1 THEN true WHEN touched = 1 THEN false ELSE is_best END AS is_best, registered_at
FROM r""")
def r6_rollback_per_series(spark, sf_dir):
    """Rollback with a slot per (series, horizon): series without the run keep their best model."""
    return R.rollback(_per_series(spark, sf_dir), 2, "run_0", key=("series_id", "horizon")).select(*SERIES_COLS)


@register("r2_promote_run_per_series", fx.ctes("registry") + f""", {_PER_SERIES},
r AS (SELECT *,
        row_number() OVER (PARTITION BY series_id, horizon ORDER BY (coalesce(run_id = 'run_1', false) = false),
                                                                    rmse ASC NULLS LAST, model_name) AS rk,
        max(CAST(coalesce(run_id = 'run_1', false) AS INTEGER)) OVER (PARTITION BY series_id, horizon) = 1 AS touched
      FROM per_series)
SELECT series_id, model_name, horizon, rmse, mae, r2, artifact, run_id,
       {_flags("touched AND rk = 1 AND run_id = 'run_1'", "touched AND status = 'production'")}, registered_at
FROM r""")
def r2_promote_run_per_series(spark, sf_dir):
    return R.promote_run(_per_series(spark, sf_dir), "run_1", key=("series_id", "horizon")).select(*SERIES_COLS)


# ---- R7 -------------------------------------------------------------------------------------

UPSERT_NEW_SQL = f"""new_rows AS (
  SELECT model_name, horizon + d AS horizon, 'production' AS status, true AS is_best,
         artifact || '/v2' AS artifact, model_name || '_h' || CAST(horizon + d AS VARCHAR) || '_v2' AS model_version,
         TIMESTAMP '{NEW_AT}' AS registered_at
  FROM registry, (SELECT unnest([0, 3]) AS d) WHERE status = 'archived')"""


@register("r7_upsert", fx.ctes("registry") + f""", {UPSERT_NEW_SQL},
base AS (SELECT * REPLACE (CASE WHEN status = 'production' THEN false ELSE is_best END AS is_best) FROM registry)
SELECT coalesce(n.model_name, b.model_name) AS model_name, coalesce(n.horizon, b.horizon) AS horizon,
       b.rmse, b.mae, b.r2,
       CASE WHEN n.model_name IS NOT NULL THEN n.artifact ELSE b.artifact END AS artifact, b.run_id,
       CASE WHEN n.model_name IS NOT NULL THEN n.status ELSE b.status END AS status,
       CASE WHEN n.model_name IS NOT NULL THEN n.is_best ELSE b.is_best END AS is_best,
       CASE WHEN n.model_name IS NOT NULL THEN n.registered_at ELSE b.registered_at END AS registered_at,
       n.model_version
FROM base b FULL OUTER JOIN new_rows n ON b.model_name = n.model_name AND b.horizon = n.horizon""")
def r7_upsert(spark, sf_dir):
    reg = _reg(spark, sf_dir)
    arch = reg.filter(F.col("status") == "archived")
    new = (arch.withColumn("d", F.explode(F.array(F.lit(0), F.lit(3))))
               .select("model_name", (F.col("horizon") + F.col("d")).alias("horizon"),
                       F.lit("production").alias("status"), F.lit(True).alias("is_best"),
                       F.concat("artifact", F.lit("/v2")).alias("artifact"),
                       F.concat("model_name", F.lit("_h"), (F.col("horizon") + F.col("d")).cast("string"),
                                F.lit("_v2")).alias("model_version"),
                       F.lit(NEW_AT).cast("timestamp_ntz").alias("registered_at")))
    return R.upsert(reg, new).select(*COLS, "model_version")


@register("r7_upsert_duplicate_key", fx.ctes("registry") + f""",
base AS (SELECT * REPLACE (CASE WHEN status = 'production' THEN false ELSE is_best END AS is_best) FROM registry)
SELECT {", ".join(c for c in SQLCOLS.split(", ") if c not in ("artifact", "registered_at"))}, artifact || '/v3' AS artifact,
       TIMESTAMP '{NEW_AT}' + INTERVAL 1 DAY AS registered_at FROM base""")
def r7_upsert_duplicate_key(spark, sf_dir):
    """Two new rows for every key: the later one counts, one row per key stays."""
    reg = _reg(spark, sf_dir)
    new = (reg.withColumn("v", F.explode(F.array(F.lit(3), F.lit(2))))
              .select("model_name", "horizon", F.concat("artifact", F.lit("/v"), F.col("v").cast("string")).alias("artifact"),
                      (F.lit(NEW_AT).cast("timestamp_ntz") + F.make_dt_interval(F.col("v") - 2)).alias("registered_at")))
    return _proj(R.upsert(reg, new))


# ---- R9 ---------------------------------------------------------------------------------------

FILE_SQL = f"""file_registry AS (
  SELECT model_name, horizon * 24 AS horizon_hours, {sround('rmse', 2, True)} AS rmse, {sround('r2', 3, True)} AS r2,
         CASE WHEN status = 'production' OR model_name = 'view' THEN 'active' ELSE 'inactive' END AS status,
         strftime(registered_at, '%Y-%m-%dT%H:%M:%S.%f') AS trained_at,
         strftime(registered_at, '%Y-%m-%dT%H:%M:%S.%f') || model_name AS position
  FROM registry)"""


def file_registry(spark, sf_dir):
    reg = _reg(spark, sf_dir)
    ts = F.date_format("registered_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return reg.select("model_name", (F.col("horizon") * 24).alias("horizon_hours"),
                      F.bround("rmse", 2).alias("rmse"), F.bround("r2", 3).alias("r2"),
                      F.when((F.col("status") == "production") | (F.col("model_name") == "view"),
                             F.lit("active")).otherwise(F.lit("inactive")).alias("status"),
                      ts.alias("trained_at"), F.concat(ts, "model_name").alias("position"))


@register("r9_load_active", fx.ctes("registry") + f", {FILE_SQL}" + """
SELECT horizon_hours, arg_max(model_name, position) AS model_name, arg_max(rmse, position) AS rmse,
       arg_max(r2, position) AS r2, arg_max(status, position) AS status,
       arg_max(trained_at, position) AS trained_at, max(position) AS position
FROM file_registry WHERE status = 'active' GROUP BY 1""")
def r9_load_active(spark, sf_dir):
    return R.load_active(file_registry(spark, sf_dir))


# ---- R10 / R11 -------------------------------------------------------------------------------

@register("r10_best_model_h1", fx.ctes("registry") + f"SELECT {SQLCOLS} FROM registry WHERE is_best AND horizon = 1 ORDER BY rmse NULLS LAST, model_name LIMIT 1")
def r10_best_model_h1(spark, sf_dir):
    return _proj(R.best_model(_reg(spark, sf_dir), 1))


@register("r10_best_model_any", fx.ctes("registry") + f"""
SELECT {SQLCOLS} FROM registry WHERE is_best ORDER BY horizon, rmse NULLS LAST, model_name LIMIT 1""")
def r10_best_model_any(spark, sf_dir):
    return _proj(R.best_model(_reg(spark, sf_dir)))


@register("r11_metrics_listing", fx.ctes("registry") + """
SELECT model_name, horizon, rmse, mae, r2, status FROM registry ORDER BY horizon, rmse NULLS LAST, model_name""")
def r11_metrics_listing(spark, sf_dir):
    return R.metrics_listing(_reg(spark, sf_dir))
