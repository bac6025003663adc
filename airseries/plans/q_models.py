"""Queries for training, forecasting and attribution."""

from pyspark.sql import functions as F

from airseries.operators import explain as X
from airseries.operators import forecast as FC
from airseries.operators import training as TR
from airseries.operators.features import FeatureSpec, build_features, latest_rows, time_split
from airseries.operators.metrics import regression_metrics
from airseries.plans import fixtures as fx
from airseries.plans.catalog import register
from airseries.plans.presets import FINAL, TRAINING_FEATURES
from airseries.plans.sqlgen import aqi_sql, r6, roll, shift, sround
from airseries.plans.sqltrees import ensemble_ctes

LIN = fx.LINEAR_MODEL
FEATS = TRAINING_FEATURES
LAGS = ["lag_1", "lag_3", "lag_6"]
FEAT_SQL = ", ".join(FEATS)


def _final(spark, sf_dir):
    return build_features(fx.readings(spark, sf_dir), FINAL)


def _clean_final(spark, sf_dir):
    return _final(spark, sf_dir).dropna(how="any")


# ---- T6: per-series ridge sweep -----------------------------------------------------

HZ = (1, 6, 24, 48)


def _sweep_sql(x: str) -> str:
    ycase = "CASE h " + " ".join(f"WHEN {h} THEN y{h}" for h in HZ) + " END"
    leads = ", ".join(f"lead(aqi_pm25, {h}) OVER w AS y{h}" for h in HZ)
    return fx.ctes("final", raw=True) + f""",
clean AS (SELECT * FROM final WHERE COLUMNS(*) IS NOT NULL),
t AS (SELECT series_id, datetime, {x} AS x, row_number() OVER w AS rn, count(*) OVER (PARTITION BY series_id) AS n,
             {leads}
      FROM clean WINDOW w AS (PARTITION BY series_id ORDER BY datetime)),
e AS (SELECT series_id, h, x, {ycase} AS y, rn, n FROM t, (SELECT unnest([{', '.join(map(str, HZ))}]) AS h)
      WHERE rn <= n - h),
s AS (SELECT *, CASE WHEN rn <= floor(CAST(0.8 AS DOUBLE) * (n - h)) THEN 'train' ELSE 'test' END AS split FROM e),
c AS (SELECT series_id, h, count(*) * covar_pop(x, y) / (count(*) * covar_pop(x, x) + CAST(1.0 AS DOUBLE)) AS w,
             avg(y) AS my, avg(x) AS mx
      FROM s WHERE split = 'train' GROUP BY 1, 2),
p AS (SELECT s.series_id, s.h, s.y, (c.my - c.mx * c.w) + c.w * s.x AS p
      FROM s JOIN c ON s.series_id = c.series_id AND s.h = c.h WHERE split = 'test')
SELECT series_id, h AS horizon, count(*) AS n_test, {r6('sqrt(avg(power(y - p, 2)))')} AS rmse,
       {r6('avg(abs(y - p))')} AS mae, {r6('1 - sum(power(y - p, 2)) / (var_pop(y) * count(*))')} AS r2
FROM p GROUP BY 1, 2"""


@register("t6_horizon_sweep_ridge_1feat", _sweep_sql("lag_1"))
def t6_horizon_sweep_ridge_1feat(spark, sf_dir):
    return TR.horizon_sweep(_clean_final(spark, sf_dir), ["lag_1"], "aqi_pm25", HZ, digits=6)


@register("t6_horizon_sweep_ridge_1feat_chunked", _sweep_sql("lag_1"))
def t6_horizon_sweep_ridge_1feat_chunked(spark, sf_dir):
    """Same sweep through positions + halo-chunked leads (hot-series plan)."""
    return TR.horizon_sweep(_clean_final(spark, sf_dir), ["lag_1"], "aqi_pm25", HZ, digits=6, chunk_rows=200)


def _sweep_d_sql(features, scores: str) -> str:
    """The sweep with any number of features: Gauss-Jordan elimination, one step a feature."""
    d = len(features)
    ycase = "CASE h " + " ".join(f"WHEN {h} THEN y{h}" for h in HZ) + " END"
    leads = ", ".join(f"lead(aqi_pm25, {h}) OVER w AS y{h}" for h in HZ)
    xs = ", ".join(f"CAST({f} AS DOUBLE) AS x{i}" for i, f in enumerate(features))
    names = ", ".join(f"x{i}" for i in range(d))
    left = " UNION ALL ".join(
        f"SELECT series_id, h, {i} AS i, {j} AS j, count(*) * covar_pop({f'x{j}' if j < d else 'y'}, x{i}) + {float(i == j)!r} AS v FROM s "
        "WHERE split = 'train' GROUP BY 1, 2" for i in range(d) for j in range(d + 1))
    steps = ",\n".join(
        f"""g{k + 1} AS MATERIALIZED (SELECT a.series_id, a.h, a.i, a.j, CASE WHEN a.i = {k} THEN a.v / p.v ELSE a.v - f.v * r.v / p.v END AS v
FROM g{k} a JOIN g{k} p ON a.series_id = p.series_id AND a.h = p.h AND p.i = {k} AND p.j = {k}
JOIN g{k} f ON a.series_id = f.series_id AND a.h = f.h AND f.i = a.i AND f.j = {k}
JOIN g{k} r ON a.series_id = r.series_id AND a.h = r.h AND r.i = {k} AND r.j = a.j)""" for k in range(d))
    ws = ", ".join(f"max(v) FILTER (i = {i}) AS w{i}" for i in range(d))
    means = ", ".join(f"avg(x{i}) AS m{i}" for i in range(d))
    dot = " + ".join(f"w{i} * (x{i} - m{i})" for i in range(d))
    return fx.ctes("final", raw=True) + f""",
clean AS (SELECT * FROM final WHERE COLUMNS(*) IS NOT NULL),
t AS (SELECT series_id, {xs}, row_number() OVER w AS rn, count(*) OVER (PARTITION BY series_id) AS n, {leads}
      FROM clean WINDOW w AS (PARTITION BY series_id ORDER BY datetime)),
s AS MATERIALIZED (SELECT series_id, h, {names}, {ycase} AS y,
      CASE WHEN rn <= floor(CAST(0.8 AS DOUBLE) * (n - h)) THEN 'train' ELSE 'test' END AS split
      FROM t, (SELECT unnest([{', '.join(map(str, HZ))}]) AS h) WHERE rn <= n - h),
g0 AS MATERIALIZED ({left}),
{steps},
w AS (SELECT series_id, h, {ws} FROM g{d} WHERE j = {d} GROUP BY 1, 2),
m AS (SELECT series_id, h, avg(y) AS my, {means} FROM s WHERE split = 'train' GROUP BY 1, 2),
p AS (SELECT s.series_id, s.h, s.y, m.my + {dot} AS p FROM s JOIN m ON s.series_id = m.series_id AND s.h = m.h
      JOIN w ON s.series_id = w.series_id AND s.h = w.h WHERE split = 'test')
SELECT series_id, h AS horizon, count(*) AS n_test, {scores} FROM p GROUP BY 1, 2"""


_RMSE, _MAE = f"{r6('sqrt(avg(power(y - p, 2)))')} AS rmse", f"{r6('avg(abs(y - p))')} AS mae"
_R2 = f"{r6('1 - sum(power(y - p, 2)) / (var_pop(y) * count(*))')} AS r2"


@register("t6_horizon_sweep_ridge_multi", _sweep_d_sql(FEATS, f"{_RMSE}, {_MAE}, {_R2}"))
def t6_horizon_sweep_ridge_multi(spark, sf_dir):
    """All eight features."""
    return TR.horizon_sweep(_clean_final(spark, sf_dir), FEATS, "aqi_pm25", HZ, digits=6)


@register("t6_horizon_sweep_moments", _sweep_d_sql(FEATS, f"{_RMSE}, {_R2}"))
def t6_horizon_sweep_moments(spark, sf_dir):
    """All eight features, scored from moments alone."""
    return TR.horizon_sweep(_clean_final(spark, sf_dir), FEATS, "aqi_pm25", HZ, digits=6, mae=False)


# ---- T3: pooled ridge through MLlib, one feature (closed form in SQL) ----------------

@register("t3_ridge_pooled_1feat", fx.ctes("training", raw=True) + f""",
s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY datetime)
                         <= floor(CAST(0.8 AS DOUBLE) * count(*) OVER (PARTITION BY series_id))
                    THEN 'train' ELSE 'test' END AS split FROM training),
c AS (SELECT count(*) * covar_pop(lag_1, target_h1) / (count(*) * covar_pop(lag_1, lag_1) + CAST(1.0 AS DOUBLE)) AS w,
             avg(target_h1) AS my, avg(lag_1) AS mx FROM s WHERE split = 'train'),
p AS (SELECT target_h1 AS y, (my - mx * w) + w * lag_1 AS p FROM s, c WHERE split = 'test')
SELECT count(*) AS n, {r6('sqrt(avg(power(y - p, 2)))')} AS rmse, {r6('avg(abs(y - p))')} AS mae,
       {r6('1 - sum(power(y - p, 2)) / (var_pop(y) * count(*))')} AS r2 FROM p""")
def t3_ridge_pooled_1feat(spark, sf_dir):
    rows = time_split(fx.training_rows(spark, sf_dir, digits=None), 0.8)
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    m = TR.fit(train, ["lag_1"], "target_h1", "ridge")
    return regression_metrics(TR.predict(m, test, "p"), "target_h1", "p", digits=6)


# ---- T1/T2/T4/T5/T10: MLlib candidates (rows-only) -------------------------------------

@register("t5_train_candidates_h1")
def t5_train_candidates_h1(spark, sf_dir):
    """Random forest (200 trees), gradient boosting, ridge and the deep
    boosted candidate for horizon 1, scored on the chronological 20 %."""
    rows = time_split(fx.training_rows(spark, sf_dir, digits=None), 0.8)
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    reg, _ = TR.train_candidates(train, val, FEATS, "target_h1", 1, "run_q",
                                 registered_at="2024-02-01 00:00:00", partitions=2)
    return reg.drop("features")


@register("t10_feature_importance")
def t10_feature_importance(spark, sf_dir):
    rows = time_split(fx.training_rows(spark, sf_dir, digits=None), 0.8).filter("split = 'train'")
    m = TR.fit(rows, FEATS, "target_h2", "random_forest", partitions=2)
    return X.feature_importance(m, FEATS)


# ---- T1/T2/T4/T10 in closed form: one tree of depth 1 on the hour --------------------------

_STUMP_SQL = fx.ctes("training", raw=True) + f""",
s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY datetime)
                         <= floor(CAST(0.8 AS DOUBLE) * count(*) OVER (PARTITION BY series_id))
                    THEN 'train' ELSE 'test' END AS split FROM training),
t AS (SELECT * FROM s WHERE split = 'train'),
cut AS (SELECT h FROM (
  SELECT c.h, var_pop(target_h1) FILTER (hour <= c.h) * count(*) FILTER (hour <= c.h)
            + var_pop(target_h1) FILTER (hour > c.h) * count(*) FILTER (hour > c.h) AS sse
  FROM t, (SELECT DISTINCT hour AS h FROM t) c GROUP BY c.h HAVING count(*) FILTER (hour > c.h) > 0)
  ORDER BY sse LIMIT 1),
m AS (SELECT avg(target_h1) FILTER (hour <= h) AS lo, avg(target_h1) FILTER (hour > h) AS hi, any_value(h) AS h FROM t, cut),
p AS (SELECT target_h1 AS y, CASE WHEN hour <= m.h THEN m.lo ELSE m.hi END AS p FROM s, m WHERE split = 'test')
SELECT count(*) AS n, {r6('sqrt(avg(power(y - p, 2)))')} AS rmse, {r6('avg(abs(y - p))')} AS mae,
       {r6('1 - sum(power(y - p, 2)) / (var_pop(y) * count(*))')} AS r2 FROM p"""


def _stump(spark, sf_dir, name, **kw):
    rows = time_split(fx.training_rows(spark, sf_dir, digits=None), 0.8)
    m = TR.fit(rows.filter("split = 'train'"), ["hour"], "target_h1", name, partitions=1, maxDepth=1, **kw)
    return regression_metrics(TR.predict(m, rows.filter("split = 'test'"), "p"), "target_h1", "p", digits=6)


@register("t1_forest_stump_hour", _STUMP_SQL)
def t1_forest_stump_hour(spark, sf_dir):
    """One tree, every row once: the best split of the hour in closed form."""
    return _stump(spark, sf_dir, "random_forest", numTrees=1, bootstrap=False, subsamplingRate=1.0)


@register("t2_boosting_stump_hour", _STUMP_SQL)
def t2_boosting_stump_hour(spark, sf_dir):
    return _stump(spark, sf_dir, "gradient_boosting", maxIter=1)


@register("t4_deep_boosting_stump_hour", _STUMP_SQL)
def t4_deep_boosting_stump_hour(spark, sf_dir):
    return _stump(spark, sf_dir, "boosted_deep", maxIter=1)


@register("t10_importance_one_feature", "SELECT * FROM (VALUES ('hour', 1.0::DOUBLE), ('month', 0.0::DOUBLE)) AS t(feature, importance)")
def t10_importance_one_feature(spark, sf_dir):
    """The month of the fixture is constant, so the hour carries all importance."""
    rows = fx.training_rows(spark, sf_dir, digits=None)
    one = rows.withColumn("month", F.lit(1))
    return X.feature_importance(TR.fit(one, ["hour", "month"], "target_h1", "random_forest", numTrees=3, maxDepth=2),
                                ["hour", "month"])


def _additive(spark, sf_dir, name, **kw):
    """Rows explained, and rows where base + sum of attributions is not the prediction."""
    from airseries.operators.treeshap import ensemble_tables, expected_value
    rows = fx.training_rows(spark, sf_dir, digits=None)
    m = TR.fit(rows, FEATS, "target_h1", name, **kw)
    base = expected_value(ensemble_tables(m, spark))
    total = X.explain_rows(rows, m, FEATS).groupBy("series_id", "datetime").agg(F.sum("shap_value").alias("s"))
    pred = TR.predict(m, rows, "p").select("series_id", "datetime", "p")
    bad = F.count_if(F.abs(F.lit(base) + F.col("s") - F.col("p")) > 1e-6)
    return pred.join(total, ["series_id", "datetime"], "left").agg(
        F.count("s").alias("n_rows"), bad.alias("n_not_additive"))


_ADDITIVE_SQL = fx.ctes("training") + "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_not_additive FROM training"


@register("t11_forest_shap_additive", _ADDITIVE_SQL)
def t11_forest_shap_additive(spark, sf_dir):
    return _additive(spark, sf_dir, "random_forest", numTrees=10, maxDepth=6)


@register("t11_boosted_shap_additive", _ADDITIVE_SQL)
def t11_boosted_shap_additive(spark, sf_dir):
    return _additive(spark, sf_dir, "gradient_boosting", maxIter=10)


# ---- T7: direct forecast -----------------------------------------------------------------

LATEST_SQL = """latest AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY datetime DESC) AS rn FROM final) WHERE rn = 1)"""


@register("t7_forecast_direct_linear", fx.ctes("final", raw=True) + f", {LATEST_SQL}\n" + " UNION ALL ".join(
    f"SELECT series_id, {h} AS horizon, {sround(fx.linear_sql(m, FEATS), 2, True)} AS value, "
    f"strftime(CAST(datetime AS DATE) + {h}, '%Y-%m-%d') AS date FROM latest"
    for h, m in fx.linear_models().items()))
def t7_forecast_direct_linear(spark, sf_dir):
    return FC.forecast_direct(latest_rows(_final(spark, sf_dir)), fx.linear_models(), FEATS)


# ---- T8: batch forecast --------------------------------------------------------------------

BATCH_SPEC = FeatureSpec(source="pm2_5", lags=(1, 3, 6), lag_name="lag_{k}", roll_mean=(6, 12),
                         roll_mean_name="roll_mean_{n}", calendar=("hour", "day", "month"))


@register("t8_forecast_batch_linear", fx.ctes("history") + f""",
warm AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY datetime DESC) AS rn FROM history) WHERE rn <= 11),
u AS (SELECT * FROM warm UNION ALL SELECT * FROM future),
f AS (SELECT series_id, datetime, pm2_5, {aqi_sql('pm2_5')} AS aqi_pm25,
             CAST(hour(datetime) AS INTEGER) AS hour, CAST(day(datetime) AS INTEGER) AS day,
             CAST(month(datetime) AS INTEGER) AS month,
             {shift('pm2_5', 1, 'lag_1')}, {shift('pm2_5', 3, 'lag_3')}, {shift('pm2_5', 6, 'lag_6')},
             {roll('pm2_5', 6, 'roll_mean_6', digits=None)}, {roll('pm2_5', 12, 'roll_mean_12', digits=None)}
      FROM u),
g AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY datetime DESC) AS rn2
      FROM f WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FEATS)})
SELECT series_id, datetime, {r6(fx.linear_sql(LIN, FEATS))} AS predicted_aqi FROM g WHERE rn2 <= 72""")
def t8_forecast_batch_linear(spark, sf_dir):
    out = FC.forecast_batch(fx.history(spark, sf_dir), fx.future(spark, sf_dir), LIN, BATCH_SPEC, FEATS)
    return out.withColumn("predicted_aqi", F.round("predicted_aqi", 6))


# ---- T9: recursive forecast ----------------------------------------------------------------

def _recursive_sql(steps=3):
    lin = fx.linear_sql(LIN, FEATS)
    keep = "series_id, datetime, hour, day, month, roll_mean_6, roll_mean_12"
    parts = [f"l0 AS (SELECT {keep}, coalesce(lag_1, 0) AS lag_1, coalesce(lag_3, 0) AS lag_3, "
             f"coalesce(lag_6, 0) AS lag_6 FROM latest)"]
    prev = []
    for s in range(1, steps + 1):
        carry = "".join(f", p{k}" for k in prev)
        parts.append(f"q{s} AS (SELECT *, {lin} AS p{s} FROM l{s - 1})")
        parts.append(f"l{s} AS (SELECT {keep}, p{s} AS lag_1, lag_1 AS lag_3, lag_3 AS lag_6{carry}, p{s} FROM q{s})")
        prev.append(s)
    sel = " UNION ALL ".join(
        f"SELECT series_id, {s} AS step, datetime + INTERVAL {s} DAY AS datetime, {r6(f'p{s}')} AS predicted_aqi "
        f"FROM l{steps}" for s in range(1, steps + 1))
    return fx.ctes("final", raw=True) + f", {LATEST_SQL},\n" + ",\n".join(parts) + "\n" + sel


@register("t9_forecast_recursive_linear", _recursive_sql(3))
def t9_forecast_recursive_linear(spark, sf_dir):
    out = FC.forecast_latest(_final(spark, sf_dir), LIN, FEATS, LAGS, steps=3)
    return out.withColumn("predicted_aqi", F.round("predicted_aqi", 6))


# ---- T11 / T12: linear attribution --------------------------------------------------------------

def _shap_sql():
    means = ", ".join(f"avg(CAST({f} AS DOUBLE)) AS m_{f}" for f in FEATS)
    body = " UNION ALL ".join(
        f"SELECT series_id, datetime, '{f}' AS feature, "
        f"{r6(f'CAST({float(LIN[f])!r} AS DOUBLE) * (CAST({f} AS DOUBLE) - m_{f})')} AS shap_value FROM training, mu"
        for f in FEATS)
    return fx.ctes("training", raw=True) + f""", mu AS (SELECT {means} FROM training),
shap AS ({body})"""


@register("t11_linear_shap", _shap_sql() + """
SELECT *, CAST(row_number() OVER (PARTITION BY series_id, datetime ORDER BY abs(shap_value) DESC, feature)
               AS INTEGER) AS rank FROM shap""")
def t11_linear_shap(spark, sf_dir):
    tr = fx.training_rows(spark, sf_dir, digits=None)
    means = X.background_means(tr, FEATS)
    return X.linear_shap(tr, LIN, FEATS, means, digits=6)


@register("t12_global_linear_shap", _shap_sql() + f"""
SELECT feature, {r6('avg(abs(shap_value))')} AS mean_abs_shap FROM shap GROUP BY 1""")
def t12_global_linear_shap(spark, sf_dir):
    tr = fx.training_rows(spark, sf_dir, digits=None)
    means = X.background_means(tr, FEATS)
    return X.global_importance(X.linear_shap(tr, LIN, FEATS, means, digits=6), digits=6)


# ---- T11 / T12: tree attribution (rows-only; additivity and brute force in pytest) --------

def _gbt_and_rows(spark, sf_dir):
    rows = time_split(fx.training_rows(spark, sf_dir, digits=None), 0.8)
    m = TR.fit(rows.filter("split = 'train'"), FEATS, "target_h1", "gradient_boosting")
    return m, rows.drop("split")


@register("t11_tree_shap_gbt")
def t11_tree_shap_gbt(spark, sf_dir):
    """Path-dependent TreeSHAP of the boosted candidate (reference defaults)
    for every training row, long form with per-row rank."""
    from airseries.operators.treeshap import explain_trees
    m, rows = _gbt_and_rows(spark, sf_dir)
    return explain_trees(rows, m, FEATS, digits=6)


@register("t12_global_tree_shap_gbt")
def t12_global_tree_shap_gbt(spark, sf_dir):
    from airseries.operators.treeshap import explain_trees
    m, rows = _gbt_and_rows(spark, sf_dir)
    return X.global_importance(explain_trees(rows, m, FEATS), digits=6)


from airseries.plans.catalog import ORACLE as _ORACLE  # noqa: E402


@register("t8_forecast_batch_linear_chunked", _ORACLE["t8_forecast_batch_linear"])
def t8_forecast_batch_linear_chunked(spark, sf_dir):
    out = FC.forecast_batch(fx.history(spark, sf_dir), fx.future(spark, sf_dir), LIN, BATCH_SPEC, FEATS,
                            chunk_rows=64)
    return out.withColumn("predicted_aqi", F.round("predicted_aqi", 6))


@register("s12_model_save_load_ridge", _ORACLE["t3_ridge_pooled_1feat"])
def s12_model_save_load_ridge(spark, sf_dir):
    """The pooled ridge is saved to the shared folder, loaded back and
    scored; the metrics equal the closed form (same oracle as T3)."""
    import uuid
    from airseries.session import ensure_checkpoint_dir
    from airseries.sources.models import load_model, save_model
    rows = time_split(fx.training_rows(spark, sf_dir, digits=None), 0.8)
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    path = save_model(TR.fit(train, ["lag_1"], "target_h1", "ridge"),
                      f"{ensure_checkpoint_dir(spark)}/models-{uuid.uuid4().hex[:12]}", "ridge", 1, "v1")
    return regression_metrics(TR.predict(load_model(path), test, "p"), "target_h1", "p", digits=6)


def _sweep2_sql(x0: str, x1: str) -> str:
    ycase = "CASE h " + " ".join(f"WHEN {h} THEN y{h}" for h in HZ) + " END"
    leads = ", ".join(f"lead(aqi_pm25, {h}) OVER w AS y{h}" for h in HZ)
    return fx.ctes("final", raw=True) + f""",
clean AS (SELECT * FROM final WHERE COLUMNS(*) IS NOT NULL),
t AS (SELECT series_id, datetime, {x0} AS x0, {x1} AS x1, row_number() OVER w AS rn,
             count(*) OVER (PARTITION BY series_id) AS n, {leads}
      FROM clean WINDOW w AS (PARTITION BY series_id ORDER BY datetime)),
e AS (SELECT series_id, h, x0, x1, {ycase} AS y, rn, n FROM t, (SELECT unnest([{', '.join(map(str, HZ))}]) AS h)
      WHERE rn <= n - h),
s AS (SELECT *, CASE WHEN rn <= floor(CAST(0.8 AS DOUBLE) * (n - h)) THEN 'train' ELSE 'test' END AS split FROM e),
st AS (SELECT series_id, h, count(*) AS m, avg(y) AS my, avg(x0) AS m0, avg(x1) AS m1,
              count(*) * covar_pop(x0, x0) + CAST(1.0 AS DOUBLE) AS a00, count(*) * covar_pop(x0, x1) AS a01,
              count(*) * covar_pop(x1, x1) + CAST(1.0 AS DOUBLE) AS a11,
              count(*) * covar_pop(x0, y) AS b0, count(*) * covar_pop(x1, y) AS b1
       FROM s WHERE split = 'train' GROUP BY 1, 2),
c AS (SELECT series_id, h, my, m0, m1, (b0 * a11 - b1 * a01) / (a00 * a11 - a01 * a01) AS w0,
             (a00 * b1 - a01 * b0) / (a00 * a11 - a01 * a01) AS w1 FROM st),
p AS (SELECT s.series_id, s.h, s.y, (c.my - c.m0 * c.w0 - c.m1 * c.w1) + c.w0 * s.x0 + c.w1 * s.x1 AS p
      FROM s JOIN c ON s.series_id = c.series_id AND s.h = c.h WHERE split = 'test')
SELECT series_id, h AS horizon, count(*) AS n_test, {r6('sqrt(avg(power(y - p, 2)))')} AS rmse,
       {r6('avg(abs(y - p))')} AS mae, {r6('1 - sum(power(y - p, 2)) / (var_pop(y) * count(*))')} AS r2
FROM p GROUP BY 1, 2"""


@register("t6_horizon_sweep_ridge_2feat", _sweep2_sql("lag_1", "roll_mean_6"))
def t6_horizon_sweep_ridge_2feat(spark, sf_dir):
    """Two features: the batched mapInPandas solve, checked against the 2 x 2
    closed form (Cramer's rule) in SQL."""
    return TR.horizon_sweep(_clean_final(spark, sf_dir), ["lag_1", "roll_mean_6"], "aqi_pm25", HZ, digits=6)


# ---- T1/T2/T4/T5/T10 as histogram ensembles: all features, several levels, bags and rounds -----------

#: Small enough for SQL; the same code grows the full sizes.
SMALL = {"random_forest": dict(trees=3, depth=2, bins=16), "gradient_boosting": dict(trees=3, depth=2, bins=16),
         "boosted_deep": dict(trees=2, depth=3, bins=16)}

_SRC_SQL = fx.ctes("training") + f""",
src AS MATERIALIZED (SELECT row_number() OVER (ORDER BY series_id, datetime) AS id, series_id, datetime,
  (date_diff('day', DATE '1970-01-01', CAST(datetime AS DATE)) * 24 + hour) * 16 + length(series_id) AS bag,
  row_number() OVER (PARTITION BY series_id ORDER BY datetime) <= floor(CAST(0.8 AS DOUBLE) * count(*) OVER (PARTITION BY series_id)) AS tr,
  target_h1 AS y, {FEAT_SQL} FROM training)"""


def _grown_sql(name: str, cte: str) -> str:
    kind, _, _, rate, l2 = TR.HISTOGRAM[name]
    return ensemble_ctes(FEATS, kind, rate=rate, l2=l2, name=cte, **SMALL[name])


def _split_rows(spark, sf_dir):
    """Rounded training rows with their split and an integer key that bags them."""
    rows = time_split(fx.training_rows(spark, sf_dir), 0.8)
    day = F.unix_date(F.to_date("datetime")).cast("long")
    return rows.withColumn("bag", (day * 24 + F.col("hour")) * 16 + F.length("series_id"))


def _grown(spark, sf_dir, name):
    rows = _split_rows(spark, sf_dir)
    m = TR.fit(rows.where("split = 'train'"), FEATS, "target_h1", name, engine="histogram", row_key=F.col("bag"), **SMALL[name])
    return m, rows


def _predictions(name):
    def run(spark, sf_dir):
        m, rows = _grown(spark, sf_dir, name)
        return TR.predict(m, rows, "p").select("series_id", "datetime", F.round("p", 6).alias("prediction"))
    return run


for _q, _name in (("t1_forest_levels", "random_forest"), ("t2_boosting_rounds", "gradient_boosting"), ("t4_second_order", "boosted_deep")):
    register(_q, _SRC_SQL + ",\n" + _grown_sql(_name, "m") + f"""
SELECT series_id, datetime, {r6('p')} AS prediction FROM src JOIN m_pred ON src.id = m_pred.id""")(_predictions(_name))


@register("t5_candidates_histogram", _SRC_SQL + ",\n" + ",\n".join(_grown_sql(m, f"c{i}") for i, m in enumerate(SMALL)) + "\n" + " UNION ALL ".join(
    f"""SELECT '{m}' AS model_name, 1 AS horizon, {r6('sqrt(avg(power(y - p, 2)))')} AS rmse, {r6('avg(abs(y - p))')} AS mae,
  {r6('1 - sum(power(y - p, 2)) / (var_pop(y) * count(*))')} AS r2, 'run_1' AS run_id, 'candidate' AS status, false AS is_best
FROM src JOIN c{i}_pred p ON src.id = p.id WHERE NOT tr""" for i, m in enumerate(SMALL)))
def t5_candidates_histogram(spark, sf_dir):
    """Three tree candidates of one horizon, fitted and scored like ``t5_train_candidates_h1``."""
    rows = _split_rows(spark, sf_dir)
    reg, _ = TR.train_candidates(rows.where("split = 'train'"), rows.where("split = 'test'"), FEATS, "target_h1", 1, "run_1",
                                 names=tuple(SMALL), overrides=SMALL, engine="histogram", row_key=F.col("bag"))
    return reg.select("model_name", "horizon", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "r2")], "run_id", "status", "is_best")


@register("t10_importance_levels", _SRC_SQL + ",\n" + _grown_sql("random_forest", "m") + f""",
own AS (SELECT tree, f, gain / sum(gain) OVER (PARTITION BY tree) AS part FROM m_gain),
total AS (SELECT f, sum(part) / (SELECT sum(part) FROM own) AS v FROM own GROUP BY f)
SELECT feature, {r6('coalesce(v, 0)')} AS importance FROM (SELECT unnest([{', '.join(f"'{f}'" for f in FEATS)}]) AS feature,
  unnest(range(0, {len(FEATS)})) AS f) n LEFT JOIN total ON n.f = total.f""")
def t10_importance_levels(spark, sf_dir):
    """Gain importances of all features of the training preset."""
    m, _ = _grown(spark, sf_dir, "random_forest")
    return X.feature_importance(m, FEATS).select("feature", F.round("importance", 6).alias("importance"))


# ---- T11/T12: attributions of a tree of depth 2, by the definition over all subsets of the features -----

def _depth2(spark, sf_dir):
    rows = _split_rows(spark, sf_dir)
    m = TR.fit(rows.where("split = 'train'"), FEATS, "target_h1", "boosted_deep", engine="histogram", trees=1, depth=2, bins=16)
    return X.explain_rows(rows, m, FEATS)


def _depth2_sql() -> str:
    kind, _, _, rate, l2 = TR.HISTOGRAM["boosted_deep"]
    d = len(FEATS)
    grown = ensemble_ctes(FEATS, kind, trees=1, depth=2, rate=rate, l2=l2, bins=16, name="m")

    def child(node: int, side: str) -> str:
        own, l, r = f"{side}o", f"{side}l", f"{side}r"
        return (f"CASE WHEN {own}.f IS NULL THEN {side}v WHEN (mask >> {own}.f) & 1 = 1 THEN CASE WHEN {side}g THEN {l} ELSE {r} END "
                f"ELSE ({own}.wl * {l} + ({own}.wn - {own}.wl) * {r}) / {own}.wn END")

    def value(node: int) -> str:
        return f"(SELECT v FROM m0_val WHERE node = {node})"

    return _SRC_SQL + ",\n" + grown + f""",
turns AS MATERIALIZED (SELECT s.id, b0.bin <= t0.bin AS g, b1.bin <= t1.bin AS ag, b2.bin <= t2.bin AS bg FROM src s, m0_best0 t0
  LEFT JOIN m0_best1 t1 ON t1.node = 1 LEFT JOIN m0_best1 t2 ON t2.node = 2 LEFT JOIN m_bin b0 ON b0.id = s.id AND b0.f = t0.f
  LEFT JOIN m_bin b1 ON b1.id = s.id AND b1.f = t1.f LEFT JOIN m_bin b2 ON b2.id = s.id AND b2.f = t2.f),
kinds AS (SELECT DISTINCT g, ag, bg FROM turns),
games AS MATERIALIZED (SELECT g, ag, bg, mask, {child(1, 'a')} AS va, {child(2, 'b')} AS vb, t.f AS tf, t.wl AS twl, t.wn AS twn FROM kinds,
  (SELECT unnest(range(0, {2 ** d})) AS mask), m0_best0 t LEFT JOIN m0_best1 ao ON ao.node = 1 LEFT JOIN m0_best1 bo ON bo.node = 2,
  (SELECT {value(1)} AS av, {value(3)} AS al, {value(4)} AS ar, {value(2)} AS bv, {value(5)} AS bl, {value(6)} AS br)),
worth AS MATERIALIZED (SELECT g, ag, bg, mask, CASE WHEN (mask >> tf) & 1 = 1 THEN CASE WHEN g THEN va ELSE vb END
  ELSE (twl * va + (twn - twl) * vb) / twn END AS v FROM games),
phi AS (SELECT a.g, a.ag, a.bg, f, {rate!r} * sum((b.v - a.v) * factorial(bit_count(a.mask)) * factorial({d - 1} - bit_count(a.mask)) / factorial({d})) AS v
  FROM worth a, (SELECT unnest(range(0, {d})) AS f) JOIN worth b ON b.mask = a.mask | (1 << f) AND a.g IS NOT DISTINCT FROM b.g
  AND a.ag IS NOT DISTINCT FROM b.ag AND a.bg IS NOT DISTINCT FROM b.bg WHERE (a.mask >> f) & 1 = 0 GROUP BY ALL),
shap AS (SELECT series_id, datetime, ([{', '.join(f"'{f}'" for f in FEATS)}])[f + 1] AS feature, v AS shap_value FROM src JOIN turns ON src.id = turns.id
  JOIN phi ON turns.g IS NOT DISTINCT FROM phi.g AND turns.ag IS NOT DISTINCT FROM phi.ag AND turns.bg IS NOT DISTINCT FROM phi.bg)
"""


@register("t11_tree_shap_depth2", _depth2_sql() + f"SELECT series_id, datetime, feature, {r6('shap_value')} AS shap_value FROM shap")
def t11_tree_shap_depth2(spark, sf_dir):
    """Every row's attributions to a second-order tree of two levels."""
    return _depth2(spark, sf_dir).select("series_id", "datetime", "feature", F.round("shap_value", 6).alias("shap_value"))


@register("t12_global_tree_shap_depth2", _depth2_sql() + f"SELECT feature, {r6('avg(abs(shap_value))')} AS mean_abs_shap FROM shap GROUP BY 1")
def t12_global_tree_shap_depth2(spark, sf_dir):
    return X.global_importance(_depth2(spark, sf_dir), digits=6)
