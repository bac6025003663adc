"""Forecasting jobs (T7-T9) over all series at once.

A model is an MLlib ``PipelineModel`` (assembler + regressor), a histogram
``TreeModel`` or a dict of linear coefficients (``intercept`` + feature -> weight), which keeps
prediction a plain column expression.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from airseries.functions.aqi import add_aqi_column
from airseries.functions.transforms import forecast_date, inverse_log, round_prediction
from airseries.operators.features import CHUNK_ROWS, FeatureSpec, build_features, latest_rows, tail_rows
from airseries.operators.joins import union_history_forecast
from airseries.operators.projection import drop_incomplete, fill_missing
from airseries.operators.trees import TreeModel


def linear_expr(coefs: dict, features=None) -> Column:
    feats = features or [k for k in coefs if k != "intercept"]
    e = F.lit(float(coefs.get("intercept", 0.0)))
    for f in feats:
        e = e + F.lit(float(coefs[f])) * F.col(f)
    return e


def apply_model(df: DataFrame, model, features, out: str = "prediction") -> DataFrame:
    if isinstance(model, dict):
        return df.withColumn(out, linear_expr(model, list(features)))
    if isinstance(model, (PipelineModel, TreeModel)):
        return model.transform(df).drop("features").withColumnRenamed("prediction", out)
    raise TypeError(f"unsupported model {type(model)}")


def forecast_direct(latest: DataFrame, models: dict, features, key="series_id", order="datetime",
                    now=None, transform: str = "identity") -> DataFrame:
    """The model of horizon h (days) applied to each series' newest row.
    ``date`` counts from the row's own time, or from ``now`` when given."""
    outs = []
    for h, m in sorted(models.items()):
        p = apply_model(latest, m, features, "_p")
        base = F.col(order) if now is None else F.lit(now).cast("timestamp_ntz")
        outs.append(p.select(key, F.lit(int(h)).alias("horizon"),
                             round_prediction(inverse_log(F.col("_p"), transform)).alias("value"),
                             forecast_date(base, int(h)).alias("date")))
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res


def forecast_batch(history: DataFrame, future: DataFrame, model, spec: FeatureSpec, features,
                   horizon_days: int = 3, rows_per_day: int = 24, warm_rows: int | None = None,
                   key="series_id", order="datetime", chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """History tail (warm start) + future inputs -> AQI index, calendar,
    lags, rolling stats -> drop rows missing required features -> last
    ``horizon_days * rows_per_day`` rows of each series -> predict."""
    chunked = bool(chunk_rows)  # the same decision for the tail steps
    warm = tail_rows(history, warm_rows if warm_rows is not None else spec.lookback, key, order, chunked=chunked)
    u = union_history_forecast(warm, future, flag=None)
    u = add_aqi_column(u)
    u = u.withColumn("aqi", F.col("aqi_pm25"))
    f = build_features(u, spec, key, order, chunk_rows=chunk_rows or None)
    f = drop_incomplete(f, [c for c in features if c in f.columns])
    f = tail_rows(f, horizon_days * rows_per_day, key, order, chunked=chunked)
    return apply_model(f, model, features, "predicted_aqi").select(key, order, "predicted_aqi")


def forecast_recursive(latest: DataFrame, model, features, lag_cols, steps: int = 3,
                       transform: str = "identity", key="series_id", order="datetime",
                       step_days: int = 1, base=None) -> DataFrame:
    """Predict, invert the target transform, step one day, shift the lag
    columns (largest <- next smaller, smallest <- prediction); every other
    feature stays frozen. ``lag_cols`` is ordered by lag (smallest first) and
    comes from the feature spec. All steps are one static projection chain
    per row; the step columns are stacked into rows at the end."""
    lag_cols = list(lag_cols)
    cur = fill_missing(latest, list(features))
    for s in range(1, steps + 1):
        cur = apply_model(cur, model, features, "_raw")
        cur = cur.withColumn(f"_p{s}", inverse_log(F.col("_raw"), transform)).drop("_raw")
        if lag_cols:
            shifted = {lag_cols[i]: F.col(lag_cols[i - 1]) for i in range(len(lag_cols) - 1, 0, -1)}
            shifted[lag_cols[0]] = F.col(f"_p{s}")
            cur = cur.withColumns(shifted)
    base_ts = F.col(order) if base is None else F.lit(base).cast("timestamp_ntz")
    cur = cur.withColumn("_base", base_ts)
    body = ", ".join(f"{s}, _p{s}" for s in range(1, steps + 1))
    long = cur.selectExpr(key, "_base", f"stack({steps}, {body}) AS (step, predicted_aqi)")
    return long.select(key, "step",
                       F.timestamp_add("DAY", F.col("step") * F.lit(step_days), F.col("_base")).alias("datetime"),
                       "predicted_aqi")


def forecast_latest(features_df: DataFrame, model, features, lag_cols, steps=3, transform="identity",
                    key="series_id", order="datetime") -> DataFrame:
    """W11 + T9: recursive forecast from each series' newest feature row."""
    return forecast_recursive(latest_rows(features_df, key, order), model, features, lag_cols, steps,
                              transform, key, order)
