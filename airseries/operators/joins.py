"""Joins and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airseries.functions.calendar import hour_floor


def align_weather(aqi: DataFrame, weather: DataFrame, key="series_id", ts="datetime",
                  broadcast_max_rows: int | None = None) -> DataFrame:
    """Left equi-join on (series, timestamp truncated to the hour). A reading
    meets every weather row of its hour: with two of them it comes out twice, with
    none once with NULLs (reduce ``weather`` to one row an hour first).
    The join strategy is left to Catalyst/AQE (runtime broadcast of a small
    side); ``broadcast_max_rows`` forces a broadcast only behind a row-count
    check."""
    from airseries.session import broadcast_if_small
    w = weather.withColumn(ts, hour_floor(ts))
    if broadcast_max_rows:
        w = broadcast_if_small(w, broadcast_max_rows)
    a = aqi.withColumn("_hour", hour_floor(ts))
    return (a.join(w.withColumnRenamed(ts, "_hour"), [key, "_hour"], "left").drop("_hour"))


def union_history_forecast(history: DataFrame, forecast: DataFrame, flag: str | None = "is_forecast") -> DataFrame:
    """Columns matched by name, absent ones NULL; order is carried by
    ``datetime``, plus an optional origin flag."""
    h, f = history, forecast
    if flag:
        h, f = h.withColumn(flag, F.lit(False)), f.withColumn(flag, F.lit(True))
    return h.unionByName(f, allowMissingColumns=True)


def feature_model_grid(latest: DataFrame, models: DataFrame, horizons, key=None,
                       broadcast_max_rows: int = 10_000, missing: str = "raise") -> DataFrame:
    """Every serving row paired with the model of every horizon. The
    horizon list (bounded, known from the registry) is exploded onto the
    rows and joined on ``horizon`` (+ ``key`` for per-series models): an
    equi-join, not a cross product. Pooled models are a handful of rows and
    would make ``horizon`` a hot shuffle key, so the model side is broadcast
    when a row-count check proves it small; per-series model tables beyond
    the bound shuffle on (horizon, key). A horizon without any model is an
    error (``missing="raise"``) or gives rows with NULL model columns
    (``"null"``); a series without a model of its own gets NULLs."""
    if missing == "raise":
        asked = [int(h) for h in horizons]
        have = {r[0] for r in models.where(F.col("horizon").isin(asked)).select("horizon").distinct().collect()}
        if lacking := sorted(set(asked) - have):
            raise RuntimeError(f"no model for horizon(s) {lacking}")
    from airseries.session import broadcast_if_small
    g = latest.withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    on = ["horizon"] + ([key] if isinstance(key, str) else list(key or []))
    return g.join(broadcast_if_small(models, broadcast_max_rows), on, "left")
