"""End-to-end jobs for the reference's three entry points, composed from the
operators with table I/O: feature refresh, daily training, serving.

Tables are parquet folders (``read_table`` / ``overwrite_table``
versioning); nothing passes through the driver except model summaries.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from airseries.operators.features import (CHUNK_ROWS, FeatureSpec, build_features, build_features_range,
                                          latest_rows, time_split)
from airseries.operators.forecast import forecast_direct
from airseries.operators.registry import best_model, publish
from airseries.operators.training import train_candidates
from airseries.plans.presets import FINAL, TRAINING, TRAINING_FEATURES
from airseries.sources.models import load_model
from airseries.session import ensure_checkpoint_dir
from airseries.sources.tables import append_table, exists, overwrite_days, read_table, replace_days, update_table


def refresh_features(spark: SparkSession, readings_path: str, features_path: str,
                     spec: FeatureSpec = FINAL, chunk_rows=CHUNK_ROWS) -> None:
    """Feature refresh: readings -> full feature build (no NULL drop) ->
    new table version, one folder a day."""
    overwrite_days(build_features(read_table(spark, readings_path), spec, chunk_rows=chunk_rows), features_path)


def refresh_feature_days(spark: SparkSession, readings_path: str, features_path: str, start: str, end: str,
                         spec: FeatureSpec = FINAL, chunk_rows=CHUNK_ROWS) -> int:
    """Incremental refresh after readings of ``[start, end)`` have (again) landed; the days written.

    Same layout as ``refresh_features``: a new version of the feature table whose manifest
    names new folders for the affected days and the old ones for all others, so what is
    read and written follows the affected days. The range is widened to whole days, to the
    rows behind it whose lags look into it, and to those before it whose targets do, each
    counted in rows per series (``affected_days``). Readers see either version whole."""
    r = read_table(spark, readings_path)
    if not exists(spark, features_path):
        refresh_features(spark, readings_path, features_path, spec, chunk_rows)
        return read_table(spark, features_path, require_rows=False).select(F.to_date("datetime")).distinct().count()

    def build(old: DataFrame) -> tuple[DataFrame, list[str]]:
        span = days.agg(F.min("lo"), F.date_add(F.max("hi"), 1)).first()
        if span[0] is None:
            return old.where("false"), []
        new = build_features_range(r, spec, f"{span[0]} 00:00:00", f"{span[1]} 00:00:00", chunk_rows=chunk_rows)
        d = F.to_date("datetime")
        bounds = days.withColumnRenamed("series_id", "_s")
        same = F.col("series_id").eqNullSafe(F.col("_s"))
        within = same & d.between(F.col("lo"), F.col("hi"))
        # calendar days between the ends: one name each
        touched = [str(x[0]) for x in days.select(F.explode(F.sequence("lo", "hi"))).distinct().collect()]
        kept = old.where(d.cast("string").isin(touched)).join(bounds, within, "left_anti")
        return kept.unionByName(new.join(bounds, within, "left_semi").select(*old.columns)), touched

    days = affected_days(r, start, end, spec).cache()
    try:
        return replace_days(spark, features_path, build)
    finally:
        days.unpersist()


def affected_days(readings: DataFrame, start: str, end: str, spec: FeatureSpec) -> DataFrame:
    """(series_id, lo, hi): whole days per series whose features a change of the
    readings in ``[start, end)`` can reach: the range, ``lookback`` rows behind
    it and ``lead`` rows before it. One count per (series, day), and a window
    over those counts."""
    s, e = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    first, last = F.to_date(s), F.to_date(F.timestamp_add("MICROSECOND", F.lit(-1), e))
    per = (readings.where("datetime IS NOT NULL").groupBy("series_id", F.to_date("datetime").alias("d"))
           .agg(F.count("*").alias("n")))
    w = Window.partitionBy("series_id")
    behind = F.sum(F.when(F.col("d") > last, F.col("n"))).over(w.orderBy("d").rowsBetween(Window.unboundedPreceding, -1))
    before = F.sum(F.when(F.col("d") < first, F.col("n"))).over(w.orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1))
    reach = per.withColumns({"b": F.coalesce(behind, F.lit(0)), "f": F.coalesce(before, F.lit(0))})
    hit = (F.col("d").between(first, last) | ((F.col("d") > last) & (F.col("b") < spec.lookback))
           | ((F.col("d") < first) & (F.col("f") < spec.lead)))
    return reach.where(hit).groupBy("series_id").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))


def train_horizons(spark: SparkSession, readings_path: str, registry_path: str, models_path: str,
                   horizons=(1, 2, 3), name: str = "random_forest", run_id: str | None = None,
                   overrides: dict | None = None, now: dt.datetime | None = None) -> DataFrame:
    """Daily training: training build, then per horizon fit -> score ->
    publish as production; the registry is written as a new version, on top of any that
    another writer published while the models were fitted."""
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    run_id = run_id or now.strftime("%Y-%m-%d_%H-%M-%S")
    # first run: there is no registry; one that is there but unreadable is an error
    if exists(spark, registry_path):
        read_table(spark, registry_path, require_rows=False)
    train_rows = build_features(read_table(spark, readings_path), TRAINING).cache()
    ensure_checkpoint_dir(spark)
    try:
        split = time_split(train_rows, 0.8)
        train, test = split.where("split = 'train'"), split.where("split = 'test'")
        fitted = [train_candidates(train, test, TRAINING_FEATURES, f"target_h{h}", h, run_id, names=(name,), registered_at=now,
                                   overrides={name: overrides or {}}, save_base=models_path)[0] for h in horizons]
    finally:
        train_rows.unpersist()

    def transition(registry: DataFrame | None) -> DataFrame:
        """The models of this run published on whatever registry is the newest."""
        for rows in fitted:
            if registry is None:
                registry = rows.withColumns({"status": F.lit("production"), "is_best": F.lit(True)})
            else:
                registry = publish(registry, rows.drop("status", "is_best"), key="horizon")
        return registry

    return update_table(spark, registry_path, transition)


def serve_forecasts(spark: SparkSession, features_path: str, registry_path: str, forecasts_path: str,
                    horizons=(1, 2, 3), now: dt.datetime | None = None, on_incomplete: str = "raise") -> DataFrame:
    """Serving: best model per horizon (registry lookup), newest feature row
    per series, direct forecast for every series, appended to the forecast
    table with ``generated_at``. A series whose newest row lacks a feature is
    an error that names it (``on_incomplete="raise"``) or gets rows with NULL
    values (``"null"``); it is never left out silently."""
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    feats = read_table(spark, features_path)
    registry = read_table(spark, registry_path)
    models = {}
    for h in horizons:
        row = best_model(registry, h).select("artifact").first()
        if row is None or row["artifact"] is None:
            raise RuntimeError(f"No production model for horizon {h}")
        models[h] = load_model(row["artifact"])
    latest = latest_rows(feats)
    gap = F.lit(False)
    for c in TRAINING_FEATURES:
        gap = gap | F.col(c).isNull()
    lacking = latest.where(gap)
    if not lacking.isEmpty():
        names = [r[0] for r in lacking.select("series_id").orderBy("series_id").limit(10).collect()]
        if on_incomplete == "raise":
            raise RuntimeError(f"{lacking.count()} series lack a feature in their newest row, among them {names}")
    # an incomplete series is served as a row without a value, not left out
    whole = forecast_direct(latest.where(~gap), models, TRAINING_FEATURES)
    out = whole.withColumn("generated_at", F.lit(now).cast("timestamp_ntz"))
    if on_incomplete == "null":
        blank = lacking.select("series_id", F.explode(F.array(*[F.lit(int(h)) for h in horizons])).alias("horizon"),
                               F.lit(now).cast("timestamp_ntz").alias("generated_at"))
        out = out.unionByName(blank, allowMissingColumns=True)
    append_table(out, forecasts_path)
    return out
