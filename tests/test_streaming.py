"""Streaming landing over several micro-batches equals the batch derivation."""

import time

from pyspark.sql import functions as F

from airseries.plans import fixtures as fx
from airseries.streaming import compact_readings, land_events, merge_readings
from tests.conftest import SF


def test_multi_batch_landing(spark, tmpdir_path):
    ev = fx.table(spark, SF["0.01"], "events")
    days = ["2024-01-01", "2024-01-02", "2024-01-03"]
    src = f"{tmpdir_path}/events"
    for d in days:  # one file per day, written in time order
        ev.filter(F.to_date("ts") == F.lit(d)).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    out = land_events(spark, src, ev.schema, out=f"{tmpdir_path}/landed", max_files_per_trigger=1)
    got = merge_readings(spark, f"{out}/data")
    exp = fx.readings(spark, SF["0.01"]).filter(F.to_date("datetime").isin(days))
    cols = ["series_id", "datetime", "pm2_5", "pm10", "nitrogen_dioxide"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, exp.select(cols).collect()))
    assert spark.read.parquet(f"{out}/data").select("batch").distinct().count() >= 2


def test_landing_does_not_depend_on_batches(spark, tmpdir_path):
    """Hours out of order, one file per batch: every event counts, before and
    after a compaction, and after more batches behind it."""
    ev = fx.table(spark, SF["0.01"], "events")
    src, out = f"{tmpdir_path}/late", f"{tmpdir_path}/late-out"
    parts = [(F.to_date("ts") == F.lit("2024-01-03")) & (F.col("event_id") % 2 == 0),
             F.to_date("ts") == F.lit("2024-01-01"),
             (F.to_date("ts") == F.lit("2024-01-03")) & (F.col("event_id") % 2 == 1)]
    days = ["2024-01-01", "2024-01-03"]
    exp = sorted(map(tuple, fx.readings(spark, SF["0.01"]).filter(F.to_date("datetime").isin(days)).collect()))
    for i, cond in enumerate(parts):
        ev.filter(cond).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
        if i:
            land_events(spark, src, ev.schema, out=out, max_files_per_trigger=1)
            compact_readings(spark, f"{out}/data")
    got = merge_readings(spark, f"{out}/data").select("series_id", "datetime", "pm2_5", "pm10", "nitrogen_dioxide")
    assert sorted(map(tuple, got.collect())) == exp
