"""End-to-end jobs: feature refresh, training with publish, serving."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from airseries.operators.registry import assert_single_best
from airseries.plans import fixtures as fx
from airseries.plans import jobs
from airseries.sources.tables import overwrite_table, read_table
from tests.conftest import SF


def test_feature_training_serving(spark, tmpdir_path):
    base = tmpdir_path
    overwrite_table(fx.readings(spark, SF["0.01"]), f"{base}/readings")
    jobs.refresh_features(spark, f"{base}/readings", f"{base}/features")
    assert read_table(spark, f"{base}/features").count() == fx.readings(spark, SF["0.01"]).count()
    now = dt.datetime(2024, 2, 1)
    reg = jobs.train_horizons(spark, f"{base}/readings", f"{base}/registry", f"{base}/models",
                              horizons=(1, 2), overrides={"numTrees": 5}, now=now)
    assert_single_best(reg)
    assert reg.filter("is_best").count() == 2
    out = jobs.serve_forecasts(spark, f"{base}/features", f"{base}/registry", f"{base}/forecasts",
                               horizons=(1, 2), now=now)
    assert out.count() == 2 * 5
    assert read_table(spark, f"{base}/forecasts").count() == 10


def _rows(df, cols):
    return sorted(map(repr, df.select(cols).collect()))


def test_incremental_refresh(spark, tmpdir_path):
    """Read through ``read_table``: a refresh after a versioned write, a range that
    starts in the middle of a day, and days that landed again with other values."""
    from airseries.operators.features import build_features
    from airseries.plans.presets import FINAL
    base = tmpdir_path
    all_ = fx.readings(spark, SF["0.01"])
    first = all_.filter(F.col("datetime") < F.lit("2024-01-20 09:00:00").cast("timestamp_ntz"))
    cols = sorted(build_features(all_, FINAL).columns)
    overwrite_table(first, f"{base}/readings")
    jobs.refresh_features(spark, f"{base}/readings", f"{base}/features")
    overwrite_table(all_, f"{base}/readings")
    jobs.refresh_feature_days(spark, f"{base}/readings", f"{base}/features", "2024-01-20 09:00:00", "2024-02-02")
    assert _rows(read_table(spark, f"{base}/features"), cols) == _rows(build_features(all_, FINAL), cols)
    again = F.to_date("datetime").isin("2024-01-10", "2024-01-11")
    changed = all_.withColumn("pm2_5", F.when(again, F.col("pm2_5") + 5).otherwise(F.col("pm2_5")))
    overwrite_table(changed, f"{base}/readings")
    jobs.refresh_feature_days(spark, f"{base}/readings", f"{base}/features", "2024-01-10 12:00:00", "2024-01-11 13:00:00")
    assert _rows(read_table(spark, f"{base}/features"), cols) == _rows(build_features(changed, FINAL), cols)


def test_unreadable_pointer_and_registry_raise(spark, tmpdir_path):
    base = f"{tmpdir_path}/t"
    r = fx.readings(spark, SF["0.001"])
    overwrite_table(r, base)
    overwrite_table(r.limit(3), base, version="a-name-that-sorts-first")
    assert read_table(spark, base).count() == 3  # by sequence, not by name or clock
    os.makedirs(f"{base}/_current", exist_ok=True)
    with open(f"{base}/_current/part-broken.json", "w") as f:
        f.write("{not json")
    with pytest.raises(Exception):
        read_table(spark, base).count()
    overwrite_table(r, f"{tmpdir_path}/readings")
    with pytest.raises(Exception):  # a registry that is there but unreadable is no first run
        jobs.train_horizons(spark, f"{tmpdir_path}/readings", base, f"{tmpdir_path}/models", horizons=(1,),
                            overrides={"numTrees": 2})


def test_serving_names_incomplete_series(spark, tmpdir_path):
    base = tmpdir_path
    r = fx.readings(spark, SF["0.01"])
    overwrite_table(r, f"{base}/readings")
    now = dt.datetime(2024, 2, 1)
    jobs.train_horizons(spark, f"{base}/readings", f"{base}/registry", f"{base}/models", horizons=(1,),
                        overrides={"numTrees": 2}, now=now)
    newest = r.filter("series_id = 'view'").agg(F.max("datetime")).first()[0]
    hole = (F.col("series_id") == "view") & (F.col("datetime") == F.lit(newest))
    overwrite_table(r.withColumn("pm2_5", F.when(~hole, F.col("pm2_5"))), f"{base}/readings")
    jobs.refresh_features(spark, f"{base}/readings", f"{base}/features")
    with pytest.raises(RuntimeError, match="view"):
        jobs.serve_forecasts(spark, f"{base}/features", f"{base}/registry", f"{base}/f", horizons=(1,), now=now)
    out = jobs.serve_forecasts(spark, f"{base}/features", f"{base}/registry", f"{base}/f", horizons=(1,), now=now,
                               on_incomplete="null")
    got = {x["series_id"]: x["value"] for x in out.collect()}
    assert len(got) == 5 and got["view"] is None and all(v is not None for k, v in got.items() if k != "view")
