"""Results do not depend on the session time zone (all times are TIMESTAMP_NTZ)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF

NAMES = ["w14_training_preset", "m6_time_features", "m12_model_version", "s1_flatten_hourly",
         "s3_plan_backfill", "a5_gap_report", "t9_forecast_recursive_linear", "r9_load_active"]


@pytest.mark.parametrize("name", NAMES)
def test_zone_independent(spark, name):
    fn = E.queries()[name]
    base = sorted(map(repr, fn(spark, SF["0.001"]).collect()))
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        other = sorted(map(repr, fn(spark, SF["0.001"]).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert base == other
