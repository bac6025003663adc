"""Payload flattening edges, sinks and round trips."""

import json

import pytest
from pyspark.sql import functions as F

from airseries.plans import fixtures as fx
from airseries.sources import payload as PL
from airseries.sources import tables as TB
from airseries.sources import registry_file as RF
from tests.conftest import SF


def _write(path, obj):
    with open(path, "w") as f:
        json.dump(obj, f)


def test_payload_edges(spark, tmpdir_path):
    d = tmpdir_path
    _write(f"{d}/c0.json", {"series_id": "k", "hourly": {"time": ["2024-09-01T00:00", "2024-09-01T01:00", "bad"],
                                                          "pm2_5": [1.5, None, 3.0], "pm10": [2.0, 2.5, None]}})
    _write(f"{d}/c1.json", {"series_id": "k", "error": "no data"})                     # hourly absent
    _write(f"{d}/c2.json", {"series_id": "k", "hourly": {"time": ["2024-09-01T02:00"], "pm10": [9.0]}})  # no pm2_5
    extra = __import__("pyspark.sql.types", fromlist=["StructType"]).StructType.fromJson(
        {"type": "struct", "fields": [{"name": "series_id", "type": "string", "nullable": True, "metadata": {}}]})
    out = PL.read_payloads(spark, [f"{d}/c0.json", f"{d}/c1.json", f"{d}/c2.json"], ["pm2_5", "pm10"], extra)
    rows = sorted(out.collect(), key=lambda r: (r["datetime"] is None, str(r["datetime"])))
    assert len(rows) == 4
    assert rows[0]["pm2_5"] == 1.5 and rows[1]["pm2_5"] is None
    assert rows[2]["pm2_5"] is None and rows[2]["pm10"] == 9.0           # missing member array -> NULL
    assert rows[3]["datetime"] is None                                    # unparseable time
    with pytest.raises(RuntimeError):
        PL.read_payloads(spark, [f"{d}/c1.json"], ["pm2_5"], extra)


def test_payload_nan_to_null(spark):
    df = spark.createDataFrame([("s", (["2024-01-01T00:00"], [float("nan")]))],
                               "series_id string, hourly struct<time: array<string>, pm2_5: array<double>>")
    r = PL.flatten_hourly(df, ["pm2_5"]).first()
    assert r["pm2_5"] is None
    with pytest.raises(ValueError):
        PL.flatten_hourly(df.drop("hourly"))


def test_backfill_plan_matches_loop(spark):
    import datetime as dt
    start, end = dt.date(2024, 1, 1), dt.date(2024, 5, 30)
    exp, cur = [], start
    while cur < end:
        ce = min(cur + dt.timedelta(days=10), end)
        exp.append((cur, ce))
        cur = ce + dt.timedelta(days=1)
    df = spark.createDataFrame([("s", start, end), ("e", end, end)], "series_id string, start date, end date")
    got = [(r["chunk_start"], r["chunk_end"]) for r in PL.plan_backfill(df).orderBy("chunk").collect()]
    assert got == exp


def test_versioned_overwrite_and_read(spark, tmpdir_path):
    base = f"{tmpdir_path}/tbl"
    r = fx.readings(spark, SF["0.001"])
    TB.overwrite_table(r, base, version="v1")
    TB.overwrite_table(r.limit(10), base, version="v2")
    assert TB.read_table(spark, base).count() == 10
    with pytest.raises(RuntimeError):
        TB.read_table(spark, TB.overwrite_table(r.limit(0), base, version="v3"))


def test_csv_round_trip(spark, tmpdir_path):
    r = fx.readings(spark, SF["0.001"])
    TB.export_csv(r, f"{tmpdir_path}/csv")
    back = TB.import_csv(spark, f"{tmpdir_path}/csv", schema=r.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, r.collect()))
    inferred = TB.import_csv(spark, f"{tmpdir_path}/csv")
    assert dict(inferred.dtypes)["pm2_5"] == "double"


def test_enrich_and_documents(spark):
    r = fx.readings(spark, SF["0.001"]).withColumn("city", F.when(F.col("series_id") == "view", F.lit("X")))
    e = TB.enrich_features(r.drop("city"), "Anytown", "2024-02-01 00:00:00")
    assert e.columns[:3] == ["city", "datetime", "aqi"] and e.columns[-1] == "created_at"
    assert {x["city"] for x in e.select("city").distinct().collect()} == {"Anytown"}
    e2 = TB.enrich_features(r.withColumn("aqi", F.lit(7.0)), "Anytown", "2024-02-01 00:00:00")
    assert {x["city"] for x in e2.select("city").distinct().collect()} == {"X", None}   # row value wins
    assert e2.first()["aqi"] == 7.0
    flat = r.select("series_id", F.lit(1).alias("horizon"), F.lit("m").alias("model_version"),
                    F.lit("2024-02-01").cast("timestamp_ntz").alias("generated_at"), "datetime",
                    F.col("pm2_5").alias("predicted_aqi"))
    docs = TB.forecast_documents(flat)
    assert docs.count() == r.select("series_id").distinct().count()
    assert TB.unnest_documents(docs).count() == r.count()
    assert TB.flat_forecasts(flat, 3, "2024-02-01").columns == ["datetime", "predicted_aqi", "horizon", "generated_at"]


def test_registry_file_append_read(spark, tmpdir_path):
    rows = spark.createDataFrame([("rf", 24, 3.14159, 0.98765, ["a", "b"])],
                                 "model_name string, horizon_hours int, rmse double, r2 double, features array<string>")
    RF.append_entries(RF.entries(rows, "active"), f"{tmpdir_path}/reg")
    RF.append_entries(RF.entries(rows.withColumn("model_name", F.lit("gb")), "active"), f"{tmpdir_path}/reg")
    got = RF.read_entries(spark, f"{tmpdir_path}/reg")
    assert got.count() == 2 and got.first()["rmse"] == 3.14 and got.first()["r2"] == 0.988
    # the reference's layout (one JSON array) reads with multiLine
    _write(f"{tmpdir_path}/arr.json", [{"model_name": "m", "horizon_hours": 1, "status": "active"}])
    assert RF.read_entries(spark, f"{tmpdir_path}/arr.json", multiline=True).count() == 1
