"""Golden edges for the AQI, category and calendar expressions."""

import math

from pyspark.sql import functions as F

from airseries.functions import aqi as A
from airseries.functions.calendar import add_time_features, cyclical


def py_aqi(x):
    """Plain restatement of the band rule (closed bands, half-even rounding)."""
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    for lo, hi, ilo, ihi in A.PM25_BREAKPOINTS:
        if lo <= x <= hi:
            return round((ihi - ilo) / (hi - lo) * (x - lo) + ilo)
    return None


def test_aqi_edges(spark):
    vals = [-1.0, 0.0, 12.0, 12.05, 12.1, 35.45, 55.45, 150.45, 250.45, 500.4, 500.5, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r["a"] for r in df.select(A.aqi_pm25("x").alias("a")).collect()]
    assert got == [py_aqi(v) for v in vals]
    assert got[:5] == [None, 0, 50, None, 51]
    assert got[-3:] == [None, None, None]


def test_aqi_every_cent(spark):
    """Equal to the Python rule at every 0.01 step from -1 to 510."""
    df = spark.range(-100, 51001).select((F.col("id") / 100).alias("x"))
    rows = df.select("x", A.aqi_pm25("x").alias("a")).collect()
    bad = [(r["x"], r["a"], py_aqi(r["x"])) for r in rows if r["a"] != py_aqi(r["x"])]
    assert not bad, bad[:5]
    gaps = sum(1 for r in rows if 0 <= r["x"] <= 500.4 and r["a"] is None)
    assert gaps == 45


def test_categories(spark):
    df = spark.createDataFrame([(v,) for v in [0, 50, 51, 100, 150, 151, 200, 201, 300, 301, None]], "a int")
    out = df.select("a", A.classify_aqi("a").alias("c"), A.classify_aqi_5("a").alias("c5"),
                    A.advisory("a").alias("adv")).collect()
    c6 = [r["c"]["category"] if r["c"] else None for r in out]
    assert c6 == ["Good", "Good", "Moderate", "Moderate", "Unhealthy for Sensitive Groups", "Unhealthy",
                  "Unhealthy", "Very Unhealthy", "Very Unhealthy", "Hazardous", None]
    c5 = [r["c5"] for r in out]
    assert c5[7:10] == ["Hazardous", "Hazardous", "Hazardous"]
    adv = [r["adv"] for r in out]
    assert adv[4] == A.ADVISORY[1][1] and adv[5] == A.ADVISORY[0][1] and adv[0] == A.ADVISORY[2][1]


def test_calendar_monday_sunday_unparseable(spark):
    df = spark.createDataFrame([("2024-01-01T05:00",), ("2024-01-07 23:00:00",), ("not a time",)], "datetime string")
    out = add_time_features(df).collect()
    assert (out[0]["hour"], out[0]["day"], out[0]["month"], out[0]["dayofweek"]) == (5, 1, 1, 0)
    assert out[1]["dayofweek"] == 6
    assert out[2]["datetime"] is None and out[2]["hour"] is None
    assert add_time_features(df.withColumnRenamed("datetime", "t")).columns == ["t"]


def test_cyclical(spark):
    df = spark.createDataFrame([("2024-01-01 06:00:00",)], "d string").select(
        F.col("d").cast("timestamp_ntz").alias("datetime"))
    r = cyclical(df).first()
    assert abs(r["hour_sin"] - 1.0) < 1e-12 and abs(r["hour_cos"]) < 1e-12


def test_describe_approx_close_to_exact(spark):
    from airseries.operators import quality as Q
    from airseries.plans import fixtures as fx
    r = fx.readings(spark, "/root/testdata/sf0.01")
    ex = {x["column"]: x for x in Q.describe(r, ["pm2_5"], exact=True).collect()}
    ap = {x["column"]: x for x in Q.describe(r, ["pm2_5"], exact=False).collect()}
    assert ex["pm2_5"]["count"] == ap["pm2_5"]["count"]
    for k in ("q25", "q50", "q75"):
        assert abs(ex["pm2_5"][k] - ap["pm2_5"][k]) <= 0.02 * ex["pm2_5"]["max"]


def test_histogram_constant_column(spark):
    from airseries.operators import eda as E
    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "x double")
    h = E.histogram(df, "x", 10).orderBy("bin").collect()
    assert len(h) == 10 and sum(r["n"] for r in h) == 3
    assert h[0]["lo"] == 4.5 and h[-1]["hi"] == 5.5 and h[5]["n"] == 3


def test_boxplot_approx_close_to_exact(spark):
    from airseries.operators import eda as E
    from airseries.plans import fixtures as fx
    r = fx.readings(spark, "/root/testdata/sf0.01")
    ex = {x["series_id"]: x for x in E.boxplot_stats(r, "pm2_5", "series_id", exact=True).collect()}
    ap = {x["series_id"]: x for x in E.boxplot_stats(r, "pm2_5", "series_id", exact=False).collect()}
    assert ex.keys() == ap.keys()
    for k in ex:
        assert abs(ex[k]["q1"] - ap[k]["q1"]) <= 5.0 and abs(ex[k]["q3"] - ap[k]["q3"]) <= 5.0
        assert ap[k]["whisker_lo"] <= ap[k]["q1"] <= ap[k]["q3"] <= ap[k]["whisker_hi"]


def test_metrics_of_a_constant_label(spark):
    """A stuck sensor has a defined R2 and does not end the grouped job."""
    from airseries.operators.metrics import regression_metrics
    rows = [("ok", 1.0, 1.5), ("ok", 2.0, 2.0), ("ok", 3.0, 2.5), ("stuck", 5.0, 4.0), ("stuck", 5.0, 6.0),
            ("exact", 5.0, 5.0), ("exact", 5.0, 5.0), ("one", 1.0, 1.0)]
    got = {r["s"]: r["r2"] for r in regression_metrics(
        spark.createDataFrame(rows, "s string, y double, p double"), by="s").collect()}
    assert got == {"ok": 0.75, "stuck": 0.0, "exact": 1.0, "one": None}


def test_sweep_with_a_stuck_sensor(spark):
    from airseries.operators.training import horizon_sweep
    from pyspark.sql import functions as F
    d = spark.range(80).select(F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, id)").alias("datetime"),
                               F.array(F.lit("a"), F.lit("stuck")).alias("k"), "id")
    d = d.select(F.explode("k").alias("series_id"), "datetime", "id").withColumn(
        "aqi_pm25", F.when(F.col("series_id") == "a", F.sin("id")).otherwise(F.lit(7.0))).withColumn("x", F.cos("id"))
    out = horizon_sweep(d, ["x"], "aqi_pm25", (1, 6)).collect()
    assert {(r["series_id"], r["horizon"]) for r in out} == {(s, h) for s in ("a", "stuck") for h in (1, 6)}
