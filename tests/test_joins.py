"""What meets a reading when weather rows are missing or doubled."""

from pyspark.sql import functions as F

from airseries.operators.joins import align_weather


def test_rows_of_an_hour(spark):
    ts = lambda df: df.withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
    a = ts(spark.createDataFrame([("s", "2024-01-01 01:20:00", 1.0), ("s", "2024-01-01 02:00:00", 2.0), ("s", "2024-01-01 03:00:00", 3.0)],
                                 "series_id string, datetime string, pm2_5 double"))
    w = ts(spark.createDataFrame([("s", "2024-01-01 01:00:00", 10.0), ("s", "2024-01-01 02:00:00", 20.0), ("s", "2024-01-01 02:30:00", 21.0)],
                                 "series_id string, datetime string, temperature_2m double"))
    got = sorted((r["pm2_5"], r["temperature_2m"] or 0) for r in align_weather(a, w).collect())
    assert got == [(1.0, 10.0), (2.0, 20.0), (2.0, 21.0), (3.0, 0)]
