"""Queries for quality reports, EDA statistics and metrics."""

from pyspark.sql import functions as F

from airseries.operators import eda as E
from airseries.operators.gram import corr_matrix_blocks, corr_with_blocks
from airseries.operators import metrics as M
from airseries.operators import quality as Q
from airseries.operators.features import build_features
from airseries.plans import fixtures as fx
from airseries.plans.catalog import ORACLE, register
from airseries.plans.presets import FINAL, TRAINING_FEATURES, WIDE
from airseries.plans.sqlgen import corr_sql, r6

NUM = ["pm2_5", "pm10", "nitrogen_dioxide"]
MODELS = ["click", "error", "purchase", "signup", "view"]


def round_doubles(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


@register("a1_profile", fx.ctes("readings") + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null FROM readings"
    for c, t in [("series_id", "string"), ("datetime", "timestamp_ntz"), ("pm2_5", "double"),
                 ("pm10", "double"), ("nitrogen_dioxide", "int")]))
def a1_profile(spark, sf_dir):
    return Q.profile(fx.readings(spark, sf_dir))


FINAL_COLS = ["series_id", "datetime", "pm2_5", "pm10", "nitrogen_dioxide", "aqi_pm25", "hour", "day",
              "month", "lag_1", "lag_3", "lag_6", "roll_mean_6", "roll_mean_12"]


@register("a2_missing_counts", fx.ctes("final") + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM final"
    for c in FINAL_COLS))
def a2_missing_counts(spark, sf_dir):
    return Q.missing_counts(build_features(fx.readings(spark, sf_dir), FINAL.with_(digits=6)))


@register("a3_describe", fx.ctes("readings") + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, {r6(f'avg({c})')} AS mean,
       {r6(f'stddev_samp({c})')} AS std, {r6(f'CAST(min({c}) AS DOUBLE)')} AS min,
       {r6(f'quantile_cont({c}, 0.25)')} AS q25, {r6(f'quantile_cont({c}, 0.5)')} AS q50,
       {r6(f'quantile_cont({c}, 0.75)')} AS q75, {r6(f'CAST(max({c}) AS DOUBLE)')} AS max FROM readings"""
    for c in NUM))
def a3_describe(spark, sf_dir):
    return round_doubles(Q.describe(fx.readings(spark, sf_dir), NUM))


@register("a4_negative_counts", fx.ctes("final") + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} - 50 < 0) AS n_negative FROM final"
    for c in ["pm2_5", "pm10", "lag_1", "roll_mean_6"]))
def a4_negative_counts(spark, sf_dir):
    f = build_features(fx.readings(spark, sf_dir), FINAL.with_(digits=6))
    shifted = f.select(*[(F.col(c) - 50).alias(c) for c in ["pm2_5", "pm10", "lag_1", "roll_mean_6"]])
    return Q.negative_counts(shifted)


@register("a5_gap_report", fx.ctes("readings") + """
SELECT gap_seconds, count(*) AS n FROM (
  SELECT CAST(date_diff('second', lag(datetime) OVER (PARTITION BY series_id ORDER BY datetime), datetime)
              AS BIGINT) AS gap_seconds FROM readings)
WHERE gap_seconds IS NOT NULL GROUP BY 1""")
def a5_gap_report(spark, sf_dir):
    return Q.gap_report(fx.readings(spark, sf_dir))


@register("a6_mean_by_hour", fx.ctes("readings") + f"""
SELECT CAST(hour(datetime) AS INTEGER) AS hour, {', '.join(f"{r6(f'avg(CAST({c} AS DECIMAL(30, 2)))')} AS mean_{c}" for c in NUM)}
FROM readings GROUP BY 1""")
def a6_mean_by_hour(spark, sf_dir):
    r = fx.readings(spark, sf_dir).withColumn("hour", F.hour("datetime"))
    return round_doubles(E.group_means(r, "hour", NUM, decimals=2))


@register("a7_mean_by_month", fx.ctes("readings") + f"""
SELECT CAST(month(datetime) AS INTEGER) AS month, {', '.join(f"{r6(f'avg(CAST({c} AS DECIMAL(30, 2)))')} AS mean_{c}" for c in NUM)}
FROM readings GROUP BY 1""")
def a7_mean_by_month(spark, sf_dir):
    r = fx.readings(spark, sf_dir).withColumn("month", F.month("datetime"))
    return round_doubles(E.group_means(r, "month", NUM, decimals=2))


@register("a8_histogram_50", fx.ctes("readings") + f""",
s AS (SELECT min(pm2_5) AS lo, max(pm2_5) AS hi FROM readings),
b AS (SELECT CAST(least(floor((pm2_5 - s.lo) * (50 / (s.hi - s.lo))), 49) AS INTEGER) AS bin, count(*) AS n
      FROM readings, s GROUP BY 1)
SELECT g.bin, {r6('s.lo + g.bin * ((s.hi - s.lo) / 50)')} AS lo,
       {r6('s.lo + (g.bin + 1) * ((s.hi - s.lo) / 50)')} AS hi, coalesce(b.n, 0) AS n
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(50)) g CROSS JOIN s LEFT JOIN b ON g.bin = b.bin""")
def a8_histogram_50(spark, sf_dir):
    return E.histogram(fx.readings(spark, sf_dir), "pm2_5", 50)


@register("a9_boxplot", fx.ctes("readings") + f""",
q AS (SELECT series_id, quantile_cont(pm2_5, 0.25) AS q1, quantile_cont(pm2_5, 0.75) AS q3
      FROM readings GROUP BY 1)
SELECT series_id, {r6('first(q1)')} AS q1, {r6('first(q3)')} AS q3,
       min(pm2_5) FILTER (WHERE pm2_5 >= q1 - 1.5 * (q3 - q1)) AS whisker_lo,
       max(pm2_5) FILTER (WHERE pm2_5 <= q3 + 1.5 * (q3 - q1)) AS whisker_hi,
       count(*) FILTER (WHERE pm2_5 < q1 - 1.5 * (q3 - q1) OR pm2_5 > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM readings JOIN q USING (series_id) GROUP BY 1""")
def a9_boxplot(spark, sf_dir):
    return round_doubles(E.boxplot_stats(fx.readings(spark, sf_dir), "pm2_5", "series_id"))


def _corr_sql(cols):
    parts = []
    for a in cols:
        for b in cols:
            if a == b:
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST(1.0 AS DOUBLE) AS corr")
            else:
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r6(corr_sql(a, b))} AS corr FROM readings")
    return " UNION ALL ".join(parts)


@register("a10_corr_matrix", fx.ctes("readings") + _corr_sql(NUM))
def a10_corr_matrix(spark, sf_dir):
    return E.corr_matrix(fx.readings(spark, sf_dir), NUM, digits=6)


@register("a11_corr_with_target", fx.ctes("training") + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r6(corr_sql(c, 'target_h1'))} AS corr FROM training"
    for c in TRAINING_FEATURES))
def a11_corr_with_target(spark, sf_dir):
    return E.corr_with(fx.training_rows(spark, sf_dir), "target_h1", TRAINING_FEATURES, digits=6)


@register("a10_corr_matrix_blocks", ORACLE["a10_corr_matrix"])
def a10_corr_matrix_blocks(spark, sf_dir):
    """The same matrix from blocked Gram matrices."""
    return corr_matrix_blocks(fx.readings(spark, sf_dir), NUM, digits=6)


@register("a11_corr_with_target_blocks", ORACLE["a11_corr_with_target"])
def a11_corr_with_target_blocks(spark, sf_dir):
    return corr_with_blocks(fx.training_rows(spark, sf_dir), "target_h1", TRAINING_FEATURES, digits=6)


@register("a12_skewness", fx.ctes("readings") + f"""
SELECT series_id, count(pm2_5) AS n,
       {r6('avg(power(pm2_5 - m, 3)) / power(avg(power(pm2_5 - m, 2)), 1.5)')} AS skewness
FROM readings JOIN (SELECT series_id, avg(pm2_5) AS m FROM readings GROUP BY 1) USING (series_id)
GROUP BY 1""")
def a12_skewness(spark, sf_dir):
    return round_doubles(E.skewness(fx.readings(spark, sf_dir), "pm2_5", "series_id"))


@register("a13_binned_scatter", fx.ctes("readings") + """,
s AS (SELECT min(nitrogen_dioxide) AS x0, max(nitrogen_dioxide) AS x1, min(pm2_5) AS y0, max(pm2_5) AS y1
      FROM readings)
SELECT CAST(least(floor((CAST(nitrogen_dioxide AS DOUBLE) - x0) * (20 / CAST(x1 - x0 AS DOUBLE))), 19) AS INTEGER) AS bin_x,
       CAST(least(floor((pm2_5 - y0) * (20 / (y1 - y0))), 19) AS INTEGER) AS bin_y, count(*) AS n
FROM readings, s GROUP BY 1, 2""")
def a13_binned_scatter(spark, sf_dir):
    return E.binned_scatter(fx.readings(spark, sf_dir), "nitrogen_dioxide", "pm2_5", 20)


@register("a14_seeded_sample_200")
def a14_seeded_sample_200(spark, sf_dir):
    """Rows-only: Spark's xxhash64 has no DuckDB counterpart; stability is a pytest property."""
    return E.sample_rows(fx.training_rows(spark, sf_dir), 200, 42, key=["series_id", "datetime"])


WIDE_FEATS = ["pm10", "nitrogen_dioxide", "hour", "day_of_week", "pm2_5_lag_1", "pm2_5_lag_3", "pm2_5_lag_6",
              "pm2_5_lag_12", "pm2_5_lag_24", "pm2_5_roll_mean_6", "pm2_5_roll_mean_12", "pm2_5_roll_mean_24"]


@register("a15_top10_features", None)
def a15_top10_features(spark, sf_dir):
    wide = build_features(fx.readings(spark, sf_dir), WIDE.with_(digits=6))
    c = E.corr_with(wide, "target_h1", WIDE_FEATS, digits=6)
    return E.top_k(c.withColumn("importance", F.abs("corr")), "importance", 10, tiebreak="feature")


def _a15_sql():
    from airseries.plans.q_features import WIDE_SQL
    body = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r6(corr_sql(c, 'target_h1'))} AS corr FROM wide"
        for c in WIDE_FEATS)
    return (WIDE_SQL.replace("\nSELECT * FROM (", ",\nwide AS (SELECT * FROM (", 1)
            + f")\nSELECT feature, corr, abs(corr) AS importance FROM ({body}) "
              "ORDER BY importance DESC, feature LIMIT 10")


from airseries.plans.catalog import ORACLE  # noqa: E402
ORACLE["a15_top10_features"] = _a15_sql()


@register("a16_regression_metrics", fx.ctes("training") + f"""
SELECT series_id, count(*) AS n, {r6('sqrt(avg(power(target_h1 - lag_1, 2)))')} AS rmse,
       {r6('avg(abs(target_h1 - lag_1))')} AS mae,
       {r6('1 - sum(power(target_h1 - lag_1, 2)) / (var_pop(target_h1) * count(*))')} AS r2
FROM training GROUP BY 1""")
def a16_regression_metrics(spark, sf_dir):
    pred = fx.training_rows(spark, sf_dir).select("series_id", F.col("target_h1").alias("y"),
                                                   F.col("lag_1").alias("p"))
    return M.regression_metrics(pred, "y", "p", by="series_id", digits=6)


@register("a17_benchmark_table", fx.ctes("registry") + "SELECT horizon, " + ", ".join(
    f"min(rmse) FILTER (WHERE model_name = '{m}') AS {m}" for m in MODELS) + " FROM registry GROUP BY 1")
def a17_benchmark_table(spark, sf_dir):
    return M.benchmark_table(fx.registry(spark, sf_dir), MODELS)


@register("a5_gap_report_chunked", ORACLE["a5_gap_report"])
def a5_gap_report_chunked(spark, sf_dir):
    return Q.gap_report(fx.readings(spark, sf_dir), chunk_rows=100)


@register("a14_seeded_sample_portable", fx.ctes("training") + """,
k AS (SELECT *, CAST(date_diff('hour', TIMESTAMP '1970-01-01 00:00:00', datetime) AS BIGINT) * 256
                + CAST(ascii(series_id) AS BIGINT) AS row_key FROM training)
SELECT series_id, datetime, pm2_5, target_h1, row_key FROM k
ORDER BY (row_key * 2654435761 + 42) % 4294967296, row_key LIMIT 200""")
def a14_seeded_sample_portable(spark, sf_dir):
    """A14 with a numeric row key (hour index * 256 + code of the series'
    first letter; the five series start with distinct letters, so keys are
    unique and, the multiplier being odd, so are their hashes) so the SQL
    oracle reproduces the sample exactly."""
    tr = fx.training_rows(spark, sf_dir)
    hours = F.timestamp_diff("HOUR", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("datetime"))
    key = hours.cast("long") * 256 + F.ascii("series_id").cast("long")
    t = tr.select("series_id", "datetime", "pm2_5", "target_h1", key.alias("row_key"))
    return E.sample_by_numeric_key(t, "row_key", 200, 42)
