"""Queries for window features (W*) and projections (F*)."""

from airseries.operators import features as W
from airseries.plans import fixtures as fx
from airseries.plans.catalog import register
from airseries.plans.presets import TRAINING, FINAL

R6 = 6


@register("w14_training_preset", fx.ctes("training") + "SELECT * FROM training")
def w14_training_preset(spark, sf_dir):
    return W.build_features(fx.readings(spark, sf_dir), TRAINING.with_(digits=R6))


from airseries.operators import projection as P  # noqa: E402
from airseries.plans.presets import WIDE, INFERENCE, TRAINING_FEATURES  # noqa: E402
from airseries.plans.sqlgen import roll, shift, win  # noqa: E402

BASE = "series_id, datetime, pm2_5"


def _rd(spark, sf_dir):
    return fx.readings(spark, sf_dir)


# ---- W1 / W2: row-based lags -------------------------------------------------

@register("w1_lags_long", fx.ctes("readings") + f"""
SELECT {BASE}, {', '.join(shift('pm2_5', k, f'pm2_5_lag_{k}') for k in (1, 6, 12, 24, 48, 72, 168))}
FROM readings""")
def w1_lags_long(spark, sf_dir):
    r = _rd(spark, sf_dir).select("series_id", "datetime", "pm2_5")
    return W.add_lags(r, "pm2_5", (1, 6, 12, 24, 48, 72, 168))


@register("w2_lags_wide", fx.ctes("readings") + f"""
SELECT {BASE}, {', '.join(shift('pm2_5', k, f'pm2_5_lag_{k}') for k in (1, 3, 6, 12, 24))}
FROM readings""")
def w2_lags_wide(spark, sf_dir):
    r = _rd(spark, sf_dir).select("series_id", "datetime", "pm2_5")
    return W.add_lags(r, "pm2_5", (1, 3, 6, 12, 24))


@register("w1_lags_raw_series_tiebreak", fx.ctes("raw_readings") + f"""
SELECT series_id, event_id, datetime, pm2_5,
       {', '.join(shift('pm2_5', k, f'pm2_5_lag_{k}', order='datetime, event_id') for k in (1, 24))}
FROM raw_readings""")
def w1_lags_raw_series_tiebreak(spark, sf_dir):
    r = fx.raw_readings(spark, sf_dir)
    return W.add_lags(r, "pm2_5", (1, 24), tiebreak="event_id")


# ---- W3 / W12: shared training/inference build --------------------------------

@register("w12_final_features", fx.ctes("final") + "SELECT * FROM final")
def w12_final_features(spark, sf_dir):
    return W.build_features(_rd(spark, sf_dir), FINAL.with_(digits=R6))


@register("w3_lags_of_alias", fx.ctes("final") + """
SELECT series_id, datetime, aqi_pm25, lag_1, lag_3, lag_6 FROM final""")
def w3_lags_of_alias(spark, sf_dir):
    r = P.alias_target(_rd(spark, sf_dir).select("series_id", "datetime", "pm2_5"))
    return W.add_lags(r, "aqi_pm25", (1, 3, 6), name="lag_{k}").drop("pm2_5")


# ---- W4 / W5: rolling statistics ----------------------------------------------

@register("w4_w5_rolling", fx.ctes("readings") + f"""
SELECT {BASE}, {', '.join(roll('pm2_5', n, f'pm2_5_roll_mean_{n}') for n in (6, 12, 24, 48))},
       {', '.join(roll('pm2_5', n, f'pm2_5_roll_std_{n}', fn='stddev_samp') for n in (6, 12, 24, 48))}
FROM readings""")
def w4_w5_rolling(spark, sf_dir):
    r = _rd(spark, sf_dir).select("series_id", "datetime", "pm2_5")
    return W.add_rolling(r, "pm2_5", (6, 12, 24, 48), digits=R6)


# ---- W6 / W7: targets -----------------------------------------------------------

@register("w6_targets", fx.ctes("readings") + f"""
SELECT {BASE}, {', '.join(shift('pm2_5', 24 * h, f'target_h{h}', 'lead') for h in (1, 2, 3))}
FROM readings""")
def w6_targets(spark, sf_dir):
    return W.with_targets(_rd(spark, sf_dir).select("series_id", "datetime", "pm2_5"))


@register("w7_horizon_target_6h", fx.ctes("readings") + f"""
SELECT series_id, datetime, pm2_5 AS aqi_pm25, target FROM (
  SELECT series_id, datetime, pm2_5, lead(pm2_5, 6) OVER {win()} AS target,
         row_number() OVER (PARTITION BY series_id ORDER BY datetime DESC) AS rn_desc
  FROM readings) WHERE rn_desc > 6""")
def w7_horizon_target_6h(spark, sf_dir):
    r = P.alias_target(_rd(spark, sf_dir)).select("series_id", "datetime", "aqi_pm25")
    return W.horizon_target(r, "aqi_pm25", 6)


# ---- W8: gaps --------------------------------------------------------------------

@register("w8_gaps", fx.ctes("readings") + f"""
SELECT series_id, datetime,
       CAST(date_diff('second', lag(datetime) OVER {win()}, datetime) AS BIGINT) AS gap_seconds
FROM readings""")
def w8_gaps(spark, sf_dir):
    return W.gaps(_rd(spark, sf_dir).select("series_id", "datetime"))


# ---- W9 / W10 / W11 -----------------------------------------------------------------

@register("w9_tail_24", fx.ctes("readings") + """
SELECT series_id, datetime, pm2_5 FROM (
  SELECT series_id, datetime, pm2_5,
         row_number() OVER (PARTITION BY series_id ORDER BY datetime DESC) AS rn FROM readings)
WHERE rn <= 24""")
def w9_tail_24(spark, sf_dir):
    return W.tail_rows(_rd(spark, sf_dir).select("series_id", "datetime", "pm2_5"), 24)


@register("w10_time_split", fx.ctes("readings") + f"""
SELECT series_id, datetime, pm2_5,
       CASE WHEN row_number() OVER {win()} <= floor(CAST(0.8 AS DOUBLE) * count(*) OVER (PARTITION BY series_id))
            THEN 'train' ELSE 'test' END AS split
FROM readings""")
def w10_time_split(spark, sf_dir):
    return W.time_split(_rd(spark, sf_dir).select("series_id", "datetime", "pm2_5"), 0.8)


@register("w11_latest_rows", fx.ctes("readings") + """
SELECT series_id, max(datetime) AS datetime, arg_max(pm2_5, datetime) AS pm2_5,
       arg_max(pm10, datetime) AS pm10, arg_max(nitrogen_dioxide, datetime) AS nitrogen_dioxide
FROM readings GROUP BY 1""")
def w11_latest_rows(spark, sf_dir):
    return W.latest_rows(_rd(spark, sf_dir))


# ---- W13: wide preset, plus its halo-chunked plan -------------------------------------

WIDE_SQL = fx.ctes("readings") + f"""
SELECT * FROM (
  SELECT series_id, datetime, pm2_5, pm10, nitrogen_dioxide,
         CAST(hour(datetime) AS INTEGER) AS hour, CAST(isodow(datetime) - 1 AS INTEGER) AS day_of_week,
         {', '.join(shift('pm2_5', k, f'pm2_5_lag_{k}') for k in (1, 3, 6, 12, 24))},
         {', '.join(roll('pm2_5', n, f'pm2_5_roll_mean_{n}') for n in (6, 12, 24))},
         {', '.join(shift('pm2_5', 24 * h, f'target_h{h}', 'lead') for h in (1, 2, 3))}
  FROM readings)
WHERE COLUMNS(*) IS NOT NULL"""


@register("w13_wide_preset", WIDE_SQL)
def w13_wide_preset(spark, sf_dir):
    return W.build_features(_rd(spark, sf_dir), WIDE.with_(digits=R6))


@register("w13_wide_preset_chunked", WIDE_SQL)
def w13_wide_preset_chunked(spark, sf_dir):
    """Same result through the skew-tolerant plan (chunks of 100 rows + halo)."""
    return W.build_features(_rd(spark, sf_dir), WIDE.with_(digits=R6), chunk_rows=100)


@register("w13_inference_set_chunked", fx.ctes("raw_readings") + f"""
SELECT series_id, event_id, datetime, pm2_5,
       {', '.join(shift('pm2_5', k, f'pm2_5_lag_{k}', order='datetime, event_id') for k in (1, 6, 24))},
       {roll('pm2_5', 12, 'pm2_5_roll_mean_12', order='datetime, event_id')},
       {roll('pm2_5', 12, 'pm2_5_roll_std_12', fn='stddev_samp', order='datetime, event_id')},
       {shift('pm2_5', 24, 'target_h1', 'lead', order='datetime, event_id')}
FROM raw_readings""")
def w13_inference_set_chunked(spark, sf_dir):
    """Raw per-user series ordered by (ts, event_id), chunked window plan."""
    spec = INFERENCE.with_(lags=(1, 6, 24), roll_mean=(12,), roll_std=(12,), calendar=(),
                           targets=(("target_h1", 24),), digits=R6)
    return W.build_features(fx.raw_readings(spark, sf_dir), spec, tiebreak="event_id", chunk_rows=50)


def _full_inference_sql() -> str:
    o = "datetime, event_id"
    cols = [shift("pm2_5", k, f"pm2_5_lag_{k}", order=o) for k in INFERENCE.lags]
    cols += [roll("pm2_5", n, f"pm2_5_roll_mean_{n}", order=o) for n in INFERENCE.roll_mean]
    cols += [roll("pm2_5", n, f"pm2_5_roll_std_{n}", fn="stddev_samp", order=o) for n in INFERENCE.roll_std]
    return fx.ctes("raw_readings") + f"""
SELECT series_id, event_id, datetime, pm2_5, CAST(hour(datetime) AS INTEGER) AS hour, CAST(day(datetime) AS INTEGER) AS day,
       CAST(month(datetime) AS INTEGER) AS month, CAST(isodow(datetime) - 1 AS INTEGER) AS dayofweek,
       {', '.join(cols)}
FROM raw_readings"""


@register("w13_inference_preset", _full_inference_sql())
def w13_inference_preset(spark, sf_dir):
    """The whole inference preset in one build: seven lags, four means, four deviations, calendar."""
    return W.build_features(fx.raw_readings(spark, sf_dir), INFERENCE.with_(digits=R6), tiebreak="event_id")


# ---- F1-F9 ------------------------------------------------------------------------

@register("f1_feature_projection", fx.ctes("training") + f"SELECT {', '.join(TRAINING_FEATURES)} FROM training")
def f1_feature_projection(spark, sf_dir):
    return P.select_features(fx.training_rows(spark, sf_dir), TRAINING_FEATURES)


@register("f2_drop_key_targets", fx.ctes("training") + """
SELECT * EXCLUDE (datetime, target_h1, target_h2, target_h3) FROM training""")
def f2_drop_key_targets(spark, sf_dir):
    return P.drop_key_and_targets(fx.training_rows(spark, sf_dir), "datetime",
                                  ["target_h1", "target_h2", "target_h3", "target_h9"])


@register("f3_non_target_projection", fx.ctes("training") + """
SELECT * EXCLUDE (target_h1, target_h2, target_h3) FROM training""")
def f3_non_target_projection(spark, sf_dir):
    return P.non_target_columns(fx.training_rows(spark, sf_dir))


@register("f4_numeric_only", fx.ctes("final") + """
SELECT * EXCLUDE (series_id, datetime) FROM final""")
def f4_numeric_only(spark, sf_dir):
    return P.numeric_only(W.build_features(_rd(spark, sf_dir), FINAL.with_(digits=R6)))


@register("f5_alias_target", fx.ctes("readings") + "SELECT *, pm2_5 AS aqi_pm25 FROM readings")
def f5_alias_target(spark, sf_dir):
    return P.alias_target(_rd(spark, sf_dir))


@register("f6_dropna_any", fx.ctes("final") + "SELECT * FROM final WHERE COLUMNS(*) IS NOT NULL")
def f6_dropna_any(spark, sf_dir):
    return P.drop_incomplete(W.build_features(_rd(spark, sf_dir), FINAL.with_(digits=R6)))


@register("f7_dropna_required", fx.ctes("final") + """
SELECT * FROM final WHERE lag_1 IS NOT NULL AND lag_6 IS NOT NULL""")
def f7_dropna_required(spark, sf_dir):
    df = W.build_features(_rd(spark, sf_dir), FINAL.with_(digits=R6))
    return P.drop_incomplete(df, ["lag_1", "lag_6", "pm2_5_lag_168"])


@register("f8_fill_zero", fx.ctes("final") + """
SELECT series_id, datetime, coalesce(lag_6, 0) AS lag_6, coalesce(roll_mean_12, 0) AS roll_mean_12,
       CAST(0 AS DOUBLE) AS temperature_2m FROM final""")
def f8_fill_zero(spark, sf_dir):
    df = W.build_features(_rd(spark, sf_dir), FINAL.with_(digits=R6))
    return P.fill_missing(df, ["lag_6", "roll_mean_12", "temperature_2m"]) \
            .select("series_id", "datetime", "lag_6", "roll_mean_12", "temperature_2m")


@register("f9_registry_lookup", fx.ctes("registry") + """
SELECT model_name, horizon, rmse, run_id FROM registry WHERE horizon = 2 AND status = 'candidate'""")
def f9_registry_lookup(spark, sf_dir):
    return P.lookup(fx.registry(spark, sf_dir), horizon=2, status="candidate") \
            .select("model_name", "horizon", "rmse", "run_id")


# ---- skew-safe (position-based / halo-chunked) variants, same oracle SQL ----------------

from airseries.plans.catalog import ORACLE as _ORACLE  # noqa: E402


def _same_sql(name, fn_name):
    def deco(fn):
        register(fn_name, _ORACLE[name])(fn)
        return fn
    return deco


@_same_sql("w9_tail_24", "w9_tail_24_chunked")
def w9_tail_24_chunked(spark, sf_dir):
    return W.tail_rows(_rd(spark, sf_dir).select("series_id", "datetime", "pm2_5"), 24, chunked=True)


@_same_sql("w10_time_split", "w10_time_split_chunked")
def w10_time_split_chunked(spark, sf_dir):
    return W.time_split(_rd(spark, sf_dir).select("series_id", "datetime", "pm2_5"), 0.8, chunked=True)


@_same_sql("w7_horizon_target_6h", "w7_horizon_target_6h_chunked")
def w7_horizon_target_6h_chunked(spark, sf_dir):
    r = P.alias_target(_rd(spark, sf_dir)).select("series_id", "datetime", "aqi_pm25")
    return W.horizon_target(r, "aqi_pm25", 6, chunk_rows=100)


@_same_sql("w14_training_preset", "w14_training_preset_chunked")
def w14_training_preset_chunked(spark, sf_dir):
    return W.build_features(_rd(spark, sf_dir), TRAINING.with_(digits=R6), chunk_rows=100)


@register("w13_wide_preset_range", WIDE_SQL + """
  AND datetime >= TIMESTAMP '2024-01-10 00:00:00' AND datetime < TIMESTAMP '2024-01-20 00:00:00'""")
def w13_wide_preset_range(spark, sf_dir):
    """Incremental build of one date range (row-counted halo, no full-history build)."""
    return W.build_features_range(_rd(spark, sf_dir), WIDE.with_(digits=R6), "2024-01-10 00:00:00",
                                  "2024-01-20 00:00:00")
