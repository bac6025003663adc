"""Window features: golden edges, chunked = unchunked, plan shape."""

from pyspark.sql import functions as F

from airseries.operators import features as W
from airseries.plans import fixtures as fx
from airseries.plans.presets import TRAINING, WIDE, INFERENCE
from tests.conftest import SF


def _series(spark, values, sid="a"):
    rows = [(sid, f"2024-01-01 {h:02d}:00:00", v) for h, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, t string, pm2_5 double").select(
        "series_id", F.col("t").cast("timestamp_ntz").alias("datetime"), "pm2_5")


def test_rolling_null_inside_window_and_short_series(spark):
    df = _series(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0]).unionByName(_series(spark, [1.0, 2.0], "b"))
    out = W.add_rolling(df, "pm2_5", (3,), stats=("mean", "std")).orderBy("series_id", "datetime").collect()
    means = [r["pm2_5_roll_mean_3"] for r in out]
    # a NULL inside the frame makes the value NULL until it leaves the frame
    assert means[:7] == [None, None, None, None, None, 5.0, 6.0]
    assert means[7:] == [None, None]
    assert out[5]["pm2_5_roll_std_3"] == 1.0


def test_w7_cuts_by_position_w6_keeps(spark):
    df = _series(spark, [1.0, None, 3.0, 4.0, 5.0])
    h = W.horizon_target(df, "pm2_5", 2).orderBy("datetime").collect()
    assert [r["target"] for r in h] == [3.0, 4.0, 5.0]
    t = W.with_targets(df, "pm2_5", horizons=(1,), rows_per_step=2).count()
    assert t == 5


def test_tail_split_latest(spark):
    df = _series(spark, [float(i) for i in range(10)])
    assert [r["pm2_5"] for r in W.tail_rows(df, 3).orderBy("datetime").collect()] == [7.0, 8.0, 9.0]
    s = W.time_split(df, 0.8).groupBy("split").count().collect()
    assert dict((r["split"], r["count"]) for r in s) == {"train": 8, "test": 2}
    assert W.latest_rows(df).first()["pm2_5"] == 9.0


def _same(a, b):
    cols = sorted(a.columns)
    return sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_chunked_equals_unchunked(spark):
    r = fx.readings(spark, SF["0.01"])
    for spec in (TRAINING.with_(digits=6), WIDE.with_(digits=6)):
        base = W.build_features(r, spec, chunk_rows=None)
        for b in (7, 50, 1000, W.CHUNK_ROWS):
            assert _same(base, W.build_features(r, spec, chunk_rows=b)), (spec, b)


def test_chunked_with_tiebreak_and_bucket(spark):
    raw = fx.raw_readings(spark, SF["0.01"])
    spec = INFERENCE.with_(lags=(1, 24), roll_mean=(12,), roll_std=(6,), calendar=(), digits=6,
                           targets=(("target_h1", 24),))
    base = W.build_features(raw, spec, tiebreak="event_id", chunk_rows=None)
    assert _same(base, W.build_features(raw, spec, tiebreak="event_id", chunk_rows=13))
    assert _same(base, W.build_features(raw, spec, tiebreak="event_id", bucket="minute"))


def test_null_keys_and_times_survive_every_plan(spark):
    """One result whatever the plan or the chunk size; NULL keys and times are kept."""
    r = fx.readings(spark, SF["0.001"]).select("series_id", "datetime", "pm2_5")
    odd = spark.createDataFrame([("view", None, 1.0), (None, None, 3.0)], r.schema)
    nullkey = r.limit(5).withColumn("series_id", F.lit(None).cast("string"))
    d = r.unionByName(odd).unionByName(nullkey)
    spec = WIDE.with_(digits=6, calendar=(), dropna=False)
    n = d.count()
    base = W.build_features(d, spec, chunk_rows=None)
    key = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    for b in (5, 40, W.CHUNK_ROWS):
        out = W.build_features(d, spec, chunk_rows=b)
        assert out.count() == n and key(out) == key(base)
    for a, b in ((W.time_split(d, 0.8, chunked=False), W.time_split(d, 0.8)),
                 (W.tail_rows(d, 3, chunked=False), W.tail_rows(d, 3)),
                 (W.horizon_target(d, "pm2_5", 2, chunk_rows=None), W.horizon_target(d, "pm2_5", 2, chunk_rows=9))):
        assert key(a) == key(b)


def test_dense_day_is_split(spark):
    """With a finer bucket one dense day is ranked by more than one task."""
    d = spark.range(4000).select(F.lit("s").alias("series_id"), F.col("id").alias("pm2_5"),
                                 F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 20)").alias("datetime"))
    o = W.with_ordinals(d, bucket="hour")
    assert o.groupBy(F.date_trunc("hour", "datetime")).count().agg(F.max("count")).first()[0] <= 180
    assert o.filter(F.col("_o") != F.col("pm2_5")).count() == 0


def test_ordinals_are_dense(spark):
    raw = fx.raw_readings(spark, SF["0.001"])
    o = W.with_ordinals(raw, tiebreak="event_id")
    chk = o.groupBy("series_id").agg(F.count("*").alias("n"), F.min("_o").alias("lo"), F.max("_o").alias("hi"),
                                     F.countDistinct("_o").alias("d"))
    assert chk.filter("lo != 0 OR hi != n - 1 OR d != n").count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_exchange_sort_window(spark):
    """All lags, rolling frames and leads of a preset share one Exchange,
    one Sort and one Window; no window runs on a single partition."""
    plan = _plan(W.build_features(fx.readings(spark, SF["0.001"]), WIDE, chunk_rows=None))
    assert plan.count("+- Window [") == 1, plan
    assert plan.count("+- Sort [") == 1, plan
    assert plan.count("Exchange hashpartitioning(series_id") == 1, plan
    assert "SinglePartition" not in plan


def test_partition_filter_pushed_below_window(spark):
    """A filter on the series key reaches the scan side of the window."""
    r = fx.readings(spark, SF["0.001"])
    df = W.build_features(r, WIDE, chunk_rows=None).filter(F.col("series_id") == "click")
    plan = _plan(df)
    assert plan.index("Filter") > plan.index("Window [") or "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in plan, plan


def test_position_paths_equal_window_paths(spark):
    r = fx.readings(spark, SF["0.01"]).select("series_id", "datetime", "pm2_5")
    assert _same(W.tail_rows(r, 24, chunked=False), W.tail_rows(r, 24))
    assert _same(W.time_split(r, 0.8, chunked=False), W.time_split(r, 0.8))
    assert _same(W.horizon_target(r, "pm2_5", 6, chunk_rows=None), W.horizon_target(r, "pm2_5", 6, chunk_rows=40))


def test_horizon_sweep_chunked_equal(spark):
    from airseries.operators.training import horizon_sweep
    from airseries.plans.presets import FINAL
    f = W.build_features(fx.readings(spark, SF["0.01"]), FINAL.with_(digits=6)).dropna()
    feats = ["lag_1", "lag_3", "roll_mean_6"]
    a = horizon_sweep(f, feats, "aqi_pm25", (1, 6, 24, 48), digits=6, chunk_rows=None)
    b = horizon_sweep(f, feats, "aqi_pm25", (1, 6, 24, 48), digits=6, chunk_rows=100)
    assert _same(a, b)


def test_chunk_groups_are_bounded(spark):
    """The chunked plan's window groups never exceed chunk + halo rows, while
    the longest series is far larger (the skew bound the plan exists for)."""
    raw = fx.raw_readings(spark, SF["0.1"])
    B, lb, ld = 40, 24, 24
    o = W.with_ordinals(raw, tiebreak="event_id")
    groups = (o.withColumn("_chunk", F.explode(W.chunk_range(F.col("_o"), lb, ld, B)))
               .groupBy("series_id", "_chunk").count())
    biggest_group = groups.agg(F.max("count")).first()[0]
    longest_series = raw.groupBy("series_id").count().agg(F.max("count")).first()[0]
    assert biggest_group <= B + lb + ld < longest_series


def test_range_build_equals_full_build(spark):
    r = fx.readings(spark, SF["0.01"])
    for spec in (WIDE.with_(digits=6), TRAINING.with_(digits=6), INFERENCE.with_(digits=6)):
        for start, end in (("2024-01-10", "2024-01-12"), ("2024-01-01", "2024-01-03"),
                           ("2024-01-28", "2024-02-05")):
            full = W.build_features(r, spec).filter((F.col("datetime") >= F.lit(start).cast("timestamp_ntz")) &
                                                   (F.col("datetime") < F.lit(end).cast("timestamp_ntz")))
            part = W.build_features_range(r, spec, start, end)
            assert _same(full, part), (spec, start, end)


def test_pieces_bound_every_task(spark):
    """A dense day, a far outlier and ties: every piece stays small, every row belongs to one."""
    B, lb, ld = 50, 24, 24
    d = spark.range(6000).select(
        F.lit("s").alias("series_id"), F.col("id").alias("pm2_5"),
        F.when(F.col("id") == 0, F.expr("timestamp_ntz'1700-01-01'")).otherwise(
            F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id div 3)")).alias("datetime"))
    d = d.unionByName(d.where("pm2_5 < 10").withColumn("series_id", F.lit("short")))
    p = W.in_pieces(d, lb, ld, chunk_rows=B)
    assert p.where("_own").count() == d.count()
    sizes = [r["count"] for r in p.groupBy("series_id", "_piece").count().collect()]
    assert len(sizes) > 100 and max(sizes) <= B + lb + ld + 5 * 3  # a second holds three rows
    out = W.build_features(d, WIDE.with_(calendar=(), dropna=False), tiebreak="pm2_5", chunk_rows=B)
    base = W.build_features(d, WIDE.with_(calendar=(), dropna=False), tiebreak="pm2_5", chunk_rows=None)
    assert sorted(map(repr, out.select(sorted(out.columns)).collect())) == sorted(map(repr, base.select(sorted(base.columns)).collect()))
    o = W.with_position(d, tiebreak="pm2_5", chunk_rows=B).where("series_id = 's'")
    assert o.where("_o <> pm2_5 OR _n <> 6000").count() == 0


def test_one_full_shuffle(spark):
    """Rows pass one exchange, by (series, piece); the others carry counts."""
    plan = _plan(W.build_features(fx.readings(spark, SF["0.001"]), WIDE))
    assert plan.count("Exchange hashpartitioning(series_id#") >= 1
    full = [x for x in plan.splitlines() if "Exchange hashpartitioning(series_id" in x and "_piece" in x]
    assert len(full) == 1, plan
    assert plan.count("_lag_24") and "BroadcastHashJoin" in plan


def test_tail_is_cut_before_the_shuffle(spark):
    r = fx.readings(spark, SF["0.01"]).select("series_id", "datetime", "pm2_5")
    plan = _plan(W.tail_rows(r, 24))
    assert plan.index("WindowGroupLimit [series_id") < plan.rindex("WindowGroupLimit [series_id"), plan
    assert "Partial" in plan
    base = W.tail_rows(r, 24)
    old = W._GROUP_LIMIT
    try:
        W._GROUP_LIMIT = 0  # by position and by window
        assert _same(base, W.tail_rows(r, 24)) and _same(base, W.tail_rows(r, 24, chunked=False))
    finally:
        W._GROUP_LIMIT = old
    assert W.tail_rows(r, 0).count() == 0 and _same(r, W.tail_rows(r, 100_000))
