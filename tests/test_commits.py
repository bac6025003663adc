"""Concurrent writers: no update is lost, readers see versions whole, day refreshes write days."""

import datetime as dt
import os
import threading

from pyspark.sql import functions as F

from airseries.operators.features import build_features
from airseries.plans import fixtures as fx
from airseries.plans import jobs
from airseries.plans.presets import FINAL
from airseries.sources import registry_file as RF
from airseries.sources import tables as TB
from tests.conftest import SF


def _add(spark, name):
    def transition(df):
        one = spark.createDataFrame([(name,)], "name string")
        return one if df is None else df.unionByName(one)
    return transition


def test_claim_has_one_winner(spark, tmpdir_path):
    won, path = [], f"{tmpdir_path}/c/v1.json"
    threads = [threading.Thread(target=lambda i=i: won.append((TB.claim(spark, path, f"text {i}"), i))) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    winners = [i for ok, i in won if ok]
    assert len(winners) == 1 and open(path).read() == f"text {winners[0]}"
    assert [f for f in os.listdir(f"{tmpdir_path}/c") if f.startswith(".draft")] == []


def test_update_is_replayed_on_the_newer_version(spark, tmpdir_path):
    base, calls = f"{tmpdir_path}/t", []
    TB.update_table(spark, base, _add(spark, "first"))

    def slow(df):
        calls.append(df.count())
        if len(calls) == 1:  # another writer publishes in between
            TB.update_table(spark, base, _add(spark, "other"))
        return _add(spark, "slow")(df)

    TB.update_table(spark, base, slow)
    assert calls == [1, 2]
    assert sorted(r[0] for r in TB.read_table(spark, base).collect()) == ["first", "other", "slow"]
    assert len([f for f in os.listdir(base) if f.startswith("v=")]) == 3  # the losing write is gone


def test_two_writers_at_once_lose_nothing(spark, tmpdir_path):
    base, start = f"{tmpdir_path}/t", threading.Barrier(3)
    TB.overwrite_table(spark.createDataFrame([("zero",)], "name string"), base)

    def work(i):
        start.wait()
        for k in range(2):
            TB.update_table(spark, base, _add(spark, f"{i}-{k}"))

    threads = [threading.Thread(target=work, args=(i,)) for i in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r[0] for r in TB.read_table(spark, base).collect()) == sorted(["zero"] + [f"{i}-{k}" for i in range(3) for k in range(2)])


def test_registry_update_during_training(spark, tmpdir_path, monkeypatch):
    """A row that another job registers while models are fitted is still there afterwards."""
    base, now = tmpdir_path, dt.datetime(2024, 2, 1)
    TB.overwrite_table(fx.readings(spark, SF["0.01"]), f"{base}/readings")
    args = dict(horizons=(1,), name="ridge", now=now)
    jobs.train_horizons(spark, f"{base}/readings", f"{base}/registry", f"{base}/models", run_id="a", **args)
    real = jobs.train_candidates

    def fit(*a, **kw):
        out = real(*a, **kw)
        TB.update_table(spark, f"{base}/registry", lambda df: df.unionByName(
            df.limit(1).withColumns({"run_id": F.lit("other"), "horizon": F.lit(9)})))
        return out

    monkeypatch.setattr(jobs, "train_candidates", fit)
    reg = jobs.train_horizons(spark, f"{base}/readings", f"{base}/registry", f"{base}/models", run_id="b", **args)
    assert sorted((r["run_id"], r["status"]) for r in reg.where("horizon = 1").collect()) == [("a", "archived"), ("b", "production")]
    assert reg.where("run_id = 'other'").count() == 1


def test_appends_at_once_have_their_own_numbers(spark, tmpdir_path):
    rows = spark.createDataFrame([("rf", 24, 3.1, 0.9, ["a"])], "model_name string, horizon_hours int, rmse double, r2 double, features array<string>")
    path, start = f"{tmpdir_path}/reg", threading.Barrier(4)

    failed = []

    def work(i):
        start.wait()
        try:
            RF.append_entries(RF.entries(rows.withColumn("model_name", F.lit(f"m{i}")), "active"), path)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    got = RF.read_entries(spark, path).select("model_name", "position.append").collect()
    assert len(got) == 4 and len({r["append"] for r in got}) == 4


def _bytes(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_day_refresh_writes_its_days_only(spark, tmpdir_path):
    base = tmpdir_path
    all_ = fx.readings(spark, SF["0.01"])
    all_ = all_.unionByName(all_.limit(1).withColumn("datetime", F.lit(None).cast("timestamp_ntz")))
    TB.overwrite_table(all_, f"{base}/readings")
    jobs.refresh_features(spark, f"{base}/readings", f"{base}/features")
    before = _bytes(f"{base}/features")
    whole = TB.read_table(spark, f"{base}/features")
    changed = all_.withColumn("pm2_5", F.when(F.to_date("datetime") == "2024-01-12", F.col("pm2_5") + 5).otherwise(F.col("pm2_5")))
    TB.overwrite_table(changed, f"{base}/readings")
    days = jobs.refresh_feature_days(spark, f"{base}/readings", f"{base}/features", "2024-01-12", "2024-01-13")
    after = _bytes(f"{base}/features")
    assert 1 <= days <= 3 and all(after[f] == n for f, n in before.items())
    new = sum(n for f, n in after.items() if f not in before and "_manifests" not in f)
    assert new < 0.2 * sum(n for f, n in before.items() if "_manifests" not in f)
    assert whole.count() == all_.count()  # a reader of the old version still has all its files
    got = TB.read_table(spark, f"{base}/features")
    want = build_features(changed, FINAL)
    cols = sorted(want.columns)
    assert sorted(map(repr, got.select(cols).collect())) == sorted(map(repr, want.select(cols).collect()))


def test_one_folder_table_becomes_a_manifest(spark, tmpdir_path):
    base = f"{tmpdir_path}/f"
    r = fx.readings(spark, SF["0.001"])
    TB.overwrite_table(r, base)
    day = "2024-01-03"
    n = TB.replace_days(spark, base, lambda old: (old.where(F.to_date("datetime") == day).withColumn("pm2_5", F.lit(-1.0)), [day]))
    got = TB.read_table(spark, base)
    assert n == 1 and got.count() == r.count() and got.where("pm2_5 = -1").count() == r.where(F.to_date("datetime") == day).count()
    assert TB.replace_days(spark, base, lambda old: (old.where("false"), [day])) == 0
    assert TB.read_table(spark, base).count() == r.where(F.to_date("datetime") != day).count()
