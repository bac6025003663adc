"""Registry transitions on literal edge frames and the fixture."""

import pytest
from pyspark.sql import functions as F

from airseries.operators import registry as R
from airseries.plans import fixtures as fx
from tests.conftest import SF

SCHEMA = ("model_name string, horizon int, rmse double, mae double, r2 double, artifact string, "
          "run_id string, status string, is_best boolean, registered_at timestamp_ntz")


def _reg(spark, rows):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([r + (t,) for r in rows], SCHEMA)


def _state(df):
    return {(r["model_name"], r["horizon"], r["run_id"]): (r["status"], r["is_best"]) for r in df.collect()}


def test_promote_best_tie_and_scope(spark):
    reg = _reg(spark, [
        ("b", 1, 2.0, 1.0, 0.5, None, "r1", "candidate", False),
        ("a", 1, 2.0, 1.0, 0.5, None, "r1", "candidate", False),   # equal rmse: name decides
        ("c", 1, 1.0, 1.0, 0.5, None, "r0", "production", True),
        ("d", 2, 1.0, 1.0, 0.5, None, "r0", "production", True),   # horizon without candidate
    ])
    st = _state(R.promote_best(reg))
    assert st[("a", 1, "r1")] == ("production", True)
    assert st[("b", 1, "r1")] == ("archived", False)
    assert st[("c", 1, "r0")] == ("archived", False)
    assert st[("d", 2, "r0")] == ("production", True)
    with pytest.raises(RuntimeError):
        R.promote_best(reg, horizon=2)


def test_promote_run_archives_only_production(spark):
    reg = _reg(spark, [
        ("x", 1, 3.0, 1.0, 0.5, None, "old", "candidate", False),
        ("y", 1, 1.0, 1.0, 0.5, None, "old", "production", True),
        ("z", 1, 2.0, 1.0, 0.5, None, "new", "candidate", False),
        ("w", 2, 2.0, 1.0, 0.5, None, "old", "production", True),
    ])
    st = _state(R.promote_run(reg, "new"))
    assert st[("z", 1, "new")] == ("production", True)
    assert st[("y", 1, "old")] == ("archived", False)
    assert st[("x", 1, "old")] == ("candidate", False)      # R3 would archive it, R2 does not
    assert st[("w", 2, "old")] == ("production", True)      # horizon not touched by the run


def test_rollback(spark):
    reg = _reg(spark, [
        ("a", 1, 1.0, 1.0, 0.5, None, "r1", "archived", False),
        ("b", 1, 2.0, 1.0, 0.5, None, "r2", "production", True),
    ])
    st = _state(R.rollback(reg, 1, "r1"))
    assert st[("a", 1, "r1")] == ("archived", True) and st[("b", 1, "r2")] == ("production", False)
    with pytest.raises(RuntimeError):
        R.rollback(reg, 1, "unknown")


def test_single_best_invariant_after_transitions(spark):
    reg = fx.registry(spark, SF["0.01"]).drop("features")
    R.assert_single_best(R.promote_best(reg))                       # every horizon has a candidate
    R.assert_single_best(R.rollback(reg, 2, "run_0").filter("horizon = 2"))
    touched = [r["horizon"] for r in reg.filter("run_id = 'run_1'").select("horizon").distinct().collect()]
    R.assert_single_best(R.promote_run(reg, "run_1").filter(F.col("horizon").isin(touched)))


def test_upsert_first_match_and_insert(spark):
    reg = _reg(spark, [("a", 1, 1.0, 1.0, 0.5, "p1", "r1", "production", True)])
    new = spark.createDataFrame([("a", 1, "p2", "v2"), ("a", 5, "p5", "v5")],
                                "model_name string, horizon int, artifact string, model_version string")
    out = {(r["model_name"], r["horizon"]): r for r in R.upsert(reg, new).collect()}
    assert out[("a", 1)]["artifact"] == "p2" and out[("a", 1)]["rmse"] == 1.0
    assert out[("a", 1)]["is_best"] is False and out[("a", 1)]["model_version"] == "v2"
    assert out[("a", 5)]["rmse"] is None and out[("a", 5)]["artifact"] == "p5"


def test_load_active_later_wins_and_errors(spark):
    df = spark.createDataFrame([("m1", 24, "active", 1), ("m2", 24, "active", 2), ("m3", 48, "inactive", 3)],
                               "model_name string, horizon_hours int, status string, position int")
    out = R.load_active(df).collect()
    assert [(r["horizon_hours"], r["model_name"]) for r in out] == [(24, "m2")]
    with pytest.raises(RuntimeError):
        R.load_active(df.filter("status = 'inactive'"))


def test_rollback_leaves_slots_without_the_run(spark):
    reg = _reg(spark, [("a", 1, 1.0, 1.0, 0.5, None, "r1", "archived", False), ("b", 1, 2.0, 1.0, 0.5, None, "r2", "production", True)])
    both = reg.withColumn("series_id", F.lit("A")).unionByName(
        reg.filter("run_id = 'r2'").withColumn("series_id", F.lit("B")))
    out = {(r["series_id"], r["model_name"]): r["is_best"] for r in R.rollback(both, 1, "r1", key=("series_id", "horizon")).collect()}
    assert out == {("A", "a"): True, ("A", "b"): False, ("B", "b"): True}


def test_several_new_rows_of_a_slot(spark):
    reg = _reg(spark, [("old", 1, 3.0, 1.0, 0.5, None, "r0", "production", True)])
    new = _reg(spark, [("x", 1, 2.0, 1.0, 0.5, None, "r1", "", None), ("y", 1, 1.0, 1.0, 0.5, None, "r1", "", None)])
    out = R.publish(reg, new.drop("status", "is_best"))
    R.assert_single_best(out)
    assert _state(out)[("y", 1, "r1")] == ("production", True) and _state(out)[("x", 1, "r1")] == ("archived", False)
    two = spark.createDataFrame([("old", 1, "v2", "b"), ("old", 1, "v1", "a")],
                                "model_name string, horizon int, artifact string, run_id string")
    got = R.upsert(reg, two).collect()
    assert len(got) == 1 and got[0]["artifact"] == "v2"
    assert R.best_model(reg.unionByName(reg), 1).count() == 1


def test_file_registry_keeps_append_order(spark, tmpdir_path):
    from airseries.sources import registry_file as RF
    path = f"{tmpdir_path}/reg"
    for i in (3, 9, 1, 7):
        m = spark.createDataFrame([(f"m{i}", 24, 1.0, 0.5, ["f"])],
                                  "model_name string, horizon_hours int, rmse double, r2 double, features array<string>")
        RF.append_entries(RF.entries(m, "active"), path)
        assert R.load_active(RF.read_entries(spark, path)).first()["model_name"] == f"m{i}"
