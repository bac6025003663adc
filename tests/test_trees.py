"""Histogram ensembles: partitions, blocks, bags, persistence, edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from airseries.operators import explain as X
from airseries.operators import training as TR
from airseries.operators import trees as HT
from airseries.sources.models import load_model, save_model


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(400).select(
        (F.col("id") % 17).cast("double").alias("a"), (F.col("id") * 7 % 23).cast("double").alias("b"), F.lit(1.0).alias("c"),
        ((F.col("id") % 17 > 8).cast("double") * 10 + (F.col("id") * 7 % 23 > 11).cast("double") * 3).alias("y"))


def _arrays(m):
    return [np.concatenate(x).tolist() for x in (m.feature, m.cut, m.value, m.gain, m.cover)]


def test_known_splits_are_found(rows):
    m = HT.fit_trees(rows, ["a", "b", "c"], "y", "boosted", 1, 2)
    assert m.feature[0][:3].tolist() == [0, 1, 1]
    assert m.edges[0][m.cut[0][0]] == 8.0 and len(m.edges[2]) == 0
    got = TR.predict(m, rows, "p").where("abs(p - y) > 1e-6").count()
    assert got == 0  # two levels hold the whole label


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_model_does_not_depend_on_partitions_or_blocks(rows, kind, monkeypatch):
    args = (["a", "b", "c"], "y", kind, 4, 3)
    one = _arrays(HT.fit_trees(rows.coalesce(1), *args))
    assert one == _arrays(HT.fit_trees(rows.repartition(7, "b"), *args))
    monkeypatch.setattr(HT, "CELLS", 200)  # one tree a pass at the deeper levels
    assert one == _arrays(HT.fit_trees(rows, *args))


def test_bags_are_poisson():
    w = np.concatenate([HT.bag_weight(np.arange(20_000), t, 42) for t in range(3)])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert not np.array_equal(HT.bag_weight(np.arange(100), 0, 42), HT.bag_weight(np.arange(100), 1, 42))


def test_candidates_persist_and_explain(spark, rows, tmpdir_path):
    small = {"random_forest": dict(trees=5, depth=3), "gradient_boosting": dict(trees=5), "boosted_deep": dict(trees=5, depth=2)}
    reg, models = TR.train_candidates(rows, rows, ["a", "b", "c"], "y", 1, "r", overrides=small, engine="histogram",
                                      save_base=tmpdir_path)
    assert {r["model_name"] for r in reg.collect()} == set(TR.CANDIDATES)
    for r in reg.collect():
        m = models[r["model_name"]]
        again = load_model(r["artifact"])
        both = TR.predict(m, rows, "p").withColumn("i", F.monotonically_increasing_id())
        assert [x["p"] for x in both.collect()] == [x["p"] for x in TR.predict(again, rows, "p").collect()]
    imp = {r["feature"]: r["importance"] for r in X.feature_importance(models["random_forest"], ["a", "b", "c"]).collect()}
    assert imp["a"] > imp["b"] > imp["c"] == 0 and abs(sum(imp.values()) - 1) < 1e-9
    assert save_model(models["ridge"], tmpdir_path, "ridge", 9, "v")


def test_missing_values(spark, rows):
    some = rows.withColumn("y", F.when(F.col("a") < 3, None).otherwise(F.col("y")))
    assert HT.fit_trees(some, ["a", "b"], "y", "boosted", 1, 1).cover[0][0] == some.where("y IS NOT NULL").count()
    with pytest.raises(Exception, match="a feature is missing"):
        HT.fit_trees(rows.withColumn("a", F.when(F.col("a") > 3, F.col("a"))), ["a", "b"], "y", "boosted", 1, 1)
    flat = HT.fit_trees(rows.withColumn("y", F.lit(2.5)), ["a"], "y", "forest", 2, 2)
    assert flat.predict([np.array([0.0, 99.0])]).tolist() == [2.5, 2.5]
