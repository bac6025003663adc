"""TreeSHAP: brute-force Shapley equality on small trees, additivity on ensembles."""

from itertools import combinations
from math import factorial

import numpy as np
from pyspark.sql import functions as F

from airseries.operators import training as TR
from airseries.operators import treeshap as TS
from airseries.operators.features import time_split
from airseries.plans import fixtures as fx
from airseries.plans.presets import TRAINING_FEATURES
from tests.conftest import SF


def _cond_exp(t, x, S, j=None):
    j = t["root"] if j is None else j
    if t["left"][j] < 0:
        return t["value"][j]
    a, b, d = t["left"][j], t["right"][j], t["feature"][j]
    if d in S:
        return _cond_exp(t, x, S, a if x[d] <= t["threshold"][j] else b)
    return (t["cover"][a] * _cond_exp(t, x, S, a) + t["cover"][b] * _cond_exp(t, x, S, b)) / t["cover"][j]


def _brute(t, x, M):
    phi = np.zeros(M)
    for i in range(M):
        others = [k for k in range(M) if k != i]
        for r in range(M):
            for S in combinations(others, r):
                w = factorial(r) * factorial(M - r - 1) / factorial(M)
                phi[i] += w * (_cond_exp(t, x, set(S) | {i}) - _cond_exp(t, x, set(S)))
    return phi


def test_matches_brute_force_and_additivity(spark):
    rows = fx.training_rows(spark, SF["0.001"], digits=None)
    feats = ["lag_1", "lag_3", "roll_mean_6", "hour"]
    m = TR.fit(rows, feats, "target_h1", "random_forest", numTrees=3, maxDepth=4)
    trees = TS.ensemble_tables(m, spark)
    X = rows.select(*[F.col(f).cast("double") for f in feats]).limit(20).toPandas().to_numpy()
    for t in trees:
        fast = TS.tree_shap(t, X)
        for r in range(5):
            assert np.allclose(fast[r], _brute(t, X[r], len(feats)), atol=1e-9)
    phi = TS.ensemble_shap(trees, X)
    pred = TR.predict(m, rows.limit(20), "p").select("p").toPandas()["p"].to_numpy()
    assert np.allclose(phi.sum(1) + TS.expected_value(trees), pred, atol=1e-8)


def test_explain_trees_gbt_additivity(spark):
    rows = time_split(fx.training_rows(spark, SF["0.001"], digits=None), 0.8)
    m = TR.fit(rows.filter("split = 'train'"), TRAINING_FEATURES, "target_h1", "gradient_boosting", maxIter=10)
    trees = TS.ensemble_tables(m, spark)
    shap = TS.explain_trees(rows, m, TRAINING_FEATURES)
    tot = shap.groupBy("series_id", "datetime").agg(F.sum("shap_value").alias("s"))
    pred = TR.predict(m, rows, "p").select("series_id", "datetime", "p")
    base = TS.expected_value(trees)
    bad = tot.join(pred, ["series_id", "datetime"]).filter(F.abs(F.col("s") + F.lit(base) - F.col("p")) > 1e-6)
    assert bad.count() == 0
    assert shap.filter("rank = 1").count() == rows.count()


def test_blocks_of_trees_add_up(spark, monkeypatch):
    """One tree a block gives the same values as all at once, for both kinds of ensembles."""
    from airseries.operators.trees import fit_trees
    rows = fx.training_rows(spark, SF["0.001"], digits=None)
    feats = ["lag_1", "lag_3", "roll_mean_6", "hour"]
    models = [TR.fit(rows, feats, "target_h1", "gradient_boosting", maxIter=3, maxDepth=3),
              fit_trees(rows, feats, "target_h1", "forest", 4, 3), fit_trees(rows, feats, "target_h1", "boosted", 3, 3, rate=0.3)]
    for m in models:
        whole = sorted(map(tuple, TS.explain_trees(rows, m, feats, digits=9).collect()))
        monkeypatch.setattr(TS, "BLOCK_BYTES", 1)
        assert len(list(TS.tree_blocks(m, spark))) in (3, 4)
        assert sorted(map(tuple, TS.explain_trees(rows, m, feats, digits=9).collect())) == whole
        monkeypatch.undo()
        trees = TS.ensemble_tables(m, spark)
        base = TS.expected_value(trees) + getattr(m, "base", 0.0)
        pred = {tuple(r[:2]): r[2] for r in TR.predict(m, rows, "p").select("series_id", "datetime", "p").collect()}
        total = {}
        for r in whole:
            total[r[:2]] = total.get(r[:2], base) + r[3]
        assert all(abs(total[k] - pred[k]) < 1e-6 for k in pred)
        x = rows.select(*[F.col(f).cast("double") for f in feats]).limit(3).toPandas().to_numpy()
        for t in trees[:2]:
            assert np.allclose(TS.tree_shap(t, x)[0], _brute(t, x[0], len(feats)), atol=1e-9)
