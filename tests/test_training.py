"""Training, forecasting and attribution properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from airseries.operators import explain as X
from airseries.operators import forecast as FC
from airseries.operators import training as TR
from airseries.operators.features import time_split
from airseries.plans import fixtures as fx
from airseries.plans.presets import TRAINING_FEATURES
from tests.conftest import SF


def _ridge_np(X_, y, alpha=1.0):
    xm, ym = X_.mean(0), y.mean()
    Xc, yc = X_ - xm, y - ym
    w = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(X_.shape[1]), Xc.T @ yc)
    return w, ym - xm @ w


def test_mllib_ridge_matches_closed_form(spark):
    tr = fx.training_rows(spark, SF["0.01"], digits=None)
    feats = ["lag_1", "lag_3", "roll_mean_6", "hour"]
    m = TR.fit(tr, feats, "target_h1", "ridge")
    pdf = tr.select(*feats, "target_h1").toPandas()
    w, b = _ridge_np(pdf[feats].to_numpy(float), pdf["target_h1"].to_numpy(float))
    lr = m.stages[-1]
    assert np.allclose(lr.coefficients.toArray(), w, rtol=1e-6, atol=1e-8)
    assert abs(lr.intercept - b) < 1e-6


def test_grouped_ridge_matches_numpy(spark):
    tr = fx.training_rows(spark, SF["0.01"], digits=None).filter(F.col("series_id").isin("click", "view"))
    feats = ["lag_1", "lag_3", "roll_mean_12"]
    stats = TR.ridge_statistics(tr.withColumn("horizon", F.lit(1)), feats, "target_h1")
    coef = {r["series_id"]: r for r in TR.solve_ridge(stats, len(feats)).collect()}
    for sid in ("click", "view"):
        pdf = tr.filter(F.col("series_id") == sid).select(*feats, "target_h1").toPandas()
        w, b = _ridge_np(pdf[feats].to_numpy(float), pdf["target_h1"].to_numpy(float))
        got = np.array([coef[sid][f"w_{i}"] for i in range(len(feats))])
        assert np.allclose(got, w, rtol=1e-7) and abs(coef[sid]["intercept"] - b) < 1e-6


def test_candidates_reload_and_importance(spark, tmpdir_path):
    rows = time_split(fx.training_rows(spark, SF["0.001"], digits=None), 0.8)
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    small = {"random_forest": {"numTrees": 10}, "gradient_boosting": {"maxIter": 5},
             "boosted_deep": {"maxIter": 5}}
    reg, models = TR.train_candidates(train, val, TRAINING_FEATURES, "target_h1", 1, "r", overrides=small,
                                      save_base=tmpdir_path)
    out = reg.collect()
    assert len(out) == 4 and all(r["rmse"] > 0 and r["status"] == "candidate" for r in out)
    from airseries.sources.models import load_model
    art = [r["artifact"] for r in out if r["model_name"] == "random_forest"][0]
    a = TR.predict(models["random_forest"], val, "p").select("p").collect()
    b = TR.predict(load_model(art), val, "p").select("p").collect()
    assert a == b
    imp = X.feature_importance(models["random_forest"], TRAINING_FEATURES).collect()
    assert len(imp) == 8 and abs(sum(r["importance"] for r in imp) - 1.0) < 1e-9
    with pytest.raises(TypeError):
        X.feature_importance(models["ridge"], TRAINING_FEATURES)


def test_recursive_shift_semantics(spark):
    df = spark.createDataFrame([("s", "2024-01-01 00:00:00", 10.0, 20.0, 30.0, 5.0)],
                               "series_id string, t string, lag_1 double, lag_3 double, lag_6 double, x double") \
              .select("series_id", F.col("t").cast("timestamp_ntz").alias("datetime"), "lag_1", "lag_3", "lag_6", "x")
    model = {"intercept": 1.0, "lag_1": 1.0, "lag_3": 0.0, "lag_6": 0.0, "x": 0.0}
    out = FC.forecast_recursive(df, model, ["lag_1", "lag_3", "lag_6", "x"], ["lag_1", "lag_3", "lag_6"], 3) \
            .orderBy("step").collect()
    assert [r["predicted_aqi"] for r in out] == [11.0, 12.0, 13.0]
    assert str(out[2]["datetime"]) == "2024-01-04 00:00:00"
    logm = FC.forecast_recursive(df, model, ["lag_1", "lag_3", "lag_6", "x"], [], 1, transform="log1p").first()
    assert abs(logm["predicted_aqi"] - np.expm1(11.0)) < 1e-6


def test_linear_shap_additivity(spark):
    tr = fx.training_rows(spark, SF["0.001"], digits=None)
    lin = fx.LINEAR_MODEL
    means = X.background_means(tr, TRAINING_FEATURES)
    shap = X.linear_shap(tr, lin, TRAINING_FEATURES, means)
    tot = shap.groupBy("series_id", "datetime").agg(F.sum("shap_value").alias("s"))
    pred = FC.apply_model(tr, lin, TRAINING_FEATURES, "p").select("series_id", "datetime", "p")
    base = X.base_value(lin, means, TRAINING_FEATURES)
    bad = tot.join(pred, ["series_id", "datetime"]).filter(F.abs(F.col("s") + F.lit(base) - F.col("p")) > 1e-9)
    assert bad.count() == 0


def test_train_and_publish(spark):
    from airseries.operators.registry import assert_single_best
    reg = fx.registry(spark, SF["0.001"])
    feats = fx.training_rows(spark, SF["0.001"], digits=None)
    new, m = TR.train_and_publish(reg, feats, 2, TRAINING_FEATURES, overrides={"numTrees": 5},
                                  registered_at="2024-02-01 00:00:00")
    rows = new.filter("horizon = 2").collect()
    prod = [r for r in rows if r["status"] == "production"]
    assert len(prod) == 1 and prod[0]["model_name"] == "random_forest" and prod[0]["is_best"]
    assert_single_best(new.filter("horizon = 2"))


def test_build_training_and_explain_rows_dispatch(spark):
    from airseries.operators.features import build_training
    from airseries.plans.presets import TRAINING
    r = fx.readings(spark, SF["0.001"])
    t = build_training(r, TRAINING, 2)
    assert "label" in t.columns and "datetime" not in t.columns
    assert not [c for c in t.columns if c.startswith("target_")]
    with pytest.raises(ValueError):
        build_training(r, TRAINING, 9)
    tr = fx.training_rows(spark, SF["0.001"], digits=None)
    lin = X.explain_rows(tr, fx.LINEAR_MODEL, TRAINING_FEATURES)
    ref = X.linear_shap(tr, fx.LINEAR_MODEL, TRAINING_FEATURES, X.background_means(tr, TRAINING_FEATURES))
    assert sorted(map(repr, lin.collect())) == sorted(map(repr, ref.collect()))
    m = TR.fit(tr, TRAINING_FEATURES, "target_h1", "gradient_boosting", maxIter=3)
    trees = X.explain_rows(tr, m, TRAINING_FEATURES)
    assert trees.count() == tr.count() * len(TRAINING_FEATURES)
