"""Feature attribution.

Linear models: exact SHAP values are column algebra, ``w_j * (x_j - E[x_j])``
with expectations over a background table, returned long
``(keys..., feature, shap_value, rank)``. Tree models: impurity importances
from the fitted MLlib model (T10).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from airseries.operators.trees import TreeModel


def feature_importance(model: PipelineModel | TreeModel, features) -> DataFrame:
    """Impurity (histogram ensembles: gain) importances zipped with feature
    names (a d-row model summary); linear models raise like the reference's error branch."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    if isinstance(model, TreeModel):
        vals = model.importances()
    else:
        est = model.stages[-1]
        if not hasattr(est, "featureImportances"):
            raise TypeError(f"{type(est).__name__} has no feature importances")
        vals = est.featureImportances.toArray().tolist()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, vals)],
                                 "feature string, importance double")


def background_means(background: DataFrame, features) -> dict:
    """E[x_j] over the background rows: one aggregate, d scalars."""
    row = background.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features]).first()
    return {f: float(row[f]) for f in features}


def linear_shap(df: DataFrame, coefs: dict, features, means: dict, keys=("series_id", "datetime"),
                digits: int | None = None) -> DataFrame:
    """T11 (linear): per-row attribution, long form, ranked by |shap| per row.
    ``base_value + sum(shap) == prediction`` holds exactly in real arithmetic."""
    keys = list(keys)
    parts = []  # sorted and numbered inside the row: no shuffle of rows x features
    for f in features:
        v = F.lit(float(coefs[f])) * (F.col(f).cast("double") - F.lit(means[f]))
        if digits is not None:
            v = F.round(v, digits)
        parts.append(F.struct((-F.abs(v)).alias("k"), F.lit(f).alias("feature"), v.alias("shap_value")))
    ranked = df.select(*keys, F.posexplode(F.array_sort(F.array(*parts))).alias("_p", "_s"))
    return ranked.select(*keys, "_s.feature", "_s.shap_value", (F.col("_p") + 1).alias("rank"))


def base_value(coefs: dict, means: dict, features) -> float:
    return float(coefs.get("intercept", 0.0)) + sum(float(coefs[f]) * means[f] for f in features)


def global_importance(shap_long: DataFrame, digits: int | None = None) -> DataFrame:
    """Mean absolute attribution per feature (beeswarm / bar data)."""
    v = F.avg(F.abs("shap_value"))
    if digits is not None:
        v = F.round(v, digits)
    return shap_long.groupBy("feature").agg(v.alias("mean_abs_shap"))


def explain_rows(df: DataFrame, model, features, keys=("series_id", "datetime"), background=None,
                 digits: int | None = None) -> DataFrame:
    """Per-row attribution, long ``(keys..., feature, shap_value, rank)``.
    A coefficient dict is explained exactly by column algebra (expectations
    over ``background``, default ``df``); a tree ensemble (MLlib or histogram)
    by path-dependent TreeSHAP."""
    if isinstance(model, dict):
        means = background_means(background if background is not None else df, features)
        return linear_shap(df, model, features, means, keys, digits)
    from airseries.operators.treeshap import explain_trees
    return explain_trees(df, model, features, keys, digits)
