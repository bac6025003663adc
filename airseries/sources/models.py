"""Model persistence. The registry row's ``artifact`` holds the path of
an MLlib ``PipelineModel`` written with ``write().save``, or of a histogram
ensemble's Parquet rows (below a folder of its own kind)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from airseries.operators.trees import TreeModel
from airseries.sources.tables import exists

TREES = "trees"


def artifact_path(base: str, model_name: str, horizon: int, version: str) -> str:
    return f"{base}/{model_name}_h{horizon}/{version}"


def save_model(model: PipelineModel | TreeModel, base: str, model_name: str, horizon: int, version: str) -> str:
    path = artifact_path(base, model_name, horizon, version)
    if isinstance(model, TreeModel):
        model.save(SparkSession.getActiveSession(), f"{path}/{TREES}")
    else:
        model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel | TreeModel:
    spark = SparkSession.getActiveSession()
    if exists(spark, f"{path}/{TREES}"):
        return TreeModel.load(spark, f"{path}/{TREES}")
    return PipelineModel.load(path)
