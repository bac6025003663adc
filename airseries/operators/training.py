"""Model training and scoring.

T1-T5 fit pooled models with MLlib (rows distributed across executors).
T6 fits and scores one ridge model per (series, horizon) from the moments of
segments: one grouped aggregation of means and (co)variances, then a batched d x d
solve over the small table of moments.
"""

from __future__ import annotations

import datetime as dt
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window, functions as F

from airseries.operators.features import CHUNK_ROWS
from airseries.operators.metrics import regression_metrics
from airseries.operators.trees import TreeModel, fit_trees
from airseries.session import written

# The reference's candidate set and hyper-parameters.
RF_TREES, RF_SEED, RF_DEPTH = 200, 42, 10
GB_TREES, GB_RATE, GB_DEPTH = 100, 0.1, 3
RIDGE_ALPHA = 1.0
# The reference's fourth candidate (an external boosted-tree library) is
# re-aimed at a deeper, faster-learning MLlib GBT.
DEEP_TREES, DEEP_RATE, DEEP_DEPTH = 100, 0.3, 6

CANDIDATES = ("random_forest", "gradient_boosting", "ridge", "boosted_deep")


def estimator(name: str, label: str = "label", n_rows: int | None = None,
              label_std: float | None = None, **overrides):
    if name == "random_forest":
        p = dict(numTrees=RF_TREES, maxDepth=RF_DEPTH, featureSubsetStrategy="all", seed=RF_SEED)
        p.update(overrides)
        return RandomForestRegressor(featuresCol="features", labelCol=label, **p)
    if name == "gradient_boosting":
        p = dict(maxIter=GB_TREES, stepSize=GB_RATE, maxDepth=GB_DEPTH, seed=RF_SEED)
        p.update(overrides)
        return GBTRegressor(featuresCol="features", labelCol=label, **p)
    if name == "boosted_deep":
        p = dict(maxIter=DEEP_TREES, stepSize=DEEP_RATE, maxDepth=DEEP_DEPTH, seed=RF_SEED)
        p.update(overrides)
        return GBTRegressor(featuresCol="features", labelCol=label, **p)
    if name == "ridge":
        alpha = overrides.pop("alpha", RIDGE_ALPHA)
        if not n_rows or label_std is None:
            raise ValueError("ridge needs n_rows and label_std to map alpha onto regParam")
        # MLlib divides the L2 penalty by the label's standard deviation;
        # this mapping reproduces the closed-form ridge ||r||^2 + alpha ||w||^2.
        reg = alpha / n_rows * label_std
        return LinearRegression(featuresCol="features", labelCol=label, regParam=reg,
                                elasticNetParam=0.0, standardization=False, solver="normal", **overrides)
    raise ValueError(f"unknown estimator {name}")


#: The tree candidates as histogram ensembles: kind, trees, depth, rate, l2 (the deep one: second order).
HISTOGRAM = {"random_forest": ("forest", RF_TREES, RF_DEPTH, 1.0, 0.0), "gradient_boosting": ("boosted", GB_TREES, GB_DEPTH, GB_RATE, 0.0),
             "boosted_deep": ("boosted", DEEP_TREES, DEEP_DEPTH, DEEP_RATE, 1.0)}


def fit(train: DataFrame, features, target: str, name: str, partitions: int | None = None,
        engine: str = "mllib", **overrides) -> PipelineModel | TreeModel:
    """VectorAssembler + estimator as one PipelineModel (persistable, S12).

    ``engine="histogram"`` grows the tree candidates with ``fit_trees`` instead: the same
    model whatever the partitions, several trees a pass (``overrides`` are its arguments).


    ``partitions``: partitions of the training input (iterative fits run several
    jobs per tree level over each). Forests sample by partition, so the number
    is the caller's and never follows the size of the data; None keeps the
    input's own."""
    if engine == "histogram" and name in HISTOGRAM:
        args = dict(zip(("kind", "trees", "depth", "rate", "l2"), HISTOGRAM[name], strict=True))
        return fit_trees(train, features, target, **{**args, **overrides})
    if engine not in ("mllib", "histogram"):
        raise ValueError(f"unknown engine {engine}")
    data = train.select(*features, target)
    n_rows = label_std = None
    if name == "ridge":  # only ridge needs the label's statistics
        st = data.agg(F.count(F.col(target)).alias("n"), F.stddev_samp(target).alias("s")).first()
        n_rows, label_std = st["n"], st["s"]
    if partitions:
        data = data.coalesce(partitions)
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    est = estimator(name, label=target, n_rows=n_rows, label_std=label_std, **overrides)
    return Pipeline(stages=[asm, est]).fit(data)


def predict(model: PipelineModel | TreeModel, df: DataFrame, name: str = "prediction") -> DataFrame:
    out = model.transform(df).drop("features")
    return out.withColumnRenamed("prediction", name) if name != "prediction" else out


REGISTRY_ROW = ("model_name string, horizon int, rmse double, mae double, r2 double, artifact string, "
                "features array<string>, run_id string, status string, is_best boolean, registered_at timestamp_ntz")


def train_candidates(train: DataFrame, val: DataFrame, features, target: str, horizon: int,
                     run_id: str, names=CANDIDATES, registered_at=None, overrides=None,
                     save_base: str | None = None, partitions: int | None = None, engine: str = "mllib", row_key=None):
    """T5: fit every candidate for one horizon, score on ``val`` and return
    ``(registry_rows, models)``. ``engine``: see ``fit``; ``row_key`` is the column
    that bags rows of histogram forests. Inputs are cached once and released when the
    metrics (one row per candidate) have been computed from them."""
    overrides = overrides or {}
    cols = list(dict.fromkeys(list(features) + [target]))
    spark = train.sparkSession
    if row_key is not None:
        train = train.withColumn("_bag", row_key)
    train = train.select(*cols, *(["_bag"] if row_key is not None else [])).cache()
    val = val.select(*cols).cache()
    models, rows = {}, []
    ts = registered_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    if isinstance(ts, str):
        ts = dt.datetime.fromisoformat(ts)
    try:
        for name in names:
            own = dict(overrides.get(name, {}))
            if engine == "histogram" and name in HISTOGRAM and row_key is not None:
                own["row_key"] = F.col("_bag")
            m = fit(train, features, target, name, partitions, engine, **own)
            models[name] = m
            artifact = None
            if save_base:
                from airseries.sources.models import save_model
                artifact = save_model(m, save_base, name, horizon, run_id)
            met = regression_metrics(predict(m, val, "p"), target, "p").first()
            rows.append((name, int(horizon), met["rmse"], met["mae"], met["r2"], artifact, list(features),
                         run_id, "candidate", False, ts))
        return spark.createDataFrame(rows, REGISTRY_ROW), models
    finally:
        train.unpersist()
        val.unpersist()


# ------------------------------------------------------------------ T6 grouped ridge

def ridge_statistics(train: DataFrame, features, y: str = "y", by=("series_id", "horizon")) -> DataFrame:
    """One grouped pass: n, means, and population (co)variances of the
    features and the label (numerically stable merges, no raw power sums)."""
    feats = list(features)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("my")]
    aggs += [F.avg(f).alias(f"m_{i}") for i, f in enumerate(feats)]
    aggs += [F.covar_pop(feats[i], feats[j]).alias(f"c_{i}_{j}")
             for i, j in combinations_with_replacement(range(len(feats)), 2)]
    aggs += [F.covar_pop(f, y).alias(f"cy_{i}") for i, f in enumerate(feats)]
    return train.groupBy(*by).agg(*aggs)


def solve_ridge(stats: DataFrame, d: int, alpha: float = RIDGE_ALPHA, by=("series_id", "horizon")) -> DataFrame:
    """Ridge with intercept per group: (n*Cxx + alpha*I) w = n*Cxy,
    b = mean(y) - mean(x).w. d = 1 stays a column expression; larger d is a
    batched ``numpy.linalg.solve`` per Arrow batch of groups."""
    by = list(by)
    if d == 1:
        w = (F.col("n") * F.col("cy_0")) / (F.col("n") * F.col("c_0_0") + F.lit(float(alpha)))
        return stats.select(*by, w.alias("w_0"), (F.col("my") - F.col("m_0") * w).alias("intercept"))

    from airseries.session import ship_package
    ship_package(stats.sparkSession)
    schema = ", ".join([f"{c} {t}" for c, t in stats.select(*by).dtypes] +
                       [f"w_{i} double" for i in range(d)] + ["intercept double"])

    def solve(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            k = len(pdf)
            A = np.zeros((k, d, d))
            for i in range(d):
                for j in range(i, d):
                    A[:, i, j] = A[:, j, i] = pdf[f"c_{i}_{j}"].to_numpy()
            n = pdf["n"].to_numpy(dtype=float)
            A = A * n[:, None, None] + alpha * np.eye(d)[None, :, :]
            b = np.stack([pdf[f"cy_{i}"].to_numpy() for i in range(d)], axis=1) * n[:, None]
            wv = np.linalg.solve(A, b[:, :, None])[:, :, 0]
            mx = np.stack([pdf[f"m_{i}"].to_numpy() for i in range(d)], axis=1)
            out = pdf[by].copy()
            for i in range(d):
                out[f"w_{i}"] = wv[:, i]
            out["intercept"] = pdf["my"].to_numpy() - (mx * wv).sum(axis=1)
            yield out

    return stats.mapInPandas(solve, schema)


def _positions(df: DataFrame, value: str, horizons, key, order, chunk_rows, bucket) -> DataFrame:
    """``df`` with ``_y{h}`` (``value`` h rows ahead), ``_rn`` (position from 1) and ``_n`` (rows of the series)."""
    if chunk_rows:
        from airseries.operators.features import FeatureSpec, _pieced
        spec = FeatureSpec(source=value, targets=tuple((f"_y{h}", h) for h in horizons))
        return _pieced(df, spec, key, order, None, chunk_rows, bucket, position=True).withColumn("_rn", F.col("_o") + 1).drop("_o")
    w, wp = Window.partitionBy(key).orderBy(order), Window.partitionBy(key)
    return df.withColumns({"_rn": F.row_number().over(w), "_n": F.count(F.lit(1)).over(wp),
                           **{f"_y{h}": F.lead(value, h).over(w) for h in horizons}})


def _ends(h: int, frac: float):
    """Last train and last test position of a horizon (the last h rows have no label)."""
    left = F.col("_n") - F.lit(int(h))
    return F.floor(F.lit(float(frac)) * left), left


def segment_moments(base: DataFrame, features, horizons, frac: float, key) -> DataFrame:
    """Moments of every (series, segment), one list of segments a series.

    The train and test ends of all horizons cut a series into at most ``2 * H + 1`` segments in
    which no horizon's split changes, so one aggregate without copies of rows serves them all."""
    feats = list(features)
    segment = sum([(F.col("_rn") > end).cast("int") for h in horizons for end in _ends(h, frac)], F.lit(0))
    aggs = [F.max("_n").alias("_n"), F.min("_rn").alias("rn"), F.count(F.lit(1)).cast("double").alias("n")]
    aggs += [F.avg(f).alias(f"m{i}") for i, f in enumerate(feats)]
    aggs += [F.covar_pop(feats[i], feats[j]).alias(f"c{i}_{j}") for i, j in combinations_with_replacement(range(len(feats)), 2)]
    for k, h in enumerate(horizons):
        y = f"_y{h}"
        aggs += [F.avg(y).alias(f"y{k}"), F.covar_pop(y, y).alias(f"v{k}")]
        aggs += [F.covar_pop(f, y).alias(f"x{k}_{i}") for i, f in enumerate(feats)]
    parts = base.groupBy(key, segment.alias("_s")).agg(*aggs)
    rest = [c for c in parts.columns if c not in (key, "_s", "_n")]
    return parts.groupBy(key).agg(F.max("_n").alias("_n"), F.collect_list(F.struct(
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in rest])).alias("segments"))


def _merged(n, means, covs, inside):
    """Count, means and covariances of some segments of each series together (shifted sums)."""
    n = np.where(inside, n, 0.0)
    total = n.sum(1)
    safe = np.maximum(total, 1.0)
    mean = (n[..., None] * means).sum(1) / safe[:, None]
    d = means - mean[:, None, :]
    cov = (n[..., None, None] * (covs + d[..., :, None] * d[..., None, :])).sum(1) / safe[:, None, None]
    return total, mean, cov


def solve_sweep(moments: DataFrame, d: int, horizons, alpha: float, frac: float, key) -> DataFrame:
    """(series, horizon, n_test, rmse, r2, w, intercept) from the segments' moments, batched over series."""
    from airseries.session import ship_package
    ship_package(moments.sparkSession)
    kind = dict(moments.dtypes)[key]
    schema = f"`{key}` {kind}, horizon int, n_test long, rmse double, r2 double, w array<double>, intercept double"
    pairs = list(combinations_with_replacement(range(d), 2))
    horizons = [int(h) for h in horizons]

    def run(batches):
        for b in batches:
            lists = b.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            many, wide = len(b), int(sizes.max(initial=0))
            at = (np.repeat(np.arange(many), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes))

            def column(name):
                out = np.zeros((many, wide))
                out[at] = flat.field(name).to_numpy(zero_copy_only=False)
                return out

            rows = b.column(1).to_numpy(zero_copy_only=False).astype(float)
            rn, n = column("rn"), column("n")
            z_mean = np.zeros((many, wide, d + 1))  # features, then the label
            z_cov = np.zeros((many, wide, d + 1, d + 1))
            for i in range(d):
                z_mean[..., i] = column(f"m{i}")
            for i, j in pairs:
                z_cov[..., i, j] = z_cov[..., j, i] = column(f"c{i}_{j}")
            for k, h in enumerate(horizons):
                z_mean[..., d], z_cov[..., d, d] = column(f"y{k}"), column(f"v{k}")
                for i in range(d):
                    z_cov[..., i, d] = z_cov[..., d, i] = column(f"x{k}_{i}")
                end = (rows - h)[:, None]
                cut = np.floor(frac * end)
                m, mean, cov = _merged(n, z_mean, z_cov, (n > 0) & (rn <= cut))
                a = m[:, None, None] * cov[:, :d, :d] + alpha * np.eye(d)
                w = np.linalg.solve(a, (m[:, None] * cov[:, :d, d])[..., None])[..., 0]
                b0 = mean[:, d] - (mean[:, :d] * w).sum(1)
                t, mean, cov = _merged(n, z_mean, z_cov, (n > 0) & (rn > cut) & (rn <= end))
                off = mean[:, d] - b0 - (mean[:, :d] * w).sum(1)
                mse = cov[:, d, d] - 2 * (w * cov[:, :d, d]).sum(1) + np.einsum("si,sij,sj->s", w, cov[:, :d, :d], w) + off ** 2
                mse = np.where(mse < 1e-13 * (1 + mean[:, d] ** 2), 0.0, mse)
                spread = cov[:, d, d]
                r2 = np.where(spread > 0, 1 - mse / np.where(spread > 0, spread, 1), np.where(mse == 0, 1.0, 0.0))
                keep = np.flatnonzero((m > 0) & (t > 0))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(keep)), pa.array(np.full(len(keep), h), pa.int32()), pa.array(t[keep].astype(np.int64)),
                     pa.array(np.sqrt(mse[keep])), pa.array(r2[keep], mask=t[keep] < 2), pa.array(list(w[keep]), pa.list_(pa.float64())),
                     pa.array(b0[keep])], names=[key, "horizon", "n_test", "rmse", "r2", "w", "intercept"])

    return moments.select(key, "_n", "segments").mapInArrow(run, schema)


def horizon_sweep(df: DataFrame, features, value: str = "aqi_pm25", horizons=(1, 6, 24, 48),
                  alpha: float = RIDGE_ALPHA, frac: float = 0.8, key="series_id", order="datetime",
                  digits: int | None = None, chunk_rows: int | None = CHUNK_ROWS, bucket=None, mae: bool = True) -> DataFrame:
    """Per (series, horizon) ridge fit on the chronological train part,
    scored on the test part: ``(series_id, horizon, n_test, rmse, mae, r2)``.

    One window pass and one aggregate for all horizons (``segment_moments``); models, RMSE and R^2
    come from these moments, without copies of rows or a join back. The mean absolute
    error cannot: ``mae`` adds a pass that joins the models of a series to its rows once. Rows are
    complete (``drop_incomplete`` first)."""
    feats, horizons = list(features), [int(h) for h in horizons]
    base = _positions(df.select(key, order, value, *[f for f in feats if f != value]), value, horizons, key, order, chunk_rows, bucket)
    models = solve_sweep(segment_moments(base, feats, horizons, frac, key), len(feats), horizons, alpha, frac, key)
    if mae:
        models = written(models, "sweep")
        of = models.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("horizon", F.struct("w", "intercept")))).alias("_m"))
        rows = base.join(of.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
        sums = []
        for h in horizons:
            m, (cut, end) = F.col("_m")[F.lit(h)], _ends(h, frac)
            p = m["intercept"]
            for i, f in enumerate(feats):
                p = p + m["w"][i] * F.col(f)
            sums.append(F.avg(F.when((F.col("_rn") > cut) & (F.col("_rn") <= end), F.abs(F.col(f"_y{h}") - p))).alias(f"_a{h}"))
        each = [F.struct(F.lit(h).alias("horizon"), F.col(f"_a{h}").alias("mae")) for h in horizons]
        errors = rows.groupBy(key).agg(*sums).select(F.col(key).alias("_key"), F.inline(F.array(*each)))
        errors = errors.withColumnRenamed("horizon", "_h")
        models = models.join(errors, F.col(key).eqNullSafe(F.col("_key")) & (F.col("horizon") == F.col("_h")))
    names = ["rmse", "mae", "r2"] if mae else ["rmse", "r2"]
    return models.select(key, "horizon", "n_test", *[F.col(c) if digits is None else F.round(c, digits).alias(c) for c in names])


def train_and_publish(registry: DataFrame, features_df: DataFrame, horizon: int, features,
                      target: str | None = None, name: str = "random_forest", frac: float = 0.8,
                      run_id: str | None = None, save_base: str | None = None, registered_at=None,
                      keep_status: bool = False, overrides: dict | None = None, partitions: int | None = None):
    """T1 flow: chronological split of the feature table, fit one model for
    ``horizon``, score it on the held-out part and publish it as the
    production/best row of its horizon (R4; ``keep_status`` gives R5).
    Returns ``(new_registry, model)``."""
    from airseries.operators.features import time_split
    from airseries.operators.registry import publish
    target = target or f"target_h{horizon}"
    rows = time_split(features_df, frac)
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    reg_rows, models = train_candidates(train, test, features, target, horizon, run_id or f"run_h{horizon}",
                                        names=(name,), registered_at=registered_at,
                                        overrides={name: overrides or {}}, save_base=save_base, partitions=partitions)
    new = reg_rows.drop("status", "is_best")
    return publish(registry, new, key="horizon", keep_status=keep_status), models[name]
