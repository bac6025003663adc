"""Path-dependent TreeSHAP for tree ensembles of any size (T11/T12, trees).

MLlib ensembles are read from their persisted form (a parquet table of nodes with
split, prediction and weighted cover), histogram ensembles from their arrays, both in
blocks of trees: the trees of a block are packed into flat arrays of at most about
``BLOCK_BYTES`` (more only for one tree that alone is larger) and broadcast. Rows pass
the blocks one after the other where they are (Arrow batches, no shuffle), each adding
its trees' attributions. A leaf costs a few numpy operations over the batch and one
small table over the 0/1 patterns of the turns that rows share with its path.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from airseries.operators.trees import TreeModel

#: Packed bytes of the trees that are broadcast together.
BLOCK_BYTES = 32_000_000
#: Packed bytes per node, at most (a leaf's path entries are counted with their depth).
_ENTRY = 28


def _mllib_blocks(model: PipelineModel, spark: SparkSession) -> Iterator[list[dict]]:
    """The trees of an MLlib ensemble, read from its node table block by block."""
    from airseries.session import ensure_checkpoint_dir
    est = model.stages[-1]
    path = f"{ensure_checkpoint_dir(spark)}/treeshap-{uuid.uuid4().hex[:12]}"
    est.write().save(path)
    table = spark.read.parquet(f"{path}/data")
    # (tree id, tree params json, tree weight) stored as a tuple table
    m = spark.read.parquet(f"{path}/treesMetadata")
    meta = {r[0]: r[1] for r in m.select(F.col(m.columns[0]), F.col(m.columns[2])).collect()}
    forest = "RandomForest" in type(est).__name__
    depth = est.getOrDefault("maxDepth")
    sizes = {r[0]: r[1] for r in table.groupBy("treeID").count().collect()}  # one row a tree
    for block in _blocks(sorted(sizes), lambda t: sizes[t] * _ENTRY * max(1, min(depth, est.numFeatures)) // 2):
        nodes = (table.where(F.col("treeID").isin(block)).select(
            "treeID", "nodeData.id", "nodeData.prediction", F.get(F.col("nodeData.impurityStats"), 0).alias("cover"),
            "nodeData.leftChild", "nodeData.rightChild", F.col("nodeData.split.featureIndex").alias("feature"),
            F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), 0).alias("threshold")).toPandas())
        trees = []
        for tid, g in nodes.groupby("treeID", sort=True):
            g = g.sort_values("id")
            idx = {int(i): k for k, i in enumerate(g["id"])}
            left = np.array([idx.get(int(c), -1) for c in g["leftChild"]])
            right = np.array([idx.get(int(c), -1) for c in g["rightChild"]])
            trees.append({"left": left, "right": right, "feature": g["feature"].to_numpy(int),
                          "threshold": g["threshold"].to_numpy(float), "value": g["prediction"].to_numpy(float),
                          "cover": g["cover"].to_numpy(float), "root": idx[int(g["id"].min())] if 0 not in idx else idx[0],
                          "weight": 1.0 / len(meta) if forest else float(meta[tid])})
        yield trees


def _histogram_blocks(model: TreeModel) -> Iterator[list[dict]]:
    """The trees of a histogram ensemble as node arrays (splits name a bin, its edge is the threshold)."""
    n = len(model.value)
    weight = 1.0 / max(n, 1) if model.kind == "forest" else model.rate
    most = _ENTRY * max(1, min(model.depth, len(model.features)))
    for block in _blocks(range(n), lambda t: int((model.feature[t] >= 0).sum() + 1) * most):
        trees = []
        for t in block:
            f, at = model.feature[t], np.arange(len(model.feature[t]))
            split = f >= 0
            edge = np.array([model.edges[i][c] if i >= 0 else 0.0 for i, c in zip(f, model.cut[t], strict=True)])
            trees.append({"left": np.where(split, 2 * at + 1, -1), "right": np.where(split, 2 * at + 2, -1), "feature": f.astype(int),
                          "threshold": edge, "value": model.value[t], "cover": model.cover[t], "root": 0, "weight": weight})
        yield trees


def _blocks(trees, size) -> Iterator[list[int]]:
    block, held = [], 0
    for t in trees:
        if block and held + size(t) > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append(int(t))
        held += size(t)
    if block:
        yield block


def tree_blocks(model: PipelineModel | TreeModel, spark: SparkSession) -> Iterator[list[dict]]:
    """The ensemble in blocks of trees: dicts of node arrays and the tree's weight."""
    return _histogram_blocks(model) if isinstance(model, TreeModel) else _mllib_blocks(model, spark)


def ensemble_tables(model: PipelineModel | TreeModel, spark: SparkSession) -> list[dict]:
    """All trees at once, for small ensembles."""
    return [t for block in tree_blocks(model, spark) for t in block]


def expected_value(trees) -> float:
    total = 0.0
    for t in trees:
        leaves = reached(t)
        total += t["weight"] * float((t["cover"][leaves] * t["value"][leaves]).sum() / t["cover"][t["root"]])
    return total


def reached(tree) -> np.ndarray:
    """The leaves of a tree (packed arrays may hold places that no path leads to)."""
    out, stack = np.zeros(len(tree["left"]), bool), [tree["root"]]
    while stack:
        j = stack.pop()
        if tree["left"][j] < 0:
            out[j] = True
        else:
            stack += [tree["left"][j], tree["right"][j]]
    return out


def leaf_paths(tree) -> list[tuple[float, list[tuple[int, float | None, float | None, float]]]]:
    """Per leaf its value and, per distinct feature on its path, (feature, low,
    high, share): the interval low < x <= high that leads there (None: open)
    and the share of training rows that take those turns."""
    left, right, feat, thr = tree["left"], tree["right"], tree["feature"], tree["threshold"]
    value, cover = tree["value"], tree["cover"]
    out, stack = [], [(tree["root"], {})]
    while stack:
        j, path = stack.pop()
        if left[j] < 0:
            out.append((float(value[j]), [(f, *v) for f, v in path.items()]))
            continue
        d, t = int(feat[j]), float(thr[j])
        lo, hi, z = path.get(d, (None, None, 1.0))
        a, b = left[j], right[j]
        stack.append((a, {**path, d: (lo, t if hi is None else min(hi, t), z * cover[a] / cover[j])}))
        stack.append((b, {**path, d: (t if lo is None else max(lo, t), hi, z * cover[b] / cover[j])}))
    return out


def pack_paths(tree) -> dict:
    """The leaf paths of a tree in flat arrays: leaf i owns the entries ``start[i]:start[i + 1]``."""
    paths = leaf_paths(tree)
    entries = [e for _, path in paths for e in path]
    return {"weight": tree["weight"], "value": np.array([v for v, _ in paths]),
            "start": np.cumsum([0, *[len(p) for _, p in paths]]).astype(np.int64),
            "feature": np.array([e[0] for e in entries], np.int32),
            "low": np.array([-np.inf if e[1] is None else e[1] for e in entries]),
            "high": np.array([np.inf if e[2] is None else e[2] for e in entries]),
            "share": np.array([e[3] for e in entries])}


def tree_shap(tree, X: np.ndarray) -> np.ndarray:
    """SHAP values (n x M) of one tree for the rows of ``X``.

    A leaf's game has one player per feature on its path: in (1) if the row's
    value leads to the leaf, else its share of the training rows. Its Shapley
    values are (o_j - z_j) times the integral over t in [0, 1] of the product
    of (1 - t) z_k + t o_k over the other players: a polynomial, which a Gauss
    rule of half its degree integrates exactly. Rows with the same 0/1 pattern
    share the result."""
    phi = np.zeros(X.shape)
    p = tree if "start" in tree else pack_paths(tree)
    for leaf, value in enumerate(p["value"].tolist()):
        lo, hi = p["start"][leaf], p["start"][leaf + 1]
        d = int(hi - lo)
        if not d:
            continue
        features, z = p["feature"][lo:hi], p["share"][lo:hi]
        pattern = np.zeros(len(X), np.int64)
        for bit in range(d):
            x = X[:, features[bit]]
            low, high = p["low"][lo + bit], p["high"][lo + bit]
            inside = np.ones(len(X), bool) if low == -np.inf else ~(x <= low)
            if high != np.inf:
                inside &= x <= high
            pattern |= inside.astype(np.int64) << bit
        seen, which = np.unique(pattern, return_inverse=True)
        o = (seen[:, None] >> np.arange(d)) & 1
        nodes, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
        t = (nodes + 1)[:, None, None] / 2
        term = (1 - t) * z + t * o
        inner = (term.prod(axis=2, keepdims=True) / term * (weights / 2)[:, None, None]).sum(axis=0)
        phi[:, features] += (value * (o - z) * inner)[which]
    return phi


def ensemble_shap(trees, X: np.ndarray) -> np.ndarray:
    phi = np.zeros(X.shape)
    for t in trees:
        phi += t["weight"] * tree_shap(t, X)
    return phi


def explain_trees(df: DataFrame, model: PipelineModel | TreeModel, features, keys=("series_id", "datetime"),
                  digits: int | None = None) -> DataFrame:
    """T11 (trees): per-row SHAP values, long ``(keys..., feature,
    shap_value, rank)``. Rows are explained block by block and ranked where they
    are (no shuffle)."""
    from airseries.session import ship_package
    spark = df.sparkSession
    ship_package(spark)
    keys, feats = list(keys), list(features)
    d = len(feats)
    rows = df.select(F.struct(*keys).alias("_key"), F.array(*[F.col(f).cast("double") for f in feats]).alias("_x"),
                     F.array_repeat(F.lit(0.0), d).alias("_phi"))

    def add(block):
        shared = spark.sparkContext.broadcast([pack_paths(t) for t in block])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), d)
                phi = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(b), d) + ensemble_shap(shared.value, x)
                packed = pa.ListArray.from_arrays(pa.array(np.arange(0, d * len(b) + 1, d), pa.int32()), pa.array(phi.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed], names=["_key", "_x", "_phi"])
        return run

    for block in tree_blocks(model, spark):
        rows = rows.mapInArrow(add(block), rows.schema)
    parts = []
    for i, f in enumerate(feats):
        v = F.col("_phi")[i] if digits is None else F.round(F.col("_phi")[i], digits)
        # largest first, equal ones by name
        parts.append(F.struct((-F.abs(v)).alias("k"), F.lit(f).alias("feature"), v.alias("shap_value")))
    ranked = rows.select("_key", F.posexplode(F.array_sort(F.array(*parts))).alias("_p", "_s"))
    return ranked.select(*[F.col(f"_key.`{k}`") for k in keys], "_s.feature", "_s.shap_value", (F.col("_p") + 1).alias("rank"))
