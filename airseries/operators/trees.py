"""Histogram tree ensembles grown level by level.

Features are binned once at order statistics of the training rows. A level of all
trees (of a block of them, if the cells of all would exceed ``CELLS``) is grown from
one aggregate: every task adds its rows to (tree, node, feature, bin) cells of
weight and label sum, Spark adds the cells up, and the best split of each node is
chosen in the same job; only split nodes, whose number is the model's, reach the
driver. Rows are re-read at every level and find their nodes through the model so
far, so no state per row is kept and a lost task is repeated from its input.

Results do not depend on partitions: a row's weight in a bagged tree is a Poisson(1)
draw from a hash of the row and the tree, and labels and residuals are summed as
integers of a millionth. Ties go to the lower gain order (feature, bin).

``forest``: bagged trees, mean of leaves. ``boosted``: each tree fits the residual of
those before it; with ``l2`` gain and leaf values are those of the second-order
expansion of the squared loss (hessian 1 a row). Rows with a missing label are not
fitted; a missing feature is an error.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from airseries.operators.quantiles import exact_quantiles
from airseries.session import ship_package, written

#: Cells a task may hold at once, and least gain of a split.
CELLS, MIN_GAIN = 4_000_000, 1e-6
SCALE = 1_000_000
#: Weights of a Poisson(1) draw: 32-bit bounds of 0, 1, 2, ... (from e^-1 / k!).
_POISSON = np.floor(np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1, 8)])) * 2 ** 32).astype(np.uint64)


def bag_weight(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a row is in a tree's bag: Poisson(1) by a 32-bit mix of row, tree and seed."""
    m = np.uint64(0xFFFFFFFF)
    x = (key.astype(np.int64).view(np.uint64) & m) ^ (np.uint64((tree + 1) * 0x9E3779B1 + seed) & m)
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(0x85EBCA6B)) & m
    x = ((x ^ (x >> np.uint64(13))) * np.uint64(0xC2B2AE35)) & m
    x ^= x >> np.uint64(16)
    return np.searchsorted(_POISSON, x, side="right").astype(np.int64)


@dataclass
class TreeModel:
    """An ensemble in packed arrays: node i of a tree has the children 2i + 1 and 2i + 2."""

    kind: str
    features: list[str]
    edges: list[np.ndarray]           # per feature: x <= edges[b] goes with bins 0..b
    depth: int
    base: float = 0.0
    rate: float = 1.0
    cover: list[np.ndarray] = field(default_factory=list)
    feature: list[np.ndarray] = field(default_factory=list)  # -1: no split
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    gain: list[np.ndarray] = field(default_factory=list)

    def grow(self, trees: int) -> None:
        n = 2 ** (self.depth + 1) - 1
        for _ in range(trees):
            self.feature.append(np.full(n, -1, np.int16))
            self.cut.append(np.zeros(n, np.int32))
            for a in (self.value, self.gain, self.cover):
                a.append(np.zeros(n))

    def bins(self, columns: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(columns[0]), len(columns)), np.int32)
        for i, (x, e) in enumerate(zip(columns, self.edges, strict=True)):
            x = np.asarray(x, np.float64)
            if np.isnan(x).any():
                raise ValueError(f"{self.features[i]}: a feature is missing")
            out[:, i] = np.searchsorted(e, x, side="left")
        return out

    def nodes(self, bins: np.ndarray, tree: int, levels: int | None = None) -> np.ndarray:
        """The node each row has reached after some levels; rows at a leaf stay there."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        feature, cut = self.feature[tree], self.cut[tree]
        for _ in range(self.depth if levels is None else levels):
            f = feature[at]
            step = 2 * at + 1 + (bins[rows, np.maximum(f, 0)] > cut[at])
            at = np.where(f >= 0, step, at)
        return at

    def margin(self, bins: np.ndarray, trees: int) -> np.ndarray:
        total = np.zeros(len(bins))
        for t in range(trees):
            total += self.value[t][self.nodes(bins, t)]
        return total

    def predict(self, columns: list[np.ndarray]) -> np.ndarray:
        bins = self.bins(columns)
        total = self.margin(bins, len(self.value))
        return total / max(len(self.value), 1) if self.kind == "forest" else self.base + self.rate * total

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``."""
        ship_package(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self)  # nodes of the ensemble: bounded by its depth and trees

        @F.pandas_udf("double")
        def predicted(*columns: pd.Series) -> pd.Series:
            return pd.Series(shared.value.predict([c.to_numpy(float) for c in columns]))

        return df.withColumn("prediction", predicted(*[F.col(f).cast("double") for f in self.features]))

    def importances(self) -> list[float]:
        """Gain per feature: normalised within each tree, averaged over trees, normalised."""
        total = np.zeros(len(self.features))
        for f, g in zip(self.feature, self.gain, strict=True):
            own = np.bincount(f[f >= 0], weights=g[f >= 0], minlength=len(total))
            total += own / own.sum() if own.sum() > 0 else 0
        return (total / total.sum() if total.sum() > 0 else total).tolist()

    def save(self, spark: SparkSession, path: str) -> None:
        """One Parquet row per tree and one for the rest."""
        def packed(a: np.ndarray) -> str:
            return base64.b64encode(a.tobytes()).decode("ascii")

        head = json.dumps({"kind": self.kind, "features": self.features, "edges": [e.tolist() for e in self.edges],
                           "depth": self.depth, "base": self.base, "rate": self.rate})
        rows = [(-1, head)] + [(t, json.dumps([packed(a[t]) for a in (self.cover, self.feature, self.cut, self.value, self.gain)]))
                               for t in range(len(self.value))]
        spark.createDataFrame(rows, "tree int, body string").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TreeModel":
        bodies = [json.loads(r["body"]) for r in spark.read.parquet(path).orderBy("tree").collect()]
        head = bodies[0]
        m = TreeModel(head["kind"], head["features"], [np.array(e) for e in head["edges"]], head["depth"], head["base"], head["rate"])
        kinds = (np.float64, np.int16, np.int32, np.float64, np.float64)
        for body in bodies[1:]:
            for into, kind, text in zip((m.cover, m.feature, m.cut, m.value, m.gain), kinds, body, strict=True):
                into.append(np.frombuffer(base64.b64decode(text), kind))
        return m


def bin_edges(df: DataFrame, features, bins: int) -> list[np.ndarray]:
    """Per feature the distinct order statistics of ranks floor(k / bins * (n - 1)), less the greatest value."""
    probs = [k / bins for k in range(1, bins)] + [1.0]
    got = {r["column"]: r["quantiles"] for r in exact_quantiles(df, features, probs, interpolate=False).collect()}
    return [np.unique([v for v in got[f][:-1] if v < got[f][-1]]) if f in got else np.zeros(0) for f in features]


def _cells(model: TreeModel, rows: DataFrame, trees: range, level: int, seed: int) -> DataFrame:
    """(tree, node, f, bin, w, s): weight and scaled label sum of the cells of a level, added up."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    width = max(len(e) for e in model.edges) + 1
    first, count = 2 ** level - 1, 2 ** level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        nf = len(m.features)
        w, s = (np.zeros(len(trees) * count * nf * width, np.int64) for _ in range(2))
        for b in batches:
            key, y = b.column(0).to_numpy(), b.column(1).to_numpy()
            bins = np.stack([b.column(2 + i).to_numpy() for i in range(nf)], axis=1)
            if m.kind == "boosted":
                y = y - np.floor((m.base + m.rate * m.margin(bins, trees[0])) * SCALE + 0.5).astype(np.int64)
            for k, t in enumerate(trees):
                node = m.nodes(bins, t, level)
                weight = bag_weight(key, t, seed) if m.kind == "forest" else np.ones(len(y), np.int64)
                here = (node >= first) & (weight > 0)
                cell = ((k * count + node[here] - first)[:, None] * nf + np.arange(nf)) * width + bins[here]
                np.add.at(w, cell, weight[here][:, None])
                np.add.at(s, cell, (weight * y)[here][:, None])
        at = np.flatnonzero(w)
        f, node, tree = at // width % nf, at // (width * nf) % count + first, at // (width * nf * count) + trees[0]
        for lo in range(0, len(at), 100_000):
            part = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v) for v in (tree[part], node[part], f[part], (at % width)[part], w[at[part]], s[at[part]])],
                names=["tree", "node", "f", "bin", "w", "s"])

    parts = rows.mapInArrow(run, "tree long, node long, f long, bin long, w long, s long")
    return parts.groupBy("tree", "node", "f", "bin").agg(F.sum("w").alias("w"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))


def _best_splits(cells: DataFrame, l2: float, min_rows: int) -> DataFrame:
    """The best split of each node of a level: (tree, node, w, s, best); ``best`` is NULL for a leaf."""
    of_node = Window.partitionBy("tree", "node", "f")
    upto = of_node.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)

    def score(s: Column, w: Column) -> Column:
        return s * s / (w + F.lit(float(l2)))

    c = cells.withColumns({"wl": F.sum("w").over(upto), "sl": F.sum("s").over(upto),
                           "wn": F.sum("w").over(of_node), "sn": F.sum("s").over(of_node)})
    c = c.withColumns({n: F.col(n).cast("double") / SCALE for n in ("sl", "sn")})
    c = c.withColumns({"wr": F.col("wn") - F.col("wl"), "sr": F.col("sn") - F.col("sl")})
    fits = (F.col("wl") >= min_rows) & (F.col("wr") >= min_rows)
    gain = score(F.col("sl"), F.col("wl")) + score(F.col("sr"), F.col("wr")) - score(F.col("sn"), F.col("wn"))
    split = F.when(fits & (gain > MIN_GAIN), F.struct(gain.alias("gain"), (-F.col("f")).alias("f"), (-F.col("bin")).alias("bin"),
                                                      "wl", "sl", "wr", "sr"))
    return c.groupBy("tree", "node").agg(F.first("wn").alias("w"), F.first("sn").alias("s"), F.max(split).alias("best"))


def _grow(model: TreeModel, rows: DataFrame, trees: range, l2: float, min_rows: int, seed: int) -> None:
    """All levels of some trees (one tree of a boosted model, any number of a forest's)."""
    per_node = len(model.features) * (max(len(e) for e in model.edges) + 1)

    def leaf(s: float, w: float) -> float:
        return s / (w + l2) if w + l2 > 0 else 0.0

    for level in range(model.depth):
        block = max(1, CELLS // (per_node * 2 ** level))
        open_nodes = 0
        for lo in range(trees.start, trees.stop, block):
            part = range(lo, min(lo + block, trees.stop))
            for r in _best_splits(_cells(model, rows, part, level, seed), l2, min_rows).collect():
                t, node, best = r["tree"], r["node"], r["best"]
                if level == 0:
                    model.value[t][0], model.cover[t][0] = leaf(r["s"], r["w"]), r["w"]
                if best is None:
                    continue
                open_nodes += 1
                model.feature[t][node], model.cut[t][node], model.gain[t][node] = -best["f"], -best["bin"], best["gain"]
                for child, w, s in ((2 * node + 1, best["wl"], best["sl"]), (2 * node + 2, best["wr"], best["sr"])):
                    model.value[t][child], model.cover[t][child] = leaf(s, w), w
        if not open_nodes:
            break


def fit_trees(df: DataFrame, features, label: str, kind: str, trees: int, depth: int, rate: float = 1.0, l2: float = 0.0,
              bins: int = 32, min_rows: int = 1, seed: int = 42, row_key: Column | None = None) -> TreeModel:
    """Fit an ensemble. ``row_key``: a long that tells rows apart for bagging (default: a hash of
    the row's features and label)."""
    features = list(features)
    spark = df.sparkSession
    ship_package(spark)
    known = df.where(F.col(label).isNotNull())
    key = F.xxhash64(*features, label) if row_key is None else row_key
    data = written(known.select(key.cast("long").alias("_k"), F.floor(F.col(label).cast("double") * SCALE + 0.5).cast("long").alias("_y"),
                                *[F.col(f).cast("double").alias(f) for f in features]), "train")
    model = TreeModel(kind, features, bin_edges(data, features, bins), depth)
    shared = spark.sparkContext.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = shared.value.bins([c.to_numpy(zero_copy_only=False) for c in b.columns[2:]])
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *[pa.array(got[:, i]) for i in range(got.shape[1])]], names=names)

    names = ["_k", "_y", *[f"b{i}" for i in range(len(features))]]
    rows = written(data.mapInArrow(binned, "_k long, _y long, " + ", ".join(f"b{i} int" for i in range(len(features)))), "binned")
    if kind == "forest":
        model.grow(trees)
        _grow(model, rows, range(trees), l2, min_rows, seed)
    elif kind == "boosted":
        model.rate = rate
        got = rows.agg(F.sum(F.col("_y").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
        model.base = float(got["s"]) / SCALE / got["n"] if got["n"] else 0.0
        for t in range(trees):
            model.grow(1)
            _grow(model, rows, range(t, t + 1), l2, min_rows, seed)
    else:
        raise ValueError(f"unknown kind {kind}")
    return model
