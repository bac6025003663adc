"""Exact quantiles against numpy, with ranges small enough that every path runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from airseries.operators import quantiles as Q

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)


@pytest.fixture()
def tiny(monkeypatch):
    monkeypatch.setattr(Q, "CELLS", 8)
    monkeypatch.setattr(Q, "FEW", 5)


def _frame(spark, columns):
    n = max(map(len, columns.values()))
    rows = [(f"g{i % 3}" if i % 7 else None, *[float(v[i]) if i < len(v) and v[i] is not None else None for v in columns.values()])
            for i in range(n)]
    return spark.createDataFrame(rows, "g string, " + ", ".join(f"{c} double" for c in columns))


def test_selection_equals_numpy(spark, tiny):
    rng = np.random.default_rng(3)
    cols = {"normal": rng.normal(size=700), "ties": rng.integers(0, 3, 700).astype(float),
            "wide": rng.normal(size=700) * 10.0 ** rng.integers(-9, 9, 700), "one": np.full(700, 2.5),
            "outlier": np.r_[1e308, -1e308, rng.random(698)], "short": np.array([4.0, 1.0])}
    df = _frame(spark, cols)
    got = {r["column"]: r for r in Q.exact_quantiles(df, list(cols), PROBS).collect()}
    for c, v in cols.items():
        v = np.asarray(v, float)
        assert got[c]["n"] == len(v)
        assert np.allclose(got[c]["quantiles"], np.quantile(v, PROBS), rtol=1e-12, atol=0), c
    by = {(r["g"], r["column"]): r["quantiles"] for r in Q.exact_quantiles(df, ["normal", "ties"], PROBS, "g").collect()}
    rows = df.select("g", "normal", "ties").collect()
    assert len(by) == 8
    for (g, c), q in by.items():
        assert np.allclose(q, np.quantile([r[c] for r in rows if r["g"] == g], PROBS), rtol=1e-12)


def test_missing_infinite_and_empty(spark, tiny):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(v,) for v in (1.0, None, nan, inf, -inf, 2.0, 3.0, 2.0)], "x double")
    r = Q.exact_quantiles(df, ["x"], (0.0, 0.5, 0.6, 1.0)).first()
    assert r["n"] == 6 and r["quantiles"] == [-inf, 2.0, 2.0, inf]
    assert Q.exact_quantiles(df.where("false"), ["x"], (0.5,)).count() == 0


def test_buffers_stay_small(spark, tiny, monkeypatch):
    """No range of more than FEW rows is ever listed."""
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).cast("double").alias("x"))
    sizes = []
    inside = Q._inside

    def watched(rows, ranges, keys, small):
        out = inside(rows, ranges, keys, small)
        sizes.append(out.groupBy("_lo").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(Q, "_inside", watched)
    got = Q.exact_quantiles(df, ["x"], (0.25, 0.5)).first()["quantiles"]
    assert got == list(np.quantile([i * 7919 % 5003 for i in range(5000)], (0.25, 0.5)))
    assert sizes[0] == 5000 and (sizes[-1] or 0) <= Q.FEW
