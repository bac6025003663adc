"""Blocked correlations against pandas, for many columns."""

import numpy as np
import pandas as pd

from airseries.operators import gram
from airseries.operators.eda import corr_matrix


def _data(n=400, d=150):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, d)) @ (np.eye(d) + 0.1 * rng.normal(size=(d, d))) + 1e6 * rng.integers(0, 3, d)
    x[rng.random((n, d)) < 0.2] = np.nan
    x[:, 3] = 7.25                       # constant
    x[:, 4] = np.nan                     # empty
    x[:200, 5], x[200:, 6] = np.nan, np.nan  # never together
    return pd.DataFrame(x, columns=[f"f {i}" for i in range(d)])


def test_many_columns_equal_pandas(spark):
    pdf = _data()
    df = spark.createDataFrame(pdf).repartition(5)
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in gram.corr_matrix_blocks(df, list(pdf.columns)).collect()}
    assert len(got) == 150 * 150
    want = pdf.corr(min_periods=2)
    for a in pdf.columns:
        for b in pdf.columns:
            w, g = want.loc[a, b], got[(a, b)]
            if a == b:
                assert g == 1.0
            elif g is None:
                assert np.isnan(w) or abs(w) < 1e-6 or "f 3" in (a, b)
            else:
                assert abs(g - w) < 1e-8, (a, b)
    assert got[("f 3", "f 0")] is None and got[("f 5", "f 6")] is None and got[("f 4", "f 0")] is None
    by = {r["feature"]: r["corr"] for r in gram.corr_with_blocks(df, "f 0", list(pdf.columns[1:])).collect()}
    assert len(by) == 149 and all((by[c] is None) == (got[(c, "f 0")] is None) for c in by)
    assert all(abs(by[c] - got[(c, "f 0")]) < 1e-12 for c in by if by[c] is not None)


def test_plan_does_not_grow_with_pairs(spark):
    pdf = _data(50, 60)
    df = spark.createDataFrame(pdf)

    def size(n):
        out = gram.pair_moments(df, list(pdf.columns[:n]))
        return out._jdf.queryExecution().optimizedPlan().toString().count("sum(")

    assert size(3) == size(60)
    few = list(pdf.columns[:3])
    a = sorted(map(tuple, gram.corr_matrix_blocks(df, few, digits=9).collect()))
    assert a == sorted(map(tuple, corr_matrix(df.select(*few), few, digits=9).collect()))
