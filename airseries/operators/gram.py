"""Correlations of hundreds of columns (A10, A11) from blocked Gram matrices.

One aggregate expression per pair of columns makes a plan that grows with the square of
their number. Here every task adds its Arrow batches to Gram matrices of the values and
of their presence, block of columns by block of columns, and Spark adds the tasks' cells
up: the plan is the same for three columns and for a thousand. Values are centred on the
columns' means first (one aggregate of d expressions), so the sums stay small and merging
loses no digits to a large mean.

Pairs are complete pairwise: a pair's moments run over the rows that hold both values. NULL
and NaN are missing. A pair without two different values on either side has no
correlation (NULL).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from airseries.session import ship_package

#: Columns of a block, and cells a task sends at once.
BLOCK, SEND = 128, 100_000
#: Spread below this share of the second moment is rounding, not spread.
FLAT = 1e-13


def pair_moments(df: DataFrame, cols, target: str | None = None) -> DataFrame:
    """``(i, j, n, sx, sy, sxx, syy, sxy)`` of all pairs i < j of ``cols`` (with ``target``: of every
    column and the target, which is column ``len(cols)``), centred on the columns' means."""
    names = [*cols, *([target] if target else [])]
    spark = df.sparkSession
    ship_package(spark)

    def value(c):
        x = F.col(f"`{c}`").cast("double")
        return F.when(~F.isnan(x), x)

    rows = df.select(*[value(c).alias(f"c{i}") for i, c in enumerate(names)])
    means = rows.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(len(names))]).first()
    centre = np.array([0.0 if m is None or not np.isfinite(m) else m for m in means])
    d = len(names)
    only = d - 1 if target else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, d, d if only is None else 1))
        for b in batches:
            x = np.empty((len(b), d))
            for i in range(d):
                x[:, i] = b.column(i).to_numpy(zero_copy_only=False)
            here = ~np.isnan(x)
            x = np.where(here, x - centre, 0.0)
            m = here.astype(float)
            for lo in range(0, d, BLOCK):
                left = slice(lo, min(lo + BLOCK, d))
                for to in (range(lo, d, BLOCK) if only is None else [only]):
                    right = slice(to, min(to + BLOCK, d))
                    into = right if only is None else slice(0, 1)
                    xl, ml, xr, mr = x[:, left].T, m[:, left].T, x[:, right], m[:, right]
                    for k, (a, c) in enumerate(((ml, mr), (xl, mr), (ml, xr), (xl * xl, mr), (ml, xr * xr), (xl, xr))):
                        sums[k, left, into] += a @ c
        i, j = np.nonzero(sums[0])
        if only is not None:
            j = np.full(len(j), only)
            cells, keep = sums[:, i, 0], i != only
        else:
            cells, keep = sums[:, i, j], i < j
        i, j, cells = i[keep], j[keep], cells[:, keep]
        for lo in range(0, len(i), SEND):
            part = slice(lo, lo + SEND)
            yield pa.RecordBatch.from_arrays([pa.array(i[part].astype(np.int32)), pa.array(j[part].astype(np.int32)),
                                              *[pa.array(c[part]) for c in cells]], names=fields)

    fields = ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"]
    parts = rows.mapInArrow(run, "i int, j int, " + ", ".join(f"{f} double" for f in fields[2:]))
    return parts.groupBy("i", "j").agg(*[F.sum(f).alias(f) for f in fields[2:]])


def pair_correlations(df: DataFrame, cols, target: str | None = None) -> DataFrame:
    """``(i, j, n, corr)`` of the pairs of ``pair_moments`` that share a row."""
    m = pair_moments(df, cols, target)

    def spread(square: str, total: str):
        left = F.col(square) - F.col(total) * F.col(total) / F.col("n")
        return F.when(left > F.lit(FLAT) * F.col(square), left)

    both = F.sqrt(spread("sxx", "sx")) * F.sqrt(spread("syy", "sy"))
    r = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / both
    return m.select("i", "j", F.col("n").cast("long").alias("n"), r.alias("corr"))


def corr_matrix_blocks(df: DataFrame, cols, digits: int | None = None) -> DataFrame:
    """The matrix of ``eda.corr_matrix``, long form ``(col_a, col_b, corr)``, by blocks."""
    cols = list(cols)
    spark = df.sparkSession
    r = pair_correlations(df, cols).select("i", "j", F.col("corr") if digits is None else F.round("corr", digits).alias("corr"))
    n = len(cols)
    # one row per pair of columns: d^2 rows of the result itself
    grid = spark.range(n * n).select(F.expr(f"CAST(id DIV {n} AS INT)").alias("a"), F.expr(f"CAST(id % {n} AS INT)").alias("b"))
    at = F.array(*[F.lit(c) for c in cols])
    full = grid.join(r, (F.least("a", "b") == F.col("i")) & (F.greatest("a", "b") == F.col("j")), "left")
    one = F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.col("corr"))
    return full.select(F.element_at(at, F.col("a") + 1).alias("col_a"), F.element_at(at, F.col("b") + 1).alias("col_b"), one.alias("corr"))


def corr_with_blocks(df: DataFrame, target: str, cols, digits: int | None = None) -> DataFrame:
    """The list of ``eda.corr_with``, descending, by blocks."""
    cols = list(cols)
    spark = df.sparkSession
    r = pair_correlations(df, cols, target)
    names = spark.createDataFrame(list(enumerate(cols)), "i int, feature string")
    corr = F.col("corr") if digits is None else F.round("corr", digits)
    return names.join(r.select("i", "corr"), "i", "left").select("feature", corr.alias("corr")).orderBy(F.desc_nulls_last("corr"))
