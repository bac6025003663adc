"""Exploratory statistics behind the reference's plots (A6-A15). Outputs are
bounded (bins, pairs, groups), never raw rows, so they stay small at any scale."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from airseries.operators.quality import _q, _stack
from airseries.operators.quantiles import exact_quantiles


def group_means(df: DataFrame, by: str, cols, decimals: int | None = None) -> DataFrame:
    """Mean of each column per group. ``decimals``: the values are reported
    at that fixed precision; they are summed exactly as DECIMAL, so the mean
    does not depend on the partitioning (double sums can differ in the last
    bit with the summation order)."""
    def mean(c):
        if decimals is None:
            return F.avg(c)
        return F.avg(F.col(c).cast(f"decimal(30,{decimals})")).cast("double")
    return df.groupBy(by).agg(*[mean(c).alias(f"mean_{c}") for c in cols])


def _range(df: DataFrame, col: str):
    row = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    return row["lo"], row["hi"]


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed; a constant column
    gets the range +-0.5; empty bins are kept. Two passes: a two-scalar
    min/max aggregate, then one grouped count."""
    lo, hi = _range(df, col)
    if lo is None:
        raise ValueError(f"{col}: no values")
    lo, hi = float(lo), float(hi)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    norm = bins / (hi - lo)
    x = F.col(col).cast("double")
    b = F.least(F.floor((x - F.lit(lo)) * F.lit(norm)), F.lit(bins - 1)).cast("int")
    counts = df.filter(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (hi - lo) / bins
    allbins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (allbins.join(F.broadcast(counts), "bin", "left")
                   .select("bin", F.round(F.lit(lo) + F.col("bin") * F.lit(width), 6).alias("lo"),
                           F.round(F.lit(lo) + (F.col("bin") + 1) * F.lit(width), 6).alias("hi"),
                           F.coalesce("n", F.lit(0)).alias("n")))


def boxplot_stats(df: DataFrame, col: str, by: str, exact: bool = True, accuracy: int = 100000) -> DataFrame:
    """Quartiles, whiskers (furthest points within 1.5 IQR) and outlier count
    per group: a quartile aggregate joined back to the rows on the group key
    (one row per group; AQE broadcasts it or splits a skewed key).
    ``exact`` as in ``quality.describe``."""
    x = F.col(col).cast("double")
    if exact:
        q = exact_quantiles(df, [col], (0.25, 0.75), by).select(by, F.col("quantiles").alias("_q"))
    else:
        q = df.groupBy(by).agg(F.percentile_approx(x, [0.25, 0.75], accuracy).alias("_q"))
    q = q.select(by, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q3"))
    j = df.select(by, x.alias("_x")).join(q, by)
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    return j.groupBy(by).agg(
        F.first("q1").alias("q1"), F.first("q3").alias("q3"),
        F.min(F.when(F.col("_x") >= lo_f, F.col("_x"))).alias("whisker_lo"),
        F.max(F.when(F.col("_x") <= hi_f, F.col("_x"))).alias("whisker_hi"),
        F.count_if((F.col("_x") < lo_f) | (F.col("_x") > hi_f)).alias("n_outliers"))


def safe_corr(a: str, b: str):
    """Pairwise-complete Pearson correlation; NULL (pandas: NaN) when either
    side has zero variance, instead of ANSI mode's division-by-zero error."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    sx = F.stddev_pop(F.when(both, x))
    sy = F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), sx * sy)


def corr_matrix(df: DataFrame, cols, digits: int | None = None) -> DataFrame:
    """Pairwise-complete Pearson matrix, long form ``(col_a, col_b, corr)``,
    from one aggregation of the upper triangle; mirrored and diagonal rows
    are added by ``stack``."""
    pairs = list(combinations(cols, 2))
    wide = df.agg(*[safe_corr(a, b).alias(f"_r{i}") for i, (a, b) in enumerate(pairs)])
    rnd = (lambda e: f"round({e}, {digits})") if digits is not None else (lambda e: e)
    rows = []
    for i, (a, b) in enumerate(pairs):
        rows.append([_q(a), _q(b), rnd(f"_r{i}")])
        rows.append([_q(b), _q(a), rnd(f"_r{i}")])
    rows += [[_q(c), _q(c), "CAST(1.0 AS DOUBLE)"] for c in cols]
    return _stack(wide, rows, ["col_a", "col_b", "corr"])


def corr_with(df: DataFrame, target: str, cols, digits: int | None = None) -> DataFrame:
    """Correlation of every column with ``target``, descending."""
    wide = df.agg(*[safe_corr(c, target).alias(f"_r{i}") for i, c in enumerate(cols)])
    rnd = (lambda e: f"round({e}, {digits})") if digits is not None else (lambda e: e)
    out = _stack(wide, [[_q(c), rnd(f"_r{i}")] for i, c in enumerate(cols)], ["feature", "corr"])
    return out.orderBy(F.desc_nulls_last("corr"))


def skewness(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """Population skewness (biased moment ratio, like ``F.skewness``)."""
    agg = [F.count(col).alias("n"), F.skewness(F.col(col).cast("double")).alias("skewness")]
    return df.groupBy(by).agg(*agg) if by else df.agg(*agg)


def binned_scatter(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Two-dimensional binned counts (the data part of a scatter plot)."""
    r = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()

    def bexpr(c, lo, hi):
        lo, hi = float(lo), float(hi)
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        return F.least(F.floor((F.col(c).cast("double") - F.lit(lo)) * F.lit(bins / (hi - lo))),
                       F.lit(bins - 1)).cast("int")

    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return (d.groupBy(bexpr(x, r["x0"], r["x1"]).alias("bin_x"), bexpr(y, r["y0"], r["y1"]).alias("bin_y"))
             .agg(F.count(F.lit(1)).alias("n")))


def sample_rows(df: DataFrame, n: int = 200, seed: int = 42, key=None) -> DataFrame:
    """Seeded sample of ``n`` rows, stable under repartitioning: rank by a hash
    of the key columns (TakeOrderedAndProject keeps n rows per partition)."""
    key = key or df.columns
    key = [key] if isinstance(key, str) else list(key)
    h = F.xxhash64(*[F.col(k) for k in key], F.lit(seed))
    return df.withColumn("_h", h).orderBy("_h", *key).limit(n).drop("_h")


def top_k(df: DataFrame, col: str, k: int = 10, tiebreak=None) -> DataFrame:
    order = [F.desc(col)] + ([F.asc(tiebreak)] if tiebreak else [])
    return df.orderBy(*order).limit(k)


# Multiplicative hashing constant (Knuth): 2^32 / golden ratio.
_KNUTH = 2654435761


def sample_by_numeric_key(df: DataFrame, key: str, n: int = 200, seed: int = 42) -> DataFrame:
    """Seeded sample of ``n`` rows ranked by ``(key * 2654435761 + seed) mod 2^32``
    of a non-negative integer key below 2^32: plain integer arithmetic, so any
    engine reproduces the same sample; the odd multiplier makes the hash a
    bijection on such keys (no ties between distinct keys); stable under
    repartitioning. TakeOrderedAndProject keeps n rows per partition."""
    h = F.pmod(F.col(key).cast("long") * F.lit(_KNUTH) + F.lit(int(seed)), F.lit(2 ** 32))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")
