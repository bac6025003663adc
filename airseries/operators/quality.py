"""Data-quality report (A1-A5): every statistic is one aggregation pass whose
wide single-row result is turned long with ``stack`` (no per-column jobs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airseries.operators.features import CHUNK_ROWS, gaps
from airseries.operators.projection import numeric_columns
from airseries.operators.quantiles import exact_quantiles


def _q(s: str) -> str:
    return "'" + s.replace("'", "\\'") + "'"


def _stack(wide: DataFrame, rows: list[list[str]], names: list[str]) -> DataFrame:
    """``rows``: per output row, SQL expressions over the columns of ``wide``."""
    body = ", ".join(", ".join(r) for r in rows)
    return wide.selectExpr(f"stack({len(rows)}, {body}) AS ({', '.join(names)})")


def profile(df: DataFrame) -> DataFrame:
    """``(column, dtype, non_null)``: schema plus non-null counts (df.info)."""
    cols = df.columns
    wide = df.agg(*[F.count(F.col(c)).alias(f"_c{i}") for i, c in enumerate(cols)])
    types = dict(df.dtypes)
    return _stack(wide, [[_q(c), _q(types[c]), f"_c{i}"] for i, c in enumerate(cols)],
                  ["column", "dtype", "non_null"])


def missing_counts(df: DataFrame) -> DataFrame:
    """``(column, n_missing)``; NaN is counted as missing like pandas."""
    cols = df.columns
    types = dict(df.dtypes)

    def miss(c):
        cond = F.col(c).isNull()
        if types[c] in ("double", "float"):
            cond = cond | F.isnan(F.col(c))
        return F.count_if(cond)

    wide = df.agg(*[miss(c).alias(f"_c{i}") for i, c in enumerate(cols)])
    return _stack(wide, [[_q(c), f"_c{i}"] for i, c in enumerate(cols)], ["column", "n_missing"])


def describe(df: DataFrame, cols=None, exact: bool = True, accuracy: int = 100000) -> DataFrame:
    """count, mean, std (n-1), min, 25/50/75 % (linear interpolation), max per
    numeric column, long form. ``exact=True`` (default) selects the quartiles by
    refined range counts (``exact_quantiles``): equal to pandas in bounded memory.
    ``exact=False`` uses ``percentile_approx`` (relative rank error 1/accuracy, one
    pass). The caller chooses; the size of the data does not."""
    cols = cols or numeric_columns(df)
    aggs, probs = [], (0.25, 0.5, 0.75)
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        if not exact:
            aggs.append(F.percentile_approx(x, list(probs), accuracy).alias(f"q{i}"))
    wide = df.agg(*aggs)
    names = ["column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    if not exact:
        return _stack(wide, [[_q(c), f"n{i}", f"m{i}", f"s{i}", f"lo{i}", f"q{i}[0]", f"q{i}[1]", f"q{i}[2]", f"hi{i}"]
                             for i, c in enumerate(cols)], names)
    rest = _stack(wide, [[_q(c), f"n{i}", f"m{i}", f"s{i}", f"lo{i}", f"hi{i}"] for i, c in enumerate(cols)],
                  ["column", "count", "mean", "std", "min", "max"])
    quart = exact_quantiles(df, cols, probs).select("column", *[F.col("quantiles")[k].alias(n) for k, n in enumerate(names[5:8])])
    return rest.join(quart, "column", "left").select(*names)


def negative_counts(df: DataFrame, cols=None) -> DataFrame:
    cols = cols or numeric_columns(df)
    wide = df.agg(*[F.count_if(F.col(c) < 0).alias(f"_c{i}") for i, c in enumerate(cols)])
    return _stack(wide, [[_q(c), f"_c{i}"] for i, c in enumerate(cols)], ["column", "n_negative"])


def gap_report(df: DataFrame, key="series_id", order="datetime", by_series: bool = False,
               chunk_rows: int | None = CHUNK_ROWS, bucket=None) -> DataFrame:
    """Frequency of each gap between consecutive rows, most frequent first;
    the first row of each series (no gap) is excluded."""
    g = gaps(df.select(key, order), key, order, chunk_rows=chunk_rows, bucket=bucket).filter(F.col("gap_seconds").isNotNull())
    by = [key, "gap_seconds"] if by_series else ["gap_seconds"]
    return g.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *by)
