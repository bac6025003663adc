"""Model-quality metrics (A16) and the horizon x model benchmark table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def regression_metrics(df: DataFrame, y: str = "y", p: str = "p", by=None,
                       digits: int | None = None) -> DataFrame:
    """RMSE, MAE and R^2 in one (grouped) aggregation. The total sum of
    squares comes from ``var_pop`` (numerically stable merge), not from raw
    sums of squares."""
    d = F.col(y) - F.col(p)
    sse = F.sum(d * d)
    n = F.count(F.lit(1))
    rmse, mae = F.sqrt(F.avg(d * d)), F.avg(F.abs(d))
    # a constant label: 1 for a perfect prediction, else 0; one row: undefined
    spread = F.var_pop(y) * n
    r2 = F.when(n < 2, F.lit(None).cast("double")).when(spread > 0, F.lit(1.0) - F.try_divide(sse, spread)) \
          .otherwise(F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    cols = [n.alias("n"), rmse.alias("rmse"), mae.alias("mae"), r2.alias("r2")]
    if digits is not None:
        cols = [cols[0]] + [F.round(c, digits).alias(a) for c, a in
                            ((rmse, "rmse"), (mae, "mae"), (r2, "r2"))]
    src = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    by = [by] if isinstance(by, str) else (by or [])
    return src.groupBy(*by).agg(*cols) if by else src.agg(*cols)


def benchmark_table(registry: DataFrame, models, metric: str = "rmse") -> DataFrame:
    """Horizon x model table of a metric; the model list is given so the
    pivot needs no extra distinct-values job."""
    return (registry.groupBy("horizon").pivot("model_name", list(models))
                    .agg(F.min(metric)).orderBy("horizon"))
