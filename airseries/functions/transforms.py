"""Small per-row transforms used around models and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def add_interactions(df: DataFrame, pairs) -> DataFrame:
    """Products ``a_x_b`` of column pairs (weather interaction features)."""
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs})


def inverse_log(c, transform: str = "log1p") -> Column:
    """Invert the model's target transform (``log1p`` -> ``expm1``)."""
    return F.expm1(_col(c)) if transform == "log1p" else _col(c)


def round_prediction(c, digits: int = 2) -> Column:
    return F.bround(_col(c), digits)


def forecast_date(base, days) -> Column:
    """``yyyy-MM-dd`` of timestamp column ``base`` plus ``days`` (column name or int)."""
    d = F.col(days) if isinstance(days, str) else F.lit(int(days))
    return F.date_format(F.date_add(F.to_date(_col(base)), d), "yyyy-MM-dd")


def version_stamp(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd_HH-mm-ss")


def model_version(version_col, name_col, horizon_col) -> Column:
    """Stored version, else ``<name>_h<horizon>``."""
    return F.coalesce(_col(version_col),
                      F.concat(_col(name_col), F.lit("_h"), _col(horizon_col).cast("string")))


def strength_flag(r2, threshold: float = 0.8) -> Column:
    return F.coalesce(_col(r2), F.lit(0.0)) > F.lit(threshold)
