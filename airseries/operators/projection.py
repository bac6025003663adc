"""Projections, NULL handling and predicate lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType

TARGET_PREFIX = "target_"


def select_features(df: DataFrame, features) -> DataFrame:
    """Ordered feature projection; missing features raise (as the reference does)."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return df.select(*features)


def drop_key_and_targets(df: DataFrame, key="datetime", targets=None) -> DataFrame:
    """Drop the time key and all target columns; absent names are ignored."""
    targets = targets or [c for c in df.columns if c.startswith(TARGET_PREFIX)]
    return df.drop(key, *targets)


def non_target_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith(TARGET_PREFIX)])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def alias_target(df: DataFrame, src="pm2_5", name="aqi_pm25") -> DataFrame:
    return df.withColumn(name, F.col(src))


def drop_incomplete(df: DataFrame, required=None) -> DataFrame:
    """Drop rows missing any of ``required`` (intersected with present columns);
    ``None`` = every column."""
    if required is None:
        return df.dropna(how="any")
    subset = [c for c in required if c in df.columns]
    return df.dropna(how="any", subset=subset) if subset else df


def fill_missing(df: DataFrame, features, value: float = 0.0) -> DataFrame:
    """Fill NULLs of ``features`` with ``value``; absent features become the
    constant column (the reference's ``.get(col, 0)``)."""
    present = [c for c in features if c in df.columns]
    out = df.fillna(value, subset=present) if present else df
    return out.withColumns({c: F.lit(value) for c in features if c not in df.columns})


def lookup(df: DataFrame, **equals) -> DataFrame:
    """Equality-predicate lookup (pushed to the parquet scan)."""
    cond = F.lit(True)
    for k, v in equals.items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.filter(cond)
