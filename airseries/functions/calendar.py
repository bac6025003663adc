"""Calendar features on TIMESTAMP_NTZ columns (session-zone independent)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Part name -> extractor. ``dayofweek``/``day_of_week`` follow the Monday = 0
# convention (Spark ``weekday``), not Spark's Sunday = 1 ``dayofweek``.
_PARTS = {
    "hour": F.hour,
    "day": F.dayofmonth,
    "day_of_month": F.dayofmonth,
    "month": F.month,
    "dayofweek": F.weekday,
    "day_of_week": F.weekday,
    "week_of_year": F.weekofyear,
}

# Periods of the cyclical encodings.
CYCLES = {"hour": ("hour", 24), "dow": ("day_of_week", 7), "month": ("month", 12)}


def hour_floor(c) -> Column:
    """Truncate a TIMESTAMP_NTZ to the hour without a time-zone round trip."""
    ts = F.col(c) if isinstance(c, str) else c
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts),
                                F.lit(0), F.lit(0))


def calendar_parts(ts: Column, parts) -> list[Column]:
    return [_PARTS[p](ts).alias(p) for p in parts]


def add_time_features(df: DataFrame, col: str = "datetime",
                      parts=("hour", "day", "month", "dayofweek")) -> DataFrame:
    """Parse ``col`` (a string that does not parse becomes NULL) and add calendar parts; no-op when
    ``col`` is absent."""
    if col not in df.columns:
        return df
    dtype = dict(df.dtypes)[col]
    if dtype == "string":
        ts = F.col(col).try_cast("timestamp_ntz")
    else:
        ts = F.col(col).cast("timestamp_ntz")
    out = df.withColumn(col, ts)
    return out.withColumns({p: _PARTS[p](F.col(col)) for p in parts})


def cyclical(df: DataFrame, col: str = "datetime", which=("hour", "dow")) -> DataFrame:
    """``<name>_sin`` / ``<name>_cos`` = sin/cos(2*pi*part/period)."""
    cols = {}
    for name in which:
        part, period = CYCLES[name]
        x = _PARTS[part](F.col(col)).cast("double")
        cols[f"{name}_sin"] = F.sin(F.lit(2 * math.pi / period) * x)
        cols[f"{name}_cos"] = F.cos(F.lit(2 * math.pi / period) * x)
    return df.withColumns(cols)
