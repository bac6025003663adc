"""PM2.5 air-quality index, categories and advisories as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values (must equal the reference): EPA PM2.5 breakpoints as
# (concentration low, concentration high, index low, index high); bands are
# closed on both ends, values between bands have no index.
PM25_BREAKPOINTS = [
    (0.0, 12.0, 0, 50),
    (12.1, 35.4, 51, 100),
    (35.5, 55.4, 101, 150),
    (55.5, 150.4, 151, 200),
    (150.5, 250.4, 201, 300),
    (250.5, 500.4, 301, 500),
]

# Six-level category labels and symbols, upper bounds inclusive.
CATEGORY_6 = [
    (50, "Good", "🟢"),
    (100, "Moderate", "🟡"),
    (150, "Unhealthy for Sensitive Groups", "🟠"),
    (200, "Unhealthy", "🔴"),
    (300, "Very Unhealthy", "🟣"),
    (None, "Hazardous", "⚫"),
]

# Five-level dashboard labels, upper bounds inclusive.
CATEGORY_5 = [
    (50, "Good"),
    (100, "Moderate"),
    (150, "Unhealthy (Sensitive)"),
    (200, "Unhealthy"),
    (None, "Hazardous"),
]

# Advisory texts by the maximum forecast value (strict bounds).
ADVISORY = [
    (150, "Hazardous air quality expected. Avoid outdoor exposure."),
    (100, "Sensitive groups should limit outdoor activity."),
    (None, "Air quality within acceptable limits."),
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def aqi_pm25(c) -> Column:
    """Index of a PM2.5 concentration; half-even rounding to int; NULL outside
    every band (negative, gaps such as 12.05, above 500.4, NULL input)."""
    x = _col(c).cast("double")
    expr = None
    for lo, hi, ilo, ihi in PM25_BREAKPOINTS:
        val = F.bround(F.lit((ihi - ilo) / (hi - lo)) * (x - F.lit(lo)) + F.lit(ilo)).cast("int")
        cond = (x >= F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr


def add_aqi_column(df: DataFrame, src: str = "pm2_5", name: str = "aqi_pm25") -> DataFrame:
    return df.withColumn(name, aqi_pm25(src))


def classify_aqi(c) -> Column:
    """Six-level ``struct(category, symbol)``; NULL input gives NULL."""
    x = _col(c)
    expr = None
    for bound, label, sym in CATEGORY_6:
        val = F.struct(F.lit(label).alias("category"), F.lit(sym).alias("symbol"))
        if bound is None:
            expr = expr.when(x.isNotNull(), val)
        else:
            cond = x <= F.lit(bound)
            expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr


def classify_aqi_5(c) -> Column:
    x = _col(c)
    expr = None
    for bound, label in CATEGORY_5:
        if bound is None:
            expr = expr.when(x.isNotNull(), F.lit(label))
        else:
            cond = x <= F.lit(bound)
            expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def advisory(max_value) -> Column:
    """Advisory text for an already aggregated maximum forecast value."""
    x = _col(max_value)
    expr = None
    for bound, text in ADVISORY:
        if bound is None:
            expr = expr.when(x.isNotNull(), F.lit(text))
        else:
            cond = x > F.lit(bound)
            expr = F.when(cond, F.lit(text)) if expr is None else expr.when(cond, F.lit(text))
    return expr
