"""Exact quantiles of any number of columns and groups in bounded memory.

Distributed selection: the order statistics asked for start in the range
[min, max] of their (group, column). Each round counts the rows of every open
range in ``CELLS`` equal cells (one grouped aggregate for all columns, groups
and ranges; partial aggregation before the shuffle) and moves each statistic to
the cell that holds its rank, with that cell's own least and greatest value as
the new range. The ends of a range have cells of their own, so every round
makes progress whatever the distribution. A range of one value is solved, one of
at most ``FEW`` rows is read and sorted. No buffer holds more than ``FEW``
values, and a task no more cells than it met.

Values are interpolated as ``percentile`` does (pandas: linear). NULL and NaN are
missing, infinities are values; a group without values gives NULLs. NULL groups
are a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from airseries.session import written

#: Cells of a range in one round, and rows that are sorted instead of counted.
CELLS, FEW = 4_096, 50_000
_BIG = 1.7976931348623157e308


def _same(left: list[str], right: list[str]) -> list[Column]:
    return [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)]


def _values(df: DataFrame, cols, by) -> DataFrame:
    """(by..., _i, _x): the present values, long form."""
    each = [F.struct(F.lit(i).alias("_i"), F.col(f"`{c}`").cast("double").alias("_x")) for i, c in enumerate(cols)]
    rows = df.select(*[F.col(f"`{b}`").alias(f"_g{k}") for k, b in enumerate(by)], F.inline(F.array(*each)))
    return rows.where(F.col("_x").isNotNull() & ~F.isnan("_x"))


def _inside(rows: DataFrame, ranges: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """Rows with the open range they lie in (ranges of a key are disjoint)."""
    r = ranges.select(*[F.col(k).alias(f"_r{k}") for k in keys], "_lo", "_hi")
    on = _same(keys, [f"_r{k}" for k in keys]) + [F.col("_x") >= F.col("_lo"), F.col("_x") <= F.col("_hi")]
    # without groups there are a few ranges a column; with groups the size is not known: a shuffle join
    return rows.join(F.broadcast(r) if small else r, on).drop(*[f"_r{k}" for k in keys])


def _cell() -> Column:
    """Cell of ``_x`` in its range: the two ends have their own."""
    x, lo, hi = (F.greatest(F.least(F.col(c), F.lit(_BIG)), F.lit(-_BIG)) / 2 for c in ("_x", "_lo", "_hi"))
    between = F.least(F.floor((x - lo) / F.greatest(hi - lo, F.lit(5e-324)) * CELLS), F.lit(CELLS - 1))
    return F.when(F.col("_x") == F.col("_lo"), F.lit(-1)).when(F.col("_x") == F.col("_hi"), F.lit(CELLS)).otherwise(between).cast("int")


def exact_quantiles(df: DataFrame, cols, probs, by=(), interpolate: bool = True) -> DataFrame:
    """``(by..., column, n, quantiles)``: ``quantiles`` is an array in the order of ``probs``;
    without ``interpolate`` the lower of the two values a quantile lies between."""
    cols, by, probs = list(cols), [by] if isinstance(by, str) else list(by), [float(p) for p in probs]
    groups = [f"_g{k}" for k in range(len(by))]
    keys = [*groups, "_i"]
    rows = _values(df, cols, by)
    whole = written(rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")), "ranges")
    # the statistics a quantile lies between, as ranks from 0
    at = [F.lit(p) * (F.col("_n") - 1) for p in probs]
    if not interpolate:
        at = [F.floor(a) for a in at]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(a), F.ceil(a)) for a in at])))
    state = whole.select(*keys, F.explode(ranks).alias("_k"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"),
                         F.col("_n").alias("_rows"))
    while True:
        wide = (F.col("_lo") < F.col("_hi")) & (F.col("_rows") > FEW)
        ranges = state.where(wide).select(*keys, "_lo", "_hi", "_below").distinct()
        if ranges.isEmpty():
            break
        counts = (_inside(rows, ranges, keys, not by).groupBy(*keys, "_lo", "_hi", _cell().alias("_c"))
                  .agg(F.count("*").alias("_m"), F.min("_x").alias("_from"), F.max("_x").alias("_to")))
        upto = Window.partitionBy(*keys, "_lo").orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("_upto", F.sum("_m").over(upto)).withColumnsRenamed({c: f"_r{c}" for c in [*keys, "_lo"]})
        on = _same([*keys, "_lo"], [f"_r{c}" for c in [*keys, "_lo"]]) + [
            F.col("_k") - F.col("_below") < F.col("_upto"), F.col("_k") - F.col("_below") >= F.col("_upto") - F.col("_m")]
        moved = state.where(wide).drop("_hi").join(counts, on).select(
            *keys, "_k", F.col("_from").alias("_lo"), F.col("_to").alias("_hi"),
            (F.col("_below") + F.col("_upto") - F.col("_m")).alias("_below"), F.col("_m").alias("_rows"))
        state = written(state.where(~wide).unionByName(moved), "ranks")
    few = state.where("_lo < _hi").select(*keys, "_lo", "_hi").distinct()
    listed = (_inside(rows, few, keys, not by).groupBy(*keys, "_lo").agg(F.array_sort(F.collect_list("_x")).alias("_list"))
              .withColumnsRenamed({c: f"_r{c}" for c in [*keys, "_lo"]}))
    solved = state.join(listed, _same([*keys, "_lo"], [f"_r{c}" for c in [*keys, "_lo"]]), "left").select(
        *keys, "_k", F.when(F.col("_list").isNull(), F.col("_lo")).otherwise(
            F.element_at("_list", (F.col("_k") - F.col("_below") + 1).cast("int"))).alias("_v"))
    of = solved.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_of"))
    of = of.withColumnsRenamed({k: f"_r{k}" for k in keys})
    both = whole.join(of, _same(keys, [f"_r{k}" for k in keys]))

    def value(a: Column) -> Column:
        low, high = F.floor(a), F.ceil(a)
        v, w = F.col("_of")[low], F.col("_of")[high]
        return F.when((low == high) | (v == w), v).otherwise((high - a) * v + (a - low) * w)

    names = F.array(*[F.lit(c) for c in cols])
    return both.select(*[F.col(g).alias(b) for g, b in zip(groups, by, strict=True)], F.element_at(names, F.col("_i") + 1).alias("column"),
                       F.col("_n").alias("n"), F.array(*[value(a) for a in at]).alias("quantiles"))
