"""Row-based series features: lags, rolling statistics, calendar parts, targets.

All window columns of one build share a single ``Window`` spec
(``partitionBy(key).orderBy(order)``), so Catalyst plans them as one
Exchange + one Sort + one Window node.

Skew: a Window partition is never split by AQE. Builds therefore run one plan
whatever the size, with one full shuffle. Rows are first counted per (series, cell of
time) in a scan of the key and time columns only; prefix sums of these counts cut each
series with more than ``chunk_rows`` rows into pieces of consecutive cells, and tell for
each piece the first and last cell that its look-back and look-ahead reach, and the
position of its first row. That table holds one row per such long series, so it joins by
broadcast; every row finds its piece by binary search over the piece starts, is copied
to the few neighbouring pieces that need its cell, and the window runs per (series,
piece), which gives features, positions and series sizes at once; each piece keeps its own
rows. A cell is a day; days with more than ``chunk_rows`` rows of a series are counted
by the second instead, so a window task holds ``chunk_rows`` rows, one cell and its
neighbours' halo, whatever the length of a series and the density of its days
(``bucket`` fixes another cell). NULL keys and NULL times are values like others (NULL
times first). ``chunk_rows=None`` asks for one window per series instead; nothing
counts rows to choose a plan.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from airseries.functions.calendar import _PARTS

#: Rows of a series that one window task owns.
CHUNK_ROWS = 500_000


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _orders(order, tiebreak=None) -> list[str]:
    cols = [order] if isinstance(order, str) else list(order)
    if tiebreak:
        cols += [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
    return cols


def series_window(key="series_id", order="datetime", tiebreak=None):
    return Window.partitionBy(*_keys(key)).orderBy(*_orders(order, tiebreak))


@dataclass(frozen=True)
class FeatureSpec:
    """Declarative feature build. ``{src}`` in names is the base column."""

    source: str = "pm2_5"
    alias: str | None = None            # copy of ``source`` that lags/rolls read
    lags: tuple = ()
    lag_name: str = "{src}_lag_{k}"
    roll_mean: tuple = ()
    roll_mean_name: str = "{src}_roll_mean_{n}"
    roll_std: tuple = ()
    roll_std_name: str = "{src}_roll_std_{n}"
    calendar: tuple = ()
    targets: tuple = ()                 # ((name, rows_ahead), ...)
    dropna: bool = False
    digits: int | None = None           # round rolling statistics

    @property
    def base(self) -> str:
        return self.alias or self.source

    @property
    def lookback(self) -> int:
        vals = list(self.lags) + [n - 1 for n in self.roll_mean + self.roll_std]
        return max(vals) if vals else 0

    @property
    def lead(self) -> int:
        return max([r for _, r in self.targets], default=0)

    def lag_cols(self) -> list[tuple[str, int]]:
        return [(self.lag_name.format(src=self.base, k=k), k) for k in self.lags]

    def feature_names(self) -> list[str]:
        names = [n for n, _ in self.lag_cols()]
        names += [self.roll_mean_name.format(src=self.base, n=n) for n in self.roll_mean]
        names += [self.roll_std_name.format(src=self.base, n=n) for n in self.roll_std]
        return list(self.calendar) + names

    def target_names(self) -> list[str]:
        return [n for n, _ in self.targets]

    def with_(self, **kw) -> "FeatureSpec":
        return replace(self, **kw)


def _rolling(c: Column, w, n: int, fn, digits) -> Column:
    """pandas ``rolling(n)`` semantics: NULL unless the frame holds n non-null values."""
    f = w.rowsBetween(-(n - 1), 0)
    val = fn(c).over(f)
    if digits is not None:
        val = F.round(val, digits)
    return F.when(F.count(c).over(f) == F.lit(n), val)


def window_columns(spec: FeatureSpec, w) -> dict[str, Column]:
    src = F.col(spec.base)
    cols: dict[str, Column] = {}
    for name, k in spec.lag_cols():
        cols[name] = F.lag(src, k).over(w)
    for n in spec.roll_mean:
        cols[spec.roll_mean_name.format(src=spec.base, n=n)] = _rolling(src, w, n, F.avg, spec.digits)
    for n in spec.roll_std:
        cols[spec.roll_std_name.format(src=spec.base, n=n)] = _rolling(src, w, n, F.stddev_samp, spec.digits)
    for name, rows in spec.targets:
        cols[name] = F.lead(src, rows).over(w)
    return cols


def build_features(df: DataFrame, spec: FeatureSpec, key="series_id", order="datetime",
                   tiebreak=None, chunk_rows: int | None = CHUNK_ROWS, bucket=None) -> DataFrame:
    """Apply ``spec`` per series. ``chunk_rows``: rows of a series per window
    task, or None for one window per series, for callers that know every
    series is bounded; both give the same rows. ``bucket``: see ``series_pieces``."""
    if spec.alias:
        df = df.withColumn(spec.alias, F.col(spec.source))
    if spec.calendar:
        ts = F.col(order if isinstance(order, str) else order[0])
        df = df.withColumns({p: _PARTS[p](ts) for p in spec.calendar})
    if chunk_rows:
        out = _pieced(df, spec, key, order, tiebreak, int(chunk_rows), bucket)
    else:
        out = df.withColumns(window_columns(spec, series_window(key, order, tiebreak)))
    return out.dropna(how="any") if spec.dropna else out


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``on`` in which NULL equals NULL; the columns of ``left`` keep their names."""
    r = right.withColumnsRenamed({c: f"_j_{c}" for c in on})
    cond = [F.col(c).eqNullSafe(F.col(f"_j_{c}")) for c in on]
    return left.join(r, cond, how).drop(*[f"_j_{c}" for c in on])


def with_ordinals(df: DataFrame, key="series_id", order="datetime", tiebreak=None,
                  bucket: Column | str | None = None, name: str = "_o") -> DataFrame:
    """0-based row position within each series without one sort per series.

    Rows are counted per (series, bucket) (partial aggregation, tiny output),
    the counts are prefix-summed per series, joined back, and a row_number
    inside each (series, bucket) adds the local offset. ``bucket`` is a unit of
    time (default ``"day"``; ``"hour"``, ``"minute"``, ... split dense days) or a
    column that rises with the order. Rows with NULL keys or times are kept.
    """
    keys = _keys(key)
    orders = _orders(order, tiebreak)
    if bucket is None or isinstance(bucket, str):
        t = F.col(orders[0])
        bucket = F.to_date(t) if bucket in (None, "day") else F.date_trunc(bucket, t)
    b = df.withColumn("_bkt", bucket)
    counts = b.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    wk = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bkt", F.coalesce(F.sum("_n").over(wk), F.lit(0)).alias("_off"))
    j = null_safe_join(b, offsets, keys + ["_bkt"])
    wr = Window.partitionBy(*keys, "_bkt").orderBy(*orders)
    return (j.withColumn(name, F.col("_off") + F.row_number().over(wr) - F.lit(1))
             .drop("_bkt", "_off"))


#: Seconds of a cell by its name, and a coordinate before all times.
_CELLS = {"day": 86_400, "hour": 3_600, "minute": 60, "second": 1}
_FIRST, _LAST = -(1 << 62), 1 << 62
#: Pieces of all long series together (the rows of the broadcast table's arrays).
MAX_PIECES = 100_000
#: A piece is reached from the pieces up to so many places away (it holds as many rows as any halo).
_REACH = 2


def _coordinate(df: DataFrame, order: str) -> Column:
    """A long that rises with the time column: its second, whatever the session's time zone."""
    t, kind = F.col(order), dict(df.dtypes)[order]
    if kind == "timestamp":
        x = F.floor(F.unix_micros(t) / F.lit(1_000_000)).cast("long")
    elif kind == "timestamp_ntz":
        x = (F.unix_date(F.to_date(t)).cast("long") * 86_400 + F.hour(t) * 3_600 + F.minute(t) * 60
             + F.second(t)).cast("long")
    elif kind == "date":
        x = F.unix_date(t).cast("long") * 86_400
    else:
        raise ValueError(f"{order}: a {kind} column needs a bucket column that rises with it")
    return F.coalesce(x, F.lit(_FIRST))


def series_pieces(df: DataFrame, x: Column, key, lookback: int, lead: int, chunk_rows: int, bucket=None) -> DataFrame:
    """The pieces of every series with more than ``chunk_rows`` rows, one row a series: the keys,
    ``_tot`` (rows) and ``_pieces``, an array of (start, lo, off, hi): a piece's first cell, the
    first cell its look-back reaches, the position of that cell's first row, and the end of
    what the look-ahead of the piece before it reaches.

    ``x``: the rows' coordinate. ``bucket``: a cell's name, or a column that is its own cell. All
    series together get at most twice ``MAX_PIECES`` pieces: beyond ``MAX_PIECES * chunk_rows``
    rows, pieces grow instead, so the table stays small enough to broadcast."""
    keys = _keys(key)
    size = max(chunk_rows, lookback, lead, 1)
    base = df.select(*keys, x.alias("_x"))

    def counted(rows: DataFrame, width: int | None) -> DataFrame:
        cell = F.col("_x") if width is None else F.col("_x") - F.pmod("_x", F.lit(width))
        return rows.groupBy(*keys, cell.alias("_c")).agg(F.count(F.lit(1)).alias("_k"))

    if isinstance(bucket, Column):
        cells = counted(base, None)
    else:
        cells = counted(base, _CELLS[bucket or "day"])
        if bucket is None:  # days that alone would fill a piece are counted by the second
            full = F.col("_k") > size
            heavy = cells.where(full).select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.col("_c").alias("_h"))
            day = F.col("_x") - F.pmod("_x", F.lit(_CELLS["day"]))
            same = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys] + [day == F.col("_h")]
            dense = base.join(F.broadcast(heavy), same, "left_semi")
            cells = cells.where(~full).unionByName(counted(dense, _CELLS["second"]))
    rows_each = F.greatest(F.lit(size), F.ceil(counted(base, _CELLS["day"]).agg(F.sum("_k")).scalar() / MAX_PIECES))
    along = Window.partitionBy(*keys).orderBy("_c")
    s = cells.withColumns({"_off": F.coalesce(F.sum("_k").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                           "_tot": F.sum("_k").over(Window.partitionBy(*keys)),
                           "_before": F.lag("_c").over(along), "_next": F.lead("_c", 1, _LAST).over(along)})
    s = s.where(F.col("_tot") > rows_each).withColumn("_p", F.floor(F.col("_off") / rows_each))
    by_row = Window.partitionBy(*keys).orderBy("_off")
    behind = by_row.rangeBetween(1 - lookback, 0) if lookback else None
    lo = F.coalesce(F.min("_before").over(behind), F.col("_c")) if behind else F.col("_c")
    hi = F.max("_next").over(by_row.rangeBetween(0, lead - 1)) if lead else F.col("_c")
    s = s.withColumns({"_lo": lo, "_hi": hi, "_was": F.lag("_p").over(along), "_row": F.col("_off") - F.lag("_k").over(along)})
    if behind:  # the position of the first row of the cell _lo
        s = s.withColumn("_at", F.coalesce(F.min("_row").over(behind), F.col("_off")))
    else:
        s = s.withColumn("_at", F.col("_off"))
    firsts = s.where(F.col("_was").isNull() | (F.col("_was") != F.col("_p")))
    return firsts.groupBy(*keys).agg(F.max("_tot").alias("_tot"), F.array_sort(F.collect_list(F.struct(
        F.col("_c").alias("start"), F.col("_lo").alias("lo"), F.col("_at").alias("off"), F.col("_hi").alias("hi")))).alias("_pieces"))


def _place(x: Column, pieces: Column) -> Column:
    """Index (from 0) of the last piece that starts at or before ``x``: a binary search."""
    def halve(state: Column, _: Column) -> Column:
        mid = F.floor((state["lo"] + state["hi"] + 1) / 2).cast("int")
        right = F.element_at(pieces, mid + 1)["start"] <= x
        return F.when(state["lo"] == state["hi"], state).otherwise(
            F.struct(F.when(right, mid).otherwise(state["lo"]).alias("lo"),
                     F.when(right, state["hi"]).otherwise(mid - 1).alias("hi")))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(pieces))).cast("int") + 1)
    whole = F.struct(F.lit(0).alias("lo"), (F.size(pieces) - 1).alias("hi"))
    return F.aggregate(steps, whole, halve, lambda state: state["lo"])


def in_pieces(df: DataFrame, lookback: int, lead: int, key="series_id", order="datetime", tiebreak=None,
              chunk_rows: int = CHUNK_ROWS, bucket=None) -> DataFrame:
    """``df`` with every row in each piece that needs it: ``_piece``, ``_own`` (whether the
    row belongs to it), ``_base`` (position of the piece's first row) and ``_tot`` (rows of the
    series, NULL unless it is long; such a series has one piece)."""
    keys = _keys(key)
    x = F.coalesce(bucket.cast("long"), F.lit(_FIRST)) if isinstance(bucket, Column) else \
        _coordinate(df, _orders(order)[0])
    pieces = series_pieces(df, x, key, lookback, lead, chunk_rows, bucket)
    r = pieces.withColumnsRenamed({k: f"_j_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in keys]
    j = df.withColumn("_x", x).join(F.broadcast(r), same, "left").drop(*[f"_j_{k}" for k in keys])
    table, x = F.col("_pieces"), F.col("_x")
    j = j.withColumn("_at", F.when(table.isNotNull(), _place(x, table)))
    own = F.col("_at")

    def entry(i: Column) -> Column:
        return F.element_at(table, i + 1)

    near = F.sequence(F.greatest(own - _REACH, F.lit(0)), F.least(own + _REACH, F.size(table) - 1))
    needed = F.filter(near, lambda i: (i == own) | ((i > own) & (entry(i)["lo"] <= x)) | ((i < own) & (x < entry(i + 1)["hi"])))
    of_long = F.transform(needed, lambda i: F.struct(i.alias("_piece"), (i == own).alias("_own"), entry(i)["off"].alias("_base")))
    of_other = F.array(F.struct(F.lit(0).alias("_piece"), F.lit(True).alias("_own"), F.lit(0).cast("long").alias("_base")))
    places = F.when(table.isNotNull(), of_long).otherwise(of_other)
    rest = [F.col(f"`{c}`") for c in df.columns]
    return j.select(*rest, "_tot", F.inline(places))


def _pieced(df: DataFrame, spec: FeatureSpec, key, order, tiebreak, chunk_rows: int, bucket=None,
            position: bool = False) -> DataFrame:
    """Window columns per (series, piece); with ``position`` also ``_o`` (0-based position in
    the series) and ``_n`` (rows of the series)."""
    rows = in_pieces(df, spec.lookback, spec.lead, key, order, tiebreak, chunk_rows, bucket)
    part = Window.partitionBy(*_keys(key), "_piece")
    w = part.orderBy(*_orders(order, tiebreak))
    cols = window_columns(spec, w)
    if position:
        cols["_o"] = F.col("_base") + F.row_number().over(w) - F.lit(1)
        cols["_n"] = F.coalesce("_tot", F.count(F.lit(1)).over(part))
    return rows.withColumns(cols).where("_own").drop("_piece", "_own", "_base", "_tot")


def with_position(df: DataFrame, key="series_id", order="datetime", tiebreak=None, bucket=None,
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``_o`` (0-based row position) and ``_n`` (rows in the series), both
    without gathering a long series into one task."""
    return _pieced(df, FeatureSpec(), key, order, tiebreak, chunk_rows, bucket, position=True)


def chunk_range(ordinal: Column, lookback: int, lead: int, B: int) -> Column:
    """Chunks that need the row at ``ordinal``: its own chunk plus those
    whose look-back or look-ahead reaches it,
    ``floor((o - lead) / B) .. floor((o + lookback) / B)`` clipped at 0."""
    lo = F.greatest(F.floor((ordinal - F.lit(lead)) / F.lit(B)), F.lit(0)).cast("long")
    hi = F.floor((ordinal + F.lit(lookback)) / F.lit(B)).cast("long")
    return F.sequence(lo, hi)


# ---------------------------------------------------------------- single ops

def add_lags(df, col="pm2_5", ks=(1, 6, 12, 24, 48, 72, 168), name="{src}_lag_{k}",
             key="series_id", order="datetime", tiebreak=None, chunk_rows=CHUNK_ROWS, bucket=None):
    spec = FeatureSpec(source=col, lags=tuple(ks), lag_name=name)
    return build_features(df, spec, key, order, tiebreak, chunk_rows=chunk_rows, bucket=bucket)


def add_rolling(df, col="pm2_5", ns=(6, 12, 24, 48), stats=("mean", "std"),
                key="series_id", order="datetime", tiebreak=None, digits=None, chunk_rows=CHUNK_ROWS, bucket=None):
    spec = FeatureSpec(source=col, roll_mean=tuple(ns) if "mean" in stats else (),
                       roll_std=tuple(ns) if "std" in stats else (), digits=digits)
    return build_features(df, spec, key, order, tiebreak, chunk_rows=chunk_rows, bucket=bucket)


def with_targets(df, col="pm2_5", horizons=(1, 2, 3), rows_per_step=24,
                 key="series_id", order="datetime", tiebreak=None, chunk_rows=CHUNK_ROWS, bucket=None):
    """``target_h<h>`` = value ``h * rows_per_step`` rows ahead."""
    spec = FeatureSpec(source=col, targets=tuple((f"target_h{h}", h * rows_per_step) for h in horizons))
    return build_features(df, spec, key, order, tiebreak, chunk_rows=chunk_rows, bucket=bucket)


def horizon_target(df, col="aqi_pm25", h: int = 1, name="target",
                   key="series_id", order="datetime", tiebreak=None, chunk_rows=CHUNK_ROWS, bucket=None):
    """Value ``h`` rows ahead; the last ``h`` rows of each series are cut by
    position (a NULL value inside the series keeps its row)."""
    if h < 1:
        raise ValueError("horizon must be >= 1")
    if chunk_rows:
        out = _pieced(df, FeatureSpec(source=col, targets=((name, h),)), key, order, tiebreak, chunk_rows, bucket,
                      position=True)
        return out.filter(F.col("_o") < F.col("_n") - F.lit(h)).drop("_o", "_n")
    w = series_window(key, order, tiebreak)
    return (df.withColumns({name: F.lead(col, h).over(w),
                            "_keep": F.lead(F.lit(1), h).over(w).isNotNull()})
              .filter("_keep").drop("_keep"))


#: Rows up to which Spark keeps the first rows of a window per map task (its own default).
_GROUP_LIMIT = 1_000


def tail_rows(df, n: int, key="series_id", order="datetime", tiebreak=None, chunked: bool = True, bucket=None):
    """Last ``n`` rows of each series. Up to ``_GROUP_LIMIT`` rows the rank runs backwards, so every
    map task hands on its own last ``n`` rows of a series only and no more than those are
    shuffled; beyond that by position (``chunked``; no window over a whole series)."""
    keys, orders = _keys(key), _orders(order, tiebreak)
    if n <= _GROUP_LIMIT:
        back = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in orders])
        return df.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= F.lit(int(n))).drop("_back")
    if chunked:
        p = with_position(df, key, order, tiebreak, bucket)
        return p.filter(F.col("_o") >= F.col("_n") - F.lit(n)).drop("_o", "_n")
    w = series_window(key, order, tiebreak)
    return (df.withColumn("_tail", F.lead(F.lit(1), n).over(w).isNull())
              .filter("_tail").drop("_tail"))


def time_split(df, frac: float = 0.8, key="series_id", order="datetime", tiebreak=None,
               name="split", chunked: bool = True, bucket=None):
    """Chronological split per series: the first ``floor(frac * n)`` rows are
    ``train``, the rest ``test``. ``chunked``: as in ``tail_rows``."""
    if chunked:
        p = with_position(df, key, order, tiebreak, bucket)
        cut = F.floor(F.lit(float(frac)) * F.col("_n"))
        return p.withColumn(name, F.when(F.col("_o") < cut, F.lit("train")).otherwise(F.lit("test"))) \
                .drop("_o", "_n")
    w = series_window(key, order, tiebreak)
    wp = Window.partitionBy(*_keys(key))
    n_train = F.floor(F.lit(float(frac)) * F.count(F.lit(1)).over(wp))
    return df.withColumn(name, F.when(F.row_number().over(w) <= n_train, F.lit("train"))
                         .otherwise(F.lit("test")))


def gaps(df, key="series_id", order="datetime", name="gap_seconds", chunk_rows=CHUNK_ROWS, bucket=None):
    """Seconds since the previous row of the same series (NULL for the first).
    The previous timestamp is a row lag, so the halo-chunked plan applies."""
    spec = FeatureSpec(source=order, lags=(1,), lag_name="_prev_ts")
    out = build_features(df, spec, key, order, chunk_rows=chunk_rows, bucket=bucket)
    return out.withColumn(name, F.timestamp_diff("SECOND", F.col("_prev_ts"), F.col(order))).drop("_prev_ts")


def latest_rows(df, key="series_id", order="datetime"):
    """Newest row per series via ``max_by`` (partial aggregation, no sort)."""
    keys = _keys(key)
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return agg.select(*keys, "_r.*")


def build_training(df: DataFrame, spec: FeatureSpec, horizon: int, key="series_id", order="datetime",
                   drop=("datetime",), chunk_rows=CHUNK_ROWS, bucket=None) -> DataFrame:
    """W14 with a horizon: the training build (targets, NULL drop) with
    ``label`` = ``target_h<horizon>``; the time key and all targets are
    dropped from the features (absent names ignored)."""
    names = spec.target_names()
    target = f"target_h{horizon}"
    if target not in names:
        raise ValueError(f"{target} is no target of this build: {names}")
    out = build_features(df, spec, key, order, chunk_rows=chunk_rows, bucket=bucket)
    return out.withColumn("label", F.col(target)).drop(*drop, *names)


def build_features_range(df: DataFrame, spec: FeatureSpec, start: str, end: str, key="series_id",
                         order="datetime", tiebreak=None, chunk_rows=CHUNK_ROWS, bucket=None) -> DataFrame:
    """Incremental build: the result of ``build_features`` restricted to
    ``start <= order < end``, without building the whole history.

    Lags are row-based, so the halo is counted in rows: one aggregate over
    the key and time columns only (a pruned scan) counts rows per (series,
    day); a small window over that table finds, per series, the first day
    from which at least ``lookback`` rows precede ``start`` and the last day
    by which ``lead`` rows follow ``end``. Rows outside their own series' days
    are dropped by a join with these bounds before anything is built (one
    sparse series does not widen the days of the others), and the result is
    trimmed to the range. No job runs before the result is asked for.
    """
    keys = _keys(key)
    lb, ld = spec.lookback, spec.lead
    s_ts = F.lit(start).cast("timestamp_ntz")
    e_ts = F.lit(end).cast("timestamp_ntz")
    t = F.col(order)
    per_day = (df.select(*keys, F.to_date(t).alias("_d"), t.alias("_t"))
                 .groupBy(*keys, "_d")
                 .agg(F.count_if(F.col("_t") < s_ts).alias("_pre"),
                      F.count_if(F.col("_t") >= e_ts).alias("_post")))
    back = Window.partitionBy(*keys).orderBy(F.desc("_d")).rowsBetween(Window.unboundedPreceding, 0)
    fwd = Window.partitionBy(*keys).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    cum = per_day.withColumns({"_pre_cum": F.sum("_pre").over(back), "_post_cum": F.sum("_post").over(fwd)})
    # earliest day still needed: the latest day whose cumulative pre-start
    # count reaches lb (or the series' first day); symmetric after ``end``
    lo_day = (F.to_date(s_ts) if lb == 0 else
              F.coalesce(F.max(F.when(F.col("_pre_cum") >= F.lit(lb), F.col("_d"))), F.min("_d")))
    hi_day = (F.to_date(e_ts) if ld == 0 else
              F.coalesce(F.min(F.when(F.col("_post_cum") >= F.lit(ld), F.col("_d"))), F.max("_d")))
    bounds = cum.groupBy(*keys).agg(lo_day.alias("_lo"), hi_day.alias("_hi"))
    near = null_safe_join(df, bounds, keys)
    near = near.filter((F.to_date(t) >= F.col("_lo")) & (F.to_date(t) <= F.col("_hi"))).drop("_lo", "_hi")
    spec_nodrop = spec.with_(dropna=False)
    out = build_features(near, spec_nodrop, key, order, tiebreak, chunk_rows=chunk_rows, bucket=bucket)
    out = out.filter((t >= s_ts) & (t < e_ts))
    return out.dropna(how="any") if spec.dropna else out
