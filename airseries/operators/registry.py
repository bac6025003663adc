"""Model registry as a table: every transition is a pure DataFrame ->
DataFrame function; ``sources.tables.overwrite_table`` publishes the new
version atomically (no delete-then-insert window).

``key`` names the columns that identify a "slot" (default ``horizon``; use
``("series_id", "horizon")`` for per-series models). One call transitions
every slot at once with window functions over the slot, so the work is one
shuffle by slot whatever the number of series.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

PRODUCTION, CANDIDATE, ARCHIVED = "production", "candidate", "archived"


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _slot(key):
    return Window.partitionBy(*_keys(key))


def _ts(value):
    return F.lit(value).cast("timestamp_ntz") if value is not None else F.current_timestamp().cast("timestamp_ntz")


def register_candidates(registry: DataFrame, new_rows: DataFrame,
                        registered_at: dt.datetime | str | None = None) -> DataFrame:
    """Append rows as ``candidate`` with ``is_best = false``."""
    rows = new_rows.withColumns({"status": F.lit(CANDIDATE), "is_best": F.lit(False),
                                 "registered_at": _ts(registered_at)})
    return registry.unionByName(rows.select(*[c for c in registry.columns if c in rows.columns]),
                                allowMissingColumns=True)


def promote_run(registry: DataFrame, run_id: str, key="horizon") -> DataFrame:
    """R2: in every slot where ``run_id`` has rows, its lowest-RMSE row
    (ties: model_name) becomes production/best, and only rows that were
    production in that slot are archived."""
    in_run = F.col("run_id") == F.lit(run_id)
    rank = F.row_number().over(_slot(key).orderBy((~F.coalesce(in_run, F.lit(False))).asc(),
                                                  F.asc_nulls_last("rmse"), "model_name"))
    touched = F.max(F.coalesce(in_run, F.lit(False)).cast("int")).over(_slot(key)) == 1
    r = registry.withColumns({"_rank": rank, "_touched": touched})
    win = F.col("_touched") & (F.col("_rank") == 1) & in_run
    was_prod = F.col("_touched") & (F.col("status") == PRODUCTION)
    return r.withColumns({
        "status": F.when(win, F.lit(PRODUCTION)).when(was_prod, F.lit(ARCHIVED)).otherwise(F.col("status")),
        "is_best": F.when(win, F.lit(True)).when(was_prod, F.lit(False)).otherwise(F.col("is_best")),
    }).drop("_rank", "_touched")


def promote_best(registry: DataFrame, horizon: int | None = None, key="horizon") -> DataFrame:
    """Lowest-RMSE candidate of a slot becomes production/best and every
    other row of the slot is archived. ``horizon=None`` transitions all slots
    (slots without a candidate are left as they are); a given horizon without
    candidate raises."""
    is_cand = F.coalesce(F.col("status") == CANDIDATE, F.lit(False))
    if horizon is not None:
        if registry.filter((F.col("horizon") == horizon) & is_cand).limit(1).count() == 0:
            raise RuntimeError(f"horizon {horizon}: nothing to promote, no candidate is registered")
    rank = F.row_number().over(_slot(key).orderBy((~is_cand).asc(), F.asc_nulls_last("rmse"), "model_name"))
    has = F.max(is_cand.cast("int")).over(_slot(key)) == 1
    scope = F.lit(True) if horizon is None else (F.col("horizon") == F.lit(horizon))
    r = registry.withColumns({"_rank": rank, "_has": has & scope})
    win = F.col("_has") & (F.col("_rank") == 1)
    return r.withColumns({
        "status": F.when(win, F.lit(PRODUCTION)).when(F.col("_has"), F.lit(ARCHIVED)).otherwise(F.col("status")),
        "is_best": F.when(win, F.lit(True)).when(F.col("_has"), F.lit(False)).otherwise(F.col("is_best")),
    }).drop("_rank", "_has")


def publish(registry: DataFrame, new_rows: DataFrame, key="horizon", keep_status: bool = False,
            registered_at=None) -> DataFrame:
    """Add ``new_rows`` as production/best. Old rows of the same
    slots lose ``is_best``; with ``keep_status=False`` (R4) rows that were
    production are also archived, with ``keep_status=True`` (R5, R8) status
    stays. Of several new rows of one slot the one with the lowest RMSE (ties:
    model_name, run_id) is the best one; the others are added as archived
    (R4) or as production without ``is_best`` (R5, R8), so a slot never has two
    best rows. The slot set is a distinct projection of the new rows joined
    back (Catalyst/AQE choose broadcast when it is small)."""
    keys = _keys(key)
    slots = new_rows.select(*keys).distinct().withColumn("_hit", F.lit(True))
    r = registry.join(slots, keys, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    status = F.col("status") if keep_status else \
        F.when(hit & (F.col("status") == PRODUCTION), F.lit(ARCHIVED)).otherwise(F.col("status"))
    old = r.withColumns({"status": status,
                         "is_best": F.when(hit, F.lit(False)).otherwise(F.col("is_best"))}) \
           .drop("_hit").select(*registry.columns)
    order = [F.asc_nulls_last(c) for c in ("rmse", "model_name", "run_id") if c in new_rows.columns]
    first = F.row_number().over(_slot(key).orderBy(*(order or keys))) == 1
    ranked = new_rows.withColumn("_first", first)
    add = ranked.withColumns({
        "status": F.when(F.col("_first") | F.lit(keep_status), F.lit(PRODUCTION)).otherwise(F.lit(ARCHIVED)),
        "is_best": F.col("_first")}).drop("_first")
    if "registered_at" not in new_rows.columns:
        add = add.withColumn("registered_at", _ts(registered_at))
    return old.unionByName(add, allowMissingColumns=True)


def rollback(registry: DataFrame, horizon: int, run_id: str, key="horizon") -> DataFrame:
    """Flags only. The target is the row of (horizon, run_id) with the
    lowest RMSE (ties: model_name) of every slot the run has a row in; the
    other rows of those slots lose ``is_best``, slots without the run stay as
    they are. Unknown (horizon, run_id) raises."""
    hit = (F.col("horizon") == F.lit(horizon)) & (F.col("run_id") == F.lit(run_id))
    if registry.filter(hit).limit(1).count() == 0:
        raise RuntimeError(f"no row of run {run_id} for horizon {horizon}")
    hitc = F.coalesce(hit, F.lit(False))
    rank = F.row_number().over(_slot(key).orderBy((~hitc).asc(), F.asc_nulls_last("rmse"), "model_name"))
    touched = F.max(hitc.cast("int")).over(_slot(key)) == 1
    r = registry.withColumns({"_rank": rank, "_touched": touched})
    target = hitc & (F.col("_rank") == 1)
    return r.withColumn("is_best", F.when(target, F.lit(True))
                        .when(F.col("_touched"), F.lit(False))
                        .otherwise(F.col("is_best"))).drop("_rank", "_touched")


def upsert(registry: DataFrame, new_rows: DataFrame, on=("model_name", "horizon"),
           order=("registered_at", "run_id")) -> DataFrame:
    """Clear ``is_best`` of every production row, then set the columns of
    ``new_rows`` on the first existing row of each ``on`` key (by ``order``),
    or insert the row. Columns absent from ``new_rows`` keep their values. Of
    several new rows of one key the last by ``order`` (then by all columns)
    counts, as if they were applied one after the other."""
    on = list(on)
    last = [F.desc_nulls_last(c) for c in order if c in new_rows.columns]
    last += [F.desc_nulls_last(c) for c in sorted(set(new_rows.columns) - set(on) - set(order))]
    new_rows = (new_rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*on).orderBy(*(last or on))))
                .where("_nth = 1").drop("_nth"))
    base = registry.withColumn("is_best", F.when(F.col("status") == PRODUCTION, F.lit(False))
                               .otherwise(F.col("is_best")))
    w = Window.partitionBy(*on).orderBy(*[F.asc_nulls_last(c) for c in order if c in registry.columns])
    base = base.withColumn("_pos", F.row_number().over(w))
    upd = new_rows.withColumn("_pos", F.lit(1)).withColumn("_new", F.lit(True))
    j = base.join(upd.select(*[F.col(c).alias(f"_n_{c}") if c not in on + ["_pos"] else F.col(c)
                               for c in upd.columns]), on + ["_pos"], "full_outer")
    out_cols = list(registry.columns) + [c for c in new_rows.columns if c not in registry.columns]
    sel = []
    for c in out_cols:
        if c in on:
            sel.append(F.col(c))
        elif c in new_rows.columns:
            sel.append(F.when(F.col("_n__new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)
                       if c in registry.columns else F.col(f"_n_{c}").alias(c))
        else:
            sel.append(F.col(c))
    return j.select(*sel)


def load_active(file_registry: DataFrame, position: str = "position") -> DataFrame:
    """Active entries keyed by ``horizon_hours``; the later entry wins."""
    act = file_registry.filter(F.col("status") == "active")
    if act.limit(1).count() == 0:
        raise RuntimeError("the registry has no entry with status active")
    rest = [c for c in file_registry.columns if c != "horizon_hours"]
    return (act.groupBy("horizon_hours").agg(F.max_by(F.struct(*rest), F.col(position)).alias("_e"))
               .select("horizon_hours", "_e.*"))


def best_model(registry: DataFrame, horizon: int | None = None) -> DataFrame:
    """The best row of a horizon, or of any (lowest horizon): one row,
    by RMSE, then model_name."""
    b = registry.filter(F.col("is_best"))
    if horizon is not None:
        b = b.filter(F.col("horizon") == F.lit(horizon))
    return b.orderBy("horizon", F.asc_nulls_last("rmse"), "model_name").limit(1)


def metrics_listing(registry: DataFrame) -> DataFrame:
    """Registry metrics, ordered by horizon then RMSE."""
    return (registry.select("model_name", "horizon", "rmse", "mae", "r2", "status")
                    .orderBy("horizon", F.asc_nulls_last("rmse"), "model_name"))


def assert_single_best(registry: DataFrame, key="horizon") -> None:
    """Invariant: at most one ``is_best`` row per slot."""
    bad = (registry.filter(F.col("is_best")).groupBy(*_keys(key)).count()
                   .filter(F.col("count") > 1).limit(1).count())
    if bad:
        raise AssertionError("more than one is_best row in a slot")
