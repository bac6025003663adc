"""SQL text for the oracle side, generated from the same fixed tables as the
Spark expressions so both engines apply identical constants."""

from airseries.functions.aqi import ADVISORY, CATEGORY_5, CATEGORY_6, PM25_BREAKPOINTS


def sround(expr: str, digits: int = 6, even: bool = False) -> str:
    """Round like Spark's ``round``/``bround`` on DOUBLE: Spark rounds the
    shortest decimal form of the double (HALF_UP, or HALF_EVEN for bround),
    DuckDB's DOUBLE round works on ``x * 10^d`` in binary. The two differ on
    exact decimal ties, so the oracle rounds the VARCHAR -> DECIMAL form.
    The result is never -0.0, like Spark's."""
    fn = "round_even" if even else "round"
    return (f"CAST({fn}(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 15)), {digits}) AS DOUBLE)")


def r6(expr: str) -> str:
    return sround(expr, 6)


def aqi_sql(x: str) -> str:
    arms = []
    for lo, hi, ilo, ihi in PM25_BREAKPOINTS:
        slope = repr((ihi - ilo) / (hi - lo))
        arms.append(f"WHEN CAST({x} AS DOUBLE) >= {lo!r} AND CAST({x} AS DOUBLE) <= {hi!r} "
                    f"THEN CAST(round_even(CAST({slope} AS DOUBLE) * (CAST({x} AS DOUBLE) - CAST({lo!r} AS DOUBLE)) + {ilo}, 0) AS INTEGER)")
    return "(CASE " + " ".join(arms) + " END)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def cat6_sql(x: str, field: int) -> str:
    arms = []
    for bound, label, sym in CATEGORY_6:
        val = _q((label, sym)[field])
        arms.append(f"WHEN {x} IS NOT NULL THEN {val}" if bound is None else f"WHEN {x} <= {bound} THEN {val}")
    return "(CASE " + " ".join(arms) + " END)"


def cat5_sql(x: str) -> str:
    arms = []
    for bound, label in CATEGORY_5:
        arms.append(f"WHEN {x} IS NOT NULL THEN {_q(label)}" if bound is None else f"WHEN {x} <= {bound} THEN {_q(label)}")
    return "(CASE " + " ".join(arms) + " END)"


def advisory_sql(x: str) -> str:
    arms = []
    for bound, text in ADVISORY:
        arms.append(f"WHEN {x} IS NOT NULL THEN {_q(text)}" if bound is None else f"WHEN {x} > {bound} THEN {_q(text)}")
    return "(CASE " + " ".join(arms) + " END)"


def win(order="datetime", key="series_id", frame=""):
    return f"(PARTITION BY {key} ORDER BY {order}{(' ' + frame) if frame else ''})"


def roll(col: str, n: int, name: str, fn="avg", order="datetime", key="series_id", digits=6) -> str:
    w = win(order, key, f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW")
    v = f"{fn}({col}) OVER {w}"
    v = r6(v) if digits == 6 else v
    return f"CASE WHEN count({col}) OVER {w} = {n} THEN {v} END AS {name}"


def shift(col: str, k: int, name: str, fn="lag", order="datetime", key="series_id") -> str:
    return f"{fn}({col}, {k}) OVER {win(order, key)} AS {name}"


def corr_sql(a: str, b: str) -> str:
    """Same formula as ``eda.safe_corr``."""
    x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    return (f"covar_pop({x}, {y}) / nullif(stddev_pop(CASE WHEN {both} THEN {x} END)"
            f" * stddev_pop(CASE WHEN {both} THEN {y} END), 0)")
