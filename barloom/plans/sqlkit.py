"""Building blocks for the comparison SQL: the same views, written for a plain SQL engine."""

from __future__ import annotations

from barloom.functions.events import BULLISH_CODES, DOWN_CODES, UP_CODES
from barloom.sources.views import CHANGE_CODE_ORDER


def r(expr: str, digits: int) -> str:
    """Half away from zero by the engine's own round(); float noise next to a tie counts as the tie."""
    s = f"{10.0**digits:.1f}::DOUBLE"
    y = f"abs(({expr})*{s})"
    return f"(sign({expr})*round({y} + 1e-8::DOUBLE + least(1e-6::DOUBLE, {y}*1e-14::DOUBLE))/{s}+0.0::DOUBLE)"


def d(expr: str = "day") -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def codes(seq) -> str:
    return "(" + ",".join(str(c) for c in sorted(seq)) + ")"


UP, DOWN, BULL = codes(UP_CODES), codes(DOWN_CODES), codes(BULLISH_CODES)

_KEY = (
    "ROW(l_orderkey,l_linenumber,l_partkey,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus)"
)
_SIGNED = "CASE l_returnflag WHEN 'A' THEN l_extendedprice WHEN 'R' THEN -l_extendedprice ELSE 0 END"

BARS = f"""bars AS MATERIALIZED (
  SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS day, arg_min(p, k) AS open, max(p) AS high, min(p) AS low,
         arg_max(p, k) AS close, sum(l_quantity) AS volume, {r('sum(l_extendedprice)', 2)} AS amount,
         {r('avg(l_discount)', 6)} AS turnover, {r(f'sum({_SIGNED})', 2)} AS net_inflow
  FROM (SELECT *, l_extendedprice / l_quantity AS p, {_KEY} AS k FROM lineitem)
  GROUP BY 1, 2)"""

TICKS = """ticks AS MATERIALIZED (
  SELECT event_id, event_type AS code, ts, value AS price,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS volume, user_id FROM events)"""

CHANGES = f"""changes AS MATERIALIZED (
  SELECT event_id, ts, strftime(ts, '%Y-%m-%d') AS change_date, strftime(ts, '%H:%M:%S') AS change_time, code,
         'U' || code AS name, 'NATION_' || (code % 25) AS industry,
         ['AFRICA','AMERICA','ASIA','EUROPE','MIDDLE EAST'][(code % 5) + 1] || ',' || event_type AS concept,
         change_type,
         CASE WHEN change_type IN {UP} THEN 'up' WHEN change_type IN {DOWN} THEN 'down' ELSE 'other' END AS change_class,
         amount, volume
  FROM (SELECT event_id, ts, user_id AS code, event_type, value AS amount,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS volume,
               {list(CHANGE_CODE_ORDER)}[(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 22) + 1] AS change_type
        FROM events))"""

SECTORS = """sectors AS MATERIALIZED (
  SELECT s_suppkey AS code, s_name AS name, n_name AS industry, r_name AS concept
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""

TRADES = """trades AS MATERIALIZED (
  SELECT l_partkey AS code, CAST(l_shipdate AS DATE) AS day,
         CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side,
         l_extendedprice / l_quantity AS price, l_quantity AS volume,
         row_number() OVER (PARTITION BY l_partkey ORDER BY CAST(l_shipdate AS DATE), l_orderkey, l_linenumber,
           l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS seq
  FROM lineitem)"""


def w(n: int, keys: str = "code", order: str = "day") -> str:
    """Frame of the last n rows."""
    return f"(PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


W = "(PARTITION BY code ORDER BY day)"


def roll(fn: str, x: str, n: int) -> str:
    """fn over the last n rows, null unless all n hold a value."""
    return f"(CASE WHEN count({x}) OVER {w(n)} = {n} THEN {fn}({x}) OVER {w(n)} END)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER {W}"


def wma(x: str, n: int) -> str:
    terms = [f"lag({x}, {n - 1 - j}) OVER {W} * {j + 1}" for j in range(n - 1)] + [f"({x}) * {n}"]
    return "((" + " + ".join(terms) + f") / {n * (n + 1) / 2})"


def ctes(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


# --- recurrences as recursive SQL ---------------------------------------------------------------


def recursive(inputs: str, fields: list[tuple[str, str, str]], select: str, before: str = BARS, final: str = "") -> str:
    """Row-by-row state machine per code.

    `inputs` selects code, day, bn and input columns; a field is (name, initial, step) where
    the step reads inputs as b.x, the previous row as p_name and earlier fields of its own
    row by name.
    """
    init = ", ".join(f"CAST({i} AS DOUBLE) AS {n}" for n, i, _ in fields)
    prev = ", ".join(f"{n} AS p_{n}" for n, _, _ in fields)
    step = ", ".join(f"CAST({s} AS DOUBLE) AS {n}" for n, _, s in fields)
    names = ", ".join(n for n, _, _ in fields)
    return (
        ctes(
            before,
            f"b AS MATERIALIZED ({inputs})",
            f"""rec AS (
  SELECT DISTINCT code, CAST(NULL AS DATE) AS day, CAST(0 AS BIGINT) AS bn, {init} FROM b
  UNION ALL
  SELECT code, day, bn, {names} FROM (
    SELECT b.code, b.day, b.bn, {step}
    FROM (SELECT code AS p_code, bn AS p_at, {prev} FROM rec) r JOIN b ON b.code = r.p_code AND b.bn = r.p_at + 1))""",
            *( [final] if final else [] ),
            recursive=True,
        )
        + select
    )


def f_ema(n: str, x: str, p: int, leading: bool = False) -> list[tuple[str, str, str]]:
    k = repr(2.0 / (p + 1))
    gap = "0" if not leading else f"p_{n}_c"
    gap_s = "0" if not leading else f"p_{n}_s"
    return [
        (f"{n}_c", "0", f"CASE WHEN ({x}) IS NULL THEN {gap} ELSE p_{n}_c + 1 END"),
        (f"{n}_s", "0", f"CASE WHEN ({x}) IS NULL THEN {gap_s} ELSE p_{n}_s + ({x}) END"),
        (
            f"{n}_v",
            "NULL",
            f"CASE WHEN ({x}) IS NULL THEN p_{n}_v WHEN p_{n}_v IS NOT NULL THEN ({x}) * {k} + p_{n}_v * (1 - {k})"
            f" WHEN {n}_c = {p} THEN {n}_s / {p} END",
        ),
        (n, "NULL", f"CASE WHEN ({x}) IS NULL THEN NULL ELSE {n}_v END"),
    ]


def f_rma(n: str, x: str, p: int) -> list[tuple[str, str, str]]:
    return [
        (f"{n}_c", "0", f"CASE WHEN ({x}) IS NULL THEN p_{n}_c ELSE p_{n}_c + 1 END"),
        (f"{n}_s", "0", f"CASE WHEN ({x}) IS NULL THEN p_{n}_s ELSE p_{n}_s + ({x}) END"),
        (
            n,
            "NULL",
            f"CASE WHEN ({x}) IS NULL THEN p_{n} WHEN p_{n} IS NOT NULL THEN (p_{n} * {p - 1} + ({x})) / {p}"
            f" WHEN {n}_c = {p} THEN {n}_s / {p} END",
        ),
    ]


def f_sum(n: str, x: str, p: int) -> list[tuple[str, str, str]]:
    return [
        (f"{n}_c", "0", f"p_{n}_c + 1"),
        (f"{n}_s", "0", f"p_{n}_s + ({x})"),
        (n, "NULL", f"CASE WHEN p_{n} IS NOT NULL THEN p_{n} - p_{n} / {p} + ({x}) WHEN {n}_c = {p} THEN {n}_s END"),
    ]


TR = (
    f"CASE WHEN {lag('close')} IS NULL THEN high - low ELSE greatest(high - low, abs(high - {lag('close')}), "
    f"abs(low - {lag('close')})) END"
)
MFM = "CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END"
AT = f"row_number() OVER {W} AS bn"
