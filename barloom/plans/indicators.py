"""Queries: bars to indicators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.dates import day_text
from barloom.functions.numeric import rnd
from barloom.indicators import recurrent as rc
from barloom.indicators import rolling as ro
from barloom.indicators import waves as wv
from barloom.operators.recurrence import by_instrument
from barloom.plans.registry import query
from barloom.plans.sqlkit import (
    AT,
    BARS,
    MFM,
    TR,
    W,
    ctes,
    d,
    f_ema,
    f_rma,
    f_sum,
    lag,
    r,
    recursive,
    roll,
    w,
    wma,
)
from barloom.sources import views


def shaped(df: DataFrame, outs: dict[str, int | None]) -> DataFrame:
    """code, day text and the outputs, rounded to the given digits (None: as is)."""
    return df.select("code", day_text("day").alias("day"), *[rnd(c, n).alias(c) if n is not None else F.col(c) for c, n in outs.items()])


def _outs_sql(outs: dict[str, int | None]) -> str:
    return "SELECT code, " + d() + " AS day, " + ", ".join(f"{r(c, n)} AS {c}" if n is not None else c for c, n in outs.items())


def rolling(name: str, build: Callable[[DataFrame], DataFrame], outs: dict[str, int | None], *stages: str, flows: bool = False) -> None:
    """Register a window indicator. Each SQL stage adds columns to the previous one."""
    parts, prev = [BARS], "bars"
    for i, s in enumerate(stages):
        parts.append(f"s{i} AS (SELECT *, {s} FROM {prev})")
        prev = f"s{i}"
    sql = ctes(*parts) + f"{_outs_sql(outs)} FROM {prev}"
    source = views.bars_flows if flows else views.bars

    @query(name, sql)
    def run(spark, sf):
        return shaped(build(source(spark, sf)), outs)


def recurrent(name: str, recipes: list[str], outs: dict[str, int | None], inputs: str, fields: list) -> None:
    @query(name, recursive(f"SELECT code, day, {AT}, {inputs} FROM bars", fields, f"{_outs_sql(outs)} FROM rec WHERE bn > 0"))
    def run(spark, sf):
        return shaped(rc.run(views.bars(spark, sf), recipes), outs)


P, V, Q = 3, 3, 6  # digits for prices, volumes, ratios

# --- feature family -------------------------------------------------------------------------
rolling("ind_ma", ro.moving_averages, {f"ma{p}": P for p in (5, 10, 20, 60)}, ", ".join(f"{roll('avg', 'close', p)} AS ma{p}" for p in (5, 10, 20, 60)))

BOLL = f"{roll('avg', 'close', 20)} AS m, {roll('stddev_pop', 'close', 20)} AS sd"
rolling("ind_bollinger", ro.bollinger_pop, {"boll_mid": P, "boll_upper": P, "boll_lower": P}, BOLL, "m AS boll_mid, m + 2 * sd AS boll_upper, m - 2 * sd AS boll_lower")

_past5 = "(PARTITION BY code ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
rolling(
    "ind_volume_ratio",
    lambda b: ro.volume_ratio_display(ro.volume_ratio(b)),
    {"volume_ratio": Q, "volume_ratio_display": 2},
    f"""CASE WHEN count(volume) OVER {_past5} = 5 AND avg(volume) OVER {_past5} > 0 THEN volume / avg(volume) OVER {_past5} ELSE 1 END AS volume_ratio,
        CASE WHEN count(*) OVER {_past5} = 5 AND avg(CASE WHEN volume > 0 THEN volume END) OVER {_past5} > 0
             THEN volume / avg(CASE WHEN volume > 0 THEN volume END) OVER {_past5} END AS volume_ratio_display""",
)
rolling("ind_atr_simple", ro.atr_simple, {"atr_sma": P}, f"CASE WHEN {lag('close')} IS NOT NULL THEN {TR} END AS tr", f"{roll('avg', 'tr', 14)} AS atr_sma")
rolling(
    "ind_change_rate",
    ro.change_rates,
    {f"change_rate{n}": Q for n in (5, 20, 60, 120)},
    ", ".join(f"CASE WHEN {lag('close', n)} = 0 THEN 0 ELSE close / {lag('close', n)} - 1 END AS change_rate{n}" for n in (5, 20, 60, 120)),
)
rolling(
    "ind_volatility",
    ro.log_volatility,
    {"volatility20": Q, "volatility60": Q},
    f"CASE WHEN {lag('close')} > 0 AND close > 0 THEN ln(close / {lag('close')}) END AS lr",
    ", ".join(f"{roll('stddev_pop', 'lr', n)} * sqrt(252) AS volatility{n}" for n in (20, 60)),
)
rolling(
    "ind_amihud",
    lambda b: ro.high_low_ratio(ro.amihud(b)),
    {"amihud": Q, "high_low_ratio": Q},
    f"CASE WHEN {lag('close')} > 0 AND close > 0 AND volume > 0 THEN abs(close / {lag('close')} - 1) / (close * volume * 100) * 1e10 END AS il, {AT}, CASE WHEN close > 0 THEN (high - low) / close ELSE 0 END AS high_low_ratio",
    f"CASE WHEN bn > 5 THEN coalesce(sum(il) OVER {w(5)}, 0) / 5 END AS amihud",
)
_cum = "(PARTITION BY code ORDER BY day ROWS UNBOUNDED PRECEDING)"
rolling(
    "ind_obv",
    lambda b: ro.obv_vol0(ro.obv_zero(b)),
    {"obv_zero": 0, "obv_vol0": 0},
    f"sign(close - {lag('close')}) * volume AS s",
    f"sum(coalesce(s, 0)) OVER {_cum} AS obv_zero, sum(coalesce(s, volume)) OVER {_cum} AS obv_vol0",
)
rolling("ind_fund_flow", ro.fund_flow, {"fund_flow5": 2, "fund_flow20": 2}, ", ".join(f"sum(net_inflow) OVER {w(n)} AS fund_flow{n}" for n in (5, 20)), flows=True)

# --- chart family: windows -------------------------------------------------------------------
TP = "(high + low + close) / 3"
rolling("ind_wma", ro.wma, {"wma": P}, f"{wma('close', 20)} AS wma")
_delta = f"close - {lag('close')} AS dl"
RSI = [
    _delta,
    "CASE WHEN dl IS NOT NULL THEN greatest(dl, 0) END AS g, CASE WHEN dl IS NOT NULL THEN greatest(-dl, 0) END AS lo",
    f"CASE WHEN {roll('sum', 'lo', 14)} = 0 THEN 100 ELSE 100 - 100 / (1 + {roll('sum', 'g', 14)} / {roll('sum', 'lo', 14)}) END AS x, count(dl) OVER {w(14)} AS n",
    "CASE WHEN n = 14 THEN x END AS rsi_cutler",
]
rolling("ind_rsi_cutler", ro.rsi_cutler, {"rsi_cutler": 4}, *RSI)
VWAP = [f"{TP} AS tp", f"{roll('sum', 'volume', 20)} AS sv, {roll('sum', 'tp * volume', 20)} AS spv", "CASE WHEN sv > 0 THEN spv / sv END AS vwap"]
rolling("ind_vwap", ro.vwap, {"vwap": P}, *VWAP)
rolling(
    "ind_vwap_bands",
    ro.vwap_bands,
    {"vwap": P, "vwap_upper": 2, "vwap_lower": 2},
    *VWAP,
    f"CASE WHEN vwap IS NOT NULL THEN list({{'t': tp, 'v': CASE WHEN volume = 0 THEN 1 ELSE volume END}}) OVER {w(20)} END AS wl",
    "sqrt(list_sum(list_transform(wl, lambda e: (e.t - vwap) * (e.t - vwap) * e.v)) / list_sum(list_transform(wl, lambda e: e.v))) AS sd",
    "vwap + 2 * sd AS vwap_upper, vwap - 2 * sd AS vwap_lower",
)
rolling(
    "ind_mfi",
    ro.mfi,
    {"mfi": 4},
    f"{TP} AS tp",
    f"{lag('tp')} AS pt",
    "CASE WHEN tp > pt THEN tp * volume WHEN pt IS NOT NULL THEN 0 END AS up, CASE WHEN tp < pt THEN tp * volume WHEN pt IS NOT NULL THEN 0 END AS dn",
    f"{roll('sum', 'up', 14)} AS su, {roll('sum', 'dn', 14)} AS sd",
    "CASE WHEN sd IS NULL THEN NULL WHEN sd = 0 THEN 100 ELSE 100 - 100 / (1 + su / sd) END AS mfi",
)


def _mid(n: int) -> str:
    return f"({roll('max', 'high', n)} + {roll('min', 'low', n)}) / 2"


ICHI = f"{_mid(9)} AS tenkan, {_mid(26)} AS kijun, {_mid(52)} AS span_b, lead(close, 26) OVER {W} AS chikou"
rolling("ind_ichimoku", ro.ichimoku, {c: P for c in ("tenkan", "kijun", "span_a", "span_b", "chikou")}, ICHI, "(tenkan + kijun) / 2 AS span_a")
rolling(
    "ind_cci",
    ro.cci,
    {"cci": 4},
    f"{TP} AS tp",
    f"{roll('avg', 'tp', 20)} AS m, list(tp) OVER {w(20)} AS wl",
    "list_sum(list_transform(wl, lambda x: abs(x - m))) / 20 AS dv",
    "CASE WHEN dv > 0 THEN (tp - m) / (0.015 * dv) END AS cci",
)
rolling("ind_donchian", ro.donchian, {c: P for c in ("donchian_upper", "donchian_lower", "donchian_mid")}, f"{roll('max', 'high', 20)} AS donchian_upper, {roll('min', 'low', 20)} AS donchian_lower", "(donchian_upper + donchian_lower) / 2 AS donchian_mid")
rolling("ind_williams_r", ro.williams_r, {"williams_r": 4}, f"{roll('max', 'high', 14)} AS hi, {roll('min', 'low', 14)} AS lo", "CASE WHEN hi > lo THEN (hi - close) / (hi - lo) * -100 END AS williams_r")
rolling(
    "ind_stoch_rsi",
    ro.stoch_rsi,
    {"stoch_k": 4, "stoch_d": 4},
    *RSI,
    f"{roll('max', 'rsi_cutler', 14)} AS hi, {roll('min', 'rsi_cutler', 14)} AS lw",
    "CASE WHEN hi IS NULL THEN NULL WHEN hi = lw THEN 0 ELSE (rsi_cutler - lw) / (hi - lw) * 100 END AS sr",
    f"{roll('avg', 'sr', 3)} AS stoch_k",
    f"{roll('avg', 'stoch_k', 3)} AS stoch_d",
)
rolling("ind_cmf", ro.cmf, {"cmf": Q}, f"({MFM}) * volume AS mv", f"{roll('sum', 'volume', 20)} AS sv, {roll('sum', 'mv', 20)} AS sm", "CASE WHEN sv > 0 THEN sm / sv END AS cmf")
rolling(
    "ind_aroon",
    ro.aroon,
    {"aroon_up": 4, "aroon_down": 4},
    AT,
    f"max(ROW(high, bn)) OVER {w(25)} AS t, max(ROW(-low, bn)) OVER {w(25)} AS b",
    "CASE WHEN bn >= 25 THEN (24 - (bn - t[2])) / 24.0 * 100 END AS aroon_up, CASE WHEN bn >= 25 THEN (24 - (bn - b[2])) / 24.0 * 100 END AS aroon_down",
)
rolling(
    "ind_cmo",
    ro.cmo,
    {"cmo": 4},
    _delta,
    "CASE WHEN dl > 0 THEN dl WHEN dl IS NOT NULL THEN 0 END AS u, CASE WHEN dl > 0 THEN 0 WHEN dl IS NOT NULL THEN -dl END AS dn",
    f"{roll('sum', 'u', 14)} AS su, {roll('sum', 'dn', 14)} AS sd",
    "CASE WHEN su IS NULL THEN NULL WHEN su + sd > 0 THEN (su - sd) / (su + sd) * 100 ELSE 0 END AS cmo",
)
PIVOT = [f"{lag('high')} AS ph, {lag('low')} AS pl, {lag('close')} AS pc", "(ph + pl + pc) / 3 AS pp", "2 * pp - pl AS pivot_r1, 2 * pp - ph AS pivot_s1, pp + (ph - pl) AS pivot_r2, pp - (ph - pl) AS pivot_s2, pp AS pivot_pp"]
rolling("ind_pivot", ro.pivot_points, {c: P for c in ("pivot_pp", "pivot_r1", "pivot_s1", "pivot_r2", "pivot_s2")}, *PIVOT)
ALLI = ["(high + low) / 2 AS hl", ", ".join(f"{roll('avg', 'hl', n)} AS a{n}" for n in (13, 8, 5)), ", ".join(f"{lag(f'a{n}', s)} AS {x}" for n, s, x in ((13, 8, "jaw"), (8, 5, "teeth"), (5, 3, "lips")))]
rolling("ind_alligator", ro.alligator, {"jaw": P, "teeth": P, "lips": P}, *ALLI)
rolling("ind_awesome", ro.awesome, {"ao": P}, "(high + low) / 2 AS hl", f"{roll('avg', 'hl', 5)} - {roll('avg', 'hl', 34)} AS ao")
rolling("ind_hull", ro.hull, {"hull": P}, f"2 * {wma('close', 4)} - {wma('close', 9)} AS x", f"{wma('x', 3)} AS hull")
rolling("ind_ad_line", ro.accumulation, {"ad": P}, f"({MFM}) * volume AS mv", f"sum(mv) OVER {_cum} AS ad")


def _roc(n: int) -> str:
    return f"CASE WHEN {lag('close', n)} <> 0 THEN (close - {lag('close', n)}) / {lag('close', n)} * 100 END"


rolling("ind_roc", lambda b: ro.coppock(ro.roc(b)), {"roc": 4, "coppock": 4}, f"{_roc(12)} AS roc, {_roc(14)} + {_roc(11)} AS x", f"{wma('x', 10)} AS coppock")


def swing_sql(n: int, hi: str, lo: str) -> str:
    bf = f"(PARTITION BY code ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    af = f"(PARTITION BY code ORDER BY day ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"
    ok = f"count(*) OVER {bf} = {n} AND count(*) OVER {af} = {n}"
    return (
        f"CASE WHEN {ok} AND high > max(high) OVER {bf} AND high > max(high) OVER {af} THEN high END AS {hi},"
        f"CASE WHEN {ok} AND low < min(low) OVER {bf} AND low < min(low) OVER {af} THEN low END AS {lo}"
    )


rolling("ind_fractals", ro.fractals, {"fractal_high": P, "fractal_low": P}, swing_sql(2, "fractal_high", "fractal_low"))
rolling("ind_swings", lambda b: ro.swing_points(b, 50, "swing_high", "swing_low"), {"swing_high": P, "swing_low": P}, swing_sql(50, "swing_high", "swing_low"))
rolling(
    "ind_choppiness",
    ro.choppiness,
    {"chop": 4},
    f"{TR} AS tr, {lag('low', 13)} AS l13",
    f"{roll('sum', 'tr', 14)} AS st, {roll('max', 'high', 14)} AS hi, {roll('min', 'low', 14)} AS lo",
    "CASE WHEN high - l13 > 0 AND hi > lo THEN 100 * ln(st / (hi - lo)) / ln(14) END AS chop",
)
rolling(
    "ind_ulcer",
    ro.ulcer,
    {"ulcer": 4},
    f"{roll('max', 'close', 14)} AS m, list(close) OVER {w(14)} AS wl",
    "CASE WHEN m IS NOT NULL THEN sqrt(list_sum(list_transform(wl, lambda x: ((x - m) / m * 100) * ((x - m) / m * 100))) / 14) END AS ulcer",
)
rolling("ind_amplitude", ro.amplitude, {f"amplitude{n}": 4 for n in (5, 10, 20)}, "CASE WHEN open > 0 THEN (high - low) / open * 100 END AS a", ", ".join(f"{roll('avg', 'a', n)} AS amplitude{n}" for n in (5, 10, 20)))


@query(
    "ind_ma_map",
    ctes(BARS, "m AS (SELECT code, day, " + ", ".join(f"{roll('avg', 'close', p)} AS m{p}" for p in (5, 10, 20, 30, 60)) + " FROM bars)")
    + " UNION ALL ".join(f"SELECT code, {d()} AS day, CAST({p} AS INTEGER) AS period, {r(f'm{p}', 2)} AS ma FROM m WHERE m{p} IS NOT NULL" for p in (5, 10, 20, 30, 60)),
)
def ind_ma_map(spark, sf):
    m = ro.ma_map(views.bars(spark, sf)).select("code", day_text("day").alias("day"), F.explode("ma").alias("period", "ma"))
    return m.select("code", "day", "period", "ma")


# --- recurrences -----------------------------------------------------------------------------
_GL = f"CASE WHEN close - {lag('close')} > 0 THEN close - {lag('close')} WHEN {lag('close')} IS NOT NULL THEN 0 END AS gain, CASE WHEN close - {lag('close')} < 0 THEN {lag('close')} - close WHEN {lag('close')} IS NOT NULL THEN 0 END AS loss"


def _rsi_fields(p: int) -> list:
    return [
        *f_rma(f"g{p}", "b.gain", p),
        *f_rma(f"l{p}", "b.loss", p),
        (f"rsi{p}_wilder", "NULL", f"CASE WHEN l{p} IS NULL THEN NULL WHEN g{p} = 0 AND l{p} = 0 THEN 50 WHEN l{p} = 0 THEN 100 ELSE 100 - 100 / (1 + g{p} / l{p}) END"),
    ]


recurrent("ind_rsi_wilder", ["rsi6", "rsi12", "rsi14"], {f"rsi{p}_wilder": 4 for p in (6, 12, 14)}, _GL, [f for p in (6, 12, 14) for f in _rsi_fields(p)])


def _x0(n: str, x: str, p: int, start: str = "NULL") -> tuple[str, str, str]:
    k = repr(2.0 / (p + 1))
    return (n, start, f"CASE WHEN p_{n} IS NULL THEN ({x}) ELSE ({x}) * {k} + p_{n} * (1 - {k}) END")


MACD0 = [_x0("e12", "b.close", 12), _x0("e26", "b.close", 26), ("dif", "NULL", "e12 - e26"), _x0("dea", "dif", 9, "0"), ("macd_x0", "NULL", "CASE WHEN b.bn >= 26 THEN 2 * (dif - dea) END")]
recurrent("ind_macd_x0", ["macd_x0"], {"macd_x0": P}, "close", MACD0)
_RSV = f"CASE WHEN {roll('max', 'high', 9)} = {roll('min', 'low', 9)} THEN 50 ELSE (close - {roll('min', 'low', 9)}) / ({roll('max', 'high', 9)} - {roll('min', 'low', 9)}) * 100 END AS rsv"
KDJ = [
    ("pk", "50", "CASE WHEN b.rsv IS NULL THEN p_pk ELSE (2 * p_pk + b.rsv) / 3 END"),
    ("pd", "50", "CASE WHEN b.rsv IS NULL THEN p_pd ELSE (2 * p_pd + pk) / 3 END"),
    ("kdj_k", "NULL", "CASE WHEN b.rsv IS NOT NULL THEN pk END"),
    ("kdj_d", "NULL", "CASE WHEN b.rsv IS NOT NULL THEN pd END"),
    ("kdj_j", "NULL", "CASE WHEN b.rsv IS NOT NULL THEN 3 * pk - 2 * pd END"),
]
recurrent("ind_kdj", ["kdj"], {"kdj_k": 4, "kdj_d": 4, "kdj_j": 4}, _RSV, KDJ)
recurrent("ind_ema", ["ema"], {"ema12": P, "ema21": P}, "close", [*f_ema("ema12", "b.close", 12), *f_ema("ema21", "b.close", 21)])
MACD = [*f_ema("m12", "b.close", 12), *f_ema("m26", "b.close", 26), ("macd_dif", "NULL", "m12 - m26"), *f_ema("macd_dea", "macd_dif", 9, True), ("macd_hist", "NULL", "2 * (macd_dif - macd_dea)")]
recurrent("ind_macd_sma", ["macd_sma"], {"macd_dif": P, "macd_dea": P, "macd_hist": P}, "close", MACD)
recurrent("ind_atr_wilder", ["atr_wilder"], {"atr_wilder": P}, f"{TR} AS tr", f_rma("atr_wilder", "b.tr", 14))
_ER = f"CASE WHEN sum(ad) OVER {w(10)} > 0 THEN abs(close - {lag('close', 10)}) / sum(ad) OVER {w(10)} ELSE 0 END AS er"
_F, _S = 2 / 3, 2 / 31


@query(
    "ind_kama",
    recursive(
        f"SELECT code, day, {AT}, close, {_ER} FROM (SELECT *, abs(close - {lag('close')}) AS ad FROM bars)",
        [("kama", "NULL", f"CASE WHEN b.bn < 11 THEN NULL WHEN b.bn = 11 THEN b.close ELSE p_kama + power(b.er * {_F - _S!r} + {_S!r}, 2) * (b.close - p_kama) END")],
        f"{_outs_sql({'kama': P})} FROM rec WHERE bn > 0",
    ),
)
def ind_kama(spark, sf):
    return shaped(rc.run(views.bars(spark, sf), ["kama"]), {"kama": P})


KELT = [*f_ema("keltner_mid", "b.close", 20), *f_rma("atr10", "b.tr", 10), ("keltner_upper", "NULL", "keltner_mid + 1.5 * atr10"), ("keltner_lower", "NULL", "keltner_mid - 1.5 * atr10")]
recurrent("ind_keltner", ["keltner"], {"keltner_mid": P, "keltner_upper": P, "keltner_lower": P}, f"close, {TR} AS tr", KELT)
SUPER = [
    *f_rma("satr", "b.tr", 10),
    ("ru", "NULL", "(b.high + b.low) / 2 + 3 * satr"),
    ("rl", "NULL", "(b.high + b.low) / 2 - 3 * satr"),
    ("su", "NULL", "CASE WHEN p_su IS NOT NULL AND ru >= p_su AND p_sc <= p_su THEN p_su ELSE ru END"),
    ("sl", "NULL", "CASE WHEN p_sl IS NOT NULL AND rl <= p_sl AND p_sc >= p_sl THEN p_sl ELSE rl END"),
    ("sc", "NULL", "b.close"),
    ("supertrend_dir", "0", "CASE WHEN satr IS NULL THEN 0 WHEN p_supertrend_dir = 0 THEN 1 WHEN p_supertrend_dir = 1 THEN CASE WHEN b.close < sl THEN -1 ELSE 1 END ELSE CASE WHEN b.close > su THEN 1 ELSE -1 END END"),
    ("supertrend", "NULL", "CASE WHEN satr IS NOT NULL THEN CASE WHEN supertrend_dir = 1 THEN sl ELSE su END END"),
]
recurrent("ind_supertrend", ["supertrend"], {"supertrend": P, "supertrend_dir": 0}, f"high, low, close, {TR} AS tr", SUPER)
SAR = [
    ("g", "NULL", "CASE WHEN p_lg = 1 THEN least(p_sar + p_af * (p_ep - p_sar), b.l1, b.l2) ELSE greatest(p_sar + p_af * (p_ep - p_sar), b.h1, b.h2) END"),
    ("brk", "0", "CASE WHEN b.bn > 2 AND ((p_lg = 1 AND b.low < g) OR (p_lg = 0 AND b.high > g)) THEN 1 ELSE 0 END"),
    ("lg", "NULL", "CASE WHEN b.bn = 1 THEN NULL WHEN b.bn = 2 THEN CASE WHEN b.close > b.c1 THEN 1 ELSE 0 END WHEN brk = 1 THEN 1 - p_lg ELSE p_lg END"),
    ("af", "0.02", "CASE WHEN b.bn <= 2 OR brk = 1 THEN 0.02 WHEN (p_lg = 1 AND b.high > p_ep) OR (p_lg = 0 AND b.low < p_ep) THEN least(p_af + 0.02, 0.2) ELSE p_af END"),
    ("ep", "NULL", "CASE WHEN b.bn = 1 THEN NULL WHEN b.bn = 2 THEN CASE WHEN lg = 1 THEN b.high ELSE b.low END WHEN brk = 1 THEN CASE WHEN p_lg = 1 THEN b.low ELSE b.high END WHEN p_lg = 1 THEN greatest(b.high, p_ep) ELSE least(b.low, p_ep) END"),
    ("sar", "NULL", "CASE WHEN b.bn = 1 THEN NULL WHEN b.bn = 2 THEN CASE WHEN lg = 1 THEN b.l1 ELSE b.h1 END WHEN brk = 1 THEN p_ep ELSE g END"),
    ("sar_dir", "0", "CASE WHEN lg IS NULL THEN 0 ELSE 2 * lg - 1 END"),
]
recurrent("ind_sar", ["sar"], {"sar": P, "sar_dir": 0}, f"high, low, close, {lag('low')} AS l1, {lag('low', 2)} AS l2, {lag('high')} AS h1, {lag('high', 2)} AS h2, {lag('close')} AS c1", SAR)
_UP, _DN = f"(high - {lag('high')})", f"({lag('low')} - low)"
ADX = [
    *f_sum("tr14", "b.tr", 14),
    *f_sum("pd14", "b.pdm", 14),
    *f_sum("md14", "b.mdm", 14),
    ("di_plus", "NULL", "CASE WHEN tr14 > 0 THEN 100 * pd14 / tr14 END"),
    ("di_minus", "NULL", "CASE WHEN tr14 > 0 THEN 100 * md14 / tr14 END"),
    ("dx", "NULL", "CASE WHEN b.bn >= 14 THEN coalesce(CASE WHEN di_plus + di_minus > 0 THEN 100 * abs(di_plus - di_minus) / (di_plus + di_minus) ELSE 0 END, 0) END"),
    *f_rma("adx", "dx", 14),
]
recurrent(
    "ind_adx",
    ["adx"],
    {"di_plus": 4, "di_minus": 4, "adx": 4},
    f"{TR} AS tr, CASE WHEN {_UP} > {_DN} AND {_UP} > 0 THEN {_UP} ELSE 0 END AS pdm, CASE WHEN {_DN} > {_UP} AND {_DN} > 0 THEN {_DN} ELSE 0 END AS mdm",
    ADX,
)
recurrent("ind_force_index", ["force"], {"force_index": 2}, f"coalesce((close - {lag('close')}) * volume, 0) AS fr", f_ema("force_index", "b.fr", 13))
recurrent("ind_dema", ["dema"], {"dema": P}, "close", [*f_ema("d1", "b.close", 21), *f_ema("d2", "d1", 21), ("dema", "NULL", "2 * d1 - d2")])
recurrent("ind_dema_biased", ["dema_biased"], {"dema_biased": P}, "close", [*f_ema("d1", "b.close", 21), ("d1z", "0", "coalesce(d1, 0)"), *f_ema("d2", "d1z", 21), ("dema_biased", "NULL", "2 * d1 - d2")])


def _triple(p: int) -> list:
    return [*f_ema("t1", "b.close", p), *f_ema("t2", "t1", p), *f_ema("t3", "t2", p)]


recurrent("ind_tema", ["tema"], {"tema": P}, "close", [*_triple(21), ("tema", "NULL", "3 * t1 - 3 * t2 + t3")])
recurrent(
    "ind_trix",
    ["trix"],
    {"trix": 4, "trix_slope": 4, "trix_signal": 4},
    "close",
    [*_triple(15), ("trix", "NULL", "CASE WHEN p_t3 <> 0 THEN (t3 - p_t3) / p_t3 * 10000 END"), ("trix_slope", "NULL", "trix - p_trix"), *f_ema("trix_signal", "trix", 9, True)],
)
recurrent("ind_elder_ray", ["elder"], {"bull_power": P, "bear_power": P}, "high, low, close", [*f_ema("e", "b.close", 13), ("bull_power", "NULL", "b.high - e"), ("bear_power", "NULL", "b.low - e")])
recurrent("ind_chaikin", ["chaikin"], {"chaikin": P}, f"sum(({MFM}) * volume) OVER {_cum} AS ad", [*f_ema("c3", "b.ad", 3), *f_ema("c10", "b.ad", 10), ("chaikin", "NULL", "c3 - c10")])
_mass = [*f_ema("r1", "b.rg", 9), *f_ema("r2", "r1", 9), ("rr", "NULL", "CASE WHEN r2 <> 0 THEN r1 / r2 END"), *f_ema("mass_ratio", "rr", 9)]


@query(
    "ind_mass_index",
    recursive(f"SELECT code, day, {AT}, high - low AS rg FROM bars", _mass, f"{_outs_sql({'mass_index': 4})} FROM m", final=f"m AS (SELECT code, day, {roll('sum', 'mass_ratio', 25)} AS mass_index FROM rec WHERE bn > 0)"),
)
def ind_mass_index(spark, sf):
    return shaped(rc.mass_index(views.bars(spark, sf)), {"mass_index": 4})


_h14, _l14 = roll("max", "high", 14), roll("min", "low", 14)
recurrent("ind_smi", ["smi"], {"smi": 4, "smi_signal": 4}, f"CASE WHEN {_h14} <> {_l14} THEN 200 * ((close - ({_h14} + {_l14}) / 2) / ({_h14} - {_l14})) END AS sm", [*f_ema("smi", "b.sm", 3), *f_ema("smi_signal", "smi", 3)])


@query(
    "ind_ttm_squeeze",
    recursive(
        f"SELECT code, day, {AT}, close, {TP} AS tp, {TR} AS tr, {roll('avg', 'close', 20)} AS m, {roll('stddev_pop', 'close', 20)} AS sd FROM bars",
        [*KELT, *f_ema("et", "b.tp", 20), ("ttm_momentum", "NULL", "b.tp - et"), ("sq", "0", "CASE WHEN b.m - 2 * b.sd >= keltner_lower AND b.m + 2 * b.sd <= keltner_upper THEN 1 ELSE 0 END")],
        f"SELECT code, {d()} AS day, sq = 1 AS squeeze, {r('ttm_momentum', 3)} AS ttm_momentum FROM rec WHERE bn > 0",
    ),
)
def ind_ttm_squeeze(spark, sf):
    return shaped(rc.ttm_squeeze(views.bars(spark, sf)), {"squeeze": None, "ttm_momentum": 3})


# --- path-dependent indicators ----------------------------------------------------------------
_p = rc.SATS
_bar = f"SELECT *, {AT}, close - {lag('close')} AS dl FROM s0"
SATS_SQL = f"""
WITH RECURSIVE {BARS},
b0 AS MATERIALIZED (SELECT code, day, {AT}, {TR} AS tr FROM bars),
rec0 AS (
  SELECT DISTINCT code, CAST(NULL AS DATE) AS day, CAST(0 AS BIGINT) AS bn, 0::DOUBLE AS a_c, 0::DOUBLE AS a_s, NULL::DOUBLE AS a FROM b0
  UNION ALL
  SELECT b.code, b.day, b.bn, a_c + 1, a_s + tr, CASE WHEN a IS NOT NULL THEN (a * 13 + tr) / 14 WHEN a_c + 1 = 14 THEN (a_s + tr) / 14 END
  FROM rec0 r JOIN b0 b ON b.code = r.code AND b.bn = r.bn + 1),
s0 AS MATERIALIZED (SELECT bars.*, rec0.a AS ratr, coalesce(rec0.a, 0) AS a0 FROM bars JOIN rec0 USING (code, day)),
s1 AS ({_bar}),
s2 AS (SELECT *, {roll('sum', 'abs(dl)', 20)} AS path, abs(close - {lag('close', 20)}) AS chg, {roll('avg', 'volume', 20)} AS vm, {roll('stddev_pop', 'volume', 20)} AS vs,
  {roll('avg', 'a0', 100)} AS ab, {roll('max', 'high', 20)} AS hi, {roll('min', 'low', 20)} AS lo, close - {lag('close', 10)} AS trn,
  {roll('sum', 'CASE WHEN dl > 0 THEN 1 WHEN dl IS NOT NULL THEN 0 END', 10)} AS ups, {roll('sum', 'CASE WHEN dl < 0 THEN 1 WHEN dl IS NOT NULL THEN 0 END', 10)} AS dns FROM s1),
s3 AS (SELECT *, CASE WHEN path <> 0 THEN chg / path ELSE 0 END AS er, ratr IS NOT NULL AND ab IS NOT NULL AS ok,
  CASE WHEN volume > 0 AND bn > 20 THEN greatest(0, least(1, ((CASE WHEN vs <> 0 THEN (volume - vm) / vs ELSE 0 END) + 1) / 3))
       ELSE greatest(0, least(1, ((CASE WHEN ab <> 0 THEN ratr / ab ELSE 1 END) - 0.6) / 1.2)) END AS q,
  CASE WHEN bn > 20 THEN greatest(0, least(1, abs((CASE WHEN hi <> lo THEN (close - lo) / (hi - lo) ELSE 0.5 END) - 0.5) * 2)) ELSE 0 END AS st,
  CASE WHEN trn > 0 THEN ups WHEN trn < 0 THEN dns ELSE 0 END / 10.0 AS mo FROM s2),
s4 AS (SELECT *, CASE WHEN ok THEN greatest(0, least(1, er * 0.35 + q * 0.20 + st * 0.25 + mo * 0.20)) ELSE 0 END AS tqi FROM s3),
s5 AS (SELECT *, 2.0 * (1 + 0.5 * (0.5 - er)) * (0.6 + 0.4 * (0.6 + 0.8 * power(1 - tqi, 1.5))) AS sym, ratr * (0.5 + 0.5 * er) AS ea FROM s4),
b AS MATERIALIZED (SELECT code, day, bn, high, low, close, ok, tqi, sym * (1 - 0.5 * tqi * 0.3) AS am, sym * (1 + 0.5 * tqi * 0.4) AS pm, ea FROM s5),
rec AS (
  SELECT DISTINCT code, CAST(NULL AS DATE) AS day, CAST(0 AS BIGINT) AS bn, NULL::DOUBLE AS sa, NULL::DOUBLE AS sp, NULL::DOUBLE AS bl, NULL::DOUBLE AS bu,
         NULL::DOUBLE AS bc, 0::DOUBLE AS pq, 0 AS dir, 0::BIGINT AS start, 0::DOUBLE AS sats_quality FROM b
  UNION ALL
  SELECT code, day, bn, sa2, sp2, CASE WHEN ok THEN nl ELSE p_bl END, CASE WHEN ok THEN nu ELSE p_bu END, close, tqi, CASE WHEN ok THEN d2 ELSE 0 END,
         CASE WHEN ok AND d2 <> held THEN bn - 1 ELSE p_start END, tqi
  FROM (SELECT *, CASE WHEN p_dir = 0 THEN 1 WHEN coalesce((p_dir = -1 AND close > p_bu) OR (faded AND held = -1 AND close > p_bc), false) THEN 1
                       WHEN coalesce((p_dir = 1 AND close < p_bl) OR (faded AND held = 1 AND close < p_bc), false) THEN -1 ELSE held END AS d2
    FROM (SELECT *, pq > 0.55 AND tqi < 0.25 AND bn - 1 - p_start >= 5 AS faded,
        CASE WHEN p_bl IS NOT NULL AND p_bc > p_bl THEN greatest((high + low) / 2 - (CASE WHEN held = 1 THEN sa2 ELSE sp2 END) * ea, p_bl) ELSE (high + low) / 2 - (CASE WHEN held = 1 THEN sa2 ELSE sp2 END) * ea END AS nl,
        CASE WHEN p_bu IS NOT NULL AND p_bc < p_bu THEN least((high + low) / 2 + (CASE WHEN held = 1 THEN sp2 ELSE sa2 END) * ea, p_bu) ELSE (high + low) / 2 + (CASE WHEN held = 1 THEN sp2 ELSE sa2 END) * ea END AS nu
      FROM (SELECT b.*, r.bl AS p_bl, r.bu AS p_bu, r.bc AS p_bc, r.pq, r.dir AS p_dir, r.start AS p_start, CASE WHEN r.dir = 0 THEN 1 ELSE r.dir END AS held,
          CASE WHEN NOT ok THEN r.sa WHEN r.sa IS NULL THEN am ELSE r.sa * 0.85 + am * 0.15 END AS sa2,
          CASE WHEN NOT ok THEN r.sp WHEN r.sp IS NULL THEN pm ELSE r.sp * 0.85 + pm * 0.15 END AS sp2
        FROM rec r JOIN b ON b.code = r.code AND b.bn = r.bn + 1))))
SELECT code, {d()} AS day, CAST(dir AS DOUBLE) AS sats_dir, CASE WHEN dir <> 0 THEN {r('CASE WHEN dir = 1 THEN bl ELSE bu END', 3)} END AS sats_line, {r('sats_quality', 6)} AS sats_quality FROM rec WHERE bn > 0
"""


@query("ind_sats", SATS_SQL)
def ind_sats(spark, sf):
    return shaped(rc.sats(views.bars(spark, sf)), {"sats_dir": 0, "sats_line": P, "sats_quality": Q})


ZIGZAG = [
    ("side", "1", "CASE WHEN b.bn = 1 THEN 1 WHEN NOT (CASE WHEN p_side = 1 THEN b.high >= p_lvl ELSE b.low <= p_lvl END) AND (CASE WHEN p_side = 1 THEN p_lvl - b.low ELSE b.high - p_lvl END) >= p_lvl * 5 / 100 THEN -p_side ELSE p_side END"),
    ("mark", "1", "CASE WHEN b.bn = 1 THEN 1 WHEN (CASE WHEN p_side = 1 THEN b.high >= p_lvl ELSE b.low <= p_lvl END) THEN p_side WHEN side <> p_side THEN p_side ELSE p_mark END"),
    ("lvl", "NULL", "CASE WHEN b.bn = 1 THEN b.high WHEN side <> p_side THEN CASE WHEN p_side = 1 THEN b.low ELSE b.high END WHEN p_side = 1 THEN greatest(b.high, p_lvl) ELSE least(b.low, p_lvl) END"),
    ("zigzag_known", "0", "CASE WHEN b.bn >= 3 THEN mark ELSE 0 END"),
]
recurrent("ind_zigzag_known", ["zigzag"], {"zigzag_known": 0}, "high, low", ZIGZAG)


_EXT = "(CASE WHEN p_side = 1 THEN b.high >= p_lvl ELSE b.low <= p_lvl END)"
# a turn opens a new slot that first repeats the pivot before it; the last content of a slot is a pivot
_SLOTS = [
    ("ext_at", "1", f"CASE WHEN b.bn = 1 THEN 1 WHEN {_EXT} OR side <> p_side THEN b.bn ELSE p_ext_at END"),
    ("slot", "0", "CASE WHEN side <> p_side THEN p_slot + 1 ELSE p_slot END"),
    ("pi", "1", f"CASE WHEN b.bn = 1 THEN 1 WHEN {_EXT} THEN b.bn WHEN side <> p_side THEN p_ext_at ELSE p_pi END"),
    ("pv", "NULL", f"CASE WHEN b.bn = 1 THEN b.high WHEN {_EXT} THEN CASE WHEN p_side = 1 THEN b.high ELSE b.low END WHEN side <> p_side THEN p_lvl ELSE p_pv END"),
]
_PIVOTS = """pl AS (SELECT code, slot, pi, pv, mark, row_number() OVER (PARTITION BY code, slot ORDER BY bn DESC) AS rn FROM rec WHERE bn > 0),
pz AS (SELECT code, pi, arg_max(pv, slot) AS v, arg_max(mark, slot) AS d FROM pl WHERE rn = 1 GROUP BY code, pi), pn AS (SELECT code, max(bn) AS n FROM rec GROUP BY code)"""


@query(
    "ind_zigzag",
    recursive(
        f"SELECT code, day, {AT}, high, low FROM bars",
        [*ZIGZAG[:3], *_SLOTS],
        f"SELECT rec.code, {d('rec.day')} AS day, {r('CASE WHEN n >= 3 THEN v END', P)} AS zigzag, {r('CASE WHEN n >= 3 THEN coalesce(pz.d, 0) ELSE 0 END', 0)} AS zigzag_dir FROM rec JOIN pn ON pn.code = rec.code LEFT JOIN pz ON pz.code = rec.code AND pz.pi = rec.bn WHERE bn > 0",
        final=_PIVOTS,
    ),
)
def ind_zigzag(spark, sf):
    return shaped(rc.zigzag(views.bars(spark, sf)), {"zigzag": P, "zigzag_dir": 0})


_TURNS = """tn AS (SELECT code, day, bn, side, lag(side) OVER (PARTITION BY code ORDER BY bn) AS s0, lag(lvl) OVER (PARTITION BY code ORDER BY bn) AS price, lag(ext_at) OVER (PARTITION BY code ORDER BY bn) AS at_bar, count(*) OVER (PARTITION BY code) AS n FROM rec WHERE bn > 0),
pv AS MATERIALIZED (SELECT code, day, at_bar, price, s0 AS pside, row_number() OVER (PARTITION BY code ORDER BY bn) AS k FROM tn WHERE s0 IS NOT NULL AND side <> s0 AND n >= 3),
lg AS (SELECT *, lag(price) OVER (PARTITION BY code ORDER BY k) AS b1, lag(price, 3) OVER (PARTITION BY code ORDER BY k) AS b3, lag(price, 5) OVER (PARTITION BY code ORDER BY k) AS b5 FROM pv)"""


def _turn_sql(select: str) -> str:
    return recursive(f"SELECT code, day, {AT}, high, low FROM bars", [*ZIGZAG[:3], *_SLOTS], select, final=_TURNS)


@query("confirmed_pivots", _turn_sql(f"SELECT code, {d()} AS day, CAST(at_bar - 1 AS BIGINT) AS pivot_at, {r('price', P)} AS price, CAST(pside AS INTEGER) AS side FROM pv"))
def confirmed_pivots(spark, sf):
    p = rc.pivots(views.bars(spark, sf))
    return p.select("code", day_text("day").alias("day"), "pivot_at", rnd("pivot_price", P).alias("price"), F.col("pivot_side").alias("side"))


@query("fibonacci_levels", _turn_sql(f"SELECT code, {d()} AS day, v AS level, {r('b1 + (price - b1) * v', 3)} AS price FROM lg, (VALUES (0::DOUBLE), (0.236::DOUBLE), (0.382::DOUBLE), (0.5::DOUBLE), (0.618::DOUBLE), (0.786::DOUBLE), (1::DOUBLE)) x(v) WHERE b1 IS NOT NULL"))
def fibonacci_levels(spark, sf):
    x = wv.retracements(rc.pivots(views.bars(spark, sf)))
    return x.select("code", day_text("day").alias("day"), "level", rnd("price", 3).alias("price"))


_NODES = "(VALUES (0, 0::DOUBLE), (1, 1::DOUBLE), (2, 0.382::DOUBLE), (3, 2::DOUBLE), (4, 1.382::DOUBLE), (5, 2.382::DOUBLE)) x(node, v)"


@query(
    "wave_targets",
    _turn_sql(
        f"SELECT code, {d()} AS day, 'impulse5' AS mode, node, {r('b5 + (price - b5) / 2.382::DOUBLE * v', 3)} AS price, false AS predicted FROM lg, {_NODES} WHERE b5 IS NOT NULL "
        f"UNION ALL SELECT code, {d()}, 'predict3', node, {r('b3 + (price - b3) / 2.0::DOUBLE * v', 3)}, node > 3 FROM lg, {_NODES} WHERE b3 IS NOT NULL"
    ),
)
def wave_targets(spark, sf):
    x = wv.waves(rc.pivots(views.bars(spark, sf)))
    return x.select("code", day_text("day").alias("day"), "mode", "node", rnd("price", 3).alias("price"), "predicted")


def breaks_sql(n: int) -> str:
    return f"""
WITH RECURSIVE {BARS},
b AS MATERIALIZED (SELECT code, day, {AT}, {swing_sql(n, 'sh', 'sl')} FROM bars),
rec AS (
  SELECT DISTINCT code, CAST(NULL AS DATE) AS day, CAST(0 AS BIGINT) AS bn, NULL::BIGINT AS hi_i, NULL::DOUBLE AS hi_v, NULL::BIGINT AS lo_i, NULL::DOUBLE AS lo_v, 0 AS trend,
         0 AS uk, NULL::BIGINT AS uf, NULL::DOUBLE AS ufp, NULL::DOUBLE AS utp, 0 AS dk, NULL::BIGINT AS df, NULL::DOUBLE AS dfp, NULL::DOUBLE AS dtp FROM b
  UNION ALL
  SELECT code, day, bn, coalesce(CASE WHEN sh IS NOT NULL THEN bn END, hi_i), coalesce(sh, hi_v), coalesce(CASE WHEN sl IS NOT NULL THEN bn END, lo_i), coalesce(sl, lo_v),
         CASE WHEN db THEN -1 ELSE t1 END, CASE WHEN ub AND trend = -1 THEN 2 WHEN ub AND trend = 1 THEN 1 ELSE 0 END, hi_i, hi_v, sh,
         CASE WHEN db AND t1 = 1 THEN 2 WHEN db AND t1 = -1 THEN 1 ELSE 0 END, lo_i, lo_v, sl
  FROM (SELECT *, CASE WHEN ub THEN 1 ELSE trend END AS t1 FROM (
    SELECT b.*, r.hi_i, r.hi_v, r.lo_i, r.lo_v, r.trend, coalesce(r.hi_i IS NOT NULL AND b.sh > r.hi_v, false) AS ub, coalesce(r.lo_i IS NOT NULL AND b.sl < r.lo_v, false) AS db
    FROM rec r JOIN b ON b.code = r.code AND b.bn = r.bn + 1)))
SELECT code, {d()} AS day, bn AS to_idx, uf AS from_idx, {r('ufp', 3)} AS from_price, {r('utp', 3)} AS to_price, CASE uk WHEN 2 THEN 'choch' ELSE 'bos' END AS kind, true AS bull FROM rec WHERE uk > 0
UNION ALL
SELECT code, {d()} AS day, bn, df, {r('dfp', 3)}, {r('dtp', 3)}, CASE dk WHEN 2 THEN 'choch' ELSE 'bos' END, false FROM rec WHERE dk > 0
"""


@query("ind_structure_breaks", breaks_sql(5))
def ind_structure_breaks(spark, sf):
    b = rc.structure_breaks(views.bars(spark, sf))
    return b.select("code", day_text("day").alias("day"), "to_idx", "from_idx", rnd("from_price", P).alias("from_price"), rnd("to_price", P).alias("to_price"), "kind", "bull")


@query("ind_swing_breaks", f"SELECT * FROM (SELECT 5 AS size, * FROM ({breaks_sql(5)})) UNION ALL SELECT 50, * FROM ({breaks_sql(50)})")
def ind_swing_breaks(spark, sf):
    b = rc.structure_lines(views.bars(spark, sf))
    return b.select("code", day_text("day").alias("day"), "size", "to_idx", "from_idx", rnd("from_price", P).alias("from_price"), rnd("to_price", P).alias("to_price"), "kind", "bull")


_I = f"i AS MATERIALIZED (SELECT *, {AT} FROM bars)"


@query(
    "ind_fair_value_gaps",
    ctes(
        BARS,
        _I,
        f"g AS (SELECT code, bn, day, high, low, lag(high, 2) OVER {W} AS h2, lag(low, 2) OVER {W} AS l2 FROM i)",
        """z AS (SELECT code, bn AS end_idx, day, low AS top, h2 AS bottom, true AS bull FROM g WHERE low > h2
             UNION ALL SELECT code, bn, day, l2, high, false FROM g WHERE high < l2)""",
    )
    + f"""SELECT z.code, {d('z.day')} AS day, z.end_idx, {r('any_value(z.top)', 3)} AS top, {r('any_value(z.bottom)', 3)} AS bottom, z.bull,
       min(i.bn) AS mitigated_idx FROM z LEFT JOIN i ON i.code = z.code AND i.bn > z.end_idx
         AND ((z.bull AND i.low <= z.bottom) OR (NOT z.bull AND i.high >= z.top)) GROUP BY z.code, z.day, z.end_idx, z.bull""",
)
def ind_fair_value_gaps(spark, sf):
    z = rc.zones(ro.fair_value_gaps(by_instrument(views.bars(spark, sf))))
    return z.select("code", day_text("day").alias("day"), F.col("idx").alias("end_idx"), rnd("top", P).alias("top"), rnd("bottom", P).alias("bottom"), "bull", "mitigated_idx")


@query(
    "ind_order_blocks",
    recursive(
        f"SELECT code, day, {AT}, {TR} AS tr FROM bars",
        f_rma("atr", "b.tr", 14),
        f"""SELECT z.code, z.idx, {r('any_value(z.top)', 3)} AS top, {r('any_value(z.bottom)', 3)} AS bottom, z.bull, min(i.bn) AS mitigated_idx
            FROM z LEFT JOIN i ON i.code = z.code AND i.bn >= z.idx + 2 AND ((z.bull AND i.low <= z.bottom) OR (NOT z.bull AND i.high >= z.top))
            GROUP BY z.code, z.idx, z.bull""",
        final=f"""{_I},
 p AS (SELECT i.*, coalesce(rec.atr, 0) AS atr, lag(open) OVER w1 AS po, lag(high) OVER w1 AS ph, lag(low) OVER w1 AS pl, lag(close) OVER w1 AS pc
       FROM i JOIN rec USING (code, bn) WINDOW w1 AS (PARTITION BY i.code ORDER BY i.day)),
 z0 AS (SELECT code, bn - 1 AS idx, greatest(po, pc) AS top, pl AS bottom, true AS bull, atr FROM p WHERE close > ph AND pc < po
        UNION ALL SELECT code, bn - 1, ph, least(po, pc), false, atr FROM p WHERE close < pl AND pc > po),
 z AS (SELECT * FROM z0 WHERE top - bottom <= 3 * atr OR atr = 0)""",
    ),
)
def ind_order_blocks(spark, sf):
    z = rc.zones(ro.order_blocks(rc.run(views.bars(spark, sf), ["atr_wilder"], carry=("open", "high", "low", "close"))))
    return z.select("code", "idx", rnd("top", P).alias("top"), rnd("bottom", P).alias("bottom"), "bull", "mitigated_idx")
