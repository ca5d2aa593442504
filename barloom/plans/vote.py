"""Query: the indicator vote on every bar."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.dates import day_text
from barloom.indicators import vote
from barloom.plans import indicators as qi
from barloom.plans.registry import query
from barloom.plans.sqlkit import AT, BARS, MFM, TR, W, d, f_ema, f_rma, lag, r, recursive, roll
from barloom.sources import views

_FIELDS = [
    *f_ema("ema12", "b.close", 12),
    *f_ema("ema21", "b.close", 21),
    *f_ema("d1", "b.close", 21),
    ("d1z", "0", "coalesce(d1, 0)"),
    *f_ema("d2", "d1z", 21),
    ("dema_biased", "NULL", "2 * d1 - d2"),
    *qi._triple(21),
    ("tema", "NULL", "3 * t1 - 3 * t2 + t3"),
    ("kama", "NULL", f"CASE WHEN b.bn < 11 THEN NULL WHEN b.bn = 11 THEN b.close ELSE p_kama + power(b.er * {qi._F - qi._S!r} + {qi._S!r}, 2) * (b.close - p_kama) END"),
    *qi.KELT,
    *qi.SUPER,
    *qi.SAR,
    *qi.ZIGZAG,
    *qi.MACD,
    *qi.KDJ,
    *qi.ADX,
    *[(a.replace("t1", "x1").replace("t2", "x2").replace("t3", "x3"), i, s.replace("t1", "x1").replace("t2", "x2").replace("t3", "x3")) for a, i, s in qi._triple(15)],
    ("trix", "NULL", "CASE WHEN p_x3 <> 0 THEN (x3 - p_x3) / p_x3 * 10000 END"),
    *f_ema("trix_signal", "trix", 9, True),
    *f_ema("smi", "b.sm", 3),
    *f_ema("smi_signal", "smi", 3),
    *f_ema("force_index", "b.fr", 13),
    *f_ema("c3", "b.ad", 3),
    *f_ema("c10", "b.ad", 10),
    ("chaikin", "NULL", "c3 - c10"),
    *f_rma("atr_wilder", "b.tr", 14),
    *qi._mass,
    *f_ema("et", "b.tp", 20),
    ("ttm_momentum", "NULL", "b.tp - et"),
    *f_ema("el", "b.close", 13),
    ("bull_power", "NULL", "b.high - el"),
    ("bear_power", "NULL", "b.low - el"),
]
_INPUTS = f"""SELECT code, day, {AT}, high, low, close, {qi.TP} AS tp, {TR} AS tr, high - low AS rg, {qi._RSV}, coalesce((close - {lag('close')}) * volume, 0) AS fr,
  sum(({MFM}) * volume) OVER {qi._cum} AS ad, {qi._ER},
  {lag('low')} AS l1, {lag('low', 2)} AS l2, {lag('high')} AS h1, {lag('high', 2)} AS h2, {lag('close')} AS c1,
  CASE WHEN {qi._UP} > {qi._DN} AND {qi._UP} > 0 THEN {qi._UP} ELSE 0 END AS pdm, CASE WHEN {qi._DN} > {qi._UP} AND {qi._DN} > 0 THEN {qi._DN} ELSE 0 END AS mdm,
  CASE WHEN {qi._h14} <> {qi._l14} THEN 200 * ((close - ({qi._h14} + {qi._l14}) / 2) / ({qi._h14} - {qi._l14})) END AS sm
  FROM (SELECT *, abs(close - {lag('close')}) AS ad FROM bars)"""


def _stages() -> str:
    """Window columns on top of the recursive ones."""
    ma = ", ".join(f"{roll('avg', 'close', p)} AS ma{p}" for p in (5, 10, 20, 60))
    steps = [
        f"{ma}, {roll('avg', 'close', 20)} AS boll_mid, {roll('stddev_pop', 'close', 20)} AS bsd, {qi.ICHI}, {qi.PIVOT[0]}, {qi.ALLI[0]}, {qi.TP} AS tp, {qi._delta}, ({MFM}) * volume AS mv,"
        f" {roll('max', 'high', 20)} AS donchian_upper, {roll('min', 'low', 20)} AS donchian_lower, {qi._roc(12)} AS roc, {qi._roc(14)} + {qi._roc(11)} AS cx,"
        f" 2 * {qi.wma('close', 4)} - {qi.wma('close', 9)} AS hx, sign(close - {lag('close')}) * volume AS ob, {TR} AS tr, {lag('low', 13)} AS l13, {qi.AT},"
        f" {qi._h14} AS h14, {qi._l14} AS lo14, {roll('max', 'close', 14)} AS um, list(close) OVER {qi.w(14)} AS ul",
        f"boll_mid + 2 * bsd AS boll_upper, boll_mid - 2 * bsd AS boll_lower, (tenkan + kijun) / 2 AS span_a, {qi.PIVOT[1]}, {qi.ALLI[1]}, {qi.VWAP[1]}, {lag('tp')} AS pt, {qi.RSI[1]},"
        f" {roll('sum', 'volume', 20)} AS sv2, {roll('sum', 'mv', 20)} AS sm2, {qi.wma('cx', 10)} AS coppock, {qi.wma('hx', 3)} AS hull, sum(coalesce(ob, volume)) OVER {qi._cum} AS obv_vol0,"
        f" sum(mv) OVER {qi._cum} AS ad, {roll('avg', 'hl', 5)} - {roll('avg', 'hl', 34)} AS ao, CASE WHEN h14 > lo14 THEN (h14 - close) / (h14 - lo14) * -100 END AS williams_r,"
        f" {roll('sum', 'tr', 14)} AS st14, {roll('avg', 'tp', 20)} AS tpm, list(tp) OVER {qi.w(20)} AS tpl, max(ROW(high, bn)) OVER {qi.w(25)} AS at_, max(ROW(-low, bn)) OVER {qi.w(25)} AS ab_,"
        " CASE WHEN dl > 0 THEN dl WHEN dl IS NOT NULL THEN 0 END AS cu, CASE WHEN dl > 0 THEN 0 WHEN dl IS NOT NULL THEN -dl END AS cd",
        f"{qi.PIVOT[2]}, {qi.ALLI[2]}, {qi.VWAP[2]}, {qi.RSI[2]}, CASE WHEN sv2 > 0 THEN sm2 / sv2 END AS cmf,"
        " CASE WHEN um IS NOT NULL THEN sqrt(list_sum(list_transform(ul, lambda x: ((x - um) / um * 100) * ((x - um) / um * 100))) / 14) END AS ulcer,"
        " CASE WHEN high - l13 > 0 AND h14 > lo14 THEN 100 * ln(st14 / (h14 - lo14)) / ln(14) END AS chop,"
        " list_sum(list_transform(tpl, lambda x: abs(x - tpm))) / 20 AS tdv,"
        " CASE WHEN bn >= 25 THEN (24 - (bn - at_[2])) / 24.0 * 100 END AS aroon_up, CASE WHEN bn >= 25 THEN (24 - (bn - ab_[2])) / 24.0 * 100 END AS aroon_down,"
        f" {roll('sum', 'cu', 14)} AS scu, {roll('sum', 'cd', 14)} AS scd,"
        " CASE WHEN tp > pt THEN tp * volume WHEN pt IS NOT NULL THEN 0 END AS mu, CASE WHEN tp < pt THEN tp * volume WHEN pt IS NOT NULL THEN 0 END AS md",
        f"{qi.RSI[3]}, CASE WHEN tdv > 0 THEN (tp - tpm) / (0.015 * tdv) END AS cci, CASE WHEN scu IS NULL THEN NULL WHEN scu + scd > 0 THEN (scu - scd) / (scu + scd) * 100 ELSE 0 END AS cmo,"
        f" {roll('sum', 'mu', 14)} AS smu, {roll('sum', 'md', 14)} AS smd,"
        f" CASE WHEN vwap IS NOT NULL THEN list({{'t': tp, 'v': CASE WHEN volume = 0 THEN 1 ELSE volume END}}) OVER {qi.w(20)} END AS wl",
        f"CASE WHEN smd IS NULL THEN NULL WHEN smd = 0 THEN 100 ELSE 100 - 100 / (1 + smu / smd) END AS mfi, {roll('max', 'rsi_cutler', 14)} AS rhi, {roll('min', 'rsi_cutler', 14)} AS rlo,"
        " sqrt(list_sum(list_transform(wl, lambda e: (e.t - vwap) * (e.t - vwap) * e.v)) / list_sum(list_transform(wl, lambda e: e.v))) AS vsd",
        "vwap + 2 * vsd AS vwap_upper, vwap - 2 * vsd AS vwap_lower, CASE WHEN rhi IS NULL THEN NULL WHEN rhi = rlo THEN 0 ELSE (rsi_cutler - rlo) / (rhi - rlo) * 100 END AS sr",
        f"{roll('avg', 'sr', 3)} AS stoch_k",
        f"{roll('avg', 'stoch_k', 3)} AS stoch_d",
    ]
    out, prev = [], "bars"
    for i, s in enumerate(steps):
        out.append(f"v{i} AS (SELECT *, {s} FROM {prev})")
        prev = f"v{i}"
    return ",\n".join(out)


_LAST = len(_stages().split(" AS (SELECT *, ")) - 2
_REC_COLS = (
    "ema12 ema21 dema_biased tema kama keltner_upper keltner_lower supertrend_dir sar_dir zigzag_known macd_dif macd_dea macd_hist kdj_k kdj_d kdj_j "
    "adx di_plus di_minus trix trix_signal smi smi_signal force_index chaikin atr_wilder mass_ratio ttm_momentum bull_power bear_power"
).split()


# the 44 votes, written for the SQL side alone
_UP_DOWN = "CASE WHEN {n} THEN NULL WHEN {u} THEN 'bullish' WHEN {d} THEN 'bearish' ELSE '{o}' END"


def _v(known: str, up: str, down: str, other: str) -> str:
    missing = f"NOT ({' AND '.join(f'{c} IS NOT NULL' for c in known.split())})"
    return _UP_DOWN.format(n=missing, u=up, d=down, o=other)


_VOTES = [
    """CASE WHEN ma60 IS NULL THEN NULL WHEN ma60 < ma20 AND ma20 < ma10 AND ma10 < ma5 THEN 'bullish'
       WHEN ma60 > ma20 AND ma20 > ma10 AND ma10 > ma5 THEN 'bearish'
       WHEN (ma20 < ma5 AND ma60 > ma10) OR (ma20 > ma5 AND ma60 < ma10) THEN 'oscillating' ELSE 'neutral' END""",
    _v("ema12 ema21", "ema21 < ema12", "ema21 > ema12", "neutral"),
    """CASE WHEN boll_upper IS NULL THEN NULL WHEN boll_upper < close THEN 'bullish' WHEN boll_lower > close THEN 'bearish'
       WHEN boll_mid < close THEN 'oscillating' ELSE 'neutral' END""",
    _v("vwap", "vwap < close", "vwap > close", "neutral"),
    _v("dema_biased", "dema_biased < close", "dema_biased > close", "neutral"),
    _v("tema", "tema < close", "tema > close", "neutral"),
    _v("kama p_kama", "kama < close AND p_kama < kama", "kama > close AND p_kama > kama", "neutral"),
    _v("hull p_hull", "p_hull < hull", "p_hull > hull", "neutral"),
    _v("keltner_upper keltner_lower", "keltner_upper < close", "keltner_lower > close", "oscillating"),
    _v("supertrend_dir", "supertrend_dir > 0", "supertrend_dir < 0", "neutral"),
    """CASE WHEN tenkan IS NULL OR kijun IS NULL OR span_a IS NULL OR span_b IS NULL THEN NULL
       WHEN span_a < close AND span_b < close AND kijun < tenkan THEN 'bullish'
       WHEN span_a > close AND span_b > close AND kijun > tenkan THEN 'bearish'
       WHEN (close BETWEEN span_a AND span_b) OR (close BETWEEN span_b AND span_a) THEN 'oscillating' ELSE 'neutral' END""",
    _v("sar_dir", "sar_dir > 0", "sar_dir < 0", "neutral"),
    _v("donchian_upper", "donchian_upper <= close", "donchian_lower >= close", "oscillating"),
    _v("jaw teeth lips", "jaw < teeth AND teeth < lips", "jaw > teeth AND teeth > lips", "oscillating"),
    _v("zigzag_known", "zigzag_known < 0", "zigzag_known > 0", "neutral"),
    _v("sats_dir", "sats_dir > 0", "sats_dir < 0", "neutral"),
    """CASE WHEN pivot_pp IS NULL THEN NULL WHEN pivot_r1 < close THEN 'bullish' WHEN pivot_s1 > close THEN 'bearish'
       WHEN pivot_pp < close THEN 'oscillating' ELSE 'neutral' END""",
    _v("vwap_upper vwap_lower", "vwap_upper < close", "vwap_lower > close", "oscillating"),
    """CASE WHEN macd_hist IS NULL THEN NULL WHEN macd_dea < macd_dif AND macd_hist > 0 THEN 'bullish'
       WHEN macd_dea > macd_dif AND macd_hist < 0 THEN 'bearish' WHEN sign(macd_dif) * sign(macd_hist) < 0 THEN 'oscillating' ELSE 'neutral' END""",
    """CASE WHEN rsi_cutler IS NULL THEN NULL WHEN rsi_cutler NOT BETWEEN 30 AND 70 THEN 'oscillating' WHEN rsi_cutler > 50 THEN 'bullish' ELSE 'bearish' END""",
    """CASE WHEN kdj_j IS NULL THEN NULL WHEN kdj_d < kdj_k AND kdj_k < kdj_j AND kdj_k < 80 THEN 'bullish'
       WHEN kdj_d > kdj_k AND kdj_k > kdj_j AND kdj_k > 20 THEN 'bearish' WHEN kdj_k > 80 THEN 'bearish' WHEN kdj_k < 20 THEN 'bullish' ELSE 'oscillating' END""",
    _v("cci", "cci > 100", "cci < -100", "oscillating"),
    _v("williams_r", "williams_r < -80", "williams_r > -20", "oscillating"),
    _v("stoch_k stoch_d", "greatest(stoch_k, stoch_d) < 20 AND stoch_d < stoch_k", "least(stoch_k, stoch_d) > 80 AND stoch_d > stoch_k", "oscillating"),
    _v("adx di_plus di_minus", "adx > 25 AND di_minus < di_plus", "adx > 25 AND di_minus > di_plus", "oscillating"),
    _v("aroon_up aroon_down", "aroon_up > 70 AND aroon_down < 30", "aroon_up < 30 AND aroon_down > 70", "oscillating"),
    _v("cmo", "cmo > 50", "cmo < -50", "oscillating"),
    _v("trix trix_signal", "trix_signal < trix", "trix_signal > trix", "neutral"),
    _v("roc", "roc > 0", "roc < 0", "neutral"),
    _v("coppock p_coppock", "coppock > 0 AND NOT p_coppock > 0", "coppock < 0", "neutral"),
    _v("smi smi_signal", "smi > greatest(0, smi_signal)", "smi < least(0, smi_signal)", "oscillating"),
    """CASE WHEN ao IS NULL OR p_ao IS NULL THEN NULL WHEN ao > greatest(0, p_ao) THEN 'bullish' WHEN ao < least(0, p_ao) THEN 'bearish'
       WHEN ao > 0 AND ao < p_ao THEN 'oscillating' ELSE 'neutral' END""",
    _v("obv_vol0 p_obv_vol0", "p_obv_vol0 < obv_vol0", "p_obv_vol0 > obv_vol0", "neutral"),
    """CASE WHEN mfi IS NULL THEN NULL WHEN mfi NOT BETWEEN 20 AND 80 THEN 'oscillating' WHEN mfi > 50 THEN 'bullish' ELSE 'bearish' END""",
    _v("cmf", "cmf > 0.05", "cmf < -0.05", "oscillating"),
    _v("ad p_ad", "p_ad < ad", "p_ad > ad", "neutral"),
    _v("force_index", "force_index > 0", "force_index < 0", "neutral"),
    _v("chaikin p_chaikin", "chaikin > greatest(0, p_chaikin)", "chaikin < least(0, p_chaikin)", "oscillating"),
    "CASE WHEN atr_wilder > p_atr_wilder THEN 'oscillating' WHEN atr_wilder IS NOT NULL AND p_atr_wilder IS NOT NULL THEN 'neutral' END",
    "CASE WHEN chop > 61.8 THEN 'oscillating' WHEN chop IS NOT NULL THEN 'neutral' END",
    "CASE WHEN mass_index IS NULL OR p_mass_index IS NULL THEN NULL WHEN mass_index < 27 AND p_mass_index > 27 THEN 'bullish' ELSE 'neutral' END",
    _v("ulcer", "ulcer < 5", "ulcer > 15", "neutral"),
    "CASE WHEN ttm_momentum IS NULL THEN NULL WHEN squeeze THEN 'oscillating' WHEN ttm_momentum > 0 THEN 'bullish' WHEN ttm_momentum < 0 THEN 'bearish' ELSE 'neutral' END",
    _v("bull_power", "bull_power > greatest(0, bear_power)", "bear_power < least(0, bull_power)", "oscillating"),
]
assert len(_VOTES) == 44


def _sql() -> str:
    sats = qi.SATS_SQL.strip()
    cut = sats.index("b0 AS MATERIALIZED")
    body, tail = sats[cut:].rsplit("SELECT code, strftime(day", 1)
    body = body.replace("b AS MATERIALIZED (SELECT code, day, bn, high", "bs AS MATERIALIZED (SELECT code, day, bn, high").replace("JOIN b ON", "JOIN bs b ON").replace("FROM b\n  UNION ALL\n  SELECT code, day, bn, sa2", "FROM bs\n  UNION ALL\n  SELECT code, day, bn, sa2")
    body = body.replace("rec AS (", "recs AS (").replace("FROM rec r JOIN bs", "FROM recs r JOIN bs")
    # one precision for everything that is compared, as the operator does
    lags = ", ".join(f"lag({c}) OVER {W} AS p_{c}" for c in vote.COMPARED)
    fills = ", ".join(f"last_value({c} IGNORE NULLS) OVER {qi._cum} AS {c}" for c in vote.FILLED)
    rest = [c for c in _REC_COLS if c not in vote.FILLED]
    others = "close ma5 ma10 ma20 ma60 boll_upper boll_lower boll_mid hull tenkan kijun span_a span_b donchian_upper donchian_lower jaw teeth lips pivot_pp pivot_r1 pivot_s1 rsi_cutler stoch_k stoch_d aroon_up aroon_down cmo roc coppock ao obv_vol0 mfi ulcer sats_dir".split()
    votes = ",\n ".join(f"{t} AS v{i}" for i, t in enumerate(_VOTES))
    listed = "[" + ",".join(f"v{i}" for i in range(len(_VOTES))) + "]"
    level = ", ".join(f"{r(c, 6)} AS {c}" for c in dict.fromkeys([*others, *rest, *vote.FILLED, "ad", "mass_index"]) if c != "mass_ratio")
    counts = ", ".join(f"CAST(len(list_filter(vs, lambda x: x = '{s}')) AS BIGINT) AS {s}" for s in vote.SIDES)
    pcts = ", ".join(f"CAST(CASE WHEN total > 0 THEN floor({s} * 100.0 / total + 0.5) ELSE 0 END AS BIGINT) AS {s}_pct" for s in vote.SIDES)
    final = f"""{_stages()},
{body.rstrip().rstrip(',')},
j0 AS (SELECT v.*, {', '.join('rec.' + c for c in _REC_COLS)}, recs.dir AS sats_dir
       FROM v{_LAST} v JOIN rec ON rec.code = v.code AND rec.day = v.day JOIN recs ON recs.code = v.code AND recs.day = v.day),
j1 AS (SELECT * REPLACE ({fills}), {roll('sum', 'mass_ratio', 25)} AS mass_index FROM j0),
j1r AS (SELECT code, day, bn, {level} FROM j1),
j2 AS (SELECT *, coalesce(boll_lower >= keltner_lower AND boll_upper <= keltner_upper, false) AS squeeze, {lags} FROM j1r),
j3 AS (SELECT code, day, {votes} FROM j2 WHERE bn >= 2),
j4 AS (SELECT code, day, list_filter({listed}, lambda x: x IS NOT NULL) AS vs FROM j3),
j5 AS (SELECT code, day, CAST(len(vs) AS BIGINT) AS total, {counts} FROM j4)"""
    return recursive(_INPUTS, _FIELDS, f"SELECT code, {d()} AS day, total, {', '.join(vote.SIDES)}, {pcts} FROM j5", final=final)


@query("ind_vote", _sql())
def ind_vote(spark, sf):
    s = vote.summary(vote.vote(views.bars(spark, sf)))
    return s.withColumn("day", day_text("day"))
