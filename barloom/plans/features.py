"""Queries: feature table, screening, rules, candidates, capital flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.dates import day_text
from barloom.functions.numeric import lit, rnd
from barloom.operators import aggregates as oa
from barloom.operators import features as of
from barloom.plans import indicators as qi
from barloom.plans.registry import query
from barloom.plans.sqlkit import AT, BARS, CHANGES, DOWN, TR, BULL, d, lag, r, recursive, roll, w
from barloom.sources import views
from barloom.sources.sinks import materialized

DIGITS = {
    **{c: 3 for c in ("open", "high", "low", "close", "ma5", "ma10", "ma20", "ma60", "boll_upper", "boll_mid", "boll_lower", "atr", "macd")},
    **{c: 2 for c in ("volume", "amount", "obv", "fund_flow5", "fund_flow20")},
    **{c: 4 for c in ("rsi6", "rsi12", "rsi14", "kdj_k")},
    **{c: 6 for c in ("volume_ratio", "change_rate5", "change_rate20", "change_rate60", "change_rate120", "volatility20", "volatility60", "amihud", "high_low_ratio")},
}


def features(spark, sf):
    return of.feature_table(views.bars_flows(spark, sf))


def narrow_features(spark, sf, columns, **how):
    """Only the named feature columns: bars carry nothing else to them (see `features.feature_columns`)."""
    return of.feature_columns(views.bars_flows(spark, sf), columns, **how)


def stored_features(spark, sf, columns=None, rows=None):
    """Features for queries that read them more than once; only the columns they read, if named, are stored, and nothing
    if `rows`, stored bars with their `bar_no`, hold them already."""
    if rows is not None:
        return rows.filter(F.col("bar_no") > of.WARM_UP).select("code", "day", *columns)
    return materialized(features(spark, sf) if columns is None else narrow_features(spark, sf, columns))


_PAST = qi._past5
_ADDED = ", ".join(
    [
        *(f"{roll('avg', 'close', p)} AS ma{p}" for p in (5, 10, 20, 60)),
        f"{roll('avg', 'close', 20)} AS boll_mid, {roll('stddev_pop', 'close', 20)} AS sd",
        f"CASE WHEN count(volume) OVER {_PAST} = 5 AND avg(volume) OVER {_PAST} > 0 THEN volume / avg(volume) OVER {_PAST} ELSE 1 END AS volume_ratio",
        f"CASE WHEN {lag('close')} IS NOT NULL THEN {TR} END AS tr0",
        *(f"close / {lag('close', n)} - 1 AS change_rate{n}" for n in (5, 20, 60, 120)),
        f"ln(close / {lag('close')}) AS lr",
        f"CASE WHEN volume > 0 THEN abs(close / {lag('close')} - 1) / (close * volume * 100) * 1e10 END AS il",
        "(high - low) / close AS high_low_ratio",
        f"coalesce(sign(close - {lag('close')}) * volume, 0) AS ob",
        *(f"sum(net_inflow) OVER {w(n)} AS fund_flow{n}" for n in (5, 20)),
    ]
)
_ADDED2 = ", ".join(
    [
        "boll_mid + 2 * sd AS boll_upper, boll_mid - 2 * sd AS boll_lower",
        f"{roll('avg', 'tr0', 14)} AS atr",
        *(f"{roll('stddev_pop', 'lr', n)} * sqrt(252) AS volatility{n}" for n in (20, 60)),
        f"coalesce(sum(il) OVER {w(5)}, 0) / 5 AS amihud",
        f"sum(ob) OVER {qi._cum} AS obv",
    ]
)
_FIELDS = [*[f for p in (6, 12, 14) for f in qi._rsi_fields(p)], *qi.MACD0, *qi.KDJ]
FEATURES = f"""w1 AS (SELECT *, {AT}, {_ADDED} FROM bars), w2 AS (SELECT *, {_ADDED2} FROM w1),
feat AS MATERIALIZED (SELECT w2.* EXCLUDE (bn, tr0, lr, il, ob, sd), rsi6_wilder AS rsi6, rsi12_wilder AS rsi12, rsi14_wilder AS rsi14, macd_x0 AS macd, kdj_k
  FROM w2 JOIN rec ON rec.code = w2.code AND rec.day = w2.day WHERE w2.bn > 60)"""


def feature_sql(select: str, *more: str) -> str:
    return recursive(f"SELECT code, day, {AT}, close, {qi._GL}, {qi._RSV} FROM bars", _FIELDS, select, final=",\n".join([FEATURES, *more]))


def _out(cols=DIGITS):
    return ", ".join(f"{r(c, k)} AS {c}" for c, k in cols.items())


@query("feature_table", feature_sql(f"SELECT code, {d()} AS day, {_out()}, strftime(day + INTERVAL 910 MINUTE, '%Y-%m-%d %H:%M') AS data_as_of, 'kline' AS source, 'daily_v3_qfq' AS feature_version FROM feat"))
def feature_table(spark, sf):
    f = features(spark, sf)
    return f.select("code", day_text("day").alias("day"), *[rnd(c, k).alias(c) for c, k in DIGITS.items()], F.date_format("data_as_of", "yyyy-MM-dd HH:mm").alias("data_as_of"), "source", "feature_version")


_FLAGS = ("macd_golden", "ma_bullish", "ma_bearish", "break_ma20", "boll_breakout", "volume_breakout", "oversold", "overbought", "macd_above_zero")
SCREEN = """dts AS (SELECT day, lead(day) OVER (ORDER BY day) AS nx FROM (SELECT DISTINCT day FROM feat)),
pv AS (SELECT code, nx AS day, macd AS pm, close AS pc, ma20 AS pa, boll_upper AS pb FROM feat JOIN dts USING (day) WHERE nx IS NOT NULL),
sc0 AS (SELECT f.*, pc IS NOT NULL AS has, coalesce(pm <= 0 AND macd > 0, false) AS macd_golden, coalesce(ma5 > ma20 AND ma20 > ma60, false) AS ma_bullish, coalesce(ma5 < ma20 AND ma20 < ma60, false) AS ma_bearish,
  coalesce(pc <= pa AND close > ma20, false) AS break_ma20, coalesce(pc <= pb AND close > boll_upper AND boll_upper > 0, false) AS boll_breakout, volume_ratio >= 1.5 AS volume_breakout, coalesce(rsi6 > 0 AND rsi6 < 30, false) AS oversold,
  coalesce(rsi6 > 70, false) AS overbought, coalesce(macd > 0, false) AS macd_above_zero FROM feat f LEFT JOIN pv ON pv.code = f.code AND pv.day = f.day),
sc AS MATERIALIZED (SELECT *, CASE WHEN has THEN 1 ELSE 0.5 END::DOUBLE AS coverage, list_sort(list_filter([CASE WHEN boll_breakout THEN 'BOLL_BREAKOUT' END, CASE WHEN break_ma20 THEN 'BREAK_MA20' END, CASE WHEN macd_golden THEN 'MACD_GOLDEN_FORK' END, CASE WHEN ma_bullish THEN 'MA_BULLISH' END,
  CASE WHEN oversold THEN 'RSI_OVERSOLD' END, CASE WHEN volume_breakout THEN 'VOLUME_BREAKOUT' END], lambda x: x IS NOT NULL)) AS cs FROM sc0)"""


@query("screening_facts", feature_sql(f"SELECT code, {d()} AS day, {', '.join(_FLAGS)}, coverage, coalesce(array_to_string(cs, '|'), '') AS conditions, CAST(len(cs) AS INTEGER) AS pattern_count FROM sc", SCREEN))
def screening_facts(spark, sf):
    s = of.screening_facts(narrow_features(spark, sf, [*of.SCREENED, *of.BEFORE]))
    return s.select("code", day_text("day").alias("day"), *_FLAGS, "coverage", F.array_join("conditions", "|").alias("conditions"), "pattern_count")


RULE = {
    "entry": [
        {"indicator": "close", "op": "cross_up", "ref": "ma20"},
        {"indicator": "rsi6", "op": "<", "value": 70.0},
        {"indicator": "volume_ratio", "op": ">", "value": 0.5, "lag": 1},
    ],
    "exit": [{"indicator": "close", "op": "cross_down", "ref": "ma10"}, {"indicator": "rsi6", "op": ">", "value": 85.0}],
    "stop_loss": 0.08,
    "stop_gain": 0.2,
    "max_hold": 10,
}


def traded_columns(*rules):
    """Columns that trades of the rules read: prices, volume and what the conditions mention."""
    return list(dict.fromkeys(["open", "high", "low", "close", "volume", *[of.column_of(n) for r in rules for c in (*r["entry"], *r["exit"]) for n in (c["indicator"], c.get("ref")) if n]]))


def rule_sql(scale: float = 1.0, name: str = "sig") -> str:
    return f"""{name} AS (SELECT *, coalesce({lag('close')} <= {lag('ma20')} AND close > ma20, false) AND coalesce(rsi6 < {70.0 * scale}::DOUBLE, false) AND coalesce({lag('volume_ratio')} > {0.5 * scale}::DOUBLE, false) AS entry_matched,
  coalesce({lag('close')} >= {lag('ma10')} AND close < ma10, false) OR coalesce(rsi6 > {85.0 * scale}::DOUBLE, false) AS exit_matched,
  30 + CASE WHEN atr > 0 THEN greatest(0, 10 - least(atr / close * 100, 10)) ELSE 0 END + CASE WHEN volume_ratio > 1 THEN least((volume_ratio - 1) * 5, 10) ELSE 0 END + CASE WHEN fund_flow5 > 0 THEN 5 ELSE 0 END
  + CASE WHEN change_rate20 > {lag('change_rate20')} THEN 3 ELSE 0 END AS score FROM feat)"""


@query("signal_rule", feature_sql(f"SELECT code, {d()} AS day, entry_matched, exit_matched, {r('score', 4)} AS score FROM sig", rule_sql()))
def signal_rule(spark, sf):
    m = of.signal_score(of.match_rule(features(spark, sf), RULE), len(RULE["entry"]))
    return m.select("code", day_text("day").alias("day"), "entry_matched", "exit_matched", rnd("score", 4).alias("score"))


@query("rule_cross_expanded", feature_sql(f"SELECT code, {d()} AS day FROM sig WHERE entry_matched", rule_sql()))
def rule_cross_expanded(spark, sf):
    rule = {**RULE, "entry": of.expand_cross(RULE["entry"])}
    return of.match_rule(features(spark, sf), rule).filter("entry_matched").select("code", day_text("day").alias("day"))


_CANDS = f"""ev0 AS (SELECT code, day, count(CASE WHEN change_type IN {BULL} THEN 1 END) AS b, count(CASE WHEN change_type IN {DOWN} THEN 1 END) AS s FROM (SELECT code, CAST('2001-10-' || substr(change_date, 9, 2) AS DATE) AS day, change_type FROM changes) GROUP BY 1, 2),
lu AS (SELECT code, CAST('2001-10-' || substr(change_date, 9, 2) AS DATE) AS day, max(greatest(least(45 + (code % 4 + 1) * 9 + least(amount, 20) - CASE WHEN change_type = 16 THEN 25 ELSE 0 END, 100), 0)) AS score FROM changes WHERE change_type IN (4, 16) GROUP BY 1, 2),
cand AS (SELECT code, day, 'event' AS source, greatest(least(45 + b * 7 - s * 8, 100), 0)::DOUBLE AS score FROM ev0 WHERE NOT (b = 0 AND s > 0)
  UNION ALL SELECT code, day, 'uplimit', score FROM lu
  UNION ALL SELECT code, day, 'pattern', least(40 + len(cs) * 10, 100) FROM sc WHERE boll_breakout OR volume_breakout OR break_ma20 OR ma_bullish
  UNION ALL SELECT code, day, 'indicator', least(45 + CASE WHEN macd_golden THEN 20 ELSE 0 END + CASE WHEN oversold THEN 15 ELSE 0 END + CASE WHEN ma_bullish THEN 10 ELSE 0 END, 100) FROM sc WHERE macd_golden OR oversold OR (macd_above_zero AND ma_bullish))"""
_MERGE = """mg0 AS (SELECT code, day, max(CASE WHEN source = 'event' THEN score END) AS e, max(CASE WHEN source = 'uplimit' THEN score END) AS u, max(CASE WHEN source = 'pattern' THEN score END) AS p, max(CASE WHEN source = 'indicator' THEN score END) AS i,
  count(DISTINCT source) AS k, avg(score) AS ss FROM (SELECT code, day, source, max(score) AS score FROM cand GROUP BY 1, 2, 3) GROUP BY 1, 2),
mg1 AS (SELECT g.*, f.close, f.atr, least(k * 10, 40) AS b, coalesce(close > 0 AND atr / close > 0.06, false) AS wild, coalesce(volume_ratio >= 1.5, false) AS vb, coalesce(rsi6 > 0 AND rsi6 < 30, false) AS os, coalesce(ma20 > ma60 AND close > ma20, false) AS tb
  FROM mg0 g LEFT JOIN feat f USING (code, day)),
mg2 AS (SELECT *, greatest(0, least(100, 25 + b + coalesce((e - 50) * 0.35, 0) + coalesce((u - 40) * 0.45, 0) + coalesce((p - 50) * 0.20, 0) + coalesce((i - 50) * 0.15, 0) + CASE WHEN vb THEN 8 ELSE 0 END - CASE WHEN wild THEN 5 ELSE 0 END)) AS short_score,
  greatest(0, least(100, 25 + b * 0.7 + coalesce((e - 50) * 0.15, 0) + coalesce((i - 50) * 0.30, 0) + CASE WHEN os THEN 15 ELSE 0 END)) AS swing_score,
  greatest(0, least(100, 25 + b * 0.6 + coalesce((u - 50) * 0.10, 0) + coalesce((p - 50) * 0.25, 0) + coalesce((i - 50) * 0.30, 0) + CASE WHEN tb THEN 15 ELSE 0 END - CASE WHEN wild THEN 12 ELSE 0 END)) AS trend_score FROM mg1),
mg AS MATERIALIZED (SELECT *, CASE WHEN short_score >= swing_score AND short_score >= trend_score THEN '短线爆发' WHEN swing_score >= trend_score THEN '波段反弹' ELSE '趋势持有' END AS best_scene FROM mg2)"""


def _month_changes(spark, sf):
    """Change events placed in the last month of the bars, so that both sources meet."""
    c = views.changes(spark, sf)
    return c.withColumn("day", F.to_date(F.concat(F.lit("2001-10-"), F.substring("change_date", 9, 2))))


_CANDIDATE_COLUMNS = ("close", "amount", "volume_ratio", "rsi6", "macd", "ma5", "ma20", "ma60", "atr", "boll_upper")


def candidate_sources(spark, sf, f):
    c = _month_changes(spark, sf)
    ev = oa.stock_day_events(c.withColumn("change_date", F.col("day"))).withColumnRenamed("change_date", "day")
    lu = c.filter("change_type IN (4, 16)").select("code", "day", (F.col("code") % 4 + 1).alias("streak"), F.col("amount").alias("seal_ratio"), (F.col("change_type") == 16).alias("exploded"))
    facts = of.screening_facts(f)
    return [of.event_candidates(ev), of.limit_up_candidates(lu), of.pattern_candidates(facts), of.indicator_candidates(facts)]


@query("candidate_sources", feature_sql(f"SELECT code, {d()} AS day, source, {r('score', 4)} AS score FROM cand", SCREEN, CHANGES, _CANDS))
def candidate_sources_query(spark, sf):
    from functools import reduce

    parts = candidate_sources(spark, sf, stored_features(spark, sf, _CANDIDATE_COLUMNS))
    u = reduce(lambda a, b: a.unionByName(b), parts)
    return u.select("code", day_text("day").alias("day"), "source", rnd("score", 4).alias("score"))


@query("captured_candidates", f"SELECT o_custkey AS code, {d('CAST(o_orderdate AS DATE)')} AS day, greatest(40, least(65, 65 - (o_orderkey % 200) * 0.25::DOUBLE)) AS score FROM orders")
def captured_candidates(spark, sf):
    o = views.table(spark, sf, "orders").select(F.col("o_custkey").alias("code"), F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderkey") % 200 + 1).alias("source_rank"))
    return of.captured_candidates(o, "pattern").select("code", day_text("day").alias("day"), "score")


@query("candidate_scores", feature_sql(f"SELECT code, {d()} AS day, k AS source_count, {r('ss', 4)} AS source_score, {r('short_score', 4)} AS short_score, {r('swing_score', 4)} AS swing_score, {r('trend_score', 4)} AS trend_score, best_scene FROM mg", SCREEN, CHANGES, _CANDS, _MERGE))
def candidate_scores(spark, sf):
    f = stored_features(spark, sf, _CANDIDATE_COLUMNS)
    m = of.merge_candidates(candidate_sources(spark, sf, f), f)
    return m.select("code", day_text("day").alias("day"), F.col("source_count").cast("long").alias("source_count"), *[rnd(c, 4).alias(c) for c in ("source_score", "short_score", "swing_score", "trend_score")], "best_scene")


_ADV = "CASE best_scene WHEN '短线爆发' THEN {} WHEN '波段反弹' THEN {} ELSE {} END::DOUBLE"


@query(
    "candidate_advice",
    feature_sql(
        f"""SELECT code, {d()} AS day, {r('close * 0.98', 3)} AS buy_min, {r('close * 1.02', 3)} AS buy_max, {r('close * 1.05', 3)} AS no_chase,
  {r('close * (1 - CASE WHEN atr > 0 THEN greatest(0.03, least(0.10, atr / close * 1.5)) ELSE 0.04 END)', 3)} AS stop_price, {r('close * (1 + ' + _ADV.format(0.05, 0.10, 0.15) + ')', 3)} AS target_price,
  {_ADV.format(5, 20, 60)} AS max_hold_days, {_ADV.format(0.10, 0.15, 0.20)} AS position_cap, CASE WHEN close > 0 THEN 'candidate_only' ELSE 'missing_price' END AS status FROM mg""",
        SCREEN,
        CHANGES,
        _CANDS,
        _MERGE,
    ),
)
def candidate_advice(spark, sf):
    f = stored_features(spark, sf, _CANDIDATE_COLUMNS)
    a = of.advice_bands(of.merge_candidates(candidate_sources(spark, sf, f), f))
    return a.select("code", day_text("day").alias("day"), *[rnd(c, 3).alias(c) for c in ("buy_min", "buy_max", "no_chase", "stop_price", "target_price")], "max_hold_days", "position_cap", "status")


_CF = f"""cf AS (SELECT code, day, open, close, fund_flow5, fund_flow20, CASE WHEN volume > 30 THEN net_inflow ELSE 0 END AS mac1, net_inflow AS m1, {lag('net_inflow')} AS m5, {lag('net_inflow', 2)} AS m20, net_inflow / amount / 20 AS ratio, -net_inflow AS sup, {lag('net_inflow', 3)} AS lg, -net_inflow / 2 AS sm,
  {lag('net_inflow', 4)} AS sec, {lag('net_inflow', 5)} AS con FROM (SELECT *, sum(net_inflow) OVER {w(5)} AS fund_flow5, sum(net_inflow) OVER {w(20)} AS fund_flow20 FROM bars)),
cf1 AS (SELECT code, day, open, close, fund_flow5 AS f5, fund_flow20 AS f20, CASE WHEN mac1 <> 0 THEN mac1 ELSE m1 END AS a, coalesce(m5, 0) AS b, coalesce(m20, 0) AS c, ratio, sup, coalesce(lg, 0) AS lg, sm, coalesce(sec, 0) AS sec, coalesce(con, 0) AS con FROM cf),
cf2 AS (SELECT *, a <> 0 OR b <> 0 OR c <> 0 OR f5 <> 0 OR f20 <> 0 AS known,
  CASE WHEN ratio >= 0.03 OR a > 0 THEN 4 ELSE 0 END - CASE WHEN ratio <= -0.03 OR a < 0 THEN 4 ELSE 0 END + CASE WHEN b > 0 OR f5 > 0 THEN 3 ELSE 0 END - CASE WHEN b < 0 OR f5 < 0 THEN 3 ELSE 0 END + CASE WHEN c > 0 OR f20 > 0 THEN 2 ELSE 0 END - CASE WHEN c < 0 OR f20 < 0 THEN 2 ELSE 0 END
  + sign(sup) * 2 + sign(lg) - CASE WHEN a < 0 AND sm > 0 THEN 3 ELSE 0 END - CASE WHEN close > open AND (a < 0 OR b < 0) THEN 2 ELSE 0 END + CASE WHEN close < open AND (a > 0 OR b > 0) THEN 2 ELSE 0 END
  + CASE WHEN a > 0 OR b > 0 THEN sign(sec) * 2 + CASE WHEN con > 0 THEN 1 ELSE 0 END ELSE 0 END - CASE WHEN con < 0 THEN 1 ELSE 0 END AS adj FROM cf1)"""


@query(
    "capital_flow_score",
    f"WITH {BARS}, {_CF} SELECT code, {d()} AS day, CAST(CASE WHEN known THEN adj ELSE 0 END AS INTEGER) AS adjustment, CASE WHEN NOT known THEN 'unknown' WHEN adj >= 8 THEN 'strong_inflow' WHEN adj > 0 THEN 'inflow' WHEN adj <= -8 THEN 'strong_outflow' WHEN adj < 0 THEN 'outflow' ELSE 'neutral' END AS level FROM cf2",
)
def capital_flow_score(spark, sf):
    from barloom.indicators import rolling as ro

    R = ro.R
    b = ro.fund_flow(views.bars_flows(spark, sf))
    x = F.col("net_inflow")

    def back(n):
        return F.coalesce(R.lag("net_inflow", n), lit(0))

    b = b.withColumns(
        {
            "mac_main_net1": F.when(F.col("volume") > 30, x).otherwise(lit(0)),
            "main_net1": x,
            "mac_main_net5": lit(0),
            "main_net5": back(1),
            "main_net20": back(2),
            "main_ratio": x / F.col("amount") / lit(20),
            "super_net1": -x,
            "large_net1": back(3),
            "mac_retail_net1": lit(0),
            "retail_net1": lit(0),
            "small_net1": -x / lit(2),
            "sector_net": back(4),
            "concept_net": back(5),
        }
    )
    return of.capital_flow_score(b).select("code", day_text("day").alias("day"), "adjustment", "level")
