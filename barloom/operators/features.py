"""Daily feature table, rules over current and previous row, screening, candidates, scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import schemas
from barloom.functions.numeric import clamp, first_non_zero, lit
from barloom.functions.ranks import all_of, any_of
from barloom.indicators import recurrent as rc
from barloom.operators.joins import unified_view
from barloom.operators.recurrence import before, by_instrument, scan_blocks
from barloom.operators.windows import Roll
from barloom.sources.sinks import materialized

WARM_UP = 60
RENAME = {
    "rsi6_wilder": "rsi6",
    "rsi12_wilder": "rsi12",
    "rsi14_wilder": "rsi14",
    "macd_x0": "macd",
    "atr_sma": "atr",
    "obv_zero": "obv",
}


_MADE = {
    "close": ("ma5", "ma10", "ma20", "ma60", "boll_mid", "change_rate5", "change_rate20", "change_rate60", "change_rate120", "bar_no", "boll_upper", "boll_lower", "volatility20", "volatility60", "rsi6_wilder", "rsi12_wilder", "rsi14_wilder", "macd_x0"),
    "volume": ("volume_ratio", "amihud", "obv_zero"),
    "high": ("high_low_ratio", "atr_sma", "kdj_k"),
    "net_inflow": ("fund_flow5", "fund_flow20"),
}


def feature_table(bars: DataFrame, source: str = "kline", warm_up: int = WARM_UP) -> DataFrame:
    """One row per (code, day) after the warm-up: prices, window and recurrent indicators, flow, as-of columns.

    One exchange by code and one sort serve the only pass, over blocks of instruments.
    """
    flows = ["net_inflow"] if "net_inflow" in bars.columns else []
    carry = [c for c in bars.columns if c not in ("code", "day", "turnover", "net_inflow")]
    first = ["ma5", "ma10", "ma20", "ma60", "boll_mid", "volume_ratio", "change_rate5", "change_rate20", "change_rate60", "change_rate120", "high_low_ratio", "bar_no"]
    last = ["boll_upper", "boll_lower", "atr_sma", "volatility20", "volatility60", "amihud", "obv_zero", "rsi6_wilder", "rsi12_wilder", "rsi14_wilder", "macd_x0", "kdj_k"]
    made = [*first, *(["fund_flow5", "fund_flow20"] if flows else []), *last]
    df = scan_blocks(by_instrument(bars), rc.feature_recipe, [*rc.FEATURE_INPUTS, *flows], made, carry=carry)
    df = df.withColumnsRenamed(RENAME).withColumn("bar_no", F.col("bar_no").cast("int"))
    as_of = F.col("day").cast("timestamp") + F.make_interval(hours=F.lit(15), mins=F.lit(10))
    return df.filter(F.col("bar_no") > warm_up).withColumns(
        {
            "data_as_of": as_of,
            "source": F.lit(source),
            "adjusted": F.lit(True),
            "feature_version": F.lit(schemas.FEATURE_VERSION),
        }
    )


def feature_columns(bars: DataFrame, columns: Sequence[str], master: DataFrame | None = None, warm_up: int = WARM_UP, horizon: int = 5) -> DataFrame:
    """(code, day, columns) of `feature_table`; bars keep only the columns that these need before they are exchanged.

    Besides feature and bar columns, `columns` may name `bar_no`, `previous_x` and `previous_day`, the value of x and the day on
    the code's row before (null on the first row after the warm-up), and `future`, the close `horizon` rows ahead.
    Columns of `master`, rows by code, are joined on the way, where bars already stand by code.
    """
    columns, back = list(dict.fromkeys(columns)), {v: k for k, v in RENAME.items()}
    behind = {c: back.get(c.removeprefix("previous_"), c.removeprefix("previous_")) for c in columns if c.startswith("previous_")}
    of_master = [c for c in columns if master is not None and c in master.columns]
    plain = [back.get(c, c) for c in columns if c not in behind and c != "future" and c not in of_master]
    asked = {*plain, *behind.values()}
    inputs = ["close", *[c for c, made in _MADE.items() if c != "close" and asked & set(made)]]
    inputs += ["low"] if "high" in inputs else []
    inputs += [c for c in behind.values() if c in bars.columns and c not in inputs and c != "day"]
    carry = [c for c in plain if c in bars.columns]
    made = list(dict.fromkeys([*[c for c in plain if c not in carry], *behind, *(["future"] if "future" in columns else []), "bar_no"]))
    df = by_instrument(bars.select("code", "day", *dict.fromkeys([*carry, *inputs])))
    if of_master:
        # a code's rows travel as one list, so bars stay one row per day
        rows = by_instrument(master.select("code", *of_master)).groupBy("code").agg(F.collect_list(F.struct(*of_master)).alias("_master"))
        df = df.join(rows, "code", "left")
        carry = [*carry, "_master"]
    if "day" in behind.values():
        df = df.withColumn("_day", F.unix_date("day").cast("double"))
        inputs = [*inputs, "_day"]

    made_of = rc.feature_recipe  # the function alone goes to the tasks

    def recipe(s):
        out = made_of(s)
        for name, x in behind.items():
            out[name] = before(s["_day"] if x == "day" else out[x] if x in out else s[x])
            out[name][: warm_up + 1] = np.nan
        out["future"] = np.full_like(s["close"], np.nan)
        out["future"][: max(0, len(out["future"]) - horizon)] = s["close"][horizon:]
        return out

    df = scan_blocks(df, recipe, inputs, made, carry=carry).filter(F.col("bar_no") > warm_up)
    if of_master:
        df = df.withColumn("_m", F.explode_outer("_master")).withColumns({c: F.col(f"_m.{c}") for c in of_master})
    if "previous_day" in made:
        df = df.withColumn("previous_day", F.date_from_unix_date(F.col("previous_day").cast("int")))
    return df.withColumnsRenamed(RENAME).withColumn("bar_no", F.col("bar_no").cast("int")).select("code", "day", *columns)


# --- indicator registry and rules ---------------------------------------------------------------

# name -> (unit, look-ahead); look-ahead columns and candidates are rejected in rules
INDICATORS: dict[str, tuple[str, bool]] = {
    **{n: ("price", False) for n in ("open", "high", "low", "close", "ma5", "ma10", "ma20", "ma60", "boll_upper", "boll_mid", "boll_lower", "atr")},
    **{n: ("index", False) for n in ("rsi6", "rsi12", "rsi14", "kdj_k")},
    **{n: ("ratio", False) for n in ("volume_ratio", "change_rate5", "change_rate20", "change_rate60", "change_rate120", "volatility20", "volatility60", "high_low_ratio", "amihud")},
    **{n: ("amount", False) for n in ("fund_flow5", "fund_flow20", "amount")},
    **{n: ("volume", False) for n in ("volume", "obv")},
    "macd": ("momentum", False),
    **{n: ("price", True) for n in ("chikou", "zigzag", "fractal_high", "fractal_low", "swing_high", "swing_low")},
}
# fixed values: ids of facts outside the feature table with unit and status; candidates are rejected unless a caller admits them
EXTERNAL: dict[str, tuple[str, str]] = {
    **{f"money_flow.{n}": ("amount", "candidate") for n in ("net_inflow", "net_inflow5")},
    **{f"market.{n}": (u, "candidate") for n, u in (("sentiment_score", "score"), ("up_ratio", "ratio"), ("up_count", "count"), ("advance_decline", "count"))},
    "sector.net_inflow": ("amount", "candidate"),
    **{f"event.{n}": (u, "candidate") for n, u in (("change_count", "count"), ("has_large_buy", "boolean"), ("has_rapid_rise", "boolean"), ("has_limit_up", "boolean"))},
    **{f"limitup.{n}": (u, "candidate") for n, u in (("keep_times", "count"), ("seal_ratio", "ratio"), ("exploded_count", "count"), ("plate_heat", "score"))},
    **{f"screening.{n}": (u, "candidate") for n, u in (("pattern_count", "count"), ("macd_golden", "boolean"), ("ma_bullish", "boolean"))},
    **{f"recommendation.{n}": ("count", "candidate") for n in ("model_count", "count")},
    "candidate.score": ("score", "candidate"),
}
CROSSING_UNITS = ("price", "momentum")


def column_of(name: str) -> str:
    """The column that holds an indicator: bare names and stock_feature ones are feature columns."""
    space, dot, column = name.rpartition(".")
    return column if not dot or space == "stock_feature" else f"{space}_{column}"


def registry() -> dict[str, dict]:
    """Every indicator id with its unit, allowed operators and status."""
    plain, cross = sorted(COMPARE), sorted([*COMPARE, *CROSS])
    own = {f"stock_feature.{n}": (u, "look_ahead" if ahead else "active") for n, (u, ahead) in INDICATORS.items()}
    return {i: {"unit": u, "status": s, "operators": cross if u in CROSSING_UNITS else plain} for i, (u, s) in {**own, **EXTERNAL}.items()}


def mentioned(rule: Mapping) -> list[str]:
    """Namespaced ids of a rule, each once."""
    names = [n for c in (*rule.get("entry", ()), *rule.get("exit", ())) for n in (c.get("indicator"), c.get("ref")) if n and "." in n]
    return list(dict.fromkeys(names))


COMPARE = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}
CROSS = {"cross_up": ("<=", ">"), "crosses_above": ("<=", ">"), "cross_down": (">=", "<"), "crosses_below": (">=", "<")}


def validate_rule(rule: Mapping, candidates: bool = False) -> list[str]:
    """Problems of a rule: unknown, look-ahead or candidate indicators, units, lags, operators, limits."""
    known = registry()
    errors = [] if rule.get("entry") else ["at least one entry condition is required"]
    for i, c in enumerate([*rule.get("entry", ()), *rule.get("exit", ())]):
        names = [n for n in (c.get("indicator"), c.get("ref")) if n]
        found = {n: known.get(n if "." in n else f"stock_feature.{n}") for n in names}
        for n, k in found.items():
            if k is None:
                errors.append(f"condition {i}: indicator is not registered: {n}")
            elif k["status"] == "look_ahead":
                errors.append(f"condition {i}: indicator looks ahead: {n}")
            elif k["status"] == "candidate" and not candidates:
                errors.append(f"condition {i}: indicator is a candidate: {n}")
            elif "." in n and c.get("op") in CROSS and c["op"] not in k["operators"]:
                errors.append(f"condition {i}: operator is not allowed for {n}: {c['op']}")
        units = {k["unit"] for k in found.values() if k}
        if len(names) == 2 and len(units) == 2:
            errors.append(f"condition {i}: unit mismatch")
        if not {c.get("lag", 0), c.get("ref_lag", 0)} <= {0, 1}:
            errors.append(f"condition {i}: lag is 0 or 1")
        if c.get("op") not in COMPARE and c.get("op") not in CROSS:
            errors.append(f"condition {i}: operator is not allowed: {c.get('op')}")
    for name, lo, hi in (("stop_loss", 0.02, 0.12), ("stop_gain", 0.03, 0.25), ("max_hold", 1, 30)):
        if not lo <= rule.get(name, lo) <= hi:
            errors.append(f"{name} must be in {lo} - {hi}")
    return errors


def expand_cross(conditions: Sequence[Mapping]) -> list[dict]:
    """A crossing in an ALL group as two comparisons, the first on the previous row."""
    out: list[dict] = []
    for c in conditions:
        if c["op"] in CROSS:
            before, now = CROSS[c["op"]]
            out += [{**c, "op": before, "lag": 1, "ref_lag": 1}, {**c, "op": now, "lag": 0, "ref_lag": 0}]
        else:
            out.append(dict(c))
    return out


def _operand(r: Roll, name: str, lag: int) -> Column:
    return r.lag(column_of(name)) if lag == 1 else F.col(column_of(name))


def condition(c: Mapping, scale: float = 1.0) -> Column:
    """One comparison as a boolean Column; a missing operand makes it false."""
    r = Roll()

    def right(lag: int) -> Column:
        return _operand(r, c["ref"], lag) if c.get("ref") else lit(c.get("value", 0.0) * scale)

    if c["op"] in CROSS:
        before, now = CROSS[c["op"]]
        if c.get("lag", 0) != 0:
            return F.lit(False)
        own = column_of(c["indicator"])
        hit = COMPARE[before](r.lag(own), right(1)) & COMPARE[now](F.col(own), right(0))
    else:
        hit = COMPARE[c["op"]](_operand(r, c["indicator"], c.get("lag", 0)), right(c.get("ref_lag", 0)))
    return F.coalesce(hit, F.lit(False))


def match_rule(df: DataFrame, rule: Mapping, scale: float = 1.0, candidates: bool = False) -> DataFrame:
    """Adds entry_matched (ALL of entry) and exit_matched (ANY of exit); an empty list never matches."""
    problems = validate_rule(rule, candidates)
    if problems:
        raise ValueError("; ".join(problems))
    entry = [condition(c, scale) for c in rule["entry"]]
    exit_ = [condition(c, scale) for c in rule.get("exit", ())]
    return df.withColumns(
        {
            "entry_matched": all_of(entry) if entry else F.lit(False),
            "exit_matched": any_of(exit_) if exit_ else F.lit(False),
        }
    )


def match_namespaced(features: DataFrame, facts: Mapping[str, DataFrame], rule: Mapping) -> DataFrame:
    """match_rule over the features and only those facts that the rule mentions; a missing fact fails its condition."""
    return match_rule(unified_view(features, facts, mentioned(rule)), rule, candidates=True)


def signal_score(df: DataFrame, n_conditions: int) -> DataFrame:
    """10 per condition, up to 10 for low ATR, up to 10 for volume, 5 for inflow, 3 for rising momentum."""
    r = Roll()
    atr_pct = F.col("atr") / F.col("close") * lit(100)
    calm = F.when((F.col("atr") > 0) & (F.col("close") > 0), F.greatest(lit(0), lit(10) - F.least(atr_pct, lit(10)))).otherwise(lit(0))
    vol = F.when(F.col("volume_ratio") > 1, F.least((F.col("volume_ratio") - 1) * lit(5), lit(10))).otherwise(lit(0))
    inflow = F.when(F.col("fund_flow5") > 0, lit(5)).otherwise(lit(0))
    rising = F.when(F.col("change_rate20") > r.lag("change_rate20"), lit(3)).otherwise(lit(0))
    return df.withColumn("score", lit(10 * n_conditions) + calm + vol + inflow + rising)


# --- screening and candidates --------------------------------------------------------------------

SCREEN_NAMES = ("BOLL_BREAKOUT", "BREAK_MA20", "MACD_GOLDEN_FORK", "MA_BULLISH", "RSI_OVERSOLD", "VOLUME_BREAKOUT")


SCREENED = ("close", "macd", "ma5", "ma20", "ma60", "boll_upper", "volume_ratio", "rsi6")
BEFORE = ("previous_day", "previous_macd", "previous_close", "previous_ma20", "previous_boll_upper")


def screening_conditions(features: DataFrame, *keep: str) -> DataFrame:
    """What screening reads of a row and of the code's row before it, as flags: a few bytes a row, for `screened`.

    Takes the row before from the columns `BEFORE`, where the features have them.
    """
    if "previous_day" not in features.columns:
        w = Window.partitionBy("code").orderBy("day")
        features = features.withColumns({c: F.lag(c.removeprefix("previous_")).over(w) for c in BEFORE})
    c = F.col

    def t(x: Column) -> Column:
        return F.coalesce(x, F.lit(False))

    flags = {
        "macd_golden": t((c("previous_macd") <= 0) & (c("macd") > 0)),
        "ma_bullish": t((c("ma5") > c("ma20")) & (c("ma20") > c("ma60")) & (c("ma60") > 0)),
        "ma_bearish": t((c("ma5") < c("ma20")) & (c("ma20") < c("ma60")) & (c("ma60") > 0)),
        "break_ma20": t((c("previous_close") <= c("previous_ma20")) & (c("close") > c("ma20")) & (c("ma20") > 0)),
        "boll_breakout": t((c("previous_close") <= c("previous_boll_upper")) & (c("close") > c("boll_upper")) & (c("boll_upper") > 0)),
        "volume_breakout": t(c("volume_ratio") >= 1.5),
        "oversold": t((c("rsi6") > 0) & (c("rsi6") < 30)),
        "overbought": t(c("rsi6") > 70),
        "macd_above_zero": t(c("macd") > 0),
    }
    return features.select("code", "day", *keep, F.when(c("code").isNotNull(), c("previous_day")).alias("_before"), *[x.alias(k) for k, x in flags.items()])


def screened(conditions: DataFrame) -> DataFrame:
    """`screening_conditions` against the market's calendar: the row before counts if its day is the previous market date.

    Reads its rows twice, so they should be stored.
    """
    # one row per trading day: a small ordered list
    dates = conditions.select("day").distinct()
    dates = dates.select("day", F.lag("day").over(Window.orderBy("day")).alias("_prior"))
    df = conditions.join(F.broadcast(dates), "day", "left")
    has = F.coalesce(F.col("_before") == F.col("_prior"), F.lit(False))
    df = df.withColumn("coverage", F.when(has, lit(1)).otherwise(lit(0.5)))
    df = df.withColumns({f: F.col(f) & has for f in ("macd_golden", "break_ma20", "boll_breakout")})
    order = ("boll_breakout", "break_ma20", "macd_golden", "ma_bullish", "oversold", "volume_breakout")
    named = F.array_compact(F.array(*[F.when(F.col(f), F.lit(n)) for f, n in zip(order, SCREEN_NAMES)]))
    df = df.withColumn("conditions", F.array_sort(named))
    return df.withColumn("pattern_count", F.size("conditions")).drop("_before", "_prior")


def screening_facts(features: DataFrame) -> DataFrame:
    """Named conditions per stock-day against the stock's row on the previous market date.

    Coverage is 1 with such a row and 0.5 without. Only the flags are stored, and only the calendar meets them.
    """
    return screened(materialized(screening_conditions(features)))


SOURCE_COLUMNS = ("code", "day", "source", "score")


def event_candidates(stock_days: DataFrame) -> DataFrame:
    """45 + 7 per bullish - 8 per bearish event; days with only bearish events are no candidates."""
    score = clamp(lit(45) + F.col("bullish_count") * 7 - F.col("bearish_count") * 8, 0, 100)
    df = stock_days.filter(~((F.col("bullish_count") == 0) & (F.col("bearish_count") > 0)))
    return df.withColumns({"score": score, "source": F.lit("event")}).select(*SOURCE_COLUMNS)


def limit_up_candidates(rows: DataFrame) -> DataFrame:
    """45 + 9 per board + seal ratio up to 20, less 25 when it broke; best row per stock-day."""
    score = clamp(lit(45) + F.col("streak") * 9 + F.least(F.col("seal_ratio"), lit(20)) - F.when(F.col("exploded"), 25).otherwise(0), 0, 100)
    best = rows.withColumn("score", score).groupBy("code", "day").agg(F.max("score").alias("score"))
    return best.withColumn("source", F.lit("uplimit")).select(*SOURCE_COLUMNS)


def pattern_candidates(facts: DataFrame) -> DataFrame:
    hit = F.col("boll_breakout") | F.col("volume_breakout") | F.col("break_ma20") | F.col("ma_bullish")
    score = clamp(lit(40) + F.col("pattern_count") * 10, 0, 100)
    return facts.filter(hit).withColumns({"score": score, "source": F.lit("pattern")}).select(*SOURCE_COLUMNS)


def indicator_candidates(facts: DataFrame) -> DataFrame:
    hit = F.col("macd_golden") | F.col("oversold") | (F.col("macd_above_zero") & F.col("ma_bullish"))

    def plus(flag: str, n: int) -> Column:
        return F.when(F.col(flag), lit(n)).otherwise(lit(0))

    score = clamp(lit(45) + plus("macd_golden", 20) + plus("oversold", 15) + plus("ma_bullish", 10), 0, 100)
    return facts.filter(hit).withColumns({"score": score, "source": F.lit("indicator")}).select(*SOURCE_COLUMNS)


def captured_candidates(items: DataFrame, source: str) -> DataFrame:
    """A captured result list: 65 less 0.25 per rank below the first, held in [40, 65]."""
    score = clamp(lit(65) - (F.col("source_rank") - 1) * lit(0.25), 40, 65)
    return items.withColumns({"score": score, "source": F.lit(source)}).select(*SOURCE_COLUMNS)


# fixed values: scene names, horizons, targets and position caps
SCENES = {"短线爆发": (5, 0.05, 0.10), "波段反弹": (20, 0.10, 0.15), "趋势持有": (60, 0.15, 0.20)}
SHORT, SWING, TREND = SCENES


def merge_candidates(sources: Sequence[DataFrame], features: DataFrame, min_sources: int = 1, min_amount: float = 0.0) -> DataFrame:
    """Best score per (code, day, source), then three scene scores; the long-term score is not available."""
    both = reduce(lambda a, b: a.unionByName(b), sources)
    names = ("event", "uplimit", "pattern", "indicator", "recommendation")
    pivot = [F.max(F.when(F.col("source") == n, F.col("score"))).alias(f"s_{n}") for n in names]
    g = both.groupBy("code", "day").agg(*pivot)
    present = [F.when(F.col(f"s_{n}").isNotNull(), 1).otherwise(0) for n in names]
    g = g.withColumn("source_count", reduce(lambda a, b: a + b, present)).filter(F.col("source_count") >= min_sources)
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"s_{n}"), lit(0)) for n in names])
    g = g.withColumn("source_score", total / F.col("source_count"))
    f = features.select("code", "day", "close", "amount", "volume_ratio", "rsi6", "ma20", "ma60", "atr")
    j = g.join(f, ["code", "day"], "left")
    if min_amount > 0:
        j = j.filter(F.coalesce("amount", lit(0)) >= min_amount)
    base = F.least(F.col("source_count") * lit(10), lit(40))

    def part(name: str, pivot_at: float, weight: float) -> Column:
        return F.coalesce((F.col(f"s_{name}") - lit(pivot_at)) * lit(weight), lit(0))

    def bonus(cond: Column, n: float) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), lit(n)).otherwise(lit(0))

    priced = F.col("close") > 0
    wild = priced & (F.col("atr") / F.col("close") > 0.06)
    short = lit(25) + base + part("event", 50, 0.35) + part("uplimit", 40, 0.45) + part("pattern", 50, 0.20) + part("indicator", 50, 0.15)
    swing = lit(25) + base * lit(0.7) + part("event", 50, 0.15) + part("indicator", 50, 0.30)
    trend = lit(25) + base * lit(0.6) + part("uplimit", 50, 0.10) + part("pattern", 50, 0.25) + part("indicator", 50, 0.30)
    short = short + bonus(priced & (F.col("volume_ratio") >= 1.5), 8) - bonus(wild, 5)
    swing = swing + bonus(priced & (F.col("rsi6") > 0) & (F.col("rsi6") < 30), 15)
    trend = trend + bonus(priced & (F.col("ma20") > F.col("ma60")) & (F.col("close") > F.col("ma20")), 15) - bonus(wild, 12)
    j = j.withColumns(
        {"short_score": clamp(short, 0, 100), "swing_score": clamp(swing, 0, 100), "trend_score": clamp(trend, 0, 100), "long_score": lit(-1)}
    )
    best = (
        F.when((F.col("short_score") >= F.col("swing_score")) & (F.col("short_score") >= F.col("trend_score")), SHORT)
        .when(F.col("swing_score") >= F.col("trend_score"), SWING)
        .otherwise(TREND)
    )
    return j.withColumn("best_scene", best)


def advice_bands(df: DataFrame, scene: str = "best_scene") -> DataFrame:
    """Entry band of 2 percent, no-chase at 5, stop from 1.5 ATR in [3, 10] percent, target and cap by scene."""
    c = F.col("close")
    stop = F.when(F.col("atr") > 0, clamp(F.col("atr") / c * lit(1.5), 0.03, 0.10)).otherwise(lit(0.04))

    def by_scene(i: int) -> Column:
        out = F.lit(None).cast("double")
        for name, values in SCENES.items():
            out = F.when(F.col(scene) == name, lit(values[i])).otherwise(out)
        return out

    priced = c > 0
    return df.withColumns(
        {
            "buy_min": F.when(priced, c * lit(0.98)),
            "buy_max": F.when(priced, c * lit(1.02)),
            "no_chase": F.when(priced, c * lit(1.05)),
            "stop_price": F.when(priced, c * (lit(1) - stop)),
            "target_price": F.when(priced, c * (lit(1) + by_scene(1))),
            "max_hold_days": by_scene(0),
            "position_cap": by_scene(2),
            "status": F.when(F.coalesce(priced, F.lit(False)), "candidate_only").otherwise("missing_price"),
        }
    )


def capital_flow_score(df: DataFrame) -> DataFrame:
    """Additive flow rules to an adjustment and one of five levels; 'unknown' without any flow.

    The vendor's own main and retail flows are preferred over the public ones when not zero.
    """
    main1, main5 = first_non_zero("mac_main_net1", "main_net1"), first_non_zero("mac_main_net5", "main_net5")
    retail = first_non_zero("mac_retail_net1", "retail_net1", "small_net1")
    df = df.withColumns({"_m1": main1, "_m5": main5, "_rt": retail})
    c = F.col
    m1, m5, m20, f5, f20 = c("_m1"), c("_m5"), c("main_net20"), c("fund_flow5"), c("fund_flow20")
    up, down = (c("open") > 0) & (c("close") > c("open")), (c("open") > 0) & (c("close") < c("open"))
    inflow = (m1 > 0) | (m5 > 0)
    rules = [
        ((c("main_ratio") >= 0.03) | (m1 > 0), 4),
        ((c("main_ratio") <= -0.03) | (m1 < 0), -4),
        ((m5 > 0) | (f5 > 0), 3),
        ((m5 < 0) | (f5 < 0), -3),
        ((m20 > 0) | (f20 > 0), 2),
        ((m20 < 0) | (f20 < 0), -2),
        (c("super_net1") > 0, 2),
        (c("super_net1") < 0, -2),
        (c("large_net1") > 0, 1),
        (c("large_net1") < 0, -1),
        ((m1 < 0) & (c("_rt") > 0), -3),
        (up & ((m1 < 0) | (m5 < 0)), -2),
        (down & inflow, 2),
        (inflow & (c("sector_net") > 0), 2),
        (inflow & (c("sector_net") < 0), -2),
        (inflow & (c("concept_net") > 0), 1),
        (c("concept_net") < 0, -1),
    ]
    total = reduce(lambda a, b: a + b, [F.when(cond, F.lit(n)).otherwise(F.lit(0)) for cond, n in rules])
    known = any_of([x != 0 for x in (m1, m5, m20, f5, f20)])
    df = df.withColumn("adjustment", F.when(known, total).otherwise(F.lit(0)))
    a = F.col("adjustment")
    level = (
        F.when(~known, "unknown")
        .when(a >= 8, "strong_inflow")
        .when(a > 0, "inflow")
        .when(a <= -8, "strong_outflow")
        .when(a < 0, "outflow")
        .otherwise("neutral")
    )
    return df.withColumn("level", level).drop("_m1", "_m5", "_rt")
