"""The indicator vote: 44 indicators each call a bar bullish, bearish, neutral or oscillating.

Rules are CASE texts over named columns; an indicator whose columns are still missing
does not vote.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import lit
from barloom.indicators import blocks as bl
from barloom.indicators import recurrent as rc
from barloom.operators.recurrence import by_instrument, scan_blocks

PRECISION = 6
SIDES = ("bullish", "bearish", "neutral", "oscillating")


def _rule(needs: str, *cases: tuple[str, str], default: str) -> str:
    missing = " OR ".join(f"{c} IS NULL" for c in needs.split())
    whens = " ".join(f"WHEN {cond} THEN '{side}'" for cond, side in cases)
    return f"CASE WHEN {missing} THEN NULL {whens} ELSE '{default}' END"


def _above(line: str) -> str:
    return _rule(line, (f"close > {line}", "bullish"), (f"close < {line}", "bearish"), default="neutral")


def _sign(x: str, default: str = "neutral") -> str:
    return _rule(x, (f"{x} > 0", "bullish"), (f"{x} < 0", "bearish"), default=default)


def _rises(x: str) -> str:
    return _rule(f"{x} p_{x}", (f"{x} > p_{x}", "bullish"), (f"{x} < p_{x}", "bearish"), default="neutral")


def _band(up: str, low: str, default: str = "oscillating") -> str:
    return _rule(f"{up} {low}", (f"close > {up}", "bullish"), (f"close < {low}", "bearish"), default=default)


def _middle(x: str, lo: int, hi: int) -> str:
    return _rule(x, (f"{x} > {hi} OR {x} < {lo}", "oscillating"), (f"{x} > 50", "bullish"), default="bearish")


# fixed values: thresholds of the 44 votes
RULES = {
    "MA": _rule(
        "ma5 ma10 ma20 ma60",
        ("ma5 > ma10 AND ma10 > ma20 AND ma20 > ma60", "bullish"),
        ("ma5 < ma10 AND ma10 < ma20 AND ma20 < ma60", "bearish"),
        ("(ma5 > ma20 AND ma10 < ma60) OR (ma5 < ma20 AND ma10 > ma60)", "oscillating"),
        default="neutral",
    ),
    "EMA": _rule("ema12 ema21", ("ema12 > ema21", "bullish"), ("ema12 < ema21", "bearish"), default="neutral"),
    "BOLL": _rule(
        "boll_upper",
        ("close > boll_upper", "bullish"),
        ("close < boll_lower", "bearish"),
        ("close > boll_mid", "oscillating"),
        default="neutral",
    ),
    "VWAP": _above("vwap"),
    "DEMA": _above("dema_biased"),
    "TEMA": _above("tema"),
    "KAMA": _rule(
        "kama p_kama",
        ("close > kama AND kama > p_kama", "bullish"),
        ("close < kama AND kama < p_kama", "bearish"),
        default="neutral",
    ),
    "HullMA": _rises("hull"),
    "Keltner": _band("keltner_upper", "keltner_lower"),
    "SuperTrend": _sign("supertrend_dir"),
    "Ichimoku": _rule(
        "tenkan kijun span_a span_b",
        ("close > greatest(span_a, span_b) AND tenkan > kijun", "bullish"),
        ("close < least(span_a, span_b) AND tenkan < kijun", "bearish"),
        ("close >= least(span_a, span_b) AND close <= greatest(span_a, span_b)", "oscillating"),
        default="neutral",
    ),
    "SAR": _sign("sar_dir"),
    "Donchian": _rule(
        "donchian_upper",
        ("close >= donchian_upper", "bullish"),
        ("close <= donchian_lower", "bearish"),
        default="oscillating",
    ),
    "Alligator": _rule(
        "jaw teeth lips",
        ("lips > teeth AND teeth > jaw", "bullish"),
        ("lips < teeth AND teeth < jaw", "bearish"),
        default="oscillating",
    ),
    "ZigZag": _rule("zigzag_known", ("zigzag_known < 0", "bullish"), ("zigzag_known > 0", "bearish"), default="neutral"),
    "SATS": _sign("sats_dir"),
    "Pivot": _rule(
        "pivot_pp",
        ("close > pivot_r1", "bullish"),
        ("close < pivot_s1", "bearish"),
        ("close > pivot_pp", "oscillating"),
        default="neutral",
    ),
    "VWAPBands": _band("vwap_upper", "vwap_lower"),
    "MACD": _rule(
        "macd_hist",
        ("macd_dif > macd_dea AND macd_hist > 0", "bullish"),
        ("macd_dif < macd_dea AND macd_hist < 0", "bearish"),
        ("(macd_dif > 0 AND macd_hist < 0) OR (macd_dif < 0 AND macd_hist > 0)", "oscillating"),
        default="neutral",
    ),
    "RSI": _middle("rsi_cutler", 30, 70),
    "KDJ": _rule(
        "kdj_j",
        ("kdj_j > kdj_k AND kdj_k > kdj_d AND kdj_k < 80", "bullish"),
        ("kdj_j < kdj_k AND kdj_k < kdj_d AND kdj_k > 20", "bearish"),
        ("kdj_k > 80", "bearish"),
        ("kdj_k < 20", "bullish"),
        default="oscillating",
    ),
    "CCI": _rule("cci", ("cci > 100", "bullish"), ("cci < -100", "bearish"), default="oscillating"),
    "W%R": _rule("williams_r", ("williams_r < -80", "bullish"), ("williams_r > -20", "bearish"), default="oscillating"),
    "StochRSI": _rule(
        "stoch_k stoch_d",
        ("stoch_k < 20 AND stoch_d < 20 AND stoch_k > stoch_d", "bullish"),
        ("stoch_k > 80 AND stoch_d > 80 AND stoch_k < stoch_d", "bearish"),
        default="oscillating",
    ),
    "ADX": _rule(
        "adx di_plus di_minus",
        ("adx > 25 AND di_plus > di_minus", "bullish"),
        ("adx > 25 AND di_plus < di_minus", "bearish"),
        default="oscillating",
    ),
    "Aroon": _rule(
        "aroon_up aroon_down",
        ("aroon_up > 70 AND aroon_down < 30", "bullish"),
        ("aroon_down > 70 AND aroon_up < 30", "bearish"),
        default="oscillating",
    ),
    "CMO": _rule("cmo", ("cmo > 50", "bullish"), ("cmo < -50", "bearish"), default="oscillating"),
    "TRIX": _rule("trix trix_signal", ("trix > trix_signal", "bullish"), ("trix < trix_signal", "bearish"), default="neutral"),
    "ROC": _sign("roc"),
    "Coppock": _rule("coppock p_coppock", ("coppock > 0 AND p_coppock <= 0", "bullish"), ("coppock < 0", "bearish"), default="neutral"),
    "SMI": _rule(
        "smi smi_signal",
        ("smi > smi_signal AND smi > 0", "bullish"),
        ("smi < smi_signal AND smi < 0", "bearish"),
        default="oscillating",
    ),
    "AO": _rule(
        "ao p_ao",
        ("ao > 0 AND ao > p_ao", "bullish"),
        ("ao < 0 AND ao < p_ao", "bearish"),
        ("ao > 0 AND ao < p_ao", "oscillating"),
        default="neutral",
    ),
    "OBV": _rises("obv_vol0"),
    "MFI": _middle("mfi", 20, 80),
    "CMF": _rule("cmf", ("cmf > 0.05", "bullish"), ("cmf < -0.05", "bearish"), default="oscillating"),
    "A/D": _rises("ad"),
    "FI": _sign("force_index"),
    "ChaikinOsc": _rule(
        "chaikin p_chaikin",
        ("chaikin > 0 AND chaikin > p_chaikin", "bullish"),
        ("chaikin < 0 AND chaikin < p_chaikin", "bearish"),
        default="oscillating",
    ),
    "ATR": _rule("atr_wilder p_atr_wilder", ("atr_wilder > p_atr_wilder", "oscillating"), default="neutral"),
    "CHOP": _rule("chop", ("chop > 61.8", "oscillating"), default="neutral"),
    "MassIndex": _rule("mass_index p_mass_index", ("p_mass_index > 27 AND mass_index < 27", "bullish"), default="neutral"),
    "UlcerIndex": _rule("ulcer", ("ulcer < 5", "bullish"), ("ulcer > 15", "bearish"), default="neutral"),
    # the chart never counted this vote, because it looked for a number in a boolean series; it is counted here
    "TTM": _rule(
        "ttm_momentum",
        ("squeeze", "oscillating"),
        ("ttm_momentum > 0", "bullish"),
        ("ttm_momentum < 0", "bearish"),
        default="neutral",
    ),
    "ElderRay": _rule(
        "bull_power",
        ("bull_power > 0 AND bull_power > bear_power", "bullish"),
        ("bear_power < 0 AND bear_power < bull_power", "bearish"),
        default="oscillating",
    ),
}

# columns that can be missing between two values: the newest value counts
FILLED = ("vwap", "vwap_upper", "vwap_lower", "cci", "williams_r", "smi", "smi_signal", "cmf", "chop")
# columns compared with their previous value
COMPARED = ("kama", "hull", "coppock", "ao", "obv_vol0", "ad", "chaikin", "atr_wilder", "mass_index")
RECIPES = (
    "ema dema_biased tema kama keltner supertrend sar zigzag macd_sma kdj adx trix smi force chaikin atr_wilder mass ttm elder"
).split()


def _read() -> list[str]:
    """The columns that rules read, without prices, previous values and what is made of others."""
    names = re.findall(r"[a-z_][a-z0-9_]*", " ".join(re.sub(r"'[^']*'", "", x) for x in RULES.values()))
    names = [*names, "keltner_lower", "keltner_upper", "boll_lower", "boll_upper"]
    return [c for c in dict.fromkeys(names) if c not in ("close", "squeeze", "greatest", "least") and not c.startswith("p_")]


def indicator_table(df: DataFrame) -> DataFrame:
    """Every column the rules read. One exchange; two Arrow passes in the same order (the second for the self-adaptive trend)."""
    base = ["high", "low", "close"]
    fns = [rc.RECIPES[n][0] for n in RECIPES]
    settings = dict(rc.SATS)
    trend = [c for c in rc.SATS_INPUTS if c not in base]
    made = [c for c in _read() if c not in rc.SATS_OUTPUTS]
    inputs, window_columns, trend_inputs = bl.inputs, bl.window_columns, bl.trend_inputs  # functions alone go to the tasks

    def recipe(s):
        s = {**s, **inputs(s)}
        for fn in fns:
            s.update(fn(s))
        return {**s, **window_columns(s), **trend_inputs(s, settings)}

    df = scan_blocks(by_instrument(df.select("code", "day", *base, "volume")), recipe, [*base, "volume"], [*made, *trend], carry=base)
    return scan_blocks(df, rc.sats_recipe, rc.SATS_INPUTS, ["sats_dir"], carry=["close", *made], ordered=True)


def settled_table(df: DataFrame) -> DataFrame:
    """The indicator table with every number that a rule compares at one precision (sums that differ only in the last bits
    are the same level), gaps of `FILLED` closed by the newest value, and previous values; from the second bar on."""
    table = indicator_table(df)
    names = ["close", *[c for c in table.columns if c not in ("code", "day", "close")]]
    level, fill, past, at = bl.settled, bl.filled, bl.lag, np.arange

    def recipe(s):
        out = {c: level(fill(s[c]) if c in FILLED else s[c], PRECISION) for c in names}
        out |= {f"p_{c}": past(out[c], 1) for c in COMPARED}
        return {**out, "_n": np.broadcast_to(at(1.0, len(out["close"]) + 1)[:, None], out["close"].shape)}

    out = scan_blocks(table, recipe, names, [*names, *[f"p_{c}" for c in COMPARED], "_n"], ordered=True)
    return out.filter(F.col("_n") >= 2).withColumn("squeeze", rc.squeeze_on())


def vote(df: DataFrame) -> DataFrame:
    """code, day and an array of (name, side) for the indicators that vote on the bar."""
    sides = settled_table(df).select("code", "day", *[F.expr(t).alias(f"_{i}") for i, t in enumerate(RULES.values())])
    votes = [F.when(F.col(f"_{i}").isNotNull(), F.struct(F.lit(n).alias("name"), F.col(f"_{i}").alias("side"))) for i, n in enumerate(RULES)]
    return sides.select("code", "day", F.array_compact(F.array(*votes)).alias("votes"))


def summary(voted: DataFrame) -> DataFrame:
    """Counts per side and whole-number percentages."""
    sides, n = F.col("votes.side"), F.size("votes")
    counts = {s: n - F.size(F.array_remove(sides, s)) for s in SIDES}
    df = voted.select("code", "day", n.cast("long").alias("total"), *[c.cast("long").alias(s) for s, c in counts.items()])
    pct = {f"{s}_pct": F.when(F.col("total") > 0, F.floor(F.col(s) * lit(100) / F.col("total") + lit(0.5))) for s in SIDES}
    return df.withColumns({k: F.coalesce(v, F.lit(0)).cast("long") for k, v in pct.items()})
