"""Indicators that are pure window expressions over bars (one row per code and day).

Every function takes a bar DataFrame and returns it with its output columns added. All
windows share one (code, day) partitioning, so any number of them costs one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import Name, _c, lit, rnd
from barloom.operators.windows import Roll

R = Roll()
c, h, l, o, v = (Name(n) for n in ("close", "high", "low", "open", "volume"))


def typical() -> Column:
    return (h + _c(l) + _c(c)) / lit(3)


def middle() -> Column:
    return (h + _c(l)) / lit(2)


def true_range(first_bar: bool = True) -> Column:
    """True range; the first bar falls back to high - low, or null when first_bar is False."""
    pc = R.lag("close")
    full = F.greatest(h - _c(l), F.abs(h - pc), F.abs(l - pc))
    return F.when(pc.isNull(), (h - _c(l)) if first_bar else None).otherwise(full)


class Staged:
    """An indicator as levels of columns: each level may read the levels before it.

    Calling it adds its columns to a frame. `together` merges many indicators level by
    level, so that a table of dozens of them is planned as a handful of window nodes.
    Columns named with a leading underscore are dropped at the end.
    """

    def __init__(self, levels):
        self.levels = levels
        self.__doc__ = levels.__doc__

    def __call__(self, df: DataFrame, *args, **kwargs) -> DataFrame:
        return together(df, self.levels(*args, **kwargs))


def together(df: DataFrame, *indicators: list[dict[str, Column]]) -> DataFrame:
    keep = [c for c in df.columns]
    depth = max(len(levels) for levels in indicators)
    for i in range(depth):
        step: dict[str, Column] = {}
        for levels in indicators:
            if i < len(levels):
                step.update({n: x for n, x in levels[i].items() if n not in step})
        df = df.withColumns({n: x for n, x in step.items() if n not in keep})
    return df.drop(*[c for c in df.columns if c.startswith("_") and c not in keep])


# --- feature-row family ---------------------------------------------------------------------


@Staged
def moving_averages(periods: Sequence[int] = (5, 10, 20, 60)):
    return [{f"ma{p}": R.mean("close", p) for p in periods}]


@Staged
def bollinger_pop(n: int = 20, k: float = 2.0):
    mid, sd = R.mean("close", n), R.std("close", n)
    return [{"boll_mid": mid, "_boll_sd": sd}, {f"boll_{s}": F.col("boll_mid") + lit(x) * F.col("_boll_sd") for s, x in (("upper", k), ("lower", -k))}]


@Staged
def volume_ratio(n: int = 5):
    """Volume over the mean of the previous n; 1 without a full history or a positive mean."""
    past = R.base.rowsBetween(-n, -1)
    m = F.avg("volume").over(past)
    ready = (F.count("volume").over(past) == n) & (m > 0)
    return [{"volume_ratio": F.when(ready, v / m).otherwise(lit(1))}]


@Staged
def volume_ratio_display(n: int = 5):
    """Chart variant: non-positive volumes are skipped, two decimals, null without history."""
    past = R.base.rowsBetween(-n, -1)
    m = F.avg(F.when(v > 0, _c(v))).over(past)
    ready = F.count(F.lit(1)).over(past) == n
    return [{"volume_ratio_display": F.when(ready & (m > 0), rnd(v / m, 2))}]


@Staged
def atr_simple(n: int = 14):
    return [{"_tr0": true_range(False)}, {"atr_sma": R.mean("_tr0", n)}]


@Staged
def change_rates(spans: Sequence[int] = (5, 20, 60, 120)):
    def rate(n: int) -> Column:
        base = R.lag("close", n)
        return F.when(base == 0, lit(0)).otherwise(c / base - lit(1))

    return [{f"change_rate{n}": rate(n) for n in spans}]


@Staged
def log_volatility(spans: Sequence[int] = (20, 60)):
    """Population deviation of log returns, annualised; null if a base in the window is not positive."""
    pc = R.lag("close")
    return [
        {"_lr": F.when((pc > 0) & (c > 0), F.log(c / pc))},
        {f"volatility{n}": R.std("_lr", n) * lit(252**0.5) for n in spans},
    ]


@Staged
def amihud(n: int = 5):
    """Illiquidity: sum over the last n of |return| per traded value, always divided by n."""
    pc = R.lag("close")
    usable = (pc > 0) & (c > 0) & (v > 0)
    one = F.when(usable, F.abs(c / pc - lit(1)) / (c * _c(v) * lit(100)) * lit(1e10))
    total = F.coalesce(F.sum("_il").over(R.frame(n)), lit(0)) / lit(n)
    return [{"_il": one}, {"amihud": F.when(R.at() > n, total)}]


@Staged
def high_low_ratio():
    return [{"high_low_ratio": F.when(c > 0, (h - _c(l)) / _c(c)).otherwise(lit(0))}]


@Staged
def obv_zero():
    """On-balance volume starting at 0."""
    return [{"_ob0": F.coalesce(F.signum(c - R.lag("close")) * _c(v), lit(0))}, {"obv_zero": R.cum("_ob0")}]


@Staged
def obv_vol0():
    """On-balance volume starting at the first bar's volume."""
    return [{"_obv": F.coalesce(F.signum(c - R.lag("close")) * _c(v), _c(v))}, {"obv_vol0": R.cum("_obv")}]


@Staged
def fund_flow(spans: Sequence[int] = (5, 20)):
    """Rolling net inflow; partial windows count."""
    return [{f"fund_flow{n}": F.sum("net_inflow").over(R.frame(n)) for n in spans}]


# --- chart family ---------------------------------------------------------------------------


@Staged
def wma(n: int = 20):
    return [{"wma": R.wma("close", n)}]


def delta() -> Column:
    return c - R.lag("close")


@Staged
def rsi_cutler(n: int = 14):
    x = F.col("_delta")
    up, down = F.col("_rsi_up"), F.col("_rsi_dn")
    rs = F.when(down == 0, lit(100)).otherwise(lit(100) - lit(100) / (lit(1) + up / down))
    return [
        {"_delta": delta()},
        {
            "_rsi_up": R.sum(F.when(x.isNotNull(), F.greatest(x, lit(0))), n),
            "_rsi_dn": R.sum(F.when(x.isNotNull(), F.greatest(-x, lit(0))), n),
        },
        {"rsi_cutler": F.when(down.isNotNull(), rs)},
    ]


@Staged
def vwap(n: int = 20):
    return [
        {"_tp": typical(), "_vw_v": R.sum("volume", n), "_vw_pv": R.sum(typical() * _c(v), n)},
        {"vwap": F.when(F.col("_vw_v") > 0, F.col("_vw_pv") / F.col("_vw_v"))},
    ]


@Staged
def vwap_bands(n: int = 20, k: float = 2.0):
    """Volume-weighted deviation around the current VWAP, expanded into three window sums.

    E[x^2] - 2mE[x] + m^2 instead of a second pass; a zero volume weighs 1.
    """
    w = F.when(_c(v) == 0, lit(1)).otherwise(_c(v))
    m, sd = F.col("vwap"), F.col("_vb_sd")
    var = (F.col("_vb_2") - lit(2) * m * F.col("_vb_1")) / F.col("_vb_0") + m * m
    first, second = vwap.levels(n)
    first = {**first, "_vb_0": R.sum(w, n), "_vb_1": R.sum(w * typical(), n), "_vb_2": R.sum(w * typical() * typical(), n)}
    return [
        first,
        second,
        {"_vb_sd": F.sqrt(F.greatest(var, lit(0)))},
        {"vwap_upper": m + lit(k) * sd, "vwap_lower": m - lit(k) * sd},
    ]


@Staged
def mfi(n: int = 14):
    tp, p = F.col("_tp"), F.col("_tp1")
    neg, pos = F.col("_mf_dn"), F.col("_mf_up")
    val = F.when(neg == 0, lit(100)).otherwise(lit(100) - lit(100) / (lit(1) + pos / neg))
    return [
        {"_tp": typical(), "_tp1": R.lag(typical())},
        {
            "_mf_up": R.sum(F.when(tp > p, tp * _c(v)).when(p.isNotNull(), lit(0)), n),
            "_mf_dn": R.sum(F.when(tp < p, tp * _c(v)).when(p.isNotNull(), lit(0)), n),
        },
        {"mfi": F.when(neg.isNotNull(), val)},
    ]


@Staged
def ichimoku(tenkan: int = 9, kijun: int = 26, span_b: int = 52):
    """Chikou reads the close `kijun` bars ahead: a look-ahead column."""

    def mid(n: int) -> Column:
        return (R.max("high", n) + R.min("low", n)) / lit(2)

    return [
        {"tenkan": mid(tenkan), "kijun": mid(kijun), "span_b": mid(span_b), "chikou": R.lead("close", kijun)},
        {"span_a": (F.col("tenkan") + F.col("kijun")) / lit(2)},
    ]


@Staged
def cci(n: int = 20):
    """Mean absolute deviation is about the current mean, so the window's values are kept."""
    m = F.col("_cci_m")
    dev = F.aggregate("_cci_w", lit(0), lambda a, x: a + F.abs(x - m)) / lit(n)
    val = F.when(F.col("_cci_d") > 0, (typical() - m) / (lit(0.015) * F.col("_cci_d")))
    return [
        {"_cci_m": R.mean(typical(), n), "_cci_w": F.collect_list(typical()).over(R.frame(n))},
        {"_cci_d": dev},
        {"cci": val},
    ]


@Staged
def donchian(n: int = 20):
    return [
        {"donchian_upper": R.max("high", n), "donchian_lower": R.min("low", n)},
        {"donchian_mid": (F.col("donchian_upper") + F.col("donchian_lower")) / lit(2)},
    ]


@Staged
def williams_r(n: int = 14):
    hi, lo = F.col("_hi14"), F.col("_lo14")
    return [
        {"_hi14": R.max("high", n), "_lo14": R.min("low", n)},
        {"williams_r": F.when(hi > lo, (hi - _c(c)) / (hi - lo) * lit(-100))},
    ]


@Staged
def stoch_rsi(n: int = 14, k: int = 3, d: int = 3):
    rsi = [dict(level) for level in rsi_cutler.levels(n)]
    rsi[2]["_srsi"] = rsi[2].pop("rsi_cutler")
    hi, lo = F.col("_sr_hi"), F.col("_sr_lo")
    raw = F.when(hi == lo, lit(0)).otherwise((F.col("_srsi") - lo) / (hi - lo) * lit(100))
    return [
        *rsi,
        {"_sr_hi": R.max("_srsi", n), "_sr_lo": R.min("_srsi", n)},
        {"_sr": F.when(hi.isNotNull(), raw)},
        {"stoch_k": R.mean("_sr", k)},
        {"stoch_d": R.mean("stoch_k", d)},
    ]


def money_flow_multiplier() -> Column:
    return F.when(h > l, ((c - _c(l)) - (h - _c(c))) / (h - _c(l))).otherwise(lit(0))


@Staged
def cmf(n: int = 20):
    return [
        {"_cmf_v": R.sum("volume", n), "_cmf_m": R.sum(money_flow_multiplier() * _c(v), n)},
        {"cmf": F.when(F.col("_cmf_v") > 0, F.col("_cmf_m") / F.col("_cmf_v"))},
    ]


@Staged
def aroon(n: int = 25):
    """Bars since the extreme of the last n; ties take the most recent bar."""
    i = F.col("_i")

    def score(at: str) -> Column:
        return F.when(i >= n, (lit(n - 1) - (i - F.col(at)["_i"])) / lit(n - 1) * lit(100))

    return [
        {"_i": R.at().cast("double")},
        {
            "_ar_t": F.max(F.struct("high", "_i")).over(R.frame(n)),
            "_ar_b": F.max(F.struct((-l).alias("x"), "_i")).over(R.frame(n)),
        },
        {"aroon_up": score("_ar_t"), "aroon_down": score("_ar_b")},
    ]


@Staged
def cmo(n: int = 14):
    x, up, dn = F.col("_delta"), F.col("_cmo_up"), F.col("_cmo_dn")
    val = F.when(up + dn > 0, (up - dn) / (up + dn) * lit(100)).otherwise(lit(0))
    return [
        {"_delta": delta()},
        {
            "_cmo_up": R.sum(F.when(x > 0, x).when(x.isNotNull(), lit(0)), n),
            "_cmo_dn": R.sum(F.when(x > 0, lit(0)).when(x.isNotNull(), -x), n),
        },
        {"cmo": F.when(up.isNotNull(), val)},
    ]


@Staged
def pivot_points():
    ph, pl, p = F.col("_h1"), F.col("_l1"), F.col("pivot_pp")
    return [
        {"_h1": R.lag("high"), "_l1": R.lag("low"), "pivot_pp": R.lag(typical())},
        {
            "pivot_r1": lit(2) * p - pl,
            "pivot_s1": lit(2) * p - ph,
            "pivot_r2": p + (ph - pl),
            "pivot_s2": p - (ph - pl),
        },
    ]


@Staged
def alligator(lens=(13, 8, 5), shifts=(8, 5, 3)):
    names = ("jaw", "teeth", "lips")
    return [
        {f"_al{i}": R.mean(middle(), n) for i, n in enumerate(lens)},
        {names[i]: R.lag(f"_al{i}", s) for i, s in enumerate(shifts)},
    ]


@Staged
def awesome(fast: int = 5, slow: int = 34):
    return [{"ao": R.mean(middle(), fast) - R.mean(middle(), slow)}]


@Staged
def hull(n: int = 9):
    return [{"_hull": lit(2) * R.wma("close", n // 2) - R.wma("close", n)}, {"hull": R.wma("_hull", int(n**0.5))}]


@Staged
def accumulation():
    return [{"ad": R.cum(money_flow_multiplier() * _c(v))}]


def _roc(n: int) -> Column:
    base = R.lag("close", n)
    return F.when(base != 0, (c - base) / base * lit(100))


@Staged
def roc(n: int = 12):
    return [{"roc": _roc(n)}]


@Staged
def coppock(n: int = 10, long: int = 14, short: int = 11):
    return [{"_cop": _roc(long) + _roc(short)}, {"coppock": R.wma("_cop", n)}]


@Staged
def swing_points(n: int, high_name: str, low_name: str):
    """Strict local extremes over n bars on both sides: look-ahead by n bars."""
    before, after = R.base.rowsBetween(-n, -1), R.base.rowsBetween(1, n)
    inside = (F.count(F.lit(1)).over(before) == n) & (F.count(F.lit(1)).over(after) == n)
    top = inside & (h > F.max("high").over(before)) & (h > F.max("high").over(after))
    low = inside & (l < F.min("low").over(before)) & (l < F.min("low").over(after))
    return [{high_name: F.when(top, _c(h)), low_name: F.when(low, _c(l))}]


def fractals(df: DataFrame, n: int = 2) -> DataFrame:
    return swing_points(df, n, "fractal_high", "fractal_low")


@Staged
def choppiness(n: int = 14):
    hi, lo = F.col("_ch_hi"), F.col("_ch_lo")
    ok = (h - F.col("_ch_l") > 0) & (hi > lo)
    return [
        {"_tr1": true_range(True)},
        {"_ch_hi": R.max("high", n), "_ch_lo": R.min("low", n), "_ch_tr": R.sum("_tr1", n), "_ch_l": R.lag("low", n - 1)},
        {"chop": F.when(ok, lit(100) * F.log(F.col("_ch_tr") / (hi - lo)) / F.log(lit(n)))},
    ]


@Staged
def ulcer(n: int = 14):
    """Root mean square drawdown from the window's single maximum, with the window sums expanded."""
    m = F.col("_ul_m")
    q = F.col("_ul_2") / (m * m) - lit(2) * F.col("_ul_1") / m + lit(n)
    return [
        {"_ul_m": R.max("close", n), "_ul_1": R.sum("close", n), "_ul_2": R.sum(c * _c(c), n)},
        {"ulcer": F.when(m.isNotNull(), F.sqrt(F.greatest(q, lit(0)) * lit(10000) / lit(n)))},
    ]


def amplitude(df: DataFrame, spans: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Average amplitude: the bar's own column where present, else (high - low) / open."""
    own = F.col("amplitude") if "amplitude" in df.columns else F.lit(None).cast("double")
    one = F.coalesce(own, F.when(o > 0, (h - _c(l)) / _c(o) * lit(100)))
    return together(df, [{"_amp": one}, {f"amplitude{n}": R.mean("_amp", n) for n in spans}])


def ma_map(df: DataFrame, periods: Sequence[int] = (5, 10, 20, 30, 60), digits: int = 2) -> DataFrame:
    """Map of period to rounded mean, holding only periods that are warm."""
    pairs = [F.struct(F.lit(p).alias("k"), rnd(R.mean("close", p), digits).alias("v")) for p in periods]
    entries = F.filter(F.array(*pairs), lambda e: e["v"].isNotNull())
    return df.withColumn("ma", F.map_from_entries(entries))


def fair_value_gaps(df: DataFrame) -> DataFrame:
    """Bars with the zone columns of a three-bar gap that ends on them (null elsewhere)."""
    df = df.withColumns({"_h2": R.lag("high", 2), "_l2": R.lag("low", 2), "idx": R.at().cast("long")})
    h2, l2 = F.col("_h2"), F.col("_l2")
    return df.withColumns(
        {
            "zone_bull": F.when(l > h2, lit(1)).when(h < l2, lit(-1)),
            "zone_top": F.when(l > h2, _c(l)).when(h < l2, l2),
            "zone_bottom": F.when(l > h2, h2).when(h < l2, _c(h)),
        }
    ).drop("_h2", "_l2")


def order_blocks(df: DataFrame, max_atr: float = 3.0) -> DataFrame:
    """Bars with the zone of the reversal candle before them that they take out.

    Needs the column atr_wilder; a block is at most max_atr ATR tall. `idx` is the
    block's own bar, one before the row's.
    """
    df = df.withColumns({f"_p{x}": R.lag(x) for x in ("open", "high", "low", "close")})
    df = df.withColumn("idx", R.at().cast("long") - 1)
    po, ph, pl, pc = (F.col(f"_p{x}") for x in ("open", "high", "low", "close"))
    bull, bear = (c > ph) & (pc < po), (c < pl) & (pc > po)
    top = F.when(bull, F.greatest(po, pc)).when(bear, ph)
    bottom = F.when(bull, pl).when(bear, F.least(po, pc))
    atr = F.coalesce(F.col("atr_wilder"), lit(0))
    keep = (top - bottom <= lit(max_atr) * atr) | (atr == 0)
    return df.withColumns(
        {
            "zone_bull": F.when(keep & bull, lit(1)).when(keep & bear, lit(-1)),
            "zone_top": F.when(keep, top),
            "zone_bottom": F.when(keep, bottom),
        }
    ).drop("_popen", "_phigh", "_plow", "_pclose")
