"""Indicators whose value depends on their own past.

`with_inputs` makes everything windows can make; each recipe holds only the state machine.
"""

from __future__ import annotations

from collections.abc import Sequence

from heapq import heappop, heappush

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import lit
from barloom.indicators import rolling as ro
from barloom.operators.recurrence import LENGTHS, before, blend, by_instrument, ema, ema_from, extreme, partial, rma, rolling, rolling_std, scan, scan_blocks, wilder_sum

R = ro.R


def input_columns() -> dict[str, Column]:
    """Window-made inputs of the recipes, by name; unused ones are pruned."""
    d = F.col("close") - R.lag("close")
    hi9, lo9 = R.max("high", 9), R.min("low", 9)
    hi14, lo14 = R.max("high", 14), R.min("low", 14)
    up, down = F.col("high") - R.lag("high"), R.lag("low") - F.col("low")
    return {
        "tr": ro.true_range(True),
        "gain": F.when(d > 0, d).when(d.isNotNull(), lit(0)),
        "loss": F.when(d < 0, -d).when(d.isNotNull(), lit(0)),
        "tp": ro.typical(),
        "rsv": F.when(hi9 == lo9, lit(50)).otherwise((F.col("close") - lo9) / (hi9 - lo9) * lit(100)),
        "force_raw": F.coalesce(d * F.col("volume"), lit(0)),
        "hl_range": F.col("high") - F.col("low"),
        "smi_raw": F.when(hi14 != lo14, lit(200) * ((F.col("close") - (hi14 + lo14) / lit(2)) / (hi14 - lo14))),
        "abs_d": F.abs(d),
        "plus_dm": F.when((up > down) & (up > 0), up).otherwise(lit(0)),
        "minus_dm": F.when((down > up) & (down > 0), down).otherwise(lit(0)),
        "mfv": ro.money_flow_multiplier() * F.col("volume"),
    }


def with_inputs(df: DataFrame) -> DataFrame:
    df = df.withColumns(input_columns())
    path = F.sum("abs_d").over(R.frame(10))
    er = F.when(path > 0, F.abs(F.col("close") - R.lag("close", 10)) / path).otherwise(lit(0))
    return df.withColumns({"er10": er, "ad_line": R.cum("mfv")})


# --- recipes: a block of series in, blocks out (see `scan_blocks`) ------------------------------


def _rsi(period: int):
    def recipe(s):
        up, dn = rma(s["gain"], period), rma(s["loss"], period)
        value = np.where(dn == 0, np.where(up == 0, 50.0, 100.0), 100 - 100 / (1 + up / dn))
        return {f"rsi{period}_wilder": np.where(np.isnan(up) | np.isnan(dn), np.nan, value)}

    return recipe


def _macd_x0(s):
    dif = ema_from(s["close"], 12) - ema_from(s["close"], 26)
    hist = 2 * (dif - ema_from(dif, 9, 0.0))
    hist[:25] = np.nan
    return {"macd_x0": hist}


def _kdj(s):
    k = blend(s["rsv"], 50.0)
    d = blend(k, 50.0)
    return {"kdj_k": k, "kdj_d": d, "kdj_j": 3 * k - 2 * d}


def _macd_sma(s):
    dif = ema(s["close"], 12) - ema(s["close"], 26)
    dea = ema(dif, 9, leading=True)
    return {"macd_dif": dif, "macd_dea": dea, "macd_hist": 2 * (dif - dea)}


def _kama(s, period=10, fast=2, slow=30):
    f, w, out = 2 / (fast + 1), 2 / (slow + 1), np.full_like(s["close"], np.nan)
    for i, (c, er) in enumerate(zip(s["close"], s["er10"])):
        if i == period:
            out[i] = c
        elif i > period:
            out[i] = out[i - 1] + (er * (f - w) + w) ** 2 * (c - out[i - 1])
    return {"kama": out}


def _keltner(s, mult=1.5):
    mid, atr = ema(s["close"], 20), rma(s["tr"], 10)
    return {"keltner_mid": mid, "keltner_upper": mid + mult * atr, "keltner_lower": mid - mult * atr}


def _supertrend(s, mult=3.0):
    up = low = last = np.full(s["close"].shape[1], np.nan)
    side = np.zeros(s["close"].shape[1])
    line, sides = np.empty_like(s["close"]), np.empty_like(s["close"])
    for t, (h, l, c, atr) in enumerate(zip(s["high"], s["low"], s["close"], rma(s["tr"], 10))):
        there = ~np.isnan(atr)
        raw_up, raw_low = (h + l) / 2 + mult * atr, (h + l) / 2 - mult * atr
        raw_up = np.where(last <= up, np.minimum(raw_up, up), raw_up)
        raw_low = np.where(last >= low, np.maximum(raw_low, low), raw_low)
        up, low, last = np.where(there, raw_up, up), np.where(there, raw_low, low), c
        crossed = np.where(side == 1, c < low, c > up)
        turned = np.where(side == 0, 1, np.where(crossed, -side, side))
        side = np.where(there, turned, side)
        line[t] = np.where(there, np.where(side == 1, low, up), np.nan)
        sides[t] = np.where(there, side, 0)
    return {"supertrend": line, "supertrend_dir": sides}


def _sar(s, inc=0.02, top=0.2):
    """Extremes are kept signed by side, so that one update serves both directions."""
    hs, ls, cs = s["high"], s["low"], s["close"]
    value, sides = np.full_like(cs, np.nan), np.zeros_like(cs)
    if len(cs) < 2:
        return {"sar": value, "sar_dir": sides}
    side = np.where(cs[1] > cs[0], 1.0, -1.0)
    extreme, speed, at = np.where(side == 1, hs[1], ls[1]), np.full(cs.shape[1], inc), np.where(side == 1, ls[0], hs[0])
    value[1], sides[1] = at, side
    for i in range(2, len(cs)):
        rising = side == 1
        lead, trail = np.where(rising, hs[i], ls[i]), np.where(rising, ls[i], hs[i])
        at = at + speed * (extreme - at)
        at = np.where(rising, np.minimum(np.minimum(at, ls[i - 1]), ls[i - 2]), np.maximum(np.maximum(at, hs[i - 1]), hs[i - 2]))
        flip = (trail - at) * side < 0
        on = ~flip & ((lead - extreme) * side > 0)
        at, extreme = np.where(flip, extreme, at), np.where(flip, trail, np.where(on, lead, extreme))
        speed, side = np.where(flip, inc, np.where(on, np.minimum(speed + inc, top), speed)), np.where(flip, -side, side)
        value[i], sides[i] = at, side
    return {"sar": value, "sar_dir": sides}


def _adx(s, n=14):
    tr, up, dn = (wilder_sum(s[k], n) for k in ("tr", "plus_dm", "minus_dm"))
    plus, minus = (np.where(tr > 0, 100 * x / tr, np.nan) for x in (up, dn))
    dx = np.where(plus + minus > 0, 100 * np.abs(plus - minus) / (plus + minus), 0.0)
    dx[: n - 1] = np.nan
    return {"di_plus": plus, "di_minus": minus, "adx": rma(dx, n)}


def _dema(s, n=21):
    first = ema(s["close"], n)
    return {"dema": 2 * first - ema(first, n)}


def _dema_biased(s, n=21):
    """The chart's variant: the second average starts on zeros."""
    first = ema(s["close"], n)
    return {"dema_biased": 2 * first - ema(np.where(np.isnan(first), 0.0, first), n)}


def _tema(s, n=21):
    a = ema(s["close"], n)
    b = ema(a, n)
    return {"tema": 3 * a - 3 * b + ema(b, n)}


def _trix(s, n=15):
    x = ema(ema(ema(s["close"], n), n), n)
    past = before(x)
    t = np.where(past != 0, (x - past) / past * 10000, np.nan)
    return {"trix": t, "trix_slope": t - before(t), "trix_signal": ema(t, 9, leading=True)}


def _elder(s, n=13):
    e = ema(s["close"], n)
    return {"bull_power": s["high"] - e, "bear_power": s["low"] - e}


def _chaikin(s):
    return {"chaikin": ema(s["ad_line"], 3) - ema(s["ad_line"], 10)}


def _mass(s, n=9):
    a = ema(s["hl_range"], n)
    b = ema(a, n)
    return {"mass_ratio": ema(np.where(b != 0, a / b, np.nan), n)}


def _smi(s):
    line = ema(s["smi_raw"], 3)
    return {"smi": line, "smi_signal": ema(line, 3)}


def _ttm(s):
    return {"ttm_momentum": s["tp"] - ema(s["tp"], 20)}


def run(df: DataFrame, names: Sequence[str], carry: Sequence[str] = (), prepared: bool = False) -> DataFrame:
    """Run the named recipes over bars in one pass over blocks of instruments."""
    chosen = [RECIPES[n] for n in names]
    inputs = sorted({i for _, ins, _ in chosen for i in ins})
    outputs = [o for _, _, outs in chosen for o in outs]
    fns = [fn for fn, _, _ in chosen]

    def recipe(s):
        made = {}
        for fn in fns:
            made.update(fn(s))
        return made

    ready = df if prepared else with_inputs(by_instrument(df))
    return scan_blocks(ready, recipe, inputs, outputs, carry=carry)


def mass_index(df: DataFrame, n: int = 25) -> DataFrame:
    return run(df, ["mass"]).withColumn("mass_index", R.sum("mass_ratio", n))


def ttm_squeeze(df: DataFrame, carry: Sequence[str] = ("close",)) -> DataFrame:
    df = ro.bollinger_pop(run(df, ["keltner", "ttm"], carry=carry))
    return df.withColumn("squeeze", squeeze_on())


def squeeze_on() -> Column:
    on = (F.col("boll_lower") >= F.col("keltner_lower")) & (F.col("boll_upper") <= F.col("keltner_upper"))
    return F.coalesce(on, F.lit(False))


# --- self-adaptive trend -----------------------------------------------------------------------

# fixed values: the strategy's default parameters
SATS = {
    "atr_len": 14,
    "base_mult": 2.0,
    "er_len": 20,
    "adapt": 0.5,
    "baseline_len": 100,
    "quality": 0.4,
    "curve": 1.5,
    "asym": 0.5,
    "flip_age": 5,
    "flip_high": 0.55,
    "flip_low": 0.25,
    "w_er": 0.35,
    "w_vol": 0.20,
    "w_struct": 0.25,
    "w_mom": 0.20,
    "struct_len": 20,
    "mom_len": 10,
    "vol_len": 20,
    "smooth": 0.15,
}


def sats_inputs(df: DataFrame) -> DataFrame:
    """Quality index and raw band multipliers, by windows. Needs the column atr_wilder.

    The 100-bar ATR baseline counts the ATR's warm-up bars as 0, as the chart does.
    """
    p = SATS
    df = df.withColumns(
        {
            "_d": F.col("close") - R.lag("close"),
            "_i": R.at(),
            "_a0": F.coalesce(F.col("atr_wilder"), lit(0)),
        }
    )

    def unit(x: Column) -> Column:
        return F.greatest(lit(0), F.least(lit(1), x))

    path = R.sum(F.abs(F.col("_d")), p["er_len"])
    er = F.when(path != 0, F.abs(F.col("close") - R.lag("close", p["er_len"])) / path).otherwise(lit(0))
    vm, vs = R.mean("volume", p["vol_len"]), R.std("volume", p["vol_len"])
    base = R.mean("_a0", p["baseline_len"])
    z = F.when(vs != 0, (F.col("volume") - vm) / vs).otherwise(lit(0))
    ratio = F.when(base != 0, F.col("atr_wilder") / base).otherwise(lit(1))
    by_volume = (F.col("volume") > 0) & (F.col("_i") > p["vol_len"])
    vol = F.when(by_volume, unit((z + lit(1)) / lit(3))).otherwise(unit((ratio - lit(0.6)) / lit(1.2)))
    hi, lo = R.max("high", p["struct_len"]), R.min("low", p["struct_len"])
    pos = F.when(hi != lo, (F.col("close") - lo) / (hi - lo)).otherwise(lit(0.5))
    struct = F.when(F.col("_i") > p["struct_len"], unit(F.abs(pos - lit(0.5)) * lit(2))).otherwise(lit(0))
    turn = F.col("close") - R.lag("close", p["mom_len"])
    ups = R.sum((F.col("_d") > 0).cast("double"), p["mom_len"])
    downs = R.sum((F.col("_d") < 0).cast("double"), p["mom_len"])
    mom = F.when(turn > 0, ups).when(turn < 0, downs).otherwise(lit(0)) / lit(p["mom_len"])
    ready = F.col("atr_wilder").isNotNull() & base.isNotNull()
    df = df.withColumns({"_er": er, "_q": vol, "_st": struct, "_mo": mom, "sats_ok": ready.cast("double")})
    tqi = unit(
        F.col("_er") * lit(p["w_er"])
        + F.col("_q") * lit(p["w_vol"])
        + F.col("_st") * lit(p["w_struct"])
        + F.col("_mo") * lit(p["w_mom"])
    )
    df = df.withColumn("sats_quality", F.when(F.col("sats_ok") == 1, tqi).otherwise(lit(0)))
    q = F.col("sats_quality")
    shape = lit(1 - p["quality"]) + lit(p["quality"]) * (lit(0.6) + lit(0.8) * F.pow(lit(1) - q, lit(p["curve"])))
    sym = lit(p["base_mult"]) * (lit(1) + lit(p["adapt"]) * (lit(0.5) - F.col("_er"))) * shape
    return df.withColumns(
        {
            "sats_active": sym * (lit(1) - lit(p["asym"]) * q * lit(0.3)),
            "sats_passive": sym * (lit(1) + lit(p["asym"]) * q * lit(0.4)),
            "sats_atr": F.col("atr_wilder") * (lit(0.5) + lit(0.5) * F.col("_er")),
        }
    ).drop("_d", "_i", "_a0", "_er", "_q", "_st", "_mo")


SATS_INPUTS = ("sats_active", "sats_passive", "sats_atr", "sats_quality", "sats_ok", "high", "low", "close")
SATS_OUTPUTS = ("sats_dir", "sats_line", "sats_upper", "sats_lower")


def sats_recipe(s):
    p, a, shape = SATS, SATS["smooth"], s["close"].shape
    act = pas = low = up = last = np.full(shape[1], np.nan)
    side, started, past_q = np.zeros(shape[1]), np.zeros(shape[1]), np.zeros(shape[1])
    out = {n: np.full(shape, np.nan) for n in SATS_OUTPUTS}
    rows = zip(*(s[n] for n in SATS_INPUTS))
    for i, (r_act, r_pas, atr, q, ok, h, l, c) in enumerate(rows):
        ok = ok == 1
        act = np.where(ok, np.where(np.isnan(act), r_act, act * (1 - a) + r_act * a), act)
        pas = np.where(ok, np.where(np.isnan(pas), r_pas, pas * (1 - a) + r_pas * a), pas)
        held = np.where(side == 0, 1, side)
        near, far = np.where(held == 1, act, pas), np.where(held == 1, pas, act)
        n_low, n_up = (h + l) / 2 - near * atr, (h + l) / 2 + far * atr
        n_low = np.where(last > low, np.maximum(n_low, low), n_low)
        n_up = np.where(last < up, np.minimum(n_up, up), n_up)
        faded = (past_q > p["flip_high"]) & (q < p["flip_low"]) & (i - started >= p["flip_age"])
        crossed = ((side == 1) & (c < low)) | ((side == -1) & (c > up))
        new = np.where((side != 0) & (crossed | (faded & ((c - last) * held < 0))), -held, held)
        started = np.where(ok & (new != held), i, started)
        side, low, up = np.where(ok, new, side), np.where(ok, n_low, low), np.where(ok, n_up, up)
        out["sats_dir"][i] = np.where(ok, side, 0)
        for n, v in (("sats_line", np.where(side == 1, low, up)), ("sats_upper", up), ("sats_lower", low)):
            out[n][i] = np.where(ok, v, np.nan)
        last, past_q = c, q
    return out


def sats(df: DataFrame) -> DataFrame:
    """Self-adaptive trend: direction, line and bands."""
    bars = run(df, ["atr_wilder"], carry=("high", "low", "close", "volume"))
    return scan_blocks(sats_inputs(bars), sats_recipe, SATS_INPUTS, SATS_OUTPUTS, carry=("sats_quality",))


# --- the feature row ----------------------------------------------------------------------------

FEATURE_INPUTS = ("high", "low", "close", "volume")


def feature_recipe(s):
    """Every indicator of the feature row that its inputs allow, as `rolling` defines them one by one.

    A frame of n bars costs n additions of whole blocks here, and n visits a row and function in a window.
    """
    c = s["close"]
    past = before(c)
    d = c - past
    out = {f"ma{n}": rolling(c, n) / n for n in (5, 10, 20, 60)}
    sd = rolling_std(c, 20)
    out |= {"boll_mid": out["ma20"], "boll_upper": out["ma20"] + 2.0 * sd, "boll_lower": out["ma20"] + -2.0 * sd}
    for n in (5, 20, 60, 120):
        base = np.full_like(c, np.nan)
        base[n:] = c[: max(0, len(c) - n)]
        out[f"change_rate{n}"] = np.where(base == 0, 0.0, c / base - 1)
    change = np.where((past > 0) & (c > 0), np.log(c / past), np.nan)
    out |= {f"volatility{n}": rolling_std(change, n) * 252**0.5 for n in (20, 60)}
    if "volume" in s:
        v = s["volume"]
        mean = before(rolling(v, 5) / 5)
        out["volume_ratio"] = np.where(mean > 0, v / mean, 1.0)
        illiquid = np.where((past > 0) & (c > 0) & (v > 0), np.abs(c / past - 1) / (c * v * 100) * 1e10, np.nan)
        out["amihud"] = np.nan_to_num(partial(illiquid, 5)) / 5
        out["amihud"][:5] = np.nan
        flow = np.sign(d) * v
        out["obv_zero"] = np.cumsum(np.where(np.isnan(flow), 0.0, flow), axis=0)
    out["bar_no"] = np.broadcast_to(np.arange(1.0, len(c) + 1)[:, None], c.shape)
    known = ~np.isnan(d)
    moves = {"gain": np.where(d > 0, d, np.where(known, 0.0, np.nan)), "loss": np.where(d < 0, -d, np.where(known, 0.0, np.nan))}
    for n in (6, 12, 14):
        out |= _rsi(n)(moves)
    out |= _macd_x0(s)
    if "high" in s and "low" in s:
        h, l = s["high"], s["low"]
        tr = np.where(np.isnan(past), np.nan, np.fmax(np.fmax(h - l, np.abs(h - past)), np.abs(l - past)))
        out["atr_sma"] = rolling(tr, 14) / 14
        out["high_low_ratio"] = np.where(c > 0, (h - l) / c, 0.0)
        hi, lo = extreme(h, 9, np.maximum), extreme(l, 9, np.minimum)
        out["kdj_k"] = blend(np.where(hi == lo, 50.0, (c - lo) / (hi - lo) * 100), 50.0)
    if "net_inflow" in s:
        out |= {f"fund_flow{n}": partial(s["net_inflow"], n) for n in (5, 20)}
    return out


# --- swing structure ----------------------------------------------------------------------------


def _breaks(s):
    """Kind per bar and side: 0 none, 1 continuation, 2 reversal; a high goes before a low."""
    out = {f"{t}_{f}": [] for t in ("up", "dn") for f in ("kind", "from", "price")}
    seen = {1: (None, None), -1: (None, None)}
    trend = 0
    for i, (hi, lo) in enumerate(zip(s["swing_high"], s["swing_low"])):
        for tag, x, sign in (("up", hi, 1), ("dn", lo, -1)):
            at, level = seen[sign]
            broke = x is not None and at is not None and (x - level) * sign > 0
            kind = 0 if not broke or trend == 0 else (1 if trend == sign else 2)
            if broke:
                trend = sign
            if x is not None:
                seen[sign] = (i + 1, x)
            out[f"{tag}_kind"].append(kind)
            out[f"{tag}_from"].append(at)
            out[f"{tag}_price"].append(level)
    return out


def _both_breaks(s):
    """Two trend machines over one pass of an instrument's bars: swing points of either size, each with its own trend."""
    return {f"{size}_{k}": v for size in ("short", "long") for k, v in _breaks({"swing_high": s[f"{size}_high"], "swing_low": s[f"{size}_low"]}).items()}


def structure_lines(df: DataFrame, short: int = 5, long: int = 50) -> DataFrame:
    """Break lines of the internal and of the swing structure, as intervals with both ends; `size` tells them apart.

    Like `structure_breaks`, both in one pass: (code, day, size, from_idx, to_idx, from_price, to_price, kind, bull).
    """
    pts = ro.swing_points(by_instrument(df), short, "short_high", "short_low")
    pts = ro.swing_points(pts, long, "long_high", "long_low").withColumn("to_idx", R.at().cast("long"))
    points = [f"{size}_{side}" for size in ("short", "long") for side in ("high", "low")]
    outs = [f"{size}_{t}_{f}" for size in ("short", "long") for t in ("up", "dn") for f in ("kind", "from", "price")]
    ran = scan(pts, _both_breaks, points, outs, carry=("to_idx", *points))
    each = [
        F.struct(F.lit(n).alias("size"), *[F.col(f"{size}_{t}_{f}").alias(f) for f in ("kind", "from", "price")], F.col(f"{size}_{side}").alias("to"), F.lit(t == "up").alias("bull"))
        for size, n in (("short", short), ("long", long))
        for t, side in (("up", "high"), ("dn", "low"))
    ]
    lines = ran.select("code", "day", "to_idx", F.explode(F.array(*each)).alias("x")).filter(F.col("x.kind") > 0)
    kind = F.when(F.col("x.kind") == 2, "choch").otherwise("bos")
    return lines.select("code", "day", "x.size", F.col("x.from").cast("long").alias("from_idx"), "to_idx", F.col("x.price").alias("from_price"), F.col("x.to").alias("to_price"), kind.alias("kind"), "x.bull")


def structure_breaks(df: DataFrame, n: int = 5) -> DataFrame:
    """Break-of-structure and change-of-character lines from swing points (look-ahead by n bars).

    One row per line: the swing it breaks, the bar that breaks it, its kind and side.
    """
    pts = ro.swing_points(by_instrument(df), n, "swing_high", "swing_low").withColumn("to_idx", R.at().cast("long"))
    outs = [f"{t}_{f}" for t in ("up", "dn") for f in ("kind", "from", "price")]
    ran = scan(pts, _breaks, ["swing_high", "swing_low"], outs, carry=("to_idx", "swing_high", "swing_low"))

    def line(tag: str, point: str, bull: bool) -> Column:
        parts = [F.col(f"{tag}_{f}").alias(f) for f in ("kind", "from", "price")]
        return F.struct(*parts, F.col(point).alias("to"), F.lit(bull).alias("bull"))

    lines = F.array(line("up", "swing_high", True), line("dn", "swing_low", False))
    return (
        ran.select("code", "day", "to_idx", F.explode(lines).alias("x"))
        .filter(F.col("x.kind") > 0)
        .select(
            "code",
            "day",
            "to_idx",
            F.col("x.from").cast("long").alias("from_idx"),
            F.col("x.price").alias("from_price"),
            F.col("x.to").alias("to_price"),
            F.when(F.col("x.kind") == 2, "choch").otherwise("bos").alias("kind"),
            F.col("x.bull").alias("bull"),
        )
    )


def _mitigation(s):
    """Bar number of the first later bar that crosses each zone: open zones wait in two heaps, nearest edge first."""
    out = [None] * len(s["high"])
    rising, falling = [], []
    for i, (hi, lo, bull, top, bottom) in enumerate(zip(s["high"], s["low"], s["zone_bull"], s["zone_top"], s["zone_bottom"])):
        while rising and lo <= -rising[0][0]:
            out[heappop(rising)[1]] = i + 1
        while falling and hi >= falling[0][0]:
            out[heappop(falling)[1]] = i + 1
        if bull is not None:
            heappush(rising, (-bottom, i)) if bull > 0 else heappush(falling, (top, i))
    return {"mitigated_idx": out}


def zones(df: DataFrame) -> DataFrame:
    """One row per zone with the bar that first mitigates it: low to the bottom, or high to the top."""
    cols = ("idx", "zone_bull", "zone_top", "zone_bottom")
    inputs = ("high", "low", "zone_bull", "zone_top", "zone_bottom")
    out = scan(df, _mitigation, inputs, ("mitigated_idx",), carry=cols).filter(F.col("zone_bull").isNotNull())
    return out.select(
        "code",
        "day",
        "idx",
        F.col("zone_top").alias("top"),
        F.col("zone_bottom").alias("bottom"),
        (F.col("zone_bull") > 0).alias("bull"),
        F.col("mitigated_idx").cast("long").alias("mitigated_idx"),
    )


def _zigzag(s, pct=5.0):
    """Repaints: the newest point moves until the opposite swing is `pct` percent away."""
    hs, ls = s["high"], s["low"]
    price, sides, known = np.full_like(hs, np.nan), np.zeros_like(hs), np.zeros_like(hs)
    side, level = np.ones(hs.shape[1]), hs[0]
    at = np.zeros(hs.shape[1], dtype=int)
    newest = (at, level, side)  # bar, price and side of the newest point; a point is marked once another follows

    def mark(where: np.ndarray) -> None:
        bar, v, d = newest
        col = np.flatnonzero(where)
        price[bar[col], col], sides[bar[col], col] = v[col], d[col]

    for i in range(1, len(hs)):
        x, y = np.where(side == 1, hs[i], ls[i]), np.where(side == 1, ls[i], hs[i])
        on = (x - level) * side >= 0
        turn = ~on & ((level - y) * side >= level * pct / 100)
        mark(turn)
        newest = tuple(np.where(turn, q, np.where(on, z, o)) for o, q, z in zip(newest, (at, level, side), (i, x, side)))
        side, at, level = np.where(turn, -side, side), np.where(on | turn, i, at), np.where(on, x, np.where(turn, y, level))
        if i >= 2:
            known[i] = newest[2]
    mark(s[LENGTHS] > 0)
    for out, none in ((price, np.nan), (sides, 0), (known, 0)):
        out[:, s[LENGTHS] < 3] = none
    return {"zigzag": price, "zigzag_dir": sides, "zigzag_known": known}


def zigzag(df: DataFrame) -> DataFrame:
    """Pivots of the whole series, and in zigzag_known the side of the newest pivot as each bar knew it."""
    return scan_blocks(by_instrument(df), _zigzag, ["high", "low"], ["zigzag", "zigzag_dir", "zigzag_known"])


def _turns(s, pct=5.0):
    """On the bar that confirms a pivot of the zigzag: the pivot's bar (from 0), price and side."""
    hs, ls = s["high"], s["low"]
    n = len(hs)
    at_bar, price, sides = [None] * n, [None] * n, [None] * n
    if n >= 3:
        side, at, level = 1, 0, hs[0]
        for i in range(1, n):
            x, y = (hs[i], ls[i]) if side == 1 else (ls[i], hs[i])
            if (x - level) * side >= 0:
                at, level = i, x
            elif (level - y) * side >= level * pct / 100:
                at_bar[i], price[i], sides[i] = at, level, side
                side, at, level = -side, i, y
    return {"pivot_at": at_bar, "pivot_price": price, "pivot_side": sides}


def pivots(df: DataFrame) -> DataFrame:
    """(code, day, pivot_at, pivot_price, pivot_side, n): confirmed zigzag pivots, known from `day` on, numbered by code.

    A later bar never changes a row: the open swing after the newest pivot is not one yet.
    """
    out = scan(by_instrument(df), _turns, ["high", "low"], ["pivot_at", "pivot_price", "pivot_side"]).filter(F.col("pivot_price").isNotNull())
    number = F.row_number().over(Window.partitionBy("code").orderBy("day"))
    return out.select("code", "day", F.col("pivot_at").cast("long").alias("pivot_at"), "pivot_price", F.col("pivot_side").cast("int").alias("pivot_side"), number.alias("n"))


# name -> (recipe, inputs, outputs)
RECIPES = {
    "ema": (
        lambda s: {"ema12": ema(s["close"], 12), "ema21": ema(s["close"], 21)},
        ["close"],
        ["ema12", "ema21"],
    ),
    "rsi6": (_rsi(6), ["gain", "loss"], ["rsi6_wilder"]),
    "rsi12": (_rsi(12), ["gain", "loss"], ["rsi12_wilder"]),
    "rsi14": (_rsi(14), ["gain", "loss"], ["rsi14_wilder"]),
    "macd_x0": (_macd_x0, ["close"], ["macd_x0"]),
    "kdj": (_kdj, ["rsv"], ["kdj_k", "kdj_d", "kdj_j"]),
    "macd_sma": (_macd_sma, ["close"], ["macd_dif", "macd_dea", "macd_hist"]),
    "atr_wilder": (lambda s: {"atr_wilder": rma(s["tr"], 14)}, ["tr"], ["atr_wilder"]),
    "kama": (_kama, ["close", "er10"], ["kama"]),
    "keltner": (_keltner, ["close", "tr"], ["keltner_mid", "keltner_upper", "keltner_lower"]),
    "supertrend": (_supertrend, ["high", "low", "close", "tr"], ["supertrend", "supertrend_dir"]),
    "sar": (_sar, ["high", "low", "close"], ["sar", "sar_dir"]),
    "adx": (_adx, ["tr", "plus_dm", "minus_dm"], ["di_plus", "di_minus", "adx"]),
    "force": (lambda s: {"force_index": ema(s["force_raw"], 13)}, ["force_raw"], ["force_index"]),
    "dema": (_dema, ["close"], ["dema"]),
    "dema_biased": (_dema_biased, ["close"], ["dema_biased"]),
    "tema": (_tema, ["close"], ["tema"]),
    "trix": (_trix, ["close"], ["trix", "trix_slope", "trix_signal"]),
    "elder": (_elder, ["close", "high", "low"], ["bull_power", "bear_power"]),
    "chaikin": (_chaikin, ["ad_line"], ["chaikin"]),
    "mass": (_mass, ["hl_range"], ["mass_ratio"]),
    "smi": (_smi, ["smi_raw"], ["smi", "smi_signal"]),
    "zigzag": (_zigzag, ["high", "low"], ["zigzag", "zigzag_dir", "zigzag_known"]),
    "ttm": (_ttm, ["tp"], ["ttm_momentum"]),
}
