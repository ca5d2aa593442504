"""The columns of the indicator vote as matrices of bars by instruments, as `rolling` and `recurrent` define them one by one.

A window visits its frame for every row and column; here a frame of n bars costs n steps over a whole block, and no row
is exchanged or sorted again between the columns. NaN is a missing value. np.fmax and np.fmin pass over it, as greatest
and least do.
"""

from __future__ import annotations

import numpy as np

from barloom.operators.recurrence import before, extreme, partial, rolling, rolling_std


def lag(x: np.ndarray, n: int) -> np.ndarray:
    out = np.full_like(x, np.nan)
    out[n:] = x[: max(0, len(x) - n)]
    return out


def cum(x: np.ndarray) -> np.ndarray:
    """Running sum of the values there are; missing before the first."""
    there = ~np.isnan(x)
    return np.where(np.logical_or.accumulate(there, axis=0), np.cumsum(np.where(there, x, 0.0), axis=0), np.nan)


def wma(x: np.ndarray, n: int) -> np.ndarray:
    """Linear weights 1..n, newest heaviest; missing while any term is."""
    total = lag(x, n - 1)
    for j in range(1, n):
        total = total + lag(x, n - 1 - j) * float(j + 1)
    return total / (n * (n + 1) / 2)


def filled(x: np.ndarray) -> np.ndarray:
    """The newest value so far."""
    out = x.copy()
    for t in range(1, len(out)):
        out[t] = np.where(np.isnan(out[t]), out[t - 1], out[t])
    return out


def settled(x: np.ndarray, digits: int) -> np.ndarray:
    """`numeric.rnd` of a block."""
    scale = 10.0**digits
    y = np.abs(x) * scale
    return np.sign(x) * np.rint(y + 1e-8 + np.fmin(1e-6, y * 1e-14)) / scale + 0.0


def unit(x: np.ndarray) -> np.ndarray:
    return np.fmax(0.0, np.fmin(1.0, x))


def newest_extreme(x: np.ndarray, n: int) -> np.ndarray:
    """Bars since the largest of the last n values; ties take the most recent one."""
    best, since = np.full_like(x, -np.inf), np.zeros_like(x)
    for j in range(n - 1, -1, -1):
        v = lag(x, j)
        new = v >= best
        best, since = np.where(new, v, best), np.where(new, float(j), since)
    return since


def inputs(s: dict) -> dict:
    """`recurrent.with_inputs`: what the recipes of the vote read."""
    h, l, c, v = s["high"], s["low"], s["close"], s["volume"]
    past = before(c)
    d = c - past
    hi9, lo9, hi14, lo14 = extreme(h, 9, np.maximum), extreme(l, 9, np.minimum), extreme(h, 14, np.maximum), extreme(l, 14, np.minimum)
    up, down = h - before(h), before(l) - l
    tr = np.where(np.isnan(past), h - l, np.fmax(np.fmax(h - l, np.abs(h - past)), np.abs(l - past)))
    mfv = np.where(h > l, ((c - l) - (h - c)) / (h - l), 0.0) * v
    path = partial(np.abs(d), 10)
    return {
        "tr": tr,
        "tp": (h + l + c) / 3.0,
        "rsv": np.where(hi9 == lo9, 50.0, (c - lo9) / (hi9 - lo9) * 100.0),
        "force_raw": np.where(np.isnan(d * v), 0.0, d * v),
        "hl_range": h - l,
        "smi_raw": np.where(hi14 != lo14, 200.0 * ((c - (hi14 + lo14) / 2.0) / (hi14 - lo14)), np.nan),
        "plus_dm": np.where((up > down) & (up > 0), up, 0.0),
        "minus_dm": np.where((down > up) & (down > 0), down, 0.0),
        "mfv": mfv,
        "er10": np.where(path > 0, np.abs(c - lag(c, 10)) / path, 0.0),
        "ad_line": cum(mfv),
    }


def _rates(up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """100 - 100 / (1 + up / down), 100 without a loss."""
    return np.where(np.isnan(down), np.nan, np.where(down == 0, 100.0, 100.0 - 100.0 / (1.0 + up / down)))


def window_columns(s: dict) -> dict:
    """The votes' window columns; reads bars, `inputs` and mass_ratio."""
    h, l, c, v, tp = s["high"], s["low"], s["close"], s["volume"], s["tp"]
    past = before(c)
    d = c - past
    known = ~np.isnan(d)
    out = {f"ma{n}": rolling(c, n) / n for n in (5, 10, 20, 60)}
    sd = rolling_std(c, 20)
    out |= {"boll_mid": out["ma20"], "boll_upper": out["ma20"] + 2.0 * sd, "boll_lower": out["ma20"] + -2.0 * sd}

    vol = rolling(v, 20)
    out["vwap"] = np.where(vol > 0, rolling(tp * v, 20) / vol, np.nan)
    w, m = np.where(v == 0, 1.0, v), out["vwap"]
    var = (rolling(w * tp * tp, 20) - 2.0 * m * rolling(w * tp, 20)) / rolling(w, 20) + m * m
    spread = np.sqrt(np.fmax(var, 0.0))
    out |= {"vwap_upper": m + 2.0 * spread, "vwap_lower": m - 2.0 * spread}
    out["hull"] = wma(2.0 * wma(c, 4) - wma(c, 9), 3)

    for name, n in (("tenkan", 9), ("kijun", 26), ("span_b", 52)):
        out[name] = (extreme(h, n, np.maximum) + extreme(l, n, np.minimum)) / 2.0
    out["span_a"] = (out["tenkan"] + out["kijun"]) / 2.0
    out |= {"donchian_upper": extreme(h, 20, np.maximum), "donchian_lower": extreme(l, 20, np.minimum)}
    mid = (h + l) / 2.0
    for name, n, shift in (("jaw", 13, 8), ("teeth", 8, 5), ("lips", 5, 3)):
        out[name] = lag(rolling(mid, n) / n, shift)
    out["ao"] = rolling(mid, 5) / 5 - rolling(mid, 34) / 34
    p = before(tp)
    out |= {"pivot_pp": p, "pivot_r1": 2.0 * p - before(l), "pivot_s1": 2.0 * p - before(h)}

    mean = rolling(tp, 20) / 20
    dev = sum((np.abs(lag(tp, j) - mean) for j in range(19, -1, -1)), np.zeros_like(tp)) / 20.0
    out["cci"] = np.where(dev > 0, (tp - mean) / (0.015 * dev), np.nan)
    hi, lo = extreme(h, 14, np.maximum), extreme(l, 14, np.minimum)
    out["williams_r"] = np.where(hi > lo, (hi - c) / (hi - lo) * -100.0, np.nan)
    out["chop"] = np.where((h - lag(l, 13) > 0) & (hi > lo), 100.0 * np.log(rolling(s["tr"], 14) / (hi - lo)) / np.log(14.0), np.nan)

    gain, loss = np.where(known, np.fmax(d, 0.0), np.nan), np.where(known, np.fmax(-d, 0.0), np.nan)
    up, down = rolling(gain, 14), rolling(loss, 14)
    rsi = out["rsi_cutler"] = _rates(up, down)
    out["cmo"] = np.where(np.isnan(up), np.nan, np.where(up + down > 0, (up - down) / (up + down) * 100.0, 0.0))
    top, low = extreme(rsi, 14, np.maximum), extreme(rsi, 14, np.minimum)
    raw = np.where(np.isnan(top), np.nan, np.where(top == low, 0.0, (rsi - low) / (top - low) * 100.0))
    out["stoch_k"] = rolling(raw, 3) / 3
    out["stoch_d"] = rolling(out["stoch_k"], 3) / 3

    bar = np.arange(1.0, len(c) + 1)[:, None]
    for name, x in (("aroon_up", h), ("aroon_down", -l)):
        out[name] = np.where(bar >= 25, (24.0 - newest_extreme(x, 25)) / 24.0 * 100.0, np.nan)

    def roc(n: int) -> np.ndarray:
        base = lag(c, n)
        return np.where(base != 0, (c - base) / base * 100.0, np.nan)

    out |= {"roc": roc(12), "coppock": wma(roc(14) + roc(11), 10)}
    step = np.sign(d) * v
    out["obv_vol0"] = cum(np.where(np.isnan(step), v, step))
    there = ~np.isnan(p)
    rise = rolling(np.where(tp > p, tp * v, np.where(there, 0.0, np.nan)), 14)
    out["mfi"] = _rates(rise, rolling(np.where(tp < p, tp * v, np.where(there, 0.0, np.nan)), 14))
    out["cmf"] = np.where(vol > 0, rolling(s["mfv"], 20) / vol, np.nan)
    out["ad"] = s["ad_line"]
    most, one, two = extreme(c, 14, np.maximum), rolling(c, 14), rolling(c * c, 14)
    q = two / (most * most) - 2.0 * one / most + 14.0
    out["ulcer"] = np.where(np.isnan(most), np.nan, np.sqrt(np.fmax(q, 0.0) * 10000.0 / 14.0))
    out["mass_index"] = rolling(s["mass_ratio"], 25)
    return out


def trend_inputs(s: dict, p: dict) -> dict:
    """`recurrent.sats_inputs` with the parameters p; reads bars and atr_wilder."""
    h, l, c, v, atr = s["high"], s["low"], s["close"], s["volume"], s["atr_wilder"]
    d = c - before(c)
    i = np.arange(1.0, len(c) + 1)[:, None]
    path = rolling(np.abs(d), p["er_len"])
    er = np.where(path > 0, np.abs(c - lag(c, p["er_len"])) / path, 0.0)
    vm, vs = rolling(v, p["vol_len"]) / p["vol_len"], rolling_std(v, p["vol_len"])
    base = rolling(np.where(np.isnan(atr), 0.0, atr), p["baseline_len"]) / p["baseline_len"]
    z = np.where(vs > 0, (v - vm) / vs, 0.0)
    ratio = np.where(base > 0, atr / base, 1.0)
    vol = np.where((v > 0) & (i > p["vol_len"]), unit((z + 1.0) / 3.0), unit((ratio - 0.6) / 1.2))
    hi, lo = extreme(h, p["struct_len"], np.maximum), extreme(l, p["struct_len"], np.minimum)
    pos = np.where(hi > lo, (c - lo) / (hi - lo), 0.5)
    struct = np.where(i > p["struct_len"], unit(np.abs(pos - 0.5) * 2.0), 0.0)
    n, turn = p["mom_len"], c - lag(c, p["mom_len"])
    ups, downs = (rolling(np.where(np.isnan(d), np.nan, hit), n) for hit in (d > 0, d < 0))
    mom = np.where(turn > 0, ups, np.where(turn < 0, downs, 0.0)) / n
    ok = ~np.isnan(atr) & ~np.isnan(base)
    q = np.where(ok, unit(er * p["w_er"] + vol * p["w_vol"] + struct * p["w_struct"] + mom * p["w_mom"]), 0.0)
    shape = (1.0 - p["quality"]) + p["quality"] * (0.6 + 0.8 * (1.0 - q) ** p["curve"])
    sym = p["base_mult"] * (1.0 + p["adapt"] * (0.5 - er)) * shape
    return {
        "sats_active": sym * (1.0 - p["asym"] * q * 0.3),
        "sats_passive": sym * (1.0 + p["asym"] * q * 0.4),
        "sats_atr": atr * (0.5 + 0.5 * er),
        "sats_quality": q,
        "sats_ok": ok.astype(float),
    }
