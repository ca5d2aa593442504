"""The trade step: bars are stepped through once, against a walk over every signal."""

import datetime as dt
import random

import pyarrow as pa
from pyspark.sql import functions as F

from barloom.operators import backtest as bt
from barloom.plans import backtest as plans

DAY0 = dt.date(2024, 1, 1)
NAMES = "code long, day date, open double, high double, low double, close double, volume double, tradable boolean, in0 boolean, out0 boolean, in1 boolean, out1 boolean"


def series(pick, code, n):
    some = lambda x, p: None if pick.random() < p else x
    rows = []
    for i in range(n):
        o = pick.uniform(80, 120)
        flags = [some(pick.random() < p, 0.05) for p in (0.9, 0.4, 0.1, 0.5, 0.3)]
        rows.append((code, DAY0 + dt.timedelta(days=i), some(o, 0.05), some(o + pick.uniform(0, 25), 0.05), some(o - pick.uniform(0, 25), 0.05), some(o, 0.05), float(i), *flags))
    return rows


def walk(bars, k, stop, gain, hold):
    """Trades of one instrument, signal by signal."""
    out = []
    for s in range(len(bars) - 1):
        e = bars[s + 1]
        price = e[2]
        if not bars[s][8 + 2 * k] or not e[7] or price is None or price <= 0:
            continue
        for i in range(1, hold + 1):
            if s + 1 + i >= len(bars):
                break
            _, day, o, h, low, c = bars[s + 1 + i][:6]
            got = None
            if low is not None and 0 < low <= price * stop:
                got = ("stop_loss", day, o if o is not None and 0 < o < price * stop else price * stop, i)
            elif h is not None and h > 0 and h >= price * gain:
                got = ("stop_gain", day, o if o is not None and o > price * gain else price * gain, i)
            elif bars[s + 1 + i][9 + 2 * k]:
                if s + 2 + i < len(bars):
                    n = bars[s + 2 + i]
                    got = ("exit_condition", n[1], n[2], i + 1)
            elif i >= hold:
                got = ("max_hold_days", day, c, i)
            if got:
                reason, sold, px, days = got
                out.append((k, e[0], bars[s][1], e[1], sold, price, px, reason, days, e[6], None if px is None else px / price - 1))
                break
    return out


def test_trades_of_every_signal(spark):
    pick = random.Random(5)
    stocks = [series(pick, c, pick.choice([1, 2, 3, 7, 40, 90])) for c in range(40)]
    rows = [r for s in stocks for r in s]
    pick.shuffle(rows)
    shares = [(0.9, 1.1), (0.95, 1.2)]
    df = spark.createDataFrame(rows, NAMES)
    seen = set()
    for hold in (1, 4, 20):
        got = bt.walked(df, [F.col("in0"), F.col("in1")], [F.col("out0"), F.col("out1")], shares, hold).collect()
        want = [t for s in stocks for k, (a, b) in enumerate(shares) for t in walk(s, k, a, b, hold)]
        seen |= {t[7] for t in want}
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert seen == {"stop_loss", "stop_gain", "exit_condition", "max_hold_days"}


def test_blocks_hold_whole_instruments():
    lengths = [3, 1, 9, 2, 2, 30, 1]
    ix = [i + 1 for n in lengths for i in range(n)]
    owner = [k for k, n in enumerate(lengths) for _ in range(n)]
    whole = pa.table({"_ix": ix, "owner": owner})
    for size in (1, 2, 5, 100):
        for rows in (1, 4, 8, 100):
            got = list(bt.whole_series(iter(whole.to_batches(max_chunksize=size)), rows))
            assert [x for t in got for x in t["owner"].to_pylist()] == owner
            seen = [set(t["owner"].to_pylist()) for t in got]
            assert sum(len(s) for s in seen) == len(lengths)


def test_no_bar_is_copied_for_a_signal(spark, sf):
    text = plans.trades(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in text and "transform" not in text


def test_decisions_read_the_trades_once(spark, sf):
    text = plans._decisions(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in text
    # both rules' conditions come from one exchange of the features, and their trades are a stored table
    assert text.count("Union") == 0


def test_only_read_features_are_stored(spark, sf):
    f = plans.stored_features(spark, sf, plans.traded_columns(plans.RULE))
    assert set(f.columns) == {"code", "day", "open", "high", "low", "close", "volume", "ma10", "ma20", "rsi6", "volume_ratio"}


def test_external_factors_store_what_they_read(spark, sf, monkeypatch):
    from barloom.plans import factors as pf

    stored = []
    make = pf.stored_features
    monkeypatch.setattr(pf, "stored_features", lambda *a: stored.append(make(*a)) or stored[-1])
    pf.factor_external(spark, sf)
    assert [set(f.columns) for f in stored] == [{"code", "day", "close", "ma20", "volume_ratio", "rsi14"}]
