"""Helpers that replace one big group: exact against brute force, with hot keys and ties."""

import datetime as dt
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.operators import backtest, factors, joins, ledger
from barloom.operators.recurrence import ema, rma
from barloom.operators.windows import cumulative_counts, first_row, lower_nearest, pick_at_rank

DAY0 = dt.date(2024, 1, 1)


def test_ema_against_pandas():
    x = list(np.random.default_rng(1).normal(100, 5, 300))
    got = ema(x, 12)
    want = pd.Series([np.mean(x[:12]), *x[12:]]).ewm(span=12, adjust=False).mean()
    assert got[:11] == [None] * 11 and np.allclose(got[11:], want)
    r = rma(x, 14)
    want = pd.Series([np.mean(x[:14]), *x[14:]]).ewm(alpha=1 / 14, adjust=False).mean()
    assert np.allclose(r[13:], want)


def test_ema_gaps():
    x = [1.0, None, 2.0, 3.0, 4.0, None, 5.0]
    assert ema(x, 2) == [None, None, None, 2.5, 4.0 * 2 / 3 + 2.5 / 3, None, 5.0 * 2 / 3 + (4.0 * 2 / 3 + 2.5 / 3) / 3]
    assert ema(x, 2, leading=True)[2] == 1.5


def test_counts_and_quantiles_with_ties(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else "cold", rng.choice([0.0, -1.5, 2.0, 2.0, 2.0, rng.uniform(-9, 9)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {(r.k, r.x): (r.n, r.below) for r in cumulative_counts(df, "x", ["k"]).collect()}
    for key in ("hot", "cold"):
        vals = sorted(x for k, x in rows if k == key)
        for v in set(vals):
            assert got[(key, v)] == (vals.count(v), sum(1 for x in vals if x < v))
    q = pick_at_rank(cumulative_counts(df, "x"), "x", {"p10": lower_nearest(0.10), "p99": lower_nearest(0.99)}).first()
    alls = sorted(x for _, x in rows)
    assert q.p10 == alls[int((len(alls) - 1) * 0.10)] and q.p99 == alls[int((len(alls) - 1) * 0.99)]


def test_pooled_rank_with_hot_value(spark):
    rng = random.Random(5)
    rows = [("f", i % 40, DAY0 + dt.timedelta(days=i // 40), rng.choice([1.0, 1.0, rng.random()])) for i in range(2000)]
    df = spark.createDataFrame(rows, "factor string, code int, day date, x double")
    got = {(r.code, r.day): r["rank"] for r in factors.pooled_rank(df, "x", ["factor"]).collect()}
    want = {(c, d): i for i, (_, c, d, _) in enumerate(sorted(rows, key=lambda r: (r[3], r[2], r[1])))}
    assert got == want


def test_median(spark):
    rng = random.Random(9)
    rows = [("a" if i % 3 else "b", round(rng.uniform(0, 5), 1)) for i in range(1001)]
    got = {r.k: r.median_x for r in joins.median_by(spark.createDataFrame(rows, "k string, x double"), "x", ["k"]).collect()}
    for k in "ab":
        assert abs(got[k] - float(np.median([x for kk, x in rows if kk == k]))) < 1e-12


def test_asof_across_buckets(spark):
    rng = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    left = [("hot" if rng.random() < 0.8 else "b", base + dt.timedelta(hours=rng.randrange(4000)), i) for i in range(800)]
    right = [("hot", base + dt.timedelta(hours=h), float(h)) for h in range(100, 3000, 97)]
    l = spark.createDataFrame(left, "code string, t timestamp, id int")
    r = spark.createDataFrame(right, "code string, rt timestamp, v double")
    got = {x.id: x.v for x in joins.asof_latest(l, r, "t", "rt", ["v"]).collect()}
    for code, t, i in left:
        past = [v for c, rt, v in right if c == code and rt <= t]
        assert got[i] == (past[-1] if past else None)


def test_first_row_takes_the_total_order(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y")], "k string, o int, v string")
    assert first_row(df, ["k"], [F.col("o"), F.col("v")]).first().v == "y"


def _fifo(trades):
    """Plain loop: (realised, open volume, open cost, matched cost)."""
    lots, realised, matched = [], 0.0, 0.0
    for side, price, vol in trades:
        if side == "buy":
            lots.append([vol, price])
            continue
        need, cost = vol, 0.0
        while need > 0 and lots:
            take = min(need, lots[0][0])
            cost += take * lots[0][1]
            lots[0][0] -= take
            need -= take
            if lots[0][0] == 0:
                lots.pop(0)
        matched += cost
        if need == 0:
            realised += price * vol - cost
    return realised, sum(v for v, _ in lots), sum(v * p for v, p in lots), matched


def test_fifo_against_a_loop(spark):
    rng = random.Random(21)
    rows, want = [], {}
    for code in range(25):
        seq = []
        for i in range(rng.randrange(1, 60)):
            seq.append((rng.choice(["buy", "buy", "sell"]), float(rng.randrange(5, 9)), float(rng.choice([1, 5, 100, 3000]))))
        want[code] = _fifo(seq)
        rows += [(code, DAY0 + dt.timedelta(days=i // 4), s, p, v, i) for i, (s, p, v) in enumerate(seq)]
    df = spark.createDataFrame(rows, "code int, day date, side string, price double, volume double, k int")
    got = {r.code: (r.realized, r.open_volume, r.open_cost, r.matched_cost) for r in ledger.fifo_positions(df).collect()}
    for code, w in want.items():
        assert np.allclose(got[code], w), code


def test_identical_trades_keep_their_own_cost(spark):
    row = (1, DAY0, "sell", 9.0, 2.0, 7)
    rows = [(1, DAY0, "buy", 5.0, 2.0, 1), (1, DAY0, "buy", 6.0, 2.0, 2), row, row]
    df = spark.createDataFrame(rows, "code int, day date, side string, price double, volume double, k int")
    assert sorted(r.cost for r in ledger.sell_costs(*ledger.lots(df)).collect()) == [10.0, 12.0]


def test_chips_sum_to_one(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        lo = rng.uniform(5, 9)
        hi = lo if i % 10 == 0 else lo + rng.uniform(0, 2)
        rows.append(("a", DAY0 + dt.timedelta(days=i), lo, hi, lo, hi, 100.0, 100 * (lo + hi) / 2, rng.uniform(0, 0.2)))
    b = spark.createDataFrame(rows, "code string, day date, open double, high double, low double, close double, volume double, amount double, turnover double")
    c = ledger.chip_bins(b, 40)
    assert abs(c.agg(F.sum("ratio")).first()[0] - 1) < 1e-9
    left, total = 1.0, 0.0
    for r in reversed(rows):
        total += 100 * left
        left *= 1 - r[-1]
    assert abs(c.agg(F.sum("volume")).first()[0] - total) < 1e-6


def test_bootstrap_paths(spark):
    rng = random.Random(4)
    draws = [(s, k, rng.uniform(-0.1, 0.12)) for s in range(3) for k in range(50)]
    got = {r.sim: r for r in backtest.simulate_paths(spark.createDataFrame(draws, "sim long, k long, x double"), block=8).collect()}
    for s in range(3):
        nav, peak, dd = 1.0, 1.0, 0.0
        for _, _, x in [d for d in draws if d[0] == s]:
            nav *= 1 + x
            peak = max(peak, nav)
            dd = max(dd, (peak - nav) / peak)
        assert abs(got[s].compound_return - (nav - 1)) < 1e-9 and abs(got[s].max_drawdown - dd) < 1e-9


def test_bootstrap_is_seed_stable(spark):
    rows = [(DAY0 + dt.timedelta(days=i), "a", (i % 7 - 3) / 100) for i in range(40)]
    t = spark.createDataFrame(rows, "day date, code string, return_rate double")
    one = backtest.bootstrap(t, 20).orderBy("sim").collect()
    assert one == backtest.bootstrap(t.repartition(5), 20).orderBy("sim").collect() and len(one) == 20
    assert backtest.bootstrap(t.limit(5), 20).count() == 0


def test_rounding_is_half_away_and_never_saturates(spark):
    from pyspark.sql import functions as F

    from barloom.functions.numeric import rnd

    inf, nan = float("inf"), float("nan")
    cases = [(2.5, 0, 3.0), (-2.5, 0, -3.0), (2.4999995, 0, 2.0), (-0.125, 2, -0.13), (1e18, 2, 1e18), (9.3e12, 6, 9.3e12), (inf, 2, inf), (-inf, 2, -inf), (nan, 2, nan), (0.0, 2, 0.0), (1.005, 2, 1.01)]
    df = spark.createDataFrame([(i, x, d) for i, (x, d, _) in enumerate(cases)], "i int, x double, d int")
    out = df.select("i", F.coalesce(*[F.when(F.col("d") == d, rnd("x", d)) for d in (0, 2, 6)]).alias("y")).orderBy("i").collect()
    for row, (x, _, want) in zip(out, cases, strict=True):
        assert row.y == want or (want != want and row.y != row.y), (x, row.y, want)


def test_value_buckets_order_the_ends(spark):
    from barloom.operators.windows import value_bucket

    xs = [float("-inf"), -1e300, -2.0, 0.0, 1.0, 2.0, 1e300, float("inf"), float("nan")]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(value_bucket("x")).collect()]
    assert got == sorted(got) and len(set(got)) == len(got)
