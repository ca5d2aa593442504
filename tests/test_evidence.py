"""Extremes of intervals, the lattice of variants and the evidence of the verdict on small hand-made series."""

import random
import re

import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest as bt
from barloom.operators import extremes as ex
from barloom.operators import stability as stb
from barloom.operators import filters as fl
from barloom.plans.catalog import load
from barloom.plans.features import RULE, stored_features


def bars(spark, n=60, codes=3, seed=1):
    pick = random.Random(seed)
    rows = [(c, f"2020-{1 + k // 28:02d}-{1 + k % 28:02d}", pick.choice([0.0, *[round(pick.uniform(5, 20), 2)] * 9]), round(pick.uniform(20, 30), 2)) for c in range(codes) for k in range(n)]
    return rows, spark.createDataFrame(rows, "code long, day string, low double, high double").withColumn("day", F.to_date("day"))


@pytest.mark.parametrize("longest", [1, 2, 7, 31])
def test_interval_extremes(spark, longest):
    rows, df = bars(spark)
    pick = random.Random(longest)
    series = {c: [r for r in rows if r[0] == c] for c in range(3)}
    want, asked = {}, []
    for k in range(200):
        c, a = pick.randint(0, 2), pick.randint(0, 59)
        n = pick.randint(1, min(longest, 60 - a))
        part = series[c][a : a + n]
        want[k] = (min((r[2] for r in part if r[2] > 0), default=None), max(r[3] for r in part))
        asked.append((k, c, series[c][a][1], n))
    ask = spark.createDataFrame(asked, "k int, code long, start string, n int").withColumn("start", F.to_date("start"))
    got = ex.interval_extremes(ask, ex.doubled_extremes(df, longest), "start", F.col("n")).collect()
    assert {r["k"]: (r["low"], r["high"]) for r in got} == want


def test_breakdown_joins_two_rows_a_trade(spark, sf):
    out = load()["stock_breakdown"].run(spark, sf)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in text.split("Window", 1)[0]
    joins = re.findall(r"Join Inner", text)
    assert len(joins) == 2
    pnl = [r["pnl"] for r in out.collect()]
    assert pnl == sorted(pnl, reverse=True)


def test_lattice_is_one_scan(spark, sf):
    f = fl.tradable(stored_features(spark, sf), "buy")
    text = stb.lattice_trades(f, RULE)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan parquet", text)) == 1 and len(re.findall("Exchange hashpartitioning", text)) == 1


def test_base_variant_is_the_backtest(spark, sf):
    f = fl.tradable(stored_features(spark, sf), "buy")
    from barloom.operators.features import match_rule

    plain = bt.barrier_trades(match_rule(f, RULE), RULE["stop_loss"], RULE["stop_gain"], RULE["max_hold"])
    every = stb.lattice_trades(f, RULE)
    base = every.filter("variant = 'base'").drop("variant")
    assert base.exceptAll(plain).count() == 0 and plain.exceptAll(base).count() == 0
    for name, scale in stb.THRESHOLDS.items():
        stop, gain = stb.exits_of(RULE, scale)
        alone = bt.barrier_trades(match_rule(f, RULE, scale=scale), stop, gain, RULE["max_hold"])
        mine = every.filter(F.col("variant") == name).drop("variant")
        assert mine.exceptAll(alone).count() == 0 and alone.exceptAll(mine).count() == 0


def test_perturbed_exits_are_clamped():
    assert stb.exits_of({"stop_loss": 0.12, "stop_gain": 0.25}, 1.05) == (0.12, 0.25)
    assert stb.exits_of({"stop_loss": 0.02, "stop_gain": 0.03}, 0.95) == (0.03, 0.03)
    assert stb.exits_of({"stop_loss": 0.10, "stop_gain": 0.20}, 0.95) == pytest.approx((0.095, 0.19))


def report(spark, rows):
    return spark.createDataFrame(rows, "code long, scenario string, trades long, avg_return double, median_return double, total_return double, max_drawdown double, lookahead long")


def test_stability_gates(spark):
    base = ("base", 10, 0.02, 0.02, 0.2, 0.1, 0)
    cases = {
        1: [("threshold_0_95x", 9, 0.01, 0.0, 0.1, 0.25, 0), ("threshold_1_05x", 9, 0.03, 0.0, 0.1, 0.1, 0), ("slippage_2x", 10, 0.001, 0.0, 0.0, 0.2, 0)],
        2: [("threshold_0_95x", 9, 0.0099, 0.0, 0.1, 0.1, 0), ("threshold_1_05x", 9, 0.03, 0.0, 0.1, 0.1, 0), ("slippage_2x", 10, 0.0, 0.0, 0.0, 0.1, 0)],
        3: [("threshold_0_95x", 9, 0.02, 0.0, 0.1, 0.26, 0), ("slippage_2x", 10, 0.1, 0.0, 0.0, 0.21, 0)],
    }
    rows = [(c, *r) for c, rest in cases.items() for r in [base, *rest]]
    got = {r["code"]: (r["cost_2x_passed"], r["variants_passed"], r["parameter_stability"]) for r in stb.stability(report(spark, rows), ("code",)).collect()}
    assert got == {1: (True, 2, "stable"), 2: (False, 1, "fragile"), 3: (False, 0, "fragile")}


def test_equity_and_drawdown(spark):
    rows = [(1, "2020-01-02", 0.5), (1, "2020-01-03", -0.75), (1, "2020-01-03", 0.0), (2, "2020-01-05", 3.0), (1, "2020-01-06", -9.0)]
    t = spark.createDataFrame(rows, "code long, sell_day string, net_return double")
    own = {(r["code"], r["day"]): (r["nav"], r["drawdown"]) for r in stb.equity(t, ("code",)).collect()}
    assert own[1, "2020-01-03"] == (0.75, 0.5) and own[2, "2020-01-05"] == (4.0, 0.0) and own[1, "2020-01-06"][1] == 1.0
    by = {r["day"]: r["nav"] for r in stb.equity(t.withColumn("s", F.lit("x")), ("s",)).collect()}
    assert by == {"2020-01-02": 1.25, "2020-01-03": 0.875, "2020-01-05": 2.375, "2020-01-06": -2.125}


def test_warnings_open_the_last_gate(spark):
    names = "code long, no_lookahead boolean, trades long, coverage double, min_coverage double, max_drawdown double, avg_return double, cost_2x_passed boolean, benchmark_available boolean, excess_return double, out_trades long, out_avg_return double, parameter_stability string, warnings array<string>"
    good = (True, 40, 1.0, 0.95, 0.1, 0.01, True, True, 0.1, 20, 0.01, "stable", [])
    change = lambda k, v: tuple(v if i == k else x for i, x in enumerate(good))
    rows = [good, change(12, ["decay"]), change(11, "fragile"), change(0, False), change(1, 0), change(2, 0.5), change(4, 0.3), change(6, False), change(1, 29), change(8, 0.0), change(9, 14)]
    got = [(r["status"], r["gate"]) for r in bt.verdict(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], names)).orderBy("code").collect()]
    assert got == [("active_candidate", "passed"), ("active_candidate", "warnings"), ("paper_trade", "parameters"), ("reject", "lookahead"), ("reject", "no_trades"), ("reject", "coverage"), ("reject", "return_drawdown"), ("watchlist", "cost"), ("watchlist", "sample_benchmark"), ("watchlist", "excess"), ("paper_trade", "out_of_sample")]
