"""Confirmed pivots never change, waves and retracements by hand, factor gates, regimes, scopes, turnover."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.indicators import recurrent as rc
from barloom.indicators import waves
from barloom.operators import backtest as bt
from barloom.operators import decisions as de
from barloom.operators import factors as fa
from barloom.operators import filters as fl


def series(spark, n, seed=2):
    pick, price, rows = random.Random(seed), 100.0, []
    for k in range(n):
        price *= 1 + pick.uniform(-0.04, 0.04)
        rows.append((1, dt.date(2020, 1, 1) + dt.timedelta(days=k), round(price * 1.01, 3), round(price * 0.99, 3)))
    return spark.createDataFrame(rows, "code long, day date, high double, low double")


def test_pivots_do_not_look_ahead(spark):
    whole = series(spark, 160)
    every = [tuple(r) for r in rc.pivots(whole).orderBy("n").collect()]
    assert len(every) > 8
    for cut in (20, 77, 120):
        end = dt.date(2020, 1, 1) + dt.timedelta(days=cut - 1)
        part = [tuple(r) for r in rc.pivots(whole.filter(F.col("day") <= end)).orderBy("n").collect()]
        assert part == [r for r in every if r[1] <= end]
    bars = {k: r for k, r in enumerate(whole.orderBy("day").collect())}
    for _, day, at, price, side, _ in every:
        assert price == (bars[at]["high"] if side == 1 else bars[at]["low"]) and bars[at]["day"] < day
    assert all(a[4] == -b[4] for a, b in zip(every, every[1:]))


def test_waves_by_hand(spark):
    prices = [10.0, 20.0, 14.0, 30.0, 22.0, 40.0]
    p = spark.createDataFrame([(1, k, v, k + 1) for k, v in enumerate(prices)], "code long, day int, pivot_price double, n int")
    got = {(r["day"], r["mode"], r["node"]): (round(r["price"], 9), r["predicted"]) for r in waves.waves(p).collect()}
    assert {k[:2] for k in got} == {(3, "predict3"), (4, "predict3"), (5, "predict3"), (5, "impulse5")}
    a = 30 / 2.382
    assert [got[5, "impulse5", k][0] for k in range(6)] == [round(10 + a * v, 9) for v in (0, 1, 0.382, 2, 1.382, 2.382)]
    assert got[3, "predict3", 3] == (30.0, False) and got[3, "predict3", 4] == (round(10 + 10 * 1.382, 9), True) and got[3, "predict3", 5][1]
    levels = {(r["day"], r["level"]): r["price"] for r in waves.retracements(p).collect()}
    assert levels[1, 0.0] == 10.0 and levels[1, 1.0] == 20.0 and levels[2, 0.5] == 17.0 and (0, 0.5) not in levels


def test_regimes(spark):
    closes = [(dt.date(2020, 1, 1), 100.0), (dt.date(2020, 2, 1), 104.9), (dt.date(2020, 3, 1), 105.0), (dt.date(2020, 4, 1), 95.0), (dt.date(2020, 4, 2), 0.0), (dt.date(2020, 8, 1), 90.0), (dt.date(2020, 8, 2), 120.0)]
    seg = de.regime_segments(spark.createDataFrame(closes, "day date, close double"))
    got = [(r["regime"], str(r["first_day"]), str(r["last_day"])) for r in seg.orderBy("first_day").collect()]
    assert got == [("震荡市", "2020-01-01", "2020-02-29"), ("上涨趋势", "2020-03-01", "2020-03-31"), ("下跌趋势", "2020-04-01", "2020-07-31"), ("震荡市", "2020-08-01", "2020-08-01"), ("上涨趋势", "2020-08-02", "9999-12-31")]
    live = spark.createDataFrame([(1, dt.date(2019, 12, 31), "趋势持有", "active"), (2, dt.date(2020, 2, 29), "趋势持有", "active"), (3, dt.date(2020, 3, 31), "趋势持有", "active"), (4, dt.date(2020, 5, 5), "短线爆发", "active"), (5, dt.date(2020, 5, 5), "短线爆发", "watch"), (6, dt.date(2021, 1, 1), "短线爆发", "active")], "id int, day date, scene string, status string")
    out = {r["id"]: (r["regime"], r["status"], r["mismatch"]) for r in de.regime_watch(de.regime_of(live, seg)).collect()}
    assert out[1] == (None, "active", False) and out[2] == ("震荡市", "watch", True) and out[3] == ("上涨趋势", "active", False)
    assert out[4] == ("下跌趋势", "watch", True) and out[5][1:] == ("watch", False) and out[6] == ("上涨趋势", "active", False)


def test_scopes(spark):
    codes = spark.createDataFrame([("a",), ("b",), (None,)], "code string")
    followed = spark.createDataFrame([("b", 1), ("c", 2), ("c", 2)], "code string, group int")
    snapshots = spark.createDataFrame([(1, "done", 10), (2, "done", 20), (3, "failed", 30)], "id int, status string, available_at int")
    items = spark.createDataFrame([(2, "x", 5), (2, "x", 3), (2, "y", 1), (3, "z", 1), (1, "w", 1)], "snapshot_id int, code string, source_rank int")
    of = lambda s: sorted((r["code"], r["place"]) for r in fl.scope_codes(s, codes, followed, snapshots, items).collect())
    assert of("") == of("全部") == of("something else") == [("a", None), ("b", None)]
    assert of("snapshot_all") == of("snapshot_2") == [("x", 3), ("y", 1)] and of("snapshot_3") == [("z", 1)] and of("snapshot_9") == []
    assert of("stock_a") == [("a", None)] and of("stock_") == [] and of("自选股") == [("b", None), ("c", None)] and of("group_2") == [("c", None)]


def test_turnover_and_days(spark):
    t = spark.createDataFrame([(10.0, 12.0, 100.0), (5.0, 4.0, 200.0)], "buy_price double, sell_price double, quantity double")
    assert tuple(bt.turnover(t, 1000.0).first()) == pytest.approx((2.0, 2.0, 2.0))
    assert tuple(bt.turnover(t, 0.0).first()) == (0.0, 0.0, 0.0)
    f = spark.createDataFrame([(1, "2020-01-02"), (1, "2020-01-04"), (2, "2020-01-03"), (2, "2021-01-03")], "code long, day string").withColumn("day", F.to_date("day"))
    days = lambda b: sorted(str(r["day"]) for r in bt.trading_days(f, b, "2020-01-01", "2020-12-31").collect())
    assert days(1) == ["2020-01-02", "2020-01-04"] and days(9) == ["2020-01-02", "2020-01-03", "2020-01-04"]


def test_confidence(spark):
    rows = [(29, 0.01, 0.1, 0.1), (30, 0.21, 0.1, 0.1), (30, 0.05, 0.1, -0.076), (30, 0.05, 0.1, 0.07), (30, 0.2, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "n long, p double, ic double, recent double")
    assert [r[0] for r in df.select(fa.confidence(*(F.col(c) for c in df.columns))).collect()] == ["low", "low", "high", "medium", "medium"]
