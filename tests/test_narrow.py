"""What a query exchanges and stores: only the columns it reads, each row once."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import features as of
from barloom.plans.catalog import load

DAY0 = dt.date(2024, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> int:
    return len(re.findall(r"Exchange hashpartitioning", text))


def bars(spark, codes=((1, 200), (2, 61), (3, 60), (4, 130)), seed=4):
    rng = random.Random(seed)
    rows = []
    for code, n in codes:
        for i in range(n):
            p = 10 + rng.uniform(-3, 3)
            rows.append((code, DAY0 + dt.timedelta(days=2 * i if code == 4 else i), p, p + 1, p - 1, p, rng.uniform(1, 500), 1.0, 0.1, rng.choice([None, rng.uniform(-9, 9)])))
    return spark.createDataFrame(rows, "code int, day date, open double, high double, low double, close double, volume double, amount double, turnover double, net_inflow double")


def test_feature_columns_are_those_of_the_table(spark):
    b = bars(spark)
    table = {(r.code, r.day): r for r in of.feature_table(b).collect()}
    names = ["close", "amount", "ma20", "macd", "rsi6", "kdj_k", "atr", "fund_flow5", "volume_ratio", "bar_no"]
    got = of.feature_columns(b, names).collect()
    assert len(got) == len(table) and all([r[c] for c in names] == [table[r.code, r.day][c] for c in names] for r in got)
    days = {c: sorted(d for k, d in table if k == c) for c in (1, 2, 4)}
    master = spark.createDataFrame([(1, "a"), (4, "x"), (4, "y")], "code int, industry string")
    for r in of.feature_columns(b, ["close", "previous_day", "previous_macd", "future", "industry"], master).collect():
        i = days[r.code].index(r.day)
        at = lambda j, c: table[r.code, days[r.code][j]][c] if 0 <= j < len(days[r.code]) else None
        assert (r.previous_day, r.previous_macd, r.future) == (at(i - 1, "day"), at(i - 1, "macd"), at(i + 5, "close"))
        assert r.industry in {1: ("a",), 2: (None,), 4: ("x", "y")}[r.code]
    assert of.feature_columns(b, ["industry"], master).count() == 140 + 1 + 2 * 70
    text = plan(of.feature_columns(b, ["close", "future", "industry"], master))
    assert "Window" not in text and re.search(r"Project \[code#\d+, day#\d+, close#\d+\]", text)  # what is exchanged


def test_screening_meets_the_calendar_alone(spark, monkeypatch):
    b = bars(spark)
    f = of.feature_table(b)
    rows = {(r.code, r.day): r for r in f.collect()}
    dates = sorted({d for _, d in rows})
    stored = []
    monkeypatch.setattr(of, "materialized", lambda df: stored.append(df) or df)
    narrow = of.screening_facts(of.feature_columns(b, [*of.SCREENED, *of.BEFORE]))
    for got in (narrow, of.screening_facts(f)):
        seen = {(r.code, r.day): r for r in got.collect()}
        assert set(seen) == set(rows)
        for (code, day), r in seen.items():
            i = dates.index(day)
            p = rows.get((code, dates[i - 1])) if i else None
            x = rows[code, day]
            assert r.coverage == (1.0 if p else 0.5)
            assert r.macd_golden == bool(p and p.macd <= 0 < x.macd) and r.break_ma20 == bool(p and p.close <= p.ma20 and x.close > x.ma20)
            assert r.boll_breakout == bool(p and p.close <= p.boll_upper and x.close > x.boll_upper > 0)
            assert r.pattern_count == len(r.conditions) and ("MACD_GOLDEN_FORK" in r.conditions) == r.macd_golden
    assert any(r.coverage == 0.5 for r in seen.values() if r.code == 4) and any(r.macd_golden for r in seen.values())
    # flags and one day are all that is stored, and no row meets another table than the calendar
    assert {t for df in stored for c, t in df.dtypes if c not in ("code", "day")} == {"boolean", "date"}
    rest = of.screened(of.screening_conditions(spark.range(0).select(F.col("id").alias("code"), F.current_date().alias("day"), *[F.lit(1.0).alias(c) for c in of.SCREENED], *[F.lit(None).cast("date" if c == "previous_day" else "double").alias(c) for c in of.BEFORE])))
    assert "SortMergeJoin" not in plan(rest) and exchanges(plan(rest)) <= 1  # the days of the calendar


def test_facts_of_one_source_travel_in_one_row(spark, monkeypatch):
    from barloom.operators import facts as ft

    at = lambda h: dt.datetime.combine(DAY0, dt.time(h))
    names = "code long, day date, available_at timestamp, change_type int, keep_times int, seal_ratio double, explode_count int, exploded boolean, plate_heat int, model string, independent boolean, score double"
    rows = [(1, DAY0, at(2), 4, 1, 0.5, 0, True, 7, "a", True, 5.0), (1, DAY0, at(3), 8193, 2, 0.1, 1, False, 8, "b", False, 4.0), (1, DAY0, at(9), 99, 3, 0.2, 1, False, 9, "c", True, 9.0), (2, DAY0, None, 4, 1, 0.5, 0, True, 7, "a", None, 1.0)]
    base = spark.createDataFrame([(1, DAY0, at(4), "x"), (2, DAY0, at(4), "y")], "code long, day date, decision_as_of timestamp, event string")

    def loaders(*frames):
        kinds = (ft.event_facts, ft.limit_up_facts, ft.recommendation_facts, ft.candidate_facts)
        return {k: f(s) for k, f, s in zip(("event", "limitup", "recommendation", "candidate"), kinds, frames)}

    li = spark.createDataFrame(rows, names)
    apart = ft.known_facts(base, loaders(*[spark.createDataFrame(rows, names) for _ in range(4)]))
    for latest in (None, F.col("day").cast("timestamp") + F.make_interval(hours=F.lit(4))):
        together = ft.known_facts(base, loaders(li, li, li, li), latest=latest)
        # base and line rows: two streams meet, in one exchange
        assert plan(together).count("Union") == 1 and plan(together).count("Scan ExistingRDD") == 2 and exchanges(plan(together)) == 1
        assert sorted(together.collect()) == sorted(apart.collect())
    got = {r.code: r for r in together.collect()}
    assert (got[1].event_change_count, got[1].limitup_keep_times, got[1].recommendation_count, got[1].candidate_score) == (2.0, 2.0, 1.0, 4.0)
    assert (got[2].event, got[2].event_change_count, got[2].recommendation_count) == ("y", None, None)


@pytest.mark.parametrize("name", ["external_facts", "factor_external_ids"])
def test_external_ids_store_one_narrow_row_a_bar(name, spark, sf, monkeypatch):
    from barloom.plans import facts as plans

    stored = []
    monkeypatch.setattr(plans, "materialized", lambda df: stored.append(df) or df)
    df = load()[name].run(spark, sf)
    assert len(stored) == 1 and sum(t == "double" for _, t in stored[0].dtypes) <= 4
    assert plan(df).count("FileScan parquet") <= 40 and not re.search(r"Window \[.*lead\(", plan(df))


def test_vote_columns_are_their_windows(spark):
    from barloom.indicators import recurrent as rc
    from barloom.indicators import rolling as ro
    from barloom.indicators import vote
    from barloom.operators.recurrence import by_instrument

    b = bars(spark, ((1, 170), (2, 61), (3, 1), (4, 20)), seed=9).withColumn("volume", F.when(F.col("day") == DAY0 + dt.timedelta(days=30), 0.0).otherwise(F.col("volume")))
    b = b.withColumns({c: F.when(F.col("code") == 4, F.lit(5.0)).otherwise(F.col(c)) for c in ("high", "low", "close")})
    df = rc.run(rc.with_inputs(by_instrument(b.select("code", "day", "open", "high", "low", "close", "volume"))), vote.RECIPES, carry=("open", "high", "low", "close", "volume"), prepared=True)
    steps = "moving_averages bollinger_pop vwap_bands hull ichimoku donchian alligator pivot_points cci williams_r stoch_rsi rsi_cutler aroon cmo roc coppock awesome obv_vol0 mfi cmf accumulation choppiness ulcer".split()
    windows = ro.together(df, [{"mass_index": ro.R.sum("mass_ratio", 25)}], *[getattr(ro, n).levels() for n in steps])
    trend = {(r.code, r.day): r.sats_dir for r in rc.sats(b).collect()}
    want = {(r.code, r.day): r for r in windows.collect()}
    table = vote.indicator_table(b)
    got = table.collect()
    assert len(got) == len(want) == 252 and len(table.columns) == 2 + 1 + 71
    for r in got:
        for c in table.columns[3:]:
            w = trend[r.code, r.day] if c == "sats_dir" else want[r.code, r.day][c]
            assert r[c] == (pytest.approx(w, rel=1e-7, abs=1e-6) if isinstance(w, float) else w), (c, r.code, r.day)
    # bars meet by instrument once; no window, and no second exchange between the passes
    text = plan(vote.summary(vote.vote(b)))
    assert exchanges(text) == 1 and "Window" not in text and text.count("Sort [") == 1


def test_settled_blocks_round_as_columns_do(spark):
    from barloom.functions.numeric import rnd
    from barloom.indicators.blocks import filled, settled

    x = [0.0, -0.0, 0.5e-6, -0.5e-6, 1.4999999999e-6, 123456.7890125, -2.5, 1e12 + 0.1, 1e300]
    want = [r.y for r in spark.createDataFrame([(v,) for v in x], "x double").select(rnd("x", 6).alias("y")).collect()]
    assert settled(np.array([x]), 6)[0].tolist() == want
    gap = np.array([[np.nan, 1.0], [2.0, np.nan], [np.nan, np.nan]])
    assert [[None if v != v else v for v in row] for row in filled(gap).tolist()] == [[None, 1.0], [2.0, 1.0], [2.0, 1.0]]


def test_recommendations_are_placed_after_the_exchange(spark):
    from barloom.operators import facts as ft

    rng = random.Random(11)
    words = {"hold": 50, "strong": 75, "buy": 65, "?": 45}
    rows = [(rng.randrange(4), dt.datetime.combine(DAY0 + dt.timedelta(days=rng.choice([rng.randrange(20), rng.randrange(400)])), dt.time(rng.randrange(3))), i, rng.choice(list(words)), float(i), 1.0, -float(i)) for i in range(160)]
    days = {DAY0 + dt.timedelta(days=i) for i in range(-3, 460) if i % 7}
    recs = spark.createDataFrame(rows, "code long, data_time timestamp, id long, rating string, close_price double, price double, stop_loss double")
    out = ft.recommendation_candidates(recs, spark.createDataFrame([(d,) for d in days for _ in range(2)], "day date"))
    want = {}
    for code in range(4):
        for day in days:
            seen = [r for r in rows if r[0] == code and 0 <= (day - r[1].date()).days <= 30]
            if seen:
                top = max(seen, key=lambda r: (r[1], r[2]))
                want[code, day] = (max(words[r[3]] for r in seen), len(seen), top[3], top[4] if top[4] > 0 else 1.0, top[6], top[1])
    got = out.collect()
    assert {(r.code, r.day): (r.score, r.recommendations, r.rating, r.reference_price, r.stop_loss, r.available_at) for r in got} == want and len(got) == len(want) > 300
    # the days that a recommendation reaches are no rows of an exchange
    text = plan(ft.recommendation_candidates(recs, spark.createDataFrame([(d,) for d in days], "day date")))
    assert not re.search(r"Exchange hashpartitioning.*\n(.*\n){0,8}.*Generate explode", text)


def test_preprocess_of_wide_rows(spark, sf):
    from barloom.operators import factors

    rng = random.Random(12)
    names = ["a", "b", "c", "d", "e"]
    rows = [(i % 45, DAY0 + dt.timedelta(days=i // 45), rng.choice(["s", "t"]), rng.gauss(0, 1), rng.choice([None, 1.0, rng.random()]), 2.0, None if i // 45 > 3 else rng.random(), rng.gauss(0, 9) if i % 45 < 7 else None, float("nan") if i % 45 == 1 else rng.random()) for i in range(900)]
    wide = spark.createDataFrame(rows, "code int, day date, sector string, y double, a double, b double, c double, d double, e double")

    def values(df):
        return {(r.factor, r.code, r.day): [pytest.approx(v, abs=1e-9, nan_ok=True) for v in (r.winsorized, r.zscore, r.neutralized)] for r in df.collect()}

    want = values(factors.preprocess(factors.long_form(wide, names)))
    out = factors.wide_preprocess(wide, names)
    got = {(r.factor, r.code, r.day): [r.winsorized, r.zscore, r.neutralized] for r in out.collect()}
    assert got == want and len({k[0] for k in got}) == 5
    assert factors.wide_preprocess(wide.filter("code < 2"), names).count() == 0
    text = plan(load()["factor_preprocess"].run(spark, sf))
    assert "Window" not in text and not re.search(r"hashpartitioning\(factor#", text)


@pytest.mark.parametrize("name", ["factor_observations", "factor_daily_ic", "factor_stats"])
def test_observations_need_no_window(name, spark, sf):
    assert not re.search(r"Window \[.*lead\(", plan(load()[name].run(spark, sf)))


@pytest.mark.parametrize("name", ["fifo_positions", "ledger_totals", "fifo_rows"])
def test_trades_are_exchanged_once(name, spark, sf, monkeypatch):
    from barloom.operators import ledger

    stored = []
    store = ledger.materialized
    monkeypatch.setattr(ledger, "materialized", lambda df: stored.append(df) or store(df))
    load()[name].run(spark, sf).collect()
    assert len(stored) == 1 and not {"k", "struct"} & {*stored[0].columns, *[t[:6] for _, t in stored[0].dtypes]}
    # days and their trades ask for the trades by code and day, and read one exchange
    text = plan(stored[0])
    assert len(re.findall(r"hashpartitioning\(code#\d+L, day#\d+, 8\), REPARTITION_BY_NUM", text)) == 2
    text = stored[0]._jdf.queryExecution()
    stored[0].collect()
    final = text.executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") >= 1 and len(re.findall(r"[+:]- Exchange hashpartitioning\(code#\d+L, day#\d+, 8\), REPARTITION_BY_NUM", final)) == 1


def test_ledger_of_dealt_trades(spark, sf):
    from barloom.operators import ledger
    from barloom.sources import views

    plain, dealt = views.trades(spark, sf), views.trades(spark, sf, dealt=True)
    assert sorted(plain.collect()) == sorted(dealt.collect()) and plain.dtypes == dealt.dtypes
    rows = lambda df: {r.code: (r.open_volume, r.uncovered_sells, pytest.approx(r.realized), pytest.approx(r.open_cost)) for r in df.collect()}
    got = {r.code: (r.open_volume, r.uncovered_sells, r.realized, r.open_cost) for r in ledger.fifo_positions(dealt, dealt=True).collect()}
    assert got == rows(ledger.fifo_positions(plain))


def test_external_factors_meet_in_one_exchange(spark):
    from barloom.operators import facts as ft
    from barloom.operators import factors

    rng = random.Random(2)
    days = [DAY0 + dt.timedelta(days=i) for i in range(12)]
    f = spark.createDataFrame([(c, d, 10.0 + rng.random(), 10.0 + rng.random(), f"i{c % 2}", float(c)) for c in range(6) for d in days], "code long, day date, close double, future double, industry string, candidate_score double")
    lines = [(rng.randrange(7), rng.choice(days), rng.randrange(1, 8), rng.choice([None, 0.1, 0.2]), rng.choice([None, "A", "R"])) for _ in range(90)]
    li = spark.createDataFrame(lines, "code long, day date, hour int, tax double, flag string")
    at = F.col("day").cast("timestamp") + F.make_interval(hours=F.lit(4))
    facts = {
        "event": li.select("code", "day", (F.col("day").cast("timestamp") + F.make_interval(hours=F.col("hour"))).alias("available_at"), F.col("hour").cast("double").alias("change_count")),
        "limitup": ft.made_of(li, {"keep_times": F.col("tax")}, {"keep_times": ft.NEWEST}),
        "recommendation": ft.made_of(li, {"count": F.col("flag")}, {"count": ft.DISTINCT}),
        "sector": spark.createDataFrame([("i0", days[0], 5.0), ("i1", days[1], 6.0)], "industry string, day date, net_inflow double"),
        "market": spark.createDataFrame([(days[2], 7.0)], "day date, up_count double"),
    }
    ids = ["event.change_count", "limitup.keep_times", "recommendation.count", "sector.net_inflow", "market.up_count", "candidate.score"]
    out = factors.wide_external(f, facts, ids, None, decision=at)
    got = {(r.code, r.day): r for r in out.collect()}
    assert len(got) == 72 == out.count()
    for (code, day), r in got.items():
        mine = [x for x in lines if x[:2] == (code, day)]
        assert r.event_change_count == max((float(x[2]) for x in mine if x[2] <= 4), default=None)
        assert r.limitup_keep_times == max((x[3] for x in mine if x[3] is not None), default=None)
        assert r.recommendation_count == (float(len({x[4] for x in mine} - {None})) if mine else None)
        assert r.sector_net_inflow == {("i0", days[0]): 5.0, ("i1", days[1]): 6.0}.get((r.sector, day))
        assert (r.market_up_count, r.candidate_score) == (7.0 if day == days[2] else None, float(code))
    assert any(r.recommendation_count == 0.0 for r in got.values())
    text = plan(factors.wide_external(f, facts, ids, None, decision=at))
    assert exchanges(text) == 1 and "SortMergeJoin" not in text


@pytest.mark.parametrize("name, most", [("factor_external", 7), ("rule_namespaced", 5)])
def test_external_rows_are_stored_once(name, most, spark, sf, monkeypatch):
    from barloom.plans import factors, features

    stored = []
    for plans in (factors, features):
        monkeypatch.setattr(plans, "materialized", lambda df: stored.append(df) or df)
    load()[name].run(spark, sf)
    assert len(stored) == 1 and len(set(stored[0].columns) - {"code", "day", "bar_no", "move"}) <= most
    assert "data_as_of" not in stored[0].columns and "ma60" not in stored[0].columns
