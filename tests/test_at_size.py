"""Operators at size: rows that a step may exchange, and results that may not depend on how rows are dealt."""

import datetime as dt
import random
import re
import statistics

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.indicators import recurrent as rc
from barloom.operators import factors
from barloom.operators import joins as oj
from barloom.operators.recurrence import in_blocks
from barloom.operators.windows import Roll
from barloom.plans.catalog import load

DAY0 = dt.date(2024, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffled(df):
    """The same rows in another order at every reading."""

    def run(batches):
        import random

        for b in batches:
            order = list(range(b.num_rows))
            random.SystemRandom().shuffle(order)
            yield b.take(pa.array(order))

    return df.coalesce(1).mapInArrow(run, df.schema)


def test_news_labels_of_copies(spark):
    from barloom.plans import ledger as ql
    from barloom.plans import streams

    words = ql._lexicon(spark).filter("kind IN ('positive', 'negative')").collect()
    assert words
    texts = [" ".join([w.word] * 5) for w in words]
    docs = spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(40 * len(texts))], "doc_id long, text string")
    got = {(r.text, r.label) for r in streams.news_labels(_shuffled(docs)).collect()}
    assert got == {(t, w.kind) for t, w in zip(texts, words)}


def test_sector_medians_are_made_once_a_set(spark):
    rng = random.Random(3)
    days = [DAY0 + dt.timedelta(days=i) for i in range(9)]
    stocks = [(i, rng.choice(["i0", "i1", "", None]), rng.sample(["c0", "c1", "c2", ""], 2)) for i in range(60)]
    net = {(k, n, d): rng.uniform(-9, 9) for k, n in (("industry", "i0"), ("concept", "c0"), ("concept", "c1"), ("concept", "c2")) for d in days if rng.random() < 0.8}
    s = spark.createDataFrame(stocks, "code int, industry string, concepts array<string>")
    flows = spark.createDataFrame([(*k, v, dt.datetime(2024, 1, 1)) for k, v in net.items()], "sector_type string, sector_name string, day date, net_inflow double, data_as_of timestamp")
    out = oj.sector_net(s, flows)
    want = {}
    for code, industry, concepts in stocks:
        for d in days:
            own = [net[k] for k in [("industry", industry, d)] if k in net]
            all_ = own or [net[k] for k in [("concept", c, d) for c in concepts] if k in net]
            if all_:
                want[(code, d)] = pytest.approx(statistics.median(all_))
    assert {(r.code, r.day): r.sector_net for r in out.collect()} == want
    # no median by stock
    assert not re.search(r"keys=\[code#[^\]]*\], functions=\[[^\]]*percentile|keys=\[code#[^\]]*\], functions=\[[^\]]*median", plan(out))


def test_a_block_is_its_instruments(spark):
    rng = random.Random(8)
    lengths = [1, 2, 3, 700, 14, 15, 61, 26, 300, 140]
    col = {n: [50 + rng.uniform(-5, 5) for _ in range(sum(lengths))] for n in ("high", "low", "close", "tr")}
    col["rsv"] = [rng.choice([None, rng.uniform(0, 100)]) for _ in range(sum(lengths))]
    col["code"] = [i for i, n in enumerate(lengths) for _ in range(n)]
    whole = pa.table(col)
    for name in ("macd_sma", "supertrend", "sar", "zigzag", "keltner", "kdj"):
        fn, ins, outs = rc.RECIPES[name]
        together = [a.to_pylist() for a in in_blocks(whole, fn, "code", ins, outs)]
        at = 0
        for n in lengths:
            alone = [a.to_pylist() for a in in_blocks(whole.slice(at, n), fn, "code", ins, outs)]
            assert alone == [x[at : at + n] for x in together]
            at += n


def test_vote_runs_in_blocks(spark, sf):
    text = plan(load()["ind_vote"].run(spark, sf))
    assert text.count("MapInArrow") >= 2 and "FlatMapGroupsInArrow" not in text


def test_rolling_counts_do_not_visit_the_frame(spark):
    df = spark.createDataFrame([("a", i, None if i == 7 else float(i)) for i in range(30)], "code string, day int, x double")
    df = df.select("day", Roll().mean("x", 5).alias("m"))
    assert not re.search(r"count\([^)]*\) windowspecdefinition\([^)]*RowFrame, -\d+, currentrow", plan(df))
    got = {r.day: r.m for r in df.collect()}
    assert got == {i: None if i < 4 or 7 <= i < 12 else i - 2.0 for i in range(30)}


def _wide(spark, n=900):
    rng = random.Random(12)
    rows = [(i % 45, DAY0 + dt.timedelta(days=i // 45), rng.choice(["s", "t"]), rng.choice([0.0, rng.gauss(0, 1)]), rng.choice([None, 1.0, rng.random()]), 2.0, None if i // 45 > 3 else rng.random()) for i in range(n)]
    return spark.createDataFrame(rows, "code int, day date, sector string, y double, a double, b double, c double")


def test_daily_ic_of_wide_rows(spark):
    wide, names = _wide(spark), ["a", "b", "c"]
    long = factors.long_form(wide, names)

    def rows(df):
        return {(r.factor, r.day): (r.n, pytest.approx(r.ic, abs=1e-12), pytest.approx(r.rank_ic, abs=1e-12)) for r in df.collect()}

    got = {(r.factor, r.day): (r.n, r.ic, r.rank_ic) for r in factors.wide_daily_ic(wide, names).collect()}
    assert got == rows(factors.daily_ic(long)) and len(got) == 44
    recent = {(r.factor, r.day): (r.n, r.ic, r.rank_ic) for r in factors.wide_daily_ic(factors.wide_recent(wide, names), names).collect()}
    assert recent == rows(factors.daily_ic(factors.recent_share(long)))


@pytest.mark.parametrize("name", ["factor_daily_ic", "factor_external", "factor_external_ids"])
def test_cross_sections_are_exchanged_once(name, spark, sf):
    assert "windowspecdefinition(factor#" not in plan(load()[name].run(spark, sf))


def test_layers_exchange_no_rows(spark):
    rng = random.Random(6)
    rows = [(f, i % 40, DAY0 + dt.timedelta(days=i // 40), rng.choice([1.0, 1.0, 2.0, rng.random()]), rng.uniform(-1, 1)) for f, n in (("f", 2003), ("g", 31), ("h", 29)) for i in range(n)]
    df = spark.createDataFrame(rows, "factor string, code int, day date, x double, y double")
    out = factors.layer_returns(df)
    want = {}
    for f in "fg":
        mine = sorted((r for r in rows if r[0] == f), key=lambda r: (r[3], r[2], r[1]))
        size = len(mine) // 5
        for k, name in enumerate(factors.LAYERS):
            part = [r[4] for r in mine[k * size : (k + 1) * size if k < 4 else None]]
            want[(f, name)] = (len(part), pytest.approx(np.mean(part)), pytest.approx(np.mean([y > 0 for y in part])))
    assert {(r.factor, r.layer): (r.n, r.avg_return, r.hit_rate) for r in out.collect()} == want
    assert not re.search(r"hashpartitioning\(factor#\d+, x#", plan(out))


def test_feature_row_is_its_windows(spark):
    from barloom.indicators import rolling as ro
    from barloom.operators import features as of

    rng = random.Random(21)
    rows = []
    for code, n in ((1, 200), (2, 61), (3, 60), (4, 130)):
        for i in range(n):
            p = 10 + rng.uniform(-3, 3) if code != 4 else 5.0
            rows.append((code, DAY0 + dt.timedelta(days=i), p, p + 1, p - 1, p, rng.choice([0.0, 100.0, rng.uniform(1, 500)]), 1.0, 0.1, rng.choice([None, rng.uniform(-9, 9)])))
    bars = spark.createDataFrame(rows, "code int, day date, open double, high double, low double, close double, volume double, amount double, turnover double, net_inflow double")
    table = of.feature_table(bars)
    assert "Window" not in plan(table)
    names = "moving_averages bollinger_pop volume_ratio atr_simple change_rates log_volatility amihud high_low_ratio obv_zero fund_flow".split()
    windows = rc.with_inputs(ro.together(bars, *[getattr(ro, n).levels() for n in names])).withColumnsRenamed({"atr_sma": "atr", "obv_zero": "obv"})
    same = [c for c in table.columns if c in windows.columns]
    want = {(r.code, r.day): r for r in windows.collect()}
    got = table.collect()
    assert len(got) == 140 + 1 + 70 and len(same) == 28
    for r in got:
        for c in same:
            w = want[(r.code, r.day)][c]
            assert r[c] == (pytest.approx(w, rel=1e-9, abs=1e-12) if isinstance(w, float) else w), c


def test_pairs_are_summed_up_in_the_tasks(spark):
    rng = random.Random(5)
    rows = [(rng.gauss(1e6, 1), rng.choice([None, rng.gauss(0, 1)]), 0.1, None) for _ in range(3000)]
    rows = [(a, None if b is None else b + a - 1e6, c, d) for a, b, c, d in rows]
    wide = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(7)
    got = {(r.a, r.b): (r.n, r.rho) for r in oj.pair_correlations(wide, ["a", "b", "c", "d"]).collect()}
    both = np.array([(a, b) for a, b, _, _ in rows if b is not None])
    assert got["a", "b"] == (len(both), pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-9))
    assert got["a", "c"] == (3000, 0.0) and got["b", "c"] == (len(both), 0.0) and got["c", "d"] == (0, 0.0)
    none = oj.pair_correlations(wide.filter("a < 0"), ["a", "b", "c"]).collect()
    assert {(r.a, r.b, r.n, r.rho) for r in none} == {("a", "b", 0, 0.0), ("a", "c", 0, 0.0), ("b", "c", 0, 0.0)}
    assert "covar" not in plan(oj.pair_correlations(wide, ["a", "b"]))  # no aggregation with a state of dozens of moments


def test_selection_makes_its_summary_once(spark, sf):
    text = plan(load()["factor_selection"].run(spark, sf))
    assert "FlatMapGroupsInArrow" not in text and "MapInArrow" not in text and "Window" not in text


def test_recent_daily_ic_makes_cut_days_again_only(spark):
    wide, names = _wide(spark), ["a", "b", "c"]
    daily = factors.wide_daily_ic(wide, names)
    want = {(r.factor, r.day): (r.n, pytest.approx(r.ic, abs=1e-12), pytest.approx(r.rank_ic, abs=1e-12)) for r in factors.daily_ic(factors.recent_share(factors.long_form(wide, names))).collect()}
    assert {(r.factor, r.day): (r.n, r.ic, r.rank_ic) for r in factors.wide_recent_daily_ic(wide, names, daily).collect()} == want
    cuts = factors.recent_cuts(wide, names)
    held = factors.from_cuts(wide, names, cuts)
    assert held.select("day").distinct().count() == cuts.select("day").distinct().count() < 20


def test_preprocess_stats_of_wide_rows(spark):
    wide, names = _wide(spark).withColumn("d", F.when(F.col("code") < 7, F.col("y"))).withColumn("e", F.when(F.col("code") == 1, F.lit(float("nan"))).otherwise(F.col("y"))), ["a", "b", "c", "d", "e"]
    measures = ("mean", "std", "skewness", "kurtosis")
    want = {r.factor: (r.observations, r.days, [pytest.approx(r[m], abs=1e-9, nan_ok=True) for m in measures]) for r in factors.preprocess_stats(factors.preprocess(factors.long_form(wide, names))).collect()}
    assert {r.factor: (r.observations, r.days, [r[m] for m in measures]) for r in factors.wide_preprocess_stats(wide, names).collect()} == want


def test_stats_exchange_a_day_once(spark, sf):
    assert "windowspecdefinition(factor#" not in plan(load()["factor_stats"].run(spark, sf))


def test_stability_stores_the_trades_alone(spark, sf, monkeypatch):
    from barloom.plans import backtest, features

    stored = []
    for plans in (backtest, features):
        monkeypatch.setattr(plans, "materialized", lambda df: stored.append(df.columns) or df)
    load()["parameter_stability"].run(spark, sf)
    assert len(stored) == 1 and "net_return" in stored[0]
