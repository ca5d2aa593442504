"""Hand-checked cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.functions import codes, dates
from barloom.indicators import recurrent as rc
from barloom.operators import backtest, factors, features, filters, ranking
from barloom.sources import readers, sinks

DAY0 = dt.date(2024, 1, 1)


def bars(spark, closes, code="a", **over):
    rows = []
    for i, c in enumerate(closes):
        row = {"code": code, "day": DAY0 + dt.timedelta(days=i), "open": c, "high": c + 1, "low": c - 1, "close": c, "volume": 1000.0, "amount": c * 1000.0, "turnover": 0.02}
        row.update({k: v[i] for k, v in over.items()})
        rows.append(tuple(float(x) if isinstance(x, int) else x for x in row.values()))
    return spark.createDataFrame(rows, "code string, day date, open double, high double, low double, close double, volume double, amount double, turnover double")


def test_rising_series(spark):
    f = features.feature_table(bars(spark, [100.0 + i for i in range(80)])).orderBy(F.desc("day")).first()
    assert f.ma5 == 177 and abs(f.change_rate5 - 5 / 174) < 1e-12
    assert f.rsi6 >= 99 and f.macd > 0 and 50 < f.kdj_k <= 100 and f.atr > 0


def test_flat_series(spark):
    b = bars(spark, [10.0] * 70).withColumns({"high": F.lit(10.0), "low": F.lit(10.0)})
    f = features.feature_table(b).orderBy(F.desc("day")).first()
    assert f.rsi6 == 50 and f.macd == 0 and f.kdj_k == 50


def test_ic_is_averaged_per_day(spark):
    rows = [("f", c, DAY0 + dt.timedelta(days=d), "s", float(c), float(c if d == 0 else -c)) for d in (0, 1) for c in (1, 2, 3)]
    obs = spark.createDataFrame(rows, "factor string, code int, day date, sector string, x double, y double")
    s = factors.ic_summary(obs).first()
    assert abs(s.ic) < 1e-12 and abs(s.rank_ic) < 1e-12


def test_ablation(spark):
    facts = spark.createDataFrame([("a", "event"), ("a", "pattern")], "code string, source string")
    row = ranking.ablation(facts, 2).filter("removed_source = 'event'").first()
    assert row.remaining == 0 and row.drop_ratio == 1


def test_codes(spark):
    df = spark.createDataFrame([("600000.SH",), ("430047",), ("000001",), ("bad",)], "c string")
    assert [r[0] for r in df.select(codes.normalize_code("c")).collect()] == ["sh600000", "bj430047", "sz000001", ""]


def test_folds(spark):
    days = spark.createDataFrame([(DAY0 + dt.timedelta(days=i),) for i in range(100)], "day date")
    plan = backtest.folds(days, 5).orderBy("fold").collect()
    assert len(plan) == 3 and (plan[0].start_day - DAY0).days > 40


def test_gap_stop_after_entry_bar(spark):
    b = bars(spark, [100.0, 100.0, 80.0, 80.0], open=[100.0, 100.0, 80.0, 80.0], low=[99.0, 85.0, 78.0, 79.0], high=[101.0, 101.0, 82.0, 81.0])
    b = b.withColumns({"entry_matched": F.col("day") == F.lit(DAY0), "exit_matched": F.lit(False), "tradable": F.lit(True)})
    t = backtest.barrier_trades(b, 0.10, 0.30, 2).first()
    assert t.reason == "stop_loss" and t.sell_price == 80 and t.buy_day == DAY0 + dt.timedelta(days=1)


def test_limit_up_blocks_a_buy(spark):
    b = bars(spark, [100.0, 110.0]).withColumns({"code": F.lit("sz000001"), "hint": F.lit(110.0)})
    assert filters.tradable(b, "buy", hint="hint").orderBy(F.desc("day")).first().tradable is False
    assert filters.tradable(b.withColumn("hint", F.lit(105.0)), "buy", hint="hint").orderBy(F.desc("day")).first().tradable is True


def test_event_payload(spark):
    df = spark.createDataFrame([("15204345,7.57,-0.028947,11500000.00", 8193)], "payload string, change_type int")
    r = readers.parse_change_items(df).first()
    assert r.volume == 15204345 and r.price == 7.57 and abs(r.rate + 2.8947) < 1e-9 and r.amount == 11500000


def test_session_clock(spark):
    at = [("2024-01-02 09:29:00", False), ("2024-01-02 09:30:00", True), ("2024-01-02 11:31:00", False), ("2024-01-02 13:00:00", True), ("2024-01-02 15:01:00", False)]
    df = spark.createDataFrame(at, "t string, want boolean").withColumn("t", F.to_timestamp("t"))
    assert all(r[0] == r[1] for r in df.select(dates.on_session("t", "a"), "want").collect())


def test_cross_needs_a_previous_row(spark):
    df = spark.createDataFrame([("a", 1, 9.0, 10.0), ("a", 2, 11.0, 10.0), ("b", 1, 11.0, 10.0)], "code string, day int, close double, ma20 double")
    m = features.match_rule(df, {"entry": [{"indicator": "close", "op": "cross_up", "ref": "ma20"}], "exit": []})
    assert [(r.code, r.day) for r in m.filter("entry_matched").collect()] == [("a", 2)]
    assert m.filter("exit_matched").count() == 0


def test_rule_validation():
    bad = {"entry": [{"indicator": "chikou", "op": ">", "value": 1}, {"indicator": "rsi6", "op": ">", "ref": "close"}, {"indicator": "nope", "op": "~", "lag": 3}], "stop_loss": 0.5}
    text = " ".join(features.validate_rule(bad))
    for part in ("looks ahead", "unit mismatch", "not registered", "operator", "lag is 0 or 1", "stop_loss"):
        assert part in text


def test_quote_parser_keeps_rejects(spark):
    good = 'var hq_str_sh600000="X,1,2,3,4,0.5,a,b,7,8' + ",0" * 20 + ',2024-01-02,09:31:00,00";'
    df = spark.createDataFrame([(good,), ('var hq_str_sz000001="short,1";',), ("garbage",)], "line string")
    ok, bad = readers.parse_quote_lines(df)
    assert ok.first().price == 3 and ok.count() == 1 and bad.count() == 2


def test_upsert_and_partitions(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "ck"))
    a = spark.createDataFrame([("x", DAY0, 1.0), ("y", DAY0, 2.0)], "code string, day date, v double")
    b = spark.createDataFrame([("x", DAY0, 9.0), ("z", DAY0 + dt.timedelta(days=1), 3.0)], "code string, day date, v double")
    path = str(tmp_path / "t")
    sinks.upsert_partitions(a, path, ["code", "day"])
    sinks.upsert_partitions(b, path, ["code", "day"])
    assert sorted((r.code, r.v) for r in spark.read.parquet(path).collect()) == [("x", 9.0), ("y", 2.0), ("z", 3.0)]


@pytest.mark.parametrize("name", ["ema", "atr_wilder", "adx", "supertrend", "sar", "trix", "kdj"])
def test_past_does_not_depend_on_the_future(spark, name):
    closes = [100 + (i * 37 % 23) - (i * 11 % 7) for i in range(120)]
    _, _, outs = rc.RECIPES[name]
    whole = rc.run(bars(spark, closes), [name]).orderBy("day").limit(90).select(*outs).collect()
    cut = rc.run(bars(spark, closes[:90]), [name]).orderBy("day").select(*outs).collect()
    assert whole == cut
