"""Facts are known from their own time to the end of their day; ratings and the reach of recommendations by hand."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from barloom.operators import facts as ft
from barloom.operators import features as of
from barloom.plans import facts as plans

DAY = dt.date(2024, 3, 4)


def at(hour, day=DAY):
    return dt.datetime.combine(day, dt.time(hour))


def frames(spark):
    events = [(1, DAY, at(9), 8193), (1, DAY, at(11), 4), (1, DAY, None, 4), (None, DAY, at(9), 4), (1, DAY + dt.timedelta(1), at(9), 8201), (2, DAY, at(10), 99)]
    boards = [(1, DAY, at(9), 1, 0.5, 0, True, 7), (1, DAY, at(12), 2, 0.25, 3, False, None), (1, DAY, at(9), 1, 0.4, 0, True, 9)]
    recs = [(1, DAY, at(9), "a", True), (1, DAY, at(10), "a", True), (1, DAY, at(10), "b", True), (1, DAY, at(9), "c", False)]
    return {
        "event": ft.event_facts(spark.createDataFrame(events, "code long, day date, available_at timestamp, change_type int")),
        "limitup": ft.limit_up_facts(spark.createDataFrame(boards, "code long, day date, available_at timestamp, keep_times int, seal_ratio double, explode_count int, exploded boolean, plate_heat int")),
        "recommendation": ft.recommendation_facts(spark.createDataFrame(recs, "code long, day date, available_at timestamp, model string, independent boolean")),
        "market": ft.market_facts(spark.createDataFrame([(DAY, 1.0), (DAY, -1.0), (DAY, 2.0), (DAY, None), (DAY + dt.timedelta(1), 0.0)], "day date, move double")),
    }


def decisions(spark, *rows):
    return spark.createDataFrame(list(rows), "code long, day date, decision_as_of timestamp, event string")


def test_each_decision_sees_what_was_known(spark):
    base = decisions(spark, (1, DAY, at(8), "x"), (1, DAY, at(9), "x"), (1, DAY, at(23), "y"), (1, DAY, at(23), "y"), (2, DAY, at(10), "z"), (None, DAY, at(10), "n"))
    got = ft.known_facts(base, frames(spark)).orderBy("code", "decision_as_of").collect()
    assert [r["event"] for r in got] == ["n", "x", "x", "y", "y", "z"]
    assert [r["event_change_count"] for r in got] == [None, None, 1.0, 2.0, 2.0, 1.0]
    assert [r["event_has_limit_up"] for r in got] == [None, None, 0.0, 1.0, 1.0, 0.0]
    assert [r["limitup_keep_times"] for r in got] == [None, None, 1.0, 2.0, 2.0, None]
    assert [r["limitup_exploded_count"] for r in got] == [None, None, 1.0, 3.0, 3.0, None]
    assert [r["limitup_seal_ratio"] for r in got] == [None, None, 0.5, 0.25, 0.25, None]  # equal times: the larger values
    assert [r["recommendation_model_count"] for r in got] == [None, None, 1.0, 2.0, 2.0, None]
    assert {r["market_up_ratio"] for r in got} == {2 / 3} and {r["market_advance_decline"] for r in got} == {1.0}


def test_empty_frames_and_other_days(spark):
    none = ft.known_facts(decisions(spark), frames(spark))
    assert none.count() == 0 and "recommendation_count" in none.columns
    later = ft.known_facts(decisions(spark, (1, DAY + dt.timedelta(1), at(9, DAY + dt.timedelta(1)), "")), frames(spark)).collect()
    assert len(later) == 1 and later[0]["limitup_keep_times"] is None and later[0]["event_change_count"] == 1.0  # known a day ahead, for its own day only
    assert later[0]["market_up_ratio"] is None and later[0]["market_up_count"] == 0.0


def test_unknown_ids_are_refused(spark):
    with pytest.raises(ValueError):
        ft.known_facts(decisions(spark), frames(spark), ["event.colour"])


def test_one_exchange_for_all_namespaces(spark):
    base = decisions(spark, (1, DAY, at(9), ""))
    facts = frames(spark)
    keyed = {k: v for k, v in facts.items() if k != "market"}
    text = ft.known_facts(base, keyed)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1 and "Join" not in text


def test_every_registered_id_has_a_loader():
    assert set(plans.IDS) == set(of.EXTERNAL) and len(plans.COLUMNS) == len(set(plans.COLUMNS))


def test_rating_points(spark):
    words = [" STRONG sell", "买入", "增持", "Buy", "谨慎推荐", "hold", "", None, "中性"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(ft.rating_points(F.col("w")).alias("p")).collect()
    assert [r["p"] for r in got] == [75, 75, 65, 65, 65, 50, 45, 45, 50]


def test_recommendations_reach_thirty_days(spark):
    rows = [(1, at(9), 5, "hold", 0.0, 8.0, 7.0), (1, at(9), 6, "strong", 10.0, 9.0, 6.0), (1, at(9, DAY + dt.timedelta(30)), 1, None, None, None, None), (None, at(9), 9, "buy", 1.0, 1.0, 1.0), (2, None, 9, "buy", 1.0, 1.0, 1.0)]
    recs = spark.createDataFrame(rows, "code long, data_time timestamp, id long, rating string, close_price double, price double, stop_loss double")
    days = spark.createDataFrame([(DAY + dt.timedelta(n),) for n in (-1, 0, 30, 31, 60, 61)], "day date")
    got = {(r["day"] - DAY).days: r for r in ft.recommendation_candidates(recs, days).collect()}
    assert sorted(got) == [0, 30, 31, 60]
    assert [got[k]["score"] for k in (0, 30, 31, 60)] == [75, 75, 45, 45] and got[30]["recommendations"] == 3
    assert (got[0]["rating"], got[0]["reference_price"], got[0]["stop_loss"]) == ("strong", 10.0, 6.0)
    assert (got[30]["rating"], got[30]["reference_price"]) == (None, 0.0)
