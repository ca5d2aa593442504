"""Streams over several files give the batch answer."""

import pytest
from pyspark.sql import functions as F

from barloom.sources import views
from barloom.streaming import streams as st


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The events in four files in time order, so a stream needs several triggers."""
    out = tmp_path_factory.mktemp("stream") / "events.parquet"
    out.mkdir()
    e = views.table(spark, sf, "events").toPandas().sort_values("ts")
    step = len(e) // 4 + 1
    for i in range(4):
        e.iloc[i * step : (i + 1) * step].to_parquet(out / f"part-{i}.parquet", coerce_timestamps="us", index=False)
    return str(out.parent)


def test_bars_over_triggers(spark, folder, sf):
    got = st.run_to_table(st.tumbling_bars(st.ticks_of(st.events_stream(spark, folder))), ["code", "bar"])
    want = st.tumbling_bars(st.ticks_of(views.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_alert_state_survives_triggers(spark, folder, sf):
    got = st.run_to_table(st.price_alerts(st.ticks_of(st.events_stream(spark, folder)).withColumn("low", F.lit(5.0))), mode="append")
    rows = views.table(spark, sf, "events").toPandas().sort_values(["ts", "event_id"])
    want = set()
    for code, g in rows.groupby("event_type"):
        state = (0.0, 0.0)
        for _, r in g.iterrows():
            state, hit = st.price_step(state, r.ts.timestamp(), r.value, 5.0)
            if hit:
                want.add((code, r.event_id))
    assert {(r.code, r.event_id) for r in got.collect()} == want and want


def test_rollup_over_triggers(spark, folder, sf):
    got = st.run_to_table(st.day_rollup(st.changes_of(st.events_stream(spark, folder))), ["code", "day"])
    n = views.table(spark, sf, "events").count()
    assert got.agg(F.sum("event_count")).first()[0] == n


def test_decision_alert_steps():
    s, out = ("", 0.0), []
    for t, active in ((0, True), (60, True), (120, False), (300, True), (3000, True), (3060, False)):
        s, change = st.decision_step(s, float(t), active)
        out.append(change)
    assert out == ["new", "", "resolved", "", "new", "resolved"]


def test_ingest_unique(spark, folder):
    e = st.events_stream(spark, folder).select("event_type")
    assert st.ingest_unique(e, ["event_type"]).count() == 5


def test_a_batch_that_runs_again_leaves_its_rows_once(spark, tmp_path):
    folder = str(tmp_path / "replay")
    for number in (0, 1, 1, 0):
        st.store_batch(spark.range(number * 10, number * 10 + 10), folder, number)
    assert sorted(r.id for r in spark.read.parquet(f"{folder}/rows").collect()) == list(range(20))


def test_zone_steps():
    def run(zone, bound, ticks):
        s, out = (0.0, 0.0), []
        for t, price in ticks:
            s, hit = st.zone_step(s, float(t), price, bound, zone)
            out.append(hit)
        return out

    assert run("buy", 5.0, [(1, 6.0), (2, 5.0), (3, 4.0), (4, 6.0), (5, 5.0), (400, 6.0), (401, 5.0)]) == [False, True, False, False, False, False, True]
    assert run("profit", 9.0, [(1, 8.0), (2, 9.0), (3, 10.0), (400, 8.0), (401, 9.5)]) == [False, True, False, False, True]
    assert run("cost", 5.0, [(1, 5.0), (2, 4.9)]) == [False, True]


def test_a_tick_meets_a_recommendation_once(spark, folder):
    """All zones of a recommendation are one group and get a tick as one row, a zone without a bound none at all."""
    e = st.events_stream(spark, folder).select("event_id", "ts", F.col("user_id").alias("code"), F.col("value").alias("price"))
    codes = spark.read.parquet(f"{folder}/events.parquet").select(F.col("user_id").alias("code")).distinct()
    recs = codes.select("code", F.lit(7).cast("long").alias("rec"), F.lit(5).alias("buy"), F.lit(0).alias("profit"), F.lit(None).cast("int").alias("loss"), F.lit(20).alias("cost"))
    alerts = st.zone_alerts(e, recs)
    assert "explode" not in alerts._jdf.queryExecution().analyzed().toString()
    got = {(r.code, r.rec, r.zone, r.event_id) for r in st.run_to_table(alerts, mode="append").collect()}
    want, states = set(), {}
    for r in spark.read.parquet(f"{folder}/events.parquet").orderBy("ts", "event_id").collect():
        for zone, bound in (("buy", 5.0), ("cost", 20.0)) if r.value > 0 else ():
            s, hit = st.zone_step(states.get((r.user_id, zone), (0.0, 0.0)), r.ts.timestamp(), r.value, bound, zone)
            states[r.user_id, zone] = s
            want |= {(r.user_id, 7, zone, r.event_id)} if hit else set()
    assert got == want and want


def test_advice_steps():
    assert st.advice_step("", "BUY", "hold") is None and st.advice_step("BUY", "BUY", "hold") is None
    assert st.advice_step("BUY", "SELL", "hold") == ("BUY", "SELL", "high")
    assert st.advice_step("BUY", "SELL", "watch") == ("BUY", "WATCH", "low")
