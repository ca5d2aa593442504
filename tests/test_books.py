"""Alert books and sessions: any order of triggers, ends by timer, closing rows."""

import pytest
from pyspark.sql import functions as F

from barloom.sources import views
from barloom.streaming import books as bk
from barloom.streaming import streams as st


@pytest.fixture(scope="module")
def shuffled(spark, sf, tmp_path_factory):
    """The events in five files; two of them hold neighbouring events in each other's place."""
    out = tmp_path_factory.mktemp("shuffled") / "events.parquet"
    out.mkdir()
    e = views.table(spark, sf, "events").toPandas().sort_values("ts").reset_index(drop=True)
    part = (e.index * 5 // len(e)).to_numpy().copy()
    for edge in range(1, 5):
        near = e.index[(part == edge)][:6]
        part[near[::2]] = edge - 1  # early in the file before
        part[near[0] - 5 : near[0] - 1] = edge  # late: in the file after
    for i in range(5):
        e[part == i].sample(frac=1.0, random_state=i).to_parquet(out / f"part-{i}.parquet", coerce_timestamps="us", index=False)
    return str(out.parent)


def recs_of(events, days):
    c, start = F.col("code"), F.date_trunc("day", "ts").cast("timestamp")
    r = events.select(F.col("user_id").alias("code"), start.alias("start")).distinct().withColumn("stop", F.col("start") + F.make_interval(days=F.lit(days)))
    r = r.withColumn("rec", F.datediff("start", F.lit("2024-01-01").cast("date")).cast("long"))
    return r.select("code", "rec", "start", "stop", (c % 5 + 6).alias("buy"), (c % 30 + 40).alias("profit"), (c % 3).alias("loss"), (c % 7 + 20).alias("cost"))


def by_hand(events, recs):
    want = set()
    for r in recs:
        ticks = sorted((e["ts"], e["event_id"], e["value"]) for e in events if e["user_id"] == r["code"] and r["start"] <= e["ts"] < r["stop"] and e["value"] > 0)
        for zone in st.ZONES:
            state, is_open = (0.0, 0.0), False
            if r[zone] <= 0:
                continue
            for ts, i, price in ticks:
                state, hit = st.zone_step(state, ts.timestamp(), price, float(r[zone]), zone)
                if hit:
                    is_open = True
                    want.add((r["code"], r["rec"], zone, i, "new"))
                elif is_open and not bk._inside(price, float(r[zone]), zone):
                    is_open = False
                    want.add((r["code"], r["rec"], zone, i, "resolved"))
            if is_open:
                want.add((r["code"], r["rec"], zone, None, "expired"))
    return want


@pytest.mark.parametrize("days", [1, 3])
def test_triggers_out_of_order(spark, shuffled, days):
    own = bk.stateful_session(spark)
    table = own.read.parquet(f"{shuffled}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    recs = recs_of(table, days)
    events, close = st.closed_events_stream(own, shuffled)
    ticks = events.select("event_id", "ts", F.col("user_id").alias("code"), F.col("value").alias("price"))
    got = st.run_to_table(bk.zone_book(ticks, recs, "6 hours"), mode="append", close=close)
    rows = [(r["code"], r["rec"], r["zone"], r["event_id"], r["status"]) for r in got.collect()]
    assert len(rows) == len(set(rows))
    want = by_hand(table.collect(), recs.collect())
    assert set(rows) == want and {w[4] for w in want} == {"new", "resolved", "expired"}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != bk.ROCKS


def test_append_sessions_over_triggers(spark, shuffled):
    events, close = st.closed_events_stream(spark, shuffled)
    got = st.run_to_table(st.sessions(events, delay="6 hours"), mode="append", close=close).filter("user_id >= 0")
    batch = spark.read.parquet(f"{shuffled}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = st.sessions(batch)
    key = lambda df: sorted((r["user_id"], r["start"], r["end"], r["n"], round(r["value"], 6)) for r in df.collect())
    assert key(got) == key(want)


def test_state_ends(spark, shuffled):
    """Recommendations that ended long before the ticks leave no row."""
    own = bk.stateful_session(spark)
    table = own.read.parquet(f"{shuffled}/events.parquet")
    recs = recs_of(table, 1).withColumns({c: F.col(c) - F.make_interval(years=F.lit(1)) for c in ("start", "stop")})
    events, close = st.closed_events_stream(own, shuffled)
    ticks = events.select("event_id", "ts", F.col("user_id").alias("code"), F.col("value").alias("price"))
    assert st.run_to_table(bk.zone_book(ticks, recs), mode="append", close=close).count() == 0
