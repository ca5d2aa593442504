"""Queries: streams run over the whole events table, compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.dates import day_text
from barloom.functions.numeric import lit, rnd
from barloom.operators import text as ot
from barloom.plans import ledger as ql
from barloom.plans.joins import _MOOD
from barloom.plans.registry import query
from barloom.plans.sqlkit import BULL, CHANGES, DOWN, TICKS, UP, ctes, r
from barloom.sources import views
from barloom.streaming import books as bk
from barloom.streaming import streams as st

_TS = "'%Y-%m-%d %H:%M:%S'"


def _ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("stream_dedup", "SELECT user_id, event_type, min(ts)::DATE::VARCHAR AS day FROM events GROUP BY user_id, event_type, CAST(ts AS DATE)")
def stream_dedup(spark, sf):
    e = st.events_stream(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return st.run_to_table(st.dedup(e, ["user_id", "event_type", "day"], "40 days"), mode="append").select("user_id", "event_type", "day")


@query(
    "stream_hourly_bars",
    ctes(TICKS)
    + f"""SELECT code, strftime(bar, {_TS}) AS bar, {', '.join(f'{r(c, 3)} AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))} FROM (SELECT code, date_trunc('hour', ts) AS bar, arg_min(price, ROW(ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, ROW(ts, event_id)) AS close, sum(volume) AS volume FROM ticks GROUP BY 1, 2)""",
)
def stream_hourly_bars(spark, sf):
    b = st.run_to_table(st.tumbling_bars(st.ticks_of(st.events_stream(spark, sf))), ["code", "bar"])
    return b.select("code", _ts("bar"), *[rnd(c, 3).alias(c) for c in ("open", "high", "low", "close", "volume")])


@query(
    "stream_breadth",
    ctes(CHANGES, f"g AS (SELECT date_trunc('minute', ts) AS minute, count(CASE WHEN change_type IN {UP} THEN 1 END) AS up, count(CASE WHEN change_type IN {DOWN} THEN 1 END) AS down, count(CASE WHEN change_type = 4 THEN 1 END) AS limit_up, count(CASE WHEN change_type = 8 THEN 1 END) AS limit_down FROM changes GROUP BY 1)", "h AS (SELECT *, CASE WHEN down > 0 THEN up / down ELSE up END AS x FROM g)")
    + f"SELECT strftime(minute, {_TS}) AS minute, up, down, limit_up, limit_down, {r('x', 4)} AS up_down_ratio, {_MOOD} AS mood FROM h",
)
def stream_breadth(spark, sf):
    b = st.run_to_table(st.breadth(st.changes_of(st.events_stream(spark, sf))), ["minute"])
    return b.select(_ts("minute"), "up", "down", "limit_up", "limit_down", rnd("up_down_ratio", 4).alias("up_down_ratio"), "mood")


@query(
    "stream_sessions",
    f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, strftime(min(ts), {_TS}) AS start, count(*) AS n, {r('sum(value)', 3)} AS value FROM i GROUP BY user_id, sid""",
)
def stream_sessions(spark, sf):
    # append mode: a session leaves the state when the watermark passes its end; the closing row ends the last ones
    events, close = st.closed_events_stream(spark, sf)
    s = st.run_to_table(st.sessions(events), mode="append", close=close).filter("user_id >= 0")
    return s.select("user_id", _ts("start"), "n", rnd("value", 3).alias("value"))


@query("stream_day_rollup", ctes(CHANGES) + f"SELECT code, change_date AS day, count(*) AS event_count, count(CASE WHEN change_type IN {BULL} THEN 1 END) AS bullish_count, count(CASE WHEN change_type IN {DOWN} THEN 1 END) AS bearish_count, {r('sum(amount)', 2)} AS event_amount FROM changes GROUP BY 1, 2")
def stream_day_rollup(spark, sf):
    d = st.run_to_table(st.day_rollup(st.changes_of(st.events_stream(spark, sf))), ["code", "day"])
    return d.select("code", day_text("day").alias("day"), "event_count", "bullish_count", "bearish_count", rnd("event_amount", 2).alias("event_amount"))


@query(
    "stream_price_alerts",
    """WITH RECURSIVE b AS MATERIALIZED (SELECT event_type AS code, event_id, epoch(ts) AS s, value AS p, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
rec AS (SELECT DISTINCT code, 0::BIGINT AS n, -1::BIGINT AS event_id, 0::DOUBLE AS last, 0::DOUBLE AS sent, false AS hit FROM b
  UNION ALL SELECT code, n, event_id, CASE WHEN p <= 5 THEN CASE WHEN last = 0 OR last > 5 THEN CASE WHEN f THEN p ELSE last END ELSE p END ELSE CASE WHEN last = 0 OR p > last THEN p ELSE last END END, CASE WHEN f THEN s ELSE sent END, f
  FROM (SELECT b.code, b.n, b.event_id, b.s, b.p, r.last, r.sent, b.p <= 5 AND (r.last = 0 OR r.last > 5) AND (r.sent = 0 OR b.s - r.sent >= 300) AS f FROM rec r JOIN b ON b.code = r.code AND b.n = r.n + 1))
SELECT code, event_id FROM rec WHERE hit""",
)
def stream_price_alerts(spark, sf):
    t = st.ticks_of(st.events_stream(spark, sf)).withColumn("low", lit(5))
    return st.run_to_table(st.price_alerts(t), mode="append").select("code", "event_id")


@query(
    "stream_decision_alerts",
    """WITH RECURSIVE e AS (SELECT event_type AS code, event_id, epoch(ts) AS s, value AS p, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
b AS MATERIALIZED (SELECT code, 'stop_loss' AS reason, event_id, s, n, p <= 3 AS a FROM e UNION ALL SELECT code, 'defence_price', event_id, s, n, p > 3 AND p <= 6 FROM e UNION ALL SELECT code, 'take_profit', event_id, s, n, p >= 60 FROM e UNION ALL SELECT code, 'entry_signal', event_id, s, n, p BETWEEN 10 AND 12 FROM e),
rec AS (SELECT DISTINCT code, reason, 0::BIGINT AS n, -1::BIGINT AS event_id, '' AS st, 0::DOUBLE AS t0, '' AS status FROM b
  UNION ALL SELECT code, reason, n, event_id, CASE WHEN f THEN 'new' WHEN NOT a AND st = 'new' THEN 'resolved' ELSE st END, CASE WHEN f THEN s ELSE t0 END, CASE WHEN f THEN 'new' WHEN NOT a AND st = 'new' THEN 'resolved' ELSE '' END
  FROM (SELECT b.*, r.st, r.t0, b.a AND NOT (r.st = 'new' OR (r.st = 'resolved' AND b.s - r.t0 < 1800)) AS f FROM rec r JOIN b ON b.code = r.code AND b.reason = r.reason AND b.n = r.n + 1))
SELECT code, reason, event_id, status FROM rec WHERE status <> ''""",
)
def stream_decision_alerts(spark, sf):
    codes = views.table(spark, sf, "events").select(F.col("event_type").alias("code")).distinct()
    thresholds = codes.select("code", lit(100).alias("holding_volume"), lit(3).alias("stop_price"), lit(6).alias("defence_price"), lit(60).alias("profit_price"), F.lit(True).alias("may_enter"), lit(10).alias("buy_min"), lit(12).alias("buy_max"))
    q = st.ticks_of(st.events_stream(spark, sf))
    return st.run_to_table(st.decision_alerts(q, thresholds), mode="append").select("code", "reason", "event_id", "status")


_RECS = """recs AS (SELECT DISTINCT user_id AS code, k::BIGINT AS rec FROM events, (VALUES (1), (2)) t(k)),
zn AS (SELECT code, rec, 'buy' AS zone, 1 AS sg, (4 + code % 5 + rec)::DOUBLE AS bound FROM recs UNION ALL SELECT code, rec, 'profit', -1, (40 + code % 30 * rec)::DOUBLE FROM recs
  UNION ALL SELECT code, rec, 'loss', 1, (code % 3 * rec)::DOUBLE FROM recs UNION ALL SELECT code, rec, 'cost', 1, (20 + code % 7)::DOUBLE FROM recs)"""


@query(
    "stream_zone_alerts",
    f"""WITH RECURSIVE {_RECS},
b AS MATERIALIZED (SELECT zn.code, rec, zone, sg, sg * bound AS bd, event_id, epoch(ts) AS s, value AS pr, row_number() OVER (PARTITION BY zn.code, rec, zone ORDER BY ts, event_id) AS n FROM events JOIN zn ON zn.code = user_id WHERE bound > 0 AND value > 0),
st AS (SELECT DISTINCT code, rec, zone, 0::BIGINT AS n, -1::BIGINT AS event_id, 0::DOUBLE AS last, 0::DOUBLE AS sent, false AS hit FROM b
  UNION ALL SELECT code, rec, zone, n, event_id, CASE WHEN f THEN pr WHEN i AND e THEN last WHEN i THEN pr WHEN last = 0 OR (CASE WHEN zone = 'cost' THEN sg * pr < sg * last ELSE sg * pr > sg * last END) THEN pr ELSE last END, CASE WHEN f THEN s ELSE sent END, f
  FROM (SELECT *, i AND e AND (sent = 0 OR s - sent >= 300) AS f FROM (SELECT b.*, st.last, st.sent, CASE WHEN b.zone = 'cost' THEN b.sg * b.pr < b.bd ELSE b.sg * b.pr <= b.bd END AS i, st.last = 0 OR (CASE WHEN b.zone = 'cost' THEN b.sg * st.last >= b.bd ELSE b.sg * st.last > b.bd END) AS e
    FROM st JOIN b ON b.code = st.code AND b.rec = st.rec AND b.zone = st.zone AND b.n = st.n + 1)))
SELECT code, rec, zone, event_id FROM st WHERE hit""",
)
def stream_zone_alerts(spark, sf):
    c = F.col("code")
    codes = views.table(spark, sf, "events").select(F.col("user_id").alias("code")).distinct()
    recs = codes.select("code", F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("rec"))
    recs = recs.select("code", "rec", (c % 5 + F.col("rec") + 4).alias("buy"), (c % 30 * F.col("rec") + 40).alias("profit"), (c % 3 * F.col("rec")).alias("loss"), (c % 7 + 20).alias("cost"))
    ticks = st.events_stream(spark, sf).select("event_id", "ts", F.col("user_id").alias("code"), F.col("value").alias("price"))
    return st.run_to_table(st.zone_alerts(ticks, recs), mode="append").select("code", "rec", "zone", "event_id")


@query(
    "stream_zone_book",
    f"""WITH RECURSIVE rc AS (SELECT DISTINCT user_id AS code, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS rec, CAST(ts AS DATE) AS day FROM events),
zn AS (SELECT code, rec, day, 'buy' AS zone, 1 AS sg, (4 + code % 5 + rec % 7)::DOUBLE AS bound FROM rc UNION ALL SELECT code, rec, day, 'profit', -1, (40 + code % 30)::DOUBLE FROM rc
  UNION ALL SELECT code, rec, day, 'loss', 1, (code % 3)::DOUBLE FROM rc UNION ALL SELECT code, rec, day, 'cost', 1, (20 + code % 7)::DOUBLE FROM rc),
b AS MATERIALIZED (SELECT zn.*, sg * bound AS bd, event_id, ts, epoch(ts) AS s, value AS pr, row_number() OVER (PARTITION BY zn.code, rec, zone ORDER BY ts, event_id) AS n FROM events JOIN zn ON zn.code = user_id AND zn.day = CAST(ts AS DATE) WHERE bound > 0 AND value > 0),
st AS (SELECT DISTINCT code, rec, zone, day, 0::BIGINT AS n, -1::BIGINT AS event_id, NULL::TIMESTAMP AS ts, 0::DOUBLE AS pr, 0::DOUBLE AS last, 0::DOUBLE AS sent, false AS op, '' AS status FROM b
  UNION ALL SELECT code, rec, zone, day, n, event_id, ts, pr, CASE WHEN f THEN pr WHEN i AND e THEN last WHEN i THEN pr WHEN last = 0 OR (CASE WHEN zone = 'cost' THEN sg * pr < sg * last ELSE sg * pr > sg * last END) THEN pr ELSE last END, CASE WHEN f THEN s ELSE sent END, f OR (op AND i), CASE WHEN f THEN 'new' WHEN op AND NOT i THEN 'resolved' ELSE '' END
  FROM (SELECT *, i AND e AND (sent = 0 OR s - sent >= 300) AS f FROM (SELECT b.*, st.last, st.sent, st.op, CASE WHEN b.zone = 'cost' THEN b.sg * b.pr < b.bd ELSE b.sg * b.pr <= b.bd END AS i, st.last = 0 OR (CASE WHEN b.zone = 'cost' THEN b.sg * st.last >= b.bd ELSE b.sg * st.last > b.bd END) AS e
    FROM st JOIN b ON b.code = st.code AND b.rec = st.rec AND b.zone = st.zone AND b.n = st.n + 1)))
SELECT code, rec, zone, event_id, strftime(ts, {_TS}) AS ts, pr AS price, status FROM st WHERE status <> ''
UNION ALL SELECT code, rec, zone, NULL, strftime(day + INTERVAL 1 DAY, {_TS}), last, 'expired' FROM (SELECT *, row_number() OVER (PARTITION BY code, rec, zone ORDER BY n DESC) AS k FROM st) WHERE k = 1 AND op""",
)
def stream_zone_book(spark, sf):
    """One recommendation a user and day: its state ends with the day."""
    own = bk.stateful_session(spark)
    c, day = F.col("code"), F.date_trunc("day", "ts")
    recs = views.table(own, sf, "events").select(F.col("user_id").alias("code"), day.cast("timestamp").alias("start")).distinct()
    recs = recs.withColumns({"stop": F.col("start") + F.make_interval(days=F.lit(1)), "rec": F.datediff("start", F.lit("2024-01-01").cast("date")).cast("long")})
    recs = recs.select("code", "rec", "start", "stop", (c % 5 + F.col("rec") % 7 + 4).alias("buy"), (c % 30 + 40).alias("profit"), (c % 3).alias("loss"), (c % 7 + 20).alias("cost"))
    events, close = st.closed_events_stream(own, sf)
    ticks = events.select("event_id", "ts", F.col("user_id").alias("code"), F.col("value").alias("price"))
    return st.run_to_table(bk.zone_book(ticks, recs), mode="append", close=close).select("code", "rec", "zone", "event_id", _ts("ts"), "price", "status")


@query(
    "stream_advice_changes",
    """WITH a AS (SELECT user_id AS code, event_id, ts, CASE event_id % 5 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' WHEN 2 THEN 'HOLD' WHEN 3 THEN 'ADD' ELSE 'HOLD' END AS action, user_id % 4 = 0 AS watch FROM events),
p AS (SELECT *, lag(action) OVER (PARTITION BY code ORDER BY ts, event_id) AS previous FROM a)
SELECT code, event_id, previous, CASE WHEN watch THEN 'WATCH' ELSE action END AS action, CASE WHEN watch THEN 'low' WHEN action = 'SELL' THEN 'high' WHEN action IN ('BUY', 'ADD') THEN 'low' ELSE 'medium' END AS level FROM p WHERE previous <> action""",
)
def stream_advice_changes(spark, sf):
    k = F.col("event_id") % 5
    action = F.when(k == 0, " buy").when(k == 1, "SELL").when(k == 3, "add ").otherwise("hold")
    d = st.events_stream(spark, sf).select(F.col("user_id").alias("code"), "event_id", "ts", action.alias("action"), F.when(F.col("user_id") % 4 == 0, "watch").otherwise("hold").alias("mode"))
    return st.run_to_table(st.advice_changes(d), mode="append").select("code", "event_id", "previous", "action", "level")


def news_labels(batch):
    """(text, label) of the batch's distinct texts.

    A text is scored under its smallest id: the texts are read twice below, and any id would be another one each time.
    """
    unique = batch.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    s = ot.sentiment(unique, ql._lexicon(batch.sparkSession), ql.TRANSITIONS)
    label = F.when(rnd("score", 4) > 1, "positive").when(rnd("score", 4) < -1, "negative").otherwise("neutral")
    return unique.join(s.select("doc_id", label.alias("label")), "doc_id").select("text", "label")


@query("stream_news", ctes(ql._LEX, ql._TOK) + f"SELECT label, count(*) AS news FROM (SELECT DISTINCT text, {ql._LAB.format(r('s', 4))} AS label FROM sn JOIN documents USING (doc_id)) GROUP BY label")
def stream_news(spark, sf):
    n = st.ingest_unique(st.news_stream(spark, sf), ["text"], news_labels)
    return n.groupBy("label").agg(F.count(F.lit(1)).alias("news"))


@query("recent_window", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def recent_window(spark, sf):
    e = views.table(spark, sf, "events").select("event_id", "ts")
    end = e.agg(F.max("ts").alias("_end"))
    # the end is one value, so the broadcast is a single row
    return e.join(F.broadcast(end), F.col("ts") >= F.col("_end") - F.make_interval(hours=F.lit(24)), "inner").select("event_id")
