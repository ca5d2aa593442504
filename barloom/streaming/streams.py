"""Streaming twins of the batch operators: same answers, kept current.

Aggregates run in update mode and are stored as (batch, row) records; the newest record of a
key is the answer, so the state stays bounded by the watermark and nothing is rewritten.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.functions import events as ev
from barloom.functions.numeric import lit
from barloom.functions.ranks import count_if
from barloom.operators.windows import first_row

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _pattern(folder: str, table: str) -> str:
    """A pattern that matches the table alone; only patterns may name a single file in a file stream."""
    return f"{folder}/{table[:-1]}[{table[-1]}]"


def events_stream(spark: SparkSession, folder: str, table: str = "events.parquet", per_trigger: int = 1) -> DataFrame:
    """Events as a file stream with an event-time column; the table is one file or a folder of part files."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(_pattern(folder, table))
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


#: event time of the row that closes a bounded stream, later than any other
CLOSING = "2200-01-01 00:00:00"


def closed_events_stream(spark: SparkSession, folder: str, table: str = "events.parquet", per_trigger: int = 1) -> tuple[DataFrame, Callable[[], None]]:
    """`events_stream` of a finished table, and what closes it: a function that adds one closing row to the stream.

    The row (event id -1, user -1, value 1) moves the watermark past everything, so windows close and timers fire. It goes to a
    folder of its own, which the stream reads besides the table; add it when the table has been read (`run_to_table`).
    """
    mark = f"{work_folder(spark)}/closing"
    row = spark.sql(f"SELECT -1L AS event_id, TIMESTAMP_NTZ'{CLOSING}' AS ts, -1L AS user_id, '' AS event_type, 1D AS value, '' AS props")
    row.limit(0).write.parquet(mark)
    ends = spark.readStream.schema(EVENTS).parquet(mark).withColumn("ts", F.col("ts").cast("timestamp"))
    return events_stream(spark, folder, table, per_trigger).unionByName(ends), lambda: row.write.mode("append").parquet(mark)


def news_stream(spark: SparkSession, folder: str, table: str = "documents.parquet", per_trigger: int = 1) -> DataFrame:
    """News texts as a file stream."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(_pattern(folder, table))


def dedup(events: DataFrame, keys: Sequence[str], delay: str = "1 hour") -> DataFrame:
    """First event per key within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def tumbling_bars(ticks: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """OHLCV per code and window; open and close by (time, id)."""
    at = F.struct("ts", "event_id")
    w = ticks.withWatermark("ts", delay).groupBy(F.window("ts", size), "code")
    g = w.agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"),
    )
    return g.select("code", F.col("window.start").alias("bar"), "open", "high", "low", "close", "volume")


def breadth(changes: DataFrame, size: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Up, down and limit counts per window with ratio and mood label."""
    t = F.col("change_type")
    g = changes.withWatermark("ts", delay).groupBy(F.window("ts", size)).agg(
        count_if(t.isin(*ev.UP_CODES)).alias("up"),
        count_if(t.isin(*ev.DOWN_CODES)).alias("down"),
        count_if(t == 4).alias("limit_up"),
        count_if(t == 8).alias("limit_down"),
    )
    ratio = ev.up_down_ratio("up", "down")
    return g.select(
        F.col("window.start").alias("minute"), "up", "down", "limit_up", "limit_down", ratio.alias("up_down_ratio"), ev.mood_label(ratio).alias("mood")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Activity sessions per user, closed by a gap."""
    g = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def day_rollup(changes: DataFrame, delay: str = "1 day") -> DataFrame:
    """Event summary per (code, day), kept current."""
    t = F.col("change_type")
    g = changes.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "code").agg(
        F.count(F.lit(1)).alias("event_count"),
        count_if(t.isin(*ev.BULLISH_CODES)).alias("bullish_count"),
        count_if(t.isin(*ev.DOWN_CODES)).alias("bearish_count"),
        F.sum("amount").alias("event_amount"),
    )
    return g.select("code", F.col("window.start").cast("date").alias("day"), "event_count", "bullish_count", "bearish_count", "event_amount")


def recent(df: DataFrame, hours: int, now=None, ts: str = "ts") -> DataFrame:
    """Rows of the last hours; a stream filters on its own clock."""
    end = F.lit(now).cast("timestamp") if now is not None else F.current_timestamp()
    return df.filter(F.col(ts) >= end - F.make_interval(hours=F.lit(hours)))


# --- keyed state machines -------------------------------------------------------------------------

COOLDOWN = 5 * 60.0


def price_step(state: tuple[float, float], seconds: float, price: float, low: float) -> tuple[tuple[float, float], bool]:
    """One tick of an edge-triggered low-price alert: state is (last price, last sent), 0 meaning none.

    It fires when the price enters the zone from outside and the last alert is five minutes old;
    inside the zone it only records, and outside it re-arms.
    """
    last, sent = state
    if price <= low:
        if last == 0 or last > low:
            if sent == 0 or seconds - sent >= COOLDOWN:
                return (price, seconds), True
            return state, False
        return (price, sent), False
    return ((price, sent) if last == 0 or price > last else state), False


def _alert_rows(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    now = state.get if state.exists else (0.0, 0.0)
    fired = []
    for event_id, ts, price, low in zip(rows["event_id"], rows["ts"], rows["price"], rows["low"]):
        now, hit = price_step(now, ts.timestamp(), price, low)
        if hit:
            fired.append((key[0], event_id, ts, price))
    state.update(now)
    yield pd.DataFrame(fired, columns=["code", "event_id", "ts", "price"])


def price_alerts(ticks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Alerts of a tick stream with a `low` threshold column (from a stream-static join)."""
    return (
        ticks.withWatermark("ts", delay)
        .groupBy("code")
        .applyInPandasWithState(
            _alert_rows, "code string, event_id long, ts timestamp, price double", "last double, sent double", "append", GroupStateTimeout.NoTimeout
        )
    )


# zones of a recommendation and the side from which the price enters them
ZONES = {"buy": 1.0, "profit": -1.0, "loss": 1.0, "cost": 1.0}


def zone_step(state: tuple[float, float], seconds: float, price: float, bound: float, zone: str) -> tuple[tuple[float, float], bool]:
    """One tick against one zone; prices are mirrored for take-profit, so every zone lies below its bound.

    Buy, loss and profit zones hold their bound, the cost zone does not; entering from the bound counts only there.
    Outside, the re-arming price moves away from the zone, for the cost price towards it.
    """
    side = ZONES[zone]
    p, b, last, sent = side * price, side * bound, side * state[0], state[1]
    cost = zone == "cost"
    if p < b or (p == b and not cost):
        if last == 0 or last > b or (cost and last == b):
            if sent == 0 or seconds - sent >= COOLDOWN:
                return (price, seconds), True
            return state, False
        return (price, sent), False
    moved = p < last if cost else p > last
    return ((price, sent) if last == 0 or moved else state), False


def _zone_rows(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    # most keys have a few rows a trigger, where frames cost more than rows: they are sorted as tuples, and no empty one is made
    rows = sorted(r for f in frames for r in zip(*(f[c] for c in ("ts", "event_id", "price", *ZONES))))
    held = state.get if state.exists else (0.0, 0.0) * len(ZONES)
    now = dict(zip(ZONES, zip(held[::2], held[1::2])))
    fired = []
    for ts, event_id, price, *bounds in rows:
        seconds = ts.timestamp()
        for zone, bound in zip(ZONES, bounds):
            if bound > 0:
                now[zone], hit = zone_step(now[zone], seconds, price, bound, zone)
                if hit:
                    fired.append((*key, zone, event_id, ts, price))
    state.update(tuple(x for pair in now.values() for x in pair))
    if fired:
        yield pd.DataFrame(fired, columns=["code", "rec", "zone", "event_id", "ts", "price"])


def zone_alerts(ticks: DataFrame, recommendations: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Alerts per (instrument, recommendation, zone) of a tick stream against static bounds; a bound of 0 is no zone.

    A key is one recommendation with the state of its zones. One trigger brings it the ticks of one instrument only, each
    tick once for all zones: a group costs more than its few rows, so zones are no keys of their own.
    """
    static = recommendations.select("code", "rec", *[F.col(z).cast("double").alias(z) for z in ZONES]).filter(F.greatest(*[F.coalesce(z, lit(0)) for z in ZONES]) > 0)
    rows = ticks.withWatermark("ts", delay).filter("price > 0").join(static, "code").select("code", "rec", *ZONES, "event_id", "ts", "price")
    held = ", ".join(f"{z}_last double, {z}_sent double" for z in ZONES)
    return rows.groupBy("code", "rec").applyInPandasWithState(
        _zone_rows, "code long, rec long, zone string, event_id long, ts timestamp, price double", held, "append", GroupStateTimeout.NoTimeout
    )


def advice_changes(decisions: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A row whenever the action of an instrument changes: level by the new action, low under watch."""
    return (
        decisions.withWatermark("ts", delay)
        .select("code", "event_id", "ts", F.upper(F.trim("action")).alias("action"), "mode")
        .filter("action <> ''")
        .groupBy("code")
        .applyInPandasWithState(
            _advice_rows, "code long, event_id long, ts timestamp, previous string, action string, level string", "action string", "append", GroupStateTimeout.NoTimeout
        )
    )


def advice_step(previous: str, action: str, mode: str) -> tuple[str, str, str] | None:
    """(previous, suggested action, level) of a change of advice, else None."""
    if not previous or previous == action:
        return None
    level = {"SELL": "high", "BUY": "low", "ADD": "low"}.get(action, "medium")
    return (previous, "WATCH", "low") if mode == "watch" else (previous, action, level)


def _advice_rows(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    now = state.get[0] if state.exists else ""
    out = []
    for event_id, ts, action, mode in zip(rows["event_id"], rows["ts"], rows["action"], rows["mode"]):
        if change := advice_step(now, action, mode):
            out.append((key[0], event_id, ts, *change))
        now = action
    state.update((now,))
    yield pd.DataFrame(out, columns=["code", "event_id", "ts", "previous", "action", "level"])


REALERT = 30 * 60.0


def decision_step(state: tuple[str, float], seconds: float, active: bool) -> tuple[tuple[str, float], str]:
    """One evaluation of a decision alert: state is (status, triggered at).

    A new alert needs no unresolved one and 30 minutes since the last trigger; an inactive
    evaluation resolves an open alert.
    """
    status, at = state
    if active:
        if status == "new" or (status == "resolved" and seconds - at < REALERT):
            return state, ""
        return ("new", seconds), "new"
    if status == "new":
        return ("resolved", at), "resolved"
    return state, ""


def _decision_rows(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    now = state.get if state.exists else ("", 0.0)
    out = []
    for event_id, ts, active in zip(rows["event_id"], rows["ts"], rows["active"]):
        now, change = decision_step(now, ts.timestamp(), bool(active))
        if change:
            out.append((key[0], key[1], event_id, ts, change))
    state.update(now)
    yield pd.DataFrame(out, columns=["code", "reason", "event_id", "ts", "status"])


def decision_alerts(quotes: DataFrame, thresholds: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Stop-loss, defence, take-profit and entry alerts of a quote stream against a static decision table."""
    j = quotes.join(thresholds, "code")
    p = F.col("price")
    held = F.col("holding_volume") > 0
    stop = held & (F.col("stop_price") > 0) & (p <= F.col("stop_price"))
    checks = {
        "stop_loss": stop,
        "defence_price": held & ~stop & (F.col("defence_price") > 0) & (p <= F.col("defence_price")),
        "take_profit": held & (F.col("profit_price") > 0) & (p >= F.col("profit_price")),
        "entry_signal": F.col("may_enter") & p.between(F.col("buy_min"), F.col("buy_max")),
    }
    each = F.array(*[F.struct(F.lit(n).alias("reason"), F.coalesce(c, F.lit(False)).alias("active")) for n, c in checks.items()])
    rows = j.withWatermark("ts", delay).select("code", "event_id", "ts", F.explode(each).alias("a")).select("code", "event_id", "ts", "a.*")
    return rows.groupBy("code", "reason").applyInPandasWithState(
        _decision_rows, "code string, reason string, event_id long, ts timestamp, status string", "status string, triggered double", "append", GroupStateTimeout.NoTimeout
    )


# --- running a stream to a table --------------------------------------------------------------------


def work_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint space."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return f"{shared}/stream-{uuid.uuid4().hex}"


def store_batch(batch: DataFrame, folder: str, number: int) -> None:
    """A batch has a folder of its own and replaces it, so a batch that is run again leaves its rows once."""
    batch.write.mode("overwrite").parquet(f"{folder}/rows/_batch={number}")


def run_to_table(stream: DataFrame, keys: Sequence[str] | None = None, mode: str = "update", each: Callable[[DataFrame], DataFrame] | None = None, close: Callable[[], None] | None = None) -> DataFrame:
    """Process everything available and return the stored result.

    With keys it is the newest record per key; in complete mode it is the last trigger's table. With close the query
    runs again from its checkpoint after close() has been called.
    """
    spark = stream.sparkSession
    folder = work_folder(spark)

    def store(batch: DataFrame, number: int) -> None:
        store_batch(each(batch) if each else batch, folder, number)

    for step in (None, close) if close else (None,):
        if step:
            step()
        q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(store).start()
        q.awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    if mode == "complete":
        last = rows.agg(F.max("_batch").alias("_batch"))
        return rows.join(F.broadcast(last), "_batch", "left_semi").drop("_batch")
    if keys:
        rows = first_row(rows, list(keys), [-F.col("_batch")])
    return rows.drop("_batch")


def ingest_unique(stream: DataFrame, keys: Sequence[str], label: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Ingest with de-duplication within each trigger and across the stored table (news: title else content)."""
    stored = run_to_table(stream, None, "append", lambda b: (label(b) if label else b).dropDuplicates(list(keys)))
    return stored.dropDuplicates(list(keys))


def ticks_of(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        "ts",
        F.col("event_type").alias("code"),
        F.col("value").alias("price"),
        F.regexp_extract("props", r"([0-9]+)", 1).cast("double").alias("volume"),
    )


def changes_of(events: DataFrame) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in sorted(ev.CHANGE_NAMES)])
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("int")
    return events.select(
        "event_id", "ts", F.col("user_id").alias("code"), F.element_at(codes, F.pmod(k, F.lit(len(ev.CHANGE_NAMES))) + 1).alias("change_type"), (F.col("value") * lit(1)).alias("amount")
    )
