"""Market clocks: trading sessions as an interval table in universal time, met by a range join on the day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.dates import SESSIONS

# fixed values: where each market's clock stands, and whose holidays it keeps
ZONES = {"a": "Asia/Shanghai", "a_auction": "Asia/Shanghai", "hk": "Asia/Hong_Kong", "us": "America/New_York"}
CALENDARS = {"a": "a", "a_auction": "a", "hk": "hk", "us": "us"}


def local_days(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """(day): every day from the day before the first row to the day after the last, so that any zone's days are there."""
    span = rows.agg(F.min(ts).cast("date").alias("a"), F.max(ts).cast("date").alias("b")).filter("a IS NOT NULL")
    return span.select(F.explode(F.sequence(F.date_sub("a", 1), F.date_add("b", 1))).alias("day"))


def session_intervals(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """(market, zone, day, part, open, close) of every session on (day); open and close are universal times without zone.

    The clock runs in the market's zone, so its daylight saving moves the interval. Weekends and the calendar's
    (market, day) holidays have none. The closing minute belongs to the session: close is the minute after it, exclusive.
    """
    each = [F.struct(F.lit(m).alias("market"), F.lit(ZONES[m]).alias("zone"), F.lit(CALENDARS[m]).alias("calendar"), F.lit(k).alias("part"), F.lit(lo).alias("lo"), F.lit(hi + 1).alias("hi")) for m, parts in SESSIONS.items() for k, (lo, hi) in enumerate(parts)]
    df = days.filter(F.dayofweek("day").between(2, 6)).select("day", F.explode(F.array(*each)).alias("s")).select("day", "s.*")
    df = df.join(holidays.select(F.col("market").alias("calendar"), "day"), ["calendar", "day"], "left_anti")

    def at(minute: str):
        local = F.col("day").cast("timestamp_ntz") + F.make_interval(mins=F.col(minute))
        return F.convert_timezone(F.col("zone"), F.lit("UTC"), local)

    return df.select("market", "zone", "day", "part", at("lo").alias("open"), at("hi").alias("close"))


def in_sessions(rows: DataFrame, intervals: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows with (market, day, part) of every session they fall into; ts is a universal time without zone.

    Intervals stand under each universal day that they touch, so the join is on the day and the times only filter.
    """
    touched = F.explode(F.sequence(F.col("open").cast("date"), F.col("close").cast("date")))
    bins = intervals.select("market", "day", "part", "open", "close", touched.alias("_at"))
    j = rows.withColumn("_at", F.col(ts).cast("date")).join(bins, "_at")
    return j.filter((F.col(ts) >= F.col("open")) & (F.col(ts) < F.col("close"))).drop("_at", "open", "close")
