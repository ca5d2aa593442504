"""Building, cleaning, merging and resampling bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.dates import iso_week_key, minute_of_day
from barloom.functions.numeric import lit, rnd
from barloom.operators.windows import Roll, first_row


def bars_from_ticks(df: DataFrame, unit: str = "hour", code: str = "code", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """OHLCV per code and time unit; one hash exchange after map-side aggregation."""
    at = F.struct(ts, tie)
    price, volume = F.col("price"), F.col("volume")
    return df.groupBy(F.col(code).alias("code"), F.date_trunc(unit, F.col(ts)).alias("bar")).agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        F.sum(volume).alias("volume"),
        F.sum(price * volume).alias("amount"),
    )


def normalize_bars(df: DataFrame, ingest: list[Column], now_day=None, now_minute: int | None = None) -> DataFrame:
    """One row per (code, day), the first under `ingest` order; today's bar goes before 15:10."""
    one = first_row(df, ["code", "day"], ingest)
    if now_day is not None and now_minute is not None and now_minute < 15 * 60 + 10:
        one = one.filter(F.col("day") != F.lit(now_day))
    return one


def merge_pages(existing: DataFrame, incoming: DataFrame, prefer: str = "existing") -> DataFrame:
    """Merge two bar sets on (code, day); `prefer` names the side that wins a clash."""
    rank = {"existing": 0, "incoming": 1} if prefer == "existing" else {"existing": 1, "incoming": 0}
    both = existing.withColumn("_p", F.lit(rank["existing"])).unionByName(incoming.withColumn("_p", F.lit(rank["incoming"])))
    return first_row(both, ["code", "day"], [F.col("_p")]).drop("_p")


def refresh_tail(existing: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Existing bars before each code's first refreshed bar, then the refreshed bars."""
    start = refreshed.groupBy("code").agg(F.min("day").alias("_start"))
    kept = existing.join(start, "code", "left").filter(F.col("_start").isNull() | (F.col("day") < F.col("_start"))).drop("_start")
    return kept.unionByName(refreshed)


def period_key(day: str, period: str) -> Column:
    d = F.col(day)
    return {"day": F.date_format(d, "yyyy-MM-dd"), "week": iso_week_key(d), "month": F.date_format(d, "yyyy-MM")}[period]


def live_bars(quotes: DataFrame) -> DataFrame:
    """Today's bar from a quote: change and amplitude against the previous close, volume in lots."""
    pc = F.col("pre_close")
    return quotes.filter((F.col("price") > 0) & (F.col("open") > 0)).select(
        "code",
        "day",
        rnd("open", 2).alias("open"),
        rnd("high", 2).alias("high"),
        rnd("low", 2).alias("low"),
        rnd("price", 2).alias("close"),
        rnd(F.col("volume") / lit(100), 0).alias("volume"),
        rnd("amount", 2).alias("amount"),
        F.when(pc > 0, rnd((F.col("price") - pc) / pc * lit(100), 2)).alias("change_pct"),
        F.when(pc > 0, rnd(F.col("price") - pc, 2)).alias("change_value"),
        F.when(pc > 0, rnd((F.col("high") - F.col("low")) / pc * lit(100), 2)).alias("amplitude"),
    )


def append_live_bar(history: DataFrame, quotes: DataFrame, period: str = "day") -> DataFrame:
    """Append the live bar; a week or month bar of the same period is replaced, a day bar is kept."""
    live = live_bars(quotes).withColumn("_k", period_key("day", period))
    past = history.withColumn("_k", period_key("day", period))
    if period == "day":
        live = live.join(past.select("code", "_k"), ["code", "_k"], "left_anti")
    else:
        past = past.join(live.select("code", "_k"), ["code", "_k"], "left_anti")
    return past.unionByName(live, allowMissingColumns=True).drop("_k")


def _ohlc(order: Column) -> list[Column]:
    return [
        F.min_by("open", order).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", order).alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("amount").alias("amount"),
    ]


def resample_every(df: DataFrame, n: int, order: str = "day") -> DataFrame:
    """Every n bars of a code become one: day and turnover of the last, a short tail is kept."""
    r = Roll(order=(order,))
    g = df.withColumn("chunk", F.floor((r.at() - 1) / F.lit(n)))
    o = F.col(order)
    return g.groupBy("code", "chunk").agg(F.max(order).alias(order), *_ohlc(o), F.max_by("turnover", o).alias("turnover"))


def resample_month(df: DataFrame) -> DataFrame:
    """Calendar months: volume summed, day of the last bar."""
    d = F.col("day")
    return df.groupBy("code", F.date_format(d, "yyyy-MM").alias("month")).agg(F.max("day").alias("day"), *_ohlc(d))


def resample_nav(df: DataFrame, period: str = "week", compat_split: bool = False) -> DataFrame:
    """NAV style: day, volume and amount of the first bar; lows of 0 are ignored unless it is the first bar's.

    Weeks are ISO weeks; compat_split keys them by calendar year, which splits a week across New Year.
    """
    d = F.col("day")
    key = iso_week_key(d, compat_split) if period == "week" else F.date_format(d, "yyyy-MM")
    first_low = F.min_by("low", d)
    low = F.least(first_low, F.min(F.when(F.col("low") != 0, F.col("low"))))
    return df.groupBy("code", key.alias("period")).agg(
        F.min("day").alias("day"),
        F.min_by("open", d).alias("open"),
        F.max("high").alias("high"),
        low.alias("low"),
        F.max_by("close", d).alias("close"),
        F.min_by("volume", d).alias("volume"),
        F.min_by("amount", d).alias("amount"),
    )


def trading_calendar(days: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Every date between the first and last day, with its trading flag (weekday, not a holiday)."""
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    cal = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    cal = cal.withColumn("is_trading", F.dayofweek("day").between(2, 6))
    if holidays is not None:
        cal = cal.join(holidays.select("day", F.lit(True).alias("_h")), "day", "left")
        cal = cal.withColumn("is_trading", F.col("is_trading") & F.col("_h").isNull()).drop("_h")
    return cal


def latest_trading_day(calendar: DataFrame, stamps: DataFrame, ts: str = "ts") -> DataFrame:
    """For each stamp the latest finished trading day: today from 15:01 on, else the one before it."""
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    open_day = F.when(F.col("is_trading"), F.col("day"))
    steps = calendar.select(
        "day",
        "is_trading",
        F.last(open_day, ignorenulls=True).over(w).alias("_upto"),
        F.last(open_day, ignorenulls=True).over(back).alias("_before"),
    )
    s = stamps.withColumn("day", F.col(ts).cast("date")).join(F.broadcast(steps), "day", "left")
    early = F.col("is_trading") & (minute_of_day(F.col(ts)) < 15 * 60 + 1)
    return s.withColumn("latest_day", F.when(early, F.col("_before")).otherwise(F.col("_upto"))).drop("_upto", "_before", "is_trading")
