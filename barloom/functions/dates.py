"""Date and clock helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.numeric import _c


def parse_day(x) -> Column:
    """Three layouts, else the first ten characters."""
    raw = F.trim(_c(x))
    return F.coalesce(
        F.try_to_date(raw, "yyyy-MM-dd"),
        F.try_to_date(raw, "yyyyMMdd"),
        F.try_to_date(raw, "yyyy/MM/dd"),
        F.try_to_date(F.substring(raw, 1, 10), "yyyy-MM-dd"),
    )


def clock_text(hhmmss) -> Column:
    """93015 -> '09:30:15'."""
    s = F.lpad(_c(hhmmss).cast("string"), 6, "0")
    return F.concat_ws(":", F.substring(s, 1, 2), F.substring(s, 3, 2), F.substring(s, 5, 2))


def day_text(day) -> Column:
    return F.date_format(_c(day), "yyyy-MM-dd")


def month_key(day) -> Column:
    return F.date_format(_c(day), "yyyy-MM")


def iso_week_key(day, compat_split: bool = False) -> Column:
    """ISO week key. The default uses the ISO year; compat_split uses the calendar year."""
    d = _c(day)
    year = F.year(d) if compat_split else F.extract(F.lit("YEAROFWEEK"), d)
    return F.concat(year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def minute_of_day(ts) -> Column:
    return F.hour(_c(ts)) * 60 + F.minute(_c(ts))


# fixed values: trading sessions by market, in minutes of the local day
SESSIONS = {
    "a": ((570, 690), (780, 900)),
    "a_auction": ((555, 690), (780, 900)),
    "hk": ((540, 720), (780, 970)),
    "us": ((240, 1200),),
}


def on_session(ts, market: str = "a") -> Column:
    """Weekday and clock inside one of the market's sessions; bounds are inclusive."""
    m = minute_of_day(ts)
    inside = F.lit(False)
    for lo, hi in SESSIONS[market]:
        inside = inside | ((m >= lo) & (m <= hi))
    return (F.dayofweek(_c(ts)).between(2, 6)) & inside
