"""Extremes of bar intervals: a table of doubled ranges, so that an interval of any length costs two rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import lit
from barloom.operators.windows import Roll


def doubled_extremes(bars: DataFrame, longest: int, keys: Sequence[str] = ("code",), order: str = "day") -> DataFrame:
    """(keys, day, ix, lows, highs): element k holds the extreme of the 2**k bars from this one on.

    Level k + 1 is level k of this bar and of the bar 2**k later, so each level is one shift in the windows' single sort.
    Lows that are not positive count as missing. At a series' end a range holds the bars that there are.
    """
    r = Roll(keys, (order,))
    df = bars.select(*keys, order, F.when(F.col("low") > 0, F.col("low")).alias("l0"), F.col("high").alias("h0"), r.at().alias("ix"))
    top = max(longest, 1).bit_length() - 1
    for k in range(top):
        df = df.withColumns({f"l{k + 1}": F.least(f"l{k}", r.lead(f"l{k}", 1 << k)), f"h{k + 1}": F.greatest(f"h{k}", r.lead(f"h{k}", 1 << k))})
    levels = range(top + 1)
    return df.select(*keys, order, "ix", F.array(*[f"l{k}" for k in levels]).alias("lows"), F.array(*[f"h{k}" for k in levels]).alias("highs"))


def interval_extremes(intervals: DataFrame, table: DataFrame, start_day: str, bars: Column, keys: Sequence[str] = ("code",), order: str = "day") -> DataFrame:
    """Adds low and high over `bars` bars from start_day on; bars is at most the table's longest range doubled, less one.

    The interval is the union of two ranges of 2**k bars, one from its first bar and one up to its last.
    """
    first = table.select(*keys, F.col(order).alias(start_day), F.col("ix").alias("_ix"), F.col("lows").alias("_l1"), F.col("highs").alias("_h1"))
    df = intervals.withColumn("_n", bars.cast("long")).join(first, [*keys, start_day])
    k = F.floor(F.log2(F.col("_n") + lit(0.5))).cast("int")
    df = df.withColumn("_k", k).withColumn("_at", F.col("_ix") + F.col("_n") - F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_k")))
    second = table.select(*keys, F.col("ix").alias("_at"), F.col("lows").alias("_l2"), F.col("highs").alias("_h2"))
    both = df.join(second, [*keys, "_at"])
    low = F.least(F.get("_l1", F.col("_k")), F.get("_l2", F.col("_k")))
    high = F.greatest(F.get("_h1", F.col("_k")), F.get("_h2", F.col("_k")))
    return both.withColumns({"low": low, "high": high}).drop("_n", "_ix", "_l1", "_h1", "_k", "_at", "_l2", "_h2")


def excursions(trades: DataFrame, bars: DataFrame, max_hold: int) -> DataFrame:
    """Adds mae and mfe, the largest loss and gain against the buy price while a trade was open.

    Open from the entry bar to the bar that decided the exit: the sell bar, or the bar before it where a condition
    sells at the next open.
    """
    held = F.col("hold_days") + F.when(F.col("reason") == "exit_condition", 0).otherwise(1)
    df = interval_extremes(trades, doubled_extremes(bars, max_hold + 1), "buy_day", held)
    price = F.col("buy_price")
    worst = F.when((price > 0) & (F.col("low") < price), F.least((price - F.col("low")) / price, lit(1))).otherwise(lit(0))
    best = F.when(price > 0, (F.greatest("high", price) - price) / price).otherwise(lit(0))
    return df.withColumns({"mae": worst, "mfe": best}).drop("low", "high")
