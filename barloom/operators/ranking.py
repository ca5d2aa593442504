"""Top-N reports, snapshots, ladders and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import lit
from barloom.operators.aggregates import direction_counts


def top_by_count(changes: DataFrame, keys: Sequence[str], n: int = 20) -> DataFrame:
    """Top-n groups by event count, with the up/down split; ties go to the smaller key."""
    df = changes
    for k in keys:
        df = df.filter(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    g = df.groupBy(*keys).agg(*direction_counts())
    return g.orderBy(F.desc("total_count"), *keys).limit(n)


def latest_snapshot(df: DataFrame, ts: str = "ts", day=None) -> DataFrame:
    """Rows at the newest snapshot time, overall or of one date."""
    if day is not None:
        df = df.filter(F.col(ts).cast("date") == F.lit(day))
    newest = df.agg(F.max(ts).alias(ts))
    return df.join(F.broadcast(newest), ts, "left_semi")


def top_and_bottom(df: DataFrame, value: str, key: str, n: int = 20) -> DataFrame:
    """The n largest inflows and n largest outflows, each labelled."""
    top = df.filter(F.col(value) > 0).orderBy(F.desc(value), key).limit(n).withColumn("side", F.lit("in"))
    bottom = df.filter(F.col(value) < 0).orderBy(F.asc(value), key).limit(n).withColumn("side", F.lit("out"))
    return top.unionByName(bottom)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) with the total row count on every row."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def daily_sector_rank(snapshots: DataFrame, n: int = 100) -> DataFrame:
    """Newest snapshot of each sector-day, ranked by net inflow within (type, day); first n kept."""
    day = F.col("ts").cast("date")
    last = snapshots.groupBy("sector_type", "sector_name", day.alias("day")).agg(F.max_by("net_inflow", "ts").alias("net_inflow"))
    ranked = rank_within(last, ["sector_type", "day"], [F.desc("net_inflow"), F.col("sector_name")])
    return ranked.filter(F.col("rank") <= n)


def limit_up_ladder(rows: DataFrame) -> DataFrame:
    """One row per stock and day (highest streak, earliest time) with its place in the ladder step and the step's size.

    A step is the day's limit-up stocks of one streak in time order. Rows stay rows: nothing is gathered into a list.
    """
    best = rows.groupBy("day", "code").agg(F.min(F.struct((-F.col("streak")).alias("s"), "limit_time", "name", "plate")).alias("x"))
    one = best.select("day", "code", (-F.col("x.s")).alias("streak"), "x.limit_time", "x.name", "x.plate")
    step = Window.partitionBy("day", "streak")
    place = F.row_number().over(step.orderBy("limit_time", "code"))
    return one.withColumns({"place": place, "stocks": F.count(F.lit(1)).over(step)})


def exploded_list(rows: DataFrame) -> DataFrame:
    """Stocks that touched the limit on a day but did not hold it: newest row per stock, by fall from the limit."""
    newest = rows.groupBy("day", "code").agg(F.max_by(F.struct("name", "plate", "held", "limit_price", "close"), "limit_time").alias("x"))
    out = newest.filter(~F.col("x.held")).select("day", "code", "x.name", "x.plate", ((F.col("x.close") / F.col("x.limit_price") - lit(1)) * lit(100)).alias("fall"))
    return out


def plate_heat(rows: DataFrame) -> DataFrame:
    """Limit-up stocks per day and plate: how many, the highest streak, and the plate's place by (count, streak, name)."""
    one = rows.groupBy("day", "plate", "code").agg(F.max("streak").alias("streak"))
    heat = one.groupBy("day", "plate").agg(F.count(F.lit(1)).alias("stocks"), F.max("streak").alias("top_streak"))
    return rank_within(heat, ["day"], [F.desc("stocks"), F.desc("top_streak"), F.col("plate")], "place")


def boards(rows: DataFrame, value: str, key: str, n: int = 10) -> DataFrame:
    """The n best of the bull side (value above 0) and of the bear side (below 0), each with its place."""
    both = top_and_bottom(rows, value, key, n)
    side = F.when(F.col("side") == "in", "bull").otherwise("bear")
    return both.withColumn("side", side).withColumn("place", F.row_number().over(Window.partitionBy("side").orderBy(F.desc(F.abs(value)), key)))


def sector_series(flows: DataFrame, sectors: DataFrame, by: str = "sector_name", value: str = "net_inflow") -> DataFrame:
    """Daily flow of each chosen sector with its running total."""
    chosen = flows.join(sectors.select(by).distinct(), by, "left_semi").groupBy(by, "day").agg(F.sum(value).alias(value))
    return chosen.withColumn("total", F.sum(value).over(Window.partitionBy(by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def consensus(sources: Sequence[tuple[str, DataFrame]], k: int) -> DataFrame:
    """Codes found by at least k of the sources, with the sources' names; k = all is the intersection."""
    tagged = [df.select("code", F.lit(name).alias("source")) for name, df in sources]
    return consensus_of(reduce(lambda a, b: a.unionByName(b), tagged), k)


def consensus_of(facts: DataFrame, k: int) -> DataFrame:
    """The same for rows (code, source) of one table, read once."""
    both = facts.select("code", "source").distinct()
    g = both.groupBy("code").agg(F.count(F.lit(1)).alias("source_count"), F.array_sort(F.collect_set("source")).alias("sources"))
    return g.filter(F.col("source_count") >= k)


def ablation(facts: DataFrame, k: int) -> DataFrame:
    """Leave one source out: how many codes still reach k sources, and the share that drops.

    From per-code source counts alone: dropping a source loses the codes that have exactly k and include it.
    """
    pairs = facts.select("code", "source").distinct()
    counts = pairs.groupBy("code").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") >= k)
    total = counts.agg(F.count(F.lit(1)).alias("total"))
    lost = pairs.join(counts, "code").groupBy("source").agg(F.count(F.when(F.col("_k") == k, 1)).alias("lost"))
    every = pairs.select("source").distinct().join(lost, "source", "left").fillna(0, ["lost"]).crossJoin(F.broadcast(total))
    return every.select(
        F.col("source").alias("removed_source"),
        (F.col("total") - F.col("lost")).alias("remaining"),
        F.when(F.col("total") > 0, F.col("lost") / F.col("total")).otherwise(lit(0)).alias("drop_ratio"),
    )


def missing_weekdays(days: DataFrame) -> DataFrame:
    """Weekdays between the first and last day on which no row exists."""
    seen = days.select("day").distinct()
    span = seen.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    every = span.select(F.explode(F.sequence("a", "b")).alias("day")).filter(F.dayofweek("day").between(2, 6))
    return every.join(seen, "day", "left_anti")
