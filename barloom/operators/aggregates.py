"""Grouped facts: event counts, distributions, coverage, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import events as ev
from barloom.functions.numeric import lit
from barloom.functions.ranks import count_if
from barloom.operators.windows import average_rank


def direction_counts(t: Column | str = "change_type") -> list[Column]:
    c = F.col(t) if isinstance(t, str) else t
    return [
        F.count(F.lit(1)).alias("total_count"),
        count_if(c.isin(*ev.UP_CODES)).alias("up_count"),
        count_if(c.isin(*ev.DOWN_CODES)).alias("down_count"),
    ]


def daily_counts(changes: DataFrame) -> DataFrame:
    """Per day: total, up, down, limit-up and limit-down events."""
    t = F.col("change_type")
    return changes.groupBy("change_date").agg(*direction_counts(), count_if(t == 4).alias("limit_up"), count_if(t == 8).alias("limit_down"))


def dimension_daily(changes: DataFrame, **where: str) -> DataFrame:
    """Daily direction counts of one stock, industry, type, or concept (matched by containment)."""
    df = changes
    for name, value in where.items():
        df = df.filter(F.contains(F.col(name), F.lit(value)) if name == "concept" else F.col(name) == F.lit(value))
    return df.groupBy("change_date").agg(*direction_counts())


def concept_counts(changes: DataFrame) -> DataFrame:
    """Direction counts per concept: aggregate by the raw text first, then split and add up."""
    raw = changes.filter("concept <> ''").groupBy("concept").agg(*direction_counts())
    one = raw.select(F.explode(ev.split_concepts("concept", distinct=False)).alias("concept"), "total_count", "up_count", "down_count")
    return one.groupBy("concept").agg(*[F.sum(c).alias(c) for c in ("total_count", "up_count", "down_count")])


def stock_day_events(changes: DataFrame) -> DataFrame:
    """Event summary per stock and day; the bullish set here also has the two opened-limit codes."""
    t = F.col("change_type")
    return changes.groupBy("code", "change_date").agg(
        F.count(F.lit(1)).alias("event_count"),
        count_if(t.isin(*ev.BULLISH_CODES)).alias("bullish_count"),
        count_if(t.isin(*ev.DOWN_CODES)).alias("bearish_count"),
        count_if(t == 8193).alias("large_buy_count"),
        count_if(t == 8194).alias("large_sell_count"),
        count_if(t.isin(8201, 8202)).alias("rapid_rise_count"),
        count_if(t.isin(8203, 8204)).alias("rapid_fall_count"),
        count_if(t == 4).alias("limit_up_count"),
        count_if(t == 8).alias("limit_down_count"),
        F.sum("amount").alias("event_amount"),
        F.max("ts").alias("latest_event"),
    )


def moments(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Count, mean, both deviations, skewness and excess kurtosis with the sample deviation in the denominator.

    One pass of partial central moments, which Spark merges without power sums; a hot key is reduced in every task.
    """
    base = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std_pop"),
        F.coalesce(F.stddev_samp(value), lit(0)).alias("std"),
        F.skewness(value).alias("_s"),
        F.kurtosis(value).alias("_k"),
    )
    shape = (F.col("std_pop") / F.col("std"))
    ok = F.col("std") > 1e-10
    skew = F.when(ok, F.col("_s") * shape * shape * shape)
    kurt = F.when(ok, (F.col("_k") + lit(3)) * shape * shape * shape * shape - lit(3))
    # without variance the cubes are 0 and so is their mean; the fourth powers' mean less 3 is 0 by definition here
    return base.withColumns({"skewness": F.coalesce(skew, lit(0)), "kurtosis": F.coalesce(kurt, lit(0))}).drop("_s", "_k")


def pearson(x: Column, y: Column, min_rows: int = 3) -> Column:
    """Correlation; 0 below min_rows or without variance. Built from its parts: the built-in one divides by zero there."""
    spread = F.nullif(F.stddev_pop(x) * F.stddev_pop(y), lit(0))
    return F.when(F.count(F.lit(1)) >= min_rows, F.coalesce(F.covar_pop(x, y) / spread, lit(0))).otherwise(lit(0))


def rank_correlation(df: DataFrame, x: str, y: str, keys: Sequence[str], min_rows: int = 3) -> DataFrame:
    """Spearman per group through average ranks; groups are cross-sections (at most one row per instrument)."""
    ranked = df.select(*keys, average_rank(x, keys).alias("_x"), average_rank(y, keys).alias("_y"))
    return ranked.groupBy(*keys).agg(pearson(F.col("_x"), F.col("_y"), min_rows).alias("rank_corr"))


def hit_rate(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), salts: int = 16) -> DataFrame:
    """Share of rows where x and y lie on the same side of their group means.

    The means are one row per key, repeated for every salt, so a hot key's rows meet them in many tasks and are
    counted there before the counts of a key come together.
    """
    means = df.groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    same = (F.col(x) - F.col("_mx")) * (F.col(y) - F.col("_my")) > 0
    if keys:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(x, y), F.lit(salts)).cast("int"))
        means = means.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        j = salted.join(means, [*keys, "_salt"]).groupBy(*keys, "_salt")
    else:
        j = df.crossJoin(F.broadcast(means)).groupBy()
    part = j.agg(count_if(same).alias("_same"), F.count(F.lit(1)).alias("_all"))
    return part.groupBy(*keys).agg((F.sum("_same") / F.sum("_all")).alias("hit_rate"))


def coverage(features: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Share of expected stock-days with usable prices and each required average; ready at 0.95 of all."""
    priced = (F.col("open") > 0) & (F.col("close") > 0) & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("volume") > 0)
    got = features.agg(
        F.countDistinct("code").alias("stocks"),
        F.countDistinct("day").alias("days"),
        count_if(priced).alias("priced"),
        count_if(F.col("ma5") > 0).alias("ma5_rows"),
        count_if(F.col("ma20") > 0).alias("ma20_rows"),
    )
    expected = F.col("stocks") * F.col("days")
    ratios = {f"{n}_ratio": F.least(F.col(c) / expected, lit(1)) for n, c in (("price", "priced"), ("ma5", "ma5_rows"), ("ma20", "ma20_rows"))}
    out = got.withColumns(ratios)
    return out.withColumn("ready", F.least(*[F.col(r) for r in ratios]) >= 0.95)


def last_snapshot_per_day(df: DataFrame, ts: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of the newest snapshot time of each day."""
    day = F.col(ts).cast("date")
    newest = df.groupBy(*keys, day.alias("_d")).agg(F.max(ts).alias(ts))
    return df.join(newest.drop("_d"), [*keys, ts], "left_semi")


def dedup_content(df: DataFrame, title: str | None, content: str, order: Sequence[Column], key: str) -> DataFrame:
    """One row per title, or per trimmed content without a title; `order` says which survives.

    Groups by a digest, and only (digest, order, id) travels: whole texts are not shuffled for the grouping.
    """
    body = F.trim(F.col(content))
    same = F.when(F.length(F.trim(F.col(title))) > 0, F.concat(F.lit("t:"), F.trim(F.col(title)))).otherwise(F.concat(F.lit("c:"), body)) if title else body
    small = df.select(F.sha2(same, 256).alias("_h"), F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.col(key).alias(key)).alias("_r"))
    keep = small.groupBy("_h").agg(F.min("_r").alias("_r")).select(F.col(f"_r.{key}").alias(key))
    return df.join(keep, key, "left_semi")


def merged_lists(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Union of text arrays per group, distinct and sorted; deduplicated before the gather."""
    out = None
    for c in columns:
        d = df.select(*keys, F.explode_outer(c).alias(c)).distinct().groupBy(*keys).agg(F.array_sort(F.collect_set(c)).alias(c))
        out = d if out is None else out.join(d, list(keys))
    return out


def source_freshness(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(
        F.countDistinct("code").alias("items"),
        F.max("data_as_of").alias("data_as_of"),
        F.max("available_at").alias("available_at"),
    )


def breadth(df: DataFrame, group: str) -> DataFrame:
    """Up and down counts per day, in total and per group, with ratio and label (rollup over the group)."""
    r = df.rollup("day", group).agg(count_if(F.col("move") > 0).alias("up"), count_if(F.col("move") < 0).alias("down"))
    r = r.filter(F.col("day").isNotNull())
    ratio = ev.up_down_ratio("up", "down")
    total = F.col("up") + F.col("down")
    return r.select(
        "day",
        F.coalesce(group, F.lit("ALL")).alias(group),
        "up",
        "down",
        F.when(total > 0, F.col("up") / total * lit(100)).otherwise(lit(0)).alias("up_ratio"),
        ratio.alias("up_down_ratio"),
        ev.mood_label(ratio).alias("mood"),
    )


def longest_run(df: DataFrame, flag: Column, key: str = "code", order: str = "day") -> DataFrame:
    """Longest run of flagged rows per key (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(order)
    x = df.select(key, order, flag.alias("_f"))
    x = x.withColumn("_g", F.row_number().over(w) - F.sum(F.col("_f").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.filter("_f").groupBy(key, "_g").agg(F.count(F.lit(1)).alias("_n"))
    return df.select(key).distinct().join(runs.groupBy(key).agg(F.max("_n").alias("longest_run")), key, "left").fillna(0, ["longest_run"])
