"""Time-aware and set-valued joins. No join here gathers one key's rows in one task."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import lit
from barloom.operators.recurrence import by_instrument
from barloom.operators.windows import quantiles


def enrich(events: DataFrame, master: DataFrame, key: str = "code", columns: Sequence[str] = ("industry", "concept")) -> DataFrame:
    """Left join to a master table; Catalyst broadcasts it only below its size threshold."""
    return events.join(master.select(key, *columns), key, "left")


def asof_latest(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, columns: Sequence[str], key: str = "code", bucket: str = "month") -> DataFrame:
    """Newest right row at or before each left row.

    Two levels keep hot keys apart: inside a (key, bucket) the value is filled by a window,
    and what precedes the bucket comes from the last right row of earlier buckets, of which
    there is one per bucket. The result has the left columns plus `columns`.
    """
    value = F.struct(F.col(right_ts).alias("_at"), *columns)
    r = right.select(key, F.col(right_ts).alias("_ts"), value.alias("_v"), F.lit(0).alias("_side"))
    l = left.select(key, F.col(left_ts).alias("_ts"), F.struct(*left.columns).alias("_l"), F.lit(1).alias("_side"))
    rows = l.unionByName(r, allowMissingColumns=True).withColumn("_b", F.date_trunc(bucket, F.col("_ts")))
    inside = Window.partitionBy(key, "_b").orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    every = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(inside))
    # the newest value of a bucket comes from the filled rows, which already stand together
    newest = every.groupBy(key, "_b").agg(F.max("_v").alias("_newest"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.select(key, "_b", F.last("_newest", ignorenulls=True).over(before).alias("_carry"))
    filled = every.filter(F.col("_side") == 1)
    out = filled.join(carried, [key, "_b"]).withColumn("_v", F.coalesce("_v", "_carry"))
    return out.select("_l.*", *[F.col(f"_v.{c}").alias(c) for c in columns])


def nth_trading_day(df: DataFrame, days: DataFrame, n: int, day: str = "day") -> DataFrame:
    """Adds the day's first on-or-after, first-after and n-th-after trading days, by calendar index.

    The index is one row per calendar day; a non-trading day carries the index of the next one.
    """
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    every = span.select(F.explode(F.sequence("a", "b")).alias("day")).join(days.select("day", F.lit(1).alias("_t")).distinct(), "day", "left")
    w = Window.orderBy("day")
    idx = every.withColumn("_i", F.sum(F.coalesce("_t", F.lit(0))).over(w))
    trading = idx.filter("_t = 1").select("_i", F.col("day").alias("_d"))
    at = idx.select(F.col("day").alias(day), (F.col("_i") + F.when(F.col("_t") == 1, 0).otherwise(1)).alias("_on"), (F.col("_i") + 1).alias("_next"))
    out = df.join(at, day, "left")
    for name, i in (("on_or_after", F.col("_on")), ("first_after", F.col("_next")), ("nth_after", F.col("_next") + n - 1)):
        out = out.withColumn("_k", i).join(trading.select(F.col("_i").alias("_k"), F.col("_d").alias(name)), "_k", "left").drop("_k")
    return out.drop("_on", "_next")


def point_in_time(base: DataFrame, facts: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("code", "day"), decision: str = "decision_as_of") -> DataFrame:
    """Newest fact known by the decision time, per key; never a later one.

    Base rows have one decision time per key. Facts shrink to one per key and time in every task before they are joined,
    and the newest fact is a maximum again.
    """
    facts = facts.groupBy(*keys, "available_at").agg(F.max(F.struct(*columns)).alias("_c")).select(*keys, "available_at", "_c.*")
    known = facts.join(base.select(*keys, decision), list(keys)).filter(F.col("available_at") <= F.col(decision))
    best = known.groupBy(*keys).agg(F.max(F.struct("available_at", *columns)).alias("_f"))
    out = base.join(best, list(keys), "left")
    return out.select(*base.columns, *[F.col(f"_f.{c}").alias(c) for c in columns], F.col("_f.available_at").alias("available_at"))


def unified_view(base: DataFrame, facts: Mapping[str, DataFrame], ids: Sequence[str], keys: Sequence[str] = ("code", "day", "industry")) -> DataFrame:
    """Base plus the requested `namespace.column` ids; only namespaces that are mentioned and not in the base are joined.

    Facts without a code are one row a trading day, or a day and industry, and are broadcast.
    """
    wanted: dict[str, list[str]] = {}
    for i in ids:
        space, _, column = i.partition(".")
        if f"{space}_{column}" not in base.columns:
            wanted.setdefault(space, []).append(column)
    out = base
    for space, columns in wanted.items():
        if space == "stock_feature":
            continue
        if space not in facts:
            raise ValueError(f"unknown namespace {space}")
        by = [k for k in keys if k in facts[space].columns and k in base.columns]  # market facts have a day and no code
        f = facts[space].select(*by, *[F.col(c).alias(f"{space}_{c}") for c in columns])
        out = out.join(f if "code" in by else F.broadcast(f), by, "left")
    return out


def unified_long(view: DataFrame, indicators: Sequence[str], keys: Sequence[str] = ("code", "day")) -> DataFrame:
    """Long form (keys, indicator, value, coverage); a missing value has coverage 0."""
    wide = view.select(*keys, *[F.col(c).cast("double").alias(c) for c in indicators])
    long = wide.unpivot(list(keys), list(indicators), "indicator", "value")
    return long.withColumn("coverage", F.when(F.col("value").isNull(), lit(0)).otherwise(lit(1)))


def median_by(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Exact median (mean of the middle two) in two passes, so a huge group is never sorted whole."""
    q = quantiles(df, value, {"_lo": F.floor((F.col("total") - 1) / 2), "_hi": F.floor(F.col("total") / 2)}, keys)
    return q.select(*keys, ((F.col("_lo") + F.col("_hi")) / lit(2)).alias(f"median_{value}"))


def sector_sets(stocks: DataFrame) -> DataFrame:
    """(code, _set): the sorted sectors of each stock, its industry and its concepts, without empty names."""
    names = F.concat(
        F.array(F.struct(F.lit("industry").alias("sector_type"), F.col("industry").alias("sector_name"))),
        F.transform("concepts", lambda c: F.struct(F.lit("concept").alias("sector_type"), c.alias("sector_name"))),
    )
    links = by_instrument(stocks.select("code", F.explode(names).alias("s")).filter("s.sector_name <> ''"))
    return links.groupBy("code").agg(F.array_sort(F.collect_set("s")).alias("_set"))


def set_net(sets: DataFrame, flows: DataFrame) -> DataFrame:
    """(_set, day, sector_net): per set of sectors and day the median net inflow of its industries, else of its concepts."""
    newest = flows.groupBy("sector_type", "sector_name", "day").agg(F.max_by("net_inflow", "data_as_of").alias("net"))
    matched = sets.select("_set").distinct().select("_set", F.explode("_set").alias("s")).select("_set", "s.*").join(newest, ["sector_type", "sector_name"])
    # a stock has few sectors, so the plain exact median of each tiny group is the cheapest
    wide = matched.groupBy("_set", "day").agg(
        F.median(F.when(F.col("sector_type") == "industry", F.col("net"))).alias("_i"),
        F.median(F.when(F.col("sector_type") == "concept", F.col("net"))).alias("_c"),
    )
    return wide.select("_set", "day", F.coalesce("_i", "_c").alias("sector_net"))


def sector_net(stocks: DataFrame, flows: DataFrame) -> DataFrame:
    """Per stock and day the median net inflow of its matching sectors: its industry, else its concepts.

    `stocks` has code, industry and a concepts array; `flows` has sector_type, sector_name,
    day, net_inflow, data_as_of, of which the newest snapshot per sector counts.
    """
    # stocks of equal sectors share their medians: these are made once a set of sectors, and a set's days go to its stocks
    sets = sector_sets(stocks)
    series = set_net(sets, flows).groupBy("_set").agg(F.collect_list(F.struct("day", "sector_net")).alias("_days"))
    return sets.join(series, "_set").select("code", F.explode("_days").alias("_d")).select("code", "_d.*")


def lookback_counts(base: DataFrame, events: DataFrame, days: int, what: Sequence[Column]) -> DataFrame:
    """Aggregates over events in the `days` days ending on each base day.

    Each event is first reduced to one row per (code, day, label) and then placed on the
    days it reaches, a fixed factor of days + 1, instead of joining on a range.
    """
    reach = F.explode(F.sequence("event_day", F.date_add("event_day", days)))
    placed = events.select("*", reach.alias("day"))
    agg = placed.groupBy("code", "day").agg(*what)
    return base.join(agg, ["code", "day"], "left")


def range_stats(bars: DataFrame, anchors: DataFrame) -> DataFrame:
    """Between two anchor bars: difference, percent, bar count and volume, from prefix sums and two equi-joins."""
    w = Window.partitionBy("code").orderBy("day")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    p = bars.select("code", "day", "close", F.row_number().over(w).alias("i"), F.sum("volume").over(upto).alias("cv"), "volume")
    a = p.select("code", F.col("day").alias("t1"), F.struct("close", "i", "cv", "volume").alias("a"))
    b = p.select("code", F.col("day").alias("t2"), F.struct("close", "i", "cv", "volume").alias("b"))
    j = anchors.join(a, ["code", "t1"]).join(b, ["code", "t2"])
    first, last = F.least("a.i", "b.i"), F.greatest("a.i", "b.i")
    lo_cv = F.when(F.col("a.i") <= F.col("b.i"), F.col("a.cv") - F.col("a.volume")).otherwise(F.col("b.cv") - F.col("b.volume"))
    return j.filter(F.col("a.close") != 0).select(
        "code",
        "t1",
        "t2",
        (F.col("b.close") - F.col("a.close")).alias("diff"),
        ((F.col("b.close") - F.col("a.close")) / F.col("a.close") * lit(100)).alias("pct"),
        (last - first + 1).cast("long").alias("bar_count"),
        (F.greatest("a.cv", "b.cv") - lo_cv).alias("volume_sum"),
    )


def _merged(a: tuple, b: tuple) -> tuple:
    """Moments (n, mean x, mean y, xx, yy, xy) of two sets of rows as one; equal means stay as they are."""
    if not a[0] or not b[0]:
        return b if b[0] else a
    n = a[0] + b[0]
    dx, dy, w = b[1] - a[1], b[2] - a[2], a[0] * b[0] / n
    return n, a[1] + dx * b[0] / n, a[2] + dy * b[0] / n, a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w, a[5] + b[5] + dx * dy * w


def _moments(x: np.ndarray, y: np.ndarray) -> tuple:
    """Moments of one set of rows, taken from its first row, so a constant has no spread at all."""
    if not len(x):
        return 0, 0.0, 0.0, 0.0, 0.0, 0.0
    mx, my = x[0] + (x - x[0]).mean(), y[0] + (y - y[0]).mean()
    u, v = x - mx, y - my
    return len(x), float(mx), float(my), float(u @ u), float(v @ v), float(u @ v)


def pair_correlations(wide: DataFrame, columns: Sequence[str], min_rows: int = 3) -> DataFrame:
    """Correlation of every column pair over rows where both are present; 0 below min_rows or without variance.

    The columns already meet on their keys, so all pairs come from one pass, not a self-join: a task sums up its rows in
    one row a pair, and only those meet. As one aggregation, dozens of moments a row outgrew compiled code.
    """
    pairs = list(combinations(columns, 2))
    names = ("n", "mx", "my", "xx", "yy", "xy")
    schema = "a string, b string, n bigint, " + ", ".join(f"{c} double" for c in names[1:])

    def rows(found: Mapping[tuple[str, str], tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), *[pa.float64()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(*k, *v) for k, v in found.items()], strict=True), kinds, strict=True)], names=["a", "b", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = dict.fromkeys(pairs, (0, 0.0, 0.0, 0.0, 0.0, 0.0))
        with np.errstate(all="ignore"):
            for batch in batches:
                there = [c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]
                held = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                for (i, j), k in zip(combinations(range(len(held)), 2), pairs, strict=True):
                    both = there[i] & there[j]
                    found[k] = _merged(found[k], _moments(held[i][both], held[j][both]))
        yield rows(found)

    def correlation(table: pa.Table) -> pa.Table:
        all_ = (0, 0.0, 0.0, 0.0, 0.0, 0.0)
        with np.errstate(all="ignore"):
            for part in sorted(zip(*[table.column(c).to_pylist() for c in names], strict=True)):
                all_ = _merged(all_, part)
            n, _, _, xx, yy, xy = all_
            spread = np.sqrt(xx / max(n, 1)) * np.sqrt(yy / max(n, 1))
            rho = float(xy / n / spread) if n >= min_rows and spread != 0 else 0.0
        return pa.table({"a": table.column("a").slice(0, 1), "b": table.column("b").slice(0, 1), "n": pa.array([n], pa.int64()), "rho": pa.array([rho], pa.float64())})

    parts = wide.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(run, schema)
    # a frame without partitions still has its pairs
    none = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    none = wide.sparkSession.range(1).select(F.explode(none).alias("p")).select("p.*", F.lit(0).cast("bigint").alias("n"), *[lit(0).cast("double").alias(c) for c in names[1:]])
    return parts.unionByName(none).groupBy("a", "b").applyInArrow(correlation, "a string, b string, n bigint, rho double")


def with_scenarios(df: DataFrame, name: str, scenarios: Sequence[tuple[str, float]]) -> DataFrame:
    """Every row under every scenario: a literal array, exploded."""
    items = F.array(*[F.struct(F.lit(n).alias("scenario"), lit(v).alias(name)) for n, v in scenarios])
    return df.withColumn("_s", F.explode(items)).select(*df.columns, "_s.*")


def tags_of(items: DataFrame, bridge: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """n-m tags per item as a sorted array."""
    named = bridge.join(tags, "tag_id").groupBy(key).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return items.join(named, key, "left")
