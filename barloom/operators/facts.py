"""Facts outside the feature table: loaders of eight namespaces and what of them is known at a decision.

A loader returns `Facts`: rows of (code, day, [available_at], values) and how the values of several rows combine. A
fact holds from the moment it becomes available to the end of its day. Rows with a null `available_at` are never known;
frames without that column hold all day. Frames without a code hold for the whole market, or for all rows of a sector.
Facts that several loaders make of one frame travel in one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import lit
from barloom.functions.ranks import count_if
from barloom.operators.joins import sector_net

# how rows of one code and day combine: the newest row's value, the rows with a value, the largest, the distinct ones (null
# where there are none), the distinct ones among rows that may hold none
NEWEST, COUNT, ANY, KINDS, DISTINCT = "newest", "count", "any", "kinds", "distinct"


@dataclass(frozen=True)
class Facts:
    rows: DataFrame
    values: Mapping[str, str]
    source: DataFrame | None = None  # the frame that the rows are made of, with the values as columns over it
    made: Mapping[str, Column] | None = None
    where: Column | None = None


def made_of(source: DataFrame, made: Mapping[str, Column], values: Mapping[str, str], where: Column | None = None) -> Facts:
    """Facts with the values `made` as columns over the rows of a frame that satisfy `where`."""
    rows = source if where is None else source.filter(where)
    at = [c for c in source.columns if c == "available_at"]
    return Facts(rows.select("code", "day", *at, *[v.alias(k) for k, v in made.items()]), values, source, made, where)


def _flag(hit: Column) -> Column:
    return F.coalesce(hit, F.lit(False)).cast("double")


def money_flow_facts(flows: DataFrame) -> Facts:
    """One row per code and day with `net_inflow` and its sum over five days, `net_inflow5`."""
    return Facts(flows.select("code", "day", "net_inflow", "net_inflow5"), {"net_inflow": NEWEST, "net_inflow5": NEWEST})


def market_facts(moves: DataFrame) -> Facts:
    """Breadth of each day from (day, move); the sentiment score is the share of risers in percent, null on a flat day."""
    g = moves.groupBy("day").agg(count_if(F.col("move") > 0).cast("double").alias("up_count"), count_if(F.col("move") < 0).cast("double").alias("_down"))
    total = F.col("up_count") + F.col("_down")
    ratio = F.when(total > 0, F.col("up_count") / total)
    rows = g.select("day", "up_count", (F.col("up_count") - F.col("_down")).alias("advance_decline"), ratio.alias("up_ratio"), (ratio * lit(100)).alias("sentiment_score"))
    return Facts(rows, {c: NEWEST for c in rows.columns[1:]})


def sector_facts(stocks: DataFrame, flows: DataFrame) -> Facts:
    """The median flow of a stock's matching sectors."""
    return Facts(sector_net(stocks, flows).withColumnRenamed("sector_net", "net_inflow"), {"net_inflow": NEWEST})


def event_facts(changes: DataFrame) -> Facts:
    """Change events one by one: how many are known, and whether a kind of them is."""
    t = F.col("change_type")
    # fixed values: codes of large buys, rapid rises and closed upper limits
    kinds = {"has_large_buy": _flag(t == 8193), "has_rapid_rise": _flag(t.isin(8201, 8202)), "has_limit_up": _flag(t == 4)}
    return made_of(changes, {"change_count": lit(1), **kinds}, {"change_count": COUNT, **{k: ANY for k in kinds}})


def limit_up_facts(rows: DataFrame) -> Facts:
    """The newest board row: streak, seal ratio, how often it opened (once at least if it broke), heat of its plate."""
    opened = F.when(F.coalesce("exploded", F.lit(False)) & (F.coalesce("explode_count", F.lit(0)) == 0), 1).otherwise(F.col("explode_count"))
    values = {"keep_times": F.col("keep_times"), "seal_ratio": F.col("seal_ratio"), "exploded_count": opened, "plate_heat": F.col("plate_heat")}
    return made_of(rows, {k: v.cast("double") for k, v in values.items()}, {k: NEWEST for k in values})


def screening_values() -> dict[str, Column]:
    """Values over screening facts."""
    return {"pattern_count": F.col("pattern_count").cast("double"), "macd_golden": _flag(F.col("macd_golden")), "ma_bullish": _flag(F.col("ma_bullish"))}


def screening_fact_values(facts: DataFrame) -> Facts:
    """Named conditions of the screening facts."""
    values = screening_values()
    return Facts(facts.select("code", "day", *[v.alias(k) for k, v in values.items()]), {c: NEWEST for c in values})


def recommendation_facts(events: DataFrame) -> Facts:
    """Recommendations that count for research: how many, and from how many models."""
    made = {"count": lit(1), "model_count": F.col("model").cast("string")}
    return made_of(events, made, {"count": COUNT, "model_count": KINDS}, F.col("independent"))


def candidate_facts(candidates: DataFrame) -> Facts:
    """The newest score among captured candidates."""
    return made_of(candidates, {"score": F.col("score").cast("double")}, {"score": NEWEST})


def shared(base: DataFrame, space: str, facts: Facts, names: Sequence[str] | None = None, by: Sequence[str] = ("day",)) -> DataFrame:
    """Base rows with the values of facts without a code, which hold for all rows of a day, or of a day and sector.

    These are one row per trading day and sector, and are broadcast.
    """
    values = [F.col(n).alias(f"{space}_{n}") for n in (facts.values if names is None else names)]
    return base.join(F.broadcast(facts.rows.select(*by, *values)), list(by), "left")


def known_facts(base: DataFrame, facts: Mapping[str, Facts], ids: Sequence[str] | None = None, decision: str = "decision_as_of", latest: Column | None = None) -> DataFrame:
    """Base rows with a column `namespace_name` for each id (all by default), as known at the row's decision time.

    Facts and base rows become one stream by (code, day), ordered by time, and every namespace is carried forward in
    the same pass: one exchange, however many namespaces, and one row for all facts that are made of the same source row.
    A key's rows may have several decision times. Facts of the whole market are one row a day and are broadcast. Equal
    times go to the larger values. `latest` is a time over (code, day) that no decision comes after: later facts stay behind.
    """
    wanted: dict[str, list[str]] = {}
    for i in ids if ids is not None else [f"{s}.{c}" for s, f in facts.items() for c in f.values]:
        space, _, name = i.partition(".")
        if space not in facts or name not in facts[space].values:
            raise ValueError(f"unknown fact {i}")
        wanted.setdefault(space, []).append(name)
    timed = dict(base.dtypes)[decision] == "timestamp"
    kept = [c for c in base.columns if c not in ("code", "day") and not (timed and c == decision)]
    streams = [base.select("code", "day", F.col(decision).cast("timestamp").alias("_at"), F.lit(1).alias("_late"), *[base[c].alias(f"_base_{c}") for c in kept])]
    carried, out = [], []
    w = Window.partitionBy("code", "day").orderBy("_at", "_late").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    together: dict[int, list[str]] = {}
    for space in wanted:
        if "code" in facts[space].rows.columns:
            source = facts[space].source
            together.setdefault(id(facts[space].rows if source is None else source), []).append(space)
    for spaces in together.values():
        one = facts[spaces[0]]
        rows = one.rows if one.source is None else one.source
        at = F.col("available_at") if "available_at" in rows.columns else F.col("day").cast("timestamp")
        values, held = [], []
        for space in spaces:
            f = facts[space]
            value = F.struct(*[F.col(n) if f.made is None else f.made[n].alias(n) for n in wanted[space]])
            values.append((value if f.where is None else F.when(f.where, value)).alias(f"_{space}"))
            held.append(F.lit(True) if f.where is None else F.coalesce(f.where, F.lit(False)))
        rows = rows.filter(reduce(lambda a, b: a | b, held)).select("code", "day", at.alias("_at"), F.lit(0).alias("_late"), *values)
        rows = rows.filter("code IS NOT NULL AND day IS NOT NULL AND _at IS NOT NULL")
        streams.append(rows if latest is None else rows.filter(F.col("_at") <= latest))
    for space in [s for spaces in together.values() for s in spaces]:
        names, how = wanted[space], facts[space].values
        here = F.col(f"_{space}").isNotNull()
        newest = [n for n in names if how[n] == NEWEST]
        if newest:
            carried.append(F.max(F.when(here, F.struct("_at", *[F.col(f"_{space}.{n}") for n in newest]))).over(w).alias(f"_n_{space}"))
            out += [F.col(f"_n_{space}.{n}").alias(f"{space}_{n}") for n in newest]
        for n in names:
            value = F.col(f"_{space}.{n}")
            if how[n] == COUNT:
                carried.append(F.nullif(F.count(value).over(w), F.lit(0)).cast("double").alias(f"{space}_{n}"))
            elif how[n] == ANY:
                carried.append(F.max(value).over(w).alias(f"{space}_{n}"))
            elif how[n] == KINDS:
                carried.append(F.nullif(F.size(F.collect_set(value).over(w)), F.lit(0)).cast("double").alias(f"{space}_{n}"))
            elif how[n] == DISTINCT:
                carried.append(F.when(F.max(here).over(w), F.size(F.collect_set(value).over(w)).cast("double")).alias(f"{space}_{n}"))
            if how[n] != NEWEST:
                out.append(F.col(f"{space}_{n}"))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)
    got = both.select("code", "day", "_at", "_late", *[f"_base_{c}" for c in kept], *carried).filter("_late = 1")
    own = [F.col(c) if c in ("code", "day") else F.col("_at").alias(c) if c not in kept else F.col(f"_base_{c}").alias(c) for c in base.columns]
    got = got.select(*own, *out)
    for space, names in wanted.items():
        if "code" not in facts[space].rows.columns:
            got = shared(got, space, facts[space], names)
    return got.select(*base.columns, *[f"{s}_{n}" for s, names in wanted.items() for n in names])


def rating_points(rating: Column) -> Column:
    """Points of a rating in either language; 45 for anything else, a null included."""
    text = F.lower(F.trim(F.coalesce(rating, F.lit(""))))

    def has(*words: str) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in words])

    # fixed values: rating words and their points
    return F.when(has("强烈", "strong", "买入"), lit(75)).when(has("推荐", "增持", "buy"), lit(65)).when(has("谨慎", "中性", "hold"), lit(50)).otherwise(lit(45))


def recommendation_candidates(recommendations: DataFrame, days: DataFrame, reach: int = 30) -> DataFrame:
    """Candidates of each trade day from the recommendations of the `reach` days before it and the day itself.

    One row per (code, day): the best rating's score, and rating, reference price (the close, or the quoted price where
    there is no positive close) and stop of the newest recommendation; equal times go to the larger id. Recommendations
    shrink to one row per code and own day, and only these are exchanged: each is placed on the days on which it is the
    newest, and holds those of the `reach` days before it.
    """
    price = F.when(F.col("close_price") > 0, F.col("close_price")).otherwise(F.coalesce("price", lit(0)))
    last = F.struct("data_time", "id", "rating", price.alias("reference_price"), "stop_loss")
    own = recommendations.filter("code IS NOT NULL AND data_time IS NOT NULL")
    own = own.groupBy("code", F.to_date("data_time").alias("_own")).agg(F.max(rating_points(F.col("rating"))).alias("score"), F.max(last).alias("_last"), F.count(F.lit(1)).alias("_n"))
    own = own.withColumn("_d", F.unix_date("_own"))
    w = Window.partitionBy("code").orderBy("_d")
    held = F.collect_list(F.struct("_d", "score", "_n")).over(w.rangeBetween(-reach, 0))
    until = F.least(F.col("_d") + reach, F.lead("_d").over(w) - 1)
    own = own.select("code", "_d", "score", "_n", "_last", held.alias("_held"), until.alias("_until"))
    placed = own.withColumn("_day", F.explode(F.sequence("_d", "_until"))).withColumn("day", F.date_from_unix_date("_day"))
    # trade days are a calendar: one row a day
    placed = placed.join(F.broadcast(days.select("day").distinct()), "day", "left_semi")
    near = F.filter("_held", lambda e: e["_d"] >= F.col("_day") - reach)
    alone = F.size("_held") == 1
    score = F.when(alone, F.col("score")).otherwise(F.array_max(F.transform(near, lambda e: e["score"])))
    count = F.when(alone, F.col("_n")).otherwise(F.aggregate(near, F.lit(0).cast("long"), lambda s, e: s + e["_n"]))
    return placed.select("code", "day", F.lit("recommendation").alias("source"), score.alias("score"), count.alias("recommendations"), "_last.rating", "_last.reference_price", "_last.stop_loss", F.col("_last.data_time").alias("available_at"))
