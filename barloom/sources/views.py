"""Market-data views over the given tables.

Each view is lazy and keeps one row per natural key, so that later windows by code
see at most one row per (code, day): the size of a window partition is bounded by the
trading calendar, however skewed the raw ticks are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import events as ev
from barloom.functions.numeric import lit, rnd

# fixed order of the 22 change codes, used to give the events table a code column
CHANGE_CODE_ORDER = tuple(sorted(ev.CHANGE_NAMES))

# the total order of ticks, as far as it decides a price: ticks that are equal in all of this have one price
TICK_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(ticks_: DataFrame, *more: Column) -> DataFrame:
    """Bars of ticks with their price p and order k. A key's first and last tick travel, and their prices come from them."""

    def price(k: str) -> Column:
        return F.col(f"{k}.l_extendedprice") / F.col(f"{k}.l_quantity")

    g = ticks_.groupBy("code", "day").agg(
        F.min("k").alias("_first"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max("k").alias("_last"),
        F.sum("l_quantity").alias("volume"),
        rnd(F.sum("l_extendedprice"), 2).alias("amount"),
        rnd(F.avg("l_discount"), 6).alias("turnover"),
        *more,
    )
    rest = [c for c in g.columns if c not in ("code", "day", "_first", "high", "low", "_last")]
    return g.select("code", "day", price("_first").alias("open"), "high", "low", price("_last").alias("close"), *rest)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per supplier: the line item is the tick, its unit price the tick price."""
    li = table(spark, sf_dir, "lineitem")
    ticks = li.select(
        F.col("l_suppkey").alias("code"),
        F.col("l_shipdate").cast("date").alias("day"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"),
        F.struct(*TICK_ORDER).alias("k"),
        "l_quantity",
        "l_extendedprice",
        "l_discount",
    )
    return _bars(ticks)


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The close column of `bars` alone, for operators that need nothing else."""
    return bars(spark, sf_dir).select("code", "day", "close")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday ticks: event type is the instrument, value the price, the k property the volume."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("event_type").alias("code"),
        "ts",
        F.col("value").alias("price"),
        F.regexp_extract("props", r"([0-9]+)", 1).cast("double").alias("volume"),
        "user_id",
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events: the k property picks one of the 22 codes; user is the stock."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("int")
    codes = F.array(*[F.lit(c) for c in CHANGE_CODE_ORDER])
    region = F.array(*[F.lit(r) for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")])
    base = e.select(
        "event_id",
        "ts",
        F.col("user_id").alias("code"),
        F.element_at(codes, F.pmod(k, F.lit(22)) + 1).alias("change_type"),
        F.col("value").alias("amount"),
        k.cast("long").alias("volume"),
        "event_type",
    )
    return base.select(
        "event_id",
        "ts",
        F.date_format("ts", "yyyy-MM-dd").alias("change_date"),
        F.date_format("ts", "HH:mm:ss").alias("change_time"),
        "code",
        F.concat(F.lit("U"), F.col("code").cast("string")).alias("name"),
        F.concat(F.lit("NATION_"), F.pmod("code", F.lit(25)).cast("string")).alias("industry"),
        F.concat_ws(
            ",", F.element_at(region, (F.pmod("code", F.lit(5)) + 1).cast("int")), F.col("event_type")
        ).alias("concept"),
        "change_type",
        ev.change_class(F.col("change_type")).alias("change_class"),
        "amount",
        "volume",
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net money flow per supplier-day, signed by the return flag."""
    li = table(spark, sf_dir, "lineitem")
    signed = (
        F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice"))
        .when(F.col("l_returnflag") == "R", -F.col("l_extendedprice"))
        .otherwise(lit(0))
    )
    return (
        li.select(F.col("l_suppkey").alias("code"), F.col("l_shipdate").cast("date").alias("day"), signed.alias("x"))
        .groupBy("code", "day")
        .agg(rnd(F.sum("x"), 2).alias("net_inflow"))
    )


def bars_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars and money flow in one pass over the ticks."""
    li = table(spark, sf_dir, "lineitem")
    signed = (
        F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice"))
        .when(F.col("l_returnflag") == "R", -F.col("l_extendedprice"))
        .otherwise(lit(0))
    )
    ticks_ = li.select(
        F.col("l_suppkey").alias("code"),
        F.col("l_shipdate").cast("date").alias("day"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"),
        F.struct(*TICK_ORDER).alias("k"),
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        signed.alias("x"),
    )
    return _bars(ticks_, rnd(F.sum("x"), 2).alias("net_inflow"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to nation (industry) and region (concept)."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (
        s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(
            F.col("s_suppkey").alias("code"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("industry"),
            F.col("r_name").alias("concept"),
        )
    )


def trades(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Trade ledger per part: returned items are sells. `k` is the total order within a day, as far as it decides a trade.

    `dealt` rows stand together by code and day; only code, day and order are exchanged for it, the rest comes from the order.
    """
    li = table(spark, sf_dir, "lineitem")
    k = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    rows = li.select(F.col("l_partkey").alias("code"), F.col("l_shipdate").cast("date").alias("day"), k.alias("k"))
    if dealt:
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "code", "day")
    return rows.select(
        "code",
        "day",
        F.when(F.col("k.l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        (F.col("k.l_extendedprice") / F.col("k.l_quantity")).alias("price"),
        F.col("k.l_quantity").alias("volume"),
        "k",
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
