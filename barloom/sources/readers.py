"""Readers and parsers for raw market text. Bad lines are kept apart, never dropped silently."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import schemas
from barloom.functions import events as ev
from barloom.functions.dates import parse_day
from barloom.functions.numeric import _c, lit, parse_number, parse_percent


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Bars from text-typed files (parquet, csv or json): cast once at the scan."""
    options = {"header": True} if fmt == "csv" else {}
    return clean_bars(spark.read.format(fmt).options(**options).schema(schemas.RAW_BARS).load(path))


def clean_bars(raw: DataFrame) -> DataFrame:
    """Cast text bars; rows with a missing or non-finite price go, a bad volume counts as 0."""
    prices = [F.col(n).try_cast("double").alias(n) for n in ("open", "high", "low", "close")]
    df = raw.select(
        "code",
        parse_day(F.col("day").cast("string")).alias("day"),
        *prices,
        parse_number("volume").alias("volume"),
        parse_number("amount").alias("amount"),
        parse_percent("turnover").alias("turnover"),
    )
    finite = [F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(F.col(n)) < lit(float("inf"))) for n in ("open", "high", "low", "close")]
    volume = F.when(F.isnan("volume") | (F.abs(F.col("volume")) == lit(float("inf"))), lit(0)).otherwise(F.col("volume"))
    return df.filter(reduce(lambda a, b: a & b, finite)).withColumn("volume", volume)


# fixed values: field positions of the delimited quote lines, by market (0-based), and their minimum width
QUOTE_FIELDS = {
    "cn": {"min": 32, "name": 0, "open": 1, "pre_close": 2, "price": 3, "high": 4, "low": 5, "volume": 8, "amount": 9, "date": 30, "time": 31},
    "hk": {"min": 19, "name": 1, "open": 2, "pre_close": 3, "high": 4, "low": 5, "price": 6, "amount": 11, "volume": 12, "date": 17, "time": 18},
    "us": {"min": 35, "name": 0, "price": 1, "open": 5, "high": 6, "low": 7, "volume": 10, "pre_close": 26, "stamp": 3},
}


# fixed values: first price and first volume of the five buy and sell levels, which alternate, in both layouts
COMMA_LEVELS = {"bids": (11, 10), "asks": (21, 20)}
TILDE_LEVELS = {"bids": (9, 10), "asks": (19, 20)}
# fixed values: positions of the tilde layout and its minimum width
TILDE_FIELDS = {"min": 35, "name": 1, "price": 3, "pre_close": 4, "open": 5, "stamp": 30, "high": 33, "low": 34}
LEVEL = "array<struct<price:double,volume:double>>"


def book_side(fields: Column, price: int, volume: int) -> Column:
    """Five levels of (price, volume) whose numbers alternate in split fields; a missing number is null."""
    def number(i: int) -> Column:
        return parse_number(F.trim(F.get(fields, F.lit(i))))

    return F.array(*[F.struct(number(price + 2 * k).alias("price"), number(volume + 2 * k).alias("volume")) for k in range(5)])


def book_columns(df: DataFrame) -> DataFrame:
    """Adds of the levels: bid1 and ask1 (0 where no level has a price), depth on both sides, spread and imbalance.

    The best level is the first with a price. Spread is null without both; imbalance is between -1 (sellers only) and 1.
    """
    def first(side: str) -> Column:
        return F.coalesce(F.get(F.filter(side, lambda x: x["price"] > 0), F.lit(0))["price"], lit(0))

    def depth(side: str) -> Column:
        return F.aggregate(F.filter(side, lambda x: (x["price"] > 0) & (x["volume"] > 0)), lit(0), lambda s, x: s + x["volume"])

    df = df.withColumns({"bid1": first("bids"), "ask1": first("asks"), "bid_depth": depth("bids"), "ask_depth": depth("asks")})
    both = F.col("bid_depth") + F.col("ask_depth")
    return df.withColumns(
        {
            "spread": F.when((F.col("bid1") > 0) & (F.col("ask1") > 0), F.col("ask1") - F.col("bid1")),
            "imbalance": F.when(both > 0, (F.col("bid_depth") - F.col("ask_depth")) / both).otherwise(lit(0)),
        }
    )


def parse_tilde_quotes(df: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """Quote lines `v_<code>="f0~f1~...";` to quotes with levels, plus rejected lines. Foreign markets have no levels."""
    code = F.regexp_replace(F.regexp_extract(line, r"^\s*(v_[A-Za-z0-9_]+)=", 1), "^v_(r_)?", "")
    parts = df.withColumns({"code": code, "_f": F.split(F.regexp_extract(line, r'="([^"]*)"', 1), "~")})
    at = lambda name: F.trim(F.get("_f", F.lit(TILDE_FIELDS[name])))
    ok = F.coalesce((F.col("code") != "") & (F.size("_f") >= TILDE_FIELDS["min"]), F.lit(False))
    stamp = F.regexp_replace(at("stamp"), "[^0-9]", "")
    day = F.when(F.length(stamp) >= 8, F.concat_ws("-", F.substring(stamp, 1, 4), F.substring(stamp, 5, 2), F.substring(stamp, 7, 2)))
    home = F.substring("code", 1, 2).isin("sh", "sz", "bj")
    sides = [F.when(home, book_side(F.col("_f"), *at_)).otherwise(F.array().cast(LEVEL)).alias(n) for n, at_ in TILDE_LEVELS.items()]
    numbers = [parse_number(at(n)).alias(n) for n in ("open", "pre_close", "price", "high", "low")]
    good = parts.filter(ok).select("code", at("name").alias("name"), *numbers, day.alias("quote_date"), *sides, *[c for c in df.columns if c != line])
    return good, parts.filter(~ok).select(*df.columns)


def parse_quote_lines(df: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """Quote lines to the quote schema with five buy and sell levels, plus a frame of rejected lines.

    A line is `var hq_str_<market><code>="f0,f1,...";`; the market picks the positions.
    """
    code = F.regexp_extract(line, r"hq_str_([A-Za-z0-9_]+)=", 1)
    body = F.regexp_extract(line, r'="([^"]*)"', 1)
    two = F.substring(code, 1, 2)
    market = (
        F.when(two.isin("sh", "sz", "bj", "sb"), "cn").when(two == "hk", "hk").when(two == "gb", "us").otherwise("")
    )
    parts = df.withColumns({"code": code, "_m": market, "_f": F.split(body, ",")})

    def at(i: int) -> Column:
        return F.trim(F.get("_f", F.lit(i)))

    def pick(name: str) -> Column:
        out = F.lit(None).cast("string")
        for m, pos in QUOTE_FIELDS.items():
            if name in pos:
                out = F.when(F.col("_m") == m, at(pos[name])).otherwise(out)
        return out

    need = F.lit(10**6)
    for m, pos in QUOTE_FIELDS.items():
        need = F.when(F.col("_m") == m, F.lit(pos["min"])).otherwise(need)
    ok = F.coalesce(F.size("_f") >= need, F.lit(False))
    stamp = pick("stamp")
    numbers = ("open", "pre_close", "price", "high", "low", "volume", "amount")
    good = parts.filter(ok).select(
        "code",
        pick("name").alias("name"),
        *[parse_number(pick(n)).alias(n) for n in numbers],
        F.regexp_replace(F.coalesce(pick("date"), F.substring_index(stamp, " ", 1)), "/", "-").alias("quote_date"),
        F.coalesce(pick("time"), F.substring_index(stamp, " ", -1)).alias("quote_time"),
        *[F.when(F.col("_m") == "cn", book_side(F.col("_f"), *at_)).otherwise(F.array().cast(LEVEL)).alias(n) for n, at_ in COMMA_LEVELS.items()],
        *[c for c in df.columns if c != line],
    )
    return good, parts.filter(~ok).select(*df.columns)


def parse_change_items(df: DataFrame, payload: str = "payload", code: str = "change_type") -> DataFrame:
    """Positional payload of a change event to price, rate (percent), volume and amount, by event code."""
    t = _c(code)
    parts = F.split(payload, ",")

    def num(i: int) -> Column:
        return F.get(parts, F.lit(i)).try_cast("double")

    rate_first = t.isin(*ev.RATE_FIRST_CODES)
    price_volume = t.isin(4, 8)
    price_rate = t.isin(16, 32)
    price_gap_rate = t.isin(8213, 8214)
    rate_price = t.isin(8215, 8216)
    zero = lit(0)
    rate = (
        F.when(rate_first | rate_price, num(0))
        .when(price_volume, num(3))
        .when(price_rate, num(1))
        .otherwise(num(2))
    )
    price = F.when(price_volume | price_rate | price_gap_rate, num(0)).otherwise(num(1))
    has_volume = ~(rate_first | price_rate | price_gap_rate | rate_price)
    volume = F.when(has_volume, F.when(price_volume, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0))))
    amount = F.when(has_volume & ~price_volume, num(3))
    return df.withColumns(
        {
            "price": F.coalesce(price, zero),
            "rate": F.coalesce(rate * lit(100), zero),
            "volume": F.coalesce(volume.try_cast("long"), F.lit(0).cast("long")),
            "amount": F.coalesce(amount, zero),
        }
    )


# fixed values: column order of the daily money-flow lines
FLOW_COLUMNS = (
    "day", "main", "small", "medium", "large", "super_large", "main_pct", "small_pct", "medium_pct", "large_pct",
    "super_large_pct", "close", "change_pct",
)


def parse_delimited_flow(df: DataFrame, line: str = "line") -> DataFrame:
    """Comma line to 13 money-flow columns; short lines yield nulls."""
    parts = F.split(line, ",")
    cols = [F.get(parts, F.lit(i)).alias(n) if n == "day" else F.get(parts, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(FLOW_COLUMNS)]
    return df.select(*[c for c in df.columns if c != line], *cols)


def first_non_empty_source(sources: Sequence[tuple[str, DataFrame]], key: str = "code") -> DataFrame:
    """Per key, all rows of the first source that has any; `source` tells which one.

    The winner per key is a pre-aggregated minimum, joined back, so a key with very many
    rows is never gathered in one task.
    """
    tagged = [df.withColumn("source", F.lit(name)).withColumn("_rank", F.lit(i)) for i, (name, df) in enumerate(sources)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    best = both.groupBy(key).agg(F.min("_rank").alias("_best"))
    return both.join(best, key).filter(F.col("_rank") == F.col("_best")).drop("_rank", "_best")
