"""FIFO matching of a trade ledger, chip (cost) distribution, purchase guard, tracking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import lit
from barloom.functions.ranks import count_if
from barloom.operators.joins import asof_latest
from barloom.sources.sinks import materialized

_UPTO = (Window.unboundedPreceding, 0)
_BEFORE = (Window.unboundedPreceding, -1)


def _two_level(df: DataFrame, value: Column, name: str, keys: Sequence[str] = ("code",), bucket: str = "day", order: str = "k") -> DataFrame:
    """Running sum along (bucket, order): inside buckets by a window, across buckets by their totals.

    A key that holds a third of all rows is spread over its buckets; only one row per bucket
    is ordered per key.
    """
    inside = Window.partitionBy(*keys, bucket).orderBy(order).rowsBetween(*_UPTO)
    df = df.withColumn("_in", F.sum(value).over(inside))
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_t"))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(*_BEFORE)
    totals = totals.select(*keys, bucket, F.coalesce(F.sum("_t").over(w), lit(0)).alias("_base"))
    return df.join(totals, [*keys, bucket]).withColumn(name, F.col("_base") + F.col("_in")).drop("_in", "_base")


def consume(trades: DataFrame, dealt: bool = False) -> DataFrame:
    """Adds cumulative purchases (bought_to), what a sell consumes, and cumulative consumption (used_to).

    With the running signed volume S and its floor M = min(0, running minimum of S), the
    inventory is S - M, a sell consumes its volume less the drop of M, and total consumption is
    total sales + M. Running sums and minima are taken inside a (code, day) and carried over
    days from one row per day, so a code that holds a third of all rows is spread over its days. `dealt` trades already
    stand together by code and day.
    """
    buy = F.when(F.col("side") == "buy", F.col("volume")).otherwise(lit(0))
    width = int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows without a key meet no day below; without them here, days and rows read one and the same exchange
    df = trades.filter("code IS NOT NULL AND day IS NOT NULL").withColumns({"_b": buy, "_s": F.when(F.col("side") == "buy", F.col("volume")).otherwise(-F.col("volume"))})
    df = df if dealt else df.repartition(width, "code", "day")
    inside = Window.partitionBy("code", "day").orderBy("k")
    upto, before = inside.rowsBetween(*_UPTO), inside.rowsBetween(*_BEFORE)
    df = df.withColumns({"_rs": F.sum("_s").over(upto), "_rb": F.sum("_b").over(upto)})
    df = df.withColumns({"_low": F.min("_rs").over(upto), "_low0": F.min("_rs").over(before)})
    days = df.groupBy("code", "day").agg(F.sum("_s").alias("_ts"), F.sum("_b").alias("_tb"), F.min("_rs").alias("_m"))
    w = Window.partitionBy("code").orderBy("day").rowsBetween(*_BEFORE)
    days = days.withColumns({"_s0": F.coalesce(F.sum("_ts").over(w), lit(0)), "_b0": F.coalesce(F.sum("_tb").over(w), lit(0))})
    floor = F.least(F.coalesce(F.min(F.col("_s0") + F.col("_m")).over(w), lit(0)), lit(0))
    days = days.select("code", "day", "_s0", "_b0", floor.alias("_floor"))
    df = df.join(days, ["code", "day"])
    low = F.least(F.col("_s0") + F.col("_low"), F.col("_floor"))
    low0 = F.least(F.coalesce(F.col("_s0") + F.col("_low0"), F.col("_floor")), F.col("_floor"))
    bought = F.col("_b0") + F.col("_rb")
    sold = bought - (F.col("_s0") + F.col("_rs"))
    sell = F.col("side") == "sell"
    return df.select(
        *trades.columns,
        F.when(sell, F.col("volume") - (low0 - low)).otherwise(lit(0)).alias("consumed"),
        bought.alias("bought_to"),
        (sold + low).alias("used_to"),
    )


def lots(trades: DataFrame, dealt: bool = False) -> tuple[DataFrame, DataFrame]:
    """Buy lots with their range of cumulative purchases, sells with their range of cumulative consumption.

    Trades are exchanged once and stored with their ranges, since lots and sells are read several times.
    """
    buy, used = F.col("side") == "buy", F.col("used_to")
    lo = F.when(buy, F.col("bought_to") - F.col("volume")).otherwise(used - F.col("consumed"))
    df = consume(trades, dealt).filter("side IN ('buy', 'sell')")
    df = materialized(df.select("code", "day", "side", "price", "volume", F.when(~buy, F.col("consumed")).alias("consumed"), lo.alias("lo"), F.when(buy, F.col("bought_to")).otherwise(used).alias("hi")))
    return df.filter("side = 'buy'").drop("side", "consumed"), df.filter("side = 'sell'").drop("side")


def sell_costs(b: DataFrame, s: DataFrame, bucket: float = 1024.0) -> DataFrame:
    """Cost of every sell: overlap of its consumption range with the lots' ranges, times lot price.

    Ranges are cut at multiples of `bucket` units and meet on (code, bucket), so a busy code is
    spread over tasks and the join never compares all its lots with all its sells.
    """

    def cut(df: DataFrame) -> DataFrame:
        first, last = F.floor(F.col("lo") / bucket), F.ceil(F.col("hi") / bucket) - 1
        each = df.filter("hi > lo").select("code", "price", "lo", "hi", F.col("lo").alias("from"), F.col("hi").alias("to"), F.explode(F.sequence(first, F.greatest(first, last))).alias("_q"))
        return each.withColumns({"lo": F.greatest("lo", F.col("_q") * bucket), "hi": F.least("hi", (F.col("_q") + 1) * bucket)})

    lot = cut(b).select("code", "_q", F.col("lo").alias("b0"), F.col("hi").alias("b1"), F.col("price").alias("lot_price"))
    # a consumption range identifies its sell, even among identical trades
    sell = cut(s).select("code", "from", "to", "_q", F.col("lo").alias("c0"), F.col("hi").alias("c1"))
    part = F.least("b1", "c1") - F.greatest("b0", "c0")
    j = sell.join(lot, ["code", "_q"]).filter((F.col("b0") < F.col("c1")) & (F.col("c0") < F.col("b1")))
    cost = j.groupBy("code", F.col("from").alias("lo"), F.col("to").alias("hi")).agg(F.sum(part * F.col("lot_price")).alias("cost"))
    out = s.join(cost, ["code", "lo", "hi"], "left").withColumn("cost", F.coalesce("cost", lit(0)))
    full = F.col("consumed") >= F.col("volume")
    return out.withColumns({"covered": full, "profit": F.when(full, F.col("price") * F.col("volume") - F.col("cost"))})


def fifo_positions(trades: DataFrame, dealt: bool = False) -> DataFrame:
    """Per code: open volume and cost from the unconsumed lots, and realised profit.

    A sell beyond the inventory consumes what is there and adds no realised profit.
    """
    b, s = lots(trades, dealt)
    used = s.groupBy("code").agg(F.max("hi").alias("_used"))
    left = b.join(used, "code", "left").withColumn("_rest", F.greatest(F.col("hi") - F.greatest(F.col("lo"), F.coalesce("_used", lit(0))), lit(0)))
    pos = left.groupBy("code").agg(F.sum("_rest").alias("open_volume"), F.sum(F.col("_rest") * F.col("price")).alias("open_cost"), F.sum(F.col("volume") * F.col("price")).alias("bought"))
    sold = sell_costs(b, s).groupBy("code").agg(
        F.coalesce(F.sum("profit"), lit(0)).alias("realized"),
        F.sum("cost").alias("matched_cost"),
        F.sum(F.col("price") * F.col("volume")).alias("sold"),
        count_if(~F.col("covered")).alias("uncovered_sells"),
    )
    j = pos.join(sold, "code", "full_outer").fillna(0)
    return j.withColumn("avg_cost", F.when(F.col("open_volume") > 0, F.col("open_cost") / F.col("open_volume")).otherwise(lit(0)))


def ledger_totals(positions: DataFrame) -> DataFrame:
    """Whole-ledger statistics; here the partial cost of uncovered sells does count."""
    return positions.agg(
        F.sum("bought").alias("bought"),
        F.sum("sold").alias("sold"),
        F.sum("realized").alias("realized"),
        (F.sum("sold") - F.sum("matched_cost")).alias("net_of_matched_cost"),
        F.sum("open_cost").alias("open_cost"),
        count_if(F.col("open_volume") > 0).alias("open_positions"),
    )


# --- chips ------------------------------------------------------------------------------------------


def chip_bins(bars: DataFrame, bins: int = 80) -> DataFrame:
    """Volume by price bin per code after daily decay: code, bin, price, volume, ratio.

    A bar's weight at the end is the product of (1 - turnover) of all later bars, in closed
    form; its volume spreads by a Gaussian around its mean price over the bins it covers.
    """
    bins = min(max(bins, 1), 300)
    t = F.greatest(lit(0), F.least(F.col("turnover"), lit(0.98)))
    later = Window.partitionBy("code").orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("code")
    df = bars.withColumn("_ln", F.log(lit(1) - t))
    lo0 = F.min(F.when(F.col("low") > 0, F.col("low"))).over(whole)
    df = df.withColumns({"_decay": F.exp(F.coalesce(F.sum("_ln").over(later), lit(0))), "_min": lo0, "_max": F.max("high").over(whole)})
    top = F.when(F.col("_max") == F.col("_min"), F.col("_min") * lit(1.001)).otherwise(F.col("_max"))
    df = df.filter((F.col("volume") > 0) & (F.col("low") > 0) & (F.col("high") > 0)).withColumns(
        {"_w": (top - F.col("_min")) / lit(bins), "_lo": F.least("low", "high"), "_hi": F.greatest("low", "high")}
    )
    lo, hi, w, base = F.col("_lo"), F.col("_hi"), F.col("_w"), F.col("_min")
    mean = F.when(F.col("amount") > 0, F.col("amount") / F.col("volume")).otherwise((hi + lo + F.col("close")) / lit(3))
    mean = F.least(hi, F.greatest(lo, mean))

    def idx(x: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.floor((x - base) / w), F.lit(bins - 1)))

    flat = hi - lo < lit(1e-9) * F.greatest(lit(1), hi)
    sigma = F.greatest((hi - lo) * lit(0.18), hi * lit(1e-6), lit(1e-6))
    df = df.withColumns({"_m": mean, "_sg": sigma, "_flat": flat, "_i0": F.when(flat, idx((lo + hi) / lit(2))).otherwise(idx(lo)), "_i1": F.when(flat, idx((lo + hi) / lit(2))).otherwise(idx(hi))})

    def kernel(i: Column) -> Column:
        at = base + (i + lit(0.5)) * w
        z = (at - F.col("_m")) / F.col("_sg")
        return F.when(F.col("_flat"), lit(1)).when((at < lo) | (at > hi), lit(0)).otherwise(F.exp(z * z * lit(-0.5)))

    df = df.withColumn("_k", F.transform(F.sequence("_i0", "_i1"), lambda i: F.struct(i.alias("bin"), kernel(i.cast("double")).alias("x"))))
    df = df.withColumn("_sum", F.aggregate("_k", lit(0), lambda a, e: a + e["x"]))
    one = df.select("code", "_min", "_w", "_i0", "_i1", "_sum", (F.col("volume") * F.col("_decay")).alias("_v"), F.explode("_k").alias("e"))
    share = F.when(F.col("_sum") > 0, F.col("e.x") / F.col("_sum")).otherwise(lit(1) / (F.col("_i1") - F.col("_i0") + 1))
    g = one.groupBy("code", F.col("e.bin").alias("bin"), "_min", "_w").agg(F.sum(F.col("_v") * share).alias("volume"))
    total = F.sum("volume").over(whole)
    return g.select(
        "code",
        F.col("bin").cast("long").alias("bin"),
        (F.col("_min") + (F.col("bin") + lit(0.5)) * F.col("_w")).alias("price"),
        "volume",
        F.when(total > 0, F.col("volume") / total).otherwise(lit(0)).alias("ratio"),
    )


def chip_summary(chips: DataFrame, bars: DataFrame) -> DataFrame:
    """Average cost and the share of chips at or below the last close."""
    last = bars.groupBy("code").agg(F.max_by("close", "day").alias("current"), F.count(F.lit(1)).alias("days"))
    j = chips.join(last, "code")
    return j.groupBy("code", "current", "days").agg(
        (F.sum(F.col("volume") * F.col("price")) / F.sum("volume")).alias("avg_cost"),
        (F.sum(F.when(F.col("price") <= F.col("current"), F.col("volume")).otherwise(lit(0))) / F.sum("volume")).alias("profit_ratio"),
    )


# --- guards and tracking --------------------------------------------------------------------------------


def frequency_guard(buys: DataFrame, ts: str = "ts", week_limit: int = 5) -> DataFrame:
    """Per buy: was there another buy of the code in 24 hours, and at least five in the 7 days up to it.

    A buy adds one when it is made and takes one off when it leaves the window, so both counts are running sums:
    inside a (code, day) by one window, over days from one row of totals per day. The table is read once.
    """
    at = F.col(ts)
    left = lambda hours: at + F.make_interval(hours=F.lit(hours))
    marks = F.array(
        F.struct(at.alias("t"), F.lit(1).alias("d"), F.lit(1).alias("w"), F.lit(True).alias("own")),
        F.struct(left(24).alias("t"), F.lit(-1).alias("d"), F.lit(0).alias("w"), F.lit(False).alias("own")),
        F.struct(left(168).alias("t"), F.lit(0).alias("d"), F.lit(-1).alias("w"), F.lit(False).alias("own")),
    )
    rows = buys.withColumn("_m", F.explode(marks)).withColumn("_b", F.col("_m.t").cast("date"))
    inside = Window.partitionBy("code", "_b").orderBy("_m.t").rangeBetween(*_UPTO)  # equal times count together
    rows = rows.withColumns({"_d": F.sum("_m.d").over(inside), "_w": F.sum("_m.w").over(inside)})
    totals = rows.groupBy("code", "_b").agg(F.sum("_m.d").alias("_td"), F.sum("_m.w").alias("_tw"))
    before = Window.partitionBy("code").orderBy("_b").rowsBetween(*_BEFORE)
    totals = totals.select("code", "_b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_td", "_tw")])
    own = rows.filter("_m.own").join(totals, ["code", "_b"])
    out = own.withColumns({"buys_day": F.col("_d") + F.col("_td"), "buys_week": F.col("_w") + F.col("_tw")})
    out = out.select(*buys.columns, "buys_day", "buys_week")
    return out.withColumns({"repeat_in_day": F.col("buys_day") > 1, "too_frequent": F.col("buys_week") >= week_limit})


def limit_up_summary(rows: DataFrame) -> DataFrame:
    """Per stock-day from its newest snapshot only: highest streak, seal and heat, exploded count."""
    newest = rows.groupBy("code", "day").agg(F.max("snapshot").alias("snapshot"))
    j = rows.join(newest, ["code", "day", "snapshot"], "left_semi")
    return j.groupBy("code", "day").agg(
        F.max("streak").alias("max_streak"), F.max("seal_ratio").alias("max_seal"), F.max("plate_heat").alias("max_heat"), count_if(F.col("exploded")).alias("exploded")
    )


def track_recommendations(recs: DataFrame, prices: DataFrame) -> DataFrame:
    """Where the price stands in each recommendation: buy zone, take-profit, stop, or between."""
    j = recs.join(prices.select("code", "price"), "code", "left")
    p = F.col("price")
    zone = (
        F.when(p.isNull(), "no_price")
        .when((F.col("stop_price") > 0) & (p <= F.col("stop_price")), "loss")
        .when((F.col("profit_price") > 0) & (p >= F.col("profit_price")), "profit")
        .when((p >= F.col("buy_min")) & (p <= F.col("buy_max")), "buy")
        .otherwise("between")
    )
    return j.withColumn("zone", zone)


def rebase_thresholds(alerts: DataFrame, min_change: float = 0.005) -> DataFrame:
    """Thresholds after a change of holding cost, and fixed alert prices after a split.

    The cost factor applies within [0.1, 10]; the split ratio when it moves the basis by half
    a percent or more. Running it again changes nothing, since the new basis is stored.
    """
    f = F.col("holding_cost") / F.col("cost_price")
    ok = (F.col("cost_price") > 0) & (F.col("holding_cost") > 0) & f.between(0.1, 10)
    factor = F.when(ok, f).otherwise(lit(1))
    ratio = F.col("basis_now") / F.col("basis_stored")
    split = F.when((F.col("basis_stored") > 0) & (F.col("basis_now") > 0) & (F.abs(ratio - lit(1)) >= min_change), ratio).otherwise(lit(1))
    out = {c: F.when(F.col(c) > 0, F.col(c) * factor).otherwise(F.col(c)) for c in ("defence_price", "stop_price", "profit_price")}
    return alerts.withColumns({**out, "alert_price": F.col("alert_price") * split, "cost_price": F.when(ok, F.col("holding_cost")).otherwise(F.col("cost_price")), "basis_stored": F.when(F.col("basis_now") > 0, F.col("basis_now")).otherwise(F.col("basis_stored"))})


def fresh_quotes(quotes: DataFrame, now: Column, ts: str = "ts") -> DataFrame:
    """Adds `fresh`: same local day, and an age from -2 to 3 minutes."""
    age = now.cast("timestamp").cast("double") - F.col(ts).cast("timestamp").cast("double")
    return quotes.withColumn("fresh", (F.col(ts).cast("date") == now.cast("date")) & age.between(-120, 180))
