"""Signal backtests with barriers and costs, folds, metrics, benchmark, verdict.

Each signal is its own trade: there is no shared cash and no cap on holdings, so signals
run in parallel and the result does not depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.codes import pays_stamp_duty
from barloom.functions.numeric import clamp, floor_lot, lit, safe_ratio
from barloom.functions.ranks import count_if
from barloom.operators.recurrence import BLOCK
from barloom.operators.windows import Roll

# fixed values: default cost model
COSTS = {"fee": 0.0003, "min_fee": 5.0, "stamp": 0.0005, "slippage": 0.0015, "impact": 0.002, "impact_cap": 0.02, "lot": 100, "participation": 0.05}


def barrier_trades(df: DataFrame, stop_loss: float, stop_gain: float, max_hold: int) -> DataFrame:
    """One row per matched signal that could enter and leave.

    Entry is the next bar's open if that bar is tradable. From the bar after entry on: a stop
    before a gain on the same bar, gaps fill at the open, an exit condition fills at the next
    open, and the last allowed bar closes the trade. Needs entry_matched, exit_matched and
    tradable columns. Only the next max_hold + 2 bars are looked at, in the bars' own order,
    so no signal-by-bar join is made and no bar is copied for a signal.
    """
    return walked(df, [F.col("entry_matched")], [F.col("exit_matched")], [limits(stop_loss, stop_gain)], max_hold).drop("at")


def limits(stop_loss: float, stop_gain: float) -> tuple[float, float]:
    """Stop and gain, held in the range of a trade, as shares of the entry price."""
    return 1 - min(max(stop_loss, 0.03), 0.15), 1 + min(max(stop_gain, 0.02), 0.30)


def walked(df: DataFrame, entries: Sequence[Column], exits: Sequence[Column], shares: Sequence[tuple[float, float]], max_hold: int) -> DataFrame:
    """Trades of every variant, `at` being its place in the lists; shares are its stop and gain as those of the entry price.

    The bar number is a window by code, so a task gets whole instruments in time order and steps all their signals on by
    one bar at a time; it holds one block and the start of the next.
    """
    flags = {**{f"_in{k}": c for k, c in enumerate(entries)}, **{f"_out{k}": c for k, c in enumerate(exits)}}
    prices = [F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")]
    bars = df.select("code", "day", *prices, "volume", "tradable", *[c.alias(n) for n, c in flags.items()], Roll().at().alias("_ix"))
    kinds = dict(bars.dtypes)
    schema = f"at int, code {kinds['code']}, signal_day {kinds['day']}, buy_day {kinds['day']}, sell_day {kinds['day']}, buy_price double, sell_price double, reason string, hold_days int, buy_volume {kinds['volume']}, return_rate double"

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for k, (stop, gain) in enumerate(shares):
            yield from outcomes(table, k, stop, gain, max_hold).to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_series(batches):
            yield from done(table)

    return bars.mapInArrow(run, schema)


def whole_series(batches: Iterator[pa.RecordBatch], rows: int = BLOCK) -> Iterator[pa.Table]:
    """Tables of whole instruments, of some `rows` rows, from batches in which `_ix` starts again at 1 for each."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            whole = int(np.flatnonzero(table.column("_ix").to_numpy() == 1)[-1])
            if whole:
                yield table.slice(0, whole).combine_chunks()
            held, n = table.slice(whole).to_batches(), n - whole
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


REASONS = pa.array(["stop_loss", "stop_gain", "exit_condition", "max_hold_days"])


def outcomes(table: pa.Table, k: int, stop: float, gain: float, max_hold: int) -> pa.Table:
    """Trades of variant k over whole instruments in time order; `_ix` numbers an instrument's bars from 1."""

    def flag(name: str) -> np.ndarray:
        return table.column(name).combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)

    def price(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values, the same as they compare in Spark (missing below all, NaN above all), and which are there."""
        c = table.column(name).combine_chunks()
        x = c.fill_null(-np.inf).to_numpy(zero_copy_only=False)
        return c.fill_null(np.nan).to_numpy(zero_copy_only=False), np.where(np.isnan(x), np.inf, x), c.is_valid().to_numpy(zero_copy_only=False)

    ix, n, leave = table.column("_ix").to_numpy(), table.num_rows, flag(f"_out{k}")
    (opens, open_, has_open), (_, high, _), (_, low, _), (closes, _, has_close) = (price(c) for c in ("open", "high", "low", "close"))
    signal = np.flatnonzero(flag(f"_in{k}"))
    signal = signal[signal + 1 < n]
    # the row `i` further on belongs to the same instrument if its number is `i` higher
    signal = signal[(ix[signal + 1] == ix[signal] + 1) & flag("tradable")[signal + 1] & (open_[signal + 1] > 0)]
    reason, sell, held = np.full(len(signal), -1), np.zeros(len(signal), dtype=np.int64), np.zeros(len(signal), dtype=np.int32)
    paid, there = np.zeros(len(signal)), np.ones(len(signal), dtype=bool)
    left = np.arange(len(signal))
    with np.errstate(all="ignore"):
        for i in range(1, max_hold + 1):
            entry = signal[left] + 1
            inside = entry + i < n
            left, entry = left[inside], entry[inside]
            inside = ix[entry + i] == ix[entry] + i
            left, entry = left[inside], entry[inside]
            bar = entry + i
            # the entry price may be NaN or infinite, and compares as such
            stop_at, gain_at = open_[entry] * stop, open_[entry] * gain
            down = (low[bar] > 0) & (low[bar] <= stop_at)
            up = ~down & (high[bar] > 0) & (high[bar] >= gain_at)
            rule = ~down & ~up & leave[bar]
            later = np.minimum(bar + 1, n - 1)
            sold = rule & (bar + 1 < n) & (ix[later] == ix[bar] + 1)
            last = ~down & ~up & ~rule & (i >= max_hold)
            for code, hit, at, px, ok, days in (
                (0, down, bar, np.where((open_[bar] > 0) & (open_[bar] < stop_at), opens[bar], opens[entry] * stop), None, i),
                (1, up, bar, np.where(open_[bar] > gain_at, opens[bar], opens[entry] * gain), None, i),
                (2, sold, later, opens[later], has_open[later], i + 1),
                (3, last, bar, closes[bar], has_close[bar], i),
            ):
                who = left[hit]
                reason[who], sell[who], held[who], paid[who] = code, at[hit], days, px[hit]
                if ok is not None:
                    there[who] = ok[hit]
            left = left[~(down | up | sold | last)]
        closed = np.flatnonzero(reason >= 0)
        s, to, px, known = signal[closed], sell[closed], paid[closed], there[closed]
        bought = opens[s + 1]
        rate = px / bought - 1.0

    def rows(name: str, at: np.ndarray) -> pa.Array:
        return table.column(name).combine_chunks().take(pa.array(at))

    return pa.table(
        {
            "at": pa.array(np.full(len(s), k, dtype=np.int32)),
            "code": rows("code", s),
            "signal_day": rows("day", s),
            "buy_day": rows("day", s + 1),
            "sell_day": rows("day", to),
            "buy_price": rows("open", s + 1),
            "sell_price": pa.array(px, mask=~known),
            "reason": REASONS.take(pa.array(reason[closed])),
            "hold_days": pa.array(held[closed]),
            "buy_volume": rows("volume", s + 1),
            "return_rate": pa.array(rate, mask=~known),
        }
    )


def trade_costs(trades: DataFrame, cash: float, slippage: str | None = None, costs: dict | None = None) -> DataFrame:
    """Quantity in lots within the participation cap, both sides' fees and slippage, and the net return."""
    k = {**COSTS, **(costs or {})}
    slip = F.col(slippage) if slippage else lit(k["slippage"])
    cap = floor_lot(F.col("buy_volume") * lit(100 * k["participation"]), k["lot"])
    wanted = floor_lot(lit(cash) / F.col("buy_price"), k["lot"])
    df = trades.withColumn("quantity", F.when(cap > 0, F.least(wanted, cap)).otherwise(wanted)).filter("quantity > 0")
    part = F.col("quantity") / (F.col("buy_volume") * lit(100))
    impact = F.when(F.col("buy_volume") > 0, F.least(lit(k["impact"]) * F.sqrt(part), lit(k["impact_cap"]))).otherwise(lit(0))
    buy, sell = F.col("buy_price") * F.col("quantity"), F.col("sell_price") * F.col("quantity")

    def fee(gross: Column) -> Column:
        return F.greatest(gross * lit(k["fee"]), lit(k["min_fee"]))

    duty = F.when(pays_stamp_duty(F.col("code").cast("string")), sell * lit(k["stamp"])).otherwise(lit(0))
    df = df.withColumns(
        {
            "fees": fee(buy) + fee(sell) + duty,
            "slippage_cost": (buy + sell) * (slip + impact),
            "pnl": sell - buy,
        }
    )
    return df.withColumn("net_return", (F.col("pnl") - F.col("fees") - F.col("slippage_cost")) / buy)


def lookahead_violations(trades: DataFrame) -> DataFrame:
    """Trades that do not satisfy signal < buy < sell; must be empty."""
    return trades.filter(~((F.col("signal_day") < F.col("buy_day")) & (F.col("buy_day") < F.col("sell_day"))))


def folds(days: DataFrame, purge: int = 5) -> DataFrame:
    """Three test folds after the first 40 percent of days, skipping `purge` days at each start."""
    w = Window.orderBy("day")
    idx = days.select("day").distinct().withColumn("i", F.row_number().over(w) - 1)
    n = idx.agg(F.count(F.lit(1)).alias("n"))
    first, size = F.floor(F.col("n") * lit(0.4)), F.floor((F.col("n") - F.floor(F.col("n") * lit(0.4))) / 3)
    short = size < 2
    plan = n.withColumns({"f": F.when(short, F.floor(F.col("n") * lit(0.7))).otherwise(first)})
    plan = plan.withColumn("s", F.when(short, F.col("n") - F.col("f")).otherwise(size)).filter("n >= 10")
    each = plan.select("n", "s", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("fold"), "f")
    start = F.col("f") + F.col("fold") * F.col("s")
    end = start + F.col("s") - 1
    each = each.filter(start < F.col("n")).select(
        "fold",
        (start + F.lit(max(purge, 1))).alias("a"),
        F.when((F.col("fold") == 2) | (end >= F.col("n")), F.col("n") - 1).otherwise(end).alias("b"),
    ).filter("a <= b")
    lo, hi = idx.select(F.col("i").alias("a"), F.col("day").alias("start_day")), idx.select(F.col("i").alias("b"), F.col("day").alias("end_day"))
    return each.join(lo, "a").join(hi, "b").select("fold", "start_day", "end_day")


def fold_trades(trades: DataFrame, plan: DataFrame) -> DataFrame:
    """Trade count and mean return per fold, by buy day. The plan has at most three rows."""
    j = trades.join(F.broadcast(plan), F.col("buy_day").between(F.col("start_day"), F.col("end_day")))
    stats = j.groupBy("fold").agg(F.count(F.lit(1)).alias("trades"), F.avg("return_rate").alias("avg_return"))
    return plan.join(stats, "fold", "left").fillna(0, ["trades", "avg_return"])


def trade_metrics(trades: DataFrame, keys: Sequence[str] = (), value: str = "return_rate") -> DataFrame:
    """Win rate, mean and median, profit/loss ratio with its status, worst loss, holding days."""
    x = F.col(value)
    win, loss = x >= 0, x < 0
    g = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        (count_if(x > 0) / F.count(F.lit(1))).alias("win_rate"),
        F.avg(x).alias("avg_return"),
        F.median(x).alias("median_return"),
        F.coalesce(F.max(F.when(loss, -x)), lit(0)).alias("worst_loss"),
        F.avg("hold_days").alias("avg_hold_days"),
        F.coalesce(F.avg(F.when(win, x)), lit(0)).alias("_w"),
        F.coalesce(F.avg(F.when(loss, -x)), lit(0)).alias("_l"),
        count_if(win).alias("_nw"),
        count_if(loss).alias("_nl"),
    )
    ratio = F.when((F.col("_nw") > 0) & (F.col("_nl") > 0) & (F.col("_l") > 0), F.col("_w") / F.col("_l")).otherwise(lit(0))
    status = F.when((F.col("_nl") == 0) & (F.col("_w") > 0), "no_loss").when((F.col("_nw") == 0) & (F.col("_nl") > 0), "no_profit").otherwise("normal")
    return g.withColumns({"profit_loss_ratio": ratio, "profit_loss_status": status}).drop("_w", "_l", "_nw", "_nl")


def drawdowns(nav: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Adds the running peak's day index and the drawdown. A series has one row per trading day."""
    w = Window.partitionBy(*keys).orderBy("day")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = nav.withColumns({"i": F.row_number().over(w) - 1, "peak": F.max("nav").over(upto)})
    at_peak = F.max(F.when(F.col("nav") == F.col("peak"), F.col("i"))).over(upto)
    return df.withColumns({"peak_i": at_peak, "drawdown": F.when(F.col("peak") > 0, (F.col("peak") - F.col("nav")) / F.col("peak")).otherwise(lit(0))})


def returns(nav: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Daily returns; days after a base that is not positive are skipped."""
    prev = F.lag("nav").over(Window.partitionBy(*keys).orderBy("day"))
    df = nav.withColumn("_p", prev).filter("_p > 0")
    return df.withColumn("ret", F.col("nav") / F.col("_p") - lit(1)).drop("_p")


def nav_metrics(nav: DataFrame, keys: Sequence[str] = ("strategy",), rf: float = 0.0, sample_std: bool = True, calmar: bool = True) -> DataFrame:
    """Total and annualised return, volatility, Sharpe, Sortino, Calmar, drawdown and its duration.

    sample_std=True: sample deviation and root-mean-square downside, rate 0. False: population
    deviations of all and of the negative returns.
    """
    total = nav.groupBy(*keys).agg(F.count(F.lit(1)).alias("days"), F.min_by("nav", "day").alias("_a"), F.max_by("nav", "day").alias("_b"))
    first = F.when(F.col("_a") > 0, F.col("_a")).otherwise(lit(1))
    total = total.withColumn("total_return", (F.col("_b") - first) / first)
    annual = F.when(F.col("total_return") <= -1, lit(-1)).otherwise(F.pow(lit(1) + F.col("total_return"), lit(252) / F.col("days")) - lit(1))
    x = F.col("ret")
    neg = F.when(x < 0, x)
    std = F.stddev_samp if sample_std else F.stddev_pop
    down = F.sqrt(F.avg(neg * neg)) if sample_std else F.stddev_pop(neg)
    vol = returns(nav, keys).groupBy(*keys).agg(
        F.coalesce(std(x), lit(0)).alias("_s"), F.coalesce(down, lit(0)).alias("_d"), F.count(x).alias("_n")
    )
    dd = drawdowns(nav, keys).groupBy(*keys).agg(F.max("drawdown").alias("max_drawdown"), F.max(F.struct("drawdown", (-F.col("i")).alias("j"), "peak_i")).alias("_m"))
    j = total.join(vol, list(keys)).join(dd, list(keys)) if keys else total.crossJoin(F.broadcast(vol)).crossJoin(F.broadcast(dd))
    year = lit(252**0.5)
    j = j.withColumns({"annual_return": annual, "annual_vol": F.col("_s") * year, "downside_vol": F.col("_d") * year})
    excess = F.col("annual_return") - lit(rf)
    return j.withColumns(
        {
            "sharpe": safe_ratio(excess, "annual_vol"),
            "sortino": safe_ratio(excess, "downside_vol"),
            "calmar": safe_ratio("annual_return", "max_drawdown"),
            "drawdown_days": F.when(F.col("max_drawdown") > 0, -F.col("_m.j") - F.col("_m.peak_i")).otherwise(F.lit(0)),
        }
    ).drop("_a", "_b", "_s", "_d", "_n", "_m")


def benchmark_return(bars: DataFrame, keys: Sequence[str] = ("code",)) -> DataFrame:
    """First to last close; unavailable when either is not positive."""
    g = bars.groupBy(*keys).agg(F.min_by("close", "day").alias("_a"), F.max_by("close", "day").alias("_b"), F.count(F.lit(1)).alias("days"))
    ok = (F.col("_a") > 0) & (F.col("_b") > 0)
    return g.select(*keys, "days", F.when(ok, (F.col("_b") - F.col("_a")) / F.col("_a")).alias("benchmark_return"))


def trading_days(features: DataFrame, benchmark, start: str, end: str) -> DataFrame:
    """(day): the benchmark's days in the period, or every instrument's where the benchmark has none."""
    inside = features.filter(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    days = inside.groupBy("day").agg(F.max(F.col("code") == F.lit(benchmark)).alias("_own"))
    any_own = days.agg(F.coalesce(F.max("_own"), F.lit(False)).alias("_any"))  # one row
    return days.crossJoin(F.broadcast(any_own)).filter(F.col("_own") | ~F.col("_any")).select("day")


def turnover(trades: DataFrame, capital: float, keys: Sequence[str] = ()) -> DataFrame:
    """Bought, sold and two-sided turnover of costed trades as multiples of the capital; without capital all are 0."""
    buy, sell = F.sum(F.col("buy_price") * F.col("quantity")), F.sum(F.col("sell_price") * F.col("quantity"))
    g = trades.groupBy(*keys).agg(F.coalesce(buy, lit(0)).alias("_b"), F.coalesce(sell, lit(0)).alias("_s"))
    share = lit(1 / capital if capital > 0 else 0)
    return g.select(*keys, (F.col("_b") * share).alias("buy_turnover"), (F.col("_s") * share).alias("sell_turnover"), ((F.col("_b") + F.col("_s")) / lit(2) * share).alias("two_sided_turnover"))


def verdict(df: DataFrame) -> DataFrame:
    """First failing gate wins. Needs the evidence columns named below, one row per strategy."""
    c = F.col
    gates = [
        (~c("no_lookahead"), "reject", "lookahead"),
        (c("trades") == 0, "reject", "no_trades"),
        (c("coverage") < c("min_coverage"), "reject", "coverage"),
        ((c("max_drawdown") > 0.25) | (c("avg_return") <= 0), "reject", "return_drawdown"),
        (~c("cost_2x_passed"), "watchlist", "cost"),
        ((c("trades") < 30) | ~c("benchmark_available"), "watchlist", "sample_benchmark"),
        (c("excess_return") <= 0, "watchlist", "excess"),
        ((c("out_trades") < 15) | (c("out_avg_return") <= 0), "paper_trade", "out_of_sample"),
        (c("parameter_stability") != "stable", "paper_trade", "parameters"),
    ]
    status = F.lit("active_candidate")
    gate = F.when(F.size("warnings") > 0, F.lit("warnings")).otherwise(F.lit("passed")) if "warnings" in df.columns else F.lit("passed")
    for cond, s, g in reversed(gates):
        status, gate = F.when(cond, s).otherwise(status), F.when(cond, g).otherwise(gate)
    return df.withColumns({"status": status, "gate": gate})


def cost_stress(trades: DataFrame, cash: float, base: float = COSTS["slippage"]) -> DataFrame:
    """Metrics under 1, 1.5 and 2 times the slippage, in one pass over the trades."""
    levels = F.array(*[F.struct(F.lit(n).alias("scenario"), lit(base * m).alias("slip")) for n, m in (("base", 1.0), ("slippage_1_5x", 1.5), ("slippage_2x", 2.0))])
    each = trades.withColumn("_s", F.explode(levels)).select(*trades.columns, "_s.scenario", "_s.slip")
    priced = trade_costs(each, cash, slippage="slip")
    return priced.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("trades"), F.avg("net_return").alias("avg_return"), F.sum("slippage_cost").alias("slippage_cost")
    )


def bootstrap(trades: DataFrame, sims: int = 1000, seed: int = 7, value: str = "return_rate") -> DataFrame:
    """Resample with replacement: `sims` runs of n draws; one row per run.

    Draw k of run s takes the row numbered mix(seed, s, k) mod n, so the result is the same
    on any cluster. Runs x draws is spread over tasks by a range; each run then needs only
    its own draws. Path measures use block sums of log returns, so a long run splits over tasks.
    """
    spark = trades.sparkSession
    per_day = trades.groupBy("day").agg(F.count(F.lit(1)).alias("_n"))
    per_day = per_day.withColumn("_before", F.sum("_n").over(Window.orderBy("day")) - F.col("_n")).drop("_n")
    inside = Window.partitionBy("day").orderBy("code", value)
    rows = trades.join(per_day, "day").select((F.col("_before") + F.row_number().over(inside) - 1).alias("pick"), F.col(value).alias("x"))
    n = trades.agg(F.count(F.lit(1)).alias("n")).filter("n >= 10")
    runs = spark.range(sims).withColumnRenamed("id", "sim").crossJoin(F.broadcast(n))
    draws = runs.select("sim", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    draws = draws.withColumn("pick", mixed_draw(seed, "sim", "k") % F.col("n"))
    got = draws.join(rows, "pick").select("sim", "k", "x")
    return simulate_paths(got)


def mixed_draw(seed: int, sim: str, k: str) -> Column:
    """A pseudo-random number below 2**31 - 1 from integers: two quadratic steps modulo that prime."""
    p = F.lit((1 << 31) - 1).cast("long")
    x = (F.lit(seed * 104_729 + 12_345).cast("long") + F.col(sim) * 1_000_003 + F.col(k) * 7_919) % p
    x = (x * x % p + x * 48_271) % p
    return (x * x % p + x * 40_692 + F.col(sim)) % p


def simulate_paths(draws: DataFrame, block: int = 4096) -> DataFrame:
    """Per run: summed and compounded return, maximum drawdown, Sharpe and win rate.

    The compounded path is a running log sum in two levels: inside blocks of draws, and over
    the blocks' totals, minima and maxima.
    """
    log = F.when(F.col("x") > -1, F.log(lit(1) + F.col("x"))).otherwise(lit(-745))
    d = draws.select("sim", "k", "x", log.alias("lg"), F.floor(F.col("k") / block).alias("b"))
    wb = Window.partitionBy("sim", "b").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("run", F.sum("lg").over(wb))
    tot = d.groupBy("sim", "b").agg(F.sum("lg").alias("t"), F.max("run").alias("top"))
    wt = Window.partitionBy("sim").orderBy("b")
    back = wt.rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("base", F.coalesce(F.sum("t").over(back), lit(0)))
    tot = tot.withColumn("peak0", F.greatest(F.coalesce(F.max(F.col("base") + F.col("top")).over(back), lit(0)), lit(0)))
    j = d.join(tot.select("sim", "b", "base", "peak0"), ["sim", "b"])
    level = F.col("base") + F.col("run")
    peak = F.greatest(F.max(level).over(wb), F.col("peak0"))
    j = j.withColumn("dd", lit(1) - F.exp(level - peak))
    g = j.groupBy("sim").agg(
        F.sum("x").alias("sum_return"),
        (F.exp(F.sum("lg")) - lit(1)).alias("compound_return"),
        F.greatest(F.max("dd"), lit(0)).alias("max_drawdown"),
        F.avg("x").alias("_m"),
        F.stddev_pop("x").alias("_s"),
        (count_if(F.col("x") > 0) / F.count(F.lit(1))).alias("win_rate"),
    )
    return g.withColumn("sharpe", F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * lit(252**0.5)).otherwise(lit(0))).drop("_m", "_s")


def interval(sims: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, deviation, upper median and lower-nearest quantiles per measure; one row per measure.

    The runs are a fixed number (default 1000), so ranking them is a small job.
    """
    long = sims.select("sim", *columns).unpivot(["sim"], list(columns), "measure", "x")
    w = Window.partitionBy("measure")
    df = long.withColumns({"_i": F.row_number().over(w.orderBy("x", "sim")) - 1, "_n": F.count(F.lit(1)).over(w)})

    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("_i") == rank, F.col("x")))

    qs = {f"p{int(p * 1000):03d}": at(F.floor((F.col("_n") - 1) * lit(p))) for p in (0.025, 0.05, 0.25, 0.75, 0.95, 0.975)}
    return df.groupBy("measure").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), at(F.floor(F.col("_n") / 2)).alias("median"), *[e.alias(n) for n, e in qs.items()]
    )


def stock_breakdown(trades: DataFrame) -> DataFrame:
    """Per-stock result of costed trades, best P&L first: P&L after costs, count, win rate, mean and median return,
    mean adverse and favourable excursion (columns mae and mfe, see `extremes.excursions`), holding days."""
    net = F.col("pnl") - F.col("fees") - F.col("slippage_cost")
    per = trades.groupBy("code").agg(
        F.sum(net).alias("pnl"),
        F.count(F.lit(1)).alias("trades"),
        (count_if(F.col("return_rate") > 0) / F.count(F.lit(1))).alias("win_rate"),
        F.avg("return_rate").alias("avg_return"),
        F.median("return_rate").alias("median_return"),
        F.avg("mae").alias("avg_mae"),
        F.avg("mfe").alias("avg_mfe"),
        F.avg("hold_days").alias("avg_hold_days"),
    )
    return per.orderBy(F.desc("pnl"), "code")


# --- portfolio risk -------------------------------------------------------------------------------


def portfolio_risk(nav: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Risk report per series: ratios over a 2 percent rate, VaR, CVaR, drawdown, breaker with three triggers.

    Calmar uses the drawdown of the same report.
    """
    m = nav_metrics(nav, keys, rf=0.02, sample_std=False)
    w = Window.partitionBy(*keys)
    r = returns(nav, keys).select(*keys, "day", "ret")
    r = r.withColumns({"_i": F.row_number().over(w.orderBy("ret", "day")) - 1, "_n": F.count(F.lit(1)).over(w)})
    worst = F.greatest(F.floor(F.col("_n") / 20), F.lit(1))

    def at(p: float) -> Column:
        return -F.max(F.when(F.col("_i") == F.floor(F.col("_n") * lit(p)), F.col("ret")))

    v = r.groupBy(*keys).agg(
        at(0.05).alias("var95"), at(0.01).alias("var99"), (-F.avg(F.when(F.col("_i") < worst, F.col("ret")))).alias("cvar95"), F.max("_n").alias("_k")
    )
    v = v.withColumns({c: F.when(F.col("_k") >= 10, F.col(c)).otherwise(lit(0)) for c in ("var95", "var99", "cvar95")}).drop("_k")
    j = m.join(v, list(keys))
    triggers = (F.col("max_drawdown") > 0.20).cast("int") + (F.col("var95") > 0.08).cast("int") + (F.col("annual_vol") > 0.50).cast("int")
    return j.withColumns({"triggers": triggers, "breaker": triggers >= 2})


def concentration(trades: DataFrame, sectors: DataFrame) -> DataFrame:
    """Share of trades per industry; above 30 percent high, above 20 percent medium."""
    per_code = trades.groupBy("code").agg(F.count(F.lit(1)).alias("_n"))
    j = per_code.join(sectors.select("code", "industry"), "code", "left")
    g = j.groupBy(F.coalesce("industry", F.lit("unknown")).alias("industry")).agg(F.sum("_n").alias("trades"))
    share = F.col("trades") / F.sum("trades").over(Window.partitionBy(F.lit(0)))
    g = g.withColumn("weight", share)
    return g.withColumn("risk", F.when(F.col("weight") > 0.30, "high").when(F.col("weight") > 0.20, "medium").otherwise("low"))


def allocation(nav: DataFrame, strategies: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Weights of four methods per strategy, and each method's expected return, risk, Sharpe and diversification.

    The strategies are a given short list; their series meet on the day, so all correlations
    come from one aggregation over a pivoted table.
    """
    from barloom.operators.joins import pair_correlations

    r = returns(nav)
    wide = r.groupBy("day").agg(*[F.max(F.when(F.col("strategy") == s, F.col("ret"))).alias(s) for s in strategies])
    pairs = pair_correlations(wide, strategies)
    both = pairs.select("a", "b", "rho").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "rho"))
    avg_abs = both.groupBy(F.col("a").alias("strategy")).agg(F.avg(F.abs("rho")).alias("rho_bar"))
    stats = r.groupBy("strategy").agg(
        (F.avg("ret") * lit(252)).alias("ret"),
        (F.stddev_pop("ret") * lit(252**0.5)).alias("vol"),
        (F.sqrt(F.avg(F.col("ret") * F.col("ret"))) * lit(252**0.5)).alias("rms"),
    )
    s = stats.join(avg_abs, "strategy")
    vol = F.when(F.col("vol") < 1e-10, lit(0.01)).otherwise(F.col("vol"))
    sharpe = F.when(F.col("vol") > 0, (F.col("ret") - lit(0.02)) / F.col("vol")).otherwise(lit(0))
    raw = {
        "equal_weight": lit(1),
        "risk_parity": lit(1) / vol,
        "min_variance": lit(1) / (vol * (lit(1) + F.col("rho_bar"))),
        "max_sharpe": F.greatest(sharpe, lit(0)) / (lit(1) + F.col("rho_bar") * lit(0.5)),
    }
    every = Window.partitionBy(F.lit(0))
    weights = []
    for method, x in raw.items():
        total = F.sum(x).over(every)
        weights.append(s.select("strategy", "ret", "rms", F.lit(method).alias("method"), F.when(total > 0, x / total).otherwise(lit(1) / F.count(F.lit(1)).over(every)).alias("weight")))
    wts = reduce(lambda a, b: a.unionByName(b), weights)
    corr = both.unionByName(stats.select(F.col("strategy").alias("a"), F.col("strategy").alias("b"), lit(1).alias("rho")))
    left = wts.select("method", F.col("strategy").alias("a"), (F.col("weight") * F.col("rms")).alias("wa"), F.col("weight").alias("pa"))
    right = wts.select("method", F.col("strategy").alias("b"), (F.col("weight") * F.col("rms")).alias("wb"), F.col("weight").alias("pb"))
    cross = left.join(corr, "a").join(right, ["method", "b"])
    live = (F.col("a") < F.col("b")) & (F.col("pa") > 0.01) & (F.col("pb") > 0.01)
    risk = cross.groupBy("method").agg(
        F.sqrt(F.sum(F.col("wa") * F.col("wb") * F.col("rho"))).alias("expected_risk"),
        (lit(1) - F.coalesce(F.avg(F.when(live, F.col("rho"))), lit(0))).alias("diversification"),
    )
    ret = wts.groupBy("method").agg(F.sum(F.col("weight") * F.col("ret")).alias("expected_return"))
    book = ret.join(risk, "method").withColumn("sharpe", F.when(F.col("expected_risk") > 0, (F.col("expected_return") - lit(0.02)) / F.col("expected_risk")).otherwise(lit(0)))
    return wts.select("method", "strategy", "weight", (F.col("weight") * F.col("ret")).alias("contribution")), book
