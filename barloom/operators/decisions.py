"""Decision table, position sizes, drift monitor, data quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.events import market_regime
from barloom.functions.numeric import clamp, lit
from barloom.functions.ranks import count_if
from barloom.operators.features import SHORT, TREND
from barloom.operators.windows import Roll

# fixed values: sample gates
POOL_SAMPLES, STOCK_SAMPLES = 30, 10


def rule_evidence(matched: DataFrame, pool: DataFrame, stock: DataFrame) -> DataFrame:
    """Shrunk evidence per (code, day) over the rules that match there.

    `matched`: code, day, rule, entry_matched, exit_matched. `pool`: per rule trades, win_rate,
    out_avg_return, target_return, stop_loss. `stock`: per (rule, code) trades, wins, avg_return.
    """
    j = matched.join(F.broadcast(pool), "rule").join(
        stock.select("rule", "code", F.col("trades").alias("s_n"), F.col("wins").alias("s_w"), F.col("avg_return").alias("s_r")), ["rule", "code"], "left"
    )
    n, wins, ret = (F.coalesce(F.col(c), lit(0)) for c in ("s_n", "s_w", "s_r"))
    j = j.withColumns({"_n": n, "_w": wins, "_r": ret})
    n = F.col("_n")
    pool_n = F.least(F.col("pool_trades"), lit(30))
    prob = F.when(n == 0, (F.col("win_rate") * pool_n + lit(2)) / (pool_n + lit(4))).otherwise((F.col("_w") + lit(2)) / (n + lit(4)))
    shrunk = (F.col("_r") * n + F.col("out_avg_return") * lit(5)) / (n + lit(5))
    ready = (F.col("pool_trades") >= POOL_SAMPLES) & (n >= STOCK_SAMPLES)
    live = F.col("entry_matched") | F.col("exit_matched")
    j = j.withColumns({"_p": prob, "_e": shrunk, "_k": F.when(live, F.sqrt(n + lit(1))).otherwise(lit(0)), "_ready": ready, "_live": live})
    weight = F.sum("_k")
    return j.groupBy("code", "day").agg(
        count_if(F.col("entry_matched")).alias("entry_count"),
        count_if(F.col("exit_matched")).alias("exit_count"),
        count_if(F.col("entry_matched") & F.col("_ready")).alias("positive_count"),
        count_if(F.col("entry_matched") & ~F.col("_ready")).alias("unready_count"),
        count_if(F.col("_live") & (F.col("_e") < 0)).alias("negative_count"),
        (count_if(F.col("_live") & F.col("_ready")) == 0).alias("sample_warning"),
        F.max("_n").alias("stock_samples"),
        F.when(weight > 0, F.sum(F.col("_p") * F.col("_k")) / weight).otherwise(lit(0.5)).alias("probability"),
        F.when(weight > 0, F.sum(F.col("_e") * F.col("_k")) / weight).otherwise(lit(0)).alias("expected_return"),
        F.when(weight > 0, F.sum(F.col("target_return") * F.col("_k")) / weight).otherwise(lit(0.01)).alias("target_return"),
        F.coalesce(F.min(F.when(F.col("_live"), F.col("stop_loss"))), lit(0)).alias("stop_loss"),
        (weight > 0).alias("has_evidence"),
    )


def decision_table(evidence: DataFrame, features: DataFrame, holdings: DataFrame, flow: DataFrame | None = None) -> DataFrame:
    """Score, action, quantity, quality and confidence per (code, day), short-term risk profile."""
    c = F.col
    j = evidence.join(features, ["code", "day"]).join(holdings.select("code", "cost_price", "cost_volume", "previous_action"), "code", "left")
    if flow is not None:
        j = j.join(flow.select("code", "day", "adjustment"), ["code", "day"], "left")
    adjust = F.coalesce(c("adjustment"), F.lit(0)) if flow is not None else F.lit(0)

    def when(cond: Column, n: float) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), lit(n)).otherwise(lit(0))

    score = (
        lit(50)
        - c("unready_count") * 3
        - c("exit_count") * 12
        + F.when(c("has_evidence"), (c("probability") - lit(0.5)) * lit(60) + clamp(c("expected_return") * lit(100), -10, 10)).otherwise(lit(0))
        - when((c("ma20") > 0) & (c("close") < c("ma20")) & (c("macd") < 0), 8)
        + when((c("rsi6") > 0) & (c("rsi6") < 30), 4)
        + when(c("volume_ratio") >= 1.2, 3)
        + adjust
    )
    stop = F.when(c("stop_loss") > 0, clamp(c("stop_loss"), 0.03, 0.05)).otherwise(lit(0.03))
    target = clamp(c("target_return"), 0.01, 0.05)
    held = F.coalesce((c("cost_price") > 0) & (c("cost_volume") > 0), F.lit(False))
    j = j.withColumns({"score": clamp(score, 0, 100), "held": held, "_stop": stop, "_target": target})
    price, cost, s = c("close"), c("cost_price"), c("score")
    stop_hit, defence_hit = price <= cost * (lit(1) - c("_stop")), price <= cost * lit(0.98)
    took = price >= cost * (lit(1) + c("_target"))
    warn = c("sample_warning")
    owner = (
        F.when(stop_hit, "SELL")
        .when(defence_hit, "REDUCE")
        .when((c("exit_count") >= 2) | (s < 42), "REDUCE")
        .when(took & (s < 70), "REDUCE")
        .when(warn & (c("entry_count") > 0) & (c("negative_count") > 0), "REDUCE")
        .when((s >= 82) & (c("entry_count") > 0) & (c("positive_count") > 0) & ~warn, "ADD")
        .otherwise("HOLD")
    )
    other = (
        F.when((s >= 78) & (c("entry_count") > 0) & (c("positive_count") > 0) & ~warn, "BUY")
        .when((s >= 55) & (c("entry_count") > 0), "WATCH")
        .when((c("exit_count") > 0) | (s < 45), "AVOID")
        .otherwise("WATCH")
    )
    j = j.withColumn("_action", F.when(held, owner).otherwise(other))
    prev, a = F.upper(F.trim("previous_action")), c("_action")
    emergency = held & stop_hit
    settled = (
        F.when(F.coalesce(prev, F.lit("")).isin("") | F.coalesce(emergency, F.lit(False)), a)
        .when(prev.isin("SELL", "AVOID") & a.isin("BUY", "ADD") & (s < 82), "WATCH")
        .when((prev == "HOLD") & (a == "ADD") & (s < 82), "HOLD")
        .when(prev.isin("BUY", "ADD") & (a == "AVOID") & (s >= 45), "WATCH")
        .otherwise(a)
    )
    budget = clamp(F.when(warn, lit(0.005)).otherwise(lit(0.01)) / F.when(c("stop_loss") > 0, c("stop_loss")).otherwise(lit(0.05)) * lit(100), 5, 20)
    j = j.withColumn("action", settled)
    qty = F.when(c("action") == "SELL", lit(100)).when(c("action") == "REDUCE", lit(50)).when(c("action").isin("BUY", "ADD"), F.least(lit(20), budget)).otherwise(lit(0))
    quality = (
        F.when((c("positive_count") == 0) | warn, "observe")
        .when(c("stock_samples") >= 30, "reference")
        .when(c("stock_samples") >= STOCK_SAMPLES, "observe")
        .otherwise("weak")
    )
    far = F.abs(c("probability") - lit(0.5))
    confidence = (
        F.when(warn | (c("stock_samples") < STOCK_SAMPLES), "low")
        .when((c("stock_samples") >= 30) & (far >= 0.15), "high")
        .when(far >= 0.07, "medium")
        .otherwise("low")
    )
    return j.withColumns({"quantity_pct": qty, "quality": quality, "confidence": confidence}).drop("_stop", "_target", "_action")


def position_size(df: DataFrame, lot: int = 100, max_share: float = 0.20) -> DataFrame:
    """Quantity in lots for an action and percentage; caps by cash and by single-position share.

    A full sale below one lot sells everything; buying without cash data or a position gives 0 and a warning.
    """
    c = F.col
    pct = clamp(c("quantity_pct"), 0, 100)

    def lots(q: Column) -> Column:
        return F.floor(q / lit(lot)) * lot

    out_raw = lots(F.floor(c("holding_volume") * pct / lit(100)))
    sell = F.when((c("action") == "SELL") & (out_raw == 0) & (c("holding_volume") > 0), c("holding_volume").cast("long")).otherwise(out_raw)
    has_cash = c("available_cash").isNotNull()
    value = F.coalesce(c("holding_value"), lit(0))
    base = F.when(value > 0, value).otherwise(c("price") * lit(lot))
    amount = F.greatest(base * pct / lit(100), c("price") * lit(lot))
    amount = F.when(has_cash & (c("available_cash") > 0), F.least(amount, c("available_cash"))).otherwise(amount)
    room = c("total_asset") * lit(max_share) - value
    amount = F.when(has_cash & (c("total_asset") > 0), F.least(amount, room)).otherwise(amount)
    blocked = ~has_cash & (value <= 0)
    buy = F.when(blocked, F.lit(0)).otherwise(F.greatest(lots(F.floor(amount / c("price"))), F.lit(0)))
    qty = F.when(c("price") <= 0, F.lit(0)).when(c("action").isin("SELL", "REDUCE"), sell).when(c("action").isin("BUY", "ADD"), buy).otherwise(F.lit(0))
    return df.withColumns(
        {
            "quantity": qty.cast("long"),
            "amount": qty * c("price"),
            "needs_cash": c("action").isin("BUY", "ADD") & ~has_cash,
        }
    )


def drift(live: DataFrame, backtest: DataFrame, min_samples: int = 10) -> DataFrame:
    """Rules whose live mean is negative or below the backtest mean by two standard errors go to watch."""
    g = live.groupBy("rule").agg(F.count(F.lit(1)).alias("samples"), F.avg("ret").alias("live_mean"), F.coalesce(F.stddev_samp("ret"), lit(0)).alias("_s"))
    j = g.join(backtest.select("rule", "avg_return"), "rule")
    t = lit(2) * F.col("_s") / F.sqrt(F.col("samples").cast("double"))
    t = F.when(t > 0, t).otherwise(F.abs("avg_return") * lit(0.25))
    bad = (F.col("live_mean") < 0) | (F.col("live_mean") < F.col("avg_return") - t)
    ok = (F.col("samples") >= min_samples) & (F.col("avg_return") != 0)
    return j.withColumns({"threshold": t, "status": F.when(ok & bad, "watch").otherwise("active")}).drop("_s")


def regime_segments(closes: DataFrame, days: int = 120) -> DataFrame:
    """(regime, first_day, last_day): stretches of one regime of a single benchmark's closes (day, close).

    The regime of a day is that of the return since the first close of the last `days` calendar days; days on which
    either close is not positive have none. One row a trading day: a short ordered list.
    """
    w = Window.orderBy("_d")
    span = w.rangeBetween(-days, 0)
    df = closes.withColumn("_d", F.datediff("day", F.lit("1970-01-01").cast("date")))
    first = F.first("close").over(span)
    df = df.withColumn("regime", F.when((first > 0) & (F.col("close") > 0), market_regime((F.col("close") - first) / first))).filter("regime IS NOT NULL")
    fresh = F.when(F.lag("regime").over(w).eqNullSafe(F.col("regime")), 0).otherwise(1)
    df = df.withColumn("_run", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = df.groupBy("_run", "regime").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    # a regime holds until the next one begins
    until = F.lead("first_day").over(Window.orderBy("first_day"))
    return runs.withColumn("last_day", F.coalesce(F.date_sub(until, 1), F.lit("9999-12-31").cast("date"))).select("regime", "first_day", "last_day")


def regime_of(rows: DataFrame, segments: DataFrame, day: str = "day") -> DataFrame:
    """Adds the regime that held on each row's day, null before the first one. Rows meet segments on the year."""
    last = F.least(F.year("last_day"), F.year("first_day") + 200)
    bins = segments.withColumn("_y", F.explode(F.sequence(F.year("first_day"), last)))
    left = rows.withColumn("_y", F.year(day)).alias("l")
    on = (F.col("l._y") == F.col("s._y")) & (F.col(f"l.{day}") >= F.col("s.first_day")) & (F.col(f"l.{day}") <= F.col("s.last_day"))
    return left.join(bins.alias("s"), on, "left").select(*[F.col(f"l.`{c}`") for c in rows.columns], "s.regime")


def regime_watch(hypotheses: DataFrame) -> DataFrame:
    """Active hypotheses (scene, status, regime) whose scene does not fit the regime go to watch.

    Holding a trend needs a rising market, and short bursts do not go with a falling one.
    """
    rising, falling = market_regime(lit(1)), market_regime(lit(-1))
    misfit = ((F.col("scene") == TREND) & (F.col("regime") != rising)) | ((F.col("scene") == SHORT) & (F.col("regime") == falling))
    moved = (F.col("status") == "active") & F.coalesce(misfit, F.lit(False))
    return hypotheses.withColumns({"mismatch": moved, "status": F.when(moved, "watch").otherwise(F.col("status")), "verdict": F.when(moved, "watchlist")})


def hypothesis_stats(signals: DataFrame) -> DataFrame:
    """Validated signals, hits, hit rate and mean return per rule."""
    v = signals.filter("status = 'validated'")
    return v.groupBy("rule").agg(
        F.count(F.lit(1)).alias("signals"), count_if(F.col("hit")).alias("hits"), (count_if(F.col("hit")) / F.count(F.lit(1))).alias("hit_rate"), F.avg("ret").alias("avg_return")
    )


def unique_samples(trades: DataFrame) -> DataFrame:
    """Distinct (code, buy, sell) samples per code, and of the whole pool."""
    one = trades.select("code", "buy_day", "sell_day").distinct()
    pool = one.agg(F.count(F.lit(1)).alias("pool_samples"))  # one row
    return one.groupBy("code").agg(F.count(F.lit(1)).alias("stock_samples")).crossJoin(F.broadcast(pool))


def quality_rows(bars: DataFrame) -> DataFrame:
    """Row-level checks against the previous row; the first row of a code is not checked, as it has none."""
    r = Roll()
    c = F.col
    prev = r.lag("close")
    jump = (prev > 0) & (c("close") > 0) & (F.abs(c("close") / prev - lit(1)) > 0.5)
    broken = (c("high") < c("low")) | (c("high") < c("open")) | (c("high") < c("close")) | (c("low") > c("open")) | (c("low") > c("close"))
    seen = prev.isNotNull()
    last = F.last("close").over(Window.partitionBy("code").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return bars.withColumns(
        {
            "jump": F.coalesce(jump, F.lit(False)),
            "negative": seen & (c("close") < 0),
            "zero": seen & (c("close") == 0) & (c("volume") == 0),
            "broken": seen & broken,
            "suspended": (c("close") <= 0) | (c("volume") <= 0) | ((c("open") <= 0) & (c("high") <= 0) & (c("low") <= 0)),
            "inflated": (c("close") > 0) & (last > 0) & (c("close") > last * lit(10)),
        }
    )


def quality_report(bars: DataFrame) -> DataFrame:
    """One row: coverage over 5/7 of the calendar, anomaly counts, suspension, 10x check and a 0-100 score."""
    rows = quality_rows(bars)
    flags = ("jump", "negative", "zero", "broken", "suspended", "inflated")
    per = rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("a"), F.max("day").alias("b"), *[count_if(F.col(f)).alias(f) for f in flags])
    span = per.agg(F.sum("n").alias("records"), F.min("a").alias("_lo"), F.max("b").alias("_hi"))
    days = F.datediff("_hi", "_lo")
    span = span.withColumn("expected_days", F.greatest(F.floor(days * 5 / 7), F.lit(1)))
    j = per.crossJoin(F.broadcast(span))
    share = F.least(F.col("n") / F.col("expected_days"), lit(1))
    g = j.groupBy("records", "expected_days").agg(
        F.count(F.lit(1)).alias("stocks"), count_if(share < 0.8).alias("low_coverage"), *[F.sum(f).alias(f"{f}_count") for f in flags]
    )
    anomalies = F.col("jump_count") + F.col("negative_count") + F.col("broken_count")
    g = g.withColumns({"anomalies": anomalies, "consistent": (F.col("inflated_count") == 0) & (F.col("negative_count") == 0)})
    start = lit(100) - F.col("low_coverage") / F.col("stocks") * lit(30) - F.col("anomalies") * 2
    score = F.greatest(start, lit(0)) - F.when(F.col("suspended_count") / F.col("records") > 0.10, 10).otherwise(0) - F.when(F.col("consistent"), 0).otherwise(20)
    return g.withColumn("score", clamp(score, 0, 100))


def action_changes(decisions: DataFrame, keys: Sequence[str] = ("code",)) -> DataFrame:
    """Newest action per key together with the one before it."""
    w = Window.partitionBy(*keys).orderBy("day")
    d = decisions.withColumn("previous_action", F.lag("action").over(w))
    newest = d.groupBy(*keys).agg(F.max(F.struct("day", "action", "previous_action")).alias("x"))
    return newest.select(*keys, "x.*")
