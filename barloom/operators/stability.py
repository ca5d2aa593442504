"""Evidence for the verdict on a rule: a lattice of perturbed rules and costs, folds, coverage, diagnostics.

Every condition's threshold and both exits carry one value per variant, so one scan of the bars per instrument advances
all variants; cost scenarios are attached to the finished trades. Results are keyed by scenario, and by fold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import lit
from barloom.functions.ranks import count_if
from barloom.operators import backtest as bt
from barloom.operators.features import all_of, any_of, condition, validate_rule

# fixed values: scenario names with the factor on thresholds and exits, and with the factor on slippage
THRESHOLDS = {"base": 1.0, "threshold_0_95x": 0.95, "threshold_1_05x": 1.05}
SLIPPAGES = {"base": 1.0, "slippage_1_5x": 1.5, "slippage_2x": 2.0}
# fixed values: limits of perturbed exits and of both gates
STOP_RANGE, GAIN_RANGE = (0.02, 0.12), (0.03, 0.25)
COST_DRAWDOWN, FLOOR_SHARE, DRAWDOWN_FLOOR, DRAWDOWN_SHARE = 0.20, 0.5, 0.25, 1.5
# fixed values: warnings of the diagnostics
MAX_CONDITIONS, MAX_DECAY, MIN_CONSISTENCY = 6, 0.5, 0.5


def exits_of(rule: Mapping, scale: float) -> tuple[float, float]:
    """Stop and gain of a variant: scaled, held in the range of a rule, then in that of a trade."""
    stop, gain = ((rule["stop_loss"], rule["stop_gain"]) if scale == 1.0 else (min(max(rule["stop_loss"] * scale, STOP_RANGE[0]), STOP_RANGE[1]), min(max(rule["stop_gain"] * scale, GAIN_RANGE[0]), GAIN_RANGE[1])))
    return min(max(stop, 0.03), 0.15), min(max(gain, 0.02), 0.30)


def lattice_trades(df: DataFrame, rule: Mapping, scales: Mapping[str, float] = THRESHOLDS) -> DataFrame:
    """`barrier_trades` of every variant of a rule, with a column `variant`. Needs tradable.

    A threshold that is another indicator's value is not scaled. A bar carries each variant's two conditions; only signals
    of a variant that matched become rows, the bars are never multiplied.
    """
    if problems := validate_rule(rule):
        raise ValueError("; ".join(problems))
    entries = [all_of([condition(c, s) for c in rule["entry"]]) if rule["entry"] else F.lit(False) for s in scales.values()]
    exits = [any_of([condition(c, s) for c in rule.get("exit", ())]) if rule.get("exit") else F.lit(False) for s in scales.values()]
    limits = [(1 - stop, 1 + gain) for stop, gain in (exits_of(rule, s) for s in scales.values())]
    names = F.array(*[F.lit(n) for n in scales])
    trades = bt.walked(df, entries, exits, limits, rule["max_hold"])
    return trades.select(F.get(names, F.col("at")).alias("variant"), *[c for c in trades.columns if c != "at"])


def scenario_trades(df: DataFrame, rule: Mapping, cash: float, slippage: float = bt.COSTS["slippage"]) -> DataFrame:
    """Costed trades of every scenario: perturbed rules at the plain slippage, the rule itself at higher ones."""
    plain = F.array(*[F.struct(F.lit(n).alias("scenario"), lit(slippage * m).alias("slip")) for n, m in SLIPPAGES.items()])
    other = F.array(F.struct(F.col("variant").alias("scenario"), lit(slippage).alias("slip")))
    trades = lattice_trades(df, rule)
    each = trades.withColumn("_s", F.explode(F.when(F.col("variant") == "base", plain).otherwise(other)))
    return bt.trade_costs(each.select(*trades.columns, "_s.scenario", "_s.slip"), cash, slippage="slip")


def equity(trades: DataFrame, keys: Sequence[str], value: str = "net_return") -> DataFrame:
    """(keys, day, nav, drawdown) on days on which trades close: 1 plus the returns so far, each staking an equal share.

    The share is one over the instruments that the key traded. The peak is at least the start.
    """
    daily = trades.groupBy(*keys, F.col("sell_day").alias("day")).agg(F.sum(value).alias("_x"))
    if "code" in keys:
        daily = daily.withColumn("_stake", lit(1))
    else:
        per = trades.select(*keys, "code").distinct().groupBy(*keys).agg((lit(1) / F.count(F.lit(1))).alias("_stake"))
        daily = daily.join(per, list(keys))
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    df = daily.withColumn("nav", lit(1) + F.sum("_x").over(w) * F.col("_stake"))
    df = df.withColumn("_peak", F.greatest(F.max("nav").over(w), lit(1)))
    lost = (F.col("_peak") - F.col("nav")) / F.col("_peak")
    return df.select(*keys, "day", "nav", F.least(F.greatest(lost, lit(0)), lit(1)).alias("drawdown"))


def stress_report(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, scenario, trades, avg_return, median_return, total_return, max_drawdown, lookahead) of costed trades."""
    by = [*keys, "scenario"]
    late = ~((F.col("signal_day") < F.col("buy_day")) & (F.col("buy_day") < F.col("sell_day")))
    stats = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), F.avg("net_return").alias("avg_return"), F.median("net_return").alias("median_return"), count_if(late).alias("lookahead")
    )
    curve = equity(trades, by).groupBy(*by).agg((F.max_by("nav", "day") - lit(1)).alias("total_return"), F.max("drawdown").alias("max_drawdown"))
    return stats.join(curve, by)


def stability(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per key: the base run, cost_2x_passed, variants passed, parameter_stability.

    A variant passes with trades, a positive mean of at least half the base's, and a drawdown below the larger of a
    quarter and one and a half times the base's. A scenario without any trade is not passed.
    """
    names = ("trades", "avg_return", "median_return", "total_return", "max_drawdown", "lookahead")

    def of(scenario: str) -> Column:
        return F.max(F.when(F.col("scenario") == scenario, F.struct(*names)))

    perturbed = [n for n in THRESHOLDS if n != "base"]
    df = report.groupBy(*keys).agg(of("base").alias("_b"), of("slippage_2x").alias("_c"), *[of(n).alias(f"_p{k}") for k, n in enumerate(perturbed)])
    df = df.filter("_b IS NOT NULL")
    base = F.col("_b")

    def passed(name: str) -> Column:
        p = F.col(name)
        limit = F.greatest(lit(DRAWDOWN_FLOOR), base["max_drawdown"] * lit(DRAWDOWN_SHARE))
        return F.coalesce((p["avg_return"] > 0) & (p["avg_return"] >= base["avg_return"] * lit(FLOOR_SHARE)) & (p["max_drawdown"] <= limit), F.lit(False))

    n_passed = sum((passed(f"_p{k}").cast("int") for k in range(len(perturbed))), F.lit(0))
    cost = F.coalesce((F.col("_c.avg_return") > 0) & (F.col("_c.max_drawdown") <= COST_DRAWDOWN), F.lit(False))
    return df.select(*keys, *[base[n].alias(n) for n in names], cost.alias("cost_2x_passed"), n_passed.alias("variants_passed")).withColumn(
        "parameter_stability", F.when(F.col("variants_passed") == len(perturbed), "stable").otherwise("fragile")
    )


def fold_evidence(trades: DataFrame, plan: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, scenario, fold, trades, avg_return), only folds with trades; the plan has at most three rows."""
    inside = trades.join(F.broadcast(plan), F.col("buy_day").between(F.col("start_day"), F.col("end_day")))
    return inside.groupBy(*keys, "scenario", "fold").agg(F.count(F.lit(1)).alias("trades"), F.avg("net_return").alias("avg_return"))


def out_of_sample(folds: DataFrame, plan: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, out_trades, out_avg_return, fold_consistency) of the base run; folds without trades count as not positive."""
    n = plan.agg(F.count(F.lit(1)).alias("_folds"))
    base = folds.filter("scenario = 'base'").groupBy(*keys).agg(
        F.sum("trades").alias("out_trades"), (F.sum(F.col("avg_return") * F.col("trades")) / F.sum("trades")).alias("out_avg_return"), count_if(F.col("avg_return") > 0).alias("_good")
    )
    return base.crossJoin(F.broadcast(n)).select(*keys, "out_trades", "out_avg_return", (F.col("_good") / F.col("_folds")).alias("fold_consistency"))


def coverage(features: DataFrame, keys: Sequence[str] = ("code",)) -> DataFrame:
    """(keys, coverage): complete rows over all trading days, for keys of one instrument each."""
    c = F.col
    ok = (c("open") > 0) & (c("high") > 0) & (c("low") > 0) & (c("close") > 0) & (c("volume") > 0)
    days = features.select("day").distinct().agg(F.count(F.lit(1)).alias("_days"))
    rows = features.groupBy(*keys).agg(count_if(ok).alias("_rows"))
    return rows.crossJoin(F.broadcast(days)).select(*keys, F.least(c("_rows") / c("_days"), lit(1)).alias("coverage"))


def evidence(trades: DataFrame, features: DataFrame, plan: DataFrame, rule: Mapping, min_coverage: float = 0.95) -> DataFrame:
    """What the verdict judges, one row per instrument, all of it measured: runs, costs, perturbations, folds, benchmark."""
    runs = stability(stress_report(trades, ("code",)), ("code",))
    late = out_of_sample(fold_evidence(trades, plan, ("code",)), plan, ("code",))
    held = bt.benchmark_return(features).select("code", "benchmark_return")
    df = runs.join(coverage(features), "code").join(held, "code").join(late, "code", "left").fillna(0, ["out_trades", "out_avg_return", "fold_consistency"])
    decay = F.when(F.col("avg_return") != 0, (F.col("avg_return") - F.col("out_avg_return")) / F.abs("avg_return")).otherwise(lit(0))
    n = len(rule["entry"]) + len(rule.get("exit", ()))
    df = df.withColumns(
        {
            "no_lookahead": F.col("lookahead") == 0,
            "min_coverage": lit(min_coverage),
            "benchmark_available": F.col("benchmark_return").isNotNull(),
            "excess_return": F.col("total_return") - F.col("benchmark_return"),
            "out_sample_decay": decay,
            "rule_complexity": F.lit(n),
        }
    )
    warn = [
        (F.lit(n > MAX_CONDITIONS), "complex"),
        (F.col("out_sample_decay") > MAX_DECAY, "decay"),
        ((F.col("fold_consistency") > 0) & (F.col("fold_consistency") < MIN_CONSISTENCY), "folds"),
        (F.col("parameter_stability") == "fragile", "fragile"),
    ]
    return df.withColumn("warnings", F.array_compact(F.array(*[F.when(c, F.lit(w)) for c, w in warn])))
