"""Factor research: forward returns, information coefficients, preprocessing, redundancy, layers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import lit, two_sided_p
from barloom.functions.ranks import count_if
from barloom.operators.aggregates import pearson
from barloom.operators.facts import NEWEST, Facts, known_facts
from barloom.operators.features import column_of
from barloom.operators.joins import unified_view
from barloom.operators.windows import Roll, average_rank, cumulative_counts, quantiles
from barloom.sources.sinks import materialized

LAYERS = ("bottom", "low", "middle", "high", "top")


def forward_returns(features: DataFrame, sectors: DataFrame | None, factors: Sequence[str], horizon: int = 5) -> DataFrame:
    """(code, day, sector, y, one column a factor); y is the return `horizon` rows ahead, and both closes are positive.

    Features may hold the later close already, as `future`, and their stock's `industry`.
    """
    ahead = F.col("future") if "future" in features.columns else Roll().lead("close", horizon)
    f = features.withColumn("_future", ahead).filter((F.col("close") > 0) & (F.col("_future") > 0))
    f = f.withColumn("y", F.col("_future") / F.col("close") - lit(1))
    if "industry" in f.columns:
        f = f.withColumn("sector", F.col("industry"))
    elif sectors is not None:
        f = f.join(sectors.select("code", F.col("industry").alias("sector")), "code", "left")
    else:
        f = f.withColumn("sector", F.lit("unknown"))
    f = f.withColumn("sector", F.coalesce("sector", F.lit("unknown")))
    return f.select("code", "day", "sector", "y", *[F.col(c).cast("double").alias(c) for c in factors])


def without_zeros(wide: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Flow and volume factors drop zeros."""
    return wide.withColumns({c: F.when(F.col(c) != 0, F.col(c)) if "flow" in c or "volume" in c else F.col(c) for c in factors})


def wide_observations(features: DataFrame, sectors: DataFrame | None, factors: Sequence[str], horizon: int = 5) -> DataFrame:
    """`forward_returns` as observations: a factor that drops zeros has no value there."""
    return without_zeros(forward_returns(features, sectors, factors, horizon), factors)


def long_form(wide: DataFrame, factors: Sequence[str]) -> DataFrame:
    """(factor, code, day, sector, x, y) of wide observations; a missing value is no observation."""
    keys = [c for c in ("code", "day", "sector", "y") if c in wide.columns]
    return wide.unpivot(keys, list(factors), "factor", "x").filter("x IS NOT NULL")


def observations(features: DataFrame, sectors: DataFrame | None, factors: Sequence[str], horizon: int = 5) -> DataFrame:
    """Long form (factor, code, day, sector, x, y); y is the return `horizon` rows ahead.

    Both closes must be positive; flow and volume factors drop zeros.
    """
    return long_form(wide_observations(features, sectors, factors, horizon), factors)


def wide_external(features: DataFrame, facts: Mapping[str, DataFrame | Facts], ids: Sequence[str], sectors: DataFrame | None, horizon: int = 5, decision: Column | None = None) -> DataFrame:
    """Wide observations of `namespace.column` factors.

    Facts with an `available_at` column count only as far as they are known at the decision time (the day's end unless
    given, a column over the day); facts without a code hold for the whole market of their day, or for an industry. All
    facts of a code meet the features in one exchange. What the features hold already is not looked up.
    """
    at = decision if decision is not None else F.col("day").cast("timestamp") + F.make_interval(hours=F.lit(24))
    base = features.withColumn("decision_as_of", at)
    open_ = [i for i in ids if not i.startswith("stock_feature.") and column_of(i) not in features.columns]
    held = {}
    for space in dict.fromkeys(i.partition(".")[0] for i in open_):
        f = facts[space]
        names = [i.partition(".")[2] for i in open_ if i.startswith(f"{space}.")]
        held[space] = f if isinstance(f, Facts) else Facts(f, dict.fromkeys(names, NEWEST))
    of_code = [i for i in open_ if "code" in held[i.partition(".")[0]].rows.columns]
    base = unified_view(base, {s: f.rows for s, f in held.items()}, [i for i in open_ if i not in of_code])
    known = known_facts(base, held, of_code, latest=at) if of_code else base
    return wide_observations(known, sectors, [column_of(i) for i in ids], horizon)


def external_observations(features: DataFrame, facts: Mapping[str, DataFrame | Facts], ids: Sequence[str], sectors: DataFrame | None, horizon: int = 5, decision: Column | None = None) -> DataFrame:
    """`wide_external` in long form."""
    return long_form(wide_external(features, facts, ids, sectors, horizon, decision), [column_of(i) for i in ids])


def daily_ic(obs: DataFrame, min_rows: int = 3) -> DataFrame:
    """IC and rank IC of every (factor, day) cross-section; a cross-section has one row per instrument."""
    keys = ["factor", "day"]
    ranked = obs.select(*keys, "x", "y", average_rank("x", keys).alias("_rx"), average_rank("y", keys).alias("_ry"))
    g = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        pearson(F.col("x"), F.col("y"), min_rows).alias("ic"),
        pearson(F.col("_rx"), F.col("_ry"), min_rows).alias("rank_ic"),
    )
    return g.filter(F.col("n") >= min_rows)


def _places(x: np.ndarray) -> np.ndarray:
    """1-based ranks with ties averaged; NaN is the largest value and equal to itself."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))]))
    size = np.diff(np.append(first, len(s)))
    out = np.empty(len(x))
    out[order] = np.repeat(first + 1 + (size - 1) / 2, size)
    return out


def _correlation(a: np.ndarray, b: np.ndarray) -> float:
    """0 without variance."""
    if a.min() == a.max() or b.min() == b.max():
        return 0.0
    a, b = a - a.mean(), b - b.mean()
    spread = np.sqrt((a * a).mean()) * np.sqrt((b * b).mean())
    return float((a * b).mean() / spread) if spread != 0 else 0.0


def wide_daily_ic(wide: DataFrame, factors: Sequence[str], min_rows: int = 3) -> DataFrame:
    """`daily_ic` of wide observations: a day's cross-section, one row per instrument, goes to one task once for all
    factors, where the long form is exchanged and sorted factor by factor."""
    names = list(factors)
    schema = f"factor string, day {dict(wide.dtypes)['day']}, n bigint, ic double, rank_ic double"

    def run(table: pa.Table) -> pa.Table:
        y = table.column("y").to_numpy()
        rows = []
        with np.errstate(all="ignore"):
            for c in names:
                there = table.column(c).is_valid().to_numpy()
                if there.sum() >= min_rows:
                    x, z = table.column(c).to_numpy()[there], y[there]
                    rows.append((c, len(x), _correlation(x, z), _correlation(_places(x), _places(z))))
        day = table.column("day").combine_chunks().take(pa.array([0] * len(rows), pa.int64()))
        made = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.float64(), pa.float64()))]
        return pa.table({"factor": made[0], "day": day, "n": made[1], "ic": made[2], "rank_ic": made[3]})

    return wide.select("day", "y", *names).groupBy("day").applyInArrow(run, schema)


def recent_cuts(wide: DataFrame, factors: Sequence[str], share: float = 0.30) -> DataFrame:
    """(factor, day, code) of the first row of each factor's recent share in (day, code) order.

    Counts by day name the day, and only that day's rows are ordered.
    """
    names = list(factors)
    days = wide.groupBy("day").agg(*[F.count(c).alias(c) for c in names]).unpivot(["day"], names, "factor", "_n").filter("_n > 0")
    w, whole = Window.partitionBy("factor").orderBy("day"), Window.partitionBy("factor")
    days = days.withColumns({"_before": F.sum("_n").over(w) - F.col("_n"), "_total": F.sum("_n").over(whole)})
    place = F.floor(F.col("_total") * lit(1 - share)) - F.col("_before")
    cuts = days.withColumn("_place", place).filter("_place >= 0 AND _place < _n").select("factor", "day", "_place")
    inside = Window.partitionBy("factor", "day").orderBy("code")
    # one row per factor
    first = long_form(wide.select("code", "day", *names), names).join(F.broadcast(cuts), ["factor", "day"])
    return first.withColumn("_i", F.row_number().over(inside) - 1).filter("_i = _place").select("factor", "day", "code")


def from_cuts(wide: DataFrame, factors: Sequence[str], cuts: DataFrame) -> DataFrame:
    """Wide observations of the days that hold a cut, without the values before it."""
    names = list(factors)
    # one row of all cuts
    cut = cuts.agg(*[F.max(F.when(F.col("factor") == c, F.struct("day", "code"))).alias(f"_{c}") for c in names])
    of = wide.join(F.broadcast(cuts.select("day").distinct()), "day").join(F.broadcast(cut), F.lit(True))
    held = {c: F.when((F.col("day") == F.col(f"_{c}.day")) & (F.col("code") >= F.col(f"_{c}.code")), F.col(c)) for c in names}
    return of.withColumns(held).drop(*[f"_{c}" for c in names])


def wide_recent_daily_ic(wide: DataFrame, factors: Sequence[str], daily: DataFrame, share: float = 0.30) -> DataFrame:
    """`wide_daily_ic` of `wide_recent` from the daily ICs of all rows: only days that hold a factor's cut are made again."""
    cuts = materialized(recent_cuts(wide, factors, share))
    after = daily.join(F.broadcast(cuts.select("factor", F.col("day").alias("_cut"))), "factor").filter("day > _cut").drop("_cut")
    return after.unionByName(wide_daily_ic(from_cuts(wide, factors, cuts), factors))


def wide_recent(wide: DataFrame, factors: Sequence[str], share: float = 0.30) -> DataFrame:
    """`recent_share` of wide observations: values before each factor's cut are taken away."""
    names = list(factors)
    cut = recent_cuts(wide, names, share).agg(*[F.max(F.when(F.col("factor") == c, F.struct("day", "code"))).alias(f"_{c}") for c in names])
    at = F.struct("day", "code")
    later = wide.join(F.broadcast(cut), F.lit(True)).filter(F.col("day") >= F.least(*[F.col(f"_{c}.day") for c in names], F.col(f"_{names[0]}.day")))
    return later.withColumns({c: F.when(at >= F.col(f"_{c}"), F.col(c)) for c in names}).drop(*[f"_{c}" for c in names])


def recent_share(obs: DataFrame, share: float = 0.30) -> DataFrame:
    """The last share of each factor's rows in (day, code) order.

    Row numbers come from per-day counts (a small ordered list) plus the rank inside the day.
    """
    days = obs.groupBy("factor", "day").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("factor").orderBy("day")
    whole = Window.partitionBy("factor")
    days = days.select("factor", "day", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_total"))
    start = F.floor(F.col("_total") * lit(1 - share))
    inside = Window.partitionBy("factor", "day").orderBy("code")
    df = obs.join(days, ["factor", "day"]).withColumn("_i", F.col("_before") + F.row_number().over(inside) - 1)
    return df.filter(F.col("_i") >= start).drop("_before", "_total", "_i")


def _mean_ic(daily: DataFrame, suffix: str = "") -> DataFrame:
    return daily.groupBy("factor").agg(
        F.avg("ic").alias(f"ic{suffix}"),
        F.avg("rank_ic").alias(f"rank_ic{suffix}"),
        F.coalesce(F.stddev_samp("ic"), lit(0)).alias(f"ic_std{suffix}"),
        F.count(F.lit(1)).alias(f"ic_days{suffix}"),
    )


def wide_ic_summary(wide: DataFrame, factors: Sequence[str]) -> DataFrame:
    """`ic_summary` of wide observations, which are read several times."""
    daily = materialized(wide_daily_ic(wide, factors))
    return ic_summary(long_form(wide, factors), daily, wide_recent_daily_ic(wide, factors, daily))


def ic_summary(obs: DataFrame, daily: DataFrame | None = None, recent_daily: DataFrame | None = None) -> DataFrame:
    """Per factor: IC, rank IC, deviation over days, t, p, hit rate, recent IC, decay flag, sector IC.

    `daily` and `recent_daily` are the daily ICs of all and of the recent rows, made here unless given.
    """
    daily = daily_ic(obs) if daily is None else daily
    recent_daily = daily_ic(recent_share(obs)) if recent_daily is None else recent_daily
    base = obs.groupBy("factor").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("_mx"), F.avg("y").alias("avg_return"))
    # one row per factor, so the small side of these joins is bounded by the factor list
    centred = obs.join(F.broadcast(base), "factor")
    hits = centred.groupBy("factor").agg(
        (count_if((F.col("x") - F.col("_mx")) * (F.col("y") - F.col("avg_return")) > 0) / F.count(F.lit(1))).alias("hit_rate")
    )
    sector = obs.groupBy("factor", "sector").agg(F.count(F.lit(1)).alias("_n"), pearson(F.col("x"), F.col("y")).alias("_ic"))
    sector = sector.filter("_n >= 10").groupBy("factor").agg(
        F.avg("_ic").alias("sector_ic"), F.coalesce(F.stddev_samp("_ic"), lit(0)).alias("sector_ic_std")
    )
    full = _mean_ic(daily)
    recent = _mean_ic(recent_daily, "_recent").select("factor", F.col("ic_recent").alias("recent_ic"))
    j = base.drop("_mx").join(full, "factor", "left").join(hits, "factor", "left").join(recent, "factor", "left").join(sector, "factor", "left")
    t = F.abs("ic") / (F.col("ic_std") / F.sqrt(F.col("ic_days").cast("double")))
    flat = (F.col("ic_days") < 2) | ((F.col("ic_std") == 0) & (F.col("ic") == 0))
    return j.withColumns(
        {
            "t_stat": F.when((F.col("ic_std") > 1e-10) & (F.col("ic_days") > 1), t).otherwise(lit(0)),
            "p_value": F.when(flat, lit(1)).when(F.col("ic_std") == 0, lit(0)).otherwise(two_sided_p(t)),
            "stability": F.when(F.col("ic_std") > 1e-10, F.abs("ic") / F.col("ic_std")).otherwise(lit(0)),
            "decay": F.when(F.abs("recent_ic") < F.abs("ic") * lit(0.75), "decaying").otherwise("stable"),
        }
    )


def preprocess(obs: DataFrame, low: float = 0.01, high: float = 0.99, min_rows: int = 3) -> DataFrame:
    """Per (factor, day) cross-section: winsorised, z-scored and industry-demeaned values.

    Bounds are lower-nearest order statistics and apply from 10 rows on; the demeaned value
    starts from the winsorised one.
    """
    keys = ["factor", "day"]
    w, o = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("x", "code")
    df = obs.withColumns({"_n": F.count(F.lit(1)).over(w), "_i": F.row_number().over(o) - 1}).filter(F.col("_n") >= min_rows)

    def bound(p: float) -> Column:
        return F.max(F.when(F.col("_i") == F.floor((F.col("_n") - 1) * lit(p)), F.col("x"))).over(w)

    df = df.withColumns({"_lo": bound(low), "_hi": bound(high)})
    clipped = F.when(F.col("_n") < 10, F.col("x")).otherwise(F.greatest(F.least(F.col("x"), F.col("_hi")), F.col("_lo")))
    df = df.withColumn("winsorized", clipped)
    sd = F.coalesce(F.stddev_samp("winsorized").over(w), lit(0))
    df = df.withColumns({"_m": F.avg("winsorized").over(w), "_sd": sd})
    ws = Window.partitionBy(*keys, "sector")
    df = df.withColumns(
        {
            "zscore": F.when(F.col("_sd") < 1e-10, lit(0)).otherwise((F.col("winsorized") - F.col("_m")) / F.col("_sd")),
            "neutralized": F.col("winsorized") - F.avg("winsorized").over(ws),
        }
    )
    return df.drop("_i", "_lo", "_hi", "_n")


def preprocess_stats(prepared: DataFrame) -> DataFrame:
    """Per factor: observations, and the mean over days of the daily mean, deviation, skewness and excess kurtosis."""
    z = F.col("zscore")
    live = F.first("_sd") > 1e-10
    day = prepared.groupBy("factor", "day").agg(
        F.count(F.lit(1)).alias("n"),
        F.first("_m").alias("mean"),
        F.first("_sd").alias("std"),
        F.when(live, F.avg(z * z * z)).otherwise(lit(0)).alias("skewness"),
        F.when(live, F.avg(z * z * z * z) - lit(3)).otherwise(lit(0)).alias("kurtosis"),
    )
    return _mean_stats(day)


def _mean_stats(day: DataFrame) -> DataFrame:
    return day.groupBy("factor").agg(
        F.sum("n").alias("observations"),
        F.count(F.lit(1)).alias("days"),
        *[F.avg(c).alias(c) for c in ("mean", "std", "skewness", "kurtosis")],
    )


def wide_preprocess_stats(wide: DataFrame, factors: Sequence[str], low: float = 0.01, high: float = 0.99, min_rows: int = 3) -> DataFrame:
    """`preprocess_stats` of `preprocess` of wide observations: a day's cross-section goes to one task once for all
    factors, and no row leaves it."""
    names = list(factors)
    measures = ("mean", "std", "skewness", "kurtosis")

    def run(table: pa.Table) -> pa.Table:
        rows = []
        with np.errstate(all="ignore"):
            for c in names:
                x = table.column(c).drop_null().to_numpy()
                n = len(x)
                if n < min_rows:
                    continue
                if n >= 10:
                    places = [int(np.floor((n - 1) * p)) for p in (low, high)]
                    bounds = np.partition(x, places)[places]  # NaN is the largest value, as in greatest and least
                    x = np.maximum(np.fmin(x, bounds[1]), bounds[0])
                # from the first value, so a constant has no spread at all
                mean = x[0] + (x - x[0]).mean()
                off = x - mean
                sd = float(np.sqrt((off * off).sum() / (n - 1))) if n > 1 else 0.0
                z = off / sd if sd >= 1e-10 or sd != sd else np.zeros(n)
                live = sd > 1e-10 or sd != sd
                rows.append((c, n, float(mean), sd, float((z**3).mean()) if live else 0.0, float((z**4).mean() - 3) if live else 0.0))
        kinds = [pa.string(), pa.int64(), *[pa.float64()] * 4]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["factor", "n", *measures])

    schema = "factor string, n bigint, " + ", ".join(f"{m} double" for m in measures)
    return _mean_stats(wide.select("day", *names).groupBy("day").applyInArrow(run, schema))


def wide_preprocess(wide: DataFrame, factors: Sequence[str], low: float = 0.01, high: float = 0.99, min_rows: int = 3) -> DataFrame:
    """(factor, code, day, winsorized, zscore, neutralized) as `preprocess` has them, of wide observations: a day's
    cross-section is exchanged once for all factors, and rows become long only where nothing is exchanged any more."""
    names, types = list(factors), dict(wide.dtypes)
    schema = f"factor string, code {types['code']}, day {types['day']}, winsorized double, zscore double, neutralized double"

    def run(table: pa.Table) -> pa.Table:
        parts = []
        sector = table.column("sector").combine_chunks().dictionary_encode().indices.to_numpy()
        with np.errstate(all="ignore"):
            for c in names:
                there = np.flatnonzero(table.column(c).is_valid().to_numpy())
                n = len(there)
                if n < min_rows:
                    continue
                x = table.column(c).drop_null().to_numpy()
                if n >= 10:
                    places = [int(np.floor((n - 1) * p)) for p in (low, high)]
                    bounds = np.partition(x, places)[places]  # NaN is the largest value, as in greatest and least
                    x = np.maximum(np.fmin(x, bounds[1]), bounds[0])
                # from the first value, so a constant has no spread at all
                mean = x[0] + (x - x[0]).mean()
                off = x - mean
                sd = float(np.sqrt((off * off).sum() / (n - 1))) if n > 1 else 0.0
                z = off / sd if sd >= 1e-10 or sd != sd else np.zeros(n)
                own = sector[there]
                total, count = np.bincount(own, weights=x), np.bincount(own)
                rows = table.select(["code", "day"]).take(pa.array(there))
                values = [pa.array(v, pa.float64()) for v in (x, z, x - (total / count)[own])]
                parts.append(pa.table([pa.array([c] * n, pa.string()), rows.column("code"), rows.column("day"), *values], names=["factor", "code", "day", "winsorized", "zscore", "neutralized"]))
        empty = pa.table({"factor": pa.array([], pa.string()), "code": table.column("code").slice(0, 0), "day": table.column("day").slice(0, 0), **{k: pa.array([], pa.float64()) for k in ("winsorized", "zscore", "neutralized")}})
        return pa.concat_tables(parts) if parts else empty

    return wide.select("code", "day", "sector", *names).groupBy("day").applyInArrow(run, schema)


def redundant_pairs(pairs: DataFrame, summary: DataFrame, limit: float = 0.70) -> DataFrame:
    """Strongly correlated factor pairs with the one to keep (larger absolute IC)."""
    ic = summary.select("factor", F.abs("ic").alias("_ic"))
    j = (
        pairs.filter(F.abs("rho") > limit)
        .join(ic.withColumnsRenamed({"factor": "a", "_ic": "_ia"}), "a")
        .join(ic.withColumnsRenamed({"factor": "b", "_ic": "_ib"}), "b")
    )
    keep_b = F.col("_ib") > F.col("_ia")
    return j.select(
        "a", "b", "rho", F.when(keep_b, F.col("b")).otherwise(F.col("a")).alias("keep"), F.when(keep_b, F.col("a")).otherwise(F.col("b")).alias("remove")
    )


def select_factors(summary: DataFrame, redundant: DataFrame, min_ic: float = 0.02, max_p: float = 0.10, min_rows: int = 30) -> DataFrame:
    """Adds `selected`: strong, significant, and not the weaker of a redundant pair of passing factors."""
    passing = (F.abs("ic") > min_ic) & (F.col("p_value") < max_p) & (F.col("n") >= min_rows)
    s = summary.withColumn("_pass", passing)
    ok = s.filter("_pass").select("factor")
    both = redundant.join(ok.withColumnRenamed("factor", "a"), "a", "left_semi").join(ok.withColumnRenamed("factor", "b"), "b", "left_semi")
    drop = both.select(F.col("remove").alias("factor")).distinct().withColumn("_drop", F.lit(True))
    j = s.join(drop, "factor", "left")
    return j.withColumn("selected", F.col("_pass") & F.col("_drop").isNull()).drop("_pass", "_drop")


def confidence(n: Column, p: Column, ic: Column, recent: Column) -> Column:
    """How far a factor's evidence goes: low below 30 rows or with p above 0.20, high where it is significant and lasts."""
    lasting = F.abs(recent) >= F.abs(ic) * lit(0.75)
    return F.when((n < 30) | (p > 0.20), "low").when((p <= 0.05) & lasting, "high").otherwise("medium")


def pooled_rank(df: DataFrame, value: str, keys: Sequence[str], day: str = "day", last: str = "code") -> DataFrame:
    """0-based rank over all rows of a key in (value, day, last) order, in three counted levels.

    Rows below the value come from value counts, rows of the same value on earlier days from
    (value, day) counts, and only the rest is ranked by a window, so ties cannot pile up.
    """
    below = cumulative_counts(df, value, keys).select(*keys, value, "below")
    per_day = df.groupBy(*keys, value, day).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys, value).orderBy(day)
    per_day = per_day.select(*keys, value, day, (F.sum("_n").over(w) - F.col("_n")).alias("_earlier"))
    inside = Window.partitionBy(*keys, value, day).orderBy(last)
    j = df.join(below, [*keys, value]).join(per_day, [*keys, value, day])
    return j.withColumn("rank", F.col("below") + F.col("_earlier") + F.row_number().over(inside) - 1).drop("below", "_earlier")


def layer_cuts(obs: DataFrame, layers: int = 5) -> DataFrame:
    """(factor, cut): where each layer but the first begins, as structs of x, day and code in order.

    The rank of a cut names its value by counted buckets, counts by day of the rows with that value name its day, and
    only the rows of that value and day are ordered. No other row is exchanged. Factors below 30 rows have no layers.
    """
    size = F.floor(F.col("total") / layers)
    values = quantiles(obs, "x", {f"_v{k}": size * k for k in range(1, layers)}, ["factor"], few=True).filter("total >= 30")
    # one row per factor and cut, so these small sides are bounded by the factor list
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (size * k).alias("rank"), F.col(f"_v{k}").alias("x")) for k in range(1, layers)]))
    cuts = values.select("factor", each.alias("c")).select("factor", "c.*")
    low = obs.join(F.broadcast(values), "factor").groupBy("factor").agg(*[count_if(F.col("x") < F.col(f"_v{k}")).alias(f"_{k}") for k in range(1, layers)])
    low = low.unpivot(["factor"], [f"_{k}" for k in range(1, layers)], "k", "below").withColumn("k", F.substring("k", 2, 9).cast("int"))
    cuts = cuts.join(low, ["factor", "k"]).select("factor", "k", "x", (F.col("rank") - F.col("below")).alias("rest"))
    per_day = obs.join(F.broadcast(cuts), ["factor", "x"]).groupBy("factor", "k", "x", "rest", "day").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("factor", "k").orderBy("day")) - F.col("_n")
    days = per_day.withColumn("place", F.col("rest") - earlier).filter("place >= 0 AND place < _n").select("factor", "k", "x", "day", "place")
    inside = Window.partitionBy("factor", "k").orderBy("code")
    rows = obs.select("factor", "x", "day", "code").join(F.broadcast(days), ["factor", "x", "day"]).withColumn("_i", F.row_number().over(inside) - 1)
    first = rows.filter("_i = place").groupBy("factor").agg(F.array_sort(F.collect_list(F.struct("k", F.struct("x", "day", "code").alias("at")))).alias("cut"))
    return first.select("factor", F.transform("cut", lambda c: c["at"]).alias("cut"))


def layer_returns(obs: DataFrame, layers: int = 5) -> DataFrame:
    """Five equal-count layers over pooled rows in (value, day, code) order; the last one takes the remainder."""
    cut = obs.join(F.broadcast(layer_cuts(obs, layers)), "factor")
    at = F.struct("x", "day", "code")
    layer = sum(((at >= F.col("cut")[k]).cast("int") for k in range(layers - 1)), F.lit(1))
    names = F.array(*[F.lit(n) for n in LAYERS])
    g = cut.groupBy("factor", F.element_at(names, layer).alias("layer"))
    return g.agg(F.avg("y").alias("avg_return"), (count_if(F.col("y") > 0) / F.count(F.lit(1))).alias("hit_rate"), F.count(F.lit(1)).alias("n"))
