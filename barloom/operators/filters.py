"""Predicates, projections and look-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import codes as fc
from barloom.functions.numeric import _c, lit, rnd
from barloom.functions.ranks import all_of
from barloom.operators.windows import Roll, first_row

_LIKE = {"code_like": "code", "name_like": "name", "industry_like": "industry", "concept_like": "concept"}
_EQUAL = {"change_type": "change_type", "change_date": "change_date", "industry": "industry"}
_FROM = {"date_from": "change_date", "time_from": "change_time", "min_volume": "volume", "min_amount": "amount", "min_rate": "rate"}
_TO = {"date_to": "change_date", "time_to": "change_time", "max_rate": "rate"}


def filter_events(df: DataFrame, **opts) -> DataFrame:
    """Optional predicates, AND-ed; options left out or None do nothing."""
    conds: list[Column] = []
    for name, value in opts.items():
        if value is None:
            continue
        if name in _LIKE:
            conds.append(F.contains(F.col(_LIKE[name]).cast("string"), F.lit(value)))
        elif name in _EQUAL:
            conds.append(F.col(_EQUAL[name]) == F.lit(value))
        elif name == "change_types":
            conds.append(F.col("change_type").isin(*value))
        elif name in _FROM:
            conds.append(F.col(_FROM[name]) >= F.lit(value))
        elif name in _TO:
            conds.append(F.col(_TO[name]) <= F.lit(value))
        else:
            raise ValueError(f"unknown option {name}")
    return df.filter(all_of(conds))


_OPS = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
}


def screen_flags(df: DataFrame, flags: Sequence[str] = (), thresholds: Mapping[str, tuple[str, float]] | None = None) -> DataFrame:
    """Rows with all the flags set and every threshold met by its own operator."""
    conds = [F.col(f) for f in flags]
    conds += [_OPS[op](F.col(c), F.lit(v)) for c, (op, v) in (thresholds or {}).items()]
    return df.filter(all_of(conds))


def search_instruments(masters: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Code or name contains the key, over several masters; a code found twice keeps the first master's row."""
    needle = F.lit(key.lower())
    found = []
    for i, (name, df) in enumerate(masters):
        hit = F.contains(F.lower(F.col("code").cast("string")), needle) | F.contains(F.lower("name"), needle)
        found.append(df.filter(hit).select(F.col("code").cast("string").alias("code"), "name", F.lit(name).alias("master"), F.lit(i).alias("_p")))
    both = reduce(lambda a, b: a.unionByName(b), found)
    return first_row(both, ["code"], [F.col("_p"), F.col("name")]).drop("_p")


def filter_news(df: DataFrame, keyword: str | None = None, since=None, title: str = "title", body: str = "content") -> DataFrame:
    conds = []
    if keyword:
        conds.append(F.contains(F.coalesce(F.col(title), F.lit("")), F.lit(keyword)) | F.contains(F.col(body), F.lit(keyword)))
    if since is not None:
        conds.append(F.col("ts") > F.lit(since))
    return df.filter(all_of(conds))


def tradable(df: DataFrame, side: str = "buy", hint: str | None = None, buffer: float = 0.0, name: str = "name") -> DataFrame:
    """Adds `tradable`: not suspended, and the execution price inside the day's price limits.

    Buys are blocked at the upper limit, sells at the lower; the buffer is held to 1 percent.
    """
    r = Roll()
    prev = r.lag("close")
    live = all_of([F.col(c) > 0 for c in ("open", "high", "low", "close", "volume")])
    rate = fc.price_limit_rate(F.col("code").cast("string"), F.col(name) if name in df.columns else F.lit(""))
    buf = min(max(buffer, 0.0), 0.01)
    price = F.col("open") if hint is None else F.when(F.col(hint) > 0, F.col(hint)).otherwise(F.col("open"))
    if side == "buy":
        blocked = price >= prev * (lit(1) + rate) * lit(1 - buf) - lit(1e-8)
    else:
        blocked = price <= prev * (lit(1) - rate) * lit(1 + buf) + lit(1e-8)
    limited = F.coalesce((prev > 0) & blocked, F.lit(False))
    return df.withColumn("tradable", live & ~limited)


def position_columns(df: DataFrame) -> DataFrame:
    """Holding columns from a quote joined to its position: price falls back to ask, bid, previous close."""
    price = F.coalesce(*[F.nullif(F.col(c), lit(0)) for c in ("price", "ask1", "bid1", "pre_close")], lit(0))
    pc, cost, vol = F.col("pre_close"), F.col("cost_price"), F.col("cost_volume")
    high = F.coalesce(F.nullif(F.col("high"), lit(0)), F.col("open"))
    low = F.coalesce(F.nullif(F.col("low"), lit(0)), F.col("open"))
    df = df.withColumns({"last_price": price, "_high": high, "_low": low})
    p = F.col("last_price")
    held = (cost > 0) & (vol > 0) & (p > 0)

    def pct(x: Column) -> Column:
        return F.when((x > 0) & (pc > 0), rnd((x - pc) / pc * lit(100), 3)).otherwise(lit(0))

    return df.withColumns(
        {
            "change_value": F.when((p > 0) & (pc > 0), rnd(p - pc, 2)).otherwise(lit(0)),
            "change_pct": pct(p),
            "high_pct": pct(F.col("_high")),
            "low_pct": pct(F.col("_low")),
            "profit_pct": F.when(held, rnd((p - cost) / cost * lit(100), 3)).otherwise(lit(0)),
            "profit_amount": F.when(held, rnd((p - cost) * vol, 2)).otherwise(lit(0)),
            "profit_today": F.when(held, rnd((p - pc) * vol, 2)).otherwise(lit(0)),
        }
    ).drop("_high", "_low")


def latest_price(codes: DataFrame, quotes: DataFrame, features: DataFrame, trades: DataFrame) -> DataFrame:
    """Quote price, else ask, else the newest feature close, else the newest trade price."""
    f = features.groupBy("code").agg(F.max_by("close", "day").alias("_f"))
    t = trades.groupBy("code").agg(F.max_by("price", F.struct("day", "k")).alias("_t"))
    j = codes.join(quotes.select("code", "price", "ask1"), "code", "left").join(f, "code", "left").join(t, "code", "left")
    best = F.coalesce(F.nullif(F.col("price"), lit(0)), F.nullif(F.col("ask1"), lit(0)), F.col("_f"), F.col("_t"))
    return j.select("code", best.alias("latest_price"))


def universe(df: DataFrame, scope: DataFrame | None = None, key: str = "code") -> DataFrame:
    """Rows whose code is in the scope; no scope means all."""
    return df if scope is None else df.join(scope.select(key).distinct(), key, "left_semi")


# fixed values: scope names
ALL_SCOPES, FOLLOWED, NEWEST = ("", "全部A股", "全部"), "自选股", "snapshot_all"


def scope_codes(scope: str, instruments: DataFrame, followed: DataFrame, snapshots: DataFrame, items: DataFrame) -> DataFrame:
    """(code, place) of a named scope, each code once at its best place; place is null where the scope has no order.

    `stock_<code>` is one instrument, `group_<id>` a followed group, `snapshot_<id>` a candidate snapshot (snapshots has
    id, status, available_at; items has snapshot_id, code, source_rank), `snapshot_all` the newest that has not failed.
    """
    plain = F.lit(None).cast("long").alias("place")
    if scope == NEWEST:
        newest = snapshots.filter("status <> 'failed'").agg(F.max(F.struct("available_at", "id")).alias("x")).select(F.col("x.id").alias("snapshot_id"))
        chosen = items.join(F.broadcast(newest), "snapshot_id", "left_semi")
    elif scope.startswith("stock_"):
        code = scope.removeprefix("stock_").strip()
        return instruments.filter(F.col("code").cast("string") == code).select("code", plain).distinct()
    elif scope == FOLLOWED or scope.startswith("group_"):
        group = followed if scope == FOLLOWED else followed.filter(F.col("group").cast("string") == scope.removeprefix("group_"))
        return group.filter("code IS NOT NULL").select("code", plain).distinct()
    elif scope.startswith("snapshot_"):
        chosen = items.filter(F.col("snapshot_id").cast("string") == scope.removeprefix("snapshot_").strip())
    else:
        return instruments.filter("code IS NOT NULL").select("code", plain).distinct()
    return chosen.groupBy("code").agg(F.min("source_rank").cast("long").alias("place"))


def watch_tag_filter(df: DataFrame, members: DataFrame | None, keyword: str = "") -> DataFrame:
    """Rows in the group (when given) whose code or name contains the keyword."""
    out = universe(df, members)
    if keyword:
        k = F.lit(keyword)
        out = out.filter(F.contains(F.col("code").cast("string"), k) | F.contains("name", k))
    return out


def fund_rates(df: DataFrame) -> DataFrame:
    """Estimated rate against the previous NAV, else the NAV; the actual rate once the NAV is dated on or after the estimate."""
    est, nav, prev = F.col("estimate"), F.col("nav"), F.col("nav_prev")
    estimated = F.when(est.isNotNull() & (prev > 0), rnd((est - prev) / prev * lit(100), 2)).when(
        est.isNotNull() & (nav > 0), rnd((est - nav) / nav * lit(100), 2)
    )
    updated = F.col("nav_date") >= F.substring_index("estimate_time", " ", 1)
    actual = F.when((prev > 0) & nav.isNotNull() & updated, rnd((nav - prev) / prev * lit(100), 2))
    return df.withColumns({"estimated_rate": estimated, "actual_rate": actual})


def fill_from_master(df: DataFrame, master: DataFrame, columns: Sequence[str], key: str = "code") -> DataFrame:
    """Fill missing values (and empty text) from a master row of the same key."""
    text = {c for c, t in df.dtypes if t == "string"}
    m = master.select(key, *[F.col(c).alias(f"_m_{c}") for c in columns])
    own = {c: F.nullif(F.col(c), F.lit("")) if c in text else F.col(c) for c in columns}
    j = df.join(m, key, "left")
    return j.withColumns({c: F.coalesce(own[c], F.col(f"_m_{c}")) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def auction_rows(df: DataFrame) -> DataFrame:
    """Side of a call-auction row from its flag's sign."""
    return df.withColumn("side", F.when(_c("flag") < 0, "卖盘").otherwise("买盘"))
