"""Queries: joins, aggregations, rankings, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import events as ev
from barloom.functions.dates import day_text
from barloom.functions.numeric import lit, rnd
from barloom.indicators import rolling as ro
from barloom.operators import aggregates as oa
from barloom.operators import joins as oj
from barloom.operators import ranking as rk
from barloom.operators.windows import level_rank, lower_nearest, quantiles
from barloom.plans.registry import query
from barloom.plans.sqlkit import BARS, BULL, CHANGES, DOWN, SECTORS, TICKS, UP, W, ctes, d, lag, r, roll
from barloom.sources import views

COUNTS = f"count(*) AS total_count, count(CASE WHEN change_type IN {UP} THEN 1 END) AS up_count, count(CASE WHEN change_type IN {DOWN} THEN 1 END) AS down_count"


# --- joins -----------------------------------------------------------------------------------
@query("enrich_events", ctes(CHANGES, SECTORS) + "SELECT event_id, changes.code, change_type, s.industry, s.concept FROM changes LEFT JOIN sectors s ON s.code = changes.code")
def enrich_events(spark, sf):
    c = views.changes(spark, sf).select("event_id", "code", "change_type")
    return oj.enrich(c, views.sectors(spark, sf))


@query(
    "semi_anti_join",
    "SELECT p_partkey AS code, 'held' AS kind FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT p_partkey, 'fresh' FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')",
)
def semi_anti_join(spark, sf):
    p = views.table(spark, sf, "part").select(F.col("p_partkey").alias("code"))
    held = views.trades(spark, sf).filter("side = 'sell'").select("code")
    return p.join(held, "code", "left_semi").withColumn("kind", F.lit("held")).unionByName(p.join(held, "code", "left_anti").withColumn("kind", F.lit("fresh")))


@query(
    "asof_latest",
    ctes(BARS)
    + f"SELECT o_orderkey, code, {d('b.day')} AS basis_day, {r('b.close', 3)} AS close FROM (SELECT o_orderkey, o_custkey % 50 AS code, CAST(o_orderdate AS DATE) AS od FROM orders) o ASOF LEFT JOIN bars b USING (code, od) ".replace("USING (code, od)", "ON o.code = b.code AND o.od >= b.day").replace("SELECT o_orderkey, code", "SELECT o_orderkey, o.code"),
)
def asof_latest(spark, sf):
    o = views.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("code"), F.col("o_orderdate").cast("date").alias("od"))
    b = views.closes(spark, sf).withColumn("basis_day", F.col("day"))
    j = oj.asof_latest(o, b, "od", "day", ["basis_day", "close"])
    return j.select("o_orderkey", "code", day_text("basis_day").alias("basis_day"), rnd("close", 3).alias("close"))


@query("previous_next_row", ctes(BARS) + f"SELECT code, {d()} AS day, {r(lag('close'), 3)} AS prev_close, {r(f'lead(close) OVER {W}', 3)} AS next_close FROM bars")
def previous_next_row(spark, sf):
    b = views.closes(spark, sf)
    return b.select("code", day_text("day").alias("day"), rnd(ro.R.lag("close"), 3).alias("prev_close"), rnd(ro.R.lead("close"), 3).alias("next_close"))


@query(
    "nth_trading_day",
    f"""WITH t AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE isodow(l_shipdate) < 6)),
o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders),
n AS (SELECT o_orderkey, o.day, (SELECT min(i) FROM t WHERE t.day >= o.day) AS a, (SELECT min(i) FROM t WHERE t.day > o.day) AS b FROM o)
SELECT o_orderkey, {d('t1.day')} AS on_or_after, {d('t2.day')} AS first_after, {d('t3.day')} AS nth_after FROM n LEFT JOIN t t1 ON t1.i = a LEFT JOIN t t2 ON t2.i = b LEFT JOIN t t3 ON t3.i = b + 4
WHERE n.day BETWEEN (SELECT min(day) FROM t) AND (SELECT max(day) FROM t)""",
)
def nth_trading_day(spark, sf):
    days = views.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")).distinct().filter(F.dayofweek("day").between(2, 6))
    o = views.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    o = o.join(F.broadcast(span), F.col("day").between(F.col("a"), F.col("b")), "left_semi")
    n = oj.nth_trading_day(o, days, 5)
    return n.select("o_orderkey", *[day_text(c).alias(c) for c in ("on_or_after", "first_after", "nth_after")])


_FACTS = "facts AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS day, l_linenumber, l_extendedprice AS x, l_orderkey, CAST(l_shipdate AS DATE) + INTERVAL (l_linenumber) HOUR AS available_at FROM lineitem)"


def _line_facts(spark, sf):
    li = views.table(spark, sf, "lineitem")
    day = F.col("l_shipdate").cast("date")
    return li.select(
        F.col("l_suppkey").alias("code"),
        day.alias("day"),
        F.col("l_extendedprice").alias("x"),
        "l_orderkey",
        (day.cast("timestamp") + F.make_interval(hours=F.col("l_linenumber"))).alias("available_at"),
    )


@query(
    "point_in_time",
    ctes(BARS, _FACTS)
    + f"""SELECT b.code, {d('b.day')} AS day, any_value({r('m.x', 2)}) AS x, any_value(strftime(m.a, '%H:%M')) AS known_at FROM bars b LEFT JOIN
  (SELECT code, day, arg_max(x, ROW(available_at, x, l_orderkey)) AS x, max(available_at) AS a FROM facts WHERE available_at <= day + INTERVAL 4 HOUR GROUP BY code, day) m ON m.code = b.code AND m.day = b.day GROUP BY b.code, b.day""",
)
def point_in_time(spark, sf):
    base = views.closes(spark, sf).select("code", "day", (F.col("day").cast("timestamp") + F.make_interval(hours=F.lit(4))).alias("decision_as_of"))
    p = oj.point_in_time(base, _line_facts(spark, sf), ["x", "l_orderkey"])
    return p.select("code", day_text("day").alias("day"), rnd("x", 2).alias("x"), F.date_format("available_at", "HH:mm").alias("known_at"))


@query(
    "unified_view",
    ctes(BARS, "mk AS (SELECT day, count(*) AS n FROM bars GROUP BY day)", "l AS (SELECT code, day, close, net_inflow, n FROM bars LEFT JOIN mk USING (day))")
    + " UNION ALL ".join(f"SELECT code, {d()} AS day, '{n}' AS indicator, {r(x, 2)} AS value, CASE WHEN {x} IS NULL THEN 0 ELSE 1 END::DOUBLE AS coverage FROM l" for n, x in (("close", "close"), ("money_flow_net_inflow", "CASE WHEN code % 2 = 0 THEN net_inflow END"), ("market_n", "n"))),
)
def unified_view(spark, sf):
    b = views.bars_flows(spark, sf).select("code", "day", "close", "net_inflow")
    market = b.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    facts = {"money_flow": b.filter("code % 2 = 0"), "market": b.select("code", "day").join(market, "day"), "event": None}
    v = oj.unified_view(b.select("code", "day", "close"), facts, ["stock_feature.close", "money_flow.net_inflow", "market.n"])
    long = oj.unified_long(v, ["close", "money_flow_net_inflow", "market_n"])
    return long.select("code", day_text("day").alias("day"), "indicator", rnd("value", 2).alias("value"), "coverage")


@query(
    "sector_net_median",
    ctes(
        BARS,
        SECTORS,
        "sf AS (SELECT 'industry' AS t, industry AS n, day, sum(net_inflow) AS net FROM bars JOIN sectors USING (code) WHERE industry NOT IN ('NATION_0', 'NATION_1', 'NATION_2') GROUP BY 1, 2, 3 UNION ALL SELECT 'concept', concept, day, sum(net_inflow) FROM bars JOIN sectors USING (code) GROUP BY 1, 2, 3 UNION ALL SELECT 'concept', 'all', day, sum(net_inflow) / 100 FROM bars GROUP BY 1, 2, 3)",
        "m AS (SELECT s.code, sf.day, median(CASE WHEN t = 'industry' THEN net END) AS i, median(CASE WHEN t = 'concept' THEN net END) AS c FROM sectors s JOIN sf ON (t = 'industry' AND n = s.industry) OR (t = 'concept' AND n IN (s.concept, 'all')) GROUP BY 1, 2)",
    )
    + f"SELECT code, {d()} AS day, {r('coalesce(i, c)', 1)} AS sector_net FROM m",
)
def sector_net_median(spark, sf):
    s = views.sectors(spark, sf)
    b = views.flows(spark, sf).join(s.select("code", "industry", "concept"), "code")
    b = b.groupBy("industry", "concept", "day").agg(F.sum("net_inflow").alias("net_inflow"))
    stamp = F.col("day").cast("timestamp").alias("data_as_of")

    def flow(kind, name, share=1.0):
        g = b.groupBy(name.alias("sector_name"), "day").agg((F.sum("net_inflow") / lit(share)).alias("net_inflow"))
        return g.select(F.lit(kind).alias("sector_type"), "sector_name", "day", "net_inflow", stamp)

    flows = flow("industry", F.col("industry")).filter(~F.col("sector_name").isin("NATION_0", "NATION_1", "NATION_2"))
    flows = flows.unionByName(flow("concept", F.col("concept"))).unionByName(flow("concept", F.lit("all"), 100))
    stocks = s.select("code", "industry", F.array("concept", F.lit("all")).alias("concepts"))
    return oj.sector_net(stocks, flows).select("code", day_text("day").alias("day"), rnd("sector_net", 1).alias("sector_net"))


_RECS = "rec AS (SELECT event_id, user_id AS code, CAST(ts AS DATE) AS event_day, event_type AS model, value FROM events)"


@query(
    "lookback_recommendations",
    ctes(_RECS, "base AS (SELECT DISTINCT user_id AS code, CAST(ts AS DATE) AS day FROM events)")
    + f"SELECT b.code, {d('b.day')} AS day, count(DISTINCT model) AS models, count(event_id) AS recommendations, {r('coalesce(max(value), 0)', 3)} AS best FROM base b LEFT JOIN rec ON rec.code = b.code AND rec.event_day BETWEEN b.day - INTERVAL 14 DAY AND b.day GROUP BY b.code, b.day",
)
def lookback_recommendations(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("user_id").alias("code"), F.col("ts").cast("date").alias("day"), "event_type", "value")
    base = e.select("code", "day").distinct()
    rec = e.groupBy("code", F.col("day").alias("event_day"), F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("best"))
    out = oj.lookback_counts(base, rec, 14, [F.countDistinct("model").alias("models"), F.sum("n").alias("recommendations"), F.max("best").alias("best")])
    return out.select("code", day_text("day").alias("day"), F.coalesce("models", F.lit(0)).alias("models"), F.coalesce("recommendations", F.lit(0)).alias("recommendations"), rnd(F.coalesce("best", lit(0)), 3).alias("best"))


@query(
    "range_stats",
    ctes(BARS, "a AS (SELECT code, strftime(day, '%Y-%m') AS m, CASE WHEN code % 2 = 0 THEN min(day) ELSE max(day) END AS t1, CASE WHEN code % 2 = 0 THEN max(day) ELSE min(day) END AS t2 FROM bars GROUP BY 1, 2)")
    + f"""SELECT a.code, {d('t1')} AS t1, {d('t2')} AS t2, {r('any_value(y.close) - any_value(x.close)', 3)} AS diff, {r('(any_value(y.close) - any_value(x.close)) / any_value(x.close) * 100', 3)} AS pct, count(*) AS bar_count, {r('sum(b.volume)', 2)} AS volume_sum
  FROM a JOIN bars x ON x.code = a.code AND x.day = t1 JOIN bars y ON y.code = a.code AND y.day = t2 JOIN bars b ON b.code = a.code AND b.day BETWEEN least(t1, t2) AND greatest(t1, t2) GROUP BY a.code, t1, t2""",
)
def range_stats(spark, sf):
    b = views.bars(spark, sf).select("code", "day", "close", "volume")
    m = b.groupBy("code", F.date_format("day", "yyyy-MM").alias("m")).agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    even = F.col("code") % 2 == 0
    anchors = m.select("code", F.when(even, F.col("lo")).otherwise(F.col("hi")).alias("t1"), F.when(even, F.col("hi")).otherwise(F.col("lo")).alias("t2"))
    s = oj.range_stats(b, anchors)
    return s.select("code", day_text("t1").alias("t1"), day_text("t2").alias("t2"), rnd("diff", 3).alias("diff"), rnd("pct", 3).alias("pct"), "bar_count", rnd("volume_sum", 2).alias("volume_sum"))


_COLS = ("open", "high", "close", "volume", "turnover", "net_inflow")


@query(
    "pair_correlations",
    ctes(BARS) + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {r(f'corr({a}, {b})', 6)} AS rho FROM bars" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]),
)
def pair_correlations(spark, sf):
    p = oj.pair_correlations(views.bars_flows(spark, sf), _COLS)
    return p.select("a", "b", "n", rnd("rho", 6).alias("rho"))


@query(
    "scenario_costs",
    ctes(BARS) + " UNION ALL ".join(f"SELECT code, '{n}' AS scenario, {r(f'sum(amount * {v}::DOUBLE)', 1)} AS cost FROM bars GROUP BY code" for n, v in (("base", 0.0015), ("slippage_1_5x", 0.00225), ("slippage_2x", 0.003))),
)
def scenario_costs(spark, sf):
    b = views.bars(spark, sf).groupBy("code").agg(F.sum("amount").alias("amount"))
    s = oj.with_scenarios(b, "slippage", [("base", 0.0015), ("slippage_1_5x", 0.00225), ("slippage_2x", 0.003)])
    return s.select("code", "scenario", rnd(F.col("amount") * F.col("slippage"), 1).alias("cost"))


@query(
    "news_tags",
    """WITH bridge AS (SELECT doc_id, lang AS tag_id FROM documents UNION SELECT doc_id, source FROM documents UNION SELECT doc_id, 'q' || quality FROM labels)
SELECT doc_id, list_aggregate(list_sort(list(DISTINCT tag_id || '!')), 'string_agg', '|') AS tags FROM documents JOIN bridge USING (doc_id) GROUP BY doc_id""",
)
def news_tags(spark, sf):
    docs = views.news(spark, sf)
    labels = views.table(spark, sf, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("tag_id"))
    bridge = docs.select("doc_id", F.col("lang").alias("tag_id")).unionByName(docs.select("doc_id", F.col("source").alias("tag_id"))).unionByName(labels).distinct()
    tags = bridge.select("tag_id").distinct().withColumn("tag", F.concat("tag_id", F.lit("!")))
    return oj.tags_of(docs.select("doc_id"), bridge, tags, "doc_id").select("doc_id", F.array_join("tags", "|").alias("tags"))


# --- aggregations ----------------------------------------------------------------------------
@query("agg_by_key", ctes(BARS) + f"SELECT code, count(*) AS n, {d('min(day)')} AS first_day, {d('max(day)')} AS last_day, {r('sum(volume)', 2)} AS volume, {r('avg(close)', 3)} AS avg_close, count(DISTINCT strftime(day, '%Y-%m')) AS months FROM bars GROUP BY code")
def agg_by_key(spark, sf):
    return (
        views.bars(spark, sf)
        .groupBy("code")
        .agg(
            F.count(F.lit(1)).alias("n"),
            day_text(F.min("day")).alias("first_day"),
            day_text(F.max("day")).alias("last_day"),
            rnd(F.sum("volume"), 2).alias("volume"),
            rnd(F.avg("close"), 3).alias("avg_close"),
            F.countDistinct(F.date_format("day", "yyyy-MM")).alias("months"),
        )
    )


@query("change_daily_counts", ctes(CHANGES) + f"SELECT change_date, {COUNTS}, count(CASE WHEN change_type = 4 THEN 1 END) AS limit_up, count(CASE WHEN change_type = 8 THEN 1 END) AS limit_down FROM changes GROUP BY 1")
def change_daily_counts(spark, sf):
    return oa.daily_counts(views.changes(spark, sf))


@query("change_type_counts", ctes(CHANGES) + "SELECT change_date, change_type, count(*) AS n FROM changes WHERE change_date >= '2024-01-10' GROUP BY 1, 2")
def change_type_counts(spark, sf):
    return views.changes(spark, sf).filter("change_date >= '2024-01-10'").groupBy("change_date", "change_type").agg(F.count(F.lit(1)).alias("n"))


@query("change_dimension_daily", ctes(CHANGES) + f"SELECT 'concept' AS dim, change_date, {COUNTS} FROM changes WHERE contains(concept, 'ASIA') GROUP BY 2 UNION ALL SELECT 'industry', change_date, {COUNTS} FROM changes WHERE industry = 'NATION_7' GROUP BY 2")
def change_dimension_daily(spark, sf):
    c = views.changes(spark, sf)
    return oa.dimension_daily(c, concept="ASIA").withColumn("dim", F.lit("concept")).unionByName(oa.dimension_daily(c, industry="NATION_7").withColumn("dim", F.lit("industry")))


_CONCEPT = f"cc AS (SELECT unnest(string_split(concept, ',')) AS concept, change_type FROM changes)"


@query("change_concept_counts", ctes(CHANGES, _CONCEPT) + f"SELECT concept, {COUNTS} FROM cc GROUP BY 1")
def change_concept_counts(spark, sf):
    return oa.concept_counts(views.changes(spark, sf))


@query(
    "stock_day_events",
    ctes(CHANGES)
    + f"""SELECT code, change_date, count(*) AS event_count, count(CASE WHEN change_type IN {BULL} THEN 1 END) AS bullish_count, count(CASE WHEN change_type IN {DOWN} THEN 1 END) AS bearish_count, count(CASE WHEN change_type = 8193 THEN 1 END) AS large_buy_count,
  count(CASE WHEN change_type = 8194 THEN 1 END) AS large_sell_count, count(CASE WHEN change_type IN (8201, 8202) THEN 1 END) AS rapid_rise_count, count(CASE WHEN change_type IN (8203, 8204) THEN 1 END) AS rapid_fall_count,
  count(CASE WHEN change_type = 4 THEN 1 END) AS limit_up_count, count(CASE WHEN change_type = 8 THEN 1 END) AS limit_down_count, {r('sum(amount)', 2)} AS event_amount, strftime(max(ts), '%H:%M:%S') AS latest_event FROM changes GROUP BY 1, 2""",
)
def stock_day_events(spark, sf):
    s = oa.stock_day_events(views.changes(spark, sf))
    return s.withColumns({"event_amount": rnd("event_amount", 2), "latest_event": F.date_format("latest_event", "HH:mm:ss")})


@query("exact_median", ctes(BARS, SECTORS) + f"SELECT industry, {r('median(close)', 3)} AS median_close FROM bars JOIN sectors USING (code) GROUP BY 1")
def exact_median(spark, sf):
    b = views.closes(spark, sf).join(views.sectors(spark, sf).select("code", "industry"), "code")
    return oj.median_by(b, "close", ["industry"]).select("industry", rnd("median_close", 3).alias("median_close"))


_RANKS = {"p01": 0.01, "p25": 0.25, "p75": 0.75, "p99": 0.99}


@query(
    "rank_quantiles",
    ctes(BARS, "o AS (SELECT close, row_number() OVER (ORDER BY close) - 1 AS k, count(*) OVER () AS n FROM bars)")
    + "SELECT " + ", ".join(f"{r(f'max(CASE WHEN k = floor((n - 1) * {p}::DOUBLE) THEN close END)', 3)} AS {n}" for n, p in _RANKS.items()) + f", {r('max(CASE WHEN k = n // 2 THEN close END)', 3)} AS upper_median FROM o",
)
def rank_quantiles(spark, sf):
    ranks = {n: lower_nearest(p) for n, p in _RANKS.items()}
    ranks["upper_median"] = F.floor(F.col("total") / 2)
    q = quantiles(views.closes(spark, sf), "close", ranks)
    return q.select(*[rnd(n, 3).alias(n) for n in ranks])


@query(
    "moments",
    ctes(BARS, "m AS (SELECT code, avg(turnover) AS mu, stddev_samp(turnover) AS sd, stddev_pop(turnover) AS sp, count(*) AS n FROM bars GROUP BY code)")
    + f"""SELECT code, n, {r('mu', 6)} AS mean, {r('sp', 6)} AS std_pop, {r('sd', 6)} AS std, {r('avg(power((turnover - mu) / sd, 3))', 5)} AS skewness, {r('avg(power((turnover - mu) / sd, 4)) - 3', 5)} AS kurtosis FROM bars JOIN m USING (code) GROUP BY code, n, mu, sp, sd""",
)
def moments(spark, sf):
    m = oa.moments(views.bars(spark, sf), "turnover", ["code"])
    return m.select("code", "n", *[rnd(c, k).alias(c) for c, k in (("mean", 6), ("std_pop", 6), ("std", 6), ("skewness", 5), ("kurtosis", 5))])


@query(
    "rank_correlation",
    ctes(BARS, "k AS (SELECT day, rank() OVER (PARTITION BY day ORDER BY volume) + (count(*) OVER (PARTITION BY day, volume) - 1) / 2.0 AS x, rank() OVER (PARTITION BY day ORDER BY turnover) + (count(*) OVER (PARTITION BY day, turnover) - 1) / 2.0 AS y FROM bars)")
    + f"SELECT {d()} AS day, {r('CASE WHEN count(*) >= 3 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) ELSE 0 END', 6)} AS rank_corr FROM k GROUP BY day",
)
def rank_correlation(spark, sf):
    c = oa.rank_correlation(views.bars(spark, sf), "volume", "turnover", ["day"])
    return c.select(day_text("day").alias("day"), rnd("rank_corr", 6).alias("rank_corr"))


@query("hit_rate", ctes(BARS, "m AS (SELECT code, avg(volume) AS a, avg(close) AS b FROM bars GROUP BY code)") + f"SELECT code, {r('count(CASE WHEN (volume - a) * (close - b) > 0 THEN 1 END) / count(*)', 6)} AS hit_rate FROM bars JOIN m USING (code) GROUP BY code")
def hit_rate(spark, sf):
    return oa.hit_rate(views.bars(spark, sf).select("code", "volume", "close"), "volume", "close", ["code"]).select("code", rnd("hit_rate", 6).alias("hit_rate"))


@query(
    "coverage",
    ctes(BARS, f"f AS (SELECT *, {roll('avg', 'close', 5)} AS ma5, {roll('avg', 'close', 20)} AS ma20 FROM bars)", "c AS (SELECT count(DISTINCT code) AS stocks, count(DISTINCT day) AS days, count(CASE WHEN volume > 0 THEN 1 END) AS priced, count(ma5) AS a, count(ma20) AS b FROM f)")
    + f"SELECT stocks, days, {r('priced / (stocks * days)', 6)} AS price_ratio, {r('a / (stocks * days)', 6)} AS ma5_ratio, {r('b / (stocks * days)', 6)} AS ma20_ratio, b / (stocks * days) >= 0.95 AS ready FROM c",
)
def coverage(spark, sf):
    c = oa.coverage(ro.moving_averages(views.bars(spark, sf)))
    return c.select("stocks", "days", *[rnd(x, 6).alias(x) for x in ("price_ratio", "ma5_ratio", "ma20_ratio")], "ready")


@query("last_snapshot_per_day", ctes(TICKS) + f"SELECT event_id, code, price FROM ticks WHERE (code, ts) IN (SELECT code, max(ts) FROM ticks GROUP BY code, CAST(ts AS DATE))")
def last_snapshot_per_day(spark, sf):
    return oa.last_snapshot_per_day(views.ticks(spark, sf), "ts", ["code"]).select("event_id", "code", "price")


@query(
    "news_dedup",
    "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY trim(text) ORDER BY n_chars DESC, source DESC, doc_id) AS rn FROM documents) WHERE rn = 1".replace("source DESC, ", ""),
)
def news_dedup(spark, sf):
    d_ = views.table(spark, sf, "documents")
    return oa.dedup_content(d_, None, "text", [-F.col("n_chars")], "doc_id").select("doc_id")


@query("merged_lists", ctes(CHANGES) + "SELECT code, change_date, array_to_string(list_sort(list(DISTINCT change_class)), '|') AS classes, array_to_string(list_sort(list(DISTINCT industry)), '|') AS industries FROM changes GROUP BY 1, 2")
def merged_lists(spark, sf):
    c = views.changes(spark, sf).select("code", "change_date", F.array("change_class").alias("classes"), F.array("industry").alias("industries"))
    m = oa.merged_lists(c, ["code", "change_date"], ["classes", "industries"])
    return m.select("code", "change_date", F.array_join("classes", "|").alias("classes"), F.array_join("industries", "|").alias("industries"))


@query("source_freshness", "SELECT event_type AS source, count(DISTINCT user_id) AS items, strftime(max(ts), '%Y-%m-%d %H:%M') AS data_as_of, strftime(max(ts) + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M') AS available_at FROM events GROUP BY 1")
def source_freshness(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("code"), F.col("ts").alias("data_as_of"), (F.col("ts") + F.make_interval(mins=F.lit(5))).alias("available_at"))
    f = oa.source_freshness(e)
    return f.select("source", "items", F.date_format("data_as_of", "yyyy-MM-dd HH:mm").alias("data_as_of"), F.date_format("available_at", "yyyy-MM-dd HH:mm").alias("available_at"))


_MOOD = "CASE WHEN x >= 2 THEN '普涨(极强)' WHEN x >= 1.5 THEN '偏强' WHEN x > 1 THEN '稍强' WHEN x = 1 THEN '中性' WHEN x > 0.5 THEN '稍弱' WHEN x > 0 THEN '偏弱' ELSE '普跌(冰点)' END"


@query(
    "market_breadth",
    ctes(BARS, SECTORS, f"m AS (SELECT code, day, close - {lag('close')} AS mv FROM bars)", "g AS (SELECT day, coalesce(concept, 'ALL') AS exchange, count(CASE WHEN mv > 0 THEN 1 END) AS up, count(CASE WHEN mv < 0 THEN 1 END) AS down FROM m JOIN sectors USING (code) GROUP BY GROUPING SETS ((day, concept), (day)))", "h AS (SELECT *, CASE WHEN down > 0 THEN up / down ELSE up END AS x FROM g)")
    + f"SELECT {d()} AS day, exchange, up, down, {r('CASE WHEN up + down > 0 THEN up / (up + down) * 100 ELSE 0 END', 4)} AS up_ratio, {r('x', 4)} AS up_down_ratio, {_MOOD} AS mood FROM h",
)
def market_breadth(spark, sf):
    b = views.closes(spark, sf).join(views.sectors(spark, sf).select("code", F.col("concept").alias("exchange")), "code")
    b = b.withColumn("move", F.col("close") - ro.R.lag("close"))
    m = oa.breadth(b, "exchange")
    return m.select(day_text("day").alias("day"), "exchange", "up", "down", rnd("up_ratio", 4).alias("up_ratio"), rnd("up_down_ratio", 4).alias("up_down_ratio"), "mood")


@query(
    "suspension_runs",
    ctes(BARS, f"f AS (SELECT code, day, volume < 20 AS s, row_number() OVER {W} - sum(CAST(volume < 20 AS INT)) OVER (PARTITION BY code ORDER BY day) AS g FROM bars)", "x AS (SELECT code, count(*) AS n FROM f WHERE s GROUP BY code, g)")
    + "SELECT b.code, coalesce(max(n), 0) AS longest_run FROM (SELECT DISTINCT code FROM bars) b LEFT JOIN x USING (code) GROUP BY b.code",
)
def suspension_runs(spark, sf):
    return oa.longest_run(views.bars(spark, sf), F.col("volume") < 20)


# --- rankings and sets ------------------------------------------------------------------------
@query("change_rank_stocks", ctes(CHANGES) + f"SELECT code, name, {COUNTS} FROM changes WHERE change_date >= '2024-01-05' GROUP BY 1, 2 ORDER BY total_count DESC, code, name LIMIT 20")
def change_rank_stocks(spark, sf):
    return rk.top_by_count(views.changes(spark, sf).filter("change_date >= '2024-01-05'"), ["code", "name"])


@query("change_rank_industries", ctes(CHANGES) + f"SELECT industry, {COUNTS} FROM changes GROUP BY 1 ORDER BY total_count DESC, industry LIMIT 10")
def change_rank_industries(spark, sf):
    return rk.top_by_count(views.changes(spark, sf), ["industry"], 10)


@query("change_rank_concepts", ctes(CHANGES, _CONCEPT) + f"SELECT concept, {COUNTS} FROM cc GROUP BY 1 ORDER BY total_count DESC, concept LIMIT 7")
def change_rank_concepts(spark, sf):
    return oa.concept_counts(views.changes(spark, sf)).orderBy(F.desc("total_count"), "concept").limit(7)


@query("latest_snapshot_top", ctes(BARS) + f"SELECT code, net_inflow FROM bars WHERE day = (SELECT max(day) FROM bars) ORDER BY net_inflow DESC, code LIMIT 10")
def latest_snapshot_top(spark, sf):
    return rk.latest_snapshot(views.flows(spark, sf), "day").orderBy(F.desc("net_inflow"), "code").limit(10).select("code", "net_inflow")


@query(
    "flow_top_bottom_series",
    ctes(BARS, "t AS (SELECT code, sum(net_inflow) AS s FROM bars GROUP BY code)", "p AS ((SELECT code, 'in' AS side FROM t WHERE s > 0 ORDER BY s DESC, code LIMIT 20) UNION ALL (SELECT code, 'out' FROM t WHERE s < 0 ORDER BY s, code LIMIT 20))")
    + f"SELECT side, code, {d()} AS day, net_inflow FROM bars JOIN p USING (code)",
)
def flow_top_bottom_series(spark, sf):
    f = views.flows(spark, sf)
    total = f.groupBy("code").agg(F.sum("net_inflow").alias("s"))
    p = rk.top_and_bottom(total, "s", "code").select("code", "side")
    return f.join(F.broadcast(p), "code").select("side", "code", day_text("day").alias("day"), "net_inflow")


@query("series_page", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def series_page(spark, sf):
    o = views.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rk.page(o, [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 50)


_SNAP = "sn AS (SELECT 'industry' AS sector_type, event_type || '_' || (user_id % 7) AS sector_name, CAST(ts AS DATE) AS day, arg_max(value, ts) AS net_inflow FROM events GROUP BY 1, 2, 3)"


@query("daily_sector_rank", ctes(_SNAP) + f"SELECT * FROM (SELECT sector_name, {d()} AS day, net_inflow, CAST(row_number() OVER (PARTITION BY day ORDER BY net_inflow DESC, sector_name) AS INTEGER) AS rank FROM sn) WHERE rank <= 10")
def daily_sector_rank(spark, sf):
    e = views.table(spark, sf, "events")
    s = e.select(F.lit("industry").alias("sector_type"), F.concat("event_type", F.lit("_"), (F.col("user_id") % 7).cast("string")).alias("sector_name"), "ts", F.col("value").alias("net_inflow"))
    return rk.daily_sector_rank(s, 10).select("sector_name", day_text("day").alias("day"), "net_inflow", "rank")


_LADDER = "lu AS (SELECT CAST(ts AS DATE) AS day, user_id AS code, user_id % 5 + 1 AS streak, strftime(ts, '%H:%M:%S') AS limit_time, 'U' || user_id AS name, event_type AS plate FROM events)"


@query(
    "limit_up_ladder",
    ctes(_LADDER, "b AS (SELECT day, code, max(streak) AS streak, min(limit_time) AS t, any_value(name) AS name FROM lu GROUP BY day, code)")
    + f"SELECT {d()} AS day, streak, code, name, CAST(row_number() OVER (PARTITION BY day, streak ORDER BY t, code) AS INTEGER) AS place, count(*) OVER (PARTITION BY day, streak) AS stocks FROM b",
)
def limit_up_ladder(spark, sf):
    e = views.table(spark, sf, "events")
    rows = e.select(F.col("ts").cast("date").alias("day"), F.col("user_id").alias("code"), (F.col("user_id") % 5 + 1).alias("streak"), F.date_format("ts", "HH:mm:ss").alias("limit_time"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("name"), F.col("event_type").alias("plate"))
    l = rk.limit_up_ladder(rows)
    return l.select(day_text("day").alias("day"), "streak", "code", "name", "place", "stocks")


def _touched(spark, sf):
    e = views.table(spark, sf, "events")
    return e.select(
        F.col("ts").cast("date").alias("day"),
        F.col("user_id").alias("code"),
        (F.col("event_id") % 4 + 1).alias("streak"),
        F.struct("ts", "event_id").alias("limit_time"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("name"),
        F.concat(F.col("event_type"), F.lit("_"), (F.col("user_id") % 6).cast("string")).alias("plate"),
        (F.col("event_id") % 3 != 0).alias("held"),
        (F.col("value") + lit(1)).alias("limit_price"),
        (F.col("value") * lit(0.97) + lit(0.5)).alias("close"),
    )


_TOUCHED = "tc AS (SELECT CAST(ts AS DATE) AS day, user_id AS code, event_id % 4 + 1 AS streak, ts, event_id, 'U' || user_id AS name, event_type || '_' || (user_id % 6) AS plate, event_id % 3 <> 0 AS held, value + 1 AS lp, value * 0.97::DOUBLE + 0.5 AS cl FROM events)"


@query("limit_up_exploded", ctes(_TOUCHED) + f"SELECT {d()} AS day, code, name, plate, {r('(cl / lp - 1) * 100', 4)} AS fall FROM (SELECT *, row_number() OVER (PARTITION BY day, code ORDER BY ts DESC, event_id DESC) AS n FROM tc) WHERE n = 1 AND NOT held")
def limit_up_exploded(spark, sf):
    x = rk.exploded_list(_touched(spark, sf))
    return x.select(day_text("day").alias("day"), "code", "name", "plate", rnd("fall", 4).alias("fall"))


@query("limit_up_plates", ctes(_TOUCHED) + f"SELECT {d()} AS day, plate, stocks, top_streak, CAST(row_number() OVER (PARTITION BY day ORDER BY stocks DESC, top_streak DESC, plate) AS INTEGER) AS place FROM (SELECT day, plate, count(DISTINCT code) AS stocks, max(streak) AS top_streak FROM tc GROUP BY 1, 2)")
def limit_up_plates(spark, sf):
    h = rk.plate_heat(_touched(spark, sf))
    return h.select(day_text("day").alias("day"), "plate", "stocks", "top_streak", "place")


@query("bull_bear_boards", ctes(BARS, "t AS (SELECT code, sum(net_inflow) AS s FROM bars GROUP BY code)") + "SELECT * FROM (SELECT CASE WHEN s > 0 THEN 'bull' ELSE 'bear' END AS side, code, CAST(row_number() OVER (PARTITION BY s > 0 ORDER BY abs(s) DESC, code) AS INTEGER) AS place FROM t WHERE s <> 0) WHERE place <= 10")
def bull_bear_boards(spark, sf):
    total = views.flows(spark, sf).groupBy("code").agg(F.sum("net_inflow").alias("s"))
    return rk.boards(total, "s", "code").select("side", "code", "place")


@query("sector_flow_series", ctes(BARS, SECTORS, "f AS (SELECT industry AS sector_name, day, sum(net_inflow) AS x FROM bars JOIN sectors USING (code) WHERE concept IN ('ASIA', 'EUROPE') GROUP BY 1, 2)") + f"SELECT sector_name, {d()} AS day, {r('x', 2)} AS net_inflow, {r('sum(x) OVER (PARTITION BY sector_name ORDER BY day)', 2)} AS total FROM f")
def sector_flow_series(spark, sf):
    s = views.sectors(spark, sf)
    flows = views.flows(spark, sf).join(s, "code").withColumnRenamed("industry", "sector_name")
    chosen = s.filter(F.col("concept").isin("ASIA", "EUROPE")).select(F.col("industry").alias("sector_name"))
    out = rk.sector_series(flows, chosen)
    return out.select("sector_name", day_text("day").alias("day"), rnd("net_inflow", 2).alias("net_inflow"), rnd("total", 2).alias("total"))


@query(
    "rank_within_source",
    ctes(CHANGES, "s AS (SELECT change_class AS source, code, count(*) AS n FROM changes GROUP BY 1, 2)") + "SELECT source, code, n, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, code) AS INTEGER) AS rank FROM s",
)
def rank_within_source(spark, sf):
    g = views.changes(spark, sf).groupBy(F.col("change_class").alias("source"), "code").agg(F.count(F.lit(1)).alias("n"))
    return level_rank(g, ["source"], "n", "code").select("source", "code", "n", "rank")


_SRC = "src AS (SELECT DISTINCT user_id AS code, event_type || '_' || (event_id % 3) AS source FROM events)"


def _sources(spark, sf):
    e = views.table(spark, sf, "events")
    return e.select(F.col("user_id").alias("code"), F.concat("event_type", F.lit("_"), (F.col("event_id") % 3).cast("string")).alias("source"))


@query("source_consensus", ctes(_SRC) + "SELECT code, count(*) AS source_count, array_to_string(list_sort(list(source)), '|') AS sources FROM src GROUP BY code HAVING count(*) >= 3")
def source_consensus(spark, sf):
    c = rk.consensus_of(_sources(spark, sf), 3)
    return c.select("code", "source_count", F.array_join("sources", "|").alias("sources"))


@query(
    "source_ablation",
    ctes(_SRC, "f AS (SELECT code FROM src GROUP BY code HAVING count(*) >= 3)", "n AS (SELECT DISTINCT source FROM src)")
    + f"SELECT n.source AS removed_source, (SELECT count(*) FROM (SELECT code FROM src s WHERE s.source <> n.source GROUP BY code HAVING count(*) >= 3)) AS remaining, {r('1 - (SELECT count(*) FROM (SELECT code FROM src s WHERE s.source <> n.source GROUP BY code HAVING count(*) >= 3)) / (SELECT count(*) FROM f)', 6)} AS drop_ratio FROM n",
)
def source_ablation(spark, sf):
    a = rk.ablation(_sources(spark, sf), 3)
    return a.select("removed_source", "remaining", rnd("drop_ratio", 6).alias("drop_ratio"))


@query(
    "missing_weekdays",
    f"WITH s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) + CASE WHEN dayofyear(o_orderdate) % 3 = 0 THEN 1 ELSE 0 END AS day FROM orders), e AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM s), (SELECT max(day) FROM s), INTERVAL 1 DAY)) AS DATE) AS day) SELECT {d()} AS day FROM e WHERE isodow(day) < 6 AND day NOT IN (SELECT day FROM s)",
)
def missing_weekdays(spark, sf):
    # every third day of the year moves on by one, which leaves gaps
    day = F.col("o_orderdate").cast("date")
    o = views.table(spark, sf, "orders").select(F.date_add(day, F.when(F.dayofyear(day) % 3 == 0, 1).otherwise(0)).alias("day"))
    return rk.missing_weekdays(o).select(day_text("day").alias("day"))


@query("distinct_dimensions", ctes(CHANGES, _CONCEPT) + "SELECT 'industry' AS dim, industry AS value FROM changes GROUP BY 2 UNION ALL SELECT 'concept', concept FROM cc GROUP BY 2")
def distinct_dimensions(spark, sf):
    c = views.changes(spark, sf)
    ind = c.select(F.lit("industry").alias("dim"), F.col("industry").alias("value")).distinct()
    con = c.select("concept").distinct().select(F.lit("concept").alias("dim"), F.explode(ev.split_concepts("concept")).alias("value")).distinct()
    return ind.unionByName(con)
