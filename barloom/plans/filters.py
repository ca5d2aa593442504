"""Queries: codes, predicates, sessions, look-ups, scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from barloom.functions import codes as fc
from barloom.functions import dates as fd
from barloom.functions import events as ev
from barloom.functions.dates import day_text
from barloom.functions.numeric import display_amount, erfc, lit, parse_number, parse_percent, rnd
from barloom.operators import clocks as oc
from barloom.operators import filters as of
from barloom.plans.registry import query
from barloom.plans.sqlkit import BARS, BULL, CHANGES, DOWN, SECTORS, UP, W, ctes, d, r
from barloom.sources import views

_RAW = "CASE p_partkey % 8 WHEN 0 THEN '6' || lpad(p_partkey::VARCHAR, 5, '0') || '.SH' WHEN 1 THEN ' SZ_' || lpad(p_partkey::VARCHAR, 6, '0') WHEN 2 THEN '43' || lpad(p_partkey::VARCHAR, 4, '0') WHEN 3 THEN lpad(p_partkey::VARCHAR, 6, '0') WHEN 4 THEN 'bad' || p_partkey WHEN 5 THEN '688' || lpad(p_partkey::VARCHAR, 3, '0') WHEN 6 THEN '5' || lpad(p_partkey::VARCHAR, 5, '0') || '.xx' ELSE 'sh' || p_partkey END"
_PARTS = f"raw AS (SELECT p_partkey, p_name, {_RAW} AS code FROM part)"


def _raw(spark, sf):
    text = _RAW
    for a in ("lpad(p_partkey::VARCHAR, 5, '0')", "lpad(p_partkey::VARCHAR, 6, '0')", "lpad(p_partkey::VARCHAR, 4, '0')", "lpad(p_partkey::VARCHAR, 3, '0')"):
        text = text.replace(a, a.replace("p_partkey::VARCHAR", "CAST(p_partkey AS STRING)"))
    return views.table(spark, sf, "part").select("p_partkey", "p_name", F.expr(text).alias("code"))


_NORM = """n0 AS (SELECT *, replace(lower(trim(code)), '_', '') AS c FROM raw),
n1 AS (SELECT *, CASE WHEN c LIKE '%.%' THEN CASE WHEN split_part(c, '.', 2) IN ('sh','ss','sz','bj') THEN split_part(c, '.', 2) || split_part(c, '.', 1) ELSE split_part(c, '.', 1) END ELSE c END AS c2 FROM n0),
n2 AS (SELECT *, regexp_replace(c2, '[^0-9]', '', 'g') AS num FROM n1),
norm AS (SELECT p_partkey, code, CASE WHEN length(num) <> 6 THEN '' WHEN left(c2, 2) IN ('sh','sz','bj') THEN left(c2, 2) || num WHEN left(num, 1) IN ('4','8','9') THEN 'bj' || num WHEN left(num, 1) IN ('5','6') THEN 'sh' || num ELSE 'sz' || num END AS normalized FROM n2)"""


@query("normalize_code", ctes(_PARTS, _NORM) + "SELECT p_partkey, code, normalized FROM norm")
def normalize_code(spark, sf):
    return _raw(spark, sf).select("p_partkey", "code", fc.normalize_code("code").alias("normalized"))


@query(
    "code_variants",
    ctes(_PARTS, _NORM, "v AS (SELECT p_partkey, normalized AS c FROM norm WHERE normalized <> '')")
    + "SELECT p_partkey, array_to_string(list_sort(list_distinct([c, upper(c), substr(c, 3), substr(c, 3) || '.' || upper(left(c, 2))])), '|') AS variants FROM v",
)
def code_variants(spark, sf):
    n = _raw(spark, sf).select("p_partkey", fc.normalize_code("code").alias("c")).filter("c <> ''")
    return n.select("p_partkey", F.array_join(fc.code_variants("c"), "|").alias("variants"))


@query(
    "normalize_flow_code",
    ctes(_PARTS, "s AS (SELECT p_partkey, split_part(lower(trim(code || ' - ' || p_name)), ' - ', 1) AS c FROM raw)")
    + """SELECT p_partkey, CASE WHEN length(c) - length(replace(c, '.', '')) = 1 THEN split_part(c, '.', 2) || split_part(c, '.', 1) WHEN left(c, 2) IN ('sh','sz','bj') THEN c WHEN length(c) < 6 THEN c
  WHEN left(right(c, 6), 1) = '6' THEN 'sh' || right(c, 6) WHEN left(right(c, 6), 1) IN ('0','3') THEN 'sz' || right(c, 6) WHEN left(right(c, 6), 1) IN ('8','9') THEN 'bj' || right(c, 6) ELSE c END AS normalized FROM s""",
)
def normalize_flow_code(spark, sf):
    c = F.concat(F.col("code"), F.lit(" - "), F.col("p_name"))
    return _raw(spark, sf).select("p_partkey", fc.normalize_flow_code(c).alias("normalized"))


@query(
    "instrument_traits",
    ctes(_PARTS, _NORM, "x AS (SELECT p_partkey, normalized AS c, substr(normalized, 3) AS b, CASE WHEN p_partkey % 5 = 0 THEN 'ST ' ELSE '' END AS nm FROM norm WHERE normalized <> '')")
    + """SELECT p_partkey, CASE WHEN nm = 'ST ' THEN 0.05 WHEN left(b, 3) IN ('688','300','301') THEN 0.20 WHEN left(b, 1) IN ('4','8') OR left(b, 2) = '92' THEN 0.30 ELSE 0.10 END::DOUBLE AS limit_rate,
  left(b, 1) NOT IN ('1','5') AS stamp_duty, left(b, 2) IN ('15','16','50','51','52','53','56','58') AS listed_fund FROM x""",
)
def instrument_traits(spark, sf):
    n = _raw(spark, sf).select("p_partkey", fc.normalize_code("code").alias("c"), F.when(F.col("p_partkey") % 5 == 0, "ST ").otherwise("").alias("nm")).filter("c <> ''")
    return n.select("p_partkey", fc.price_limit_rate("c", "nm").alias("limit_rate"), fc.pays_stamp_duty("c").alias("stamp_duty"), fc.is_listed_fund("c").alias("listed_fund"))


@query(
    "filter_events",
    ctes(CHANGES) + f"SELECT event_id, code, change_type FROM changes WHERE contains(industry, 'NATION_1') AND change_type IN {UP} AND change_date BETWEEN '2024-01-05' AND '2024-01-20' AND change_time >= '06:00:00' AND volume >= 10 AND amount >= 5 AND contains(concept, 'A')",
)
def filter_events(spark, sf):
    f = of.filter_events(
        views.changes(spark, sf), industry_like="NATION_1", change_types=ev.UP_CODES, date_from="2024-01-05", date_to="2024-01-20", time_from="06:00:00", min_volume=10, min_amount=5.0, concept_like="A", name_like=None
    )
    return f.select("event_id", "code", "change_type")


@query(
    "filter_news",
    "SELECT doc_id, source FROM documents WHERE contains(source, 'the') OR contains(text, 'the')",
)
def filter_news(spark, sf):
    return of.filter_news(views.news(spark, sf), "the", title="source", body="text").select("doc_id", "source")


@query(
    "search_instruments",
    """WITH u AS (SELECT s_suppkey::VARCHAR AS code, s_name AS name, 'supplier' AS master, 0 AS p FROM supplier UNION ALL SELECT c_custkey::VARCHAR, c_name, 'customer', 1 FROM customer UNION ALL SELECT p_partkey::VARCHAR, p_name, 'part', 2 FROM part)
SELECT code, arg_min(name, ROW(p, name)) AS name, arg_min(master, ROW(p, name)) AS master FROM u WHERE contains(lower(code), '7') OR contains(lower(name), '7') GROUP BY code""",
)
def search_instruments(spark, sf):
    s = views.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"))
    c = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"))
    p = views.table(spark, sf, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"))
    return of.search_instruments([("supplier", s), ("customer", c), ("part", p)], "7")


@query(
    "tradable",
    ctes(BARS)
    + f"""SELECT code, {d()} AS day, side, live AND NOT coalesce(pc > 0 AND blocked, false) AS tradable FROM (
  SELECT code, day, 'buy' AS side, open > 0 AND volume > 0 AND low > 0 AS live, lag(close) OVER {W} AS pc, open >= lag(close) OVER {W} * 1.1 * 0.995 - 1e-8 AS blocked FROM bars
  UNION ALL SELECT code, day, 'sell', open > 0 AND volume > 0 AND low > 0, lag(close) OVER {W}, open <= lag(close) OVER {W} * 0.9 * 1.005 + 1e-8 FROM bars)""".replace("* 1.1 *", "* (1 + 0.1::DOUBLE) *").replace("* 0.9 *", "* (1 - 0.1::DOUBLE) *"),
)
def tradable(spark, sf):
    b = views.bars(spark, sf).withColumn("code", F.concat(F.lit("sz1"), F.col("code").cast("string")))
    outs = [of.tradable(b, side, buffer=0.005).select(F.substring("code", 4, 20).cast("long").alias("code"), day_text("day").alias("day"), F.lit(side).alias("side"), "tradable") for side in ("buy", "sell")]
    return outs[0].unionByName(outs[1])


@query(
    "screen_flags",
    ctes(BARS, f"f AS (SELECT *, close > open AS up_bar, close > lag(close) OVER {W} AS rising FROM bars)") + f"SELECT code, {d()} AS day FROM f WHERE up_bar AND rising AND volume >= 30 AND amount < 1000000",
)
def screen_flags(spark, sf):
    b = views.bars(spark, sf)
    from barloom.indicators.rolling import R

    b = b.withColumns({"up_bar": F.col("close") > F.col("open"), "rising": F.col("close") > R.lag("close")})
    return of.screen_flags(b, ["up_bar", "rising"], {"volume": (">=", 30), "amount": ("<", 1000000)}).select("code", day_text("day").alias("day"))


_QUOTES = """q AS (SELECT p_partkey AS code, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_retailprice END AS price, CASE WHEN p_partkey % 8 = 0 THEN 0 ELSE p_retailprice + 1 END AS ask1, CASE WHEN p_partkey % 16 = 0 THEN 0 ELSE p_retailprice - 1 END AS bid1,
  p_retailprice * 0.98::DOUBLE AS pre_close, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_retailprice * 1.02::DOUBLE END AS high, p_retailprice * 0.97::DOUBLE AS low, p_retailprice AS open,
  p_retailprice * 0.9::DOUBLE AS cost_price, CAST(p_size AS DOUBLE) AS cost_volume FROM part)"""


def _quotes(spark, sf):
    p = views.table(spark, sf, "part")
    k, x = F.col("p_partkey"), F.col("p_retailprice")
    return p.select(
        k.alias("code"),
        F.when(k % 4 == 0, lit(0)).otherwise(x).alias("price"),
        F.when(k % 8 == 0, lit(0)).otherwise(x + 1).alias("ask1"),
        F.when(k % 16 == 0, lit(0)).otherwise(x - 1).alias("bid1"),
        (x * lit(0.98)).alias("pre_close"),
        F.when(F.col("p_size") % 3 == 0, lit(0)).otherwise(x * lit(1.02)).alias("high"),
        (x * lit(0.97)).alias("low"),
        x.alias("open"),
        (x * lit(0.9)).alias("cost_price"),
        F.col("p_size").cast("double").alias("cost_volume"),
    )


@query(
    "position_columns",
    ctes(_QUOTES, "x AS (SELECT *, coalesce(nullif(price, 0), nullif(ask1, 0), nullif(bid1, 0), pre_close) AS lp, coalesce(nullif(high, 0), open) AS hi FROM q)")
    + f"""SELECT code, {r('lp', 4)} AS last_price, {r('lp - pre_close', 2)} AS change_value, {r('(lp - pre_close) / pre_close * 100', 3)} AS change_pct, {r('(hi - pre_close) / pre_close * 100', 3)} AS high_pct, {r('(low - pre_close) / pre_close * 100', 3)} AS low_pct,
  {r('(lp - cost_price) / cost_price * 100', 3)} AS profit_pct, {r('(lp - cost_price) * cost_volume', 2)} AS profit_amount, {r('(lp - pre_close) * cost_volume', 2)} AS profit_today FROM x""",
)
def position_columns(spark, sf):
    cols = ("change_value", "change_pct", "high_pct", "low_pct", "profit_pct", "profit_amount", "profit_today")
    return of.position_columns(_quotes(spark, sf)).select("code", rnd("last_price", 4).alias("last_price"), *cols)


@query(
    "latest_price",
    ctes(
        _QUOTES,
        BARS,
        "t AS (SELECT l_partkey AS code, arg_max(l_extendedprice / l_quantity, ROW(CAST(l_shipdate AS DATE), ROW(l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus))) AS tp FROM lineitem GROUP BY 1)",
        "f AS (SELECT code, arg_max(close, day) AS fp FROM bars GROUP BY 1)",
    )
    + f"SELECT p_partkey AS code, {r('coalesce(nullif(q.price, 0), nullif(q.ask1, 0), fp, tp)', 3)} AS latest_price FROM part LEFT JOIN (SELECT * FROM q WHERE code % 3 <> 0) q ON q.code = p_partkey LEFT JOIN f ON f.code = p_partkey LEFT JOIN t ON t.code = p_partkey",
)
def latest_price(spark, sf):
    codes = views.table(spark, sf, "part").select(F.col("p_partkey").alias("code"))
    q = _quotes(spark, sf).filter(F.col("code") % 3 != 0)
    return of.latest_price(codes, q, views.bars(spark, sf), views.trades(spark, sf)).select("code", rnd("latest_price", 3).alias("latest_price"))


_MINUTE = "hour(ts) * 60 + minute(ts)"


@query(
    "on_session",
    f"""SELECT event_id, isodow(ts) < 6 AND ({_MINUTE} BETWEEN 570 AND 690 OR {_MINUTE} BETWEEN 780 AND 900) AS a, isodow(ts) < 6 AND ({_MINUTE} BETWEEN 555 AND 690 OR {_MINUTE} BETWEEN 780 AND 900) AS a_auction,
  isodow(ts) < 6 AND ({_MINUTE} BETWEEN 540 AND 720 OR {_MINUTE} BETWEEN 780 AND 970) AS hk, isodow(ts) < 6 AND {_MINUTE} BETWEEN 240 AND 1200 AS us FROM events""",
)
def on_session(spark, sf):
    e = views.table(spark, sf, "events")
    return e.select("event_id", *[fd.on_session("ts", m).alias(m) for m in fd.SESSIONS])


_HOLIDAYS = (("us", "1995-07-04"), ("us", "1996-12-25"), ("us", "1997-09-01"), ("hk", "1997-07-01"), ("hk", "1996-12-25"), ("a", "1996-10-01"), ("a", "1997-05-01"))


@query(
    "market_sessions",
    f"""WITH o AS (SELECT o_orderkey, o_orderdate + to_minutes(o_orderkey * 7 % 1440) AS u FROM orders),
l AS (SELECT o_orderkey, 'a' AS market, 'a' AS cal, (u AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Shanghai' AS ts FROM o UNION ALL SELECT o_orderkey, 'a_auction', 'a', (u AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Shanghai' FROM o
  UNION ALL SELECT o_orderkey, 'hk', 'hk', (u AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Hong_Kong' FROM o UNION ALL SELECT o_orderkey, 'us', 'us', (u AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' FROM o),
h(cal, day) AS (VALUES {', '.join(f"('{m}', DATE '{x}')" for m, x in _HOLIDAYS)}),
w AS (SELECT o_orderkey, market, CAST(ts AS DATE) AS day, {_MINUTE} AS m FROM l WHERE isodow(ts) < 6 AND NOT EXISTS (SELECT 1 FROM h WHERE h.cal = l.cal AND h.day = CAST(l.ts AS DATE))),
p AS (SELECT *, CASE WHEN market = 'a' AND m BETWEEN 570 AND 690 OR market = 'a_auction' AND m BETWEEN 555 AND 690 OR market = 'hk' AND m BETWEEN 540 AND 720 OR market = 'us' AND m BETWEEN 240 AND 1200 THEN 0
  WHEN market IN ('a', 'a_auction') AND m BETWEEN 780 AND 900 OR market = 'hk' AND m BETWEEN 780 AND 970 THEN 1 END AS part FROM w)
SELECT o_orderkey, market, {d()} AS day, part FROM p WHERE part IS NOT NULL""",
)
def market_sessions(spark, sf):
    """Orders, spread over the minutes of the day, in the sessions of every market."""
    o = views.table(spark, sf, "orders")
    rows = o.select("o_orderkey", (F.col("o_orderdate").cast("timestamp_ntz") + F.make_interval(mins=(F.col("o_orderkey") * 7 % 1440).cast("int"))).alias("ts"))
    holidays = spark.createDataFrame(list(_HOLIDAYS), "market string, day string").withColumn("day", F.to_date("day"))
    out = oc.in_sessions(rows, oc.session_intervals(oc.local_days(rows), holidays))
    return out.select("o_orderkey", "market", day_text("day").alias("day"), "part")


@query(
    "universe_scope",
    ctes(BARS, SECTORS, "g AS (SELECT code FROM sectors WHERE industry IN ('NATION_1', 'NATION_3', 'NATION_5'))") + f"SELECT code, {d()} AS day, {r('close', 3)} AS close FROM bars WHERE code IN (SELECT code FROM g)",
)
def universe_scope(spark, sf):
    group = views.sectors(spark, sf).filter(F.col("industry").isin("NATION_1", "NATION_3", "NATION_5"))
    return of.universe(views.closes(spark, sf), group).select("code", day_text("day").alias("day"), rnd("close", 3).alias("close"))


_SCOPES = ("全部A股", "自选股", "group_2", "stock_7", "snapshot_3", "snapshot_all", "snapshot_404")


@query(
    "named_scopes",
    """WITH sn AS (SELECT dayofmonth(ts) AS id, CASE WHEN dayofmonth(ts) % 5 = 0 THEN 'failed' ELSE 'done' END AS status, max(ts) AS available_at FROM events GROUP BY 1, 2),
it AS (SELECT dayofmonth(ts) AS snapshot_id, user_id AS code, event_id AS source_rank FROM events WHERE value > 60)
SELECT '全部A股' AS scope, s_suppkey AS code, NULL::BIGINT AS place FROM supplier UNION ALL SELECT DISTINCT '自选股', o_custkey % 100, NULL::BIGINT FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT DISTINCT 'group_2', o_custkey % 100, NULL::BIGINT FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 4 = 2 UNION ALL SELECT 'stock_7', s_suppkey, NULL::BIGINT FROM supplier WHERE s_suppkey = 7
UNION ALL SELECT 'snapshot_3', code, min(source_rank) FROM it WHERE snapshot_id = 3 GROUP BY code UNION ALL SELECT 'snapshot_all', code, min(source_rank) FROM it WHERE snapshot_id = (SELECT arg_max(id, available_at) FROM sn WHERE status <> 'failed') GROUP BY code""",
)
def named_scopes(spark, sf):
    e = views.table(spark, sf, "events")
    day = F.dayofmonth("ts").cast("long")
    snapshots = e.groupBy(day.alias("id")).agg(F.max("ts").alias("available_at")).withColumn("status", F.when(F.col("id") % 5 == 0, "failed").otherwise("done"))
    items = e.filter("value > 60").select(day.alias("snapshot_id"), F.col("user_id").alias("code"), F.col("event_id").alias("source_rank"))
    instruments = views.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"))
    followed = views.table(spark, sf, "orders").filter("o_orderkey % 3 = 0").select((F.col("o_custkey") % 100).alias("code"), (F.col("o_custkey") % 4).alias("group"))
    each = [of.scope_codes(s, instruments, followed, snapshots, items).select(F.lit(s).alias("scope"), "code", "place") for s in _SCOPES]
    return reduce(lambda a, b: a.unionByName(b), each)


@query("watch_tag_filter", ctes(SECTORS) + "SELECT code, name FROM sectors WHERE concept = 'ASIA' AND contains(name, '1')")
def watch_tag_filter(spark, sf):
    s = views.sectors(spark, sf)
    return of.watch_tag_filter(s, s.filter("concept = 'ASIA'"), "1").select("code", "name")


_FUNDS = "f AS (SELECT c_custkey AS code, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS nav, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal * 0.99::DOUBLE END AS nav_prev, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal * 1.01::DOUBLE END AS estimate, '2024-01-0' || (c_custkey % 9 + 1) AS nav_date, '2024-01-05 10:00' AS estimate_time FROM customer)"


def _funds(spark, sf):
    c = views.table(spark, sf, "customer")
    k, x = F.col("c_custkey"), F.col("c_acctbal")
    return c.select(
        k.alias("code"),
        F.when(k % 3 != 0, x).alias("nav"),
        F.when(k % 4 != 0, x * lit(0.99)).alias("nav_prev"),
        F.when(k % 5 != 0, x * lit(1.01)).alias("estimate"),
        F.concat(F.lit("2024-01-0"), (k % 9 + 1).cast("string")).alias("nav_date"),
        F.lit("2024-01-05 10:00").alias("estimate_time"),
    )


@query(
    "fund_rates",
    ctes(_FUNDS)
    + f"""SELECT code, CASE WHEN estimate IS NOT NULL AND nav_prev > 0 THEN {r('(estimate - nav_prev) / nav_prev * 100', 2)} WHEN estimate IS NOT NULL AND nav > 0 THEN {r('(estimate - nav) / nav * 100', 2)} END AS estimated_rate,
  CASE WHEN nav_prev > 0 AND nav IS NOT NULL AND nav_date >= '2024-01-05' THEN {r('(nav - nav_prev) / nav_prev * 100', 2)} END AS actual_rate FROM f""",
)
def fund_rates(spark, sf):
    return of.fund_rates(_funds(spark, sf)).select("code", "estimated_rate", "actual_rate")


@query(
    "fill_from_master",
    ctes(_FUNDS) + f"SELECT code, {r('coalesce(nav, c_acctbal * 2)', 2)} AS nav, {r('coalesce(estimate, c_acctbal * 3)', 2)} AS estimate, CASE WHEN code % 2 = 0 THEN c_mktsegment ELSE 'own' END AS segment FROM f JOIN customer ON c_custkey = code",
)
def fill_from_master(spark, sf):
    c = views.table(spark, sf, "customer")
    master = c.select(F.col("c_custkey").alias("code"), (F.col("c_acctbal") * 2).alias("nav"), (F.col("c_acctbal") * 3).alias("estimate"), F.col("c_mktsegment").alias("segment"))
    own = _funds(spark, sf).withColumn("segment", F.when(F.col("code") % 2 == 0, "").otherwise("own"))
    f = of.fill_from_master(own, master, ["nav", "estimate", "segment"])
    return f.select("code", rnd("nav", 2).alias("nav"), rnd("estimate", 2).alias("estimate"), "segment")


@query("auction_rows", "SELECT event_id, CASE WHEN value < 20 THEN '卖盘' ELSE '买盘' END AS side FROM events")
def auction_rows(spark, sf):
    e = views.table(spark, sf, "events").select("event_id", (F.col("value") - 20).alias("flag"))
    return of.auction_rows(e).select("event_id", "side")


@query(
    "number_text",
    f"SELECT c_custkey, {r('c_acctbal', 2)} AS plain, {r('c_acctbal / 100', 4)} AS percent, CASE WHEN c_acctbal >= 1e8 THEN printf('%.2f', {r('c_acctbal / 1e8', 2)}) || '亿' WHEN c_acctbal >= 1e4 THEN printf('%.2f', {r('c_acctbal / 1e4', 2)}) || '万' ELSE printf('%.2f', {r('c_acctbal', 2)}) END AS shown FROM (SELECT c_custkey, c_acctbal * 8 AS c_acctbal FROM customer)",
)
def number_text(spark, sf):
    c = views.table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") * 8).alias("x"))
    plain = F.format_number("x", 2)
    return c.select("c_custkey", rnd(parse_number(plain), 2).alias("plain"), rnd(parse_percent(F.concat(plain, F.lit("%"))), 4).alias("percent"), display_amount("x").alias("shown"))


@query(
    "date_text",
    """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S') AS clock, strftime(ts, '%Y-%m') AS month, isoyear(ts) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS week FROM events""",
)
def date_text(spark, sf):
    e = views.table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyyMMdd")).when(F.col("event_id") % 4 == 2, F.date_format("ts", "yyyy/MM/dd")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    day = fd.parse_day(raw)
    hms = F.hour("ts") * 10000 + F.minute("ts") * 100 + F.second("ts")
    return e.select("event_id", day_text(day).alias("day"), fd.clock_text(hms).alias("clock"), fd.month_key(day).alias("month"), fd.iso_week_key(day).alias("week"))


@query(
    "event_labels",
    ctes(CHANGES, "names AS (SELECT unnest(" + str(list(ev.CHANGE_NAMES)) + ") AS t, unnest(" + str(list(ev.CHANGE_NAMES.values())) + ") AS name)")
    + f"SELECT event_id, n.name AS change_name, CASE WHEN change_type IN {UP} THEN 'up' WHEN change_type IN {DOWN} THEN 'down' ELSE 'other' END AS change_class, change_type IN {BULL} AS bullish FROM changes JOIN names n ON n.t = change_type",
)
def event_labels(spark, sf):
    c = views.changes(spark, sf)
    t = F.col("change_type")
    return c.select("event_id", ev.change_name(t).alias("change_name"), ev.change_class(t).alias("change_class"), t.isin(*ev.BULLISH_CODES).alias("bullish"))


@query(
    "rating_regime",
    """WITH x AS (SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '强烈推荐' WHEN 'BUILDING' THEN '增持' WHEN 'FURNITURE' THEN 'Hold' WHEN 'HOUSEHOLD' THEN 'Strong Buy' ELSE 'x' END AS rating, c_acctbal / 100000 AS ret FROM customer)
SELECT c_custkey, CASE rating WHEN '强烈推荐' THEN 75 WHEN '增持' THEN 65 WHEN 'Hold' THEN 50 WHEN 'Strong Buy' THEN 75 ELSE 45 END::DOUBLE AS score, CASE WHEN ret >= 0.05 THEN '上涨趋势' WHEN ret <= -0.05 THEN '下跌趋势' ELSE '震荡市' END AS regime FROM x""",
)
def rating_regime(spark, sf):
    c = views.table(spark, sf, "customer")
    names = F.create_map(*[F.lit(x) for x in ("AUTOMOBILE", "强烈推荐", "BUILDING", "增持", "FURNITURE", "Hold", "HOUSEHOLD", "Strong Buy")])
    return c.select("c_custkey", ev.rating_score(F.coalesce(names[F.col("c_mktsegment")], F.lit("x"))).alias("score"), ev.market_regime(F.col("c_acctbal") / 100000).alias("regime"))


@query(
    "row_fingerprint",
    "SELECT o_orderkey, sha256('{\"o_custkey\":' || o_custkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS fingerprint FROM orders",
)
def row_fingerprint(spark, sf):
    o = views.table(spark, sf, "orders")
    return o.select("o_orderkey", F.sha2(F.to_json(F.struct("o_custkey", "o_orderstatus")), 256).alias("fingerprint"))


_ERFC = "(t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z))"


@query(
    "normal_tail",
    f"SELECT event_id, {r(f'CASE WHEN x >= 0 THEN {_ERFC} ELSE 2 - {_ERFC} END', 6)} AS erfc FROM (SELECT event_id, x, abs(x) AS z, 1 / (1 + 0.3275911 * abs(x)) AS t FROM (SELECT event_id, (value - 20) / 10 AS x FROM events))",
)
def normal_tail(spark, sf):
    e = views.table(spark, sf, "events")
    return e.select("event_id", rnd(erfc((F.col("value") - 20) / 10), 6).alias("erfc"))
