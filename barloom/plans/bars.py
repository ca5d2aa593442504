"""Queries: sources, sinks, bars and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.dates import day_text
from barloom.functions.numeric import lit, rnd
from barloom.operators import bars as ob
from barloom.operators import filters as fl
from barloom.plans.registry import query
from barloom.plans.sqlkit import BARS, CHANGES, TICKS, W, ctes, d, r
from barloom.sources import readers, sinks, views

OHLC = ("open", "high", "low", "close")


def _round(df, *lead, volume="volume", amount="amount", day="day"):
    cols = [*lead, day_text(day).alias(day)] if day else list(lead)
    out = [rnd(c, 3).alias(c) for c in OHLC] + ([rnd(volume, 2).alias(volume)] if volume else []) + ([rnd(amount, 2).alias(amount)] if amount else [])
    return df.select(*cols, *out)


def _r(prefix="", volume=True, amount=True):
    cols = list(OHLC)
    out = [f"{r(prefix + c, 3)} AS {c}" for c in cols]
    if volume:
        out.append(f"{r(prefix + 'volume', 2)} AS volume")
    if amount:
        out.append(f"{r(prefix + 'amount', 2)} AS amount")
    return ", ".join(out)


@query("bars_daily", ctes(BARS) + f"SELECT code, {d()} AS day, {_r()}, turnover, net_inflow FROM bars")
def bars_daily(spark, sf):
    b = views.bars_flows(spark, sf)
    return b.select("code", day_text("day").alias("day"), *[rnd(c, 3).alias(c) for c in OHLC], rnd("volume", 2).alias("volume"), rnd("amount", 2).alias("amount"), "turnover", "net_inflow")


@query(
    "read_text_bars",
    f"""WITH raw AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS code, strftime(l_shipdate, '%Y/%m/%d') AS day,
    CASE WHEN l_linenumber = 7 THEN '-' ELSE CAST(l_extendedprice AS VARCHAR) END AS open, CAST(l_extendedprice AS VARCHAR) AS high,
    CAST(l_extendedprice AS VARCHAR) AS low, CASE WHEN l_linenumber = 6 THEN 'null' ELSE CAST(l_extendedprice AS VARCHAR) END AS close,
    CASE WHEN l_linenumber = 1 THEN '' ELSE CAST(l_quantity AS VARCHAR) END AS volume, l_discount FROM lineitem)
SELECT code, replace(day, '/', '-') AS day, count(*) AS n, {r('sum(CAST(open AS DOUBLE))', 2)} AS open_sum,
  {r("sum(CASE WHEN volume = '' THEN 0 ELSE CAST(volume AS DOUBLE) END)", 2)} AS volume_sum, {r('sum(l_discount)', 6)} AS turnover_sum
FROM raw WHERE open <> '-' AND close <> 'null' GROUP BY 1, 2""",
)
def read_text_bars(spark, sf):
    li = views.table(spark, sf, "lineitem")
    price = F.col("l_extendedprice").cast("string")
    raw = li.select(
        F.col("l_suppkey").cast("string").alias("code"),
        F.date_format("l_shipdate", "yyyy/MM/dd").alias("day"),
        F.when(F.col("l_linenumber") == 7, "-").otherwise(price).alias("open"),
        price.alias("high"),
        price.alias("low"),
        F.when(F.col("l_linenumber") == 6, "null").otherwise(price).alias("close"),
        F.when(F.col("l_linenumber") == 1, "").otherwise(F.col("l_quantity").cast("string")).alias("volume"),
        F.lit("-").alias("amount"),
        F.concat((F.col("l_discount") * 100).cast("string"), F.lit("%")).alias("turnover"),
    )
    b = readers.clean_bars(raw)
    g = b.groupBy("code", day_text("day").alias("day"))
    return g.agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("open"), 2).alias("open_sum"), rnd(F.sum("volume"), 2).alias("volume_sum"), rnd(F.sum("turnover"), 6).alias("turnover_sum"))


@query(
    "bars_from_ticks",
    ctes(TICKS)
    + f"""SELECT code, strftime(bar, '%Y-%m-%d %H:%M:%S') AS bar, {_r()} FROM (
  SELECT code, date_trunc('hour', ts) AS bar, arg_min(price, ROW(ts, event_id)) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, ROW(ts, event_id)) AS close, sum(volume) AS volume, sum(price * volume) AS amount FROM ticks GROUP BY 1, 2)""",
)
def bars_from_ticks(spark, sf):
    b = ob.bars_from_ticks(views.ticks(spark, sf))
    return _round(b, "code", F.date_format("bar", "yyyy-MM-dd HH:mm:ss").alias("bar"), day=None)


_QL = """CASE p_partkey % 4 WHEN 0 THEN 'var hq_str_sh' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '="' || p_name || ',1.5,2.5,' || CAST(p_retailprice AS VARCHAR) || ',4.5,0.5,x,y,' || p_size || ',77' || repeat(',0', 20) || ',2024-01-02,09:31:00,00";'
 WHEN 1 THEN 'var hq_str_hk' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || '="' || 'EN,' || p_name || ',1.5,2.5,4.5,0.5,' || CAST(p_retailprice AS VARCHAR) || ',0,0,0,0,77,' || p_size || ',0,0,0,0,2024/01/02,09:31";'
 WHEN 2 THEN 'var hq_str_gb_x' || p_partkey || '="' || p_name || ',' || CAST(p_retailprice AS VARCHAR) || ',-1,2024-01-02 09:31:00,0,1.5,4.5,0.5,0,0,' || p_size || repeat(',0', 15) || ',2.5' || repeat(',0', 9) || '";'
 ELSE 'var hq_str_sz' || p_partkey || '="' || p_name || ',1,2,3";' END"""


@query(
    "parse_quote_lines",
    """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'sh' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') WHEN 1 THEN 'hk' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') ELSE 'gb_x' || p_partkey END AS code,
  p_name AS name, p_retailprice AS price, 2.5::DOUBLE AS pre_close, 4.5::DOUBLE AS high, CAST(p_size AS DOUBLE) AS volume, '2024-01-02' AS quote_date FROM part WHERE p_partkey % 4 <> 3""",
)
def parse_quote_lines(spark, sf):
    p = views.table(spark, sf, "part")
    lines = p.select(F.col("p_partkey").alias("id"), F.expr(_QL.replace("VARCHAR", "STRING")).alias("line"))
    good, _bad = readers.parse_quote_lines(lines)
    return good.select("id", "code", "name", "price", "pre_close", "high", "volume", "quote_date")


@query(
    "parse_quote_rejects",
    "SELECT p_partkey AS id FROM part WHERE p_partkey % 4 = 3",
)
def parse_quote_rejects(spark, sf):
    p = views.table(spark, sf, "part")
    return readers.parse_quote_lines(p.select(F.col("p_partkey").alias("id"), F.expr(_QL.replace("VARCHAR", "STRING")).alias("line")))[1].select("id")


# levels as text: quotes of the home market in both layouts; every third lacks its best levels, every fifth its price
_P = "CAST(p_partkey AS VARCHAR)"
_BID = [f"CAST(p_size + {20 - k} AS VARCHAR)" for k in range(5)]
_ASK = [f"CAST(p_size + {21 + k} AS VARCHAR)" for k in range(5)]
_VOL = [f"CAST(p_partkey % {7 + k} * 100 AS VARCHAR)" for k in range(10)]
_DROP = "CASE WHEN p_partkey % 3 = 0 THEN '0' ELSE {} END"
_PRICE = "CASE WHEN p_partkey % 5 = 0 THEN '0.00' ELSE CAST(p_size + 20.5 AS VARCHAR) END"
_B = [(_DROP.format(p) if k == 0 else p, v) for k, (p, v) in enumerate(zip(_BID, _VOL[:5], strict=True))]
_A = [(_DROP.format(p) if k == 0 else p, v) for k, (p, v) in enumerate(zip(_ASK, _VOL[5:], strict=True))]
_COMMA = f"'var hq_str_sz' || lpad({_P}, 6, '0') || '=\"' || p_name || ',1.5,2.5,' || {_PRICE} || ',4.5,0.5,x,y,1,77,' || " + " || ',' || ".join(x for p, v in [*_B, *_A] for x in (v, p)) + " || ',2024-01-02,09:31:00,00\";'"
_TILDE = f"'v_sh' || lpad({_P}, 6, '0') || '=\"1~' || p_name || '~' || {_P} || '~' || {_PRICE} || '~2.5~1.5~0~0~0~' || " + " || '~' || ".join(x for pv in [*_B, *_A] for x in pv) + " || '~~20240102093100~0~0~4.5~0.5\";'"


def _book_lines(spark, sf):
    p = views.table(spark, sf, "part")
    pick = lambda text: p.select(F.col("p_partkey").alias("id"), F.expr(text.replace("VARCHAR", "STRING").replace("p_size + 20.5", "p_size + 20.5D")).alias("line"), "p_partkey")
    comma, _ = readers.parse_quote_lines(pick(_COMMA).filter("p_partkey % 2 = 0").drop("p_partkey"))
    tilde, _ = readers.parse_tilde_quotes(pick(_TILDE).filter("p_partkey % 2 = 1").drop("p_partkey"))
    same = ["id", "code", "name", "price", "quote_date", "bids", "asks"]
    return readers.book_columns(comma.select(*same).unionByName(tilde.select(*same)))


_BOOK_SQL = """bk AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'sz' ELSE 'sh' END || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS code, p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size + 20.5 END::DOUBLE AS price,
  (CASE WHEN p_partkey % 3 = 0 THEN p_size + 19 ELSE p_size + 20 END)::DOUBLE AS bid1, (CASE WHEN p_partkey % 3 = 0 THEN p_size + 22 ELSE p_size + 21 END)::DOUBLE AS ask1,
  (CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 7 END + p_partkey % 8 + p_partkey % 9 + p_partkey % 10 + p_partkey % 11) * 100::DOUBLE AS bd,
  (CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 12 END + p_partkey % 13 + p_partkey % 14 + p_partkey % 15 + p_partkey % 16) * 100::DOUBLE AS ad FROM part)"""


@query("quote_levels", f"WITH {_BOOK_SQL} SELECT id, code, name, price, '2024-01-02' AS quote_date, bid1, ask1, bd AS bid_depth, ad AS ask_depth, ask1 - bid1 AS spread, {r('CASE WHEN bd + ad > 0 THEN (bd - ad) / (bd + ad) ELSE 0 END', 6)} AS imbalance FROM bk")
def quote_levels(spark, sf):
    q = _book_lines(spark, sf)
    return q.select("id", "code", "name", "price", "quote_date", "bid1", "ask1", "bid_depth", "ask_depth", "spread", rnd("imbalance", 6).alias("imbalance"))


@query("latest_price_from_text", f"WITH {_BOOK_SQL} SELECT id AS code, {r('coalesce(nullif(price, 0), nullif(ask1, 0))', 3)} AS latest_price FROM bk")
def latest_price_from_text(spark, sf):
    """The ask of the parsed levels stands in where a quote line has no price."""
    q = _book_lines(spark, sf).select(F.col("id").alias("code"), "price", "ask1")
    none = views.closes(spark, sf)
    trades = views.trades(spark, sf)
    return fl.latest_price(q.select("code"), q, none, trades).select("code", rnd("latest_price", 3).alias("latest_price"))


@query(
    "parse_change_items",
    ctes(CHANGES)
    + f"""SELECT event_id, change_type,
  CASE WHEN change_type IN (4,8,16,32,8213,8214) THEN CAST(volume AS DOUBLE) ELSE amount END AS price,
  {r('CASE WHEN change_type IN (8201,8202,8203,8204,8207,8208,8209,8210,8215,8216) THEN volume WHEN change_type IN (4,8) THEN 12345.6 WHEN change_type IN (16,32) THEN amount ELSE -0.028947 END * 100', 3)} AS rate,
  CAST(CASE WHEN change_type IN (4,8) THEN coalesce(try_cast(CASE WHEN amount = floor(amount) THEN NULL END AS BIGINT), 0) WHEN change_type IN (8201,8202,8203,8204,8207,8208,8209,8210,8215,8216,16,32,8213,8214) THEN 0 ELSE volume END AS BIGINT) AS volume,
  CASE WHEN change_type IN (4,8,8201,8202,8203,8204,8207,8208,8209,8210,8215,8216,16,32,8213,8214) THEN 0::DOUBLE ELSE 12345.6::DOUBLE END AS amount FROM changes""",
)
def parse_change_items(spark, sf):
    c = views.changes(spark, sf)
    payload = F.concat_ws(",", F.col("volume").cast("string"), F.format_string("%.2f", "amount"), F.lit("-0.028947"), F.lit("12345.60"))
    raw = c.select("event_id", "change_type", payload.alias("payload"))
    p = readers.parse_change_items(raw)
    return p.select("event_id", "change_type", "price", rnd("rate", 3).alias("rate"), "volume", "amount")


@query(
    "parse_flow_lines",
    ctes(BARS)
    + f"""SELECT code, {d()} AS day, net_inflow AS main, {r('close', 2)} AS close, {r('-net_inflow', 2)} AS small, CAST(NULL AS DOUBLE) AS change_pct FROM bars""",
)
def parse_flow_lines(spark, sf):
    b = views.bars_flows(spark, sf)
    line = F.concat_ws(
        ",",
        day_text("day"),
        F.format_string("%.2f", "net_inflow"),
        F.format_string("%.2f", -F.col("net_inflow")),
        *[F.lit("0")] * 8,
        rnd("close", 2).cast("string"),
        F.lit("-"),
    )
    p = readers.parse_delimited_flow(b.select("code", line.alias("line")))
    return p.select("code", "day", "main", "close", rnd("small", 2).alias("small"), "change_pct")


@query(
    "first_non_empty_source",
    ctes(BARS)
    + f"""SELECT code, {d()} AS day, {r('close', 3)} AS close, CASE WHEN code % 3 = 0 THEN 'primary' ELSE 'fallback' END AS source FROM bars""",
)
def first_non_empty_source(spark, sf):
    b = views.bars(spark, sf).select("code", "day", "close")
    out = readers.first_non_empty_source([("primary", b.filter(F.col("code") % 3 == 0)), ("fallback", b)])
    return out.select("code", day_text("day").alias("day"), rnd("close", 3).alias("close"), "source")


@query(
    "upsert",
    ctes(BARS)
    + f"""SELECT code, {d()} AS day, CASE WHEN code % 2 = 0 THEN {r('close * 2', 3)} ELSE {r('close', 3)} END AS close FROM bars""",
)
def upsert(spark, sf):
    b = views.bars(spark, sf).select("code", "day", "close")
    out = sinks.upsert(b, b.filter(F.col("code") % 2 == 0).withColumn("close", F.col("close") * lit(2)), ["code", "day"])
    return out.select("code", day_text("day").alias("day"), rnd("close", 3).alias("close"))


@query(
    "insert_ignore",
    """SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'A' AND NOT EXISTS
     (SELECT 1 FROM lineitem x WHERE x.l_returnflag = 'A' AND x.l_orderkey = lineitem.l_orderkey AND x.l_linenumber = lineitem.l_linenumber)""",
)
def insert_ignore(spark, sf):
    li = views.table(spark, sf, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    return sinks.insert_ignore(li.filter("l_returnflag = 'A'"), li.filter("l_returnflag <> 'A'"), keys).select(*keys)


@query(
    "merge_money_flow",
    ctes(BARS, "x AS (SELECT *, code % 3 <> 0 AS has_a, code % 4 <> 0 AS has_b, code % 5 AS s FROM bars)")
    + f"""SELECT code, {d()} AS day,
  {r("CASE WHEN NOT has_b THEN amount WHEN has_a AND s IN (0, 1) THEN amount ELSE net_inflow END", 2)} AS main_net1,
  {r("CASE WHEN NOT has_b THEN volume WHEN has_a AND s IN (2, 3) THEN volume ELSE volume * 3 END", 2)} AS mac_main_net1,
  {r("CASE WHEN NOT has_b THEN turnover WHEN has_a AND s IN (0, 1, 2, 3) THEN turnover ELSE turnover * 2 END", 6)} AS northbound,
  CASE WHEN NOT has_b THEN 'eastmoney+other' WHEN NOT has_a THEN CASE WHEN s < 2 THEN 'tdx_mac' WHEN s < 4 THEN 'eastmoney' ELSE 'manual' END
       WHEN s < 2 THEN 'eastmoney+other+tdx_mac' WHEN s < 4 THEN 'eastmoney+other' ELSE 'manual' END AS source
FROM x WHERE has_a OR has_b""",
)
def merge_money_flow(spark, sf):
    b = views.bars_flows(spark, sf)
    src = F.when(F.col("code") % 5 < 2, "tdx_mac").when(F.col("code") % 5 < 4, "eastmoney").otherwise("manual")

    def shape(df, main, mac, north, source):
        return df.select("code", "day", main.alias("main_net1"), mac.alias("mac_main_net1"), north.alias("northbound"), source.alias("source"))

    a = shape(b.filter(F.col("code") % 3 != 0), F.col("amount"), F.col("volume"), F.col("turnover"), F.lit("eastmoney+other"))
    n = shape(b.filter(F.col("code") % 4 != 0), F.col("net_inflow"), F.col("volume") * lit(3), F.col("turnover") * lit(2), src)
    out = sinks.merge_money_flow(a, n)
    return out.select("code", day_text("day").alias("day"), rnd("main_net1", 2).alias("main_net1"), rnd("mac_main_net1", 2).alias("mac_main_net1"), rnd("northbound", 6).alias("northbound"), "source")


@query("retention", ctes(BARS) + f"SELECT code, {d()} AS day, {r('close', 3)} AS close FROM bars WHERE day >= DATE '2000-06-01'")
def retention(spark, sf):
    b = sinks.retention(views.bars(spark, sf), "day", "2000-06-01")
    return b.select("code", day_text("day").alias("day"), rnd("close", 3).alias("close"))


@query(
    "normalize_bars",
    f"""SELECT code, {d()} AS day, {r('price', 3)} AS price FROM (
  SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS day, l_extendedprice / l_quantity AS price,
    row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1 AND day <> DATE '2001-11-04'""",
)
def normalize_bars(spark, sf):
    li = views.table(spark, sf, "lineitem")
    raw = li.select(
        F.col("l_suppkey").alias("code"),
        F.col("l_shipdate").cast("date").alias("day"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        "l_quantity",
    )
    order = [-F.col("l_orderkey"), -F.col("l_linenumber"), -F.col("l_extendedprice"), -F.col("l_quantity")]
    n = ob.normalize_bars(raw, order, now_day="2001-11-04", now_minute=14 * 60)
    return n.select("code", day_text("day").alias("day"), rnd("price", 3).alias("price"))


@query(
    "merge_pages",
    ctes(BARS) + f"SELECT code, {d()} AS day, CASE WHEN day < DATE '1999-01-01' THEN {r('close', 3)} ELSE {r('close * 2', 3)} END AS close FROM bars",
)
def merge_pages(spark, sf):
    b = views.bars(spark, sf).select("code", "day", "close")
    m = ob.merge_pages(b.filter("day < '1999-01-01'"), b.filter("day >= '1998-01-01'").withColumn("close", F.col("close") * lit(2)))
    return m.select("code", day_text("day").alias("day"), rnd("close", 3).alias("close"))


@query(
    "refresh_tail",
    ctes(BARS) + f"SELECT code, {d()} AS day, CASE WHEN day >= DATE '1999-01-01' AND code % 2 = 0 THEN {r('close * 2', 3)} ELSE {r('close', 3)} END AS close FROM bars",
)
def refresh_tail(spark, sf):
    b = views.bars(spark, sf).select("code", "day", "close")
    m = ob.refresh_tail(b, b.filter("day >= '1999-01-01' AND code % 2 = 0").withColumn("close", F.col("close") * lit(2)))
    return m.select("code", day_text("day").alias("day"), rnd("close", 3).alias("close"))


@query(
    "append_live_bar",
    ctes(
        BARS,
        "q AS (SELECT code, last_day(max(day)) AS day, arg_max(close, day) AS pc, arg_max(open, day) AS o, arg_max(high, day) AS h, arg_max(low, day) AS l, arg_max(volume, day) AS v FROM bars GROUP BY code)",
        f"m AS (SELECT code, strftime(day, '%Y-%m') AS month, max(day) AS day, arg_max(close, day) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2)",
    )
    + f"""SELECT code, month, {r('close', 2)} AS close, {r('volume', 0)} AS volume, CAST(NULL AS DOUBLE) AS change_pct FROM m
  WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.code = m.code AND strftime(q.day, '%Y-%m') = m.month)
UNION ALL SELECT code, strftime(day, '%Y-%m'), {r('pc * 1.01', 2)}, {r('v / 100', 0)}, {r('(pc * 1.01 - pc) / pc * 100', 2)} FROM q""",
)
def append_live_bar(spark, sf):
    b = views.bars(spark, sf)
    last = b.groupBy("code").agg(F.max_by(F.struct("open", "high", "low", "close", "volume", "amount"), "day").alias("x"), F.last_day(F.max("day")).alias("day"))
    quotes = last.select("code", "day", "x.open", "x.high", "x.low", (F.col("x.close") * lit(1.01)).alias("price"), F.col("x.close").alias("pre_close"), "x.volume", "x.amount")
    out = ob.append_live_bar(ob.resample_month(b), quotes, "month")
    return out.select("code", F.date_format("day", "yyyy-MM").alias("month"), rnd("close", 2).alias("close"), rnd("volume", 0).alias("volume"), "change_pct")


@query(
    "resample_every_n",
    ctes(BARS, f"g AS (SELECT *, (row_number() OVER {W} - 1) // 5 AS chunk FROM bars)")
    + f"""SELECT code, chunk, {d('max(day)')} AS day, {r('arg_min(open, day)', 3)} AS open, {r('max(high)', 3)} AS high, {r('min(low)', 3)} AS low,
  {r('arg_max(close, day)', 3)} AS close, {r('sum(volume)', 2)} AS volume, {r('sum(amount)', 2)} AS amount, arg_max(turnover, day) AS turnover FROM g GROUP BY code, chunk""",
)
def resample_every_n(spark, sf):
    g = ob.resample_every(views.bars(spark, sf), 5)
    return _round(g, "code", "chunk", "turnover")


@query(
    "resample_month",
    ctes(BARS)
    + f"""SELECT code, strftime(day, '%Y-%m') AS month, {d('max(day)')} AS day, {r('arg_min(open, day)', 3)} AS open, {r('max(high)', 3)} AS high, {r('min(low)', 3)} AS low,
  {r('arg_max(close, day)', 3)} AS close, {r('sum(volume)', 2)} AS volume, {r('sum(amount)', 2)} AS amount FROM bars GROUP BY 1, 2""",
)
def resample_month(spark, sf):
    return _round(ob.resample_month(views.bars(spark, sf)), "code", "month")


def _nav_sql(key):
    return (
        ctes(BARS)
        + f"""SELECT code, {key} AS period, {d('min(day)')} AS day, {r('arg_min(open, day)', 3)} AS open, {r('max(high)', 3)} AS high, {r('least(arg_min(low, day), min(CASE WHEN low <> 0 THEN low END))', 3)} AS low,
  {r('arg_max(close, day)', 3)} AS close, {r('arg_min(volume, day)', 2)} AS volume, {r('arg_min(amount, day)', 2)} AS amount FROM bars GROUP BY 1, 2"""
    )


@query("resample_week_nav", _nav_sql("isoyear(day) || '-W' || lpad(CAST(week(day) AS VARCHAR), 2, '0')"))
def resample_week_nav(spark, sf):
    return _round(ob.resample_nav(views.bars(spark, sf)), "code", "period")


@query("resample_week_nav_split", _nav_sql("year(day) || '-W' || lpad(CAST(week(day) AS VARCHAR), 2, '0')"))
def resample_week_nav_split(spark, sf):
    return _round(ob.resample_nav(views.bars(spark, sf), compat_split=True), "code", "period")


@query("resample_month_nav", _nav_sql("strftime(day, '%Y-%m')"))
def resample_month_nav(spark, sf):
    return _round(ob.resample_nav(views.bars(spark, sf), "month"), "code", "period")


_CAL = """cal AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders)),
flag AS (SELECT day, isodow(day) < 6 AND strftime(day, '%m-%d') NOT IN ('01-01', '05-01', '10-01') AS is_trading FROM cal)"""


def _calendar(spark, sf):
    days = views.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    hol = span.filter(F.date_format("day", "MM-dd").isin("01-01", "05-01", "10-01"))
    return ob.trading_calendar(days, hol)


@query("trading_calendar", "WITH " + _CAL.replace("NOT IN ('01-01', '05-01', '10-01') AS is_trading FROM cal", "NOT IN ('01-01', '05-01', '10-01') AS is_trading FROM cal") + f" SELECT {d()} AS day, is_trading FROM flag")
def trading_calendar(spark, sf):
    return _calendar(spark, sf).select(day_text("day").alias("day"), "is_trading")


@query(
    "latest_trading_day",
    f"""WITH cal AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM events)),
f AS (SELECT day, isodow(day) < 6 AS t FROM cal),
w AS (SELECT day, t, max(CASE WHEN t THEN day END) OVER (ORDER BY day) AS upto, max(CASE WHEN t THEN day END) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f)
SELECT event_id, {d('CASE WHEN t AND hour(ts) * 60 + minute(ts) < 901 THEN before ELSE upto END')} AS latest_day FROM events JOIN w ON w.day = CAST(ts AS DATE)""",
)
def latest_trading_day(spark, sf):
    e = views.table(spark, sf, "events").select("event_id", "ts")
    cal = ob.trading_calendar(e.select(F.col("ts").cast("date").alias("day")))
    return ob.latest_trading_day(cal, e).select("event_id", day_text("latest_day").alias("latest_day"))
