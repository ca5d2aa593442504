"""Queries: FIFO, chips, guards, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.dates import day_text
from barloom.functions.numeric import lit, rnd
from barloom.operators import ledger as ol
from barloom.operators import text as ot
from barloom.plans.registry import query
from barloom.plans.sqlkit import BARS, TRADES, ctes, d, r
from barloom.sources import views

FIFO = """s0 AS (SELECT *, sum(CASE side WHEN 'buy' THEN volume ELSE -volume END) OVER (PARTITION BY code ORDER BY seq) AS ss FROM trades),
s1 AS (SELECT *, least(0, min(ss) OVER (PARTITION BY code ORDER BY seq)) AS m, least(0, coalesce(min(ss) OVER (PARTITION BY code ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS m0 FROM s0),
s2 AS (SELECT *, CASE WHEN side = 'sell' THEN volume - (m0 - m) ELSE 0 END AS consumed FROM s1),
s3 AS MATERIALIZED (SELECT *, sum(CASE WHEN side = 'buy' THEN volume ELSE 0 END) OVER (PARTITION BY code ORDER BY seq) AS b1, sum(consumed) OVER (PARTITION BY code ORDER BY seq) AS c1 FROM s2),
sl AS MATERIALIZED (SELECT s.code, s.seq, any_value(s.day) AS day, any_value(s.price) AS price, any_value(s.volume) AS volume, any_value(s.consumed) AS consumed, coalesce(sum((least(b.b1, s.c1) - greatest(b.b1 - b.volume, s.c1 - s.consumed)) * b.price), 0) AS cost
  FROM s3 s LEFT JOIN s3 b ON b.code = s.code AND b.side = 'buy' AND b.b1 > s.c1 - s.consumed AND b.b1 - b.volume < s.c1 AND s.consumed > 0 WHERE s.side = 'sell' GROUP BY s.code, s.seq),
us AS (SELECT code, max(c1) AS u FROM s3 GROUP BY 1),
ps AS (SELECT code, sum(greatest(b1 - greatest(b1 - volume, u), 0)) AS ov, sum(greatest(b1 - greatest(b1 - volume, u), 0) * price) AS oc, sum(volume * price) AS bought FROM s3 JOIN us USING (code) WHERE side = 'buy' GROUP BY 1),
sd AS (SELECT code, coalesce(sum(CASE WHEN consumed >= volume THEN price * volume - cost END), 0) AS rl, sum(cost) AS mc, sum(price * volume) AS sold, count(CASE WHEN consumed < volume THEN 1 END) AS uc FROM sl GROUP BY 1),
fp AS MATERIALIZED (SELECT coalesce(ps.code, sd.code) AS code, coalesce(ov, 0) AS ov, coalesce(oc, 0) AS oc, coalesce(bought, 0) AS bought, coalesce(rl, 0) AS rl, coalesce(mc, 0) AS mc, coalesce(sold, 0) AS sold, coalesce(uc, 0) AS uc FROM ps FULL JOIN sd ON sd.code = ps.code)"""


@query("fifo_positions", ctes(TRADES, FIFO) + f"SELECT code, {r('ov', 2)} AS open_volume, {r('oc', 1)} AS open_cost, {r('CASE WHEN ov > 0 THEN oc / ov ELSE 0 END', 3)} AS avg_cost, {r('rl', 1)} AS realized, {r('mc', 1)} AS matched_cost, uc AS uncovered_sells FROM fp")
def fifo_positions(spark, sf):
    p = ol.fifo_positions(views.trades(spark, sf, dealt=True), dealt=True)
    return p.select("code", rnd("open_volume", 2).alias("open_volume"), rnd("open_cost", 1).alias("open_cost"), rnd("avg_cost", 3).alias("avg_cost"), rnd("realized", 1).alias("realized"), rnd("matched_cost", 1).alias("matched_cost"), "uncovered_sells")


@query("fifo_rows", ctes(TRADES, FIFO) + f"SELECT code, {d()} AS day, {r('price', 3)} AS price, {r('volume', 2)} AS volume, {r('consumed', 2)} AS consumed, {r('cost', 1)} AS cost, CASE WHEN consumed >= volume THEN {r('price * volume - cost', 1)} END AS profit FROM sl")
def fifo_rows(spark, sf):
    s = ol.sell_costs(*ol.lots(views.trades(spark, sf, dealt=True), dealt=True))
    return s.select("code", day_text("day").alias("day"), rnd("price", 3).alias("price"), rnd("volume", 2).alias("volume"), rnd("consumed", 2).alias("consumed"), rnd("cost", 1).alias("cost"), rnd("profit", 1).alias("profit"))


@query("ledger_totals", ctes(TRADES, FIFO) + f"SELECT {r('sum(bought)', 0)} AS bought, {r('sum(sold)', 0)} AS sold, {r('sum(rl)', 0)} AS realized, {r('sum(sold) - sum(mc)', 0)} AS net_of_matched_cost, {r('sum(oc)', 0)} AS open_cost, count(CASE WHEN ov > 0 THEN 1 END) AS open_positions FROM fp")
def ledger_totals(spark, sf):
    t = ol.ledger_totals(ol.fifo_positions(views.trades(spark, sf, dealt=True), dealt=True))
    return t.select(*[rnd(c, 0).alias(c) for c in ("bought", "sold", "realized", "net_of_matched_cost", "open_cost")], "open_positions")


_CHIP = """c0 AS (SELECT *, min(low) OVER (PARTITION BY code) AS mn, CASE WHEN max(high) OVER (PARTITION BY code) = min(low) OVER (PARTITION BY code) THEN min(low) OVER (PARTITION BY code) * 1.001 ELSE max(high) OVER (PARTITION BY code) END AS mx,
  exp(coalesce(sum(ln(1 - greatest(0, least(turnover, 0.98)))) OVER (PARTITION BY code ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS dc FROM bars),
c1 AS (SELECT *, (mx - mn) / 80 AS w, least(high, greatest(low, amount / volume)) AS m, greatest((high - low) * 0.18, high * 1e-6, 1e-6) AS sg, high - low < 1e-9 * greatest(1, high) AS flat FROM c0 WHERE volume > 0),
c2 AS (SELECT *, CASE WHEN flat THEN greatest(0, least(floor(((low + high) / 2 - mn) / w), 79)) ELSE greatest(0, least(floor((low - mn) / w), 79)) END AS i0, CASE WHEN flat THEN greatest(0, least(floor(((low + high) / 2 - mn) / w), 79)) ELSE greatest(0, least(floor((high - mn) / w), 79)) END AS i1 FROM c1),
c3 AS (SELECT code, day, volume * dc AS v, mn, w, low, high, m, sg, flat, i0, i1, CAST(unnest(generate_series(CAST(i0 AS BIGINT), CAST(i1 AS BIGINT))) AS BIGINT) AS bin FROM c2),
c4 AS (SELECT *, CASE WHEN flat THEN 1 WHEN mn + (bin + 0.5) * w < low OR mn + (bin + 0.5) * w > high THEN 0 ELSE exp(-0.5 * power((mn + (bin + 0.5) * w - m) / sg, 2)) END AS x FROM c3),
c5 AS (SELECT *, sum(x) OVER (PARTITION BY code, day) AS sx FROM c4),
c6 AS MATERIALIZED (SELECT code, bin, any_value(mn + (bin + 0.5) * w) AS price, sum(v * CASE WHEN sx > 0 THEN x / sx ELSE 1 / (i1 - i0 + 1) END) AS volume FROM c5 GROUP BY code, bin),
ch AS MATERIALIZED (SELECT *, volume / sum(volume) OVER (PARTITION BY code) AS ratio FROM c6)"""


@query("chip_distribution", ctes(BARS, _CHIP) + f"SELECT code, bin, {r('price', 4)} AS price, {r('volume', 4)} AS volume, {r('ratio', 6)} AS ratio FROM ch")
def chip_distribution(spark, sf):
    return ol.chip_bins(views.bars(spark, sf)).select("code", "bin", rnd("price", 4).alias("price"), rnd("volume", 4).alias("volume"), rnd("ratio", 6).alias("ratio"))


@query(
    "chip_summary",
    ctes(BARS, _CHIP, "lc AS (SELECT code, arg_max(close, day) AS cur, count(*) AS days FROM bars GROUP BY 1)")
    + f"SELECT code, days, {r('cur', 4)} AS current, {r('sum(volume * price) / sum(volume)', 4)} AS avg_cost, {r('sum(CASE WHEN price <= cur THEN volume ELSE 0 END) / sum(volume)', 6)} AS profit_ratio FROM ch JOIN lc USING (code) GROUP BY code, days, cur",
)
def chip_summary(spark, sf):
    b = views.bars(spark, sf)
    s = ol.chip_summary(ol.chip_bins(b), b)
    return s.select("code", "days", rnd("current", 4).alias("current"), rnd("avg_cost", 4).alias("avg_cost"), rnd("profit_ratio", 6).alias("profit_ratio"))


@query("chip_top_bins", ctes(BARS, _CHIP) + f"SELECT code, bin, {r('ratio', 6)} AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ratio DESC, bin) AS k FROM ch) WHERE k <= 5")
def chip_top_bins(spark, sf):
    from barloom.operators.ranking import rank_within

    c = rank_within(ol.chip_bins(views.bars(spark, sf)), ["code"], [F.desc("ratio"), F.col("bin")], "k")
    return c.filter("k <= 5").select("code", "bin", rnd("ratio", 6).alias("ratio"))


@query(
    "frequency_guard",
    """SELECT event_id, count(*) OVER w1 > 1 AS repeat_in_day, count(*) OVER w7 >= 5 AS too_frequent FROM events WINDOW w1 AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECONDS PRECEDING AND CURRENT ROW), w7 AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 604799999999 MICROSECONDS PRECEDING AND CURRENT ROW)""",
)
def frequency_guard(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("user_id").alias("code"), "event_id", "ts")
    return ol.frequency_guard(e).select("event_id", "repeat_in_day", "too_frequent")


@query(
    "limit_up_summary",
    f"""WITH l AS (SELECT user_id AS code, CAST(ts AS DATE) AS day, hour(ts) // 6 AS snapshot, event_id % 5 + 1 AS streak, value AS seal, value * 2 AS heat, event_type = 'error' AS ex FROM events), n AS (SELECT code, day, max(snapshot) AS snapshot FROM l GROUP BY 1, 2)
SELECT code, {d()} AS day, max(streak) AS max_streak, {r('max(seal)', 3)} AS max_seal, {r('max(heat)', 3)} AS max_heat, count(CASE WHEN ex THEN 1 END) AS exploded FROM l JOIN n USING (code, day, snapshot) GROUP BY code, day""",
)
def limit_up_summary(spark, sf):
    e = views.table(spark, sf, "events")
    rows = e.select(F.col("user_id").alias("code"), F.col("ts").cast("date").alias("day"), F.floor(F.hour("ts") / 6).alias("snapshot"), (F.col("event_id") % 5 + 1).alias("streak"), F.col("value").alias("seal_ratio"), (F.col("value") * 2).alias("plate_heat"), (F.col("event_type") == "error").alias("exploded"))
    s = ol.limit_up_summary(rows)
    return s.select("code", day_text("day").alias("day"), "max_streak", rnd("max_seal", 3).alias("max_seal"), rnd("max_heat", 3).alias("max_heat"), "exploded")


@query(
    "recommendation_tracking",
    "WITH p AS (SELECT p_partkey AS code, p_retailprice AS price FROM part), q AS (SELECT o_orderkey, o_custkey AS code, o_totalprice / 200 AS x FROM orders) SELECT o_orderkey, CASE WHEN price IS NULL THEN 'no_price' WHEN price <= x * 0.7 THEN 'loss' WHEN price >= x * 1.6 THEN 'profit' WHEN price BETWEEN x * 0.9 AND x * 1.1 THEN 'buy' ELSE 'between' END AS zone FROM q LEFT JOIN p USING (code)",
)
def recommendation_tracking(spark, sf):
    x = F.col("o_totalprice") / 200
    rec = views.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("code"), (x * lit(0.7)).alias("stop_price"), (x * lit(1.6)).alias("profit_price"), (x * lit(0.9)).alias("buy_min"), (x * lit(1.1)).alias("buy_max"))
    price = views.table(spark, sf, "part").select(F.col("p_partkey").alias("code"), F.col("p_retailprice").alias("price"))
    return ol.track_recommendations(rec, price).select("o_orderkey", "zone")


@query(
    "rebase_thresholds",
    f"""WITH x AS (SELECT o_orderkey AS id, o_totalprice AS cost, o_totalprice * (1 + (o_custkey % 40 - 3) / 3.0::DOUBLE) AS hold, o_totalprice * (1 + (o_custkey % 9 - 4) / 1000.0::DOUBLE) AS now FROM orders), y AS (SELECT *, CASE WHEN hold > 0 AND hold / cost BETWEEN 0.1 AND 10 THEN hold / cost ELSE 1 END AS f, CASE WHEN abs(now / cost - 1) >= 0.005 THEN now / cost ELSE 1 END AS s FROM x)
SELECT id, {r('cost * 0.98::DOUBLE * f', 2)} AS defence_price, {r('cost * 0.95::DOUBLE * f', 2)} AS stop_price, {r('cost * 1.1::DOUBLE * s', 2)} AS alert_price FROM y""",
)
def rebase_thresholds(spark, sf):
    o = views.table(spark, sf, "orders")
    c = F.col("o_totalprice")
    a = o.select(
        F.col("o_orderkey").alias("id"),
        c.alias("cost_price"),
        (c * (lit(1) + (F.col("o_custkey") % 40 - 3) / lit(3))).alias("holding_cost"),
        c.alias("basis_stored"),
        (c * (lit(1) + (F.col("o_custkey") % 9 - 4) / lit(1000))).alias("basis_now"),
        (c * lit(0.98)).alias("defence_price"),
        (c * lit(0.95)).alias("stop_price"),
        (c * lit(1.2)).alias("profit_price"),
        (c * lit(1.1)).alias("alert_price"),
    )
    return ol.rebase_thresholds(a).select("id", *[rnd(x, 2).alias(x) for x in ("defence_price", "stop_price", "alert_price")])


@query(
    "fresh_quotes",
    "SELECT event_id, CAST(ts AS DATE) = CAST(n AS DATE) AND epoch(n) - epoch(ts) BETWEEN -120 AND 180 AS fresh FROM (SELECT event_id, ts, ts + INTERVAL (CAST(value * 10 AS INT) - 200) SECOND AS n FROM events)",
)
def fresh_quotes(spark, sf):
    e = views.table(spark, sf, "events")
    now = F.col("ts") + F.make_interval(secs=F.rint(F.col("value") * 10) - 200)
    return ol.fresh_quotes(e.withColumn("now", now), F.col("now")).select("event_id", "fresh")


# fixed values: a small test lexicon over words of the test texts
LEXICON = [
    ("the", "positive", 1.0), ("le", "positive", 0.5), ("der", "positive", 0.8), ("la", "positive", 0.7),
    ("and", "negative", 1.0), ("que", "negative", 0.6), ("und", "negative", 0.9), ("el", "negative", 0.4),
    ("of", "degree", 2.0), ("les", "degree", 1.5), ("die", "degree", 0.5),
    ("in", "negation", 1.0), ("un", "negation", 1.0), ("on", "negation", 1.0),
]
TRANSITIONS = ("that", "qui", "das", "ou")
_LEX = "lx AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{k}', {x}::DOUBLE)" for w, k, x in LEXICON) + ") t(word, kind, weight))"
_TOK = f"""tk AS (SELECT doc_id, t, CASE WHEN len(p) > 0 THEN list_min(p) ELSE 0 END AS cut FROM (SELECT doc_id, t, list_filter([{', '.join(f"coalesce(list_position(t, '{w}'), 0)" for w in TRANSITIONS)}], lambda x: x > 0) AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '(\\p{{L}}+)', 1) AS t FROM documents))),
wd AS (SELECT doc_id, cut, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS i FROM tk),
w0 AS (SELECT *, CASE WHEN cut > 0 AND i > cut THEN 1 ELSE 0 END AS sg FROM wd WHERE NOT (cut > 0 AND i = cut)),
w1 AS (SELECT *, lag(w) OVER (PARTITION BY doc_id, sg ORDER BY i) AS p, lead(w) OVER (PARTITION BY doc_id, sg ORDER BY i) AS n FROM w0),
w2 AS (SELECT w1.doc_id, sg, a.kind AS wk, a.weight AS ww, b.kind AS pk, b.weight AS pw, c.kind AS nk, c.weight AS nw FROM w1 JOIN lx a ON a.word = w LEFT JOIN lx b ON b.word = p LEFT JOIN lx c ON c.word = n),
w3 AS (SELECT doc_id, sg, CASE WHEN wk = 'positive' THEN CASE WHEN pk = 'negation' THEN -ww WHEN pk = 'degree' THEN ww * pw ELSE ww END WHEN wk = 'negative' THEN CASE WHEN pk = 'negation' THEN ww WHEN pk = 'degree' THEN -ww * pw ELSE -ww END
  WHEN nk IN ('positive', 'negative') THEN CASE WHEN nk = 'positive' THEN 1 ELSE -1 END * nw * CASE WHEN wk = 'degree' THEN ww ELSE -1 END END AS v FROM w2),
ws AS MATERIALIZED (SELECT doc_id, sum(v * CASE WHEN sg = 1 THEN 1.5 ELSE 1 END) AS s, count(CASE WHEN v > 0 THEN 1 END) AS pc, count(CASE WHEN v < 0 THEN 1 END) AS nc FROM w3 WHERE v IS NOT NULL GROUP BY 1),
sn AS MATERIALIZED (SELECT doc_id, coalesce(s, 0) AS s, coalesce(pc, 0) AS pc, coalesce(nc, 0) AS nc FROM documents LEFT JOIN ws USING (doc_id))"""
_LAB = "CASE WHEN {0} > 1 THEN 'positive' WHEN {0} < -1 THEN 'negative' ELSE 'neutral' END"


def _lexicon(spark):
    return spark.createDataFrame(LEXICON, "word string, kind string, weight double")


def _scored(spark, sf):
    return ot.sentiment(views.news(spark, sf), _lexicon(spark), TRANSITIONS)


@query("news_sentiment", ctes(_LEX, _TOK) + f"SELECT doc_id, {r('s', 4)} AS score, pc AS positive_count, nc AS negative_count, {_LAB.format(r('s', 4))} AS label FROM sn")
def news_sentiment(spark, sf):
    s = _scored(spark, sf)
    s = s.withColumn("score", rnd("score", 4))
    return s.select("doc_id", "score", "positive_count", "negative_count", F.when(F.col("score") > 1, "positive").when(F.col("score") < -1, "negative").otherwise("neutral").alias("label"))


@query("corpus_sentiment", ctes(_LEX, _TOK) + f"SELECT {r('sum(s)', 3)} AS score, CAST(sum(pc) AS BIGINT) AS positive_count, CAST(sum(nc) AS BIGINT) AS negative_count, {_LAB.format('sum(s)')} AS label FROM sn")
def corpus_sentiment(spark, sf):
    return ot.corpus_sentiment(_scored(spark, sf)).withColumn("score", rnd("score", 3))


@query(
    "word_frequencies",
    "WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) AS word FROM documents), g AS (SELECT word, count(*) AS n FROM w GROUP BY 1) SELECT word, n, length(word) * 40::DOUBLE AS weight, length(word) * 40::DOUBLE * n AS score FROM g WHERE length(word) * 40 >= 100",
)
def word_frequencies(spark, sf):
    docs = views.news(spark, sf)
    words = docs.select(F.explode(ot.tokens("text")).alias("word")).distinct().withColumn("weight", F.length("word") * lit(40))
    return ot.word_frequencies(docs, words).select("word", "n", "weight", "score")


@query(
    "word_ranking",
    "WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) AS word FROM documents), g AS (SELECT word, count(*) AS n FROM w GROUP BY 1) SELECT word, n FROM g WHERE length(word) * 40 >= 100 ORDER BY n * length(word) DESC, word LIMIT 10",
)
def word_ranking(spark, sf):
    docs = views.news(spark, sf)
    words = docs.select(F.explode(ot.tokens("text")).alias("word")).distinct().withColumn("weight", F.length("word") * lit(40))
    return ot.word_frequencies(docs, words).orderBy(F.desc("score"), "word").limit(10).select("word", "n")
