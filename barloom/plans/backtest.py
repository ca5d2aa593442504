"""Queries: backtest, metrics, risk, decisions, data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.dates import day_text
from barloom.functions.numeric import lit, rnd
from barloom.operators import backtest as bt
from barloom.operators import decisions as de
from barloom.operators import extremes as ex
from barloom.operators import features as of
from barloom.operators import filters as fl
from barloom.operators import stability as stb
from barloom.plans.features import RULE, feature_sql, features, rule_sql, stored_features, traded_columns
from barloom.plans.registry import query
from barloom.plans.sqlkit import BARS, SECTORS, W, ctes, d, lag, r
from barloom.sources import views
from barloom.sources.sinks import materialized

H = RULE["max_hold"]
CASH = 1e8
RULE_B = {**RULE, "entry": [{"indicator": "rsi6", "op": "<", "value": 35.0}], "exit": [{"indicator": "rsi6", "op": ">", "value": 60.0}]}


def _live_sql(src: str, name: str = "lv") -> str:
    return f"""{name} AS MATERIALIZED (SELECT *, row_number() OVER {W} AS ix, NOT coalesce({lag('close')} > 0 AND open >= {lag('close')} * (1 + CASE WHEN left(code::VARCHAR, 3) IN ('688','300','301') THEN 0.20 WHEN left(code::VARCHAR, 1) IN ('4','8') OR left(code::VARCHAR, 2) = '92' THEN 0.30 ELSE 0.10 END::DOUBLE) - 1e-8, false) AND volume > 0 AS tradable FROM {src})"""


def _trade_sql(src: str = "lv", name: str = "tr", stop: float = 0.08, gain: float = 0.2) -> str:
    return f"""{name}_h AS (SELECT s.code, s.day AS signal_day, e.day AS buy_day, e.open AS ep, e.volume AS ev, b.ix - e.ix AS j, b.day AS bd, b.open AS bo, b.low AS bl, b.high AS bh, b.close AS bc, b.exit_matched AS bx, n.day AS nd, n.open AS no
  FROM {src} s JOIN {src} e ON e.code = s.code AND e.ix = s.ix + 1 AND e.tradable JOIN {src} b ON b.code = s.code AND b.ix BETWEEN e.ix + 1 AND e.ix + {H} LEFT JOIN {src} n ON n.code = s.code AND n.ix = b.ix + 1 WHERE s.entry_matched),
{name}_o AS (SELECT *, CASE WHEN bl <= ep * (1 - {stop}::DOUBLE) THEN 'stop_loss' WHEN bh >= ep * (1 + {gain}::DOUBLE) THEN 'stop_gain' WHEN bx THEN CASE WHEN nd IS NOT NULL THEN 'exit_condition' END WHEN j >= {H} THEN 'max_hold_days' END AS reason FROM {name}_h),
{name}_p AS (SELECT *, row_number() OVER (PARTITION BY code, signal_day ORDER BY j) AS rn FROM {name}_o WHERE reason IS NOT NULL),
{name} AS MATERIALIZED (SELECT code, signal_day, buy_day, CASE WHEN reason = 'exit_condition' THEN nd ELSE bd END AS sell_day, ep AS buy_price,
  CASE reason WHEN 'stop_loss' THEN least(bo, ep * (1 - {stop}::DOUBLE)) WHEN 'stop_gain' THEN greatest(bo, ep * (1 + {gain}::DOUBLE)) WHEN 'exit_condition' THEN no ELSE bc END AS sell_price, reason, CAST(CASE WHEN reason = 'exit_condition' THEN j + 1 ELSE j END AS INTEGER) AS hold_days, ev AS buy_volume FROM {name}_p WHERE rn = 1)"""


TRADES_SQL = [rule_sql(), _live_sql("sig"), _trade_sql(), "trr AS (SELECT *, sell_price / buy_price - 1 AS return_rate FROM tr)"]


def trades(spark, sf, rule=RULE, f=None):
    m = of.match_rule(features(spark, sf) if f is None else f, rule)
    return bt.barrier_trades(fl.tradable(m, "buy"), rule["stop_loss"], rule["stop_gain"], rule["max_hold"])


@query("barrier_backtest", feature_sql(f"SELECT code, {d('signal_day')} AS signal_day, {d('buy_day')} AS buy_day, {d('sell_day')} AS sell_day, {r('buy_price', 3)} AS buy_price, {r('sell_price', 3)} AS sell_price, reason, hold_days, {r('return_rate', 6)} AS return_rate FROM trr", *TRADES_SQL))
def barrier_backtest(spark, sf):
    t = trades(spark, sf)
    return t.select("code", *[day_text(c).alias(c) for c in ("signal_day", "buy_day", "sell_day")], rnd("buy_price", 3).alias("buy_price"), rnd("sell_price", 3).alias("sell_price"), "reason", "hold_days", rnd("return_rate", 6).alias("return_rate"))


def _cost_sql(slip="0.0015::DOUBLE", src="trr", name="cs", extra=""):
    return f"""{name}0 AS (SELECT *{extra}, CASE WHEN floor(buy_volume * 5 / 100) * 100 > 0 THEN least(floor({CASH} / buy_price / 100) * 100, floor(buy_volume * 5 / 100) * 100) ELSE floor({CASH} / buy_price / 100) * 100 END AS q FROM {src}),
{name} AS MATERIALIZED (SELECT *, buy_price * q AS b, sell_price * q AS s, greatest(buy_price * q * 0.0003, 5) + greatest(sell_price * q * 0.0003, 5) + CASE WHEN left(code::VARCHAR, 1) IN ('1','5') THEN 0 ELSE sell_price * q * 0.0005 END AS fees,
  (buy_price * q + sell_price * q) * ({slip} + least(0.002 * sqrt(q / (buy_volume * 100)), 0.02)) AS sc FROM {name}0 WHERE q > 0)"""


@query("trade_costs", feature_sql(f"SELECT code, {d('signal_day')} AS signal_day, {r('q', 0)} AS quantity, {r('fees', 1)} AS fees, {r('sc', 1)} AS slippage_cost, {r('s - b', 1)} AS pnl, {r('(s - b - fees - sc) / b', 6)} AS net_return FROM cs", *TRADES_SQL, _cost_sql()))
def trade_costs(spark, sf):
    t = bt.trade_costs(trades(spark, sf), CASH)
    return t.select("code", day_text("signal_day").alias("signal_day"), rnd("quantity", 0).alias("quantity"), *[rnd(c, 1).alias(c) for c in ("fees", "slippage_cost", "pnl")], rnd("net_return", 6).alias("net_return"))


@query("cost_stress", feature_sql(f"SELECT scenario, count(*) AS trades, {r('avg((s - b - fees - sc) / b)', 6)} AS avg_return FROM cs GROUP BY scenario", *TRADES_SQL, "st AS (SELECT trr.*, x.scenario, x.slip FROM trr, (VALUES ('base', 0.0015::DOUBLE), ('slippage_1_5x', 0.0015::DOUBLE * 1.5), ('slippage_2x', 0.0015::DOUBLE * 2)) x(scenario, slip))", _cost_sql("slip", "st")))
def cost_stress(spark, sf):
    return bt.cost_stress(trades(spark, sf), CASH).select("scenario", "trades", rnd("avg_return", 6).alias("avg_return"))


@query("lookahead_check", feature_sql("SELECT count(*) AS violations FROM trr WHERE NOT (signal_day < buy_day AND buy_day < sell_day)", *TRADES_SQL))
def lookahead_check(spark, sf):
    return bt.lookahead_violations(trades(spark, sf)).agg(F.count(F.lit(1)).alias("violations"))


_FOLDS = """di AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT DISTINCT day FROM feat)), nn AS (SELECT count(*) AS n, floor(count(*) * 0.4::DOUBLE) AS f FROM di),
fp AS (SELECT k AS fold, f + k * floor((n - f) / 3) + 5 AS a, CASE WHEN k = 2 THEN n - 1 ELSE f + (k + 1) * floor((n - f) / 3) - 1 END AS b FROM nn, (VALUES (0), (1), (2)) x(k)),
fd AS (SELECT fold, x.day AS sd, y.day AS ed FROM fp JOIN di x ON x.i = a JOIN di y ON y.i = b)"""


@query("walk_forward_folds", feature_sql(f"SELECT fold, {d('sd')} AS start_day, {d('ed')} AS end_day, count(code) AS trades, {r('coalesce(avg(return_rate), 0)', 6)} AS avg_return FROM fd LEFT JOIN trr ON buy_day BETWEEN sd AND ed GROUP BY fold, sd, ed", *TRADES_SQL, _FOLDS))
def walk_forward_folds(spark, sf):
    f = stored_features(spark, sf, traded_columns(RULE))
    out = bt.fold_trades(trades(spark, sf, f=f), bt.folds(f))
    return out.select("fold", day_text("start_day").alias("start_day"), day_text("end_day").alias("end_day"), "trades", rnd("avg_return", 6).alias("avg_return"))


_M = "count(*) AS trades, {0} AS win_rate, {1} AS avg_return, {2} AS worst_loss, {3} AS avg_hold_days, {4} AS profit_loss_ratio, {5} AS median_return".format(
    r("count(CASE WHEN return_rate > 0 THEN 1 END) / count(*)", 6),
    r("avg(return_rate)", 6),
    r("coalesce(max(CASE WHEN return_rate < 0 THEN -return_rate END), 0)", 6),
    r("avg(hold_days)", 4),
    r("coalesce(avg(CASE WHEN return_rate >= 0 THEN return_rate END) / nullif(avg(CASE WHEN return_rate < 0 THEN -return_rate END), 0), 0)", 5),
    r("median(return_rate)", 6),
)


@query("trade_metrics", feature_sql(f"SELECT reason, {_M} FROM trr GROUP BY reason", *TRADES_SQL))
def trade_metrics(spark, sf):
    m = bt.trade_metrics(trades(spark, sf), ["reason"])
    digits = {"win_rate": 6, "avg_return": 6, "median_return": 6, "worst_loss": 6, "avg_hold_days": 4, "profit_loss_ratio": 5}
    return m.select("reason", "trades", *[rnd(c, k).alias(c) for c, k in digits.items()])


@query("trade_turnover", feature_sql(f"SELECT reason, {r('sum(b) / 1e8', 5)} AS buy_turnover, {r('sum(s) / 1e8', 5)} AS sell_turnover, {r('(sum(b) + sum(s)) / 2e8', 5)} AS two_sided_turnover FROM cs GROUP BY reason", *TRADES_SQL, _cost_sql()))
def trade_turnover(spark, sf):
    t = bt.turnover(bt.trade_costs(trades(spark, sf), CASH), CASH, ["reason"])
    return t.select("reason", *[rnd(c, 5).alias(c) for c in ("buy_turnover", "sell_turnover", "two_sided_turnover")])


@query("benchmark_days", ctes(BARS) + f"SELECT 'own' AS list, {d()} AS day FROM bars WHERE code = 1 AND day BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' UNION ALL SELECT DISTINCT 'all', {d()} FROM bars WHERE day BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def benchmark_days(spark, sf):
    """The trading days of a benchmark that is there, and of one that is not."""
    c = views.closes(spark, sf)
    own, other = (bt.trading_days(c, b, "1995-01-01", "1996-12-31").select(F.lit(n).alias("list"), day_text("day").alias("day")) for n, b in (("own", 1), ("all", -1)))
    return own.unionByName(other)


_MAE = """xt AS (SELECT t.code, t.signal_day, greatest(0, (buy_price - min(CASE WHEN b.low > 0 THEN b.low END)) / buy_price) AS mae, greatest(0, max(b.high) / buy_price - 1) AS mfe
  FROM cs t JOIN lv e ON e.code = t.code AND e.day = t.buy_day JOIN lv b ON b.code = t.code AND b.ix BETWEEN e.ix AND e.ix + hold_days - CASE WHEN reason = 'exit_condition' THEN 1 ELSE 0 END GROUP BY t.code, t.signal_day, buy_price)"""


@query("stock_breakdown", feature_sql(f"SELECT code, {r('sum(s - b - fees - sc)', 0)} AS pnl, count(*) AS trades, {r('count(CASE WHEN return_rate > 0 THEN 1 END) / count(*)', 6)} AS win_rate, {r('avg(return_rate)', 6)} AS avg_return, {r('median(return_rate)', 6)} AS median_return, {r('avg(mae)', 6)} AS avg_mae, {r('avg(mfe)', 6)} AS avg_mfe, {r('avg(hold_days)', 4)} AS avg_hold_days FROM cs JOIN xt USING (code, signal_day) GROUP BY code ORDER BY sum(s - b - fees - sc) DESC, code", *TRADES_SQL, _cost_sql(), _MAE))
def stock_breakdown(spark, sf):
    f = stored_features(spark, sf, traded_columns(RULE))
    t = bt.trade_costs(trades(spark, sf, f=f), CASH)
    b = bt.stock_breakdown(ex.excursions(t, f, H))
    return b.select("code", rnd("pnl", 0).alias("pnl"), "trades", *[rnd(c, 6).alias(c) for c in ("win_rate", "avg_return", "median_return", "avg_mae", "avg_mfe")], rnd("avg_hold_days", 4).alias("avg_hold_days"))


# --- series of strategies: daily mean order value by priority --------------------------------
NAV = "nav AS MATERIALIZED (SELECT o_orderpriority AS strategy, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS nav FROM orders GROUP BY 1, 2)"
RET = "rt AS MATERIALIZED (SELECT strategy, day, nav / p - 1 AS ret FROM (SELECT *, lag(nav) OVER (PARTITION BY strategy ORDER BY day) AS p FROM nav) WHERE p > 0)"
DD = "dd0 AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY day) - 1 AS i, max(nav) OVER (PARTITION BY strategy ORDER BY day) AS peak FROM nav), dd AS MATERIALIZED (SELECT *, (peak - nav) / peak AS dd, max(CASE WHEN nav = peak THEN i END) OVER (PARTITION BY strategy ORDER BY day) AS pi FROM dd0)"


def nav(spark, sf):
    o = views.table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("strategy"), F.col("o_orderdate").cast("date").alias("day")).agg(F.avg("o_totalprice").alias("nav"))


@query("drawdowns", ctes(NAV, DD) + f"SELECT strategy, {d()} AS day, {r('peak', 2)} AS peak, {r('dd', 6)} AS drawdown, CAST(i - pi AS BIGINT) AS since_peak FROM dd")
def drawdowns(spark, sf):
    x = bt.drawdowns(nav(spark, sf))
    return x.select("strategy", day_text("day").alias("day"), rnd("peak", 2).alias("peak"), rnd("drawdown", 6).alias("drawdown"), (F.col("i") - F.col("peak_i")).cast("long").alias("since_peak"))


@query("daily_returns", ctes(NAV, RET) + f"SELECT strategy, {d()} AS day, {r('ret', 6)} AS ret FROM rt")
def daily_returns(spark, sf):
    return bt.returns(nav(spark, sf)).select("strategy", day_text("day").alias("day"), rnd("ret", 6).alias("ret"))


def _metrics_sql(std, down, rf):
    return f"""tt AS (SELECT strategy, count(*) AS days, arg_max(nav, day) / arg_min(nav, day) - 1 AS tr FROM nav GROUP BY 1), vv AS (SELECT strategy, {std}(ret) * sqrt(252) AS vol, {down} * sqrt(252) AS dv FROM rt GROUP BY 1),
mm AS (SELECT strategy, max(dd) AS mdd, arg_max(i - pi, ROW(dd, -i)) AS ddd FROM dd GROUP BY 1),
pm AS MATERIALIZED (SELECT *, (ar - {rf}) / vol AS sharpe, (ar - {rf}) / dv AS sortino, ar / mdd AS calmar FROM (SELECT *, power(1 + tr, 252.0 / days) - 1 AS ar FROM tt JOIN vv USING (strategy) JOIN mm USING (strategy)))"""


_PM = {"total_return": ("tr", 6), "annual_return": ("ar", 6), "annual_vol": ("vol", 6), "max_drawdown": ("mdd", 6), "sharpe": ("sharpe", 5), "sortino": ("sortino", 5), "calmar": ("calmar", 5)}


@query("performance_metrics", ctes(NAV, RET, DD, _metrics_sql("stddev_samp", "sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END))", 0)) + f"SELECT strategy, days, {', '.join(f'{r(x, k)} AS {c}' for c, (x, k) in _PM.items())}, CAST(ddd AS BIGINT) AS drawdown_days FROM pm")
def performance_metrics(spark, sf):
    m = bt.nav_metrics(nav(spark, sf))
    return m.select("strategy", "days", *[rnd(c, k).alias(c) for c, (_, k) in _PM.items()], F.col("drawdown_days").cast("long").alias("drawdown_days"))


@query(
    "portfolio_risk",
    ctes(NAV, RET, DD, _metrics_sql("stddev_pop", "stddev_pop(CASE WHEN ret < 0 THEN ret END)", 0.02), "o AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY ret, day) - 1 AS k, count(*) OVER (PARTITION BY strategy) AS n FROM rt)", "vr AS (SELECT strategy, -max(CASE WHEN k = floor(n * 0.05::DOUBLE) THEN ret END) AS var95, -max(CASE WHEN k = floor(n * 0.01::DOUBLE) THEN ret END) AS var99, -avg(CASE WHEN k < greatest(n // 20, 1) THEN ret END) AS cvar95 FROM o GROUP BY 1)")
    + f"SELECT strategy, {r('var95', 6)} AS var95, {r('var99', 6)} AS var99, {r('cvar95', 6)} AS cvar95, {r('sharpe', 5)} AS sharpe, {r('sortino', 5)} AS sortino, {r('calmar', 5)} AS calmar, (mdd > 0.2)::INT + (var95 > 0.08)::INT + (vol > 0.5)::INT >= 2 AS breaker FROM pm JOIN vr USING (strategy)",
)
def portfolio_risk(spark, sf):
    p = bt.portfolio_risk(nav(spark, sf))
    return p.select("strategy", *[rnd(c, 6).alias(c) for c in ("var95", "var99", "cvar95")], *[rnd(c, 5).alias(c) for c in ("sharpe", "sortino", "calmar")], "breaker")


STRATEGIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_CORR = "co AS MATERIALIZED (SELECT x.strategy AS a, y.strategy AS b, count(*) AS n, corr(x.ret, y.ret) AS rho FROM rt x JOIN rt y USING (day) WHERE x.strategy <> y.strategy GROUP BY 1, 2)"


@query("strategy_correlation", ctes(NAV, RET, _CORR) + f"SELECT a, b, n, {r('rho', 6)} AS rho, abs(rho) > 0.7 AS warning FROM co WHERE a < b")
def strategy_correlation(spark, sf):
    from barloom.operators.joins import pair_correlations

    x = bt.returns(nav(spark, sf))
    wide = x.groupBy("day").agg(*[F.max(F.when(F.col("strategy") == s, F.col("ret"))).alias(s) for s in STRATEGIES])
    p = pair_correlations(wide.select("day", *[F.col(f"`{s}`").alias(s.replace("-", "_").replace(" ", "_")) for s in STRATEGIES]), [s.replace("-", "_").replace(" ", "_") for s in STRATEGIES], 11)
    back = F.create_map(*[F.lit(v) for s in STRATEGIES for v in (s.replace("-", "_").replace(" ", "_"), s)])
    return p.select(back[F.col("a")].alias("a"), back[F.col("b")].alias("b"), "n", rnd("rho", 6).alias("rho"), (F.abs("rho") > 0.7).alias("warning"))


_ALLOC = """al AS (SELECT strategy, avg(ret) * 252 AS ret, stddev_pop(ret) * sqrt(252) AS vol, sqrt(avg(ret * ret)) * sqrt(252) AS rms FROM rt GROUP BY 1), rb AS (SELECT a AS strategy, avg(abs(rho)) AS rb FROM co GROUP BY 1),
raw AS (SELECT strategy, ret, rms, unnest(['equal_weight', 'risk_parity', 'min_variance', 'max_sharpe']) AS method, unnest([1, 1 / vol, 1 / (vol * (1 + rb)), greatest((ret - 0.02) / vol, 0) / (1 + rb * 0.5)]) AS x FROM al JOIN rb USING (strategy)),
wt AS MATERIALIZED (SELECT *, x / sum(x) OVER (PARTITION BY method) AS weight FROM raw)"""


@query("allocation_weights", ctes(NAV, RET, _CORR, _ALLOC) + f"SELECT method, strategy, {r('weight', 6)} AS weight, {r('weight * ret', 5)} AS contribution FROM wt")
def allocation_weights(spark, sf):
    w, _ = bt.allocation(nav(spark, sf), STRATEGIES)
    return w.select("method", "strategy", rnd("weight", 6).alias("weight"), rnd("contribution", 5).alias("contribution"))


@query(
    "allocation_book",
    ctes(NAV, RET, _CORR, _ALLOC, "cr AS (SELECT a, b, rho FROM co UNION ALL SELECT strategy, strategy, 1 FROM al)", "vx AS (SELECT x.method, sqrt(sum(x.weight * x.rms * y.weight * y.rms * rho)) AS risk, 1 - avg(CASE WHEN a < b AND x.weight > 0.01 AND y.weight > 0.01 THEN rho END) AS dv FROM wt x JOIN cr ON cr.a = x.strategy JOIN wt y ON y.method = x.method AND y.strategy = cr.b GROUP BY 1)", "er AS (SELECT method, sum(weight * ret) AS er FROM wt GROUP BY 1)")
    + f"SELECT method, {r('er', 5)} AS expected_return, {r('risk', 5)} AS expected_risk, {r('dv', 6)} AS diversification, {r('(er - 0.02) / risk', 5)} AS sharpe FROM er JOIN vx USING (method)",
)
def allocation_book(spark, sf):
    _, b = bt.allocation(nav(spark, sf), STRATEGIES)
    return b.select("method", *[rnd(c, 5).alias(c) for c in ("expected_return", "expected_risk")], rnd("diversification", 6).alias("diversification"), rnd("sharpe", 5).alias("sharpe"))


@query("benchmark_return", ctes(BARS) + f"SELECT code, count(*) AS days, {r('arg_max(close, day) / arg_min(close, day) - 1', 6)} AS benchmark_return FROM bars GROUP BY code")
def benchmark_return(spark, sf):
    return bt.benchmark_return(views.closes(spark, sf)).select("code", "days", rnd("benchmark_return", 6).alias("benchmark_return"))


@query("industry_concentration", feature_sql(f"SELECT industry, count(*) AS trades, {r('count(*) / sum(count(*)) OVER ()', 6)} AS weight, CASE WHEN count(*) / sum(count(*)) OVER () > 0.3 THEN 'high' WHEN count(*) / sum(count(*)) OVER () > 0.2 THEN 'medium' ELSE 'low' END AS risk FROM trr JOIN sectors USING (code) GROUP BY industry", *TRADES_SQL, SECTORS))
def industry_concentration(spark, sf):
    c = bt.concentration(trades(spark, sf), views.sectors(spark, sf))
    return c.select("industry", "trades", rnd("weight", 6).alias("weight"), "risk")


_MEASURES = {"sum_return": 6, "compound_return": 6, "max_drawdown": 6, "sharpe": 5, "win_rate": 6}
_BOOT = [
    "op AS MATERIALIZED (SELECT row_number() OVER (ORDER BY day) - 1 AS pick, x, count(*) OVER () AS n FROM (SELECT day, avg(ret) / 1000 AS x FROM rt GROUP BY day))",
    "b0 AS (SELECT s AS sim, pick AS k, n, (7 * 104729 + 12345 + s * 1000003 + pick * 7919) % 2147483647 AS z FROM op, range(1000) t(s))",
    "b1 AS (SELECT sim, k, n, (z * z % 2147483647 + z * 48271) % 2147483647 AS z FROM b0)",
    "b2 AS (SELECT sim, k, ((z * z % 2147483647 + z * 40692 + sim) % 2147483647) % n AS pick FROM b1)",
    "b3 AS (SELECT sim, k, x, sum(ln(1 + x)) OVER (PARTITION BY sim ORDER BY k) AS lv FROM b2 JOIN op USING (pick))",
    "b4 AS (SELECT *, 1 - exp(lv - greatest(0, max(lv) OVER (PARTITION BY sim ORDER BY k))) AS dd FROM b3)",
    "b5 AS MATERIALIZED (SELECT sim, sum(x) AS sum_return, exp(sum(ln(1 + x))) - 1 AS compound_return, greatest(0, max(dd)) AS max_drawdown, CASE WHEN stddev_pop(x) > 0 THEN avg(x) / stddev_pop(x) * sqrt(252) ELSE 0 END AS sharpe, count(CASE WHEN x > 0 THEN 1 END) / count(*) AS win_rate FROM b4 GROUP BY sim)",
]


def _interval_sql() -> str:
    at = {"median": "500", **{f"p{int(p * 1000):03d}": f"floor(999 * {p}::DOUBLE)" for p in (0.025, 0.05, 0.25, 0.75, 0.95, 0.975)}}
    one = lambda m, k: f"SELECT '{m}' AS measure, {r('avg(v)', k)} AS mean, {r('stddev_pop(v)', k)} AS std, " + ", ".join(f"{r(f'max(CASE WHEN i = {e} THEN v END)', k)} AS {n}" for n, e in at.items()) + f" FROM (SELECT {m} AS v, row_number() OVER (ORDER BY {m}) - 1 AS i FROM b5)"
    return " UNION ALL ".join(one(m, k) for m, k in _MEASURES.items())


@query("bootstrap_interval", ctes(NAV, RET, *_BOOT) + _interval_sql())
def bootstrap_interval(spark, sf):
    t = bt.returns(nav(spark, sf)).groupBy("day").agg(F.avg("ret").alias("return_rate")).withColumn("code", F.lit("all"))
    # the synthetic account moves by whole multiples a day; read per mille its paths stay finite
    s = bt.bootstrap(t.withColumn("return_rate", F.col("return_rate") / lit(1000)))
    i = bt.interval(s, list(_MEASURES))
    digits = lambda c: F.coalesce(*[F.when(F.col("measure") == m, rnd(c, k)) for m, k in _MEASURES.items()])
    return i.select("measure", *[digits(c).alias(c) for c in i.columns if c != "measure"])


# --- verdict: perturbed rules and costs, folds, coverage ---------------------------------------
#: thin trading: the shares of covered days that the shipped default and a looser configuration ask for
MIN_COVERAGE = {"default": 0.95, "thin": 0.15}


def _variant_sql(k: int, scale: float, stop: float, gain: float) -> list[str]:
    return [rule_sql(scale, f"sg{k}"), _live_sql(f"sg{k}", f"lw{k}"), _trade_sql(f"lw{k}", f"tq{k}", stop, gain)]


_SCENARIO_SQL = [
    *_variant_sql(0, 1.0, 0.08, 0.2),
    *_variant_sql(1, 0.95, 0.08 * 0.95, 0.2 * 0.95),
    *_variant_sql(2, 1.05, 0.08 * 1.05, 0.2 * 1.05),
    """sa AS (SELECT x.*, tq0.* FROM tq0, (VALUES ('base', 0.0015::DOUBLE), ('slippage_1_5x', 0.0015::DOUBLE * 1.5), ('slippage_2x', 0.0015::DOUBLE * 2)) x(scenario, slip)
  UNION ALL SELECT 'threshold_0_95x', 0.0015::DOUBLE, * FROM tq1 UNION ALL SELECT 'threshold_1_05x', 0.0015::DOUBLE, * FROM tq2)""",
    _cost_sql("slip", "sa", "cz"),
    "nt AS MATERIALIZED (SELECT *, (s - b - fees - sc) / b AS net FROM cz)",
]


def _report_sql(key: str = "") -> str:
    """rp: trades, means, total return and drawdown by scenario, over all instruments or by code."""
    k = f"{key}, " if key else ""
    stake = "1" if key else "(SELECT count(DISTINCT code) FROM nt n WHERE n.scenario = dy.scenario)"
    return f"""dy AS (SELECT {k}scenario, sell_day, sum(net) AS x FROM nt GROUP BY ALL),
dn AS (SELECT *, 1 + sum(x) OVER (PARTITION BY {k}scenario ORDER BY sell_day) / {stake} AS nav FROM dy),
dp AS (SELECT *, greatest(1, max(nav) OVER (PARTITION BY {k}scenario ORDER BY sell_day)) AS peak FROM dn),
dq AS (SELECT {k}scenario, arg_max(nav, sell_day) - 1 AS total, max(least(1, greatest(0, (peak - nav) / peak))) AS mdd FROM dp GROUP BY ALL),
rp AS MATERIALIZED (SELECT {k}scenario, count(*) AS n, avg(net) AS ar, median(net) AS md, count(CASE WHEN NOT (signal_day < buy_day AND buy_day < sell_day) THEN 1 END) AS la, any_value(total) AS total, any_value(mdd) AS mdd FROM nt JOIN dq USING ({k}scenario) GROUP BY {k}scenario)"""


def _scenarios(spark, sf, f):
    return materialized(stb.scenario_trades(fl.tradable(f, "buy"), RULE, CASH))


@query(
    "parameter_stability",
    feature_sql(
        f"""SELECT p.scenario, p.n AS trades, {r('p.ar', 6)} AS avg_return, {r('p.md', 6)} AS median_return, {r('p.total', 5)} AS total_return, {r('p.mdd', 6)} AS max_drawdown,
  p.scenario = 'base' OR coalesce(p.ar > 0 AND p.ar >= b.ar * 0.5 AND p.mdd <= greatest(0.25, b.mdd * 1.5), false) AS passed FROM rp p JOIN rp b ON b.scenario = 'base' WHERE p.scenario IN ('base', 'threshold_0_95x', 'threshold_1_05x')""",
        *_SCENARIO_SQL,
        _report_sql(),
    ),
)
def parameter_stability(spark, sf):
    """The rule over all instruments: its own run and both perturbed ones."""
    # the features are read once, by the trades, which are stored
    rep = stb.stress_report(_scenarios(spark, sf, features(spark, sf))).filter(F.col("scenario").isin(list(stb.THRESHOLDS)))
    base = rep.filter("scenario = 'base'").select(F.col("avg_return").alias("_a"), F.col("max_drawdown").alias("_d"))
    ok = (F.col("avg_return") > 0) & (F.col("avg_return") >= F.col("_a") * 0.5) & (F.col("max_drawdown") <= F.greatest(lit(0.25), F.col("_d") * lit(1.5)))
    j = rep.crossJoin(F.broadcast(base))
    return j.select("scenario", "trades", *[rnd(c, 6).alias(c) for c in ("avg_return", "median_return")], rnd("total_return", 5).alias("total_return"), rnd("max_drawdown", 6).alias("max_drawdown"), ((F.col("scenario") == "base") | F.coalesce(ok, F.lit(False))).alias("passed"))


@query("variant_folds", feature_sql(f"SELECT scenario, fold, count(*) AS trades, {r('avg(net)', 6)} AS avg_return FROM nt JOIN fd ON buy_day BETWEEN sd AND ed GROUP BY scenario, fold", *_SCENARIO_SQL, _FOLDS))
def variant_folds(spark, sf):
    f = stored_features(spark, sf, traded_columns(RULE))
    e = stb.fold_evidence(_scenarios(spark, sf, f), bt.folds(f))
    return e.select("scenario", "fold", "trades", rnd("avg_return", 6).alias("avg_return"))


_EVIDENCE_SQL = [
    *_SCENARIO_SQL,
    _report_sql("code"),
    _FOLDS,
    "oo AS (SELECT code, fold, count(*) AS n, avg(net) AS a FROM nt JOIN fd ON buy_day BETWEEN sd AND ed WHERE scenario = 'base' GROUP BY 1, 2)",
    "os AS (SELECT code, sum(n) AS n2, sum(n * a) / sum(n) AS a2, count(CASE WHEN a > 0 THEN 1 END) / (SELECT count(*) FROM fd) AS fc FROM oo GROUP BY 1)",
    "cv AS (SELECT code, least(1, count(CASE WHEN open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume > 0 THEN 1 END) / (SELECT count(DISTINCT day) FROM feat)) AS cov, CASE WHEN arg_min(close, day) > 0 AND arg_max(close, day) > 0 THEN (arg_max(close, day) - arg_min(close, day)) / arg_min(close, day) END AS br FROM feat GROUP BY 1)",
    """ev AS MATERIALIZED (SELECT b.code, b.n, b.ar, b.total, b.mdd, b.la, cov, br, coalesce(n2, 0) AS n2, coalesce(a2, 0) AS a2, coalesce(fc, 0) AS fc, coalesce(c.ar > 0 AND c.mdd <= 0.20, false) AS cost,
  (SELECT count(*) FROM rp p WHERE p.code = b.code AND p.scenario IN ('threshold_0_95x', 'threshold_1_05x') AND p.ar > 0 AND p.ar >= b.ar * 0.5 AND p.mdd <= greatest(0.25, b.mdd * 1.5)) = 2 AS stable,
  CASE WHEN b.ar <> 0 THEN (b.ar - coalesce(a2, 0)) / abs(b.ar) ELSE 0 END AS decay
  FROM rp b JOIN cv USING (code) LEFT JOIN os USING (code) LEFT JOIN rp c ON c.code = b.code AND c.scenario = 'slippage_2x' WHERE b.scenario = 'base')""",
    "wn AS (SELECT *, list_filter([CASE WHEN decay > 0.5 THEN 'decay' END, CASE WHEN fc > 0 AND fc < 0.5 THEN 'folds' END, CASE WHEN NOT stable THEN 'fragile' END], lambda x: x IS NOT NULL) AS warnings FROM ev)",
]


@query(
    "overfit_diagnostics",
    feature_sql(f"SELECT code, n AS trades, {r('total', 5)} AS total_return, {r('mdd', 6)} AS max_drawdown, {r('cov', 6)} AS coverage, cost AS cost_2x_passed, CASE WHEN stable THEN 'stable' ELSE 'fragile' END AS parameter_stability, CAST(n2 AS BIGINT) AS out_trades, {r('a2', 6)} AS out_avg_return, {r('fc', 6)} AS fold_consistency, {r('decay', 4)} AS out_sample_decay, {r('total - br', 5)} AS excess_return, 5 AS rule_complexity, array_to_string(warnings, ',') AS warnings FROM wn", *_EVIDENCE_SQL),
)
def overfit_diagnostics(spark, sf):
    e = _evidence(spark, sf)
    digits = {"total_return": 5, "max_drawdown": 6, "coverage": 6, "out_avg_return": 6, "fold_consistency": 6, "out_sample_decay": 4, "excess_return": 5}
    return e.select("code", "trades", "cost_2x_passed", "parameter_stability", "out_trades", "rule_complexity", F.array_join("warnings", ",").alias("warnings"), *[rnd(c, k).alias(c) for c, k in digits.items()])


def _evidence(spark, sf):
    f = stored_features(spark, sf, traded_columns(RULE))
    return stb.evidence(_scenarios(spark, sf, f), f, bt.folds(f), RULE)


_GATES = """CASE WHEN la > 0 THEN 'lookahead' WHEN n = 0 THEN 'no_trades' WHEN cov < mc THEN 'coverage' WHEN mdd > 0.25 OR ar <= 0 THEN 'return_drawdown' WHEN NOT cost THEN 'cost' WHEN n < 30 OR br IS NULL THEN 'sample_benchmark'
  WHEN total - br <= 0 THEN 'excess' WHEN n2 < 15 OR a2 <= 0 THEN 'out_of_sample' WHEN NOT stable THEN 'parameters' WHEN len(warnings) > 0 THEN 'warnings' ELSE 'passed' END"""


@query(
    "quant_verdict",
    feature_sql(
        """SELECT config, code, gate, CASE WHEN gate IN ('lookahead', 'no_trades', 'coverage', 'return_drawdown') THEN 'reject' WHEN gate IN ('cost', 'sample_benchmark', 'excess') THEN 'watchlist' WHEN gate IN ('out_of_sample', 'parameters') THEN 'paper_trade' ELSE 'active_candidate' END AS status FROM gt""",
        *_EVIDENCE_SQL,
        f"gt AS (SELECT config, code, {_GATES} AS gate FROM wn, (VALUES ('default', 0.95), ('thin', 0.15)) x(config, mc))",
    ),
)
def quant_verdict(spark, sf):
    """Every instrument's verdict on measured evidence, under the shipped coverage gate and under one for thin trading."""
    configs = F.array(*[F.struct(F.lit(n).alias("config"), lit(v).alias("min_coverage")) for n, v in MIN_COVERAGE.items()])
    e = _evidence(spark, sf).drop("min_coverage").withColumn("_c", F.explode(configs))
    return bt.verdict(e.select("*", "_c.*")).select("config", "code", "status", "gate")


@query("unique_samples", feature_sql("SELECT code, count(DISTINCT ROW(buy_day, sell_day)) AS stock_samples, (SELECT count(DISTINCT ROW(code, buy_day, sell_day)) FROM trr) AS pool_samples FROM trr GROUP BY code", *TRADES_SQL))
def unique_samples(spark, sf):
    return de.unique_samples(trades(spark, sf))


# --- decisions --------------------------------------------------------------------------------
_RULES = {"cross": RULE, "oversold": RULE_B}
_SIGB = rule_sql(name="sgb").replace(f"coalesce({lag('close')} <= {lag('ma20')} AND close > ma20, false) AND coalesce(rsi6 < 70.0::DOUBLE, false) AND coalesce({lag('volume_ratio')} > 0.5::DOUBLE, false)", "coalesce(rsi6 < 35.0::DOUBLE, false)").replace(f"coalesce({lag('close')} >= {lag('ma10')} AND close < ma10, false) OR coalesce(rsi6 > 85.0::DOUBLE, false)", "coalesce(rsi6 > 60.0::DOUBLE, false)")
_DEC_SQL = [
    *TRADES_SQL,
    _SIGB,
    _live_sql("sgb", "lvb"),
    _trade_sql("lvb", "trb"),
    "ta AS MATERIALIZED (SELECT 'cross' AS rule, code, return_rate FROM trr UNION ALL SELECT 'oversold', code, sell_price / buy_price - 1 FROM trb)",
    "pl AS (SELECT rule, count(*) AS pn, count(CASE WHEN return_rate > 0 THEN 1 END) / count(*) AS wr, avg(return_rate) AS oa FROM ta GROUP BY 1)",
    "sk AS (SELECT rule, code, count(*) AS n, count(CASE WHEN return_rate > 0 THEN 1 END) AS w, avg(return_rate) AS r FROM ta GROUP BY 1, 2)",
    "ma AS (SELECT 'cross' AS rule, code, day, entry_matched AS en, exit_matched AS ex FROM sig UNION ALL SELECT 'oversold', code, day, entry_matched, exit_matched FROM sgb)",
    "mj AS (SELECT ma.*, pn, wr, oa, coalesce(n, 0) AS n, coalesce(w, 0) AS w, coalesce(r, 0) AS r FROM ma JOIN pl USING (rule) LEFT JOIN sk USING (rule, code))",
    "mk AS (SELECT *, en OR ex AS lv, pn >= 30 AND n >= 10 AS rd, CASE WHEN n = 0 THEN (wr * least(pn, 30) + 2) / (least(pn, 30) + 4) ELSE (w + 2) / (n + 4) END AS p, (r * n + oa * 5) / (n + 5) AS e, CASE WHEN en OR ex THEN sqrt(n + 1) ELSE 0 END AS k FROM mj)",
    "ee AS MATERIALIZED (SELECT code, day, count(CASE WHEN en THEN 1 END) AS ec, count(CASE WHEN ex THEN 1 END) AS xc, count(CASE WHEN en AND rd THEN 1 END) AS pc, count(CASE WHEN en AND NOT rd THEN 1 END) AS uc, count(CASE WHEN lv AND e < 0 THEN 1 END) AS nc, count(CASE WHEN lv AND rd THEN 1 END) = 0 AS warn, max(n) AS ss, CASE WHEN sum(k) > 0 THEN sum(p * k) / sum(k) ELSE 0.5 END AS pr, CASE WHEN sum(k) > 0 THEN sum(e * k) / sum(k) ELSE 0 END AS er, sum(k) > 0 AS he FROM mk GROUP BY 1, 2)",
    """hd AS (SELECT s_suppkey AS code, CASE WHEN s_suppkey % 2 = 0 THEN 20000::DOUBLE END AS cp, CASE s_suppkey % 3 WHEN 0 THEN 'SELL' WHEN 1 THEN 'HOLD' ELSE '' END AS pa FROM supplier)""",
    "dc0 AS (SELECT ee.*, f.close, cp, pa, coalesce(cp > 0, false) AS held, greatest(0, least(100, 50 - uc * 3 - xc * 12 + CASE WHEN he THEN (pr - 0.5) * 60 + greatest(-10, least(10, er * 100)) ELSE 0 END - CASE WHEN close < ma20 AND macd < 0 THEN 8 ELSE 0 END + CASE WHEN rsi6 > 0 AND rsi6 < 30 THEN 4 ELSE 0 END + CASE WHEN volume_ratio >= 1.2 THEN 3 ELSE 0 END)) AS s FROM ee JOIN feat f USING (code, day) LEFT JOIN hd ON hd.code = ee.code)",
    """dc1 AS (SELECT *, CASE WHEN held THEN CASE WHEN close <= cp * (1 - CASE WHEN he THEN 0.05 ELSE 0.03 END::DOUBLE) THEN 'SELL' WHEN close <= cp * 0.98 THEN 'REDUCE' WHEN xc >= 2 OR s < 42 THEN 'REDUCE' WHEN close >= cp * (1 + CASE WHEN he THEN 0.05 ELSE 0.01 END::DOUBLE) AND s < 70 THEN 'REDUCE' WHEN warn AND ec > 0 AND nc > 0 THEN 'REDUCE' WHEN s >= 82 AND ec > 0 AND pc > 0 AND NOT warn THEN 'ADD' ELSE 'HOLD' END
  ELSE CASE WHEN s >= 78 AND ec > 0 AND pc > 0 AND NOT warn THEN 'BUY' WHEN s >= 55 AND ec > 0 THEN 'WATCH' WHEN xc > 0 OR s < 45 THEN 'AVOID' ELSE 'WATCH' END END AS a0, held AND close <= cp * (1 - CASE WHEN he THEN 0.05 ELSE 0.03 END::DOUBLE) AS em FROM dc0)""",
    "dc AS MATERIALIZED (SELECT *, CASE WHEN pa = '' OR em THEN a0 WHEN pa = 'SELL' AND a0 IN ('BUY', 'ADD') AND s < 82 THEN 'WATCH' WHEN pa = 'HOLD' AND a0 = 'ADD' AND s < 82 THEN 'HOLD' ELSE a0 END AS action FROM dc1)",
]


def _decisions(spark, sf):
    f = stored_features(spark, sf, list(dict.fromkeys([*traded_columns(*_RULES.values()), "ma20", "macd", "rsi6", "volume_ratio"])))
    names, both = list(_RULES), f
    for n, rule in _RULES.items():
        both = of.match_rule(both, rule).withColumnsRenamed({"entry_matched": f"in_{n}", "exit_matched": f"out_{n}"})
    m = both.select("code", "day", F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"in_{n}").alias("entry_matched"), F.col(f"out_{n}").alias("exit_matched")) for n in names])))
    # one pass for both rules, stored because pool and stock read its trades; the rules hold equally long
    limits = [bt.limits(rule["stop_loss"], rule["stop_gain"]) for rule in _RULES.values()]
    t = bt.walked(fl.tradable(both, "buy"), [F.col(f"in_{n}") for n in names], [F.col(f"out_{n}") for n in names], limits, H)
    t = materialized(t.select(F.get(F.array(*[F.lit(n) for n in names]), F.col("at")).alias("rule"), "code", "return_rate"))
    win = F.count(F.when(F.col("return_rate") > 0, 1))
    pool = t.groupBy("rule").agg(F.count(F.lit(1)).alias("pool_trades"), (win / F.count(F.lit(1))).alias("win_rate"), F.avg("return_rate").alias("out_avg_return")).withColumns({"target_return": lit(0.2), "stop_loss": lit(0.08)})
    stock = t.groupBy("rule", "code").agg(F.count(F.lit(1)).alias("trades"), win.alias("wins"), F.avg("return_rate").alias("avg_return"))
    s = views.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    held = s.select(k.alias("code"), F.when(k % 2 == 0, lit(20000)).alias("cost_price"), F.when(k % 2 == 0, lit(500)).alias("cost_volume"), F.when(k % 3 == 0, "SELL").when(k % 3 == 1, "HOLD").otherwise("").alias("previous_action"))
    return de.decision_table(de.rule_evidence(m, pool, stock), f, held)


@query(
    "decision_table",
    feature_sql(
        f"""SELECT code, {d()} AS day, {r('s', 4)} AS score, {r('pr', 5)} AS probability, {r('er', 5)} AS expected_return, action, CASE action WHEN 'SELL' THEN 100 WHEN 'REDUCE' THEN 50 WHEN 'BUY' THEN least(20, greatest(5, CASE WHEN warn THEN 0.005 ELSE 0.01 END / CASE WHEN he THEN 0.08 ELSE 0.05 END * 100)) WHEN 'ADD' THEN least(20, greatest(5, CASE WHEN warn THEN 0.005 ELSE 0.01 END / CASE WHEN he THEN 0.08 ELSE 0.05 END * 100)) ELSE 0 END::DOUBLE AS quantity_pct,
  CASE WHEN pc = 0 OR warn THEN 'observe' WHEN ss >= 30 THEN 'reference' WHEN ss >= 10 THEN 'observe' ELSE 'weak' END AS quality, CASE WHEN warn OR ss < 10 THEN 'low' WHEN ss >= 30 AND abs(pr - 0.5) >= 0.15 THEN 'high' WHEN abs(pr - 0.5) >= 0.07 THEN 'medium' ELSE 'low' END AS confidence FROM dc""",
        *_DEC_SQL,
    ),
)
def decision_table(spark, sf):
    x = _decisions(spark, sf)
    return x.select("code", day_text("day").alias("day"), rnd("score", 4).alias("score"), rnd("probability", 5).alias("probability"), rnd("expected_return", 5).alias("expected_return"), "action", "quantity_pct", "quality", "confidence")


@query("latest_action", feature_sql(f"SELECT code, {d('max(day)')} AS day, arg_max(action, day) AS action, arg_max(p, day) AS previous_action FROM (SELECT *, coalesce(lag(action) OVER {W}, '') AS p FROM dc) GROUP BY code", *_DEC_SQL))
def latest_action(spark, sf):
    a = de.action_changes(_decisions(spark, sf).select("code", "day", "action"))
    return a.select("code", day_text("day").alias("day"), "action", F.coalesce("previous_action", F.lit("")).alias("previous_action"))


@query(
    "position_size",
    """WITH x AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' WHEN 2 THEN 'REDUCE' WHEN 3 THEN 'ADD' ELSE 'WATCH' END AS action, CASE c_custkey % 5 WHEN 1 THEN 100 WHEN 2 THEN 50 ELSE 20 END::DOUBLE AS pct, 10 + (c_custkey % 37)::DOUBLE AS price, (c_custkey % 7) * 130::DOUBLE AS vol,
  (c_custkey % 7) * 130 * (10 + c_custkey % 37)::DOUBLE AS val, CASE WHEN c_custkey % 2 = 0 THEN abs(c_acctbal) * 10 END AS cash, abs(c_acctbal) * 40 AS total FROM customer),
y AS (SELECT *, greatest(CASE WHEN val > 0 THEN val ELSE price * 100 END * pct / 100, price * 100) AS a0 FROM x), z AS (SELECT *, CASE WHEN cash > 0 THEN least(a0, cash) ELSE a0 END AS a1 FROM y), w AS (SELECT *, CASE WHEN cash IS NOT NULL AND total > 0 THEN least(a1, total * 0.2 - val) ELSE a1 END AS a2 FROM z),
q AS (SELECT *, CAST(CASE WHEN action IN ('SELL', 'REDUCE') THEN CASE WHEN action = 'SELL' AND floor(vol * pct / 100) < 100 AND vol > 0 THEN vol ELSE floor(floor(vol * pct / 100) / 100) * 100 END WHEN action IN ('BUY', 'ADD') THEN CASE WHEN cash IS NULL AND val <= 0 THEN 0 ELSE greatest(floor(floor(a2 / price) / 100) * 100, 0) END ELSE 0 END AS BIGINT) AS quantity FROM w)
SELECT id, action, quantity, quantity * price AS amount, action IN ('BUY', 'ADD') AND cash IS NULL AS needs_cash FROM q""",
)
def position_size(spark, sf):
    c = views.table(spark, sf, "customer")
    k = F.col("c_custkey")
    m = k % 5
    bal = F.abs("c_acctbal")
    price = lit(10) + (k % 37).cast("double")
    vol = ((k % 7) * 130).cast("double")
    x = c.select(
        k.alias("id"),
        F.when(m == 0, "BUY").when(m == 1, "SELL").when(m == 2, "REDUCE").when(m == 3, "ADD").otherwise("WATCH").alias("action"),
        F.when(m == 1, lit(100)).when(m == 2, lit(50)).otherwise(lit(20)).alias("quantity_pct"),
        price.alias("price"),
        vol.alias("holding_volume"),
        (vol * price).alias("holding_value"),
        F.when(k % 2 == 0, bal * 10).alias("available_cash"),
        (bal * 40).alias("total_asset"),
    )
    return de.position_size(x).select("id", "action", "quantity", "amount", "needs_cash")


@query(
    "monitor_drift",
    """WITH l AS (SELECT event_type AS rule, value / 100 - 0.2 AS ret FROM events WHERE user_id % 2 = 0), b AS (SELECT event_type AS rule, avg(value) / 100 - 0.2 AS ar FROM events GROUP BY 1),
g AS (SELECT rule, count(*) AS samples, avg(ret) AS m, stddev_samp(ret) AS s FROM l GROUP BY 1)
SELECT rule, samples, """
    + f"{r('m', 5)} AS live_mean, {r('2 * s / sqrt(samples)', 5)} AS threshold, CASE WHEN samples >= 10 AND ar <> 0 AND (m < 0 OR m < ar - 2 * s / sqrt(samples)) THEN 'watch' ELSE 'active' END AS status FROM g JOIN b USING (rule)",
)
def monitor_drift(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("event_type").alias("rule"), (F.col("value") / 100 - lit(0.2)).alias("ret"), "user_id")
    x = de.drift(e.filter("user_id % 2 = 0"), e.groupBy("rule").agg(F.avg("ret").alias("avg_return")))
    return x.select("rule", "samples", rnd("live_mean", 5).alias("live_mean"), rnd("threshold", 5).alias("threshold"), "status")


@query(
    "monitor_regimes",
    feature_sql(
        f"""SELECT h.code, {d('as_of')} AS as_of, scene, regime, CASE WHEN (scene = '趋势持有' AND regime <> '上涨趋势') OR (scene = '短线爆发' AND regime = '下跌趋势') THEN 'watch' ELSE 'active' END AS status
  FROM (SELECT code, max(sell_day) AS as_of, CASE code % 3 WHEN 0 THEN '趋势持有' WHEN 1 THEN '短线爆发' ELSE '波段反弹' END AS scene FROM trr GROUP BY code) h ASOF LEFT JOIN rg ON h.as_of >= rg.day""",
        *TRADES_SQL,
        "b1 AS (SELECT day, close FROM bars WHERE code = 1)",
        "rg AS (SELECT day, CASE WHEN x >= 0.05 THEN '上涨趋势' WHEN x <= -0.05 THEN '下跌趋势' ELSE '震荡市' END AS regime FROM (SELECT b.day, (b.close - arg_min(p.close, p.day)) / arg_min(p.close, p.day) AS x FROM b1 b JOIN b1 p ON p.day BETWEEN b.day - 120 AND b.day WHERE b.close > 0 GROUP BY b.day, b.close))",
    ),
)
def monitor_regimes(spark, sf):
    """Every instrument's rule at its last sale, against the regime of a benchmark."""
    c = F.col("code")
    live = trades(spark, sf).groupBy("code").agg(F.max("sell_day").alias("as_of")).withColumns({"scene": F.when(c % 3 == 0, of.TREND).when(c % 3 == 1, of.SHORT).otherwise(of.SWING), "status": F.lit("active")})
    seg = de.regime_segments(views.closes(spark, sf).filter("code = 1").select("day", "close"))
    return de.regime_watch(de.regime_of(live, seg, "as_of")).select("code", day_text("as_of").alias("as_of"), "scene", "regime", "status")


@query("hypothesis_stats", f"SELECT event_type AS rule, count(*) AS signals, count(CASE WHEN value > 20 THEN 1 END) AS hits, {r('count(CASE WHEN value > 20 THEN 1 END) / count(*)', 6)} AS hit_rate, {r('avg(value)', 4)} AS avg_return FROM events WHERE value > 1 GROUP BY 1")
def hypothesis_stats(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("event_type").alias("rule"), F.col("value").alias("ret"), (F.col("value") > 20).alias("hit"), F.when(F.col("value") > 1, "validated").otherwise("open").alias("status"))
    return de.hypothesis_stats(e).select("rule", "signals", "hits", rnd("hit_rate", 6).alias("hit_rate"), rnd("avg_return", 4).alias("avg_return"))


_QR = f"qr AS (SELECT *, coalesce(close / {lag('close')} - 1 > 0.5 OR close / {lag('close')} - 1 < -0.5, false) AS jump, coalesce(close > 10 * last_value(close) OVER (PARTITION BY code ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), false) AS inflated FROM bars)"


@query("quality_anomalies", ctes(BARS, _QR) + f"SELECT code, {d()} AS day, jump, inflated FROM qr WHERE jump OR inflated")
def quality_anomalies(spark, sf):
    q = de.quality_rows(views.bars(spark, sf)).filter("jump OR negative OR zero OR broken OR suspended OR inflated")
    return q.select("code", day_text("day").alias("day"), "jump", "inflated")


@query(
    "data_quality",
    ctes(BARS, _QR, "pc AS (SELECT code, count(*) AS n, count(CASE WHEN jump THEN 1 END) AS j, count(CASE WHEN inflated THEN 1 END) AS f FROM qr GROUP BY 1)", "sp AS (SELECT count(*) AS records, greatest(floor((max(day) - min(day)) * 5 / 7), 1) AS e FROM bars)")
    + f"SELECT records, CAST(e AS BIGINT) AS expected_days, count(*) AS stocks, count(CASE WHEN n / e < 0.8 THEN 1 END) AS low_coverage, CAST(sum(j) AS BIGINT) AS anomalies, sum(f) = 0 AS consistent, {r('greatest(0, greatest(0, 100 - count(CASE WHEN n / e < 0.8 THEN 1 END) / count(*) * 30 - sum(j) * 2) - CASE WHEN sum(f) = 0 THEN 0 ELSE 20 END)', 2)} AS score FROM pc, sp GROUP BY records, e",
)
def data_quality(spark, sf):
    q = de.quality_report(views.bars(spark, sf))
    return q.select("records", "expected_days", "stocks", "low_coverage", "anomalies", "consistent", rnd("score", 2).alias("score"))
