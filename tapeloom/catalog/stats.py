"""Performance statistics and data-quality of results."""

from pyspark.sql import functions as F

from tapeloom.catalog import backtest as _backtest
from tapeloom.catalog.spec import query, view
from tapeloom.operators import backtest as K
from tapeloom.operators import stats as G
from tapeloom.sources import testtables as T

BPY = 8760


def _bt(spark, sf):
    return _backtest.crossover_backtest(spark, sf)




SHARPE = f"""CASE WHEN count(net_return) >= 2 AND NOT stddev_samp(net_return) < 1e-15 * (abs(avg(net_return)) + 1e-300)
       THEN avg(net_return) / stddev_samp(net_return) * sqrt({BPY}e0) END"""
SORTINO = f"""CASE WHEN count(net_return) < 2 THEN NULL
       WHEN count(*) FILTER (net_return < 0) > 0 THEN avg(net_return) / sqrt(avg(net_return * net_return) FILTER (net_return < 0)) * sqrt({BPY}e0)
       WHEN avg(net_return) > 0 THEN 'inf'::DOUBLE END"""
TOTAL = "CASE WHEN count(*) < 2 THEN 0 ELSE arg_max(equity, rn) / arg_min(equity, rn) - 1 END"
# The yearly power of hourly noise leaves the range of a double, so a short "year" is used.
CAGR = """CASE WHEN count(*) >= 2 AND arg_max(equity, rn) / arg_min(equity, rn) > 0
       THEN pow(arg_max(equity, rn) / arg_min(equity, rn), 24e0 / (count(*) - 1)) - 1 END"""

query("G1_annualized_sharpe", "symbol:s sharpe:f6", f"SELECT symbol, {SHARPE} AS sharpe FROM v_bt_ma GROUP BY 1")(
    lambda s, f: _bt(s, f).groupBy("symbol").agg(G.sharpe("net_return", BPY).alias("sharpe"))
)
query("G2_annualized_sortino", "symbol:s sortino:e8", f"SELECT symbol, {SORTINO} AS sortino FROM v_bt_ma GROUP BY 1")(
    lambda s, f: _bt(s, f).groupBy("symbol").agg(G.sortino("net_return", BPY).alias("sortino"))
)
query("G3_annualized_return", "symbol:s value:e7", f"SELECT symbol, {CAGR} AS value FROM v_bt_ma GROUP BY 1")(
    lambda s, f: _bt(s, f).groupBy("symbol").agg(G.annualized_return("equity", 24).alias("value"))
)
query("G4_total_return", "symbol:s value:e7", f"SELECT symbol, {TOTAL} AS value FROM v_bt_ma GROUP BY 1")(
    lambda s, f: _bt(s, f).groupBy("symbol").agg(G.total_return("equity").alias("value"))
)

view("v_mdd", """
SELECT symbol, arg_min(dd, (dd, ts)) AS max_drawdown, arg_min(peak_ts, (dd, ts)) AS peak_ts, arg_min(ts, (dd, ts)) AS trough_ts FROM (
  SELECT symbol, ts, equity / top - 1 AS dd, last_value(CASE WHEN equity = top THEN ts END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY rn) AS peak_ts
  FROM (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING) AS top FROM v_bt_ma))
GROUP BY 1""")


@query("G5_max_drawdown", "symbol:s max_drawdown:f8 peak_ts:t trough_ts:t", "SELECT * FROM v_mdd")
def _(spark, sf):
    return G.max_drawdown(_bt(spark, sf))


@query("G6_calmar", "symbol:s calmar:e7",
       f"SELECT symbol, c / nullif(abs(m), 0) AS calmar FROM (SELECT symbol, {CAGR} AS c, min(drawdown) AS m FROM v_bt_ma GROUP BY 1)")
def _(spark, sf):
    agg = _bt(spark, sf).groupBy("symbol").agg(G.annualized_return("equity", 24).alias("c"), F.min("drawdown").alias("m"))
    return agg.select("symbol", G.calmar(F.col("c"), F.col("m")).alias("calmar"))


view("v_turnover", f"""
SELECT symbol, CASE WHEN count(*) < 2 THEN 0 ELSE coalesce(sum(abs(lagged - prev_position)), 0) * {BPY}e0 / count(*) END AS turnover_per_year
FROM v_bt_ma GROUP BY 1""")


@query("G7_turnover_per_year", "symbol:s turnover_per_year:f6", "SELECT * FROM v_turnover")
def _(spark, sf):
    return G.turnover_per_year(_bt(spark, sf), BPY)


HIT = "avg(CASE WHEN pnl_pct > 0 THEN 1e0 ELSE 0e0 END)"
FACTOR = """CASE WHEN count(*) FILTER (pnl_pct < 0) > 0 THEN coalesce(sum(pnl_pct) FILTER (pnl_pct > 0), 0) / -sum(pnl_pct) FILTER (pnl_pct < 0)
       WHEN count(*) FILTER (pnl_pct > 0) > 0 THEN 'inf'::DOUBLE END"""


@query("G8_hit_rate", "symbol:s value:f8", f"SELECT symbol, {HIT} AS value FROM v_trades_ma GROUP BY 1")
def _(spark, sf):
    return K.trade_log(_bt(spark, sf)).groupBy("symbol").agg(G.hit_rate("pnl_pct").alias("value"))


@query("G9_profit_factor", "symbol:s value:e7", f"SELECT symbol, {FACTOR} AS value FROM v_trades_ma GROUP BY 1")
def _(spark, sf):
    return K.trade_log(_bt(spark, sf)).groupBy("symbol").agg(G.profit_factor("pnl_pct").alias("value"))


@query(
    "G10_summarize",
    "symbol:s total_return:e7 annualized_return:e7 sharpe:f6 sortino:e7 max_drawdown:f7 calmar:e7 turnover_per_year:f5 num_trades:f0 hit_rate:f8 profit_factor:e7",
    f"""
SELECT m.*, annualized_return / nullif(abs(max_drawdown), 0) AS calmar, coalesce(t.n, 0) AS num_trades, t.hit_rate, t.profit_factor
FROM (SELECT symbol, {TOTAL} AS total_return, {CAGR} AS annualized_return, {SHARPE.replace('8760', '24')} AS sharpe,
             {SORTINO.replace('8760', '24')} AS sortino, min(drawdown) AS max_drawdown,
             sum(abs(lagged - prev_position)) * 24e0 / count(*) AS turnover_per_year FROM v_bt_ma GROUP BY 1) m
LEFT JOIN (SELECT symbol, count(*) AS n, {HIT} AS hit_rate, {FACTOR} AS profit_factor FROM v_trades_ma GROUP BY 1) t USING (symbol)""",
)
def _(spark, sf):
    from tapeloom.plans.stage import stage

    result = stage(_bt(spark, sf), "backtest")
    return G.summarize(result, K.trade_log(result), 24)


@query("G11_auto_block_size", "symbol:s value:f8", """
SELECT symbol, CASE WHEN count(*) < 10 THEN 2 ELSE greatest(2, least(count(*) / 10e0, 1.75e0 * pow(count(*), 1e0 / 3))) END AS value
FROM v_bars GROUP BY 1""")
def _(spark, sf):
    n = T.hourly_bars(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"))
    return n.select("symbol", G.auto_block_size(F.col("n")).alias("value"))


ITERATIONS = 400


def _u(name: str) -> str:
    return f"CAST('0x' || substr(md5('0|{name}|' || iter || '|' || t), 1, 8) AS BIGINT) / 4294967296e0"


view("v_sizes", "SELECT symbol, count(*) AS n, greatest(2, least(count(*) / 10e0, 1.75e0 * pow(count(*), 1e0 / 3))) AS len FROM v_bars GROUP BY 1")
view("v_draws", f"""
SELECT symbol, iter, t, (last_value(CASE WHEN t = 0 OR {_u('restart')} < 1 / len THEN CAST(floor({_u('start')} * n) AS BIGINT) END IGNORE NULLS) OVER w
       + t - last_value(CASE WHEN t = 0 OR {_u('restart')} < 1 / len THEN t END IGNORE NULLS) OVER w) % n AS idx
FROM (SELECT symbol, n, len, iter, unnest(range(n)) AS t FROM (SELECT *, unnest(range({ITERATIONS})) AS iter FROM v_sizes))
WINDOW w AS (PARTITION BY symbol, iter ORDER BY t)""")


@query("G12_bootstrap_indices", "symbol:s iter:i t:i idx:i", "SELECT * FROM v_draws")
def _(spark, sf):
    n = T.hourly_bars(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"))
    return G.bootstrap_indices(n, n_iter=ITERATIONS)


# Blocks: geometric steps by inversion, segment by segment, and the rows they stand for.
def _blocks_sql(iterations: int) -> str:
    u = lambda name, *parts: f"CAST('0x' || substr(md5('0|{name}|' || {" || '|' || ".join(parts)}), 1, 8) AS BIGINT) / 4294967296e0"
    return f"""
WITH z AS (SELECT *, greatest(1, least(n, CAST(floor(256 * len) AS BIGINT))) AS span FROM v_sizes),
k AS (SELECT *, CAST(least(span + 1, ceil(span / len + 12 * sqrt(span / len) + 30)) AS BIGINT) AS most FROM z),
i AS (SELECT *, unnest(range({iterations})) AS iter FROM k),
s AS (SELECT *, unnest(range((n - 1) // span + 1)) AS seg FROM i),
g AS (SELECT *, unnest(range(most)) AS k FROM s),
d AS (SELECT *, seg * span - 1 + sum(CASE WHEN seg = 0 AND k = 0 THEN 1 ELSE CAST(floor(ln(1 - {u('gap', 'iter', 'seg', 'k')}) / ln(1 - 1 / len)) AS BIGINT) + 1 END)
        OVER (PARTITION BY symbol, iter, seg ORDER BY k) AS t FROM g)
SELECT symbol, n, len, iter, CAST(t AS BIGINT) AS t, CAST(floor({u('start', 'iter', 'CAST(t AS BIGINT)')} * n) AS BIGINT) AS s,
       CAST(coalesce(lead(t) OVER (PARTITION BY symbol, iter ORDER BY t), n) - t AS BIGINT) AS length
FROM d WHERE t < least(n, (seg + 1) * span)"""


view("v_blocks", _blocks_sql(ITERATIONS))


@query("G12_bootstrap_blocks", "symbol:s iter:i t:i idx:i", """
SELECT symbol, iter, t + j AS t, (s + j) % n AS idx FROM (SELECT *, unnest(range(length)) AS j FROM v_blocks)""")
def _(spark, sf):
    """The rows that the blocks stand for."""
    n = T.hourly_bars(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"))
    blocks = G.bootstrap_blocks(n, n_iter=ITERATIONS)
    rows = blocks.select("symbol", "iter", "t", "idx", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("j"))
    return rows.select("symbol", "iter", (F.col("t") + F.col("j")).alias("t"), F.pmod(F.col("idx") + F.col("j"), "n").alias("idx"))


def _interval_sql(statistic: str, value: str, source: str, iterations: int = ITERATIONS) -> str:
    return f"""
WITH x AS (SELECT symbol, iter, (s + j) % n AS idx FROM (SELECT *, unnest(range(length)) AS j FROM v_blocks WHERE iter < {iterations})),
d AS (SELECT x.symbol, x.iter, {statistic.replace('$', 'b.' + value)} AS s FROM x
      JOIN {source} b ON b.symbol = x.symbol AND b.rn = x.idx GROUP BY 1, 2)
SELECT p.symbol, p.point, quantile_cont(s, 0.025e0) AS lower, quantile_cont(s, 0.975e0) AS upper, {iterations} AS n_iter, any_value(len) AS block_size
FROM d JOIN (SELECT symbol, {statistic.replace('$', value)} AS point FROM {source} GROUP BY 1) p USING (symbol)
JOIN v_sizes z USING (symbol) GROUP BY 1, 2"""


_CI = "symbol:s point:f6 lower:f6 upper:f6 n_iter:i block_size:f6"


@query("G13_bootstrap_ci", _CI, _interval_sql("avg($)", "close", "v_nbars"))
def _(spark, sf):
    return G.bootstrap_ci(T.indexed_hourly_bars(spark, sf), "close", n_iter=ITERATIONS)


@query("G13_bootstrap_any_ci", _CI, _interval_sql("median($)", "close", "v_nbars", 40))
def _(spark, sf):
    return G.bootstrap_any_ci(T.indexed_hourly_bars(spark, sf), "close", F.median, n_iter=40)


@query("G14_bootstrap_sharpe_ci", _CI, _interval_sql(f"avg($) / nullif(stddev_samp($), 0) * sqrt({BPY}e0)", "net_return", "v_bt_ma"))
def _(spark, sf):
    return G.bootstrap_sharpe_ci(_bt(spark, sf), "net_return", BPY, n_iter=ITERATIONS)


@query("G15_auto_nw_lag", "symbol:s lag:i", """
SELECT symbol, CASE WHEN count(*) < 20 THEN greatest(1, count(*) // 5) ELSE floor(4 * pow(count(*) / 100e0, 2e0 / 9)) END AS lag
FROM v_bars GROUP BY 1""")
def _(spark, sf):
    n = T.hourly_bars(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"))
    return n.select("symbol", G.auto_nw_lag(F.col("n")).alias("lag"))


@query("G16_newey_west_sharpe", "symbol:s sharpe:f6 standard_error:f6 t_stat:f6 lag:i", f"""
WITH m AS (SELECT symbol, count(*) AS n, avg(net_return) AS mu, stddev_samp(net_return) AS sd, var_pop(net_return) AS g0 FROM v_bt_ma GROUP BY 1),
k AS (SELECT *, greatest(1, least(CAST(floor(4 * pow(n / 100e0, 2e0 / 9)) AS BIGINT), n - 2)) AS lag FROM m),
c AS (SELECT k.*, unnest(range(1, lag + 1)) AS j FROM k),
x AS (SELECT c.symbol, c.j, c.lag, avg((a.net_return - c.mu) * (b.net_return - c.mu)) AS g
      FROM c JOIN v_bt_ma a ON a.symbol = c.symbol JOIN v_bt_ma b ON b.symbol = a.symbol AND b.rn = a.rn + c.j GROUP BY 1, 2, 3),
s AS (SELECT symbol, sum(g * (1 - j / (lag + 1e0))) AS w FROM x GROUP BY 1),
e AS (SELECT k.*, mu / sd AS sr, sqrt(greatest(1e-12, (1 + 0.5e0 * (mu / sd) * (mu / sd)) * ((g0 + 2 * w) / g0) / n)) AS se FROM k JOIN s USING (symbol))
SELECT symbol, sr * sqrt({BPY}e0) AS sharpe, se * sqrt({BPY}e0) AS standard_error, sr / se AS t_stat, lag FROM e""")
def _(spark, sf):
    return G.newey_west_sharpe(_bt(spark, sf), "net_return", BPY)


def _poly(x: str, coefficients) -> str:
    text = f"{coefficients[0]!r}"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r})"
    return text.replace("'", "")


def norm_cdf_sql(z: str) -> str:
    from tapeloom.functions.maths import _TAIL_BOTTOM, _TAIL_TOP

    x = f"least(abs({z}), 37e0)"
    top, bottom = (_poly(x, [f"{c!r}e0" for c in t]) for t in (_TAIL_TOP, _TAIL_BOTTOM))
    near = f"exp(-{x} * {x} / 2) * {top} / {bottom}"
    far = f"exp(-{x} * {x} / 2) / ({x} + 1e0 / ({x} + 2e0 / ({x} + 3e0 / ({x} + 4e0 / ({x} + 0.65e0))))) / 2.506628274631e0"
    tail = f"(CASE WHEN {x} < 7.07106781186547e0 THEN {near} ELSE {far} END)"
    return f"CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END"


@query("G17_probabilistic_sharpe", "symbol:s psr:f8", f"""
WITH m AS (SELECT symbol, CAST(count(net_return) AS DOUBLE) AS n, avg(net_return) AS mu, stddev_samp(net_return) AS sd,
                  skewness(net_return) AS sk, kurtosis(net_return) + 3 AS ku FROM v_bt_ma GROUP BY 1),
z AS (SELECT *, mu / sd * sqrt(n - 1) / sqrt(1 - sk * (mu / sd) + (ku - 1) / 4 * (mu / sd) * (mu / sd)) AS z FROM m
      WHERE n >= 4 AND 1 - sk * (mu / sd) + (ku - 1) / 4 * (mu / sd) * (mu / sd) > 0)
SELECT m.symbol, {norm_cdf_sql('z.z')} AS psr FROM m LEFT JOIN z USING (symbol)""")
def _(spark, sf):
    return _bt(spark, sf).groupBy("symbol").agg(G.probabilistic_sharpe("net_return").alias("psr"))
