"""Trade microstructure."""

from pyspark.sql import functions as F

from tapeloom.catalog import bars as _bars  # noqa: F401  (shared views)
from tapeloom.catalog.spec import query, view
from tapeloom.operators import bars as B
from tapeloom.operators import micro as M
from tapeloom.sources import testtables as T


@query("C1_signed_volume", "symbol:s agg_id:i ts:t signed_volume:f4", "SELECT *, sv AS signed_volume FROM v_trades")
def _(spark, sf):
    return M.signed_volume(T.trades(spark, sf))


@query("C2_order_flow_imbalance", "symbol:s ts:t ofi:f6", "SELECT * FROM v_ofi")
def _(spark, sf):
    return M.order_flow_imbalance(T.trades(spark, sf), "30m")


view("v_spread", """
SELECT t.symbol, t.agg_id, t.ts, 2 * abs(t.price - m.price) / nullif(m.price, 0) AS effective_spread
FROM v_trades t ASOF LEFT JOIN v_hour_last m ON t.symbol = m.symbol AND t.ts >= m.ts""")
view("v_hour_last", """
SELECT symbol, make_timestamp(epoch_us(ts) - epoch_us(ts) % 3600000000) AS ts, arg_max(price, (ts, agg_id)) AS price
FROM v_trades GROUP BY 1, 2""")


def _spreads(spark, sf):
    trades = T.trades(spark, sf)
    mid = B.resample_last(trades, "price", "1h", order=B.tick()).withColumnRenamed("price", "mid")
    return M.effective_spread(trades, mid)


@query("C3_effective_spread", "symbol:s agg_id:i ts:t effective_spread:f6", "SELECT * FROM v_spread")
def _(spark, sf):
    return _spreads(spark, sf)


@query("C4_microprice", "symbol:s ts:t microprice:e8", """
SELECT symbol, ts, CASE WHEN trades + volume > 0 THEN (low * volume + high * trades) / (trades + volume) END AS microprice
FROM v_bars""")
def _(spark, sf):
    bars = T.hourly_bars(spark, sf)
    return bars.withColumn("microprice", M.microprice(F.col("low"), F.col("high"), F.col("trades"), F.col("volume")))


view("v_impact", """
SELECT symbol, ts, signed_vol, close, abs(close - lag(close) OVER w) AS delta_p_abs, abs(signed_vol) AS abs_signed_vol
FROM (SELECT symbol, make_timestamp(epoch_us(ts) - epoch_us(ts) % 3600000000) AS ts, sum(sv) AS signed_vol,
             arg_max(price, (ts, agg_id)) AS close FROM v_trades GROUP BY 1, 2)
WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")


@query("C5_impact_rows", "symbol:s ts:t signed_vol:f4 close:f4 delta_p_abs:f4 abs_signed_vol:f4",
       "SELECT * FROM v_impact WHERE delta_p_abs IS NOT NULL")
def _(spark, sf):
    return M.impact_rows(T.trades(spark, sf), "1h")


@query("C5_kyle_lambda", "symbol:s n:i kyle_lambda:e8", """
SELECT symbol, count(*) AS n, CASE WHEN count(*) >= 5 THEN
       sum(delta_p_abs * abs_signed_vol) / nullif(sum(abs_signed_vol * abs_signed_vol), 0) END AS kyle_lambda
FROM v_impact WHERE delta_p_abs IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return M.kyle_lambda(M.impact_rows(T.trades(spark, sf), "1h"))


@query("C6_trade_size_distribution", "symbol:s n:i p50:f6 p90:f6 p99:f6 p999:f6 hill_alpha:e8 whale_threshold:f6", """
WITH q AS (SELECT symbol, count(*) AS n, quantile_cont(qty, 0.5e0) AS p50, quantile_cont(qty, 0.9e0) AS p90,
                  quantile_cont(qty, 0.99e0) AS p99, quantile_cont(qty, 0.999e0) AS p999 FROM v_trades WHERE qty > 0 GROUP BY 1),
r AS (SELECT t.symbol, t.qty, row_number() OVER (PARTITION BY t.symbol ORDER BY t.qty DESC) AS place,
             greatest(20, CAST(floor(0.05e0 * n) AS BIGINT)) AS k FROM v_trades t JOIN q USING (symbol) WHERE qty > 0),
h AS (SELECT symbol, avg(ln(qty / cut)) AS tail FROM (SELECT *, min(qty) OVER (PARTITION BY symbol) AS cut FROM r WHERE place <= k)
      GROUP BY 1)
SELECT symbol, n, CASE WHEN n >= 100 THEN p50 END AS p50, CASE WHEN n >= 100 THEN p90 END AS p90,
       CASE WHEN n >= 100 THEN p99 END AS p99, CASE WHEN n >= 100 THEN p999 END AS p999,
       CASE WHEN n >= 100 THEN 1e0 / tail END AS hill_alpha, CASE WHEN n >= 100 THEN p99 END AS whale_threshold
FROM q JOIN h USING (symbol)""")
def _(spark, sf):
    return M.trade_size_distribution(T.trades(spark, sf))


@query("C7_trade_summary", "symbol:s n:i first_ts:t last_ts:t taker_buy_fraction:f6 min_price:f4 max_price:f4", """
SELECT symbol, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, avg(CASE WHEN is_buyer_maker THEN 0e0 ELSE 1e0 END)
       AS taker_buy_fraction, min(price) AS min_price, max(price) AS max_price FROM v_trades GROUP BY 1""")
def _(spark, sf):
    return M.trade_summary(T.trades(spark, sf))


@query("C8_arrival_heatmap", "symbol:s dow:i hour:i trades:i", """
SELECT s.symbol, d.dow, h.hour, count(t.agg_id) AS trades
FROM (SELECT DISTINCT symbol FROM v_trades) s, (SELECT unnest(range(7)) AS dow) d, (SELECT unnest(range(24)) AS hour) h
LEFT JOIN v_trades t ON t.symbol = s.symbol AND isodow(t.ts) - 1 = d.dow AND hour(t.ts) = h.hour
GROUP BY 1, 2, 3""")
def _(spark, sf):
    return M.arrival_heatmap(T.trades(spark, sf))


@query("C9_trade_size_histogram", "symbol:s bin:i n:i", """
SELECT symbol, floor(qty / 0.0625e0) AS bin, count(*) AS n FROM v_trades WHERE qty > 0 GROUP BY 1, 2""")
def _(spark, sf):
    return M.trade_size_histogram(T.trades(spark, sf), 0.0625)


@query("C9_spread_histogram", "symbol:s bin:i n:i", """
WITH b AS (SELECT symbol, effective_spread * 1e4 AS bps FROM v_spread WHERE effective_spread IS NOT NULL),
top AS (SELECT symbol, quantile_cont(bps, 0.999e0) AS cut FROM b GROUP BY 1)
SELECT symbol, floor(bps / 64e0) AS bin, count(*) AS n FROM b JOIN top USING (symbol) WHERE bps <= cut GROUP BY 1, 2""")
def _(spark, sf):
    return M.spread_histogram(_spreads(spark, sf), 64.0)


@query("C9_volume_histogram", "symbol:s bin:i n:i outliers:i", """
SELECT symbol, floor(volume / 0.25e0) AS bin, count(*) AS n, count(*) FILTER (trades >= 6) AS outliers FROM v_bars GROUP BY 1, 2""")
def _(spark, sf):
    bars = T.hourly_bars(spark, sf)
    return M.volume_histogram(bars, bars.where("trades >= 6"), 0.25)
