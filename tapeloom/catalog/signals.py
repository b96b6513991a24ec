"""Signals, sizing and quotes."""

from pyspark.sql import functions as F

from tapeloom.catalog import bars as _bars  # noqa: F401  (shared views)
from tapeloom.catalog.spec import query, view
from tapeloom.operators import bars as B
from tapeloom.operators import signals as S
from tapeloom.sources import testtables as T

view("v_ma", """
SELECT *, CASE WHEN count(*) OVER l >= 20 THEN CASE WHEN avg(close) OVER s > avg(close) OVER l THEN 1e0 ELSE 0e0 END END AS position
FROM v_nbars WINDOW s AS (PARTITION BY symbol ORDER BY rn ROWS 4 PRECEDING), l AS (PARTITION BY symbol ORDER BY rn ROWS 19 PRECEDING)""")


@query("E1_ma_crossover", "symbol:s ts:t position:f1", "SELECT * FROM v_ma")
def _(spark, sf):
    return S.ma_crossover(T.indexed_hourly_bars(spark, sf), 5, 20)


view("v_boll", """
WITH RECURSIVE m AS (SELECT *, CASE WHEN count(*) OVER w >= 20 THEN avg(close) OVER w END AS mu,
                  CASE WHEN count(*) OVER w >= 20 THEN stddev_samp(close) OVER w END AS sd
           FROM v_nbars WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS 19 PRECEDING)),
walk AS (
  SELECT *, CASE WHEN mu IS NULL THEN NULL WHEN close < mu - 1.0e0 * sd THEN 1e0 ELSE 0e0 END AS position FROM m WHERE rn = 0
  UNION ALL
  SELECT m.*, CASE WHEN m.mu IS NULL THEN NULL
                   WHEN coalesce(w.position, 0) = 0 THEN CASE WHEN m.close < m.mu - 1.0e0 * m.sd THEN 1e0 ELSE 0e0 END
                   WHEN m.close > m.mu THEN 0e0 ELSE 1e0 END
  FROM walk w JOIN m ON m.symbol = w.symbol AND m.rn = w.rn + 1)
SELECT * FROM walk""")


@query("E2_bollinger", "symbol:s ts:t position:f1", "SELECT * FROM v_boll")
def _(spark, sf):
    return S.bollinger_mean_reversion(T.indexed_hourly_bars(spark, sf), 20, 1.0)


view("v_ofirev", """
WITH RECURSIVE z AS (SELECT *, CASE WHEN count(ofi) OVER w >= 20 THEN avg(ofi) OVER w END AS mu,
                  CASE WHEN count(ofi) OVER w >= 20 THEN stddev_samp(ofi) OVER w END AS sd
           FROM v_ofibars WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
t AS (SELECT symbol, ts, rn, CASE WHEN sd > 0 THEN (ofi - mu) / sd WHEN sd = 0 AND ofi > mu THEN 'inf'::DOUBLE
             WHEN sd = 0 AND ofi < mu THEN '-inf'::DOUBLE END AS z FROM z),
walk AS (
  SELECT symbol, ts, rn, 0e0 AS position, 0e0 AS current, 0 AS remaining FROM t WHERE rn = 0
  UNION ALL
  SELECT t.symbol, t.ts, t.rn,
    CASE WHEN t.z IS NULL THEN 0e0 WHEN w.remaining > 0 THEN w.current
         WHEN t.z > 1.5e0 THEN -1e0 WHEN t.z < -1.5e0 THEN 1e0 ELSE 0e0 END,
    CASE WHEN t.z IS NULL OR w.remaining > 0 THEN w.current WHEN t.z > 1.5e0 THEN -1e0 WHEN t.z < -1.5e0 THEN 1e0 ELSE 0e0 END,
    CASE WHEN t.z IS NULL THEN w.remaining WHEN w.remaining > 0 THEN w.remaining - 1
         WHEN abs(t.z) > 1.5e0 THEN 4 ELSE 0 END
  FROM walk w JOIN t ON t.symbol = w.symbol AND t.rn = w.rn + 1)
SELECT * FROM walk""")


@query("E3_ofi_mean_reversion", "symbol:s ts:t position:f1", "SELECT * FROM v_ofirev")
def _(spark, sf):
    bars = B.ofi_bars(T.trades(spark, sf), "1h", "30m")
    return S.ofi_mean_reversion(bars, 1.5, 5, 20)


@query("E3_ofi_mean_reversion_chained", "symbol:s ts:t position:f1", "SELECT * FROM v_ofirev")
def _(spark, sf):
    """Stretches that hold few signals, so that holds cross many of their borders."""
    bars = B.ofi_bars(T.trades(spark, sf), "1h", "30m")
    return S.ofi_mean_reversion(bars, 1.5, 5, 20, size=25)


@query("E4_predictions_to_positions", "doc_id:i direction:f1 returns:f1", """
SELECT doc_id, CASE WHEN pred > 0.55e0 THEN 1 WHEN pred < 0.45e0 THEN -1 ELSE 0 END AS direction,
       CASE WHEN pred > 0.3e0 THEN 1 WHEN pred < -0.3e0 THEN -1 ELSE 0 END AS returns FROM v_scores""")
def _(spark, sf):
    return T.scores(spark, sf).select(
        "doc_id",
        S.predictions_to_positions("pred", "direction", direction_band=0.05).alias("direction"),
        S.predictions_to_positions("pred", "return", return_band=0.3).alias("returns"),
    )


view("v_voltarget", """
WITH r AS (SELECT *, CASE WHEN rn = 0 THEN 0e0 ELSE ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY rn)) END AS r FROM v_ma),
v AS (SELECT *, CASE WHEN count(*) OVER w >= 24 THEN stddev_samp(r) OVER w END * sqrt(24e0) AS vol
      FROM r WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT symbol, ts, coalesce(position, 0) * CASE WHEN vol > 0 THEN least(2e0, 4e0 / vol) ELSE 0 END AS position FROM v""")


@query("E6_vol_target", "symbol:s ts:t position:f6", "SELECT * FROM v_voltarget")
def _(spark, sf):
    bars = S.ma_crossover(T.indexed_hourly_bars(spark, sf), 5, 20).withColumn("position", F.coalesce("position", F.lit(0.0)))
    return S.vol_target(bars, 4.0, 24, 24, 2.0)


@query("E7_market_making_quotes", "symbol:s agg_id:i reservation:f6 bid:f6 ask:f6", """
SELECT symbol, agg_id, price - inv * g AS reservation, price - inv * g - (g + h) AS bid, price - inv * g + (g + h) AS ask
FROM (SELECT *, (agg_id % 11 - 5) / 8e0 AS inv, 1e-5 * 25e0 * greatest(1e-9, (3600 - agg_id % 3600) * 1e0) AS g,
             2e0 / 1e-5 * ln(1 + 1e-5 / 1.5e0) AS h FROM v_trades)""")
def _(spark, sf):
    state = T.trades(spark, sf).withColumns(
        {
            "mid": F.col("price"),
            "inventory": (F.col("agg_id") % 11 - 5) / F.lit(8.0),
            "horizon_left": (3600 - F.col("agg_id") % 3600).cast("double"),
        }
    )
    return S.market_making_quotes(state, 1e-5, 5.0, 1.5)


@query("E8_fill_probability", "symbol:s agg_id:i p:f8", """
SELECT symbol, agg_id, CASE WHEN d < 0 THEN 1e0 ELSE 1 - exp(-0.5e0 * exp(-1.5e0 * d) * qty) END AS p
FROM (SELECT *, (price - 20) / 64 AS d FROM v_trades)""")
def _(spark, sf):
    trades = T.trades(spark, sf)
    return trades.withColumn("p", S.fill_probability((F.col("price") - 20) / 64, F.col("qty")))


@query("E9_markers", "symbol:s ts:t close:f4 marker:s", """
SELECT symbol, ts, close, CASE WHEN d > 0 THEN 'entry' ELSE 'exit' END AS marker FROM (
  SELECT *, p - coalesce(lag(p) OVER (PARTITION BY symbol ORDER BY rn), 0) AS d FROM (SELECT *, coalesce(position, 0) AS p FROM v_ma))
WHERE d <> 0""")
def _(spark, sf):
    bars = S.ma_crossover(T.indexed_hourly_bars(spark, sf), 5, 20)
    return S.markers(bars.withColumn("position", F.coalesce("position", F.lit(0.0))))
