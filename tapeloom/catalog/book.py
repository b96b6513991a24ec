"""Order books."""

from pyspark.sql import functions as F

from tapeloom.catalog import views as _views  # noqa: F401  (shared views)
from tapeloom.catalog.spec import query, view
from tapeloom.operators import book as O
from tapeloom.sources import testtables as T


def _priced(spark, sf):
    from tapeloom.plans.joins import asof_join

    depth, daily = T.book_depth(spark, sf), T.daily_bars(spark, sf)
    mids = asof_join(depth.select("symbol", "ts").distinct(), daily, ["close"], bucket="1d")
    return depth.join(mids.where("close > 0").withColumnRenamed("close", "mid"), ["symbol", "ts"])


view("v_levels", """
SELECT symbol, ts, side, price, size FROM (
  SELECT d.symbol, d.ts, CASE WHEN percentage < 0 THEN 'bid' ELSE 'ask' END AS side,
         m.close * (1 + percentage / 100) AS price,
         greatest(0e0, depth - lag(depth, 1, 0) OVER (PARTITION BY d.symbol, d.ts, percentage < 0 ORDER BY abs(percentage))) AS size
  FROM v_depth d JOIN (SELECT s.symbol, s.ts, b.close FROM (SELECT DISTINCT symbol, ts FROM v_depth) s
                       ASOF JOIN v_daily b ON s.symbol = b.symbol AND s.ts >= b.ts) m
  ON d.symbol = m.symbol AND d.ts = m.ts WHERE m.close > 0 AND percentage <> 0)
WHERE size > 0""")
view("v_bbo", """
SELECT symbol, ts, max(price) FILTER (side = 'bid') AS bid_price, arg_max(size, price) FILTER (side = 'bid') AS bid_size,
       min(price) FILTER (side = 'ask') AS ask_price, arg_min(size, price) FILTER (side = 'ask') AS ask_size
FROM v_levels GROUP BY 1, 2
HAVING count(*) FILTER (side = 'bid') > 0 AND count(*) FILTER (side = 'ask') > 0""")
view("v_tob", """
SELECT *, (bid_price + ask_price) * 0.5e0 AS mid, ask_price - bid_price AS spread,
       CASE WHEN bid_size + ask_size > 0 THEN (bid_price * ask_size + ask_price * bid_size) / (bid_size + ask_size)
            ELSE (bid_price + ask_price) * 0.5e0 END AS microprice,
       CASE WHEN bid_size + ask_size > 0 THEN (bid_size - ask_size) / (bid_size + ask_size) ELSE 0 END AS imbalance
FROM v_bbo""")


@query("D1_depth_levels", "symbol:s ts:t side:s price:e9 size:f4", "SELECT * FROM v_levels")
def _(spark, sf):
    return O.depth_levels(_priced(spark, sf))


_BBO = "symbol:s ts:t bid_price:e9 bid_size:f4 ask_price:e9 ask_size:f4"


@query("D2_replay_depth", _BBO, "SELECT * FROM v_bbo")
def _(spark, sf):
    return O.replay_depth(T.book_depth(spark, sf), T.daily_bars(spark, sf))


@query("D3_top_of_book", _BBO + " mid:e9 spread:e9 microprice:e9 imbalance:f6", "SELECT * FROM v_tob")
def _(spark, sf):
    return O.top_of_book(T.book_depth(spark, sf), T.daily_bars(spark, sf))


view("v_book", """
WITH cuts AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 12 HOUR)) AS cut FROM (
       SELECT symbol, make_timestamp(-((-epoch_us(min(ts))) - (((-epoch_us(min(ts))) % 43200000000) + 43200000000) % 43200000000)) AS lo,
              make_timestamp(-((-epoch_us(max(ts))) - (((-epoch_us(max(ts))) % 43200000000) + 43200000000) % 43200000000)) AS hi
       FROM v_updates GROUP BY 1)),
last AS (SELECT c.symbol, c.cut AS ts, u.side, u.price, arg_max(u.size, (u.ts, u.seq)) AS size
         FROM cuts c JOIN v_updates u ON u.symbol = c.symbol AND u.ts <= c.cut GROUP BY 1, 2, 3, 4)
SELECT * FROM last WHERE size > 0""")


def _book(spark, sf):
    return O.book_at(T.book_updates(spark, sf), "12h")


@query("D4_book_at", "symbol:i ts:t side:s price:f2 size:f4", "SELECT * FROM v_book")
def _(spark, sf):
    return _book(spark, sf)


view("v_snapshots", """
SELECT symbol, seq, ts, side, CASE WHEN seq % 291 <> 0 THEN price END AS price, CASE WHEN seq % 291 <> 0 THEN size END AS size, seq % 97 = 0 AS is_snapshot FROM v_updates""")


@query("D4_book_at_snapshots", "symbol:i ts:t side:s price:f2 size:f4", """
WITH c AS (SELECT symbol, unnest(range(first, last + INTERVAL 12 HOUR, INTERVAL 12 HOUR)) AS cut FROM (
             SELECT symbol, min(time_bucket(INTERVAL 12 HOUR, ts + INTERVAL 12 HOUR - INTERVAL 1 MICROSECOND, TIMESTAMP '1970-01-01')) AS first,
                    max(time_bucket(INTERVAL 12 HOUR, ts + INTERVAL 12 HOUR - INTERVAL 1 MICROSECOND, TIMESTAMP '1970-01-01')) AS last FROM v_snapshots GROUP BY 1)),
e AS (SELECT c.symbol, c.cut, u.side, max(u.seq) FILTER (u.is_snapshot) AS epoch FROM c JOIN v_snapshots u ON u.symbol = c.symbol AND u.ts <= c.cut GROUP BY 1, 2, 3),
l AS (SELECT e.symbol, e.cut AS ts, e.side, u.price, arg_max(u.size, u.seq) AS size FROM e
      JOIN v_snapshots u ON u.symbol = e.symbol AND u.side = e.side AND u.ts <= e.cut AND u.seq >= coalesce(e.epoch, 0) AND u.price IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT * FROM l WHERE size > 0""")
def _(spark, sf):
    """Whole-side snapshots, empty ones included."""
    return O.book_at(T.with_snapshots(T.book_updates(spark, sf)), "12h")


view("v_top", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts, side
       ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS level FROM v_book) WHERE level <= 5""")


@query("D5_depth_n", "symbol:i ts:t side:s level:i price:f2 size:f4", "SELECT * FROM v_top")
def _(spark, sf):
    return O.depth_n(_book(spark, sf), 5)


@query("D5_depth_arrays", "symbol:i ts:t n_bids:i n_asks:i best_bid:f2 worst_ask:f2", """
SELECT symbol, ts, count(*) FILTER (side = 'bid') AS n_bids, count(*) FILTER (side = 'ask') AS n_asks,
       max(price) FILTER (side = 'bid') AS best_bid, max(price) FILTER (side = 'ask') AS worst_ask FROM v_top GROUP BY 1, 2""")
def _(spark, sf):
    out = O.depth_arrays(_book(spark, sf), 5)
    return out.withColumns(
        {
            "n_bids": F.size("bids"),
            "n_asks": F.size("asks"),
            "best_bid": F.get("bids", 0)["price"],
            "worst_ask": F.get("asks", F.size("asks") - 1)["price"],
        }
    )


@query("D6_depth_imbalance", "symbol:i ts:t imbalance:f6", """
SELECT symbol, ts, coalesce(sum(CASE WHEN side = 'bid' THEN size ELSE -size END) / nullif(sum(size), 0), 0) AS imbalance
FROM v_top GROUP BY 1, 2""")
def _(spark, sf):
    return O.depth_imbalance(_book(spark, sf))


@query("D7_validate_book", "symbol:i ts:t levels:i bids:i asks:i bad_price:i bad_size:i crossed:b", """
SELECT symbol, ts, count(*) AS levels, count(*) FILTER (side = 'bid') AS bids, count(*) FILTER (side = 'ask') AS asks,
       count(*) FILTER (price <= 0) AS bad_price, count(*) FILTER (size <= 0) AS bad_size,
       coalesce(max(price) FILTER (side = 'bid') >= min(price) FILTER (side = 'ask'), false) AS crossed
FROM v_book GROUP BY 1, 2""")
def _(spark, sf):
    return O.validate_book(_book(spark, sf))


view("v_queue", """
SELECT event_id AS seq, user_id % 100 AS order_id, CASE WHEN event_id % 3 = 0 THEN 'trade' ELSE 'level' END AS kind,
       CASE WHEN event_id % 3 = 0 THEN value / 64 ELSE value * 16 END AS qty FROM events""")


@query("D8_queue_position", "order_id:i seq:i shares_ahead:f6 at_front:b", """
WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY seq) AS k FROM v_queue),
walk AS (
  SELECT order_id, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS seq, 1000e0 AS ahead, 2000e0 AS size FROM (SELECT DISTINCT order_id FROM v_queue)
  UNION ALL
  SELECT w.order_id, n.k, n.seq,
         CASE WHEN n.kind = 'trade' THEN greatest(0e0, w.ahead - n.qty)
              WHEN n.qty >= w.size THEN w.ahead
              WHEN w.size <= 0 THEN 0e0
              ELSE greatest(0e0, w.ahead - (w.size - n.qty) * (w.ahead / w.size)) END,
         CASE WHEN n.kind = 'level' THEN n.qty ELSE w.size END
  FROM walk w JOIN numbered n ON n.order_id = w.order_id AND n.k = w.k + 1)
SELECT order_id, seq, ahead AS shares_ahead, ahead < 5e-10 AS at_front FROM walk WHERE k > 0""")
def _(spark, sf):
    events = T.table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        (F.col("user_id") % 100).alias("order_id"),
        F.when(F.col("event_id") % 3 == 0, "trade").otherwise("level").alias("kind"),
        F.when(F.col("event_id") % 3 == 0, F.col("value") / 64).otherwise(F.col("value") * 16).alias("qty"),
    )
    orders = events.select("order_id").distinct().withColumns({"shares_ahead": F.lit(1000.0), "level_size": F.lit(2000.0)})
    return O.queue_position(events, orders)


@query("D9_book_summary", "symbol:s snapshots:i mean_spread_bps:f6 mean_imbalance:f8 min_mid:e9 max_mid:e9", """
SELECT symbol, count(*) AS snapshots, avg(spread / mid * 1e4) AS mean_spread_bps, avg(imbalance) AS mean_imbalance,
       min(mid) AS min_mid, max(mid) AS max_mid FROM v_tob GROUP BY 1""")
def _(spark, sf):
    return O.book_summary(O.top_of_book(T.book_depth(spark, sf), T.daily_bars(spark, sf)))


@query("D9_spread_bps", "symbol:s ts:t spread_bps:f6", "SELECT symbol, ts, spread / mid * 1e4 AS spread_bps FROM v_tob")
def _(spark, sf):
    return O.spread_bps(O.top_of_book(T.book_depth(spark, sf), T.daily_bars(spark, sf)))
