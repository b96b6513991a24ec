"""Bars and resampling."""


from tapeloom.catalog import views as _views  # noqa: F401  (shared views)
from tapeloom.catalog.spec import query, view
from tapeloom.operators import bars as B
from tapeloom.sources import testtables as T

_BAR = "symbol:s ts:t open:f4 high:f4 low:f4 close:f4 volume:f6 trades:i"


@query("B1_time_bars", _BAR, "SELECT * FROM v_bars")
def _(spark, sf):
    return B.time_bars(T.trades(spark, sf), "1h")


def _accumulated(weight: str, threshold: str) -> str:
    return f"""
SELECT symbol, CAST(floor(cum / {threshold}) AS BIGINT) AS bar, max(ts) AS ts, arg_min(price, (ts, agg_id)) AS open,
       max(price) AS high, min(price) AS low, arg_max(price, (ts, agg_id)) AS close, sum(qty) AS volume,
       count(*) AS trades, sum(price * qty) AS dollar_volume
FROM (SELECT *, sum(CAST({weight} AS DECIMAL(18, 8))) OVER
             (PARTITION BY symbol ORDER BY ts, agg_id ROWS UNBOUNDED PRECEDING) AS cum FROM v_trades)
GROUP BY 1, 2"""


_THRESHOLD = "symbol:s bar:i ts:t open:f4 high:f4 low:f4 close:f4 volume:f6 trades:i dollar_volume:f4"


@query("B2_volume_bars", _THRESHOLD, _accumulated("qty", "5"))
def _(spark, sf):
    return B.volume_bars(T.trades(spark, sf), 5.0)


@query("B3_dollar_bars", _THRESHOLD, _accumulated("price * qty", "256"))
def _(spark, sf):
    return B.dollar_bars(T.trades(spark, sf), 256.0)


view("v_minute_last", """
SELECT symbol, make_timestamp(epoch_us(ts) - epoch_us(ts) % 60000000) AS ts, arg_max(price, (ts, agg_id)) AS price
FROM v_trades GROUP BY 1, 2""")


@query("B4_resample_last_filled", "symbol:s ts:t price:f4", """
SELECT g.symbol, g.ts, last_value(m.price IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.ts) AS price
FROM (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 MINUTE)) AS ts FROM v_minute_last GROUP BY 1) g
LEFT JOIN v_minute_last m ON m.symbol = g.symbol AND m.ts = g.ts""")
def _(spark, sf):
    return B.resample_last_filled(T.trades(spark, sf), "price", "1m", order=B.tick())


view("v_ofi", """
SELECT DISTINCT symbol, ts, greatest(-1e0, least(1e0,
       sum(sv) OVER w / nullif(sum(abs(sv)) OVER w, 0))) AS ofi
FROM v_trades WINDOW w AS (PARTITION BY symbol ORDER BY epoch_us(ts) RANGE BETWEEN 1799999999 PRECEDING AND CURRENT ROW)""")


@query("B5_resample_last", "symbol:s ts:t ofi:f6", """
SELECT symbol, make_timestamp(epoch_us(ts) - epoch_us(ts) % 3600000000) AS ts, arg_max(ofi, ts) AS ofi
FROM v_ofi WHERE ofi IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    from tapeloom.operators.micro import order_flow_imbalance

    return B.resample_last(order_flow_imbalance(T.trades(spark, sf), "30m"), "ofi", "1h")


view("v_ofibars", """
SELECT b.*, coalesce(o.ofi, 0e0) AS ofi, row_number() OVER (PARTITION BY b.symbol ORDER BY b.ts) - 1 AS rn
FROM v_bars b ASOF LEFT JOIN v_ofi o ON b.symbol = o.symbol AND b.ts >= o.ts""")


@query("B6_ofi_bars", _BAR + " ofi:f6", "SELECT * FROM v_ofibars")
def _(spark, sf):
    return B.ofi_bars(T.trades(spark, sf), "1h", "30m")


@query("B7_stride_downsample", "symbol:s agg_id:i ts:t price:f4", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, agg_id) - 1 AS rn,
                      count(*) OVER (PARTITION BY symbol) AS n FROM v_trades)
WHERE rn % (CASE WHEN n > 600 THEN n // 500 ELSE 1 END) = 0""")
def _(spark, sf):
    return B.stride_downsample(T.trades(spark, sf), limit=600, target=500, order=("ts", "agg_id"), bucket="1h")


@query("B8_lttb", "symbol:s ts:t close:f4", """
WITH RECURSIVE p AS (SELECT symbol, ts, rn, CAST(epoch_us(ts) AS DOUBLE) AS x, close AS y, count(*) OVER (PARTITION BY symbol) AS n FROM v_nbars),
g AS (SELECT *, (n - 2) / 98e0 AS width, CAST(floor((rn - 1) / ((n - 2) / 98e0)) AS BIGINT) AS guess FROM p WHERE n > 100),
b AS MATERIALIZED (SELECT *, CASE WHEN rn = 0 THEN -1 WHEN rn = n - 1 THEN 98 WHEN rn < floor(guess * width) + 1 THEN guess - 1
        WHEN rn >= floor((guess + 1) * width) + 1 THEN guess + 1 ELSE guess END AS bucket FROM g),
m AS MATERIALIZED (SELECT symbol, bucket, avg(x) AS mx, avg(y) AS my FROM b GROUP BY 1, 2),
walk AS (
  SELECT symbol, CAST(-1 AS BIGINT) AS bucket, rn, x, y FROM b WHERE rn = 0
  UNION ALL
  SELECT symbol, bucket, best.rn, best.x, best.y FROM (
    SELECT w.symbol, w.bucket + 1 AS bucket, arg_max({'rn': c.rn, 'x': c.x, 'y': c.y}, (abs((w.x - m.mx) * (c.y - w.y) - (c.x - w.x) * (m.my - w.y)), -c.rn)) AS best
    FROM walk w JOIN b c ON c.symbol = w.symbol AND c.bucket = w.bucket + 1 AND w.bucket + 1 < 98
    JOIN m ON m.symbol = w.symbol AND m.bucket = w.bucket + 2 GROUP BY 1, 2)),
k AS (SELECT symbol, rn FROM walk UNION ALL SELECT symbol, rn FROM b WHERE bucket = 98 UNION ALL SELECT symbol, rn FROM p WHERE n <= 100)
SELECT symbol, ts, close FROM v_nbars JOIN k USING (symbol, rn)""")
def _(spark, sf):
    return B.lttb(T.indexed_hourly_bars(spark, sf), "close", 100)


