"""The test tables as market data, in SQL."""

from tapeloom.catalog.spec import view

view("v_trades", """
SELECT event_id AS agg_id, event_type AS symbol, ts, value AS price,
       (CAST(json_extract_string(props, '$.k') AS INT) + 1) / 100.0e0 AS qty, (user_id % 2 = 0) AS is_buyer_maker,
       CASE WHEN user_id % 2 = 0 THEN -1 ELSE 1 END * (CAST(json_extract_string(props, '$.k') AS INT) + 1) / 100.0e0 AS sv
FROM events""")


def bars_sql(step_us: int) -> str:
    return f"""
SELECT symbol, make_timestamp(epoch_us(ts) - epoch_us(ts) % {step_us}) AS ts, arg_min(price, (ts, agg_id)) AS open,
       max(price) AS high, min(price) AS low, arg_max(price, (ts, agg_id)) AS close, sum(qty) AS volume, count(*) AS trades
FROM v_trades GROUP BY 1, 2"""


view("v_bars", bars_sql(3_600_000_000))
view("v_nbars", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM v_bars")
view("v_daily", """
SELECT 'ORD' AS symbol, o_orderdate AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
       min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM orders GROUP BY 2""")
view("v_ndaily", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM v_daily")
view("v_updates", """
SELECT event_id AS seq, ts, user_id % 5 AS symbol, CASE WHEN user_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
       CASE WHEN user_id % 2 = 0 THEN 100.0e0 - (CAST(json_extract_string(props, '$.k') AS INT) % 50)
            ELSE 101.0e0 + (CAST(json_extract_string(props, '$.k') AS INT) % 50) END AS price,
       CASE WHEN event_type = 'error' THEN 0.0e0 ELSE value END AS size
FROM events""")
view("v_depth", """
WITH lv AS (SELECT l_shipdate AS ts, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS sgn,
                   least(l_linenumber, 6) AS lvl, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3)
SELECT 'ORD' AS symbol, ts, sgn * (CASE lvl WHEN 1 THEN 0.2e0 WHEN 2 THEN 1.0e0 WHEN 3 THEN 2.0e0 WHEN 4 THEN 3.0e0
       WHEN 5 THEN 4.0e0 ELSE 5.0e0 END) AS percentage,
       sum(q) OVER (PARTITION BY ts, sgn ORDER BY lvl ROWS UNBOUNDED PRECEDING) AS depth
FROM lv""")
view("v_fills", """
SELECT event_id AS fill_id, ts, user_id % 5 AS symbol, CASE WHEN user_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
       value AS price, 0.01e0 AS qty
FROM events""")
view("v_scores", "SELECT doc_id, least(1.0e0, n_chars / 5000.0e0) AS pred FROM documents")
view("v_predictions", """
SELECT d.lang AS symbol, d.doc_id, least(1.0e0, d.n_chars / 5000.0e0) AS pred, CAST(l.quality AS DOUBLE) AS actual
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
