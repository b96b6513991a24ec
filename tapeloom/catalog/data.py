"""Sources, sinks and schema checks."""

import uuid

import pandas as pd
from pyspark.sql import functions as F

from tapeloom import schema as Z
from tapeloom.catalog import views as _views  # noqa: F401  (shared views)
from tapeloom.catalog.spec import query
from tapeloom.functions import clock
from tapeloom.plans.stage import shared_folder
from tapeloom.sources import archives, store
from tapeloom.sources import testtables as T


def _folder(spark, name):
    return f"{shared_folder(spark)}/tapeloom-{name}-{uuid.uuid4().hex}"


def _raw_trades(spark, sf):
    """Trades as the eight text fields of an archive."""
    t = T.trades(spark, sf)
    us = clock.micros("ts")
    return t.select(
        "symbol", F.to_date("ts").alias("date"),
        F.col("agg_id").cast("string").alias("agg_id"), F.col("price").cast("string").alias("price"),
        F.col("qty").cast("string").alias("qty"), F.col("agg_id").cast("string").alias("first_id"),
        F.col("agg_id").cast("string").alias("last_id"),
        F.when(F.col("agg_id") % 3 == 0, F.floor(us / 1_000_000)).when(F.col("agg_id") % 3 == 1, F.floor(us / 1000)).otherwise(us).cast("string").alias("ts"),
        F.when(F.col("is_buyer_maker"), "True").otherwise("False").alias("is_buyer_maker"),
        F.lit("True").alias("is_best_match"),
    )


_TRADE = "agg_id:i price:f4 qty:f4 first_id:i last_id:i ts:t is_buyer_maker:b"
_COERCED = """
SELECT symbol, agg_id, price, qty, agg_id AS first_id, agg_id AS last_id, is_buyer_maker, CAST(ts AS DATE) AS date,
       CASE agg_id % 3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('millisecond', ts) ELSE ts END AS ts FROM v_trades"""


@query("A1_read_depth_csv", "ts:t percentage:f2 depth:f4 notional:f1", "SELECT ts, percentage, depth, 0e0 AS notional FROM v_depth")
def _(spark, sf):
    path = _folder(spark, "csv")
    depth = T.book_depth(spark, sf).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "percentage", "depth", "notional")
    depth.write.option("header", True).csv(path)
    return archives.read_depth_csv(spark, path)


@query("A2_read_trades_csv", _TRADE, _COERCED)
def _(spark, sf):
    path = _folder(spark, "csv")
    _raw_trades(spark, sf).drop("symbol", "date").write.csv(path)
    return archives.read_trades_csv(spark, path)


def _with_bad_lines(spark, sf):
    """Raw trades where every 50th id, price and flag does not parse."""
    nth = F.col("first_id").cast("long") % 50
    return _raw_trades(spark, sf).withColumns({
        "agg_id": F.when(nth == 0, F.concat(F.lit("x"), "agg_id")).otherwise(F.col("agg_id")),
        "price": F.when(nth == 1, "oops").otherwise(F.col("price")),
        "is_buyer_maker": F.when(nth == 2, "maybe").otherwise(F.col("is_buyer_maker")),
    })


@query("A2_trade_rejects", "first_id:i reason:s", """
SELECT agg_id AS first_id, CASE agg_id % 50 WHEN 0 THEN 'agg_id' WHEN 1 THEN 'price' ELSE 'is_buyer_maker' END AS reason
FROM v_trades WHERE agg_id % 50 < 3""")
def _(spark, sf):
    path = _folder(spark, "csv")
    _with_bad_lines(spark, sf).drop("symbol", "date").write.csv(path)
    return archives.trade_rejects(archives.raw_trades_csv(spark, path))


@query("A2_trades_without_rejects", _TRADE, f"SELECT * FROM ({_COERCED}) WHERE agg_id % 50 > 2")
def _(spark, sf):
    return archives.parse_trades(_with_bad_lines(spark, sf), bad="skip")


@query("A3_epoch_units", "agg_id:i ts:t", _COERCED)
def _(spark, sf):
    raw = _raw_trades(spark, sf)
    return raw.select("agg_id", clock.coerce_epoch(F.col("ts").cast("long")).alias("ts"))


def _zip(rows: pd.DataFrame) -> pd.DataFrame:
    """One zipped archive per symbol and day, with a header line."""
    import io
    import zipfile

    symbol, date = rows["symbol"].iloc[0], rows["date"].iloc[0]
    name = f"{symbol}-aggTrades-{date}"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(f"{name}.csv", rows.drop(columns=["symbol", "date"]).to_csv(index=False))
    return pd.DataFrame({"path": [f"/data/{name}.zip"], "content": [buffer.getvalue()]})


@query("A4_unzip_archives", "symbol:s " + _TRADE, _COERCED)
def _(spark, sf):
    files = _raw_trades(spark, sf).groupBy("symbol", "date").applyInPandas(_zip, "path string, content binary")
    return archives.zipped_trades(archives.unzip_lines(files))


def _zip_depth(rows: pd.DataFrame) -> pd.DataFrame:
    """One zipped archive of depth lines per day."""
    import io
    import zipfile

    name = f"BOOK-bookDepth-{rows['date'].iloc[0]}"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(f"{name}.csv", rows.drop(columns=["date"]).to_csv(index=False))
    return pd.DataFrame({"path": [f"/data/{name}.zip"], "content": [buffer.getvalue()]})


@query("A4_unzip_depth", "symbol:s ts:t percentage:f2 depth:f4 notional:f1", "SELECT 'BOOK' AS symbol, ts, percentage, depth, 0e0 AS notional FROM v_depth")
def _(spark, sf):
    depth = T.book_depth(spark, sf).select(F.to_date("ts").alias("date"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "percentage", "depth", "notional")
    files = depth.groupBy("date").applyInPandas(_zip_depth, "path string, content binary")
    return archives.zipped_depth(archives.unzip_lines(files))


def _dated(spark, sf):
    root = _folder(spark, "trades")
    store.write_by_date(T.trades(spark, sf), root)
    return root


_STORED = "symbol:s agg_id:i ts:t price:f4 qty:f4 is_buyer_maker:b"


@query("A5_load_range", _STORED, "SELECT * FROM v_trades WHERE symbol = 'view' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
def _(spark, sf):
    return store.load_range(spark, _dated(spark, sf), "view", "2024-01-05", "2024-01-12")


@query("A6_load_symbol", _STORED, "SELECT * FROM v_trades WHERE symbol = 'click'")
def _(spark, sf):
    return store.load_symbol(spark, _dated(spark, sf), "click")


_BAR = "symbol:s ts:t open:f4 high:f4 low:f4 close:f4 volume:f4"


@query("A7_merge_bars", _BAR, """
WITH m AS (SELECT * REPLACE (CASE WHEN day(ts) >= 10 THEN close * 2 ELSE close END AS close) FROM v_bars)
SELECT * FROM m WHERE ts >= TIMESTAMP '2024-01-05 07:00:00'""")
def _(spark, sf):
    import datetime as dt

    bars = T.hourly_bars(spark, sf).drop("trades")
    stored = bars.where(F.dayofmonth("ts") <= 20)
    fresh = bars.where(F.dayofmonth("ts") >= 10).withColumn("close", F.col("close") * 2)
    return store.keep_recent(store.merge_bars(stored, fresh), dt.datetime(2024, 1, 25, 7, 30), 20, "1h")


@query("A8_stitch_pages", _BAR, "SELECT * FROM v_bars")
def _(spark, sf):
    bars = T.hourly_bars(spark, sf).withColumns(
        {"ts_ms": F.unix_millis(F.col("ts").cast("timestamp")), "page": F.dayofmonth("ts"), "pos": F.hour("ts")}
    )
    again = bars.withColumns({"page": F.col("page") + 1, "close": F.col("close") + 1})  # later pages repeat bars
    return store.stitch_pages(bars.unionByName(again).drop("ts", "trades"))


@query("A9_manifest", "symbol:s timeframe:s first_ts:t last_ts:t rows:i",
       "SELECT symbol, '1h' AS timeframe, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS rows FROM v_bars GROUP BY 1")
def _(spark, sf):
    return store.manifest(T.hourly_bars(spark, sf), "1h")


@query("A10_check_bars", "rule:s rows:i", """
WITH b AS (SELECT symbol, ts, CASE WHEN trades = 4 THEN -open ELSE open END AS open, CASE WHEN trades = 5 THEN 'inf'::DOUBLE ELSE high END AS high,
                  low, CASE WHEN trades = 6 THEN NULL ELSE close END AS close, CASE WHEN trades = 7 THEN 0 ELSE volume END AS volume FROM v_bars)
SELECT 'nan' AS rule, count(*) FILTER (close IS NULL) AS rows FROM b UNION ALL SELECT 'infinite', count(*) FILTER (isinf(high)) FROM b UNION ALL
SELECT 'non_positive_price', count(*) FILTER (open <= 0) FROM b UNION ALL SELECT 'negative_volume', count(*) FILTER (volume < 0) FROM b UNION ALL
SELECT 'null_time', count(*) FILTER (ts IS NULL) FROM b UNION ALL SELECT 'zero_volume', count(*) FILTER (volume = 0) FROM b UNION ALL
SELECT 'duplicate_time', 0""")
def _(spark, sf):
    n = F.col("trades")
    bars = T.hourly_bars(spark, sf).select(
        "symbol", "ts", F.when(n == 4, -F.col("open")).otherwise(F.col("open")).alias("open"),
        F.when(n == 5, F.lit(float("inf"))).otherwise(F.col("high")).alias("high"), "low",
        F.when(n == 6, F.lit(None)).otherwise(F.col("close")).alias("close"),
        F.when(n == 7, F.lit(0.0)).otherwise(F.col("volume")).alias("volume"),
    )
    return Z.check_bars(bars, allow_zero_volume=False)


@query("A11_check_trades", "rule:s rows:i", """
WITH t AS (SELECT *, CASE WHEN agg_id % 97 = 0 THEN ts - INTERVAL 1 DAY ELSE ts END AS t2, CASE WHEN agg_id % 10 = 0 THEN 0 ELSE price END AS p2 FROM v_trades)
SELECT 'non_positive_price' AS rule, count(*) FILTER (p2 <= 0) AS rows FROM t UNION ALL
SELECT 'non_positive_qty', count(*) FILTER (qty <= 0) FROM t UNION ALL SELECT 'null_time', count(*) FILTER (t2 IS NULL) FROM t UNION ALL
SELECT 'time_order', count(*) FILTER (t2 < top) FROM (SELECT *, max(t2) OVER (PARTITION BY symbol ORDER BY agg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM t)""")
def _(spark, sf):
    t = T.trades(spark, sf)
    late = F.when(F.col("agg_id") % 97 == 0, F.col("ts") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts"))
    return Z.check_trades(t.withColumns({"ts": late, "price": F.when(F.col("agg_id") % 10 == 0, F.lit(0.0)).otherwise(F.col("price"))}))


@query("A12_timeframes", "timeframe:s seconds:i bars_per_year:i bars:i", """
SELECT timeframe, seconds, bars_per_year, count(DISTINCT (symbol, epoch_us(ts) // (seconds * CAST(1000000 AS BIGINT)))) AS bars
FROM v_trades, (VALUES ('1m', 60, 525600), ('5m', 300, 105120), ('15m', 900, 35040), ('1h', 3600, 8760), ('4h', 14400, 2190), ('1d', 86400, 365)) f(timeframe, seconds, bars_per_year)
GROUP BY 1, 2, 3""")
def _(spark, sf):
    seconds = F.array(*[F.lit(clock.timeframe_seconds(t)) for t in clock.TIMEFRAMES])
    bins = T.trades(spark, sf).select("symbol", clock.micros("ts").alias("us"), F.explode(seconds).alias("seconds"))
    bars = bins.select("symbol", "seconds", (F.col("us") - F.pmod("us", F.col("seconds").cast("long") * 1_000_000)).alias("bin")).distinct()
    return clock.timeframe_table(spark).join(bars.groupBy("seconds").agg(F.count("*").alias("bars")), "seconds")


@query("A13_parquet_sink", _STORED, "SELECT * FROM v_trades")
def _(spark, sf):
    return spark.read.parquet(_dated(spark, sf))


@query("A14_csv_sink", "symbol:s ts:t check:s reason:s gap_seconds:i", "SELECT * FROM v_findings")
def _(spark, sf):
    from tapeloom.catalog import quality as bent

    path = _folder(spark, "findings")
    store.write_csv(bent._found(bent.indexed(spark, sf)), path)
    return spark.read.option("header", True).csv(path)


@query("A15_trailing", _BAR, """
SELECT b.* FROM v_bars b JOIN (SELECT symbol, max(ts) AS hi FROM v_bars GROUP BY 1) m USING (symbol) WHERE b.ts >= m.hi - INTERVAL 7 DAY""")
def _(spark, sf):
    return store.trailing(T.hourly_bars(spark, sf), 7)
