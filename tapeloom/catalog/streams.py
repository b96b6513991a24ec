"""Streams over the test tables."""

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from tapeloom.catalog import views as _views  # noqa: F401  (shared views)
from tapeloom.catalog.spec import query
from tapeloom.plans.stage import shared_folder, stage
from tapeloom.sources import store
from tapeloom.sources import testtables as T
from tapeloom.streaming import jobs as K


def _stream(spark, sf):
    """The events table as a file stream."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@contextmanager
def _rocksdb(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", K.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


@query("K1_streaming_time_bars", "symbol:s ts:t open:f4 high:f4 low:f4 close:f4 volume:f6 trades:i", """
SELECT b.* FROM v_bars b WHERE b.ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM v_trades) - INTERVAL 10 MINUTE""")
def _(spark, sf):
    return K.drain(K.time_bars(T.trades_of(_stream(spark, sf)), "1 hour", "10 minutes"), "bars")


@query("K2_streaming_top_of_book", "symbol:i seq:i ts:t bid_price:f2 bid_size:f4 ask_price:f2 ask_size:f4", """
WITH levels AS (SELECT DISTINCT symbol, side, price FROM v_updates),
state AS (SELECT u.symbol, u.seq, u.ts, l.side, l.price, p.size
          FROM v_updates u JOIN levels l ON l.symbol = u.symbol
          ASOF JOIN v_updates p ON p.symbol = l.symbol AND p.side = l.side AND p.price = l.price AND u.seq >= p.seq)
SELECT symbol, seq, ts, max(price) FILTER (side = 'bid' AND size > 0) AS bid_price, arg_max(size, price) FILTER (side = 'bid' AND size > 0) AS bid_size,
       min(price) FILTER (side = 'ask' AND size > 0) AS ask_price, arg_min(size, price) FILTER (side = 'ask' AND size > 0) AS ask_size
FROM (SELECT * FROM state UNION ALL SELECT symbol, seq, ts, 'none', 0, 0 FROM v_updates) GROUP BY 1, 2, 3""")
def _(spark, sf):
    with _rocksdb(spark):
        return K.drain(K.top_of_book(T.book_updates_of(_stream(spark, sf))), "top")


_FINAL = """
WITH e AS (SELECT symbol, side, max(seq) FILTER (is_snapshot) AS epoch FROM v_snapshots GROUP BY 1, 2),
l AS (SELECT u.symbol, u.side, u.price, arg_max(u.size, u.seq) AS size FROM v_snapshots u JOIN e USING (symbol, side)
      WHERE u.seq >= coalesce(epoch, 0) AND u.price IS NOT NULL GROUP BY 1, 2, 3)
SELECT * FROM l WHERE size > 0"""


def _out_of_order(spark, sf, batches: int):
    """Updates with snapshots, dealt to so many micro-batches without regard to their times."""
    rows = T.with_snapshots(T.book_updates(spark, sf)).withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(batches)))
    fresh = stage(rows.repartition(batches, "part").drop("part"), "updates")
    path = fresh.inputFiles()[0].rsplit("/", 1)[0]
    return spark.readStream.schema(fresh.schema).option("maxFilesPerTrigger", -(-len(fresh.inputFiles()) // batches)).parquet(path)


@query("K2_streaming_late_updates", "symbol:i side:s price:f2 size:f4", _FINAL)
def _(spark, sf):
    """The book that updates in any order leave."""
    with _rocksdb(spark):
        return K.standing_levels(K.drain(K.book_changes(_out_of_order(spark, sf, 5)), "changes"))


@query("K2_streaming_late_top", "symbol:i bid_price:f2 bid_size:f4 ask_price:f2 ask_size:f4", f"""
SELECT symbol, max(price) FILTER (side = 'bid') AS bid_price, arg_max(size, price) FILTER (side = 'bid') AS bid_size,
       min(price) FILTER (side = 'ask') AS ask_price, arg_min(size, price) FILTER (side = 'ask') AS ask_size FROM ({_FINAL}) GROUP BY 1""")
def _(spark, sf):
    with _rocksdb(spark):
        out = K.drain(K.top_of_book(_out_of_order(spark, sf, 3)), "tops")
    return out.groupBy("symbol").agg(*[F.max_by(c, "step").alias(c) for c in K.TOPS[3:7]])


@query("K3_upsert_replayed", "symbol:s first_ts:t last_ts:t rows:i total:f4", """
SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS rows, sum(close) AS total FROM v_daily GROUP BY 1""")
def _(spark, sf):
    """An empty store; doubled rows in the first batch; the older batch sent again after the newer one; the manifest of what is left."""
    root = f"{shared_folder(spark)}/tapeloom-replayed-{uuid.uuid4().hex}"
    daily = stage(T.daily_bars(spark, sf), "daily")
    stale = daily.where(F.dayofmonth("ts") <= 20).withColumn("close", F.lit(-1.0))
    for name, rows in (("a", stale.union(stale)), ("b", daily), ("a", stale)):
        store.upsert_bars(spark, root, rows, period="year", batch=name)
    left = spark.read.parquet(root)
    totals = left.groupBy("symbol").agg(F.sum("close").alias("total"))
    return store.manifest(left, "1d").join(totals, "symbol")


@query("K3_streaming_upsert", "symbol:s ts:t close:f4 volume:f6", "SELECT symbol, ts, close, volume FROM v_daily")
def _(spark, sf):
    base = f"{shared_folder(spark)}/tapeloom-upsert-{uuid.uuid4().hex}"
    daily = T.daily_bars(spark, sf)
    # An older state of half the days, then the full table as a stream.
    store.write_by_date(daily.where(F.dayofmonth("ts") <= 15).withColumn("close", F.lit(0.0)), f"{base}/store", period="year")
    fresh = stage(daily, "stream")
    path = fresh.inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(fresh.schema).option("maxFilesPerTrigger", 4).parquet(path)
    K.bar_upsert(stream, f"{base}/store", f"{base}/log", period="year").awaitTermination()
    return spark.read.parquet(f"{base}/store")
