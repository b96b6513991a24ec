"""The generic test tables seen as market data: trades, bars, book updates, depth, fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import bars as B
from tapeloom.plans.stage import stage
from tapeloom.plans.tiles import index_rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def trades(spark: SparkSession, folder: str) -> DataFrame:
    return trades_of(table(spark, folder, "events"))


def trades_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("agg_id"),
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("value").alias("price"),
        ((_k() + 1) / F.lit(100.0)).alias("qty"),
        (F.col("user_id") % 2 == 0).alias("is_buyer_maker"),
    )


def hourly_bars(spark: SparkSession, folder: str) -> DataFrame:
    return B.time_bars(trades(spark, folder), "1h")


def indexed_hourly_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars numbered and written once, as input of several branches."""
    return stage(index_rows(stage(hourly_bars(spark, folder), "bars")), "indexed")


def daily_bars(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    price = F.col("o_totalprice")
    return orders.groupBy(F.lit("ORD").alias("symbol"), F.col("o_orderdate").alias("ts")).agg(
        F.min_by(price, "o_orderkey").alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, "o_orderkey").alias("close"),
        F.count("*").cast("double").alias("volume"),
    )


def indexed_daily_bars(spark: SparkSession, folder: str) -> DataFrame:
    return stage(index_rows(stage(daily_bars(spark, folder), "daily"), bucket="365d"), "indexed")


def book_updates(spark: SparkSession, folder: str) -> DataFrame:
    return book_updates_of(table(spark, folder, "events"))


def book_updates_of(events: DataFrame) -> DataFrame:
    bid = F.col("user_id") % 2 == 0
    step = (_k() % 50).cast("double")
    return events.select(
        F.col("event_id").alias("seq"),
        "ts",
        (F.col("user_id") % 5).alias("symbol"),
        F.when(bid, "bid").otherwise("ask").alias("side"),
        F.when(bid, F.lit(100.0) - step).otherwise(F.lit(101.0) + step).alias("price"),
        F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(F.col("value")).alias("size"),
    )


def with_snapshots(updates: DataFrame) -> DataFrame:
    """Every 97th update as a snapshot of its side, every third of them an empty one (without price and size)."""
    snapshot, empty = F.col("seq") % 97 == 0, F.col("seq") % 291 == 0
    gone = lambda c: F.when(~empty, F.col(c)).alias(c)
    return updates.select("seq", "ts", "symbol", "side", gone("price"), gone("size"), snapshot.alias("is_snapshot"))


def book_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Cumulative depth per percentage offset, one snapshot per ship date."""
    from pyspark.sql import Window

    levels = table(spark, folder, "lineitem").groupBy(
        F.col("l_shipdate").alias("ts"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("sgn"),
        F.least(F.col("l_linenumber"), F.lit(6)).alias("lvl"),
    ).agg(F.sum("l_quantity").alias("q"))
    offsets = F.array(*[F.lit(v) for v in (0.2, 1.0, 2.0, 3.0, 4.0, 5.0)])
    upto = Window.partitionBy("ts", "sgn").orderBy("lvl").rowsBetween(Window.unboundedPreceding, 0)  # <= 6 rows
    return levels.select(
        F.lit("ORD").alias("symbol"),
        "ts",
        (F.col("sgn") * F.element_at(offsets, F.col("lvl"))).alias("percentage"),
        F.sum("q").over(upto).alias("depth"),
        F.lit(0.0).alias("notional"),
    )


def fills(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("fill_id"),
        "ts",
        (F.col("user_id") % 5).alias("symbol"),
        F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.col("value").alias("price"),
        F.lit(0.01).alias("qty"),
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """A score of every document."""
    return table(spark, folder, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / F.lit(5000.0)).alias("pred"))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    d, lab = table(spark, folder, "documents"), table(spark, folder, "labels")
    return d.join(lab, "doc_id").select(
        F.col("lang").alias("symbol"),
        "doc_id",
        F.least(F.lit(1.0), F.col("n_chars") / F.lit(5000.0)).alias("pred"),
        F.col("quality").cast("double").alias("actual"),
    )
