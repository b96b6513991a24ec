"""Trade microstructure: order flow, spreads, price impact, size distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import clock, maths
from tapeloom.operators.bars import tick
from tapeloom.plans.joins import asof_join, lookup_join
from tapeloom.plans.quantiles import exact_quantiles
from tapeloom.plans.runs import next_row
from tapeloom.plans.stage import stage
from tapeloom.plans.tiles import KEY, index_rows


def signed_qty(qty: str = "qty", maker: str = "is_buyer_maker") -> Column:
    return F.when(F.col(maker), -F.col(qty)).otherwise(F.col(qty))


def signed_volume(trades: DataFrame) -> DataFrame:
    """Quantity with the sign of the aggressor: negative when the buyer was the maker."""
    return trades.withColumn("signed_volume", signed_qty())


def order_flow_imbalance(trades: DataFrame, window: str = "10s", *, key: Sequence[str] = KEY) -> DataFrame:
    """Σ signed / Σ |signed| over (t - window, t], one value per series and timestamp.

    Trades at one time are added up before the shuffle. A task holds one series for four windows;
    rows within a window of the right edge are copied to the following slice as its look-back.
    """
    width = clock.duration_us(window)
    slice_us = 4 * width
    like = clock.ts_type(trades)
    flow = trades.groupBy(*key, clock.micros("ts").alias("_us")).agg(
        F.sum(signed_qty()).alias("_s"), F.sum(F.abs(signed_qty())).alias("_a")
    )
    here = clock.floor_us(F.col("_us"), slice_us)
    slices = F.array(
        F.struct(here.alias("_slice"), F.lit(True).alias("_core")),
        F.when(
            F.col("_us") > here + F.lit(slice_us - width),
            F.struct((here + F.lit(slice_us)).alias("_slice"), F.lit(False).alias("_core")),
        ),
    )
    spread = flow.select("*", F.explode(F.filter(slices, lambda s: s.isNotNull())).alias("_c")).select(
        *flow.columns, "_c.*"
    )
    w = Window.partitionBy(*key, "_slice").orderBy("_us").rangeBetween(-(width - 1), 0)
    ratio = maths.div(F.sum("_s").over(w), F.sum("_a").over(w))
    return (
        spread.select(*key, "_us", "_core", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)).alias("ofi"))
        .where("_core")
        .select(*key, clock.from_micros(F.col("_us"), like).alias("ts"), "ofi")
    )


def effective_spread(trades: DataFrame, mid: DataFrame, *, key: Sequence[str] = KEY, tie: str | None = None) -> DataFrame:
    """2 |price - mid| / mid with the mid as of each trade."""
    out = asof_join(trades, stage(mid, "mid"), ["mid"], key=key, tie=tie)
    return out.withColumn("effective_spread", maths.div(2 * F.abs(F.col("price") - F.col("mid")), F.col("mid")))


def microprice(bid_price: Column, ask_price: Column, bid_size: Column, ask_size: Column) -> Column:
    """Size-weighted mid; NULL when there is no size."""
    total = bid_size + ask_size
    return F.when(total > 0, maths.div(bid_price * ask_size + ask_price * bid_size, total))


def impact_rows(trades: DataFrame, bar: str = "1min", *, key: Sequence[str] = KEY) -> DataFrame:
    """Per non-empty bar: signed volume, last price and their absolute values and changes."""
    like = clock.ts_type(trades)
    width = clock.duration_us(bar)
    flow = trades.groupBy(*key, clock.floor_us(clock.micros("ts"), width).alias("_us")).agg(
        F.sum(signed_qty()).alias("signed_vol"), F.max_by("price", tick()).alias("close")
    )
    flow = stage(flow.withColumn("ts", clock.from_micros(F.col("_us"), like)), "flow")
    ahead = next_row(index_rows(flow, key), key, ["ts", "signed_vol", "close"])
    return ahead.where("next_ts is not null").select(
        *key,
        F.col("next_ts").alias("ts"),
        F.col("next_signed_vol").alias("signed_vol"),
        F.col("next_close").alias("close"),
        F.abs(F.col("next_close") - F.col("close")).alias("delta_p_abs"),
        F.abs("next_signed_vol").alias("abs_signed_vol"),
    )


def kyle_lambda(rows: DataFrame, *, key: Sequence[str] = KEY) -> DataFrame:
    """Price impact: |Δprice| regressed on |signed volume| through the origin, from impact_rows."""
    x, y = F.col("abs_signed_vol"), F.col("delta_p_abs")
    out = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum(x * y).alias("_xy"), F.sum(x * x).alias("_xx"))
    return out.select(*key, "n", F.when(F.col("n") >= 5, maths.div("_xy", "_xx")).alias("kyle_lambda"))


def trade_size_distribution(trades: DataFrame, *, key: Sequence[str] = KEY) -> DataFrame:
    """Exact quantiles of trade size and the Hill index of the largest 5 % (at least 20).

    The Hill sum needs only the k-th largest size: rows equal to it add ln(1) = 0, so they need no
    ranking among themselves.
    """
    sizes = trades.where("qty > 0").select(*key, "qty")
    names = ["p50", "p90", "p99", "p999"]
    top = F.greatest(F.lit(20), F.floor(F.lit(0.05) * F.col("n")))
    kth = F.greatest(F.lit(0), F.col("n") - top)
    base = exact_quantiles(sizes, "qty", [0.5, 0.9, 0.99, 0.999], names, key=key, at={"_cut": kth})
    base = stage(base.withColumn("_k", top), "sizes")
    cut = base.select(*key, "_k", "_cut")
    log_excess = F.when(F.col("qty") > F.col("_cut"), F.ln(F.col("qty") / F.col("_cut")))
    tail = (
        sizes.join(cut, list(key))
        .groupBy(*key, "_k")
        .agg(F.sum(log_excess).alias("_sum"))
        .select(*key, F.coalesce(maths.div("_k", "_sum"), F.lit(maths.INF)).alias("hill_alpha"))
    )
    enough = F.col("n") >= 100
    return base.join(tail, list(key)).select(
        *key,
        "n",
        *[F.when(enough, F.col(c)).alias(c) for c in [*names, "hill_alpha"]],
        F.when(enough, F.col("p99")).alias("whale_threshold"),
    )


def trade_summary(trades: DataFrame, *, key: Sequence[str] = KEY) -> DataFrame:
    return trades.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.avg((~F.col("is_buyer_maker")).cast("double")).alias("taker_buy_fraction"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
    )


def arrival_heatmap(trades: DataFrame, *, key: Sequence[str] = KEY) -> DataFrame:
    """Trade counts by weekday (0 = Monday) and hour, all 168 cells per series."""
    seen = trades.groupBy(*key, F.weekday("ts").alias("dow"), F.hour("ts").alias("hour")).agg(
        F.count("*").alias("trades")
    )
    cells = seen.select(*key).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("dow"))
    cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return cells.join(seen, [*key, "dow", "hour"], "left").withColumn("trades", F.coalesce("trades", F.lit(0)))


def histogram(df: DataFrame, value: Column, width: float, *, key: Sequence[str] = KEY) -> DataFrame:
    """Counts of ``value`` per bin of ``width``; ``bin`` is the bin number, ``lower`` its left edge."""
    rows = df.select(*key, value.alias("_v")).where("_v is not null")
    out = rows.groupBy(*key, F.floor(F.col("_v") / F.lit(width)).alias("bin")).agg(F.count("*").alias("n"))
    return out.withColumn("lower", F.col("bin") * F.lit(width))


def trade_size_histogram(trades: DataFrame, width: float = 0.001, *, key: Sequence[str] = KEY) -> DataFrame:
    return histogram(trades.where("qty > 0"), F.col("qty"), width, key=key)


def spread_histogram(spreads: DataFrame, width: float = 0.05, *, key: Sequence[str] = KEY) -> DataFrame:
    """Effective spread in basis points up to its 99.9 % quantile."""
    bps = spreads.where("effective_spread is not null").select(*key, (F.col("effective_spread") * 1e4).alias("bps"))
    bps = stage(bps, "bps")
    top = exact_quantiles(bps, "bps", [0.999], ["_top"], key=key).drop("n")
    return histogram(lookup_join(bps, top, key).where("bps <= _top"), F.col("bps"), width, key=key)


def volume_histogram(bars: DataFrame, outliers: DataFrame, width: float, *, key: Sequence[str] = KEY) -> DataFrame:
    """Bar volume per bin, for all bars and for the flagged ones."""
    flagged = histogram(outliers, F.col("volume"), width, key=key).withColumnRenamed("n", "outliers").drop("lower")
    out = histogram(bars, F.col("volume"), width, key=key).join(flagged, [*key, "bin"], "left")
    return out.withColumn("outliers", F.coalesce("outliers", F.lit(0)))


def pnl_histogram(trades: DataFrame, width: float = 0.01, *, key: Sequence[str] = KEY) -> DataFrame:
    """Profit and loss per trade of a trade log."""
    return histogram(trades, F.col("pnl_pct"), width, key=key)


__all__ = [
    "arrival_heatmap", "effective_spread", "histogram", "impact_rows", "kyle_lambda", "microprice",
    "order_flow_imbalance", "pnl_histogram", "signed_qty", "signed_volume", "spread_histogram", "trade_size_distribution",
    "trade_size_histogram", "trade_summary", "volume_histogram",
]
