"""Bars from trades, and resampling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import clock, maths
from tapeloom.plans.joins import asof_join, fill_forward, lookup_join
from tapeloom.plans.scan import carry_scan, running
from tapeloom.plans.stage import stage
from tapeloom.plans.tiles import KEY, bucketed, tidy, tile


_EXACT = "decimal(38,18)"


def tick(ts: str = "ts", tie: str = "agg_id") -> Column:
    """The order of trades: time, then trade id."""
    return maths.tick_order(clock.micros(ts), F.col(tie))


def time_bars(trades: DataFrame, interval: str, *, key: Sequence[str] = KEY) -> DataFrame:
    """OHLC, summed volume and trade count per UTC-aligned bin; empty bins do not appear."""
    width = clock.duration_us(interval)
    like = clock.ts_type(trades)
    at = tick()
    return (
        trades.groupBy(*key, clock.floor_us(clock.micros("ts"), width).alias("_us"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("qty").alias("volume"),
            F.count("price").alias("trades"),
        )
        .select(*key, clock.from_micros(F.col("_us"), like).alias("ts"), "open", "high", "low", "close", "volume", "trades")
    )


def _threshold_bars(
    trades: DataFrame, weight: Column, threshold: float, key: Sequence[str], bucket: str
) -> DataFrame:
    if threshold <= 0:
        raise ValueError(f"a bar's threshold is {threshold}; it has to be above zero")
    priced, _ = bucketed(trades.withColumn("_w", weight), clock.micros("ts"), bucket, None)
    # The running sum is exact (18 places, below 1e20; more raises), so bar edges do not depend on how the data is split.
    summed = carry_scan(priced, key, "_bucket", ("ts", "agg_id"), {"_cum": running("sum", "_w")})
    summed = summed.withColumn("_threshold", F.lit(threshold).cast(_EXACT))
    bar = F.expr("_cum div _threshold")
    at = tick()
    return (
        summed.groupBy(*key, bar.alias("bar"))
        .agg(
            F.max("ts").alias("ts"),
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("qty").alias("volume"),
            F.count("price").alias("trades"),
            F.sum(F.col("price") * F.col("qty")).alias("dollar_volume"),
        )
    )


def volume_bars(trades: DataFrame, threshold: float, *, key: Sequence[str] = KEY, bucket: str = "1h") -> DataFrame:
    """Bars of about ``threshold`` traded quantity; the trade that crosses opens the next bar."""
    return _threshold_bars(trades, F.col("qty").cast(_EXACT), threshold, key, bucket)


def dollar_bars(trades: DataFrame, threshold: float, *, key: Sequence[str] = KEY, bucket: str = "1h") -> DataFrame:
    """Bars of about ``threshold`` traded notional."""
    notional = (F.col("price") * F.col("qty")).cast(_EXACT)
    return _threshold_bars(trades, notional, threshold, key, bucket)


def last_per_bin(
    df: DataFrame, value: str, step: str, *, key: Sequence[str] = KEY, order: Column | None = None
) -> DataFrame:
    """Last non-NULL value per bin as (key, _us, value); bins without one are dropped."""
    width = clock.duration_us(step)
    order = clock.micros("ts") if order is None else order
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(*key, clock.floor_us(clock.micros("ts"), width).alias("_us")).agg(
        F.max_by(value, order).alias(value)
    )


def resample_last(
    df: DataFrame, value: str, step: str, *, key: Sequence[str] = KEY, order: Column | None = None
) -> DataFrame:
    """Sparse resample: the last value per bin at the bin's left edge."""
    like = clock.ts_type(df)
    return last_per_bin(df, value, step, key=key, order=order).select(
        *key, clock.from_micros(F.col("_us"), like).alias("ts"), value
    )


def resample_last_filled(
    df: DataFrame, value: str, step: str, *, key: Sequence[str] = KEY, order: Column | None = None
) -> DataFrame:
    """Dense resample: the last value per bin, carried forward over empty bins."""
    sparse = last_per_bin(df, value, step, key=key, order=order)
    return fill_forward(sparse, clock.duration_us(step), [value], key=key, like=clock.ts_type(df))


def ofi_bars(trades: DataFrame, bar: str = "1min", ofi_window: str = "30s", *, key: Sequence[str] = KEY) -> DataFrame:
    """Time bars with the order-flow imbalance as of each bar's left edge (0 when none yet)."""
    from tapeloom.operators.micro import order_flow_imbalance

    # Only the last value in (edge - bar, edge] can be the one as of an edge.
    edge = -clock.floor_us(-clock.micros("ts"), clock.duration_us(bar))
    flow = order_flow_imbalance(trades, ofi_window, key=key)
    flow = flow.groupBy(*key, edge.alias("_us")).agg(F.max_by("ofi", clock.micros("ts")).alias("ofi"))
    flow = flow.select(*key, clock.from_micros(F.col("_us"), clock.ts_type(trades)).alias("ts"), "ofi")
    bars = stage(time_bars(trades, bar, key=key), "bars")
    out = asof_join(bars, stage(flow, "flow"), ["ofi"], key=key, bucket="1d")
    return out.withColumn("ofi", F.coalesce("ofi", F.lit(0.0)))


def stride_downsample(
    df: DataFrame, *, key: Sequence[str] = KEY, limit: int = 6000, target: int = 5000, size: int | None = None, **kw
) -> DataFrame:
    """Every (n div target)-th row of series longer than ``limit``; shorter ones whole."""
    rows = df if "rn" in df.columns else tidy(tile(df, key, **({"size": size} if size else {}), **kw).df)
    n = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    step = F.when(F.col("_n") > limit, F.expr(f"_n div {target}")).otherwise(1)
    return lookup_join(rows, n, key).where(F.pmod("rn", step) == 0).drop("_n", "rn")


# ---- largest-triangle-three-buckets -------------------------------------------------------------


def _hull(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Positions of the convex hull's points; the farthest point from any line is one of them."""
    if len(x) <= 3:
        return list(range(len(x)))

    def half(ids) -> list[int]:
        kept: list[int] = []
        for i in ids:
            while len(kept) > 1:
                a, b = kept[-2], kept[-1]
                if (x[b] - x[a]) * (y[i] - y[a]) - (y[b] - y[a]) * (x[i] - x[a]) >= 0:
                    break
                kept.pop()
            kept.append(int(i))
        return kept

    order = np.lexsort((y, x))
    return sorted(set(half(order)) | set(half(order[::-1])))


def _hull_points(piece: pd.DataFrame) -> pd.DataFrame:
    """The hull points of every bucket that a contiguous piece of a series touches."""
    piece = piece.sort_values("rn", ignore_index=True)
    x, y, b = (piece[c].to_numpy() for c in ("x", "y", "bucket"))
    edges = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1), len(b)]
    keep = [s + i for s, e in zip(edges, edges[1:]) for i in _hull(x[s:e], y[s:e])]
    return piece.iloc[keep]


def _walk(points: pd.DataFrame) -> pd.DataFrame:
    """From the first point on, the candidate that spans the largest triangle with the last choice
    and the mean of the bucket ahead."""
    points = points.sort_values("rn", ignore_index=True)
    x, y, b = (points[c].to_numpy() for c in ("x", "y", "bucket"))
    mx, my = points["mx"].to_numpy(), points["my"].to_numpy()
    edges = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1), len(b)]
    chosen = [0]
    for s, e in zip(edges[1:-2], edges[2:-1]):
        a = chosen[-1]
        area = np.abs((x[a] - mx[e]) * (y[s:e] - y[a]) - (x[s:e] - x[a]) * (my[e] - y[a]))
        chosen.append(int(s + np.argmax(area)))
    return points.iloc[[*chosen, len(b) - 1]]


def lttb(
    df: DataFrame, value: str, n_out: int = 5000, *, key: Sequence[str] = KEY, size: int = 100_000, **kw
) -> DataFrame:
    """Largest-triangle-three-buckets downsampling to ``n_out`` points per series.

    A bucket's choice maximises the distance from a line, which is always reached on the convex
    hull of its points. Series are therefore reduced to hulls in pieces of ``size`` rows; only the
    walk along the n_out hulls, a few points each, runs once per series. The last bucket looks
    ahead to the final point.
    """
    key = list(key)
    if n_out < 3:
        return df.select(*key, "ts", F.col(value).cast("double").alias(value))
    rows = df if "rn" in df.columns else tidy(tile(df, key, **kw).df)
    x = clock.micros("ts").cast("double")
    rows = rows.select(*key, "rn", "ts", x.alias("x"), F.col(value).cast("double").alias("y"))
    rows = lookup_join(rows, rows.groupBy(*key).agg(F.count("*").alias("n")), key)
    whole = rows.where(F.col("n") <= n_out).select(*key, "ts", F.col("y").alias(value))
    width = (F.col("n") - 2) / F.lit(float(n_out - 2))
    guess = F.floor((F.col("rn") - 1) / width)
    first_of = lambda i: F.floor(i * width) + 1
    inner = (
        F.when(F.col("rn") < first_of(guess), guess - 1)
        .when(F.col("rn") >= first_of(guess + 1), guess + 1)
        .otherwise(guess)
    )
    bucket = F.when(F.col("rn") == 0, F.lit(-1)).when(F.col("rn") == F.col("n") - 1, F.lit(n_out - 2)).otherwise(inner)
    long = rows.where(F.col("n") > n_out).withColumn("bucket", bucket.cast("long"))
    means = long.groupBy(*key, "bucket").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    pieces = long.select(*key, "rn", "ts", "x", "y", "bucket", F.expr(f"rn div {size}").alias("piece"))
    hulls = pieces.groupBy(*key, "piece").applyInPandas(_hull_points, pieces.schema).drop("piece")
    hulls = hulls.join(means, [*key, "bucket"])
    picked = hulls.groupBy(*key).applyInPandas(_walk, hulls.schema).select(*key, "ts", F.col("y").alias(value))
    return whole.unionByName(picked)


__all__ = [
    "dollar_bars", "last_per_bin", "lttb", "ofi_bars", "resample_last", "resample_last_filled",
    "stride_downsample", "tick", "time_bars", "volume_bars",
]
