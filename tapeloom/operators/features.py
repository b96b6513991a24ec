"""Model features, targets, labels, scaling and sequence windows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import clock, maths
from tapeloom.operators.bars import last_per_bin
from tapeloom.operators.micro import order_flow_imbalance, signed_qty
from tapeloom.plans.joins import asof_join, asof_join_many, fill_forward, lookup_join, match_keys
from tapeloom.plans.stage import stage
from tapeloom.plans.tiles import KEY, TILE_ROWS, Tiles, full, tidy, tile

MTF_WINDOW = 20  # fixed value: coarse returns per volatility estimate


@dataclass(frozen=True)
class FeatureConfig:
    n_lag_returns: int = 10
    rolling_windows: tuple[int, ...] = (5, 20, 60)
    include_volume_z: bool = True
    include_tod_cyclic: bool = True
    volume_z_window: int = 60
    include_multi_timeframe: bool = False
    mtf_timeframes: tuple[str, ...] = ("1h", "4h")

    @property
    def columns(self) -> list[str]:
        names = [f"ret_lag{k}" for k in range(1, self.n_lag_returns + 1)]
        for w in self.rolling_windows:
            names += [f"ret_mean_{w}", f"ret_std_{w}"]
        names += ["volume_z"] * self.include_volume_z
        names += ["tod_sin", "tod_cos"] * self.include_tod_cyclic
        if self.include_multi_timeframe:
            for tf in self.mtf_timeframes:
                names += [f"ret_{tf}_lag1", f"vol_{tf}_lag1"]
        return names

    @property
    def lookback(self) -> int:
        return max([self.n_lag_returns, self.volume_z_window, *self.rolling_windows]) + 1


def log_return(t: Tiles, close: str = "close") -> Column:
    """ln(close / previous close); NULL on the first bar and where a price is not positive."""
    ratio = maths.div(F.col(close), t.lag(close))
    return F.when(ratio > 0, F.ln(ratio))


def lagged_returns(t: Tiles, n: int) -> dict[str, Column]:
    """``ret_lag1`` is the current bar's return. Reads ``_r`` (log return) of the tiled frame."""
    return {f"ret_lag{k}": F.col("_r") if k == 1 else t.lag("_r", k - 1) for k in range(1, n + 1)}


def rolling_moments(t: Tiles, windows: Sequence[int]) -> dict[str, Column]:
    out = {}
    for n in windows:
        w = t.rows(1 - n, 0)
        out[f"ret_mean_{n}"] = full(F.col("_r"), w, n, F.avg("_r").over(w))
        out[f"ret_std_{n}"] = full(F.col("_r"), w, n, F.stddev_samp("_r").over(w))
    return out


def volume_z(t: Tiles, n: int) -> Column:
    """Volume against its rolling mean and deviation; 0 without a positive deviation."""
    w = t.rows(1 - n, 0)
    sd = full(F.col("volume"), w, n, F.stddev_samp("volume").over(w))
    return F.when(sd > 0, (F.col("volume") - F.avg("volume").over(w)) / sd).otherwise(F.lit(0.0))


def time_of_day(ts: str = "ts") -> dict[str, Column]:
    angle = (F.hour(ts) + F.minute(ts) / F.lit(60.0)) * F.lit(2.0 * math.pi) / F.lit(24.0)
    return {"tod_sin": F.sin(angle), "tod_cos": F.cos(angle)}


def build_features(
    bars: DataFrame, config: FeatureConfig = FeatureConfig(), *, key: Sequence[str] = KEY, size: int | None = TILE_ROWS
) -> DataFrame:
    """(key, ts, rn, features...): every feature from one tiled pass over the bars."""
    for c in ("close", "volume"):
        if c not in bars.columns:
            raise KeyError(f"a {c!r} column is required")
    t = tile(bars, key, before=config.lookback, size=size)
    t = t.with_df(t.df.withColumn("_r", log_return(t)))
    made = {**lagged_returns(t, config.n_lag_returns), **rolling_moments(t, config.rolling_windows)}
    if config.include_volume_z:
        made["volume_z"] = volume_z(t, config.volume_z_window)
    if config.include_tod_cyclic:
        made.update(time_of_day())
    out = tidy(t.core(t.df.withColumns(made))).select(*key, "ts", "rn", *made)
    if config.include_multi_timeframe:
        coarse = multi_timeframe(bars, config.mtf_timeframes, key=key)
        out = out.join(coarse, [*key, "ts"], "left")
    return out.select(*key, "ts", "rn", *config.columns)


def multi_timeframe(
    bars: DataFrame, timeframes: Sequence[str] = ("1h", "4h"), *, key: Sequence[str] = KEY, size: int | None = TILE_ROWS
) -> DataFrame:
    """Return and volatility of coarser bars, visible to a bar once the coarse bar has ended. All timeframes meet the bars in one scan."""
    like = clock.ts_type(bars)
    sides = []
    for tf in timeframes:
        delta = clock.duration_us(tf)
        coarse = last_per_bin(bars, "close", tf, key=key).withColumn("ts", clock.from_micros(F.col("_us"), like))
        t = tile(coarse, key, before=MTF_WINDOW + 1, size=size, bucket="30d")
        t = t.with_df(t.df.withColumn("_r", log_return(t)))
        w = t.rows(1 - MTF_WINDOW, 0)
        vol = full(F.col("_r"), w, MTF_WINDOW, F.stddev_samp("_r").over(w))
        ret, dev = f"ret_{tf}_lag1", f"vol_{tf}_lag1"
        ended = clock.from_micros(F.col("_us") + F.lit(delta), like)
        known = t.core(t.df.withColumn(dev, vol)).where("rn > 0").select(*key, ended.alias("ts"), F.col("_r").alias(ret), dev)
        sides.append((stage(known, "coarse"), [ret, dev]))
    return asof_join_many(bars.select(*key, "ts"), sides, key=key, bucket="1d")


def micro_features(
    bars: DataFrame, trades: DataFrame, *, bar: str, ofi_window: str = "5min", key: Sequence[str] = KEY
) -> DataFrame:
    """Order-flow imbalance, signed volume and trade count of the last finished bar bin.

    Bins form a dense grid per series (imbalance carried forward, sums 0), moved on by one bin so
    that a bar sees only the past.
    """
    width = clock.duration_us(bar)
    like = clock.ts_type(bars)
    span = bars.groupBy(*key).agg(
        (F.min(clock.micros("ts")) - clock.DAY).alias("_lo"), (F.max(clock.micros("ts")) + clock.DAY).alias("_hi")
    )
    near = lookup_join(trades, span, key).where(clock.micros("ts").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    ofi = last_per_bin(order_flow_imbalance(near, ofi_window, key=key), "ofi", bar, key=key)
    sums = near.groupBy(*key, clock.floor_us(clock.micros("ts"), width).alias("_us")).agg(
        F.sum(signed_qty()).alias("signed_vol"), F.count("price").cast("double").alias("trade_count")
    )
    bins = stage(sums.join(ofi, [*key, "_us"], "left"), "micro")
    dense = fill_forward(bins, width, ["ofi"], key=key, zero=["signed_vol", "trade_count"], like=like)
    # A dense grid has a bin at every step, so "the bin before" is the same row one step later.
    moved = dense.withColumn("_us", clock.micros("ts") + F.lit(width))
    last_bin = bins.groupBy(*key).agg(F.max("_us").alias("_end"))
    shifted = lookup_join(moved, last_bin, key).where("_us <= _end").select(
        *key, clock.from_micros(F.col("_us"), like).alias("ts"), "ofi", "signed_vol", "trade_count"
    )
    return asof_join(bars.select(*key, "ts"), shifted, ["ofi", "signed_vol", "trade_count"], key=key)


# ---- targets and labels -------------------------------------------------------------------------


def return_target(bars: DataFrame, *, key: Sequence[str] = KEY, size: int | None = TILE_ROWS) -> DataFrame:
    """``y``: log return to the next bar; NULL on the last."""
    t = tile(bars, key, after=1, size=size)
    ratio = maths.div(t.lead("close"), F.col("close"))
    return tidy(t.core(t.df.withColumn("y", F.when(ratio > 0, F.ln(ratio)))))


def direction_target(
    bars: DataFrame, neutral_band: float = 0.0, *, key: Sequence[str] = KEY, size: int | None = TILE_ROWS
) -> DataFrame:
    """``y``: 1 for a rise, 0 for a fall; with a band, moves inside it are NULL."""
    out = return_target(bars, key=key, size=size)
    y = F.col("y")
    if neutral_band <= 0:
        return out.withColumn("y", F.when(y.isNotNull(), (y > 0).cast("double")))
    return out.withColumn("y", F.when(y > neutral_band, 1.0).when(y < -neutral_band, 0.0))


@dataclass(frozen=True)
class TripleBarrierConfig:
    horizon_bars: int = 12
    take_profit_sigma: float = 1.0
    stop_loss_sigma: float = 1.0
    sigma_lookback: int = 100


def triple_barrier(
    bars: DataFrame,
    config: TripleBarrierConfig = TripleBarrierConfig(),
    *,
    key: Sequence[str] = KEY,
    size: int | None = TILE_ROWS,
) -> DataFrame:
    """``y``: 1 if the upper barrier is hit first within the horizon, -1 the lower, 0 neither.

    The first bar to reach a barrier is found per barrier as the smallest step among the next
    ``horizon_bars`` leads, so it stays a plain expression over one window.
    """
    h = config.horizon_bars
    high = "high" if "high" in bars.columns else "close"
    low = "low" if "low" in bars.columns else "close"
    t = tile(bars, key, before=config.sigma_lookback, after=h, size=size)
    ret = F.when(F.col("rn") == 0, F.lit(0.0)).otherwise(log_return(t))
    t = t.with_df(t.df.withColumn("_r", ret))
    w = t.rows(1 - config.sigma_lookback, 0)
    sigma = full(F.col("_r"), w, config.sigma_lookback, F.stddev_samp("_r").over(w))
    df = t.df.withColumns({"_s": sigma, "_ahead": F.collect_list(F.struct(F.col(high).alias("hi"), F.col(low).alias("lo"))).over(t.rows(1, h))})
    up = F.col("close") * F.exp(F.col("_s") * F.lit(config.take_profit_sigma))
    down = F.col("close") * F.exp(-F.col("_s") * F.lit(config.stop_loss_sigma))
    df = df.withColumns({"_up": up, "_down": down})
    hits = F.filter("_ahead", lambda b: (b["hi"] >= F.col("_up")) | (b["lo"] <= F.col("_down")))
    first = F.get(hits, F.lit(0))
    label = F.when(first["hi"] >= F.col("_up"), 1.0).when(first["lo"] <= F.col("_down"), -1.0).otherwise(0.0)
    y = F.when((F.size("_ahead") == h) & (F.col("_s") > 0), label)
    return tidy(t.core(df.withColumn("y", y))).drop("_r", "_s", "_ahead", "_up", "_down")


def label_distribution(labels: DataFrame, y: str = "y", *, key: Sequence[str] = KEY) -> DataFrame:
    n = F.greatest(F.count(y), F.lit(1))
    share = lambda v: maths.div(F.count_if(F.col(y) == v).cast("double"), n)
    return labels.groupBy(*key).agg(
        share(1.0).alias("tp_frac"), share(-1.0).alias("sl_frac"), share(0.0).alias("timeout_frac"), n.alias("n_labels")
    )


TARGETS = {
    "direction": direction_target,
    "return": return_target,
    "triple_barrier": triple_barrier,
}


def align(features: DataFrame, target: DataFrame, columns: Sequence[str], *, key: Sequence[str] = KEY) -> DataFrame:
    """Rows with every feature and the target; differing keys fail the job."""
    on = [*key, "ts"]
    both = match_keys(features.select(*on, *columns), target.select(*on, "y"), on, "features and target")
    return both.dropna(subset=[*columns, "y"])


def scale_split(
    rows: DataFrame, columns: Sequence[str], *, by: Sequence[str], role: str = "role"
) -> DataFrame:
    """Centre and scale by the training rows' mean and population deviation (1 where it is 0)."""
    train = rows.where(F.col(role) == "train")
    moments = train.groupBy(*by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )
    unit = lambda c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0))
    scaled = lookup_join(rows, moments, by).withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / unit(c) for c in columns})
    return scaled.drop(*[f"_m_{c}" for c in columns], *[f"_s_{c}" for c in columns])


def sequences(
    rows: DataFrame, columns: Sequence[str], seq_len: int, *, y: str = "y", key: Sequence[str] = KEY, size: int | None = TILE_ROWS
) -> DataFrame:
    """Overlapping stacks of the last ``seq_len`` feature rows with the last row's target."""
    if seq_len < 1:
        raise ValueError(f"stacks of {seq_len} rows are asked for; 1 row is the least")
    t = tile(rows, key, before=seq_len - 1, size=size)
    df = t.df.withColumn("_x", F.array(*columns))
    out = t.core(df.withColumn("x", F.collect_list("_x").over(t.rows(1 - seq_len, 0))))
    return out.where(F.size("x") == seq_len).select(*key, "ts", "x", y)


__all__ = [
    "FeatureConfig", "TARGETS", "TripleBarrierConfig", "align", "build_features", "direction_target",
    "label_distribution", "lagged_returns", "log_return", "micro_features", "multi_timeframe", "return_target",
    "rolling_moments", "scale_split", "sequences", "time_of_day", "triple_barrier", "volume_z",
]
