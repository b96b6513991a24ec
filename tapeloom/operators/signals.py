"""Target positions from rules, position sizing, and market-making quotes."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions import maths
from tapeloom.plans.scan import carry_scan, running
from tapeloom.plans.stage import stage
from tapeloom.plans.tiles import KEY, TILE_ROWS, Tiles, full, tidy, tile


class Strategy:
    """A rule that can be run for many parameter sets at once.

    ``indicators`` adds the columns that any of the parameter sets needs, once per distinct window
    length; ``position`` then reads them for one set. ``valid`` raises ValueError on bad parameters.
    """

    def valid(self, **params) -> None:
        raise NotImplementedError

    def lookback(self, **params) -> int:
        raise NotImplementedError

    def indicators(self, tiles: Tiles, combos: Sequence[Mapping]) -> DataFrame:
        raise NotImplementedError

    def event(self, **params) -> Column:
        """Position by itself, or (``latched``) set/reset events that hold until the next event."""
        raise NotImplementedError

    latched = False
    columns: tuple[str, ...] = ("open", "close")  # of the bars, as far as the rule or the backtest reads them

    def ready(self, **params) -> Column:
        raise NotImplementedError

    def positions(self, bars: DataFrame, *, key: Sequence[str] = KEY, size: int | None = TILE_ROWS, **params) -> DataFrame:
        """``bars`` with ``position``: NULL during warm-up."""
        self.valid(**params)
        t = tile(bars, key, before=self.lookback(**params), size=size)
        extra = [c for c in bars.columns] + (["rn"] if "rn" not in bars.columns else [])
        df = t.core(self.indicators(t, [params])).withColumns(
            {"_event": self.event(**params), "_ready": self.ready(**params)}
        )
        if self.latched:
            df = carry_scan(df, key, "_tile", ("rn",), {"_event": running("last", "_event")})
        return df.select(*extra, F.when(F.col("_ready"), F.coalesce("_event", F.lit(0.0))).alias("position"))


class MACrossover(Strategy):
    """1 while the short moving average of close is above the long one, else 0."""

    def valid(self, short_window: int, long_window: int) -> None:
        if short_window <= 0 or long_window <= 0:
            raise ValueError(f"window lengths are {short_window} and {long_window}; they start at 1")
        if short_window >= long_window:
            raise ValueError(f"the short window ({short_window}) is not shorter than the long one ({long_window})")

    def lookback(self, short_window: int, long_window: int) -> int:
        return long_window - 1

    def indicators(self, tiles, combos):
        lengths = sorted({w for c in combos for w in (c["short_window"], c["long_window"])})
        means = {
            f"_sma{n}": full(F.col("close"), tiles.rows(1 - n, 0), n, F.avg("close").over(tiles.rows(1 - n, 0)))
            for n in lengths
        }
        return tiles.df.withColumns(means)

    def event(self, short_window, long_window):
        return F.when(F.col(f"_sma{short_window}") > F.col(f"_sma{long_window}"), 1.0).otherwise(0.0)

    def ready(self, short_window, long_window):
        return F.col(f"_sma{long_window}").isNotNull()


class BollingerMeanReversion(Strategy):
    """Long from a close below the lower band until a close above the mean.

    Entering and leaving exclude each other, so the state is simply the latest of the two events.
    """

    latched = True

    def valid(self, window: int, num_std: float) -> None:
        if window <= 1:
            raise ValueError(f"a band over {window} bars has no deviation; 2 bars are the least")
        if num_std <= 0:
            raise ValueError(f"bands {num_std} deviations wide are asked for; the width has to be above zero")

    def lookback(self, window: int, num_std: float) -> int:
        return window - 1

    def indicators(self, tiles, combos):
        out = {}
        for n in sorted({c["window"] for c in combos}):
            w = tiles.rows(1 - n, 0)
            out[f"_mu{n}"] = full(F.col("close"), w, n, F.avg("close").over(w))
            out[f"_sd{n}"] = full(F.col("close"), w, n, F.stddev_samp("close").over(w))
        return tiles.df.withColumns(out)

    def event(self, window, num_std):
        mu, sd = F.col(f"_mu{window}"), F.col(f"_sd{window}")
        return F.when(F.col("close") < mu - F.lit(float(num_std)) * sd, 1.0).when(F.col("close") > mu, 0.0)

    def ready(self, window, num_std):
        return F.col(f"_mu{window}").isNotNull()


STRATEGIES: dict[str, Strategy] = {
    "ma_crossover": MACrossover(),
    "bollinger": BollingerMeanReversion(),
}


def ma_crossover(bars: DataFrame, short_window: int = 20, long_window: int = 100, **kw) -> DataFrame:
    return STRATEGIES["ma_crossover"].positions(bars, short_window=short_window, long_window=long_window, **kw)


def bollinger_mean_reversion(bars: DataFrame, window: int = 20, num_std: float = 2.0, **kw) -> DataFrame:
    return STRATEGIES["bollinger"].positions(bars, window=window, num_std=num_std, **kw)


def buy_and_hold(bars: DataFrame) -> DataFrame:
    return bars.withColumn("position", F.lit(1.0))


def hold_remainders(m: np.ndarray, begin: int, span: int, hold: int) -> np.ndarray:
    """Held bars left after the stretch [begin, begin + span) with signals at ``m`` (ascending), for 0, 1, ... left before it."""
    at = np.arange(len(m))
    after = np.searchsorted(m, m + hold)
    last = np.where(after < len(m), after, at)
    while len(m) and (last != last[last]).any():  # pointer doubling to the last signal of every path
        last = last[last]
    left = np.append(np.maximum(0, m[last] + hold - (begin + span)), 0)
    return left[np.searchsorted(m, begin + np.arange(hold))].astype(np.int64)


def _chained(steps: DataFrame, key: list[str]) -> DataFrame:
    """(key, _part, _rest): what is left of a hold where each stretch begins, from (key, _part, _rest, _out).

    Nothing is left after a stretch without signals (a stretch is at least as long as a hold), so runs of neighbouring stretches
    are chained: doubling reaches a run of r stretches in log2(r) rounds over one row per stretch and remainder.
    """
    parts = steps.select(*key, "_part").distinct()
    before = Window.partitionBy(*key).orderBy("_part")  # one short row per stretch
    run = parts.withColumn("_new", F.coalesce(F.col("_part") - F.lag("_part").over(before) != 1, F.lit(True)))
    roots = run.where("_new").select(*key, "_part")
    runs = run.withColumn("_run", F.sum(F.col("_new").cast("long")).over(before)).groupBy(*key, "_run").count()
    longest = runs.agg(F.max("count")).first()[0] or 1
    reached = roots.withColumn("_rest", F.lit(0).cast("long"))
    jumps = steps.select(*key, "_part", "_rest", (F.col("_part") + 1).alias("_to"), F.col("_out").alias("_then"))
    for _ in range((longest - 1).bit_length()):
        further = reached.join(jumps, [*key, "_part", "_rest"]).select(*key, F.col("_to").alias("_part"), F.col("_then").alias("_rest"))
        reached = stage(reached.union(further.join(parts, [*key, "_part"])).distinct(), "ofi-reached")
        onward = jumps.select(*key, F.col("_part").alias("_to"), F.col("_rest").alias("_then"), F.col("_to").alias("_to2"), F.col("_then").alias("_then2"))
        jumps = stage(jumps.join(onward, [*key, "_to", "_then"]).select(*key, "_part", "_rest", F.col("_to2").alias("_to"), F.col("_then2").alias("_then")), "ofi-jumps")
    return reached


def ofi_mean_reversion(
    bars: DataFrame,
    z_threshold: float = 2.0,
    holding_bars: int = 5,
    lookback_bars: int = 60,
    *,
    key: Sequence[str] = KEY,
    size: int = TILE_ROWS,
) -> DataFrame:
    """Fade extreme order flow: -1 above the z threshold, +1 below, held ``holding_bars`` bars.

    z compares a bar's ``ofi`` with the ``lookback_bars`` before it. Signals during a hold are
    ignored, bars without a z are flat and do not count towards a hold. Which signals open a hold
    depends on the one before: every signal points to the first one at or after the end of its hold, and the path
    from a series' first signal has those that open one. Signals are laid out in stretches of ``size`` bars; all that
    crosses from one to the next is how many held bars remain, a number below ``holding_bars``. A stretch turns it into the
    next one by pointer doubling over its signals, stretches are chained by doubling over (stretch, remainder) pairs, and
    only then each stretch follows its own path. No series is chained in one task.
    """
    if z_threshold <= 0:
        raise ValueError(f"the z threshold is {z_threshold}; it has to be above zero")
    if holding_bars <= 0:
        raise ValueError(f"a hold of {holding_bars} bars is asked for; 1 bar is the least")
    if lookback_bars < 10:
        raise ValueError(f"z over {lookback_bars} bars is asked for; 10 bars are the least")
    if "ofi" not in bars.columns:
        raise KeyError("an 'ofi' column is required")
    span = max(size, holding_bars)
    key = list(key)
    t = tile(bars, key, before=lookback_bars, size=size)
    w = t.rows(-lookback_bars, -1)
    enough = F.count("ofi").over(w) >= lookback_bars
    df = t.df.withColumns({"_mu": F.when(enough, F.avg("ofi").over(w)), "_sd": F.when(enough, F.stddev_samp("ofi").over(w))})
    z = maths.z_score(F.col("ofi"), F.col("_mu"), F.col("_sd"))
    df = t.core(df).withColumn("_z", z).drop("_mu", "_sd")
    seen = F.when(F.col("_z").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long")
    df = carry_scan(df, key, "_tile", ("rn",), {"_m": running("sum", seen)})
    side = F.when(F.col("_z") > z_threshold, -1.0).when(F.col("_z") < -z_threshold, 1.0)
    df = stage(df.withColumn("_side", side).drop("_tile"), "ofi")  # _m counts bars with a z, from 1

    signals = stage(df.where("_side is not null").select(*key, "_m", "_side", F.expr(f"_m div {span}").alias("_part")), "ofi-signals")
    part = [*key, "_part"]
    kinds = {f.name: f.dataType for f in signals.schema.fields}
    named = T.StructType([T.StructField(c, kinds[c]) for c in part])
    passed = T.StructType([*named, T.StructField("_rest", T.LongType()), T.StructField("_out", T.LongType())])
    chosen = T.StructType([*named, T.StructField("_m", T.LongType()), T.StructField("_side", T.DoubleType())])

    def remainders(group: pd.DataFrame) -> pd.DataFrame:
        m = np.sort(group["_m"].to_numpy())
        begin = int(group["_part"].iloc[0]) * span
        out = hold_remainders(m, begin, span, holding_bars)
        return group[part].iloc[[0] * holding_bars].assign(_rest=np.arange(holding_bars), _out=out)

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_m")
        m = group["_m"].to_numpy()
        after = np.searchsorted(m, m + holding_bars)
        at = int(np.searchsorted(m, int(group["_part"].iloc[0]) * span + int(group["_rest"].iloc[0])))
        taken = []
        while at < len(m):
            taken.append(at)
            at = int(after[at])
        return group.iloc[taken][[*part, "_m", "_side"]]

    steps = stage(signals.groupBy(*part).applyInPandas(remainders, passed), "ofi-steps")
    entries = _chained(steps, key)
    opened = signals.join(entries, part).groupBy(*part).applyInPandas(follow, chosen).select(*key, F.struct("_m", "_side").alias("_s"))
    held = opened.select(
        *key, F.explode(F.sequence(F.col("_s._m"), F.col("_s._m") + F.lit(holding_bars - 1))).alias("_m"),
        F.col("_s._side").alias("_held"), F.lit(True).alias("_has"),
    )
    keep = [c for c in df.columns if c not in ("_m", "_side", "_z")]
    live = df.withColumn("_has", F.col("_z").isNotNull())
    out = live.join(held, [*key, "_m", "_has"], "left")
    return out.select(*keep, F.coalesce("_held", F.lit(0.0)).alias("position"))


def predictions_to_positions(
    pred: Column | str, kind: str, *, direction_band: float = 0.0, return_band: float = 0.0
) -> Column:
    """+1 above the upper bound, -1 below the lower one, else 0."""
    p = maths.col(pred)
    middle, band = (0.5, direction_band) if kind == "direction" else (0.0, return_band)
    return F.when(p > middle + band, 1.0).when(p < middle - band, -1.0).otherwise(0.0)


def vol_target(
    bars: DataFrame,
    daily_target: float = 0.01,
    lookback: int = 288,
    bars_per_day: int = 288,
    max_leverage: float = 1.0,
    *,
    key: Sequence[str] = KEY,
    size: int | None = TILE_ROWS,
) -> DataFrame:
    """Scale ``position`` to a daily volatility, measured up to the previous bar; 0 without one."""
    if daily_target <= 0:
        raise ValueError(f"the daily target is {daily_target}; it has to be above zero")
    if lookback < 5:
        raise ValueError(f"volatility over {lookback} bars is asked for; 5 bars are the least")
    t = tile(bars, key, before=lookback + 1, size=size)
    ret = F.coalesce(F.ln(maths.div("close", t.lag("close"))), F.lit(0.0))
    first = F.col("rn") == 0
    df = t.df.withColumn("_r", F.when(first, F.lit(0.0)).otherwise(ret))
    w = t.rows(-lookback, -1)
    vol = full(F.col("_r"), w, lookback, F.stddev_samp("_r").over(w)) * F.lit(math.sqrt(bars_per_day))
    scale = F.when(vol > 0, F.least(F.lit(float(max_leverage)), maths.div(F.lit(float(daily_target)), vol)))
    out = t.core(df.withColumn("position", F.col("position") * F.coalesce(scale, F.lit(0.0))))
    return tidy(out).drop("_r")


def market_making_quotes(
    state: DataFrame, gamma: float = 0.01, sigma: float = 5.0, k: float = 1.5
) -> DataFrame:
    """Avellaneda-Stoikov quotes for rows of (mid, inventory, horizon_left)."""
    for name, v in (("gamma", gamma), ("sigma", sigma), ("k", k)):
        if v <= 0:
            raise ValueError(f"{name} is {v}; it has to be above zero")
    risk = F.lit(gamma * sigma**2) * F.greatest(F.lit(1e-9), F.col("horizon_left"))
    reservation = F.col("mid") - F.col("inventory") * risk
    half = risk + F.lit(2.0 / gamma * math.log(1.0 + gamma / k))
    return state.withColumns({"reservation": reservation, "bid": reservation - half, "ask": reservation + half})


def fill_probability(delta: Column, dt_seconds: Column, base_rate: float = 0.5, decay: float = 1.5) -> Column:
    """Chance that a quote ``delta`` away from the mid is hit within ``dt_seconds``."""
    rate = F.lit(base_rate) * F.exp(F.lit(-decay) * delta)
    return F.when(delta < 0, F.lit(1.0)).otherwise(1 - F.exp(-rate * dt_seconds))


def markers(bars: DataFrame, *, key: Sequence[str] = KEY, size: int | None = TILE_ROWS) -> DataFrame:
    """Bars where the position rises (``entry``) or falls (``exit``), with their close."""
    t = tile(bars, key, before=1, size=size)
    change = F.col("position") - F.coalesce(t.lag("position"), F.lit(0.0))
    out = t.core(t.df.withColumn("_d", change)).where("_d <> 0")
    return out.select(*key, "ts", "close", F.when(F.col("_d") > 0, "entry").otherwise("exit").alias("marker"))


__all__ = [
    "STRATEGIES", "BollingerMeanReversion", "MACrossover", "Strategy", "bollinger_mean_reversion", "buy_and_hold",
    "fill_probability", "ma_crossover", "market_making_quotes", "markers", "ofi_mean_reversion",
    "predictions_to_positions", "vol_target",
]
