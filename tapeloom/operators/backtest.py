"""Backtests of position columns, trade logs, walk-forward search, and fill ledgers."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import clock, maths
from tapeloom.operators.signals import STRATEGIES, Strategy
from tapeloom.operators.walkforward import Score, scored_slices, sharpe_score
from tapeloom.plans.joins import asof_join, lookup_join, match_keys
from tapeloom.plans.runs import next_row
from tapeloom.plans.scan import carry_scan, running
from tapeloom.plans.stage import stage
from tapeloom.plans.tiles import KEY, TILE_ROWS, tile

# Default costs in basis points.
TAKER_FEE_BPS = 10.0
SLIPPAGE_BPS = 2.0


@dataclass(frozen=True)
class BacktestConfig:
    initial_capital: float = 10_000.0
    fee_bps: float = TAKER_FEE_BPS
    slippage_bps: float = SLIPPAGE_BPS
    execution: str = "next_open"
    fee_bps_maker: float = 0.0
    assume_maker: bool = False

    def __post_init__(self) -> None:
        if self.execution not in {"next_open", "next_close"}:
            raise ValueError(f"execution is {self.execution!r}; next_open and next_close are possible")

    @property
    def cost(self) -> float:
        """Cost per unit of position change, as a fraction."""
        fee = self.fee_bps_maker if self.assume_maker else self.fee_bps
        return (fee + self.slippage_bps) / 1e4


def align_positions(bars: DataFrame, positions: DataFrame, *, key: Sequence[str] = KEY) -> DataFrame:
    """Bars joined with a separate position table; differing keys fail the job."""
    return match_keys(bars, positions.select(*key, "ts", "position"), [*key, "ts"], "bars and positions")


def _checked(position: Column) -> Column:
    bad_price = (F.col("close") <= 0) | (F.col("open") <= 0)
    raw = F.coalesce(position.cast("double"), F.lit(0.0))
    return (
        F.when(bad_price, F.raise_error(F.lit("non-positive price")))
        .when(F.abs(raw) > 1, F.raise_error(F.lit("position outside [-1, 1]")))
        .otherwise(raw)
    )


def _highest() -> Column:
    """The highest product so far, whatever the sign of what came before the tile."""
    return F.greatest(F.col("_in") * F.col("_m"), F.col("_in") * F.col("_n"))


def run_backtest(
    bars: DataFrame,
    config: BacktestConfig = BacktestConfig(),
    *,
    key: Sequence[str] = KEY,
    size: int | None = TILE_ROWS,
    cost: Column | None = None,
) -> DataFrame:
    """Per bar: lagged position, gross and net return, fee, equity and drawdown.

    ``bars`` carry the target ``position`` (NULL counts as 0), which takes effect one bar later.
    Equity is a running product and drawdown refers to a running maximum; both cross tile borders
    through one table with each tile's total, highest and lowest product. ``cost`` per unit of position change may differ
    between series; the default is the configuration's.
    """
    key = list(key)
    t = tile(bars, key, before=2, after=1, size=size)
    df = t.df.withColumn("raw_position", _checked(F.col("position")))
    df = df.withColumn("_lagged", F.coalesce(t.lag("raw_position"), F.lit(0.0)))
    if config.execution == "next_open":
        gross = maths.div(t.lead("open"), F.col("open")) - 1
    else:
        gross = maths.div(F.col("close"), t.lag("close")) - 1
    df = df.withColumns({"gross_return": F.coalesce(gross, F.lit(0.0)), "prev_position": F.coalesce(t.lag("_lagged"), F.lit(0.0))})
    df = t.core(df).withColumn("position_change", F.abs(F.col("_lagged") - F.col("prev_position")))
    df = df.withColumn("fee", F.col("position_change") * (F.lit(config.cost) if cost is None else cost))
    df = df.withColumn("net_return", F.col("_lagged") * F.col("gross_return") - F.col("fee"))
    w = Window.partitionBy(*key, "_tile").orderBy("rn")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_p", F.product(F.col("net_return") + 1).over(up_to))
    df = df.withColumns({"_m": F.max("_p").over(up_to), "_n": F.min("_p").over(up_to), "_pp": F.coalesce(F.lag("_p").over(w), F.lit(1.0))})
    if size is None:
        df = df.withColumns({"_in": F.lit(1.0), "_peak": F.lit(None).cast("double")})
    else:
        totals = df.groupBy(*key, "_tile").agg(F.max_by("_p", "rn").alias("_p"), F.max("_p").alias("_m"), F.min("_p").alias("_n"))
        before = Window.partitionBy(*key).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.withColumn("_in", F.coalesce(F.product("_p").over(before), F.lit(1.0)))
        totals = totals.withColumn("_peak", F.max(_highest()).over(before)).drop("_p", "_m", "_n")
        df = df.join(totals, [*key, "_tile"])
    equity = F.lit(config.initial_capital) * F.col("_in")
    top = F.greatest(F.col("_peak"), _highest())
    kept = [c for c in bars.columns if c not in ("position", "rn")]
    return df.select(
        *kept,
        "rn",
        "raw_position",
        F.col("_lagged").alias("position"),
        "prev_position",
        "position_change",
        "gross_return",
        "fee",
        "net_return",
        (equity * F.col("_p")).alias("equity"),
        F.when(F.col("rn") == 0, equity * F.col("_p")).otherwise(equity * F.col("_pp")).alias("prev_equity"),
        (maths.div(F.col("_in") * F.col("_p"), top) - 1).alias("drawdown"),
    )


def trade_log(result: DataFrame, *, key: Sequence[str] = KEY, size: int | None = TILE_ROWS) -> DataFrame:
    """One row per trade (a maximal run of one position sign) of a backtest.

    A trade exits on the first bar of the next run, with the cost of leaving, or on the last bar.
    Its entry equity is that of the bar before it, except after a flip, where it starts from the
    previous trade's exit equity.
    """
    key = list(key)
    sign = F.signum("position")
    came_from = F.signum("prev_position")
    edges = result.where((F.col("rn") == 0) | (sign != came_from)).select(
        *key, "rn", "ts", "position", "equity", "prev_equity", came_from.alias("_from")
    )
    edges = next_row(edges, key, ["rn", "ts", "equity"], size=size)
    ends = result.groupBy(*key).agg(*[F.max_by(c, "rn").alias(f"_end_{c}") for c in ("rn", "ts", "equity")])
    opened = edges.where("position <> 0").join(ends, key)
    exit_ = lambda c: F.coalesce(F.col(f"next_{c}"), F.col(f"_end_{c}"))
    start = F.when(F.col("_from") != 0, F.col("equity")).otherwise(F.col("prev_equity"))
    return opened.select(
        *key,
        F.col("ts").alias("entry_at"),
        exit_("ts").alias("exit_at"),
        F.col("position").cast("long").alias("side"),
        (exit_("rn") - F.col("rn")).alias("bars_held"),
        start.alias("entry_equity"),
        exit_("equity").alias("exit_equity"),
        F.coalesce(maths.div(exit_("equity"), start) - 1, F.lit(0.0)).alias("pnl_pct"),
    )


# ---- walk-forward -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rolling:
    """Walk-forward geometry; window k trains on ``train_days`` ending at first + train + k·step."""

    train_days: int = 60
    test_days: int = 14
    step_days: int | None = None
    anchored: bool = False

    def __post_init__(self) -> None:
        if self.step_days is not None and self.step_days <= 0:
            raise ValueError(f"windows step by {self.step_days} days; 1 day is the least")
        if self.train_days <= 0 or self.test_days <= 0:
            raise ValueError(f"windows train on {self.train_days} and test on {self.test_days} days; 1 day each is the least")

    @property
    def us(self) -> tuple[int, int, int]:
        step = self.test_days if self.step_days is None else self.step_days
        return self.train_days * clock.DAY, self.test_days * clock.DAY, step * clock.DAY


def _extent(bars: DataFrame, key: Sequence[str]) -> DataFrame:
    us = clock.micros("ts")
    return bars.groupBy(*key).agg(F.min(us).alias("_first"), F.max(us).alias("_last"))


def make_windows(bars: DataFrame, rolling: Rolling = Rolling(), *, key: Sequence[str] = KEY) -> DataFrame:
    """(key, window_id, train_start, train_end, test_start, test_end) per series."""
    train, test, step = rolling.us
    like = clock.ts_type(bars)
    lo, hi = F.col("_first") + train, F.col("_last") - test
    ends = _extent(bars, key).where(lo <= hi)
    ends = ends.select(*key, "_first", F.posexplode(F.sequence(lo, hi, F.lit(step))).alias("window_id", "_end"))
    start = F.col("_first") if rolling.anchored else F.col("_end") - train
    at = lambda c: clock.from_micros(c, like)
    return ends.select(
        *key,
        F.col("window_id").cast("long").alias("window_id"),
        at(start).alias("train_start"),
        at(F.col("_end")).alias("train_end"),
        at(F.col("_end")).alias("test_start"),
        at(F.col("_end") + test).alias("test_end"),
    )


def window_slices(
    bars: DataFrame, rolling: Rolling, *, key: Sequence[str] = KEY, inclusive: bool = True, extent: DataFrame | None = None
) -> DataFrame:
    """Every bar once per walk-forward slice it belongs to: adds ``window_id`` and ``role``.

    The window numbers of a bar follow from its offset by arithmetic, so this is an explode of a
    few numbers per row, not a range join. ``inclusive`` slices hold both ends (rule search), the
    others are half-open (model fitting).
    """
    train, test, step = rolling.us
    spans = (_extent(bars, key) if extent is None else extent).where(F.col("_last") - F.col("_first") >= train + test)
    df = lookup_join(bars, spans, key)
    off = clock.micros("ts") - F.col("_first")
    most = F.floor((F.col("_last") - F.col("_first") - train - test) / F.lit(step))

    def at_least(d: Column) -> Column:  # smallest k with k·step >= d (inclusive) or > d
        below = (d - F.pmod(d, F.lit(step))) / step
        k = F.round(below).cast("long")
        on_edge = F.pmod(d, F.lit(step)) == 0
        return F.when(on_edge & F.lit(inclusive), k).otherwise(k + 1)

    def at_most(d: Column) -> Column:  # largest k with k·step <= d
        return F.round((d - F.pmod(d, F.lit(step))) / step).cast("long")

    zero = F.lit(0).cast("long")
    last = F.lit(2**40) if rolling.anchored else at_most(off)
    ids = lambda lo, hi: F.when(F.greatest(zero, lo) <= F.least(most, hi), F.sequence(F.greatest(zero, lo), F.least(most, hi)))
    roles = F.array(
        F.struct(F.lit("train").alias("role"), ids(at_least(off - train), last).alias("_k")),
        F.struct(F.lit("test").alias("role"), ids(at_least(off - train - test), at_most(off - train)).alias("_k")),
    )
    out = df.select(*bars.columns, F.explode(roles).alias("_s")).where("_s._k is not null")
    return out.select(*bars.columns, F.col("_s.role").alias("role"), F.explode("_s._k").alias("window_id"))


def parameter_grid(grid: Mapping[str, Iterable[Any]]) -> list[dict[str, Any]]:
    """Cartesian product in the order of the keys."""
    names = list(grid)
    return [dict(zip(names, values)) for values in itertools.product(*(list(grid[n]) for n in names))]


def valid_combos(strategy: Strategy, grid: Mapping[str, Iterable[Any]]) -> list[tuple[int, dict[str, Any]]]:
    """Numbered parameter sets, without those the strategy refuses."""
    out = []
    for i, params in enumerate(parameter_grid(grid)):
        try:
            strategy.valid(**params)
        except (ValueError, TypeError):
            continue
        out.append((i, params))
    return out


def _grid_positions(slices: DataFrame, strategy: Strategy, combos, key: list[str]) -> DataFrame:
    """Positions for the parameter set named by ``combo_id`` in each row's slice."""
    pick_event, pick_ready = F.lit(None).cast("double"), F.lit(False)
    for i, params in combos:
        mine = F.col("combo_id") == i
        pick_event = F.when(mine, strategy.event(**params)).otherwise(pick_event)
        pick_ready = F.when(mine, strategy.ready(**params)).otherwise(pick_ready)
    df = slices.withColumns({"_event": pick_event, "_ready": pick_ready})
    if strategy.latched:
        w = Window.partitionBy(*key, "combo_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn("_event", F.last("_event", ignorenulls=True).over(w))
    return df.withColumn("position", F.when(F.col("_ready"), F.coalesce("_event", F.lit(0.0))))


def _finite_or_high(c: str) -> Column:
    """A score that can win: neither missing, nor not a number, nor minus infinity."""
    x = F.col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (x > F.lit(float("-inf")))


def walk_forward(
    bars: DataFrame,
    strategy: Strategy | str,
    grid: Mapping[str, Iterable[Any]],
    rolling: Rolling = Rolling(),
    config: BacktestConfig = BacktestConfig(),
    *,
    bars_per_year: int | None = None,
    score: Score | None = None,
    key: Sequence[str] = KEY,
    size: int = TILE_ROWS,
) -> DataFrame:
    """Per window the parameter set with the best training score, and how it did on the test slice.

    Every parameter set is run once over each series, and slices are scored by differences of running
    sums (``walkforward``), so rolling and anchored windows take work linear in the bars. ``score`` maps the
    moments of a slice's net returns to a number; the default is the Sharpe ratio.
    """
    if score is None:
        if bars_per_year is None:
            raise ValueError("give bars_per_year or score")
        score = sharpe_score(bars_per_year)
    strategy = STRATEGIES[strategy] if isinstance(strategy, str) else strategy
    combos = valid_combos(strategy, grid)
    params = [p for _, p in combos]
    key = list(key)
    part = [*key, "window_id"]
    windows = stage(make_windows(bars, rolling, key=key), "windows")
    scores = stage(scored_slices(bars, windows, strategy, combos, score, config.cost, config.execution, key=key, size=size), "scores")
    train = scores.where("role = 'train'").withColumnRenamed("score", "train_score").where(_finite_or_high("train_score"))
    best = train.groupBy(*part).agg(F.max_by(F.struct("combo_id", "train_score"), F.struct("train_score", -F.col("combo_id"))).alias("_b"))
    test = scores.where("role = 'test'").select(*part, "combo_id", F.col("score").alias("test_score"), F.col("trades").alias("n_trades_test"))
    out = best.select(*part, "_b.*").join(test, [*part, "combo_id"])
    named = F.create_map(*[x for n in (params[0] if params else {}) for x in (F.lit(n), _param(combos, n))])
    return windows.join(out, part).select(*windows.columns, "combo_id", "train_score", "test_score", named.alias("params"), "n_trades_test")


def _param(combos, name: str) -> Column:
    out = F.lit(None).cast("double")
    for i, p in combos:
        out = F.when(F.col("combo_id") == i, F.lit(float(p[name]))).otherwise(out)
    return out


def stitched_curve(
    bars: DataFrame,
    strategy: Strategy | str,
    params: Mapping[str, Any],
    rolling: Rolling = Rolling(),
    config: BacktestConfig = BacktestConfig(),
    *,
    key: Sequence[str] = KEY,
) -> DataFrame:
    """Out-of-sample test slices chained into one curve, each rescaled to the end of the last."""
    strategy = STRATEGIES[strategy] if isinstance(strategy, str) else strategy
    strategy.valid(**params)
    if rolling.us[2] < rolling.us[1]:
        raise ValueError("step_days must be at least test_days to chain test slices")
    key = list(key)
    part = [*key, "window_id"]
    slices = window_slices(bars.select(*key, "ts", *strategy.columns), rolling, key=key).where("role = 'test'").drop("role")
    t = tile(slices, part, size=None)
    df = strategy.indicators(t, [params]).drop("_tile", "_core").withColumn("combo_id", F.lit(0))
    df = _grid_positions(df, strategy, [(0, dict(params))], part)
    parts = stage(run_backtest(df.select(*part, "ts", "open", "close", "rn", "position"), config, key=part, size=None), "slices")
    ends = parts.groupBy(*part).agg(F.min_by("equity", "rn").alias("_a"), F.max_by("equity", "rn").alias("_b"))
    earlier = Window.partitionBy(*key).orderBy("window_id").rowsBetween(Window.unboundedPreceding, -1)  # one row per window
    scale = F.coalesce(F.product(maths.div("_b", "_a")).over(earlier), F.lit(1.0)) * F.lit(config.initial_capital)
    ends = ends.select(*part, maths.div(scale, F.col("_a")).alias("_scale"))
    chained = parts.join(ends, part).withColumn("equity", F.col("equity") * F.col("_scale")).drop("_scale", "prev_equity", "drawdown", "prev_position", "position_change")
    chained = carry_scan(
        chained, key, "window_id", ("rn",),
        {"_top": running("max", "equity"), "_prev": running("last", "position")}, exclusive=True,
    )
    return chained.select(
        *part, "ts", "rn", "equity", "net_return", "gross_return", "fee", "position",
        F.coalesce(F.abs(F.col("position") - F.col("_prev")), F.lit(0.0)).alias("position_change"),
        (maths.div("equity", F.greatest(F.col("_top"), F.col("equity"))) - 1).alias("drawdown"),
    )


def walk_forward_summary(report: DataFrame, *, key: Sequence[str] = KEY) -> DataFrame:
    """Window count, mean train and test score, median test score, share of positive test scores."""
    return report.groupBy(*key).agg(
        F.count("*").alias("windows"),
        F.avg("train_score").alias("mean_train"),
        F.avg("test_score").alias("mean_test"),
        F.median("test_score").alias("median_test"),
        F.avg(F.coalesce((F.col("test_score") > 0).cast("double"), F.lit(0.0))).alias("positive_share"),
    )


# ---- market-maker fills -------------------------------------------------------------------------


def ledger(
    fills: DataFrame,
    mids: DataFrame,
    *,
    mid: str = "mid",
    fee_bps: float = 0.0,
    initial_cash: float = 10_000.0,
    inventory_cap: float | None = None,
    key: Sequence[str] = KEY,
    bucket: str = "1d",
) -> DataFrame:
    """Running inventory, cash and equity of fills, marked at the mid as of each fill."""
    fee = fee_bps / 1e4
    buy = F.col("side") == "buy"
    notional = F.col("price") * F.col("qty")
    quoted = stage(asof_join(fills, mids, [mid], key=key), "quoted")
    moved = quoted.withColumns(
        {
            "_q": F.when(buy, F.col("qty")).otherwise(-F.col("qty")),
            "_c": F.when(buy, notional * F.lit(-(1 + fee))).otherwise(notional * F.lit(1 - fee)),
            "_bucket": clock.floor_us(clock.micros("ts"), clock.duration_us(bucket)),
        }
    )
    out = carry_scan(
        moved, key, "_bucket", ("ts", "fill_id"), {"inventory": running("sum", "_q"), "_cash": running("sum", "_c")}
    )
    cash = F.lit(initial_cash) + F.col("_cash")
    breach = F.lit(False) if inventory_cap is None else F.abs("inventory") > F.lit(inventory_cap + 1e-12)
    return out.select(
        *[c for c in fills.columns], mid, "inventory", cash.alias("cash"),
        (cash + F.col("inventory") * F.col(mid)).alias("equity"), breach.alias("over_cap"),
    )


def marked_ledger(
    book: DataFrame, mids: DataFrame, *, mid: str = "mid", key: Sequence[str] = KEY, initial_cash: float = 10_000.0
) -> DataFrame:
    """Every mid observation with the inventory, cash and equity that the fills up to it have left."""
    held = asof_join(mids, book.select(*key, "ts", "fill_id", "inventory", "cash"), ["inventory", "cash"], key=key, tie="fill_id")
    held = held.withColumns({"inventory": F.coalesce("inventory", F.lit(0.0)), "cash": F.coalesce("cash", F.lit(initial_cash))})
    return held.withColumn("equity", F.col("cash") + F.col("inventory") * F.col(mid))


def pnl_decomposition(book: DataFrame, *, mid: str = "mid", key: Sequence[str] = KEY, order: Sequence[str] = ("ts", "fill_id")) -> DataFrame:
    """Total PnL, cash drift and inventory mark-to-market, from the first row of each series."""
    at = maths.tick_order(clock.micros(order[0]), F.col(order[1]))
    first = book.groupBy(*key).agg(F.min_by("equity", at).alias("_equity"), F.min_by("cash", at).alias("_cash"))
    return lookup_join(book, first, key).select(
        *key, *order,
        (F.col("equity") - F.col("_equity")).alias("total_pnl"),
        (F.col("cash") - F.col("_cash")).alias("cash_drift"),
        (F.col("inventory") * F.col(mid)).alias("inventory_value"),
    )


def step_sharpe(book: DataFrame, *, key: Sequence[str] = KEY, order: Sequence[str] = ("ts", "fill_id"), initial_cash: float = 10_000.0) -> DataFrame:
    """mean(Δequity) / std(Δequity) · √n and the final PnL of each series."""
    t = tile(book, key, before=1, order=order)
    steps = t.core(t.df.withColumn("_d", F.col("equity") - t.lag("equity")))
    return steps.groupBy(*key).agg(
        F.count("*").alias("steps"),
        (maths.div(F.avg("_d"), F.stddev_samp("_d")) * F.sqrt(F.count("*"))).alias("step_sharpe"),
        (F.max_by("equity", "rn") - F.lit(initial_cash)).alias("final_pnl"),
    )


def leaderboard(results: DataFrame, *, by: Sequence[str] = ("symbol", "timeframe")) -> DataFrame:
    """Strategies ranked by final equity within each panel; ``overall`` marks the best of all.

    ``results`` has one row per (panel, strategy).
    """
    w = Window.partitionBy(*by).orderBy(F.desc("final_equity"), "strategy")
    top = results.agg(F.max(F.struct("final_equity")).alias("_top"))
    ranked = results.withColumn("place", F.row_number().over(w))
    return ranked.join(F.broadcast(top), F.lit(True)).withColumn(
        "overall", F.col("final_equity") == F.col("_top.final_equity")
    ).drop("_top")


__all__ = [
    "BacktestConfig", "Rolling", "align_positions", "leaderboard", "ledger", "make_windows", "marked_ledger", "parameter_grid",
    "pnl_decomposition", "run_backtest", "step_sharpe", "stitched_curve", "trade_log", "valid_combos",
    "walk_forward", "walk_forward_summary", "window_slices",
]
