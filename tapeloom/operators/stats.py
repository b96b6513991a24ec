"""Performance statistics, each an aggregate per series key. NULL stands for "undefined"."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import maths
from tapeloom.functions.maths import INF, col, div, norm_cdf, uniform
from tapeloom.plans.joins import dense_grid, lookup_join
from tapeloom.plans.scan import carry_scan, running
from tapeloom.plans.stage import stage
from tapeloom.plans.tiles import KEY, TILE_ROWS, tile


def sharpe(returns: Column | str, bars_per_year: int, rf_per_bar: float = 0.0) -> Column:
    """Aggregate: annualised mean / standard deviation."""
    r = col(returns) - F.lit(rf_per_bar)
    mean, sd = F.avg(r), F.stddev_samp(r)
    usable = (F.count(r) >= 2) & ~maths.is_flat(mean, sd)
    return F.when(usable, div(mean, sd) * F.lit(math.sqrt(bars_per_year)))


def sortino(returns: Column | str, bars_per_year: int, mar_per_bar: float = 0.0) -> Column:
    """Aggregate: as Sharpe, over the root mean square of the negative returns only."""
    r = col(returns) - F.lit(mar_per_bar)
    mean = F.avg(r)
    down = F.sqrt(F.avg(F.when(r < 0, r * r)))
    ratio = F.when(down.isNotNull(), div(mean, down) * F.lit(math.sqrt(bars_per_year))).when(mean > 0, F.lit(INF))
    return F.when(F.count(r) >= 2, ratio)


def _ends(equity: str, order: str) -> tuple[Column, Column]:
    return F.min_by(equity, order), F.max_by(equity, order)


def annualized_return(equity: str, bars_per_year: int, order: str = "rn") -> Column:
    """Aggregate: (last / first) ^ (bars_per_year / (n - 1)) - 1."""
    first, last = _ends(equity, order)
    ratio, n = div(last, first), F.count("*")
    return F.when((n >= 2) & (ratio > 0), F.pow(ratio, F.lit(float(bars_per_year)) / F.greatest(n - 1, F.lit(1))) - 1)


def total_return(equity: str, order: str = "rn") -> Column:
    """Aggregate: last / first - 1."""
    first, last = _ends(equity, order)
    return F.when(F.count("*") >= 2, div(last, first) - 1).otherwise(F.lit(0.0))


def hit_rate(pnl: str) -> Column:
    """Aggregate: share of positive values."""
    return F.avg(F.when(F.col(pnl).isNotNull(), (F.col(pnl) > 0).cast("double")))


def profit_factor(pnl: str) -> Column:
    """Aggregate: gains over losses; infinite without losses."""
    p = F.col(pnl)
    gains = F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0))
    losses = F.coalesce(-F.sum(F.when(p < 0, p)), F.lit(0.0))
    return F.when(losses != 0, div(gains, losses)).when(gains > 0, F.lit(INF))


def with_peak(df: DataFrame, value: str = "equity", *, key: Sequence[str] = KEY, size: int | None = TILE_ROWS) -> DataFrame:
    """Add ``peak`` (running maximum so far), ``peak_ts`` (its latest time) and ``dd``."""
    out = carry_scan(tile(df, key, size=size).core(), key, "_tile", ("rn",), {"peak": running("max", value)})
    out = out.withColumn("_top", F.when(F.col(value) == F.col("peak"), F.col("ts")))
    out = carry_scan(out, key, "_tile", ("rn",), {"peak_ts": running("last", "_top")})
    return out.withColumn("dd", div(value, "peak") - 1).drop("_top", "_tile")


def max_drawdown(df: DataFrame, value: str = "equity", *, key: Sequence[str] = KEY, size: int | None = TILE_ROWS) -> DataFrame:
    """Deepest fall from the running maximum, its first trough and the latest peak before it.

    The depth is found first, then the first row that has it: plain numbers, so both are hash aggregates."""
    falls = stage(with_peak(df, value, key=key, size=size).select(*key, "ts", "dd", "peak_ts"), "falls")
    deepest = falls.groupBy(*key).agg(F.min("dd").alias("max_drawdown"))
    at = lookup_join(falls, deepest, key).where("dd = max_drawdown")
    return at.groupBy(*key).agg(F.min("dd").alias("max_drawdown"), F.min_by("peak_ts", "ts").alias("peak_ts"), F.min("ts").alias("trough_ts"))


def calmar(cagr: Column, mdd: Column) -> Column:
    return F.when(mdd != 0, div(cagr, F.abs(mdd)))


def turnover_per_year(
    df: DataFrame, bars_per_year: int, position: str = "position", *, key: Sequence[str] = KEY, size: int | None = TILE_ROWS
) -> DataFrame:
    """Σ |Δposition| scaled to a year."""
    t = tile(df, key, before=1, size=size)
    out = t.core(t.df.withColumn("_d", F.abs(F.col(position) - t.lag(position))))
    n = F.count("*")
    total = F.coalesce(F.sum("_d"), F.lit(0.0)) * F.lit(float(bars_per_year)) / n
    return out.groupBy(*key).agg(F.when(n < 2, F.lit(0.0)).otherwise(total).alias("turnover_per_year"))


def summarize(
    result: DataFrame,
    trades: DataFrame | None,
    bars_per_year: int,
    *,
    key: Sequence[str] = KEY,
    size: int | None = TILE_ROWS,
) -> DataFrame:
    """All metrics of a backtest, one row per key. ``trades`` may be None."""
    key = list(key)
    if "prev_position" in result.columns:
        moved = result.withColumn("_d", F.abs(F.col("position") - F.col("prev_position")))
    else:
        t = tile(result, key, before=1, size=size)
        moved = t.core(t.df.withColumn("_d", F.abs(F.col("position") - t.lag("position"))))
    n = F.count("*")
    per_year = F.lit(float(bars_per_year))
    out = moved.groupBy(*key).agg(
        total_return("equity").alias("total_return"),
        annualized_return("equity", bars_per_year).alias("annualized_return"),
        sharpe("net_return", bars_per_year).alias("sharpe"),
        sortino("net_return", bars_per_year).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"),
        F.when(n < 2, F.lit(0.0)).otherwise(F.coalesce(F.sum("_d"), F.lit(0.0)) * per_year / n).alias("turnover_per_year"),
    )
    out = out.withColumn("calmar", calmar(F.col("annualized_return"), F.col("max_drawdown")))
    if trades is None:
        empty = F.lit(None).cast("double")
        return out.withColumns({"num_trades": F.lit(0.0), "hit_rate": empty, "profit_factor": empty})
    per_trade = trades.groupBy(*key).agg(
        F.count("*").cast("double").alias("num_trades"),
        hit_rate("pnl_pct").alias("hit_rate"),
        profit_factor("pnl_pct").alias("profit_factor"),
    )
    return out.join(per_trade, key, "left").withColumn("num_trades", F.coalesce("num_trades", F.lit(0.0)))


# ---- resampling intervals -----------------------------------------------------------------------


def auto_block_size(n: Column) -> Column:
    cube = F.pow(n.cast("double"), F.lit(1.0 / 3.0))
    return F.when(n < 10, F.lit(2.0)).otherwise(F.greatest(F.lit(2.0), F.least(n / 10, cube * 1.75)))


def _numbered(df: DataFrame, value: str, key: Sequence[str]) -> DataFrame:
    """The non-NULL values numbered from 0 in series order."""
    return tile(_returns(df, value, key), key).df.select(*key, "rn", "r")


def _returns(df: DataFrame, value: str, key: Sequence[str]) -> DataFrame:
    """The one column that a statistic reads several times, written once."""
    return stage(df.where(F.col(value).isNotNull()).select(*key, "ts", F.col(value).alias("r")), "returns")


def bootstrap_indices(
    sizes: DataFrame,
    *,
    n_iter: int,
    seed: int = 0,
    mean_block_size: float | None = None,
    key: Sequence[str] = KEY,
    block: int = 65_536,
) -> DataFrame:
    """Stationary bootstrap: (key, iter, t, idx) from (key, n).

    At each t a block restarts at a uniform row with probability 1 / mean block size, else the
    index moves on by one, round the end. Draws are hashes of (seed, iter, t), so any partitioning
    gives the same rows; the latest restart comes from a scan over blocks of t.
    """
    if mean_block_size is not None and mean_block_size < 1:
        raise ValueError("mean_block_size must be >= 1")
    length = auto_block_size(F.col("n")) if mean_block_size is None else F.lit(float(mean_block_size))
    by = [*key, "iter"]
    bounds = sizes.where("n > 0").select(
        *key, F.lit(0).cast("long").alias("lo"), (F.col("n") - 1).cast("long").alias("hi"),
        F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1))).alias("iter"),
    )
    steps = dense_grid(bounds, 1, key=by, block=block).withColumnRenamed("_us", "t")
    steps = lookup_join(steps, sizes.select(*key, "n", length.alias("_len")), key)
    restart = (F.col("t") == 0) | (uniform(seed, F.lit("restart"), "iter", "t") < 1 / F.col("_len"))
    start = F.floor(uniform(seed, F.lit("start"), "iter", "t") * F.col("n")).cast("long")
    mark = F.when(restart, F.struct(F.col("t").alias("t"), start.alias("s")))
    out = carry_scan(steps, by, "_from", ("t",), {"_at": running("last", mark, ("t", "s"))})
    return out.select(*by, "t", F.pmod(F.col("_at.s") + F.col("t") - F.col("_at.t"), F.col("n")).alias("idx"))


# Blocks of one replicate are drawn in segments that expect this many of them.
_BLOCKS = 256


def bootstrap_blocks(
    sizes: DataFrame, *, n_iter: int, seed: int = 0, mean_block_size: float | None = None, key: Sequence[str] = KEY
) -> DataFrame:
    """Stationary bootstrap by blocks: (key, iter, t, idx, length, n) from (key, n).

    Rows t to t + length - 1 of a replicate are the source rows idx, idx + 1, ... round the end. The steps
    between restarts are geometric, so they are drawn directly, by inversion of a hash of (seed, iter, segment, number):
    about n / mean block size rows per replicate instead of n. Restarts have no memory, so the time axis is cut into segments that
    are drawn on their own; a block that crosses a border is continued there by one more row. A segment in which the
    drawn steps should not reach its end (a chance below 1e-15) fails the job.
    """
    if mean_block_size is not None and mean_block_size < 1:
        raise ValueError("mean_block_size must be >= 1")
    key = list(key)
    by = [*key, "iter"]
    length = auto_block_size(F.col("n")) if mean_block_size is None else F.lit(float(mean_block_size))
    span = F.greatest(F.lit(1), F.least(F.col("n"), F.floor(F.lit(_BLOCKS) * F.col("_len")))).cast("long")
    expected = F.col("_span") / F.col("_len")
    most = F.least(F.col("_span") + 1, F.ceil(expected + 12 * F.sqrt(expected) + 30)).cast("long")
    series = sizes.where("n > 0").select(*key, F.col("n").cast("long").alias("n"), length.alias("_len")).withColumn("_span", span).withColumn("_most", most)
    drawn = series.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1))).alias("iter"))
    drawn = drawn.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("_span")))).alias("_seg"))
    drawn = drawn.repartition(*by, "_seg")  # few wide rows become many: spread them first
    drawn = drawn.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_most") - 1)).alias("_k"))
    u = uniform(seed, F.lit("gap"), "iter", "_seg", "_k")
    gap = F.floor(div(F.log(1 - u), F.log(1 - 1 / F.col("_len")))) + 1
    gap = F.when(((F.col("_seg") == 0) & (F.col("_k") == 0)) | (F.col("_len") <= 1), F.lit(1)).otherwise(gap).cast("long")
    within = Window.partitionBy(*by, "_seg").orderBy("_k")
    begin, end = F.col("_seg") * F.col("_span"), F.least(F.col("n"), (F.col("_seg") + 1) * F.col("_span"))
    drawn = drawn.withColumn("t", begin - 1 + F.sum(gap).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    short = (F.col("_k") == F.col("_most") - 1) & (F.col("t") < end - 1)
    drawn = drawn.withColumn("t", F.when(short, F.raise_error(F.lit("a bootstrap segment was drawn too short")).cast("long")).otherwise(F.col("t")))
    start = F.floor(uniform(seed, F.lit("start"), "iter", "t") * F.col("n")).cast("long")
    marked = drawn.where(F.col("t") < end).select(*by, "n", "_span", "_seg", "t", F.struct(F.col("t").alias("t"), start.alias("s")).alias("_at"))
    borders = series.select(*key, "n", "_span", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1))).alias("iter"))
    borders = borders.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("_span")))).alias("_seg"))
    borders = borders.where("_seg > 0").select(*by, "n", "_span", "_seg", begin.alias("t"), F.lit(None).cast(marked.schema["_at"].dataType).alias("_at"))
    rows = marked.unionByName(borders).withColumn("_order", 2 * F.col("t") + F.col("_at").isNotNull().cast("long"))
    rows = carry_scan(rows, by, "_seg", ("_order",), {"_from": running("last", "_at", ("t", "s"))})
    following = F.lead("t").over(Window.partitionBy(*by, "_seg").orderBy("_order"))
    size = F.coalesce(following, end) - F.col("t")
    out = rows.withColumn("length", size).where("length > 0")
    return out.select(*by, "t", F.pmod(F.col("_from.s") + F.col("t") - F.col("_from.t"), F.col("n")).alias("idx"), "length", "n")


@dataclass(frozen=True)
class Sample:
    """What a statistic of a replicate may use: how many values, their mean and sample standard deviation."""

    n: Column
    mean: Column
    deviation: Column


def mean(s: Sample) -> Column:
    return s.mean


def _replicates(rows: DataFrame, sizes: DataFrame, blocks: DataFrame, key: list[str]) -> DataFrame:
    """(key, iter, n, first, second): the first two moments of every replicate about the mean of the series.

    A block is a run of rows round the end of the series, so its sums are differences of running sums, plus
    whole turns: two looked-up rows per block. Centred values keep the sums of a constant series at 0.
    """
    centred = rows.join(sizes.select(*key, "_mean"), key).withColumn("r", F.col("r") - F.col("_mean"))
    t = tile(centred, key)
    sums = {"first": running("sum", F.col("r")), "second": running("sum", F.col("r") * F.col("r"))}
    before = stage(carry_scan(t.core(), key, "_tile", ("rn",), sums, exclusive=True).select(*key, "rn", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in sums]), "running")
    turn = centred.groupBy(*key).agg(F.sum("r").alias("_all1"), F.sum(F.col("r") * F.col("r")).alias("_all2"))
    ends = F.array(*[F.struct(F.lit(sign).alias("sign"), at.alias("at")) for sign, at in ((-1, F.col("idx")), (1, F.col("idx") + F.col("length")))])
    asked = blocks.select(*key, "iter", "n", F.inline(ends)).select(*key, "iter", "sign", F.pmod("at", "n").alias("rn"), F.floor(F.col("at") / F.col("n")).alias("turns"))
    found = lookup_join(asked.join(before, [*key, "rn"]), turn, key)
    total = lambda c, whole: F.sum(F.col("sign") * (F.col(c) + F.col("turns") * F.col(whole)))
    return found.groupBy(*key, "iter").agg(total("first", "_all1").alias("first"), total("second", "_all2").alias("second"))


def bootstrap_ci(
    df: DataFrame,
    value: str,
    statistic: Callable[[Sample], Column] = mean,
    *,
    n_iter: int = 2000,
    confidence: float = 0.95,
    mean_block_size: float | None = None,
    seed: int = 0,
    key: Sequence[str] = KEY,
) -> DataFrame:
    """Percentile interval of a statistic of mean, deviation and size under the stationary bootstrap.

    A series with fewer than 10 values fails the job. ``bootstrap_any_ci`` takes any aggregate.
    """
    key = list(key)
    rows, sizes = _bootstrap_input(df, value, key, confidence)
    blocks = bootstrap_blocks(sizes.select(*key, "n"), n_iter=n_iter, seed=seed, mean_block_size=mean_block_size, key=key)
    moments = _replicates(rows, sizes, blocks, key).join(sizes.select(*key, "n", "_mean"), key)
    n, first, second = F.col("n"), F.col("first"), F.col("second")
    spread = F.sqrt(F.greatest(F.lit(0.0), second - first * first / n) / (n - 1))
    replicates = moments.select(*key, statistic(Sample(n, F.col("_mean") + first / n, spread)).alias("s")).where("s is not null")
    points = sizes.select(*key, "n", statistic(Sample(n, F.col("_mean"), F.col("_sd"))).alias("point"))
    return _interval(points, replicates, n_iter, confidence, mean_block_size, key)


def bootstrap_any_ci(
    df: DataFrame,
    value: str,
    statistic: Callable[[str], Column],
    *,
    n_iter: int = 2000,
    confidence: float = 0.95,
    mean_block_size: float | None = None,
    seed: int = 0,
    key: Sequence[str] = KEY,
) -> DataFrame:
    """As ``bootstrap_ci`` for any aggregate (``statistic`` maps a column name to one), for which all rows of all
    replicates are needed: blocks meet their rows in a join on (key, row number) and collapse map-side."""
    key = list(key)
    rows, sizes = _bootstrap_input(df, value, key, confidence)
    blocks = bootstrap_blocks(sizes.select(*key, "n"), n_iter=n_iter, seed=seed, mean_block_size=mean_block_size, key=key)
    idx = blocks.select(*key, "iter", "n", F.explode(F.sequence(F.col("idx"), F.col("idx") + F.col("length") - 1)).alias("_i"))
    drawn = idx.withColumn("rn", F.pmod("_i", "n")).join(rows, [*key, "rn"])
    replicates = drawn.groupBy(*key, "iter").agg(statistic("r").alias("s")).where("s is not null")
    points = sizes.select(*key, "n").join(rows.groupBy(*key).agg(statistic("r").alias("point")), key)
    return _interval(points, replicates, n_iter, confidence, mean_block_size, key)


def _bootstrap_input(df: DataFrame, value: str, key: list[str], confidence: float) -> tuple[DataFrame, DataFrame]:
    if not 0 < confidence < 1:
        raise ValueError(f"a confidence of {confidence} is asked for; it lies between 0 and 1")
    rows = stage(_numbered(df, value, key), "numbered")
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n"), F.avg("r").alias("_mean"), F.stddev_samp("r").alias("_sd"))
    short = F.raise_error(F.lit("bootstrap needs at least 10 values per series"))
    return rows, stage(sizes.withColumn("n", F.when(F.col("n") < 10, short).otherwise(F.col("n"))), "sizes")


def _interval(points: DataFrame, replicates: DataFrame, n_iter: int, confidence: float, mean_block_size: float | None, key: list[str]) -> DataFrame:
    alpha = 1.0 - confidence
    bounds = replicates.groupBy(*key).agg(
        F.percentile("s", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("_q")  # n_iter values
    )
    length = auto_block_size(F.col("n")) if mean_block_size is None else F.lit(float(mean_block_size))
    return points.join(bounds, key, "left").select(
        *key, "point", F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper"),
        F.lit(confidence).alias("confidence"), F.lit(n_iter).alias("n_iter"), length.alias("block_size"),
    )


def bootstrap_sharpe_ci(df: DataFrame, value: str, bars_per_year: int, **kw) -> DataFrame:
    def plain_sharpe(s: Sample) -> Column:
        return F.when(s.n >= 2, div(s.mean, F.when(s.deviation > 0, s.deviation)) * F.lit(math.sqrt(bars_per_year)))

    return bootstrap_ci(df, value, plain_sharpe, **kw)


# ---- autocorrelation-robust and probabilistic Sharpe ---------------------------------------------


def auto_nw_lag(n: Column) -> Column:
    long = F.floor(F.pow(n / F.lit(100.0), F.lit(2.0 / 9.0)) * 4)
    return F.when(n < 20, F.greatest(F.lit(1), F.floor(n / 5))).otherwise(long)


def newey_west_sharpe(
    df: DataFrame, value: str, bars_per_year: int, *, lag: int | None = None, key: Sequence[str] = KEY, size: int = TILE_ROWS
) -> DataFrame:
    """Sharpe ratio with a Bartlett-weighted long-run variance.

    The products with the k-th previous return come from one pass over tiles with a halo of the
    longest lag; that lag is a single number read from the series lengths.
    """
    key = list(key)
    rows = _returns(df, value, key)
    moments = rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"), F.var_pop("r").alias("g0")
    )
    wanted = auto_nw_lag(F.col("n")) if lag is None else F.lit(lag)
    moments = moments.withColumn("lag", F.greatest(F.lit(1), F.least(wanted, F.col("n") - 2)).cast("long"))
    moments = stage(moments, "moments")
    longest = moments.agg(F.max("lag")).first()[0] or 1
    t = tile(rows, key, before=longest, size=size)
    products = {f"_x{k}": t.lag("r", k) for k in range(1, longest + 1)}
    lagged = t.core(t.df.withColumns(products)).join(moments.select(*key, "mu", "n", "lag"), key)
    centred = F.col("r") - F.col("mu")
    weighted = F.lit(0.0)
    for k in range(1, longest + 1):
        part = centred * (F.col(f"_x{k}") - F.col("mu"))
        share = (1 - F.lit(float(k)) / (F.col("lag") + 1)) / F.greatest(F.col("n") - k, F.lit(1))
        weighted = weighted + F.when(F.col("lag") >= k, F.coalesce(part, F.lit(0.0)) * share).otherwise(0.0)
    sums = lagged.groupBy(*key).agg(F.sum(weighted).alias("_w"))
    out = moments.join(sums, key)
    usable = (F.col("n") >= 3) & (F.col("sd") != 0)
    per_bar = div("mu", "sd")
    adjust = F.when(F.col("g0") > 0, div(F.col("g0") + 2 * F.col("_w"), F.col("g0"))).otherwise(F.lit(1.0))
    se = F.sqrt(F.greatest(F.lit(1e-12), (1 + 0.5 * per_bar * per_bar) * adjust / F.col("n")))
    scale = F.lit(math.sqrt(bars_per_year))
    return out.select(
        *key,
        F.when(usable, per_bar * scale).alias("sharpe"),
        F.when(usable, se * scale).alias("standard_error"),
        F.when(usable, per_bar / se).alias("t_stat"),
        F.when(usable, F.col("lag")).otherwise(F.lit(0)).alias("lag"),
    )


def probabilistic_sharpe(returns: Column | str, benchmark_per_bar: float = 0.0) -> Column:
    """Aggregate: probability that the true per-bar Sharpe ratio exceeds the benchmark."""
    r = col(returns)
    n, mean, sd = F.count(r).cast("double"), F.avg(r), F.stddev_samp(r)
    skew = F.skewness(r) * div(F.sqrt(n * (n - 1)), n - 2)
    excess = div(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(r) + 6)
    ratio = div(mean, sd)
    spread = 1 - skew * ratio + (excess + 2) / 4 * ratio * ratio
    z = div((ratio - F.lit(benchmark_per_bar)) * F.sqrt(n - 1), F.sqrt(F.when(spread > 0, spread)))
    return F.when((n >= 4) & ~maths.is_flat(mean, sd), norm_cdf(z))


__all__ = [
    "Sample", "annualized_return", "auto_block_size", "auto_nw_lag", "bootstrap_any_ci", "bootstrap_blocks", "bootstrap_ci",
    "bootstrap_indices", "bootstrap_sharpe_ci", "calmar", "hit_rate", "max_drawdown", "mean", "newey_west_sharpe", "probabilistic_sharpe", "profit_factor", "sharpe",
    "sortino", "summarize", "total_return", "turnover_per_year", "with_peak",
]
