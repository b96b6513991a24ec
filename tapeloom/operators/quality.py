"""Data-quality checks on bars. One pass over the bars evaluates all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import clock, maths
from tapeloom.plans.joins import lookup_join
from tapeloom.plans.scan import carry_scan, running
from tapeloom.plans.stage import stage
from tapeloom.plans.tiles import KEY, TILE_ROWS, tile

# Check names, outlier window and threshold, stale run length, severity limit.
CHECKS = (
    "ohlc_invariants", "gaps", "duplicates", "zero_volume", "volume_outliers", "return_outliers", "stale_quotes",
)
OUTLIER_WINDOW = 288
Z_THRESHOLD = 4.0
STALE_RUN = 3
GAP_TOLERANCE = 1.5
MINOR_LIMIT = 100


# Bars that share a time are put in order by their values, so that row numbers, gaps and returns do not depend on the layout.
ORDER = ("ts", "open", "high", "low", "close", "volume")


def _out_of_range(c: str) -> Column:
    return (F.col(c) < F.col("low")) | (F.col(c) > F.col("high"))


def invariant_reason() -> Column:
    """Comma-joined broken price relations; empty when the bar is sound."""
    return F.concat_ws(
        ",",
        F.when(F.col("low") > F.col("high"), "low>high"),
        F.when(_out_of_range("open"), "open_oob"),
        F.when(_out_of_range("close"), "close_oob"),
    )


def ohlc_invariants(bars: DataFrame) -> DataFrame:
    return bars.withColumn("reason", invariant_reason()).where("reason <> ''")


def gaps(bars: DataFrame, timeframe: str, *, tolerance: float = GAP_TOLERANCE, key: Sequence[str] = KEY, size: int = TILE_ROWS) -> DataFrame:
    """Bars that come more than ``tolerance`` bar lengths after their predecessor."""
    t = tile(bars, key, before=1, order=ORDER, size=size)
    out = _with_gap(t.core(t.df.withColumn("previous", t.lag("ts"))), timeframe, tolerance)
    return out.where("_gap").select(*key, "ts", "previous", "gap_seconds")


def _with_gap(df: DataFrame, timeframe: str, tolerance: float) -> DataFrame:
    delta = clock.micros("ts") - clock.micros("previous")
    limit = tolerance * clock.timeframe_seconds(timeframe) * 1e6
    return df.withColumns(
        {"_gap": F.coalesce(delta > F.lit(limit), F.lit(False)), "gap_seconds": F.floor(delta / 1_000_000).cast("long")}
    )


def duplicates(bars: DataFrame, *, key: Sequence[str] = KEY) -> DataFrame:
    """All copies of bars that share a timestamp. Copies are counted map-side, then looked up."""
    twice = bars.groupBy(*key, "ts").agg(F.count("*").alias("copies")).where("copies > 1")
    return lookup_join(bars, twice, [*key, "ts"])


def zero_volume(bars: DataFrame) -> DataFrame:
    return bars.where("volume = 0")


def _window_moments(t, value: str, window: int) -> tuple[Column, Column]:
    w = t.rows(-window, -1)
    enough = F.count(value).over(w) >= window // 2
    return F.when(enough, F.avg(value).over(w)), F.when(enough, F.stddev_samp(value).over(w))


def _outliers(df: DataFrame, value: str, threshold: float, name: str) -> DataFrame:
    x, mu, sd = F.col(value), F.col("_mu"), F.col("_sd")
    out = df.where(maths.z_beyond(x, mu, sd, threshold))
    return out.withColumns({"z_score": maths.z_score(x, mu, sd), "reason": F.lit(name)}).drop("_mu", "_sd", "_tile")


def volume_outliers(
    bars: DataFrame, *, window: int = OUTLIER_WINDOW, z_threshold: float = Z_THRESHOLD, key: Sequence[str] = KEY, size: int = TILE_ROWS
) -> DataFrame:
    """Volume far from its mean over the ``window`` bars before."""
    t = tile(bars, key, before=window, order=ORDER, size=size)
    mu, sd = _window_moments(t, "volume", window)
    return _outliers(t.core(t.df.withColumns({"_mu": mu, "_sd": sd})), "volume", z_threshold, "volume_outlier")


def return_outliers(
    bars: DataFrame, *, window: int = OUTLIER_WINDOW, z_threshold: float = Z_THRESHOLD, key: Sequence[str] = KEY, size: int = TILE_ROWS
) -> DataFrame:
    """Close-to-close returns far from their mean over the ``window`` returns before."""
    t = tile(bars, key, before=window + 1, order=ORDER, size=size)
    t = t.with_df(t.df.withColumn("return", maths.div("close", t.lag("close")) - 1))
    mu, sd = _window_moments(t, "return", window)
    return _outliers(t.core(t.df.withColumns({"_mu": mu, "_sd": sd})), "return", z_threshold, "return_outlier")


def _is_stale() -> Column:
    return (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close"))


def stale_quotes(bars: DataFrame, *, min_run: int = STALE_RUN, key: Sequence[str] = KEY, size: int = TILE_ROWS) -> DataFrame:
    """Bars in runs of at least ``min_run`` bars with open = high = low = close.

    Within a run the row number minus the count of stale bars so far is constant, which names the
    run; run lengths are counted map-side and joined back.
    """
    key = list(key)
    flat = tile(bars, key, order=ORDER, size=size).core().where(_is_stale())
    flat = carry_scan(flat, key, "_tile", ("rn",), {"_k": running("sum", F.lit(1).cast("long"))})
    flat = flat.withColumn("_run", F.col("rn") - F.col("_k")).drop("_k", "_tile")
    runs = flat.groupBy(*key, "_run").agg(F.count("*").alias("run_length")).where(F.col("run_length") >= min_run)
    return lookup_join(flat, runs, [*key, "_run"]).drop("_run").withColumn("reason", F.lit("stale_quote"))


def findings(
    bars: DataFrame,
    timeframe: str,
    *,
    outlier_window: int = OUTLIER_WINDOW,
    z_threshold: float = Z_THRESHOLD,
    stale_run: int = STALE_RUN,
    key: Sequence[str] = KEY,
    size: int = TILE_ROWS,
) -> DataFrame:
    """Union of all findings with a ``check`` column.

    The row-local and look-back checks are evaluated together on one tiled pass and exploded per
    broken check; duplicates and stale runs need a lookup of group counts and are joined on.
    """
    key = list(key)
    t = tile(bars, key, before=outlier_window + 1, order=ORDER, size=size)
    t = t.with_df(t.df.withColumns({"previous": t.lag("ts"), "return": maths.div("close", t.lag("close")) - 1}))
    vm, vs = _window_moments(t, "volume", outlier_window)
    rm, rs = _window_moments(t, "return", outlier_window)
    df = _with_gap(t.core(t.df.withColumns({"_vm": vm, "_vs": vs, "_rm": rm, "_rs": rs})), timeframe, GAP_TOLERANCE)
    none = F.lit(None)
    flag = lambda ok, check, reason=None, z=None, ret=None, gap=None, prev=None: F.when(
        ok,
        F.struct(
            F.lit(check).alias("check"),
            (none if reason is None else reason).cast("string").alias("reason"),
            (none if z is None else z).cast("double").alias("z_score"),
            (none if ret is None else ret).cast("double").alias("return"),
            (none if gap is None else gap).cast("long").alias("gap_seconds"),
            (none if prev is None else prev).cast(clock.ts_type(bars)).alias("previous"),
        ),
    )
    vol, ret = F.col("volume"), F.col("return")
    broken = F.array(
        flag(invariant_reason() != "", "ohlc_invariants", invariant_reason()),
        flag(F.col("_gap"), "gaps", gap=F.col("gap_seconds"), prev=F.col("previous")),
        flag(vol == 0, "zero_volume"),
        flag(maths.z_beyond(vol, F.col("_vm"), F.col("_vs"), z_threshold), "volume_outliers", F.lit("volume_outlier"),
             maths.z_score(vol, F.col("_vm"), F.col("_vs"))),
        flag(maths.z_beyond(ret, F.col("_rm"), F.col("_rs"), z_threshold), "return_outliers", F.lit("return_outlier"),
             maths.z_score(ret, F.col("_rm"), F.col("_rs")), ret),
    )
    ohlcv = ["open", "high", "low", "close", "volume"]
    one = df.select(*key, "ts", *ohlcv, F.explode(F.filter(broken, lambda b: b.isNotNull())).alias("_f"))
    one = one.select(*key, "ts", *ohlcv, "_f.*")
    two = duplicates(bars, key=key).select(*key, "ts", *ohlcv, F.lit("duplicates").alias("check"))
    three = stale_quotes(bars, min_run=stale_run, key=key, size=size).select(
        *key, "ts", *ohlcv, "reason", "run_length", F.lit("stale_quotes").alias("check")
    )
    return one.unionByName(two, allowMissingColumns=True).unionByName(three, allowMissingColumns=True)


def summary(found: DataFrame, bars: DataFrame, *, key: Sequence[str] = KEY) -> DataFrame:
    """rows_flagged per series and check; all checks are present."""
    names = F.array(*[F.lit(c) for c in CHECKS])
    every = bars.select(*key).distinct().select(*key, F.explode(names).alias("check"))
    counts = found.groupBy(*key, "check").agg(F.count("*").alias("rows_flagged"))
    return every.join(counts, [*key, "check"], "left").withColumn("rows_flagged", F.coalesce("rows_flagged", F.lit(0)))


def severity(counts: DataFrame, *, key: Sequence[str] = KEY) -> DataFrame:
    """clean, minor or major per series, from the summary."""
    grave = F.sum(F.when(F.col("check").isin("ohlc_invariants", "duplicates"), F.col("rows_flagged")).otherwise(0))
    total = F.sum("rows_flagged")
    grade = F.when(total == 0, "clean").when((grave > 0) | (total > MINOR_LIMIT), "major").otherwise("minor")
    return counts.groupBy(*key).agg(total.alias("findings"), grade.alias("severity"))


def report(bars: DataFrame, found: DataFrame, *, key: Sequence[str] = KEY) -> DataFrame:
    """One row per series: total rows, findings, severity and a column per check."""
    counts = stage(summary(found, bars, key=key), "counts")
    wide = counts.groupBy(*key).agg(
        *[F.sum(F.when(F.col("check") == c, F.col("rows_flagged")).otherwise(0)).alias(c) for c in CHECKS]
    )
    total = bars.groupBy(*key).agg(F.count("*").alias("total_rows"))
    return total.join(severity(counts, key=key), list(key)).join(wide, list(key))


__all__ = [
    "CHECKS", "duplicates", "findings", "gaps", "invariant_reason", "ohlc_invariants", "report", "return_outliers",
    "severity", "stale_quotes", "summary", "volume_outliers", "zero_volume",
]
