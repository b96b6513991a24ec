"""Exact order statistics of non-negative values without ranking whole series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.plans.tiles import KEY

_PER_OCTAVE = 512


def _cell(value: Column) -> Column:
    """A non-decreasing cell number: 512 cells per doubling, one cell for zero."""
    octave = F.floor(F.log2(F.when(value > 0, value)) * F.lit(float(_PER_OCTAVE)))
    return F.coalesce(octave, F.lit(-(2**40)))


def values_at_ranks(df: DataFrame, value: str, ranks: Column, *, key: Sequence[str] = KEY) -> DataFrame:
    """(key, n, rank, value) for the 0-based ``ranks`` (an array column over ``n``).

    First pass: a histogram over logarithmic cells finds the cell of every rank. Second pass: only
    rows of those cells are counted by distinct value. Ties collapse before the shuffle.
    """
    rows = df.where(F.col(value).isNotNull()).select(*key, F.col(value).alias("value"))
    rows = rows.withColumn("_cell", _cell(F.col("value")))
    cells = rows.groupBy(*key, "_cell").agg(F.count("*").alias("_n"))
    up_to = Window.partitionBy(*key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumns(
        {
            "_before": F.coalesce(F.sum("_n").over(up_to), F.lit(0)),
            "n": F.sum("_n").over(Window.partitionBy(*key)),
        }
    )
    wanted = placed.select("*", F.explode(ranks).alias("rank")).where(
        (F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_n"))
    )
    hot = wanted.select(*key, "_cell").distinct()
    ties = rows.join(hot, [*key, "_cell"], "left_semi").groupBy(*key, "_cell", "value").agg(F.count("*").alias("_m"))
    inside = Window.partitionBy(*key, "_cell").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("_lo", F.coalesce(F.sum("_m").over(inside), F.lit(0)))
    found = wanted.join(ties, [*key, "_cell"]).where(
        (F.col("rank") - F.col("_before") >= F.col("_lo"))
        & (F.col("rank") - F.col("_before") < F.col("_lo") + F.col("_m"))
    )
    return found.select(*key, "n", "rank", "value")


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    *,
    key: Sequence[str] = KEY,
    at: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles of a non-negative column: one row (key, n, *names) per key.

    ``at`` names further columns for the values at given 0-based ranks (columns over ``n``).
    """
    extra = dict(at or {})
    places = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    ranks = F.array_distinct(
        F.concat(*[F.array(F.floor(h).cast("long"), F.ceil(h).cast("long")) for h in [*places, *extra.values()]])
    )
    table = values_at_ranks(df, value, ranks, key=key).groupBy(*key, "n").agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at")  # at most 2 per quantile
    )

    def interpolate(h: Column) -> Column:
        low = F.col("_at")[F.floor(h).cast("long")]
        high = F.col("_at")[F.ceil(h).cast("long")]
        return low + (high - low) * (h - F.floor(h))

    columns = {**dict(zip(names, places)), **extra}
    return table.select(*key, "n", *[interpolate(h).alias(c) for c, h in columns.items()])
