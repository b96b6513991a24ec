"""As-of join, key alignment and dense time grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import clock
from tapeloom.functions.maths import tick_order
from tapeloom.plans.scan import carry_scan, running
from tapeloom.plans.stage import stage
from tapeloom.plans.tiles import KEY, bucketed


def asof_join(
    left: DataFrame,
    right: DataFrame,
    cols: Sequence[str],
    *,
    key: Sequence[str] = KEY,
    left_ts: str = "ts",
    right_ts: str = "ts",
    tie: str | None = None,
    bucket: str = "1h",
    group: str | None = None,
) -> DataFrame:
    """Each left row with ``cols`` of the latest right row at or before it (NULL when none).

    Both sides are tagged and united, so this is one shuffle by (key, time bucket) and a scan, not
    a range join. Among right rows at one time the highest ``tie`` wins; a NULL inside the latest
    right row stays NULL, because the columns travel as one struct.
    """
    return asof_join_many(left, [(right, cols)], key=key, left_ts=left_ts, right_ts=right_ts, tie=tie, bucket=bucket, group=group)


def asof_join_many(
    left: DataFrame,
    rights: Sequence[tuple[DataFrame, Sequence[str]]],
    *,
    key: Sequence[str] = KEY,
    left_ts: str = "ts",
    right_ts: str = "ts",
    tie: str | None = None,
    bucket: str = "1h",
    group: str | None = None,
) -> DataFrame:
    """As ``asof_join`` with several right sides, all in one scan that keeps the latest row of each.

    What a bucket passes on comes from the narrow right rows; of the left side only the buckets are read for it.
    """
    rows = left.withColumns({"_us": clock.micros(left_ts), "_side": F.lit(1), "_tie": F.lit(0).cast("long")})
    items = {}
    for i, (right, cols) in enumerate(rights):
        quotes = right.where(F.col(right_ts).isNotNull()).select(
            *key,
            clock.micros(right_ts).alias("_us"),
            F.lit(0).alias("_side"),
            (F.col(tie).cast("long") if tie else F.lit(0).cast("long")).alias("_tie"),
            F.struct(*cols).alias(f"_right{i}"),
        )
        rows = rows.unionByName(quotes, allowMissingColumns=True)
        items[f"_right{i}"] = running("last", f"_right{i}", cols)
    both, coarse = bucketed(rows, F.col("_us"), bucket, group)
    out = carry_scan(both, key, "_bucket", ("_us", "_side", "_tie"), items, coarse=coarse, rank=tick_order(F.col("_us"), F.col("_tie")))
    taken = {c for _, cols in rights for c in cols}
    kept = [F.col(c) for c in left.columns if c not in taken]
    found = [F.col(f"_right{i}")[c].alias(c) for i, (_, cols) in enumerate(rights) for c in cols]
    return out.where("_side = 1").select(*kept, *found)


def lookup_join(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join many rows with a table of one row per series, slice or value.

    The table is written first, so the planner knows its true size: below Spark's broadcast
    threshold the rows are not shuffled at all; above it the join shuffles, and adaptive execution
    splits a key that holds too many rows.
    """
    return rows.join(stage(table, "lookup"), list(on), how)


def match_keys(left: DataFrame, right: DataFrame, on: Sequence[str], what: str) -> DataFrame:
    """Inner join that fails at run time if either side has a key the other lacks."""
    a = left.withColumn("_l", F.lit(True))
    b = right.withColumn("_r", F.lit(True))
    both = a.join(b, list(on), "full")
    ok = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    checked = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(f"{what}: the two sides have different keys")))
    return both.where(checked).drop("_l", "_r")


def dense_grid(bounds: DataFrame, step_us: int, *, key: Sequence[str] = KEY, block: int = 4096) -> DataFrame:
    """Rows (key, _from, _us) for every step from ``lo`` to ``hi``; ``_from`` is the block's first step.

    Blocks of steps are exploded first and spread over the cluster, then each block is filled in,
    so that no task holds the grid of a whole series.
    """
    width = step_us * block
    starts = bounds.select(*key, "hi", F.explode(F.sequence("lo", "hi", F.lit(width))).alias("_from"))
    spread = starts.repartition(*key, "_from")
    ends = F.least(F.col("hi"), F.col("_from") + F.lit(width - step_us))
    return spread.select(*key, "_from", F.explode(F.sequence("_from", ends, F.lit(step_us))).alias("_us"))


def fill_forward(
    sparse: DataFrame,
    step_us: int,
    cols: Sequence[str],
    *,
    key: Sequence[str] = KEY,
    zero: Sequence[str] = (),
    like: str = "timestamp",
    blocks: int = 4096,
) -> DataFrame:
    """Dense series from sparse bins (key, _us, ...): ``cols`` filled forward, ``zero`` set to 0.

    The bins are written first: their bounds, the filled grid and its block totals all read them.
    """
    sparse = stage(sparse, "bins")
    bounds = sparse.groupBy(*key).agg(F.min("_us").alias("lo"), F.max("_us").alias("hi"))
    grid = dense_grid(bounds, step_us, key=key, block=blocks).join(sparse, [*key, "_us"], "left")
    out = carry_scan(grid, key, "_from", ("_us",), {c: running("last", c) for c in cols})
    zeros: list[Column] = [F.coalesce(F.col(c), F.lit(0).cast(sparse.schema[c].dataType)).alias(c) for c in zero]
    return out.select(*key, clock.from_micros(F.col("_us"), like).alias("ts"), *cols, *zeros)
