"""Row numbers for whole series, and equal-sized tiles with a halo of neighbouring rows.

``index_rows`` numbers the rows of every series from 0. Everything that looks a fixed number of
rows back or ahead then works on tiles of ``size`` rows: a tile is one task's window partition, no
matter how many rows its series has, and it carries copies of the rows just before and after it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import clock
from tapeloom.plans.scan import carry_scan, running

TILE_ROWS = 50_000
KEY = ("symbol",)


def index_rows(
    df: DataFrame,
    key: Sequence[str] = KEY,
    order: Sequence[str] = ("ts",),
    *,
    bucket: str = "1d",
    group: str | None = None,
) -> DataFrame:
    """Add ``rn``, the 0-based position of the row in its series.

    Ranks are taken inside time buckets and shifted by the counts of the earlier buckets. Choose
    ``bucket`` so that one series fits a task for that long: bars of a day, trades of a minute. A
    series has as many bucket counts as the calendar has buckets; with very short buckets give a
    ``group`` to add the counts up in two levels.
    """
    df, coarse = bucketed(df, clock.micros(order[0]), bucket, group)
    out = carry_scan(df, key, "_bucket", order, {"rn": running("sum", F.lit(1).cast("long"))}, coarse=coarse)
    return out.withColumn("rn", F.col("rn") - 1).drop("_bucket", "_group")


def bucketed(df: DataFrame, us: Column, bucket: str, group: str | None) -> tuple[DataFrame, str | None]:
    """Add ``_bucket`` (and ``_group``), the time slices that scans run in."""
    df = df.withColumn("_bucket", clock.floor_us(us, clock.duration_us(bucket)))
    if group is None:
        return df, None
    return df.withColumn("_group", clock.floor_us(us, clock.duration_us(group))), "_group"


@dataclass(frozen=True)
class Tiles:
    """A tiled frame: ``df`` with ``_tile`` and ``_core``; windows never leave a tile."""

    df: DataFrame
    key: tuple[str, ...]

    @property
    def window(self):
        return Window.partitionBy(*self.key, "_tile").orderBy("rn")

    def rows(self, first: int, last: int):
        return self.window.rowsBetween(first, last)

    def lag(self, value: Column | str, n: int = 1) -> Column:
        return F.lag(value, n).over(self.window)

    def lead(self, value: Column | str, n: int = 1) -> Column:
        return F.lead(value, n).over(self.window)

    def with_df(self, df: DataFrame) -> Tiles:
        return Tiles(df, self.key)

    def core(self, df: DataFrame | None = None) -> DataFrame:
        """Drop the halo copies; ``_tile`` stays as the chunk of later scans."""
        return (self.df if df is None else df).where("_core").drop("_core")


def tile(
    df: DataFrame,
    key: Sequence[str] = KEY,
    *,
    before: int = 0,
    after: int = 0,
    order: Sequence[str] = ("ts",),
    size: int | None = TILE_ROWS,
    bucket: str = "1d",
) -> Tiles:
    """Cut series into tiles with ``before``/``after`` halo rows.

    ``size=None`` keeps each series whole. It is for keys whose series are bounded by construction,
    such as one walk-forward slice.
    """
    if "rn" not in df.columns:
        if size is None:
            rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long") - 1
            df = df.withColumn("rn", rank)
        else:
            df = index_rows(df, key, order, bucket=bucket)
    if size is None:
        return Tiles(df.withColumns({"_tile": F.lit(0).cast("long"), "_core": F.lit(True)}), tuple(key))
    size = max(size, before, after, 1)
    number = F.expr(f"rn div {size}")
    within = F.pmod(F.col("rn"), F.lit(size))
    copies = [F.struct(number.alias("_tile"), F.lit(True).alias("_core"))]
    if before:
        copies.append(
            F.when(within >= size - before, F.struct((number + 1).alias("_tile"), F.lit(False).alias("_core")))
        )
    if after:
        copies.append(
            F.when((within < after) & (number > 0), F.struct((number - 1).alias("_tile"), F.lit(False).alias("_core")))
        )
    if len(copies) == 1:
        return Tiles(df.withColumns({"_tile": number, "_core": F.lit(True)}), tuple(key))
    spread = df.select("*", F.explode(F.filter(F.array(*copies), lambda c: c.isNotNull())).alias("_copy"))
    return Tiles(spread.select(*df.columns, "_copy.*"), tuple(key))


def full(value: Column, window, n: int, result: Column) -> Column:
    """``result`` only where the frame holds ``n`` values."""
    return F.when(F.count(value).over(window) >= n, result)


def tidy(df: DataFrame) -> DataFrame:
    return df.drop("_tile", "_core")
