"""Rows where a state changes, and each one's successor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.plans.tiles import TILE_ROWS


def next_row(df: DataFrame, key: Sequence[str], cols: Sequence[str], *, order: str = "rn", size: int | None = TILE_ROWS) -> DataFrame:
    """Add ``next_<col>``: the values in the following row of the series (NULL at its end).

    The rows may be any subset of an indexed series. Inside a chunk this is ``lead``; the last row
    of a chunk takes the first row of the next chunk that has one, from a table of chunk heads.
    """
    named = [F.col(c).alias(c) for c in cols]
    if size is None:
        w = Window.partitionBy(*key).orderBy(order)
        ahead = F.lead(F.struct(*named)).over(w)
        return df.withColumn("_next", ahead).select(*df.columns, *[F.col("_next")[c].alias(f"next_{c}") for c in cols])
    df = df.withColumn("_chunk", F.expr(f"{order} div {size}"))
    heads = df.groupBy(*key, "_chunk").agg(*[F.min_by(c, order).alias(f"_h_{c}") for c in cols])
    heads = heads.select(*key, "_chunk", F.struct(*[F.col(f"_h_{c}").alias(c) for c in cols]).alias("_head"))
    following = Window.partitionBy(*key).orderBy("_chunk")
    heads = heads.select(*key, "_chunk", F.lead("_head").over(following).alias("_head"))
    w = Window.partitionBy(*key, "_chunk").orderBy(order)
    local = df.withColumn("_next", F.lead(F.struct(*named)).over(w))
    out = local.join(heads, [*key, "_chunk"], "left").withColumn("_next", F.coalesce("_next", "_head"))
    kept = [c for c in df.columns if c != "_chunk"]
    return out.select(*kept, *[F.col("_next")[c].alias(f"next_{c}") for c in cols])
