"""Prefix scans (sum, product, max, last, ...) that never put a whole series into one task.

A series is cut into chunks by a column that is non-decreasing in the series order. Each chunk is
scanned on its own; what flows from one chunk to the next is read off a table of chunk totals,
which is built with a map-side combined aggregate and has one row per (key, chunk).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FIRST = Window.unboundedPreceding


class Item:
    """One scanned value: how to fold rows, and how to join the carry with the local fold.

    A struct value names its ``fields``. Its chunk total then keeps one buffer per field, which
    stays a hash aggregate; a struct buffer would make Spark sort all rows before aggregating.
    """

    def __init__(self, kind: str, value: Column, fields: Sequence[str] = ()):
        if kind not in {"sum", "product", "max", "last"}:
            raise ValueError(f"unknown scan {kind!r}")
        self.kind, self.value, self.fields = kind, value, tuple(fields)

    def over(self, window, value: Column) -> Column:
        if self.kind == "last":
            return F.last(value, ignorenulls=True).over(window)
        return {"sum": F.sum, "product": F.product, "max": F.max}[self.kind](value).over(window)

    def total(self, order: Column) -> Column:
        if self.kind == "last":
            seen = F.when(self.value.isNotNull(), order)
            if not self.fields:
                return F.max_by(self.value, seen)
            latest = F.struct(*[F.max_by(self.value[f], seen).alias(f) for f in self.fields])
            return F.when(F.count(seen) > 0, latest)
        return {"sum": F.sum, "product": F.product, "max": F.max}[self.kind](self.value)

    def join(self, carry: Column, local: Column) -> Column:
        if self.kind == "last":
            return F.coalesce(local, carry)
        if self.kind == "max":
            return F.greatest(carry, local)
        both = carry + local if self.kind == "sum" else carry * local
        return F.coalesce(both, local, carry)


def running(kind: str, value: Column | str, fields: Sequence[str] = ()) -> Item:
    return Item(kind, F.col(value) if isinstance(value, str) else value, fields)


def carry_in(
    totals: DataFrame,
    key: Sequence[str],
    chunk: str,
    items: Mapping[str, Item],
    coarse: str | None = None,
) -> DataFrame:
    """Exclusive scan of the chunk totals: per chunk, the fold of all earlier chunks.

    One key has at most one row per chunk here. With ``coarse`` (a column of ``totals`` that groups
    neighbouring chunks) the totals are scanned in two levels, so not even they meet in one task.
    """
    before = Window.partitionBy(*key).orderBy(chunk).rowsBetween(_FIRST, -1)
    if coarse is None:
        return totals.select(*key, chunk, *[it.over(before, F.col(n)).alias(n) for n, it in items.items()])
    upper = {n: Item(it.kind, F.col(n), it.fields) for n, it in items.items()}
    tops = totals.groupBy(*key, coarse).agg(*[it.total(F.col(chunk)).alias(n) for n, it in upper.items()])
    tops = carry_in(tops, key, coarse, upper)
    inner = Window.partitionBy(*key, coarse).orderBy(chunk).rowsBetween(_FIRST, -1)
    local = totals.select(*key, coarse, chunk, *[it.over(inner, F.col(n)).alias(f"{n}__l") for n, it in items.items()])
    return local.join(tops, [*key, coarse], "left").select(
        *key, chunk, *[it.join(F.col(n), F.col(f"{n}__l")).alias(n) for n, it in items.items()]
    )


def carry_scan(
    df: DataFrame,
    key: Sequence[str],
    chunk: str,
    order: Sequence[str],
    items: Mapping[str, Item],
    *,
    exclusive: bool = False,
    coarse: str | None = None,
    rank: Column | None = None,
) -> DataFrame:
    """Add one running value per item over (key; order).

    ``chunk`` must be non-decreasing in ``order``. ``exclusive`` leaves the current row out.
    ``rank`` is a number that sorts like ``order`` inside a chunk (default: the only order column).
    """
    last_rank = rank if rank is not None else (F.col(order[0]) if len(order) == 1 else F.struct(*order))
    totals = df.groupBy(*key, chunk, *([coarse] if coarse else [])).agg(
        *[it.total(last_rank).alias(n) for n, it in items.items()]
    )
    carry = carry_in(totals, key, chunk, items, coarse)
    renamed = carry.select(*key, chunk, *[F.col(n).alias(f"{n}__c") for n in items])
    w = Window.partitionBy(*key, chunk).orderBy(*order).rowsBetween(_FIRST, -1 if exclusive else 0)
    local = df.select("*", *[it.over(w, it.value).alias(f"{n}__l") for n, it in items.items()])
    return local.join(renamed, [*key, chunk], "left").select(
        *[F.col(c) for c in df.columns if c not in items],
        *[it.join(F.col(f"{n}__c"), F.col(f"{n}__l")).alias(n) for n, it in items.items()],
    )
