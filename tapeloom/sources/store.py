"""Stored tables: partitioned parquet, date ranges, incremental bar merges, manifest, CSV."""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import clock
from tapeloom.functions.maths import tick_order
from tapeloom.plans.joins import lookup_join
from tapeloom.plans.stage import stage
from tapeloom.plans.tiles import KEY


def _dated(df: DataFrame, period: str, ts: str = "ts") -> DataFrame:
    return df.withColumn("date", F.to_date(F.date_trunc(period, ts)))


def _write(dated: DataFrame, root: str, key: str, ts: str, mode: str) -> None:
    """Rows are spread by ranges of (series, time), which splits a busy period over several files."""
    ranged = dated.repartitionByRange(key, ts).sortWithinPartitions(key, "date", ts)
    ranged.write.partitionBy(key, "date").option("partitionOverwriteMode", "dynamic").mode(mode).parquet(root)


def write_by_date(
    df: DataFrame, root: str, *, key: str = "symbol", mode: str = "append", ts: str = "ts", period: str = "day"
) -> None:
    """Parquet under ``root/symbol=…/date=…``, in time order inside files.

    ``period`` (day, month, year) sets how much time a folder holds; ``date`` is its first day.
    """
    _write(_dated(df, period, ts), root, key, ts, mode)


def _as_date(x: dt.date | str) -> dt.date:
    if isinstance(x, dt.datetime):
        return x.date()
    return x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x)[:10])


def load_range(spark: SparkSession, root: str, symbol: str | None, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """Rows of the days ``start`` to ``end``, both included; only those partitions are read."""
    first, last = _as_date(start), _as_date(end)
    if last < first:
        raise ValueError(f"the range ends on {last}, before it starts on {first}")
    df = spark.read.parquet(root).where(F.col("date").between(F.lit(first), F.lit(last)))
    return (df if symbol is None else df.where(F.col("symbol") == symbol)).drop("date")


def load_symbol(spark: SparkSession, root: str, symbol: str) -> DataFrame:
    """All stored days of one symbol; no rows if there are none."""
    return spark.read.parquet(root).where(F.col("symbol") == symbol).drop("date")


def stitch_pages(pages: DataFrame, *, key: Sequence[str] = KEY) -> DataFrame:
    """Overlapping pages (page, pos, ts_ms, open, …) to bars; the first copy of a time wins."""
    values = ("open", "high", "low", "close", "volume")
    at = tick_order(F.col("page"), F.col("pos"))
    out = pages.groupBy(*key, "ts_ms").agg(*[F.min_by(F.col(v).cast("double"), at).alias(v) for v in values])
    return out.select(*key, F.timestamp_millis("ts_ms").alias("ts"), *values)


def merge_bars(stored: DataFrame, fresh: DataFrame, *, key: Sequence[str] = KEY) -> DataFrame:
    """Stored and fresh bars; at one time a fresh one wins, and of several fresh ones that with the largest values, column by column
    from the left (one whole row: columns of different rows are never mixed). Copies collapse before the shuffle."""
    values = [c for c in stored.columns if c not in (*key, "ts")]
    both = stored.withColumn("_batch", F.lit(0)).unionByName(fresh.withColumn("_batch", F.lit(1)))
    whole = F.max(F.struct("_batch", *values)).alias("_row")
    return both.groupBy(*key, "ts").agg(whole).select(*key, "ts", *[F.col("_row")[v].alias(v) for v in values])


def keep_recent(bars: DataFrame, end: dt.datetime, days: int, timeframe: str) -> DataFrame:
    """Bars from ``end - days``, rounded down to a bar, on."""
    if end.tzinfo is None:
        end = end.replace(tzinfo=dt.timezone.utc)
    start_us = int(end.timestamp()) * 1_000_000 + end.microsecond - days * clock.DAY
    return bars.where(clock.micros("ts") >= start_us - start_us % clock.duration_us(timeframe))


def upsert_bars(spark: SparkSession, root: str, fresh: DataFrame, *, key: str = "symbol", period: str = "day", batch: str | None = None) -> None:
    """Merge fresh bars into ``root``; only the folders they touch are read and rewritten. One rule holds for the first
    write and for all others: one row per series and time.

    A ``batch`` is a name under which the store keeps what it has applied, in a ledger beside the data: a
    batch that is sent again changes nothing. The merged folders are staged whole before any is replaced, and a batch that
    was staged but not finished is finished first, so a job killed in between leaves no half of a batch.
    """
    ledger = Ledger(spark, root)
    ledger.recover(key)
    if batch is not None and ledger.has(batch):
        return
    fresh = stage(_dated(fresh, period), "fresh")
    try:
        stored = spark.read.parquet(root).select(*fresh.columns)
    except AnalysisException as error:  # first write
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        stored = fresh.limit(0)
    touched = fresh.select(key, "date").distinct()
    old = stored.join(touched, [key, "date"], "left_semi")
    ledger.apply(merge_bars(old, fresh, key=[key]), key, batch)


class Ledger:
    """What a bar store has applied, in ``_applied`` beside its folders (names that begin with _ are not read as data).

    A batch passes three states, each reached by one atomic rename or file: its merged rows are staged whole, the
    staged folder is named ready, and after the store's folders are overwritten with it, its name is entered
    as done. Overwriting from a ready folder may be repeated any number of times with the same outcome.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        path = spark._jvm.org.apache.hadoop.fs.Path
        self.path = lambda *parts: path("/".join((root.rstrip("/"), "_applied", *parts)))
        self.files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _entry(self, batch: str) -> str:
        return hashlib.sha256(batch.encode()).hexdigest()

    def has(self, batch: str) -> bool:
        return self.files.exists(self.path("done", self._entry(batch)))

    def apply(self, merged: DataFrame, key: str, batch: str | None) -> None:
        entry = self._entry(batch) if batch is not None else uuid.uuid4().hex
        staged = self.path(f"staged-{uuid.uuid4().hex}")
        merged.write.parquet(staged.toString())
        ready = self.path("ready", entry)
        self.files.mkdirs(self.path("ready"))
        if not self.files.rename(staged, ready):
            raise RuntimeError(f"{staged} could not be renamed: is another job writing to {self.root}?")
        self._finish(ready, key)

    def recover(self, key: str) -> None:
        """Finish batches that were ready when a job ended."""
        if self.files.exists(self.path("ready")):
            for found in self.files.listStatus(self.path("ready")):
                self._finish(found.getPath(), key)

    def _finish(self, ready, key: str) -> None:
        _write(self.spark.read.parquet(ready.toString()), self.root, key, "ts", "overwrite")
        self.files.mkdirs(self.path("done"))
        self.files.create(self.path("done", ready.getName()), True).close()
        self.files.delete(ready, True)


def manifest(bars: DataFrame, timeframe: str, *, key: Sequence[str] = KEY) -> DataFrame:
    out = bars.groupBy(*key).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("rows"))
    return out.withColumn("timeframe", F.lit(timeframe))


def trailing(df: DataFrame, days: int, *, key: Sequence[str] = KEY) -> DataFrame:
    """The last ``days`` of every series, counted from its own last row."""
    last = df.groupBy(*key).agg(F.max(clock.micros("ts")).alias("_last"))
    return lookup_join(df, last, key).where(clock.micros("ts") >= F.col("_last") - days * clock.DAY).drop("_last")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


__all__ = [
    "keep_recent", "load_range", "load_symbol", "manifest", "merge_bars", "stitch_pages", "trailing", "upsert_bars",
    "write_by_date", "write_csv",
]
