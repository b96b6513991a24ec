"""Streaming queries over trades and book updates."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tapeloom.operators.bars import tick
from tapeloom.plans.stage import shared_folder
from tapeloom.plans.tiles import KEY
from tapeloom.sources.store import upsert_bars

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def time_bars(trades: DataFrame, interval: str, delay: str, *, key: Sequence[str] = KEY) -> DataFrame:
    """Bars of a trade stream, sent once the watermark has passed them; later trades are dropped.

    ``interval`` and ``delay`` are Spark interval texts such as ``"1 hour"``.
    """
    at = tick()
    return (
        trades.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .groupBy(*key, F.window("ts", interval).alias("_w"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("qty").alias("volume"),
            F.count("price").alias("trades"),
        )
        .select(*key, F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume", "trades")
    )


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of all batches by time and seq, a few at a time. Held are their numbers alone, about 35 bytes a row, twice while joined."""
    kept = [b.assign(side=pd.Categorical(b["side"], categories=SIDES))[list(UPDATES)].copy() for b in batches]
    rows = pd.concat(kept, ignore_index=True)
    del kept
    order = np.lexsort((rows["seq"].to_numpy(), rows["ts"].to_numpy()))
    for i in range(0, len(order), CHUNK):
        yield rows.iloc[order[i : i + CHUNK]]


class _Book(StatefulProcessor):
    """The book of one instrument as state: every level keeps its size and its own version (time, seq), every side the
    version of its last snapshot.

    An update wins if it is newer than its level and not older than its side's snapshot; a loser changes nothing and is sent out
    as late. A snapshot removes the levels that are older than itself. So the book that all updates leave does not
    depend on their order or on how micro-batches are cut. Deleted levels keep their version until a snapshot: a
    side's state is bounded by the prices seen since then. The best price is state too, and a side is read
    through only when its best level goes.
    """

    def __init__(self, tops: bool):
        self.tops_out = tops

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = {s: handle.getMapState(s, "price double", "size double, at long, seq long") for s in SIDES}
        self.tops = {s: handle.getValueState(f"{s}_top", "price double, size double") for s in SIDES}
        self.epochs = {s: handle.getValueState(f"{s}_epoch", "at long, seq long") for s in SIDES}
        self.steps = handle.getValueState("steps", "n long")

    def _all(self, side: str, changed: dict[float, tuple]) -> Iterator[tuple]:
        """(price, size, at, seq) of stored levels under what this micro-batch has changed."""
        for (price,), row in self.levels[side].iterator():
            if price not in changed:
                yield (price, *row)
        yield from ((price, *row) for price, row in changed.items() if row is not None)

    def _best(self, side: str, changed: dict[float, tuple]) -> tuple[float, float] | None:
        live = ((price, size) for price, size, _, _ in self._all(side, changed) if size > 0)
        return (max if side == "bid" else min)(live, key=lambda level: level[0], default=None)

    def _write(self, changed: dict[str, dict[float, tuple]]) -> None:
        for side, levels in changed.items():
            for price, row in levels.items():
                if row is not None:
                    self.levels[side].updateValue((price,), row)
                elif self.levels[side].containsKey((price,)):
                    self.levels[side].removeKey((price,))
            levels.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Rows in order are only needed for the best price after each of them; the numbers of one instrument's
        # micro-batch are then held in memory, and what it changes is written once. Results leave a few rows at a time.
        if self.tops_out:
            rows = _in_order(rows)
        n = self.steps.get()[0] if self.steps.exists() else 0
        top = {s: tuple(v.get()) if v.exists() else None for s, v in self.tops.items()}
        epoch = {s: tuple(v.get()) if v.exists() else None for s, v in self.epochs.items()}
        changed: dict[str, dict[float, tuple]] = {s: {} for s in SIDES}
        for batch in rows:
            out = []
            micros = batch["ts"].astype("datetime64[us]").astype("int64")
            for seq, ts, at, side, price, size, snapshot in zip(batch["seq"], batch["ts"], micros, batch["side"], batch["price"], batch["size"], batch["is_snapshot"]):
                n += 1
                mine, version, empty = changed[side], (at, seq), pd.isna(price)
                if (empty and not snapshot) or (not empty and not (price > 0 and size >= 0)):
                    raise ValueError(f"bad level update {seq}: price {price}, size {size}")
                late = epoch[side] is not None and version < epoch[side]
                if snapshot and not late and version != epoch[side]:
                    epoch[side] = version
                    for old, was, *then in list(self._all(side, mine)):
                        if tuple(then) < version:
                            mine[old] = None
                            if was > 0 and old != price and not self.tops_out:  # this row tells of its own level below
                                out.append((key[0], seq, ts, side, old, 0.0, False, n))
                    top[side] = self._best(side, mine)
                if not late and not empty:
                    known = mine[price] if price in mine else self.levels[side].getValue((price,)) if self.levels[side].containsKey((price,)) else None
                    late = known is not None and version < tuple(known[1:])
                    if not late:
                        mine[price] = (float(size), int(at), int(seq))
                        best = top[side]
                        if size > 0 and (best is None or price == best[0] or (price > best[0]) == (side == "bid")):
                            top[side] = (price, size)
                        elif size == 0 and best is not None and price == best[0]:
                            top[side] = self._best(side, mine)
                if self.tops_out:
                    out.append((key[0], seq, ts, *(top["bid"] or (None, None)), *(top["ask"] or (None, None)), late, n))
                elif late or not empty:
                    out.append((key[0], seq, ts, side, price, size, late, n))
            if not self.tops_out:
                self._write(changed)
            names = TOPS if self.tops_out else CHANGES
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({c: "float64" for c in names if c.endswith(("price", "size"))} | {"late": "bool", "step": "int64"})
        self._write(changed)
        for side in SIDES:
            self.tops[side].clear() if top[side] is None else self.tops[side].update(tuple(float(x) for x in top[side]))
            if epoch[side] is not None:
                self.epochs[side].update(tuple(int(x) for x in epoch[side]))
        self.steps.update((n,))

    def close(self) -> None:
        pass


SIDES = ("bid", "ask")
UPDATES = ("seq", "ts", "side", "price", "size", "is_snapshot")
CHUNK = 10_000
TOPS = ["symbol", "seq", "ts", "bid_price", "bid_size", "ask_price", "ask_size", "late", "step"]
CHANGES = ["symbol", "seq", "ts", "side", "price", "size", "late", "step"]


def _book_stream(updates: DataFrame, tops: bool) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in updates.schema.fields}
    kinds |= {c: "double" for c in ("price", "size", *TOPS[3:7])} | {"late": "boolean", "step": "long", "side": "string"}
    if "is_snapshot" not in updates.columns:
        updates = updates.withColumn("is_snapshot", F.lit(False))
    rows = updates.withColumn("is_snapshot", F.coalesce("is_snapshot", F.lit(False)))
    schema = ", ".join(f"{c} {kinds[c]}" for c in (TOPS if tops else CHANGES))
    return rows.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=_Book(tops), outputStructType=schema, outputMode="Append", timeMode="None"
    )


def top_of_book(updates: DataFrame) -> DataFrame:
    """Best bid and ask after every level update of a stream, with the book kept as state.

    ``updates`` has symbol, seq, ts, side, price, size, and may have ``is_snapshot``: the rows of one snapshot share
    time and seq, and one without price says that its side is empty. ``late`` marks updates that lost to a newer
    one of their level or to a snapshot; ``step`` counts an instrument's rows. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    return _book_stream(updates, True)


def book_changes(updates: DataFrame) -> DataFrame:
    """Every change of a level, with size 0 where a snapshot or an update removes it, and the late updates, marked."""
    return _book_stream(updates, False)


def standing_levels(changes: DataFrame) -> DataFrame:
    """The book that the changes written so far leave: symbol, side, price, size."""
    last = changes.where("not late").groupBy("symbol", "side", "price").agg(F.max_by("size", "step").alias("size"))
    return last.where("size > 0")


def bar_upsert(bars: DataFrame, root: str, checkpoint: str, *, key: str = "symbol", period: str = "day"):
    """Merge every micro-batch of bars into the bar store, each once, also if Spark sends it again after a failure; returns the started query."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            upsert_bars(batch.sparkSession, root, batch, key=key, period=period, batch=f"{checkpoint}#{batch_id}")

    return (
        bars.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available now and read back all it wrote."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/tapeloom-{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
