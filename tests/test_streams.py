"""Streams fed in several micro-batches against the batch result."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.catalog import streams
from tapeloom.operators import bars as B
from tapeloom.streaming import jobs as K
from tests import frames as f


def feed(spark, df, folder, parts, order):
    """Write ``df`` as successive files in ``order`` and open them as a stream, one file a batch."""
    n = df.count()
    ids = df.orderBy(order).toPandas()
    for i in range(parts):
        part = ids.iloc[i * n // parts : (i + 1) * n // parts]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_time_bars(spark, tmp_path):
    t = f.trades(spark, 400, step_ms=60_000)
    out = K.drain(K.time_bars(feed(spark, t, str(tmp_path / "in"), 4, "agg_id"), "30 minutes", "10 minutes"), "bars")
    last = t.agg(F.max("ts")).first()[0] - pd.Timedelta(minutes=10)
    want = B.time_bars(t, "30min").where(F.col("ts") + F.expr("INTERVAL 30 MINUTES") <= F.lit(last)).orderBy("ts").toPandas()
    got = out.orderBy("ts").toPandas()
    assert len(got) > 5
    pd.testing.assert_frame_equal(got.drop(columns="ts"), want.drop(columns="ts"))


def test_top_of_book_keeps_state_between_batches(spark, tmp_path):
    t = f.trades(spark, 300).select(
        "symbol", F.col("agg_id").alias("seq"), "ts", F.when(F.col("agg_id") % 2 == 0, "bid").otherwise("ask").alias("side"),
        F.when(F.col("agg_id") % 2 == 0, 100.0 - F.col("agg_id") % 7).otherwise(101.0 + F.col("agg_id") % 5).alias("price"),
        F.when(F.col("agg_id") % 3 == 0, F.lit(0.0)).otherwise(F.col("qty")).alias("size"),
    )
    rows = t.orderBy("seq").collect()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", K.ROCKSDB)
    try:
        out = K.drain(K.top_of_book(feed(spark, t, str(tmp_path / "in"), 3, "seq")), "top")
        got = {r["seq"]: r for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    books = {"bid": {}, "ask": {}}
    assert len(got) == 300
    for r in rows:
        book = books[r["side"]]
        book.pop(r["price"], None)
        if r["size"] > 0:
            book[r["price"]] = r["size"]
        bid, ask = max(books["bid"], default=None), min(books["ask"], default=None)
        g = got[r["seq"]]
        assert (g["bid_price"], g["bid_size"], g["ask_price"], g["ask_size"]) == (bid, books["bid"].get(bid), ask, books["ask"].get(ask))


def test_upsert_in_batches(spark, tmp_path):
    bars = f.bars(spark, range(1, 61), seconds=3600)
    again = bars.where("close > 40").withColumn("close", F.col("close") + 1000)
    stream = feed(spark, bars.unionByName(again).withColumn("k", F.monotonically_increasing_id()), str(tmp_path / "in"), 2, "k").drop("k")
    K.bar_upsert(stream, str(tmp_path / "store"), str(tmp_path / "log")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "store"))
    assert out.count() == 60 and out.where("close > 1000").count() == 20


BOOK = "symbol string, seq long, ts timestamp_ntz, side string, price double, size double, is_snapshot boolean, n int"


def test_late_updates_win_or_lose_on_their_own_level(spark, tmp_path):
    at = lambda i: f.START + pd.Timedelta(seconds=i)
    rows = [
        ("X", 1, at(10), "bid", 100.0, 1.0, False), ("X", 2, at(11), "bid", 101.0, 1.0, False),
        ("X", 0, at(5), "bid", 105.0, 9.0, False), ("X", -1, at(4), "bid", 101.0, 7.0, False), ("X", 3, at(12), "bid", 101.0, 0.0, False),
    ]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], BOOK)
    with streams._rocksdb(spark):
        out = K.drain(K.top_of_book(feed(spark, df, str(tmp_path / "in"), 3, "n").drop("n")), "top").orderBy("step").collect()
    assert {(r["seq"], r["bid_price"], r["late"]) for r in out if r["seq"] < 3} == {(1, 100.0, False), (2, 101.0, False) if out[1]["seq"] == 2 else (2, 105.0, False), (0, 105.0, False), (-1, 105.0, True)}
    assert [(r["seq"], r["bid_price"], r["bid_size"], r["late"]) for r in out if r["step"] == 5] == [(3, 105.0, 9.0, False)]


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_book_does_not_depend_on_how_batches_are_cut(spark, tmp_path, parts):
    rng = np.random.default_rng(4)
    rows = []
    for seq in range(240):
        side = ("bid", "ask")[int(rng.integers(2))]
        price = (100.0 - int(rng.integers(9))) if side == "bid" else 101.0 + int(rng.integers(9))
        ts = f.START + pd.Timedelta(seconds=seq // 3)
        if seq % 40 == 17:  # a snapshot of several rows, or of none
            levels = [] if seq % 80 == 17 else [(price, 4.0), (price + 20, 5.0)]
            rows += [("X", seq, ts, side, p, s, True) for p, s in levels or [(None, None)]]
        else:
            rows.append(("X", seq, ts, side, price, float(rng.integers(0, 4)), False))
    want = {"bid": {}, "ask": {}}
    last = None
    for _, seq, _, side, price, size, snapshot in rows:
        if snapshot and seq != last:
            want[side] = {}
        last = seq if snapshot else None
        if price is not None:
            want[side][price] = size
    order = rng.permutation(len(rows)).tolist()
    df = spark.createDataFrame([(*r, n) for n, r in zip(order, rows)], BOOK)
    with streams._rocksdb(spark):
        out = K.standing_levels(K.drain(K.book_changes(feed(spark, df, str(tmp_path / "in"), parts, "n").drop("n")), "changes")).collect()
    assert sorted((r["side"], r["price"], r["size"]) for r in out) == sorted((s, p, x) for s in want for p, x in want[s].items() if x > 0)


class _Value:
    """State of one value, or of one value per key, kept in a dict."""

    def __init__(self):
        self.held = {}

    exists = lambda self: None in self.held
    get = lambda self: self.held[None]
    clear = lambda self: self.held.clear()
    containsKey = lambda self, key: key in self.held
    getValue = lambda self, key: self.held[key]
    updateValue = lambda self, key, row: self.held.__setitem__(key, row)
    removeKey = lambda self, key: self.held.pop(key)
    iterator = lambda self: iter(list(self.held.items()))
    update = lambda self, row: self.held.__setitem__(None, row)


class _Handle:
    getMapState = lambda self, *_: _Value()
    getValueState = lambda self, *_: _Value()


def test_tops_of_a_long_micro_batch_need_little_memory():
    import tracemalloc

    n, parts = 60_000, 12
    rng = np.random.default_rng(1)
    seq = rng.permutation(n)
    rows = pd.DataFrame({
        "seq": seq, "ts": pd.Timestamp(f.START) + pd.to_timedelta(seq, unit="s"), "symbol": "X", "side": np.where(seq % 2, "bid", "ask"),
        "price": np.where(seq % 2, 100.0 - seq % 7, 101.0 + seq % 5), "size": (seq % 3).astype(float), "is_snapshot": False,
    })
    book = K._Book(True)
    book.init(_Handle())
    given = (rows.iloc[i * n // parts : (i + 1) * n // parts].reset_index(drop=True) for i in range(parts))
    tracemalloc.start()
    at, last = 0, None
    for out in book.handleInputRows(("X",), given, None):
        assert len(out) <= 10_000 and (out["seq"] == range(at, at + len(out))).all()
        at, last = at + len(out), out.iloc[-1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == n and last["step"] == n and peak < 200 * n
    books = {"bid": {}, "ask": {}}
    for side, price, size in rows.sort_values("seq")[["side", "price", "size"]].to_numpy():
        books[side][price] = size
    live = {s: [p for p, x in b.items() if x > 0] for s, b in books.items()}
    assert (last["bid_price"], last["ask_price"]) == (max(live["bid"]), min(live["ask"]))
