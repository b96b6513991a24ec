"""Tiled and chunked forms equal the plain window over the whole series, for any tile size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.operators import backtest as K
from tapeloom.operators import bars as B
from tapeloom.operators import quality as Q
from tapeloom.operators import signals as S
from tapeloom.operators import stats as G
from tapeloom.plans.joins import asof_join, dense_grid, match_keys
from tapeloom.plans.quantiles import exact_quantiles
from tapeloom.plans.runs import next_row
from tapeloom.plans.scan import carry_scan, running
from tapeloom.plans.tiles import index_rows, tile
from tests import frames as f


@pytest.fixture(scope="module")
def two(spark):
    """Two series, one much longer than the other."""
    a = f.bars(spark, f.walk(400, 1), symbol="long")
    return a.unionByName(f.bars(spark, f.walk(37, 2), symbol="short")).cache()


@pytest.mark.parametrize("bucket,group", [("1h", None), ("5m", "1h"), ("1d", None)])
def test_index_rows(two, bucket, group):
    got = index_rows(two, bucket=bucket, group=group)
    plain = F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1
    assert got.withColumn("want", plain).where("rn <> want").count() == 0
    assert got.count() == two.count()


@pytest.mark.parametrize("size", [8, 50, 10_000])
def test_row_frames_in_tiles(two, size):
    t = tile(two, before=7, after=2, size=size)
    cols = {"m": F.avg("close").over(t.rows(-7, 0)), "n": F.lead("close", 2).over(t.window)}
    got = t.core(t.df.withColumns(cols))
    w = Window.partitionBy("symbol").orderBy("ts")
    want = {"m2": F.avg("close").over(w.rowsBetween(-7, 0)), "n2": F.lead("close", 2).over(w)}
    out = got.withColumns(want)
    assert out.count() == two.count()
    assert out.where("abs(m - m2) > 1e-9 or not (n <=> n2)").count() == 0


@pytest.mark.parametrize("size", [5, 64])
def test_scans_in_chunks(two, size):
    df = index_rows(two).withColumn("_c", F.expr(f"rn div {size}"))
    odd = F.when(F.col("rn") % 7 == 0, F.col("close"))
    items = {"s": running("sum", "close"), "m": running("max", "close"), "l": running("last", odd)}
    w = Window.partitionBy("symbol").orderBy("rn")
    for exclusive, end in ((False, 0), (True, -1)):
        r = w.rowsBetween(Window.unboundedPreceding, end)
        out = carry_scan(df, ["symbol"], "_c", ["rn"], items, exclusive=exclusive).withColumns(
            {"s2": F.sum("close").over(r), "m2": F.max("close").over(r), "l2": F.last(odd, ignorenulls=True).over(r)}
        )
        assert out.where("not (m <=> m2) or not (l <=> l2) or abs(coalesce(s, 0) - coalesce(s2, 0)) > 1e-6").count() == 0


def test_next_row_over_sparse_chunks(two):
    sparse = index_rows(two).where("rn % 29 = 0 or rn in (1, 2)")
    got = next_row(sparse, ["symbol"], ["rn"], size=10)
    w = Window.partitionBy("symbol").orderBy("rn")
    assert got.withColumn("want", F.lead("rn").over(w)).where("not (next_rn <=> want)").count() == 0


@pytest.mark.parametrize("bucket", ["1m", "1h", "30d"])
def test_asof_join(spark, bucket):
    rng = np.random.default_rng(3)
    left = pd.DataFrame({"symbol": "X", "ts": sorted(f.START + pd.to_timedelta(rng.integers(0, 20_000, 300), unit="s"))})
    right = pd.DataFrame({"symbol": "X", "ts": sorted(f.START + pd.to_timedelta(rng.choice(20_000, 60, replace=False), unit="s"))})
    right["v"] = rng.normal(size=60)
    right.loc[right.index % 9 == 0, "v"] = None
    got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["v"], bucket=bucket)
    want = pd.merge_asof(left, right.drop(columns="symbol"), on="ts")
    assert got.count() == len(left)
    a = got.toPandas().sort_values(["ts", "v"], ignore_index=True)
    b = want.sort_values(["ts", "v"], ignore_index=True)
    np.testing.assert_allclose(a["v"].to_numpy(dtype=float), b["v"].to_numpy(dtype=float))


def test_dense_grid(spark):
    bounds = spark.createDataFrame([("a", 0, 990), ("b", 10, 10)], "symbol string, lo long, hi long")
    got = dense_grid(bounds, 10, block=7).groupBy("symbol").agg(F.count("*").alias("n"), F.countDistinct("_us").alias("d")).orderBy("symbol")
    assert [tuple(r) for r in got.collect()] == [("a", 100, 100), ("b", 1, 1)]


def test_match_keys_fails_on_a_missing_key(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(Exception, match="different keys"):
        match_keys(a, a.where("k = 1"), ["k"], "test").collect()


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    x = np.round(np.concatenate([rng.pareto(1.5, 3000), np.zeros(50), np.full(1500, 2.5)]), 3)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "X", "v": x}))
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = exact_quantiles(df, "v", probs, [f"q{i}" for i in range(len(probs))]).first()
    np.testing.assert_allclose([got[f"q{i}"] for i in range(len(probs))], np.quantile(x, probs), rtol=1e-12)


def test_backtest_does_not_depend_on_tiles(two):
    results = []
    for size in (None, 30, 5000):
        bt = K.run_backtest(S.bollinger_mean_reversion(two, 10, 0.5, size=size), size=size)
        log = K.trade_log(bt, size=size)
        results.append((bt.select("symbol", "ts", "equity", "drawdown").orderBy("symbol", "ts").toPandas(),
                        log.orderBy("symbol", "entry_at").toPandas()))
    for bt, log in results[1:]:
        np.testing.assert_allclose(bt["equity"], results[0][0]["equity"], rtol=1e-12)
        np.testing.assert_allclose(bt["drawdown"], results[0][0]["drawdown"], atol=1e-12)
        pd.testing.assert_frame_equal(log, results[0][1])


def test_statistics_do_not_depend_on_tiles(two):
    bt = K.run_backtest(S.buy_and_hold(two))
    dd = [G.max_drawdown(bt.drop("rn"), size=s).orderBy("symbol").collect() for s in (11, 5000)]
    assert dd[0] == dd[1]
    nw = [G.newey_west_sharpe(bt.drop("rn"), "net_return", 100, size=s).orderBy("symbol").toPandas() for s in (20, 5000)]
    pd.testing.assert_frame_equal(nw[0], nw[1], rtol=1e-9)
    found = [Q.findings(two, "5m", outlier_window=20, z_threshold=2, size=s).count() for s in (25, 5000)]
    assert found[0] == found[1] > 0


@pytest.mark.parametrize("size", [12, 100, 5000])
def test_ofi_holds_across_stretches(spark, size):
    """Against the bar-by-bar rule, with stretches shorter than runs of signals."""
    rng = np.random.default_rng(11)
    ofi = rng.normal(0, 0.1, 600)
    ofi[rng.choice(600, 150, replace=False)] *= 30
    df = f.bars(spark, f.walk(600)).join(
        spark.createDataFrame([(t, float(v)) for t, v in zip(f.times(600), ofi)], "ts timestamp_ntz, ofi double"), "ts"
    )
    got = f.column(S.ofi_mean_reversion(df, 1.0, 5, 10, size=size), "position")
    s = pd.Series(ofi)
    z = (s - s.shift(1).rolling(10).mean()) / s.shift(1).rolling(10).std()
    want, left, side = [], 0, 0.0
    for v in z:
        if np.isnan(v):
            want.append(0.0)
        elif left > 0:
            want.append(side)
            left -= 1
        elif abs(v) > 1.0:
            side, left = (-1.0 if v > 0 else 1.0), 4
            want.append(side)
        else:
            want.append(0.0)
    assert got == want


def test_bars_do_not_depend_on_buckets(spark):
    t = f.trades(spark)
    a, b = (B.volume_bars(t, 3.0, bucket=k).orderBy("bar").toPandas() for k in ("1s", "1h"))
    pd.testing.assert_frame_equal(a, b)


def test_lttb_equals_the_direct_walk(spark):
    y = np.random.default_rng(2).normal(size=500).cumsum()
    df = f.bars(spark, y + 1000)
    for size in (40, 100_000):
        got = B.lttb(df, "close", 30, size=size).orderBy("ts").toPandas()
        x = np.array([pd.Timestamp(t).value / 1000 for t in f.times(500)])
        v, width, picked = y + 1000, 498 / 28, [0]
        edges = [int(np.floor(i * width)) + 1 for i in range(29)]
        for i in range(28):
            s, e = edges[i], edges[i + 1]
            ahead = slice(e, edges[i + 2]) if i < 27 else slice(499, 500)
            a = picked[-1]
            area = abs((x[a] - x[ahead].mean()) * (v[s:e] - v[a]) - (x[s:e] - x[a]) * (v[ahead].mean() - v[a]))
            picked.append(s + int(np.argmax(area)))
        want = [f.times(500)[i] for i in [*picked, 499]]
        assert [t.to_pydatetime() for t in got["ts"]] == want


def test_results_do_not_depend_on_shuffle_partitions(spark, two):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("1", "5", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            bt = K.run_backtest(S.ma_crossover(two, 3, 9, size=50), size=50)
            seen.append(bt.select("symbol", "ts", "equity").orderBy("symbol", "ts").toPandas())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0].equals(seen[1]) and seen[0].equals(seen[2])


@pytest.mark.parametrize("size", [3, 50])
def test_drawdown_does_not_depend_on_the_tile_size(spark, size):
    """Also when losses exceed the capital, so that equity changes its sign."""
    close = np.abs(np.random.default_rng(4).normal(60, 60, 300)) + 1
    bars = index_rows(f.bars(spark, close)).withColumn("position", F.when(F.col("close") > 60, -1.0).otherwise(1.0))
    whole, tiled = (K.run_backtest(bars, size=s).orderBy("rn").toPandas() for s in (50_000, size))
    assert (whole.equity < 0).any()
    np.testing.assert_allclose(whole.drawdown, tiled.drawdown, rtol=1e-9)
    np.testing.assert_allclose(whole.equity, tiled.equity, rtol=1e-9)


def test_threshold_bars_of_tiny_and_huge_amounts(spark):
    rows = [("X", i, 2e12, 1e-9, f.START + pd.Timedelta(seconds=i), True) for i in range(10)]
    trades = spark.createDataFrame(rows, "symbol string, agg_id long, price double, qty double, ts timestamp_ntz, is_buyer_maker boolean")
    assert [r["trades"] for r in B.volume_bars(trades, 5e-9).orderBy("bar").collect()] == [4, 5, 1]
    big = trades.withColumn("qty", F.lit(5.0))
    assert [r["trades"] for r in B.dollar_bars(big, 4e13).orderBy("bar").collect()] == [3, 4, 3]
    with pytest.raises(ValueError):
        B.volume_bars(trades, 0)
