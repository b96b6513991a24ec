"""Hand-checked values and rules of single operators."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import clock
from tapeloom.functions.maths import norm_cdf
from tapeloom.operators import backtest as K
from tapeloom.operators import bars as B
from tapeloom.operators import book as O
from tapeloom.operators import features as X
from tapeloom.operators import micro as M
from tapeloom.operators import quality as Q
from tapeloom.operators import signals as S
from tapeloom.operators import stats as G
from tapeloom.operators.backtest import BacktestConfig, Rolling
from tests import frames as f

FREE = BacktestConfig(fee_bps=0, slippage_bps=0, execution="next_close")


def equity(spark, values):
    rows = [("X", t, float(v), i) for i, (t, v) in enumerate(zip(f.times(len(values)), values))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, equity double, rn long")


def held(spark, close, position, **kw):
    p = spark.createDataFrame([(t, float(v)) for t, v in zip(f.times(len(close)), position)], "ts timestamp_ntz, position double")
    return f.bars(spark, close, **kw).join(p, "ts")


def test_max_drawdown(spark):
    got = G.max_drawdown(equity(spark, [100, 110, 90, 95, 80, 100])).first()
    assert got["max_drawdown"] == pytest.approx(-30 / 110)
    assert (got["peak_ts"], got["trough_ts"]) == (f.times(2)[1], f.times(5)[4])


def test_total_return(spark):
    assert equity(spark, [100, 110, 121]).agg(G.total_return("equity")).first()[0] == pytest.approx(0.21)
    assert equity(spark, [100]).agg(G.total_return("equity")).first()[0] == 0.0


def test_trade_ratios(spark):
    df = spark.createDataFrame([(1.0,), (-0.5,), (2.0,), (-1.5,)], "p double")
    assert df.agg(G.profit_factor("p")).first()[0] == 1.5
    assert df.where("p > 0").agg(G.profit_factor("p")).first()[0] == float("inf")
    df = spark.createDataFrame([(v,) for v in (0.01, -0.005, 0.02, -0.01, 0.003)], "p double")
    assert df.agg(G.hit_rate("p")).first()[0] == pytest.approx(0.6)
    assert df.where("p > 9").agg(G.hit_rate("p"), G.profit_factor("p")).first() == (None, None)


def test_turnover(spark):
    df = equity(spark, [1] * 100).withColumn("position", (F.col("rn") >= 50).cast("double"))
    assert G.turnover_per_year(df, 105120).first()[1] == pytest.approx(1051.2)


def test_sharpe_of_constant_returns_is_undefined(spark):
    df = spark.createDataFrame([(0.01,)] * 5, "r double")
    assert df.agg(G.sharpe("r", 365), G.probabilistic_sharpe("r")).first() == (None, None)
    assert df.agg(G.sortino("r", 365)).first()[0] == float("inf")


def test_fees_and_lag(spark):
    bt = K.run_backtest(held(spark, [100] * 6, [0.0, 1, 1, 0, 0, 0]), BacktestConfig(fee_bps=10, slippage_bps=0, execution="next_close"))
    assert bt.agg(F.sum("fee")).first()[0] == pytest.approx(0.002)
    assert f.column(bt, "position") == [0, 0, 1, 1, 0, 0]


def test_buy_and_hold_doubles(spark):
    bt = K.run_backtest(S.buy_and_hold(f.bars(spark, np.linspace(100, 200, 11))), FREE)
    assert f.column(bt, "equity")[-1] == pytest.approx(20_000)
    assert max(f.column(bt, "drawdown")) <= 0


def test_backtest_rejects_bad_input(spark):
    with pytest.raises(Exception, match="outside"):
        K.run_backtest(held(spark, [100, 101, 102], [0.0, 2, 0])).collect()
    with pytest.raises(Exception, match="non-positive"):
        K.run_backtest(held(spark, [100, -1, 102], [0.0, 1, 0])).collect()
    with pytest.raises(ValueError):
        BacktestConfig(execution="now")
    bars = f.bars(spark, [1, 2, 3])
    with pytest.raises(Exception, match="different keys"):
        K.align_positions(bars, S.buy_and_hold(bars).limit(2)).collect()


def test_trade_log_after_flip_and_after_flat(spark):
    close = [100, 110, 121, 100, 90, 95, 95, 99]
    position = [1.0, 1, -1, -1, 0, 0.5, 0.5, 0.5]
    bt = K.run_backtest(held(spark, close, position), FREE)
    eq = f.column(bt, "equity")
    log = K.trade_log(bt).orderBy("entry_at").collect()
    assert [(r["side"], r["bars_held"]) for r in log] == [(1, 2), (-1, 2), (0, 1)]
    assert log[0]["entry_equity"] == eq[0] and log[0]["exit_equity"] == eq[3]
    assert log[1]["entry_equity"] == eq[3] and log[1]["exit_equity"] == eq[5]  # a flip carries on
    assert log[2]["entry_equity"] == eq[5] and log[2]["exit_equity"] == eq[7]  # open at the end


def test_windows_and_slices(spark):
    bars = f.bars(spark, [1.0] * 101, seconds=86400)
    roll = Rolling(30, 10)
    w = K.make_windows(bars, roll).orderBy("window_id").collect()
    assert len(w) == 7 and w[0]["train_start"] == f.START and w[-1]["test_end"] == f.START + dt.timedelta(days=100)
    sizes = lambda **kw: {(r["window_id"], r["role"]): r["count"] for r in K.window_slices(bars, roll, **kw).groupBy("window_id", "role").count().collect()}
    both, half = sizes(), sizes(inclusive=False)
    assert set(both.values()) == {31, 11} and set(half.values()) == {30, 10}
    anchored = K.window_slices(bars, Rolling(30, 10, anchored=True)).where("role = 'train'").groupBy("window_id").count()
    assert {r["window_id"]: r["count"] for r in anchored.collect()} == {k: 31 + 10 * k for k in range(7)}
    with pytest.raises(ValueError):
        Rolling(30, 10, 0)


def test_parameter_grid_and_refused_sets():
    assert K.parameter_grid({"a": [1, 2], "b": [3, 4]}) == [{"a": 1, "b": 3}, {"a": 1, "b": 4}, {"a": 2, "b": 3}, {"a": 2, "b": 4}]
    grid = {"short_window": [5, 50], "long_window": [20]}
    assert K.valid_combos(S.STRATEGIES["ma_crossover"], grid) == [(0, {"short_window": 5, "long_window": 20})]


@pytest.mark.parametrize("name,grid,execution,anchored", [
    ("bollinger", {"window": [5], "num_std": [0.5, 1.0]}, "next_open", False),
    ("bollinger", {"window": [4, 15], "num_std": [1.5]}, "next_close", True),
    ("ma_crossover", {"short_window": [2, 3], "long_window": [5, 19]}, "next_close", False),
    ("ma_crossover", {"short_window": [2, 25], "long_window": [20, 40]}, "next_open", True),
])
def test_walk_forward_scores_slices_as_if_run_alone(spark, name, grid, execution, anchored):
    """Look-backs longer than the test slice, tiles shorter than a slice, both executions."""
    bars = f.bars(spark, f.walk(110, 4), seconds=86400).cache()
    rolling, config = Rolling(60, 20, anchored=anchored), BacktestConfig(execution=execution)
    got = K.walk_forward(bars, name, grid, rolling, config, bars_per_year=365, size=50).orderBy("window_id").toPandas()
    assert len(got) == 2
    rule = {"bollinger": S.bollinger_mean_reversion, "ma_crossover": S.ma_crossover}[name]
    combos = K.valid_combos(S.STRATEGIES[name], grid)

    def alone(start, end, params):
        run = K.run_backtest(rule(bars.where(F.col("ts").between(start, end)), **params, size=None), config, size=None).cache()
        return run.agg(G.sharpe("net_return", 365)).first()[0], K.trade_log(run, size=None).count()

    near = lambda x: None if x is None else pytest.approx(x, rel=1e-7)
    for r in got.itertuples():
        scores = {i: alone(r.train_start, r.train_end, p)[0] for i, p in combos}
        best = max(scores, key=lambda i: (-np.inf if scores[i] is None else scores[i], -i))
        assert r.combo_id == best and r.train_score == near(scores[best])
        score, trades = alone(r.test_start, r.test_end, dict(combos)[best])
        assert r.n_trades_test == trades and (None if np.isnan(r.test_score) else r.test_score) == near(score)


def test_walk_forward_takes_a_score_of_moments(spark):
    bars = f.bars(spark, f.walk(110, 4), seconds=86400)
    grid = {"short_window": [2, 5], "long_window": [9]}
    got = K.walk_forward(bars, "ma_crossover", grid, Rolling(60, 20), score=lambda m: m.total / m.n).toPandas()
    assert len(got) == 2 and (got["train_score"].abs() < 0.1).all()
    with pytest.raises(ValueError):
        K.walk_forward(bars, "ma_crossover", grid)


def test_book_levels_and_imbalance(spark):
    rows = [("X", f.START, "bid", 100.0 - i, s) for i, s in enumerate((10.0, 5.0, 3.0))]
    rows += [("X", f.START, "ask", 101.0 + i, 1.0) for i in range(3)]
    book = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, side string, price double, size double")
    assert O.depth_imbalance(book).first()["imbalance"] == pytest.approx(15 / 21)
    pairs = O.depth_arrays(book, 2).first()
    assert [p["price"] for p in pairs["bids"]] == [100, 99] and [p["price"] for p in pairs["asks"]] == [101, 102]
    crossed = book.unionByName(spark.createDataFrame([("X", f.START, "bid", 105.0, 1.0)], book.schema))
    assert O.validate_book(crossed).first()["crossed"] and not O.validate_book(book).first()["crossed"]


def test_snapshot_replaces_its_side(spark):
    at = lambda m: f.START + dt.timedelta(minutes=m)
    rows = [
        (1, at(1), "bid", 99.0, 5.0, False), (2, at(2), "bid", 98.0, 4.0, False), (3, at(3), "ask", 101.0, 7.0, False),
        (4, at(70), "bid", 97.0, 2.0, True), (4, at(70), "bid", 96.0, 0.0, True), (5, at(130), "bid", 98.0, 1.0, False),
    ]
    df = spark.createDataFrame(rows, "seq long, ts timestamp_ntz, side string, price double, size double, is_snapshot boolean").withColumn("symbol", F.lit("X"))
    got = O.book_at(df, "1h").orderBy("ts", "side", "price").collect()
    by_hour = {}
    for r in got:
        by_hour.setdefault((r["ts"] - f.START).seconds // 3600, []).append((r["side"], r["price"], r["size"]))
    assert by_hour == {
        1: [("ask", 101.0, 7.0), ("bid", 98.0, 4.0), ("bid", 99.0, 5.0)],
        2: [("ask", 101.0, 7.0), ("bid", 97.0, 2.0)],
        3: [("ask", 101.0, 7.0), ("bid", 97.0, 2.0), ("bid", 98.0, 1.0)],
    }
    with pytest.raises(Exception, match="price must be"):
        O.book_at(df.withColumn("price", F.lit(0.0)), "1h").collect()


def test_queue_position(spark):
    events = spark.createDataFrame(
        [(1, 1, "level", 15.0), (1, 2, "trade", 3.0), (1, 3, "level", 30.0), (1, 4, "level", 0.0), (2, 1, "trade", 25.0)],
        "order_id int, seq long, kind string, qty double",
    )
    orders = spark.createDataFrame([(1, 10.0, 20.0), (2, 10.0, 20.0)], "order_id int, shares_ahead double, level_size double")
    for chunk in (1, 2, 1000):
        got = O.queue_position(events, orders, chunk_rows=chunk).orderBy("order_id", "seq").collect()
        assert [r["shares_ahead"] for r in got] == pytest.approx([7.5, 4.5, 4.5, 0.0, 0.0])
        assert [r["at_front"] for r in got] == [False, False, False, True, True]


def test_gap_and_stale_runs(spark):
    at = [t for i, t in enumerate(f.times(50)) if not 20 <= i < 25]
    gap = Q.gaps(f.bars(spark, [1] * 45, at=at), "5m").collect()
    assert [(g["gap_seconds"], g["ts"]) for g in gap] == [(1800, f.times(50)[25])]
    flat = f.bars(spark, f.walk(50)).withColumn("k", F.minute("ts") + 60 * F.hour("ts"))
    flat = flat.withColumns({c: F.when(F.col("k").between(50, 65), F.lit(7.0)).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    assert [r["run_length"] for r in Q.stale_quotes(flat).collect()] == [4] * 4


def test_zero_deviation_makes_any_change_an_outlier(spark):
    df = f.bars(spark, [100] * 40, volume=[5.0] * 30 + [6.0] + [5.0] * 9)
    out = Q.volume_outliers(df, window=10, z_threshold=4).collect()
    assert [(r["volume"], r["z_score"]) for r in out] == [(6.0, float("inf"))]


def test_ofi_bounds_and_conservation(spark):
    t = f.trades(spark)
    ofi = [v for v in f.column(M.order_flow_imbalance(t, "2s"), "ofi") if v is not None]
    assert len(ofi) == 500 and max(map(abs, ofi)) <= 1
    total = t.agg(F.sum("qty"), F.sum(F.col("price") * F.col("qty"))).first()
    v = B.volume_bars(t, 5.0).agg(F.sum("volume"), F.sum("trades")).first()
    d = B.dollar_bars(t, 500.0).agg(F.sum("dollar_volume"), F.sum("trades")).first()
    assert v[0] == pytest.approx(total[0]) and d[0] == pytest.approx(total[1]) and v[1] == d[1] == 500
    with pytest.raises(ValueError):
        B.volume_bars(t, 0)


def test_ofi_signal_is_held(spark):
    ofi = [0.005 if i % 2 else -0.005 for i in range(80)]
    ofi[60] = 5.0
    df = f.bars(spark, [100] * 80, seconds=60).join(
        spark.createDataFrame(list(zip(f.times(80, 60), ofi)), "ts timestamp_ntz, ofi double"), "ts"
    )
    pos = f.column(S.ofi_mean_reversion(df, 2.0, 3, 20), "position")
    assert pos[60:64] == [-1, -1, -1, 0]


def test_predictions_to_positions(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (0.6,), (0.9,)], "p double")
    got = [r[0] for r in df.select(S.predictions_to_positions("p", "direction", direction_band=0.05)).collect()]
    assert got == [-1, 0, 1, 1]


def test_triple_barrier_against_the_definition(spark):
    close = f.walk(160, 9, 0.01)
    cfg = X.TripleBarrierConfig(8, 1.5, 1.5, 20)
    got = f.column(X.triple_barrier(f.bars(spark, close), cfg, size=30), "y")
    c = np.array(close)
    r = np.r_[0.0, np.diff(np.log(c))]
    sd = pd.Series(r).rolling(20).std()
    for t in range(160):
        if t >= 152 or np.isnan(sd[t]):
            assert got[t] is None
            continue
        up, down = c[t] * np.exp(1.5 * sd[t]), c[t] * np.exp(-1.5 * sd[t])
        want = 0.0
        for j in range(t + 1, t + 9):
            if c[j] + 1 >= up or c[j] - 1 <= down:
                want = 1.0 if c[j] + 1 >= up else -1.0
                break
        assert got[t] == want


def test_sequences_and_scaling(spark):
    df = f.bars(spark, range(1, 11))
    got = X.sequences(df, ["close", "volume"], 3, y="close").orderBy("ts").collect()
    assert len(got) == 8 and [v[0] for v in got[0]["x"]] == [1, 2, 3] and got[0]["close"] == 3
    with pytest.raises(ValueError):
        X.sequences(df, ["close"], 0)
    rows = df.withColumn("role", F.when(F.col("close") <= 6, "train").otherwise("test"))
    out = X.scale_split(rows, ["close", "volume"], by=["symbol"]).where("role = 'train'").agg(F.avg("close"), F.stddev_pop("close"), F.max("volume")).first()
    assert out[0] == pytest.approx(0) and out[1] == pytest.approx(1) and out[2] == 0


def test_time_and_normal_helpers(spark):
    assert clock.duration_us("5m") == clock.duration_us("5min") == 300 * clock.SECOND
    for bad in ("5x", "m", ""):
        with pytest.raises(ValueError):
            clock.duration_us(bad)
    with pytest.raises(ValueError):
        clock.bars_per_year("2h")
    z = [-40.0, -3.0, -1.0, 0.0, 0.5, 1.96, 8.0]
    from math import erfc, sqrt

    got = [r[0] for r in spark.createDataFrame([(v,) for v in z], "z double").select(norm_cdf(F.col("z"))).collect()]
    assert got == pytest.approx([0.5 * erfc(-v / sqrt(2)) for v in z], abs=1e-14)


def test_bootstrap_covers_the_point(spark):
    r = np.random.default_rng(0).normal(0.001, 0.01, 500)
    df = spark.createDataFrame([("X", t, float(v)) for t, v in zip(f.times(500), r)], "symbol string, ts timestamp_ntz, r double")
    ci = G.bootstrap_sharpe_ci(df, "r", 365, n_iter=100).first()
    assert ci["lower"] < ci["point"] < ci["upper"]
    idx = G.bootstrap_indices(spark.createDataFrame([("X", 500)], "symbol string, n long"), n_iter=3, block=64).toPandas()
    assert idx.groupby("iter").size().tolist() == [500] * 3 and idx["idx"].between(0, 499).all()
    with pytest.raises(Exception, match="at least 10"):
        G.bootstrap_sharpe_ci(df.limit(5), "r", 365, n_iter=5).collect()


def test_newey_west_against_numpy(spark):
    rng = np.random.default_rng(1)
    r = np.zeros(600)
    for i in range(1, 600):
        r[i] = 0.3 * r[i - 1] + rng.normal(0.0005, 0.01)
    df = spark.createDataFrame([("X", t, float(v)) for t, v in zip(f.times(600), r)], "symbol string, ts timestamp_ntz, r double")
    got = G.newey_west_sharpe(df, "r", 365, size=50).first()
    c, lag = r - r.mean(), int(4 * 6 ** (2 / 9))
    lrv = (c**2).mean() + 2 * sum((1 - k / (lag + 1)) * (c[:-k] * c[k:]).mean() for k in range(1, lag + 1))
    sr = r.mean() / r.std(ddof=1)
    se = np.sqrt((1 + sr**2 / 2) * lrv / (c**2).mean() / 600)
    assert got["lag"] == lag and got["standard_error"] == pytest.approx(se * np.sqrt(365)) and got["t_stat"] == pytest.approx(sr / se)


def test_bootstrap_blocks_cover_every_step_once(spark):
    """Short and long blocks, one segment and many."""
    sizes = spark.createDataFrame([("A", 3000), ("B", 17), ("C", 1)], "symbol string, n long")
    for mean_length in (1, 2.5, 400):
        out = G.bootstrap_blocks(sizes, n_iter=4, seed=3, mean_block_size=mean_length).toPandas()
        for (symbol, _), own in out.groupby(["symbol", "iter"]):
            own = own.sort_values("t")
            n = {"A": 3000, "B": 17, "C": 1}[symbol]
            assert own["t"].tolist() == [0, *np.cumsum(own["length"])[:-1].tolist()] and own["length"].sum() == n
            assert own["idx"].between(0, n - 1).all()
        if mean_length == 2.5:
            assert len(out[out["symbol"] == "A"]) == pytest.approx(4 * 3000 / 2.5, rel=0.1)


def test_bootstrap_sums_are_those_of_the_rows(spark):
    df = f.bars(spark, f.walk(40, 3)).withColumn("r", F.col("close") - 90)
    kw = dict(n_iter=30, seed=5, mean_block_size=60)  # blocks that go round the end more than once
    by_sums = G.bootstrap_ci(df, "r", **kw).first()
    by_rows = G.bootstrap_any_ci(df, "r", F.avg, **kw).first()
    assert all(by_sums[c] == pytest.approx(by_rows[c]) for c in ("point", "lower", "upper"))
    flat = G.bootstrap_sharpe_ci(df.withColumn("r", F.lit(0.1)), "r", 365, n_iter=5).first()
    assert flat["point"] is None and flat["lower"] is None
