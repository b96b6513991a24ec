"""Fits against their definitions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import models as J
from tapeloom.operators.backtest import BacktestConfig, Rolling, run_backtest
from tapeloom.operators.features import FeatureConfig
from tests import frames as f


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    p = 1 / (1 + np.exp(-(0.3 + 1.2 * x[:, 0] - 0.7 * x[:, 1])))
    frame = pd.DataFrame(x, columns=list("abc")).assign(
        symbol=np.where(np.arange(600) % 2, "p", "q"), y=(rng.random(600) < p).astype(float),
        role=np.where(np.arange(600) < 400, "train", "test"), ts=f.times(600),
    )
    frame["z"] = 0.5 + 0.2 * frame["a"] + rng.normal(0, 0.01, 600)
    return frame, spark.createDataFrame(frame)


def test_logistic_meets_its_optimality_condition(planted):
    frame, df = planted
    rows = J.logistic_coefficients(df.where("role = 'train'"), list("abc"), ["symbol"], alpha=2.0).collect()
    assert len(rows) == 2
    for r in rows:
        part = frame[(frame.symbol == r["symbol"]) & (frame.role == "train")]
        x = np.c_[np.ones(len(part)), part[list("abc")]]
        b = np.array(r["_b"])
        gradient = x.T @ (1 / (1 + np.exp(-x @ b)) - part.y) + 2.0 * np.r_[0, b[1:]]
        assert np.abs(gradient).max() < 1e-8


def test_ridge_equals_the_closed_form(planted):
    frame, df = planted
    rows = df.withColumn("y", F.col("z"))
    got = J.ridge_regression(3.0)(rows, list("abc"), ["symbol"], "return").orderBy("ts").toPandas()
    for s, part in frame.groupby("symbol"):
        train, test = part[part.role == "train"], part[part.role == "test"]
        xm, zm = train[list("abc")].mean(), train.z.mean()
        xc = (train[list("abc")] - xm).to_numpy()
        b = np.linalg.solve(xc.T @ xc + 3.0 * np.eye(3), xc.T @ (train.z - zm))
        np.testing.assert_allclose(got[got.symbol == s].pred, zm + (test[list("abc")] - xm).to_numpy() @ b, rtol=1e-9)


@pytest.mark.parametrize("model", [J.mlp((4,), 30), J.boosted_trees(60, 2)])
def test_local_fits_give_repeatable_probabilities(planted, model):
    _, df = planted
    a, b = (model(df, list("abc"), ["symbol"], "direction").orderBy("ts").toPandas() for _ in range(2))
    assert len(a) == 200 and a.pred.between(0, 1).all() and a.pred.equals(b.pred)
    assert ((a.pred > 0.5) == (a.y > 0.5)).mean() > 0.6


@pytest.mark.parametrize("model", [J.mlp(), J.boosted_trees()])
def test_local_fits_learn_returns(planted, model):
    _, df = planted
    out = model(df.withColumn("y", F.col("z")), list("abc"), ["symbol"], "return").toPandas()
    assert np.corrcoef(out.pred, out.y)[0, 1] > 0.9
    assert set(out.symbol) == {"p", "q"} and "a" not in out.columns


def test_newton_that_does_not_settle_raises(planted):
    _, df = planted
    with pytest.raises(RuntimeError, match="2 slices still move"):
        J.logistic_coefficients(df.where("role = 'train'"), list("abc"), ["symbol"], max_iter=2)


def test_overlapping_predictions_raise(spark):
    bars = f.bars(spark, f.walk(30 * 24), seconds=3600)
    spec = J.BenchmarkSpec("1h", features=FeatureConfig(2, (), False, False), rolling=Rolling(10, 3, 1))
    with pytest.raises(Exception, match="several positions for one bar"):
        J.evaluate_one(bars, spec, "Lag1").collect()


def test_series_without_predictions_have_no_test_rows(spark):
    bars = f.bars(spark, f.walk(30 * 24), seconds=3600).unionByName(f.bars(spark, f.walk(20), symbol="short", seconds=3600))
    spec = J.BenchmarkSpec("1h", features=FeatureConfig(2, (), False, False), rolling=Rolling(10, 3))
    got = {r["symbol"]: r["n_test"] for r in J.evaluate_one(bars, spec, "Lag1").collect()}
    assert got["short"] == 0 and got["X"] > 0


def test_one_class_slices_are_left_out(planted):
    _, df = planted
    one = df.withColumn("y", F.when(F.col("symbol") == "p", 1.0).otherwise(F.col("y")))
    out = J.ridge_classifier()(one, list("abc"), ["symbol"], "direction")
    assert {r[0] for r in out.select("symbol").distinct().collect()} == {"q"}


def test_metrics_by_hand(spark):
    rows = [("X", 0.9, 1.0), ("X", 0.8, 0.0), ("X", 0.8, 1.0), ("X", 0.2, 0.0), ("X", 0.1, 1.0)]
    got = J.classification_metrics(spark.createDataFrame(rows, "symbol string, pred double, actual double")).first()
    assert got["accuracy"] == pytest.approx(0.6) and got["f1"] == pytest.approx(2 / 3)
    assert got["auc"] == pytest.approx((2 + 1.5 + 0) / 6)
    single = spark.createDataFrame([("X", 0.9, 1.0), ("X", 0.1, 1.0)], "symbol string, pred double, actual double")
    assert J.classification_metrics(single).first()["auc"] is None


def test_short_series_stay_flat(spark):
    bars = f.bars(spark, f.walk(40))
    out = J.ml_directional(bars, J.lag1(), config=FeatureConfig(2, (), False, False))
    assert out.count() == 40 and out.where("position <> 0").count() == 0
    with pytest.raises(ValueError):
        J.ml_directional(bars, J.lag1(), train_fraction=0.05)
    with pytest.raises(KeyError):
        J.make_model("nothing")


def test_windows_need_fifty_training_rows(spark):
    bars = f.bars(spark, f.walk(30 * 24), seconds=3600)
    cfg = FeatureConfig(2, (), False, False)
    assert J.fit_predict_walkforward(bars, J.lag1(), "return", Rolling(2, 1), cfg).count() == 0
    out = J.fit_predict_walkforward(bars, J.ridge(), "return", Rolling(10, 3), cfg)
    assert out.groupBy("window_id").count().where("count = 72").count() == 6


def test_registered_sweep_has_every_cell(spark, sf):
    """The whole sweep is run once here; the pivots are taken from its result."""
    from tapeloom.catalog import all_queries

    swept = all_queries()["J13_benchmark_sweep"].run(spark, sf).cache()
    out = swept.toPandas()
    cells = out.groupby(["timeframe", "target", "model", "fee_mode"]).symbol.nunique()
    assert len(out) == cells.sum() and len(cells) == 2 * 3 * len(J.MODELS) * 2 and set(cells) == {5}
    fitted = out[out.model.isin(["MLP", "GBT"])]
    assert fitted[fitted.target == "return"].rmse.notna().any() and fitted[fitted.target != "return"].accuracy.notna().any()
    assert (out.turnover > 0).any()
    fees = J.fee_pivot(swept).toPandas()
    assert len(fees) == len(out) / 2 and (fees.maker - fees.taker)[fees.maker.notna()].abs().max() > 0
    panels = J.accuracy_pivot(swept).toPandas()
    assert len(panels) == 3 * len(J.MODELS) and panels.shape[1] == 2 + 2 * 5
    cell = out[(out.model == "Ridge") & (out.target == "direction") & (out.fee_mode == "taker") & (out.symbol == "view") & (out.timeframe == "1h")]
    assert panels[(panels.model == "Ridge") & (panels.target == "direction")]["1h|view"].item() == cell.accuracy.item()


def test_sweep_leaves_out_trades_without_a_positive_price(spark, sf, monkeypatch):
    from tapeloom.catalog import models as queries

    rows = [("X", i, f.START + pd.Timedelta(minutes=15 * i + 1), float(p), 1.0, False) for i, p in enumerate(f.walk(40))]
    rows += [("X", 40, f.START + pd.Timedelta(minutes=14), 0.0, 1.0, False), ("X", 41, f.START + pd.Timedelta(minutes=59), -1.0, 1.0, False)]  # the last trades of their bars
    trades = spark.createDataFrame(rows, "symbol string, agg_id long, ts timestamp_ntz, price double, qty double, is_buyer_maker boolean")
    monkeypatch.setattr(queries.T, "trades", lambda *_: trades)
    monkeypatch.setattr(J, "benchmark_sweep", lambda bars, specs, models: bars)
    for timeframe, bars in queries._sweep(spark, sf).items():
        out = run_backtest(bars.withColumn("position", F.lit(1.0)), BacktestConfig(execution="next_close")).toPandas()
        assert len(out) == {"15m": 40, "1h": 10}[timeframe] and out.volume.sum() == 40 and out.low.min() > 0


def test_models_evaluated_together_equal_models_alone(spark):
    bars = f.bars(spark, f.walk(30 * 24), seconds=3600)
    cfg = FeatureConfig(2, (), False, False)
    spec = J.BenchmarkSpec("1h", "triple_barrier", cfg, Rolling(10, 3))
    models = {"Lag1": J.lag1(), "Ridge": J.ridge(), "MLP": J.mlp((4,), 5)}
    together = J.benchmark_sweep({"1h": bars}, [spec], models, fee_modes=("taker",)).toPandas().set_index("model")
    for name, model in models.items():
        alone = J.evaluate_one(bars, spec, name, model=model).first().asDict()
        for c in ("n_test", "accuracy", "timeout_frac", "strategy_sharpe", "strategy_total_return", "turnover"):
            assert together.loc[name, c] == pytest.approx(alone[c], nan_ok=True), (name, c)


@pytest.mark.parametrize("name", ["J4_mlp", "J5_boosted_trees"])
def test_registered_fits_return_varied_predictions(spark, sf, name):
    from tapeloom.catalog import all_queries

    out = all_queries()[name].run(spark, sf).toPandas()
    assert list(out.columns) == ["symbol", "window_id", "ts", "pred", "actual"]
    assert len(out) and out.pred.between(0, 1).all() and out.pred.nunique() > 10


@pytest.mark.parametrize("model", [J.mlp(), J.boosted_trees()])
def test_default_fits_repeat_and_beat_lag1_on_a_planted_signal(spark, model):
    # Returns of alternating sign with noise: the last one repeated is mostly wrong.
    rng = np.random.default_rng(2)
    steps = 0.01 * np.where(np.arange(24 * 24) % 2, 1, -1) + rng.normal(0, 0.004, 24 * 24)
    bars = f.bars(spark, 100 * np.exp(np.cumsum(steps)), seconds=3600)
    a, b, last = (
        J.fit_predict_walkforward(bars, m, "direction", Rolling(14, 3), FeatureConfig()).toPandas().sort_values(["window_id", "ts"], ignore_index=True)
        for m in (model, model, J.lag1())
    )
    right = lambda out: ((out.pred > 0.5) == (out.actual > 0.5)).mean()
    assert a.equals(b) and right(a) > 0.9 > right(last) + 0.3
