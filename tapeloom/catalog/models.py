"""Predictors and their evaluation."""

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.catalog import backtest as _backtest
from tapeloom.catalog import features as _features  # noqa: F401  (shared views)
from tapeloom.catalog.spec import query, view
from tapeloom.operators import bars as B
from tapeloom.operators import models as J
from tapeloom.operators.backtest import BacktestConfig, Rolling
from tapeloom.operators.features import FeatureConfig
from tapeloom.plans.stage import stage
from tapeloom.plans.tiles import index_rows
from tapeloom.sources import testtables as T

TWO = FeatureConfig(n_lag_returns=2, rolling_windows=(), include_volume_z=False, include_tod_cyclic=False)
ROLL = Rolling(14, 3)
_SPAN = {"train": (0, 14), "test": (14, 17)}
_DAY = 86_400_000_000


def _role_sql(role: str) -> str:
    lo, hi = _SPAN[role]
    return f"""
SELECT a.symbol, k.window_id, a.ts, '{role}' AS role, a.ret_lag1 AS x1, a.ret_lag2 AS x2, a.fwd
FROM v_two a JOIN v_hours k ON k.symbol = a.symbol
 AND epoch_us(a.ts) >= k.first + (3 * k.window_id + {lo}) * {_DAY} AND epoch_us(a.ts) < k.first + (3 * k.window_id + {hi}) * {_DAY}"""


view("v_two", """
SELECT f.symbol, f.ts, f.ret_lag1, f.ret_lag2, t.fwd FROM v_features f JOIN v_fwd t ON t.symbol = f.symbol AND t.ts = f.ts
WHERE f.ret_lag1 + f.ret_lag2 + t.fwd IS NOT NULL""")
view("v_hours", f"""
SELECT symbol, first, unnest(range(CAST((last - first - 17 * {_DAY}) // (3 * {_DAY}) + 1 AS BIGINT))) AS window_id
FROM (SELECT symbol, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM v_bars GROUP BY 1)""")
view("v_fit", f"{_role_sql('train')} UNION ALL {_role_sql('test')}")
view("v_scaled", """
WITH m AS (SELECT symbol, window_id, avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, count(*) AS n
           FROM v_fit WHERE role = 'train' GROUP BY 1, 2)
SELECT f.* REPLACE ((x1 - m1) / CASE WHEN s1 > 0 THEN s1 ELSE 1 END AS x1, (x2 - m2) / CASE WHEN s2 > 0 THEN s2 ELSE 1 END AS x2)
FROM v_fit f JOIN m USING (symbol, window_id) WHERE n >= 50""")
_PREDS = "symbol:s window_id:i ts:t pred:f7 actual:f7"
view("v_lag1", """
SELECT symbol, window_id, ts, CASE WHEN x1 > 0 THEN 0.9e0 ELSE 0.1e0 END AS pred, CASE WHEN fwd > 0 THEN 1e0 ELSE 0e0 END AS actual
FROM v_scaled WHERE role = 'test'""")


def _bars(spark, sf):
    return T.indexed_hourly_bars(spark, sf)


@query("J1_lag1", _PREDS, "SELECT symbol, window_id, ts, x1 AS pred, fwd AS actual FROM v_scaled WHERE role = 'test'")
def _(spark, sf):
    return J.fit_predict_walkforward(_bars(spark, sf), J.lag1(), "return", ROLL, TWO)


@query("J2_ridge_regression", _PREDS, """
WITH g AS (SELECT symbol, window_id, avg(x1) AS a1, avg(x2) AS a2, avg(fwd) AS ay,
                  var_pop(x1) * count(*) + 1 AS c11, var_pop(x2) * count(*) + 1 AS c22, covar_pop(x1, x2) * count(*) AS c12,
                  covar_pop(x1, fwd) * count(*) AS d1, covar_pop(x2, fwd) * count(*) AS d2 FROM v_scaled WHERE role = 'train' GROUP BY 1, 2),
b AS (SELECT *, (d1 * c22 - d2 * c12) / (c11 * c22 - c12 * c12) AS b1, (d2 * c11 - d1 * c12) / (c11 * c22 - c12 * c12) AS b2 FROM g)
SELECT symbol, window_id, ts, ay + b1 * (x1 - a1) + b2 * (x2 - a2) AS pred, fwd AS actual
FROM v_scaled JOIN b USING (symbol, window_id) WHERE role = 'test'""")
def _(spark, sf):
    return J.fit_predict_walkforward(_bars(spark, sf), J.ridge_regression(), "return", ROLL, TWO)


def _logistic_sql(steps: int = 10, alpha: float = 1.0) -> str:
    """Ten unrolled Newton steps for two features, solved by Cramer's rule."""
    parts = ["""l AS (SELECT symbol, window_id, ts, role, x1, x2, fwd, CASE WHEN fwd > 0 THEN 1e0 ELSE 0e0 END AS y FROM v_scaled),
c0 AS (SELECT symbol, window_id, 0e0 AS b0, 0e0 AS b1, 0e0 AS b2 FROM l WHERE role = 'train' GROUP BY 1, 2 HAVING count(DISTINCT y) > 1)"""]
    for k in range(steps):
        parts.append(f"""s{k} AS (SELECT symbol, window_id, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2,
  sum(w) AS a, sum(w * x1) AS b, sum(w * x2) AS c, sum(w * x1 * x1) + {alpha} AS d, sum(w * x1 * x2) AS e, sum(w * x2 * x2) + {alpha} AS f,
  sum(p - y) AS g0, sum((p - y) * x1) + {alpha} * any_value(b1) AS g1, sum((p - y) * x2) + {alpha} * any_value(b2) AS g2
  FROM (SELECT *, p * (1 - p) AS w FROM (SELECT l.*, b0, b1, b2, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p
        FROM l JOIN c{k} USING (symbol, window_id) WHERE role = 'train')) GROUP BY 1, 2),
c{k + 1} AS MATERIALIZED (SELECT symbol, window_id, b0 - (g0 * (d * f - e * e) - b * (g1 * f - e * g2) + c * (g1 * e - d * g2)) / det AS b0,
  b1 - (a * (g1 * f - e * g2) - g0 * (b * f - e * c) + c * (b * g2 - g1 * c)) / det AS b1,
  b2 - (a * (d * g2 - g1 * e) - b * (b * g2 - g1 * c) + g0 * (b * e - d * c)) / det AS b2
  FROM (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM s{k}))""")
    return f"""WITH {", ".join(parts)}
SELECT symbol, window_id, ts, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS pred, y AS actual
FROM l JOIN c{steps} USING (symbol, window_id) WHERE role = 'test'"""


@query("J3_ridge_classifier", _PREDS, _logistic_sql())
def _(spark, sf):
    return J.fit_predict_walkforward(_bars(spark, sf), J.ridge_classifier(), "direction", ROLL, TWO)


@query("J3_ridge_classifier_wide", _PREDS)
def _(spark, sf):
    return J.fit_predict_walkforward(_bars(spark, sf), J.ridge_classifier(), "direction", ROLL, FeatureConfig(rolling_windows=(5, 20)))


# What SQL can say about a fit that has no closed form: its rows, their actuals, and the range of its predictions.
_FITTED = "symbol:s window_id:i ts:t actual:f7 sound:b"
_FITTED_SQL = "SELECT symbol, window_id, ts, CASE WHEN fwd > 0 THEN 1e0 ELSE 0e0 END AS actual, true AS sound FROM v_scaled WHERE role = 'test'"


def _sound(preds):
    return preds.withColumn("sound", F.col("pred").between(0.0, 1.0))


@query("J4_mlp", _PREDS)
def _(spark, sf):
    return J.fit_predict_walkforward(_bars(spark, sf), J.mlp(), "direction", ROLL, FeatureConfig())


@query("J4_mlp_rows", _FITTED, _FITTED_SQL)
def _(spark, sf):
    return _sound(J.fit_predict_walkforward(_bars(spark, sf), J.mlp(), "direction", ROLL, TWO))


@query("J5_boosted_trees", _PREDS)
def _(spark, sf):
    return J.fit_predict_walkforward(_bars(spark, sf), J.boosted_trees(), "direction", ROLL, FeatureConfig())


@query("J5_boosted_trees_rows", _FITTED, _FITTED_SQL)
def _(spark, sf):
    return _sound(J.fit_predict_walkforward(_bars(spark, sf), J.boosted_trees(), "direction", ROLL, TWO))


@query("J7_walkforward_fit", _PREDS, "SELECT * FROM v_lag1")
def _(spark, sf):
    return J.fit_predict_walkforward(_bars(spark, sf), J.make_model("Lag1"), "direction", ROLL, TWO)


def _class_sql(source: str) -> str:
    return f"""
WITH c AS (SELECT symbol, CAST(count(*) AS DOUBLE) AS n_test, avg(CASE WHEN (pred > 0.5e0) = (actual > 0.5e0) THEN 1e0 ELSE 0e0 END) AS accuracy,
                  CAST(count(*) FILTER (pred > 0.5e0 AND actual > 0.5e0) AS DOUBLE) AS tp, CAST(count(*) FILTER (pred > 0.5e0) AS DOUBLE) AS pp,
                  CAST(count(*) FILTER (actual > 0.5e0) AS DOUBLE) AS ap FROM {source} GROUP BY 1),
r AS (SELECT symbol, sum(rk) FILTER (actual > 0.5e0) AS s FROM (
        SELECT symbol, actual, rank() OVER (PARTITION BY symbol ORDER BY pred) + (count(*) OVER (PARTITION BY symbol, pred) - 1) / 2e0 AS rk
        FROM {source}) GROUP BY 1)
SELECT symbol, n_test, accuracy, CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (pp + ap) END AS f1,
       (s - ap * (ap + 1) / 2) / nullif(ap * (n_test - ap), 0) AS auc FROM c JOIN r USING (symbol)"""


_CLASS = "symbol:s n_test:f0 accuracy:f8 f1:f8 auc:f8"


@query("J8_classification_metrics", _CLASS, _class_sql("v_predictions"))
def _(spark, sf):
    return J.classification_metrics(T.predictions(spark, sf))


view("v_signed", "SELECT symbol, pred - 0.3e0 AS pred, CASE WHEN doc_id % 5 = 0 THEN 0e0 ELSE 2 * actual - 1 END AS actual FROM v_predictions")


@query("J9_triple_barrier_metrics", "symbol:s n_test:f0 accuracy:f8 f1:f8 timeout_frac:f8", """
SELECT symbol, count(*) AS n_test, avg(CASE WHEN sign(pred) = actual THEN 1e0 ELSE 0e0 END) FILTER (actual <> 0) AS accuracy,
       CASE WHEN count(*) FILTER (actual <> 0) = 0 THEN NULL WHEN count(*) FILTER (pred > 0 AND actual = 1) = 0 THEN 0
            ELSE 2e0 * count(*) FILTER (pred > 0 AND actual = 1) / (2 * count(*) FILTER (pred > 0 AND actual = 1)
                 + count(*) FILTER (pred > 0 AND actual = -1) + count(*) FILTER (pred < 0 AND actual = 1)) END AS f1,
       1 - avg(CASE WHEN actual <> 0 THEN 1e0 ELSE 0e0 END) AS timeout_frac FROM v_signed GROUP BY 1""")
def _(spark, sf):
    p = T.predictions(spark, sf)
    actual = F.when(F.col("doc_id") % 5 == 0, F.lit(0.0)).otherwise(2 * F.col("actual") - 1)
    return J.triple_barrier_metrics(p.select("symbol", (F.col("pred") - 0.3).alias("pred"), actual.alias("actual")))


@query("J10_regression_metrics", "symbol:s n_test:f0 rmse:f8 mae:f8 r2:f7", """
SELECT symbol, count(*) AS n_test, sqrt(avg((pred - actual) * (pred - actual))) AS rmse, avg(abs(pred - actual)) AS mae,
       1 - sum((pred - actual) * (pred - actual)) / nullif(var_pop(actual) * count(*), 0) AS r2 FROM v_predictions GROUP BY 1""")
def _(spark, sf):
    return J.regression_metrics(T.predictions(spark, sf))


view("v_lagpos", """
SELECT b.*, coalesce(CASE WHEN p.pred > 0.55e0 THEN 1e0 WHEN p.pred < 0.45e0 THEN -1e0 END, 0e0) AS position
FROM v_nbars b LEFT JOIN v_lag1 p ON p.symbol = b.symbol AND p.ts = b.ts""")
view("v_lagbt", _backtest.backtest_sql("v_lagpos"))
view("v_lagtrades", _backtest.trades_sql("v_lagbt"))
view("v_lagfig", """
SELECT m.*, t.strategy_hit_rate FROM (
  SELECT symbol, coalesce(avg(net_return) / nullif(stddev_samp(net_return), 0) * sqrt(8760e0), 0) AS strategy_sharpe,
         arg_max(equity, rn) / arg_min(equity, rn) - 1 AS strategy_total_return, min(drawdown) AS strategy_max_drawdown,
         sum(CASE WHEN rn > 0 THEN abs(position - lagged) ELSE 0 END) AS turnover FROM v_lagbt GROUP BY 1) m
LEFT JOIN (SELECT symbol, avg(CASE WHEN pnl_pct > 0 THEN 1e0 ELSE 0e0 END) AS strategy_hit_rate FROM v_lagtrades GROUP BY 1) t USING (symbol)""")
SPEC = J.BenchmarkSpec("1h", "direction", TWO, ROLL, BacktestConfig(execution="next_close"))
_FIG = "strategy_sharpe:f6 strategy_total_return:e6 strategy_max_drawdown:f7 strategy_hit_rate:f8 turnover:f2"


@query("J11_strategy_metrics", "symbol:s " + _FIG, "SELECT * FROM v_lagfig")
def _(spark, sf):
    from tapeloom.operators.signals import predictions_to_positions

    bars = _bars(spark, sf)
    preds = J.fit_predict_walkforward(bars, J.lag1(), "direction", ROLL, TWO)
    positions = preds.withColumn("position", predictions_to_positions("pred", "direction", direction_band=0.05))
    return J.strategy_metrics(bars, positions, SPEC.backtest, 8760)


@query("J12_evaluate", _CLASS + " timeframe:s target:s model:s fee_mode:s " + _FIG, f"""
SELECT c.*, '1h' AS timeframe, 'direction' AS target, 'Lag1' AS model, 'taker' AS fee_mode, f.* EXCLUDE (symbol)
FROM ({_class_sql('v_lag1')}) c JOIN v_lagfig f USING (symbol)""")
def _(spark, sf):
    return J.evaluate_one(_bars(spark, sf), SPEC, "Lag1")


# Two targets, two models, two fee modes, in SQL: predictions, positions, backtests, figures.
view("v_targets", """
SELECT symbol, window_id, ts, role, x1, x2, 'direction' AS target, CASE WHEN fwd > 0 THEN 1e0 ELSE 0e0 END AS y FROM v_scaled
UNION ALL SELECT symbol, window_id, ts, role, x1, x2, 'return' AS target, fwd AS y FROM v_scaled""")
view("v_sweep_preds", """
WITH g AS (SELECT symbol, window_id, target, avg(x1) AS a1, avg(x2) AS a2, avg(y) AS ay, var_pop(x1) * count(*) + 1 AS c11, var_pop(x2) * count(*) + 1 AS c22,
             covar_pop(x1, x2) * count(*) AS c12, covar_pop(x1, y) * count(*) AS d1, covar_pop(x2, y) * count(*) AS d2
           FROM v_targets WHERE role = 'train' GROUP BY 1, 2, 3),
b AS (SELECT *, (d1 * c22 - d2 * c12) / (c11 * c22 - c12 * c12) AS b1, (d2 * c11 - d1 * c12) / (c11 * c22 - c12 * c12) AS b2 FROM g)
SELECT symbol, ts, target, 'RidgeReg' AS model, ay + b1 * (x1 - a1) + b2 * (x2 - a2) AS pred, y FROM v_targets JOIN b USING (symbol, window_id, target) WHERE role = 'test'
UNION ALL SELECT symbol, ts, target, 'Lag1', CASE WHEN target = 'return' THEN x1 WHEN x1 > 0 THEN 0.9e0 ELSE 0.1e0 END, y FROM v_targets WHERE role = 'test'""")
view("v_sweep_pos", """
SELECT b.*, t.target, t.model, coalesce(CASE WHEN p.pred > t.hi THEN 1e0 WHEN p.pred < t.lo THEN -1e0 END, 0e0) AS position
FROM v_nbars b CROSS JOIN (SELECT * FROM (VALUES ('direction', 0.55e0, 0.45e0), ('return', 0.5e0, -0.5e0)) v(target, hi, lo), (VALUES ('Lag1'), ('RidgeReg')) m(model)) t
LEFT JOIN v_sweep_preds p ON p.symbol = b.symbol AND p.ts = b.ts AND p.target = t.target AND p.model = t.model""")
_KEYS = "symbol, target, model"
view("v_sweep_taker", _backtest.backtest_sql("v_sweep_pos", _KEYS))
view("v_sweep_maker", _backtest.backtest_sql("v_sweep_pos", _KEYS, cost="0.0002e0"))
view("v_sweep", " UNION ALL ".join(f"""
SELECT f.*, '1h' AS timeframe, '{mode}' AS fee_mode, m.accuracy, m.rmse FROM (
  SELECT {_KEYS}, coalesce(avg(net_return) / nullif(stddev_samp(net_return), 0) * sqrt(8760e0), 0) AS strategy_sharpe,
         sum(CASE WHEN rn > 0 THEN abs(position - lagged) ELSE 0 END) AS turnover FROM v_sweep_{mode} GROUP BY {_KEYS}) f
LEFT JOIN (SELECT {_KEYS}, avg(CASE WHEN (pred > 0.5e0) = (y > 0.5e0) THEN 1e0 ELSE 0e0 END) FILTER (target = 'direction') AS accuracy,
                  sqrt(avg((pred - y) * (pred - y)) FILTER (target = 'return')) AS rmse FROM v_sweep_preds GROUP BY {_KEYS}) m USING ({_KEYS})""" for mode in ("taker", "maker")))


def _closed_sweep(spark, sf):
    """The cells that SQL can fit."""
    specs = [SPEC, replace(SPEC, target="return", return_band=0.5)]
    return J.benchmark_sweep({"1h": _bars(spark, sf)}, specs, {"Lag1": J.lag1(), "RidgeReg": J.ridge_regression()})


TIMEFRAMES = ("15m", "1h")


def _sweep(spark, sf):
    """Every model on every target with the default features, per timeframe.

    Backtests raise on a price that is not positive, so a trade with such a price (``check_trades`` counts it as a violation) goes
    before bars are made; its bar keeps the other trades.
    """
    trades = T.trades(spark, sf).where(~F.coalesce(F.col("price") <= 0, F.lit(False)))
    bars = {tf: stage(index_rows(stage(B.time_bars(trades, tf), "bars")), "indexed") for tf in TIMEFRAMES}
    specs = [J.BenchmarkSpec(timeframe=tf, target=target, rolling=ROLL) for tf in TIMEFRAMES for target in J.METRICS]
    return J.benchmark_sweep(bars, specs, list(J.MODELS))


_SWEEP = "symbol:s timeframe:s target:s model:s fee_mode:s accuracy:f8 rmse:f6 strategy_sharpe:f6 turnover:f2"


@query("J13_benchmark_sweep", _SWEEP)
def _(spark, sf):
    return _sweep(spark, sf)


@query("J13_closed_cells", _SWEEP, "SELECT * FROM v_sweep")
def _(spark, sf):
    return _closed_sweep(spark, sf)


@query("J14_fee_pivot", "target:s timeframe:s symbol:s model:s maker:f6 taker:f6")
def _(spark, sf):
    return J.fee_pivot(_sweep(spark, sf))


@query("J14_fee_pivot_closed_cells", "target:s timeframe:s symbol:s model:s maker:f6 taker:f6", """
SELECT target, timeframe, symbol, model, max(strategy_sharpe) FILTER (fee_mode = 'maker') AS maker, max(strategy_sharpe) FILTER (fee_mode = 'taker') AS taker
FROM v_sweep GROUP BY target, timeframe, symbol, model""")
def _(spark, sf):
    return J.fee_pivot(_closed_sweep(spark, sf))


_SERIES = ("click", "error", "purchase", "signup", "view")
_PANELS = {f"{tf}|{s}": f"{s}_{tf}" for tf in TIMEFRAMES for s in _SERIES}


@query("J14_accuracy_pivot", "target:s model:s " + " ".join(f"{name}:f8" for name in _PANELS.values()))
def _(spark, sf):
    return J.accuracy_pivot(_sweep(spark, sf), list(_PANELS)).withColumnsRenamed(_PANELS)


@query("J14_accuracy_pivot_closed_cells", "target:s model:s " + " ".join(f"{s}:f8" for s in _SERIES), f"""
SELECT 'direction' AS target, 'Lag1' AS model, {", ".join(f"max(accuracy) FILTER (symbol = '{s}') AS {s}" for s in _SERIES)}
FROM (SELECT symbol, avg(CASE WHEN (pred > 0.5e0) = (actual > 0.5e0) THEN 1e0 ELSE 0e0 END) AS accuracy FROM v_lag1 GROUP BY 1)""")
def _(spark, sf):
    results = J.evaluate_all(_bars(spark, sf), SPEC, ["Lag1"])
    wide = J.accuracy_pivot(results, [f"1h|{s}" for s in _SERIES])
    return wide.withColumnsRenamed({f"1h|{s}": s for s in _SERIES})


view("v_dir", """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM v_two),
m AS (SELECT symbol, avg(ret_lag1) AS m1 FROM s WHERE k < greatest(10, floor(0.6e0 * n)) GROUP BY 1)
SELECT b.*, coalesce(CASE WHEN s.ret_lag1 > m.m1 THEN 1e0 WHEN s.ret_lag1 IS NOT NULL THEN -1e0 END, 0e0) AS position
FROM v_nbars b LEFT JOIN s ON s.symbol = b.symbol AND s.ts = b.ts AND s.n >= 50 AND s.k >= greatest(10, floor(0.6e0 * n))
LEFT JOIN m ON m.symbol = b.symbol""")


@query("E5_ml_directional", "symbol:s ts:t position:f1", "SELECT * FROM v_dir")
def _(spark, sf):
    return J.ml_directional(_bars(spark, sf), J.make_model("Lag1"), config=TWO)


# Ridge regression on both targets, fitted on the first part of each series and held on the rest.
view("v_split", """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM v_two),
t AS (SELECT *, k < greatest(10, floor(0.6e0 * n)) AS train FROM s WHERE n >= 50),
m AS (SELECT symbol, avg(ret_lag1) AS m1, avg(ret_lag2) AS m2, stddev_pop(ret_lag1) AS s1, stddev_pop(ret_lag2) AS s2 FROM t WHERE train GROUP BY 1),
x AS (SELECT symbol, ts, train, fwd, (ret_lag1 - m1) / CASE WHEN s1 > 0 THEN s1 ELSE 1 END AS x1, (ret_lag2 - m2) / CASE WHEN s2 > 0 THEN s2 ELSE 1 END AS x2
      FROM t JOIN m USING (symbol)),
y AS (SELECT *, 'return' AS target, fwd AS y FROM x UNION ALL SELECT *, 'direction', CASE WHEN fwd > 0 THEN 1e0 ELSE 0e0 END FROM x),
g AS (SELECT symbol, target, avg(x1) AS a1, avg(x2) AS a2, avg(y) AS ay, var_pop(x1) * count(*) + 1 AS c11, var_pop(x2) * count(*) + 1 AS c22,
             covar_pop(x1, x2) * count(*) AS c12, covar_pop(x1, y) * count(*) AS d1, covar_pop(x2, y) * count(*) AS d2 FROM y WHERE train GROUP BY 1, 2),
b AS (SELECT *, (d1 * c22 - d2 * c12) / (c11 * c22 - c12 * c12) AS b1, (d2 * c11 - d1 * c12) / (c11 * c22 - c12 * c12) AS b2 FROM g)
SELECT symbol, target, ts, ay + b1 * (x1 - a1) + b2 * (x2 - a2) AS pred FROM y JOIN b USING (symbol, target) WHERE NOT train""")


@query("E5_ml_directional_ridge", "symbol:s target:s ts:t position:f1", """
SELECT n.symbol, t.target, n.ts, coalesce(CASE WHEN p.pred > t.hi THEN 1e0 WHEN p.pred < t.lo THEN -1e0 END, 0e0) AS position
FROM v_nbars n CROSS JOIN (VALUES ('direction', 0.55e0, 0.45e0), ('return', 0.25e0, -0.25e0)) t(target, hi, lo)
LEFT JOIN v_split p ON p.symbol = n.symbol AND p.ts = n.ts AND p.target = t.target""")
def _(spark, sf):
    """A fitted model on both targets."""
    bars = _bars(spark, sf)
    each = [
        J.ml_directional(bars, J.ridge_regression(), target, direction_band=0.05, return_band=0.25, config=TWO).withColumn("target", F.lit(target))
        for target in ("direction", "return")
    ]
    return reduce(DataFrame.unionByName, each)


@query("J6_registry_predictions", "name:s symbol:s window_id:i ts:t pred:f7 actual:f7", """
WITH g AS (SELECT symbol, window_id, avg(x1) AS a1, avg(x2) AS a2, avg(fwd) AS ay, var_pop(x1) * count(*) + 1 AS c11, var_pop(x2) * count(*) + 1 AS c22,
                  covar_pop(x1, x2) * count(*) AS c12, covar_pop(x1, fwd) * count(*) AS d1, covar_pop(x2, fwd) * count(*) AS d2
           FROM v_scaled WHERE role = 'train' GROUP BY 1, 2),
b AS (SELECT *, (d1 * c22 - d2 * c12) / (c11 * c22 - c12 * c12) AS b1, (d2 * c11 - d1 * c12) / (c11 * c22 - c12 * c12) AS b2 FROM g)
SELECT 'Ridge' AS name, symbol, window_id, ts, ay + b1 * (x1 - a1) + b2 * (x2 - a2) AS pred, fwd AS actual FROM v_scaled JOIN b USING (symbol, window_id) WHERE role = 'test'
UNION ALL SELECT 'Lag1', symbol, window_id, ts, x1, fwd FROM v_scaled WHERE role = 'test'""")
def _(spark, sf):
    """What the closed-form models of the registry predict, by name."""
    bars = _bars(spark, sf)
    each = [J.fit_predict_walkforward(bars, J.make_model(name), "return", ROLL, TWO).withColumn("name", F.lit(name)) for name in ("Lag1", "Ridge")]
    return reduce(DataFrame.unionByName, each)


@query("J6_registry", "name:s rows:i", """
SELECT name, count(*) AS rows FROM v_scaled, (VALUES ('GBT'), ('Lag1'), ('MLP'), ('Ridge')) m(name) WHERE role = 'test' GROUP BY 1""")
def _(spark, sf):
    bars = _bars(spark, sf)
    counts = [
        J.fit_predict_walkforward(bars, J.make_model(name), "return", ROLL, TWO).agg(F.count("*").alias("rows")).withColumn("name", F.lit(name))
        for name in J.MODELS
    ]
    return reduce(DataFrame.unionByName, counts)
