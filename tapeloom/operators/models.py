"""Predictors fitted per slice (series × walk-forward window), and their evaluation.

A fitted slice is a group of rows sharing the columns ``by``, marked ``train`` or ``test``. The
linear models fit every slice in the same job: their sufficient statistics are sums, so slices of
any size are reduced map-side and only a small system per slice is solved.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions import clock, maths
from tapeloom.operators.backtest import BacktestConfig, Rolling, _extent, run_backtest, trade_log, window_slices
from tapeloom.operators.features import TARGETS, FeatureConfig, align, build_features, scale_split
from tapeloom.operators.signals import predictions_to_positions
from tapeloom.operators.stats import hit_rate, sharpe, total_return
from tapeloom.plans.joins import lookup_join
from tapeloom.plans.scan import carry_scan, running
from tapeloom.plans.stage import stage
from tapeloom.plans.tiles import KEY, index_rows

# Smallest slices that are fitted, and smallest split of a single fit.
MIN_TRAIN_ROWS = 50
MIN_SPLIT = 10

Model = Callable[[DataFrame, Sequence[str], Sequence[str], str], DataFrame]


def lag1(**_) -> Model:
    """The last return repeats: 0.9 / 0.1 by its sign, or the return itself."""

    def fit_predict(rows, columns, by, kind):
        last = F.col(columns[0])
        pred = F.when(last > 0, 0.9).otherwise(0.1) if kind == "direction" else last
        return rows.where("role = 'test'").withColumn("pred", pred)

    return fit_predict


def _linear(columns: Sequence[str], coefficients: str = "_b") -> Column:
    b = F.col(coefficients)
    return reduce(lambda s, ic: s + b[ic[0] + 1] * F.col(ic[1]), enumerate(columns), b[0])


def _gram(terms: Sequence[Column], weight: Column | None = None) -> Column:
    """Aggregate: the upper triangle of Σ w·z·zᵀ, row by row."""
    w = F.lit(1.0) if weight is None else weight
    return F.array(*[F.sum(w * a * b) for i, a in enumerate(terms) for b in terms[i:]])


def _square(flat, m):
    out = np.zeros((m, m))
    out[np.triu_indices(m)] = flat
    return out + np.triu(out, 1).T


def _solver(p: int, alpha: float):
    """Ridge from the Gram matrix of (1, x, y): centred, with an unpenalised intercept."""
    @F.pandas_udf("array<double>")
    def solve(grams: pd.Series) -> pd.Series:
        out = []
        for flat in grams:
            g = _square(flat, p + 2)
            n, sx, sy = g[0, 0], g[0, 1:-1], g[0, -1]
            cxx = g[1:-1, 1:-1] - np.outer(sx, sx) / n
            cxy = g[1:-1, -1] - sx * sy / n
            beta = np.linalg.solve(cxx + alpha * np.eye(p), cxy)
            out.append([float(sy / n - sx @ beta / n), *map(float, beta)])
        return pd.Series(out)

    return solve


def ridge_regression(alpha: float = 1.0, **_) -> Model:
    def fit_predict(rows, columns, by, kind):
        train = rows.where("role = 'train'")
        terms = [F.lit(1.0), *[F.col(c) for c in columns], F.col("y")]
        grams = train.groupBy(*by).agg(_gram(terms).alias("_g"))
        fitted = grams.select(*by, _solver(len(columns), float(alpha))("_g").alias("_b"))
        test = rows.where("role = 'test'")
        return lookup_join(test, fitted, by).withColumn("pred", _linear(columns)).drop("_b")

    return fit_predict


def _newton(p: int, alpha: float):
    @F.pandas_udf("array<double>")
    def step(hessian: pd.Series, gradient: pd.Series, current: pd.Series) -> pd.Series:
        import numpy as np

        penalty = np.diag([0.0] + [alpha] * p)
        out = []
        for h, g, b in zip(hessian, gradient, current):
            b = np.asarray(b, dtype=float)
            move = np.linalg.solve(_square(h, p + 1) + penalty + 1e-12 * np.eye(p + 1), np.asarray(g) + penalty @ b)
            # Far from the solution a full step can overshoot for good.
            out.append((b - move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-300))).tolist())
        return pd.Series(out)

    return step


def logistic_coefficients(
    train: DataFrame, columns: Sequence[str], by: Sequence[str], *, alpha: float = 1.0, tol: float = 1e-9, max_iter: int = 100
) -> DataFrame:
    """L2 logistic regression by Newton steps, all slices at once.

    One step is one aggregate over the training rows of the slices that still move; a slice whose coefficients
    changed by less than ``tol`` is done. The coefficients are a small table that is written after every
    step, so the plan does not grow with the number of steps. Slices that still move after ``max_iter``
    steps raise an error.
    """
    by, p = list(by), len(columns)
    start = F.array(*[F.lit(0.0)] * (p + 1))
    moving = train.groupBy(*by).agg(start.alias("_b"))
    terms = [F.lit(1.0), *[F.col(c) for c in columns]]
    done: list[DataFrame] = []
    for _ in range(max_iter):
        prob = 1 / (1 + F.exp(-_linear(columns)))
        rows = train.join(moving, by).withColumn("_p", prob)
        p_ = F.col("_p")
        sums = rows.groupBy(*by).agg(
            _gram(terms, p_ * (1 - p_)).alias("_h"),
            F.array(*[F.sum((p_ - F.col("y")) * z) for z in terms]).alias("_grad"),
            F.first("_b").alias("_old"),
        )
        change = F.array_max(F.zip_with("_old", "_b", lambda a, b: F.abs(a - b)))
        moved = sums.select(*by, "_old", _newton(p, alpha)("_h", "_grad", "_old").alias("_b")).withColumn("_still", change >= tol)
        moved = stage(moved.select(*by, "_b", "_still"), "newton")
        done.append(moved.where("not _still").select(*by, "_b"))
        moving = moved.where("_still").select(*by, "_b")
        left = moving.count()
        if not left:
            return reduce(DataFrame.unionByName, done)
    raise RuntimeError(f"{left} slices still move after {max_iter} Newton steps")


def ridge_classifier(alpha: float = 1.0, **_) -> Model:
    """Slices whose training rows hold one class only are left out."""

    def fit_predict(rows, columns, by, kind):
        train = rows.where("role = 'train'")
        both = train.groupBy(*by).agg(F.count_distinct("y").alias("_k")).where("_k > 1").select(*by)
        usable = stage(train.join(both, list(by), "left_semi"), "train")
        fitted = logistic_coefficients(usable, columns, by, alpha=max(float(alpha), 1e-9))
        prob = 1 / (1 + F.exp(-_linear(columns)))
        return rows.where("role = 'test'").join(fitted, list(by)).withColumn("pred", prob).drop("_b")

    return fit_predict


def ridge(alpha: float = 1.0, **_) -> Model:
    def fit_predict(rows, columns, by, kind):
        chosen = ridge_classifier(alpha) if kind == "direction" else ridge_regression(alpha)
        return chosen(rows, columns, by, kind)

    return fit_predict


def _per_slice(learn: Callable[[np.ndarray, np.ndarray, str, np.random.Generator], Callable[[np.ndarray], np.ndarray]], seed: int) -> Model:
    """One local fit per slice, all slices in one job.

    A slice holds the bars of one training window and its test window, so a task's group is bounded by
    the window's days and the bar size, however long the series are. Rows are put in time order and the random numbers
    start from the seed alone, so a fit does not depend on the layout.
    """

    def fit_predict(rows, columns, by, kind):
        # Copied here: the function travels to the workers.
        columns = list(columns)
        kept = [f for f in rows.schema.fields if f.name not in columns]
        names = [f.name for f in kept]
        schema = T.StructType([*kept, T.StructField("pred", T.DoubleType())])

        def one(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("ts", kind="stable")
            train, test = group[group["role"] == "train"], group[group["role"] == "test"]
            predict = learn(train[columns].to_numpy(float), train["y"].to_numpy(float), kind, np.random.default_rng(seed))
            return test[names].assign(pred=predict(test[columns].to_numpy(float)))

        return rows.groupBy(*by).applyInPandas(one, schema)

    return fit_predict


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def mlp(hidden_units: tuple[int, ...] = (32,), max_iter: int = 120, learning_rate: float = 0.01, alpha: float = 1e-4, batch: int = 200, seed: int = 0, **_) -> Model:
    """Multilayer perceptron with ReLU layers, trained by Adam on mini-batches; classifier or regressor by target."""

    def learn(x, y, kind, rng):
        sizes = [x.shape[1], *hidden_units, 1]
        bound = [np.sqrt(6 / (a + b)) for a, b in zip(sizes, sizes[1:])]
        params = [p for a, b, r in zip(sizes, sizes[1:], bound) for p in (rng.uniform(-r, r, (a, b)), np.zeros(b))]
        middle, scale = (0.0, 1.0) if kind == "direction" else (y.mean(), y.std() or 1.0)
        target = (y - middle) / scale
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]

        def forward(x):
            layers = [x]
            for i in range(0, len(params), 2):
                z = layers[-1] @ params[i] + params[i + 1]
                layers.append(np.maximum(z, 0) if i + 2 < len(params) else z)
            return layers

        steps = 0
        for _ in range(max_iter):
            for rows in np.array_split(rng.permutation(len(x)), max(1, -(-len(x) // batch))):
                layers = forward(x[rows])
                out = layers[-1][:, 0]
                delta = (((_sigmoid(out) if kind == "direction" else out) - target[rows]) / len(rows))[:, None]
                steps += 1
                for i in range(len(params) - 2, -1, -2):
                    gradients = (layers[i // 2].T @ delta + alpha * params[i] / len(rows), delta.sum(axis=0))
                    delta = (delta @ params[i].T) * (layers[i // 2] > 0)
                    for j, g in zip((i, i + 1), gradients):
                        m, v = moments[j]
                        m += 0.1 * (g - m)
                        v += 0.001 * (g * g - v)
                        params[j] = params[j] - learning_rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)

        def predict(x):
            out = forward(x)[-1][:, 0]
            return _sigmoid(out) if kind == "direction" else middle + scale * out

        return predict

    return _per_slice(learn, seed)


def _grow(bins, gradient, hessian, rows, columns, depth, least, shrink):
    """One regression tree on binned columns, level by level: (column, bin, value) per node of a full binary tree."""
    n_bins = int(bins.max(initial=0)) + 1
    nodes = (1 << (depth + 1)) - 1
    column, cut, value = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)
    at = np.zeros(len(rows), np.int64)
    b, g, h = bins[rows][:, columns], gradient[rows], hessian[rows]
    for level in range(depth + 1):
        first, width = (1 << level) - 1, 1 << level
        local = at - first
        live = local >= 0
        value[first : first + width] = -np.bincount(local[live], g[live], width) / (np.bincount(local[live], h[live], width) + shrink)
        if level == depth:
            break
        place = (local[live][:, None] * len(columns) + np.arange(len(columns))) * n_bins + b[live]
        shape = (width, len(columns), n_bins)
        sums = [np.bincount(place.ravel(), np.repeat(w, len(columns)), width * len(columns) * n_bins).reshape(shape).cumsum(axis=2) for w in (g[live], h[live], np.ones(live.sum()))]
        total = [s[:, :, -1:] for s in sums]
        right = [t - s for t, s in zip(total, sums)]
        gain = sums[0] ** 2 / (sums[1] + shrink) + right[0] ** 2 / (right[1] + shrink) - total[0] ** 2 / (total[1] + shrink)
        gain = np.where((sums[2] >= least) & (right[2] >= least), gain, 0).reshape(width, -1)
        best = gain.argmax(axis=1)
        split = gain[np.arange(width), best] > 1e-12
        column[first : first + width] = np.where(split, columns[best // n_bins], -1)
        cut[first : first + width] = best % n_bins
        down = live & (column[at] >= 0)
        goes_right = bins[rows, np.maximum(column[at], 0)] > cut[at]
        at = np.where(down, 2 * at + 1 + goes_right, np.where(live, -1 - at, at))
    return column, cut, value


def _leaf_values(tree, bins):
    column, cut, value = tree
    at = np.zeros(len(bins), np.int64)
    for _ in range(int(np.log2(len(value) + 1)) - 1):
        inner = column[at] >= 0
        goes_right = bins[np.arange(len(bins)), np.maximum(column[at], 0)] > cut[at]
        at = np.where(inner, 2 * at + 1 + goes_right, at)
    return value[at]


def boosted_trees(
    n_estimators: int = 200, max_depth: int = 4, learning_rate: float = 0.05, subsample: float = 0.8, colsample: float = 0.8,
    min_rows: int = 20, max_bins: int = 64, shrink: float = 1.0, seed: int = 0, **_,
) -> Model:
    """Gradient-boosted trees on quantile bins, with Newton leaf values; classifier or regressor by target."""

    def learn(x, y, kind, rng):
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, max_bins + 1)[1:-1])) for c in x.T]
        binned = lambda x: np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)], axis=1)
        bins, trees = binned(x), []
        start = y.mean()
        if kind == "direction":
            start = min(max(start, 1e-6), 1 - 1e-6)
            start = np.log(start / (1 - start))
        score = np.full(len(y), start)
        for _ in range(n_estimators):
            if kind == "direction":
                p = _sigmoid(score)
                gradient, hessian = p - y, p * (1 - p)
            else:
                gradient, hessian = score - y, np.ones(len(y))
            rows = rng.permutation(len(y))[: max(1, round(subsample * len(y)))]
            columns = np.sort(rng.permutation(x.shape[1])[: max(1, round(colsample * x.shape[1]))])
            trees.append(_grow(bins, gradient, hessian, rows, columns, max_depth, min_rows, shrink))
            score = score + learning_rate * _leaf_values(trees[-1], bins)

        def predict(x):
            bins = binned(x)
            out = start + learning_rate * sum(_leaf_values(t, bins) for t in trees)
            return _sigmoid(out) if kind == "direction" else out

        return predict

    return _per_slice(learn, seed)


MODELS: dict[str, Callable[..., Model]] = {"Lag1": lag1, "Ridge": ridge, "MLP": mlp, "GBT": boosted_trees}


def make_model(name: str, **params) -> Model:
    if name not in MODELS:
        raise KeyError(f"no model is called {name!r}; there are {sorted(MODELS)}")
    return MODELS[name](**params)


# ---- fitting over windows -----------------------------------------------------------------------


def _model_kind(target: str) -> str:
    return "return" if target == "triple_barrier" else target


def training_rows(
    bars: DataFrame, target: str, config: FeatureConfig = FeatureConfig(), *, key: Sequence[str] = KEY, **target_args
) -> DataFrame:
    """Aligned features and target of every bar that has them all."""
    return align(build_features(bars, config, key=key), TARGETS[target](bars, key=key, **target_args), config.columns, key=key)


def fit_predict_walkforward(
    bars: DataFrame,
    model: Model,
    target: str = "direction",
    rolling: Rolling = Rolling(14, 3),
    config: FeatureConfig = FeatureConfig(),
    *,
    key: Sequence[str] = KEY,
    rows: DataFrame | None = None,
) -> DataFrame:
    """Out-of-sample predictions (key, window_id, ts, pred, actual) of every window.

    Slices are half-open. Windows with fewer than 50 training rows or no test row are skipped, and
    scaling is fitted on each window's training rows. ``rows`` may carry prepared training rows.
    """
    key = list(key)
    by = [*key, "window_id"]
    rows = training_rows(bars, target, config, key=key) if rows is None else rows
    scaled = scaled_slices(rows, _extent(bars, key), rolling, config.columns, key=key)
    out = model(scaled, config.columns, by, _model_kind(target))
    return out.select(*by, "ts", "pred", F.col("y").alias("actual"))


def scaled_slices(rows: DataFrame, extent: DataFrame, rolling: Rolling, columns: Sequence[str], *, key: Sequence[str] = KEY) -> DataFrame:
    """Rows once per window and role, scaled on each window's training rows; windows that are too small are left out."""
    by = [*key, "window_id"]
    slices = stage(window_slices(rows, rolling, key=key, inclusive=False, extent=extent), "slices")
    train, test = (F.count_if(F.col("role") == r) for r in ("train", "test"))
    usable = slices.groupBy(*by).agg(train.alias("_a"), test.alias("_b"))
    usable = usable.where((F.col("_a") >= MIN_TRAIN_ROWS) & (F.col("_b") >= 1)).select(*by)
    return scale_split(lookup_join(slices, usable, by, "left_semi"), columns, by=by)


def ml_directional(
    bars: DataFrame,
    model: Model,
    target: str = "direction",
    train_fraction: float = 0.6,
    direction_band: float = 0.0,
    return_band: float = 0.0,
    config: FeatureConfig = FeatureConfig(),
    *,
    key: Sequence[str] = KEY,
) -> DataFrame:
    """Fit on the first part of each series, hold the predicted side on the rest, flat elsewhere."""
    if not 0.1 <= train_fraction < 1.0:
        raise ValueError(f"train_fraction is {train_fraction}; 0.1 up to, not including, 1 is possible")
    key = list(key)
    rows = stage(index_rows(training_rows(bars, target, config, key=key), key), "rows")
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    split = F.greatest(F.lit(MIN_SPLIT), F.floor(F.lit(train_fraction) * F.col("_n")))
    marked = lookup_join(rows, sizes.where(F.col("_n") >= 50), key).withColumn("role", F.when(F.col("rn") < split, "train").otherwise("test"))
    scaled = scale_split(marked.drop("rn", "_n"), config.columns, by=key)
    preds = model(scaled, config.columns, key, _model_kind(target))
    position = predictions_to_positions("pred", target, direction_band=direction_band, return_band=return_band)
    placed = preds.select(*key, "ts", position.alias("position"))
    return bars.join(placed, [*key, "ts"], "left").withColumn("position", F.coalesce("position", F.lit(0.0)))


# ---- metrics ------------------------------------------------------------------------------------


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    precision = F.when(tp + fp > 0, maths.div(tp, tp + fp)).otherwise(F.lit(0.0))
    recall = F.when(tp + fn > 0, maths.div(tp, tp + fn)).otherwise(F.lit(0.0))
    both = precision + recall
    return F.when(both > 0, 2 * precision * recall / F.when(both > 0, both)).otherwise(F.lit(0.0))


def classification_metrics(preds: DataFrame, *, key: Sequence[str] = KEY) -> DataFrame:
    """n_test, accuracy, F1 and AUC at the cut 0.5; AUC is NULL with a single class.

    AUC counts ties as one half. Equal predictions are added up before the shuffle and the ranks
    come from a scan over 4096 slices of the unit interval, so no series is sorted in one task.
    """
    key = list(key)
    p, a = F.col("pred") > 0.5, F.col("actual") > 0.5
    count = lambda c: F.count_if(c).cast("double")
    tp, fp, fn = count(p & a), count(p & ~a), count(~p & a)
    base = preds.groupBy(*key).agg(
        F.count("*").cast("double").alias("n_test"), F.avg((p == a).cast("double")).alias("accuracy"), _f1(tp, fp, fn).alias("f1")
    )
    ties = preds.groupBy(*key, "pred").agg(F.count("*").cast("double").alias("_n"), count(a).alias("_pos"))
    cell = F.floor(F.least(F.greatest(F.col("pred"), F.lit(0.0)), F.lit(1.0)) * 4096)
    ranked = carry_scan(ties.withColumn("_cell", cell), key, "_cell", ("pred",), {"_below": running("sum", "_n")}, exclusive=True)
    rank = F.coalesce("_below", F.lit(0.0)) + (F.col("_n") + 1) / 2
    sums = ranked.groupBy(*key).agg(F.sum(F.col("_pos") * rank).alias("_r"), F.sum("_pos").alias("_p"), F.sum("_n").alias("_t"))
    auc = maths.div(F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2, F.col("_p") * (F.col("_t") - F.col("_p")))
    return base.join(sums.select(*key, auc.alias("auc")), key)


def triple_barrier_metrics(preds: DataFrame, *, key: Sequence[str] = KEY) -> DataFrame:
    """Sign accuracy and F1 over rows that hit a barrier, and the share that did not."""
    p, a = F.signum("pred"), F.signum("actual")
    hit = F.col("actual") != 0
    count = lambda c: F.count_if(c).cast("double")
    tp, fp, fn = count((p == 1) & (a == 1)), count((p == 1) & (a == -1)), count((p == -1) & (a == 1))
    none = F.lit(None).cast("double")
    return preds.groupBy(*key).agg(
        F.count("*").cast("double").alias("n_test"),
        F.avg(F.when(hit, (p == a).cast("double"))).alias("accuracy"),
        F.when(F.count_if(hit) > 0, _f1(tp, fp, fn)).alias("f1"),
        none.alias("auc"),
        (1 - F.avg(hit.cast("double"))).alias("timeout_frac"),
    )


def regression_metrics(preds: DataFrame, *, key: Sequence[str] = KEY) -> DataFrame:
    err = F.col("pred") - F.col("actual")
    n = F.count("*")
    spread = F.var_pop("actual") * n
    return preds.groupBy(*key).agg(
        n.cast("double").alias("n_test"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.when(spread > 0, 1 - maths.div(F.sum(err * err), spread)).alias("r2"),
    )


def strategy_metrics(
    bars: DataFrame, positions: DataFrame, config: BacktestConfig, bars_per_year: int, *, key: Sequence[str] = KEY, cost: Column | None = None
) -> DataFrame:
    """Backtest figures of a position table; bars without a position are flat. ``cost`` is that of ``run_backtest``."""
    key = list(key)
    twice = F.raise_error(F.lit("several positions for one bar: overlapping test windows need a rule of their own"))
    single = positions.groupBy(*key, "ts").agg(F.max("position").alias("position"), F.count("*").alias("_n"))
    single = single.select(*key, "ts", F.when(F.col("_n") == 1, F.col("position")).otherwise(twice).alias("position"))
    held = bars.join(single, [*key, "ts"], "left")
    held = held.withColumn("position", F.coalesce("position", F.lit(0.0)))
    result = stage(run_backtest(held, config, key=key, cost=cost), "backtest")
    moved = F.when(F.col("rn") > 0, F.abs(F.col("raw_position") - F.col("position"))).otherwise(0.0)
    out = result.groupBy(*key).agg(
        F.max(F.abs("raw_position")).alias("_any"),
        F.coalesce(sharpe("net_return", bars_per_year), F.lit(0.0)).alias("strategy_sharpe"),
        total_return("equity").alias("strategy_total_return"),
        F.min("drawdown").alias("strategy_max_drawdown"),
        F.sum(moved).alias("turnover"),
    )
    trades = trade_log(result, key=key).groupBy(*key).agg(hit_rate("pnl_pct").alias("strategy_hit_rate"))
    out = out.join(trades, key, "left")
    idle = F.col("_any") == 0
    zero = lambda c: F.when(idle, F.lit(0.0)).otherwise(F.col(c)).alias(c)
    return out.select(
        *key, zero("strategy_sharpe"), zero("strategy_total_return"), zero("strategy_max_drawdown"),
        F.when(~idle, F.col("strategy_hit_rate")).alias("strategy_hit_rate"), zero("turnover"),
    )


# ---- benchmark ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class BenchmarkSpec:
    timeframe: str = "5m"
    target: str = "direction"
    features: FeatureConfig = field(default_factory=FeatureConfig)
    rolling: Rolling = Rolling(14, 3)
    backtest: BacktestConfig = BacktestConfig(execution="next_close")
    direction_band: float = 0.05
    return_band: float = 0.0
    bars_per_year: int | None = None


METRICS = {
    "direction": classification_metrics,
    "triple_barrier": triple_barrier_metrics,
    "return": regression_metrics,
}


def evaluate_one(
    bars: DataFrame, spec: BenchmarkSpec, model_name: str | None, *, model: Model | None = None, key: Sequence[str] = KEY,
    preds: DataFrame | None = None,
) -> DataFrame:
    """One row per series: keys, prediction metrics and strategy metrics. Without a name, ``model`` is part of the key."""
    key = list(key)
    if preds is None:
        fitted = fit_predict_walkforward(bars, model or make_model(model_name), spec.target, spec.rolling, spec.features, key=key)
        preds = stage(fitted, "predictions")
    position = predictions_to_positions(
        "pred", spec.target, direction_band=spec.direction_band, return_band=spec.return_band
    )
    bpy = spec.bars_per_year or clock.bars_per_year(spec.timeframe)
    figures = strategy_metrics(bars, preds.withColumn("position", position), spec.backtest, bpy, key=key)
    labels = {
        "timeframe": spec.timeframe, "target": spec.target, "fee_mode": "maker" if spec.backtest.assume_maker else "taker",
    } | ({"model": model_name} if model_name is not None else {})
    measured = METRICS[spec.target](preds, key=key)
    both = figures.join(measured, key, "left").withColumn("n_test", F.coalesce("n_test", F.lit(0.0)))
    return both.withColumns({n: F.lit(v) for n, v in labels.items()})


def evaluate_all(
    bars: DataFrame, spec: BenchmarkSpec, models: Mapping[str, Model] | Sequence[str] | None = None, *, key: Sequence[str] = KEY
) -> DataFrame:
    chosen = models if isinstance(models, Mapping) else {n: make_model(n) for n in (models or MODELS)}
    ready = stage(training_rows(bars, spec.target, spec.features, key=key), "rows")
    rows = []
    for name, model in chosen.items():
        fitted = fit_predict_walkforward(bars, model, spec.target, spec.rolling, spec.features, key=key, rows=ready)
        rows.append(evaluate_one(bars, spec, name, preds=stage(fitted, "predictions"), key=key))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def benchmark_sweep(
    bars_by_timeframe: Mapping[str, DataFrame],
    specs: Sequence[BenchmarkSpec],
    models: Mapping[str, Model] | Sequence[str],
    *,
    fee_modes: Sequence[str] = ("taker", "maker"),
    key: Sequence[str] = KEY,
) -> DataFrame:
    """symbol × timeframe × target × fee mode × model, as columns of the key.

    Specs that differ in timeframe and target only run together: one table of scaled slices, one fit per model and kind of
    target over all of them, and one backtest of all cells. The number of jobs does not depend on the number of cells.
    """
    chosen = models if isinstance(models, Mapping) else {n: make_model(n) for n in models}
    groups: list[list[BenchmarkSpec]] = []
    for spec in specs:
        own = next((g for g in groups if replace(g[0], timeframe="", target="", bars_per_year=None) == replace(spec, timeframe="", target="", bars_per_year=None)), None)
        if own is None:
            groups.append([spec])
        else:
            own.append(spec)
    swept = [_stacked_sweep(bars_by_timeframe, g, chosen, list(fee_modes), list(key)) for g in groups]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), swept)


def _stacked_sweep(bars_by_timeframe: Mapping[str, DataFrame], specs: list[BenchmarkSpec], models: Mapping[str, Model], fee_modes: list[str], key: list[str]) -> DataFrame:
    spec, cells = specs[0], {(s.timeframe, s.target): s for s in specs}
    timeframes, targets = sorted({t for t, _ in cells}), sorted({t for _, t in cells})
    series, panel = [*key, "timeframe"], [*key, "timeframe", "target"]
    wanted = F.concat_ws("|", "timeframe", "target").isin(["|".join(c) for c in cells])
    literals = lambda names: F.explode(F.array(*map(F.lit, names)))
    bars = stage(reduce(DataFrame.unionByName, [bars_by_timeframe[t].withColumn("timeframe", F.lit(t)) for t in timeframes]), "bars")

    columns = spec.features.columns
    features = stage(build_features(bars, spec.features, key=series), "features")
    rows = [align(features, TARGETS[t](bars, key=series), columns, key=series).withColumn("target", F.lit(t)) for t in targets]
    extent = _extent(bars, series).withColumn("target", literals(targets))
    scaled = stage(scaled_slices(reduce(DataFrame.unionByName, rows).where(wanted), extent, spec.rolling, columns, key=panel), "scaled")
    kinds = {kind: [t for t in targets if _model_kind(t) == kind] for kind in dict.fromkeys(map(_model_kind, targets))}
    fitted = [
        model(scaled.where(F.col("target").isin(own)), columns, [*panel, "window_id"], kind)
        .select(*panel, "window_id", "ts", "pred", F.col("y").alias("actual"), F.lit(name).alias("model"))
        for name, model in models.items() for kind, own in kinds.items()
    ]
    preds = stage(reduce(DataFrame.unionByName, fitted), "predictions")

    bands = {"direction_band": spec.direction_band, "return_band": spec.return_band}
    position = F.lit(None).cast("double")
    for t in targets:
        position = F.when(F.col("target") == t, predictions_to_positions("pred", t, **bands)).otherwise(position)
    cell = [*panel, "model", "fee_mode"]
    each = bars.withColumn("target", literals(targets)).where(wanted).withColumn("model", literals(models)).withColumn("fee_mode", literals(fee_modes))
    held = preds.withColumn("position", position).withColumn("fee_mode", literals(fee_modes))
    cost = F.lit(None).cast("double")
    for mode in fee_modes:
        cost = F.when(F.col("fee_mode") == mode, F.lit(replace(spec.backtest, assume_maker=mode == "maker").cost)).otherwise(cost)
    figures = strategy_metrics(each, held, spec.backtest, 1, key=cell, cost=cost)
    yearly = F.lit(None).cast("double")
    for (timeframe, target), s in cells.items():
        here = (F.col("timeframe") == timeframe) & (F.col("target") == target)
        yearly = F.when(here, F.lit(math.sqrt(s.bars_per_year or clock.bars_per_year(timeframe)))).otherwise(yearly)
    figures = figures.withColumn("strategy_sharpe", F.col("strategy_sharpe") * yearly)
    scored = [METRICS[t](preds.where(F.col("target") == t), key=[*panel, "model"]) for t in targets]
    measured = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scored)
    return stage(figures.join(measured, [*panel, "model"], "left").withColumn("n_test", F.coalesce("n_test", F.lit(0.0))), "figures")


def accuracy_pivot(results: DataFrame, panels: Sequence[str] | None = None, *, key: Sequence[str] = KEY) -> DataFrame:
    """Mean accuracy by model and panel (timeframe|series), taker fees."""
    panel = F.concat_ws("|", "timeframe", *key)
    taker = results.where("fee_mode = 'taker'").withColumn("panel", panel).groupBy("target", "model")
    return taker.pivot("panel", list(panels) if panels else None).agg(F.avg("accuracy"))


def fee_pivot(results: DataFrame, *, key: Sequence[str] = KEY) -> DataFrame:
    """Mean strategy Sharpe ratio by fee mode."""
    grouped = results.groupBy("target", "timeframe", *key, "model")
    return grouped.pivot("fee_mode", ["maker", "taker"]).agg(F.avg("strategy_sharpe"))


__all__ = [
    "BenchmarkSpec", "MODELS", "accuracy_pivot", "benchmark_sweep", "boosted_trees", "classification_metrics",
    "evaluate_all", "evaluate_one", "fee_pivot", "fit_predict_walkforward", "lag1", "logistic_coefficients",
    "make_model", "ml_directional", "mlp", "regression_metrics", "ridge", "ridge_classifier", "ridge_regression",
    "strategy_metrics", "training_rows", "triple_barrier_metrics",
]
