"""Small bar and trade tables for tests."""

import datetime as dt

import numpy as np
import pandas as pd

START = dt.datetime(2024, 1, 1)
BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def times(n, seconds=300):
    return [START + dt.timedelta(seconds=seconds * i) for i in range(n)]


def bars(spark, close, *, open_=None, volume=100.0, symbol="X", seconds=300, at=None):
    close = [float(c) for c in close]
    open_ = close if open_ is None else [float(o) for o in open_]
    vol = [float(volume)] * len(close) if np.isscalar(volume) else [float(v) for v in volume]
    rows = [
        (symbol, t, o, max(o, c) + 1, min(o, c) - 1, c, v)
        for t, o, c, v in zip(at or times(len(close), seconds), open_, close, vol)
    ]
    return spark.createDataFrame(rows, BAR)


def walk(n, seed=0, sigma=0.01, start=100.0):
    return list(start * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, sigma, n))))


def trades(spark, n=500, seed=1, symbol="X", step_ms=100):
    rng = np.random.default_rng(seed)
    price = 100 + np.cumsum(rng.normal(0, 0.01, n))
    rows = [
        (symbol, i, float(price[i]), float(np.round(rng.uniform(0.01, 2), 2)), START + dt.timedelta(milliseconds=step_ms * i), bool(rng.integers(2)))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "symbol string, agg_id long, price double, qty double, ts timestamp_ntz, is_buyer_maker boolean")


def column(df, name, order="ts"):
    values = df.orderBy(order).select(name).toPandas()[name]
    return [None if pd.isna(v) else v for v in values]
