"""Table layouts and their checks.

A check returns rule violations as a table; the strict form raises. "In order" is a property of
values here, not of rows: bars are unique per (series, time), trades do not go back in time as
their ids rise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions import clock
from tapeloom.plans.scan import carry_scan, running
from tapeloom.plans.tiles import KEY

OHLCV = ("open", "high", "low", "close", "volume")
TRADE_FIELDS = ("agg_id", "price", "qty", "first_id", "last_id", "ts", "is_buyer_maker")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_LONG, _DOUBLE, _WHEN = T.LongType(), T.DoubleType(), T.TimestampType()
BARS = _struct(symbol=T.StringType(), ts=_WHEN, **{c: _DOUBLE for c in OHLCV})
TRADES = _struct(
    symbol=T.StringType(), agg_id=_LONG, price=_DOUBLE, qty=_DOUBLE, first_id=_LONG, last_id=_LONG, ts=_WHEN,
    is_buyer_maker=T.BooleanType(),
)
DEPTH = _struct(symbol=T.StringType(), ts=_WHEN, percentage=_DOUBLE, depth=_DOUBLE, notional=_DOUBLE)

_CHUNK = 1_000_000


class SchemaError(ValueError):
    """A table does not have the required columns, types or values."""


def _require(df: DataFrame, types: Mapping[str, tuple[type, ...]], what: str) -> None:
    missing = [c for c in types if c not in df.columns]
    if missing:
        raise SchemaError(f"missing {what} columns: {missing}")
    for name, allowed in types.items():
        if not isinstance(df.schema[name].dataType, allowed):
            raise SchemaError(f"{what} column {name!r} has type {df.schema[name].dataType.simpleString()}")


_TIME = (T.TimestampType, T.TimestampNTZType)


def _counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    one = df.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    cells = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows")) for n in rules])
    return one.select(F.inline(cells))


def check_bars(bars: DataFrame, *, allow_zero_volume: bool = True, key: Sequence[str] = KEY) -> DataFrame:
    """(rule, rows) with the number of offending rows of every rule."""
    _require(bars, {"ts": _TIME, **{c: (T.FloatType, T.DoubleType) for c in OHLCV}}, "bar")
    broken = lambda test, names: _any(*[test(F.col(c)) for c in names])
    rules = {
        "nan": broken(lambda c: c.isNull() | F.isnan(c), OHLCV),
        "infinite": broken(lambda c: F.abs(c) == F.lit(float("inf")), OHLCV),
        "non_positive_price": broken(lambda c: c <= 0, OHLCV[:4]),
        "negative_volume": F.col("volume") < 0,
        "null_time": F.col("ts").isNull(),
    }
    if not allow_zero_volume:
        rules["zero_volume"] = F.col("volume") == 0
    copies = bars.groupBy(*key, "ts").agg(F.count("*").alias("n")).where("n > 1")
    twice = copies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).select(F.lit("duplicate_time").alias("rule"), "rows")
    return _counts(bars, rules).unionByName(twice)


def _any(*tests: Column) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return F.coalesce(out, F.lit(False))


def check_trades(trades: DataFrame, *, key: Sequence[str] = KEY) -> DataFrame:
    """(rule, rows); ``time_order`` compares each trade with all of lower id."""
    numbers = (T.FloatType, T.DoubleType)
    _require(trades, {"agg_id": (T.LongType,), "ts": _TIME, "price": numbers, "qty": numbers, "is_buyer_maker": (T.BooleanType,)}, "trade")
    rules = {"non_positive_price": F.col("price") <= 0, "non_positive_qty": F.col("qty") <= 0, "null_time": F.col("ts").isNull()}
    rows = trades.select(*key, "agg_id", clock.micros("ts").alias("_us"), F.expr(f"agg_id div {_CHUNK}").alias("_chunk"))
    seen = carry_scan(rows, key, "_chunk", ("agg_id",), {"_before": running("max", "_us")}, exclusive=True)
    return _counts(trades, rules).unionByName(_counts(seen, {"time_order": F.col("_us") < F.col("_before")}))


def _strict(df: DataFrame, report: DataFrame) -> DataFrame:
    bad = [(r["rule"], r["rows"]) for r in report.where("rows > 0").collect()]  # one row per rule
    if bad:
        raise SchemaError(", ".join(f"{rule}: {n} rows" for rule, n in bad))
    return df


def validate_bars(bars: DataFrame, *, allow_zero_volume: bool = True, key: Sequence[str] = KEY) -> DataFrame:
    return _strict(bars, check_bars(bars, allow_zero_volume=allow_zero_volume, key=key))


def validate_trades(trades: DataFrame, *, key: Sequence[str] = KEY) -> DataFrame:
    return _strict(trades, check_trades(trades, key=key))
