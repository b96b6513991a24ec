"""Timeframes, durations and timestamps as integer microseconds.

The session time zone must be UTC; ``TIMESTAMP`` and ``TIMESTAMP_NTZ`` columns are both accepted.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Supported bar sizes and the number of bars in a 365-day year.
TIMEFRAMES = ("1m", "5m", "15m", "1h", "4h", "1d")
BARS_PER_YEAR = {"1m": 525600, "5m": 105120, "15m": 35040, "1h": 8760, "4h": 2190, "1d": 365}

_UNIT_SECONDS = {"ms": 0.001, "s": 1, "m": 60, "min": 60, "h": 3600, "d": 86400}
_DURATION = re.compile(r"^\s*(\d+)\s*([a-zA-Z]+)\s*$")

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 3600 * SECOND
DAY = 86400 * SECOND


def duration_us(text: str | int) -> int:
    """``"5m"``, ``"30s"``, ``"1min"``, ``"4h"``, ``"1d"`` (or microseconds) -> microseconds."""
    if isinstance(text, int):
        value = text
    else:
        match = _DURATION.match(text)
        if not match or match.group(2).lower() not in _UNIT_SECONDS:
            raise ValueError(f"unknown duration {text!r}")
        value = round(int(match.group(1)) * _UNIT_SECONDS[match.group(2).lower()] * SECOND)
    if value <= 0:
        raise ValueError(f"duration must be positive, got {text!r}")
    return value


def timeframe_seconds(timeframe: str) -> int:
    match = re.match(r"^(\d+)([mhd])$", timeframe)
    if not match:
        raise ValueError(f"{timeframe!r} is no timeframe; a number and m, h or d make one")
    return int(match.group(1)) * _UNIT_SECONDS[match.group(2)]


def bars_per_year(timeframe: str) -> int:
    if timeframe not in BARS_PER_YEAR:
        raise ValueError(f"bars per year are not known for {timeframe!r}, only for {sorted(BARS_PER_YEAR)}")
    return BARS_PER_YEAR[timeframe]


def timeframe_table(spark: SparkSession) -> DataFrame:
    """Dimension table (timeframe, seconds, bars_per_year)."""
    rows = [(t, timeframe_seconds(t), BARS_PER_YEAR[t]) for t in TIMEFRAMES]
    return spark.createDataFrame(rows, "timeframe string, seconds long, bars_per_year long")


def micros(ts: Column | str) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def from_micros(us: Column | str, like: str) -> Column:
    """Microseconds back to a timestamp of type ``like`` (``timestamp`` or ``timestamp_ntz``)."""
    return F.timestamp_micros(us).cast(like)


def ts_type(df: DataFrame, ts: str = "ts") -> str:
    return df.schema[ts].dataType.simpleString()


def floor_us(us: Column, width_us: int) -> Column:
    """Left edge of the epoch-aligned bin, exact in integers."""
    return us - F.pmod(us, F.lit(width_us))


def coerce_epoch(value: Column) -> Column:
    """Integer epoch in s, ms or µs, told apart by size, to TIMESTAMP."""
    return (
        F.when(value < F.lit(10**12), F.timestamp_seconds(value))
        .when(value < F.lit(10**15), F.timestamp_millis(value))
        .otherwise(F.timestamp_micros(value))
    )
