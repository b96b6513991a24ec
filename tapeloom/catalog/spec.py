"""How a query and its SQL counterpart are put side by side.

Both results pass through the same projection, built from a column list such as
``"symbol:s ts:t close:f4 n:i"``: s text, i integer, b boolean, t timestamp, fN a double kept to
N decimals, eN a double kept to N significant digits (infinities pass).
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Values with few decimals never lie this far between two steps, so tiny differences in the last
# bit do not flip the rounding as they would at one half.
_OFF_CENTRE = 0.3719

_REGISTRY: dict[str, Query] = {}
_VIEWS: dict[str, str] = {}
_MODULES = ("data", "bars", "micro", "book", "signals", "backtest", "stats", "quality", "features", "models", "streams")


@dataclass(frozen=True)
class Query:
    name: str
    columns: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None

    @property
    def fields(self) -> list[tuple[str, str]]:
        return [tuple(c.split(":")) for c in self.columns.split()]

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        out = self.build(spark, folder)
        return out.select(*[_spark_column(F.col(n), t).alias(n) for n, t in self.fields])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        picked = ", ".join(f'{_sql_column(f'"{n}"', t)} AS "{n}"' for n, t in self.fields)
        body = f"_result AS ({self.sql.strip()})"
        views = _needed(self.sql)
        return f"WITH RECURSIVE {', '.join([*views, body])} SELECT {picked} FROM _result"


def _spark_column(c: Column, code: str) -> Column:
    if code[0] in "fe":
        x, digits = c.cast("double"), int(code[1:])
        if code[0] == "f":
            step = F.lit(10.0**digits)
            return F.floor(x * step + F.lit(_OFF_CENTRE)) / step
        power = (digits - 1 - F.floor(F.log10(F.abs(x)))).cast("int")
        whole = F.floor(x * F.pow(F.lit(10.0), power.cast("double")) + F.lit(_OFF_CENTRE)).cast("bigint")
        # Reading the decimal text gives the same double in every engine; a product of powers may not.
        kept = F.concat(whole.cast("string"), F.lit("e"), (-power).cast("string")).cast("double")
        return F.when((x == 0) | (F.abs(x) == F.lit(float("inf"))), x).otherwise(kept)
    return c.cast({"s": "string", "i": "bigint", "b": "boolean", "t": "timestamp_ntz"}[code])


def _sql_column(name: str, code: str) -> str:
    if code[0] in "fe":
        x, digits = f"CAST({name} AS DOUBLE)", int(code[1:])
        if code[0] == "f":
            return f"floor({x} * 1e{digits} + {_OFF_CENTRE}e0) / 1e{digits}"
        power = f"CAST({digits - 1} - floor(log10(abs({x}))) AS INT)"
        whole = f"CAST(floor({x} * pow(10e0, {power}) + {_OFF_CENTRE}e0) AS BIGINT)"
        return (
            f"CASE WHEN {x} = 0 OR isinf({x}) THEN {x} "
            f"ELSE CAST({whole} || 'e' || -{power} AS DOUBLE) END"
        )
    return f"CAST({name} AS {({'s': 'VARCHAR', 'i': 'BIGINT', 'b': 'BOOLEAN', 't': 'TIMESTAMP'}[code])})"


def view(name: str, sql: str) -> str:
    """Register a named SQL subquery (``v_...``) that query texts may refer to."""
    _VIEWS[name] = sql.strip()
    return name


def _needed(sql: str, seen: dict[str, str] | None = None) -> list[str]:
    seen = {} if seen is None else seen
    for name in re.findall(r"\bv_\w+", sql):
        if name not in seen:
            _needed(_VIEWS[name], seen)
            seen[name] = f"{name} AS MATERIALIZED ({_VIEWS[name]})"
    return list(seen.values())


def query(name: str, columns: str, sql: str | None = None):
    """Decorator: register ``build(spark, folder)`` under ``name``."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        _REGISTRY[name] = Query(name, columns, build, sql)
        return build

    return add


def all_queries() -> dict[str, Query]:
    for module in _MODULES:
        importlib.import_module(f"tapeloom.catalog.{module}")
    return dict(_REGISTRY)
