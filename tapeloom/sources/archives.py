"""Exchange archives: headed or headless CSV, plain or zipped, to typed tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.clock import coerce_epoch

# Raw column orders of the two archive kinds.
TRADE_COLUMNS = ("agg_id", "price", "qty", "first_id", "last_id", "ts", "is_buyer_maker", "is_best_match")
DEPTH_COLUMNS = ("ts", "percentage", "depth", "notional")

# Names that the first (or, for depth, second) column of a header line carries.
TRADE_HEADERS = ("agg_id", "agg_trade_id", "aggregate tradeid", "a")
DEPTH_HEADERS = ("percentage",)

_LINES_PER_BATCH = 50_000


def slug(symbol: str) -> str:
    """``btc/usdt`` -> ``BTCUSDT``."""
    return symbol.replace("/", "").upper()


def _number(c: str, kind: str = "double") -> Column:
    return F.expr(f"try_cast(`{c}` AS {kind})")


def _is_header(column: str, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(F.trim(F.col(column))).isin(*names), F.lit(False))


def _flag(c: str) -> Column:
    text = F.lower(F.trim(c))
    return F.when(text == "true", True).when(text == "false", False)


def _reason(parsed: dict[str, Column]) -> Column:
    """The first column of a line that does not parse, or null."""
    return F.coalesce(*[F.when(value.isNull(), F.lit(name)) for name, value in parsed.items()])


def _trade_reason() -> Column:
    numbers = {c: _number(c, "bigint" if c in ("agg_id", "ts") else "double") for c in ("agg_id", "price", "qty", "ts")}
    return _reason(numbers | {"is_buyer_maker": _flag("is_buyer_maker")})


def _depth_reason() -> Column:
    return _reason({"ts": F.try_to_timestamp(F.col("ts"))} | {c: _number(c) for c in DEPTH_COLUMNS[1:]})


def _sound(raw: DataFrame, header: Column, reason: Column, bad: str) -> DataFrame:
    """Lines but for headers; one that does not parse fails the job, or with ``bad="skip"`` is left to the rejects."""
    if bad not in ("raise", "skip"):
        raise ValueError(f"bad lines are to be raised or skipped, not {bad!r}")
    lines = raw.where(~header)
    if bad == "skip":
        return lines.where(reason.isNull())
    message = F.concat(F.lit("an archive line does not parse, column "), reason)
    return lines.where(F.when(reason.isNull(), F.lit(True)).otherwise(F.raise_error(message)))


def trade_rejects(raw: DataFrame) -> DataFrame:
    """Trade lines that do not parse, as text, with ``reason``, the first column at fault."""
    return raw.where(~_is_header("agg_id", TRADE_HEADERS)).withColumn("reason", _trade_reason()).where("reason is not null")


def depth_rejects(raw: DataFrame) -> DataFrame:
    return raw.where(~_is_header("percentage", DEPTH_HEADERS)).withColumn("reason", _depth_reason()).where("reason is not null")


def parse_trades(raw: DataFrame, bad: str = "raise") -> DataFrame:
    """Text columns to typed aggregated trades without header lines. First and last ids may be missing."""
    extra = [c for c in raw.columns if c not in TRADE_COLUMNS]
    return _sound(raw, _is_header("agg_id", TRADE_HEADERS), _trade_reason(), bad).select(
        *extra,
        _number("agg_id", "bigint").alias("agg_id"),
        _number("price").alias("price"),
        _number("qty").alias("qty"),
        _number("first_id", "bigint").alias("first_id"),
        _number("last_id", "bigint").alias("last_id"),
        coerce_epoch(_number("ts", "bigint")).alias("ts"),
        _flag("is_buyer_maker").alias("is_buyer_maker"),
    )


def parse_depth(raw: DataFrame, bad: str = "raise") -> DataFrame:
    """Text columns to typed depth rows without header lines."""
    extra = [c for c in raw.columns if c not in DEPTH_COLUMNS]
    return _sound(raw, _is_header("percentage", DEPTH_HEADERS), _depth_reason(), bad).select(
        *extra, F.to_timestamp("ts").alias("ts"), *[_number(c).alias(c) for c in DEPTH_COLUMNS[1:]]
    )


def _text_schema(columns: tuple[str, ...]) -> str:
    return ", ".join(f"{c} string" for c in columns)


def raw_trades_csv(spark: SparkSession, path: str) -> DataFrame:
    """The text columns as they stand, for ``parse_trades`` and ``trade_rejects``."""
    return spark.read.schema(_text_schema(TRADE_COLUMNS)).csv(path)


def read_trades_csv(spark: SparkSession, path: str, bad: str = "raise") -> DataFrame:
    return parse_trades(raw_trades_csv(spark, path), bad)


def read_depth_csv(spark: SparkSession, path: str, bad: str = "raise") -> DataFrame:
    return parse_depth(spark.read.schema(_text_schema(DEPTH_COLUMNS)).csv(path), bad)


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                names = archive.namelist()
                if not names:
                    raise ValueError(f"empty zip archive: {path}")
                with archive.open(names[0]) as member:
                    lines = io.TextIOWrapper(member, encoding="utf-8")
                    while chunk := [line.rstrip("\r\n") for _, line in zip(range(_LINES_PER_BATCH), lines)]:
                        yield pd.DataFrame({"path": path, "line": [c for c in chunk if c]})


def unzip_lines(files: DataFrame) -> DataFrame:
    """(path, content) rows to (path, line) of each archive's first member; files run in parallel.

    A member is decompressed as a stream, so a task holds one compressed archive and one batch of
    lines.
    """
    return files.select("path", "content").mapInPandas(_unzip, "path string, line string")


def read_zips(spark: SparkSession, path: str) -> DataFrame:
    return unzip_lines(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path))


def _fields(lines: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    parts = F.split("line", ",")
    symbol = F.regexp_extract("path", r"([^/]+?)-(?:aggTrades|bookDepth)-", 1)
    return lines.select(symbol.alias("symbol"), *[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def zipped_trades(lines: DataFrame, bad: str = "raise") -> DataFrame:
    """Lines of ``<SYMBOL>-aggTrades-<date>.zip`` to typed trades with their symbol."""
    return parse_trades(_fields(lines, TRADE_COLUMNS), bad)


def zipped_depth(lines: DataFrame, bad: str = "raise") -> DataFrame:
    return parse_depth(_fields(lines, DEPTH_COLUMNS), bad)


__all__ = [
    "DEPTH_COLUMNS", "TRADE_COLUMNS", "depth_rejects", "parse_depth", "parse_trades", "raw_trades_csv", "read_depth_csv",
    "read_trades_csv", "read_zips", "slug", "trade_rejects", "unzip_lines", "zipped_depth", "zipped_trades",
]
