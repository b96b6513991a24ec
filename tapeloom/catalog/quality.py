"""Data quality. The bars are bent on purpose so that every check finds something."""

from pyspark.sql import functions as F

from tapeloom.catalog import views as _views  # noqa: F401  (shared views)
from tapeloom.catalog.spec import query, view
from tapeloom.operators import quality as Q
from tapeloom.plans.stage import stage
from tapeloom.plans.tiles import index_rows
from tapeloom.sources import testtables as T

WINDOW, Z = 24, 2.0

view("v_bent", """
SELECT symbol, ts, open, CASE WHEN trades = 3 THEN low / 2 ELSE high END AS high, low, CASE WHEN trades = 5 THEN high * 2 ELSE close END AS close,
       CASE WHEN trades = 4 THEN 0 ELSE volume END AS volume FROM v_bars""")
view("v_nbent", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM v_bent")


def bent(spark, sf):
    n = F.col("trades")
    return T.hourly_bars(spark, sf).select(
        "symbol", "ts", "open",
        F.when(n == 3, F.col("low") / 2).otherwise(F.col("high")).alias("high"),
        "low",
        F.when(n == 5, F.col("high") * 2).otherwise(F.col("close")).alias("close"),
        F.when(n == 4, F.lit(0.0)).otherwise(F.col("volume")).alias("volume"),
    )


def indexed(spark, sf):
    return index_rows(stage(bent(spark, sf), "bent"))


_REASON = """concat_ws(',', CASE WHEN low > high THEN 'low>high' END, CASE WHEN open < low OR open > high THEN 'open_oob' END,
       CASE WHEN close < low OR close > high THEN 'close_oob' END)"""
view("v_h1", f"SELECT *, {_REASON} AS reason FROM v_bent WHERE {_REASON} <> ''")
view("v_h2", """
SELECT *, CAST(floor(date_diff('microsecond', previous, ts) / 1000000) AS BIGINT) AS gap_seconds
FROM (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY rn) AS previous FROM v_nbent)
WHERE date_diff('microsecond', previous, ts) > 1.5 * 3600 * 1000000""")
view("v_h4", "SELECT * FROM v_bent WHERE volume = 0")


def _outlier_sql(value: str) -> str:
    return f"""
SELECT *, CASE WHEN sd > 0 THEN (x - mu) / sd WHEN x > mu THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END AS z_score FROM (
  SELECT *, CASE WHEN count(x) OVER w >= {WINDOW // 2} THEN avg(x) OVER w END AS mu,
         CASE WHEN count(x) OVER w >= {WINDOW // 2} THEN stddev_samp(x) OVER w END AS sd FROM (SELECT *, {value} AS x FROM v_nbent)
  WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING))
WHERE CASE WHEN sd > 0 THEN abs(x - mu) / sd > {Z}e0 WHEN sd = 0 THEN x <> mu ELSE false END"""


view("v_h5", _outlier_sql("volume"))
view("v_h6", _outlier_sql("close / lag(close) OVER (PARTITION BY symbol ORDER BY rn) - 1"))
view("v_h7", """
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY symbol, run) AS run_length FROM (
  SELECT *, rn - row_number() OVER (PARTITION BY symbol ORDER BY rn) AS run FROM v_nbent WHERE open = high AND high = low AND low = close))
WHERE run_length >= 2""")
_BAR = "symbol:s ts:t open:f4 high:f4 low:f4 close:f4 volume:f6"


@query("H1_ohlc_invariants", _BAR + " reason:s", "SELECT * FROM v_h1")
def _(spark, sf):
    return Q.ohlc_invariants(bent(spark, sf))


@query("H2_gaps", "symbol:s ts:t previous:t gap_seconds:i", "SELECT * FROM v_h2")
def _(spark, sf):
    return Q.gaps(indexed(spark, sf), "1h")


view("v_pages", """
SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_totalprice AS close, o_orderkey FROM orders""")


@query("H3_duplicates", "symbol:s ts:t o_orderkey:i close:f2",
       "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY symbol, ts) AS n FROM v_pages) WHERE n > 1")
def _(spark, sf):
    rows = T.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), "o_orderkey", F.col("o_totalprice").alias("close")
    )
    return Q.duplicates(rows)


@query("H4_zero_volume", _BAR, "SELECT * FROM v_h4")
def _(spark, sf):
    return Q.zero_volume(bent(spark, sf))


@query("H5_volume_outliers", _BAR + " z_score:e8", "SELECT * FROM v_h5")
def _(spark, sf):
    return Q.volume_outliers(indexed(spark, sf), window=WINDOW, z_threshold=Z)


@query("H6_return_outliers", _BAR + " return:e8 z_score:e8", 'SELECT *, x AS "return" FROM v_h6')
def _(spark, sf):
    return Q.return_outliers(indexed(spark, sf), window=WINDOW, z_threshold=Z)


@query("H7_stale_quotes", _BAR + " run_length:i", "SELECT * FROM v_h7")
def _(spark, sf):
    return Q.stale_quotes(indexed(spark, sf), min_run=2)


view("v_findings", """
SELECT symbol, ts, 'ohlc_invariants' AS "check", reason, NULL::DOUBLE AS z_score, NULL::BIGINT AS gap_seconds, NULL::BIGINT AS run_length FROM v_h1 UNION ALL
SELECT symbol, ts, 'gaps', NULL, NULL, gap_seconds, NULL FROM v_h2 UNION ALL
SELECT symbol, ts, 'zero_volume', NULL, NULL, NULL, NULL FROM v_h4 UNION ALL
SELECT symbol, ts, 'volume_outliers', 'volume_outlier', z_score, NULL, NULL FROM v_h5 UNION ALL
SELECT symbol, ts, 'return_outliers', 'return_outlier', z_score, NULL, NULL FROM v_h6 UNION ALL
SELECT symbol, ts, 'stale_quotes', 'stale_quote', NULL, NULL, run_length FROM v_h7""")
view("v_summary", f"""
SELECT s.symbol, c."check", count(f.ts) AS rows_flagged
FROM (SELECT DISTINCT symbol FROM v_bent) s, (SELECT unnest([{', '.join(repr(c) for c in Q.CHECKS)}]) AS "check") c
LEFT JOIN v_findings f ON f.symbol = s.symbol AND f."check" = c."check" GROUP BY 1, 2""")


def _found(bars):
    return Q.findings(bars, "1h", outlier_window=WINDOW, z_threshold=Z, stale_run=2)


@query("H8_severity", "symbol:s findings:i severity:s", """
SELECT symbol, sum(rows_flagged) AS findings, CASE WHEN sum(rows_flagged) = 0 THEN 'clean'
       WHEN sum(rows_flagged) FILTER ("check" IN ('ohlc_invariants', 'duplicates')) > 0 OR sum(rows_flagged) > 100 THEN 'major' ELSE 'minor' END AS severity
FROM v_summary GROUP BY 1""")
def _(spark, sf):
    bars = indexed(spark, sf)
    return Q.severity(Q.summary(_found(bars), bars))


view("v_kinds", """
SELECT symbol || '-' || kind AS symbol, TIMESTAMP '2024-01-01' + to_hours(CAST(rn AS INT)) AS ts, rn, kind, n
FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM v_nbars), (VALUES ('clean'), ('gappy'), ('doubled'), ('idle')) k(kind)""")


def kinds(spark, sf):
    """Per series one without findings, one with few gaps, one with doubled bars of different prices, one often without volume."""
    every = T.indexed_hourly_bars(spark, sf).withColumn("kind", F.explode(F.array(*map(F.lit, ("clean", "gappy", "doubled", "idle")))))
    at, twice = F.col("rn"), (F.col("kind") == "doubled") & (F.col("rn") % 50 == 0)
    regular = every.select(
        F.concat_ws("-", "symbol", "kind").alias("symbol"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(rn as int))").alias("ts"),
        F.lit(100.0).alias("open"), F.lit(103.0).alias("high"), F.lit(99.0).alias("low"), F.explode(F.when(twice, F.array(F.lit(101.0), F.lit(102.0))).otherwise(F.array(F.lit(101.0)))).alias("close"),
        F.when((F.col("kind") == "idle") & (at % 2 == 0), 0.0).otherwise(1.0).alias("volume"),
        ((F.col("kind") == "gappy") & (at % 40 == 20)).alias("gone"),
    )
    return index_rows(stage(regular.where("not gone").drop("gone"), "kinds"), order=Q.ORDER)


@query("H8_severity_kinds", "symbol:s findings:i severity:s", """
SELECT symbol, findings, CASE WHEN findings = 0 THEN 'clean' WHEN kind = 'doubled' OR findings > 100 THEN 'major' ELSE 'minor' END AS severity FROM (
  SELECT symbol, kind, CASE kind WHEN 'clean' THEN 0 WHEN 'gappy' THEN count(*) FILTER (rn % 40 = 20 AND rn < n - 1)
         WHEN 'doubled' THEN 2 * count(*) FILTER (rn % 50 = 0) ELSE count(*) FILTER (rn % 2 = 0) END AS findings FROM v_kinds GROUP BY 1, 2)""")
def _(spark, sf):
    bars = kinds(spark, sf)
    return Q.severity(Q.summary(Q.findings(bars, "1h", z_threshold=1e9), bars))


@query("H10_report_kinds", "symbol:s total_rows:i findings:i severity:s gaps:i duplicates:i zero_volume:i", """
SELECT symbol, total_rows, gaps + duplicates + zero_volume AS findings, CASE WHEN gaps + duplicates + zero_volume = 0 THEN 'clean'
       WHEN duplicates > 0 OR gaps + zero_volume > 100 THEN 'major' ELSE 'minor' END AS severity, gaps, duplicates, zero_volume FROM (
  SELECT symbol, count(*) + CASE kind WHEN 'gappy' THEN -count(*) FILTER (rn % 40 = 20) WHEN 'doubled' THEN count(*) FILTER (rn % 50 = 0) ELSE 0 END AS total_rows,
         CASE kind WHEN 'gappy' THEN count(*) FILTER (rn % 40 = 20 AND rn < n - 1) ELSE 0 END AS gaps,
         CASE kind WHEN 'doubled' THEN 2 * count(*) FILTER (rn % 50 = 0) ELSE 0 END AS duplicates,
         CASE kind WHEN 'idle' THEN count(*) FILTER (rn % 2 = 0) ELSE 0 END AS zero_volume FROM v_kinds GROUP BY symbol, kind)""")
def _(spark, sf):
    bars = kinds(spark, sf)
    return Q.report(bars, Q.findings(bars, "1h", z_threshold=1e9))


@query("H9_findings", "symbol:s ts:t check:s reason:s z_score:e8 gap_seconds:i run_length:i", "SELECT * FROM v_findings")
def _(spark, sf):
    return _found(indexed(spark, sf))


@query("H10_summary", "symbol:s check:s rows_flagged:i", "SELECT * FROM v_summary")
def _(spark, sf):
    bars = indexed(spark, sf)
    return Q.summary(_found(bars), bars)


@query("H10_report", "symbol:s total_rows:i findings:i severity:s gaps:i stale_quotes:i volume_outliers:i", """
SELECT t.symbol, t.n AS total_rows, sum(rows_flagged) AS findings, 'major' AS severity,
       sum(rows_flagged) FILTER ("check" = 'gaps') AS gaps, sum(rows_flagged) FILTER ("check" = 'stale_quotes') AS stale_quotes,
       sum(rows_flagged) FILTER ("check" = 'volume_outliers') AS volume_outliers
FROM v_summary s JOIN (SELECT symbol, count(*) AS n FROM v_bent GROUP BY 1) t USING (symbol) GROUP BY 1, 2""")
def _(spark, sf):
    bars = indexed(spark, sf)
    return Q.report(bars, _found(bars))
