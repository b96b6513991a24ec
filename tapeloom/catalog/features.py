"""Features, targets and labels."""

from pyspark.sql import functions as F

from tapeloom.catalog import bars as _bars  # noqa: F401  (shared views)
from tapeloom.catalog.spec import query, view
from tapeloom.operators import features as X
from tapeloom.operators.features import FeatureConfig, TripleBarrierConfig
from tapeloom.sources import testtables as T

SMALL = FeatureConfig(n_lag_returns=3, rolling_windows=(5, 20), volume_z_window=24)
OVER = "(PARTITION BY symbol ORDER BY rn)"


def _rows(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY rn ROWS {n - 1} PRECEDING)"


def _when_full(column: str, n: int, what: str) -> str:
    return f"CASE WHEN count({column}) OVER {_rows(n)} >= {n} THEN {what} OVER {_rows(n)} END"


view("v_ret", f"SELECT *, ln(close / lag(close) OVER {OVER}) AS r FROM v_nbars")
view("v_features", f"""
SELECT *, r AS ret_lag1, lag(r, 1) OVER {OVER} AS ret_lag2, lag(r, 2) OVER {OVER} AS ret_lag3,
       {_when_full('r', 5, 'avg(r)')} AS ret_mean_5, {_when_full('r', 5, 'stddev_samp(r)')} AS ret_std_5,
       {_when_full('r', 20, 'avg(r)')} AS ret_mean_20, {_when_full('r', 20, 'stddev_samp(r)')} AS ret_std_20,
       CASE WHEN {_when_full('volume', 24, 'stddev_samp(volume)')} > 0
            THEN (volume - avg(volume) OVER {_rows(24)}) / nullif(stddev_samp(volume) OVER {_rows(24)}, 0) ELSE 0 END AS volume_z,
       sin((hour(ts) + minute(ts) / 60e0) * 2 * pi() / 24) AS tod_sin, cos((hour(ts) + minute(ts) / 60e0) * 2 * pi() / 24) AS tod_cos
FROM v_ret""")


def _features(spark, sf):
    return X.build_features(T.indexed_hourly_bars(spark, sf), SMALL)


def _part(name: str, columns: str):
    query(name, "symbol:s ts:t " + columns, "SELECT * FROM v_features")(_features)


_part("I1_lagged_returns", "ret_lag1:f7 ret_lag2:f7 ret_lag3:f7")
_part("I2_rolling_moments", "ret_mean_5:f7 ret_std_5:f7 ret_mean_20:f7 ret_std_20:f7")
_part("I3_volume_z", "volume_z:f6")
_part("I4_time_of_day", "tod_sin:f8 tod_cos:f8")
_part("I5_build_features", " ".join(f"{c}:f6" for c in SMALL.columns))


def _coarse_sql(tf: str, us: int) -> str:
    return f"""
SELECT symbol, make_timestamp(us + {us}) AS ts, r AS ret_{tf}, CASE WHEN count(r) OVER w >= 20 THEN stddev_samp(r) OVER w END AS vol_{tf} FROM (
  SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY us)) AS r FROM (
    SELECT symbol, epoch_us(ts) - epoch_us(ts) % {us} AS us, arg_max(close, ts) AS close FROM v_bars GROUP BY 1, 2))
WINDOW w AS (PARTITION BY symbol ORDER BY us ROWS 19 PRECEDING) QUALIFY r IS NOT NULL"""


view("v_c4h", _coarse_sql("4h", 4 * 3_600_000_000))
view("v_c1d", _coarse_sql("1d", 24 * 3_600_000_000))


@query("I6_multi_timeframe", "symbol:s ts:t ret_4h_lag1:f7 vol_4h_lag1:f7 ret_1d_lag1:f7 vol_1d_lag1:f7", """
SELECT b.symbol, b.ts, h.ret_4h AS ret_4h_lag1, h.vol_4h AS vol_4h_lag1, d.ret_1d AS ret_1d_lag1, d.vol_1d AS vol_1d_lag1
FROM v_bars b ASOF LEFT JOIN v_c4h h ON b.symbol = h.symbol AND b.ts >= h.ts
ASOF LEFT JOIN v_c1d d ON b.symbol = d.symbol AND b.ts >= d.ts""")
def _(spark, sf):
    return X.multi_timeframe(T.indexed_hourly_bars(spark, sf), ("4h", "1d"))


view("v_bins", """
SELECT g.symbol, g.ts, last_value(o.ofi IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.ts) AS ofi,
       coalesce(s.signed_vol, 0) AS signed_vol, coalesce(s.trade_count, 0) AS trade_count
FROM (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM v_bars GROUP BY 1) g
LEFT JOIN (SELECT symbol, make_timestamp(epoch_us(ts) - epoch_us(ts) % 3600000000) AS ts, sum(sv) AS signed_vol, count(*) AS trade_count
           FROM v_trades GROUP BY 1, 2) s ON s.symbol = g.symbol AND s.ts = g.ts
LEFT JOIN (SELECT symbol, make_timestamp(epoch_us(ts) - epoch_us(ts) % 3600000000) AS ts, arg_max(ofi, ts) AS ofi
           FROM v_ofi WHERE ofi IS NOT NULL GROUP BY 1, 2) o ON o.symbol = g.symbol AND o.ts = g.ts""")
view("v_shifted", """
SELECT symbol, ts, lag(ofi) OVER w AS ofi, lag(signed_vol) OVER w AS signed_vol, lag(trade_count) OVER w AS trade_count
FROM v_bins WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")


@query("I7_micro_features", "symbol:s ts:t ofi:f6 signed_vol:f6 trade_count:f1", """
SELECT b.symbol, b.ts, s.ofi, s.signed_vol, s.trade_count FROM v_bars b ASOF LEFT JOIN v_shifted s ON b.symbol = s.symbol AND b.ts >= s.ts""")
def _(spark, sf):
    return X.micro_features(T.hourly_bars(spark, sf), T.trades(spark, sf), bar="1h", ofi_window="30m")


view("v_fwd", f"SELECT *, ln(lead(close) OVER {OVER} / close) AS fwd FROM v_nbars")


@query("I8_return_target", "symbol:s ts:t y:f8", "SELECT *, fwd AS y FROM v_fwd")
def _(spark, sf):
    return X.return_target(T.indexed_hourly_bars(spark, sf))


@query("I9_direction_target", "symbol:s ts:t y:f1", "SELECT *, CASE WHEN fwd > 0 THEN 1e0 WHEN fwd IS NOT NULL THEN 0e0 END AS y FROM v_fwd")
def _(spark, sf):
    return X.direction_target(T.indexed_hourly_bars(spark, sf))


@query("I9_direction_target_band", "symbol:s ts:t y:f1", "SELECT *, CASE WHEN fwd > 0.5e0 THEN 1e0 WHEN fwd < -0.5e0 THEN 0e0 END AS y FROM v_fwd")
def _(spark, sf):
    return X.direction_target(T.indexed_hourly_bars(spark, sf), 0.5)


BARRIERS = TripleBarrierConfig(horizon_bars=6, sigma_lookback=24)
view("v_barrier", f"""
WITH s AS (SELECT *, {_when_full('r', 24, 'stddev_samp(r)')} AS sd FROM (SELECT * REPLACE (coalesce(r, 0) AS r) FROM v_ret)),
f AS (SELECT s.symbol, s.ts, s.rn, s.sd, arg_min(CASE WHEN a.high >= s.close * exp(s.sd) THEN 1e0 ELSE -1e0 END, a.rn)
             FILTER (a.high >= s.close * exp(s.sd) OR a.low <= s.close * exp(-s.sd)) AS label, count(a.rn) AS ahead
      FROM s LEFT JOIN v_nbars a ON a.symbol = s.symbol AND a.rn BETWEEN s.rn + 1 AND s.rn + 6 GROUP BY 1, 2, 3, 4)
SELECT symbol, ts, rn, CASE WHEN ahead = 6 AND sd > 0 THEN coalesce(label, 0) END AS y FROM f""")


@query("I10_triple_barrier", "symbol:s ts:t y:f1", "SELECT * FROM v_barrier")
def _(spark, sf):
    return X.triple_barrier(T.indexed_hourly_bars(spark, sf), BARRIERS)


@query("I11_label_distribution", "symbol:s tp_frac:f8 sl_frac:f8 timeout_frac:f8 n_labels:i", """
SELECT symbol, count(*) FILTER (y = 1) / greatest(1, count(y)) AS tp_frac, count(*) FILTER (y = -1) / greatest(1, count(y)) AS sl_frac,
       count(*) FILTER (y = 0) / greatest(1, count(y)) AS timeout_frac, greatest(1, count(y)) AS n_labels FROM v_barrier GROUP BY 1""")
def _(spark, sf):
    return X.label_distribution(X.triple_barrier(T.indexed_hourly_bars(spark, sf), BARRIERS))


view("v_aligned", """
SELECT f.symbol, f.ts, f.ret_lag1, f.ret_lag2, f.ret_lag3, f.ret_std_20, f.volume_z, t.fwd AS y,
       row_number() OVER (PARTITION BY f.symbol ORDER BY f.ts) - 1 AS rn, count(*) OVER (PARTITION BY f.symbol) AS n
FROM v_features f JOIN v_fwd t ON t.symbol = f.symbol AND t.ts = f.ts
WHERE f.ret_lag1 + f.ret_lag2 + f.ret_lag3 + f.ret_mean_5 + f.ret_std_5 + f.ret_mean_20 + f.ret_std_20 + f.volume_z + t.fwd IS NOT NULL""")
_ALIGNED = "symbol:s ts:t ret_lag1:f7 ret_lag3:f7 ret_std_20:f7 volume_z:f6 y:f7"


def _aligned(spark, sf):
    bars = T.indexed_hourly_bars(spark, sf)
    return X.align(X.build_features(bars, SMALL), X.return_target(bars), SMALL.columns)


@query("I12_align", _ALIGNED, "SELECT * FROM v_aligned")
def _(spark, sf):
    return _aligned(spark, sf)


@query("I13_scale_split", "symbol:s ts:t role:s ret_lag1:f6 volume_z:f6", """
WITH m AS (SELECT symbol, avg(ret_lag1) AS ma, stddev_pop(ret_lag1) AS sa, avg(volume_z) AS mb, stddev_pop(volume_z) AS sb
           FROM v_aligned WHERE rn < floor(0.6e0 * n) GROUP BY 1)
SELECT a.symbol, a.ts, CASE WHEN rn < floor(0.6e0 * n) THEN 'train' ELSE 'test' END AS role,
       (ret_lag1 - ma) / CASE WHEN sa > 0 THEN sa ELSE 1 END AS ret_lag1, (volume_z - mb) / CASE WHEN sb > 0 THEN sb ELSE 1 END AS volume_z
FROM v_aligned a JOIN m USING (symbol)""")
def _(spark, sf):
    from tapeloom.plans.stage import stage
    from tapeloom.plans.tiles import index_rows

    rows = index_rows(stage(_aligned(spark, sf), "aligned"))
    n = rows.groupBy("symbol").agg(F.count("*").alias("n"))
    marked = rows.join(n, "symbol").withColumn("role", F.when(F.col("rn") < F.floor(F.lit(0.6) * F.col("n")), "train").otherwise("test"))
    return X.scale_split(marked, ["ret_lag1", "volume_z"], by=["symbol"])


@query("I14_sequences", "symbol:s ts:t steps:i first:f7 last:f7 y:f7", """
SELECT symbol, ts, 8 AS steps, lag(ret_lag1, 7) OVER (PARTITION BY symbol ORDER BY ts) AS first, ret_lag1 AS last, y
FROM v_aligned QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts) >= 8""")
def _(spark, sf):
    from tapeloom.plans.stage import stage

    rows = stage(_aligned(spark, sf), "aligned")
    out = X.sequences(rows, ["ret_lag1", "volume_z"], 8)
    return out.withColumns({"steps": F.size("x"), "first": F.col("x")[0][0], "last": F.col("x")[7][0]})
