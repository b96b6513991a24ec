"""Backtests, walk-forward and ledgers."""

from pyspark.sql import functions as F

from tapeloom.catalog import book as _book  # noqa: F401  (shared views)
from tapeloom.catalog import signals as _signals  # noqa: F401  (shared views)
from tapeloom.catalog.spec import query, view
from tapeloom.operators import backtest as K
from tapeloom.operators import signals as S
from tapeloom.operators.backtest import BacktestConfig, Rolling
from tapeloom.sources import testtables as T

CLOSE = BacktestConfig(execution="next_close")


def backtest_sql(source: str, part: str = "symbol", execution: str = "next_close", cost: str = "0.0012e0") -> str:
    """Backtest of ``position`` in a view that has ``rn`` per ``part``."""
    gross = "close / lag(close) OVER w - 1" if execution == "next_close" else "lead(open) OVER w / open - 1"
    return f"""
SELECT *, equity / max(equity) OVER u - 1 AS drawdown, coalesce(lag(equity) OVER w, equity) AS prev_equity FROM (
  SELECT *, 10000e0 * product(1 + net_return) OVER u AS equity FROM (
    SELECT *, lagged * gross_return - fee AS net_return FROM (
      SELECT *, abs(lagged - prev_position) * {cost} AS fee, abs(lagged - prev_position) AS position_change FROM (
        SELECT *, coalesce(lag(lagged) OVER w, 0) AS prev_position FROM (
          SELECT *, coalesce(lag(coalesce(position, 0)) OVER w, 0) AS lagged, coalesce({gross}, 0) AS gross_return
          FROM {source} WINDOW w AS (PARTITION BY {part} ORDER BY rn))
        WINDOW w AS (PARTITION BY {part} ORDER BY rn))))
  WINDOW u AS (PARTITION BY {part} ORDER BY rn ROWS UNBOUNDED PRECEDING))
WINDOW w AS (PARTITION BY {part} ORDER BY rn), u AS (PARTITION BY {part} ORDER BY rn ROWS UNBOUNDED PRECEDING)"""


def trades_sql(source: str, part: str = "symbol") -> str:
    on = " AND ".join(f"e.{c.strip()} = l.{c.strip()}" for c in part.split(","))
    return f"""
WITH edge AS (SELECT *, sign(prev_position) AS came FROM {source} WHERE rn = 0 OR sign(lagged) <> sign(prev_position)),
nxt AS (SELECT *, lead(rn) OVER w AS nrn, lead(ts) OVER w AS nts, lead(equity) OVER w AS neq FROM edge
        WINDOW w AS (PARTITION BY {part} ORDER BY rn)),
l AS (SELECT {part}, max(rn) AS lrn, arg_max(ts, rn) AS lts, arg_max(equity, rn) AS leq FROM {source} GROUP BY {part})
SELECT e.*, e.ts AS entry_at, coalesce(nts, lts) AS exit_at, CAST(trunc(lagged) AS BIGINT) AS side, coalesce(nrn, lrn) - rn AS bars_held,
       CASE WHEN came <> 0 THEN equity ELSE prev_equity END AS entry_equity, coalesce(neq, leq) AS exit_equity,
       coalesce(neq, leq) / CASE WHEN came <> 0 THEN equity ELSE prev_equity END - 1 AS pnl_pct
FROM nxt e JOIN l ON {on} WHERE lagged <> 0"""


# Signed positions with flips and flat stretches, so that every trade rule is exercised.
view("v_flips", "SELECT *, CASE WHEN close > 100 THEN -1e0 WHEN close > 50 THEN 0.5e0 WHEN close < 10 THEN NULL ELSE 1e0 END AS position FROM v_nbars")
view("v_bt_ma", backtest_sql("v_ma"))
view("v_bt_open", backtest_sql("v_ma", execution="next_open"))
view("v_bt_flips", backtest_sql("v_flips"))
view("v_trades_ma", trades_sql("v_bt_ma"))


def flips(spark, sf):
    c = F.col("close")
    position = F.when(c > 100, -1.0).when(c > 50, 0.5).when(c < 10, F.lit(None)).otherwise(1.0)
    return T.indexed_hourly_bars(spark, sf).withColumn("position", position)


def crossover_backtest(spark, sf, config=CLOSE):
    return K.run_backtest(S.ma_crossover(T.indexed_hourly_bars(spark, sf), 5, 20), config)


_RESULT = "symbol:s ts:t position:f2 position_change:f2 gross_return:e8 fee:f8 net_return:f7 equity:e7 drawdown:f6"


@query("F1_run_backtest", _RESULT, "SELECT * REPLACE (lagged AS position) FROM v_bt_ma")
def _(spark, sf):
    return crossover_backtest(spark, sf)


@query("F1_run_backtest_tiles", _RESULT.replace("drawdown:f6", "drawdown:e6"), "SELECT * REPLACE (lagged AS position) FROM v_bt_flips")
def _(spark, sf):
    """Positions that flip, losses beyond the capital, and tiles far shorter than a series."""
    return K.run_backtest(flips(spark, sf), CLOSE, size=50)


@query("F1_run_backtest_next_open", _RESULT, "SELECT * REPLACE (lagged AS position) FROM v_bt_open")
def _(spark, sf):
    return crossover_backtest(spark, sf, BacktestConfig())


@query("E10_buy_and_hold", "symbol:s ts:t equity:e7 drawdown:f6", "SELECT * FROM v_bt_hold")
def _(spark, sf):
    return K.run_backtest(S.buy_and_hold(T.indexed_hourly_bars(spark, sf)), CLOSE)


view("v_hold", "SELECT *, 1e0 AS position FROM v_nbars")
view("v_bt_hold", backtest_sql("v_hold"))
_LOG = "symbol:s entry_at:t exit_at:t side:i bars_held:i entry_equity:e6 exit_equity:e6 pnl_pct:f6"


@query("F2_trade_log", _LOG, trades_sql("v_bt_flips"))
def _(spark, sf):
    return K.trade_log(K.run_backtest(flips(spark, sf), CLOSE))


@query("C9_pnl_histogram", "symbol:s bin:i n:i", f"""
SELECT symbol, floor(pnl_pct / 0.0625e0) AS bin, count(*) AS n FROM ({trades_sql("v_bt_flips")}) GROUP BY 1, 2""")
def _(spark, sf):
    from tapeloom.operators.micro import pnl_histogram

    return pnl_histogram(K.trade_log(K.run_backtest(flips(spark, sf), CLOSE)), 0.0625)


@query("F3_cost_model", "symbol:s mode:s total_fee:f6", f"""
SELECT symbol, 'taker' AS mode, sum(fee) AS total_fee FROM v_bt_ma GROUP BY 1 UNION ALL
SELECT symbol, 'maker' AS mode, sum(fee) AS total_fee FROM ({backtest_sql('v_ma', cost='0.0002e0')}) GROUP BY 1""")
def _(spark, sf):
    bars = S.ma_crossover(T.indexed_hourly_bars(spark, sf), 5, 20)
    out = None
    for mode, maker in (("taker", False), ("maker", True)):
        bt = K.run_backtest(bars, BacktestConfig(execution="next_close", assume_maker=maker))
        one = bt.groupBy("symbol").agg(F.sum("fee").alias("total_fee")).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


ROLL = Rolling(train_days=365, test_days=90)
GRID = {"short_window": [5, 10, 30], "long_window": [20, 30, 60]}

view("v_windows", """
SELECT symbol, CAST(k AS BIGINT) AS window_id, first + to_days(CAST(90 * k AS INT)) AS train_start,
       first + to_days(CAST(365 + 90 * k AS INT)) AS train_end, first + to_days(CAST(365 + 90 * k AS INT)) AS test_start,
       first + to_days(CAST(455 + 90 * k AS INT)) AS test_end
FROM (SELECT symbol, first, unnest(range(CAST((date_diff('day', first, last) - 455) // 90 + 1 AS BIGINT))) AS k
      FROM (SELECT symbol, min(ts) AS first, max(ts) AS last FROM v_daily GROUP BY 1))""")
_WINDOW = "symbol:s window_id:i train_start:t train_end:t test_start:t test_end:t"


@query("F4_make_windows", _WINDOW, "SELECT * FROM v_windows")
def _(spark, sf):
    return K.make_windows(T.daily_bars(spark, sf), ROLL)


@query("F4_make_windows_anchored", _WINDOW, """
SELECT w.* REPLACE (f.first AS train_start) FROM v_windows w JOIN (SELECT symbol, min(ts) AS first FROM v_daily GROUP BY 1) f USING (symbol)""")
def _(spark, sf):
    return K.make_windows(T.daily_bars(spark, sf), Rolling(365, 90, anchored=True))


view("v_combos", """
SELECT i * 3 + j AS combo_id, s AS short_window, l AS long_window
FROM (VALUES (0, 5), (1, 10), (2, 30)) a(i, s), (VALUES (0, 20), (1, 30), (2, 60)) b(j, l)""")


@query("F5_parameter_grid", "symbol:s combo_id:i short_window:i long_window:i bars:i", """
SELECT symbol, combo_id, short_window, long_window, count(*) AS bars FROM v_daily, v_combos GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    grid = [(i, p["short_window"], p["long_window"]) for i, p in enumerate(K.parameter_grid(GRID))]
    sets = F.array(*[F.struct(F.lit(i).alias("combo_id"), F.lit(s).alias("short_window"), F.lit(n).alias("long_window")) for i, s, n in grid])
    bars = T.daily_bars(spark, sf).groupBy("symbol").agg(F.count("*").alias("bars"))
    return bars.select("symbol", "bars", F.inline(sets))


def _slices_sql(role: str, windows: str = "v_windows", combos: str = "(SELECT * FROM v_combos WHERE short_window < long_window)") -> str:
    return f"""
SELECT b.symbol, w.window_id, c.*, b.ts, b.open, b.close,
       row_number() OVER (PARTITION BY b.symbol, w.window_id, c.combo_id ORDER BY b.ts) - 1 AS rn
FROM v_daily b JOIN {windows} w ON w.symbol = b.symbol AND b.ts BETWEEN w.{role}_start AND w.{role}_end, {combos} c"""


def _grid_ma_sql(source: str) -> str:
    length = lambda n: f"avg(close) OVER (PARTITION BY symbol, window_id, combo_id ORDER BY rn ROWS {n - 1} PRECEDING)"
    pick = lambda col: "CASE " + col + " " + " ".join(f"WHEN {n} THEN {length(n)}" for n in (5, 10, 20, 30, 60)) + " END"
    return f"""
SELECT *, CASE WHEN rn >= long_window - 1 THEN CASE WHEN {pick('short_window')} > {pick('long_window')} THEN 1e0 ELSE 0e0 END END AS position
FROM {source}"""


_SHARPE = """CASE WHEN count(net_return) >= 2 AND NOT stddev_samp(net_return) < 1e-15 * (abs(avg(net_return)) + 1e-300)
       THEN avg(net_return) / stddev_samp(net_return) * sqrt(365e0) END"""
_PART = "symbol, window_id, combo_id"


def _walk_views(name: str, slices, positions, score: str, windows: str = "v_windows", combos: str = "v_combos") -> None:
    """Views of the backtests of all slices, and the walk-forward table over them."""
    for role in ("train", "test"):
        view(f"{name}_{role}", slices(role))
        view(f"{name}_{role}_pos", positions(f"{name}_{role}"))
        view(f"{name}_{role}_bt", backtest_sql(f"{name}_{role}_pos", _PART, "next_open"))
    view(name, f"""
WITH best AS (SELECT symbol, window_id, arg_max(combo_id, (score, -combo_id)) AS combo_id, max(score) AS train_score FROM (
                SELECT {_PART}, {score} AS score FROM {name}_train_bt GROUP BY {_PART}) WHERE score IS NOT NULL GROUP BY 1, 2),
tested AS (SELECT {_PART}, {score} AS test_score,
                  count(*) FILTER (lagged <> 0 AND prev_position = 0) AS n_trades_test FROM {name}_test_bt GROUP BY {_PART})
SELECT w.*, b.combo_id, b.train_score, t.test_score, t.n_trades_test, c.* EXCLUDE (combo_id)
FROM {windows} w JOIN best b USING (symbol, window_id) JOIN tested t USING (symbol, window_id, combo_id) JOIN {combos} c USING (combo_id)""")


_walk_views("v_wf", _slices_sql, _grid_ma_sql, _SHARPE)
view("v_anchored", "SELECT w.* REPLACE (f.first AS train_start) FROM v_windows w JOIN (SELECT symbol, min(ts) AS first FROM v_daily GROUP BY 1) f USING (symbol)")
_walk_views("v_wfa", lambda role: _slices_sql(role, "v_anchored"), _grid_ma_sql, _SHARPE, "v_anchored")

BANDS = {"window": [10, 20], "num_std": [1.0, 2.0]}
view("v_bands", "SELECT i * 2 + j AS combo_id, n AS length, k AS num_std FROM (VALUES (0, 10), (1, 20)) a(i, n), (VALUES (0, 1e0), (1, 2e0)) b(j, k)")


def _grid_bands_sql(source: str) -> str:
    pick = lambda f: "CASE length " + " ".join(
        f"WHEN {n} THEN {f}(close) OVER (PARTITION BY {_PART} ORDER BY rn ROWS {n - 1} PRECEDING)" for n in BANDS["window"]
    ) + " END"
    return f"""
SELECT *, CASE WHEN rn >= length - 1 THEN coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY {_PART} ORDER BY rn ROWS UNBOUNDED PRECEDING), 0e0) END AS position
FROM (SELECT *, CASE WHEN rn >= length - 1 THEN CASE WHEN close < mu - num_std * sd THEN 1e0 WHEN close > mu THEN 0e0 END END AS event
      FROM (SELECT *, {pick('avg')} AS mu, {pick('stddev_samp')} AS sd FROM {source}))"""


# Net profit per trade: a score other than the Sharpe ratio.
_PER_TRADE = "sum(net_return) / nullif(count(*) FILTER (lagged <> 0 AND prev_position = 0), 0)"
_walk_views("v_wfb", lambda role: _slices_sql(role, "v_anchored", "v_bands"), _grid_bands_sql, _PER_TRADE, "v_anchored", "v_bands")


def _walk(spark, sf):
    return K.walk_forward(T.indexed_daily_bars(spark, sf), "ma_crossover", GRID, ROLL, bars_per_year=365)


@query("F6_walk_forward", _WINDOW + " combo_id:i short_window:i long_window:i train_score:f6 test_score:f6 n_trades_test:i", "SELECT * FROM v_wf")
def _(spark, sf):
    return _walk(spark, sf).select("*", F.col("params.short_window"), F.col("params.long_window"))


@query("F6_walk_forward_anchored", _WINDOW + " combo_id:i short_window:i long_window:i train_score:f6 test_score:f6 n_trades_test:i", "SELECT * FROM v_wfa")
def _(spark, sf):
    """Growing training slices; tiles far shorter than a slice."""
    bars = T.indexed_daily_bars(spark, sf)
    out = K.walk_forward(bars, "ma_crossover", GRID, Rolling(365, 90, anchored=True), bars_per_year=365, size=100)
    return out.select("*", F.col("params.short_window"), F.col("params.long_window"))


@query("F6_walk_forward_score", _WINDOW + " combo_id:i length:i num_std:f2 train_score:f7 test_score:f7 n_trades_test:i", "SELECT * FROM v_wfb")
def _(spark, sf):
    """A rule that keeps its last event, anchored windows, and a score of its own."""
    bars = T.indexed_daily_bars(spark, sf)
    score = lambda m: m.total / F.when(m.trades > 0, m.trades)
    out = K.walk_forward(bars, "bollinger", BANDS, Rolling(365, 90, anchored=True), score=score)
    return out.select("*", F.col("params.window").alias("length"), F.col("params.num_std"))


@query("J14_walk_forward_summary", "symbol:s windows:i mean_train:f6 mean_test:f6 median_test:f6 positive_share:f6", """
SELECT symbol, count(*) AS windows, avg(train_score) AS mean_train, avg(test_score) AS mean_test, median(test_score) AS median_test,
       avg(CASE WHEN test_score > 0 THEN 1e0 ELSE 0e0 END) AS positive_share FROM v_wf GROUP BY 1""")
def _(spark, sf):
    return K.walk_forward_summary(_walk(spark, sf))


view("v_st_slices", """
SELECT b.symbol, w.window_id, b.ts, b.open, b.close, row_number() OVER (PARTITION BY b.symbol, w.window_id ORDER BY b.ts) - 1 AS rn
FROM v_daily b JOIN v_windows w ON w.symbol = b.symbol AND b.ts BETWEEN w.test_start AND w.test_end""")
view("v_st_pos", """
SELECT *, CASE WHEN rn >= 19 THEN CASE WHEN avg(close) OVER (PARTITION BY symbol, window_id ORDER BY rn ROWS 4 PRECEDING) >
       avg(close) OVER (PARTITION BY symbol, window_id ORDER BY rn ROWS 19 PRECEDING) THEN 1e0 ELSE 0e0 END END AS position FROM v_st_slices""")
view("v_st_bt", backtest_sql("v_st_pos", "symbol, window_id", "next_open"))


@query("F7_stitched_curve", "symbol:s window_id:i ts:t equity:e7 net_return:f7 position:f2 position_change:f2 drawdown:f6", """
WITH ends AS (SELECT symbol, window_id, arg_min(equity, rn) AS a, arg_max(equity, rn) AS b FROM v_st_bt GROUP BY 1, 2),
scale AS (SELECT symbol, window_id, 10000e0 * coalesce(product(b / a) OVER (PARTITION BY symbol ORDER BY window_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) / a AS k FROM ends),
s AS (SELECT t.symbol, t.window_id, t.ts, t.rn, t.equity * k AS equity, t.net_return, t.lagged AS position FROM v_st_bt t JOIN scale USING (symbol, window_id))
SELECT *, coalesce(abs(position - lag(position) OVER w), 0) AS position_change,
       equity / max(equity) OVER (PARTITION BY symbol ORDER BY window_id, rn ROWS UNBOUNDED PRECEDING) - 1 AS drawdown
FROM s WINDOW w AS (PARTITION BY symbol ORDER BY window_id, rn)""")
def _(spark, sf):
    return K.stitched_curve(T.indexed_daily_bars(spark, sf), "ma_crossover", {"short_window": 5, "long_window": 20}, ROLL)


view("v_mids", "SELECT symbol, event_id, ts, value AS mid FROM (SELECT *, user_id % 5 AS symbol FROM events)")
view("v_ledger", """
SELECT f.*, m.mid, i.inventory, i.cash, i.cash + i.inventory * m.mid AS equity, abs(i.inventory) > 0.15e0 + 1e-12 AS over_cap
FROM (SELECT symbol, fill_id, sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) OVER w AS inventory,
             10000e0 + sum(CASE WHEN side = 'buy' THEN -price * qty * (1 + 1e-4) ELSE price * qty * (1 - 1e-4) END) OVER w AS cash
      FROM v_fills WINDOW w AS (PARTITION BY symbol ORDER BY ts, fill_id ROWS UNBOUNDED PRECEDING)) i
JOIN v_fills f USING (symbol, fill_id)
ASOF JOIN v_mids m ON m.symbol = f.symbol AND f.ts >= m.ts""")


def _ledger(spark, sf):
    mids = T.table(spark, sf, "events").select((F.col("user_id") % 5).alias("symbol"), "ts", F.col("value").alias("mid"))
    return K.ledger(T.fills(spark, sf), mids, fee_bps=1.0, inventory_cap=0.15)


@query("F8_ledger", "symbol:i fill_id:i ts:t side:s mid:f4 inventory:f6 cash:f6 equity:f6 over_cap:b", "SELECT * FROM v_ledger")
def _(spark, sf):
    return _ledger(spark, sf)


view("v_marked", """
WITH l AS (SELECT symbol, ts, arg_max(inventory, fill_id) AS inventory, arg_max(cash, fill_id) AS cash FROM v_ledger GROUP BY 1, 2)
SELECT m.symbol, m.event_id, m.ts, m.mid, coalesce(l.inventory, 0) AS inventory, coalesce(l.cash, 10000e0) AS cash,
       coalesce(l.cash, 10000e0) + coalesce(l.inventory, 0) * m.mid AS equity
FROM v_mids m ASOF LEFT JOIN l ON l.symbol = m.symbol AND m.ts >= l.ts""")


def _marked(spark, sf):
    fills = T.fills(spark, sf)
    mids = T.table(spark, sf, "events").select((F.col("user_id") % 5).alias("symbol"), "event_id", "ts", F.col("value").alias("mid"))
    return K.marked_ledger(K.ledger(fills, mids.drop("event_id"), fee_bps=1.0, inventory_cap=0.15), mids)


@query("F8_marked_ledger", "symbol:i event_id:i ts:t mid:f4 inventory:f6 cash:f6 equity:f6", "SELECT * FROM v_marked")
def _(spark, sf):
    return _marked(spark, sf)


@query("F10_marked_step_sharpe", "symbol:i steps:i step_sharpe:f6 final_pnl:f6", """
SELECT symbol, count(*) AS steps, avg(d) / stddev_samp(d) * sqrt(count(*)) AS step_sharpe, arg_max(equity, (ts, event_id)) - 10000e0 AS final_pnl
FROM (SELECT *, equity - lag(equity) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS d FROM v_marked) GROUP BY 1""")
def _(spark, sf):
    return K.step_sharpe(_marked(spark, sf), order=("ts", "event_id"))


@query("F9_pnl_decomposition", "symbol:i fill_id:i total_pnl:f6 cash_drift:f6 inventory_value:f6", """
SELECT symbol, fill_id, equity - first_value(equity) OVER w AS total_pnl, cash - first_value(cash) OVER w AS cash_drift,
       inventory * mid AS inventory_value FROM v_ledger WINDOW w AS (PARTITION BY symbol ORDER BY ts, fill_id)""")
def _(spark, sf):
    return K.pnl_decomposition(_ledger(spark, sf))


@query("F10_step_sharpe", "symbol:i steps:i step_sharpe:f6 final_pnl:f6", """
SELECT symbol, count(*) AS steps, avg(d) / stddev_samp(d) * sqrt(count(*)) AS step_sharpe, arg_max(equity, (ts, fill_id)) - 10000e0 AS final_pnl
FROM (SELECT *, equity - lag(equity) OVER (PARTITION BY symbol ORDER BY ts, fill_id) AS d FROM v_ledger) GROUP BY 1""")
def _(spark, sf):
    return K.step_sharpe(_ledger(spark, sf))


@query("F11_leaderboard", "symbol:s timeframe:s strategy:s final_equity:e6 place:i overall:b", """
SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY final_equity DESC, strategy) AS place,
       final_equity = max(final_equity) OVER () AS overall
FROM (SELECT symbol, '1h' AS timeframe, 'hold' AS strategy, arg_max(equity, rn) AS final_equity FROM v_bt_hold GROUP BY 1 UNION ALL
      SELECT symbol, '1h', 'crossover', arg_max(equity, rn) FROM v_bt_ma GROUP BY 1 UNION ALL
      SELECT symbol, '1h', 'flips', arg_max(equity, rn) FROM v_bt_flips GROUP BY 1)""")
def _(spark, sf):
    bars = T.indexed_hourly_bars(spark, sf)
    runs = {"hold": S.buy_and_hold(bars), "crossover": S.ma_crossover(bars, 5, 20), "flips": flips(spark, sf)}
    out = None
    for name, positions in runs.items():
        last = K.run_backtest(positions, CLOSE).groupBy("symbol").agg(F.max_by("equity", "rn").alias("final_equity"))
        last = last.withColumns({"timeframe": F.lit("1h"), "strategy": F.lit(name)})
        out = last if out is None else out.unionByName(last)
    return K.leaderboard(out)


