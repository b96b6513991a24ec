"""What physical plans must not contain."""

import re

from tapeloom.catalog import all_queries

QUERIES = all_queries()
PYTHON = {"A4_unzip_archives", "A4_unzip_depth", "E5_ml_directional_ridge", "J6_registry_predictions", "B8_lttb", "E3_ofi_mean_reversion", "E3_ofi_mean_reversion_chained", "J2_ridge_regression", "J3_ridge_classifier",
          "J3_ridge_classifier_wide", "J4_mlp", "J4_mlp_rows", "J5_boosted_trees", "J5_boosted_trees_rows",
          "J13_benchmark_sweep", "J14_fee_pivot", "J6_registry", "K2_streaming_top_of_book"}
# One row in all (best of panels, rule counts, per-class totals) meets in a single task by definition.
ONE_ROW = {"F11_leaderboard", "A10_check_bars", "A11_check_trades", "J6_registry"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def assert_scalable(name, text):
    """No window or aggregate over everything in one task, no cross join, no Python by surprise."""
    if name not in ONE_ROW:
        assert "SinglePartition" not in text
        assert "BroadcastNestedLoopJoin" not in text
    assert "CartesianProduct" not in text
    if name not in PYTHON:
        assert not re.search(r"(ArrowEvalPython|BatchEvalPython|InPandas|PythonUDF)", text)


def test_scans_read_only_the_columns_they_need(spark, sf):
    text = plan(QUERIES["B1_time_bars"].run(spark, sf))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double,props:string" in text
    assert "toxic" not in plan(QUERIES["J8_classification_metrics"].run(spark, sf))


def test_bars_are_hash_aggregated(spark, sf):
    """min_by/max_by on a struct order would sort every trade before the partial aggregate."""
    text = plan(QUERIES["B1_time_bars"].run(spark, sf))
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_chunk_totals_are_hash_aggregated(spark, sf):
    for name in ("B2_volume_bars", "C3_effective_spread", "D4_book_at", "G12_bootstrap_indices", "F2_trade_log", "G5_max_drawdown"):
        assert "SortAggregate" not in plan(QUERIES[name].run(spark, sf)), name


def test_small_tables_are_broadcast_by_their_true_size(spark, sf):
    """The rows of the big side are not shuffled by series."""
    text = plan(QUERIES["A15_trailing"].run(spark, sf))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_several_timeframes_meet_the_bars_in_one_scan(spark, sf):
    text = plan(QUERIES["I6_multi_timeframe"].run(spark, sf))
    assert text.count("Exchange hashpartitioning") <= 10
