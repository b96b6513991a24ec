"""Archives, stores, schema checks."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tapeloom import schema as Z
from tapeloom.sources import archives, store
from tests import frames as f

HEADER = "agg_trade_id,price,quantity,first_trade_id,last_trade_id,transact_time,is_buyer_maker,is_best_match\n"
LINES = "1,100.5,0.1,1,1,1700000000000,True,True\n2,100.6,0.2,2,3,1700000001000000,false,True\n3,100.7,0.3,4,4,1700000002,TRUE,True\n"


def zipped(*members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, text in members:
            z.writestr(name, text)
    return buffer.getvalue()


@pytest.mark.parametrize("header", ["", HEADER])
def test_trades_csv_and_zip(spark, tmp_path, header):
    (tmp_path / "plain.csv").write_text(header + LINES)
    (tmp_path / "BTCUSDT-aggTrades-2023-11-14.zip").write_bytes(zipped(("a.csv", header + LINES), ("b.csv", "junk")))
    plain = archives.read_trades_csv(spark, str(tmp_path / "plain.csv")).orderBy("agg_id").collect()
    assert [r["ts"].replace(tzinfo=None) for r in plain] == [dt.datetime(2023, 11, 14, 22, 13, 20 + i) for i in range(3)]
    assert [r["is_buyer_maker"] for r in plain] == [True, False, True]
    packed = archives.zipped_trades(archives.read_zips(spark, str(tmp_path))).orderBy("agg_id").collect()
    assert [r["price"] for r in packed] == [r["price"] for r in plain] and {r["symbol"] for r in packed} == {"BTCUSDT"}


def test_empty_zip_is_an_error(spark, tmp_path):
    (tmp_path / "X-aggTrades-2023-11-14.zip").write_bytes(zipped())
    with pytest.raises(Exception, match="empty zip"):
        archives.read_zips(spark, str(tmp_path)).collect()


def test_depth_csv(spark, tmp_path):
    (tmp_path / "d.csv").write_text("timestamp,percentage,depth,notional\n2026-05-13 00:00:08,-1.00,10.5,1000\n2026-05-13 00:00:08,0.20,3,300\n")
    got = archives.read_depth_csv(spark, str(tmp_path / "d.csv")).orderBy("percentage").collect()
    assert [(r["percentage"], r["depth"]) for r in got] == [(-1.0, 10.5), (0.2, 3.0)]
    assert archives.slug("btc/usdt") == "BTCUSDT"


def test_load_range_prunes_and_checks(spark, tmp_path):
    root = str(tmp_path / "t")
    store.write_by_date(f.trades(spark, 300, step_ms=1_000_000), root)
    got = store.load_range(spark, root, "X", "2024-01-02", dt.date(2024, 1, 3))
    assert {r[0] for r in got.select(F.to_date("ts")).distinct().collect()} == {dt.date(2024, 1, 2), dt.date(2024, 1, 3)}
    assert "PartitionFilters: [" in got._jdf.queryExecution().toString() and store.load_symbol(spark, root, "none").count() == 0
    with pytest.raises(ValueError):
        store.load_range(spark, root, "X", "2024-01-03", "2024-01-02")


def test_upsert_rewrites_only_touched_days(spark, tmp_path):
    root = str(tmp_path / "b")
    old = f.bars(spark, range(1, 101), seconds=3600)
    store.upsert_bars(spark, root, old)
    fresh = f.bars(spark, [500.0] * 30, at=f.times(120, 3600)[90:])
    kept = {p for p in spark.read.parquet(root).inputFiles() if "2024-01-02" in p}
    store.upsert_bars(spark, root, fresh)
    out = spark.read.parquet(root)
    assert out.count() == 120 and out.where("close = 500").count() == 30
    assert kept <= set(out.inputFiles())
    top = store.keep_recent(out, dt.datetime(2024, 1, 5, 23, 30), 1, "1h")
    assert top.agg(F.min("ts")).first()[0] == dt.datetime(2024, 1, 4, 23)


def test_strict_checks_raise(spark):
    good = f.bars(spark, [11, 12, 13])
    assert Z.validate_bars(good) is good
    with pytest.raises(Z.SchemaError, match="missing"):
        Z.check_bars(good.drop("volume"))
    with pytest.raises(Z.SchemaError, match="type"):
        Z.check_bars(good.withColumn("close", F.lit("x")))
    with pytest.raises(Z.SchemaError, match="duplicate_time: 6"):
        Z.validate_bars(good.unionByName(good))
    with pytest.raises(Z.SchemaError, match="nan: 3"):
        Z.validate_bars(good.withColumn("open", F.lit(float("nan"))))
    t = f.trades(spark, 20)
    assert Z.validate_trades(t) is t
    late = t.withColumn("ts", F.when(F.col("agg_id") == 3, F.lit(dt.datetime(2025, 1, 1))).otherwise(F.col("ts")))
    with pytest.raises(Z.SchemaError, match="time_order: 16"):
        Z.validate_trades(late)


def test_shared_folder_is_the_sessions(spark):
    from tapeloom.plans.stage import shared_folder, stage

    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) in stage(spark.range(3)).inputFiles()[0]


def test_lines_that_do_not_parse(spark, tmp_path):
    (tmp_path / "t.csv").write_text(HEADER + LINES + "x2,1,1,1,1,1700000000000,True,True\n5,oops,1,1,1,1700000000000,True,True\n6,1,1,1,1,1700000000000,maybe,True\n")
    path = str(tmp_path / "t.csv")
    with pytest.raises(Exception, match="does not parse, column (agg_id|price|is_buyer_maker)"):
        archives.read_trades_csv(spark, path).collect()
    assert archives.read_trades_csv(spark, path, bad="skip").count() == 3
    rejects = archives.trade_rejects(archives.raw_trades_csv(spark, path)).collect()
    assert sorted((r["agg_id"], r["reason"]) for r in rejects) == [("5", "price"), ("6", "is_buyer_maker"), ("x2", "agg_id")]
    (tmp_path / "d.csv").write_text("timestamp,percentage,depth,notional\n2026-05-13 00:00:08,-1.00,10.5,1000\n2026-05-13 00:00:08,much,3,300\n")
    with pytest.raises(Exception, match="column percentage"):
        archives.read_depth_csv(spark, str(tmp_path / "d.csv")).collect()
    with pytest.raises(ValueError):
        archives.read_depth_csv(spark, str(tmp_path / "d.csv"), bad="ignore")


def test_zipped_depth(spark, tmp_path):
    text = "timestamp,percentage,depth,notional\n2026-05-13 00:00:08,-1.00,10.5,1000\n"
    (tmp_path / "ETHUSDT-bookDepth-2026-05-13.zip").write_bytes(zipped(("d.csv", text)))
    rows = archives.zipped_depth(archives.read_zips(spark, str(tmp_path))).collect()
    assert [(r["symbol"], r["percentage"], r["depth"]) for r in rows] == [("ETHUSDT", -1.0, 10.5)]


def test_staged_tables_can_be_removed(tmp_path, spark):
    import os

    from tapeloom.plans import stage as P

    kept = P._staged.pop(spark.sparkContext.applicationId, [])  # those of other tests stay
    try:
        table = P.stage(spark.range(3), "one")
        path = P._staged[spark.sparkContext.applicationId][0].removeprefix("file:")
        assert table.count() == 3 and os.path.isdir(path)
        assert P.clear(spark) == 1 and not os.path.exists(path) and P.clear(spark) == 0
    finally:
        P._staged[spark.sparkContext.applicationId] = kept
