"""Materialise an intermediate table in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_staged: dict[str, list[str]] = {}
_tables: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tapeloom-"))
    return spark.sparkContext.getCheckpointDir()


def stage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as parquet and read it back.

    Used where a result feeds several branches of one plan: the branches then share one computed
    table (column-pruned, with known sizes) that survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tapeloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``stage``, laid out by ``key`` in as many buckets as a shuffle has partitions: joins and groups by key read it in place."""
    spark = df.sparkSession
    table = f"tapeloom_{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(table)
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(table)
    return spark.table(table)


def clear(spark: SparkSession) -> int:
    """Remove the tables this session has staged, once its results are written; returns how many.

    Results that were not written before cannot be computed afterwards.
    """
    for table in _tables.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)
