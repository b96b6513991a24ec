"""Columns of numbers packed into compressed binaries, and texts packed for a shuffle.

Work that exchanges one small number per word or per few bytes of text would drown in row overhead.
Tasks therefore send one row per (slice of texts, bucket) whose columns hold sorted arrays: bytes are
transposed by significance, which makes the high bytes of sorted differences vanish under compression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.batches import slices

_LEVEL = 1


def pack(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T) if len(values) else values
    return zstandard.ZstdCompressor(level=_LEVEL).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned values, as differences."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


def bucket_cuts(values: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where sorted ``bits``-bit values cross from one of ``buckets`` equal ranges into the next (buckets + 1 offsets)."""
    edges = (np.arange(1, buckets, dtype=np.float64) * (2.0**bits / buckets)).astype(np.uint64)
    return np.concatenate(([0], np.searchsorted(values, edges), [len(values)]))


RANGE_BYTES = 16 << 20


def n_buckets(docs: DataFrame, text: str, per_partition: int = 1) -> int:
    """Hash ranges to send to: several per shuffle partition, as a task holds one at a time, and so many that one range
    stands for at most 16 MB of the input's text, however large the input is."""
    given = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()[0]
    return max(1, per_partition * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-given // RANGE_BYTES))


def dealt(sent: DataFrame, buckets: int, per_partition: int = 1, by: tuple[str, ...] = ("bucket",)) -> DataFrame:
    """Rows dealt out by bucket (or bucket and salt), to more tasks than the session's shuffles have where there are more ranges than those should hold."""
    tasks = -(-buckets // per_partition)
    many = tasks > int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(tasks, *by) if many else sent


def text_runs(batch: pa.RecordBatch, column: str = "z", rows: int = 400, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch of packed texts into runs of few rows whose plain texts take at most ``limit`` bytes (a longer one stands alone)."""
    sizes = [zstandard.frame_content_size(z) for z in batch.column(column).to_pylist()]
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > limit or i - start == rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def compressed_texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id (long) and z, the compressed UTF-8 text, of rows that have an id: what a text costs in a shuffle."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("z", T.BinaryType())])

    def run(batches):
        packer = zstandard.ZstdCompressor(level=_LEVEL)
        for batch in batches:
            for part in slices(batch, "text"):
                z = [packer.compress((t or "").encode()) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(z, pa.binary())], names=["doc_id", "z"])

    return docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def plain_text(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def pack_all(arrays: list[np.ndarray]) -> bytes:
    parts = [pack(a) for a in arrays]
    return np.array([len(p) for p in parts], np.uint32).tobytes() + b"".join(parts)


def unpack_all(data: bytes, dtypes: list) -> list[np.ndarray]:
    at = 4 * len(dtypes)
    out = []
    for size, dtype in zip(np.frombuffer(data[:at], np.uint32).tolist(), dtypes):
        out.append(unpack(data[at : at + size], dtype))
        at += size
    return out
