"""Arrow batches inside tasks: slices of bounded size, and columns computed next to their rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_BYTES = 2 << 20
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts: fewer rows than Spark's default, so that a task's buffers stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory to the system: Python workers live on after a task, and allocators keep what they once held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose text takes at most ``limit`` bytes (a longer text stands alone)."""
    lengths = batch.column(column)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(lengths), 0), np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def add_columns(
    df: DataFrame, column: str, fields: T.StructType, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]
) -> DataFrame:
    """Add ``fields``, computed from each slice of rows by the function that ``make`` returns in the task.

    Columns of ``df`` with the names of new ones are replaced.
    """
    kept = [f for f in df.schema.fields if f.name not in fields.names]
    if column in fields.names:
        raise ValueError(f"the input column {column} cannot also be a result")
    out = T.StructType(kept + list(fields.fields))
    schema = to_arrow_schema(out)
    names = [f.name for f in kept]

    def run(batches):
        compute = make()
        for batch in batches:
            for part in slices(batch, column):
                arrays = [part.column(n) for n in names] + compute(part)
                yield pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, schema.types)], schema=schema)
            give_back()

    return df.mapInArrow(run, out)


def unused(name: str, columns: list[str]) -> str:
    """A column name that the input does not have (names are compared without case, as Spark does)."""
    given = {c.lower() for c in columns}
    while name.lower() in given:
        name = f"_{name}"
    return name


def strings(column: pa.Array) -> pa.Array:
    """Texts as 64-bit addressed strings, null as empty."""
    return pa.compute.fill_null(column.cast(pa.large_string()), "")


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
