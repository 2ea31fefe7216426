"""Small helpers that the operators share: typed columns, Arrow batches, staged tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text bytes that an Arrow kernel works on at a time; one longer document makes a larger slice.
SLICE_BYTES = 1 << 19


def text_column(text: str = "text") -> Column:
    """The text column as a string, null read as empty."""
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


def documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (never null), whatever else the table holds."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_column(text).alias("text"))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the text of each part stays near ``limit`` bytes; rows are never cut."""
    lengths = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column)))
    sizes = lengths.fill_null(0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for row, size in enumerate(sizes):
        if row > first and total + size > limit:
            yield batch.slice(first, row - first)
            first, total = row, 0
        total += int(size)
    if first < batch.num_rows:
        yield batch.slice(first)


#: What workers remember from task to task, such as loaded tokenizers. Each operator that remembers something adds it.
remembered: list[dict] = []


def trim(forget: bool = True) -> None:
    """Give memory that a task no longer uses back to the system: Python workers live on after it.

    With ``forget`` what other operators remembered in this worker goes, too; it is made anew when needed.
    """
    if forget:
        for memory in remembered:
            memory.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps what it keeps


def map_slices(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str,
               column: str = "text") -> DataFrame:
    """``mapInArrow`` with memory bounded by slices of text rather than by rows."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, column):
                yield function(part)
        trim()
    return df.mapInArrow(run, schema)
