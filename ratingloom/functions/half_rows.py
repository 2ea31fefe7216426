"""Factor rows in half precision as two bytes a value, for what is stored and what is shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StructField, StructType

from ratingloom.plans import exchange

cloudpickle.register_pickle_by_value(exchange)


def _with_types(df: DataFrame, columns: list[str], kind) -> StructType:
    return StructType([StructField(f.name, kind if f.name in columns else f.dataType, f.nullable) for f in df.schema])


def packed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Arrays of floats that hold binary16 values as binary columns; rows of a column may differ in length."""
    def run(batches):
        for batch in batches:
            arrays = []
            for name, values in zip(batch.schema.names, batch.columns):
                if name in columns:
                    halves = values.flatten().to_numpy(zero_copy_only=False).astype(np.float16)
                    offsets = values.offsets.to_numpy()
                    values = pa.BinaryArray.from_buffers(
                        pa.binary(), len(values), [None, pa.py_buffer((2 * (offsets - offsets[0])).astype(np.int32)), pa.py_buffer(halves)])
                arrays.append(values)
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return df.mapInArrow(run, _with_types(df, columns, BinaryType()))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The reverse of ``packed``."""
    def run(batches):
        for batch in batches:
            arrays = []
            for name, values in zip(batch.schema.names, batch.columns):
                if name in columns:
                    singles = pa.array(exchange.packed_values(values).astype(np.float32))
                    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset: values.offset + len(values) + 1]
                    values = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]) // 2, pa.int32()), singles)
                arrays.append(values)
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return df.mapInArrow(run, _with_types(df, columns, ArrayType(FloatType())))
