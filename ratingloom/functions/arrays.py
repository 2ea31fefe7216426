"""Column expressions over factor arrays. All of them stay on the JVM side."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Up to this width one sum() per element stays inside whole-stage codegen (which stops at
# 100 columns) and is the fastest; wider arrays use the vector summarizer.
COLUMNWISE_WIDTH = 64


def dot(left: Column, right: Column, width: int | None = None) -> Column:
    """Inner product with a double accumulator (products keep the array type).

    Of a known, small ``width`` it is a plain sum, which is compiled; lambdas are interpreted value by value.
    """
    if width and width <= COLUMNWISE_WIDTH:
        return sum((F.get(left, F.lit(k)) * F.get(right, F.lit(k)) for k in range(width)), F.lit(0.0).cast("double"))
    products = F.zip_with(left, right, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda total, x: total + x)


def scaled(factor: Column, values: Column, width: int | None = None) -> Column:
    if width and width <= COLUMNWISE_WIDTH:
        return F.array(*[factor * F.get(values, F.lit(k)) for k in range(width)])
    return F.transform(values, lambda x: factor * x)


def array_type(precision: str) -> str:
    return "array<double>" if precision == "double" else "array<float>"


def sum_arrays(df: DataFrame, keys: list[str], column: str, width: int, extra=()) -> DataFrame:
    """Element-wise sum of an array column per key, combined on the map side.

    ``extra`` are further aggregates computed in the same pass.
    """
    if width <= COLUMNWISE_WIDTH:
        sums = [F.sum(F.col(column)[i].cast("double")).alias(f"_s{i}") for i in range(width)]
        wide = df.groupBy(*keys).agg(*sums, *extra)
        packed = F.array(*[F.col(f"_s{i}") for i in range(width)]).alias(column)
        names = [c for c in wide.columns if c not in keys and not c.startswith("_s")]
        return wide.select(*keys, packed, *names)
    vectors = df.withColumn(column, array_to_vector(F.col(column).cast("array<double>")))
    summed = vectors.groupBy(*keys).agg(Summarizer.sum(F.col(column)).alias(column), *extra)
    return summed.withColumn(column, vector_to_array(F.col(column)))
