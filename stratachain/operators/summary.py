"""A column at a glance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lower import c


def describe(df: DataFrame, column: str) -> DataFrame:
    """One row about a column: its type, rows, missing and distinct values, least and greatest; of numbers the mean and quartiles as well."""
    kind, x = df.schema[column].dataType, c(column)
    parts = [F.lit(kind.simpleString()).alias("type"), F.count(F.lit(1)).alias("rows"), F.count_if(x.isNull()).alias("missing"), F.count_distinct(x).alias("distinct")]
    if not isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        parts += [F.min(x).alias("minimum"), F.max(x).alias("maximum")]
    if isinstance(kind, T.NumericType):
        parts += [F.avg(x).alias("mean"), F.percentile(x, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("quartiles")]
    return df.agg(*parts)
