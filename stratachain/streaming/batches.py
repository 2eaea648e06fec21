"""The verbs on streams: each micro-batch is a frame of its own.

Windows over the left context need all rows of a partition, which a stream never has; so a chain is applied to each
micro-batch, and ``agg`` over the whole of a stream is left to the sink, as with any batch result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def each_batch(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that applies a transform, such as ``dims(...)`` or ``aggs(...)``, to each micro-batch and hands it to ``sink``."""
    return stream.writeStream.foreachBatch(lambda df, number: sink(transform(df), number))
