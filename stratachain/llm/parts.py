"""Texts written once in parts of bounded size, and exchanges of packed arrays between parts and groups.

A part's rows lie in one bucket of a table, so every later step meets them where they lie; only what steps tell one another is
shuffled, as blobs of arrays.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType

from .base import _remove, shared_dir, utf8


def _forget(spark: SparkSession, name: str, path: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session has ended, and its catalogue with it unless that outlives sessions
        pass
    _remove(spark, path)


def parted(rows: DataFrame, part_bytes: int, more: Callable[[np.ndarray, np.ndarray], list[bytes]] | None = None, extra: StructField | None = None) -> DataFrame:
    """``rows`` (with a column text) and __part, __row (number in its part), as a table bucketed by part; ``more`` makes a column ``extra``
    of texts' bytes and offsets. A part holds at most ``part_bytes`` of text, or one longer text."""
    spark = rows.sparkSession
    text = rows.columns.index("text")
    names = [*rows.columns, "__part", "__row", *([extra.name] if extra else [])]

    def run(batches):
        from pyspark import TaskContext

        number, row, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            data, at = utf8(batch.column(text))
            start, n_rows = 0, len(at) - 1
            while start < n_rows:
                room = int(np.searchsorted(at, at[start] + part_bytes - held, "right")) - 1
                stop = min(max(room, start + (held == 0)), n_rows)
                if stop > start:
                    n = stop - start
                    own = [pa.array(more(data, at[start : stop + 1]), pa.binary())] if more else []
                    yield pa.record_batch([*batch.slice(start, n).columns, pa.array(np.full(n, number)), pa.array(np.arange(row, row + n)), *own], names=names)
                    row, held = row + n, held + int(at[stop] - at[start])
                if stop < n_rows:
                    number, row, held = number + 1, 0, 0
                start = stop

    schema = StructType([*rows.schema.fields, StructField("__part", LongType()), StructField("__row", LongType()), *([extra] if extra else [])])
    name, path = f"parts_{uuid.uuid4().hex}", f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.mapInArrow(run, schema).write.option("compression", "zstd").option("path", path).bucketBy(buckets, "__part").saveAsTable(name)
    atexit.register(_forget, spark, name, path)
    return spark.table(name)


def blob(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, transposed by their items' bytes, which squeezes better."""
    out = [len(arrays).to_bytes(8, "little")]
    for a in arrays:
        raw = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b""
        out += [len(a).to_bytes(8, "little"), a.dtype.str.encode().ljust(8), raw]
    return b"".join(out)


def unpacked(packed: bytes) -> list[np.ndarray]:
    """The arrays of a blob."""
    at, out = 8, []
    for _ in range(int.from_bytes(packed[:8], "little")):
        n, kind = int.from_bytes(packed[at : at + 8], "little"), np.dtype(packed[at + 8 : at + 16].strip().decode())
        at += 16
        raw = np.frombuffer(packed, np.uint8, n * kind.itemsize, at)
        at += n * kind.itemsize
        out.append(np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind).ravel() if n else np.zeros(0, kind))
    return out


def least(a: np.ndarray) -> np.ndarray:
    """``a`` (no negative numbers) in the narrowest unsigned type that holds it."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def squeezed(packed: bytes) -> bytes:
    return len(packed).to_bytes(8, "little") + pa.compress(packed, codec="zstd", asbytes=True)


def restored(packed: pa.Scalar) -> list[np.ndarray]:
    """The arrays of a squeezed blob."""
    raw = packed.as_buffer()
    return unpacked(pa.decompress(raw.slice(8), int.from_bytes(raw.slice(0, 8).to_pybytes(), "little"), codec="zstd", asbytes=True))


def empty(schema: str | StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema).empty_table()
