"""Document fingerprints by winnowing.

Hashes of all ``GRAM``-byte grams of the UTF-8 text roll along; of each window of ``WINDOW`` grams the smallest is kept, of equal
ones the rightmost, with its position. So any match of ``WINDOW + GRAM - 1`` bytes leaves a common hash. Hashes have
32 bits. A fingerprint is the base64 text of (hash, byte position) pairs, little-endian unsigned 32-bit numbers in text order;
likeness is the Jaccard index of two fingerprints' distinct hashes.

Cases: null and empty texts have the empty fingerprint, and two empty ones have likeness 1; a text of fewer grams than a window is one
window; a shorter text than a gram is one gram; rows with equal ids follow one another by their texts; a null id
sorts first; the only row's next document is itself; an empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Roller, slices, utf8, window_min
from .op10_bpe import documents

GRAM, WINDOW = 12, 24


def winnow(data: np.ndarray, offsets: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and position of the grams kept, and where each row's begin."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    grams = size - gram + 1
    roll = Roller(data)
    low = np.uint64(0xFFFFFFFF)
    key = roll.grams(gram)
    key = (key & ~low) | (low - np.arange(len(key), dtype=np.uint64))  # smallest hash, then rightmost
    rows, keys = [], []
    full = np.flatnonzero(grams >= window)
    if len(full):
        m = window_min(key, window)
        inside = np.zeros(len(m) + 1, np.int8)
        inside[offsets[full]] += 1
        inside[offsets[full] + grams[full] - window + 1] -= 1
        at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        got = m[at]
        row = np.searchsorted(offsets, at, "right") - 1
        head = np.ones(len(got), bool)
        head[1:] = (got[1:] != got[:-1]) | (row[1:] != row[:-1])
        rows.append(row[head])
        keys.append(got[head])
    few = np.flatnonzero((grams > 0) & (grams < window))
    if len(few):
        edges = np.stack([offsets[few], offsets[few] + grams[few]], 1).ravel()
        padded = np.append(key, np.uint64(2**64 - 1))
        rows.append(few)
        keys.append(np.minimum.reduceat(padded, edges)[::2])
    short = np.flatnonzero((size > 0) & (grams <= 0))
    if len(short):
        rows.append(short)
        keys.append((roll.ranges(offsets[short], offsets[short + 1]) & ~low) | (low - offsets[short].astype(np.uint64)))
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    order = np.argsort(row, kind="stable")
    row, key = row[order], key[order]
    return (key >> np.uint64(32)).astype(np.uint32), (low - (key & low)).astype(np.int64) - offsets[row], np.searchsorted(row, np.arange(n + 1))


def _strings(h: np.ndarray, pos: np.ndarray, first: np.ndarray) -> list[str]:
    raw = np.stack([h, pos.astype(np.uint32)], 1).astype("<u4")
    return [base64.b64encode(raw[a:b].tobytes()).decode() for a, b in zip(first, first[1:], strict=False)]


def parse(fingerprint: str) -> np.ndarray:
    """(hash, position) pairs of a fingerprint."""
    return np.frombuffer(base64.b64decode(fingerprint), "<u4").reshape(-1, 2)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Jaccard index of the distinct hashes of two fingerprints, row by row; each: hashes and where rows begin."""
    n = len(a[1]) - 1
    sets = [np.unique(np.repeat(np.arange(n, dtype=np.uint64), np.diff(f)) << np.uint64(32) | h) for h, f in (a, b)]
    row = lambda x: np.bincount((x >> np.uint64(32)).astype(np.int64), minlength=n)
    both = row(np.intersect1d(*sets, assume_unique=True))
    either = row(sets[0]) + row(sets[1]) - both
    return np.where(either > 0, both / np.maximum(either, 1), 1.0)


def fingerprints(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` and the fingerprint of each row."""

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column(len(columns)))
            for i, j in slices(at):
                marks = winnow(data[at[i] : at[j]], at[i : j + 1] - at[i])
                yield pa.record_batch([*(c.slice(i, j - i) for c in batch.columns[: len(columns)]), pa.array(_strings(*marks), pa.string())], names=[*columns, "fingerprint"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, F.col("text").alias("_text")).mapInArrow(run, f"{schema}, fingerprint string")


def _chained(docs: DataFrame, ranges: int) -> DataFrame:
    """(doc_id, text, range, extra), each range of ids in one task in order, and after it, as extra, the row that follows it.

    The driver holds two numbers for each range.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select("doc_id", "text", key.alias("_key"))
    steps = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(rows.agg(F.percentile_approx("_key", steps, 100 * ranges).alias("b")).first()["b"] or [])) if steps else []
    at = F.aggregate(F.lit(bounds), F.lit(0), lambda n, b: n + (b <= F.col("_key")).cast("int")) if bounds else F.lit(0)
    rows = rows.withColumn("range", at)
    heads = sorted((r["range"], r["head"]) for r in rows.groupBy("range").agg(F.min("_key").alias("head")).collect())
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    extra = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))[F.col("_key")] if before else F.lit(None).cast("int")
    twice = F.filter(F.array(F.struct("range", F.lit(0).alias("extra")), F.when(extra.isNotNull(), F.struct(extra.alias("range"), F.lit(1).alias("extra")))), lambda x: x.isNotNull())
    spread = rows.select("doc_id", "text", "_key", F.explode(twice).alias("x")).select("doc_id", "text", "_key", "x.range", "x.extra")
    return spread.repartition(ranges, "range").sortWithinPartitions("range", "extra", "_key", "text").drop("_key")


def compare_edited(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text (its last half replaced by the start of the next document's)."""
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def emit(table: pa.Table, n: int) -> pa.RecordBatch:
        """Rows 0 to n-1 of the table, whose next documents are rows 1 to n."""
        texts = [t or "" for t in table.column("text").to_pylist()]
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts[:n], texts[1 : n + 1], strict=True)]
        h, pos, first = winnow(*utf8(pa.array(texts, pa.large_string())))
        eh, epos, efirst = winnow(*utf8(pa.array(edited, pa.large_string())))
        own, after = (h[: first[n]], first[: n + 1]), (h[first[1] :], first[1:] - first[1])
        sha = [hashlib.sha256(e.encode()).hexdigest() for e in edited]
        out = [table.column("doc_id").combine_chunks().slice(0, n), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array(sha), pa.array(_strings(h[: first[n]], pos[: first[n]], first[: n + 1])), pa.array(_strings(eh, epos, efirst)), pa.array(likeness(own, (eh, efirst))), pa.array(likeness(own, after))]
        return pa.record_batch([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            where, extra = table.column("range").to_numpy(), table.column("extra").to_numpy()
            size = np.cumsum([0, *(len(t or "") for t in table.column("text").to_pylist())])
            i = 0
            while i < len(where) - 1:
                # rows in a row whose next row is there; a range's extra rows only serve as next
                if extra[i]:
                    i += 1
                    continue
                stop = int(np.searchsorted(size, size[i] + (1 << 20), "right"))
                stop = min(max(stop, i + 2), len(where))
                other = np.flatnonzero((where[i:stop] != where[i]) | (extra[i:stop] > 0))
                if len(other):
                    stop = i + int(other[0]) + 1
                yield emit(table.slice(i, stop - i), stop - i - 1)
                i = stop - 1
            held = table.slice(len(where) - 1) if len(where) else held

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _chained(docs, ranges).mapInArrow(run, schema)


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(documents(spark, sf_dir))
