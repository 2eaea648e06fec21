"""Best-two-fit packing of token sequences.

A bin is filled greedily, largest first. If a gap stays that no unpacked piece fits, the bin's smallest piece is
replaced by two unpacked ones that fill the gap so widened more tightly. Only lengths are packed: pieces are dealt
into groups of bounded size by a hash, each packed on its own, so a group costs at most its last, partly filled bin.

Cases: null and empty texts are one piece, the end id alone; longer documents than a sequence are cut, the rest
first; repeated rows are packed each; an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import staged, utf8
from .bpe import codec
from .op10_bpe import default_tokenizer, documents

CAPACITY = 2048
#: Pieces packed together: a bound on a task's memory.
GROUP = 100_000


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; no piece may be longer than ``capacity``."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(n - 1, -1, -1):
        free[lengths[i]].append(i)
    mask = sum(1 << k for k in range(capacity + 1) if free[k])  # bit k: a piece of length k is unpacked
    ones = [(1 << (k + 1)) - 1 for k in range(capacity + 1)]
    number = 0
    while mask:
        gap, held = capacity, []
        while m := mask & ones[gap]:
            size = m.bit_length() - 1
            held.append((size, free[size].pop()))
            if not free[size]:
                mask ^= 1 << size
            gap -= size
        if gap and mask and len(held) > 1:
            small, room = held[-1][0], gap + held[-1][0]
            best, pair = small, None
            low = mask & ones[room // 2]
            while low:
                a = (low & -low).bit_length() - 1
                low &= low - 1
                rest = mask & ones[room - a]
                if len(free[a]) < 2:
                    rest &= ~(1 << a)
                b = rest.bit_length() - 1
                if b >= a and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
            if pair:
                size, i = held.pop()
                for x in pair:
                    held.append((x, free[x].pop()))
                for x in pair:
                    if not free[x]:
                        mask &= ~(1 << x)
                free[size].append(i)
                mask |= 1 << size
        at = 0
        for size, i in held:
            bins[i], offsets[i] = number, at
            at += size
        number += 1
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, cut where longer than a sequence."""

    def run(batches):
        c = codec(tokenizer)
        for batch in batches:
            key = batch.column(0)
            data, at = utf8(batch.column(1))
            for i, ids, first in c.batches(data, at):
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for k in range(len(first) - 1):
                    own = np.append(ids[first[k] : first[k + 1]], end_id).astype("<u4")
                    cuts = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                    for p in range(len(cuts) - 1):
                        part = own[cuts[p] : cuts[p + 1]]
                        row.append(i + k)
                        piece.append(p)
                        start.append(cuts[p])
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            kept.append(part.astype(np.int32))
                out = [key.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.record_batch([*out, pa.array(kept, pa.list_(pa.int32()))], names=[*names, "ids"]) if keep_ids else pa.record_batch(out, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``cut`` (a stored table with ``length``) with sequence_id and offset; full pieces are sequences of their own."""
    part = cut.where(F.col("length") < capacity)
    groups = max(1, -(-part.count() // group))
    names = cut.columns
    keys = [F.xxhash64("doc_id", "piece", "start", "ids_crc32")]

    def run(table: pa.Table) -> pa.Table:
        bins, offsets = best_two_fit(table.column("length").to_numpy(), capacity)
        number = bins * groups + table.column("_group").to_numpy()
        return table.select(names).append_column("sequence_id", pa.array(number, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    packed = part.withColumn("_group", F.pmod(*keys, F.lit(groups)).cast("long")).groupBy("_group").applyInArrow(run, schema)
    full = cut.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(staged(pieces(docs, tokenizer, capacity), "pieces"), capacity)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), default_tokenizer())
