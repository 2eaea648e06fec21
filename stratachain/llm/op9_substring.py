"""Removal of repeated byte strings across documents, by merged shard Burrows-Wheeler transforms.

The plan never moves texts between tasks. They are written once in parts of bounded size, bucketed by part, and
every later step meets a part's texts where they lie:

1. Whole copies of a text: all but the smallest id's are settled by one digest.
2. Every window of ``length`` bytes has a minimizer (the smallest hash of its ``GRAM``-byte grams), so equal windows
   have equal minimizers. Parts ask which minimizers another document holds too; the answer is two bits each.
3. Parts send the distinct segments (the windows of one shared minimizer end to end) with the smallest id that holds
   each. Where so many parts share a minimizer that its segments could overfill a task, single windows go out
   instead, dealt by their own hash.
4. A minimizer with a single form of segment is settled by its smallest id. Of all others
   each group builds Burrows-Wheeler transforms of shards and merges them by interleave refinement; runs
   with a common prefix of ``length`` bytes are the equal windows, and give each the smallest id that has it.
5. Parts remove the bytes that a window with a smaller id covers.

Cases: null and empty texts, and those shorter than ``length``, lose nothing; a row with a null id loses nothing and
takes nothing from others; rows with equal ids take nothing from each other; an empty table gives an empty result; other
columns pass through under their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .base import Roller, mix, slices, staged, utf8, window_max, window_min
from .bwt import repeated_minimum
from .op10_bpe import documents
from .parts import blob, empty, parted, unpacked

LENGTH, GRAM = 50, 24
#: Bytes of text in a part, and parts that may share a minimizer before its windows go out one by one.
PART, MANY = 12 << 20, 2000
#: Bytes of a part's text that a kernel takes at once, or one longer text; what is kept of a whole part is a few bytes a byte.
STEP = 1 << 19
#: What a group merges at once: its segments by a second hash of their minimizers.
SUBGROUPS = 32
_NO = np.int64(2**63 - 1)


def _parts(docs: DataFrame, part_bytes: int) -> DataFrame:
    """(__id, text, __rest, __part, __row, __digest), as a table bucketed by part: ids, texts, all other columns, and the row's
    number in its part."""
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), "text", F.struct(*(f"`{c}`" for c in docs.columns if c != "text")).alias("__rest"))
    return parted(rows, part_bytes, lambda data, at: [hashlib.md5(data[i:j]).digest() for i, j in zip(at, at[1:], strict=False)], StructField("__digest", BinaryType()))


class _Part:
    """A part's texts in row order, and the minimizers of those that aren't copies."""

    def __init__(self, table: pa.Table, length: int):
        table = table.sort_by("__row")
        self.table, self.length = table, length
        self.data, self.at = utf8(table.column("text"))
        self.id = table.column("__id").fill_null(-1).to_numpy()
        self.lonely = table.column("__id").is_null().to_numpy() | (np.diff(self.at) < length)

    def minimizers(self, copies: np.ndarray) -> None:
        """Sets start (first window), count (windows), h and row of each; and h's distinct values."""
        length, w = self.length, self.length - GRAM + 1
        skip = self.lonely.copy()
        skip[copies] = True
        start, count, hashes, rows = [], [], [], []
        none = np.uint64(2**64 - 1)
        for i, j in slices(self.at, STEP):
            x = self.data[self.at[i] : self.at[j]]
            if len(x) < length or skip[i:j].all():
                continue
            h = Roller(x).grams(GRAM)
            m = window_min(h, w)
            inside = np.zeros(len(m) + 1, np.int8)  # windows within one text that takes part
            own = np.flatnonzero(~skip[i:j]) + i
            inside[self.at[own] - self.at[i]] += 1
            inside[self.at[own + 1] - self.at[i] - length + 1] -= 1
            inside = np.cumsum(inside[:-1]) > 0
            pad = np.zeros(w - 1, np.uint64)
            best = window_max(np.concatenate([pad, np.where(inside, m, 0), pad]), w)
            pos = np.flatnonzero(best == h)
            wide = np.concatenate([pad, np.where(inside, m, none), pad])
            hit = wide[pos[:, None] + np.arange(w)] == h[pos, None]
            first = hit.argmax(1)
            some = hit[np.arange(len(pos)), first]
            pos, first, hit = pos[some], first[some], hit[some]
            start.append(pos - (w - 1) + first + self.at[i])
            count.append(w - first - hit[:, ::-1].argmax(1))
            hashes.append(h[pos])
        self.start = np.concatenate(start) if start else np.zeros(0, np.int64)
        self.count = np.concatenate(count) if count else np.zeros(0, np.int64)
        self.h = (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)) >> np.uint64(16)
        self.row = np.searchsorted(self.at, self.start, "right") - 1
        self.forms, self.form = np.unique(self.h, return_inverse=True)

    def shared(self, answer: pa.Table, groups: int) -> None:
        """Keep what other documents hold too; single windows for those that very many parts hold."""
        bucket = (mix(self.forms) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        state = np.zeros(len(self.forms), np.uint8)
        begin = np.searchsorted(bucket[order], np.arange(groups + 1))
        for b, flags in zip(answer.column("bucket").to_pylist(), answer.column("flags").to_pylist(), strict=True):
            state[order[begin[b] : begin[b + 1]]] = np.frombuffer(flags, np.uint8)
        got = state[self.form]
        keep, many = got == 1, got == 2
        start, count, h = self.start[keep], self.count[keep], self.h[keep]
        n = self.count[many]
        single = np.repeat(self.start[many], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.start = np.concatenate([start, single])
        self.count = np.concatenate([count, np.ones(len(single), np.int64)])
        self.row = np.searchsorted(self.at, self.start, "right") - 1
        end = self.start + self.count + self.length - 1
        self.segment = np.zeros(len(self.start), np.uint64)
        rolled = 0
        order = np.argsort(self.start, kind="stable")
        for i, j in slices(self.at, STEP):  # hashes of the segments' bytes
            to = int(np.searchsorted(self.start[order], self.at[j], "left"))
            own = order[rolled:to]
            rolled = to
            if len(own):
                self.segment[own] = Roller(self.data[self.at[i] : self.at[j]]).ranges(self.start[own] - self.at[i], end[own] - self.at[i])
        deal = np.concatenate([mix(h), self.segment[len(start) :]])
        target, deal = deal % np.uint64(groups), deal >> np.uint64(32)
        self.names, one, self.which = np.unique(self.segment, return_index=True, return_inverse=True)
        self.target, self.deal = target[one].astype(np.int64), deal[one].astype(np.uint32)
        self.low = np.full(len(self.names), _NO)
        np.minimum.at(self.low, self.which, self.id[self.row])
        self.from_, self.size, self.windows = self.start[one], (end - self.start)[one], self.count[one]


def _copies(right: pa.Table) -> np.ndarray:
    return right.column("copy").to_numpy().astype(np.int64)


def _ask(part: _Part, number: int, groups: int) -> pa.Table:
    bucket = (mix(part.forms) % np.uint64(groups)).astype(np.int64)
    low, high = np.full(len(part.forms), _NO), np.full(len(part.forms), -1)
    np.minimum.at(low, part.form, part.row)
    np.maximum.at(high, part.form, part.row)
    order = np.argsort(bucket, kind="stable")
    begin = np.searchsorted(bucket[order], np.arange(groups + 1))
    blobs, which = [], []
    for b in range(groups):
        own = order[begin[b] : begin[b + 1]]
        if len(own):
            f = part.forms[own]
            blobs.append(blob(np.diff(f, prepend=np.uint64(0)), (low[own] < high[own]).astype(np.uint8)))
            which.append(b)
    return pa.table({"bucket": pa.array(which, pa.int32()), "part": pa.array(np.full(len(which), number)), "ask": pa.array(blobs, pa.binary())})


def _answer(table: pa.Table, many: int) -> pa.Table:
    """Of each form that a part asks for: 0 no other document holds it, 1 some do, 2 very many parts do."""
    got = [unpacked(x) for x in table.column("ask").to_pylist()]
    forms = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in got])
    twice = np.concatenate([x[1] for x in got])
    order = np.argsort(forms, kind="stable")
    s = forms[order]
    head = np.ones(len(s), bool)
    head[1:] = s[1:] != s[:-1]
    run = np.cumsum(head) - 1
    parts = np.bincount(run)
    shared = (parts > 1) | (np.maximum.reduceat(twice[order], np.flatnonzero(head)) > 0)
    state = np.where(parts > many, 2, shared).astype(np.uint8)
    back = np.empty(len(s), np.uint8)
    back[order] = state[run]
    size = [len(x[0]) for x in got]
    flags = [x.tobytes() for x in np.split(back, np.cumsum(size)[:-1])]
    return pa.table({"part": table.column("part"), "bucket": table.column("bucket"), "flags": pa.array(flags, pa.binary())})


def _send(part: _Part, number: int, groups: int) -> pa.Table:
    order = np.argsort(part.target, kind="stable")
    begin = np.searchsorted(part.target[order], np.arange(groups + 1))
    blobs, which = [], []
    for g in range(groups):
        own = order[begin[g] : begin[g + 1]]
        if len(own):
            size = part.size[own]
            at = np.cumsum(size) - size
            flat = part.data[np.repeat(part.from_[own] - at, size) + np.arange(size.sum())]
            blobs.append(blob(part.names[own], part.low[own], size.astype(np.uint32), flat, part.deal[own]))
            which.append(g)
    return pa.table({"bucket": pa.array(which, pa.int32()), "part": pa.array(np.full(len(which), number)), "sent": pa.array(blobs, pa.binary())})


def _resolve(table: pa.Table, length: int) -> pa.Table:
    """Merge the group's shards; tell each part the smallest ids of those windows that a smaller id than its own holds."""
    got = [unpacked(x) for x in table.column("sent").to_pylist()]
    name = np.concatenate([x[0] for x in got])
    low = np.concatenate([x[1] for x in got])
    size = np.concatenate([x[2] for x in got]).astype(np.int64)
    flat = np.concatenate([x[3] for x in got])
    deal = np.concatenate([x[4] for x in got])
    begin = np.cumsum(size) - size
    forms, one, which = np.unique(name, return_index=True, return_inverse=True)
    least = np.full(len(forms), _NO)
    np.minimum.at(least, which, low)
    windows = size[one] - length + 1
    at = np.concatenate([[0], np.cumsum(windows)])
    # windows are equal in segments of one minimizer only: where that has one form, its windows are in no other
    _, group, many = np.unique(deal[one], return_inverse=True, return_counts=True)
    value = np.repeat(least, windows)
    sub = np.where(many[group] > 1, deal[one] % SUBGROUPS, SUBGROUPS)
    for b in range(SUBGROUPS):
        own = np.flatnonzero(sub == b)
        s = size[one[own]]
        first = np.concatenate([[0], np.cumsum(s)])
        strings = flat[np.repeat(begin[one[own]] - first[:-1], s) + np.arange(first[-1])]
        v, _ = repeated_minimum(strings, first, least[own], length)
        n = windows[own]
        value[np.repeat(at[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = v
    out, k = [], 0
    for x in got:
        w = which[k : k + len(x[0])]
        k += len(w)
        n = at[w + 1] - at[w]
        v = value[np.repeat(at[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        better = v < np.repeat(x[1], n)
        some = np.zeros(len(w), bool)
        some[np.repeat(np.arange(len(w)), n)[better]] = True
        out.append(blob(np.flatnonzero(some).astype(np.uint32), v[np.repeat(some, n)]))
    return pa.table({"part": table.column("part"), "bucket": table.column("bucket"), "low": pa.array(out, pa.binary())})


def _cut(part: _Part, low: pa.Table, copies: np.ndarray, groups: int, as_text: bool) -> pa.Table:
    order = np.argsort(part.target, kind="stable")
    begin = np.searchsorted(part.target[order], np.arange(groups + 1))
    first = np.cumsum(part.windows) - part.windows
    value = np.repeat(part.low, part.windows)  # of each window of each distinct segment
    for g, told in zip(low.column("bucket").to_pylist(), low.column("low").to_pylist(), strict=True):
        some, v = unpacked(told)
        own = order[begin[g] : begin[g + 1]][some]
        n = part.windows[own]
        value[np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = v
    size = np.diff(part.at)
    whole = np.zeros(len(size), bool)
    whole[copies] = True
    whole &= ~part.lonely
    removed, spans, rest = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), []
    order = np.argsort(part.start, kind="stable")
    place = np.searchsorted(part.start[order], part.at)  # of each row's windows in this order
    for i, j in slices(part.at, STEP):
        own = order[place[i] : place[j]]
        n = part.count[own]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        gone = value[np.repeat(first[part.which[own]], n) + step] < np.repeat(part.id[part.row[own]], n)
        at = part.at[i : j + 1] - part.at[i]
        mark = np.zeros(at[-1] + part.length - 1, bool)
        mark[(np.repeat(part.start[own] - part.at[i], n) + step)[gone] + part.length - 1] = True  # a window begins
        covered = window_max(mark, part.length) | np.repeat(whole[i:j], size[i:j])
        removed[i:j] = np.diff(np.append(0, np.cumsum(covered))[at])
        edge = covered.copy()
        edge[1:] &= ~covered[:-1]
        inner = at[:-1][size[i:j] > 0]
        edge[inner] = covered[inner]
        spans[i:j] = np.diff(np.append(0, np.cumsum(edge))[at])
        kept = part.data[part.at[i] : part.at[j]][~covered]
        left = np.append(0, np.cumsum(size[i:j] - removed[i:j]))
        rest += [kept[a:b].tobytes() for a, b in zip(left, left[1:], strict=False)]
    if as_text:
        text = [x.decode(errors="ignore") for x in rest]
        was_null = part.table.column("text").is_null().to_numpy()
        rest = pa.array(text, pa.string(), mask=was_null)
    else:
        rest = pa.array(rest, pa.binary())
    made = {"n_bytes": pa.array(size), "n_removed": pa.array(removed), "n_spans": pa.array(spans), "kept": rest}
    return pa.table({"__rest": part.table.column("__rest")} | made)


def remove_repeats(docs: DataFrame, length: int = LENGTH, as_text: bool = False, part_bytes: int = PART, many: int = MANY) -> DataFrame:
    """``docs`` without text, and n_bytes, n_removed, n_spans (maximal runs removed) and kept (the bytes that stay); these four
    names are the operator's, also where ``docs`` has columns of such names. With ``as_text``: ``docs`` with the text that stays,
    without characters that were cut in part. ``doc_id`` must be integral."""
    parts = _parts(docs, part_bytes)
    short = parts.select("__part", "__row", "__id", "__digest")
    texts = short.where("__id is not null").groupBy("__digest").agg(F.min("__id").alias("least"), F.max("__id").alias("most")).where("least < most")
    copies = staged(short.join(texts, "__digest").where("__id > least").groupBy("__part").agg(F.collect_list("__row").alias("copies")), "copies")
    copies = copies.select("__part", F.explode("copies").alias("copy"))
    groups = max(1, short.agg(F.count_distinct("__part")).first()[0])
    own = parts.select("__part", "__row", "__id", "text")

    def ask(key, left, right):
        if not len(left):
            return empty("bucket int, part long, ask binary")
        p = _Part(left, length)
        p.minimizers(_copies(right))
        return _ask(p, key[0].as_py(), groups)

    asked = own.groupBy("__part").cogroup(copies.groupBy("__part")).applyInArrow(ask, "bucket int, part long, ask binary")
    answers = staged(asked.groupBy("bucket").applyInArrow(lambda t: _answer(t, many), "part long, bucket int, flags binary"), "answers")

    def told(left, right):
        """A part after the answers; ``right`` bears copies and answers."""
        p = _Part(left, length)
        kind = right.column("copy").is_valid()
        p.minimizers(_copies(right.filter(kind)))
        p.shared(right.filter(right.column("flags").is_valid()), groups)
        return p

    none = lambda kind: F.lit(None).cast(kind)
    facts = copies.select("__part", "copy", none("int").alias("bucket"), none("binary").alias("flags"), none("binary").alias("low"))
    facts = facts.unionByName(answers.select(F.col("part").alias("__part"), none("long").alias("copy"), "bucket", "flags", none("binary").alias("low")))

    def send(key, left, right):
        return _send(told(left, right), key[0].as_py(), groups) if len(left) else empty("bucket int, part long, sent binary")

    sent = own.groupBy("__part").cogroup(facts.groupBy("__part")).applyInArrow(send, "bucket int, part long, sent binary")
    found = staged(sent.groupBy("bucket").applyInArrow(lambda t: _resolve(t, length), "part long, bucket int, low binary"), "found")
    facts = facts.unionByName(found.select(F.col("part").alias("__part"), none("long").alias("copy"), "bucket", none("binary").alias("flags"), "low"))
    kind = parts.schema["__rest"]
    schema = StructType([kind, *(StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")), StructField("kept", StringType() if as_text else BinaryType())])

    def cut(left, right):
        if not len(left):
            return empty(schema)
        p = told(left, right)
        return _cut(p, right.filter(right.column("low").is_valid()), _copies(right.filter(right.column("copy").is_valid())), groups, as_text)

    out = parts.drop("__digest").groupBy("__part").cogroup(facts.groupBy("__part")).applyInArrow(cut, schema)
    if as_text:
        return out.select(*(F.col("kept").alias("text") if c == "text" else F.col(f"__rest.`{c}`") for c in docs.columns))
    made = ["n_bytes", "n_removed", "n_spans", "kept"]
    return out.select(*(F.col(f"__rest.`{c}`") for c in docs.columns if c not in ("text", *made)), *made)


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
