"""MinHash near-dedup by SuperMinHash: signatures, banding, verification on full sets, union-find grouping.

Texts with equal shingle sets (by a 128-bit digest) are one vertex, so copies cost one row each. Each bucket of a band first compares all
its vertices with one of them, the hub, which joins a group of near copies in linear work; vertices of a bucket that are
still apart are compared with a second hub. What is then still apart is told by its residual: the shingles in which a vertex
and its hub differ. Two that are alike share about half of their residuals, though members of one family share little
of them. So an inverted index on the rarest shingles of residuals has small groups; each compares its vertices with one of
them, again and again while that joins any, and the pairs still apart in a group that exact bounds (size, place, bitmap)
admit are verified. So no pair within a bucket is left open unless both are already in one component or a bound rules the link out.

Cases: null and empty texts, and texts of white space, have no shingles and are linked with nothing; shorter texts than a
shingle are one shingle; repeated rows are each returned, in one component; an empty table gives an empty
result; only ``doc_id`` and ``text`` are read; a null id is no component's smallest id.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import components as union_find
from .base import LOWER, Roller, brief_shuffles, mix, slices, staged, utf8, words
from .components import components, components_alone
from .op10_bpe import documents

BANDS, ROWS = 20, 4
#: Numbers of 64 bits in a residual's bitmap.
BITS = 4
#: Rows that a row of the residual index meets on average from which on groups are compared with one of theirs once more.
CROWD = 128


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, and where each row's begin."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    h = Roller(data).ranges(starts, ends)
    n_words = np.diff(first)
    salt = mix(np.arange(1, size + 2, dtype=np.uint64)) | np.uint64(1)
    n = len(h)
    every = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        every += h[k : k + len(every)] * salt[k]
    row = np.repeat(np.arange(len(n_words)), n_words)
    inside = row[: len(every)] == row[size - 1 :] if n >= size else np.zeros(0, bool)
    full, full_row = mix(every[inside] + np.uint64(size)), row[: len(every)][inside]
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    folded = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        on = n_words[short] > k
        folded[on] += h[first[short[on]] + k] * salt[k]
    folded = mix(folded + n_words[short].astype(np.uint64))
    h, row = np.concatenate([full, folded]), np.concatenate([full_row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(n_words) + 1))


def superminhash(h: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """(rows, m) signatures. Step j gives each element's j-th place of its own random permutation the value j + r;
    a row stops once no place can become smaller."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    sig = np.full((n, m), np.inf)
    flat = sig.ravel()
    live = np.arange(len(h))
    perm = None
    for j in range(m):
        keep = (sig.max(1) > j)[row[live]]
        if not keep.all():
            live = live[keep]
            perm = perm[keep] if perm is not None else None
            if j == 1:
                k0 = k0[keep]
        if not len(live):
            break
        x = mix(h[live] + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        r = (x >> np.uint64(11)).astype(np.float64) * 2.0**-53
        k = j + (mix(x) % np.uint64(m - j)).astype(np.int64)
        if j == 0:
            at, k0 = k, k
        else:
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint16), (len(live), 1))
                perm[np.arange(len(live)), k0] = 0
                perm[:, 0] = k0
            i = np.arange(len(live))
            at = perm[i, k].astype(np.int64)
            perm[i, k] = perm[:, j]
            perm[:, j] = at
        np.minimum.at(flat, row[live] * m + at, r + j)
    return sig


def _digests(h: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """128 bits of each row's set, whatever its order; none of an empty set."""
    count = np.diff(first)
    halves = []
    for salt in (1, 0x9E3779B97F4A7C15):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(salt)))])
        halves.append(mix(total[first[1:]] - total[first[:-1]] + count.astype(np.uint64)))
    raw = np.stack(halves, 1).tobytes()
    return [raw[16 * k : 16 * k + 16] if n else None for k, n in enumerate(count)]


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, digest, bands): digest is null without shingles."""
    salt = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches):
        for batch in batches:
            key = batch.column(0)
            data, at = utf8(batch.column(1))
            for i, j in slices(at):
                h, first = shingles(data[at[i] : at[j]], at[i : j + 1] - at[i], size)
                count = np.diff(first)
                bits = np.ascontiguousarray(superminhash(h, first, bands * rows)).view(np.uint64) * salt
                band = mix(bits.reshape(j - i, bands, rows).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * bands), pa.array(band.ravel()))
                yield pa.record_batch([key.slice(i, j - i), pa.array(count), pa.array(_digests(h, first), pa.binary()), lists], names=["doc_id", "n_shingles", "digest", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, bands array<long>")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(digest, shingles array<long>) of each row that has any."""

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column(0))
            for i, j in slices(at):
                h, first = shingles(data[at[i] : at[j]], at[i : j + 1] - at[i], size)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.record_batch([pa.array(_digests(h, first), pa.binary()), lists], names=["digest", "shingles"])

    return docs.select("text").mapInArrow(run, "digest binary, shingles array<long>").where("digest is not null")


def _sets(vertices: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(digest, s): the full shingle sets of the vertices given, from whole texts."""
    ids = classes.join(vertices, "digest").select("doc_id")
    sets = shingle_sets(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), size)
    return staged(sets.join(vertices, "digest", "left_semi").groupBy("digest").agg(F.first("shingles").alias("s")), "sets")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("a").union(pairs.select("b")).distinct().toDF("digest")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of digests whose full sets are alike enough."""
    a, b = sets.toDF("a", "s"), sets.toDF("b", "t")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", F.size(F.array_intersect("s", "t")).alias("i"), (F.size("s") + F.size("t")).alias("u"))
    return both.where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("u") - F.col("i"))).select("a", "b")


def _residuals(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(t, v, n, k, place, b0..): an inverted index of the members' (hub, v) residuals D, their differences from the hub's set; t
    tells hub and token, by hash.

    With n(v) shingles and k(v) = |D(v)|, x and y are alike if and only if |D(x) & D(y)| >= (e(x) + e(y)) / 2, where
    e = k - n (100 - p) / (100 + p). A pair of which one isn't linked with the hub has e(x) + e(y) > 0, so it shares a token. Tokens
    are ordered by how many members have them; a pair's first common token has no place beyond k - (e(x) + e(y)) / 2 + 1 in either, so
    the index holds no later ones.
    """
    one, two = sets.toDF("v", "s"), sets.toDF("hub", "t")
    m = members.where("v != hub").join(one, "v").join(two, "hub")
    m = m.select("hub", "v", F.size("s").alias("n"), F.concat(F.array_except("s", "t"), F.array_except("t", "s")).alias("d"))
    bits = [F.expr(f"aggregate(d, 0L, (a, g) -> a | if(pmod(g >> 6, {BITS}) = {k}, shiftleft(1L, cast(g & 63 as int)), 0L))").alias(f"b{k}") for k in range(BITS)]
    m = staged(m.select("hub", "v", "n", "d", F.size("d").alias("k"), *bits), "members")
    excess = F.col("k") - F.col("n") * (100 - percent) / (100.0 + percent)
    low = m.groupBy("hub").agg(F.min(excess).alias("low"))
    last = F.col("k") - F.ceil((excess + F.col("low")) / 2 - 1e-6) + 1
    token = m.join(low, "hub").select("hub", "v", last.alias("last"), F.explode("d").alias("g"))
    common = token.groupBy("hub", "g").agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy("hub", "v").orderBy("m", "g")
    token = token.join(common, ["hub", "g"]).withColumn("place", F.row_number().over(w)).where("m > 1 and place <= last")
    return staged(token.join(m.drop("d"), ["hub", "v"]).select(F.xxhash64("hub", "g").alias("t"), "v", "n", "k", "place", *(f"b{k}" for k in range(BITS))), "tokens")


def _admitted(percent: int) -> Column:
    """Whether x and y, that share a token, can be alike: by size, by the tokens from this one on, and by bitmaps of their residuals."""
    need = (F.col("x.k") + F.col("y.k") - (F.col("x.n") + F.col("y.n")) * (100 - percent) / (100.0 + percent)) / 2 - 1e-6
    size = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    rest = F.least(F.col("x.k") - F.col("x.place"), F.col("y.k") - F.col("y.place")) + 1 >= need
    lone = lambda p, q: sum(F.bit_count(F.col(f"{p}.b{k}").bitwiseAND(F.bitwise_not(f"{q}.b{k}"))) for k in range(BITS))
    return size & rest & (F.col("x.k") - lone("x", "y") >= need) & (F.col("y.k") - lone("y", "x") >= need)


def _paired(x: DataFrame, y: DataFrame, percent: int, more: Column) -> DataFrame:
    """Pairs (a, b) of the index's rows x and y of one hub and token, in different components, that can be alike."""
    both = x.alias("x").join(y.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.c") != F.col("y.c")) & more & _admitted(percent))
    return both.select(F.least("x.v", "y.v").alias("a"), F.greatest("x.v", "y.v").alias("b")).distinct()


def _merged(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (v, c) after further links: only the components that these touch are looked at, or, of few rows, all in one task."""
    if links.count() + (comp.count() if comp is not None else 0) <= union_find.ALONE:
        return components_alone(links if comp is None else comp.toDF("a", "b").union(links))
    if comp is None:
        return components(links)
    ends = links
    for side in ("a", "b"):
        ends = ends.join(comp.toDF(side, f"{side}_c"), side, "left").withColumn(side, F.coalesce(f"{side}_c", side)).drop(f"{side}_c")
    more = components(ends.select("a", "b").distinct())
    moved = comp.join(more.toDF("c", "new"), "c", "left").select("v", F.coalesce("new", "c").alias("c"))
    return staged(moved.union(more.join(comp, "v", "left_anti").select("v", "c")), "labels")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): ``size`` words a shingle, links from ``percent`` % Jaccard likeness on."""
    with brief_shuffles(docs.sparkSession):  # each table is written once, and what one has shuffled need not lie beside the next one's
        return _grouped(docs, size, percent, bands, rows)


def _grouped(docs: DataFrame, size: int, percent: int, bands: int, rows: int) -> DataFrame:
    signed = staged(signatures(docs, size, bands, rows), "signatures")
    one = signed.where("digest is not null and doc_id is not null")
    classes = staged(one.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "classes")
    spread = classes.select("digest", F.explode("bands").alias("key"))
    hubs = spread.groupBy("key").agg(F.min("digest").alias("hub"), F.max("digest").alias("top")).where("hub < top").select("key", "hub")
    buckets = staged(spread.join(hubs, "key").select("key", "hub", F.col("digest").alias("v")), "buckets")

    tested = staged(buckets.where("v != hub").select(F.col("hub").alias("a"), F.col("v").alias("b")).distinct(), "pairs")
    sets = _sets(_ends(tested), classes, docs, size)  # of all that lie in buckets: whatever is compared later is among them
    comp = _merged(None, staged(_verified(tested, sets, percent), "near"))

    def verify(pairs: DataFrame, sets: DataFrame) -> int:
        """Joins components by what holds of ``pairs``; the number of new links."""
        nonlocal comp, tested
        pairs = staged(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if not pairs.limit(1).count():
            return 0
        tested = tested.union(pairs)
        found = staged(_verified(pairs, sets, percent), "near")
        n = found.count()
        if n:
            comp = _merged(comp, found)
        return n

    def now(rows: DataFrame) -> DataFrame:
        return rows.join(comp, "v", "left").withColumn("c", F.coalesce("c", "v"))

    def apart(rows: DataFrame) -> DataFrame:
        """The buckets' rows given, where a bucket has more than one component among them; lead: that of its first."""
        own = now(rows)
        return own.join(own.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min_by("c", "v").alias("lead")).where("low < high"), "key")

    own = apart(buckets)
    second = own.where("c != lead").groupBy("key").agg(F.min(F.struct("v", "c")).alias("h")).select("key", "h.v", "h.c").toDF("key", "other", "other_c")
    second = staged(own.select("key", "hub", "v", "c").join(second, "key"), "seconds")
    verify(second.where("c != other_c").select(F.least("other", "v").alias("a"), F.greatest("other", "v").alias("b")).distinct(), sets)

    # both hubs are done with; pairs are left where the rest of a bucket is apart
    members = staged(apart(second.where("v != hub and v != other").select("key", "hub", "v")).select("hub", "v").distinct(), "apart")
    if members.limit(1).count():
        sets = staged(sets.join(members.select(F.col("v").alias("digest")).union(members.select("hub")).distinct(), "digest", "left_semi"), "sets")
        tokens = _residuals(members, sets, percent)
        first = 0
        for turn in count():
            index = now(tokens)
            mixed = index.groupBy("t").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("low"), F.max("c").alias("high"), F.min_by(F.struct(*index.columns), F.xxhash64("c", "v", F.lit(turn))).alias("r"))
            mixed = staged(mixed.where("low < high").drop("low", "high"), "groups")
            rows, meets = mixed.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum(F.col("m") * F.col("m")), F.lit(0))).first()
            if meets <= CROWD * rows:
                break
            found = verify(_paired(index, mixed.select("r.*"), percent, F.lit(True)), sets)
            first = first or found
            if found * 10 <= first:
                break  # what is left is found below
        index = staged(now(tokens).join(mixed, "t", "left_semi"), "index")
        verify(_paired(index, index, percent, F.col("x.v") < F.col("y.v")), sets)
    member = classes.select(F.col("digest").alias("v"), "doc_id").join(comp, "v", "left").select("v", "doc_id", F.coalesce("c", "v").alias("c"))
    least = member.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    of = member.join(least, "c").select(F.col("v").alias("digest"), "component_id")
    out = signed.join(of, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=2)
