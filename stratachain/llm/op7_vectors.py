"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are rotated and split into blocks of few dimensions. If two are within a squared distance of 2 - 2 cos, some block's
share of it is within the block's share of the budget (in proportion to its size), so each block is joined by range and the union of
the candidates is verified exactly, in double precision, on the vectors as they came. A label of at most ``CELL`` vectors is joined as one
cell in each block; of a larger one each block has a grid over its first two coordinates. A pair counts in the first block that finds
it only, so counts add up and no pair is ever written: a task returns each vector's links and a forest that spans them. Equal vectors of
one label (by 128 bits of hash) are one class with a count. A grid cell with more vectors than ``CELL`` is cut into chunks, and each two
chunks meet in a task of their own.

Cases: a null, empty or zero vector, one with null or non-finite components and one without label link with nothing and are
returned with 0 links; vectors of different lengths aren't compared; repeated rows are linked copies; an empty table gives
an empty result; only ``vec_id``, ``embedding`` and ``label`` are read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .base import staged
from .components import components

LIKE = 0.93
BLOCK = 8
CELL = 8192


@cache
def _rotation(dims: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(17).normal(size=(dims, dims)))[0]


def _turned(x: np.ndarray) -> np.ndarray:
    """Rotated unit vectors; without BLAS, so that a vector gives the same bits in any company."""
    x = x / np.sqrt(np.einsum("ij,ij->i", x, x, optimize=False))[:, None]
    return np.einsum("ij,jk->ik", x, _rotation(x.shape[1]), optimize=False)


def _blocks(dims: int, like: float) -> list[tuple[int, int, float]]:
    """First and last dimension and squared-distance budget of each block."""
    cuts = np.linspace(0, dims, max(1, round(dims / BLOCK)) + 1).astype(int)
    return [(int(a), int(b), (2 - 2 * like + 1e-9) * (b - a) / dims) for a, b in zip(cuts, cuts[1:], strict=False)]


#: A cell's own vectors, and the half of its neighbours whose vectors visit it.
_VISITS = [(0, 0), (-1, 0), (0, -1), (-1, -1), (-1, 1)]


def _cells(classes: DataFrame, like: float, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` of the classes, block, gx, gy and home for each cell that a vector lies in or visits."""

    def run(batches):
        for batch in batches:
            size = np.array([len(v) for v in batch.column("vec").to_pylist()])
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            first = np.concatenate([[0], np.cumsum(size)])
            wide = batch.column("wide").to_numpy(zero_copy_only=False)
            for dims in np.unique(size):
                for grid in (False, True):
                    row = np.flatnonzero((size == dims) & (wide == grid))
                    if not len(row):
                        continue
                    own = batch.select(list(columns)).take(pa.array(row))
                    x = _turned(flat[first[row][:, None] + np.arange(dims)]) if grid else None
                    for k, (a, b, budget) in enumerate(_blocks(int(dims), like)):
                        gx, gy = (np.floor(x[:, i] / budget**0.5).astype(np.int32) for i in (a, min(a + 1, b - 1))) if grid else np.zeros((2, len(row)), np.int32)
                        for dx, dy in _VISITS if grid else _VISITS[:1]:
                            yield pa.record_batch([*own.columns, pa.array(np.full(len(row), k, np.int32)), pa.array(gx + np.int32(dx)), pa.array(gy + np.int32(dy)), pa.array(np.full(len(row), (dx, dy) == (0, 0)))], names=[*columns, "block", "gx", "gy", "home"])

    schema = ", ".join(f"`{c}` {classes.schema[c].dataType.simpleString()}" for c in columns)
    return classes.select(*dict.fromkeys([*columns, "vec", "wide"])).mapInArrow(run, f"{schema}, block int, gx int, gy int, home boolean")


def _met(table: pa.Table, block: int, one: int, two: int, like: float) -> pa.Table:
    """Links of a cell's chunks ``one`` and ``two``: each linked vector's number of linked vectors, and its root in the task's forest."""
    n_rows = len(table)
    vec = table.column("vec").combine_chunks()
    x = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n_rows, -1)
    c, count = table.column("c").to_numpy(), table.column("n").to_numpy()
    home, chunk = table.column("home").to_numpy(zero_copy_only=False), table.column("chunk").to_numpy()
    turned = _turned(x)
    blocks = _blocks(x.shape[1], like)
    a, b, budget = blocks[block]
    part = turned[:, a:b].astype(np.float32)
    square = (part * part).sum(1)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x, optimize=False))
    left = np.flatnonzero(chunk == one)
    right = np.flatnonzero(chunk == two)
    found = []
    for k in range(0, len(left), 512):
        i, j = left[k : k + 512], right[k:] if one == two else right
        near = square[i, None] + square[j] - 2 * (part[i] @ part[j].T) <= budget + 1e-5
        p, q = np.nonzero(near)
        p, q = i[p], j[q]
        on = (home[p] | home[q]) & ((p < q) if one == two else True) & (c[p] != c[q])
        p, q = p[on], q[on]
        for m in range(0, len(p), 1 << 16):
            u, v = p[m : m + (1 << 16)], q[m : m + (1 << 16)]
            gap = (turned[u] - turned[v]) ** 2
            hit = gap[:, a:b].sum(1) <= budget
            for a0, b0, budget0 in blocks[:block]:
                hit &= gap[:, a0:b0].sum(1) > budget0
            u, v = u[hit], v[hit]
            cos = np.einsum("ij,ij->i", x[u], x[v], optimize=False) / (norm[u] * norm[v])
            found.append(np.stack([u[cos >= like], v[cos >= like]]))
    pair = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
    links = np.bincount(pair[0], count[pair[1]], n_rows) + np.bincount(pair[1], count[pair[0]], n_rows)
    root = np.arange(n_rows)
    while True:
        low = np.minimum(root[pair[0]], root[pair[1]])
        new = root.copy()
        np.minimum.at(new, root[pair[0]], low)
        np.minimum.at(new, root[pair[1]], low)
        new = new[new]
        new = np.minimum(new, new[root])
        if (new == root).all():
            break
        root = new
    some = np.flatnonzero(links > 0)
    return pa.table({"c": pa.array(c[some]), "links": pa.array(links[some].astype(np.int64)), "root": pa.array(c[root[some]])})


def near_vectors(vectors: DataFrame, like: float = LIKE, cell: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of all rows of (vec_id, embedding, label)."""
    kind = vectors.schema["embedding"].dataType
    kind = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    v = vectors.select("vec_id", "label", F.col("embedding").cast(f"array<{kind}>").alias("vec"))
    good = F.forall("vec", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("vec", lambda e: e != 0) & F.col("label").isNotNull()
    v = v.withColumns({f"h{k}": F.when(good, F.xxhash64(F.lit(k), "label", "vec", F.size("vec"))) for k in (1, 2)})
    classes = v.where("h1 is not null").groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    classes = staged(classes.withColumns({"dims": F.size("vec"), "c": F.monotonically_increasing_id()}), "vectors")
    labels = classes.groupBy("label", "dims").count().where(F.col("count") > cell).select("label", "dims", F.lit(True).alias("wide"))
    told = classes.join(labels, ["label", "dims"], "left").withColumn("wide", F.coalesce("wide", F.lit(False)))
    cells = _cells(told, like, ("c", "n", "label", "vec", "dims"))
    key = ["label", "dims", "block", "gx", "gy"]
    large = _cells(told.where("wide"), like, ("label", "dims")).groupBy(*key).count().where(F.col("count") > cell).select(*key, F.ceil(F.col("count") / (cell // 2)).cast("int").alias("chunks"))
    large = staged(large, "cells")
    cut = cells.join(large, key, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda t: F.struct(F.least(t, F.col("chunk")).alias("one"), F.greatest(t, F.col("chunk")).alias("two")))
    cut = cut.withColumn("meet", F.explode(meets)).select(*key, "meet.one", "meet.two", "c", "n", "vec", "home", "chunk")

    def run(k, table):
        return _met(table, k[2].as_py(), k[5].as_py(), k[6].as_py(), like)

    met = staged(cut.groupBy(*key, "one", "two").applyInArrow(run, "c long, links long, root long"), "met")
    comp = components(met.select(F.col("root").alias("a"), F.col("c").alias("b")).distinct())
    links = met.groupBy("c").agg(F.sum("links").alias("links"))
    facts = classes.select("c", "n", "least").join(links, "c", "left").join(comp.toDF("c", "comp"), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    least = facts.groupBy("comp").agg(F.min("least").alias("component_id"))
    facts = facts.join(least, "comp").join(classes.select("c", "h1", "h2"), "c").select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = v.select("vec_id", "h1", "h2").join(facts, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
