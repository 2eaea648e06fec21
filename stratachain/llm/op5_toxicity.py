"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with word ends); its vector is the mean of the n-grams' vectors, and a
linear softmax over the vector gives its odds. A text's odds are the mean of its ``TOP`` highest distinct words' odds and, where it is above 0,
the mean of all distinct words' odds: a text of many mildly toxic words is more toxic than one of two, and a long harmless text doesn't
drown a few words. A misspelt or inflected form that never occurred in training is scored by the n-grams that it shares.

Training rows are a bounded sample of the labelled rows (``MOST_TOXIC`` toxic and ``MOST_CLEAN`` others, by hash of the id);
whole texts, labels only from rows that aren't held out. Executors cut them to their distinct words and one task trains on these, so
that no text reaches the driver. Scoring takes every row, and reads its text only.

Cases: null, empty and white-space texts score as the model's bias without words; repeated rows are scored each, and are one row of training; of an
id's different texts the least in order trains; with
no labelled rows of both kinds every text scores 0; an empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import LOWER, Roller, held_out, slices, utf8, words
from .op10_bpe import documents

MOST_TOXIC, MOST_CLEAN = 1200, 2400
#: Bytes of training text cut to words at once.
TRAINING_SLICE = 1 << 19
BUCKETS, WIDTH = 1 << 17, 8
SHORTEST, LONGEST = 3, 6
#: Words that count for a text besides the mean of all.
TOP = 2
CUT = 0.7

#: What counts as a letter of a word: digits, letters and bytes of non-ASCII characters.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_MARKED = LOWER.copy()
_MARKED[~_WORD] = 32


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The slice's lowered bytes, starts and ends of its distinct words, and (row, word number) of all words."""
    data = _MARKED[data]
    starts, ends, first = words(data, offsets)
    code, _ = pd.factorize(Roller(data).ranges(starts, ends))
    one = np.zeros(code.max() + 1 if len(code) else 0, np.int64)
    one[code[::-1]] = np.arange(len(code))[::-1]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return data, starts[one], ends[one], row, code


def bags(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's n-grams, and where each word's begin. Long words' n-grams are all taken."""
    size = ends - starts + 2  # with an end on either side
    at = np.concatenate([[0], np.cumsum(size)])
    text = np.full(at[-1], 32, np.uint8)
    inner = np.arange((size - 2).sum()) - np.repeat(np.cumsum(size - 2) - (size - 2), size - 2)
    text[np.repeat(at[:-1] + 1, size - 2) + inner] = data[np.repeat(starts, size - 2) + inner]
    roll = Roller(text)
    word = np.repeat(np.arange(len(size)), size)
    left = at[1:][word] - np.arange(at[-1])  # bytes to the word's end
    got, of = [], []
    for n in range(SHORTEST, LONGEST + 1):
        i = np.flatnonzero(left >= n)
        got.append(roll.ranges(i, i + n))
        of.append(word[i])
    got.append(roll.ranges(at[:-1], at[1:]))
    of.append(np.arange(len(size)))
    got, of = np.concatenate(got), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return (got[order] % np.uint64(BUCKETS)).astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(size)))])


class Model:
    """Embeddings of n-gram buckets and a softmax over two labels."""

    def __init__(self, vectors: np.ndarray, out: np.ndarray, bias: float):
        self.vectors, self.out, self.bias = vectors, out, bias
        self.value = np.einsum("ij,j->i", vectors, out[:, 1] - out[:, 0]).astype(np.float32)

    def odds(self, bag: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log odds of each word without the bias."""
        if len(first) < 2:
            return np.zeros(0)
        return np.add.reduceat(self.value[bag].astype(np.float64), first[:-1]) / np.diff(first)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        data, starts, ends, row, code = distinct_words(data, offsets)
        z, mean = np.full((n, TOP), -1e9), np.zeros(n)
        if len(code):
            odds = self.odds(*bags(data, starts, ends))
            pair = np.unique(row * np.int64(len(odds)) + code)
            row, code = pair // len(odds), pair % len(odds)
            v = odds[code]
            mean = np.bincount(row, v, n) / np.maximum(np.bincount(row, minlength=n), 1)
            for k in range(TOP):
                np.maximum.at(z[:, k], row, v)
                if k + 1 < TOP:  # take one word that has the most
                    hit = np.flatnonzero(v == z[row, k])
                    _, one = np.unique(row[hit], return_index=True)
                    v = v.copy()
                    v[hit[one]] = -1e9
        return 1 / (1 + np.exp(-np.clip(pooled(z) + np.maximum(mean, 0) + self.bias, -50, 50)))


def pooled(z: np.ndarray) -> np.ndarray:
    """Mean of the top odds that there are; a text without words has 0."""
    on = z > -1e8
    return np.where(on, z, 0).sum(1) / np.maximum(on.sum(1), 1)


def training_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of all distinct words, where each word's begin, and the (row, word number) of each row's distinct words, slice by slice."""
    known, of, got, firsts = pd.Index(np.zeros(0, np.uint64)), [], [], [np.zeros(1, np.int64)]
    for i, j in slices(at, TRAINING_SLICE):
        part, starts, ends, row, code = distinct_words(data[at[i] : at[j]], at[i : j + 1] - at[i])
        if not len(starts):
            continue
        h = Roller(part).ranges(starts, ends)
        new = np.flatnonzero(known.get_indexer(h) < 0)
        known = known.append(pd.Index(h[new]))
        bag, first = bags(part, starts[new], ends[new])
        got.append(bag)
        firsts.append(firsts[-1][-1] + first[1:])
        pair = np.unique(row * np.int64(len(h)) + code)
        of.append(np.stack([pair // len(h) + i, known.get_indexer(h)[pair % len(h)]]))
    row, code = np.concatenate(of, 1) if of else np.zeros((2, 0), np.int64)
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    return np.concatenate(got) if got else np.zeros(0, np.int32), np.concatenate(firsts), row, code


def _top(v: np.ndarray, row: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Places of each row's ``TOP`` highest values, of equal ones the first."""
    some, left, out = np.flatnonzero(np.diff(begin)), v.copy(), [np.zeros(0, np.int64)]
    for _ in range(TOP if len(some) else 0):
        best = np.zeros(len(begin) - 1)
        best[some] = np.maximum.reduceat(left, begin[some])
        hit = np.flatnonzero((left == best[row]) & (left > -np.inf))
        out.append(hit[np.diff(row[hit], prepend=-1) > 0])
        left[out[-1]] = -np.inf
    return np.concatenate(out)


def train(texts: list[str] | pa.ChunkedArray, labels: np.ndarray, seed: int = 7, rounds: int = 60, rate: float = 0.25) -> Model | None:
    """Joint training of vectors and softmax: first every word of a text bears its label, then its top words do, and all where their mean is above 0."""
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return None
    data, at = utf8(texts if isinstance(texts, pa.ChunkedArray) else pa.array(texts, pa.large_string()))
    bag, first, row, code = training_words(data, at)
    n_words, size = len(first) - 1, np.diff(first)
    del data
    rng = np.random.default_rng(seed)
    vec = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    out = np.stack([np.full(WIDTH, -0.5), np.full(WIDTH, 0.5)], 1)
    bias = 0.0
    g_vec, g_out, g_bias = np.full(BUCKETS, 1e-3), 1e-3, 1e-3
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y == 0).sum()) * len(y)
    begin = np.searchsorted(row, np.arange(len(y) + 1))
    count = np.diff(begin)

    def step(word: np.ndarray, g: np.ndarray, g_b: float) -> None:
        """g: gradient by the odds of each word given; AdaGrad, one rate for a bucket's vector."""
        nonlocal bias, g_out, g_bias, out
        on = np.zeros(n_words)
        np.add.at(on, word, g)
        share = on / size
        touched, s = np.flatnonzero(on), np.zeros(BUCKETS)  # s: gradient by each bucket's odds
        for k in range(0, len(touched), 16384):
            hit = touched[k : k + 16384]
            take = np.repeat(first[hit] - np.concatenate([[0], np.cumsum(size[hit])[:-1]]), size[hit]) + np.arange(size[hit].sum())
            s += np.bincount(bag[take], np.repeat(share[hit], size[hit]), BUCKETS)
        w = out[:, 1] - out[:, 0]
        d_vec_norm = s * s * (w @ w)
        d_w = np.einsum("i,ij->j", s, vec)  # not by BLAS, whose threads would take other tasks' cores
        g_vec[:] += d_vec_norm
        vec[:] -= (rate * s / np.sqrt(g_vec))[:, None] * w
        g_out += float(d_w @ d_w)
        out = out + 0.1 * rate * np.stack([d_w, -d_w], 1) / np.sqrt(g_out)
        g_bias += g_b * g_b
        bias -= rate * g_b / np.sqrt(g_bias)

    for r in range(rounds):
        value = np.einsum("ij,j->i", vec, out[:, 1] - out[:, 0]).astype(np.float32)
        odds = (np.add.reduceat(value[bag], first[:-1]) if n_words else np.zeros(0)) / size
        v = odds[code]
        doc = np.bincount(row, v, len(y)) / np.maximum(count, 1)
        if r < rounds // 5:
            err = (1 / (1 + np.exp(-(doc + bias))) - y) * weight
            step(code, err[row] / np.maximum(count, 1)[row], err.sum())
            continue
        top = _top(v, row, begin)
        z = np.bincount(row[top], v[top], len(y)) / np.maximum(np.minimum(count, TOP), 1)
        err = (1 / (1 + np.exp(-np.clip(z + np.maximum(doc, 0) + bias, -50, 50))) - y) * weight
        above = np.flatnonzero((doc > 0)[row])
        step(np.concatenate([code[top], code[above]]), np.concatenate([err[row[top]] / np.minimum(count, TOP)[row[top]], err[row[above]] / count[row[above]]]), err.sum())
    return Model(vec, out, bias)


def training_rows(docs: DataFrame, labels: DataFrame, keep) -> DataFrame:
    """(doc_id, text, toxic) of a bounded sample of labelled rows that ``keep`` admits; ``text`` bears each distinct word of the whole text once."""
    known = labels.where("doc_id is not null and toxic is not null").where(keep).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y, most in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    # at most MOST_TOXIC + MOST_CLEAN rows of two numbers
    found = docs.select("doc_id", "text").join(F.broadcast(some[0].union(some[1])), "doc_id")

    def shorten(batches):
        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, j in slices(at, TRAINING_SLICE):
                part, starts, ends, row, code = distinct_words(data[at[i] : at[j]], at[i : j + 1] - at[i])
                word = [part[x:y].tobytes() for x, y in zip(starts, ends, strict=True)]
                pair = np.unique(row * np.int64(max(len(word), 1)) + code)
                of, begin = pair % max(len(word), 1), np.searchsorted(pair // max(len(word), 1), np.arange(j - i + 1))
                text = [b" ".join(word[k] for k in of[x:y]).decode(errors="replace") for x, y in zip(begin, begin[1:], strict=False)]
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(text, pa.string()), batch.column(2).slice(i, j - i)], names=["doc_id", "text", "toxic"])

    short = found.mapInArrow(shorten, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, toxic {labels.schema['toxic'].dataType.simpleString()}")
    return short.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, keep=None) -> Model | None:
    """Trains in one task, whose rows ``MOST_TOXIC`` and ``MOST_CLEAN`` bound; the driver gets the weights only."""

    def run(batches):
        texts, toxic = [], []
        for batch in batches:
            texts.append(batch.column(0))
            toxic.append(batch.column(1).to_numpy())
        model = train(pa.chunked_array(texts, pa.string()), np.concatenate(toxic)) if texts else None
        if model is not None:
            yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in (model.vectors.astype(np.float32), model.out, np.float64(model.bias))], names=["vectors", "out", "bias"])

    rows = training_rows(docs, labels, keep if keep is not None else F.lit(True))
    one = rows.repartition(1).sortWithinPartitions("doc_id").select("text", F.col("toxic").cast("double").alias("toxic"))
    made = one.mapInArrow(run, "vectors binary, out binary, bias binary").collect()
    if not made:
        return None
    vectors, out, bias = (np.frombuffer(x, kind) for x, kind in zip(made[0], (np.float32, np.float64, np.float64), strict=True))
    return Model(vectors.reshape(BUCKETS, WIDTH), out.reshape(WIDTH, 2), float(bias[0]))


def scored(docs: DataFrame, model: Model | None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` and ``score`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.vectors.astype(np.float32), model.out, model.bias) if model else None)
    cache: list[Model] = []

    def run(batches):
        if shared.value is not None and not cache:
            cache.append(Model(*shared.value))
        for batch in batches:
            data, at = utf8(batch.column(len(columns)))
            score = np.zeros(len(at) - 1)
            if cache:
                for i, j in slices(at):
                    score[i:j] = cache[0].score(data[at[i] : at[j]], at[i : j + 1] - at[i])
            yield pa.record_batch([*batch.columns[: len(columns)], pa.array(score)], names=[*columns, "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, F.col("text").alias("_text")).mapInArrow(run, f"{schema}, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, ~held_out("doc_id", 3, 1))
    return scored(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


__all__ = ["fit", "op5_toxicity", "scored", "train"]
