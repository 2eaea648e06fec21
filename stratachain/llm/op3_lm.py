"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

A token's probability is a mixture of four, each normalised over the same tokens, with weights of a softmax:

* That of its class given the two tokens before it, times that of the word in its class. Classes are the most frequent tokens, each by
  itself, and for all other words, seen or not, hashes of their endings. The class softmax has bigram features (class before),
  skip features (class before that) and hashed trigram features (both). It is trained by distributed gradient updates:
  contexts with their class counts lie in a table, tasks return the gradient of their contexts, the driver holds the weights, whose number
  is fixed. Words in a class have the softmax of biases whose maximum-likelihood solution is known, their smoothed counts; each
  class keeps one share for all unseen words.
* Those of the word after the word before (bigram), after the one before that (skip) and after both (trigram). Each is the softmax of
  its context's own features, whose maximum-likelihood solution are their counts. Features are hashed, to more bits the larger
  the corpus, and their counts, over all training texts, lie in a table of groups by hash: what the model gathers grows with the corpus.
* The mixture's weights are a softmax over features of how often each context was seen, trained by distributed gradient updates on
  all training tokens, each left out of the counts it is predicted by.

Texts lie in parts of bounded size. A part tells each group which features it has and how often; a group answers with its sums, so no
table of features goes to every task. Texts are scored in sparse numpy batches. Nothing is left out for being rare.

Cases: null and empty texts are one token, the end; an empty training set knows no token (N and V are 0; each token scores as
unseen); repeated rows count and are scored each; a null id counts as the empty text for the fold; an empty table gives an
empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from .base import LOWER, Roller, brief_shuffles, held_out, mix, slices, staged, swept, utf8, words
from .bpe import Table
from .op10_bpe import documents
from .parts import blob, empty, least, parted, restored, squeezed, unpacked

#: Token classes: the end, the most frequent words, hashed endings; and the place of "before the text" among contexts.
SINGLE, ENDINGS = 64, 128
CLASSES = SINGLE + ENDINGS
START = CLASSES
BUCKETS = 1 << 14
EPOCHS, RATE = 10, 0.7
#: Bytes of text in a part, contexts in a block.
PART, BLOCK = 8 << 20, 512
#: Features of a word with what is before it, before that, and both.
KINDS = ("pair", "skip", "triple")
#: Levels of how often a context was seen, and rounds and rate of the mixture's training.
LEVELS, MIXTURE_EPOCHS, MIXTURE_RATE = 66, 16, 0.6
_END, _START = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)


def _ending(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class of a word by its last three bytes."""
    h = np.zeros(len(starts), np.int64)
    for k, m in ((1, 1), (2, 131), (3, 17161)):
        on = ends - k >= starts
        h[on] += (data[ends[on] - k].astype(np.int64) + 1) * m
    return SINGLE + (h * 2654435761 >> 16) % ENDINGS


class Slice:
    """Tokens of a slice of texts: distinct words (hash, place) and the number of each token's word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = LOWER[data]
        starts, ends, self.first = words(self.data, offsets)
        h = Roller(self.data).ranges(starts, ends) if len(starts) else np.zeros(0, np.uint64)
        self.code, self.hash = pd.factorize(h)
        self.hash = np.asarray(self.hash, np.uint64)
        one = np.zeros(len(self.hash), np.int64)
        one[self.code[::-1]] = np.arange(len(self.code))[::-1]
        self.start, self.end = starts[one], ends[one]
        self.rows = len(offsets) - 1
        self.row = np.repeat(np.arange(self.rows), np.diff(self.first))

    def classes(self, single: Table) -> np.ndarray:
        """Class of each distinct word; the end has class 0."""
        at = single.find(self.hash)
        return np.where(at >= 0, at + 1, _ending(self.data, self.start, self.end))

    def contexts(self, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, context number, class) of each token, ends included."""
        n = len(self.code) + self.rows
        seq, row = np.zeros(n, np.int64), np.empty(n, np.int64)
        seq[np.arange(len(self.code)) + self.row] = cls[self.code]
        end = self.first[1:] + np.arange(self.rows)
        row[np.arange(len(self.code)) + self.row] = self.row
        row[end] = np.arange(self.rows)
        place = np.arange(n) - (self.first[:-1] + np.arange(self.rows))[row]
        one, two = np.full(n, START), np.full(n, START)
        one[1:] = np.where(place[1:] >= 1, seq[:-1], START)
        two[2:] = np.where(place[2:] >= 2, seq[:-2], START)
        return row, two * (CLASSES + 1) + one, seq


def word_counts(texts: DataFrame) -> DataFrame:
    """(hash, word, n) of all words of ``texts.text``."""

    def count(batches):
        for batch in batches:
            data, at = utf8(batch.column(0))
            for i, j in slices(at):
                s = Slice(data[at[i] : at[j]], at[i : j + 1] - at[i])
                if not len(s.hash):
                    continue
                size = s.end - s.start
                first = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                flat = s.data[np.repeat(s.start - first[:-1], size) + np.arange(first[-1])]
                word = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(first), pa.py_buffer(flat)])
                yield pa.record_batch([pa.array(s.hash.view(np.int64)), word, pa.array(np.bincount(s.code, minlength=len(size)))], names=["hash", "word", "n"])

    return texts.select("text").mapInArrow(count, "hash long, word binary, n long").groupBy("word").agg(F.first("hash").alias("hash"), F.sum("n").alias("n"))


def _context_counts(texts: DataFrame, single: np.ndarray) -> DataFrame:
    """(context, classes) over all tokens: tasks send packed counts of blocks of contexts, which are added up as they come."""
    shared = texts.sparkSession.sparkContext.broadcast(single)

    def packed(held):
        key, n = _added(held)
        block = key // (CLASSES * BLOCK)
        cuts = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
        blobs = [blob(np.diff(key[i:j], prepend=0).astype(np.uint32), n[i:j].astype(np.uint64)) for i, j in zip(cuts, cuts[1:], strict=False)]
        return pa.record_batch([pa.array(block[cuts[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], names=["block", "counts"])

    def count(batches):
        table, held, size = Table(shared.value), [], 0
        for batch in batches:
            data, at = utf8(batch.column(0))
            for i, j in slices(at):
                s = Slice(data[at[i] : at[j]], at[i : j + 1] - at[i])
                _, context, cls = s.contexts(s.classes(table))
                held.append(np.unique(context * CLASSES + cls, return_counts=True))
                size += len(held[-1][0])
                if size > 4_000_000:
                    held = [_added(held)]
                    size = len(held[0][0])
                    if size > 2_000_000:
                        yield packed(held)
                        held, size = [], 0
        if held:
            yield packed(held)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                gap, n = unpacked(counts.as_buffer().to_pybytes())
                own = sums.setdefault(block, np.zeros(CLASSES * BLOCK, np.int64))
                own[np.cumsum(gap, dtype=np.int64) - block * CLASSES * BLOCK] += n.astype(np.int64)
        for block, own in sums.items():
            at = np.flatnonzero(own)
            row, cls = at // CLASSES, at % CLASSES
            some = np.unique(row)
            items = pa.StructArray.from_arrays([pa.array(cls.astype(np.int16)), pa.array(own[at])], ["class", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.append(some, BLOCK)).astype(np.int32)), items)
            yield pa.record_batch([pa.array((some + block * BLOCK).astype(np.int32)), lists], names=["context", "classes"])

    sent = texts.select("text").mapInArrow(count, "block int, counts binary").repartition("block")
    return sent.mapInArrow(add, "context int, classes array<struct<class:short,n:long>>")


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([p[1] for p in parts]), len(key)).astype(np.int64)


def _bucket(context: np.ndarray) -> np.ndarray:
    return (context.astype(np.int64) * 2654435761 >> 12) % BUCKETS


class Weights:
    """Bias, bigram, skip and hashed trigram weights of the class softmax."""

    def __init__(self):
        self.bias = np.zeros(CLASSES, np.float32)
        self.parts = [np.zeros((n, CLASSES), np.float32) for n in (CLASSES + 1, CLASSES + 1, BUCKETS)]

    def places(self, context: np.ndarray) -> list[np.ndarray]:
        return [context % (CLASSES + 1), context // (CLASSES + 1), _bucket(context)]

    def log_p(self, context: np.ndarray) -> np.ndarray:
        """Natural log probability of each class in each context."""
        z = self.bias + sum(w[at] for w, at in zip(self.parts, self.places(context), strict=True))
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def _gradient(counts: DataFrame, weights: Weights) -> tuple[list[np.ndarray], float]:
    """Gradient of the log likelihood by each part's weights, and the likelihood, over the table of contexts."""
    shared = counts.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        grads, like, touched = [np.zeros_like(p) for p in w.parts], 0.0, np.zeros(BUCKETS, bool)
        for batch in batches:
            n, at = np.diff(batch.column("classes").offsets.to_numpy()), batch.column("context").to_numpy().astype(np.int64)
            flat = batch.column("classes").flatten()
            seen = np.zeros((len(at), CLASSES), np.float32)
            seen[np.repeat(np.arange(len(at)), n), flat.field("class").to_numpy()] = flat.field("n").to_numpy()
            for k in range(0, len(at), 2048):
                c, s = at[k : k + 2048], seen[k : k + 2048]
                log_p = w.log_p(c)
                like += float((s * log_p).sum(dtype=np.float64))
                g = s - s.sum(1, keepdims=True) * np.exp(log_p)
                for grad, place in zip(grads, w.places(c), strict=True):
                    np.add.at(grad, place, g)
                touched[_bucket(c)] = True
        rows = [(p, np.arange(len(g)) if p < 2 else np.flatnonzero(touched), g) for p, g in enumerate(grads)]
        for p, i, g in rows:
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1, dtype=np.int32) * CLASSES), pa.array(g[i].ravel()))
            yield pa.record_batch([pa.array(np.full(len(i), p, np.int16)), pa.array(i.astype(np.int32)), values, pa.array(np.full(len(i), like if p == 0 else 0.0) * (i == 0))], names=["part", "place", "g", "likelihood"])

    got = counts.mapInArrow(run, "part short, place int, g array<float>, likelihood double").toArrow()
    shared.destroy()
    grads = [np.zeros_like(p) for p in weights.parts]
    part, place = got.column("part").to_numpy(), got.column("place").to_numpy()
    g = got.column("g").combine_chunks().flatten().to_numpy().reshape(-1, CLASSES) if len(got) else np.zeros((0, CLASSES), np.float32)
    for p, grad in enumerate(grads):
        np.add.at(grad, place[part == p], g[part == p])
    return grads, float(np.sum(got.column("likelihood").to_numpy()))


def train(counts: DataFrame, epochs: int = EPOCHS, rate: float = RATE) -> tuple[Weights, list[float]]:
    """Distributed AdaGrad over (context, classes); starts from the classes' own frequencies. Returns the likelihoods too."""
    w = Weights()
    total = counts.select(F.explode("classes").alias("x")).groupBy("x.class").agg(F.sum("x.n").alias("n")).collect()
    if not total:
        return w, []
    for r in total:
        w.bias[r["class"]] = r["n"]
    w.bias = np.log((w.bias + 0.5) / (w.bias.sum() + 0.5 * CLASSES)).astype(np.float32)
    squares = [np.zeros_like(p) for p in w.parts]
    likes = []
    for _ in range(epochs):
        grads, like = _gradient(counts, w)
        likes.append(like)
        for p, g, s in zip(w.parts, grads, squares, strict=True):
            s += g * g
            p += rate * g / (np.sqrt(s) + 1.0)  # the 1 holds back what few tokens say
    return w, likes


class Tokens:
    """A part's tokens, ends included: hashes of the word and of the two before it, row, class and class context."""

    def __init__(self, table: pa.Table, single: Table):
        self.table = table.sort_by("__row")
        data, at = utf8(self.table.column("text"))
        self.rows = len(at) - 1
        got: list[list[np.ndarray]] = [[np.zeros(0, kind)] for kind in (np.uint64, np.int64, np.int64, np.int64)]
        for i, j in slices(at):
            s = Slice(data[at[i] : at[j]], at[i : j + 1] - at[i])
            row, context, cls = s.contexts(s.classes(single))
            h = np.full(len(row), _END)
            h[np.arange(len(s.code)) + s.row] = s.hash[s.code]
            for held, x in zip(got, (h, row + i, context, cls), strict=True):
                held.append(x)
        self.h, self.row, self.context, self.cls = map(np.concatenate, got)
        self.first = np.diff(self.row, prepend=-1) > 0
        self.train = self.table.column("_train").to_numpy(zero_copy_only=False)[self.row].astype(np.float64)

    def before(self, x: np.ndarray, start) -> np.ndarray:
        """``x`` of the token before, in the same text."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.first] = start
        return out

    def features(self, bits: int, counted: bool = True) -> list[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
        """Words (and the start as one), pairs, skips and triples: the distinct ones in order, how often training has each here, and
        each token's. Words count twice: by themselves, and as what stands two before a token. Not ``counted``: no counts."""
        key, which = _grouped(np.append(self.h, _START), 64)
        start, which = which[-1], which[:-1]
        two = self.before(self.before(which, start), start)
        counts = [np.bincount(x, self.train, len(key)) for x in (which, two)] if counted else []
        if counted:
            counts[0][start] = self.train[self.first].sum()
        out = [(key, counts, [which, self.before(which, start), two])]
        one = self.before(self.h, _START)
        a, b, c = (mix(np.array([k], np.uint64))[0] | np.uint64(1) for k in (11, 12, 13))
        pair, skip = self.h * a + one * b, self.h * a + self.before(one, _START) * c
        for k, x in enumerate((pair, skip, pair + skip)):
            key, which = _grouped(mix(x + np.uint64(k)) >> np.uint64(64 - bits), bits)
            out.append((key, [np.bincount(which, self.train, len(key))] if counted else [], [which]))
        return out


def _grouped(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of keys of so many bits, in order, and the number of each key's. Where key and place fit 64 bits, these are sorted as one; else only distinct keys are sorted."""
    n = len(key)
    own = n.bit_length()
    if bits + own > 64:
        code, key = pd.factorize(key)
        order = np.argsort(key)
        place = np.empty(len(key), np.int32)
        place[order] = np.arange(len(key), dtype=np.int32)
        return key[order], place[code]
    s = np.sort(key << np.uint64(own) | np.arange(n, dtype=np.uint64))
    order, s = (s & np.uint64((1 << own) - 1)).astype(np.int64), s >> np.uint64(own)
    head = np.ones(n, bool)
    head[1:] = s[1:] != s[:-1]
    which = np.empty(n, np.int32)
    which[order] = np.cumsum(head, dtype=np.int32) - 1
    return s[head], which


def _cuts(key: np.ndarray, bits: int, groups: int) -> np.ndarray:
    """Where each group's range of keys begins among keys in order."""
    group = (key >> np.uint64(bits - 32)) * np.uint64(groups) >> np.uint64(32)
    return np.searchsorted(group, np.arange(groups + 1, dtype=np.uint64))


def _ask(part: Tokens, number: int, groups: int, bits: int) -> pa.Table:
    """For each group, the part's features and their counts."""
    found = part.features(bits)
    cuts = np.stack([_cuts(key, 64 if k == 0 else bits, groups) for k, (key, *_) in enumerate(found)])
    some = np.flatnonzero((cuts[:, :-1] < cuts[:, 1:]).any(0))
    blobs = []
    for g in some.tolist():
        arrays = []
        for (key, counts, _), i, j in zip(found, cuts[:, g], cuts[:, g + 1], strict=True):
            arrays += [least(np.diff(key[i:j], prepend=np.uint64(0))), *(least(n[i:j]) for n in counts)]
        blobs.append(squeezed(blob(*arrays)))
    return pa.table({"bucket": pa.array(some.astype(np.int32)), "part": pa.array(np.full(len(some), number)), "ask": pa.array(blobs, pa.binary())})


def _answer(table: pa.Table, bits: int) -> pa.Table:
    """The sums of all that the group's parts have told, for each part in the order of its features."""
    got = [restored(x) for x in table.column("ask")]
    out: list[list[np.ndarray]] = [[] for _ in got]
    for at, counts in ((0, 2), (3, 1), (5, 1), (7, 1)):
        _, which = _grouped(np.concatenate([np.cumsum(x[at], dtype=np.uint64) for x in got]), bits if at else 64)
        cuts = np.cumsum([len(x[at]) for x in got])[:-1]
        for k in range(at + 1, at + 1 + counts):
            total = np.bincount(which, np.concatenate([x[k] for x in got]))
            for own, part in zip(out, np.split(total[which], cuts), strict=True):
                own.append(least(part))
    return pa.table({"part": table.column("part"), "bucket": table.column("bucket"), "told": pa.array([squeezed(blob(*x)) for x in out], pa.binary())})


def _known(part: Tokens, told: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each token's word; of its bigram, skip and trigram; and of their contexts."""
    answers = [restored(x) for x in told.sort_by("bucket").column("told")]
    total = [np.concatenate([np.zeros(0), *(x[k] for x in answers)]) for k in range(5)]
    (_, _, (word, one, two)), *rest = part.features(bits, counted=False)
    pair, skip, triple = (t[which] for t, (_, _, (which,)) in zip(total[2:], rest, strict=True))
    start = total[0][one[part.first]] if len(one) else 0  # texts begin as often as a pair does that holds two starts
    return total[0][word], np.stack([pair, skip, triple]), np.stack([total[0][one], total[1][two], part.before(pair, start)])


def _level(n: np.ndarray) -> np.ndarray:
    """How often a context was seen: 0 to 3 times, and a level more for each doubling from 4 on."""
    return np.where(n < 4, n, np.frexp(n)[1] + 1).astype(np.int64)


def _shares(mixture: np.ndarray, level: np.ndarray) -> np.ndarray:
    """(4, tokens): weights of the class model and the three contexts; mixture: (2, 3, LEVELS), by the own context's level and the trigram's."""
    z = np.stack([mixture[0, k][level[k]] + mixture[1, k][level[2]] for k in range(3)])
    z = np.concatenate([np.zeros((1, level.shape[1])), np.where(level > 0, z, -np.inf)])
    z = np.exp(z - z.max(0))
    return z / z.sum(0)


def _mixed(mixture: np.ndarray, by_class: np.ndarray, seen: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Probability of each token."""
    a = _shares(mixture, _level(of))
    return a[0] * by_class + (a[1:] * seen / np.maximum(of, 1)).sum(0)


#: Places of an event's number: the three levels, the three shares of their contexts' tokens and the class model's probability, as powers of two and four.
_PLACES = (LEVELS, LEVELS, LEVELS, 66, 66, 66, 512)


def _events(part: Tokens, by_class: np.ndarray, seen: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens as numbers, each left out of its own counts, and how many there are of each number."""
    on = part.train > 0
    seen, of = seen[:, on] - 1, of[:, on] - 1
    share = np.where(seen > 0, 1 + np.floor(np.log2(np.maximum(of, 1) / np.maximum(seen, 1)) + 0.5).astype(np.int64), 0)
    number = np.zeros(int(on.sum()), np.int64)
    for size, x in zip(_PLACES, (*_level(of), *share, np.minimum(np.floor(-np.log2(by_class[on]) / 2 + 0.5).astype(np.int64), 511)), strict=True):
        number = number * size + x
    return np.unique(number, return_counts=True)


def _mixture_gradient(events: DataFrame, mixture: np.ndarray) -> tuple[np.ndarray, float]:
    shared = events.sparkSession.sparkContext.broadcast(mixture)

    def run(batches):
        grad, like = np.zeros_like(shared.value), 0.0
        for batch in batches:
            rest, n = batch.column(0).to_numpy().copy(), batch.column(1).to_numpy()
            x = []
            for size in reversed(_PLACES):
                x.append(rest % size)
                rest //= size
            base, own, level = x[0], x[3:0:-1], np.stack(x[:3:-1])  # from the last place to the first
            p = np.stack([4.0**-base, *(np.where(q > 0, 2.0 ** (1 - q), 0.0) for q in own)])
            a = _shares(shared.value, level)
            total = (a * p).sum(0)
            like += float(n @ np.log(total))
            g = n * a[1:] * (p[1:] / total - 1)
            for k in range(3):
                grad[0, k] += np.bincount(level[k], g[k], LEVELS)
                grad[1, k] += np.bincount(level[2], g[k], LEVELS)
        yield pa.record_batch([pa.array([grad.ravel().tolist()], pa.list_(pa.float64())), pa.array([like])], names=["grad", "likelihood"])

    got = events.mapInArrow(run, "grad array<double>, likelihood double").toArrow()
    shared.destroy()
    grads = got.column("grad").combine_chunks().flatten().to_numpy().reshape(-1, *mixture.shape)
    return grads.sum(0), float(np.sum(got.column("likelihood").to_numpy()))


def train_mixture(events: DataFrame, epochs: int = MIXTURE_EPOCHS, rate: float = MIXTURE_RATE) -> tuple[np.ndarray, list[float]]:
    """Distributed AdaGrad over (number, n) rows of events. Returns the likelihoods too."""
    mixture, squares, likes = np.zeros((2, 3, LEVELS)), np.zeros((2, 3, LEVELS)), []
    for _ in range(epochs):
        g, like = _mixture_gradient(events, mixture)
        likes.append(like)
        squares += g * g
        mixture += rate * g / (np.sqrt(squares) + 1.0)
    return mixture, likes


def score(docs: DataFrame, keep: Column, epochs: int = EPOCHS, part_bytes: int = PART) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, left_out_score) of each row; learns from rows with ``keep``.
    left_out_score: each token of a training row is left out of the counts that it is predicted by, so that a text's own
    occurrence doesn't make it likely; for other rows the same as score."""
    spark = docs.sparkSession
    parts = parted(docs.select("doc_id", "text", keep.alias("_train")), part_bytes)
    learn = parts.where("_train").select("text")
    with brief_shuffles(spark):
        counts = staged(word_counts(learn), "words")
    n_docs = learn.count()
    n_words, n_forms = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = n_words + n_docs, n_forms + (n_docs > 0)
    single = counts.orderBy(F.desc("n"), "word").limit(SINGLE - 1).select("hash").toArrow().column("hash").to_numpy().view(np.uint64)

    def endings(batches):
        table, n, forms = Table(single), np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            data, at = utf8(batch.column(1).cast(pa.large_binary()).view(pa.large_string()))
            rest = table.find(batch.column(0).to_numpy().view(np.uint64)) < 0
            cls = _ending(data, at[:-1], at[1:])[rest]
            n += np.bincount(cls, batch.column(2).to_numpy()[rest], CLASSES).astype(np.int64)
            forms += np.bincount(cls, minlength=CLASSES)
        yield pa.record_batch([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(n), pa.array(forms)], names=["class", "n", "forms"])

    size = np.ones(CLASSES)
    for r in counts.select("hash", "word", "n").mapInArrow(endings, "class int, n long, forms long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("forms").alias("v")).collect():
        size[r["class"]] = r["n"] + r["v"] + 1
    with brief_shuffles(spark):
        contexts = staged(_context_counts(learn, single), "contexts")
    swept(spark)
    weights, _ = train(contexts, epochs)

    groups = max(1, parts.agg(F.count_distinct("__part")).first()[0])
    bits = min(64, 34 + groups.bit_length())  # of a feature's hash: the more parts, the more features
    own = parts.groupBy("__part")
    asked = own.applyInArrow(lambda key, t: _ask(Tokens(t, Table(single)), key[0].as_py(), groups, bits), "bucket int, part long, ask binary")
    with brief_shuffles(spark):  # what the parts ask is the most on disk
        answers = staged(asked.groupBy("bucket").applyInArrow(lambda t: _answer(t, bits), "part long, bucket int, told binary"), "answers")
    swept(spark)
    answers = answers.withColumnRenamed("part", "__part").groupBy("__part")
    shared = spark.sparkContext.broadcast((weights, size))

    def read(left: pa.Table, right: pa.Table) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A part with the class model's probabilities and its counts."""
        w, size = shared.value
        part = Tokens(left, Table(single))
        n, seen, of = _known(part, right, bits)
        some = np.flatnonzero(np.bincount(part.context))
        place = np.zeros(some[-1] + 1, np.int64)
        place[some] = np.arange(len(some))
        log_p = np.concatenate([w.log_p(some[k : k + 4096]) for k in range(0, len(some), 4096)])
        by_class = np.exp(log_p[place[part.context], part.cls].astype(np.float64)) * np.where(part.cls >= SINGLE, (n + 1) / size[part.cls], 1.0)
        return part, by_class, n, seen, of

    def events(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return empty("number long, n long")
        part, by_class, _, seen, of = read(left, right)
        number, n = _events(part, by_class, seen, of)
        return pa.table({"number": number, "n": n})

    found = own.cogroup(answers).applyInArrow(events, "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))
    with brief_shuffles(spark):
        found = staged(found, "events")
    swept(spark)
    mixture, _ = train_mixture(found)
    kind = parts.schema["doc_id"]
    schema = StructType([kind, StructField("_train", BooleanType()), *(StructField(c, LongType()) for c in ("n_tokens", "n_known")), *(StructField(c, DoubleType()) for c in ("logs", "score", "left_out_score"))])

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return empty(schema)
        part, by_class, n, seen, of = read(left, right)
        add = lambda x: np.bincount(part.row, x, part.rows)
        logs = [add(np.log10(_mixed(mixture, by_class, seen, of)))]
        by_class[part.cls >= SINGLE] *= (n / (n + 1))[part.cls >= SINGLE] ** part.train[part.cls >= SINGLE]
        by_class[by_class == 0] = 1 / (total + distinct + 1)  # a word that training has nowhere else
        logs.append(add(np.log10(_mixed(mixture, by_class, seen - part.train, of - part.train))))
        made = {"n_tokens": add(None).astype(np.int64), "n_known": add(n > 0).astype(np.int64), "logs": add(np.log10(n + 1.0)), "score": logs[0], "left_out_score": logs[1]}
        return pa.table({"doc_id": part.table.column("doc_id"), "_train": part.table.column("_train")} | made)

    return own.cogroup(answers).applyInArrow(scored, schema).select(
        "doc_id",
        (~F.col("_train")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"),
        "score",
        "left_out_score",
    )


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), ~held_out("doc_id", 7, 2))
