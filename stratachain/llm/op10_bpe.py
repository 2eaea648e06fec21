"""BPE encoding and decoding by a minimal acyclic transducer lexicon.

Cases: null and empty texts give no ids and the empty text; very long texts are one slice of their own; repeated
rows are encoded each; an empty table gives an empty result; only ``doc_id`` and ``text`` are read, so further
columns can't clash. A pretoken outside the lexicon is merged exactly, so the lexicon never changes a result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import slices, utf8
from .bpe import Codec, Lexicon, codec

#: Words in the lexicon: a bound on the automaton and on what the driver holds, not on the texts.
LEXICON_WORDS = 1 << 16
_COUNT_SLICE = 4 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_counts(texts: DataFrame, tokenizer: str) -> DataFrame:
    """How often each pretoken occurs in all of ``texts.text``: (word binary, n long)."""

    def count(batches):
        c = codec(tokenizer)
        for batch in batches:
            data, at = utf8(batch.column(0))
            for i, j in slices(at, _COUNT_SLICE):
                part, own = data[at[i] : at[j]], at[i : j + 1] - at[i]
                if not len(part):
                    continue
                _, code, form, size = c.distinct(part, own)
                first = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                flat = part[np.repeat(form - first[:-1], size) + np.arange(first[-1])]
                word = pa.BinaryArray.from_buffers(pa.binary(), len(form), [None, pa.py_buffer(first), pa.py_buffer(flat)])
                yield pa.record_batch([word, pa.array(np.bincount(code, minlength=len(form)))], names=["word", "n"])

    return texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(texts: DataFrame, tokenizer: str, most: int = LEXICON_WORDS) -> bytes:
    """The transducer of the ``most`` most frequent words of all texts (at least two occurrences; ties by the words' bytes)."""
    top = word_counts(texts, tokenizer).where("n > 1").orderBy(F.desc("n"), "word").limit(most).select("word").toArrow().column(0)
    c = Codec(tokenizer)
    top = top.cast(pa.large_binary())
    words = [w for w in top.to_pylist() if w not in {s.encode() for s in c.specials}]
    size = np.array([len(w) for w in words], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    ids, sizes = c.merge(np.frombuffer(b"".join(words), np.uint8), first[:-1].astype(np.int64), size) if words else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    parts = np.split(ids, np.cumsum(sizes)[:-1]) if words else []
    return Lexicon.build({w: p.tolist() for w, p in zip(words, parts, strict=True)}).dump()


def encode(docs: DataFrame, tokenizer: str, lexicon: bytes | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon) if lexicon else None

    def run(batches):
        c = codec(tokenizer, shared)
        for batch in batches:
            key = batch.column(0)
            data, at = utf8(batch.column(1))
            for i, ids, first in c.batches(data, at):
                rows = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
                yield pa.record_batch([key.slice(i, len(rows)), rows], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) of rows of (doc_id, ids); null ids give the empty text."""

    def run(batches):
        c = codec(tokenizer)
        for batch in batches:
            texts = [c.decode(np.asarray(x or [], np.int64)).decode() for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, tokenizer: str, lexicon: bytes | None = None) -> DataFrame:
    """Per row: number of ids, SHA-256 of the ids (little-endian unsigned 32 bits), SHA-256 of the text decoded from them."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon) if lexicon else None

    def run(batches):
        c = codec(tokenizer, shared)
        for batch in batches:
            key = batch.column(0)
            data, at = utf8(batch.column(1))
            for i, ids, first in c.batches(data, at):
                n = len(first) - 1
                raw, hashes, texts = ids.astype("<u4"), [], []
                for k in range(n):
                    own = slice(first[k], first[k + 1])
                    hashes.append(hashlib.sha256(raw[own]).hexdigest())
                    texts.append(hashlib.sha256(c.decode(ids[own])).hexdigest())
                yield pa.record_batch([key.slice(i, n), pa.array(np.diff(first)), pa.array(hashes, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    tokenizer = default_tokenizer()
    return digests(docs, tokenizer, build_lexicon(docs, tokenizer))


__all__ = ["build_lexicon", "decode", "digests", "encode", "op10_bpe", "word_counts"]
