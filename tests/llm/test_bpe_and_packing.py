import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratachain.llm import op2_packing, op10_bpe
from stratachain.llm.base import utf8
from stratachain.llm.bpe import Codec, Lexicon

from .cases import collected, documents

tokenizers = pytest.importorskip("tokenizers")
PATH = op10_bpe.default_tokenizer()
PIECES = ["a", "the", "'", "s", "'t", "re", "ll", " ", "  ", "\n", "\t", "é", "12", "²", " ", "　", "!", "…", "😀", "<|endoftext|>", "<|end", "'d", "\r\n", "日本", "́", "\u0085"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    plain = Codec(PATH)
    words = [b"the", b" the", b" a", b"ing", b" thing", "é".encode()]
    ids = {w: plain.merge_one(w) for w in words}
    return Codec(PATH, Lexicon.build(ids).dump())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join) | st.text(max_size=30), min_size=1, max_size=6))
def test_ids_are_the_librarys(codec, library, texts):
    data, at = utf8(pa.array(texts, pa.large_string()))
    for i, ids, first in codec.batches(data, at):
        for k in range(len(first) - 1):
            want = library.encode(texts[i + k], add_special_tokens=False).ids
            assert ids[first[k] : first[k + 1]].tolist() == want
            assert codec.decode(ids[first[k] : first[k + 1]]).decode() == library.decode(want, skip_special_tokens=False)


@given(st.lists(st.binary(max_size=8), unique=True, max_size=60))
def test_transducer_is_exact_and_minimal(words):
    entries = {w: [k, k + 1] for k, w in enumerate(sorted(words))}
    lex = Lexicon.load(Lexicon.build(entries).dump())
    probe = sorted({*words, b"zz", b"", *(w[:-1] for w in words), *(w + b"x" for w in words)})
    size = np.array([len(w) for w in probe], np.int64)
    got = lex.numbers(np.frombuffer(b"".join(probe) or b"\0", np.uint8), np.cumsum(size) - size, size)
    assert [int(x) for x in got] == [sorted(words).index(w) if w in entries else -1 for w in probe]
    suffixes = {frozenset(w[k:] for w in words if w.startswith(p)) for v in words for k in range(len(v) + 1) for p in [v[:k]]}
    assert len(lex.a["final"]) == max(1, len(suffixes))


def test_long_words_merge_as_short_ones_do(codec, library):
    for text in ("a" * 3000, "ab" * 400, "the" * 100):
        assert codec.merge_one(text.encode()) == library.encode(text, add_special_tokens=False).ids


def test_query_round_trip(spark, library):
    docs = documents(spark)
    lexicon = op10_bpe.build_lexicon(docs, PATH, most=50)
    want = sorted((i if i is not None else -1, len(ids := library.encode(t or "", add_special_tokens=False).ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in collected(docs))
    for lex in (None, lexicon):
        assert sorted(tuple(r) for r in op10_bpe.digests(docs, PATH, lex).collect()) == want
    back = op10_bpe.decode(op10_bpe.encode(docs, PATH, lexicon), PATH)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((i, t or "") for i, t in collected(docs))
    assert op10_bpe.digests(docs.limit(0), PATH, None).count() == 0
    assert op10_bpe.build_lexicon(docs.limit(0), PATH)


def _sequences(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_query(spark, library):
    docs = documents(spark)
    rows = op2_packing.pack_documents(docs, PATH).collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in collected(docs)}
    n = _sequences(rows, 2048)
    total = sum(len(ids[i]) for i, _ in collected(docs))
    assert sum(r.length for r in rows) == total and n == -(-total // 2048)
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and (r.piece == 0 or r.length == 2048)
    assert op2_packing.pack_documents(docs.limit(0), PATH).count() == 0


@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_two_fit_is_sound(lengths):
    bins, offsets = op2_packing.best_two_fit(np.array(lengths, np.int64), 40)
    fill = {}
    for b, o, n in sorted(zip(bins, offsets, lengths, strict=True)):
        assert o == fill.get(b, 0)
        fill[b] = o + n
    assert all(v <= 40 for v in fill.values()) and len(fill) <= 2 * -(-sum(lengths) // 40) + 1


def test_two_smaller_pieces_replace_one():
    bins, _ = op2_packing.best_two_fit(np.array([6, 3, 2, 2], np.int64), 10)
    assert len(set(bins)) == 2 and bins[0] == bins[2] == bins[3] != bins[1]
