"""Byte-level BPE on numpy batches, with a minimal acyclic transducer of frequent words.

* Pretokens are cut for a whole slice of texts at once, by character class.
* Each distinct pretoken of a slice is looked up in the lexicon, a minimal acyclic automaton whose edges carry
  counts; the sum along a word's path is its number, and so gives its ids. The automaton is one memory-mapped file.
* Pretokens outside the lexicon are merged exactly (lowest rank first, leftmost first), many at once.
* A special token's string in a text is cut out before, as the tokenizers library does it.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import tempfile
import unicodedata

import numpy as np
import pandas as pd

from .base import SLICE, Roller, slices

LETTER, NUMBER, WHITE, OTHER = 0, 1, 2, 3
#: Unicode's White_Space property, fixed values.
_WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_NONE = np.int32(2**31 - 1)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = LETTER
        elif k == "N":
            out[c] = NUMBER
    out[_WHITE] = WHITE
    return out


class Table:
    """Open-addressed map from 64-bit keys to 32-bit values, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, slots: np.ndarray | None = None, where: np.ndarray | None = None):
        if slots is None:
            keys = keys.astype(np.uint64)
            bits = max(4, int(np.ceil(np.log2(len(keys) * 4 + 1))))
            slots, where = np.full(1 << bits, 2**64 - 1, np.uint64), np.full(1 << bits, -1, np.int32)
            todo = np.arange(len(keys))
            at = self._home(keys, bits)
            while len(todo):
                free = slots[at[todo]] == np.uint64(2**64 - 1)
                cand = todo[free]
                _, one = np.unique(at[cand], return_index=True)
                done = cand[one]
                slots[at[done]], where[at[done]] = keys[done], done
                left = np.ones(len(keys), bool)
                left[done] = False
                todo = todo[left[todo]]
                at[todo] = (at[todo] + 1) & ((1 << bits) - 1)
        self.slots, self.where = slots, where
        self.bits = int(len(slots)).bit_length() - 1

    @staticmethod
    def _home(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys * _MUL) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key among the keys given, or -1."""
        keys = keys.astype(np.uint64)
        at = self._home(keys, self.bits)
        got = self.slots[at]
        out = np.where(got == keys, self.where[at], np.int32(-1))
        todo = np.flatnonzero((got != keys) & (got != np.uint64(2**64 - 1)))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            got = self.slots[at[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = self.where[at[todo[hit]]]
            todo = todo[~hit & (got != np.uint64(2**64 - 1))]
        return out


class Lexicon:
    """Minimal acyclic transducer: words in, their ids out.

    ``arrays``: edge slots and places (an open-addressed table over state*256+byte), edge targets, edge counts
    (words that sort before by this edge), final states, and ids by word number.
    """

    FIELDS = ("slots", "where", "target", "count", "final", "first", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays
        self.table = Table(np.zeros(0), arrays["slots"], arrays["where"])

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        """Incremental construction from sorted words: a finished suffix is shared with an equal one at once."""
        kids: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path = [0]
        last = b""

        def settle(depth: int) -> None:
            while len(path) - 1 > depth:
                s = path.pop()
                key = (final[s], *kids[s].items())
                kids[path[-1]][last[len(path) - 1]] = register.setdefault(key, s)

        order = sorted(entries)
        for w in order:
            same = 0
            while same < min(len(w), len(last)) and w[same] == last[same]:
                same += 1
            settle(same)
            for b in w[same:]:
                kids.append({})
                final.append(False)
                kids[path[-1]][b] = len(kids) - 1
                path.append(len(kids) - 1)
            final[path[-1]] = True
            last = w
        settle(0)
        number, reach, stack = {0: 0}, [], [0]
        while stack:  # renumber what is reachable
            s = stack.pop()
            reach.append(s)
            for t in kids[s].values():
                if t not in number:
                    number[t] = len(number)
                    stack.append(t)
        below: dict[int, int] = {}

        def count(s: int) -> int:
            todo = [s]
            while todo:
                x = todo[-1]
                missing = [t for t in kids[x].values() if t not in below]
                if missing:
                    todo += missing
                else:
                    below[x] = final[x] + sum(below[t] for t in kids[x].values())
                    todo.pop()
            return below[s]

        count(0)
        keys, target, counts = [], [], []
        fin = np.zeros(len(number), bool)
        for s in reach:
            fin[number[s]] = final[s]
            before = int(final[s])
            for b in sorted(kids[s]):
                keys.append(number[s] * 256 + b)
                target.append(number[kids[s][b]])
                counts.append(before)
                before += below[kids[s][b]]
        table = Table(np.array(keys, np.uint64))
        lens = [len(entries[w]) for w in order]
        return cls({"slots": table.slots, "where": table.where, "target": np.array(target, np.int32), "count": np.array(counts, np.int32), "final": fin, "first": np.concatenate([[0], np.cumsum(lens)]).astype(np.int64), "ids": np.array([i for w in order for i in entries[w]], np.int32)})

    def dump(self) -> bytes:
        head = json.dumps([[k, str(self.a[k].dtype), len(self.a[k])] for k in self.FIELDS]).encode()
        out = [len(head).to_bytes(8, "little"), head]
        for k in self.FIELDS:
            pad = -sum(map(len, out)) % 16
            out += [b"\0" * pad, self.a[k].tobytes()]
        return b"".join(out)

    @classmethod
    def load(cls, blob: bytes) -> Lexicon:
        """Memory-map a dump; the file loses its name at once, so nothing stays behind."""
        fd, name = tempfile.mkstemp()
        try:
            with os.fdopen(fd, "wb") as f:
                f.write(blob)
            with open(name, "rb") as f:
                mem = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        finally:
            os.unlink(name)
        at = 8 + int.from_bytes(mem[:8], "little")
        arrays = {}
        for k, kind, n in json.loads(mem[8:at]):
            at += -at % 16
            arrays[k] = np.frombuffer(mem, np.dtype(kind), n, at)
            at += arrays[k].nbytes
        return cls(arrays)

    def numbers(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The number of each word, or -1; all words walk together, a byte a step."""
        state, total = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64)
        out = np.full(len(starts), -1, np.int64)
        live = np.arange(len(starts))
        step = 0
        while len(live):
            done = lens[live] == step
            end = live[done]
            hit = end[self.a["final"][state[end].astype(np.int64)]]
            out[hit] = total[hit]
            live = live[~done]
            if not len(live):
                break
            e = self.table.find(state[live] * np.uint64(256) + data[starts[live] + step].astype(np.uint64))
            live, e = live[e >= 0], e[e >= 0]
            state[live] = self.a["target"][e].astype(np.uint64)
            total[live] += self.a["count"][e]
            step += 1
        return out


class Codec:
    """Encodes and decodes as the tokenizers library does with a byte-level BPE file (no added specials, truncation or padding)."""

    def __init__(self, path: str, lexicon: bytes | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        self.vocab = {k: i for k, i in spec["model"]["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.specials.values()]) + 1
        pieces = [b""] * size
        for k, i in self.vocab.items():
            pieces[i] = k.encode() if k in self.specials else bytes(alphabet[c] for c in k)
        for k, i in self.specials.items():
            pieces[i] = k.encode()
        self.piece_at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.byte_id = np.zeros(256, np.int32)
        for c, b in alphabet.items():
            self.byte_id[b] = self.vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([self.vocab[a] for a, _ in merges], np.uint64)
        right = np.array([self.vocab[b] for _, b in merges], np.uint64)
        self.merged = np.array([self.vocab[a + b] for a, b in merges], np.int32)
        self.pairs = Table(left << np.uint64(32) | right)
        self.rank = {(int(a), int(b)): r for r, (a, b) in enumerate(zip(left, right, strict=True))}
        b = self.byte_id.astype(np.uint64)
        self.byte_pairs = self._ranks(np.repeat(b, 256), np.tile(b, 256)).reshape(256, 256)
        self.kind = _classes()
        self.ascii = self.kind[:256].copy()
        self.lexicon = Lexicon.load(lexicon) if lexicon else None

    # -- pretokens

    def pretokens(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Start of each pretoken; they cover all bytes."""
        n = len(data)
        kind = self.ascii[data]
        high = np.flatnonzero(data >= 0xC0)
        if len(high):
            lead = data[high]
            size = 2 + (lead >= 0xE0) + (lead >= 0xF0).astype(np.int64)
            cp = (lead & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07)).astype(np.uint8)).astype(np.int64)
            for k in (1, 2, 3):
                on = size > k
                cp[on] = cp[on] << 6 | (data[high[on] + k] & 0x3F)
            got = self.kind[cp]
            kind[high] = got
            for k in (1, 2, 3):
                on = size > k
                kind[high[on] + k] = got[on]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        start = np.ones(n, bool)
        start[1:] = (kind[1:] != kind[:-1]) | first[1:n]
        # a blank goes with what follows; of more white space, the last character stands apart
        white = kind == WHITE
        turn = np.flatnonzero(start[1:] & ~first[1:n] & white[:-1]) + 1  # first byte after a white run
        last = turn - 1
        while True:  # back to the start of the run's last character
            inner = (data[last] & 0xC0) == 0x80
            if not inner.any():
                break
            last = last - inner
        start[last] = True
        blank = data[last] == 32
        start[turn[blank]] = False
        # contractions
        quote = np.flatnonzero((data == 39) & start)
        quote = quote[quote + 1 < n]
        quote = quote[~first[quote + 1]]
        if len(quote):
            a = data[quote + 1]
            b = np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n)], data[np.minimum(quote + 2, n - 1)], 0)
            two = np.isin(a, np.frombuffer(b"stmd", np.uint8))
            three = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
            for on, size in ((two, 2), (three, 3)):
                q = quote[on]
                start[q + 1] = False
                nxt = q + size
                nxt = nxt[nxt < n]
                start[nxt] = True
        return np.flatnonzero(start)

    # -- merging

    def merge_one(self, word: bytes) -> list[int]:
        """Exact merge of a long pretoken by a heap of (rank, place)."""
        ids = [int(self.byte_id[b]) for b in word]
        n = len(ids)
        prev, nxt, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = int(self.merged[r]), False
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
                if (r2 := self.rank.get((ids[i], ids[nxt[j]]))) is not None:
                    heapq.heappush(heap, (r2, i, ids[i], ids[nxt[j]]))
            if (p := prev[i]) >= 0 and (r2 := self.rank.get((ids[p], ids[i]))) is not None:
                heapq.heappush(heap, (r2, p, ids[p], ids[i]))
        return [t for t, on in zip(ids, alive, strict=True) if on]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = self.pairs.find(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
        return np.where(r < 0, _NONE, r)

    def merge(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, one after the other, and how many."""
        sizes = lens.copy()
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, padded ids, which of them stay
        for lo, hi in ((0, 3), (3, 5), (5, 7), (7, 9), (9, 12), (12, 16), (16, 24), (24, 48)):
            which = np.flatnonzero((lens > lo) & (lens <= hi))
            for k in range(0, len(which), 1 << 14):
                w = which[k : k + (1 << 14)]
                col, size = np.arange(hi), lens[w]
                inside = col < size[:, None]
                raw = np.ascontiguousarray(data[np.minimum(starts[w, None] + col, len(data) - 1)])
                ids = np.ascontiguousarray(self.byte_id[raw])
                rank = np.full((len(w), hi), _NONE, np.int32)
                rank[:, :-1] = np.where(inside[:, 1:], self.byte_pairs[raw[:, :-1], raw[:, 1:]], _NONE)
                # each row is a linked list, so that a merge touches a few cells only
                after = np.tile((col + 1).astype(np.int32), (len(w), 1))
                before = np.tile((col - 1).astype(np.int32), (len(w), 1))
                stay = np.ascontiguousarray(inside)
                live = np.arange(len(w))
                view = rank
                while len(live):
                    p = view.argmin(1)
                    r = view[np.arange(len(live)), p]
                    on = r != _NONE
                    if not on.all():
                        live, p, r = live[on], p[on], r[on]
                        if not len(live):
                            break
                    at = live * hi + p
                    q = after.ravel()[at]
                    gone = live * hi + q
                    new = self.merged[r]
                    ids.ravel()[at] = new
                    stay.ravel()[gone] = False
                    rank.ravel()[gone] = _NONE
                    rank.ravel()[at] = _NONE
                    nxt = after.ravel()[gone]
                    after.ravel()[at] = nxt
                    more = np.flatnonzero(nxt < size[live])
                    to = live[more] * hi + nxt[more]
                    before.ravel()[to] = p[more]
                    prv = before.ravel()[at]
                    less = np.flatnonzero(prv >= 0)
                    back = live[less] * hi + prv[less]
                    got_ranks = self._ranks(np.concatenate([new[more], ids.ravel()[back]]), np.concatenate([ids.ravel()[to], new[less]]))
                    rank.ravel()[at[more]] = got_ranks[: len(more)]
                    rank.ravel()[back] = got_ranks[len(more) :]
                    view = rank if len(live) == len(w) else rank[live]
                sizes[w] = stay.sum(1)
                got.append((w, ids, stay))
        long = np.flatnonzero(lens > 48)
        held = {int(w): self.merge_one(data[starts[w] : starts[w] + lens[w]].tobytes()) for w in long}
        for w, ids in held.items():
            sizes[w] = len(ids)
        at = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros(at[-1], np.int32)
        for w, ids, stay in got:
            out[np.repeat(at[w] - np.cumsum(sizes[w]) + sizes[w], sizes[w]) + np.arange(sizes[w].sum())] = ids[stay]
        for w, ids in held.items():
            out[at[w] : at[w + 1]] = ids
        return out, sizes

    # -- whole texts

    def distinct(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pretoken starts, the number of each one's form, and starts and lengths of the forms."""
        starts = self.pretokens(data, offsets)
        ends = np.append(starts[1:], len(data))
        code, _ = pd.factorize(Roller(data).ranges(starts, ends))
        one = np.zeros(code.max() + 1 if len(code) else 0, np.int64)
        one[code[::-1]] = np.arange(len(code))[::-1]
        return starts, code, starts[one], (ends - starts)[one]

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        starts, code, form, size = self.distinct(data, offsets)
        n_ids, first, flat = np.zeros(len(form), np.int64), np.zeros(len(form), np.int64), np.zeros(0, np.int32)
        todo = np.arange(len(form))
        if self.lexicon:
            num = self.lexicon.numbers(data, form, size)
            known = num >= 0
            first[known], n_ids[known] = self.lexicon.a["first"][num[known]], np.diff(self.lexicon.a["first"])[num[known]]
            flat, todo = np.asarray(self.lexicon.a["ids"]), todo[~known]
        ids, sizes = self.merge(data, form[todo], size[todo])
        n_ids[todo] = sizes
        first[todo] = len(flat) + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(todo) else 0
        flat = np.concatenate([flat, ids])
        count = n_ids[code]
        at = np.concatenate([[0], np.cumsum(count)])
        place = np.repeat(first[code] - at[:-1], count) + np.arange(at[-1])
        return flat[place], at[np.searchsorted(starts, offsets)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and where each row's begin (one more than rows). Rows with a special token's string are cut there."""
        raw = data.tobytes()
        cut: list[tuple[int, int, int]] = []
        for text, i in self.specials.items():
            s = text.encode()
            k = raw.find(s)
            while k >= 0:
                if np.searchsorted(offsets, k, "right") == np.searchsorted(offsets, k + len(s) - 1, "right"):
                    cut.append((k, k + len(s), i))
                k = raw.find(s, k + len(s))
        if not cut:
            return self._plain(data, offsets)
        cut.sort()
        marks = np.unique(np.concatenate([offsets, [x for c in cut for x in c[:2]]]))
        ids, at = self._plain(data, marks)
        lens = np.diff(at)
        begins = {c[0]: c[2] for c in cut}
        parts, new = [], [0]
        for k, m in enumerate(marks[:-1]):
            part = np.array([begins[int(m)]], np.int32) if int(m) in begins else ids[at[k] : at[k] + lens[k]]
            parts.append(part)
            new.append(new[-1] + len(part))
        return np.concatenate(parts), np.array(new)[np.searchsorted(marks, offsets)]

    def batches(self, data: np.ndarray, offsets: np.ndarray):
        """(first row, ids, where rows begin) for slices of bounded size."""
        for i, j in slices(offsets, SLICE):
            at = offsets[i : j + 1]
            yield i, *self.encode(data[at[0] : at[-1]], at - at[0])

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of ids; invalid bytes become U+FFFD, as the library writes them."""
        first, size = self.piece_at[ids], np.diff(self.piece_at)[ids]
        at = np.concatenate([[0], np.cumsum(size)])
        raw = self.piece_bytes[np.repeat(first - at[:-1], size) + np.arange(at[-1])].tobytes()
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


_codecs: dict[tuple, Codec] = {}


def codec(path: str, lexicon=None) -> Codec:
    """One codec for a Python worker; ``lexicon``: a broadcast dump or None."""
    key = (path, lexicon.value[:64] if lexicon is not None else None, len(lexicon.value) if lexicon is not None else 0)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(path, lexicon.value if lexicon is not None else None)
    return _codecs[key]
