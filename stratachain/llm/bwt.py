"""Burrows-Wheeler transforms of shards, and their merge by iterative interleave refinement.

After r rounds, of two bytes each, the interleave lists all suffixes of all shards ordered by their first 2r bytes; neighbours that
first differ in round r have a common prefix of less than 2r bytes. Suffixes are never compared or sorted again.
"""

from __future__ import annotations

import numpy as np

#: Bytes that UTF-8 never holds: the end of a string, the end of a shard.
END, LAST = 0xFF, 0xFE


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of one shard (its last byte is unique) by prefix doubling from eight bytes on."""
    n = len(text)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = text
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | wide[k : n + k]
    sa = np.argsort(key)
    head = np.ones(n, bool)
    head[1:] = key[sa[1:]] != key[sa[:-1]]
    rank = np.empty(n, np.int64)
    # a rank is the number of smaller ranks' suffixes: the first place of its run
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    alone = head & np.append(head[1:], True)
    open_at, step = np.flatnonzero(~alone), 8
    while len(open_at):  # only suffixes that share their rank with another are sorted on
        s = sa[open_at]
        key = rank[s] * (n + 1) + np.where(s + step < n, rank[np.minimum(s + step, n - 1)] + 1, 0)
        order = np.argsort(key)
        s, key = s[order], key[order]
        sa[open_at] = s
        first = np.ones(len(s), bool)
        first[1:] = key[1:] != key[:-1]
        rank[s] = np.maximum.accumulate(np.where(first, open_at, 0))
        open_at = open_at[~(first & np.append(first[1:], True))]
        step *= 2
    return sa


def transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, transform (the byte before each suffix) and its last-to-first map."""
    sa = suffix_array(text)
    inverse = np.empty(len(sa), np.int64)
    inverse[sa] = np.arange(len(sa))
    before = np.where(sa > 0, sa - 1, len(sa) - 1)
    return sa, text[before], inverse[before]


def merge(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge transforms to ``depth`` bytes: (the interleave as shard-major suffix numbers, the shard-major text place of each
    number, common prefix of each entry with the one before, rounded down to even, at most ``depth``)."""
    base = np.cumsum([0, *(len(s[0]) for s in shards)])
    n = int(base[-1])
    sa = np.concatenate([s[0] + b for s, b in zip(shards, base, strict=False)])
    letter = np.concatenate([s[1] for s in shards])
    last_first = np.concatenate([(s[2] + b).astype(np.int32) for s, b in zip(shards, base, strict=False)])
    # two bytes a round: the byte before a suffix and the one before that
    pair = letter[last_first].astype(np.uint16) << np.uint16(8) | letter
    two_back = last_first[last_first]
    inter = np.arange(n, dtype=np.int32)
    block = np.zeros(n, np.int32)
    prefix = np.full(n, depth, np.int16)
    new = np.zeros(n, bool)
    new[0] = True
    for r in range(0, depth, 2):
        key, back = (pair, two_back) if r + 2 <= depth else (letter, last_first)
        k = key[inter]
        order = np.argsort(k, kind="stable")
        k, block, inter = k[order], block[order], back[inter[order]]
        now = k[1:] != k[:-1]
        now |= block[1:] != block[:-1]
        fresh = np.flatnonzero(now > new[1:]) + 1
        prefix[fresh] = r  # places of older borders keep theirs: later rounds only cut blocks further
        new[1:] = now
        if not len(fresh) and r > 8 and now.all():
            break
        np.cumsum(new, dtype=np.int32, out=block)
    prefix[0] = 0
    return inter, sa, prefix


def _heads(block: np.ndarray) -> np.ndarray:
    head = np.ones(len(block), bool)
    head[1:] = block[1:] != block[:-1]
    return head


def repeated_minimum(strings: np.ndarray, first: np.ndarray, value: np.ndarray, depth: int, shard_bytes: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``depth`` bytes of each string, the least ``value`` of all strings that hold an equal window.

    ``strings``: bytes end to end, ``first``: where they begin (one more). Returns the values, string by string, and
    where each string's begin.
    """
    size = np.diff(first)
    count = np.maximum(size - depth + 1, 0)
    at = np.concatenate([[0], np.cumsum(count)])
    if not at[-1]:
        return np.zeros(0, np.int64), at
    cuts = [0]
    while cuts[-1] < len(size):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(first, first[cuts[-1]] + shard_bytes, "right")) - 1))
    shards, owner, window = [], [], []
    for i, j in zip(cuts, cuts[1:], strict=False):
        n = int(first[j] - first[i]) + (j - i) + 1
        text = np.full(n, END, np.uint8)
        text[-1] = LAST
        own = np.repeat(np.arange(i, j), size[i:j])
        inner = np.arange(first[i], first[j]) - first[own]
        place = first[own] - first[i] + (own - i) + inner
        text[place] = strings[first[i] : first[j]]
        who, where = np.full(n, -1, np.int32), np.full(n, -1, np.int64)
        on = inner < count[own]
        who[place[on]], where[place[on]] = own[on], (at[own] + inner)[on]
        shards.append(transform(text))
        owner.append(who)
        window.append(where)
    inter, sa, prefix = merge(shards, depth)
    spot = sa[inter]
    who, where = np.concatenate(owner)[spot], np.concatenate(window)[spot]
    cls = np.cumsum(prefix < depth) - 1
    on = who >= 0
    who, where, cls = who[on], where[on], cls[on]
    head = _heads(cls)
    least = np.minimum.reduceat(value[who], np.flatnonzero(head))
    out = np.zeros(at[-1], np.int64)
    out[where] = least[np.cumsum(head) - 1]
    return out, at
