"""The text operators against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratachain.llm import op3_lm, op4_neardup, op5_toxicity, op6_fingerprint, op8_license, op9_substring
from stratachain.llm.base import Roller, held_out
from stratachain.llm.bwt import merge, repeated_minimum, transform

from .cases import collected, documents, words


def test_lm_base_counts_and_score(spark, monkeypatch):
    """All columns against brute force, with an untrained class model and a mixture given; parts of all sizes."""
    docs = documents(spark, 120)
    texts = collected(docs)
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
    rng = np.random.default_rng(5)
    mixture = rng.normal(size=(2, 3, op3_lm.LEVELS))
    counts, events = [Counter() for _ in range(5)], Counter()
    rows = [(i, [None, *words(t), "END"]) for i, t in texts]

    def features(tok):  # (word, bigram, skip, trigram, context of the skip) of each token
        seq = [0, 0, *tok[1:]]
        return [((w,), (a, w), (b, w), (b, a, w), (b,)) for b, a, w in zip(seq, seq[1:], seq[2:])]

    for i, tok in rows:
        for f in features(tok) if not out[i] else ():
            for c, x in zip(counts, f):
                c[x] += 1
    n_docs = sum(not out[i] for i, _ in texts)
    single = [w for (w,), _ in sorted(((w, n) for w, n in counts[0].items() if w != ("END",)), key=lambda x: (-x[1], x[0][0].encode()))][: op3_lm.SINGLE - 1]
    cls = lambda w: 0 if w == "END" else single.index(w) + 1 if w in single else int(op3_lm._ending(b := np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(b)]))[0])
    size = Counter()
    for (w,), n in counts[0].items():
        size[cls(w)] += n + 1

    def p(f, less=0):
        (w,), pair, skip, triple, ctx = f
        n = counts[0][w,]
        own = 1 / op3_lm.CLASSES * ((n + 1 - less) / (size[cls(w)] + 1) if cls(w) >= op3_lm.SINGLE else 1)
        own = own or 1 / (sum(counts[0].values()) + len(counts[0]) + 1)
        of = [counts[0][pair[0],] if pair[0] else n_docs, counts[4][ctx], (counts[1][triple[:2]] if triple[1] else n_docs)]
        seen = [c[x] - less for c, x in zip(counts[1:4], (pair, skip, triple))]
        of = [x - less for x in of]
        level = [x if x < 4 else int(math.log2(x)) + 2 for x in of]
        z = [1.0] + [math.exp(mixture[0, k, level[k]] + mixture[1, k, level[2]]) if of[k] else 0 for k in range(3)]
        return (z[0] * own + sum(a * s / o for a, s, o in zip(z[1:], seen, of) if o)) / sum(z)

    monkeypatch.setattr(op3_lm, "train", lambda table, epochs: (op3_lm.Weights(), []))
    monkeypatch.setattr(op3_lm, "train_mixture", lambda table: (mixture, events.update({r.number: r.n for r in table.collect()}))[:2])
    total, v = sum(counts[0].values()), len(counts[0])
    want = []
    for i, tok in rows:
        fs = features(tok)
        want.append((i, out[i], len(fs), sum(counts[0][f[0]] > 0 for f in fs), total, *(pytest.approx(x, rel=1e-6, abs=1e-6) for x in (sum(math.log10((counts[0][f[0]] + 1) / (total + v + 1)) for f in fs), sum(math.log10(p(f)) for f in fs), sum(math.log10(p(f, int(not out[i]))) for f in fs)))))
    key = lambda r: (r[0], r[2])
    for part_bytes in (op3_lm.PART, 3000):
        events.clear()
        got = op3_lm.score(docs, ~held_out("doc_id", 7, 2), part_bytes=part_bytes).collect()
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
        assert sum(events.values()) == total
    empty = op3_lm.score(docs.limit(0), F.lit(True), epochs=1)
    assert empty.count() == 0
    none = op3_lm.score(docs, F.lit(False), epochs=1).first()
    assert none.n_known == 0 and none.train_tokens == 0 and none.base_score == 0 and none.score == none.left_out_score < 0


def test_lm_mixture_learns_what_predicts(spark):
    """Of tokens that only a seen trigram predicts, the trigram's weight grows; the likelihood never falls by much."""
    rng = np.random.default_rng(3)
    part = type("P", (), {"train": np.ones(400)})
    seen = np.stack([rng.integers(1, 2, 400), rng.integers(1, 2, 400), rng.integers(1, 4, 400)]).astype(float)
    number, n = op3_lm._events(part, np.full(400, 1e-4), seen, np.stack([seen[0] + 9, seen[1] + 9, seen[2]]))
    mixture, likes = op3_lm.train_mixture(spark.createDataFrame([(int(a), int(b)) for a, b in zip(number, n)], "number long, n long"))
    assert likes[-1] > likes[0] + 50 and (mixture[0, 2, 1] + mixture[1, 2, 1]) > 1 > -1 > mixture[0, 0, 5] + mixture[1, 0, 1]
    assert op3_lm._shares(mixture, np.array([[0, 3], [2, 3], [0, 1]])).sum(0) == pytest.approx(1)


def test_lm_training_beats_the_base_on_held_out_texts(spark):
    rng = np.random.default_rng(6)
    follow = {w: rng.choice(200, 3) for w in range(200)}
    rows = []
    for i in range(300):
        tok = [int(rng.integers(200))]
        while len(tok) < 40:
            tok.append(int(rng.choice(follow[tok[-1]])))
        rows.append((i, " ".join(f"w{k}x{k % 7}" for k in tok)))
    got = op3_lm.score(documents(spark, rows=rows), ~held_out("doc_id", 7, 2), epochs=3).where("held_out").collect()
    assert len(got) > 20 and sum(r.score for r in got) > 0.5 * sum(r.base_score for r in got)


def test_lm_classes_sum_to_one_and_training_helps(spark):
    w = op3_lm.Weights()
    rng = np.random.default_rng(0)
    for p in w.parts:
        p[:] = rng.normal(size=p.shape)
    assert np.exp(w.log_p(np.arange(50))).sum(1) == pytest.approx(1)
    table = spark.createDataFrame([(c, [(k, int(rng.integers(1, 9))) for k in rng.choice(192, 9, replace=False).tolist()]) for c in range(300)], "context int, classes array<struct<class:short,n:long>>")
    _, likes = op3_lm.train(table, epochs=6)
    assert likes[-1] > likes[0]


def test_swept_deletes_finished_shuffles(spark):
    import time

    from stratachain.llm import base

    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    base.swept(spark)
    time.sleep(2)
    for k in range(5):
        base.staged(spark.range(1000).groupBy(F.col("id") % (k + 3)).count(), "sums")
    before = held()
    base.swept(spark)
    for _ in range(20):
        if held() < before - 2:
            break
        time.sleep(0.25)
    assert held() < before - 2


def test_lm_tables_leave_no_shuffle_files(spark, monkeypatch):
    """A table's shuffle files go when it is written, without a collection; the session's setting is as it was."""
    import time

    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    staged, more = op3_lm.staged, {}

    def seen(df, name):
        before = held()
        out = staged(df, name)
        for _ in range(20):
            if held() <= before:
                break
            time.sleep(0.25)
        more[name] = held() - before
        return out

    monkeypatch.setattr(op3_lm, "staged", seen)
    monkeypatch.setattr(op3_lm, "swept", lambda spark: None)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    docs = documents(spark, 60)
    assert op3_lm.score(docs, ~held_out("doc_id", 7, 2), epochs=1, part_bytes=2000).count() == docs.count()
    assert more.keys() == {"words", "contexts", "answers", "events"} and max(more.values()) <= 0
    assert spark.conf.get(key, None) == was


def _near(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = words(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_against_all_pairs(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base[:k] + [f"z{k}"] + base[k + 1 :])) for k in range(0, 24)] + [(100 + k, " ".join(f"q{k}{m}" for m in range(20))) for k in range(5)] + [(200, "One"), (201, "one "), (202, None), (203, ""), (203, ""), (204, " \n")]
    rng = np.random.default_rng(8)
    for k in range(60):  # a family whose members differ from its first by up to a quarter
        own = [f"v{m}" for m in range(80)]
        for m in rng.choice(80, rng.integers(0, 14), replace=False):
            own[m] = f"u{rng.integers(0, 4)}"
        rows.append((300 + k, " ".join(own)))
    docs = documents(spark, rows=rows)
    want = _near([(i, t) for i, t in rows], 2, 80)
    for own in ({}, {"bands": 60, "rows": 2}):  # the query's bands, and ones that put much into a bucket that isn't alike
        got = op4_neardup.near_duplicates(docs, size=2, **own).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert op4_neardup.near_duplicates(docs.limit(0), size=2).count() == 0


def test_residual_index_loses_no_link(spark):
    """All pairs of a family that are alike, and not both linked with the hub, stand in the index and pass its bounds."""
    rng = np.random.default_rng(11)
    hub = rng.integers(-(2**62), 2**62, 60)
    sets = {b"\0": hub.tolist()}
    for k in range(1, 90):
        own = hub[rng.random(60) > rng.uniform(0.02, 0.3)].tolist()
        sets[bytes([k])] = [*own, *(int(x) for x in rng.choice(40, rng.integers(0, 14), replace=False))]
    frame = spark.createDataFrame([(bytearray(k), v) for k, v in sets.items()], "digest binary, s array<long>")
    members = frame.select(F.lit(bytearray(b"\0")).alias("hub"), F.col("digest").alias("v"))
    index = op4_neardup._residuals(members, frame, 80).withColumn("c", F.col("v"))
    got = {(bytes(r.a), bytes(r.b)) for r in op4_neardup._paired(index, index, 80, F.col("x.v") < F.col("y.v")).collect()}
    alike = lambda a, b: 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))
    want = {(a, b) for a in sets for b in sets if b"\0" < a < b and alike(a, b) and not (alike(a, b"\0") and alike(b, b"\0"))}
    assert want and want <= got and len(got) < 90 * 89 / 6


def test_superminhash_estimates_likeness():
    rng = np.random.default_rng(3)
    both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (160, 20, 20))
    sets = [np.sort(np.concatenate([both, x])) for x in (a, b)]
    sig = op4_neardup.superminhash(np.concatenate(sets), np.array([0, 180, 360]), 512)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.06
    one = op4_neardup.superminhash(both[:1], np.array([0, 1]), 16)
    assert sorted(np.floor(one[0]).tolist()) == list(range(16))


def test_toxicity_finds_unseen_forms(spark):
    rng = np.random.default_rng(1)
    clean = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(300)]
    text = lambda bad: " ".join([*rng.choice(clean, rng.integers(5, 60)), *bad])
    stems = ["zorkan", "quimpel"]
    rows = [(k, text([f"{rng.choice(stems)}{rng.choice(['s', 'isch', 'ed', 'o', 'ung'])}" for _ in range(3)] if k % 3 == 0 else [])) for k in range(240)]
    docs = documents(spark, rows=rows)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(240)] + [(None, 1), (500, 1), (3, None)], "doc_id long, toxic int")
    model = op5_toxicity.fit(docs, labels, F.col("doc_id") < 200)
    probe = documents(spark, rows=[(1, text(["zorkanlich", "quimpelade"])), (2, text([])), (3, None), (4, ""), (5, "  "), (6, "word " * 20000)])
    got = {r.doc_id: r.score for r in op5_toxicity.scored(probe, model).collect()}
    assert got[1] > 0.7 and all(got[k] < 0.7 for k in (2, 3, 4, 5, 6))
    assert op5_toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert [r.score for r in op5_toxicity.scored(probe, None).collect()] == [0.0] * 6
    assert op5_toxicity.scored(probe.limit(0), model).count() == 0


def test_toxicity_spread_over_many_words_raises_the_score():
    rng = np.random.default_rng(6)
    clean = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(200)]
    mild = ["".join(rng.choice(list("qrstuvwxyz"), 6)) for _ in range(40)]
    text = lambda n: " ".join([*rng.choice(clean, 30 - n, replace=False), *rng.choice(mild, n, replace=False)])
    model = op5_toxicity.train([text(10 if k % 2 else 1) for k in range(200)], np.arange(200) % 2)
    texts = [" ".join([*mild[:2], *rest]) for rest in (clean[:20], mild[2:22])]
    data, at = op5_toxicity.utf8(op5_toxicity.pa.array(texts))
    words_of = lambda t: op5_toxicity.distinct_words(*op5_toxicity.utf8(op5_toxicity.pa.array([t])))
    odds = [model.odds(*op5_toxicity.bags(*words_of(t)[:3])) for t in texts]
    want = [1 / (1 + math.exp(-(np.sort(o)[-2:].mean() + max(o.mean(), 0) + model.bias))) for o in odds]
    got = model.score(data, at)
    assert got == pytest.approx(want) and odds[1].mean() > 0 and got[1] > got[0]


def test_toxicity_training_words_by_slices(monkeypatch):
    data, at = op5_toxicity.utf8(op5_toxicity.pa.array(["One two one", "", "two three", None, "four ONE two"]))
    whole = op5_toxicity.training_words(data, at)
    monkeypatch.setattr(op5_toxicity, "slices", lambda at, most: ((k, k + 1) for k in range(len(at) - 1)))
    for a, b in zip(whole, op5_toxicity.training_words(data, at), strict=True):
        assert a.tolist() == b.tolist()
    assert list(zip(whole[2].tolist(), whole[3].tolist(), strict=True)) == [(0, 0), (0, 1), (2, 1), (2, 2), (4, 0), (4, 1), (4, 3)]


def _winnowed(text, k=op6_fingerprint.GRAM, w=op6_fingerprint.WINDOW):
    b = np.frombuffer(text.encode(), np.uint8)
    if not len(b):
        return []
    if len(b) < k:
        return [(int(Roller(b).ranges(np.array([0]), np.array([len(b)]))[0] >> np.uint64(32)), 0)]
    h = [int(x) for x in (Roller(b).grams(k) >> np.uint64(32))]
    out = []
    for i in range(max(1, len(h) - w + 1)):
        part = h[i : i + w]
        p = i + max(j for j, x in enumerate(part) if x == min(part))
        if not out or out[-1][1] != p:
            out.append((h[p], p))
    return out


def test_fingerprints_against_brute_force(spark):
    docs = documents(spark)
    texts = sorted(((i, t or "") for i, t in collected(docs)))
    want = []
    for k, (i, t) in enumerate(texts):
        u = texts[(k + 1) % len(texts)][1]
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        marks = [_winnowed(x) for x in (t, e, u)]
        near = [len(a & b) / len(a | b) if a | b else 1.0 for a, b in ((set(h for h, _ in marks[0]), set(h for h, _ in m)) for m in marks[1:])]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), marks[0], marks[1], *near))
    for ranges in (1, 5):
        got = sorted((r.doc_id, r.n_chars, r.edited_sha256, [tuple(x) for x in op6_fingerprint.parse(r.fingerprint).tolist()], [tuple(x) for x in op6_fingerprint.parse(r.edited_fingerprint).tolist()], r.near_edited, r.near_next) for r in op6_fingerprint.compare_edited(docs, ranges).collect())
        assert got == sorted(want)
    assert op6_fingerprint.compare_edited(docs.limit(0), 3).count() == 0
    one = op6_fingerprint.compare_edited(docs.where("doc_id = 14").limit(1), 3).collect()
    assert len(one) == 1 and one[0].near_next == 1 and one[0].doc_id == 14 and one[0].near_edited <= 1
    text = dict(collected(docs))[14]
    assert one[0].edited_sha256 == hashlib.sha256((text[: len(text) - len(text) // 2] + text[: len(text) // 2]).encode()).hexdigest()
    assert op6_fingerprint.fingerprints(docs).count() == len(texts)


def test_fingerprints_of_short_texts_keep_their_likeness():
    rng = np.random.default_rng(9)
    line = lambda n: "".join(rng.choice(list("abcdefghijklmnop "), n))
    for n in range(70, 87):  # half of the text is equal: 35 bytes or more
        t, u = line(n), line(n)
        marks = [op6_fingerprint.winnow(np.frombuffer(x.encode(), np.uint8), np.array([0, n])) for x in (t, t[: n - n // 2] + u[: n // 2], u)]
        same = [float(op6_fingerprint.likeness(marks[0][::2], m[::2])[0]) for m in marks]
        assert same[0] == 1 and 0 < same[1] < 1 and same[2] == 0


def test_license_against_its_sql(spark):
    import duckdb

    mit = " ".join(op8_license.TEMPLATES["MIT"][2:3])
    rows = [(1, None), (2, ""), (3, "Some words.\nReleased under the MIT License.\nMore"), (4, mit.upper()), (5, mit + "\n\n" + "All rights reserved."), (6, "all rights"), (7, "This work is licensed under the GNU General Public License, version 2"), (8, "x " * 9000 + "\nLicensed under CC BY-NC 4.0"), (3, "Some words.\nReleased under the MIT License.\nMore"), (9, "the License under version 2.0 of Apache")]
    docs = documents(spark, rows=rows)
    got = sorted(map(tuple, op8_license.scan(docs).collect()), key=str)
    con = duckdb.connect()
    frame = docs.select("doc_id", "text").toArrow()
    con.register("documents", frame)
    assert got == sorted(map(tuple, con.sql(op8_license.oracle_sql()).fetchall()), key=str)
    by = {r[0]: r for r in got}
    assert by[3][1] == "MIT" and by[4][1] == "MIT" and by[5][3] == "MIT,Proprietary" and by[7][1] == "GPL-2.0" and by[8][1] == "CC-BY-NC-4.0" and by[1][1:] == (None, 0.0, "")
    assert op8_license.scan(docs.limit(0)).count() == 0


def _windowed(text):
    """(id, score) of template-sized windows, by trying every position; of licences that are alike the one nearest there."""
    w, found = op8_license._pairs(text), {}
    every = [(k, set(g), len(g)) for k, texts in op8_license.TEMPLATES.items() for g in map(op8_license._pairs, texts)]
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b))
    for k, t, n in every:
        for i in range(len(w) - n + 1):
            if (d := dice(set(w[i : i + n]), t)) >= op8_license.LIKE:
                near = [dice(set(w[j : j + m]), u) for o, u, m in every if o != k for j in range(max(0, i - n // 5 - 1), i + n // 5 + 2) if w[j : j + m]]
                if d >= max(near):
                    found[k] = max(found.get(k, 0), d)
    return found


def test_license_inside_longer_lines(spark):
    mit = op8_license.TEMPLATES["MIT"][2].split()
    wrapped = "".join(f" * {' '.join(mit[k : k + 9])}\n *\n" for k in range(0, len(mit), 9))
    rows = [
        (1, "Copyright (c) 2020 Foo Ltd. All rights reserved."),
        (2, "This project is licensed under the MIT License."),
        (3, "A sentence of prose that says what it is about. Released under the MIT License. And more."),
        (4, f"/* Foo, a program\n *\n{wrapped} * Some more words follow here and do not matter\n */ int main;"),
        (5, "word " * 5000 + "this one is licensed under CC BY-SA 4.0 they say " + "word " * 5000),
        (6, "the general public likes software under a license of version 2 and all rights are reserved"),
        (7, "code licensed under the Apache License, Version 2.0 and docs licensed under CC BY 4.0 too, all rights reserved by us"),
        (8, "This work is licensed under the GNU General Public License, version 2."),
        (9, "Note that this work is licensed under the GNU General Public License, version 3, as is all of it"),
        (10, "This work is licensed under the GNU Lesser General Public License, version 3.\nThis work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ]
    got = {r.doc_id: r for r in op8_license.scan(documents(spark, rows=rows)).collect()}
    assert {i: got[i].licenses for i, _ in rows} == {1: "Proprietary", 2: "MIT", 3: "MIT", 4: "MIT", 5: "CC-BY-SA-4.0", 6: "", 7: "Apache-2.0,CC-BY-4.0,Proprietary", 8: "GPL-2.0", 9: "GPL-3.0", 10: "CC-BY-SA-4.0,LGPL-3.0"}
    for i, t in rows:
        want = _windowed(t)
        assert got[i].licenses == ",".join(sorted(want)) and got[i].score == pytest.approx(max(want.values(), default=0), abs=1e-6)


def test_license_anchors_lose_nothing():
    made = op8_license.compiled(op8_license.TEMPLATES)
    import re

    pattern = re.compile(op8_license.anchors(made))
    for _, grams in made:
        keep = math.ceil(len(grams) * op8_license.LIKE / (2 - op8_license.LIKE) - 1e-9)
        worst = sorted(grams, key=lambda g: max(map(len, g.split())))[:keep]
        assert pattern.search(" . ".join(worst))


def test_merged_transforms_order_all_suffixes():
    rng = np.random.default_rng(4)
    shards = [np.append(rng.integers(97, 100, n), 0xFE).astype(np.uint8) for n in (40, 1, 25)]
    inter, sa, prefix = merge([transform(s) for s in shards], 10)
    texts = [bytes(np.concatenate([s, s])) for s in shards]
    owner = np.repeat(np.arange(3), [len(s) for s in shards])
    base = np.cumsum([0, *(len(s) for s in shards)])
    got = [texts[owner[i]][sa[i] - base[owner[i]] :][:10] for i in inter]
    assert got == sorted(got)
    assert [bool(p >= 10) for p in prefix[1:]] == [a == b for a, b in zip(got, got[1:])]
    value, at = repeated_minimum(np.frombuffer(b"abcabxabc", np.uint8), np.array([0, 3, 6, 9]), np.array([5, 4, 9]), 2)
    assert value.tolist() == [4, 5, 4, 4, 4, 5] and at.tolist() == [0, 2, 4, 6]


def _removed(texts, length=50):
    first = {}
    for i, t in texts:
        if i is not None:
            b = (t or "").encode()
            for k in range(len(b) - length + 1):
                first[b[k : k + length]] = min(first.get(b[k : k + length], i), i)
    out = []
    for i, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if i is not None and first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, kept))
    return out


@pytest.mark.parametrize("part_bytes,many", [(1 << 24, 2000), (2000, 2000), (2000, 2)])
def test_repeats_against_brute_force(spark, part_bytes, many):
    docs = documents(spark, 30)
    got = op9_substring.remove_repeats(docs, part_bytes=part_bytes, many=many)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "score", "row", "n_bytes", "n_removed", "n_spans", "kept"]
    have = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect())
    want = sorted(_removed(collected(docs)))
    assert have == want and sum(x[2] for x in want) > 500
    if part_bytes > 2000:
        text = op9_substring.remove_repeats(docs, as_text=True)
        assert text.columns == docs.columns and {r.doc_id: r.text for r in text.collect() if r.doc_id is not None}.keys() == {i for i, _ in collected(docs) if i is not None}
        assert op9_substring.remove_repeats(docs.limit(0)).count() == 0


def test_settled_buckets_are_not_indexed(spark, monkeypatch):
    """Residuals are indexed only where pairs are left that neither hub of a bucket is part of, and each index is made once."""
    common = " ".join(f"s{k}" for k in range(20))
    docs = documents(spark, rows=[(k, f"{common} " + " ".join(f"o{k}x{m}" for m in range(10))) for k in range(6)])
    made, tables, residuals, staged = [], [], op4_neardup._residuals, op4_neardup.staged
    monkeypatch.setattr(op4_neardup, "_residuals", lambda members, *own: made.append(members.count()) or residuals(members, *own))
    monkeypatch.setattr(op4_neardup, "staged", lambda frame, name: tables.append(name) or staged(frame, name))
    for n in (3, 6):
        got = op4_neardup.near_duplicates(docs.where(F.col("doc_id") < n), size=2, bands=40, rows=1).collect()
        assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(k, k, True) for k in range(n)]
        assert bool(made) == (n == 6) and tables.count("index") == (n == 6)


def _cut_alone(texts):
    """The steps of op9 on one part, without Spark; and the bytes that the last step takes at its peak."""
    import tracemalloc

    import pyarrow as pa

    table = pa.table({"__id": pa.array([i for i, _ in texts], pa.int64()), "text": [t for _, t in texts], "__rest": pa.array([{"doc_id": i} for i, _ in texts]), "__row": np.arange(len(texts))})
    part, none = op9_substring._Part(table, 50), np.zeros(0, np.int64)
    part.minimizers(none)
    part.shared(op9_substring._answer(op9_substring._ask(part, 0, 1), 9), 1)
    low = op9_substring._resolve(op9_substring._send(part, 0, 1), 50)
    tracemalloc.start()
    try:
        got = op9_substring._cut(part, low, none, 1, False)
        return got.to_pylist(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_repeats_cut_in_slices(monkeypatch):
    """The cuts are the same however many texts are taken at once, and take a few bytes for a byte of the part's text."""
    texts = [(i, t) for i, t in enumerate(["", None, "é" * 90, "x", "é" * 70 + "y" * 60, "y" * 60 + " z"] + [f"{k} {'w' * (k % 70)} {'passage that is told again, ' * (k % 4)}" for k in range(80)])]
    want = sorted(_removed(texts))
    for step in (1, 300, 1 << 20):
        monkeypatch.setattr(op9_substring, "STEP", step, raising=False)
        got = _cut_alone(texts)[0]
        assert sorted((r["__rest"]["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for r in got) == want
    monkeypatch.undo()
    rng = np.random.default_rng(3)
    own = rng.integers(97, 123, (4000, 1000)).astype(np.uint8)
    own[::2, :60] = own[0, :60]
    got, peak = _cut_alone([(k, x.tobytes().decode()) for k, x in enumerate(own)])
    assert sum(r["n_removed"] for r in got) >= 1999 * 60 and peak < 8 * own.size


def test_few_links_are_joined_in_one_task(spark, monkeypatch):
    """Few links take one table a merge, and shingles are made once; dealt out, the same components come of it."""
    from stratachain.llm import components as union_find

    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"f{k % 3}w{m}" if rng.random() > 0.002 * (k % 40) else f"x{rng.integers(0, 4)}" for m in range(60))) for k in range(90)]
    docs, want = documents(spark, rows=rows), _near(rows, 2, 80)
    tables, shingled, staged, sets = [], [], op4_neardup.staged, op4_neardup.shingle_sets
    seen = lambda frame, name: tables.append(name) or staged(frame, name)
    for module in (op4_neardup, union_find):
        monkeypatch.setattr(module, "staged", seen)
    monkeypatch.setattr(op4_neardup, "shingle_sets", lambda *own: shingled.append(1) or sets(*own))
    for alone in (union_find.ALONE if hasattr(union_find, "ALONE") else 0, 0):
        monkeypatch.setattr(union_find, "ALONE", alone, raising=False)
        tables.clear(), shingled.clear()
        got = op4_neardup.near_duplicates(docs, size=2, bands=60, rows=2).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len({c for _, c in want.values()}) > 3
        assert len(shingled) == 1 and tables.count("near") > 1
        assert (tables.count("labels") == tables.count("near")) == (alone > 0)


@pytest.mark.parametrize("kind", ["long", "binary"])
def test_components_alone_and_dealt_out(spark, kind):
    from stratachain.llm.components import components, components_alone

    rng = np.random.default_rng(6)
    links = [(int(a), int(b)) for a, b in rng.integers(-80, 80, (70, 2))] + [(k, k + 1) for k in range(200, 260)] + [(300, 300)]
    if kind == "binary":
        links = [tuple(bytearray((x + 90).to_bytes(2, "big")) for x in pair) for pair in links]
    frame = spark.createDataFrame(links, f"a {kind}, b {kind}")
    one, two = (sorted((r.v, r.c) for r in f(frame).collect()) for f in (components_alone, components))
    assert one == two and len(one) > len({c for _, c in one})
    assert components_alone(frame.limit(0)).count() == 0


def test_near_duplicates_shuffles_are_brief(spark, monkeypatch):
    """While tables are written, what one has shuffled goes as soon as it is written; afterwards the setting is as before."""
    from stratachain.llm import components as union_find

    key, told, staged = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], op4_neardup.staged
    seen = lambda frame, name: told.append(spark.conf.get(key, None)) or staged(frame, name)
    for module in (op4_neardup, union_find):
        monkeypatch.setattr(module, "staged", seen)
    before = spark.conf.get(key, None)
    rows = [(k, " ".join(f"a{m}" if m != k else "z" for m in range(40))) for k in range(4)]
    assert {r.component_id for r in op4_neardup.near_duplicates(documents(spark, rows=rows), size=2).collect()} == {0}
    assert len(told) > 5 and set(told) == {"true"} and spark.conf.get(key, None) == before


def test_lm_sorts_distinct_words_only(monkeypatch):
    """Keys of 64 bits, many of them equal, are numbered in order, and only the distinct ones are sorted; asked again, features aren't counted again."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    key = rng.integers(0, 2**64, 40, np.uint64)[rng.integers(0, 40, 3000)]
    sorts, argsort, bincount = [], np.argsort, np.bincount
    monkeypatch.setattr(np, "argsort", lambda x, *own, **more: sorts.append(len(x)) or argsort(x, *own, **more))
    for keys in (key, key[:0]):
        for got, want in zip(op3_lm._grouped(keys, 64), np.unique(keys, return_inverse=True), strict=True):
            assert (got == want).all()
    assert max(sorts) <= 40
    table = pa.table({"doc_id": [1, 2], "text": ["a b a", "b c"], "_train": [True, False], "__row": [0, 1]})
    part = op3_lm.Tokens(table, op3_lm.Table(np.zeros(0, np.uint64)))
    told = op3_lm._answer(op3_lm._ask(part, 0, 1, 35), 35)
    weighed = []
    monkeypatch.setattr(np, "bincount", lambda x, *own: weighed.append(len(x)) or bincount(x, *own))
    word, seen, of = op3_lm._known(part, told, 35)
    assert not weighed and word.tolist() == [2, 1, 2, 1, 1, 0, 1] and (seen <= of).all()
    assert (op3_lm._level(np.array([0.0, 3, 4, 7, 8, 2.0**40])) == [0, 3, 4, 4, 5, 42]).all()
