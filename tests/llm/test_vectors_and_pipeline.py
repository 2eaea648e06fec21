import numpy as np
import pytest

import corpus_pipeline
from stratachain.llm import op5_toxicity, op7_vectors

from .cases import collected, words


@pytest.mark.parametrize("cell", [8192, 16])
def test_vectors_against_all_pairs(spark, cell):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(6, 16))
    vecs = [(centre[k % 6] + rng.normal(size=16) * (0.02 + 0.09 * (k % 4))).astype(np.float32).tolist() for k in range(90)]
    rows = [(k, v, k % 2 if k != 7 else None) for k, v in enumerate(vecs)]
    rows += [(200, vecs[0], 0), (201, [2 * x for x in vecs[0]], 0), (202, None, 0), (203, [], 0), (204, [0.0] * 16, 0), (205, [float("nan")] * 16, 0), (206, [None] * 16, 0), (207, vecs[0][:8], 0), (0, vecs[0], 0), (208, [float("inf")] * 16, 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, vec string, n int").repartition(3)
    good = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            (_, a, p), (_, b, q) = rows[i], rows[j]
            if i != j and p is not None and p == q and good(a) and good(b) and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                link[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93
    ids = np.array([r[0] for r in rows])
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(link, low[None], 10**9).min(1))
        if (new == low).all():
            break
        low = new
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in op7_vectors.near_vectors(df, cell=cell).collect())
    assert got == sorted((int(i), int(k), int(c), bool(i == c)) for i, k, c in zip(ids, link.sum(1), low, strict=True)) and link.sum() > 100
    assert op7_vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_keep_double_precision(spark):
    one = np.random.default_rng(4).normal(size=16)
    rows = [(1, one.tolist(), 0), (2, (one * (1 + 1e-12)).tolist(), 0), (3, one.tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, op7_vectors.near_vectors(df).collect())) == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False)]
    far = [(1, [1.0, 0.0], "a"), (2, [0.93, (1 - 0.93**2) ** 0.5 * (1 - 1e-12)], "a"), (3, [0.93, (1 - 0.93**2) ** 0.5 * (1 + 1e-9)], "a")]
    got = {r.vec_id: r.n_links for r in op7_vectors.near_vectors(spark.createDataFrame(far, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_pigeonhole_budgets():
    blocks = op7_vectors._blocks(64, 0.93)
    assert blocks[0][0] == 0 and blocks[-1][1] == 64 and sum(b for *_, b in blocks) >= 0.14
    x = np.random.default_rng(0).normal(size=(5, 64))
    y = op7_vectors._turned(x)
    assert np.allclose(np.linalg.norm(y, axis=1), 1) and np.allclose(y @ y.T, (x @ x.T) / np.outer(*[np.linalg.norm(x, axis=1)] * 2))


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(300)]
    text = lambda n, bad=(): " ".join([*rng.choice(vocabulary, n), *bad])
    passage = text(60)
    rows, labels = [], []
    for k in range(150):
        bad = [f"zorkan{s}" for s in rng.choice(["s", "ed", "isch"], 3)] if k % 5 == 0 else []
        rows.append((k, text(int(rng.integers(20, 80)), bad)))
        labels.append((k, 0, int(k % 5 == 0)))
    near = rows[1][1]
    rows += [(200, near), (201, near + " tail"), (202, text(30) + " " + passage + " " + text(30)), (203, text(30) + " " + passage), (204, None), (205, ""), (None, text(20)), (206, "é" * 40), (1, near)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, kept int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", 1) for i, t in rows], schema).repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    folder, stages = str(tmp_path), dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns
    left = collected(clean)
    assert not [i for i, t in left if "zorkan" in (t or "")] and len(left) >= len(rows) - 32

    one = stages["near_duplicates"](spark, docs, folder)
    assert one.columns == docs.columns
    kept = sorted(i for i, _ in collected(one) if i is not None)
    shingles = {i: set(zip(*(words(t)[k:] for k in range(5)))) for i, t in rows}
    for i in kept:
        assert not any(j is not None and j < i and shingles[i] and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]) for j in shingles)
    assert {1, 202, 203, 204, 205} <= set(kept) and not {200, 201} & set(kept) and len(kept) == len(set(kept))
    assert len([1 for i, _ in collected(one) if i is None]) == 1

    cut = stages["repeats"](spark, one, folder)
    assert cut.columns == docs.columns and cut.count() == one.count()
    after = dict(collected(cut))
    assert passage in after[202] and passage[20:] not in after[203] and after[204] is None and after[205] == ""
    assert all(r.n_chars == len(r.text or "") for r in cut.collect())

    packed = stages["packing"](spark, cut, folder)
    assert {r.doc_id for r in packed.collect()} == set(after)
    total = corpus_pipeline.run(spark, folder).collect()
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(total[0].asDict())
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "packing"]
    assert op5_toxicity.CUT == 0.7


def test_near_duplicates_keep_rows_of_clashing_ids(spark):
    text = lambda a: " ".join(f"{a}{k}" for k in range(40))
    rows = [(3, text("a"), "en"), (7, text("a"), "en"), (7, text("b"), "en"), (9, text("c"), "en"), (9, text("d"), "en"), (11, text("e"), "fr"), (11, text("e"), "en"), (12, text("f"), "en"), (12, text("f") + " tail", "en"), (None, text("a"), "en"), (13, None, "en"), (13, "", "en"), (13, None, "en")]
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
        got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
        assert len(got) == 9 and len([r for r in got if r[0] == 12]) == 1
        assert {r for r in got if r[0] != 12} == {(3, text("a"), "en"), (7, text("b"), "en"), (9, text("c"), "en"), (9, text("d"), "en"), (11, text("e"), "en"), (None, text("a"), "en"), (13, None, "en"), (13, "", "en")}
