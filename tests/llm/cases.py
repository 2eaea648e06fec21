"""Documents with everything that may go wrong: nulls, empty and blank texts, ties, repeated rows, clashing names, long texts."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, row string, n_bytes long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def documents(spark, n=40, seed=2, rows=None):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgéß日") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(30))
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    texts[3] = texts[2]
    texts[5] = texts[4] + " Tail"
    texts[6] = "Head " + shared + "\nend"
    texts[7] = shared + "!"
    texts[8] = texts[9] = "It"
    texts[10] = "word " * 3000 + shared
    texts += [None, "", " \t\n", "   ", "x" * 120, "x" * 90, "don't we'll\r\n<|endoftext|>  ok  ", texts[2]]
    made = [(i * 7 % 1009, t) for i, t in enumerate(texts)] if rows is None else rows
    made += [made[1], made[-1]] if rows is None else []
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1.0, "r", 5) for i, t in made], SCHEMA).repartition(3)


def collected(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
