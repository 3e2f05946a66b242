"""Small tables that hold the awkward cases of every operator."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=200):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward_rows(seed=1, n=60):
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.choice([1, 3, 5, 40, 200])), "en", rng.choice(["a", "b", "é", "😀", None]), 0) for i in range(n)]
    rows += [
        (1000, None, "en", "a", 0),
        (1001, "", None, "b", 0),
        (1002, " \t\n\x0b\x0c\r ", "en", "b", 0),
        (1003, words(rng, 30000), "en", "a", 0),
        (1004, "Ünïcode  text here\n\n <|im_end|> 漢字 " * 3, "en", None, 0),
        (None, "a row without an id", "en", "a", 0),
        (7, rows[7][1], "en", rows[7][3], 0),
        (8, "another text with a repeated id", "en", "a", 0),
    ]
    rows += [(2000 + i, rows[3][1] + " again and again", "en", "a", 0) for i in range(12)]
    return [(*r[:4], len(r[1] or "")) for r in rows]


def awkward(spark, seed=1, n=60):
    return spark.createDataFrame(awkward_rows(seed, n), DOCS).repartition(5)


def empty(spark):
    return spark.createDataFrame([], DOCS)
