import collections
import math
import zlib

import pytest
from pyspark.sql import functions as F

from rimward.llm import lm_scoring
from tests.llm.helpers import awkward, awkward_rows, empty

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if w] + [None]


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7


def brute(rows):
    """Counts and base scores from the definition, and the held-out histogram's exact probabilities."""
    c1, c2 = collections.Counter(), collections.Counter()
    for r in rows:
        if fold(r[0]) != 2:
            t = tokens(r[1])
            c1.update(t)
            c2.update(zip(["<s>", *t], t, strict=False))
    return c1, c2


@pytest.mark.parametrize("chunk_tokens", [1_000_000, 500])
def test_counts_and_scores(spark, chunk_tokens, monkeypatch):
    kept = {}
    learn = lm_scoring.learn_weights
    monkeypatch.setattr(lm_scoring, "learn_weights", lambda *a: kept.setdefault("w", learn(*a)))
    rows = awkward_rows()
    found = lm_scoring.score(awkward(spark).withColumn("fold", F.lit("clash")), chunk_tokens, bucket_chars=3000).collect()
    c1, c2 = brute(rows)
    n, v, w = sum(c1.values()), len(c1), kept["w"]
    want = collections.defaultdict(list)
    for r in rows:
        t = tokens(r[1])
        score = 0.0
        for h, x in zip(["<s>", *t], t, strict=False):
            ch = c1[None] if h == "<s>" else c1[h]
            b = lm_scoring.context_bucket(__import__("numpy").array([float(ch)]))[0]
            p = w[b][0] / (v + 1) + w[b][1] * c1[x] / n + (w[b][2] * c2[(h, x)] / ch if ch else 0)
            score += math.log10(p)
        want[(r[0], len(t))].append((fold(r[0]) == 2, sum(c1[x] > 0 for x in t), sum(math.log10((c1[x] + 1) / (n + v + 1)) for x in t), score))
    assert len(found) == len(rows)
    for r in found:
        assert r["train_tokens"] == n
        assert any(r["held_out"] == h and r["n_known"] == k and r["base_score"] == pytest.approx(b) and r["score"] == pytest.approx(s) for h, k, b, s in want[(r["doc_id"], r["n_tokens"])])


def test_weights_are_a_distribution_and_scores_beat_the_base(spark, monkeypatch):
    import numpy as np

    w = lm_scoring.learn_weights(np.array([3, 3, 0]), np.array([40, 0, 0]), np.array([5, 0, 0]), np.array([90, 10, 5]), 1000)
    assert np.allclose(w.sum(axis=1), 1) and (w > 0)[1:].all() and w[3][2] > 0.7 and w[0][2] == 0
    rows = [(i, " ".join(f"a{j % 7} b{(j * j + i) % 11}" for j in range(60)), "en", "s", 0) for i in range(300)]
    found = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).where("held_out").collect()
    assert found and sum(r["score"] for r in found) > 0.85 * sum(r["base_score"] for r in found)


def test_empty(spark):
    assert lm_scoring.score(empty(spark)).count() == 0
