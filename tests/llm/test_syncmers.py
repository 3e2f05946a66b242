import hashlib

import pytest
from pyspark.sql import functions as F

from rimward.llm import syncmers
from tests.llm.helpers import awkward, awkward_rows, empty, words


def brute(spark, texts):
    """Kept k-mers of each text from the definition, hashed by Spark."""
    blank = __import__("re").compile(r"[\x20\x09-\x0D]+")
    lists = [[w for w in blank.split(t) if w] for t in texts]
    every = sorted({w for ws in lists for w in ws}) or ["x"]
    h = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = sorted({(h[a], h[b]) for ws in lists for a, b in zip(ws, ws[1:], strict=False)}) or [(0, 0)]
    g = {(r["a"], r["b"]): r["x"] for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("x")).collect()}
    out = []
    for ws in lists:
        x = [h[w] for w in ws]
        inner = [g[p] for p in zip(x, x[1:], strict=False)]
        mers = []
        for i in range(len(x) - 4):
            low = min(inner[i : i + 4])
            mers.append((i, low in (inner[i], inner[i + 3])))
        out.append([i for i, keep in mers if keep])
    return out


def test_contract_on_awkward_rows(spark):
    rows = sorted(awkward_rows(), key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    texts = [r[1] or "" for r in rows]
    for range_docs in (7, 10_000):
        found = syncmers.compare_edited(awkward(spark).withColumn("range", F.lit("clash")), range_docs).collect()
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]) for r in found)
        want = []
        for i, r in enumerate(rows):
            text, after = texts[i], texts[(i + 1) % len(rows)]
            half = len(text) // 2
            want.append((r[0] is None, r[0] or 0, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
        assert got == sorted(want)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
        by = {}
        for r in found:
            if r["doc_id"] is not None and r["doc_id"] >= 2000:
                by.setdefault(r["fingerprint"], 0)
        assert len(by) == 1
    assert syncmers.compare_edited(empty(spark)).count() == 0


def test_ranges_beyond_the_bounds_and_positions(spark):
    rows = sorted(awkward_rows(), key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    after = [(r[0], r[1] or "", rows[(i + 1) % len(rows)][1] or "") for i, r in enumerate(rows)]
    found = syncmers.with_next(awkward(spark), 3, most_bounds=4).collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["next_text"]) for r in found))) == sorted(map(repr, after))
    texts, edits = [], []
    for _, text, other in after:
        half = len(text) // 2
        texts.append(text)
        edits.append(text[: len(text) - half] + other[:half])
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(texts, edits, strict=True))], "i int, a string, b string")
    placed = [{r["i"]: {(x["position"], x["hash"]) for x in r["anchors"]} for r in syncmers.anchors(pairs.select("i", F.col(c).alias("text"))).collect()} for c in "ab"]
    want = sorted((len(placed[0][i]), len(placed[0][i] & placed[1][i]), max((p + 5 for p, _ in placed[0][i] & placed[1][i]), default=0)) for i in range(len(texts)))
    assert sorted((r["anchors"], r["anchors_kept"], r["same_words"]) for r in syncmers.compare_edited(awkward(spark)).collect()) == want


def test_near_values_follow_the_sketches(spark):
    """Likeness as defined: the share of the union's smallest hashes that both hold."""
    found = syncmers.compare_edited(awkward(spark)).collect()
    cut = lambda s: {s[i : i + 8] for i in range(0, len(s), 8)}
    prints = [r["fingerprint"] for r in sorted(found, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))]

    def like(a, b):
        a, b = cut(a), cut(b)
        union = set(sorted(a | b)[: syncmers.SKETCH])
        return len(a & b & union) / len(union) if union else 1.0

    for r in found:
        assert r["near_edited"] == pytest.approx(like(r["fingerprint"], r["edited_fingerprint"]))
    unique = [r for r in found if r["doc_id"] is not None and 10 <= r["doc_id"] < 60]
    by_id = {r["doc_id"]: r["fingerprint"] for r in unique}
    assert prints and all(r["near_next"] == pytest.approx(like(r["fingerprint"], by_id[r["doc_id"] - 1])) for r in unique if r["doc_id"] - 1 in by_id)


def test_anchors_and_sketches_follow_the_definition(spark):
    import random

    rng = random.Random(6)
    texts = [words(rng, n, 50) for n in (0, 1, 4, 5, 6, 30, 300)] + ["  lead and trail blanks here now \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = syncmers.with_sketch(syncmers.anchors(df), "text", "sketch", 1000).orderBy("doc_id").collect()
    for r, want in zip(rows, brute(spark, texts), strict=True):
        assert [a["position"] for a in r["anchors"]] == want
        if want:
            assert r["sketch"] == sorted({a["hash"] & 0x7FFFFFFF for a in r["anchors"]})
        assert bool(r["sketch"]) == bool(r["text"].split())


def test_likeness_follows_shared_passages(spark):
    import random

    rng = random.Random(8)
    a, b = words(rng, 800, 10**6), words(rng, 800, 10**6)
    half = " ".join(a.split()[:400] + b.split()[:400])
    df = spark.createDataFrame([(a, a), (a, half), (a, b), ("", ""), ("", a)], "x string, y string")
    df = syncmers.with_sketch(syncmers.with_sketch(df, "x", "sx"), "y", "sy")
    got = [r[0] for r in df.select(syncmers.likeness("sx", "sy")).collect()]
    assert got[0] == 1 and got[1] == pytest.approx(1 / 3, abs=0.2) and got[2] < 0.05 and got[3:] == [1, 0]
