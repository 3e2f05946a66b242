import collections
import re

import pytest
from pyspark.sql import functions as F

from rimward.llm import mixing
from tests.llm.helpers import awkward, awkward_rows, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def goals(sizes):
    """Targets by repeated resharing, straight from the definition."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(sizes.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        for s in over or free:
            target[s] = 3.0 * sizes[s] if over else weight[s] * level
        if not over:
            break
        free -= over
        rest -= sum(target[s] for s in over)
    return target


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = awkward(spark).withColumn("size", F.lit("clash")).withColumn("slice", F.lit(0))
    rows = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for r in awkward_rows():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = goals(dict(sizes))
    assert len(rows) == len(awkward_rows())
    taken = collections.Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_each_source_takes_whole_epochs_and_one_cut(spark):
    by = collections.defaultdict(list)
    for r in mixing.mix(awkward(spark)).collect():
        by[r["source"]].append(r)
    for rows in by.values():
        epochs = int(rows[0]["target"] // rows[0]["source_size"])
        rest = sorted((r for r in rows if r["size"]), key=lambda r: r["mix_key"])
        assert sum(r["taken"] not in (epochs * r["size"], (epochs + 1) * r["size"]) for r in rest) <= 1


def test_materialise_holds_the_words_taken(spark):
    docs = awkward(spark)
    for name in ("_id", "_key", "_taken", "_no", "_cut", "size", "key", "taken", "cut", "_0", "_1"):
        docs = docs.withColumn(name, F.lit("clash"))
    taken = collections.Counter()
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    out = mixing.materialise(docs)
    assert out.columns == docs.columns
    found = collections.Counter()
    texts = collections.defaultdict(set)
    for r in awkward_rows():
        texts[r[0]].add(r[1] or "")
    for r in out.collect():
        found[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert any(t.startswith(r["text"]) for t in texts[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])
    assert {k: v for k, v in taken.items() if v} == dict(found)


def test_empty(spark):
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.materialise(empty(spark)).count() == 0
