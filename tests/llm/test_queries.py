"""The registered queries and the pipeline on whole small tables."""

import collections
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rimward.llm import mixing, queries, toxicity
from rimward.llm.common import table
from tests.llm.helpers import DOCS
from tests.llm.test_simhash import brute_similar

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")

COLUMNS = {
    "op1_mixture_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op2_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op3_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op4_syncmer_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op5_simhash_near_dedup": "doc_id fingerprint component_id",
    "op6_license_scan": "doc_id license coverage",
    "op7_toxicity": "doc_id severity grade is_toxic",
    "op8_hnsw": "query_id rank vec_id score",
    "op9_source_mixing": "doc_id size source_size target taken",
    "op10_chat_formatting": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
}


@pytest.fixture(scope="module")
def found(spark):
    return {name: f(spark, SF) for name, f in queries.queries().items()}


def test_every_query_gives_its_columns_and_rows(spark, found):
    docs = table(spark, SF, "documents").count()
    assert found.keys() == COLUMNS.keys()
    for name, df in found.items():
        assert set(COLUMNS[name].split()) <= set(df.columns), name
        ids = df.select("doc_id").distinct().count() if "doc_id" in df.columns else df.count()
        assert ids == docs if "doc_id" in df.columns else ids > 0, name


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_sql(found, name):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = found[name].collect()
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(found[name].columns)
    assert collections.Counter(tuple(r[c] for c in names) for r in got) == collections.Counter(want.fetchall())


def test_nearest_vectors_score_what_they_are(spark, found):
    x = {r["vec_id"]: r["embedding"] for r in table(spark, SF, "embeddings").collect()}
    by = collections.defaultdict(list)
    for r in found["op8_hnsw"].collect():
        assert r["score"] == pytest.approx(sum(float(a) * float(b) for a, b in zip(x[r["query_id"]], x[r["vec_id"]], strict=True)), rel=1e-12)
        by[r["query_id"]].append((r["rank"], -r["score"], r["vec_id"]))
    assert by.keys() == {i for i in x if i % 20 == 0}
    hits = 0
    for q, rows in by.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)
        best = sorted((-sum(float(a) * float(b) for a, b in zip(x[q], x[j], strict=True)), j) for j in x if j != q)[:20]
        hits += len({j for _, j in best} & {r[2] for r in rows})
    assert hits >= 0.9 * 20 * len(by)


def test_mix_takes_what_its_targets_say(found):
    taken, target = collections.Counter(), {}
    for r in found["op9_source_mixing"].collect():
        taken[(r["source_size"], r["target"])] += r["taken"]
        target[(r["source_size"], r["target"])] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[k] - t) <= len(target) for k, t in target.items())


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on the whole table, its result held against what it is defined to be."""
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash_near_dedup", "source_mixing", "mixture_packing"]
    model = toxicity.train(docs, table(spark, SF, "labels"))
    rows = docs.collect()
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns
    sums = [sum(model.weights.get(int(x), 0.0) for x in toxicity.features(r["text"])) for r in rows]
    want = {r["doc_id"] for r, s in zip(rows, sums, strict=True) if model.expected(np.array([s]))[0] < model.cut}
    kept = clean.collect()
    assert {r["doc_id"] for r in kept} == want and len(want) < len(rows)
    one = stages["simhash_near_dedup"](spark, clean, SF).collect()
    roots = brute_similar([r["text"] for r in kept])
    least = {}
    for r, root in zip(kept, roots, strict=True):
        least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in one) == sorted(least.values())
    unique = spark.createDataFrame(one, docs.schema)
    mixed = stages["source_mixing"](spark, unique, SF)
    assert mixed.columns == docs.columns
    words = collections.Counter()
    for r in mixed.collect():
        words[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    goal = {r["source"]: r["t"] for r in mixing.mix(unique).groupBy("source").agg(F.first("target").alias("t")).collect()}
    assert all(abs(words[s] - t) <= 1 for s, t in goal.items())
    pieces = stages["mixture_packing"](spark, mixed, SF)
    total = pieces.agg(F.sum("length"), F.max("sequence_id")).first()
    assert (total[1] + 1) * 2048 - total[0] < 2048
    assert corpus_pipeline.run(spark, SF).count() == pieces.count()


def test_pipeline_on_awkward_documents(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "a text of some words that repeats", "en", "a", 0), (2, "a text of some words that repeats", "en", None, 0), (2, "w " * 30000, "en", "b", 0)]
    spark.createDataFrame(rows, DOCS).withColumn("_id", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in found.collect()} <= {None, 1, 2} and found.count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == found.count()
