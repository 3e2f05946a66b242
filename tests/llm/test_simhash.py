import collections
import random

import xxhash
from pyspark.sql import functions as F

from rimward.llm import simhash
from tests.llm.helpers import DOCS, awkward, awkward_rows, empty, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=4):
    groups = list(range(len(prints)))

    def root(x):
        while groups[x] != x:
            x = groups[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance:
                groups[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def same(rows, ids, prints):
    roots = brute_components(prints)
    least = {}
    for i, r in zip(ids, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = collections.Counter((i, p, least.get(r)) for i, p, r in zip(ids, prints, roots, strict=True))
    assert collections.Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in rows) == want


def test_against_brute_force(spark):
    rows = awkward_rows()
    docs = awkward(spark).withColumn("fp", F.lit("clash")).withColumn("key", F.lit(1))
    same(simhash.near_duplicates(docs, block=2).collect(), [r[0] for r in rows], [brute_print(r[1]) for r in rows])


def test_links_and_blocks_on_random_prints(spark):
    rng = random.Random(3)
    prints = []
    for _ in range(40):
        base = rng.getrandbits(64)
        prints += [base]
        for _ in range(rng.choice([0, 3, 60])):
            x = rng.choice(prints[-5:])
            for _ in range(rng.choice([1, 2, 4, 5, 6])):
                x ^= 1 << rng.randrange(64)
            prints.append(x)
    prints = sorted(set(prints))
    fps = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    for n, block in ((len(prints), 8), (1 << 30, 512)):
        edges = simhash.links(fps, n, block=block).mapInArrow(simhash._forests(most=50), "node long, top long")
        tops = {r["node"]: r["top"] for r in simhash.components(edges).collect()}
        want = brute_components(prints)
        got = [tops.get(simhash._signed(p), simhash._signed(p)) for p in prints]
        assert len(set(zip(got, want, strict=True))) == len(set(want)) == len(set(got))


def test_nothing_that_grows_with_the_table_is_broadcast(spark):
    """A small file of fingerprints, exploded to 46 probes each, is not sent to the driver, nor is any table of components."""
    fps = simhash.stage(spark.range(3000).select(F.xxhash64("id").alias("fp")), "test-prints")
    plans = [simhash.links(fps, 3000), simhash.near_duplicates(awkward(spark))]
    assert ["Broadcast" in df._jdf.queryExecution().executedPlan().toString() for df in plans] == [False, False]


def shingle_set(text):
    words = (text or "").translate(LOW).encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_similar(texts, least=0.8):
    """Component of each text, by all pairs of distinct shingle sets."""
    sets = [shingle_set(t) for t in texts]
    groups = list(range(len(texts)))

    def root(x):
        while groups[x] != x:
            x = groups[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= least * len(a | sets[j]) > 0:
                groups[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def least_ids(ids, roots):
    least = {}
    for i, r in zip(ids, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return least


def edited_rows():
    """Unrelated texts, near copies of them in chains and stars, and texts that share a passage only."""
    rng = random.Random(5)
    rows = []
    passage = words(rng, 60, 5000)
    for n in range(12):
        base = words(rng, rng.choice([120, 180, 240]), 5000).split()
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 2, 25])):
            copy = list(rng.choice(rows).split() if n % 3 == 0 else base)
            copy[rng.randrange(len(copy))] = "changed"
            rows.append(" ".join(copy))
        rows.append(words(rng, 150, 5000) + " " + passage)
    return [(i, t, "en", "a", len(t)) for i, t in enumerate(rows)]


def test_similar_against_brute_force(spark):
    rows = edited_rows()
    docs = spark.createDataFrame(rows, DOCS).withColumn("hi", F.lit("clash")).withColumn("node", F.lit(1))
    roots = brute_similar([r[1] for r in rows])
    least = least_ids([r[0] for r in rows], roots)
    want = {r[0]: least[root] for r, root in zip(rows, roots, strict=True)}
    assert len(set(want.values())) >= 24
    for block in (2, 512):
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs, block=block).collect()}
        assert got == want
    assert simhash.keep_one(docs).columns == docs.columns


def test_forests_keep_what_is_connected():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in zip(rng.integers(0, 90, 400), rng.integers(100, 190, 400), strict=True)]

    def tops(edges):
        forest = simhash.Forest()
        for a, b in edges:
            forest.join(a, b)
        return {x: forest.root(x) for x in list(forest.up)}

    same, other = (np.array(x, np.int64).tobytes() for x in ([1, 2, 3, 4, 5], [6, 7, 8, 9, 10]))
    for most in (10, 100, 1000):
        out = []
        links = [pa.RecordBatch.from_arrays([pa.array([a]), pa.array([[b]])], ["fp", "near"]) for a, b in pairs]
        found = [pa.RecordBatch.from_arrays([pa.array([a, a]), pa.array([b, 500 + b]), pa.array([same, same]), pa.array([same, other])], ["node", "top", "a", "b"]) for a, b in pairs]
        for batches in (simhash._forests(most)(iter(links)), simhash._held(0.8, most)(iter(found))):
            out = [e for batch in batches for e in zip(batch["node"].to_pylist(), batch["top"].to_pylist(), strict=True)]
            assert tops(out) == tops(pairs)


def test_links_are_verified_before_they_are_thinned(spark):
    """Texts of similarity 0.8 or more between which closer links fail the verification stay joined."""
    rng = random.Random(11)
    rows = []
    for _ in range(8):
        base = words(rng, 200, 5000).split()
        for _ in range(40):
            copy = list(base)
            for i in rng.sample(range(0, 200, 10), rng.choice([2, 3, 4, 5])):
                copy[i] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(rows)]
    sets = [shingle_set(r[1]) for r in rows]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(rows, DOCS).repartition(5)).collect()}
    lost = sum(got[i] != got[j] for i, a in enumerate(sets) for j in range(i) if len(a & sets[j]) >= 0.8 * len(a | sets[j]))
    assert lost == 0


def test_no_pair_near_the_least_similarity_is_missed(spark):
    """Isolated pairs at 0.8 or a little more, of texts of any length; changes of words spread over the text."""
    rng = random.Random(12)
    rows = [(text := words(rng, 8, 10**6), text + " more") for _ in range(30)]
    for n, k in ((14, 1), (60, 1), (104, 2), (250, 5), (250, 5), (250, 5), (250, 5), (1000, 22), (1000, 22), (5000, 111)):
        base = words(rng, n, 10**6).split()
        copy = list(base)
        for i in range(k):
            copy[0 if n < 20 else 4 + i * (n // k)] = f"x{i}"
        rows.append((" ".join(base), " ".join(copy)))
    docs = spark.createDataFrame([(2 * i + j, t, "en", "a", len(t)) for i, pair in enumerate(rows) for j, t in enumerate(pair)], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()}
    for i, (a, b) in enumerate(rows):
        a, b = shingle_set(a), shingle_set(b)
        assert (got[2 * i] == got[2 * i + 1]) == (len(a & b) >= 0.8 * len(a | b)), i


def test_long_texts_are_decided_exactly(spark):
    """Isolated pairs of long texts just above and just below 0.8."""
    rng = random.Random(13)
    rows = []
    for k in [44, 45] * 15:  # 5 * k of 1996 shingles change: similarity 0.801 and 0.797
        base = words(rng, 2000, 10**6).split()
        copy = list(base)
        for i in range(k):
            copy[4 + i * 40] = f"x{i}"
        rows += [" ".join(base), " ".join(copy)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(rows)], DOCS)).collect()}
    want = brute_similar(rows)
    assert [got[i] == got[i + 1] for i in range(0, 60, 2)] == [want[i] == want[i + 1] for i in range(0, 60, 2)]
    assert len({got[i] == got[i + 1] for i in range(0, 60, 2)}) == 2


def test_keep_one_loses_no_text_to_null_and_repeated_ids(spark):
    rng = random.Random(21)
    a, b, c, d = (words(rng, 60, 10**6) for _ in range(4))
    rows = [(1, a), (1, b), (None, a + " more"), (None, c), (None, c), (None, d), (2, d), (1, a), (3, None), (4, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{n}", n) for n, (i, t) in enumerate(rows)], DOCS).withColumn("_rimward_id", F.lit(5)).withColumn("_rimward_hash", F.lit("x")).repartition(3)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == collections.Counter([(1, a), (1, b), (None, c), (2, d), (3, None)])


def test_stars_of_edited_copies_at_common_shingles(spark):
    """Copies that are similar to their centre only, so many that every shingle of it is common and dealt to blocks."""
    rng = random.Random(22)
    rows = []
    for _ in range(2):
        base = words(rng, 70, 10**6).split()
        rows.append(" ".join(base))
        for _ in range(150):
            copy = list(base)
            for i in rng.sample(range(4, 66), 2):
                copy[i] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rows += [words(rng, 70, 10**6) for _ in range(50)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(rows)], DOCS).repartition(4)
    roots = brute_similar(rows)
    least = least_ids(range(len(rows)), roots)
    for block in (8, 512):
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs, block=block).collect()}
        assert got == {i: least[root] for i, root in enumerate(roots)}


def test_keep_one_and_empty(spark):
    docs = awkward(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = awkward_rows()
    least = least_ids([r[0] for r in rows], brute_similar([r[1] for r in rows]))
    found = collections.Counter((r["doc_id"], r["text"]) for r in kept.collect())
    want = collections.Counter()
    first = {}
    for r, root in zip(rows, brute_similar([r[1] for r in rows]), strict=True):
        first.setdefault(root, []).append(r)
    for group in first.values():  # one row of each component: that with the smallest id, of several texts with it any
        least_id = min((r[0] is None, r[0] or 0) for r in group)
        some = [(r[0], r[1]) for r in group if (r[0] is None, r[0] or 0) == least_id and (r[0], r[1]) in found]
        want[some[0]] += 1
    assert found == want and set(least.values()) - {None} <= {i for i, _ in found}
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_texts_are_joined_by_their_fingerprints(spark, monkeypatch):
    """Texts whose SimHash fingerprints link are joined once their sets are similar enough, without any shared prefix member."""
    rng = random.Random(31)
    rows = []
    for _ in range(12):
        base = words(rng, 400, 10**6)
        rows += [base, base + " more", "more " + base]
    rows += [words(rng, 400, 10**6) for _ in range(10)] + ["", None]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(rows)], DOCS).repartition(3)
    prints = [brute_print(t) for t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    assert len(linked) >= 12
    none = lambda *args: spark.createDataFrame([], simhash.PAIRS)
    monkeypatch.setattr(simhash, "first_candidates", none)
    monkeypatch.setattr(simhash, "other_candidates", none)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()}
    assert all(got[i] == got[j] for i, j in linked)
    assert len({got[i] for i in range(36, 46)}) == 10 and len({got[3 * i] for i in range(12)}) == 12


def test_shared_keys_are_sorted_once(spark):
    rng = random.Random(5)
    rows = []
    for node in range(400):
        keys = sorted(rng.sample(range(-300, 900), rng.randint(1, 12))) + ([7000] if node % 2 else [])
        rows.append((node - 200, 20 + node % 7, keys, [3 if k == 7000 else 2 if k % 50 == 0 else 1 for k in keys]))
    nodes = spark.createDataFrame(rows, "node long, n int, keys array<long>, parts array<int>")
    shared = simhash.shared_keys(nodes)
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (7, 10_000):  # groups that go on in later batches, and whole ones
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            found = simhash.shared_keys(nodes).collect()
            all_of = collections.defaultdict(list)
            dealt = {(r["node"], r["key"]): r["h"] for r in nodes.select("node", F.explode("keys").alias("key")).withColumn("h", F.xxhash64("node", "key")).collect()}
            for node, n, keys, parts in rows:
                for pos, (k, p) in enumerate(zip(keys, parts, strict=True)):
                    all_of[k, p, dealt[node, k] % p if p > 1 else 0].append((pos, n, node))
            want = {(k, p, part): sorted(v) for (k, p, part), v in all_of.items() if len(v) > 1 or p > 1}
            assert len(found) == len(want) and {(r["key"], r["parts"], r["part"]): [tuple(x) for x in r["held"]] for r in found} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert simhash.shared_keys(nodes.where("false")).collect() == []
