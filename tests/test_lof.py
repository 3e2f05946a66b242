"""The outlier operators on small tables with known answers, and the plans against each other."""

import math
import random

import pytest

from rimward import cli
from rimward.config import LofConfig
from rimward.functions.metrics import metric, space
from rimward.operators import lof as L
from rimward.operators import microcluster as MC
from rimward.operators import partition as P
from rimward.operators.knn import knn_grid, knn_pivot, knn_vectors, knn_within
from rimward.plans import strategies as S
from rimward.sources.points import read_points_csv, write_topn

POINTS = "id long, x double, y double"


def brute(points, k, dist=math.dist, own=False):
    near = {}
    for i, *p in points:
        order = sorted((dist(p, q), j) for j, *q in points if j != i)
        near[i] = ([(0.0, i)] if own else []) + order[: k - 1 if own else k]
    kd = {i: n[-1][0] for i, n in near.items() if n}
    lrd = {i: (k / s if (s := sum(max(d, kd[j]) for d, j in n)) > 0 else None) for i, n in near.items() if n}
    return near, {i: round(0.0 if lrd[i] is None or any(lrd[j] is None for _, j in n) else sum(lrd[j] / lrd[i] for _, j in n) / k, 6) for i, n in near.items() if n}


def some_points(seed=1, n=150):
    rng = random.Random(seed)
    out = [(i, rng.gauss(0, 1) * rng.choice([1, 10]), rng.uniform(-5, 5)) for i in range(n)]
    return out + [(1000, 200.0, -300.0), (1001, out[0][1], out[0][2]), (1002, -50.0, 3.0)]


@pytest.mark.parametrize("name, dist", [("L2Metric", math.dist), ("l1", lambda p, q: sum(abs(a - b) for a, b in zip(p, q, strict=True)))])
def test_neighbours_and_scores_against_brute_force(spark, name, dist):
    points = some_points()
    df = spark.createDataFrame(points, POINTS)
    near, want = brute(points, 6, dist)
    for found in (knn_grid(df, 6, name), knn_pivot(df, 6, name=name)):
        got = {}
        for r in found.orderBy("id", "rn").collect():
            got.setdefault(r["id"], []).append(r["nid"])
        assert got == {i: [j for _, j in n] for i, n in near.items()}
    scores = {r["id"]: r["lof"] for r in L.lof_of(knn_grid(df, 6, name), 6).collect()}
    assert scores == pytest.approx(want, abs=2e-6)


def test_plans_agree_and_pruning_loses_nothing(spark):
    df = spark.createDataFrame(some_points(2), POINTS)
    c = LofConfig(n=7)
    want = [tuple(r) for r in S.grid(df, c).collect()]
    assert [tuple(r) for r in S.pivot(df, c).collect()] == want
    assert [tuple(r) for r in S.cell_pruning(df, c, seeds=20).collect()] == want
    assert [tuple(r) for r in S.micro_cluster(df, MC.leaders(df, 8.0), c).collect()] == want
    for c in (LofConfig(n=7, metric="L1"), LofConfig(n=7, include_self=True)):
        want = [tuple(r) for r in S.grid(df, c).collect()]
        assert [tuple(r) for r in S.pivot(df, c).collect()] == want
        assert [tuple(r) for r in S.cell_pruning(df, c, seeds=20).collect()] == want
        assert [tuple(r) for r in S.micro_cluster(df, MC.leaders(df, 8.0), c).collect()] == want
    few = df.where("id % 40 = 0")
    want = {r["id"]: r["lof"] for r in L.lof_of(knn_grid(df, 6), 6).collect()}
    got = {r["id"]: r["lof"] for r in L.lof_of_survivors(S.closure(df, few, LofConfig()), few, 6).collect()}
    assert got and got == {i: want[i] for i in got}
    scores = {r["id"]: r["lof"] for r in L.lof_of(knn_grid(df, 6), 6).collect()}
    bounds = {r["id"]: r["bound"] for r in L.point_bound(knn_grid(df, 6).persist()).collect()}
    assert all(b is None or scores[i] <= b + 1e-6 for i, b in bounds.items())
    centroids = MC.leaders(df, 8.0).persist()
    assigned = MC.assign(df, centroids).persist()
    kept = {r["mc_id"]: (r["lower"], r["upper"]) for r in MC.lof_bounds(MC.stats(assigned, centroids), 6).collect()}
    for r in assigned.collect():
        low, high = kept[r["mc_id"]]
        assert low - 1e-5 <= scores[r["id"]] and (high is None or scores[r["id"]] <= high + 1e-5 or scores[r["id"]] == 0)


@pytest.mark.parametrize("name", ["L1", "L2"])
def test_dense_cells_are_left_out_without_loss(spark, name):
    """A clump far from few points: most of it is pruned before the search, the scores of what is pruned are under the threshold."""
    rng = random.Random(5)
    rows = [(i, i % 24 + rng.uniform(-0.2, 0.2), i // 24 + rng.uniform(-0.2, 0.2)) for i in range(576)]
    rows += [(600, -400.0, 10.0), (601, 12.0, 420.0), (602, 430.0, 3.0), (603, 11.0, -410.0)]
    df = spark.createDataFrame(rows, POINTS).repartition(2).persist()
    c = LofConfig(n=3, metric=name)
    scores = {r["id"]: r["lof"] for r in L.lof_of(knn_grid(df, c.k, name), c.k).collect()}
    placed = P.kd_buckets(df, 200)
    merged = P.merged_buckets(placed, name=name)
    celled = P.with_bucket_cells(P.bucket_of(placed, merged), merged, 80.0, c.k, name).persist()
    dense = P.dense_cells(celled, c.k)
    pruned = {r["id"] for r in celled.join(dense, ["bucket", "cx", "cy"], "left_semi").select("id").collect()}
    assert len(pruned) > 400 and not pruned & {600, 601, 602, 603}
    assert max(scores[i] for i in pruned) <= 80
    want = sorted(((-v, i) for i, v in scores.items()))[:3]
    assert [(-r["lof"], r["id"]) for r in S.small_cells(df, c, least=200, seeds=20).collect()] == want
    over = LofConfig(n=30, metric=name, threshold=90.0)
    want = sorted(((-v, i) for i, v in scores.items() if v > 90))
    assert [(-r["lof"], r["id"]) for r in S.small_cells(df, over, least=200, seeds=20).collect()] == want
    assert S.small_cells(df.limit(0), c).count() == 0


@pytest.mark.parametrize("name", ["L1", "L2"])
def test_neighbours_of_skewed_points_groups_and_copies(spark, name):
    """Diagonal and clustered points, groups of very different sizes, and many points at one place."""
    dist = math.dist if name == "L2" else lambda p, q: sum(abs(a - b) for a, b in zip(p, q, strict=True))
    rng = random.Random(9)
    points = [(i, t := rng.uniform(0, 100), t + rng.gauss(0, 0.1)) for i in range(300)] + [(1000 + i, rng.gauss(90, 1), rng.gauss(5, 1)) for i in range(200)]
    copies = [(5000 + i, 3.0, 3.0) for i in range(400)] + [(6000 + i, 3.0, 4.0) for i in range(3)]
    for some in (points, points + copies):
        near, _ = brute(some, 4, dist)
        for found in (knn_grid(spark.createDataFrame(some, POINTS), 4, name), knn_pivot(spark.createDataFrame(some, POINTS), 4, name=name)):
            got = {}
            for r in found.orderBy("id", "rn").collect():
                got.setdefault(r["id"], []).append((round(r["dist"], 9), r["nid"]))
            assert got == {i: [(round(d, 9), j) for d, j in n] for i, n in near.items()}
    grouped = [("big" if i < 300 else f"small{i % 30}", i, x, y) for i, x, y in points]
    want = {}
    for g in {r[0] for r in grouped}:
        want.update({i: [j for _, j in n] for i, n in brute([r[1:] for r in grouped if r[0] == g], 4, dist)[0].items() if n})
    got = {}
    for r in knn_within(spark.createDataFrame(grouped, "g string, " + POINTS), 4, "g", name).orderBy("id", "rn").collect():
        got.setdefault(r["id"], []).append(r["nid"])
    assert got == want


@pytest.mark.parametrize("name", ["L1", "L2"])
def test_vectors_against_brute_force(spark, name):
    dist = math.dist if name == "L2" else lambda p, q: sum(abs(a - b) for a, b in zip(p, q, strict=True))
    rng = random.Random(10)
    rows = [(i, [rng.gauss(0, 1) + 8 * (i % 3) for _ in range(7)]) for i in range(150)]
    rows += [(500 + i, rows[0][1]) for i in range(8)]
    near = {i: sorted((round(dist(p, q), 9), j) for j, q in rows if j != i)[:5] for i, p in rows}
    got = {}
    for r in knn_vectors(spark.createDataFrame(rows, "id long, v array<double>"), 5, name, 9, block=16).orderBy("id", "rn").collect():
        got.setdefault(r["id"], []).append((r["dist"], r["nid"]))
    assert got == near


def test_edge_cases(spark):
    make = lambda rows: spark.createDataFrame(rows, POINTS)
    few = [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 2.0), (4, 5.0, 5.0)]
    assert {r["id"]: r["lof"] for r in L.lof_of(knn_grid(make(few), 6), 6).collect()} == pytest.approx({i: round(v * 0 + w, 6) for (i, w), v in zip(brute(few, 6)[1].items(), range(4), strict=True)}, abs=2e-6)
    same = [(i, 1.0, 1.0) for i in range(9)]
    assert {r["lof"] for r in L.lof_of(knn_grid(make(same), 3), 3).collect()} == {0.0}
    assert {r["id"]: r["lof"] for r in L.lof_of(knn_grid(make([*same, (99, 50.0, 50.0)]), 3), 3).collect()}[99] == 0.0
    assert L.lof_of(knn_grid(make([(1, 0.0, 0.0)]), 3), 3).count() == 0
    assert S.grid(make([]), LofConfig()).count() == 0
    lattice = [(10 * i + j, float(i), float(j)) for i in range(10) for j in range(10)]
    assert S.grid(make(lattice), LofConfig(threshold=50.0)).count() == 0
    own = {r["id"]: r["lof"] for r in L.lof_of(knn_grid(make(lattice), 4, include_self=True), 4).collect()}
    assert own == pytest.approx(brute(lattice, 4, own=True)[1], abs=2e-6)


def test_files_and_names(spark, tmp_path):
    (tmp_path / "p.csv").write_text("1,0.5,-2,a text\n2,3,4\n\n3,1,1\n")
    df = read_points_csv(spark, str(tmp_path / "p.csv"))
    assert sorted(tuple(r) for r in df.collect()) == [(1, 0.5, -2.0), (2, 3.0, 4.0), (3, 1.0, 1.0)]
    (tmp_path / "bad.csv").write_text("1,0.5,-2\n2,x,4\n3,1\n4,1,1\n")
    assert sorted(r["id"] for r in read_points_csv(spark, str(tmp_path / "bad.csv"), on_error="skip").collect()) == [1, 4]
    with pytest.raises(Exception, match="malformed point"):
        read_points_csv(spark, str(tmp_path / "bad.csv")).collect()
    write_topn(spark.createDataFrame([(1, 2.5), (2, 1.5)], "id long, lof double"), str(tmp_path / "top"))
    assert "".join(p.read_text() for p in (tmp_path / "top").glob("part*")) == "2,1.5\n1,2.5\n"
    with pytest.raises(ValueError):
        metric("cosine")
    with pytest.raises(ValueError):
        space("string")


@pytest.mark.parametrize("plan, dims", [("grid", 2), ("clusters", 2), ("grid", 1), ("pivot", 3)])
def test_command_line(spark, tmp_path, plan, dims):
    points = [(i, *p[: min(dims, 2)], *([0.5 * (i % 7)] if dims == 3 else [])) for i, *p in some_points(4, 60)]
    (tmp_path / "p.csv").write_text("".join(",".join(map(str, p)) + "\n" for p in points))
    args = cli.parser().parse_args(["-k", "3", "-n", "5", "-i", str(tmp_path / "p.csv"), "-d", str(dims), "-o", str(tmp_path / "out"), "-p", plan])
    want = sorted(brute(points, 3)[1].items(), key=lambda x: (-x[1], x[0]))[:5]
    got = [(r["id"], r["lof"]) for r in cli.result(spark, args).collect()]
    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-6)


def test_halves_by_slices_equal_those_by_sorting(spark):
    rng = random.Random(12)
    points = [(i, rng.choice([1.0, 1.0, 1.0, 2.0, rng.uniform(0, 3)]), rng.gauss(0, 1)) for i in range(1001)]
    df = spark.createDataFrame(points, POINTS)
    by_sort = {r["id"]: r["bucket"] for r in P.median_buckets(df, 3).collect()}
    assert {r["id"]: r["bucket"] for r in P.median_buckets(df, 3, most_sorted=100).collect()} == by_sort
    parts = P.kd_buckets(df, 300, most_sorted=100)
    assert {r["id"]: r["bucket"] for r in parts.collect()} == {r["id"]: r["bucket"] for r in P.kd_buckets(df, 300).collect()}
    merged = P.merged_buckets(parts)
    assert sum(r["n"] for r in merged.collect()) == 1001
    assert P.bucket_of(parts, merged).count() == 1001


def test_leaders_fold_in_order_of_id(spark):
    points = [(i, float(x), 0.0) for i, x in enumerate([0, 1, 10, 2, 11, 30, 0.5])]
    got = [tuple(r) for r in MC.leaders(spark.createDataFrame(points, POINTS).repartition(3), 3.0).orderBy("mc_id").collect()]
    assert got == [(1, (0 + 1 + 2 + 0.5) / 4, 0.0), (2, 10.5, 0.0), (3, 30.0, 0.0)]


@pytest.mark.parametrize("name", ["L1", "L2"])
def test_merging_needs_no_neighbour_search(spark, monkeypatch, name):
    """Closest pairs of merged buckets, which may lie across their halves, without a search over the points of each level."""
    dist = math.dist if name == "L2" else lambda p, q: sum(abs(a - b) for a, b in zip(p, q, strict=True))
    rng = random.Random(14)
    points = [(i, rng.uniform(0, 90), rng.uniform(0, 60)) for i in range(400)] + [(1000 + i, rng.uniform(200, 200.5), rng.uniform(0, 0.5)) for i in range(300)]
    points += [(2000 + i, 500.0, float(i % 40)) for i in range(90)]
    placed = P.kd_buckets(spark.createDataFrame(points, POINTS), 30).persist()
    found = P.closest_pair_within
    monkeypatch.setattr(P, "closest_pair_within", lambda *a: pytest.fail("searched"))
    merged = P.merged_buckets(placed, ratio=3.0, name=name)
    monkeypatch.setattr(P, "closest_pair_within", found)
    where = {r["id"]: r["bucket"] for r in P.bucket_of(placed, merged).collect()}
    rows = merged.collect()
    assert 3 < len(rows) < 64 and {r["cp_dist"] for r in rows} > {0.0}
    for r in rows:
        mine = [p[1:] for p in points if where[p[0]] == r["bucket"]]
        assert r["n"] == len(mine) and r["cp_dist"] == pytest.approx(min(dist(a, b) for i, a in enumerate(mine) for b in mine[:i]), abs=1e-6)
    large = {r["bucket"]: r["cp_dist"] for r in P.leaf_pairs(placed, name, most=2).collect()}
    assert large == {r["bucket"]: r["cp_dist"] for r in P.leaf_pairs(placed, name).collect()}


def test_bounds_of_few_clusters_take_few_shuffles(spark):
    df = spark.createDataFrame(some_points(2), POINTS).repartition(4)
    centroids = MC.leaders(df, 8.0).persist()
    bounds = MC.lof_bounds(MC.stats(MC.assign(df, centroids), centroids), 6)
    assert bounds._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") <= 8
    assert bounds.count() == centroids.count() > 6


@pytest.mark.parametrize("name", ["L1", "L2"])
def test_many_clusters_meet_by_cells(spark, monkeypatch, name):
    """Nearest centroids and bounds of many clusters equal those of all pairs, which are not formed."""
    dist = math.dist if name == "L2" else lambda p, q: sum(abs(a - b) for a, b in zip(p, q, strict=True))
    rng = random.Random(15)
    points = [(i, float(i % 30), float(i // 30)) for i in range(900)] + [(1000 + i, rng.gauss(-90, 30), rng.gauss(15, 1)) for i in range(60)] + [(2000 + i, 400.0 * i, 900.0) for i in range(1, 9)]
    df = spark.createDataFrame(points, POINTS)
    centres = [(i + 1, 2.0 * (i % 15) + 0.5, float(i // 15)) for i in range(450)] + [(500, -100.0, 15.0), (501, -99.0, 15.0), (502, -99.0, 15.0)] + [(600 + i, 400.0 * i, 900.0) for i in range(1, 9)]
    centroids = spark.createDataFrame(centres, "mc_id long, cx double, cy double").persist()
    got = {r["id"]: (r["d"], r["mc_id"]) for r in MC.assign(df, centroids, name).collect()}
    assert {i: m for i, (_, m) in got.items()} == {i: min((dist(p, c), m) for m, *c in centres)[1] for i, *p in points}
    clusters = MC.stats(MC.assign(df, centroids, name), centroids).persist()
    want = sorted(tuple(r) for r in MC.lof_bounds(clusters, 6, name, few=1000).collect())
    want_kd = sorted(tuple(r) for r in MC.kdist_bounds(clusters, 6, name, MC.pairs(clusters, name)).collect())
    monkeypatch.setattr(MC, "pairs", lambda *a: pytest.fail("all pairs"))
    assert len(want) > 400 and sorted(tuple(r) for r in MC.kdist_bounds(clusters, 6, name).collect()) == want_kd
    bounds = MC.lof_bounds(clusters, 6, name)
    assert sorted(tuple(r) for r in bounds.collect()) == want
    assert MC.near_pairs(clusters, 6, name).count() < len(want) ** 2 / 3


def test_micro_cluster_plan_of_many_clusters(spark, monkeypatch):
    """The plan with a cluster for every two points, which are not compared pair by pair, gives the grid's rows."""
    points = [(i, float(i % 40), float(i // 40)) for i in range(800)] + [(1000 + i, *p) for i, p in enumerate([(-600.0, 10.0), (1600.0, 10.0), (50.0, -500.0), (50.0, 800.0)])]
    df = spark.createDataFrame(points, POINTS)
    centroids = MC.centroids_by(df.selectExpr("*", "floor(x / 2) * 1000000 + floor(y) as name"), "name")
    want = [tuple(r) for r in S.grid(df, LofConfig(n=4)).collect()]
    monkeypatch.setattr(MC, "pairs", lambda *a: pytest.fail("all pairs"))
    assert [tuple(r) for r in S.micro_cluster(df, centroids, LofConfig(n=4)).collect()] == want


@pytest.mark.parametrize("name", ["L1", "L2"])
def test_micro_cluster_plan_scores_the_highest_bounds_first(spark, monkeypatch, name):
    """Lower bounds alone prune nothing here: exact scores of few clusters do, so no neighbours of all points are looked for."""
    points = [(i, float(i % 50), float(i // 50)) for i in range(2600)] + [(5000 + i, *p) for i, p in enumerate([(-60.0, 10.0), (-120.0, 10.0), (-180.0, 10.0), (160.0, 10.0), (20.0, -50.0), (20.0, 180.0), (7.0, 7.0)])]
    df = spark.createDataFrame(points, POINTS)
    centroids = MC.centroids_by(df.selectExpr("*", "floor(x / 2) * 1000000 + floor(y) as name"), "name")
    c = LofConfig(n=4, metric=name)
    want = [tuple(r) for r in S.grid(df, c).collect()]
    bounds = MC.lof_bounds(MC.stats(MC.assign(df, centroids, name), centroids), 6, name).persist()
    assert MC.pruned(bounds, 4).count() < bounds.count() / 5
    for plain in ("knn_grid", "grid"):
        monkeypatch.setattr(S, plain, lambda *a: pytest.fail("neighbours of all points"))
    assert [tuple(r) for r in S.micro_cluster(df, centroids, c).collect()] == want
    # the seed alone gives no threshold worth the name; others follow, or all if these are too many
    monkeypatch.undo()
    assert [tuple(r) for r in S.micro_cluster(df, centroids, c, seeds=1).collect()] == want
    assert [tuple(r) for r in S.micro_cluster(df, centroids, c, seeds=4).collect()] == want
    assert [tuple(r) for r in S.micro_cluster(df, centroids, LofConfig(n=4, metric=name, threshold=1e9)).collect()] == []


@pytest.mark.parametrize("name", ["L1", "L2"])
def test_one_search_serves_assignment_and_bounds(spark, name):
    """The others around a cluster are k, or are looked for where centroids have no points; bounds are those of all pairs, and all neighbours lie in the clusters named."""
    rng = random.Random(17)
    points = [(i, float(i % 30), float(i // 30)) for i in range(900)] + [(1000 + i, rng.gauss(-90, 30), rng.gauss(15, 1)) for i in range(60)] + [(2000 + i, 400.0 * i, 900.0) for i in range(1, 9)]
    df = spark.createDataFrame(points, POINTS)
    centres = [(i + 1, 2.0 * (i % 15) + 0.5, float(i // 15)) for i in range(450)] + [(500, -100.0, 15.0), (501, -99.0, 15.0), (502, -99.0, 15.0)] + [(600 + i, 400.0 * i, 900.0) for i in range(1, 9)]
    empty = [(700 + i, 0.5, 0.1 + 0.01 * i) for i in range(8)]
    for centroids in (centres, centres + empty):
        held = spark.createDataFrame(centroids, "mc_id long, cx double, cy double").persist()
        assigned, beside = MC.assign_near(df, held, 6, name)
        rows = sorted(tuple(r) for r in assigned.collect())
        assert rows == sorted(tuple(r) for r in MC.assign(df, held, name).select(*assigned.columns).collect())
        clusters = MC.stats(assigned, held).persist()
        assert clusters.count() > MC.FEW and {r["c"] for r in beside.groupBy("mc_id").agg({"other": "count"}).withColumnRenamed("count(other)", "c").collect()} == {6}
        bounds, near = MC.bounds_and_near(clusters, 6, name, beside=beside)
        got = {r["mc_id"]: (r["n"], r["lower"], r["upper"]) for r in bounds.collect()}
        want = {r["mc_id"]: (r["n"], r["lower"], r["upper"]) for r in MC.lof_bounds(clusters, 6, name, few=1000).collect()}
        assert got.keys() == want.keys()
        for m, (n, low, high) in want.items():
            assert got[m][0] == n and got[m][1] == pytest.approx(low, abs=1e-4) and (high is None) == (got[m][2] is None) and (high is None or got[m][2] == pytest.approx(high, rel=1e-4))
        found = MC.knn_near(assigned, near, clusters.select("mc_id"), 6, name)
        assert sorted(tuple(r) for r in found.select("id", "nid", "rn").collect()) == sorted(tuple(r) for r in knn_grid(df, 6, name).select("id", "nid", "rn").collect())


def test_splitting_and_merging_take_no_job_a_level(spark, monkeypatch):
    """A table is split in one task, with the buckets of splitting level by level, and the passes of merging do not grow with the levels."""
    rng = random.Random(16)
    points = [(i, rng.choice([1.0, 2.0, rng.uniform(0, 30)]), rng.uniform(0, 30)) for i in range(900)] + [(1000 + i, 5.0, 5.0 + i % 3) for i in range(80)]
    df = spark.createDataFrame(points, POINTS).repartition(3)
    cuts, cut = [], P.cut
    monkeypatch.setattr(P, "cut", lambda d: cuts.append(1) or cut(d))
    of = lambda d: {r["id"]: r["bucket"] for r in d.collect()}
    for least, levels in ((30, None), (30, 3), (2000, None)):
        placed = P.kd_buckets(df, least, levels=levels)
        assert len(cuts) == 2
        assert of(placed) == of(P.kd_buckets(df, least, levels=levels, in_task=0)) == of(P.kd_buckets(df, least, levels=levels, in_task=250))
        cuts.clear()
    merged = P.merged_buckets(P.kd_buckets(df, 30))
    assert len(cuts) - 2 <= 7
    assert sum(r["n"] for r in merged.collect()) == 980
