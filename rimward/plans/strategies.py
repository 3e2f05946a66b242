"""Interchangeable plans for the top-N outliers; all give the same rows, whatever the metric and ``include_self``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimward.config import LofConfig
from rimward.operators import lof as L
from rimward.operators import microcluster as MC
from rimward.operators import partition as P
from rimward.operators.caching import cut, keep
from rimward.operators.knn import knn_grid, knn_of, knn_pivot


def grid(points: DataFrame, c: LofConfig) -> DataFrame:
    return L.top_n(L.lof_of(knn_grid(points, c.k, c.metric, c.cell_points, c.include_self), c.k), c.n, c.threshold)


def pivot(points: DataFrame, c: LofConfig) -> DataFrame:
    return L.top_n(L.lof_of(knn_pivot(points, c.k, name=c.metric, include_self=c.include_self), c.k), c.n, c.threshold)


def closure(points: DataFrame, survivors: DataFrame, c: LofConfig) -> DataFrame:
    """Neighbours of the survivors, of their neighbours, and of those' neighbours: all that their scores need."""
    near = lambda ids: knn_of(points, ids, c.k, c.metric, c.cell_points, c.include_self)
    found, done = None, None
    ask = cut(survivors.select("id").distinct())
    for _ in range(3):
        new = cut(near(ask))
        found = new if found is None else found.unionByName(new)
        done = ask if done is None else done.unionByName(ask)
        ask = cut(new.select(F.col("nid").alias("id")).distinct().join(done, "id", "left_anti"))
    return found


def survivors_only(points: DataFrame, survivors: DataFrame, c: LofConfig, share: float = 0.2) -> DataFrame:
    """Neighbours for the scores of ``survivors``: the closure of few, those of all points if there are many."""
    few = survivors.count() <= share * points.count()
    return closure(points, survivors, c) if few else knn_grid(points, c.k, c.metric, c.cell_points, c.include_self)


def cell_pruning(points: DataFrame, c: LofConfig, seeds: int = 200) -> DataFrame:
    """Exact scores of a few seeds give a threshold; points whose bound is not over it need no score."""
    knn = keep(knn_grid(points, c.k, c.metric, c.cell_points, c.include_self))
    bound = keep(L.point_bound(knn))
    seed = bound.where("bound is not null").orderBy(F.desc("bound"), "id").limit(seeds).select("id")
    best = L.top_n(L.lof_of_survivors(knn, seed, c.k), c.n, c.threshold).select("lof").collect()  # n numbers
    least = best[-1]["lof"] if len(best) == c.n else c.threshold
    survivors = bound.where(F.col("bound").isNull() | (F.col("bound") >= least - 1e-6)).select("id")
    return L.top_n(L.lof_of_survivors(knn, survivors, c.k), c.n, c.threshold)


def small_cells(points: DataFrame, c: LofConfig, least: int | None = None, seeds: int = 200) -> DataFrame:
    """Points of dense cells are left out before any neighbour but those of a few seeds is looked for.

    Buckets of ``least`` points (20 k) or more are split, and merged by their closest pairs; each has its own cell size. The n-th best score of the seeds,
    the points farthest out in their buckets, is the threshold, or the one given if that is higher. The rule needs neighbours that exclude the point itself.
    """
    if c.include_self:
        return grid(points, c)
    points = points.select("id", "x", "y")
    placed = P.kd_buckets(points, least or 20 * c.k)
    middle = placed.groupBy("bucket").agg(F.avg("x").alias("_x"), F.avg("y").alias("_y"), (F.var_pop("x") + F.var_pop("y")).alias("_v"))
    off = lambda a: (F.col(a) - F.col(f"_{a}")) * (F.col(a) - F.col(f"_{a}"))
    far = placed.join(middle.where("_v > 0"), "bucket").withColumn("_far", (off("x") + off("y")) / F.col("_v"))
    seed = cut(far.orderBy(F.desc("_far"), "id").limit(seeds).select("id"))
    best = L.top_n(L.lof_of_survivors(closure(points, seed, c), seed, c.k), c.n, c.threshold).select("lof").collect()  # n numbers
    threshold = (best[-1]["lof"] if len(best) == c.n else c.threshold) - 1e-6
    if threshold < P.sound_from(c.metric):
        return grid(points, c)
    merged = P.merged_buckets(placed, name=c.metric)
    celled = cut(P.with_bucket_cells(P.bucket_of(placed, merged), merged, threshold, c.k, c.metric))
    pruned = celled.join(P.dense_cells(celled, c.k), ["bucket", "cx", "cy"], "left_semi")
    survivors = cut(points.select("id").join(pruned.select("id"), "id", "left_anti"))
    return L.top_n(L.lof_of_survivors(survivors_only(points, survivors, c), survivors, c.k), c.n, c.threshold)


def micro_cluster(points: DataFrame, centroids: DataFrame, c: LofConfig, seeds: int = 200) -> DataFrame:
    """Clusters whose upper bound cannot reach the n-th lower bound are left out before any neighbour is looked for.

    Of many small clusters, the members of those with the largest upper bounds (``seeds``) or none are scored first, and the n-th of these
    scores is a threshold too; neighbours are then looked for only in the clusters that the bounds name.
    The bounds hold for neighbours that exclude the point itself; with ``include_self`` nothing is pruned.
    """
    if c.include_self:
        return grid(points, c)
    assigned, beside = MC.assign_near(points, centroids, c.k, c.metric)
    assigned = cut(assigned)
    clusters = cut(MC.stats(assigned, centroids))
    size = clusters.agg(F.count(F.lit(1)).alias("count"), F.max("n").alias("most")).first()
    if size["count"] > max(MC.FEW, c.k + 1) and size["most"] <= 4 * c.cell_points:
        return _best_first(points, assigned, clusters, size["count"], beside, c, seeds)
    bounds = cut(MC.lof_bounds(clusters, c.k, c.metric))
    survivors = cut(assigned.join(MC.pruned(bounds, c.n), "mc_id", "left_anti").select("id"))
    return L.top_n(L.lof_of_survivors(survivors_only(points, survivors, c), survivors, c.k), c.n, c.threshold)


def _best_first(points: DataFrame, assigned: DataFrame, clusters: DataFrame, count: int, beside: DataFrame | None, c: LofConfig, seeds: int, share: float = 0.2) -> DataFrame:
    """The scores of many small clusters' members in order of their upper bounds, as far as these reach the n-th score; if too many do, those of all points."""
    bounds, near = MC.bounds_and_near(clusters, c.k, c.metric, beside=beside)
    bounds = cut(bounds)

    def scores(asked: DataFrame) -> DataFrame:
        knn = MC.knn_near(assigned, near, MC.around(near, asked), c.k, c.metric)
        return cut(L.lof_of_survivors(knn, assigned.join(asked, "mc_id", "left_semi").select("id"), c.k))

    unknown = bounds.where("upper is null").select("mc_id")
    first = cut(unknown.unionByName(bounds.where("upper is not null").orderBy(F.desc("upper"), "mc_id").limit(seeds).select("mc_id")))
    if first.count() > share * count:
        return grid(points, c)
    known = scores(first)
    best = L.top_n(known, c.n, c.threshold).select("lof").collect()  # n numbers
    least = bounds.orderBy(F.desc("lower"), "mc_id").limit(c.n).agg(F.count(F.lit(1)).alias("c"), F.min("lower").alias("m")).first()
    least = max(best[-1]["lof"] if len(best) == c.n else c.threshold, least["m"] if least["c"] == c.n else c.threshold)
    rest = cut(bounds.where(F.col("upper") >= least - 1e-6 - 1e-9 * abs(least)).select("mc_id").join(first, "mc_id", "left_anti"))
    left = rest.count()
    if left > share * count:
        return grid(points, c)
    return L.top_n(known.unionByName(scores(rest)) if left else known, c.n, c.threshold)
