"""Micro-clusters: assignment, statistics, features, distance bounds, outlier-factor bounds and pruning."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rimward.functions.metrics import cf_distance, hyperplane, l2, metric
from rimward.operators.caching import cut, keep
from rimward.operators.knn import _parts, dist_2d, knn_cells, knn_grid, knn_of, pairs_within, rank

C = F.col
#: So many clusters are held in one partition and compared pair by pair; of more, only those that are near enough meet.
FEW = 256


def centroids_by(points: DataFrame, group: str) -> DataFrame:
    """(mc_id, cx, cy): the mean of each group, numbered by name; the means are rounded so that every engine agrees."""
    means = points.groupBy(group).agg(F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"))
    return means.select(F.row_number().over(Window.orderBy(group)).cast("long").alias("mc_id"), "cx", "cy")


def leaders(points: DataFrame, radius: float) -> DataFrame:
    """(mc_id, cx, cy) by sequential leader clustering in order of id: a point joins the nearest running mean
    within ``radius`` or opens a cluster. It is one fold over all points, so it is for samples that fit a task."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        means: list[list[float]] = []
        for batch in batches:
            for x, y in zip(batch.x, batch.y, strict=True):
                near = min(((m[0] / m[2] - x) ** 2 + (m[1] / m[2] - y) ** 2, i) for i, m in enumerate(means)) if means else None
                if near and near[0] <= radius * radius:
                    m = means[near[1]]
                    m[0], m[1], m[2] = m[0] + x, m[1] + y, m[2] + 1
                else:
                    means.append([x, y, 1])
        yield pd.DataFrame([(i + 1, m[0] / m[2], m[1] / m[2]) for i, m in enumerate(means)], columns=["mc_id", "cx", "cy"])

    return points.coalesce(1).sortWithinPartitions("id").select("x", "y").mapInPandas(fold, "mc_id long, cx double, cy double")


def _nearest(points: DataFrame, centroids: DataFrame, k: int, name: str) -> DataFrame:
    """(id, nid, dist, rn): the k nearest places of centroids by cells, named by the smallest mc_id there."""
    uv = (C("x").alias("u"), C("y").alias("v"))
    places = cut(centroids.groupBy(C("cx").alias("x"), C("cy").alias("y")).agg(F.min("mc_id").alias("id")))
    return knn_cells(points.select("id", "x", "y", *uv), k, name, among=places.select("id", "x", "y", *uv))


def assign(points: DataFrame, centroids: DataFrame, name: str = "L2", few: int = FEW) -> DataFrame:
    """(id, x, y, mc_id, d): each point's nearest centroid, ties by mc_id. One array of few centroids goes along; many are met by cells."""
    centroids = keep(centroids)
    if centroids.count() > few:
        found = _nearest(points, centroids, 1, name)
        return cut(points.select("id", "x", "y").join(found.select("id", C("nid").alias("mc_id"), C("dist").alias("d")), "id"))
    held = centroids.agg(F.sort_array(F.collect_list(F.struct("mc_id", "cx", "cy"))).alias("held"))
    near = F.array_min(F.transform("held", lambda c: F.struct(metric(name)([C("x"), C("y")], [c["cx"], c["cy"]]).alias("d"), c["mc_id"].alias("mc_id"))))
    return points.crossJoin(F.broadcast(held)).withColumn("_n", near).select("id", "x", "y", C("_n.mc_id").alias("mc_id"), C("_n.d").alias("d"))


def assign_near(points: DataFrame, centroids: DataFrame, k: int, name: str = "L2", few: int = FEW) -> tuple[DataFrame, DataFrame | None]:
    """``assign``, and of more than ``few`` centroids (mc_id, other): k others around each cluster, from the same search.
    They are those nearest to the member that is nearest to the centroid."""
    centroids = keep(centroids)
    if centroids.count() <= few:
        return assign(points, centroids, name, few), None
    nn = _nearest(points, centroids, k + 1, name).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("dist", "nid"))).alias("nn"))
    found = cut(points.select("id", "x", "y").join(nn, "id").select("id", "x", "y", F.get("nn", F.lit(0))["nid"].alias("mc_id"), F.get("nn", F.lit(0))["dist"].alias("d"), F.slice("nn", 2, k).alias("nn")))
    least = found.groupBy("mc_id").agg(F.min(F.struct("d", "id", "nn")).alias("_m"))
    return found.drop("nn"), least.select("mc_id", F.explode("_m.nn.nid").alias("other"))


def stats(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """(mc_id, cx, cy, n, radius) of the clusters that have points."""
    return assigned.groupBy("mc_id").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius")).join(centroids, "mc_id").select("mc_id", "cx", "cy", "n", "radius")


def pairs(clusters: DataFrame, name: str = "L2") -> DataFrame:
    """Ordered pairs of different clusters with the distance of their centroids: a table of clusters is small."""
    other = clusters.select(*[C(c).alias(f"o_{c}") for c in clusters.columns])
    return clusters.join(other, C("mc_id") != C("o_mc_id")).withColumn("d", metric(name)([C("cx"), C("cy")], [C("o_cx"), C("o_cy")]))


def near_pairs(clusters: DataFrame, k: int, name: str = "L2", few: int = FEW) -> DataFrame:
    """``pairs``, of many clusters those only that the bounds of k-distances and outlier factors need.

    The k nearest centroids bound a cluster's kd_hi by u, the largest of their distances and radii, plus its own radius. The bounds need clusters whose
    least distance is at most kd_hi, so none whose centroid is farther than u and both radii. Clusters are met by classes of
    their radius, a power of two each, so that one large cluster widens the search for itself only.
    """
    return pairs(clusters, name) if clusters.count() <= max(few, k + 1) else _near_of_many(cut(clusters), k, name)


def _near_of_many(clusters: DataFrame, k: int, name: str, beside: DataFrame | None = None) -> DataFrame:
    """``beside``: k others around each cluster if they are at hand, which need not be the nearest; those of which some have no points are looked for."""
    centres = clusters.select(C("mc_id").alias("id"), C("cx").alias("x"), C("cy").alias("y"))
    own, other = clusters.select("mc_id", C("cx").alias("x"), C("cy").alias("y")), clusters.select(C("mc_id").alias("other"), C("cx").alias("nx"), C("cy").alias("ny"), C("radius").alias("_ro"))

    def most(near: DataFrame) -> DataFrame:
        return near.join(other, "other").join(own, "mc_id").groupBy("mc_id").agg(F.max(dist_2d(name) + C("_ro")).alias("_u"), F.count(F.lit(1)).alias("_c")).where(C("_c") >= k).drop("_c")

    named = (C("id").alias("mc_id"), C("nid").alias("other"))
    if beside is None:
        reach = cut(most(knn_grid(centres, k, name).select(*named)))
    else:
        reach = cut(most(beside))
        missing = cut(centres.join(reach.select(C("mc_id").alias("id")), "id", "left_anti").select("id"))
        if not missing.isEmpty():
            reach = cut(reach.unionByName(most(knn_of(centres, missing, k, name).select(*named))))
    kind = F.when(C("radius") > 0, F.ceil(F.log2("radius"))).otherwise(-9999).cast("int")
    kinds = clusters.groupBy(kind.alias("kind")).agg(F.max("radius").alias("_most")).collect()  # one for each power of two
    each = F.explode(F.array(*[F.struct(F.lit(r["kind"]).alias("kind"), F.lit(r["_most"]).alias("_most")) for r in kinds]))
    # each row becomes many, so small partitions are not merged
    dealt = lambda df: df.repartition(_parts(clusters), "mc_id")
    asked = dealt(clusters).join(dealt(reach).hint("merge"), "mc_id").withColumn("_k", each).withColumn("r", (C("_u") + 2 * C("radius") + C("_k._most")) * (1 + 1e-9) + 1e-5)
    asked = asked.withColumn("kind", C("_k.kind")).withColumn("x", C("cx")).withColumn("y", C("cy")).drop("_k", "_u")
    table = clusters.select(*[C(c).alias(f"o_{c}") for c in clusters.columns], kind.alias("kind"), C("cx").alias("nx"), C("cy").alias("ny"))
    met = pairs_within(asked, table, name).where("mc_id <> o_mc_id")
    return cut(met.select(*clusters.columns, *[f"o_{c}" for c in clusters.columns], C("dist").alias("d")))


def overlaps(clusters: DataFrame) -> DataFrame:
    return pairs(clusters).where("mc_id < o_mc_id and d < radius + o_radius").select("mc_id", C("o_mc_id").alias("other"))


def pair_bounds(clusters: DataFrame) -> DataFrame:
    """Least and largest distance of points of two clusters."""
    reach = C("radius") + C("o_radius")
    return pairs(clusters).where("mc_id < o_mc_id").select("mc_id", C("o_mc_id").alias("other"), F.round(F.greatest(C("d") - reach, F.lit(0.0)), 6).alias("least"), F.round(C("d") + reach, 6).alias("most"))


def point_bounds(assigned: DataFrame, clusters: DataFrame) -> DataFrame:
    """Least and largest distance of a point from another cluster's points: d -+ r, and for overlapping clusters the plane between the centroids."""
    own = clusters.select("mc_id", C("cx").alias("ax"), C("cy").alias("ay"), C("radius").alias("ar"))
    other = clusters.select(C("mc_id").alias("other"), C("cx").alias("bx"), C("cy").alias("by"), C("radius").alias("br"))
    both = assigned.join(F.broadcast(own), "mc_id").join(F.broadcast(other), C("mc_id") != C("other"))
    d = l2([C("x"), C("y")], [C("bx"), C("by")])
    apart = l2([C("ax"), C("ay")], [C("bx"), C("by")]) >= C("ar") + C("br")
    plane = F.coalesce(hyperplane([C("x"), C("y")], [C("ax"), C("ay")], [C("bx"), C("by")]), F.lit(0.0))
    return both.select("id", "other", F.round(F.when(apart, F.greatest(d - C("br"), F.lit(0.0))).otherwise(plane), 6).alias("least"), F.round(d + C("br"), 6).alias("most"))


def _least(clusters: DataFrame, k: int, both: DataFrame) -> DataFrame:
    """(mc_id, other, n, lo, hi, _lo, _hi): the pairs ``both`` and each cluster's own row; n counts the points of ``other`` but the member
    itself, lo and hi are its least and largest distance, null in _lo and _hi where fewer than k points are as near."""
    near = both.select("mc_id", C("o_mc_id").alias("other"), C("o_n").alias("n"), F.greatest(C("d") - C("radius") - C("o_radius"), F.lit(0.0)).alias("lo"), (C("d") + C("radius") + C("o_radius")).alias("hi"))
    near = near.unionByName(clusters.select("mc_id", C("mc_id").alias("other"), (C("n") - 1).alias("n"), F.lit(0.0).alias("lo"), (2 * C("radius")).alias("hi")))

    def reached(edge: str):
        order = Window.partitionBy("mc_id").orderBy(edge).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return F.when(F.sum("n").over(order) >= k, C(edge))

    # both orders are of the same partitions, so the pairs are shuffled once
    return near.withColumn("_lo", reached("lo")).withColumn("_hi", reached("hi"))


def _kdist(digits: int | None, over=lambda e: e) -> list:
    edge = lambda e: over(F.min(e)) if digits is None else F.round(over(F.min(e)), digits)
    return [F.coalesce(edge("_lo"), F.lit(0.0)).alias("kd_lo"), edge("_hi").alias("kd_hi")]


def kdist_bounds(clusters: DataFrame, k: int, name: str = "L2", both: DataFrame | None = None) -> DataFrame:
    """(mc_id, kd_lo, kd_hi) for a cluster's members: clusters in order of their least (largest) distance until k other points are reached.
    ``both`` are the clusters' ``near_pairs`` if they are at hand."""
    both = near_pairs(clusters, k, name) if both is None else both
    return _least(clusters, k, both).groupBy("mc_id").agg(*_kdist(6))


def _reached(clusters: DataFrame, k: int, name: str, few: int, digits: int | None, beside: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mc_id, n, kd_lo, kd_hi), then (mc_id, other, lo, hi, ...) of the clusters that may hold a member's neighbours, itself included,
    with the bounds of ``other``, then the same (mc_id, other) alone.

    Up to ``few`` clusters are held in one partition, so that nothing made of them is shuffled.
    """
    clusters = keep(clusters)
    count = clusters.count()
    clusters = F.broadcast(cut(clusters.coalesce(1))) if count <= few else cut(clusters)
    met = "lo <= kd_hi + 0.000001"
    if count > max(few, k + 1):
        rows = _least(clusters, k, _near_of_many(clusters, k, name, beside))
        rows = cut(rows.select("mc_id", "other", "n", "lo", "hi", *_kdist(digits, lambda e: e.over(Window.partitionBy("mc_id")))).where(met))
        full = rows.where("mc_id = other").select("mc_id", (C("n") + 1).alias("n"), "kd_lo", "kd_hi")
        # a cluster of one point holds no neighbour of its member
        rows = rows.where("mc_id <> other or n > 0")
        return full, rows.join(full.select(C("mc_id").alias("other"), C("kd_lo").alias("o_kd_lo"), C("kd_hi").alias("o_kd_hi")), "other"), rows.select("mc_id", "other")
    full = cut(clusters.join(_least(clusters, k, pairs(clusters, name)).groupBy("mc_id").agg(*_kdist(digits)), "mc_id").coalesce(1))
    full = F.broadcast(full) if count <= few else full
    near = pairs(full, name).select("mc_id", C("o_mc_id").alias("other"), "kd_hi", F.greatest(C("d") - C("radius") - C("o_radius"), F.lit(0.0)).alias("lo"), (C("d") + C("radius") + C("o_radius")).alias("hi"), "o_kd_lo", "o_kd_hi")
    near = keep(near.unionByName(full.select("mc_id", C("mc_id").alias("other"), "kd_hi", F.lit(0.0).alias("lo"), (2 * C("radius")).alias("hi"), C("kd_lo").alias("o_kd_lo"), C("kd_hi").alias("o_kd_hi")).where("n > 1")).where(met))
    return full, near, near.select("mc_id", "other")


def _bounds(full: DataFrame, near: DataFrame, met: DataFrame, digits: int | None) -> DataFrame:
    edge = lambda value: value if digits is None else F.round(value, digits)
    reach = near.groupBy("mc_id").agg(F.min(F.greatest("lo", "o_kd_lo")).alias("r_lo"), F.max(F.greatest("hi", "o_kd_hi")).alias("r_hi"))
    around = met.join(reach.select(C("mc_id").alias("other"), C("r_lo").alias("n_lo"), C("r_hi").alias("n_hi")), "other").groupBy("mc_id").agg(F.min("n_lo").alias("n_lo"), F.max("n_hi").alias("n_hi"))
    out = full.select("mc_id", "n").join(reach, "mc_id").join(around, "mc_id")
    return out.select("mc_id", "n", edge(F.when(C("n_hi") > 0, C("r_lo") / C("n_hi")).otherwise(0.0)).alias("lower"), edge(F.when(C("n_lo") > 0, C("r_hi") / C("n_lo"))).alias("upper"))


def lof_bounds(clusters: DataFrame, k: int, name: str = "L2", few: int = FEW) -> DataFrame:
    """(mc_id, n, lower, upper) of the outlier factors of a cluster's members; null where nothing is known.

    A member's neighbours lie in clusters whose least distance is at most kd_hi. Reachabilities between
    two clusters lie between max(least, kd_lo of the neighbour) and max(most, its kd_hi), so densities, and
    with them their ratios, are bounded.
    """
    return _bounds(*_reached(clusters, k, name, few, 6), 6)


def bounds_and_near(clusters: DataFrame, k: int, name: str = "L2", few: int = FEW, beside: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``lof_bounds`` without rounding, and (mc_id, other): the clusters that hold all neighbours of a cluster's members, which follows from the bounds.
    ``beside`` is what ``assign_near`` gives."""
    full, near, met = _reached(clusters, k, name, few, None, beside)
    return _bounds(full, near, met, None), met


def _light(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A table of ids, which goes along with the tasks if it is short."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


def around(near: DataFrame, asked: DataFrame, steps: int = 2) -> DataFrame:
    """(mc_id): the clusters ``asked`` and so many times those that hold their members' neighbours."""
    found = asked
    for _ in range(steps):
        found = _light(near.join(found, "mc_id", "left_semi").select(C("other").alias("mc_id")).unionByName(found).distinct())
    return found


def knn_near(assigned: DataFrame, near: DataFrame, asked: DataFrame, k: int, name: str = "L2") -> DataFrame:
    """(id, nid, dist, rn): the neighbours of the members of the clusters ``asked`` (mc_id), looked for in the clusters of ``near`` only."""
    other = assigned.select(C("mc_id").alias("other"), C("id").alias("nid"), C("x").alias("nx"), C("y").alias("ny"))
    met = near.join(asked, "mc_id", "left_semi").join(assigned.select("mc_id", "id", "x", "y"), "mc_id").join(other, "other").where("id <> nid")
    return rank(met.withColumn("dist", dist_2d(name)).select("id", "nid", "dist"), k)


def pruned(bounds: DataFrame, n: int) -> DataFrame:
    """Clusters none of whose members can be among the n largest: their upper bound is under the n-th largest lower bound."""
    bounds = keep(bounds)
    last = bounds.orderBy(F.desc("lower"), "mc_id").limit(n).agg(F.count(F.lit(1)).alias("c"), F.min("lower").alias("m")).where(C("c") == n)
    return bounds.join(F.broadcast(last), C("upper") < C("m")).select("mc_id")


def features(assigned: DataFrame) -> DataFrame:
    """Cluster features: count, linear sums and square sums."""
    sums = [F.round(F.sum(e), 6).alias(n) for n, e in (("sx", C("x")), ("sy", C("y")), ("qx", C("x") * C("x")), ("qy", C("y") * C("y")))]
    return assigned.groupBy("mc_id").agg(F.count(F.lit(1)).alias("n"), *sums)


def feature_distances(cf: DataFrame) -> DataFrame:
    """D0 to D4 of each pair of clusters."""
    other = cf.select(*[C(c).alias(f"o_{c}") for c in cf.columns])
    args = (C("n"), [C("sx"), C("sy")], [C("qx"), C("qy")], C("o_n"), [C("o_sx"), C("o_sy")], [C("o_qx"), C("o_qy")])
    both = cf.join(other, C("mc_id") < C("o_mc_id"))
    return both.select("mc_id", C("o_mc_id").alias("other"), *[F.round(cf_distance(k, *args), 4).alias(k.lower()) for k in ("D0", "D1", "D2", "D3", "D4")])


def sum_lambda(cf: DataFrame) -> DataFrame:
    """Number of sub-clusters and the root of the sum of their squared populations."""
    return cf.agg(F.count(F.lit(1)).alias("entries"), F.round(F.sqrt(F.sum(C("n") * C("n"))), 6).alias("sum_lambda"))


def pivot_kdist(assigned: DataFrame, k: int) -> DataFrame:
    """(mc_id, pivot_kdist): the distance of the k-th nearest member from the centroid, -1 for clusters of fewer members."""
    order = Window.partitionBy("mc_id").orderBy("d", "id")
    last = assigned.withColumn("rn", F.row_number().over(order)).where(C("rn") <= k).groupBy("mc_id").agg(F.count(F.lit(1)).alias("c"), F.max("d").alias("d"))
    return last.select("mc_id", F.round(F.when(C("c") == k, C("d")).otherwise(-1.0), 6).alias("pivot_kdist"))


def members(assigned: DataFrame) -> DataFrame:
    """(mc_id, place, id): the members of each cluster by id."""
    return assigned.select("mc_id", F.row_number().over(Window.partitionBy("mc_id").orderBy("id")).alias("place"), "id")
