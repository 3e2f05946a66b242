"""From neighbours to scores: k-distance, reachability, local reachability density, outlier factor, top-N."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimward.operators.caching import keep


def kdist(knn: DataFrame) -> DataFrame:
    return knn.groupBy("id").agg(F.max("dist").alias("kdist"))


def nn_dist(knn: DataFrame) -> DataFrame:
    return knn.groupBy("id").agg(F.min("dist").alias("nn_dist"))


def reach_dist(knn: DataFrame, kd: DataFrame | None = None) -> DataFrame:
    """(id, nid, reach): the larger of the distance and the neighbour's k-distance."""
    kd = (kd if kd is not None else kdist(knn)).select(F.col("id").alias("nid"), F.col("kdist").alias("nkdist"))
    return knn.join(kd, "nid").select("id", "nid", F.greatest("dist", "nkdist").alias("reach"))


def lrd(reach: DataFrame, k: int) -> DataFrame:
    """(id, lrd); null where all reachabilities are 0, which stands for an infinite density."""
    total = reach.groupBy("id").agg(F.sum("reach").alias("total"))
    return total.select("id", F.when(F.col("total") > 0, k / F.col("total")).alias("lrd"))


def lof(knn: DataFrame, density: DataFrame, k: int) -> DataFrame:
    """(id, lof); 0 where a density that enters is infinite."""
    own = density.select("id", F.col("lrd").alias("own"))
    near = density.select(F.col("id").alias("nid"), F.col("lrd").alias("other"))
    both = knn.select("id", "nid").join(near, "nid").groupBy("id").agg(F.sum("other").alias("s"), F.count("other").alias("known"), F.count(F.lit(1)).alias("all"))
    whole = F.col("own").isNotNull() & (F.col("known") == F.col("all"))
    return both.join(own, "id").select("id", F.round(F.when(whole, F.col("s") / F.col("own") / k).otherwise(0.0), 6).alias("lof"))


def lof_of(knn: DataFrame, k: int) -> DataFrame:
    """(id, lof) of every point of a neighbour table, which is read several times and so kept."""
    knn = keep(knn)
    return lof(knn, lrd(reach_dist(knn), k), k)


def top_n(scores: DataFrame, n: int, threshold: float = 0.0) -> DataFrame:
    return scores.where(F.col("lof") > threshold).orderBy(F.desc("lof"), "id").limit(n)


def point_bound(knn: DataFrame) -> DataFrame:
    """(id, bound): LOF is at most the largest reachability over the smallest neighbour's nearest distance.

    Null where that nearest distance is 0: nothing is known then.
    """
    near = nn_dist(knn).select(F.col("id").alias("nid"), F.col("nn_dist").alias("nnn"))
    reach = reach_dist(knn).join(near, "nid").groupBy("id").agg(F.max("reach").alias("most"), F.min("nnn").alias("least"))
    return reach.select("id", F.when(F.col("least") > 0, F.col("most") / F.col("least")).alias("bound"))


def lof_of_survivors(knn: DataFrame, survivors: DataFrame, k: int) -> DataFrame:
    """LOF of ``survivors`` only: densities of them and their neighbours, k-distances of those' neighbours."""
    knn = keep(knn)
    first = knn.join(survivors.select("id"), "id", "left_semi")
    need = first.select(F.col("nid").alias("id")).unionByName(survivors.select("id")).distinct()
    second = knn.join(need, "id", "left_semi")
    return lof(first, lrd(reach_dist(second, kdist(knn)), k), k)
