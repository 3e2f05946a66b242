"""Command line: ``python -m rimward.cli -k 6 -n 10 -i points.csv -d 2 -o out [-r 10000] [-p plan] [-m metric] [-c rate] [-t threshold]``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimward.config import LofConfig
from rimward.operators import lof as L
from rimward.operators import microcluster as MC
from rimward.operators.knn import knn_pivot
from rimward.plans import strategies as S
from rimward.sources.points import read_points_csv, write_topn


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rimward", description="The N points with the largest local outlier factors.")
    p.add_argument("-k", type=int, required=True, help="neighbours")
    p.add_argument("-n", type=int, required=True, help="results")
    p.add_argument("-i", required=True, metavar="INPUT", help="text files of id,v0,... lines")
    p.add_argument("-d", type=int, required=True, metavar="DIMS", help="dimensions")
    p.add_argument("-o", required=True, metavar="OUTPUT", help="folder of the result")
    p.add_argument("-r", type=float, metavar="RANGE", help="width of the domain; by default that of the points")
    p.add_argument("-p", choices=["grid", "pivot", "cells", "bounds", "clusters"], default="grid", metavar="PLAN", help="grid, pivot, cells, bounds or clusters")
    p.add_argument("-m", default="L2Metric", metavar="METRIC", help="L1Metric or L2Metric")
    p.add_argument("-c", type=float, default=0.1, metavar="RATE", help="cluster radius as a share of the domain, for plan clusters")
    p.add_argument("-t", type=float, default=0.0, metavar="THRESHOLD", help="only scores over this are reported")
    p.add_argument("--include-self", action="store_true", help="each point is its own first neighbour")
    return p


def result(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    c = LofConfig(k=args.k, n=args.n, metric=args.m, include_self=args.include_self, threshold=args.t)
    points = read_points_csv(spark, args.i, args.d)
    if args.d > 2:
        return L.top_n(L.lof_of(knn_pivot(points, c.k, vectors=True, name=c.metric, include_self=c.include_self), c.k), c.n, c.threshold)
    if args.d == 1:
        points = points.withColumn("y", F.lit(0.0))
    if args.p == "clusters":
        width = args.r or max(points.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first())
        return S.micro_cluster(points, MC.leaders(points, args.c * width), c)
    return {"grid": S.grid, "pivot": S.pivot, "cells": S.small_cells, "bounds": S.cell_pruning}[args.p](points, c)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("rimward").getOrCreate()
    write_topn(result(spark, args), args.o)


if __name__ == "__main__":
    main()
