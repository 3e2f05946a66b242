"""Distances and geometry as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(items: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, items)


def l1(a: list[Column], b: list[Column]) -> Column:
    return _sum([F.abs(x - y) for x, y in zip(a, b, strict=True)])


def l2(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(_sum([(x - y) * (x - y) for x, y in zip(a, b, strict=True)]))


METRICS = {"l1": l1, "l2": l2}


def metric(name: str):
    """The metric of that name, in any case, with or without the suffix "Metric"."""
    found = METRICS.get(name.lower().removesuffix("metric"))
    if found is None:
        raise ValueError(f"unknown metric {name!r}; known: {sorted(METRICS)}")
    return found


def l1_arrays(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def l2_arrays(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def hyperplane(p: list[Column], a: list[Column], b: list[Column]) -> Column:
    """Distance from p to the plane half way between a and b; null if a and b are equal."""
    gap = _sum([(y - x) * (y - x) for x, y in zip(a, b, strict=True)])
    along = _sum([(y - x) * (v - (x + y) / 2) for v, x, y in zip(p, a, b, strict=True)])
    return F.when(gap > 0, F.abs(along) / F.sqrt(gap))


SPACES = {"vector": METRICS}


def space(name: str) -> dict:
    """The metrics of a metric space; vectors are the only one."""
    if name not in SPACES:
        raise ValueError(f"unknown metric space {name!r}; known: {sorted(SPACES)}")
    return SPACES[name]


def greatest_of(a: Column, b: Column) -> Column:
    """The larger number at each place of two arrays."""
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def absorbs(distance: Column, threshold: float) -> Column:
    """Whether a cluster takes in an entry at that distance."""
    return (distance == 0) | (distance <= threshold)


def product(a: Column) -> Column:
    return F.aggregate(a, F.lit(1.0), lambda s, x: s * x)


def cf_distance(kind: str, n1: Column, s1: list[Column], q1: list[Column], n2: Column, s2: list[Column], q2: list[Column]) -> Column:
    """Distance of two cluster features (count, linear sums, square sums): D0 to D4."""
    if kind == "D0":
        return l2([s / n1 for s in s1], [s / n2 for s in s2])
    if kind == "D1":
        return l1([s / n1 for s in s1], [s / n2 for s in s2])
    n = n1 + n2
    if kind == "D2":
        return F.sqrt(F.greatest(_sum([(n2 * a - 2 * x * y + n1 * b) / (n1 * n2) for x, y, a, b in zip(s1, s2, q1, q2, strict=True)]), F.lit(0.0)))
    if kind == "D3":
        return F.sqrt(F.greatest(_sum([(2 * n * (a + b) - 2 * (x + y) * (x + y)) / (n * (n - 1)) for x, y, a, b in zip(s1, s2, q1, q2, strict=True)]), F.lit(0.0)))
    if kind == "D4":
        return F.sqrt(F.greatest(_sum([x * x / n1 + y * y / n2 - (x + y) * (x + y) / n for x, y in zip(s1, s2, strict=True)]), F.lit(0.0)))
    raise ValueError(f"unknown cluster distance {kind!r}")


def gap_to_box(p: Column, lo: Column, hi: Column) -> Column:
    """How far p is outside [lo, hi] on one axis."""
    return F.greatest(lo - p, F.lit(0.0), p - hi)


def boxes_meet(alo: list[Column], ahi: list[Column], blo: list[Column], bhi: list[Column]) -> Column:
    """Closed boxes share a point."""
    return reduce(lambda a, b: a & b, [(x <= w) & (z <= y) for x, y, z, w in zip(alo, ahi, blo, bhi, strict=True)])


def box_inside(alo: list[Column], ahi: list[Column], blo: list[Column], bhi: list[Column]) -> Column:
    """The first box lies in the second."""
    return reduce(lambda a, b: a & b, [(x >= z) & (y <= w) for x, y, z, w in zip(alo, ahi, blo, bhi, strict=True)])
