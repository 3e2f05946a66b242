"""Queries on tables of rectangles (id, x1, y1, x2, y2), two opposite corners each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimward.functions.metrics import box_inside, boxes_meet, gap_to_box

C = F.col


def _own():
    return [C("lox"), C("loy")], [C("hix"), C("hiy")]


def normalised(rects: DataFrame) -> DataFrame:
    return rects.select("id", F.least("x1", "x2").alias("lox"), F.least("y1", "y2").alias("loy"), F.greatest("x1", "x2").alias("hix"), F.greatest("y1", "y2").alias("hiy"))


def _box(box):
    return [F.lit(float(v)) for v in box[:2]], [F.lit(float(v)) for v in box[2:]]


def intersects(rects: DataFrame, box: tuple) -> DataFrame:
    return rects.where(boxes_meet(*_own(), *_box(box))).select("id")


def contained_by(rects: DataFrame, box: tuple) -> DataFrame:
    return rects.where(box_inside(*_own(), *_box(box))).select("id")


def nearest_n(rects: DataFrame, x: float, y: float, n: int) -> DataFrame:
    """The n nearest rectangles of a point and all that tie with the last, ties by id."""
    gaps = [gap_to_box(F.lit(p), lo, hi) for p, lo, hi in zip((float(x), float(y)), *_own(), strict=True)]
    far = rects.select("id", F.round(F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1]), 6).alias("dist"))
    last = far.orderBy("dist", "id").limit(n).agg(F.max("dist").alias("last"))
    return far.join(F.broadcast(last), C("dist") <= C("last")).select("id", "dist")


def bounds(rects: DataFrame) -> DataFrame:
    return rects.agg(F.min("lox").alias("lox"), F.min("loy").alias("loy"), F.max("hix").alias("hix"), F.max("hiy").alias("hiy"))


def measures(rects: DataFrame, box: tuple) -> DataFrame:
    """Width, height, area, aspect ratio, centre, enlargement to take in the box, and distance from it."""
    (ax, ay), (bx, by) = _box(box)
    w, h = C("hix") - C("lox"), C("hiy") - C("loy")
    grown = (F.greatest("hix", bx) - F.least("lox", ax)) * (F.greatest("hiy", by) - F.least("loy", ay))
    gx, gy = F.greatest(ax - C("hix"), C("lox") - bx, F.lit(0.0)), F.greatest(ay - C("hiy"), C("loy") - by, F.lit(0.0))
    named = {"width": w, "height": h, "area": w * h, "aspect": F.when((w > 0) & (h > 0), F.greatest(w, h) / F.least(w, h)), "mid_x": (C("lox") + C("hix")) / 2, "mid_y": (C("loy") + C("hiy")) / 2, "enlargement": grown - w * h, "distance": F.sqrt(gx * gx + gy * gy)}
    return rects.select("id", *[F.round(v, 6).alias(k) for k, v in named.items()])


def contains(rects: DataFrame, box: tuple) -> DataFrame:
    """Rectangles that hold the box."""
    return rects.where(box_inside(*_box(box), *_own())).select("id")


def edge_overlaps(rects: DataFrame, box: tuple) -> DataFrame:
    """Rectangles one of whose edges lies on the line of the same edge of the box."""
    lo, hi = _box(box)
    return rects.where((C("lox") == lo[0]) | (C("loy") == lo[1]) | (C("hix") == hi[0]) | (C("hiy") == hi[1])).select("id")


def equals(rects: DataFrame, box: tuple) -> DataFrame:
    lo, hi = _box(box)
    return rects.where((C("lox") == lo[0]) & (C("loy") == lo[1]) & (C("hix") == hi[0]) & (C("hiy") == hi[1])).select("id")


def union_with(rects: DataFrame, box: tuple) -> DataFrame:
    """Each rectangle grown to take in the box."""
    lo, hi = _box(box)
    return rects.select("id", F.least("lox", lo[0]).alias("lox"), F.least("loy", lo[1]).alias("loy"), F.greatest("hix", hi[0]).alias("hix"), F.greatest("hiy", hi[1]).alias("hiy"))


def nearest(rects: DataFrame, x: float, y: float) -> DataFrame:
    """The nearest rectangles of a point, all that tie."""
    return nearest_n(rects, x, y, 1)


def meeting_pairs(rects: DataFrame, cell_x: float, cell_y: float) -> DataFrame:
    """(id, other): rectangles that share a point, id < other.

    Each rectangle goes to the cells it covers; two meet in many cells, and the one with the low corner of what they share reports them.
    """
    at = lambda c, size: F.floor(C(c) / size)
    cells = rects.withColumn("cx", F.explode(F.sequence(at("lox", cell_x), at("hix", cell_x)))).withColumn("cy", F.explode(F.sequence(at("loy", cell_y), at("hiy", cell_y))))
    other = cells.select("cx", "cy", *[C(c).alias(f"o_{c}") for c in rects.columns])
    both = cells.join(other, ["cx", "cy"]).where((C("id") < C("o_id")) & boxes_meet(*_own(), [C("o_lox"), C("o_loy")], [C("o_hix"), C("o_hiy")]))
    first = (C("cx") == F.floor(F.greatest("lox", "o_lox") / cell_x)) & (C("cy") == F.floor(F.greatest("loy", "o_loy") / cell_y))
    return both.where(first).select("id", C("o_id").alias("other"))
