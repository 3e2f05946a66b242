"""Point tables and result files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def points_of_lines(lines: DataFrame, dims: int = 2, line: str = "value", on_error: str = "fail") -> DataFrame:
    """``id,v0,...`` lines to (id, x, y, ...) or, beyond two dimensions, (id, v). Further fields and empty lines are ignored.

    A line with fewer fields or other than numbers fails the job; with ``on_error="skip"`` it is left out.
    """
    if on_error not in ("fail", "skip"):
        raise ValueError("on_error is 'fail' or 'skip'")
    names = ["x", "y"][:dims] if dims <= 2 else [f"v{i}" for i in range(dims)]
    fields = F.split(F.col(line), ",")
    typed = [F.get(fields, F.lit(0)).try_cast("long"), *[F.get(fields, F.lit(i + 1)).try_cast("double") for i in range(dims)]]
    rows = lines.where(F.trim(line) != "")
    good = reduce(lambda a, b: a & b, [c.isNotNull() for c in typed])
    if on_error == "skip":
        rows = rows.where(good)
    else:
        typed[0] = F.when(good, typed[0]).otherwise(F.raise_error(F.concat(F.lit("malformed point: "), F.col(line))).cast("long"))
    rows = rows.select(*[c.alias(n) for c, n in zip(typed, ["id", *names], strict=True)])
    return rows if dims <= 2 else rows.select("id", F.array(*names).alias("v"))


def read_points_csv(spark: SparkSession, path: str, dims: int = 2, on_error: str = "fail") -> DataFrame:
    """The points of text files of ``id,v0,...`` lines without header."""
    return points_of_lines(spark.read.text(path), dims, on_error=on_error)


def points_from(df: DataFrame, id_col: str, x: str, y: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"))


def vectors_from(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def write_topn(top: DataFrame, path: str) -> None:
    """``id,lof`` lines, smallest score first, in one file: a top-N is small."""
    top.select("id", "lof").coalesce(1).sortWithinPartitions("lof", F.desc("id")).write.csv(path)


def as_line(*columns: str):
    return F.concat_ws(",", *columns)


def topn_lines(top: DataFrame) -> DataFrame:
    """(place, line): the ``id,lof`` lines of a result file, smallest score first."""
    order = Window.orderBy("lof", F.desc("id"))  # a top-N is small
    return top.select(F.row_number().over(order).alias("place"), as_line("id", "lof").alias("line"))
