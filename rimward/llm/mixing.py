"""Mixing sources to target weights.

Each document gets a hash-random key. Within a source, documents are ordered by that key: equal
slices of the key space are the range partitions (the keys are uniform, so the slices are even, a
hot source's too), sorted within, and running sums of words inside a slice plus the sums of the
slices before it are the distributed prefix sums. A source's budget is whole epochs over all its
documents, then the prefix of that order that ends exactly at the budget, the last document of it in
part.

Defined cases: a null text has size 0; a document without words takes 0; a null source is a source
of its own, last in order; repeated rows are separate documents of the same size; a null doc_id is
kept; an empty table gives an empty mix. Columns beyond the named ones are ignored by ``mix`` and
carried along by ``materialise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rimward.llm.common import WORD, numbered, stage

#: Slices of the key space in each source, as a power of two.
SLICE_BITS = 10


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most_epochs: float = 3.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources by code point, null last, take the weights in turn. The total of all sizes is shared by
    weight; a target stops at ``most_epochs`` times its source's size and the excess goes to the rest
    by weight. With sources sorted by size / weight those that stop come first, so running sums
    give the common level of the rest; there is one row a source.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.lit(float(most_epochs)) * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, rest, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    ranked = ranked.withColumn("_level", level)
    # the first row whose own level does not lift it over its cap sets the level of all later ones
    free = F.col("_w") * F.col("_level") <= F.col("_cap")
    ranked = ranked.withColumn("_common", F.min(F.when(free, F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_level").alias("l")))).over(whole)["l"])
    target = F.least(F.col("_cap"), F.col("_w") * F.coalesce(F.col("_common"), F.lit(float("inf"))))
    return ranked.select("source", "source_size", target.alias("target"))


def random_key(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> Column:
    return F.xxhash64(F.lit(seed), docs[id_col], docs[source_col], docs[text_col])


def mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), most_epochs: float = 3.0, seed: int = 9, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, mix_key, size, source_size, target, taken (words, repeats counted)."""
    slim = docs.select(
        docs[id_col].alias("doc_id"),
        docs[source_col].alias("source"),
        word_count(docs[text_col]).alias("size"),
        random_key(docs, seed, id_col, text_col, source_col).alias("mix_key"),
    )
    slim = stage(slim, "mix-keys").withColumn("slice", F.shiftright("mix_key", 64 - SLICE_BITS))
    slices = slim.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    goal = targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most_epochs)
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("base", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words")
    goal = goal.withColumnRenamed("source", "_gs")
    starts = starts.join(goal, F.col("source").eqNullSafe(F.col("_gs"))).select(F.col("source").alias("_s"), F.col("slice").alias("_l"), "base", "source_size", "target")
    inside = Window.partitionBy("source", "slice").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("slice") == F.col("_l")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("base") - F.col("_in")))
    taken = epochs * F.col("size") + part
    return placed.select("doc_id", "source", "mix_key", "size", "source_size", "target", taken.cast("long").alias("taken"))


def materialise(docs: DataFrame, weights=(5.0, 2.0, 1.0), most_epochs: float = 3.0, seed: int = 9, n_chars_col: str | None = "n_chars") -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each whole taking of a document, and
    for a partial taking a row whose text ends after the last word taken. n_chars follows the text."""
    plain, of = numbered(docs)
    columns = dict(id_col=of["doc_id"], text_col=of["text"], source_col=of["source"])
    plan = mix(plain, weights, most_epochs, seed, **columns).select(F.col("doc_id").alias("id"), F.col("mix_key").alias("key"), "size", "taken")
    plan = plan.withColumn("no", F.row_number().over(Window.partitionBy("id", "key").orderBy("taken"))).where("taken > 0")
    keyed = plain.select("*", random_key(plain, seed, **columns).alias("own_key"))
    keyed = keyed.withColumn("own_no", F.row_number().over(Window.partitionBy(of["doc_id"], "own_key").orderBy(F.lit(0))))
    both = keyed.join(plan, F.col(of["doc_id"]).eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")) & (F.col("own_no") == F.col("no")))
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    part = (F.col("taken") - whole * F.col("size")).cast("int")
    takes = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    copies = both.withColumn("cut", F.explode(takes))
    head = F.array_join(F.slice(F.regexp_extract_all(of["text"], F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1)), 1, F.greatest(F.col("cut"), F.lit(1))), "")
    out = copies.withColumn(of["text"], F.when(F.col("cut") > 0, head).otherwise(F.col(of["text"])))
    if n_chars_col and n_chars_col in of:
        length = of[n_chars_col]
        out = out.withColumn(length, F.when(F.col("cut") > 0, F.char_length(of["text"]).cast(docs.schema[n_chars_col].dataType)).otherwise(F.col(length)))
    return out.select(*plain.columns).toDF(*docs.columns)
