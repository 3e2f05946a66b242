"""Document fingerprints by closed syncmers, in DataFrame functions only.

The alphabet is words, hashed to 64 bits. A k-mer of 5 words is kept if the smallest of its inner
2-word substrings lies at its first or last place. Whether it is kept depends on its own words alone, so
equal passages give equal anchors wherever they stand, and at least one k-mer of every few is kept. A
fingerprint is the set of the distinct hashes of all kept k-mers, 31 bits each and sorted, so it grows with
the text; the likeness of two is the Jaccard similarity of these sets. ``with_sketch`` can keep the smallest hashes only,
``likeness`` then estimates.

All steps are array functions of one row; element-wise functions get whole arrays as arguments, so no
array is evaluated again for each element.

The edited text of the contract needs each document's neighbour in descending doc_id order. Documents go
to ranges of doc_id (bounds from approximate quantiles, at most ``MOST_RANGES`` numbers on the
driver, and even parts between them), one shuffle of the texts; the first document of a range is also sent to the range before it, so a
window inside each range finds every neighbour.

Defined cases: a null text is empty; an empty text has the empty fingerprint, like 1 to another empty one
and 0 to any other; a text of fewer than 5 words is one k-mer; if no k-mer of a text is closed all count;
repeated doc_ids are ordered by text; null doc_ids come last; the only document is its own neighbour; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S = 5, 2
#: Hashes of a fingerprint, at most; None for all.
SKETCH: int | None = None
RANGE_DOCS = 512
#: Quantiles of doc_id that the driver holds; beyond, the stretches between them are cut evenly.
MOST_RANGES = 4096
#: Heads of ranges that are broadcast, at most.
MOST_SENT = 200_000

BLANKS = " \t\n\x0b\x0c\r"


def with_sketch(df: DataFrame, text: str, out: str, size: int | None = SKETCH, places: str | None = None) -> DataFrame:
    """``df`` with ``out``: the sorted sketch of the column ``text``, and, if asked for, with ``places``: all kept k-mers as
    position * 2^31 + hash, the position counted in words from 0."""
    c = F.col
    df = df.withColumn("_t", F.btrim(c(text), F.lit(BLANKS)))
    df = df.withColumn("_h", F.when(c("_t") == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split("_t", r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))))
    df = df.withColumn("_n", F.size("_h") - (K - 1)).withColumn("_long", c("_n") > 0)

    def part(name: str, start: int, more: int = 0) -> Column:
        """A slice as long as the number of k-mers plus ``more``; empty for short texts."""
        return F.slice(name, start, F.greatest(F.when(c("_long"), c("_n") + more).otherwise(0), F.lit(0)))

    df = df.withColumn("_g", F.zip_with(part("_h", 1, 3), part("_h", 2, 3), lambda a, b: F.xxhash64(a, b)))  # all 2-word substrings
    df = df.withColumn("_p", F.zip_with(part("_g", 1, 2), part("_g", 2, 2), lambda a, b: F.least(a, b)))
    df = df.withColumn("_q", F.zip_with(part("_p", 1), part("_p", 3), lambda a, b: F.least(a, b)))  # the smallest of each four
    first = F.zip_with("_q", part("_g", 1), lambda a, b: a == b)
    last = F.zip_with("_q", part("_g", 4), lambda a, b: a == b)
    hashed = F.zip_with(F.zip_with(part("_g", 1), part("_g", 3), lambda a, b: F.xxhash64(a, b)), part("_h", 5), lambda a, b: F.xxhash64(a, b).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    df = df.withColumn("_k", hashed).withColumn("_closed", F.zip_with(first, last, lambda a, b: a | b))
    df = df.withColumn("_kept", F.filter(F.zip_with("_closed", "_k", lambda keep, k: F.when(keep, k)), lambda x: x.isNotNull()))
    short = F.array(F.xxhash64("_h").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    kept = F.when(F.size("_h") == 0, F.array().cast("array<int>")).when(~c("_long"), short).when(F.size("_kept") == 0, c("_k")).otherwise(c("_kept"))
    hashes = F.sort_array(F.array_distinct(kept))
    df = df.withColumn(out, hashes if size is None else F.slice(hashes, 1, size))
    if places:
        placed = F.transform(F.zip_with("_closed", "_k", lambda keep, k: F.when(keep, k)), lambda k, i: i.cast("long") * (1 << 31) + k)
        df = df.withColumn(places, F.filter(placed, lambda x: x.isNotNull()))
    return df.drop("_t", "_h", "_n", "_long", "_g", "_p", "_q", "_k", "_closed", "_kept")


def anchors(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``anchors``: the kept k-mers as (position in words from 0, hash), for positional matching."""
    c = F.col
    df = df.withColumn("_w", F.filter(F.split(F.coalesce(c(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    places = F.when(F.size("_h") >= K, F.sequence(F.lit(1), F.size("_h") - (K - 1))).otherwise(F.array().cast("array<int>"))
    mers = F.transform(F.arrays_zip(places.alias("p"), F.transform(places, lambda i: F.slice("_h", i, K)).alias("m")), lambda x: x)
    pair = lambda m, i: F.xxhash64(F.get(m, F.lit(i)), F.get(m, F.lit(i + 1)))
    closed = lambda m: F.least(*[pair(m, i) for i in range(K - S + 1)]).isin(pair(m, 0), pair(m, K - S))
    kept = F.transform(F.filter(mers, lambda x: closed(x["m"])), lambda x: F.struct((x["p"] - 1).alias("position"), F.xxhash64(F.xxhash64(pair(x["m"], 0), pair(x["m"], 2)), F.get(x["m"], F.lit(4))).alias("hash")))
    return df.withColumn("anchors", kept).drop("_w", "_h")


def as_text(sketch: str | Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: str, b: str, size: int | None = SKETCH) -> Column:
    """The Jaccard similarity of two sorted sketches, from 0 to 1; of limited ones, its estimate."""
    if size is None:
        shared = F.size(F.array_intersect(a, b))
        share = shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1))
    else:
        union = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
        share = F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.greatest(F.size(union), F.lit(1))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(share).cast("double")


def _range_of(low: int, bounds: list[int], high: int, parts: int) -> Column:
    """The number of the range that holds doc_id, -1 for null: the stretch between two bounds, found by binary search in a
    constant array, and the even part of that stretch."""
    if not bounds:
        found, low_of, high_of = F.lit(0), F.lit(low), F.lit(high + 1)
    else:
        held, lows, highs = (F.expr(f"array({', '.join(f'{v}L' for v in x)})") for x in (bounds, [low, *bounds], [*bounds, high + 1]))
        steps = F.expr(f"array({', '.join(str(1 << i) for i in range(len(bounds).bit_length() - 1, -1, -1))})")
        found = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(held, at + s - 1) <= F.col("doc_id")), at + s).otherwise(at))
        low_of, high_of = F.get(lows, found), F.get(highs, found)
    if parts == 1:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(found).cast("long")
    share = (F.col("doc_id").cast("double") - low_of) / F.greatest(F.lit(1.0), high_of.cast("double") - low_of)
    part = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(share * parts)))
    return F.when(F.col("doc_id").isNull(), -1).otherwise(found.cast("long") * parts + part).cast("long")


def with_next(docs: DataFrame, range_docs: int = RANGE_DOCS, most_bounds: int = MOST_RANGES) -> DataFrame:
    """doc_id, text, and next_text of the next document in descending doc_id order, the first after the last."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ends = rows.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    ranges = max(1, ends["n"] // range_docs)
    cuts = min(most_bounds, ranges)
    bounds = []
    if cuts > 1:
        found = rows.agg(F.percentile_approx("doc_id", [i / cuts for i in range(1, cuts)], 8 * cuts)).first()[0]
        bounds = sorted(set(found or []))
    number = _range_of(ends["low"] or 0, bounds, ends["high"] or 0, -(-ranges // cuts))
    # the first document of the next range below, of the first range after the last one; a row for each range
    order = Window.orderBy(F.desc("range"))
    tops = rows.select("doc_id", number.alias("range")).groupBy("range").agg(F.max("doc_id").alias("top"))
    after = tops.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy())).select("range", F.when(F.row_number().over(order) < F.col("_n"), F.lead("top").over(order)).otherwise(F.first("top").over(order)).alias("_head"))
    guests = after.select(F.col("range"), "_head")
    inside = rows.withColumn("range", number).withColumn("guest", F.lit(0))
    sent = rows.join(F.broadcast(guests) if ranges <= MOST_SENT else guests, F.col("doc_id").eqNullSafe(F.col("_head")))
    both = inside.unionByName(sent.withColumn("guest", F.lit(1)).drop("_head"))
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    both = both.withColumn("next_text", F.lead("text").over(order))
    return both.where("guest = 0").drop("guest", "range")


def compare_edited(docs: DataFrame, range_docs: int = RANGE_DOCS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and by position, from all anchors of
    both texts: anchors (how many the text has), anchors_kept (how many the edited text has at the same place), same_words (where the last of these ends)."""
    both = with_next(docs, range_docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    both = both.select("doc_id", "text", "next_text", "n_chars", "edited", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    both = with_sketch(both, "next_text", "next_sketch").drop("next_text")
    both = with_sketch(both, "edited", "edited_sketch", places="_edited_places").drop("edited")
    both = with_sketch(both, "text", "sketch", places="_places").withColumn("_shared", F.array_intersect("_places", "_edited_places"))
    until = F.coalesce(F.shiftright(F.array_max("_shared"), 31) + K, F.lit(0))
    return both.select("doc_id", "n_chars", "edited_sha256", as_text("sketch").alias("fingerprint"), as_text("edited_sketch").alias("edited_fingerprint"), likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"), F.size("_places").cast("long").alias("anchors"), F.size("_shared").cast("long").alias("anchors_kept"), until.cast("long").alias("same_words"))
