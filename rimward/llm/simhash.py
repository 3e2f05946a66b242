"""SimHash near-duplicates by multi-index hashing.

A fingerprint's bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the text's 4-word
shingles. Two fingerprints at most 4 bits apart link. The 64 bits are cut into segments; by the
pigeonhole principle such a pair is at most one bit apart in one of the first segments or equal in the last
one, so each fingerprint looks up the small Hamming ball of each of its segments in the table of all
fingerprints by segment, and every match is verified by its complete distance.

Only distinct fingerprints take part: copies of a text meet in one row. A segment value with very many
fingerprints is cut into blocks, and the links found between a fingerprint and a block stay one row;
each task then keeps a spanning forest of the links it saw, so links are never written out pair by
pair and none that joins two groups is lost. Components follow by large-star and small-star steps over
these forests, written to the shared folder after each round.

``similar`` finds texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more. Texts whose fingerprints link as above
are compared on their complete sets, and those that hold are joined. No Hamming distance finds all such texts with certainty, so prefix
filtering then adds the links that fingerprints miss: with the shingles in one order for all texts, two such sets share a member among
the first n - ceil(0.8 n) + 1 of each. Shingles known to be common come last in
that order. Lengths, places in the prefixes and then the number of shared prefix members rule out most pairs that meet; the others
are verified on the complete sets of both texts. The texts of a common key are dealt to blocks. Its first round takes all candidates of
keys of few texts and three partners of each text at the others, the second those that lie in different components still.
Of the links that hold, each task keeps a spanning forest.

Defined cases: a null or empty text has fingerprint zero, which links like any other; a text of fewer
words than a shingle is one shingle; repeated rows share a component; a null doc_id takes part and the
component's id is its smallest other id, null if there is none; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimward.llm.common import lower_words, numbered, release, stage, text_bytes

SHINGLE = 4
DISTANCE = 4
#: Fingerprints of one segment value that are held in one row.
BLOCK = 512
#: Shingles that are known as common; the others count as rare.
COMMON = 200_000
#: Of keys with more texts, the first round of ``similar`` takes three partners for each text.
FEW = 16
#: One distinct text of so many is read to learn which shingles are common.
SAMPLE = 16


def shingles(words: list[bytes], width: int) -> Iterator[bytes]:
    """Runs of ``width`` words, repeats included; of fewer words the whole sequence."""
    line = b" ".join(words)
    if len(words) <= width:
        return iter([line] if words else [])
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    return (line[a:b] for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True))


def majority(hashes: np.ndarray) -> bytes:
    """The bits set in over half of the rows of bytes."""
    counts = np.zeros(8 * hashes.shape[1], dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # blocks bound the memory of very long texts
        counts += np.unpackbits(hashes[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of UTF-8 text."""
    import xxhash

    words = lower_words(text)
    if not words:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in shingles(words, width)), np.uint64).astype(">u8")
    return int.from_bytes(majority(hashes.view(np.uint8).reshape(-1, 8)), "big")


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """The distinct 64-bit hashes of the text's shingles, sorted."""
    import xxhash

    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(x) for x in shingles(lower_words(text), width)), np.uint64)).view(np.int64)


def text_node(hashes: np.ndarray) -> int:
    """The signed long that stands for all texts of these shingles."""
    import xxhash

    return _signed(xxhash.xxh3_64_intdigest(hashes.tobytes(), 1))


def _prints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), width) for x in batch["_text"]], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found)], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp), fp being the 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("_text")).mapInArrow(_prints(width), "doc_id long, fp long")


def segments(n_fingerprints: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments: about as wide as the logarithm of the number of fingerprints."""
    return [(42, 22), (21, 21), (0, 21)] if n_fingerprints < 1 << 28 else [(32, 32), (0, 32)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _ball(width: int, radius: int) -> list[int]:
    out = [0]
    if radius >= 1:
        out += [1 << i for i in range(width)]
    if radius >= 2:
        out += [1 << i | 1 << j for i in range(width) for j in range(i)]
    if radius > 2:
        raise ValueError("more segments are needed for this distance")
    return out


def links(fps: DataFrame, n_fingerprints: int, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(fp, near): for each fingerprint, arrays of smaller ones within the distance."""
    cut = segments(n_fingerprints)
    radius, more = divmod(distance, len(cut))  # the first more + 1 segments need this radius, the others one less
    masks = [(s, _signed(((1 << width) - 1) << shift)) for s, (shift, width) in enumerate(cut)]
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), F.lit(m).cast("long").alias("mask")) for s, m in masks]))
    tab = fps.select("fp", rows.alias("_x")).select("_x.seg", F.col("fp").bitwiseAND(F.col("_x.mask")).alias("key"), "fp")
    sizes = tab.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).withColumn("_parts", F.ceil(F.col("_n") / block))
    tab = tab.join(sizes.drop("_n").hint("merge"), ["seg", "key"], "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("_parts"))))
    blocks = tab.groupBy("seg", "key", "_part").agg(F.collect_list("fp").alias("held")).drop("_part")
    probes = [(s, m, _signed(b << cut[s][0])) for s, m in masks if radius - (s > more) >= 0 for b in _ball(cut[s][1], radius - (s > more))]
    ball = F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("flip")) for s, m, b in probes]))
    look = fps.select("fp", ball.alias("_x")).select("_x.seg", F.col("fp").bitwiseAND(F.col("_x.mask")).bitwiseXOR(F.col("_x.flip")).alias("key"), "fp")
    near = F.filter("held", lambda x: (x < F.col("fp")) & (F.bit_count(x.bitwiseXOR(F.col("fp"))) <= distance))
    # estimates leave out that rows are exploded, so that either side would be broadcast long after it has outgrown the driver
    return look.join(blocks.hint("merge"), ["seg", "key"]).select("fp", near.alias("near")).where(F.size("near") > 0)


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.setdefault(top, top)) != top:
            top = y
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> pa.RecordBatch:
        pairs = [(x, r) for x in list(self.up) if (r := self.root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["node", "top"])


def _forests(most: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for fp, near in zip(batch["fp"].to_pylist(), batch["near"].to_pylist(), strict=True):
                for other in near:
                    forest.join(fp, other)
            if len(forest.up) > most:
                yield forest.edges()
                forest = Forest()
        yield forest.edges()

    return run


def _joining(most: int = 200_000):
    """Batches of (fp, near) to the links (a, b) among them, each as it was found, that join two groups of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            out = []
            for fp, near in zip(batch["fp"].to_pylist(), batch["near"].to_pylist(), strict=True):
                for other in near:
                    if forest.root(fp) != forest.root(other):
                        forest.join(fp, other)
                        out.append((fp, other))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
            if len(forest.up) > most:
                forest = Forest()

    return run


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, top): the smallest node of each node's component, for nodes with an edge that aren't it.

    Rounds of large-star and small-star steps; each is an aggregate with map-side partial minima and a
    join that AQE may split, so a hub of many edges does not meet in one task. Nothing that grows with the nodes is broadcast.
    """

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "top").cast("decimal(38,0)"))).first()
        return tuple(row)

    now = stage(edges.distinct(), "cc")
    seen = state(now)
    for _ in range(most_rounds):
        both = now.select("node", "top").unionAll(now.select(F.col("top").alias("node"), F.col("node").alias("top")))
        least = both.groupBy("node").agg(F.least(F.min("top"), F.first("node")).alias("m"))
        # large star: larger neighbours go to the smallest neighbour
        large = both.where("top > node").join(least.hint("merge"), "node").select(F.col("top").alias("node"), F.col("m").alias("top")).where("node <> top").distinct()
        # small star: the node and its smaller neighbours go to the smallest of them
        low = large.groupBy("node").agg(F.min("top").alias("m"))
        small = large.join(low.hint("merge"), "node").select(F.col("top").alias("node"), F.col("m").alias("top")).unionAll(low.select("node", F.col("m").alias("top")))
        now = stage(small.where("node <> top").distinct(), "cc")
        if (after := state(now)) == seen:
            return now
        seen = after
    raise RuntimeError("components have not settled")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) for each document."""
    prints = stage(fingerprints(docs, width), "simhash")
    fps = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    edges = links(fps.select("fp"), fps.count(), distance, block).mapInArrow(_forests(), "node long, top long")
    tops = components(edges)
    marked = fps.join(tops.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("top", F.coalesce("top", "fp"))
    ids = marked.groupBy("top").agg(F.min("least").alias("component_id"))
    named = marked.join(ids.hint("merge"), "top").select("fp", "component_id")
    return prints.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, which bounds what is held of long texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def least_overlap(n, m, least: float):
    """How many shingles sets of n and m members share at least if their similarity is ``least`` or more."""
    return np.ceil(least / (1 + least) * (n + m) - 1e-6).astype(np.int64)


def common_shingles(docs: DataFrame, width: int, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts), sorted by hash: shingles that several of a sixteenth of the distinct texts hold, the commonest ``most`` of them.

    They only set the order in which prefixes are taken and how keys are cut into blocks; any such choice finds the same links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch["_text"]:
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(x.as_py(), width))], ["h"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select(text_bytes().alias("_text"), F.xxhash64("text").alias("_hash"))
    found = some.dropDuplicates(["_hash"]).select("_text").mapInArrow(run, "h long")
    rows = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(most).toArrow()
    h, n = (rows[c].to_numpy().astype(np.int64) for c in ("h", "n"))
    order = np.argsort(h)
    return h[order], n[order]


def _prefixes(width: int, least: float, common, block: int):
    """Batches of (doc_id, _hash, _text) to those of (doc_id, hash, fp, node, n, keys, parts): the fingerprint, the prefix that sets of
    similarity ``least`` or more share in part, and into how many blocks the texts of each key are dealt."""

    def keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, n = common.value
        times = np.zeros(len(x), np.int64)
        if len(h):
            at = np.minimum(np.searchsorted(h, x), len(h) - 1)
            times = np.where(h[at] == x, n[at], 0)
        use = np.lexsort((x, times))[: len(x) - int(np.ceil(least * len(x) - 1e-6)) + 1]
        return x[use], (-(-SAMPLE * times[use] // block)).clip(1).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            sets = [shingle_hashes(x.as_py(), width) for x in batch["_text"]]
            prefixes = [keys(x) for x in sets]
            prints = np.array([fingerprint(x.as_py()) for x in batch["_text"]], dtype=np.uint64).view(np.int64)
            columns = [pa.array(prints), pa.array([text_node(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array([k for k, _ in prefixes], pa.list_(pa.int64())), pa.array([p for _, p in prefixes], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["_hash"], *columns], ["doc_id", "hash", "fp", "node", "n", "keys", "parts"])

    return run


def print_candidates(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(node, top): of texts (fp, node) the pairs whose fingerprints are equal or link, thinned to what joins groups of fingerprints.

    The smallest node of a fingerprint stands for it, and the others of the same fingerprint are paired with that one.
    """
    heads = stage(prints.groupBy("fp").agg(F.min("node").alias("head")), "similar-prints")
    linked = links(heads.select("fp"), heads.count(), distance, block).mapInArrow(_joining(), "a long, b long")
    ends = [heads.select(F.col("fp").alias(c), F.col("head").alias(n)).hint("merge") for c, n in (("a", "x"), ("b", "y"))]
    across = linked.join(ends[0], "a").join(ends[1], "b").select("x", "y")
    same = prints.distinct().join(heads.hint("merge"), "fp").select(F.col("node").alias("x"), F.col("head").alias("y"))
    return across.unionAll(same).where("x <> y").select(F.greatest("x", "y").alias("node"), F.least("x", "y").alias("top")).distinct()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows (key, part, parts, pos, n, node) to one row for each key and part of several texts or of a key in parts."""

    def packed(pieces: list[list[np.ndarray]]) -> pa.RecordBatch:
        key, part, parts, pos, n, node = (np.concatenate(c) for c in zip(*pieces, strict=True))
        ends = np.append(np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1, len(key))
        starts = np.append(0, ends[:-1])
        use = (ends - starts > 1) | (parts[starts] > 1)
        rows, heads = np.repeat(use, ends - starts), starts[use]
        members = pa.StructArray.from_arrays([pa.array(c[rows]) for c in (pos, n, node)], ["pos", "n", "node"])
        held = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum((ends - starts)[use])), pa.int32()), members)
        return pa.RecordBatch.from_arrays([pa.array(key[heads]), pa.array(parts[heads]), pa.array(part[heads]), held], ["key", "parts", "part", "held"])

    rest: list[list[np.ndarray]] = []  # pieces that end with a group whose other rows may follow
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy() for c in batch.columns]
        key, part = now[:2]
        if rest and (rest[-1][0][-1], rest[-1][1][-1]) != (key[0], part[0]):
            yield packed(rest)
            rest = []
        other = np.flatnonzero((key != key[-1]) | (part != part[-1]))
        if len(other):
            yield packed([*rest, [c[: other[-1] + 1] for c in now]])
            rest, now = [], [c[other[-1] + 1 :].copy() for c in now]
        rest.append(now)
    if rest:
        yield packed(rest)


def shared_keys(nodes: DataFrame) -> DataFrame:
    """(key, parts, part, held): the prefix members that several texts have, with (pos, n, node) of each, sorted.

    The texts of a common key are dealt to blocks, by text and key, so that two texts meet in a block of some key or other.
    """
    tab = nodes.select("node", "n", F.posexplode(F.arrays_zip("keys", "parts")).alias("pos", "_x")).select(F.col("_x.keys").alias("key"), F.col("_x.parts").alias("parts"), "pos", "n", "node")
    tab = tab.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node", "key"), F.col("parts"))).otherwise(0).cast("int"))
    # almost all keys are of one text, so rows move and are sorted as they are, once, and only those of the other keys become arrays:
    # collected lists of all keys would be sorted twice in each task, in memory that the executors then keep
    rows = tab.repartition("key", "part").sortWithinPartitions("key", "part", "pos", "n", "node").select("key", "part", "parts", "pos", "n", "node")
    return rows.mapInArrow(_blocks, "key long, parts int, part int, held array<struct<pos: int, n: int, node: long>>")


def _candidates(least: float, few: int = 0):
    """Batches of (held, other) to pairs (node, top) that lengths and places in the prefixes allow to be similar.

    Members of a row are those of ``held``, or one of ``held`` and one of ``other``; two of one component, if ``held`` has a
    field ``top``, need no link. With ``few``, each member of a longer ``held`` gets two partners only: the first one that may
    be similar, which has the fewest rare shingles, and the one before it.
    """

    def columns(rows: pa.ListArray) -> list[tuple[np.ndarray, ...]]:
        flat, ends = rows.flatten(), np.cumsum(rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        names = ("pos", "n", "node", "top") if flat.type.get_field_index("top") >= 0 else ("pos", "n", "node")
        columns = [flat.field(flat.type.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
        return [tuple(c[a:b] for c in columns) for a, b in zip(np.r_[0, ends[:-1]].astype(int), ends, strict=True)]

    def partners(one: tuple, others: tuple) -> np.ndarray:
        pos, n = others[:2]
        ok = (least * n <= one[1] + 1e-6) & (least * one[1] <= n + 1e-6)
        ok &= np.minimum(one[1] - one[0], n - pos) >= least_overlap(one[1], n, least)
        ok &= others[2] != one[2]
        return others[2][ok & (others[3] != one[3])] if len(one) > 3 else others[2][ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()

        def out():
            pairs = np.array(list(seen), np.int64).reshape(-1, 2)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["node", "top"])

        for batch in _pieces(batches):
            for held, other in zip(columns(batch["held"]), columns(batch["other"]), strict=True):
                size = len(held[0])
                for i in range(size):
                    one = tuple(int(c[i]) for c in held)
                    found = partners(one, other if len(other[0]) else tuple(c[:i] for c in held))
                    if few and size > few and len(found) > 2:
                        found = found[[0, -1]]
                    seen.update((max(one[2], x), min(one[2], x)) for x in found.tolist())
                    if len(seen) > 100_000:
                        yield out()
        yield out()

    return run


PAIRS = "node long, top long"


def first_candidates(shared: DataFrame, least: float) -> DataFrame:
    """(node, top): all candidates of keys of few texts; of other keys two partners for each text in its block, and the
    one text of the whole key that has the fewest rare shingles, which is the centre of a group of edited copies."""
    none = F.lit(None).cast(shared.schema["held"].dataType)
    inside = shared.select("held", none.alias("other")).mapInArrow(_candidates(least, FEW), PAIRS)
    cut = shared.where("parts > 1").select("key", "part", "parts", "held")
    heads = cut.groupBy("key", "parts").agg(F.min(F.get("held", F.lit(0))).alias("_head"))
    heads = heads.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "_head")  # a key's blocks stay apart
    across = cut.join(heads, ["key", "part"]).select("held", F.array("_head").cast(shared.schema["held"].dataType).alias("other")).mapInArrow(_candidates(least), PAIRS)
    return inside.unionAll(across).distinct()


def other_candidates(shared: DataFrame, tops: DataFrame, least: float, block: int) -> DataFrame:
    """(node, top): all candidates of keys of many texts that lie in different components so far.

    At each such key, the texts outside its largest component are dealt to blocks and each block meets all blocks of the key:
    what is compared grows with the texts that are still apart, not with the square of a group.
    """
    rows = shared.where((F.size("held") > FEW) | (F.col("parts") > 1)).select("key", "part", "parts", F.explode("held").alias("_x")).select("key", "part", "parts", "_x.pos", "_x.n", "_x.node")
    rows = rows.join(tops, "node", "left").withColumn("top", F.coalesce("top", "node"))
    sizes = rows.groupBy("key", "parts", "top").agg(F.count(F.lit(1)).alias("_n"))
    main = sizes.groupBy("key", "parts").agg(F.max(F.struct("_n", "top")).alias("_m"), F.sum("_n").alias("_all")).where("_all > _m._n")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")  # a key's blocks stay apart in all that follows
    main = main.select("key", every, F.col("_m.top").alias("_main"), F.ceil((F.col("_all") - F.col("_m._n")) / block).alias("_asks"))
    mixed = rows.join(main, ["key", "part"])
    members = F.collect_list(F.struct("pos", "n", "node", "top"))
    whole = mixed.groupBy("key", "part").agg(members.alias("other"))
    asked = mixed.where("top <> _main").groupBy("key", "parts", F.pmod(F.xxhash64("node"), F.col("_asks")).alias("_ask")).agg(members.alias("held"))
    met = asked.select("key", every, "held").join(whole, ["key", "part"]).select("held", "other")
    parts = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a count that is kept: work does not follow bytes
    return met.repartition(parts, F.xxhash64("held", "other")).mapInArrow(_candidates(least), PAIRS).distinct()


def _plausible(least: float):
    """Batches of (node, top, n, m, a, b), a and b being prefixes of sets of n and m members, to the pairs (node, top) that may be similar.

    The set whose prefix ends first in the order shares no more than the prefixes share and its own rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            a, b = ([x.values.to_numpy() for x in batch[c]] for c in ("a", "b"))
            n, m = (batch[c].to_numpy().astype(np.int64) for c in ("n", "m"))
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
            rest = np.maximum(n - [len(x) for x in a], m - [len(x) for x in b])
            ok = pa.array(both + rest >= least_overlap(n, m, least))
            yield pa.RecordBatch.from_arrays([batch["node"].filter(ok), batch["top"].filter(ok)], ["node", "top"])

    return run


def plausible(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs whose prefixes share enough; few others are left, so few whole sets have to move."""
    own = nodes.select("node", "n", F.col("keys").alias("a"))
    other = nodes.select(F.col("node").alias("top"), F.col("n").alias("m"), F.col("keys").alias("b"))
    return pairs.join(own, "node").join(other, "top").select("node", "top", "n", "m", "a", "b").mapInArrow(_plausible(least), PAIRS)


def _sets(width: int):
    """Batches of texts to those of (node, held): the sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            sets = [shingle_hashes(x.as_py(), width) for x in batch["_text"]]
            yield pa.RecordBatch.from_arrays([pa.array([text_node(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "held"])

    return run


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets of hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _held(least: float, most: int = 200_000):
    """Batches of (node, top, a, b) to a spanning forest (node, top) of the pairs whose sets a and b are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in _pieces(batches):
            sides = ((np.frombuffer(x.as_buffer(), np.int64) for x in batch[c]) for c in ("a", "b"))
            for x, y, a, b in zip(batch["node"].to_pylist(), batch["top"].to_pylist(), *sides, strict=True):
                if similarity(a, b) >= least - 1e-12:
                    forest.join(x, y)
            if len(forest.up) > most:
                yield forest.edges()
                forest = Forest()
        yield forest.edges()

    return run


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(node, top): a spanning forest, in each task, of the pairs whose texts are similar enough.

    Links are thinned only after they are verified: a forest of candidates may lose those that hold.
    """
    both = pairs.join(sets.withColumnRenamed("held", "a"), "node").join(sets.select(F.col("node").alias("top"), F.col("held").alias("b")), "top")
    return both.select("node", "top", "a", "b").mapInArrow(_held(least), PAIRS)


def _links_of(rows: DataFrame, prints: DataFrame, nodes: DataFrame, candidates: DataFrame, width: int, least: float) -> DataFrame:
    """The staged links (node, top) among the candidates, thinned to forests after their whole sets are compared."""
    spark = rows.sparkSession
    pairs = stage(plausible(candidates, nodes, least), "similar-pairs")
    ends = pairs.select("node").unionAll(pairs.select(F.col("top").alias("node"))).distinct()
    # one text of each node among the ends; equal sets of shingles are equal nodes
    hashes = prints.join(ends, "node", "left_semi").groupBy("node").agg(F.min("hash").alias("_hash"))
    texts = rows.select("_hash", "_text").join(hashes, "_hash", "left_semi").dropDuplicates(["_hash"])
    sets = stage(texts.select("_text").mapInArrow(_sets(width), "node long, held binary"), "similar-sets")
    edges = stage(verified(pairs, sets, least), "similar-links")
    release(spark, pairs, sets)
    return edges


def similar_nodes(docs: DataFrame, width: int = 5, least: float = 0.8, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(doc_id, hash, node) of each row, hash and node being those of its text and of its set of shingles, and (node, top) of
    the nodes that are linked by a similarity of ``least`` or more to a smaller one, top being the smallest they reach."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    common = spark.sparkContext.broadcast(common_shingles(docs, width))
    found = stage(rows.mapInArrow(_prefixes(width, least, common, block), "doc_id long, hash long, fp long, node long, n int, keys array<long>, parts array<int>"), "similar")
    prints = found.select("doc_id", "hash", "node")
    nodes = stage(found.select("node", "n", "keys", "parts").dropDuplicates(["node"]), "similar-nodes")
    linked = _links_of(rows, prints, nodes, print_candidates(found.select("fp", "node"), block=block), width, least)
    shared = stage(shared_keys(nodes), "similar-keys")
    edges = _links_of(rows, prints, nodes, first_candidates(shared, least), width, least)
    tops = components(linked.unionAll(edges))
    if not shared.where((F.size("held") > FEW) | (F.col("parts") > 1)).isEmpty():
        more = _links_of(rows, prints, nodes, other_candidates(shared, tops, least, block), width, least)
        tops = components(tops.unionAll(more))
        release(spark, more)
    release(spark, shared, linked, edges, nodes)
    return prints, tops


def similar(docs: DataFrame, width: int = 5, least: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(doc_id, node, component_id): texts linked by a similarity of ``least`` or more share a component."""
    prints, tops = similar_nodes(docs, width, least, block)
    least_of = prints.groupBy("node").agg(F.min("doc_id").alias("least"))
    marked = least_of.join(tops.select("node", F.col("top").alias("_top")), "node", "left").withColumn("_top", F.coalesce("_top", "node"))
    ids = marked.groupBy("_top").agg(F.min("least").alias("component_id"))
    return prints.select("doc_id", "node").join(marked.join(ids, "_top").select("node", "component_id"), "node").select("doc_id", "node", "component_id")


def keep_one(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest doc_id, null last, then the smallest hash
    of its text; of rows that are equal in both, the one with the smallest hash of all columns. So each component keeps one row, whatever its ids."""
    prints, tops = similar_nodes(docs, width, least)
    first = prints.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "hash")).alias("_first"))
    first = first.join(tops, "node", "left").groupBy(F.coalesce("top", "node").alias("top")).agg(F.min("_first").alias("_first"))
    chosen = stage(first.select("_first.*"), "similar-chosen")
    keys = chosen.columns
    repeats = prints.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "hash").groupBy(*keys).count().where("count > 1").drop("count")
    repeats = stage(chosen.join(repeats, keys, "left_semi"), "similar-repeats")
    plain, of = numbered(docs)
    keyed = plain.select("*", F.col(of["doc_id"]).isNull().alias("none"), F.coalesce(F.col(of["doc_id"]).cast("long"), F.lit(0)).alias("id"), F.xxhash64(text_bytes(of["text"])).alias("hash"))
    kept = keyed.join(chosen.join(repeats, keys, "left_anti"), keys, "left_semi").select(*plain.columns)
    if not repeats.isEmpty():
        again = keyed.join(repeats, keys, "left_semi").groupBy(*keys).agg(F.min_by(F.struct(*plain.columns), F.xxhash64(*plain.columns)).alias("row"))
        kept = kept.unionByName(again.select("row.*"))
    return kept.toDF(*docs.columns)
