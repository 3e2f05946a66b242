"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Vectors are dealt to shards of about ``SHARD_ROWS`` by a hash of vec_id. A shard's graph is built in bulk:
each vector has a level drawn from a hash (geometric, as in the incremental algorithm), each layer's
candidate lists come from blocked products inside the shard, the usual heuristic keeps a candidate only
if no kept one is nearer to it, and reverse links are added. A layer is one flat array of neighbours, -1
filled. Queries go down the layers greedily and search the lowest one with a beam of ``EF``; all
queries of a block move at once. The shards' results are merged to the best of all.

Inner product is turned into Euclidean distance by one more component, sqrt(M^2 - |x|^2), M being the
shard's largest norm; so the graph is that of a metric. Reported scores are inner products of the original
vectors in double precision. Equal vectors of a shard are one node that holds their smallest ids.

Indexes are staged in the shared folder, so a lost executor costs only the search that it ran. Queries
are a stated set, every ``QUERY_STEP``-th id, in blocks. A shard's index is read once, by one task, to which the blocks of
queries stream in order; the task holds one index and one block.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components and rows without id
take no part; a repeated vec_id counts once, with its smallest vector; vectors of another length are in
shards of their own; fewer candidates than asked for give all; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rimward.llm.common import stage

SHARD_ROWS = 8192
M = 16
EF = 128
QUERY_STEP = 20
QUERY_BLOCK = 2048


@dataclass
class Graph:
    """points: augmented vectors; layers: (nodes, flat neighbours of nodes), the lowest first."""

    points: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]


def _candidates(points: np.ndarray, count: int, block: int = 1024) -> np.ndarray:
    """The ``count`` nearest others of each point, nearest first, by blocked products."""
    n = len(points)
    norms, out = (points**2).sum(axis=1), np.empty((n, count), dtype=np.int64)
    for a in range(0, n, block):
        d = norms[None, :] - 2 * points[a : a + block] @ points.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near = np.argpartition(d, count - 1, axis=1)[:, :count]
        out[a : a + block] = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
    return out


def _links(points: np.ndarray, degree: int) -> np.ndarray:
    """Flat neighbour lists of one layer: the heuristic's choice, filled up with the nearest rest, plus reverse links."""
    n = len(points)
    if n == 1:
        return np.full((1, degree), -1, dtype=np.int32)
    count = min(n - 1, 3 * degree // 2)
    near = _candidates(points, count)
    chosen: list[np.ndarray] = []
    for a in range(0, n, 512):
        c = near[a : a + 512]
        v = points[c]
        sq = (v**2).sum(axis=2)
        between = sq[:, :, None] + sq[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
        own = ((v - points[a : a + 512, None, :]) ** 2).sum(axis=2)
        kept = np.zeros(c.shape, dtype=bool)
        for j in range(count):
            kept[:, j] = ~(kept & (between[:, j, :] < own[:, j : j + 1])).any(axis=1)
        # the heuristic's choice first, then the nearest of the rest
        rank = np.argsort(np.where(kept, 0, count) + np.arange(count), axis=1, kind="stable")[:, : max(1, degree // 2)]
        chosen.append(np.take_along_axis(c, rank, 1))
    out = np.concatenate(chosen)
    source = np.repeat(np.arange(n), out.shape[1])
    target = out.ravel()
    a, b = np.concatenate([source, target]), np.concatenate([target, source])
    forward = np.concatenate([np.zeros(len(source), np.int8), np.ones(len(source), np.int8)])
    pair, at = np.unique(a * n + b, return_index=True)
    a, b, forward = pair // n, pair % n, forward[at]
    far = ((points[a] - points[b]) ** 2).sum(axis=1)
    order = np.lexsort((far, forward, a))
    a, b = a[order], b[order]
    starts = np.searchsorted(a, np.arange(n))
    place = np.arange(len(a)) - starts[a]
    flat = np.full((n, degree), -1, dtype=np.int32)
    use = place < degree
    flat[a[use], place[use]] = b[use]
    return flat


def build(vectors: np.ndarray, m: int = M) -> Graph:
    """The graph of distinct vectors."""
    x = vectors.astype(np.float64)
    squares = (x**2).sum(axis=1)
    points = np.concatenate([x, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]], axis=1)
    draws = np.array([(zlib.crc32(row.tobytes()) + 1) / (2**32 + 1) for row in x])
    levels = np.minimum((-np.log(draws) / np.log(m)).astype(np.int64), 12)
    layers = []
    for level in range(int(levels.max()) + 1):
        nodes = np.flatnonzero(levels >= level)
        inner = _links(points[nodes], 2 * m if level == 0 else m)
        layers.append((nodes.astype(np.int32), np.where(inner >= 0, nodes[inner], -1).astype(np.int32)))
    return Graph(points, layers)


def search(graph: Graph, queries: np.ndarray, ef: int = EF, at_once: int = 4) -> np.ndarray:
    """For each query up to ``ef`` nodes of the lowest layer, -1 filled, in no order."""
    points, n, count = graph.points, len(graph.points), len(queries)
    q = np.concatenate([queries.astype(np.float64), np.zeros((count, 1))], axis=1)
    now = np.full(count, graph.layers[-1][0][0], dtype=np.int64)
    best = np.einsum("qd,qd->q", points[now], q)
    for nodes, links in reversed(graph.layers[1:]):
        place = np.full(n, -1)
        place[nodes] = np.arange(len(nodes))
        moving = np.arange(count)
        while len(moving):
            around = links[place[now[moving]]]
            score = np.where(around >= 0, np.einsum("qmd,qd->qm", points[around], q[moving]), -np.inf)
            j = score.argmax(axis=1)
            top = score[np.arange(len(moving)), j]
            better = top > best[moving]
            moving, j, around, top = moving[better], j[better], around[better], top[better]
            now[moving], best[moving] = around[np.arange(len(moving)), j], top
    links = graph.layers[0][1]
    ef = min(ef, n)
    ids = np.full((count, ef), -1, dtype=np.int64)
    scores = np.full((count, ef), -np.inf)
    done = np.ones((count, ef), dtype=bool)
    ids[:, 0], scores[:, 0], done[:, 0] = now, best, False
    seen = np.zeros((count, n), dtype=bool)
    seen[np.arange(count), now] = True
    active = np.arange(count)
    while len(active):
        open_score = np.where(done[active], -np.inf, scores[active])
        take = np.argpartition(-open_score, min(at_once, ef) - 1, axis=1)[:, :at_once] if ef > 1 else np.zeros((len(active), 1), dtype=np.int64)
        valid = np.take_along_axis(open_score, take, 1) > -np.inf
        go = valid.any(axis=1)
        active, take, valid = active[go], take[go], valid[go]
        if not len(active):
            break
        done[active[:, None], take] |= valid
        around = links[np.where(valid, ids[active[:, None], take], 0)]
        around = np.where(valid[:, :, None], around, -1).reshape(len(active), -1)
        around.sort(axis=1)  # the same neighbour may come from several nodes
        fresh = (around >= 0) & np.concatenate([np.ones((len(active), 1), bool), around[:, 1:] != around[:, :-1]], axis=1)
        fresh &= ~seen[active[:, None], around]
        rows, cols = np.nonzero(fresh)
        found = around[rows, cols]
        seen[active[rows], found] = True
        score = np.full(around.shape, -np.inf)
        score[rows, cols] = np.einsum("xd,xd->x", points[found], q[active[rows]])
        all_scores = np.concatenate([scores[active], score], axis=1)
        keep = np.argpartition(-all_scores, ef - 1, axis=1)[:, :ef]
        scores[active] = np.take_along_axis(all_scores, keep, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(fresh, around, -1)], axis=1), keep, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], axis=1), keep, 1)
    return np.where(scores > -np.inf, ids, -1)


INDEX = "shard long, dim int, ids binary, owners binary, vectors binary, nodes array<binary>, links array<binary>"


def _build_shard(k: int, m: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        x = np.stack(rows.embedding.to_numpy()).astype(np.float64)
        distinct, owner = np.unique(x, axis=0, return_inverse=True)
        ids, owner = rows.vec_id.to_numpy(np.int64), owner.ravel()
        order = np.argsort(owner, kind="stable")  # ids stay in order inside a node
        ids, owner = ids[order], owner[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        first = place <= k  # the k smallest ids and one that may be the query's own
        graph = build(distinct, m)
        return pd.DataFrame([[rows["shard"].iloc[0], x.shape[1], ids[first].tobytes(), owner[first].astype(np.int64).tobytes(), distinct.tobytes(), [a.tobytes() for a, _ in graph.layers], [b.tobytes() for _, b in graph.layers]]], columns=["shard", "dim", "ids", "owners", "vectors", "nodes", "links"])

    return run


class Shard:
    """An index row, opened."""

    def __init__(self, r: dict, m: int):
        x = np.frombuffer(r["vectors"]).reshape(-1, r["dim"])
        self.x, self.ids, owners = x, np.frombuffer(r["ids"], np.int64), np.frombuffer(r["owners"], np.int64)
        self.starts = np.searchsorted(owners, np.arange(len(x) + 1))
        squares = (x**2).sum(axis=1)
        points = np.concatenate([x, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]], axis=1)
        self.graph = Graph(points, [(np.frombuffer(a, np.int32), np.frombuffer(b, np.int32).reshape(-1, 2 * m if i == 0 else m)) for i, (a, b) in enumerate(zip(r["nodes"], r["links"], strict=True))])

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, ef: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, own id, score) of the k best rows of each query."""
        found = search(self.graph, queries, max(ef, k + 1))
        for query_id, query, nodes in zip(query_ids, queries, found, strict=True):
            nodes = nodes[nodes >= 0]
            score = np.ascontiguousarray(self.x[nodes] * query).sum(axis=1)
            counts = self.starts[nodes + 1] - self.starts[nodes]
            each = np.repeat(np.arange(len(nodes)), counts)
            own = self.ids[np.repeat(self.starts[nodes] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(len(each))]
            use = own != query_id
            own, score = own[use], score[each][use]
            best = np.lexsort((own, -score))[:k]
            yield np.full(len(best), query_id), own[best], score[best]


def _search_shards(k: int, m: int, ef: int, at_once: int = 512):
    """Rows in order of shard, an index before its blocks of queries, to (query_id, vec_id, score). One index is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["ids"] is not None:
                    name, shard = r["shard"], Shard(r, m)
                    continue
                if r["shard"] != name:
                    continue  # queries of a length that this shard number has no rows for
                query_ids, queries = np.frombuffer(r["query_ids"], np.int64), np.frombuffer(r["queries"]).reshape(-1, r["dim"])
                for a in range(0, len(queries), at_once):
                    out = list(shard.nearest(query_ids[a : a + at_once], queries[a : a + at_once], k, ef))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return run


def _pack_block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("vec_id")
    return pd.DataFrame([[rows["dim"].iloc[0], rows["block"].iloc[0], rows.vec_id.to_numpy(np.int64).tobytes(), np.stack(rows.embedding.to_numpy()).astype(np.float64).tobytes()]], columns=["dim", "block", "query_ids", "queries"])


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles, dim) of the rows that take part, each id once."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0.0)
    rows = embeddings.select(F.col("vec_id").cast("long"), x.alias("embedding")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))


def nearest(embeddings: DataFrame, k: int = 20, query_step: int = QUERY_STEP, shard_rows: int = SHARD_ROWS, m: int = M, ef: int = EF, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's nearest found."""
    good = stage(usable(embeddings), "vectors")
    total = good.count()
    shards, blocks = max(1, -(-total // shard_rows)), max(1, -(-total // query_step // query_block))
    dealt = good.withColumn("shard", F.col("dim").cast("long") * shards + F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    index = stage(dealt.select("shard", "vec_id", "embedding").groupBy("shard").applyInPandas(_build_shard(k, m), INDEX), "hnsw")
    asked = good.where(F.pmod("vec_id", F.lit(query_step)) == 0).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(8)), F.lit(blocks)))
    asked = asked.groupBy("dim", "block").applyInPandas(_pack_block, "dim int, block long, query_ids binary, queries binary")
    asked = asked.withColumn("shard", F.explode(F.sequence(F.col("dim").cast("long") * shards, F.col("dim").cast("long") * shards + (shards - 1))))
    both = index.withColumn("block", F.lit(-1).cast("long")).unionByName(asked, allowMissingColumns=True)
    parts = max(shards, int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = both.repartition(parts, "shard").sortWithinPartitions("shard", "block").mapInArrow(_search_shards(k, m, ef), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
