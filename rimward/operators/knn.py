"""Exact k nearest neighbours as DataFrame plans. Every plan gives (id, nid, dist, rn), ties by nid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rimward.functions.metrics import l1_arrays, l2_arrays, metric
from rimward.operators.caching import keep

#: Cells along one axis, at most, as a power of two; a bound of the edges that the driver holds.
MOST_BITS = 11
#: Vectors that are compared at once with as many others.
BLOCK = 1024


def rank(pairs: DataFrame, k: int, dist: str = "dist") -> DataFrame:
    """The k best pairs of each id (Spark keeps only k rows of a group before the shuffle)."""
    order = Window.partitionBy("id").orderBy(dist, "nid")
    return pairs.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def dist_2d(name: str) -> Column:
    return metric(name)([F.col("x"), F.col("y")], [F.col("nx"), F.col("ny")])


def doubles(values: list[float]) -> Column:
    """A constant array."""
    return F.expr(f"array({', '.join(f'{v!r}D' for v in map(float, values))})")


def quantiles(column: str, parts: int) -> Column:
    """Approximate quantiles that cut the values into so many parts."""
    return F.expr(f"percentile_approx({column}, array({', '.join(f'{i / parts!r}D' for i in range(1, parts))}), {10 * parts})")


def _cell(value: Column, edges: list[float]) -> Column:
    """How many edges are at most the value: a binary search in a constant array."""
    if not edges:
        return F.lit(0)
    held, n = doubles(edges), len(edges)
    steps = F.expr(f"array({', '.join(str(1 << i) for i in range(n.bit_length() - 1, -1, -1))})")
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(held, at + s - 1) <= value), at + s).otherwise(at))


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, made by a generator of one row: the optimizer then does not derive filters from their expressions,
    which goes wrong for those that hold lambda functions."""
    return df.withColumn("_one", F.explode(F.array(F.struct(*[e.alias(n) for n, e in columns.items()])))).select(*df.columns, "_one.*")


def _parts(df: DataFrame) -> int:
    """A fixed number of partitions: the work of a join follows the pairs, not the bytes by which small partitions are merged."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _bits(count: Column | int, per_cell: float):
    """Half the logarithm of the number of cells, so that a cell holds ``per_cell`` to four times as many points."""
    return F.greatest(F.lit(0), F.floor(F.log2(F.greatest(count, F.lit(1)) / F.lit(per_cell)) / 2)).cast("int")


def knn_cells(points: DataFrame, k: int, name: str = "L2", group: str | None = None, cell_points: int = 12, probe: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """Neighbours of points (id, x, y, u, v) by a two-phase join on cells of (u, v).

    u and v are any two numbers that differ by no more than the distance of two points: the coordinates, or
    distances to two pivots. Cell edges are approximate quantiles, so that skewed values give even cells. With ``group``,
    neighbours are of the same group, and a group's cells are as coarse as its size asks for. ``probe`` (id) limits the points
    that are asked for; with ``among``, a table of the same columns, they are looked for in that table, whatever its ids.

    Phase 1 joins each point with its own and the adjoining cells; a point whose ball of the k-th distance found lies in them is
    done. Phase 2 joins the others with every cell that their balls meet. Both are equi-joins on the cell. The first one
    deals the table's points to the cells around, so all pairs of a point meet in its own cell and are ranked there without another shuffle.
    """
    top = 1 << MOST_BITS
    ends = [F.max(F.abs(F.col("x"))).alias("ax"), F.max(F.abs(F.col("y"))).alias("ay")]
    row = (points if among is None else among).agg(F.count(F.lit(1)).alias("n"), *[e for c in ("u", "v") for e in (quantiles(c, top).alias(f"q{c}"),)], *ends).first()
    far = row if among is None else points.agg(*ends).first()
    per_cell = 0.375 * max(cell_points, 2 * k)
    most = 0
    while most < MOST_BITS and row["n"] / 4 ** (most + 1) >= per_cell:
        most += 1
    edges = {c: [] if not most else sorted(set(row[f"q{c}"][(top >> most) - 1 :: top >> most])) for c in ("u", "v")}
    whole = 4.0 * float(max(row["ax"] or 0, far["ax"] or 0) + max(row["ay"] or 0, far["ay"] or 0)) + 1.0  # no two points are as far apart in L1 or L2
    own = points.select(*([F.col(group).alias("g")] if group else [F.lit(0).alias("g")]), "id", "x", "y", "u", "v")
    if group:
        sizes = own.groupBy(F.col("g").alias("_g")).agg(F.greatest(F.lit(most) - _bits(F.count(F.lit(1)), per_cell), F.lit(0)).alias("s"))
        own = own.join(sizes, F.col("g") == F.col("_g")).drop("_g")
    else:
        own = own.withColumn("s", F.lit(0))
    at = lambda c, value: F.call_function("shiftright", _cell(value, edges[c]), F.col("s"))
    placed = _with(own, cx=at("u", F.col("u")), cy=at("v", F.col("v")))
    parts = _parts(points)
    held = placed if among is None else _with(among.select(F.lit(0).alias("g"), "id", "x", "y", "u", "v", F.lit(0).alias("s")), cx=at("u", F.col("u")), cy=at("v", F.col("v")))
    other = F.col("id") != F.col("nid") if among is None else F.lit(True)
    table = held.select(F.col("g").alias("tg"), F.col("cx").alias("tx"), F.col("cy").alias("ty"), F.col("id").alias("nid"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    around = F.explode(F.array(*[F.struct((F.col("tx") + i).alias("i"), (F.col("ty") + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    dealt = table.withColumn("_c", around).select("tg", F.col("_c.i").alias("tx"), F.col("_c.j").alias("ty"), "nid", "nx", "ny").repartition(parts, "tg", "tx", "ty")
    asked = placed.join(probe.select("id"), "id", "left_semi") if probe is not None else placed
    met = asked.repartition(parts, "g", "cx", "cy").join(dealt.hint("merge"), (F.col("g") == F.col("tg")) & (F.col("cx") == F.col("tx")) & (F.col("cy") == F.col("ty")) & other, "left")
    keys = ["g", "cx", "cy", "id", "x", "y", "u", "v", "s"]
    pair = F.when(F.col("nid").isNotNull(), F.struct("dist", "nid"))
    best = met.withColumn("dist", dist_2d(name)).withColumn("rn", F.row_number().over(Window.partitionBy("g", "cx", "cy", "id").orderBy("dist", "nid"))).where(F.col("rn") <= k)
    per = best.groupBy(*keys).agg(F.sort_array(F.collect_list(pair)).alias("nn"))
    # computed distances may be off by some units in the last place, which the balls allow for
    radius = F.when(F.size("nn") >= k, F.get("nn", F.lit(k - 1))["dist"] * (1 + 1e-12) + F.lit(1e-13 * whole)).otherwise(F.lit(whole))
    inside = F.size("nn") >= k
    for c, place in (("u", "cx"), ("v", "cy")):
        inside = inside & (at(c, F.col(c) - F.col("r")) >= F.col(place) - 1) & (at(c, F.col(c) + F.col("r")) <= F.col(place) + 1)
    per = keep(per.withColumn("r", radius).withColumn("done", inside))
    span = lambda c: F.explode(F.sequence(at(c, F.col(c) - F.col("r")), at(c, F.col(c) + F.col("r"))))
    rest = per.where(~F.col("done")).withColumn("cx", span("u")).withColumn("cy", span("v")).select("g", "cx", "cy", "id", "x", "y", "r")
    wide = rest.repartition(parts, "g", "cx", "cy").join(table.repartition(parts, "tg", "tx", "ty").hint("merge"), (F.col("g") == F.col("tg")) & (F.col("cx") == F.col("tx")) & (F.col("cy") == F.col("ty")) & other)
    label = ["g"] if group else []
    found = rank(wide.withColumn("dist", dist_2d(name)).where("dist <= r").select(*label, "id", "nid", "dist"), k)
    near = per.where("done").select(*label, "id", F.posexplode("nn").alias("rn", "_n")).select(*label, "id", F.col("_n.nid").alias("nid"), F.col("_n.dist").alias("dist"), (F.col("rn") + 1).alias("rn"))
    both = near.unionByName(found)
    return both.withColumnRenamed("g", group) if group else both


def pairs_within(asked: DataFrame, table: DataFrame, name: str = "L2", cell_points: int = 12) -> DataFrame:
    """The columns of ``asked`` (kind, x, y, r, ...) and of ``table`` (kind, nx, ny, ...) with ``dist``, for rows of one kind that are no
    farther apart than r: an equi-join on the cells that the balls meet, edges being approximate quantiles of the table."""
    top = 1 << MOST_BITS
    row = table.agg(F.count(F.lit(1)).alias("n"), quantiles("nx", top).alias("qx"), quantiles("ny", top).alias("qy")).first()
    most = 0
    while most < MOST_BITS and row["n"] / 4 ** (most + 1) >= 0.375 * cell_points:
        most += 1
    edges = {c: [] if not most else sorted(set(row[f"q{c}"][(top >> most) - 1 :: top >> most])) for c in ("x", "y")}
    placed = _with(table.withColumnRenamed("kind", "_tk"), _tx=_cell(F.col("nx"), edges["x"]), _ty=_cell(F.col("ny"), edges["y"]))
    span = lambda c: F.explode(F.sequence(_cell(F.col(c) - F.col("r"), edges[c]), _cell(F.col(c) + F.col("r"), edges[c])))
    spread = asked.withColumn("_cx", span("x")).withColumn("_cy", span("y"))
    parts = _parts(asked)
    met = spread.repartition(parts, "kind", "_cx", "_cy").join(placed.repartition(parts, "_tk", "_tx", "_ty").hint("merge"), (F.col("kind") == F.col("_tk")) & (F.col("_cx") == F.col("_tx")) & (F.col("_cy") == F.col("_ty")))
    return met.withColumn("dist", dist_2d(name)).where("dist <= r").drop("_cx", "_cy", "_tk", "_tx", "_ty")


def _apart(points: DataFrame, k: int, most: int, near) -> DataFrame:
    """``near`` of points (id, x, y); where more than ``most`` points share a place, of the distinct places instead.

    A place holds its k + 1 smallest ids; the k nearest other places and the own one hold all neighbours of its points, so
    no pairs are formed among the points of a place, however many they are.
    """
    places = points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    if (places.agg(F.max("n")).first()[0] or 0) <= most:
        return near(points)
    held = Window.partitionBy("x", "y").orderBy("id")
    few = points.select("x", "y", "id").withColumn("_no", F.row_number().over(held)).where(F.col("_no") <= k + 1)
    places = keep(few.groupBy("x", "y").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")))
    found = near(places.select("id", "x", "y")).select("id", "nid", "dist").unionByName(places.select("id", F.col("id").alias("nid"), F.lit(0.0).alias("dist")))
    named = found.join(places.select(F.col("id").alias("nid"), "ids"), "nid").select("id", "dist", F.explode("ids").alias("nid"))
    best = rank(named, k + 1).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("dist", "nid"))).alias("nn"))
    each = points.select("x", "y", F.col("id").alias("pid")).join(places.drop("ids").join(best, "id").drop("id"), ["x", "y"])
    nn = F.slice(F.filter("nn", lambda n: n["nid"] != F.col("pid")), 1, k)
    return each.select(F.col("pid").alias("id"), F.posexplode(nn).alias("rn", "_n")).select("id", F.col("_n.nid").alias("nid"), F.col("_n.dist").alias("dist"), (F.col("rn") + 1).alias("rn"))


def with_self(found: DataFrame, points: DataFrame) -> DataFrame:
    """Each point as its own first neighbour, the others one rank further."""
    own = points.select("id", F.col("id").alias("nid"), F.lit(0.0).alias("dist"), F.lit(1).alias("rn"))
    return own.unionByName(found.withColumn("rn", F.col("rn") + 1))


def _or_self(points: DataFrame, k: int, include_self: bool, near) -> DataFrame:
    if not include_self:
        return near(k)
    if k == 1:
        return with_self(points.select("id", F.col("id").alias("nid"), F.lit(0.0).alias("dist"), F.lit(1).alias("rn")).where("false"), points)
    return with_self(near(k - 1), points)


def knn_grid(points: DataFrame, k: int, name: str = "L2", cell_points: int = 12, include_self: bool = False) -> DataFrame:
    """Neighbours by cells of the coordinates."""
    points = points.select("id", "x", "y")
    near = lambda need: _apart(points, need, 8 * (cell_points + need), lambda p: knn_cells(p.withColumn("u", F.col("x")).withColumn("v", F.col("y")), need, name, None, cell_points))
    return _or_self(points, k, include_self, near)


def knn_of(points: DataFrame, probe: DataFrame, k: int, name: str = "L2", cell_points: int = 12, include_self: bool = False) -> DataFrame:
    """Neighbours of the points whose ids are in ``probe`` only."""
    points = points.select("id", "x", "y")
    near = lambda need: knn_cells(points.withColumn("u", F.col("x")).withColumn("v", F.col("y")), need, name, None, cell_points, probe)
    return _or_self(points.join(probe.select("id"), "id", "left_semi"), k, include_self, near)


def knn_within(points: DataFrame, k: int, group: str, name: str = "L2") -> DataFrame:
    """Neighbours among the points of the same group."""
    return knn_cells(points.where(F.col(group).isNotNull()).select(group, "id", "x", "y", F.col("x").alias("u"), F.col("y").alias("v")), k, name, group)


def knn_pivot(points: DataFrame, k: int, vectors: bool = False, name: str = "L2", digits: int | None = None, include_self: bool = False) -> DataFrame:
    """Neighbours by distances to pivots: |d(a, p) - d(a, q)| never exceeds the distance of p and q.

    In two dimensions the pivots are two corners of the domain, whose distances together tell all places of the domain
    apart, and cells of these two distances are joined. Vectors are compared in blocks, see ``knn_vectors``.
    """
    if vectors:
        return _or_self(points, k, include_self, lambda need: knn_vectors(points, need, name, digits))
    points = points.select("id", "x", "y")
    row = points.agg(F.min("x").alias("ax"), F.max("x").alias("bx"), F.min("y").alias("y")).first()
    pd = lambda x: metric(name)([F.col("x"), F.col("y")], [F.lit(float(x or 0)), F.lit(float(row["y"] or 0))])
    near = lambda need: _apart(points, need, 8 * (12 + need), lambda p: knn_cells(p.withColumn("u", pd(row["ax"])).withColumn("v", pd(row["bx"])), need, name))
    return _or_self(points, k, include_self, near)


def _distances(name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a - b).sum(axis=-1) if name == "l1" else np.sqrt(((a - b) ** 2).sum(axis=-1))


def _nearest_in(name: str, x: np.ndarray, y: np.ndarray, k: int, same: bool, most: np.ndarray | None, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of the k nearest rows of y for each of x, with all that are farther by ``slack`` at most."""
    out = []
    for a in range(0, len(x), 128):
        part = x[a : a + 128]
        if name == "l1":
            rough = np.abs(part[:, None, :] - y[None, :, :]).sum(axis=2)
        else:
            rough = np.sqrt(np.maximum((part**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :] - 2 * part @ y.T, 0))
        if same:
            rough[np.arange(len(part)), np.arange(a, a + len(part))] = np.inf
        # products lose half of the digits of small distances
        loose = slack + 1e-6 * (1 + np.abs(part).max(initial=0) + np.abs(y).max(initial=0)) * part.shape[1] ** 0.5
        last = np.partition(rough, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
        last = np.where(np.isfinite(last), last, np.inf) + loose
        if most is not None:
            last = np.minimum(last, most[a : a + 128] + loose)
        r, c = np.nonzero((rough <= last[:, None]) & np.isfinite(rough))
        d = _distances(name, part[r], y[c])
        order = np.lexsort((d, r))
        r, c, d = r[order], c[order], d[order]
        first = np.searchsorted(r, np.arange(len(part)))
        kth = np.full(len(part), np.inf)
        has = np.append(first[1:], len(r)) - first >= k
        kth[has] = d[first[has] + k - 1]
        use = d <= kth[r] + slack
        out.append((r[use] + a, c[use], d[use]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def knn_vectors(points: DataFrame, k: int, name: str = "L2", digits: int | None = None, block: int = BLOCK) -> DataFrame:
    """Neighbours of vectors (id, v) of one length.

    Vectors are dealt to bands of their distance to a pivot and, where a band holds many, to blocks of it. A block's own
    neighbours bound the distances, and the block then meets the blocks of all bands that its balls reach; a pair of blocks is one matrix product.
    """
    kind = name.lower().removesuffix("metric")
    measure = {"l1": l1_arrays, "l2": l2_arrays}[kind]
    slack = 2.0 * 10.0**-digits if digits is not None else 0.0
    points = points.select("id", "v").where("v is not null")
    size, count = points.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    if not count:
        return points.select("id", F.col("id").alias("nid"), F.lit(0.0).alias("dist"), F.lit(1).alias("rn"))
    centre = points.agg(*[((F.min(F.get("v", F.lit(i))) + F.max(F.get("v", F.lit(i)))) / 2).alias(f"c{i}") for i in range(size)]).first()
    placed = points.withColumn("pd", measure(F.col("v"), doubles(list(centre))))
    bands = max(1, min(4096, count // block))
    marks = sorted(set(placed.agg(quantiles("pd", bands)).first()[0] or [])) if bands > 1 else []
    placed = _with(placed, band=_cell(F.col("pd"), marks))
    sizes = placed.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_parts"))
    placed = placed.join(sizes, "band").withColumn("part", F.pmod(F.xxhash64("id"), F.col("_parts"))).drop("_parts")

    def pack(rows):
        import pandas as pd

        x = np.stack(rows.v.to_numpy()).astype(np.float64)
        r, _, d = _nearest_in(kind, x, x, k, True, None, 0.0)
        bound = np.full(len(x), np.inf)
        full = np.bincount(r, minlength=len(x)) >= k
        bound[full] = 0.0
        np.maximum.at(bound, r, d)
        return pd.DataFrame([[rows.band.iloc[0], rows.part.iloc[0], float((rows.pd - bound).min()), float((rows.pd + bound).max()), rows.id.to_numpy(np.int64).tobytes(), x.tobytes(), bound.tobytes()]], columns=["band", "part", "low", "high", "ids", "vectors", "bounds"])

    # what a block needs is far less than what its pairs compute
    blocks = keep(placed.groupBy("band", "part").applyInPandas(pack, "band int, part long, low double, high double, ids binary, vectors binary, bounds binary"))
    span = F.explode(F.sequence(_cell(F.col("low") - F.lit(slack + 1e-9), marks), _cell(F.col("high") + F.lit(slack + 1e-9), marks)))
    ask = blocks.withColumn("to", span).select("to", "band", "part", "ids", "vectors", "bounds")
    other = blocks.select(F.col("band").alias("to"), F.col("part").alias("opart"), F.col("ids").alias("oids"), F.col("vectors").alias("ovectors"))
    parts = _parts(points)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, oids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["oids"], np.int64)
                x, y = (np.frombuffer(r[c]).reshape(-1, size) for c in ("vectors", "ovectors"))
                same = r["band"] == r["to"] and r["part"] == r["opart"]
                a, b, d = _nearest_in(kind, x, y, k, same, np.frombuffer(r["bounds"]), slack)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(oids[b]), pa.array(d)], ["id", "nid", "dist"])

    met = ask.join(other, "to").repartition(parts, "to", "band", "part", "opart")
    found = met.mapInArrow(search, "id long, nid long, dist double")
    if digits is not None:
        found = found.withColumn("dist", F.round("dist", digits))
    return rank(found, k)
