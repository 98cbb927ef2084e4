"""Operator 10: embedding near-duplicates by tiles of vectors, compared in the order of principal components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import components, forest, join_facts, stored, table


@dataclass(frozen=True)
class TileConfig:
    """threshold: least cosine of a link. tile: vectors of a tile, about; a task holds two. lead: leading dimensions read first.
    strip: rows of a tile compared at a time. pivots: cells at most, one for each per_pivot vectors. most_tiles: tiles at most, as
    each task knows them; with more vectors than that tiles are larger."""

    threshold: float = 0.95
    tile: int = 4096
    lead: int = 16
    strip: int = 512
    pivots: int = 1024
    per_pivot: int = 256
    most_tiles: int = 100_000


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    y /= np.abs(y).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return y / np.sqrt((y * y).sum(axis=1, keepdims=True))


def _axes(vectors: DataFrame, d: int) -> np.ndarray:
    """Principal axes of the unit vectors, the strongest first, as columns: the second moments are added up in tasks, row by row
    of the matrix."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                y = _unit(_matrix(batch.column(0)))
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([[*map(float, r)] for r in total], pa.list_(pa.float64()))], names=["row", "sums"])

    parts = vectors.select("embedding").mapInArrow(moments, "row int, sums array<double>").select("row", F.posexplode("sums"))
    sums = parts.groupBy("row", "pos").agg(F.sum("col").alias("s")).collect()
    m = np.zeros((d, d))
    for r in sums:
        m[r.row, r.pos] = r.s
    values, axes = np.linalg.eigh((m + m.T) / 2)
    return axes[:, ::-1].copy()


def _links(a: np.ndarray, b: np.ndarray, same: bool, axes: np.ndarray, config: TileConfig) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine at or over the threshold, strip by strip; of one tile with itself each pair once.

    The product of the leading coordinates, plus the product of the norms of what is left, bounds the cosine; both are one
    matrix product, as the norm stands beside the leading coordinates. Pairs under the bound stop there. The others read
    on by the next dimensions under a new bound, and the last of them are held against the threshold in double precision.
    """
    d, lead = a.shape[1], min(config.lead, a.shape[1])
    ua, ub = _unit(a), _unit(b)
    ya, yb = ua @ axes, ub @ axes
    steps = [*range(lead, d, lead), d]
    tail = lambda y, k: np.sqrt(np.maximum(0, (y[:, k:] ** 2).sum(axis=1)))
    tails = {k: (tail(ya, k), tail(yb, k)) for k in steps[:-1]}
    first = lambda y, t: np.column_stack((y[:, :lead], t)).astype(np.float32)
    ra, rb = tails.get(lead, (np.zeros(len(a)), np.zeros(len(b))))
    fa, fb = first(ya, ra), first(yb, rb)
    floor = np.float32(config.threshold - 1e-4)
    for s in range(0, len(a), config.strip):
        near = fa[s : s + config.strip] @ fb.T >= floor
        if same:
            near &= np.arange(s, min(s + config.strip, len(a)))[:, None] < np.arange(len(b))[None, :]
        n = int(near.sum())
        if n > near.size // 8:
            i, j = np.nonzero(near & (ua[s : s + config.strip] @ ub.T >= config.threshold))
            i += s
        else:
            i, j = np.nonzero(near)
            i += s
            keep_i, keep_j = [], []
            for k in range(0, i.size, 50_000):
                p, q = i[k : k + 50_000], j[k : k + 50_000]
                dot = (ya[p, :lead] * yb[q, :lead]).sum(axis=1)
                for x, y in zip(steps, steps[1:]):
                    dot += (ya[p, x:y] * yb[q, x:y]).sum(axis=1)
                    most = dot + (tails[y][0][p] * tails[y][1][q] if y < d else 0)
                    on = most >= config.threshold - 1e-9
                    p, q, dot = p[on], q[on], dot[on]
                on = (ua[p] * ub[q]).sum(axis=1) >= config.threshold
                keep_i.append(p[on])
                keep_j.append(q[on])
            i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keep_i, keep_j))
        if i.size:
            yield i, j


def _pivots(nodes: DataFrame, n: int, config: TileConfig) -> np.ndarray:
    """Unit vectors that cells are made around, as many as config.pivots at most: of eight times as many, those of least hash, each
    time the one furthest from all taken yet, so that no cluster of some size is without one."""
    wanted = max(1, min(config.pivots, n // config.per_pivot))
    drawn = nodes.select(F.xxhash64("node").alias("h"), "node", "embedding").orderBy("h", "node").limit(8 * wanted).collect()
    x = _unit(np.array([r.embedding for r in drawn], np.float64))
    taken, near = [0], x @ x[0]
    while len(taken) < wanted:
        taken.append(int(near.argmin()))
        near = np.maximum(near, x @ x[taken[-1]])
    return x[_beside(x[taken], np.array(taken))]


def _beside(x: np.ndarray, names: np.ndarray) -> np.ndarray:
    """names of the rows of x in an order in which near ones are close: halves along the main axis, each ordered likewise."""
    if len(names) < 3:
        return names
    along = x @ np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][0]
    order = np.argsort(along, kind="stable")
    halves = np.array_split(order, 2)
    return np.concatenate([_beside(x[h], names[h]) for h in halves])


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles of the rows of x to each pivot."""
    return np.arccos(np.clip(_unit(x) @ pivots.T, -1, 1))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most, none empty: each has an angle to every pivot."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _placed(nodes: DataFrame, pivots: np.ndarray, n: int, config: TileConfig) -> tuple[DataFrame, list]:
    """nodes with tile and ring, and the rings: (ring, tile, cell, low, high). A tile is about so many vectors that follow each other by
    cell (their nearest pivot) and angle to it; a ring is what it has of one cell, whose angles are from low to high. Rings are numbered
    by cell, then by angle."""
    kind = dict(nodes.dtypes)["embedding"]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            angles = _angles(_matrix(batch.column("embedding")), pivots)
            cell = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell])], names=[*batch.schema.names, "cell", "angle"])

    tiles = max(1, min(config.most_tiles, -(-n // config.tile)))
    placed = stored(nodes.mapInArrow(near, f"node long, copies long, embedding {kind}, cell int, angle double").repartitionByRange(tiles, "cell", "angle", "node").withColumn("range", F.spark_partition_id()), "ranges")
    ranges = (placed.agg(F.max("range")).first()[0] or 0) + 1
    placed = placed.withColumn("tile", F.floor(F.col("range") * min(tiles, ranges) / ranges).cast("int"))  # where more ranges were made than asked for
    found = placed.groupBy("tile", "cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high")).collect()  # tiles and cells at most
    rings = [(k, r.tile, r.cell, r.low, r.high) for k, r in enumerate(sorted(found, key=lambda r: (r.cell, r.low, r.tile)))]
    numbers = nodes.sparkSession.createDataFrame([r[:3] for r in rings], "ring int, tile int, cell int")
    return placed.join(F.broadcast(numbers), ["tile", "cell"]).select("node", "copies", "embedding", "tile", "ring"), rings


def _visits(placed: DataFrame, pivots: np.ndarray, rings: list, config: TileConfig) -> DataFrame:
    """placed with visit and met: a row for each tile that a vector is compared in, its own always, and the rings there, all before
    its own, that may hold a vector it links with.

    A vector of a ring is as far from its pivot as the ring says, from low to high; what is within the threshold's angle of it is
    at most that angle nearer or further. So a vector meets a ring if its own angle to that pivot is in the ring, widened by the
    threshold's angle; of a cell's rings those lie side by side. Each pair of rings is met from one side only."""
    reach = float(np.arccos(config.threshold)) + 1e-6
    tile_of = np.array([r[1] for r in rings])
    own_rings: dict[int, list] = {}
    for r in rings:
        own_rings.setdefault(r[2], []).append(r)
    cells = [(c, own[0][0], np.array([r[3] for r in own]), np.maximum.accumulate([r[4] for r in own])) for c, own in own_rings.items()]
    kind = dict(placed.dtypes)["embedding"]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            angles = _angles(_matrix(batch.column("embedding")), pivots)
            home, ring = batch.column("tile").to_numpy(), batch.column("ring").to_numpy()
            rows, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for cell, number, low, high in cells:
                first = np.searchsorted(high, angles[:, cell] - reach, side="left")
                n = np.searchsorted(low, angles[:, cell] + reach, side="right") - first
                some = np.flatnonzero((n > 0) & (ring > number + first))
                if some.size:
                    n = n[some]
                    there = np.repeat(number + first[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    at = np.repeat(some, n)
                    before = there < ring[at]
                    rows.append(at[before])
                    to.append(there[before])
            at, met = np.concatenate(rows), np.concatenate(to)
            tile = tile_of[met]
            none = np.arange(len(home))  # the row of a vector's own tile, whether it meets a ring there or not
            at, tile, met = np.concatenate((at, none)), np.concatenate((tile, home)), np.concatenate((met, np.full(len(home), -1)))
            order = np.lexsort((met, tile, at))
            at, tile, met = at[order], tile[order], met[order]
            new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (tile[1:] != tile[:-1]))))
            lists = pa.ListArray.from_arrays(pa.array(np.append(new, at.size).astype(np.int32)), pa.array(met.astype(np.int32)))
            taken = pa.Table.from_batches([batch]).take(pa.array(at[new])).append_column("visit", pa.array(tile[new].astype(np.int32))).append_column("met", lists)
            yield from taken.to_batches(max_chunksize=20_000)

    names = ["node", "copies", "embedding", "tile", "ring"]
    return placed.select(*names).mapInArrow(visit, f"node long, copies long, embedding {kind}, tile int, ring int, visit int, met array<int>")


def _compare(nodes: DataFrame, d: int, n: int, config: TileConfig) -> DataFrame:
    """nodes (node, copies, embedding), all of d components: rows of node, links (copies that it links with) and parent, which
    connects what links connect (null in rows that only count). Each pair meets in one task: that of the tile of its lower ring, in
    which the tile's vectors meet each other, and a lot of so many visitors; by rings, so that only rings that met are compared."""
    axes, pivots = _axes(nodes, d), _pivots(nodes, n, config)
    placed, rings = _placed(nodes, pivots, n, config)
    visits = _visits(placed, pivots, rings, config)
    sizes = visits.where("tile <> visit").groupBy("visit").count().collect()  # a row for each tile
    lots = {r.visit: -(-r["count"] // config.tile) for r in sizes}
    lots = nodes.sparkSession.createDataFrame([(t, lots.get(t, 1)) for t in sorted({r[1] for r in rings})], "visit int, lots int")
    sent = visits.join(F.broadcast(lots), "visit")
    own = F.sequence(F.lit(0), F.col("lots") - 1)
    lot = F.when(F.col("tile") == F.col("visit"), own).otherwise(F.array(F.pmod(F.xxhash64("node"), "lots").cast("int")))
    sent = sent.select("visit", F.explode(lot).alias("lot"), "tile", "ring", "met", "node", "copies", "embedding")

    def tile_lot(keys: tuple, both: pa.Table) -> pa.Table:
        visit, lot = (k.as_py() for k in keys)
        home, ring = both.column("tile").to_numpy() == visit, both.column("ring").to_numpy()
        node, copies = both.column("node").to_numpy(), both.column("copies").to_numpy()
        vectors = _matrix(both.column("embedding").combine_chunks())
        lists = both.column("met").combine_chunks()
        met = lists.flatten().to_numpy(zero_copy_only=False)
        whose = np.repeat(np.arange(len(node)), lists.value_lengths().to_numpy())
        whose, met = (x[met >= 0] for x in (whose, met))
        if lot:  # the tile's own pairs are of the first lot
            whose, met = (x[~home[whose]] for x in (whose, met))
        order = np.argsort(met, kind="stable")
        whose, met = whose[order], met[order]
        count = np.zeros(len(node), np.int64)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for r in np.unique(ring[home]).tolist():
            left = np.flatnonzero(home & (ring == r))
            right = whose[np.searchsorted(met, r, side="left") : np.searchsorted(met, r, side="right")]
            for a, b, same in ((left, left, True),) * (lot == 0) + ((left, right, False),) * (right.size > 0):
                for i, j in _links(vectors[a], vectors[b], same, axes, config):
                    p, q = a[i], b[j]
                    count += np.bincount(p, weights=copies[q], minlength=len(node)).astype(np.int64)
                    count += np.bincount(q, weights=copies[p], minlength=len(node)).astype(np.int64)
                    out.append(forest(p, q, len(node)))
        child, root = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
        some = np.flatnonzero(count)
        return pa.table({"node": np.concatenate((node[some], node[child])), "links": np.concatenate((count[some], np.zeros(child.size, np.int64))), "parent": pa.array([None] * some.size + node[root].tolist(), pa.int64())})

    return sent.groupBy("visit", "lot").applyInArrow(tile_lot, "node long, links long, parent long")


def near_vectors(vectors: DataFrame, config: TileConfig = TileConfig()) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding).

    A row without a vec_id links with nothing, has no component and is kept. Rows that repeat a vec_id are vectors of their own,
    each of which counts as a link; all rows whose vec_id is that of their component are kept.

    Links are the pairs with cosine at or over the threshold, all of them: a vector is compared in every tile whose bounds
    allow one. Vectors that are null, empty, zero or hold a null or a component that isn't finite link with nothing, as do
    vectors of different lengths with each other. Equal vectors become one node with a count before anything is compared;
    tiles give counts and forests, never their pairs. Other columns are left out.
    """
    rows = vectors.select("vec_id", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = F.coalesce(F.col("embedding").isNotNull() & finite, F.lit(False))
    rows = rows.withColumn("embedding", F.when(good, F.col("embedding")))
    nodes = stored(rows.where("embedding IS NOT NULL AND vec_id IS NOT NULL").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    sizes = nodes.groupBy(F.size("embedding").alias("d")).count().collect()
    found = None
    for r in sorted(sizes, key=lambda r: r.d):
        own = _compare(nodes.where(F.size("embedding") == r.d).select("node", "copies", "embedding"), r.d, r["count"], config)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "node long, links long, parent long")
    found = stored(found, "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    graph = components(found.where("parent IS NOT NULL").select(F.col("node").alias("a"), F.col("parent").alias("b")))
    known = nodes.join(counts, "node", "left").join(graph, "node", "left")
    known = stored(known.select("embedding", "copies", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("group")), "known")
    firsts = known.groupBy("group").agg(F.min("least").alias("component"), F.count("*").alias("members"))
    known = stored(join_facts(known, firsts, ["group"], "members", known.count()).select("embedding", "copies", "links", "component"), "named")
    there = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()
    some = rows.where(there)
    met = join_facts(some, known, ["embedding"], "copies", some.count()).select("vec_id", "links", "component")
    alone = rows.where(~there).select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    kept = F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True))
    return met.unionByName(alone).select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"), kept.alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
