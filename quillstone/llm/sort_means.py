"""Operator 13: centroid clustering by sort-means, over integer vectors with exact sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from quillstone.llm.common import dropped, others, stored, table

#: Components at most, in amount: squared distances of vectors of up to 128 of them fit in 63 bits.
LIMIT = 1 << 27
#: Components up to this make sums that 53 bits hold, so that products of floats are exact.
_EXACT = 1 << 22


@dataclass(frozen=True)
class SortMeansConfig:
    """clusters: centroids. rounds: assignments that are followed by new centroids; one more assignment follows. dims: components
    of the vectors that take part. scale: what components are multiplied by before their floor is taken. seed: stands before
    vec_id in the hash that draws the first centroids."""

    clusters: int = 40
    rounds: int = 5
    dims: int = 64
    scale: int = 256
    seed: str = "2"


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has so many components, none of them null or not finite."""
    value = lambda x: x.cast("double")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(value(x)) & (F.abs(value(x)) < float("inf")))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), x as double, as integers. Components over LIMIT are refused: a distance couldn't hold them."""
    y = np.floor(x.astype(np.float64) * scale)
    if y.size and np.abs(y).max() > LIMIT:
        raise ValueError(f"a component times {scale} is over {LIMIT}; squared distances wouldn't fit in 63 bits")
    return y.astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to one centroid."""
    y = x - c
    return (y * y).sum(axis=1)


def assign(x: np.ndarray, previous: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row of x, of equally near ones the smaller number, and the squared distance.

    The other centroids are ordered by their distance from a row's previous one; the scan starts there and ends at the first
    which is strictly further from it than twice the row's distance d: by the triangle inequality that one, and all behind it,
    are further from the row than d. At exactly twice d one may be as near and have a smaller number, so it is read.
    """
    best, at = np.zeros(len(x), np.int64), previous.astype(np.int64)
    for p in np.unique(at[: len(x)]).tolist():
        mine = np.flatnonzero(previous == p)
        own = squared(x[mine], centroids[p])
        gaps = squared(centroids, centroids[p])
        order = np.argsort(gaps, kind="stable")
        order = order[order != p]
        reach = np.searchsorted(gaps[order], 4 * own, side="right")  # gaps over (2 d)^2 end the scan
        far_first = np.argsort(-reach, kind="stable")
        mine, reach = mine[far_first], reach[far_first]
        near, number = own[far_first], np.full(mine.size, p)
        rows = x[mine]
        exact = rows.size and max(np.abs(rows).max(), np.abs(centroids).max()) <= _EXACT
        if exact:
            floats, norms = rows.astype(np.float64), (rows * rows).sum(axis=1)
        for k, c in enumerate(order.tolist()):
            n = int(np.searchsorted(-reach, -k, side="left"))  # rows whose scan reaches over k centroids
            if not n:
                break
            if exact:
                d = norms[:n] + int((centroids[c] ** 2).sum()) - 2 * (floats[:n] @ centroids[c].astype(np.float64)).astype(np.int64)
            else:
                d = squared(rows[:n], centroids[c])
            won = (d < near[:n]) | ((d == near[:n]) & (c < number[:n]))
            near[:n][won], number[:n][won] = d[won], c
        best[mine], at[mine] = near, number
    return at, best


def first_centroids(vectors: DataFrame, config: SortMeansConfig) -> np.ndarray:
    """The vectors of least hash of their vec_id, in its order; rows that share an id go by their components, those without one
    last. As many as clusters reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{config.seed}:"), F.col("vec_id").cast("string")), 256).alias("h")
    drawn = vectors.select(key, "embedding").orderBy(F.asc_nulls_last("h"), "embedding").limit(config.clusters).collect()
    return whole(np.array([r.embedding for r in drawn], np.float64).reshape(len(drawn), config.dims), config.scale)


def _pass(rows: DataFrame, row: list, centroids: np.ndarray, config: SortMeansConfig) -> DataFrame:
    """rows (of row, vector, cluster: integers in binary and the previous assignment; or vector as an array, at first) with the
    nearest of centroids. Beside each task's rows stand its sums: of each cluster the components, members and distances, in
    rows that have sums and no vector."""
    k = len(centroids)
    named = [f.name for f in row]
    kinds = StructType([*row]).add("vector", "binary").add("cluster", "integer").add("distance", "long").add("members", "long").add("sums", ArrayType(LongType()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, members, inertia = np.zeros((k, config.dims), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        types = None
        for batch in batches:
            types = [batch.column(c).type for c in named]
            n = batch.num_rows
            if not n:
                continue
            column = batch.column("vector")
            if pa.types.is_list(column.type):
                x, previous = whole(column.flatten().to_numpy(zero_copy_only=False).reshape(n, config.dims), config.scale), np.zeros(n, np.int64)
            else:
                x = np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(n, config.dims).astype(np.int64)
                previous = batch.column("cluster").to_numpy().astype(np.int64)
            cluster, distance = assign(x, previous, centroids)
            order = np.argsort(cluster, kind="stable")
            there, starts = np.unique(cluster[order], return_index=True)
            sums[there] += np.add.reduceat(x[order], starts, axis=0)
            inertia[there] += np.add.reduceat(distance[order], starts)
            members += np.bincount(cluster, minlength=k)
            packed = pa.array([v.tobytes() for v in x.astype("<i4")], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in named), packed, pa.array(cluster.astype(np.int32)), pa.array(distance), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))],
                names=[f.name for f in kinds],
            )
        own = np.flatnonzero(members)
        if own.size:
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(own.size, t) for t in types), pa.nulls(own.size, pa.binary()), pa.array(own.astype(np.int32)), pa.array(inertia[own]), pa.array(members[own]), pa.array(sums[own].tolist(), pa.list_(pa.int64()))],
                names=[f.name for f in kinds],
            )

    return rows.mapInArrow(read, kinds)


def _summed(made: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
    """The next centroids (exact floors of means; those without members stay) and each cluster's summed distances. As many rows as
    there are centroids, times their components, reach the driver."""
    parts = made.where("sums IS NOT NULL").select("cluster", "members", "distance", F.posexplode("sums"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    after, inertia = centroids.copy(), {}
    for r in parts.groupBy("cluster", "pos").agg(exact("members"), exact("distance"), exact("col")).collect():
        after[r.cluster, r.pos] = int(r.col) // int(r.members)
        inertia[r.cluster] = int(r.distance)
    return after, inertia


def sort_means(vectors: DataFrame, config: SortMeansConfig = SortMeansConfig()) -> DataFrame:
    """The rows of vectors (vec_id, embedding and others) that can be clustered, with cluster, distance (squared, to the
    cluster's last centroid), cluster_inertia, inertia, centroid_sha256 and centroid (its components), which replace columns of
    these names; embedding is left out.

    Rows whose embedding is null, has another number of components than config.dims, or one that is null or not finite are left
    out. Rows that repeat a vec_id, or have none, are vectors of their own. With fewer vectors than clusters there are as many
    clusters as vectors; without any the result is empty. Components over LIMIT are refused by an error. Sums are of integers and
    exact, so that no order of tasks changes a result. Each round reads one table and writes the next, in the shared folder,
    and drops the one before: vectors are never shuffled, and of each task only sums of the clusters are.
    """
    new = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
    names = others(vectors, "embedding", *new)
    good = vectors.where(usable(F.col("embedding"), config.dims))
    centroids = first_centroids(good, config)
    spark = vectors.sparkSession
    row = [StructType().add("_row", good.select(*names).schema)["_row"]]
    if not len(centroids):
        kinds = StructType([*row[0].dataType]).add("cluster", "integer").add("distance", "long").add("cluster_inertia", "long").add("inertia", "long")
        return spark.createDataFrame([], kinds.add("centroid_sha256", "string").add("centroid", ArrayType(LongType())))
    now = good.select(F.struct(*names).alias("_row"), F.col("embedding").cast("array<double>").alias("vector"))
    before = None
    for turn in range(config.rounds + 1):
        now = stored(_pass(now, row, centroids, config), f"sort-means-{turn}")
        after, inertia = _summed(now, centroids)
        if before is not None:
            dropped(before)
        if turn < config.rounds:
            centroids, before = after, now
            now = now.where("sums IS NULL").select("_row", "vector", "cluster")
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = [(c, total, sum(inertia.values()), digests[c], centroids[c].tolist()) for c, total in inertia.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    members = now.where("sums IS NULL").select("_row", "cluster", "distance").join(F.broadcast(facts), "cluster")  # a row for each cluster
    return members.select("_row.*", *new)


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sort_means(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(config: SortMeansConfig = SortMeansConfig()) -> str:
    """DuckDB SQL of op13: every vector against every centroid in each round."""
    parts = [
        f"""good AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({config.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {config.dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {config.dims})""",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{config.seed}:' || vec_id)) - 1 AS INTEGER) AS cluster, v AS c FROM good QUALIFY cluster < {config.clusters})""",
    ]
    for k in range(config.rounds + 1):
        parts.append(f"""a{k} AS MATERIALIZED (
  SELECT vec_id, v, unnest(least_of) FROM (
    SELECT vec_id, any_value(v) AS v, arg_min({{'cluster': cluster, 'distance': d}}, (d, cluster)) AS least_of FROM (
      SELECT vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM good, c{k})
    GROUP BY vec_id))""")
        if k < config.rounds:
            parts.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT c{k}.cluster, coalesce(n.c, c{k}.c) AS c FROM c{k} LEFT JOIN (
    SELECT cluster, list(m ORDER BY i) AS c FROM (
      SELECT cluster, i, CAST(floor(CAST(sum(v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM a{k}, range(1, {config.dims + 1}) AS r(i) GROUP BY cluster, i)
    GROUP BY cluster) AS n USING (cluster))""")
    last = config.rounds
    return f"""WITH {", ".join(parts)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} USING (cluster)"""


ORACLE_SQL = oracle_sql()
