"""Sort-means against plain rounds over every centroid, and on awkward rows."""

import hashlib

import numpy as np
import pytest

from quillstone.llm import sort_means
from quillstone.llm.sort_means import SortMeansConfig, assign

VECTORS = "vec_id long, embedding array<double>, cluster string, _row int"


def plain(rows, config):
    """(row number, cluster, distance) of usable rows (vec_id, vector), and the centroids."""
    good = [(k, v, [int(np.floor(config.scale * c)) for c in e]) for k, (v, e) in enumerate(rows) if e is not None and len(e) == config.dims and all(c is not None and np.isfinite(c) for c in e)]
    drawn = sorted(good, key=lambda r: (r[1] is None, hashlib.sha256(f"{config.seed}:{r[1]}".encode()).hexdigest(), rows[r[0]][1]))[: config.clusters]
    centroids = [r[2] for r in drawn]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centroids))
    for _ in range(config.rounds):
        members = {}
        for _, _, x in good:
            members.setdefault(near(x)[1], []).append(x)
        centroids = [[sum(c) // len(members[k]) for c in zip(*members[k])] if k in members else c for k, c in enumerate(centroids)]
    return {r[0]: near(r[2])[::-1] for r in good}, centroids


def held(spark, rows, config):
    found = sort_means.sort_means(spark.createDataFrame([(v, e, "x", k) for k, (v, e) in enumerate(rows)], VECTORS).repartition(3), config).collect()
    wanted, centroids = plain(rows, config)
    assert {r._row: (r.cluster, r.distance) for r in found} == wanted and len(found) == len(wanted)
    for r in found:
        assert r.inertia == sum(d for _, d in wanted.values())
        assert r.cluster_inertia == sum(d for c, d in wanted.values() if c == r.cluster)
        assert list(r.centroid) == centroids[r.cluster]
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()
    return found


def test_clusters_equal_plain_rounds(spark):
    r = np.random.default_rng(3)
    middles = r.normal(size=(6, 8))
    rows = [(k, (middles[k % 6] + 0.2 * r.normal(size=8)).tolist()) for k in range(300)]
    held(spark, rows, SortMeansConfig(clusters=9, rounds=5, dims=8))


def test_ties_repeats_and_rows_that_are_left_out(spark):
    """Few distinct values of few components: many equal distances, equal centroids, empty clusters."""
    r = np.random.default_rng(4)
    rows = [(k % 40, (r.integers(0, 3, size=3) / 256).tolist()) for k in range(120)]
    rows += [(500, None), (501, []), (502, [1.0, 2.0]), (503, [1.0, None, 2.0]), (504, [float("nan"), 0.0, 0.0]), (505, [0.0, float("inf"), 0.0]), (None, [0.5, -0.5, 0.25])]
    held(spark, rows, SortMeansConfig(clusters=12, rounds=4, dims=3))


def test_large_components_stay_exact(spark):
    r = np.random.default_rng(5)
    rows = [(k, (r.integers(-100_000_000, 100_000_000, size=4) / 256).tolist()) for k in range(60)]
    held(spark, rows, SortMeansConfig(clusters=5, rounds=3, dims=4))
    with pytest.raises(Exception, match="wouldn't fit"):
        sort_means.sort_means(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>"), SortMeansConfig(dims=2)).collect()


def test_empty_few_and_one(spark):
    config = SortMeansConfig(clusters=4, rounds=2, dims=2)
    none = sort_means.sort_means(spark.createDataFrame([], VECTORS), config)
    assert none.collect() == [] and none.columns == ["vec_id", "_row", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"]
    held(spark, [(7, [0.0, 1.0])], config)
    held(spark, [(1, [0.0, 1.0]), (2, [5.0, 1.0]), (2, [5.0, 2.0])], config)


def test_scan_stops_only_strictly_beyond_twice_the_distance():
    """The row lies midway: the other centroid is at exactly twice its distance, as near, and of smaller number."""
    at, d = assign(np.array([[2]]), np.array([1]), np.array([[0], [4], [40]]))
    assert (at.tolist(), d.tolist()) == ([0], [4])
