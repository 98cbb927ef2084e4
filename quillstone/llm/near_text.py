"""Near-duplicate texts by the Jaccard similarity of their word shingles: candidates by SimHash and min-hashes, verified exactly.

A 64-bit fingerprint alone can't find all pairs of 0.8: by the usual estimate they differ in about 10 bits, and any byte index
that reaches so far pairs nearly everything. Bands of min-hashes find them; the fingerprints' links are candidates besides.
Links decide nothing: they only say which texts are read again, and of those all pairs are held against the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import components, join_facts, others, stored, texts_of
from quillstone.llm.repeats import mixed
from quillstone.llm.simhash import SimHashConfig, link, majority, shingle_hashes


@dataclass(frozen=True)
class NearConfig:
    """shingle: words of a shingle. least: Jaccard similarity of shingle sets from which on texts are near-duplicates. bands, rows:
    keys of a text and min-hashes of each; a pair at 0.8 misses all keys with a chance of (1 - 0.8^6)^40, about 5 in a million.
    block: shingles that a task compares with as many others; larger groups are dealt out as pairs of blocks."""

    shingle: int = 5
    least: float = 0.8
    seed: int = 42
    bands: int = 40
    rows: int = 6
    block: int = 1_000_000


def shingle_set(text: str | None, config: NearConfig) -> np.ndarray:
    return np.unique(shingle_hashes(text, config.shingle, config.seed))


class Bands:
    """Band keys of shingle sets."""

    def __init__(self, config: NearConfig) -> None:
        self.config = config
        n = config.bands * config.rows
        self.factors = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(self.factors.size, ~np.uint64(0))
        for k in range(0, shingles.size, 1024):
            np.minimum(least, (shingles[k : k + 1024, None] * self.factors).min(axis=0), out=least)
        keys = np.arange(self.config.bands, dtype=np.uint64)
        for column in least.reshape(self.config.bands, -1).T:
            keys = mixed((keys ^ column) + np.uint64(0x9E3779B97F4A7C15))
        return keys.view(np.int64)


def marked(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """docs with row (an id of its own), node (a digest of its shingle set), fp (SimHash), keys (bands) and n (shingles)."""

    @F.pandas_udf("node long, fp long, keys array<long>, n long")
    def marks(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bands = Bands(config)
        for column in texts:
            out = []
            for text in column:
                hashes = shingle_hashes(text, config.shingle, config.seed)
                own = np.unique(hashes)
                node, fp = np.array([xxhash.xxh3_64_intdigest(own.tobytes()), majority(hashes)], np.uint64).view(np.int64).tolist()
                out.append((node, fp, bands(own), own.size))
            yield pd.DataFrame(out, columns=["node", "fp", "keys", "n"])

    found = texts_of(docs).withColumn("row", F.monotonically_increasing_id()).withColumn("_m", marks(F.col("text")))
    return found.select(*docs.columns, "row", "_m.*")


def candidates(made: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """Edges (a, b) between nodes that share a band's key or whose fingerprints link. A list yields a star, never its pairs."""
    nodes = stored(made.groupBy("node").agg(F.first("keys").alias("keys"), F.first("fp").alias("fp")), "nodes")
    total = nodes.count()
    posted = nodes.select("node", F.explode("keys").alias("key"))
    lists = stored(posted.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1"), "band-lists")
    shared = join_facts(posted, lists, ["key"], "n", total * config.bands).where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    classes = stored(nodes.groupBy("fp").agg(F.min("node").alias("b"), F.count("*").alias("n")), "fingerprint-classes")
    same = join_facts(nodes.select("node", "fp"), classes.where("n > 1"), ["fp"], "n", total).where("node <> b").select(F.col("node").alias("a"), "b")
    near = link(classes.select(F.col("b").alias("node"), "fp"), SimHashConfig(shingle=config.shingle, seed=config.seed))
    return shared.unionByName(same).unionByName(near.select("a", "b"))


def searched(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """Edges (child, root) that connect 0 to n - 1 as near does: near(i, others) tells which others i is linked with. Each one
    is held against those not reached yet only, so that a large group of near copies isn't paired with itself."""
    child, root, rest = [], [], np.arange(n)
    while rest.size > 1:
        start, rest = int(rest[0]), rest[1:]
        wave = [start]
        while wave and rest.size:
            hit = near(wave.pop(), rest)
            found = rest[hit].tolist()
            wave += found
            child += found
            root += [start] * len(found)
            rest = rest[~hit]
    return child, root


def similar(sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Edges that connect the sets as pairs of a Jaccard similarity of at least least do. Two empty sets are equal."""
    sizes = np.array([s.size for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    of = [ids[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist())]
    there = np.zeros(ids.size + 1, np.int64)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        hit = np.zeros(others.size, bool)
        low, high = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        may = np.flatnonzero(low >= least * high - 1e-9)  # sizes too different can't be similar
        if may.size:
            there[of[i]] = 1
            taken = sizes[others[may]]
            sums = np.concatenate(([0], np.cumsum(there[np.concatenate([of[k] for k in others[may].tolist()])])))
            stops = np.cumsum(taken)
            common = sums[stops] - sums[stops - taken]
            there[of[i]] = 0
            hit[may] = common >= least * (sizes[i] + taken - common) - 1e-9
        return hit

    return searched(len(sets), near)


def verified(made: DataFrame, groups: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """Edges (a, b) that connect nodes as all pairs of a group (node, component) with the similarity do.

    One text of each node goes to its group's task; of a group over the block size, texts go to pairs of blocks, so that
    no task gets all of it and each pair still meets in one."""
    one = made.groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"))
    picked = stored(groups.join(one, "node"), "picked")
    sizes = picked.groupBy("component").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / config.block)).cast("int").alias("blocks"), F.count("*").alias("members"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    sized = join_facts(picked, stored(sizes, "group-sizes"), ["component"], "members", picked.count())
    parts = made.select("row", "text").join(sized, "row").withColumn("own", own)
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = parts.select("component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, sets = None, [], []

        def done() -> pa.RecordBatch:
            child, root = similar(sets, config.least)
            return pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in c], pa.int64()) for c in (child, root)], names=["a", "b"])

        for batch in batches:
            for c, x, y, node, text in zip(*(batch.column(n).to_pylist() for n in ("component", "x", "y", "node", "text"))):
                if (c, x, y) != last and nodes:
                    yield done()
                    nodes, sets = [], []
                last = (c, x, y)
                nodes.append(node)
                sets.append(shingle_set(text, config))
        if nodes:
            yield done()

    dealt = texts_of(parts).repartition("component", "x", "y").sortWithinPartitions("component", "x", "y", "node")
    return dealt.mapInArrow(compare, "a long, b long")


def first_of_groups(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """Of the rows of docs (doc_id, text and others), of each group that pairs of similar texts connect, the one of the
    smallest doc_id. Rows that repeat a doc_id are told apart by their texts. Rows without a doc_id stay. All columns pass."""
    own = docs.where("doc_id IS NOT NULL").select(F.struct(*others(docs)).alias("_row"), "doc_id", "text")
    made = stored(marked(own, config), "marked")
    groups = components(candidates(made, config))
    linked = components(verified(made, groups, config))
    firsts = made.groupBy("node").agg(F.min(F.struct("doc_id", "node", "row")).alias("first"))  # so that no node's rows meet in one task
    kept = firsts.join(linked, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").row.alias("row"))
    return made.join(kept.select("row"), "row", "left_semi").select("_row.*").unionByName(docs.where("doc_id IS NULL"))
