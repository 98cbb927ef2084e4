"""Operator 8: near-duplicates by SimHash, linked through an inverted index of byte positions with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import components, forest, join_facts, stored, table, texts_of

BYTES = 8


@dataclass(frozen=True)
class SimHashConfig:
    """shingle: words of a shingle. max_bits: bits that linked fingerprints differ in at most. block: fingerprints of a
    posting list that one task compares with as many others; longer lists are dealt out as pairs of blocks."""

    shingle: int = 4
    seed: int = 42
    max_bits: int = 4
    block: int = 4096


def shingle_hashes(text: str | None, n: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of n words, of all words if there are fewer; none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    stops = (ends - 1)[min(n, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), stops)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits that over half the hashes have set."""
    ones = np.zeros(64, np.int64)
    for k in range(0, hashes.size, 8192):
        ones += np.unpackbits(hashes[k : k + 8192].astype("<u8").view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > hashes.size, bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, config: SimHashConfig = SimHashConfig()) -> int:
    """Bits that over half the shingles' XXH64 have set; 0 without words."""
    return majority(shingle_hashes(text, config.shingle, config.seed))


def fingerprints(docs: DataFrame, config: SimHashConfig = SimHashConfig(), text: str = "text") -> DataFrame:
    """Each row of docs with fp, the fingerprint as a signed 64-bit integer. Null text counts as empty."""

    @F.pandas_udf("long")
    def made(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in texts:
            yield pd.Series(np.array([fingerprint(t, config) for t in column], np.uint64).view(np.int64))

    return texts_of(docs).withColumn("fp", made(F.col(text)))


def index_positions() -> list[tuple[int, int, int]]:
    """Triples of byte positions, such that any four positions hold one of them (Turan's three-class construction).

    Fingerprints that differ in at most 4 bits share 4 of 8 bytes at their positions, so they meet in a list of a triple.
    """
    classes = ((0, 1, 2), (3, 4, 5), (6, 7))
    out = [t for c in classes for t in combinations(c, 3)]
    for k, c in enumerate(classes):
        out += [(*pair, x) for pair in combinations(c, 2) for x in classes[(k + 1) % 3]]
    return out


def _linked(fps: np.ndarray, config: SimHashConfig) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a posting list that link, as a forest: tally of shared positional bytes, then the bits themselves."""
    left, right = [], []
    least = BYTES - config.max_bits
    for i in range(fps.size - 1):
        x = fps[i + 1 :] ^ fps[i]
        tally = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        near = np.flatnonzero(tally >= least)
        near = near[np.bitwise_count(x[near]) <= config.max_bits] + i + 1
        if near.size:
            left.append(np.full(near.size, i))
            right.append(near)
        if sum(map(len, left[-256:])) > 1 << 20:
            a, b = forest(np.concatenate(left), np.concatenate(right), fps.size)
            left, right = [a], [b]
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(left), np.concatenate(right), fps.size)


def link(classes: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """Edges (a, b) between nodes of classes (node, fp; each fp once) that connect what fingerprints' links connect.

    Posting lists are keyed by a triple of positions and the bytes there. Lists of one are dropped after a count that
    combines on the map side; keys of many fingerprints find theirs by a broadcast (join_facts). A list over the block size goes to pairs of blocks, so that no task gets all of it; lists
    yield forests, never all their pairs.
    """
    triples = index_positions()

    def key(t: tuple[int, ...], k: int):
        value = F.lit(k).cast("long")
        for p in t:
            value = F.shiftleft(value, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)))
        return value

    postings = classes.select("node", "fp", F.explode(F.array(*(key(t, k) for k, t in enumerate(triples)))).alias("key"))
    lists = postings.groupBy("key").count().where("count > 1")
    total = len(triples) * classes.count()
    blocks = F.ceil(F.col("count") / config.block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    parts = join_facts(postings, lists, ["key"], "count", total).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    parts = parts.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, nodes, fps in groups(batches, ("key", "x", "y"), ("node", "fp")):
            a, b = _linked(fps.view(np.uint64), config)
            if a.size:
                yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], names=["a", "b"])

    dealt = parts.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "node")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...], values: tuple[str, ...]) -> Iterator[tuple]:
    """Of batches sorted by the integer columns by: each group's key and its values as arrays. Groups may span batches."""
    held: list[list[np.ndarray]] = []
    last = None
    for batch in batches:
        keys = [batch.column(n).to_numpy() for n in by]
        cols = [batch.column(n).to_numpy() for n in values]
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(new).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(k[a] for k in keys)
            if key != last and held:
                yield (last, *(np.concatenate(c) for c in zip(*held)))
                held = []
            last = key
            held.append([c[a:b] for c in cols])
    if held:
        yield (last, *(np.concatenate(c) for c in zip(*held)))


def near_duplicates(docs: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable by links) of each row of docs (doc_id, text).

    Equal fingerprints are one class before anything is compared, so copies are never paired. Null and empty texts have
    fingerprint zero and link like others. Rows with a null doc_id take part through their class, and have a null
    component_id where no row of their component has an id; rows that repeat a doc_id are texts of their own, which don't link
    by it. Other columns are left out.
    """
    made = stored(fingerprints(docs.select("doc_id", "text"), config).select("doc_id", "fp"), "fingerprints")
    classes = made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("members")).withColumn("node", F.monotonically_increasing_id())
    classes = stored(classes, "classes")
    found = components(link(classes.select("node", "fp"), config))
    grouped = stored(classes.join(found.hint("merge"), "node", "left").withColumn("group", F.coalesce("component", "node")).select("fp", "members", "least", "group"), "grouped")
    firsts = grouped.groupBy("group").agg(F.min("least").alias("component_id"), F.count("*").alias("classes"))
    named = stored(join_facts(grouped, firsts, ["group"], "classes", grouped.count()).select("fp", "members", "component_id"), "named")
    return join_facts(made, named, ["fp"], "members", made.count()).select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
