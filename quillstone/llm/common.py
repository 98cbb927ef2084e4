"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.tables import read_table

#: ASCII white space, as the words of all contracts see it: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
WORD_BYTES = rb"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local tests a folder of this machine."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    place = "file://" + tempfile.mkdtemp(prefix="quillstone-")
    spark.conf.set("spark.checkpoint.dir", place)
    return place


def texts_of(docs: DataFrame) -> DataFrame:
    """docs, whose texts are about to be sent to Python: in batches of few megabytes, whatever their lengths, so that workers
    hold little at a time. The setting is the session's and stays."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return docs


def stored(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage of df by a table in the shared folder, which survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that stored made, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def held_out(ids: Column) -> Column:
    """Rows of the held-out fold: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(ids.cast("string")) % 4 == 2, F.lit(False))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def rows_of(batches: Iterator, *names: str) -> Iterator[tuple]:
    """Of Arrow batches, one at a time, the named columns as Python lists."""
    for batch in batches:
        yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)


def others(df: DataFrame, *names: str) -> list[str]:
    """Columns of df but those named, quoted, so that dots in them are no paths."""
    return [quoted(c) for c in df.columns if c not in names]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Keys at most that a table of hot keys holds, and rows that a key has at least to be one.
HOT_KEYS, HOT_ROWS = 4096, 256


def join_facts(rows: DataFrame, facts: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """rows joined to facts, which has one row for each key and in n how many rows hold it; total: rows there are.

    Keys with over a 4096th of all rows are at most 4096. Those are broadcast, so that their rows stay where they are and no
    task gets all of one key; the others meet in a shuffle, by a hint, as Spark would judge rows made by an explode, or files of
    packed columns, to be small enough for the driver.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot = facts.where(F.col(n) > most)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(facts.where(F.col(n) <= most).hint("merge"), on)
    return rest.unionByName(rows.join(F.broadcast(hot), on))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph, as (node, component): component is the smallest node reachable.

    edges has long columns a and b; null ends are not allowed, loops and repeats are. Alternates large-star and small-star
    rounds (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014), which take O(log^2 n) rounds; each round
    is a written table, so no lineage grows. A star's centre is a node's smallest neighbour, found by an aggregate that
    combines on the map side; nodes with many neighbours take it from a broadcast (join_facts), so that no node's neighbours
    are gathered in one place. Only nodes with an edge are returned. Graphs that need more than max_rounds are refused by an
    error; nothing is left out.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")

    def starred(pairs: DataFrame, total: int) -> DataFrame:
        return join_facts(pairs, pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), ["u"], "n", total).drop("n")

    for _ in range(max_rounds):
        size, centres = now.agg(F.count("*"), F.countDistinct("u")).first()
        if size == centres and now.join(now.select(F.col("v").alias("u")).distinct().hint("merge"), "u", "left_semi").isEmpty():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = starred(both, 2 * size).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = stored(large.distinct(), "large-star")
        star = starred(large, large.count())
        star = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v")))
        now = stored(star.distinct(), "small-star")
    else:
        raise RuntimeError(f"components need more than {max_rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (child, root) that connect 0 to n - 1 as the links a[k] - b[k] do, at most n - 1 of them."""
    label = np.arange(n)
    while a.size:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != label[label]).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]
