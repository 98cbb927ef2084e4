"""The longest stretch that each document shares with one of many items, such as the questions of a benchmark."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class OverlapConfig:
    """least: characters that a shared stretch has at least. gram: characters of what documents and items are matched by first. salts:
    lots that an item's documents are dealt to. broadcast_rows: rows of the items' grams up to which they go to every task; more of
    them are joined by a shuffle."""

    least: int = 24
    gram: int = 16
    salts: int = 64
    broadcast_rows: int = 1_000_000

    def __post_init__(self) -> None:
        if not 0 < self.gram <= self.least:
            raise ValueError("gram must be from 1 to least")


class Automaton:
    """Suffix automaton of a text: each state stands for the strings that end at the same places of it."""

    def __init__(self, text: str) -> None:
        self.to: list[dict[str, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [0]
        last = 0
        for k, c in enumerate(text):
            last = self._grown(last, c, k + 1)

    def _state(self, to: dict[str, int], link: int, length: int, end: int) -> int:
        self.to.append(to)
        self.link.append(link)
        self.length.append(length)
        self.end.append(end)
        return len(self.to) - 1

    def _grown(self, last: int, c: str, end: int) -> int:
        new = self._state({}, 0, self.length[last] + 1, end)
        p = last
        while p >= 0 and c not in self.to[p]:
            self.to[p][c] = new
            p = self.link[p]
        if p < 0:
            return new
        q = self.to[p][c]
        if self.length[p] + 1 != self.length[q]:  # only the shorter strings of q go on by c: they get a state of their own
            q, whole = self._state({**self.to[q]}, self.link[q], self.length[p] + 1, self.end[q]), q
            self.link[whole] = q
            while p >= 0 and self.to[p].get(c) == whole:
                self.to[p][c] = q
                p = self.link[p]
        self.link[new] = q
        return new

    def longest(self, text: str) -> tuple[int, int, int]:
        """Length, start in text and start in the automaton's text of the longest stretch of both: of equally long ones the first of
        text, and its first place here."""
        best, at, own = 0, 0, 0
        state, n = 0, 0
        to, link, length = self.to, self.link, self.length
        for k, c in enumerate(text):
            while state and c not in to[state]:
                state = link[state]
                n = length[state]
            if c in to[state]:
                state = to[state][c]
                n += 1
                if n > best:
                    best, at, own = n, k + 1 - n, self.end[state] - n
        return best, at, own


def _grams(rows: DataFrame, id_: str, gram: int, step: int, name: str) -> DataFrame:
    """(gram, name) of rows (id_, text): hashes of the stretches of gram characters at each step, once each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(id_).to_pylist(), batch.column("text").to_pylist()):
                found = {*(xxhash.xxh64_intdigest(text[k : k + gram].encode("utf-8", "replace")) for k in range(0, len(text) - gram + 1, step))}
                if found:
                    grams = pa.array([h - (1 << 63) for h in found], pa.int64())
                    yield pa.RecordBatch.from_arrays([grams, pa.array([key] * len(found), pa.int64())], names=["gram", name])

    return rows.where("text IS NOT NULL").select(F.col(id_).cast("long").alias(id_), "text").mapInArrow(read, f"gram long, {name} long")


def longest_shared(docs: DataFrame, items: DataFrame, config: OverlapConfig = OverlapConfig()) -> DataFrame:
    """Each row of docs (doc_id, text and others) with item_id, shared (its length), doc_start, item_start and passage: the longest
    stretch that its text and the text of one of items (item_id, text) have in common, if it has config.least characters, else nulls
    and 0. Of equally long ones the smallest item_id counts, then the first place in the document, then in the item.

    A shared stretch of least characters holds a gram that starts at a multiple of least - gram + 1 in the document, and items have
    one at every place, so that documents and items that share a gram are all that need be compared; most share none. Those pairs are
    dealt by item and salt, and each task builds an item's suffix automaton once for the documents that follow it. Null texts share
    nothing; rows that repeat a doc_id are told by a hash of their text; rows of items without an id or text are left out, of those
    that repeat an id each counts. Columns with the new names are replaced.
    """
    new = ("item_id", "shared", "doc_start", "item_start", "passage")
    own = docs.select(*(c for c in docs.columns if c not in new)).withColumn("_key", F.xxhash64("doc_id", "text"))
    keyed = own.select("_key", "text").where("text IS NOT NULL")
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item"))
    item_grams = _grams(items.select("item_id", F.col("item").alias("text")), "item_id", config.gram, 1, "item_id").distinct()
    if item_grams.count() <= config.broadcast_rows:
        item_grams = F.broadcast(item_grams)
    pairs = _grams(keyed, "_key", config.gram, config.least - config.gram + 1, "_key").join(item_grams, "gram").select("_key", "item_id").distinct()
    met = keyed.join(pairs, "_key").dropDuplicates(["_key", "item_id"]).join(items, "item_id")
    met = met.withColumn("_salt", F.pmod("_key", F.lit(config.salts))).repartition("item_id", "_salt").sortWithinPartitions("item_id", "item").drop("_salt")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, automaton = None, None
        for batch in batches:
            rows = []
            for key, item_id, text, now in zip(*(batch.column(c).to_pylist() for c in ("_key", "item_id", "text", "item"))):
                if now != item:
                    item, automaton = now, Automaton(now)
                n, at, there = automaton.longest(text)
                if n >= config.least:
                    rows.append((key, item_id, n, at, there, text[at : at + n]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 6, kinds)], names=["_key", *new])

    found = met.select("_key", "item_id", "text", "item").mapInArrow(compare, "_key long, item_id long, shared long, doc_start long, item_start long, passage string")
    order = F.struct(-F.col("shared"), "item_id", "doc_start", "item_start")
    best = found.groupBy("_key").agg(F.min_by(F.struct(*new), order).alias("_best"))
    out = own.join(best, "_key", "left").select(*(c for c in own.columns if c != "_key"), *(F.col(f"_best.{c}").alias(c) for c in new))
    return out.withColumn("shared", F.coalesce("shared", F.lit(0)).cast("long"))
