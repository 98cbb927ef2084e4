"""Operator 9: substring dedup by automata of recurring passages.

Anchors (see repeats) tell which passages may recur in other documents. The passages of every document go to the shard of their
anchor. A shard confirms the windows that two of its documents hold, by their words, compiles them into an Aho-Corasick automaton
over words, and then streams the passages of all documents through it, which locates every occurrence and tells the first document
that holds it. What it finds is joined back to the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.llm.common import WORD_BYTES, others, table
from quillstone.llm.repeats import Routing, anchors_of, beside, covered, dealt, lots_of, packed, unplaced


@dataclass(frozen=True)
class PassageConfig:
    """window: words that must recur in a row. k: words of an anchor's k-gram. routing: see repeats."""

    window: int = 13
    k: int = 4
    routing: Routing = field(default_factory=Routing)

    def __post_init__(self) -> None:
        if self.window - self.k > 62:
            raise ValueError("a window may have at most 62 words over k: the marks of an anchor's windows are one long")


class Words:
    """Hashes of words, kept for their repeats."""

    def __init__(self, keep: int = 200_000) -> None:
        self.known, self.keep = {}, keep

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.split()
        if len(self.known) > self.keep:
            self.known = {}
        known = self.known
        for w in {*words}:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


class Phrases:
    """Automaton of the windows that two of the documents of passages (words, doc) hold; each tells the first of those."""

    def __init__(self, passages: list[tuple[bytes, int]], window: int) -> None:
        self.window, self.number = window, {}
        ends: dict[bytes, tuple[int, int]] = {}
        for words, doc in passages:
            lo, hi = ends.get(words, (doc, doc))
            ends[words] = (min(lo, doc), max(hi, doc))
        held: dict[tuple, tuple[int, int]] = {}
        number = self.number
        for words, (lo, hi) in ends.items():
            ids = [number.setdefault(x, len(number) + 1) for x in words.split()]
            for j in range(len(ids) - window + 1):
                key = tuple(ids[j : j + window])
                a, b = held.get(key, (lo, hi))
                held[key] = (a if a < lo else lo, b if b > hi else hi)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, (lo, hi) in held.items():
            if lo < hi:
                self.machine.add_word(key, lo)
        self.some = len(self.machine) > 0
        self.seen: dict[bytes, list[tuple[int, int]]] = {}
        if self.some:
            self.machine.make_automaton()

    def bits(self, words: bytes, doc: int) -> int:
        """A bit for each window of a passage of doc: whether an earlier document holds it."""
        if not self.some:
            return 0
        found = self.seen.get(words)
        if found is None:  # equal passages are streamed once
            number = self.number
            found = self.seen[words] = [*self.machine.iter(tuple([number.get(x, 0) for x in words.split()]))]
        out = 0
        for end, first in found:
            if first < doc:
                out |= 1 << (end - self.window + 1)
        return out


MARKS = "doc long, row long, place long, bits long"


def _located(parts: DataFrame, config: PassageConfig) -> DataFrame:
    """MARKS of dealt stretches: those with windows that an earlier document holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reps, phrases = None, [], None
        out: list[tuple] = []

        def stream(doc: int, row: int, place: int, words: bytes) -> None:
            bits = phrases.bits(words, doc)
            if bits:
                out.append((doc, row, place, bits))

        def confirmed() -> None:
            """Compile the lot's reps, which are documents' passages as well."""
            nonlocal phrases
            phrases = Phrases([(words, doc) for doc, _, _, words in reps], config.window)
            for r in reps:
                stream(*r)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc", "row", "place", "bits"])

        for lot, _, rep, *row in lots_of(batches):
            if lot != now:
                if phrases is None and reps:
                    confirmed()
                now, reps, phrases = lot, [], None
            if rep:
                reps.append(tuple(row))
                continue
            if phrases is None:
                confirmed()
            stream(*row)
            if len(out) > 20_000:
                yield batch_of(out)
                out = []
        if phrases is None and reps:
            confirmed()
        if out:
            yield batch_of(out)

    return parts.mapInArrow(run, MARKS)


def passages(docs: DataFrame, config: PassageConfig = PassageConfig()) -> DataFrame:
    """(doc, row, marks): of documents (doc, text) with windows that an earlier one holds, places and a bit for each such window;
    row is a hash of the text."""
    sample = docs.where(F.pmod(F.xxhash64("doc"), F.lit(config.routing.sample)) == 0)
    every, sampled = (anchors_of(d, Words, config.window, config.k) for d in (docs, sample))
    parts = dealt(docs, every, sampled, "lo < hi", Words, bytes.split, b" ".join, config.window, config.k, config.routing, "NOT rep", first_doc=True)
    return _located(parts, config).groupBy("doc", "row").agg(F.collect_list(F.struct("place", "bits")).alias("marks"))


def dedup(docs: DataFrame, config: PassageConfig = PassageConfig(), whole_texts: bool = True) -> DataFrame:
    """Each row of docs (doc_id, text and others) with n_words, n_removed, kept_words (joined by one space) and clean_text; without
    whole_texts, neither text nor clean_text is made.

    Removed is each word of a window of so many words whose sequence also starts in a document with a smaller doc_id, all
    judged on the input. clean_text has the runs of kept words as they stand in the text, with a line break between runs; a
    text that loses nothing stays as it is. Null text counts as empty and stays null as clean_text. Rows without a doc_id
    neither lose words nor cause losses. Of rows that repeat a doc_id, whatever their texts, neither is earlier than the other, and
    each loses what documents of smaller ids hold. Columns with the new names are replaced, all others pass.
    """
    new = ("n_words", "n_removed", "kept_words", "clean_text")
    kept = [c for c in docs.columns if c not in (*new, "text")]
    marks = passages(docs.select(F.col("doc_id").cast("long").alias("doc"), "text"), config)
    texts = packed(docs.select(F.struct(*others(docs, *new, "text")).alias("_row"), F.col("doc_id").cast("long").alias("doc"), "text", F.col("text").isNull().alias("_null")))
    joined = beside(texts, marks, ["doc", "row"], "left").select("_row", "z", "_null", "marks")
    whole_kinds, counted = (("text", pa.string()), ("clean_text", pa.string())), (("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_words", pa.string()))
    made_kinds = [whole_kinds[0], *counted, whole_kinds[1]] if whole_texts else [*counted]
    kinds = StructType([docs.schema[c] for c in kept])
    for c, t in made_kinds:
        kinds = kinds.add(c, "string" if t == pa.string() else "long")
    word = re.compile(WORD_BYTES)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for text, null, marked in zip(*(batch.column(n).to_pylist() for n in ("z", "_null", "marks"))):
                raw = z.decompress(text)
                words = raw.split()
                whole = raw.decode("utf-8", "replace") if whole_texts and not null else None
                if not marked:
                    own = (len(words), 0, b" ".join(words))
                    rows.append((whole, *own, whole) if whole_texts else own)
                    continue
                starts = [unplaced(m["place"])[0] + j for m in marked for j in range(config.window) if m["bits"] >> j & 1]
                gone = covered(np.array(starts, np.int64), config.window, len(words))
                own = (len(words), int(gone.sum()), b" ".join(x for x, g in zip(words, gone.tolist()) if not g))
                if not whole_texts:
                    rows.append(own)
                    continue
                spans = [m.span() for m in word.finditer(raw)]
                edges = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True])).astype(np.int8)))
                runs = [raw[spans[x][0] : spans[y - 1][1]] for x, y in edges.reshape(-1, 2).tolist()]
                rows.append((whole, *own, b"\n".join(runs).decode("utf-8", "replace")))
            made = [pa.array(c, pa.binary()).cast(t) if n == "kept_words" else pa.array(c, t) for c, (n, t) in zip(zip(*rows) if rows else ((),) * len(made_kinds), made_kinds)]
            yield pa.RecordBatch.from_arrays([*batch.column("_row").flatten(), *made], names=[*kept, *(n for n, _ in made_kinds)])

    return joined.mapInArrow(clean, kinds)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), whole_texts=False)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))
