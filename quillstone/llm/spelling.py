"""Operator 12: groups of spelling variants, by errata tries: pairs of words that are one edit apart, and the forms they follow.

In a trie of all words, a pair that is one edit apart parts at one node, with the string u above it: one word goes on by an edge c
and a rest s, the other by another edge. Of a node's edges the one with most words below is heavy, the others are light; a word
has at most log2 of all words light edges above it. A pair parts by one light edge at least, so it is enough to look from words
in light subtrees: their edge replaced (by the heavy one: u a s is a word; by a light one: another light subtree has the same
rest), skipped (u s is a word), or the heavy edge put before it (u a c s is a word). Merging the light subtrees with their first
character replaced or skipped thus costs n log n terminals, the heavy subtrees stay as they are, and coinciding terminals are
the pairs, each found at one node in one way. Subtrees are kept by their terminals: what stands in the merged one is a table of
rests, and the heavy subtree is a table of the words.

On Spark the trie is cut. Nodes with over SpellConfig.most words, few by that bound, make a top that every task knows; its light
subtrees are merged by joins and groups over words and rests, no key of which has more rows than there are letters, or edits of
one word. What hangs below the top has at most so many words under one prefix, and is merged in one task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import stored, table, texts_of

#: Letters of the words: A-Z, a-z and U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"


@dataclass(frozen=True)
class SpellConfig:
    """min_length: code points of a word, at least; min_count: occurrences, at least. ratio: a form occurs at least so many times as
    often. most: words of a subtree that one task merges; it grows where a 4096th of all words is more. held: distinct words that
    a task counts before it sends them."""

    min_length: int = 7
    min_count: int = 2
    ratio: int = 10
    most: int = 5_000
    held: int = 300_000


# --- words --------------------------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame, config: SpellConfig = SpellConfig(), slips: int = 0) -> DataFrame:
    """(word, n) of docs (doc_id, text): distinct words of at least min_length code points with their occurrences, if min_count.

    Words are maximal runs of LETTERS, in which A-Z alone are lower-cased; null texts have none. With slips, one in about so many
    runs loses a code point: those whose CRC-32 h of "<doc_id>:<run>" it divides, at h modulo the length; a null doc_id counts
    as the empty string there. Occurrences are added up in tasks before the shuffle, so no frequent word is hot.
    """
    runs = re.compile(f"[{LETTERS}]{{{config.min_length},}}").findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                lower = text.as_py().encode().lower().decode()  # of bytes, only A-Z are lower-cased
                found = Counter(runs(lower))
                begin = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in found.items():
                    if slips and not (h := zlib.crc32(run.encode(), begin)) % slips:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < config.min_length:
                            continue
                    total[run] = total.get(run, 0) + n
                if len(total) > config.held:
                    yield pa.RecordBatch.from_pydict({"word": [*total], "n": [*total.values()]})
                    total = {}
        yield pa.RecordBatch.from_pydict({"word": pa.array([*total], pa.string()), "n": pa.array([*total.values()], pa.int64())})

    counted = texts_of(docs).where("text IS NOT NULL").select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= config.min_count)


# --- the top of the trie ------------------------------------------------------------------------------------------------


@dataclass
class Node:
    """A node of the top: the string above it, its heavy edge, and by edge those nodes below that are of the top too."""

    prefix: str
    heavy: str = ""
    below: dict[str, int] = field(default_factory=dict)


def shared(a: str, b: str, start: int = 0) -> int:
    """Length of the common prefix of a and b, which have the first start characters in common."""
    end = min(len(a), len(b))
    if a[:end] == b[:end]:
        return end
    while a[start] == b[start]:
        start += 1
    return start


def edges(word: str, top: list[Node]) -> list[tuple[int, str]]:
    """(node, edge) of the nodes of the top that a word passes; the edge is empty where it ends."""
    path, at = [], 0 if top else None
    while at is not None:
        edge = word[len(top[at].prefix) :][:1]
        path.append((at, edge))
        at = top[at].below.get(edge) if edge else None
    return path


def top_of(words: DataFrame, most: int) -> list[Node]:
    """Nodes with over most of the words (word, n) below them that branch. Each round counts the edges below the last nodes, and
    only those that go on to further nodes, or are heavy, reach the driver: as many as all words over most, at most."""
    total, least, last = words.agg(F.count("*"), F.min("word"), F.max("word")).first()
    if total <= most:
        return []
    top = [Node(least[: shared(least, last)])]
    fresh = [0]
    while fresh:
        known, ends = top, {*fresh}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[int, str], list] = {}
            for batch in batches:
                for word in batch.column("word").to_pylist():
                    last_edge = edges(word, known)[-1]
                    if last_edge[0] in ends:
                        one = found.setdefault(last_edge, [0, word, word])
                        one[0] += 1
                        one[1], one[2] = min(one[1], word), max(one[2], word)
            rows = [(*k, *v) for k, v in found.items()]
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 5, kinds)], names=["node", "edge", "n", "least", "last"])

        counted = words.select("word").mapInArrow(count, "node int, edge string, n long, least string, last string")
        counted = stored(counted.groupBy("node", "edge").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("last").alias("last")), "edges")
        for r in counted.groupBy("node").agg(F.max_by("edge", F.struct("n", "edge")).alias("edge")).collect():
            top[r.node].heavy = r.edge
        top, fresh = [*top], []
        for r in counted.where(F.col("n") > most).orderBy("node", "edge").collect():
            top[r.node].below[r.edge] = len(top)
            fresh.append(len(top))
            top.append(Node(r.least[: shared(r.least, r.last)]))
    return top


# --- merging ------------------------------------------------------------------------------------------------------------


def merge(words: list[str], n: list[int]) -> tuple[list[int], list[int | None]]:
    """Of sorted distinct words with occurrences n: how many words are one edit away, and the index of the most frequent of
    them (of equally frequent ones the first). One task's errata trie: nodes are stretches of the sorted words."""
    place = {w: k for k, w in enumerate(words)}
    near, best = [0] * len(words), [None] * len(words)

    def link(i: int, j: int) -> None:
        for a, b in ((i, j), (j, i)):
            near[a] += 1
            c = best[a]
            if c is None or n[b] > n[c] or (n[b] == n[c] and b < c):
                best[a] = b

    nodes = [(0, len(words), 0)]
    while nodes:
        lo, hi, depth = nodes.pop()
        if hi - lo < 2:
            continue
        depth = shared(words[lo], words[hi - 1], depth)
        ends = len(words[lo]) == depth
        at, children = lo + ends, []
        while at < hi:
            start, edge = at, words[at][depth]
            while at < hi and words[at][depth] == edge:
                at += 1
            children.append((start, at))
        nodes += [(a, b, depth + 1) for a, b in children]
        heavy = max(children, key=lambda c: c[1] - c[0])
        above, most = words[lo][:depth], words[heavy[0]][: depth + 1]
        if ends and (other := place.get(most)) is not None:
            link(lo, other)
        rests: dict[str, list[int]] = {}
        for child in children:
            if child is heavy:
                continue
            edge = words[child[0]][depth]
            for k in range(*child):
                rest = words[k][depth + 1 :]
                if (other := place.get(most + rest)) is not None:
                    link(k, other)
                if (other := place.get(most + edge + rest)) is not None:
                    link(k, other)
                if rest[:1] != edge and (other := place.get(above + rest)) is not None:
                    link(k, other)
                same = rests.setdefault(rest, [])
                for other in same:
                    link(k, other)
                same.append(k)
    return near, best


FOUND = "word string, n long, near long, minus long, form string"
_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
_NAMES = ["word", "n", "near", "minus", "form"]


def _below(words: DataFrame, top: list[Node]) -> DataFrame:
    """FOUND of words, by pairs that part below the top: near counts them, form is the most frequent and minus its occurrences, less
    than zero. Each word has a row."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["%d:%s" % path[-1] if (path := edges(w, top)) else "" for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *batch.columns], names=["subtree", "word", "n"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(words: list[str], n: list[int]) -> pa.RecordBatch:
            near, best = merge(words, n)
            best_n = [None if b is None else -n[b] for b in best]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((words, n, near, best_n, [None if b is None else words[b] for b in best]), _KINDS)], names=_NAMES)

        now, words, n = None, [], []
        for batch in batches:
            for subtree, word, k in zip(*(batch.column(c).to_pylist() for c in ("subtree", "word", "n"))):
                if subtree != now and words:
                    yield done(words, n)
                    words, n = [], []
                now = subtree
                words.append(word)
                n.append(k)
        if words:
            yield done(words, n)

    dealt = words.select("word", "n").mapInArrow(grouped, "subtree string, word string, n long") if top else words.select(F.lit("").alias("subtree"), "word", "n")
    return dealt.repartition("subtree").sortWithinPartitions("subtree", "word").mapInArrow(merged, FOUND)


def _across(words: DataFrame, top: list[Node]) -> DataFrame:
    """FOUND by pairs that part at a node of the top; n is null."""

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                for at, edge in edges(word, top):
                    heavy = top[at].heavy
                    if edge == heavy:
                        continue
                    depth = len(top[at].prefix)
                    above, rest = word[:depth], word[depth + 1 :]
                    rows.append((None, above + heavy + edge + rest, word, n))
                    if edge:
                        rows.append((None, above + heavy + rest, word, n))
                        if rest[:1] != edge:
                            rows.append((None, above + rest, word, n))
                        rows.append((at, rest, word, n))
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 4, kinds)], names=["node", "key", "word", "n"])

    made = stored(words.select("word", "n").mapInArrow(edited, "node int, key string, word string, n long"), "edited")
    one, none = F.lit(1).cast("long"), F.lit(None).cast("long")
    pairs = made.where("node IS NULL").join(words.select(F.col("word").alias("key"), F.col("n").alias("other")), "key")
    way = lambda word, form, n: F.struct(F.col(word).alias("word"), none.alias("n"), one.alias("near"), (-F.col(n)).alias("minus"), F.col(form).alias("form"))
    pairs = pairs.select(F.inline(F.array(way("word", "key", "other"), way("key", "word", "n"))))
    # of the light subtrees of one node, words with the same rest: not more than there are letters
    rests = made.where("node IS NOT NULL").groupBy("node", "key").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "word"))).alias("same"))
    rests = rests.where(F.size("same") > 1).select(F.posexplode("same").alias("at", "one"), "same")
    best = F.when(F.col("at") == 0, F.col("same")[1]).otherwise(F.col("same")[0])
    light = rests.select("one.word", none.alias("n"), (F.size("same") - 1).cast("long").alias("near"), best["minus"].alias("minus"), best["word"].alias("form"))
    return pairs.unionByName(light)


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the last of the chain word, its form, that one's form. Rounds double the steps; a form is
    at least ratio times as frequent, so that chains are short and never close."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = stored(now.join(now.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left"), "roots")
        if on.where("further IS NOT NULL").isEmpty():
            return now
        now = on.select("word", F.coalesce("further", "root").alias("root"))


def variants(words: DataFrame, config: SpellConfig = SpellConfig()) -> DataFrame:
    """word, form, root, n, n_near and form_n of the distinct words of words (word, n).

    Near are words that differ by exactly one inserted, deleted or replaced code point; n_near counts them. A word's form is the
    most frequent near word (of equally frequent ones the first in code-point order) if it occurs at least ratio times as often
    as the word, else null; root is where forms lead, the word itself if it has none. Rows that repeat a word are added up, null
    words are left out, as are other columns. Empty tables give none.
    """
    if config.ratio < 2:
        raise ValueError("ratio must be 2 or more, as forms could follow each other in a circle")
    own = stored(words.where("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    top = top_of(own, max(config.most, own.count() // 4096))
    found = _below(own, top)
    if top:
        found = found.unionByName(_across(own, top))
    best = F.when(F.col("form").isNotNull(), F.struct("minus", "form"))
    facts = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min(best).alias("best"))
    follows = -F.col("best.minus") >= config.ratio * F.col("n")
    facts = stored(facts.select("word", "n", "n_near", F.when(follows, F.col("best.form")).alias("form"), F.when(follows, -F.col("best.minus")).alias("form_n")), "forms")
    roots = roots_of(facts.where("form IS NOT NULL"))
    return facts.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), slips=31))
