"""Longest shared stretches, chunks and budgets against plain versions."""

from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.operators import chunks as C
from quillstone.operators import overlap as O


def plain_longest(text, item):
    """Length and starts by the full table: the longest, then the first of text, then the first of item."""
    best = (0, 0, 0)
    row = [0] * (len(item) + 1)
    for i, x in enumerate(text):
        now = [0] * (len(item) + 1)
        for j, y in enumerate(item):
            if x == y:
                now[j + 1] = row[j] + 1
                best = min(best, (-now[j + 1], i + 1 - now[j + 1], j + 1 - now[j + 1]))
        row = now
    return -best[0], best[1], best[2]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=40), st.text("abc", max_size=40))
def test_automaton_equals_the_table(text, item):
    assert O.Automaton(item).longest(text) == plain_longest(text, item)


def shared_rows(frame):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text or "", r.item_id, r.shared, r.doc_start, r.item_start, r.passage) for r in frame.collect())


@pytest.mark.parametrize("config", [O.OverlapConfig(5, 3), O.OverlapConfig(5, 5), O.OverlapConfig(5, 2, broadcast_rows=0, salts=3), O.OverlapConfig(1, 1)])
def test_longest_shared_equals_all_pairs(spark, config):
    r = random.Random(7)
    some = lambda n: "".join(r.choice(["ab", "c", "de", "漢字", "😀", " "]) for _ in range(n))
    items = [(k % 9, some(12)) for k in range(11)] + [(20, None), (None, some(5)), (21, ""), (22, "x" * 300)]
    docs = [(k % 25, some(r.randrange(30))) for k in range(40)] + [(30, None), (31, ""), (32, "x" * 2000), (None, items[0][1]), (33, items[3][1]), (33, items[3][1])]
    frame = spark.createDataFrame([(d, t, "old") for d, t in docs], "doc_id long, text string, item_id string").repartition(3)
    want = []
    for d, t in docs:
        best = min(((-n, i, a, b) for i, item in items if i is not None and item is not None and t is not None for n, a, b in [plain_longest(t, item)] if n >= config.least), default=None)
        row = (None, 0, None, None, None) if best is None else (best[1], -best[0], best[2], best[3], t[best[2] : best[2] - best[0]])
        want.append((d if d is not None else -1, t or "", *row))
    assert shared_rows(O.longest_shared(frame, spark.createDataFrame(items, "item_id long, text string"), config)) == sorted(want, key=lambda w: (w[0], w[1]))


def test_longest_shared_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "text")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert shared_rows(O.longest_shared(docs, items)) == [(1, "text", None, 0, None, None, None)]
    assert O.longest_shared(docs.limit(0), items).collect() == []
    with pytest.raises(ValueError):
        O.OverlapConfig(4, 5)


PROSE = st.text(st.sampled_from("ab 好。!\n"), max_size=120)


@settings(max_examples=200, deadline=None)
@given(PROSE, st.integers(1, 30))
def test_chunks_hold_the_text_and_their_size(text, size):
    found = C.chunks(text, C.ChunkConfig(size))
    squeezed = lambda s: re.sub(r"\s", "", s)
    assert squeezed("".join(found)) == squeezed(text) and all(c.strip() for c in found)
    for c in found:
        assert len(c) <= size or len(re.findall("[^。！？!?]*[。！？!?]|[^。！？!?]+$", c)) == 1
    for a, b in zip(found, found[1:]):  # no two neighbours that would have fit
        first = re.split("\n\n", b)[0]
        assert len(a) + len(first) > size or len(a) + 2 + len(first) > size


def test_chunks_of_written_texts(spark):
    assert C.chunks("甲甲。乙乙。丙", C.ChunkConfig(5)) == ["甲甲。", "乙乙。丙"]
    assert C.chunks("a\n\nb\n\n\ncc", C.ChunkConfig(4)) == ["a\n\nb", "cc"]
    assert C.chunks("x" * 50, C.ChunkConfig(10)) == ["x" * 50]
    rows = spark.createDataFrame([(1, "a\n\nb", "p"), (2, None, "q"), (3, " \n ", "r"), (1, "a\n\nb", "p")], "id long, text string, piece string")
    got = C.chunk_rows(rows, C.ChunkConfig(2)).collect()
    assert sorted((r.id, r.chunk, r.piece) for r in got) == [(1, 0, "a"), (1, 0, "a"), (1, 1, "b"), (1, 1, "b")]


def test_budget(spark):
    rows = spark.createDataFrame([(1, " 甲乙。丙 丁；戊 "), (2, None), (3, "甲乙丙丁戊己庚"), (4, "甲。"), (5, "a b c d e f!")], "id long, text string")
    got = {r.id: (r.submitted, r.chars, r.truncated) for r in C.within_budget(rows, 6).collect()}
    assert got == {1: ("甲乙。丙 丁；", 7, True), 2: ("", 0, False), 3: ("甲乙丙丁戊己", 7, True), 4: ("甲。", 2, False), 5: ("a b c", 7, True)}
    assert {r.id: r.submitted for r in C.within_budget(rows, 3).collect()}[1] == "甲乙。"
