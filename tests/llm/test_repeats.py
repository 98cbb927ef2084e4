"""op7 and op9 against brute force: whichever way rows are dealt, on awkward rows, and with hashes that collide."""

from __future__ import annotations

import random
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest

from quillstone.llm import substring_dedup, suffix_dedup
from quillstone.llm.repeats import Routing, Sketch
from tests.llm.test_operators import DOCS, brute_strings, docs, empty, prose, rows  # noqa: F401

#: As shipped; every key cold and split; every key hot; every key hot and dealt window by window, in several salts.
ROUTES = (Routing(), Routing(shard=2, rows=2, most=10**9), Routing(shard=2, sample=1, most=1), Routing(shard=2, hot=1, rows=3, sample=1, most=1))
DATA = Path("/root/testdata/sf0.001/documents.parquet")


def brute_words(texts, window=13):
    """(n_words, n_removed, kept words) of each (doc_id, text)."""
    first = {}
    cut = [(d, (t or "").encode().split()) for d, t in texts]
    for d, words in cut:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if d is not None:
                first[key] = min(d, first.get(key, d))
    out = []
    for d, words in cut:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if d is not None and first[tuple(words[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return sorted(out, key=repr)


def found_words(frame, config=substring_dedup.PassageConfig()):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_words) for r in substring_dedup.dedup(frame, config).collect()), key=repr)


@pytest.mark.parametrize("routing", ROUTES)
def test_suffix_dedup(spark, docs, rows, routing):  # noqa: F811
    config = suffix_dedup.SuffixConfig(length=40, k=10, batch=200, routing=routing)
    frame = docs.unionByName(spark.createDataFrame([rows[1], (None, rows[2][1], "q", "q", 0)], DOCS))
    texts = [r[1] for r in rows] + [rows[1][1], rows[2][1]]
    got = sorted(((r.doc_id if r.doc_id is not None else 99), r.n_bytes, bytes(r.kept)) for r in suffix_dedup.dedup(frame, config).collect())
    assert got == sorted((i, len((t or "").encode()), k) for i, t, k in zip([r[0] for r in rows] + [2, 99], texts, brute_strings(texts, 40)))


@pytest.mark.parametrize("routing", ROUTES)
def test_substring_dedup(spark, docs, rows, routing):  # noqa: F811
    frame = docs.unionByName(spark.createDataFrame([(None, rows[0][1], "q", "q", 0)], DOCS))
    config = substring_dedup.PassageConfig(routing=routing)
    assert found_words(frame, config) == brute_words([r[:2] for r in rows] + [(None, rows[0][1])])
    for r in substring_dedup.dedup(frame, config).collect():
        assert r.clean_text == r.text if not r.n_removed else r.clean_text.split() == r.kept_words.split()
    assert substring_dedup.dedup(empty(spark)).count() == 0 and suffix_dedup.dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("routing", ROUTES)
def test_a_passage_between_different_neighbours(spark, routing):
    shared = prose(1, 20)
    texts = [*enumerate([prose(100 + 2 * i, 15) + " " + shared + " " + prose(101 + 2 * i, 15) for i in range(60)] + [shared] * 2)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert found_words(frame, substring_dedup.PassageConfig(routing=routing)) == brute_words(texts)
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup(frame, suffix_dedup.SuffixConfig(length=40, k=10, batch=200, routing=routing)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_strings([t for _, t in texts], 40)


@pytest.mark.parametrize("routing", ROUTES)
def test_rows_that_share_an_id_but_not_a_text(spark, routing):
    s, x, y = prose(1, 100), prose(2, 30), prose(3, 40)
    texts = [(1, s + " " + x), (2, y + " " + s), (2, "z"), (2, x + " " + y), (3, s + " " + s), (3, s), (3, s), (4, prose(9, 5))]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert found_words(frame, substring_dedup.PassageConfig(routing=routing)) == brute_words(texts)
    config = suffix_dedup.SuffixConfig(length=40, k=10, batch=200, routing=routing)
    got = sorted((r.doc_id, r.n_bytes, bytes(r.kept)) for r in suffix_dedup.dedup(frame, config).collect())
    assert got == sorted((d, len(t), k) for (d, t), k in zip(texts, brute_strings([t for _, t in texts], 40)))


def test_a_row_is_never_held_against_itself(spark):
    """Many texts share a phrase that is too short to count, so that its keys go window by window; two rows have the id 5."""
    letters = random.Random(3)
    some = lambda: "".join(letters.choices("abcdefghijklmnopqrstuvwxyz", k=300))
    phrase = some()[:170]
    rows = [(k, some() + phrase + some()) for k in range(2000)] + [(5, some() + phrase + some())]
    done = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert done.where("n_removed > 0").count() == 0 and done.count() == 2001


@pytest.mark.parametrize("seed", range(3))
def test_repeated_ids_under_small_routing(spark, seed):
    r = random.Random(seed)
    rows = [(r.randrange(25), "".join(r.choice(["abcab", "bca", "cabba", "xyz", "abcabcabc", r.choice("qrstuvw")]) for _ in range(r.randrange(14)))) for _ in range(120)]
    config = suffix_dedup.SuffixConfig(length=9, k=3, batch=200, routing=Routing(shard=5, hot=3, rows=4, sample=1, most=20))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((x.doc_id, x.n_bytes, bytes(x.kept)) for x in suffix_dedup.dedup(frame, config).collect())
    assert got == sorted((d, len(t), k) for (d, t), k in zip(rows, brute_strings([t for _, t in rows], 9)))


def test_lengths_that_places_cannot_hold_are_refused():
    with pytest.raises(ValueError):
        Sketch(350, 50)
    with pytest.raises(ValueError):
        Sketch(5, 6)
    with pytest.raises(ValueError):
        substring_dedup.PassageConfig(window=70, k=4)


def test_columns_of_any_name_pass(spark):
    frame = spark.createDataFrame([(1, prose(1, 30), "p", 2, "q", 5.0)], "doc_id long, text string, `a.b` string, row int, z string, lot double")
    for done in (substring_dedup.dedup(frame), suffix_dedup.dedup(frame)):
        r = done.collect()[0].asDict()
        assert (r["a.b"], r["row"], r["z"], r["lot"]) == ("p", 2, "q", 5.0)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_the_shipped_lengths_on_a_test_table(spark):
    frame = spark.read.parquet(str(DATA)).select("doc_id", "text")
    texts = [(r.doc_id, r.text) for r in frame.collect()]
    assert found_words(frame) == brute_words(texts)
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup(frame).collect()}
    want = brute_strings([t for _, t in texts], 200)
    assert [got[d] for d, _ in texts] == want and any(len(k) < len((t or "").encode()) for k, (_, t) in zip(want, texts))


def test_hashes_that_collide_neither_make_nor_hide_repeats():
    class Colliding:
        def of(self, start, length):
            return np.zeros(np.shape(start), np.uint64)

    data = np.frombuffer(b"abcabdabcxbcabcabd", np.uint8)
    starts = np.arange(data.size - 2)
    order, agrees = suffix_dedup.sort_suffixes(Colliding(), data, starts, np.zeros(starts.size, np.int64), 3)
    cut = [bytes(data[s : s + 3]) for s in starts[order]]
    assert cut == sorted(cut) and agrees.tolist() == [False] + [a == b for a, b in zip(cut, cut[1:])]


def test_lots_tell_stretches_of_one_key_and_context_by_their_bytes(spark):
    """As if their hashes collided: copies of one stretch repeat, the other doesn't."""
    a, b = b"a" * 30 + b"b" * 20, b"c" * 30 + b"d" * 20
    place = (0 << 16) | (11 << 8) | 5
    parts = spark.createDataFrame([(0, 1, True, d, d, place, bytearray(x)) for d, x in ((1, a), (2, b), (3, a))], "lot int, key long, rep boolean, doc long, row long, place long, part binary").coalesce(1)
    got = {r.doc: r.bits for r in suffix_dedup._located(parts, replace(suffix_dedup.SuffixConfig(), length=40)).collect()}
    assert got == {1: None, 3: None}


def test_what_a_task_makes_is_sent_on_by_few_megabytes():
    """A batch of 3,000 texts that share one passage, each asked for all of its anchors: their stretches hold some 25 MB."""
    import pyarrow as pa
    import zstandard

    from quillstone.llm import repeats

    text = prose(8, 600).encode()[:2400]
    config, z = suffix_dedup.SuffixConfig(), zstandard.ZstdCompressor(level=1)
    a = Sketch(config.length, config.k).anchors(suffix_dedup._units(text))
    asked = [{"key": k, "ctx": c, "place": p, "rep": False, "copies": True, "many": False, "spread": 1} for k, c, p in zip(a.key.tolist(), a.ctx.tolist(), repeats.placed(a).tolist())]
    kind = pa.list_(pa.struct([("key", pa.int64()), ("ctx", pa.int64()), ("place", pa.int64()), ("rep", pa.bool_()), ("copies", pa.bool_()), ("many", pa.bool_()), ("spread", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(range(3000), pa.int64()), pa.array([z.compress(text)] * 3000, pa.binary()), pa.array([asked] * 3000, kind)], names=["doc", "row", "z", "asked"])
    made = [*repeats.cut(iter([batch]), lambda: suffix_dedup._units, bytes, bytes, config.length, config.k)]
    assert sum(b.num_rows for b in made) == 3000 * len(asked) and {len(p) for b in made for p in b.column("part").to_pylist()} == set((a.windows + config.length - 1).tolist())
    assert sum(b.nbytes for b in made) > 20_000_000 and max(b.nbytes for b in made) < 4_000_000


@pytest.mark.parametrize("dedup", (suffix_dedup.dedup, substring_dedup.dedup))
def test_packing_is_a_stage_of_its_own(spark, docs, dedup):  # noqa: F811
    done = dedup(docs)
    done.collect()
    assert "BroadcastHashJoin" not in done._jdf.queryExecution().executedPlan().toString()
