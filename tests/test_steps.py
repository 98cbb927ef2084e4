"""Steps that scores and audits share: what is made once, guards that skip a pattern, and odd texts, against plain Python and DuckDB."""

from __future__ import annotations

import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions.lexicon import LATIN
from quillstone.operators import audit as A
from quillstone.operators import detector as D
from quillstone.operators import local_score as L
from quillstone.operators import spans as S
from quillstone.plans.measure import feature_sql

ODD = ["", "-" * 30 + "word one. " + "-" * 30 + "word two. Other.", "😀a😀b😀a", "a", "The statement  of station; nation, tion.", "x\r\n　y  z.\n\n w"]


def test_features_of_odd_texts_equal_their_sql(spark):
    frame = spark.createDataFrame(list(enumerate(ODD)), "doc_id int, text string")
    names = [f"f_{n}" for n, *_ in D.FEATURES]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id INT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(ODD)))
    wanted = con.execute(f"WITH {feature_sql(LATIN, 'documents')} SELECT doc_id, chars, sentences, paragraphs, {', '.join(names)} FROM f ORDER BY doc_id").fetchall()
    found = D.raw_features(frame, LATIN).select("doc_id", "chars", "sentences", "paragraphs", *names).orderBy("doc_id").collect()
    assert [[*r] for r in found] == [pytest.approx([*w]) for w in wanted]


def test_radar_makes_only_its_own_features(spark):
    made = D.raw_features(spark.createDataFrame([(1, "a b.")], "doc_id int, text string"), LATIN, ["idioms"])
    assert [c for c in made.columns if c.startswith("f_")] == ["f_idioms"]


@pytest.mark.parametrize("word", ["the", "é", "aa", "😀"])
def test_occurrences_are_those_of_the_pattern(spark, word):
    texts = [None, "", "aaaaa", "thethe the é", "😀😀 aa 😀"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(T.occurrences("t", word)).collect()] == [None if t is None else t.count(word) for t in texts]


def test_visible_length_of_a_sentence_is_made_once(spark):
    scored = S.scored_spans(spark.createDataFrame([(1, "a b.")], "doc_id int, text string"), LATIN)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1


def polluted(text, m):
    parts = [s for s in (p.strip(T.SPACES) for p in re.findall(f"[^{m.stops}\n]*[{m.stops}]|[^{m.stops}\n]+", text)) if s]
    bad = lambda s: any(re.search(p, re.sub(f"[{m.stops}]+$", "", s) if k.startswith("bare") else s) for k, p in L.polluted_patterns(m).items())
    return sum(map(bad, parts)) / len(parts) if parts else 0.0


@pytest.mark.parametrize("m", [L.LATIN_MARKS, L.CHINESE_MARKS])
def test_polluted_share_equals_plain_python(spark, m):
    stop, comma, pad = m.stops[0], m.commas[0], m.pads[0]
    texts = ["", f"abc{stop}", f"{pad}{comma}abc{stop}abc{stop}", f"abcdef {pad}{comma}x{stop}", f"{pad}{comma} {m.more_pads[0]}{comma}x{stop}b{stop}"]
    texts += [f"abc{stop}{m.fragments[0]}{stop}", f"我x {m.particles.split('|')[0]}{comma}y{stop}z{stop}", f"{pad} {m.fragments[1]}{stop}", f"好{m.particles.split('|')[1]}{stop}好{stop}"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(L.polluted_ratio(frame.t, m)).collect()] == [polluted(t, m) for t in texts]


def test_a_pattern_reads_only_texts_with_one_of_its_words(spark):
    frame = spark.createDataFrame([("aaa",), ("aaab",)], "t string")
    assert [r[0] for r in frame.select(L._count_where(frame.t, "a", ["b"])).collect()] == [0, 3]


def test_words_before_a_mark_are_looked_for_from_the_marks(spark):
    frame = spark.createDataFrame([(1, "a b.")], "doc_id int, text string")
    plan = L.local_score(frame, L.LATIN_MARKS)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"CASE WHEN RLIKE\(t#\d+, \[\.!\?\]\(\?:\(\?<= oh", plan.replace("\\ ", " "))
    assert not re.search(r"Contains\(t#\d+, honestly,\)", plan)


@pytest.mark.parametrize("m", [L.LATIN_MARKS, L.CHINESE_MARKS])
def test_guards_and_held_words_as_plain_python(spark, m):
    r = random.Random(6)
    words = [*m.phrases[:20], *m.broken, *m.pads, *m.orphans, *m.stops, *m.commas, " ", "the ", "the", " de", "de ", "in", "x", "\n", "é", "文"]
    texts = ["", "the the the ", " de de de ", "in in conclusion", *("".join(r.choices(words, k=r.randint(0, 9))) for _ in range(600))]
    t = F.col("t")
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(L._held(t, m.phrases), L._held(t, m.broken), t.rlike(L._behind(m.pads, m.commas)), t.rlike(L._behind(m.orphans, m.stops))).collect()
    held = lambda text, some: sum(w in text for w in some)
    behind = lambda text, some, marks: any(w + c in text for w in some for c in marks)
    assert [tuple(g) for g in got] == [(held(x, m.phrases), held(x, m.broken), behind(x, m.pads, m.commas), behind(x, m.orphans, m.stops)) for x in texts]
    nothing = spark.createDataFrame([(None,)], "t string").select(L._held(t, m.phrases)).first()
    assert nothing[0] is None


@pytest.mark.parametrize("ends", [".!?;\n", "。！？!?；;\n", ".!?"])
def test_runs_of_sentences_as_plain_python(spark, ends):
    r = random.Random(7)
    texts = ["", "\n", "abc\n", "a\r", "".join(ends), *("".join(r.choices([*ends, "ab", " ", "\n", "\r", "\u3000", "é", "文"], k=r.randint(0, 12))) for _ in range(500))]
    got = [g.s for g in spark.createDataFrame([(t,) for t in texts], "t string").select(T.sentences_runs("t", ends).alias("s")).collect()]
    assert got == [[s for s in (p.strip(T.SPACES) for p in re.findall(f"[^{ends}]*[{ends}]+|[^{ends}]+", t)) if s] for t in texts]


def test_traces_that_do_not_veto_are_not_looked_for(spark):
    frame = spark.createDataFrame([(1, "abcdefgh. " * 12)], "doc_id int, text string")
    kinds = lambda **by: {r.kind for r in L.fingerprint_issues(frame, L.LATIN_MARKS, **by).collect()}
    assert "even rhythm" in kinds()
    assert not {*A.NOT_VETOING} & kinds(without=A.NOT_VETOING)


def test_a_rewrite_is_finished_by_its_last_character(spark):
    texts = ["Done.", "Done.\u0085", "Done.\n", "Do.ne", "完。"]
    frame = spark.createDataFrame([(k, t, t) for k, t in enumerate(texts)], "doc_id int, original string, rewritten string")
    assert sorted(r.doc_id for r in A.size_issues(frame).collect() if r.kind == "unfinished") == [1, 3]


def test_roles_terms_clauses_and_experience(spark):
    rows = [
        (1, "Ann(loud): hi. Bob（soft）： no. (x) y", "hi. no."),
        (2, "Alpha beta-x ALPHA gamma", "alpha BETA-X"),
        (3, "the long clause here，and more", "the long吧，and more"),
        (4, "plain", "那天我 plain. 有一次我 plain"),
    ]
    frame = spark.createDataFrame(rows, "doc_id int, original string, rewritten string")
    assert [(r.doc_id, r.kind, r.before) for r in A.structure_loss(frame).collect()] == [(1, "role", 2)]
    assert [r.token for r in A.term_loss(frame).collect() if r.doc_id == 2] == ["GAMMA"]
    assert [(r.clause, r.source) for r in A.collapsed_clauses(frame).collect() if r.doc_id == 3] == [("the long", "the long clause here")]
    assert [r.phrase for r in A.new_signals(frame).collect()] == ["有一次我", "那天我"]


def test_sums_of_long_arrays_are_summed_by_blocks_of_blocks(spark):
    r = random.Random(8)
    arrays = [None, [], [5], *([r.randrange(9) for _ in range(n)] for n in (15, 16, 17, 255, 256, 257, 4097, 70_000))]
    v = spark.createDataFrame([(a,) for a in arrays], "v array<int>")
    wanted = [[*itertools.accumulate(a or [])] for a in arrays]
    assert [g[0] for g in v.select(T.running_sum(F.col("v"))).collect()] == wanted
    assert [g[0] for g in v.where("size(v) < 300").select(T.running_sum(F.col("v"), block=2, levels=2)).collect()] == [w for a, w in zip(arrays, wanted) if a is not None and len(a) < 300]


def test_rows_that_come_twice_are_one_document_in_spans(spark):
    mixed = "The statement of the nation in the station is the element of the treatment. He ate 3 eggs? No. The movement of the moment in the nation and the station is it."
    once = [(1, mixed), (2, "He ate. So?"), (3, ""), (4, None), (None, mixed)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id int, text string")
    found = lambda rows: sorted(map(str, S.top_spans(frame(rows), LATIN).collect()))
    scored = S.scored_spans(frame(once[:1]), LATIN).orderBy("sent_idx").collect()
    runs = [[*g] for k, g in itertools.groupby(scored, lambda x: x.label) if k != "human"]
    got = S.merged_spans(frame(once[:1]), LATIN).orderBy("start").collect()
    assert len(runs) > 1 and [(g.first_idx, g.last_idx, g.start, g.end, g.label) for g in got] == [(x[0].sent_idx, x[-1].sent_idx, x[0].start, x[-1].end, x[0].label) for x in runs]
    assert found(once) == found(once * 2) and len(found(once)) == 2 * len(runs)
