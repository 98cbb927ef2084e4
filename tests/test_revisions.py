"""Protected stretches, guarded replacement, aligned differences and explanations against plain versions."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.operators import chunks as C
from quillstone.operators import difference as D
from quillstone.operators import protect as P
from quillstone.operators import replace as R
from quillstone.plans import revisions


def table_of_lengths(a, b):
    """A longest common subsequence by the full table: from the ends back, a match first, then one less of a."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif best[i - 1][j] >= best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=60), st.text("abc", max_size=60))
def test_common_is_what_the_full_table_gives(a, b):
    assert D.common(a, b) == table_of_lengths(a, b)


def test_common_of_long_and_repeated_sequences():
    same = ["x"] * 3000
    assert D.common(same, same[:2000]) == [(k + 1000, k) for k in range(2000)]
    r = random.Random(1)
    a, b = ([r.choice("abcdefgh") for _ in range(700)] for _ in range(2))
    assert D.common(a, b) == table_of_lengths(a, b)
    assert D.common([], "abc") == D.common("abc", []) == []


TEXTS = st.text(st.sampled_from("ab 好。!?\n,"), max_size=80)


@settings(max_examples=200, deadline=None)
@given(TEXTS, TEXTS)
def test_both_texts_are_rebuilt_from_the_rows(before, after):
    for rows in (D.sentences_aligned(before, after), D.inline_parts(before, after), D.inline_parts(before, after, most=3), D.trimmed_parts(before, after)):
        assert "".join(r[1] for r in rows) == before and "".join(r[2] for r in rows) == after
        assert all(r[2] == "" if r[0] == "deleted" else r[1] == "" if r[0] == "inserted" else r[1].strip() == r[2].strip() for r in rows)


def test_written_examples():
    rows = D.sentences_aligned("第一句。第二句。第三句。", "第一句。改过的第二句。第三句。")
    assert [r[0] for r in rows] == ["kept", "deleted", "inserted", "kept"]
    assert D.inline_parts("天气非常好。", "天气挺好。") == [("kept", "天气", "天气"), ("deleted", "非常", ""), ("inserted", "", "挺"), ("kept", "好。", "好。")]
    assert D.trimmed_parts("abcXdef", "abcYZdef") == [("kept", "abc", "abc"), ("deleted", "X", ""), ("inserted", "", "YZ"), ("kept", "def", "def")]
    assert D.trimmed_parts("aaa", "aa") == [("kept", "aa", "aa"), ("deleted", "a", "")]
    assert D.units("甲。乙！？\n\n 丙") == ["甲。", "乙！？\n\n", " 丙"]
    assert D.units("") == [] and D.units("。。") == ["。。"]


@pytest.mark.parametrize("n", [1499, 1501, 6000])
def test_characters_are_aligned_whatever_the_length(spark, n):
    """A character changed at both ends of one sentence and in its middle, which is no less a change in a longer one."""
    r = random.Random(n)
    first, second = ("".join(r.choice("abcdefgh ") for _ in range(n // 2)) for _ in range(2))
    before, after = f"X{first}X{second}X", f"Y{first}Y{second}Y"
    one = [("deleted", "X", ""), ("inserted", "", "Y")]
    assert D.inline_parts(before, after) == [*one, ("kept", first, first), *one, ("kept", second, second), *one]
    pairs = spark.createDataFrame([(before, after)], "before string, after string")
    got = D.inline_diff(pairs).select(*D.change_share(F.col("parts")).values()).first()
    assert tuple(got) == (len(first + second), 3, 3, 0)


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=60), st.text("abc", max_size=60), st.text("abc", max_size=20), st.integers(0, 50))
def test_memory_bound_and_common_ends_do_not_change_the_result(a, b, shared, most):
    for x, y in ((a, b), (shared + a, shared + b), (a + shared, b + shared), (shared + a + shared, shared + b + shared)):
        assert D.common(x, y, most) == table_of_lengths(x, y)
    assert D.inline_parts(a, b, most=most) == D.inline_parts(a, b)


def test_diff_of_null_empty_and_repeated_rows(spark):
    rows = [(1, None, None), (2, "", "新的。"), (3, "旧的。", None), (4, "一样。", "一样。"), (4, "一样。", "一样。")]
    pairs = spark.createDataFrame([(*r, "p") for r in rows], "id long, before string, after string, parts string")
    got = D.inline_diff(pairs).select("id", *(c.alias(n) for n, c in D.change_share(F.col("parts")).items())).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0, 0), (2, 0, 0, 3, 0), (3, 0, 3, 0, 100), (4, 3, 0, 0, 0), (4, 3, 0, 0, 0)]
    assert D.sentence_diff(pairs.limit(0)).collect() == []


# --- protected stretches ------------------------------------------------------------------------------------------------


def test_spans_of_each_kind():
    text = "见 https://a.b/c?d=1.2 和 me.x@y.org。读《论语。学而》，跑 `a.b`"
    found = [(k, text[s:e]) for k, s, e in P.find_spans(text)]
    assert found == [("address", "https://a.b/c?d=1.2"), ("address", "me.x@y.org"), ("title", "《论语。学而》"), ("code", "`a.b`")]
    many = " ".join(f"http://site{k}.example/x.y" for k in range(40))
    assert len(P.find_spans(many)) == 40 and P.find_spans("") == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=12), st.integers(-1, 45), st.integers(0, 6))
def test_guard_equals_a_scan(cuts, place, size):
    ends = sorted({*cuts})
    spans = [*zip(ends[::2], ends[1::2])]
    guard = P.Guard(spans)
    assert guard.holds(place) == any(s <= place < e for s, e in spans)
    assert guard.meets(place, place + size) == any(s < place + size and place < e for s, e in spans if size)


def test_range_join_equals_nested_loops(spark):
    r = random.Random(4)
    spans, hits = [], []
    for doc in range(30):
        at = 0
        for _ in range(r.randrange(12)):
            at += r.randrange(1, 9)
            end = at + r.randrange(0, 6)
            spans.append((doc, r.choice("xyz"), at, end))
            at = end
        hits += [(doc, r.choice([None, *range(100)]), k, "old") for k in range(r.randrange(40))]
    hits += [(0, 5, 99, "old")] * 500  # one place in many rows
    got = P.within(spark.createDataFrame(hits, "doc int, start int, n int, kind string"), spark.createDataFrame(spans, "doc int, kind string, start int, end int"), ["doc"])
    want = [(d, s, n, next((k for x, k, a, b in spans if s is not None and x == d and a <= s < b), None)) for d, s, n, _ in hits]
    assert sorted(map(repr, ((x.doc, x.start, x.n, x.kind) for x in got.collect()))) == sorted(map(repr, want))
    assert P.within(spark.createDataFrame(hits, "doc int, start int, n int, kind string"), spark.createDataFrame([], "doc int, kind string, start int, end int"), ["doc"]).where("kind IS NOT NULL").count() == 0


# --- replacement --------------------------------------------------------------------------------------------------------


def plain_sites(text, rules, key, patterns, share):
    """Each place of each rule, by find; then from the left, the longest first."""
    held = [s[1:] for s in P.find_spans(text, patterns)]
    found = []
    for r in rules:
        at = text.find(r.term)
        while at >= 0:
            end = at + len(r.term)
            near = (text[at - 1 : at], text[end : end + 1])
            if not (r.whole and any(c.isalnum() for c in near)) and not any(text[:at].endswith(x) for x in r.not_after) and not any(text[end:].startswith(x) for x in r.not_before):
                if not any(s < end and at < e for s, e in held):
                    found.append((at, -end, r.term))
            at = text.find(r.term, at + 1)
    out, last = [], 0
    for at, minus, term in sorted(found):
        if at >= last:
            out.append((at, -minus, term))
            last = -minus
    assert share == 1
    return out


@pytest.mark.parametrize("seed", range(8))
def test_sites_equal_a_plain_search(seed):
    r = random.Random(seed)
    words = ["非常", "非常好", "好", "常", "very", "very good", "go", "good", "a"]
    rules = [R.Rule(w, ("X", "YY", "好"), tuple(r.sample(["不", "the "], r.randrange(3))), tuple(r.sample(["，", "的", " "], r.randrange(3))), r.random() < 0.5) for w in words]
    ready = R.Rules(rules)
    for _ in range(60):
        text = "".join(r.choice([*words, " ", "，", "的", "不", "the ", "《好", "》", "http://good.a", "😀"]) for _ in range(30))
        got = ready.sites(text, "k")
        assert [s[:3] for s in got] == plain_sites(text, rules, "k", P.PATTERNS, 1)
        parts, at = [], 0
        for start, end, _, instead in got:
            parts += [text[at:start], instead]
            at = end
        assert R.rewritten(text, got) == "".join(parts) + text[at:]


def test_a_change_of_the_table_changes_the_result(spark):
    docs = spark.createDataFrame([(1, "非常好，见《非常》 very http://very.a/very", "x"), (2, None, "y"), (3, "", "z"), (1, "very", "w")], "id long, text string, rewritten string")
    kinds = "term string, instead array<string>, not_before array<string>, whole boolean, note string"
    table = [("非常", ["挺"], None, False, "a"), ("very", ["quite"], ["!"], None, "b"), ("", ["?"], None, None, "c"), (None, ["?"], None, None, "d"), ("no", [], None, None, "e"), ("非常", ["很"], None, False, "f")]
    got = lambda rows: sorted((r.id, r.rewritten, len(r.sites)) for r in R.replace_terms(docs, spark.createDataFrame(rows, kinds), "id").where("text IS NOT NULL").collect())
    assert got(table) == [(1, "quite", 1), (1, "很好，见《非常》 quite http://very.a/very", 2), (3, "", 0)]
    assert got([r if r[0] != "very" else ("very", ["truly"], None, None, "b") for r in table])[0] == (1, "truly", 1)
    assert got([]) == [(1, "very", 0), (1, "非常好，见《非常》 very http://very.a/very", 0), (3, "", 0)]
    null = R.replace_terms(docs, spark.createDataFrame(table, kinds), "id").where("text IS NULL").collect()
    assert [(r.rewritten, r.sites) for r in null] == [(None, [])]


def test_share_and_choice_depend_on_the_site_alone():
    rules = [R.Rule("word", ("one", "two", "three"))]
    text = "word " * 4000
    some = R.Rules(rules, share=0.3).sites(text, "7")
    assert 1000 < len(some) < 1400 and {s[3] for s in some} == {"one", "two", "three"}
    every = {s[0]: s[3] for s in R.Rules(rules).sites(text, "7")}
    assert all(every[s[0]] == s[3] for s in some)
    assert R.Rules(rules, share=0.3).sites(text[:50], "7") == [s for s in some if s[1] <= 50]


def test_tables_over_the_bound_are_refused(spark, monkeypatch):
    monkeypatch.setattr(R, "MOST_RULES", 3)
    with pytest.raises(ValueError):
        R.rules_of(spark.range(5).select(F.col("id").cast("string").alias("term"), F.array(F.lit("x")).alias("instead")))


# --- explanation --------------------------------------------------------------------------------------------------------

RULES = [R.Rule("非常", ("挺",)), R.Rule("具有十分重要的意义", ("很重要",)), R.Rule("重要", ("要紧",))]


@pytest.mark.parametrize(
    "before, after, want",
    [
        ("天气非常好，这具有十分重要的意义。", "天气挺好，这很重要。", [("vocabulary", "具有十分重要的意义", "很重要", True), ("vocabulary", "非常", "挺", True)]),
        ("因此我们走。", "我们走。", [("connector", "因此", "", True)]),
        ("甲。乙丙。", "甲。", [("trim", "乙丙。", "", False)]),
        ("甲。", "甲。说实话，丁。", [("injection", "", "说实话，", True)]),
        ("甲。", "甲。丁（笑）。", [("injection", "", "（笑）", True)]),
        ("甲。", "甲。丁。", [("structure", "", "丁。", False)]),
        ("旧句子。", "新话。", [("structure", "旧句子。", "新话。", False)]),
        ("甲。", "甲。", []),
        ("", "甲。", []),
    ],
)
def test_causes(before, after, want):
    assert D.causes(before, after, RULES, {"connector": ["因此"]}, ["说实话，"], ["（笑）"]) == want


def test_explained_changes_sum_to_all_changes(spark):
    sf = "/root/testdata/sf0.001"
    rows = revisions.explained(spark, sf).select("doc_id", "before", "after", "causes").collect()
    summary = D.explain_summary(revisions.explained(spark, sf), ["doc_id"]).collect()
    assert sum(r.changes for r in summary) == sum(len(r.causes) for r in rows)
    assert {r.cause for r in summary} == {"vocabulary", "injection", "trim", "structure"} and any(r.certain for r in summary)
    assert all((r.before == r.after or not r.before or not r.after) if not r.causes else r.before != r.after for r in rows if r.before.split() != r.after.split())


def test_the_given_tables_hold_protected_marks(spark):
    got = revisions.guarded_cuts(spark, "/root/testdata/sf0.001").agg(F.sum("cuts"), F.sum("in_address")).first()
    assert 0 < got[1] < got[0]


@pytest.mark.parametrize("made", [lambda d: D.sentence_diff(d), lambda d: D.inline_diff(d), lambda d: D.explain(d, [], {}), lambda d: C.chunk_rows(d.withColumnRenamed("before", "text"))])
def test_texts_go_to_python_in_small_batches(spark, made):
    @F.pandas_udf("int")
    def sizes(column: pd.Series) -> pd.Series:
        return pd.Series([len(column)] * len(column))

    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    pairs = spark.range(3000).coalesce(1).select(F.repeat(F.lit("One. Two!\n"), 1000).alias("before"), F.lit("One. Three!").alias("after"))
    assert made(pairs).limit(1).count() == 1
    assert pairs.select(F.max(sizes("before"))).first()[0] <= 1000
