"""The hard gate on pairs whose issues are written by hand, one at least of each kind."""

from __future__ import annotations

import pytest

from quillstone.operators import audit as A
from quillstone.operators import local_score as L

PLAIN = "我们在春天种下了十棵树，夏天的雨水让它们长得很好，到了秋天树上结满了果子。"

CASES = [
    ("增长 12% 了。", "增长 13% 了。", {("number lost", "12"), ("number invented", "13")}),
    ("他用 Spark 写完了这段代码。", "他写完了这段代码。", {("term lost", "SPARK")}),
    (PLAIN, PLAIN + "其次，收成不错。", {("unpaired", "其次")}),
    (PLAIN, "它" + PLAIN, {("unpaired", "opening pronoun")}),
    (PLAIN, PLAIN + "我朋友说味道好。", {("experience added", "我朋友")}),
    (PLAIN, "", {("empty", "")}),
    (PLAIN, PLAIN[:6] + "。", {("shrunk", "")}),
    (PLAIN, PLAIN[:-1], {("unfinished", "")}),
    ("# 标题\n" + PLAIN, PLAIN, {("heading lost", "")}),
    ("【场景：院子】\n" + PLAIN, PLAIN, {("scene lost", "")}),
    (PLAIN, PLAIN + "——结果——很好。", {("trace", "dashes")}),
    (PLAIN, "因此" + PLAIN, {("trace", "leading transition")}),
    ("数据安全治理体系建设是重点。", "数据安全。治理体系建设是重点。", {("stub", "数据安全")}),
    (PLAIN, PLAIN, set()),
]


@pytest.fixture(scope="module")
def issues(spark):
    frame = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(CASES)], "doc_id int, original string, rewritten string")
    found: dict[int, set] = {}
    for r in A.hard_gate(frame, L.CHINESE_MARKS).collect():
        found.setdefault(r.doc_id, set()).add((r.issue, r.detail))
    return found


@pytest.mark.parametrize("case", range(len(CASES)))
def test_each_issue_is_found(issues, case):
    wanted = CASES[case][2]
    got = issues.get(case, set())
    assert wanted <= got if wanted else not got, got


def test_rhythm_and_spacing_do_not_veto(spark):
    even = "一二三四五六七八。" * 12
    frame = spark.createDataFrame([(1, even + " AI 好。", even + " AI 好。")], "doc_id int, original string, rewritten string")
    kinds = {r.kind for r in L.fingerprint_issues(frame.selectExpr("doc_id", "rewritten AS text"), L.CHINESE_MARKS).collect()}
    assert {"even rhythm", "mixed spacing"} & kinds
    assert not {r.detail for r in A.hard_gate(frame, L.CHINESE_MARKS).collect()} & set(A.NOT_VETOING)


def test_latin_predicates_and_nothing_but_letters_are_no_stubs(spark):
    rows = [(1, "the old word here; x", "word\nit is\n4 2 x\nx")]
    frame = spark.createDataFrame(rows, "doc_id int, original string, rewritten string")
    assert [r.stub for r in A.deletion_stubs(frame, A.LATIN_PREDICATE).collect()] == ["word"]
