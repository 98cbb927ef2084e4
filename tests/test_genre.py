"""Genres and signatures of written texts, with what the rules give by hand."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import genre as G
from quillstone.plans import genres as G_plans

DATA = "/root/testdata/sf0.001"

EXPOSITION = "综上所述，研究表明市场正在变化。数据显示，研发投入同比增长，复合增长率提高。首先要完善战略布局，其次要补上人才缺口。"
STORY = "昨天我去了公园，在湖边坐了一会儿。后来下了雨，我跑到车站里躲了半天。他已经走到了路上，从商店里买了伞，又回到了房间里。"
SCRIPT = "【场景：会议室】\n张总（项目经理）：这个季度的指标完成得怎么样了？\n李工（前端）：还差两个用例。"
CHAT = "小明：你去不去？小红：我不去！小明：为什么呀？小红：今天要加班，真的走不开啊！"
REPORT = "公司负责人在发布会上表示：“明年将扩大产能，并在三个城市建设新的研发中心。”这一消息引起了广泛的关注与讨论。"
OFFICIAL = "现将有关工作总结如下。各单位完成了年度任务，提高了效率，推动了改革，落实了责任，各部门认真贯彻要求，狠抓了进度。"
LINK = "接口地址：https://api.example.com/v1?x=1!y 这是一段说明文字，它介绍了怎样调用这个接口以及返回的内容。"


def rows(spark, texts):
    frame = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "id int, text string, genre string")
    return {r.id: r for r in G.genres(frame).collect()}


def test_genres_of_written_texts(spark):
    got = rows(spark, [EXPOSITION, STORY, SCRIPT, CHAT, REPORT, OFFICIAL, LINK])
    assert [(got[k].genre, got[k].rule) for k in range(7)] == [("main", 2), ("narrative", 3), ("dialogue", 1), ("dialogue", 1), ("narrative", 4), ("main", 4), ("narrative", 4)]  # one 了 in 52 characters and no official phrase is a weak story
    assert got[2].evidence["scene_blocks"] > 0 and got[3].evidence["colons"] == 1.0
    assert got[4].evidence["colons"] == 0 and got[6].evidence["colons"] == 0
    assert got[5].genre == "main" and got[5].evidence["official"] >= 0.006
    assert all(0 <= r.confidence <= 1 for r in got.values())


def test_short_null_and_repeated_texts(spark):
    got = rows(spark, [None, "", "好。", "啊" * 29, "！" * 40, CHAT, CHAT])
    assert [(got[k].genre, got[k].rule, got[k].confidence) for k in range(5)] == [("main", 4, 0.3)] * 4 + [("main", 4, 0.35)]
    assert got[5].asDict() | {"id": 0} == got[6].asDict() | {"id": 0}
    assert G.genres(spark.createDataFrame([], "text string")).collect() == []


def test_densities_by_hand(spark):
    text = "阿明：“你好吗”他说。在学校里，我曾去过，去了的话就好。嗯。再见！\"这样的话\"就是这样了，没有别的。"
    r = rows(spark, [text])[0]
    pure = len([c for c in text if "一" <= c <= "龥"])
    assert r.evidence["quotes"] == pytest.approx(1 / pure)
    assert r.evidence["past"] == pytest.approx(3 / pure)  # 曾, 过, and the last 了: not the one before 的话
    assert r.evidence["short"] == pytest.approx(2 / 5)
    assert r.evidence["colons"] == pytest.approx(1 / 5)
    assert r.evidence["scenes"] == pytest.approx(1 / pure)


def test_exposition_and_what_takes_from_it(spark):
    plain = rows(spark, [EXPOSITION, EXPOSITION + "那天早晨的路上，我看到了雪。", EXPOSITION + "“一句话”“两句话”“三句话”"])
    assert plain[0].evidence["exposition"] == pytest.approx(0.55)
    assert plain[1].evidence["exposition"] == pytest.approx(0.55 - 0.35)
    assert plain[2].evidence["exposition"] == pytest.approx(0.55 - 0.2)


def test_dialogue_of_few_colons_only_is_main_in_effect(spark):
    """One colon in ten sentences, none of them short, no quotes and no scene."""
    text = "项目：预算已经批准，可以开始采购设备。" + "这一段说明了采购流程中的各项要求和注意事项。" * 9
    r = rows(spark, [text])[0]
    assert (r.genre, r.effective) == ("dialogue", "main")


@pytest.mark.parametrize("text, want", [("现将情况报告如下", ["official"]), ("本研究提出一种方法，尊敬的各位", ["academic", "speech"]), ("本院认为", ["litigation"]), ("一、内存：不少于8G。二、硬盘：不低于1T", ["specification"]), ("一、二", []), (None, [])])
def test_signatures(spark, text, want):
    assert spark.createDataFrame([(text,)], "text string").select(G.signatures("text").alias("s")).first().s == want


def test_transcripts(spark):
    turns = [(1, 2, "b", "two"), (1, 1, "a", "one"), (1, 3, None, None), (2, 1, "a", None), (2, 1, "a", None)]
    got = {r.conv_id: r.text for r in G.transcripts(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: "a：one\nb：two\n：", 2: "a：\na："}


def test_addresses_cut_no_sentence_and_long_runs_are_read_once(spark):
    from quillstone.functions import text as T

    texts = ["见 http://a.b/c?d=1!e 吧。好！x.y@z.org?再见", "a" * 60_000 + "。" + "b.c_d" * 20_000, "http://a.b?c"]
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.sentences_apart_from_urls("t", "。！？!?").alias("s")).collect()]
    assert got[0] == ["见 http://a.b/c?d=1!e 吧。", "好！", "x.y@z.org?", "再见"] and len(got[1]) == 2 and got[2] == ["http://a.b?c"]


def test_predictions_read_each_text_once(spark):
    found = G_plans.genre_predictions(spark, DATA)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "SortMergeJoin" not in plan
    one = {r.doc_id: r.effective for r in G.genres(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    assert {r.id: r.track for r in found.collect()} == one


ENDS = ("。！？!?…", ".!?;\n", "!+_-")


@pytest.mark.parametrize("ends", ENDS)
def test_sentences_apart_from_addresses_as_character_by_character(spark, ends):
    bits = ["http", "https", "://", "www.", ".", "a", "b-c", "@", "x@y.de", "!", "?", "。", " ", "\n", "…", ":", "é", "漢", "_", "+", "a" * 70]
    r = random.Random(3)
    frame = spark.createDataFrame([("".join(r.choices(bits, k=r.randint(0, 14))),) for _ in range(5000)], "text string")
    ends_class = "".join("\\" + c if c in "-" else c for c in ends)
    assert frame.where(T.sentences_apart_from_urls("text", ends) != by_characters(ends_class)).count() == 0


def by_characters(ends):
    unit = rf"(?:(?>{T.ADDRESS})|[^{ends}])*+"
    parts = F.regexp_extract_all("text", F.lit(f"{unit}[{ends}]+|(?:{unit})$"), F.lit(0))
    return F.filter(F.transform(parts, T.trimmed), lambda s: s != "")


def test_addresses_are_not_looked_for_at_each_character(spark):
    frame = spark.createDataFrame([("The words of a sentence, with marks and no address. " * 1000,)] * 40, "text string").coalesce(1).cache()
    frame.count()

    def seconds(parts):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            frame.select(F.size(parts)).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return min(took)

    assert seconds(T.sentences_apart_from_urls("text", ENDS[0])) < seconds(by_characters(ENDS[0])) / 2


def test_what_is_held_against_two_limits_is_counted_once(spark):
    plan = G.features(spark.createDataFrame([(1, "a")], "id int, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(G.DIALOGUE) == 1 and plan.count(f"{G.OWN_STORY[0]}") == plan.count(f"{G.STRONG[0]}") > 0


def test_texts_without_chinese_are_not_read_by_its_lists(spark):
    for word in (*G.PAST, *G.OFFICIAL.split("|"), *G.STRONG, *G.WEAK, *G.OWN_STORY, *"在到从来去回"):
        assert re.match(G.HAN, word)
    plan = G.features(spark.createDataFrame([(1, "a")], "id int, text string"))._jdf.queryExecution().optimizedPlan().toString()
    guarded = re.findall(r"CASE WHEN _han#\d+ THEN cast\(size\(regexp_extract_all\(_text#\d+, (.*)", plan.replace("CASE", "\nCASE"))
    for pattern in (G.SCENE, G.OFFICIAL, "|".join(G.PAST)):
        assert plan.count(pattern) == sum(pattern in g[:len(pattern) + 40] for g in guarded) == 1


def test_pure_characters_as_character_by_character(spark):
    r = random.Random(4)
    texts = [None, "", *("".join(r.choices("aZ09一龥龦丿é😀 \n。_:", k=r.randint(0, 20))) for _ in range(500)), "é" * 5000 + "a" * 5 + "\n" * 5000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(G.pure(F.col("t")), G.over_five_pure(F.col("t"))).collect()
    counts = [None if t is None else len(re.findall(G.PURE, t)) for t in texts]
    assert [tuple(g) for g in got] == [(n, None if n is None else n > 5) for n in counts]
