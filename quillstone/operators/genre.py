"""Genre of a text: an ordered list of rules over a few densities, with the evidence of each; and signatures of kinds of documents."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T

# What the densities count, and the thresholds of the rules.
DELIMITERS = "。！？!?…"
PURE = "[一-龥A-Za-z0-9]"
#: A Chinese character: each word of the lists below, and each match of PAST, SCENE and OFFICIAL, begins with one.
HAN = "[一-龥]"
QUOTED = ("「[^」]{2,60}」", '"[^"]{2,60}"')
SPEAKER = "^[一-龥A-Za-z0-9_\\- \t\r\n\f\u000b 　（）()【】\\[\\]]{1,24}?[：:]"
SCHEME = r"(?i)\b(?:https?|ftp|mailto|file)://"
#: What stands before a colon that isn't a speaker's: verbs of report, labels of explanations, of rulings and of fields.
LABELS = (
    "表示", "指出", "强调", "认为", "介绍", "宣布", "透露", "补充", "解释", "说明", "总结", "写道", "宣称", "回应", "提醒", "建议",
    "如下", "示例", "例如", "举例", "步骤", "注意", "备注", "附注", "要点", "清单", "用法",
    "上诉请求", "事实和理由", "辩称", "裁判结果", "判决如下", "裁决如下", "原审认定",
    "项目名称", "项目编号", "招标编号", "标的", "工期", "开标时间", "投标文件", "招标文件",
)
SCENE_BLOCK = "【[^】]{0,40}(?:场景|人物|角色|地点|时间|背景)[^】]{0,40}】"
PAST = ("过了", "过", "了", "曾", "曾经", "已经", "方才", "刚刚", "刚才", "此前", "先前", "后来", "之后", "以前", "从前", "去年", "昨天", "前天", "前几日", "上周", "上个月")
PAST_NOT_BEFORE = "的话"
SCENE = (
    "(?:在|到|从|来到|去到|去了|回了)[一-龥A-Za-z0-9]{1,14}?(?:里|外|旁|中|上|下|家|学校|教室|公司|办公室|房间|客厅|卧室|厨房|路上|街|城市|小镇|村庄|国|省|市|区|"
    "机场|车站|码头|医院|商店|餐厅|公园|山|河|海边|森林|草原|沙漠|楼|门|口|前|后|边|处|头|角)"
)
OFFICIAL = "现将|根据[《A-Za-z0-9_]|按照|为了|关于|特此|各单位|各部门|上级部门|认真贯彻|工作目标|工作总结|总结如下|汇报如下|报告如下|主责主业|狠抓|筑牢|下一步|工作总基调|在肯定成绩的同时|清醒地认识到"
STRONG = (
    "综上所述", "基于以上分析", "研究表明", "数据显示", "白皮书显示", "报告显示", "调查数据显示", "调研显示", "统计结果表明", "根据相关调研",
    "占GDP", "万亿元", "百分点", "同比增长", "环比增长", "复合增长率", "研发投入", "战略布局", "国民经济", "核心增长引擎", "人才缺口",
)
WEAK = ("首先", "其次", "再次", "最后", "具体来说", "值得注意的是", "更重要的是", "一方面", "另一方面", "第一", "第二", "第三")
DIALOGUE = "(?md)【场景[：:]?|【[^\n]*?】|(?:^|\n)[^\n]{1,12}（[^\n]{0,12}）[：:]|(?:^|\n)[^\n]{1,12}[总工程前技产品运营]："
SAID = "[“\"「][^」”\"]{2,40}[”\"」][，。！？]?"
OWN_STORY = ("那天", "那年", "周末", "早晨", "中午", "晚上", "路上", "我走进", "我来到", "我选了", "我点了", "我坐", "我看到", "我走到", "临走前", "回到家")
SIGNATURES = {
    "official": "现将|特此|各单位|各部门|上级部门|认真贯彻|工作目标|工作总结|总结如下|汇报如下|报告如下|主责主业|狠抓|筑牢|工作总基调|在肯定成绩的同时|清醒地认识到",
    "academic": "本文档?|本研究|实验结果表明|消融实验|基线模型|提出了?一种|数据集",
    "speech": "尊敬的|各位领导|各位来宾|各位同志|值此|谨代表|预祝|表示衷心的感谢|热烈的欢迎|谢谢大家",
    "litigation": "上诉人|被上诉人|民事判决|劳动争议|诉讼请求|本院认为|判决书|裁定书|起诉状",
}
ITEM_HEAD = "(?:^|[。\n；])[ \t\r\n]*(?:[一二三四五六七八九十]+|[0-9]+)[ \t\r\n]*[、.．][ \t\r\n]*[^ \t\r\n]"
LIMIT = "不(?:少于|低于|高于|超过|小于|大于|足于)"


@dataclass(frozen=True)
class GenreConfig:
    """Thresholds. least_trimmed, least_pure: shorter texts have the main genre. quotes, colons, short, combined: dialogue.
    exposition: exposition. past, scenes, below: narrative. weak_exposition, weak_past, official: what remains."""

    least_trimmed: int = 30
    least_pure: int = 20
    quotes: float = 0.05
    colons: float = 0.06
    short: float = 0.25
    combined: float = 0.28
    exposition: float = 0.55
    past: float = 0.025
    scenes: float = 0.015
    below: float = 0.5
    weak_exposition: float = 0.35
    weak_past: float = 0.012
    official: float = 0.006


def pure(text: Column) -> Column:
    """How many characters of PURE the text holds, by runs of them: a text has far fewer runs than characters."""
    return F.length(F.array_join(F.regexp_extract_all(text, F.lit(PURE + "+"), F.lit(0)), ""))


def over_five_pure(text: Column) -> Column:
    """Whether a text holds more than five characters of PURE; it is read up to the sixth only."""
    others = T.all_but("".join(c for c in map(chr, range(ord("龥") + 1)) if re.match(PURE, c)))
    return text.rlike(f"(?:{PURE}[{others}]*+){{6}}")


def count_where(text: Column, pattern: str, marks: tuple[str, ...]) -> Column:
    """Count of a pattern whose every match holds one of marks: texts without them aren't read by it."""
    return F.when(T.some(text, marks), T.count(text, pattern)).otherwise(0)


def literal_count(text: Column, words: tuple[str, ...]) -> Column:
    """Occurrences of each word, one after the other, added up; a text is only split by the words that it holds."""
    return reduce(lambda a, b: a + b, (F.when(F.contains(text, F.lit(w)), F.size(F.split(text, T.alternation([w], literal=True))) - 1).otherwise(0) for w in words))


def begun(pattern: str, firsts: str) -> str:
    """pattern, of which every match begins with one of firsts, tried at those places alone."""
    return f"(?=[{firsts}])(?:{pattern})"


def exposition(text: Column, han: Column) -> Column:
    """0 to 1: how much a text reads as an exposition, by its markers for a thousand characters, less for dialogue and stories. han:
    whether the text holds a character of HAN; one without holds no word of the lists. Counts that are held against two limits are
    made once."""
    strong, weak, story = (F.when(han, literal_count(text, words)).otherwise(0) for words in (STRONG, WEAK, OWN_STORY))
    per = F.greatest(F.lit(0.4), T.visible_length(text) / 1000)
    dialogue, said = count_where(text, DIALOGUE, ("【", "（", "：")), count_where(text, SAID, ("“", '"', "「"))
    score = F.least(F.lit(0.55), (strong * 0.18 + weak * 0.06) / per)
    score = score - T.let(dialogue, lambda n: F.when(n >= 2, 0.45).when(n == 1, 0.2).otherwise(0.0)) - F.when(said >= 3, 0.2).otherwise(0.0)
    score = score - T.let(story, lambda n: F.when(n >= 3, 0.35).when(n >= 1, 0.1).otherwise(0.0))
    return F.when(F.length(T.trimmed(text)) < 40, 0.0).otherwise(T.clamp(score))


def speaks(sentence: Column) -> Column:
    """Whether a sentence begins with a speaker and a colon; one without a colon isn't looked into."""
    start = F.ltrim(F.regexp_replace(sentence, f"^{T.SPACE_CLASS}+", ""))
    head = T.trimmed(F.regexp_replace(F.regexp_extract(start, SPEAKER, 0), "[：:]$", ""))
    return T.some(sentence, (":", "：")) & start.rlike(SPEAKER) & ~start.rlike(SCHEME) & ~head.rlike(f"(?:{'|'.join(LABELS)})$")


def features(docs: DataFrame) -> DataFrame:
    """docs (text and others) with _text, _pure, _sents, _han and the densities q (quotes), c (colons), h (short sentences), b (scene blocks),
    e (exposition), p (past), s (scenes) and o (official phrases); null counts as empty."""
    df = T.once(docs, _text=F.coalesce("text", F.lit("")))
    df = T.once(df, _pure=pure(F.col("_text")), _sents=T.sentences_apart_from_urls("_text", DELIMITERS), _han=F.col("_text").rlike(HAN))
    t, n, sents = F.col("_text"), F.greatest(F.lit(1), F.col("_pure")), F.greatest(F.lit(1), F.size("_sents"))
    share = lambda f: F.size(F.filter("_sents", f)) / sents
    past = f"(?:{'|'.join(PAST)})(?!{PAST_NOT_BEFORE})"
    in_han = lambda pattern: F.when(F.col("_han"), T.count(t, pattern)).otherwise(0)
    return T.once(
        df,
        q=sum(count_where(t, p, (p[0],)) for p in QUOTED) / n,
        c=share(speaks),
        h=share(lambda s: ~over_five_pure(s) & pure(s).between(1, 5)),
        b=count_where(t, SCENE_BLOCK, ("【",)) / n,
        e=exposition(t, F.col("_han")),
        p=in_han(begun(past, "".join({w[0]: None for w in PAST}))) / n,
        s=in_han(SCENE) / n,
        o=in_han(begun(OFFICIAL, "".join({w[0]: None for w in OFFICIAL.split("|")}))) / n,
    )


def genres(docs: DataFrame, config: GenreConfig = GenreConfig()) -> DataFrame:
    """docs with genre (main, narrative or dialogue), rule (the first that held: 1 dialogue, 2 exposition, 3 narrative, 4 what remains),
    confidence (0 to 1), evidence (the densities by name) and effective, the genre without dialogues that only some colons tell.
    Null and very short texts are main by rule 4."""
    x = config
    df = features(docs)
    q, c, h, b, e, p, s, o = (F.col(k) for k in "qchbepso")
    part = lambda v, full, weight: F.least(F.lit(1.0), v / full) * weight
    df = T.once(df, k=F.least(F.lit(1.0), F.when(b > 0, 0.35).otherwise(0.0) + part(c, x.colons, 0.3) + part(q, x.quotes, 0.25) + part(h, x.short, 0.12)))
    k = F.col("k")
    tiny = (F.length(T.trimmed("_text")) < x.least_trimmed) | (F.col("_pure") < x.least_pure)
    least = F.when(F.length(T.trimmed("_text")) < x.least_trimmed, 0.3).otherwise(0.35)
    dialogue = (b > 0) | (q >= x.quotes) | (c >= x.colons) | (k >= x.combined)
    story = (p >= x.past) & (s >= x.scenes) & (e < x.below)
    falls = (e < x.weak_exposition) & (p >= x.weak_past) & (o < x.official)
    grows = lambda v, base, rate, most: F.least(F.lit(most), (v - base) * rate)
    rules = [
        (tiny, "main", 4, least),
        (dialogue, "dialogue", 1, F.least(F.lit(0.95), F.when(k > 0, 0.45 + k * 0.55).otherwise(0.6))),
        (e >= x.exposition, "main", 2, F.least(F.lit(0.92), 0.5 + (e - x.exposition) * 2 + F.when(p < 0.012, 0.08).otherwise(0.0))),
        (story, "narrative", 3, F.least(F.lit(0.9), 0.35 + grows(p, x.past, 6, 0.25) + grows(s, x.scenes, 8, 0.2) + F.when(q < 0.02, 0.08).otherwise(0.0))),
        (falls, "narrative", 4, F.least(F.lit(0.75), F.greatest(F.lit(0.4), 0.35 + p * 8 + s * 6))),
        (F.lit(True), "main", 4, F.least(F.lit(0.75), F.greatest(F.lit(0.4), 0.35 + e * 0.4))),
    ]
    found = reduce(lambda done, r: done.when(r[0], _verdict(*r[1:])), rules[1:], F.when(rules[0][0], _verdict(*rules[0][1:])))
    df = T.once(df, _found=found)
    only_colons = (F.col("_found.genre") == "dialogue") & (q < 0.002) & (h == 0) & (b == 0) & (c < 0.15)
    names = {"q": "quotes", "c": "colons", "h": "short", "b": "scene_blocks", "e": "exposition", "p": "past", "s": "scenes", "o": "official"}
    evidence = F.create_map(*(x for key, name in names.items() for x in (F.lit(name), F.col(key).cast("double"))))
    new = ("genre", "rule", "confidence", "evidence", "effective")
    kept = [F.col("`" + n.replace("`", "``") + "`") for n in docs.columns if n not in new]
    return df.select(*kept, "_found.genre", "_found.rule", "_found.confidence", evidence.alias("evidence"), F.when(only_colons, "main").otherwise(F.col("_found.genre")).alias("effective"))


def _verdict(genre: str, rule: int, confidence: Column) -> Column:
    return F.struct(F.lit(genre).alias("genre"), F.lit(rule).alias("rule"), confidence.cast("double").alias("confidence"))


def signatures(text: Column | str) -> Column:
    """Which kinds of document a text shows itself to be, of official, academic, speech, litigation and specification (a list with
    limits), as an array; null has none."""
    t = F.coalesce(T.col(text), F.lit(""))
    found = [F.when(t.rlike(p), k) for k, p in SIGNATURES.items()]
    found.append(F.when((T.count(t, ITEM_HEAD) >= 2) & (T.count(t, LIMIT) >= 2), "specification"))
    return F.array_compact(F.array(*found))


def transcripts(turns: DataFrame) -> DataFrame:
    """(conv_id, text) of turns (conv_id, turn, role, text): a line for each turn, its role, a colon and its text; null counts as empty.
    Turns are ordered by turn, then role and text. A conversation is one row, as its text is what is judged."""
    line = F.concat(F.coalesce("role", F.lit("")), F.lit("："), F.coalesce("text", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), line.alias("line"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))
