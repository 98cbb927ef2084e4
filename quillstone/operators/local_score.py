"""Local score of a text: stock phrases, traces of clumsy rewriting and the lengths of its sentences; fingerprint issues, radar
features, and predictions by calibration lines.

All is computed in the document's row: nothing is shuffled but by the sums over documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions.lexicon import Lexicon
from quillstone.operators import detector, spans


@dataclass(frozen=True)
class Marks:
    """What the local score looks for. delimiters, stops, commas: members of character classes. tail and particles: alternatives.
    letter: pattern of what a particle stands behind. spaced: patterns of spaces that the language has not. dash, ellipsis: literal."""

    delimiters: str
    stops: str
    commas: str
    phrases: tuple[str, ...]
    broken: tuple[str, ...]
    typos: tuple[str, ...]
    pads: tuple[str, ...]
    more_pads: tuple[str, ...]
    pad_sentences: tuple[str, ...]
    fragments: tuple[str, ...]
    tail: str
    particles: str
    letter: str
    orphans: tuple[str, ...]
    transitions: tuple[str, ...]
    spaced: tuple[str, ...]
    dash: str
    ellipsis: str
    half_comma: str
    full_comma: str


#: Lists whose content decides the local score of Chinese prose.
CHINESE_MARKS = Marks(
    delimiters="。！？!?；;\n",
    stops="。！？",
    commas="，,",
    phrases=(
        "值得注意的是", "综上所述", "在当今社会", "毋庸置疑", "应运而生", "在一定程度上", "至关重要", "随着……的发展", "随着...的发展", "总体而言", "从长远来看",
        "具有十分重要的意义", "发挥着不可替代的作用", "获得感", "为抓手", "为契机", "的背景下", "的重要组成部分", "提供了有力支撑", "注入了新动能", "发挥着重要作用",
        "奠定了坚实基础", "取得了显著成效", "取得了丰硕成果", "取得了阶段性成果", "取得了令人瞩目的成绩", "交出了一份满意的答卷", "实现了历史性跨越", "实现了质的飞跃",
        "实现了跨越式发展", "迈上了新的台阶", "步入了快车道", "按下了快进键", "具有里程碑意义", "具有划时代的意义", "具有十分重要的现实意义", "具有深远的历史意义",
        "发挥了不可替代的作用", "发挥了至关重要的作用", "占据着举足轻重的地位", "扮演着不可或缺的角色", "占有重要的一席之地", "做出了不可磨灭的贡献", "展望未来", "面向未来",
        "前路漫漫亦灿灿", "未来可期", "任重而道远", "前途是光明的道路是曲折的", "让我们一起努力", "让我们携手并进", "共同谱写新篇章", "再创辉煌", "在新时代背景下",
        "在新征程上", "站在新的历史起点上", "面对百年未有之大变局", "面对新形势新挑战", "面对机遇和挑战", "当前，我国正处于", "当前，国内外形势正在发生", "不容忽视的是",
        "尤为关键的是", "尤为重要的是", "关键在于", "重点在于", "本质在于", "根本在于",
    ),
    broken=(
        "搭起弄全", "弄全", "搭起", "垒起", "开花结果", "死磕", "摆平", "捋顺", "兜好", "拔高", "盯紧", "把牢", "兜住", "连上壁垒", "建起", "画圈子", "对哦", "嗯。", "嗨。",
        "咳。", "呣。", "啧。", "嗯哼", "得嘞", "妥妥的", "整挺好", "贼好", "贼快", "贼多", "麻溜", "麻利", "揣着", "不信？那你自己试试就知道了", "那你自己试试就知道了",
        "这事儿还真不是我瞎编",
    ),
    typos=("再去年", "再上个", "是实上", "大这家", "时候候"),
    pads=("说真的", "说实话", "讲真", "要我说", "说白了", "我寻思", "老实讲", "不瞒你说", "你别说", "按我的经验", "反正", "所以说", "总之", "总的来说", "反过来看", "平心而论"),
    more_pads=("其实", "说到底", "具体来说", "换句话说", "简单说", "总体而言", "坦白讲", "客观讲", "往实了说", "话又说回来"),
    pad_sentences=(
        "就这样", "你懂的", "说白了", "讲真", "说真的", "老实讲", "行吧", "好吧", "是啊", "你说得对", "是这个理", "随你怎么说", "反正", "往实了说", "往好听了说", "说难听点",
        "夸张点说", "不瞒你说", "这么说吧", "差不多得了",
    ),
    fragments=(
        "就这样", "怎么说呢", "反正就那样", "你懂的", "没别的意思", "话是这么说", "道理是这个道理", "也不是不行", "差不多得了", "懂的都懂", "你别不信", "这谁说得准呢",
        "也不是没有道理", "行吧", "随你怎么说", "反正我信了", "无话可说", "是啊", "哦对",
    ),
    tail="嗯|啊|哦|嗨|咳|呣|啧|诶|哈",
    particles="嗯|啊|哦|嗨|咳|呣|啧|诶|哈|嗼|呵",
    letter="[一-龥]",
    orphans=(
        "说到底", "具体来说", "总的来说", "换句话说", "简单说", "总体而言", "归根到底", "归根结底", "一言以蔽之", "综上所述", "由此可见", "值得一提的是", "换言之", "简而言之",
        "与此同时", "在此基础上", "从长远来看", "本质上", "核心在于",
    ),
    transitions=("然而", "因此", "此外", "与此同时", "综上所述", "总而言之", "值得注意的是"),
    spaced=("[一-龥，。；：、][ \t]+[A-Za-z0-9]", "[A-Za-z0-9%）)\\]][ \t]+[一-龥]"),
    dash="——",
    ellipsis="……",
    half_comma=",",
    full_comma="，",
)

#: The same for the languages of the test tables; the phrases are common in reports and essays.
LATIN_MARKS = Marks(
    delimiters=".!?;\n",
    stops=".!?",
    commas=",",
    phrases=(
        "it is worth noting", "in conclusion", "in today's world", "plays a crucial role", "plays a vital role", "a testament to", "it is important to note", "when it comes to",
        "il convient de noter", "en conclusion", "joue un rôle", "es ist wichtig", "zusammenfassend", "spielt eine", "cabe destacar", "en conclusión", "juega un papel",
    ),
    broken=("the the ", "and and ", "of of ", " de de ", " der der ", " la la "),
    typos=("recieve", "seperate", "definately", "occured", "teh "),
    pads=("honestly", "frankly", "you know", "actually", "basically", "bref", "enfin", "ehrlich gesagt", "la verdad"),
    more_pads=("in short", "that said", "after all", "en somme", "kurz gesagt", "al fin y al cabo"),
    pad_sentences=("You know", "That's it", "Fair enough", "Bref", "Na ja", "Pues nada"),
    fragments=("You know", "That's it", "Fair enough", "Who knows", "Bref", "Na ja", "Pues nada"),
    tail=" oh| um| uh| hm",
    particles="oh|um|uh|hm",
    letter="[a-zà-ÿ] ",
    orphans=("However", "Moreover", "In conclusion", "In short", "Therefore", "Cependant", "Deshalb", "Sin embargo"),
    transitions=("However", "Moreover", "Therefore", "Furthermore", "In conclusion", "Cependant", "Deshalb", "Sin embargo"),
    spaced=("[a-zà-ÿ] +[,.;:]", "[(] +[A-Za-z0-9]"),
    dash="—",
    ellipsis="...",
    half_comma=" ,",
    full_comma=", ",
)

#: Points and limits of the terms; shares of polluted sentences with their points; bands of the score.
PHRASE, BROKEN, TYPO, STRUCTURE_MOST = (6, 60), (12, 45), (30, 60), 70
TAIL, ORPHAN, PAD_SENTENCE = (12, 2), (16, 3), (12, 3)
POLLUTED = ((0.6, 36), (0.4, 26), (0.25, 16))
LONG_FROM, LONG_SPAN, LONG_MOST, EVEN_STD, EVEN_POINTS = 25, 40, 25, (8.0, 10.5), 8
HUMAN_MOST, CUT_OFF, MACHINE_LEAST, LEAST_APART = 27, 29, 30, 20
#: Fixed values of the fingerprint: least CV and its sentences, suspect deviations and their sentences, share of half commas.
LEAST_CV, SUSPECT_STD, HALF_SHARE = (4, 0.40), (6, 4.5, 8.5), 0.15


def any_literal(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def pad_sentence(m: Marks, word: str) -> str:
    return f"(?:^|[{m.stops}!?\n]{T.SPACE_CLASS}*){re.escape(word)}[{m.stops}]"


def tail_particle(m: Marks) -> str:
    return f"[0-9%．.、，]?(?:{m.tail}){{1,2}}[{m.stops}]"


def orphan(m: Marks) -> str:
    return f"{any_literal(m.orphans)}[{m.stops}]"


def polluted_patterns(m: Marks) -> dict[str, str]:
    """Patterns of a polluted sentence; those named bare are held against it without its stops."""
    pad = any_literal((*m.pads, *m.more_pads))
    return {
        "head": f"^{pad}[{m.commas}]",
        "bare middle": f"^.{{4,}}{pad}[{m.commas}]",
        "stack": f"{pad}[{m.commas}]{T.SPACE_CLASS}*{pad}[{m.commas}]",
        "particle": f"{m.letter}(?:{m.particles})[{m.commas}{m.stops}]",
        "bare fragment": f"^{any_literal(m.fragments)}$",
    }


def _behind(words: Iterable[str], marks: str) -> str:
    """Pattern of one of marks right behind one of words, looked for from the marks on, as a text has few of them. A word that has its
    own look behind is compared at one place."""
    return f"[{marks}](?:" + "|".join(f"(?<={re.escape(w)}[{marks}])" for w in words) + ")"


def _spaced(words: Iterable[str]) -> str:
    """Pattern of any of words, each of which holds a space, looked for from its first space on."""
    parts = ((w, w.partition(" ")[2]) for w in words)
    return " (?:" + "|".join(f"{re.escape(rest)}(?<={re.escape(w)})" for w, rest in parts) + ")"


def _held(text: Column, words: tuple[str, ...]) -> Column:
    """How many of words the text holds. Words with spaces are only looked for one by one in texts that hold any."""
    count = lambda some: reduce(Column.__add__, (F.contains(text, F.lit(w)).cast("int") for w in some), F.lit(0))
    spaced = [w for w in words if " " in w]
    total = count(w for w in words if " " not in w)
    return total + F.when(~text.rlike(_spaced(spaced)), 0).otherwise(count(spaced)) if spaced else total


def _some(text: Column, words: Iterable[str]) -> Column:
    return T.some(text, words)


def _count_where(text: Column, pattern: str, words: Iterable[str]) -> Column:
    """Count of a pattern whose every match holds one of words: texts without them aren't read by it."""
    return F.when(_some(text, words), T.count(text, pattern)).otherwise(0)


def _sentences(docs: DataFrame, m: Marks) -> DataFrame:
    """docs with t, its text, and the number, mean and population deviation of its sentences' lengths, delimiters left out.
    A delimiter within a URL cuts, too."""
    df = T.once(docs, t=F.coalesce("text", F.lit("")))
    df = T.once(df, _lens=F.transform(T.sentences_runs("t", m.delimiters), lambda s: F.length(F.rtrim(s, F.lit(m.delimiters)))))
    return T.once(df, n=F.size("_lens"), avg_len=T.mean(F.col("_lens")), std_len=T.deviation(F.col("_lens"))).drop("_lens")


def polluted_ratio(text: Column, m: Marks) -> Column:
    """Share of a text's sentences that hold pads, stacked or set off by a comma, particles behind a word, or are fragments.

    A sentence is only held against patterns of which the text holds a word, and a text that holds none isn't cut.
    """
    parts = F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"[^{m.stops}\n]*[{m.stops}]|[^{m.stops}\n]+"), F.lit(0)), T.trimmed), lambda s: s != "")
    patterns = polluted_patterns(m)
    pads = (*m.pads, *m.more_pads)
    groups = (
        ([k for k, p in patterns.items() if any_literal(pads) in p], text.rlike(_behind(pads, m.commas))),
        (["particle"], text.rlike(_behind(m.particles.split("|"), m.commas + m.stops))),
        (["bare fragment"], _some(text, m.fragments)),
    )

    def bad(s: Column, held: Column) -> Column:
        plain = F.regexp_replace(s, f"[{m.stops}]+$", "")
        hits = [F.get(held, F.lit(k)) & reduce(Column.__or__, ((plain if n.startswith("bare") else s).rlike(patterns[n]) for n in names)) for k, (names, _) in enumerate(groups)]
        return reduce(Column.__or__, hits)

    share = lambda held: T.let(parts, lambda p: F.when(F.size(p) > 0, F.size(F.filter(p, lambda s: bad(s, held))) / F.size(p)).otherwise(0.0))
    return T.let(F.array(*(some for _, some in groups)), lambda held: F.when(F.array_contains(held, F.lit(True)), share(held)).otherwise(0.0))


def local_score(docs: DataFrame, m: Marks) -> DataFrame:
    """docs (doc_id, text) to (doc_id, sentences, hits, broken, typos, structure, polluted, avg_len, std_len, score, band).

    The score runs from 0 to 100, 0 for a text without sentences. It describes a text and tells nothing of who wrote it.
    """
    df = _sentences(docs, m)
    t = F.col("t")
    before_stop = lambda words: [w + c for w in words for c in m.stops]
    at_most = lambda rule, pattern, words: F.least(F.lit(rule[1]), _count_where(t, pattern, before_stop(words))) * rule[0]
    structure = at_most(TAIL, tail_particle(m), m.tail.split("|")) + at_most(ORPHAN, orphan(m), m.orphans)
    for w in m.pad_sentences:
        structure = structure + at_most(PAD_SENTENCE, pad_sentence(m, w), [w])
    ending = (*m.tail.split("|"), *m.orphans, *m.pad_sentences)  # each trace of structure ends with one of them and a stop
    structure = F.when(t.rlike(_behind(ending, m.stops)), structure).otherwise(0)
    df = T.once(df, hits=_held(t, m.phrases), broken=_held(t, m.broken), typos=T.count_of(t, m.typos), polluted=polluted_ratio(t, m), _structure=structure)
    points = F.lit(0)
    for least, worth in reversed(POLLUTED):
        points = F.when(F.col("polluted") >= least, worth).otherwise(points)
    df = T.once(df, structure=(F.col("_structure") + points).cast("int"))
    capped = lambda c, rule: F.least(F.lit(rule[1]), F.col(c) * rule[0])
    total = capped("hits", PHRASE) + capped("broken", BROKEN) + capped("typos", TYPO) + F.least(F.lit(STRUCTURE_MOST), F.col("structure"))
    total = total + T.clamp((F.col("avg_len") - LONG_FROM) / LONG_SPAN) * LONG_MOST + F.when(F.col("std_len").between(*EVEN_STD), EVEN_POINTS).otherwise(0)
    df = T.once(df, score=F.when(F.col("n") > 0, T.half_up(T.clamp(total, 0, 100)).cast("int")).otherwise(0))
    return df.select("doc_id", F.col("n").alias("sentences"), "hits", "broken", "typos", "structure", "polluted", "avg_len", "std_len", "score", band(F.col("score")).alias("band"))


def band(score: Column) -> Column:
    """Fixed bands: up to the highest score of human samples, from the least of machine ones, and between them by the cut-off."""
    return F.when(score <= HUMAN_MOST, "human").when(score >= MACHINE_LEAST, "machine").otherwise(F.when(score >= CUT_OFF, "grey, machine side").otherwise("grey, human side"))


def fingerprint_issues(docs: DataFrame, m: Marks, without: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kind, n): deterministic traces of a text, a row for each kind found; those of without are not looked for."""
    df = T.once(docs, t=F.coalesce("text", F.lit(""))) if {"even rhythm", "suspect deviation"} <= {*without} else _sentences(docs, m)
    t = F.col("t")
    dash, ellipsis, half, full = (T.occurrences(t, w) for w in (m.dash, m.ellipsis, m.half_comma, m.full_comma))
    cv = lambda: F.round(F.when(F.col("avg_len") > 0, F.col("std_len") / F.col("avg_len")).otherwise(0.0), 2)
    std = lambda: F.round("std_len", 1)
    lead = f"(?:^|[{m.stops}!?\n]{T.SPACE_CLASS}*){any_literal(m.transitions)}"
    half_commas = lambda h, f: F.when((h > 0) & (h / (f + h) > HALF_SHARE), h).otherwise(0)
    kinds = [
        ("mixed spacing", lambda: T.count_of(t, m.spaced), 0),
        *((f"repeated pad {w}", lambda w=w: T.occurrences(t, w + m.full_comma.strip()), 1) for w in m.pads),
        ("dashes", lambda: dash, 1),
        ("ellipses", lambda: ellipsis, 1),
        ("leading transition", lambda: _count_where(t, lead, m.transitions), 0),
        ("stock phrase", lambda: _held(t, m.phrases), 0),
        ("even rhythm", lambda: ((F.col("n") >= LEAST_CV[0]) & (cv() < LEAST_CV[1])).cast("int"), 0),
        ("suspect deviation", lambda: ((F.col("n") >= SUSPECT_STD[0]) & std().between(*SUSPECT_STD[1:])).cast("int"), 0),
        ("half commas", lambda: T.let(F.struct(half.alias("h"), full.alias("f")), lambda x: half_commas(x.h, x.f)), 0),
    ]
    found = F.array(*(F.struct(F.lit(k).alias("kind"), c().cast("int").alias("n"), F.lit(over).alias("over")) for k, c, over in kinds if k not in without))
    df = T.once(df.select("doc_id", found.alias("_f")), _i=F.filter("_f", lambda x: x["n"] > x["over"]))
    return df.select("doc_id", F.explode("_i").alias("_x")).select("doc_id", "_x.kind", "_x.n")


#: Name, low, high and inversion of the radar features that are densities of the document score.
DENSITIES = (
    ("formulaic", 0.0, 1.0, False), ("official", 0.0, 2.0, False), ("skeleton", 0.0, 0.5, False), ("connectives", 0.0, 2.2, False), ("nominal", 0.5, 4.0, False),
    ("personal", 0.15, 1.2, True), ("concrete", 0.2, 1.8, True), ("mixed_spacing", 0.0, 0.6, False), ("idioms", 0.0, 1.2, False),
)
RHYTHM, LONG_SHARE, LONG_SENTENCE, TRIPLE, RHYTHM_LEAST = (0.28, 0.62), (0.05, 0.45), 38, (0.0, 0.6), 0.75


def radar(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and twelve features from 0 to 1. Rhythm goes by the sample deviation of the spans' lengths; one that is suspect
    lifts it to RHYTHM_LEAST at least."""
    df = detector.raw_features(docs, lexicon, [name for name, *_ in DENSITIES])
    df = T.once(df, _spans=F.transform(F.filter(spans.pieces(lexicon), lambda s: spans.worded(s, lexicon)), T.visible_length))
    df = T.once(df, _mean=T.mean(F.col("_spans")), _std=T.deviation(F.col("_spans"), sample=True), _n=F.size("_spans"))
    even = T.norm(F.when(F.col("_mean") > 0, F.col("_std") / F.col("_mean")).otherwise(0.0), *RHYTHM, invert=True)
    suspect = (F.col("_n") >= SUSPECT_STD[0]) & F.col("_std").between(*SUSPECT_STD[1:])
    share = F.when(F.col("_n") > 0, F.size(F.filter("_spans", lambda n: n >= LONG_SENTENCE)) / F.col("_n")).otherwise(0.0)
    made = {
        **{name: T.norm(F.col(f"f_{name}"), low, high, invert) for name, low, high, invert in DENSITIES},
        "rhythm": F.when(suspect, F.greatest(even, F.lit(RHYTHM_LEAST))).otherwise(even),
        "long_share": T.norm(share, *LONG_SHARE),
        "triple": T.norm(T.count("_text", lexicon.triple) * 100 / F.greatest(F.lit(1), F.col("chars")), *TRIPLE),
    }
    return T.once(df, **{f"r_{k}": v for k, v in made.items()}).select("doc_id", *(f"r_{k}" for k in made))


def predicted(scored: DataFrame, lines: DataFrame) -> DataFrame:
    """scored (id, genre, score) with track, percent, label, advice and saturated, by lines (track, a, b, sat), of which there is one
    for each track, a handful: they are broadcast. Genres without a track of their own have the main one."""
    genre = F.col("genre")
    track = F.when(genre.isin("narrative", "dialogue"), genre).when(genre == "humanHand", "human").otherwise("main")
    df = scored.withColumn("track", track).join(F.broadcast(lines), "track")
    df = T.once(df, percent=T.clamp(F.col("a") * F.col("score") + F.col("b"), 0, 100))
    advice = F.lit("rewrite")
    for most, name in ((80, "heavy"), (60, "doubtful"), (40, "fair"), (20, "safe")):
        advice = F.when(F.col("percent") <= most, name).otherwise(advice)
    saturated = F.coalesce(F.col("score") >= F.col("sat"), F.lit(False))
    return df.select("id", "track", "percent", spans.official_label(F.col("percent")).alias("label"), advice.alias("advice"), saturated.alias("saturated"))


def scale_guard(scored: DataFrame) -> DataFrame:
    """scored (kind human or machine, score): the extremes, and whether bands and separation hold."""
    at = lambda f, k: f(F.when(F.col("kind") == k, F.col("score")))
    out = scored.agg(at(F.max, "human").alias("human_most"), at(F.min, "machine").alias("machine_least"), (at(F.avg, "machine") - at(F.avg, "human")).alias("apart"))
    ok = (F.col("human_most") <= HUMAN_MOST) & (F.col("machine_least") >= MACHINE_LEAST) & (F.col("apart") >= LEAST_APART)
    return out.withColumn("ok", ok)


def pollution_sweep(docs: DataFrame, labels: DataFrame, m: Marks, thresholds: tuple[float, ...]) -> DataFrame:
    """Of each threshold, how many documents of either quality have at least such a share of polluted sentences. Flags are counted
    by one aggregate over documents, so that thresholds multiply columns and not rows."""
    rated = T.once(docs, _p=polluted_ratio(F.coalesce("text", F.lit("")), m)).select("doc_id", "_p").join(labels.select("doc_id", "quality"), "doc_id")
    n = lambda x, q: F.count_if((F.col("_p") >= x) & (F.col("quality") == q))
    sums = rated.agg(F.array(*(F.struct(F.lit(x).alias("threshold"), n(x, 1).alias("good"), n(x, 0).alias("bad")) for x in thresholds)).alias("s"))
    return sums.select(F.inline("s"))
