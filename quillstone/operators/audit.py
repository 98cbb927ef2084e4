"""Audits of pairs (doc_id, original, rewritten): what a rewrite lost, invented, collapsed or inflated, as rows of issues.

Both texts of a pair stand in one row, so every audit is an expression over arrays in that row; nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import text as T
from quillstone.operators import local_score

NUMBER = "[0-9]+(?:[.][0-9]+)?"
#: Terms hold no digits, so that a number that stands right behind one doesn't make it another.
TERM = "[A-Za-z][A-Za-z-]*"
#: A rewrite may grow and shrink so far.
INFLATED, WARNED, LEAST_ORIGINAL, LEAST_MORE, SHRUNK = 1.5, 1.1, 60, 60, 0.4
#: What ends a finished text; what cuts clauses; particles that a cut clause is padded with.
FINISHED = "[。！？；…)\"'’”』】》.!?]$"
CLAUSE_CUT = "[，、；;：:。！？!?\n]+"
PARTICLES = "[吧呢啊嘛呀哦哈呗咯嗯]+$"
#: Blocks of a script, headings, and speakers with their role.
SCENE = "(?m)^[ \t]*【[^】\n]{2,}】"
HEADING = "(?m)^[ \t]{0,3}#{1,6}[ \t]+[^ \t\n]"
ROLE_END = "[（(][^）()\n]{1,14}[）)][ \t]*[:：]"
ROLE = "[一-龥A-Za-z]{1,6}" + ROLE_END
#: Connectives that need one of their partners, and pronouns that can't open a text.
PARTNERS = {
    "其次": ("首先", "再者", "第二", "头一件", "一来"), "再者": ("首先", "第二", "一来"), "另一方面": ("一方面",), "其二": ("其一",), "其三": ("其一", "其二"),
}
OPENING_PRONOUN = "^(?:这|这些|这种|这样|它|它们|他|她|他们|她们|它们|此)"
#: Experience that a rewrite may not add.
EXPERIENCE = (
    "我朋友", "我同事", "我邻居", "我同学", "我师傅", "我领导", "我表哥", "我表弟", "我舅", "我叔", "我姨", "我妈", "我爸", "我哥", "我姐", "我弟", "我妹", "我们公司",
    "我们厂", "我们学校", "我们单位", "我们小区", "有一次我", "有一回我", "去年我", "前年我", "那天我", "当时我", "上回我", "我见过", "我遇到过", "我碰到过", "我曾经",
    "我听人说", "我身边的",
)
#: Concrete and colloquial marks that are only pointed out; what a stub's word can't hold.
SPECIFIC = "去年|上个月|前阵子|那天|我认识|我同事|我家|我朋友|楼下|小区|说白了|讲真|有一说一"
PREDICATE = "[是有着在能会要得让把被和或与及的出现发生变得成为觉得知道]|[哦呵啧呣诶呀嘛呢吧啊嗯这那他她它你我不]"
SENTENCE_CUT = "[。！？!?；;\n]"
#: For languages of Latin script: forms of to be and to have, and whatever isn't all letters, beside the fixed class.
LATIN_PREDICATE = PREDICATE + "|[^A-Za-zÀ-ÿ ]|(?i)(?:^| )(?:is|are|was|were|be|has|had|have|est|sont|était|ont|ist|sind|war|hat|es|son|era|ha|han)(?: |$)"
#: Traces that a rewrite isn't refused for, as they are of its rhythm or follow the original's spacing.
NOT_VETOING = ("even rhythm", "suspect deviation", "mixed spacing")


def _all(column: str, pattern: str) -> Column:
    return F.regexp_extract_all(column, F.lit(pattern), F.lit(0))


def _number_rows() -> Column:
    def rows(v: Column) -> Column:
        times = lambda side, t: F.size(F.filter(side, lambda x: x == t))
        each = F.transform(F.array_distinct(F.concat(v.a, v.b)), lambda t: F.struct(t.alias("token"), times(v.a, t).alias("before"), times(v.b, t).alias("after")))
        bad = F.filter(each, lambda x: (x.after < x.before) | (x.before == 0))
        return F.transform(bad, lambda x: x.withField("kind", F.when(x.after < x.before, "lost").otherwise("invented")))

    return T.let(F.struct(_all("original", NUMBER).alias("a"), _all("rewritten", NUMBER).alias("b")), rows)


def number_fidelity(pairs: DataFrame) -> DataFrame:
    """Numbers that the rewrite has less often than the original (lost), and those that the original has not at all (invented)."""
    return pairs.select("doc_id", F.inline(_number_rows()))


def _lost_terms() -> Column:
    """Terms are put in capitals only where the rewrite lacks some as they are written."""
    upper = lambda terms: F.transform(terms, lambda t: F.upper(t))

    def lost(v: Column) -> Column:
        away = F.array_except(v.a, v.b)
        return F.when(F.size(away) > 0, F.array_except(upper(away), upper(F.array_distinct(v.b)))).otherwise(away)

    return T.let(F.struct(_all("original", TERM).alias("a"), _all("rewritten", TERM).alias("b")), lost)


def term_loss(pairs: DataFrame) -> DataFrame:
    """Terms of the original, in capitals, that the rewrite lacks."""
    return pairs.select("doc_id", F.explode(_lost_terms()).alias("token"))


def _sizes() -> Column:
    def kinds(v: Column) -> Column:
        inflated = (v.before >= LEAST_ORIGINAL) & (v.after > INFLATED * v.before) & (v.after - v.before > LEAST_MORE)
        some = v.text != ""
        found = F.array(F.when(~some, "empty"), F.when(some & ~F.right(v.text, F.lit(1)).rlike(FINISHED), "unfinished"), F.when(some & (v.after < SHRUNK * v.before), "shrunk"), F.when(inflated, "inflated"))
        return F.transform(F.filter(found, lambda k: k.isNotNull()), lambda k: F.struct(v.before.alias("before"), v.after.alias("after"), k.alias("kind")))

    return T.let(F.struct(T.visible_length("original").alias("before"), T.visible_length("rewritten").alias("after"), T.trimmed("rewritten").alias("text")), kinds)


def size_issues(pairs: DataFrame) -> DataFrame:
    """Rewrites that are empty, end in the middle of a sentence, or have shrunk or grown beyond the bounds."""
    return pairs.select("doc_id", F.inline(_sizes()))


def _collapsed(least: int, shortest: int, longest: int) -> Column:
    clauses = lambda c: F.filter(F.transform(F.split(c, CLAUSE_CUT), T.trimmed), lambda p: p != "")

    def rows(v: Column) -> Column:
        padded = lambda c: F.right(c, F.lit(1)).rlike(PARTICLES)
        heads = F.filter(F.transform(v.b, lambda c: F.when(padded(c), F.regexp_replace(c, PARTICLES, "")).otherwise(c)), lambda c: F.length(c).between(shortest, longest))
        hits = lambda gone: F.transform(F.when(F.size(gone) > 0, heads).otherwise(F.slice(heads, 1, 0)), lambda h: F.struct(h.alias("clause"), hit(gone, h).alias("source")))
        gone = F.array_except(F.filter(v.a, lambda c: F.length(c) >= shortest), v.b)
        return T.let(gone, lambda g: F.filter(hits(g), lambda x: x.source.isNotNull()))

    def hit(gone: Column, h: Column) -> Column:
        return F.get(F.filter(gone, lambda s: s.startswith(h) & (F.length(s) - F.length(h) >= least)), F.lit(0))

    return T.let(F.struct(clauses("original").alias("a"), clauses("rewritten").alias("b")), rows)


def collapsed_clauses(pairs: DataFrame, least: int = 2, shortest: int = 4, longest: int = 16) -> DataFrame:
    """Clauses of the rewrite, particles at their ends aside, that are a strict prefix of a clause that the rewrite lost."""
    return pairs.select("doc_id", F.inline(_collapsed(least, shortest, longest)))


def _structure() -> Column:
    def rows(v: Column) -> Column:
        one = lambda kind, b, a, bad: F.when(bad, F.struct(F.lit(kind).alias("kind"), b.alias("before"), a.alias("after")))
        both = F.array(one("scene", v.s0, v.s1, v.s1 < v.s0), one("heading", v.h0, v.h1, v.h1 < v.h0), one("role", v.r0, v.r1, (v.r0 >= 2) & (v.r1 == 0)))
        return F.filter(both, lambda x: x.isNotNull() & (T.trimmed("rewritten") != ""))

    roles = lambda c: F.when(F.col(c).rlike(ROLE_END), T.count(c, ROLE)).otherwise(0)
    counts = [f(c).alias(f"{n}{k}") for n, f in (("s", lambda c: T.count(c, SCENE)), ("h", lambda c: T.count(c, HEADING)), ("r", roles)) for k, c in enumerate(("original", "rewritten"))]
    return T.let(F.struct(*counts), rows)


def structure_loss(pairs: DataFrame) -> DataFrame:
    """Blocks and headings of which fewer are left, and speakers' roles, two or more of which are all gone. Empty rewrites count
    as no loss of structure: they are an issue of size."""
    return pairs.select("doc_id", F.inline(_structure()))


def adjacent_duplicates(sentences: DataFrame) -> DataFrame:
    """Sentences (doc_id, sent_idx, sent) equal to the one before."""
    before = F.lag("sent").over(Window.partitionBy("doc_id").orderBy("sent_idx"))
    return sentences.withColumn("before", before).where("sent = before").select("doc_id", "sent_idx")


def _signals(phrases: tuple[str, ...] = EXPERIENCE) -> Column:
    """Each phrase is looked for where the rewrite holds a character of it; few characters stand for all phrases."""
    common, rest = [], [*phrases]
    while rest:
        common.append(max({c for p in rest for c in p}, key=lambda c: (sum(c in p for p in rest), c)))
        rest = [p for p in rest if common[-1] not in p]
    new = F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains("rewritten", p) & ~F.contains("original", p))
    some = reduce(Column.__or__, (F.contains("rewritten", F.lit(c)) for c in common))
    return F.when(some, F.array_distinct(new)).otherwise(F.array().cast("array<string>"))


def new_signals(pairs: DataFrame, phrases: tuple[str, ...] = EXPERIENCE) -> DataFrame:
    """Phrases that only the rewrite has."""
    return pairs.select("doc_id", F.explode(_signals(phrases)).alias("phrase"))


def _unpaired(partners: dict[str, tuple[str, ...]] = PARTNERS) -> Column:
    found = [F.when(F.contains("rewritten", F.lit(a)) & ~_any(bs), F.lit(a)) for a, bs in partners.items()]
    opening = F.when(T.trimmed("rewritten").rlike(OPENING_PRONOUN), "opening pronoun")
    return F.filter(F.array(*found, opening), lambda x: x.isNotNull())


def unpaired(pairs: DataFrame, partners: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Connectives of the rewrite without a partner, and a pronoun that opens it."""
    return pairs.select("doc_id", F.explode(_unpaired(partners or PARTNERS)).alias("connective"))


def _any(phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains("rewritten", F.lit(p))
    return out


def _stubs(predicate: str) -> Column:
    parts = F.filter(F.transform(F.split("rewritten", SENTENCE_CUT), T.trimmed), lambda s: F.length(s).between(2, 6) & ~s.rlike(predicate))

    def cut(s: Column) -> Column:
        at = F.instr("original", s)
        before, after = F.substring(F.col("original"), at - 1, F.lit(1)), F.substring(F.col("original"), at + F.length(s), F.lit(1))
        whole = ((at == 1) | before.rlike(SENTENCE_CUT)) & ((after == "") | after.rlike(SENTENCE_CUT))
        return (at > 0) & ~whole

    return F.filter(parts, cut)


def deletion_stubs(pairs: DataFrame, predicate: str = PREDICATE) -> DataFrame:
    """Sentences of 2 to 6 characters without a predicate that stand in the original within a longer sentence."""
    return pairs.select("doc_id", F.explode(_stubs(predicate)).alias("stub"))


def added_content(pairs: DataFrame) -> DataFrame:
    """What a rewrite has more of, to be pointed out, not refused: first persons, concrete marks, length."""
    more = lambda p: T.count("rewritten", p) - T.count("original", p)

    def rows(v: Column) -> Column:
        ratio = F.when(v.n > 0, v.m / v.n).otherwise(0.0)
        one = lambda name, holds, n: F.when(holds, F.struct(F.lit(name).alias("signal"), n.cast("int").alias("n")))
        found = F.array(one("first person", v.first >= 3, v.first), one("concrete", v.concrete >= 2, v.concrete), one("longer", (ratio > WARNED) & (ratio <= INFLATED), T.half_up(ratio * 100)))
        return F.filter(found, lambda x: x.isNotNull())

    made = F.struct(more("我").alias("first"), more(SPECIFIC).alias("concrete"), T.visible_length("original").alias("n"), T.visible_length("rewritten").alias("m"))
    return pairs.select("doc_id", F.inline(T.let(made, rows)))


def hard_gate(pairs: DataFrame, marks: local_score.Marks, predicate: str = PREDICATE) -> DataFrame:
    """All that a rewrite is refused for, as rows (doc_id, issue, detail): traces of a fingerprint but those of NOT_VETOING, numbers and
    terms, coherence, added experience, size, stubs, collapsed clauses, lost structure. The audits are one pass over the pairs, the
    fingerprint another."""
    issue = lambda name, detail: F.struct(name.alias("issue"), detail.alias("detail"))
    parts = [
        F.transform(_number_rows(), lambda x: issue(F.concat(F.lit("number "), x.kind), x.token)),
        F.transform(_lost_terms(), lambda t: issue(F.lit("term lost"), t)),
        F.transform(_unpaired(), lambda t: issue(F.lit("unpaired"), t)),
        F.transform(_signals(), lambda t: issue(F.lit("experience added"), t)),
        F.transform(_sizes(), lambda x: issue(x.kind, F.lit(""))),
        F.transform(_stubs(predicate), lambda t: issue(F.lit("stub"), t)),
        F.transform(_structure(), lambda x: issue(F.concat(x.kind, F.lit(" lost")), F.lit(""))),
        F.transform(_collapsed(2, 4, 16), lambda x: issue(F.lit("collapsed"), x.clause)),
    ]
    traces = local_score.fingerprint_issues(pairs.select("doc_id", F.col("rewritten").alias("text")), marks, without=NOT_VETOING)
    return pairs.select("doc_id", F.inline(F.concat(*parts))).unionByName(traces.select("doc_id", F.lit("trace").alias("issue"), F.col("kind").alias("detail")))
