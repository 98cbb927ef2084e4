"""Document score: sixteen features of a text, their weighted mean, its level; and the risk of each sentence with its reasons."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions.lexicon import Lexicon

#: Levels begin at these probabilities; marks and severities at these risks.
HIGH, MEDIUM = 48, 32
MARKED, SEVERE, MODERATE = 40, 60, 45

#: Name, low, high, inverted, weight of each feature.
FEATURES = (
    ("formulaic", 0.0, 1.0, False, 2.0),
    ("official", 0.0, 2.0, False, 1.4),
    ("sentence_cv", 0.28, 0.62, True, 1.2),
    ("mean_length", 16.0, 42.0, False, 0.7),
    ("bigram_ttr", 0.82, 0.98, True, 0.4),
    ("paragraph_cv", 0.15, 0.7, True, 0.6),
    ("head_repetition", 0.1, 0.55, False, 0.9),
    ("connectives", 0.0, 2.2, False, 1.0),
    ("skeleton", 0.0, 0.5, False, 1.8),
    ("personal", 0.15, 1.2, True, 1.6),
    ("concrete", 0.2, 1.8, True, 1.3),
    ("idioms", 0.0, 1.2, False, 0.7),
    ("nominal", 0.5, 4.0, False, 0.8),
    ("mixed_spacing", 0.0, 0.6, False, 1.2),
    ("modal", 0.3, 2.6, False, 1.2),
    ("mark_variety", 2.0, 7.0, True, 0.3),
)


def _cv(values: Column) -> Column:
    m = T.mean(values)
    return F.when((F.size(values) < 2) | (m == 0), 0.0).otherwise(T.deviation(values) / m)


def _head(sent: Column) -> Column:
    """The first two characters of a sentence, white space and punctuation left out; most are found near its beginning."""
    strip = lambda s: F.regexp_replace(s, f"[{T.SPACES}{T.PUNCTUATION}]+", "")
    return T.let(strip(F.substring(sent, 1, 24)), lambda h: F.substring(F.when(F.length(h) >= 2, h).otherwise(strip(sent)), 1, 2))


def _nominal(lexicon: Lexicon) -> str:
    """Pattern of the suffix of a word of two characters or more; words stand between white space, punctuation and the ends."""
    member = f"[^{T.SPACES}{T.PUNCTUATION}]"
    return f"{lexicon.nominal_suffix.removesuffix('$')}(?!{member})(?<={member}{member})"


def raw_features(docs: DataFrame, lexicon: Lexicon, only: Collection[str] | None = None) -> DataFrame:
    """docs with a column f_<name> for each feature (or those of only), before it is normalised, and chars; densities are hits in 100
    visible characters. Without only, sentences and paragraphs are counted, too.

    All is computed in the row, so nothing is shuffled; the text, its sentences and their lengths are made once. White space but
    line ends is one character first, so that it can be cut out as bytes.
    """
    bare = lambda s: F.replace(s, F.lit(" "), F.lit(""))
    df = T.once(docs, _text=T.trimmed(F.coalesce("text", F.lit(""))))
    df = T.once(df, _lines=F.regexp_replace("_text", f"[{T.SPACES.replace(' ', '').replace(chr(10), '')}]", " "))
    df = T.once(df, _line=F.replace("_lines", F.lit("\n"), F.lit(" ")))
    df = T.once(df, chars=F.length(bare(F.col("_line"))))
    per = lambda n: n * 100 / F.greatest(F.lit(1), F.col("chars"))
    made = {
        "formulaic": per(T.count_of("_text", lexicon.formulaic)),
        "official": per(T.count_of("_text", lexicon.official)),
        "connectives": per(T.count_of("_text", lexicon.connectives)),
        "skeleton": per(T.count_of("_text", lexicon.skeleton)),
        "personal": per(T.count("_text", lexicon.personal)),
        "concrete": per(T.count("_text", lexicon.concrete)),
        "idioms": per(T.count("_text", lexicon.idioms)),
        "nominal": per(T.count("_text", _nominal(lexicon))),
        "mixed_spacing": per(T.count("_text", lexicon.mixed_spacing)),
        "modal": per(T.count("_text", lexicon.modal)),
    }
    if only is not None:
        return T.once(df, **{f"f_{n}": made[n] for n in only})
    parts = F.filter(F.transform(T.pieces("_line", lexicon.delimiters), lambda s: F.trim(s)), lambda s: s.rlike(f"[^{lexicon.delimiters}{lexicon.ignore} ]"))
    df = T.once(df, _sents=parts, _paras=F.filter(F.transform(F.split("_lines", "\n"), lambda p: F.length(bare(p))), lambda n: n > 0))
    df = T.once(df, _lens=F.transform("_sents", lambda s: F.length(bare(s))), _heads=F.filter(F.transform("_sents", _head), lambda h: h != ""))
    made |= {
        "sentence_cv": _cv(F.col("_lens")),
        "mean_length": T.mean(F.col("_lens")),
        "bigram_ttr": T.bigram_variety("_line"),
        "paragraph_cv": _cv(F.col("_paras")),
        "head_repetition": F.when(F.size("_heads") > 0, 1 - F.size(F.array_distinct("_heads")) / F.size("_heads")).otherwise(0.0),
        "mark_variety": T.variety("_text", lexicon.marks).cast("double"),
    }
    return T.once(df, **{f"f_{n}": made[n] for n, *_ in FEATURES}, sentences=F.size("_lens"), paragraphs=F.size("_paras"))


def detect(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs with probability (0 to 100), level, confidence, warnings, chars, sentences, paragraphs and the raw features."""
    df = raw_features(docs, lexicon)
    total = F.lit(0.0)
    for name, low, high, invert, weight in FEATURES:
        value = T.norm(F.col(f"f_{name}"), low, high, invert)
        if name == "paragraph_cv":
            value = F.when(F.col("paragraphs") >= 2, value).otherwise(0.0)
        total = total + value * weight
    df = T.once(df, probability=T.half_up(total / sum(f[4] for f in FEATURES) * 100).cast("int"))
    p = F.col("probability")
    level = F.when(p >= HIGH, "high").when(p >= MEDIUM, "medium").otherwise("human")
    away = F.least(F.abs(p - MEDIUM), F.abs(p - HIGH))
    warnings = F.filter(F.array(F.when(F.col("chars") < 350, "short text"), F.when(F.col("sentences") < 4, "few sentences")), lambda w: w.isNotNull())
    df = df.withColumn("level", level).withColumn("confidence", T.half_up(T.clamp(50 + away * 1.4, 45, 99)).cast("int")).withColumn("warnings", warnings)
    return df.drop("_text", "_lines", "_line", "_sents", "_lens", "_paras", "_heads")


def keep_only_if_lower(pairs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """pairs (before, after, ...) with kept: after where its probability is less than before's, else before."""
    for side in ("before", "after"):
        cols = [c for c in pairs.columns]
        pairs = detect(pairs.withColumn("text", F.col(side)), lexicon).select(*cols, F.col("probability").alias(f"probability_{side}"))
    return pairs.withColumn("kept", F.when(F.col("probability_after") < F.col("probability_before"), F.col("after")).otherwise(F.col("before")))


def sentence_table(docs: DataFrame, lexicon: Lexicon, *keep: str) -> DataFrame:
    """A row for each sentence of each document: the columns keep, sent_idx (from 0) and sent."""
    parts = T.sentences_each(T.trimmed(F.coalesce("text", F.lit(""))), lexicon.delimiters, lexicon.ignore)
    return docs.select(*keep, F.posexplode(parts).alias("sent_idx", "sent"))


#: Points of each rule of a sentence's risk, which begins at 20.
RISK_BASE = 20


def risk_rules(sent: Column, lexicon: Lexicon) -> list[tuple[str, Column, int]]:
    n = T.visible_length(sent)
    return [
        ("formulaic phrase", T.any_of(sent, lexicon.formulaic), 34),
        ("outline head", sent.rlike(f"^{T.alternation(lexicon.skeleton)}"), 30),
        ("connective head", sent.rlike(f"^(?:{lexicon.connective_heads})"), 22),
        ("judgement tail", sent.rlike(lexicon.judgement_tail) & (F.length(sent) > 22), 12),
        ("abstract nouns", sent.rlike(lexicon.abstract) & (F.length(sent) > 25), 10),
        ("mixed spacing", sent.rlike(lexicon.spacing_before), 14),
        ("very long", n >= 38, 12),
        ("row of idioms", sent.rlike(lexicon.long_idioms), 12),
        ("personal view", sent.rlike(lexicon.subjective), -18),
        ("concrete detail", sent.rlike(lexicon.concrete), -12),
        ("short", n <= 10, -14),
        ("question", sent.rlike(lexicon.question), -8),
    ]


def sentence_risk(sentences: DataFrame, lexicon: Lexicon) -> DataFrame:
    """sentences with risk (0 to 100) and reasons, in the order of the rules."""
    found = T.once(sentences, _found=_found(F.col("sent"), lexicon))
    return found.withColumns({"risk": _risk(F.col("_found")), "reasons": F.transform("_found", lambda x: x["name"])}).drop("_found")


def _found(sent: Column, lexicon: Lexicon) -> Column:
    """Rules that hold of a sentence, in order, with their points."""
    return F.filter(F.array(*(F.when(holds, F.struct(F.lit(name).alias("name"), F.lit(points).alias("points"))) for name, holds, points in risk_rules(sent, lexicon))), lambda x: x.isNotNull())


def _risk(found: Column) -> Column:
    return T.clamp(F.aggregate(found, F.lit(RISK_BASE), lambda a, x: a + x.points), 0, 100).cast("int")


def review(docs: DataFrame, lexicon: Lexicon, *keep: str) -> DataFrame:
    """Sentences of a risk worth marking, with their severity."""
    rated = sentence_risk(sentence_table(docs, lexicon, *keep), lexicon).where(F.col("risk") >= MARKED)
    severity = F.when(F.col("risk") >= SEVERE, "high").when(F.col("risk") >= MODERATE, "medium").otherwise("low")
    return rated.withColumn("severity", severity)


def reason_tally(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """How many marked sentences each reason that raises the risk stands beside."""
    raising = [name for name, _, points in risk_rules(F.lit(""), lexicon) if points > 0]
    return review(docs, lexicon, "doc_id").select(F.explode("reasons").alias("reason")).where(F.col("reason").isin(raising)).groupBy("reason").agg(F.count("*").alias("n"))


def top_segments(docs: DataFrame, lexicon: Lexicon, k: int = 8) -> DataFrame:
    """The k sentences of highest risk of each document, ties in order of the text; ranked within the row."""
    parts = T.sentences_each(T.trimmed(F.coalesce("text", F.lit(""))), lexicon.delimiters, lexicon.ignore)
    rated = F.transform(parts, lambda s, i: F.struct((-_risk(_found(s, lexicon))).alias("minus"), i.alias("sent_idx")))
    top = T.once(docs, _top=F.slice(F.sort_array(rated), 1, k))
    return top.select("doc_id", F.posexplode("_top").alias("at", "_s")).select("doc_id", (F.col("at") + 1).alias("rank"), "_s.sent_idx", (-F.col("_s.minus")).alias("risk"))
