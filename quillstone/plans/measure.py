"""Queries of the measures and scores, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions.lexicon import CHINESE, LATIN, Lexicon
from quillstone.operators import detector as D
from quillstone.operators import spans as S
from quillstone.plans.fixtures import sql_table, table_of
from quillstone.sources.tables import read_table

W = T.SPACE_CLASS


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", ("doc_id", "text"))


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def n_of(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {lit(pattern)}))"


def n_sum(expr: str, patterns: tuple[str, ...]) -> str:
    return "(" + " + ".join(n_of(expr, p) for p in patterns) + ")"


def has(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {lit(pattern)})"


def bare(expr: str) -> str:
    return f"regexp_replace({expr}, {lit(W)}, '', 'g')"


def trim(expr: str) -> str:
    return f"regexp_replace({expr}, {lit(f'^{W}+|{W}+$')}, '', 'g')"


def split_each(expr: str, x: Lexicon) -> str:
    flat = f"regexp_replace({expr}, {lit(W + '+')}, ' ', 'g')"
    d = x.delimiters
    parts = f"regexp_extract_all({flat}, {lit(f'[^{d}]*[{d}]|[^{d}]+$')})"
    return f"list_filter(list_transform({parts}, lambda s: trim(s, ' ')), lambda s: regexp_replace(s, {lit(f'[{d}{x.ignore} ]')}, '', 'g') <> '')"


def base_sql(x: Lexicon, source: str) -> str:
    """Sentences of each document: table s (doc_id, sent_idx, sent)."""
    return f"""
t AS (SELECT doc_id, {trim("coalesce(text, '')")} AS t FROM {source}),
p AS (SELECT doc_id, t, {split_each('t', x)} AS sents FROM t),
s AS (SELECT doc_id, unnest(range(0, len(sents))) AS sent_idx, unnest(sents) AS sent FROM p)"""


def feature_sql(x: Lexicon, source: str) -> str:
    per = lambda n: f"({n}) * 100.0::DOUBLE / greatest(1, chars)"
    cv = lambda c: f"CASE WHEN len({c}) < 2 OR list_avg({c}) = 0 THEN 0.0::DOUBLE ELSE list_stddev_pop({c}) / list_avg({c}) END"
    words = f"list_filter(regexp_split_to_array(t, {lit(f'(?:{W}|' + chr(92) + 'p{P})')}), lambda w: length(w) >= 2 AND {has('w', x.nominal_suffix)})"
    return f"""{base_sql(x, source)},
g AS (
  SELECT doc_id, t, sents, list_transform(sents, lambda s: length({bare('s')})) AS lens, length({bare('t')}) AS chars,
         list_transform(list_filter(list_transform(string_split(t, chr(10)), lambda q: {trim('q')}), lambda q: q <> ''), lambda q: length({bare('q')})) AS paras,
         regexp_replace({bare('t')}, '\\p{{P}}', '', 'g') AS plain,
         list_filter(list_transform(sents, lambda s: substring(regexp_replace({bare('s')}, '\\p{{P}}', '', 'g'), 1, 2)), lambda h: h <> '') AS heads FROM p),
b AS (SELECT *, list_transform(range(1, length(plain)), lambda i: substring(plain, i, 2)) AS bg FROM g),
f AS (
  SELECT doc_id, chars, len(sents) AS sentences, len(paras) AS paragraphs,
    {per(n_sum('t', x.formulaic))} AS f_formulaic, {per(n_sum('t', x.official))} AS f_official,
    {cv('lens')} AS f_sentence_cv, coalesce(list_avg(lens), 0.0) AS f_mean_length,
    CASE WHEN len(bg) > 0 THEN len(list_distinct(bg))::DOUBLE / len(bg) ELSE 0.0 END AS f_bigram_ttr, {cv('paras')} AS f_paragraph_cv,
    CASE WHEN len(heads) > 0 THEN 1 - len(list_distinct(heads))::DOUBLE / len(heads) ELSE 0.0 END AS f_head_repetition,
    {per(n_sum('t', x.connectives))} AS f_connectives, {per(n_sum('t', x.skeleton))} AS f_skeleton,
    {per(n_of('t', x.personal))} AS f_personal, {per(n_of('t', x.concrete))} AS f_concrete, {per(n_of('t', x.idioms))} AS f_idioms,
    {per(f'len({words})')} AS f_nominal, {per(n_of('t', x.mixed_spacing))} AS f_mixed_spacing, {per(n_of('t', x.modal))} AS f_modal,
    len(list_distinct(regexp_extract_all(t, {lit(x.marks)})))::DOUBLE AS f_mark_variety FROM b),
v AS (
  SELECT *, CAST(floor(({' + '.join(_value(*f) for f in D.FEATURES)}) / {sum(f[4] for f in D.FEATURES)!r}::DOUBLE * 100 + 0.5) AS INT) AS probability FROM f)"""


def _value(name: str, low: float, high: float, invert: bool, weight: float) -> str:
    r = f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, (f_{name} - {low!r}::DOUBLE) / ({high!r}::DOUBLE - {low!r}::DOUBLE)))"
    r = f"(1 - {r})" if invert else r
    if name == "paragraph_cv":
        r = f"CASE WHEN paragraphs >= 2 THEN {r} ELSE 0.0::DOUBLE END"
    return f"({r}) * {weight!r}::DOUBLE"


def points_sql(rules: list[tuple[str, str, int]], base: int) -> str:
    return f"CAST(least(100, greatest(0, {base} + " + " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for _, c, n in rules) + ")) AS INT)"


def risk_sql(x: Lexicon) -> list[tuple[str, str, int]]:
    n = f"length({bare('sent')})"
    return [
        ("formulaic phrase", has("sent", "|".join(x.formulaic)), 34),
        ("outline head", has("sent", f"^(?:{'|'.join(x.skeleton)})"), 30),
        ("connective head", has("sent", f"^(?:{x.connective_heads})"), 22),
        ("judgement tail", f"{has('sent', x.judgement_tail)} AND length(sent) > 22", 12),
        ("abstract nouns", f"{has('sent', x.abstract)} AND length(sent) > 25", 10),
        ("mixed spacing", has("sent", x.spacing_before), 14),
        ("very long", f"{n} >= 38", 12),
        ("row of idioms", has("sent", x.long_idioms), 12),
        ("personal view", has("sent", x.subjective), -18),
        ("concrete detail", has("sent", x.concrete), -12),
        ("short", f"{n} <= 10", -14),
        ("question", has("sent", x.question), -8),
    ]


def spans_sql(x: Lexicon, source: str) -> str:
    d, n = x.span_delimiters, f"length({bare('sent')})"
    vague = has("sent", x.vague)
    rules = [
        ("", has("sent", "|".join(x.formulaic)), 30),
        ("", has("sent", "|".join(x.official)), 16),
        ("", has("sent", f"^ *(?:{'|'.join(x.skeleton)})"), 28),
        ("", has("sent", f"^ *(?:{x.wide_connective_heads})"), 18),
        ("", f"{has('sent', x.abstract)} AND {n} > 22", 12),
        ("", f"{n} >= 38", 14),
        ("", f"{n} BETWEEN 28 AND 37", 6),
        ("", has("sent", x.long_idioms), 14),
        ("", has("sent", x.mixed_spacing), 12),
        ("", f"{has('sent', x.span_judgement_tail)} AND {n} > 20", 10),
        ("", has("sent", x.triple), 14),
        ("", vague, 10),
        ("", f"{n_of('sent', x.span_modal)} >= 2", 8),
        ("", f"NOT {vague} AND {has('sent', x.personal)}", -20),
        ("", has("sent", x.concrete), -12),
        ("", has("sent", x.colloquial), -10),
        ("", f"{n} <= 12", -16),
        ("", has("sent", x.question), -8),
        ("", has("sent", x.pause), -6),
    ]
    return f"""
a0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {lit(f'[^{d}]*[{d}]|[^{d}]+$')}) AS parts FROM {source}),
a1 AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS k, unnest(parts) AS sent FROM a0),
a2 AS (SELECT *, CAST(coalesce(sum(length(sent)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start" FROM a1),
a3 AS (SELECT * FROM a2 WHERE regexp_replace({bare('sent')}, {lit(f'[{d}{x.ignore}]')}, '', 'g') <> ''),
sp AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS sent_idx, sent, "start", "start" + length(sent) AS "end",
         {points_sql(rules, 22)} AS risk, greatest(1, {n}) AS weight FROM a3),
sc AS (SELECT *, CASE WHEN risk >= 62 THEN 'ai' WHEN risk >= 38 THEN 'suspected' ELSE 'human' END AS label FROM sp),
il AS (
  SELECT *, CAST(sum(turn) OVER (PARTITION BY doc_id ORDER BY sent_idx) AS BIGINT) AS island FROM (
    SELECT *, CASE WHEN label <> lag(label) OVER (PARTITION BY doc_id ORDER BY sent_idx) THEN 1 ELSE 0 END AS turn FROM sc)),
ms AS (
  SELECT doc_id, island, label, min(sent_idx) AS first_idx, max(sent_idx) AS last_idx, min("start") AS "start", max("end") AS "end",
         CAST(floor(avg(risk) + 0.5) AS INT) AS risk FROM il WHERE label <> 'human' GROUP BY doc_id, island, label)"""


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

for _suffix, _lexicon, _source in (("", LATIN, None), ("_zh", CHINESE, "zh_docs")):

    def _register(suffix: str, x: Lexicon, source: str | None) -> None:
        read = docs if source is None else (lambda spark, _: table_of(spark, source))
        name, prefix = ("documents", "") if source is None else (source, f"{source} AS ({sql_table(source)}),")
        features = [f"f_{f[0]}" for f in D.FEATURES]
        six = lambda: [F.round(f, 6).alias(f) for f in features]
        sql6 = ", ".join(f"round({f}, 6) AS {f}" for f in features)
        reasons = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {lit(r)} END" for r, c, _ in risk_sql(x)) + "], lambda r: r IS NOT NULL)"
        rated = f"{base_sql(x, name)}, r AS (SELECT doc_id, sent_idx, sent, {points_sql(risk_sql(x), 20)} AS risk, {reasons} AS reasons FROM s)"

        QUERIES[f"review_sentences{suffix}"] = lambda s, d: D.review(read(s, d), x, "doc_id").select("doc_id", "sent_idx", "risk", "severity", F.array_join("reasons", ", ").alias("reasons"))
        ORACLE_SQL[f"review_sentences{suffix}"] = f"""WITH {prefix}{rated}
SELECT doc_id, sent_idx, risk, CASE WHEN risk >= 60 THEN 'high' WHEN risk >= 45 THEN 'medium' ELSE 'low' END AS severity,
       array_to_string(reasons, ', ') AS reasons FROM r WHERE risk >= 40"""
        QUERIES[f"sentence_stats{suffix}"] = lambda s, d: sentence_stats(read(s, d), x)
        ORACLE_SQL[f"sentence_stats{suffix}"] = f"""WITH {prefix}{base_sql(x, name)}, n AS (SELECT doc_id, length({bare('sent')}) AS n FROM s)
SELECT doc_id, count(*) AS n, round(avg(n), 6) AS avg_len, round(stddev_pop(n), 6) AS std_len,
       round(CASE WHEN avg(n) > 0 THEN stddev_pop(n) / avg(n) ELSE 0 END, 6) AS cv FROM n GROUP BY doc_id"""
        QUERIES[f"detect_features{suffix}"] = lambda s, d: D.detect(read(s, d), x).select("doc_id", "chars", "sentences", "paragraphs", *six())
        ORACLE_SQL[f"detect_features{suffix}"] = f"WITH {prefix}{feature_sql(x, name)} SELECT doc_id, chars, sentences, paragraphs, {sql6} FROM f"
        QUERIES[f"detect_probability{suffix}"] = lambda s, d: D.detect(read(s, d), x).select("doc_id", "probability", "level", "confidence", F.size("warnings").alias("n_warnings"))
        ORACLE_SQL[f"detect_probability{suffix}"] = f"""WITH {prefix}{feature_sql(x, name)}
SELECT doc_id, probability, CASE WHEN probability >= 48 THEN 'high' WHEN probability >= 32 THEN 'medium' ELSE 'human' END AS level,
       CAST(floor(least(99.0::DOUBLE, greatest(45.0::DOUBLE, 50 + least(abs(probability - 32), abs(probability - 48)) * 1.4::DOUBLE)) + 0.5) AS INT) AS confidence,
       CAST((chars < 350)::INT + (sentences < 4)::INT AS INT) AS n_warnings FROM v"""
        QUERIES[f"top_segments{suffix}"] = lambda s, d: D.top_segments(read(s, d), x).select("doc_id", "rank", "sent_idx", "risk")
        ORACLE_SQL[f"top_segments{suffix}"] = f"""WITH {prefix}{rated}
SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY risk DESC, sent_idx) AS rank, sent_idx, risk FROM r) WHERE rank <= 8"""
        QUERIES[f"reason_tally{suffix}"] = lambda s, d: D.reason_tally(read(s, d), x)
        raising = ", ".join(lit(r) for r, _, n in risk_sql(x) if n > 0)
        ORACLE_SQL[f"reason_tally{suffix}"] = f"""WITH {prefix}{rated}
SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r WHERE risk >= 40) WHERE reason IN ({raising}) GROUP BY reason"""
        QUERIES[f"span_scores{suffix}"] = lambda s, d: S.scored_spans(read(s, d), x).select("doc_id", "sent_idx", "start", "end", "risk", "label")
        ORACLE_SQL[f"span_scores{suffix}"] = f'WITH {prefix}{spans_sql(x, name)} SELECT doc_id, sent_idx, "start", "end", risk, label FROM sc'
        rounded = lambda: [F.round(c, 2).alias(c) for c in ("ai_share", "suspected_share", "human_share", "composite")]
        QUERIES[f"span_ratios{suffix}"] = lambda s, d: S.ratios(read(s, d), x).select("doc_id", "n", *rounded(), "composite_label")
        share = lambda k: f"sum(CASE WHEN label = '{k}' THEN weight ELSE 0 END) * 100.0::DOUBLE / sum(weight)"
        ORACLE_SQL[f"span_ratios{suffix}"] = f"""WITH {prefix}{spans_sql(x, name)},
k AS (SELECT doc_id, count(*) AS n, {share('ai')} AS a, {share('suspected')} AS b, {share('human')} AS c FROM sc GROUP BY doc_id)
SELECT doc_id, n, round(a, 2) AS ai_share, round(b, 2) AS suspected_share, round(c, 2) AS human_share, round(a + 0.5::DOUBLE * b, 2) AS composite,
       CASE WHEN a + 0.5::DOUBLE * b >= 40 THEN 'ai' WHEN a + 0.5::DOUBLE * b >= 20 THEN 'suspected' ELSE 'human' END AS composite_label FROM k"""
        QUERIES[f"span_merge{suffix}"] = lambda s, d: S.merged_spans(read(s, d), x)
        ORACLE_SQL[f"span_merge{suffix}"] = f"WITH {prefix}{spans_sql(x, name)} SELECT * FROM ms"
        QUERIES[f"span_top{suffix}"] = lambda s, d: S.top_spans(read(s, d), x).select("doc_id", "rank", "start", "risk", "label")
        ORACLE_SQL[f"span_top{suffix}"] = f"""WITH {prefix}{spans_sql(x, name)}
SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY risk DESC, "start") AS rank, "start", risk, label FROM ms) WHERE rank <= 8"""

    _register(_suffix, _lexicon, _source)


def sentence_stats(frame: DataFrame, x: Lexicon) -> DataFrame:
    """Number, mean, population deviation and CV of sentence lengths."""
    lens = D.sentence_table(frame, x, "doc_id").select("doc_id", T.visible_length("sent").alias("len"))
    six = lambda c: F.round(c, 6)
    return lens.groupBy("doc_id").agg(
        F.count("*").alias("n"), six(F.avg("len")).alias("avg_len"), six(F.stddev_pop("len")).alias("std_len"),
        six(F.when(F.avg("len") > 0, F.stddev_pop("len") / F.avg("len")).otherwise(0.0)).alias("cv"),
    )
