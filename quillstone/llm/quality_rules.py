"""Operator 2 [native]: line-first cleaning with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import others, table

SYMBOLS = "#*$%&|<>"
GAP = r"[\x20\x09-\x0D]+"
#: A word that only separates links.
MARK = r"(?<![^\x20\x09-\x0D])(?:[|/»›>·•]|::|->)(?![^\x20\x09-\x0D])"

#: Lines with one of these are boilerplate.
BOILERPLATE = (
    "all rights reserved", "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados",
    "copyright (c)", "©", "licensed under", "released under the", "is licensed under", "spdx-license-identifier",
    "cookie policy", "accept cookies", "privacy policy", "terms of use", "terms of service", "enable javascript",
    "click here", "subscribe to our", "sign up for our newsletter", "share this article",
)


@dataclass(frozen=True)
class LineRules:
    """max_symbols: symbols a character of a line. max_marks: share of a line's words that are mere separators.
    max_loss: share of a document's words that may go with failing lines."""

    max_symbols: float = 0.1
    max_marks: float = 0.2
    max_loss: float = 0.4
    min_words: int = 50
    max_repeat_percent: int = 50


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more: windows are compared by 64-bit hashes within one text.

    Windows sorted by hash have their equals beside them; the places of those, in order, each cover up to three words more.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        places = _let(ranked, lambda r: F.filter(F.transform(r, lambda x, j: F.when((x.h == F.get(r, j - 1).h) | (x.h == F.get(r, j + 1).h), x.i)), lambda i: i.isNotNull()))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        add = lambda a, p: F.struct((a.n + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(F.sort_array(places), start, add, lambda a: a.n)

    return F.when(F.size(words) < 3, 0).otherwise(_let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))))


def line_passes(line: Column, plain: Column, n_words: Column, n_symbols: Column, rules: LineRules) -> Column:
    """Whether a line with words stays: it ends a sentence somewhere, isn't a row of symbols or links, isn't boilerplate.

    plain is the line in lower case. The costly count of separators runs only on lines that hold one.
    """
    marks = F.when(line.rlike("[|/»›>·•]|::"), F.regexp_count(line, F.lit(MARK))).otherwise(0)
    boilerplate = plain.contains(BOILERPLATE[0])
    for phrase in BOILERPLATE[1:]:
        boilerplate |= plain.contains(phrase)
    return line.rlike(r"[.!?…。！？]") & (n_symbols <= rules.max_symbols * F.length(line)) & (marks <= rules.max_marks * n_words) & ~boilerplate


def clean(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """Each row of docs with quality (struct): the base counts, n_lines, n_failed_lines, n_lost_words, clean_text, kept.

    Rules are read per line before anything is decided about the document: lines that fail go, and a document that loses
    over max_loss of its words, or that the base rules fail, is not kept. Null text counts as empty, which the base rules
    fail; lines without words always stay and count as no loss. Other columns, clashing names included, pass unchanged,
    but a column named quality is replaced. Rows are independent: repeats and ties each get their own verdict, and no row
    is shuffled.
    """
    body = F.coalesce(F.col(text), F.lit(""))

    def split_up(line: Column) -> Column:
        return F.struct(line.alias("line"), _words(line).alias("words"), F.regexp_count(line, F.lit(f"[{SYMBOLS}]")).alias("symbols"))

    def judged(parts: Column, plain: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            n = F.size(p.words)
            return F.struct(p.line.alias("line"), n.alias("n"), ((n == 0) | line_passes(p.line, F.get(plain, i), n, p.symbols, rules)).alias("ok"))

        return F.transform(parts, one)

    def verdict(words: Column, parts: Column, lines: Column) -> Column:
        full = F.filter(lines, lambda x: x["n"] > 0)
        bad = F.filter(lines, lambda x: ~x.ok)
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + p.symbols).alias("n_symbols"),
            (F.size(full) - F.size(F.array_distinct(F.transform(full, lambda x: x.line)))).cast("long").alias("n_dup_lines"),
            _repeated(words).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(bad).cast("long").alias("n_failed_lines"),
            F.aggregate(bad, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_lost_words"),
            F.array_join(F.transform(F.filter(lines, lambda x: x.ok), lambda x: x.line), "\n").alias("clean_text"),
        )

    parts = F.transform(F.split(body, "\n"), split_up)
    read = _let(F.struct(parts.alias("parts"), F.split(F.lower(body), "\n").alias("plain")), lambda v: F.struct(v.parts.alias("parts"), judged(v.parts, v.plain).alias("lines"), F.flatten(F.transform(v.parts, lambda p: p.words)).alias("words")))
    made = _let(read, lambda v: verdict(v.words, v.parts, v.lines))
    # a generator of one row, which no filter or projection of the result can repeat
    out = docs.select(*others(docs, "quality"), F.explode_outer(F.array(made)).alias("quality"))
    base = (F.col("quality.n_words") < rules.min_words) | (100 * F.col("quality.n_repeat_words") > rules.max_repeat_percent * F.col("quality.n_words"))
    out = out.withColumn("quality", F.col("quality").withField("base_failed", base))
    lost = F.col("quality.n_lost_words") > rules.max_loss * F.col("quality.n_words")
    return out.withColumn("quality", F.col("quality").withField("kept", ~F.col("quality.base_failed") & ~lost))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "n_lost_words")
    return clean(docs).select("doc_id", *(F.col(f"quality.{n}").alias(n) for n in names))


_PHRASES = " OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)

ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
tri AS (
  SELECT doc_id, g.i AS i, g.k AS k FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: {{'i': i, 'k': [ws[i], ws[i + 1], ws[i + 2]]}})) AS g FROM w)),
again AS (SELECT doc_id, k FROM tri GROUP BY doc_id, k HAVING count(*) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri JOIN again USING (doc_id, k)) GROUP BY doc_id),
ln AS (
  SELECT doc_id, line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n,
         list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
lj AS (
  SELECT doc_id, line, n, n = 0 OR (
      regexp_matches(line, '[.!?…。！？]')
      AND length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) <= 0.1::DOUBLE * length(line)
      AND len(list_filter(lw, lambda x: x IN ('|', '/', '»', '›', '>', '·', '•', '::', '->'))) <= 0.2::DOUBLE * n
      AND NOT ({_PHRASES})) AS ok FROM ln),
ls AS (
  SELECT doc_id, count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines,
         count(*) FILTER (WHERE NOT ok) AS n_failed_lines, coalesce(sum(n) FILTER (WHERE NOT ok), 0) AS n_lost_words FROM lj GROUP BY doc_id),
q AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, n_failed_lines::BIGINT AS n_failed_lines, n_lost_words::BIGINT AS n_lost_words
  FROM w JOIN ls USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT n_lost_words > 0.4::DOUBLE * n_words AS kept,
       n_failed_lines, n_lost_words
FROM q
"""
