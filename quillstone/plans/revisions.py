"""Queries of protected stretches, replacement by a table, aligned differences and their explanation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.operators import difference as D
from quillstone.operators import protect as P
from quillstone.operators import replace as R
from quillstone.plans.measure import docs, lit
from quillstone.sources.tables import read_table

#: Marks at which a text might be cut.
CUT = "[.!?;。！？；]"
#: Words that the rules of the queries are made of: so many of the most frequent ones, each of at least five small letters.
RULES = 60
SHARE = 0.7
#: Sentences that the revised texts have more, by what they are found.
OPENED, NOTED = ("By the way, ",), ("(so to speak)",)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as (source, id, text)."""
    pages = read_table(spark, sf_dir, "pages").select(F.lit("page").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return docs(spark, sf_dir).select(F.lit("document").alias("source"), F.col("doc_id").alias("id"), "text").unionByName(pages)


def guarded_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each text, how many marks could end a sentence, and how many of them stand in an address, a title or code: a range join."""
    rows = texts(spark, sf_dir)
    hits = rows.select("source", "id", F.explode(P.places_of("text", CUT)).alias("start"))
    spans = rows.select("source", "id", F.explode(P.spans_of("text")).alias("s")).select("source", "id", "s.kind", "s.start", "s.end")
    met = P.within(hits, spans, ["source", "id"])
    held = [F.count_if(F.col("kind") == k).alias(f"in_{k}") for k in P.PATTERNS]
    return met.groupBy("source", "id").agg(F.count("*").alias("cuts"), *held)


def word_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules made of the most frequent words: the next two stand for each, and some keep their places before a comma or behind an
    article."""
    words = docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("term")).where(F.col("term").rlike("^[a-z]{5,}$"))
    top = words.groupBy("term").count().orderBy(F.desc("count"), "term").limit(RULES)
    rank = Window.orderBy(F.desc("count"), "term")  # RULES rows
    n = F.row_number().over(rank)
    following = [F.coalesce(F.lead("term", k).over(rank), F.first("term").over(rank)) for k in (1, 2)]
    none = F.array().cast("array<string>")
    return top.select("term", F.array(*following).alias("instead"), F.when(n % 3 == 0, F.array(F.lit("the "), F.lit("de "))).otherwise(none).alias("not_after"), F.when(n % 2 == 0, F.array(F.lit(","))).otherwise(none).alias("not_before"))


def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.replace_terms(docs(spark, sf_dir), word_rules(spark, sf_dir), "doc_id", share=SHARE)


def replaced_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its replacements' number and the digest of what it becomes."""
    return replaced(spark, sf_dir).select("doc_id", F.size("sites").cast("long").alias("sites"), F.md5(F.col("rewritten").cast("binary")).alias("rewritten_md5"))


def term_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each term was replaced, and by what."""
    return replaced(spark, sf_dir).select(F.explode("sites").alias("s")).groupBy("s.term", "s.instead").agg(F.count("*").alias("sites"))


def revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, before, after): documents against themselves with terms replaced; by the remainder of the id some lose their first
    sentence too, and some get one more."""
    rows = replaced(spark, sf_dir)
    less = F.regexp_replace("rewritten", r"^[^!?\n]*[!?\n]+", "")
    more = F.concat("rewritten", F.lit("\nBy the way, this came later!"))
    noted = F.concat("rewritten", F.lit("\nIt ends here (so to speak)!"))
    k = F.pmod("doc_id", F.lit(4))
    return rows.select("doc_id", F.coalesce("text", F.lit("")).alias("before"), F.coalesce(F.when(k == 1, less).when(k == 2, more).when(k == 3, noted).otherwise(F.col("rewritten")), F.lit("")).alias("after"))


def _rebuilt(rows: DataFrame, name: str) -> DataFrame:
    whole = lambda side: F.md5(F.array_join(F.transform(name, lambda p: p[side]), "").cast("binary")).alias(f"{side}_md5")
    return rows.select("doc_id", whole("before"), whole("after"))


def sentence_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of both versions, one after the other: kept, deleted or inserted."""
    return D.sentence_diff(revised(spark, sf_dir)).select("doc_id", F.inline("sentences"))


def sentence_diff_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both versions' digests, put together again from the rows of the sentence diff."""
    return _rebuilt(D.sentence_diff(revised(spark, sf_dir)), "sentences")


def inline_diff_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both versions' digests, put together again from the parts of the inline diff."""
    return _rebuilt(D.inline_diff(revised(spark, sf_dir)), "parts")


def inline_diff_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters kept, removed and added, and the share of change."""
    return D.inline_diff(revised(spark, sf_dir)).select("doc_id", *(c.alias(n) for n, c in D.change_share(F.col("parts")).items()))


def explained_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document, its changes by what explains them."""
    return D.explain_summary(explained(spark, sf_dir), ["doc_id"])


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.explain(revised(spark, sf_dir), R.rules_of(word_rules(spark, sf_dir)), {}, OPENED, NOTED)


# --- SQL ----------------------------------------------------------------------------------------------------------------


def pieces_sql(source: str, key: str, pattern: str, name: str) -> str:
    """Table name (key, piece, k, start): matches of a pattern in text and their places, from the texts between them."""
    return f"""{name}0 AS (SELECT {key}, regexp_extract_all(text, {lit(pattern)}) AS m, regexp_split_to_array(text, {lit(pattern)}) AS s FROM {source} WHERE text IS NOT NULL AND len(regexp_extract_all(text, {lit(pattern)})) > 0),
{name}1 AS (SELECT {key}, unnest(m) AS piece, unnest(list_transform(s[:len(m)], lambda x: length(x))) AS before, unnest(range(len(m))) AS k FROM {name}0),
{name} AS (SELECT {key}, piece, k, CAST(sum(before + length(piece)) OVER (PARTITION BY {key} ORDER BY k) - length(piece) AS BIGINT) AS start FROM {name}1)"""


def sequence_sql(source: str, key: str, pattern: str, name: str) -> str:
    """Table name (key, piece, k, start) of the pieces that a pattern cuts a whole text into."""
    return f"""{name}0 AS (SELECT {key}, regexp_extract_all(text, {lit(pattern)}) AS m FROM {source} WHERE text IS NOT NULL),
{name}1 AS (SELECT {key}, unnest(m) AS piece, unnest(range(len(m))) AS k FROM {name}0),
{name} AS (SELECT {key}, piece, k, CAST(sum(length(piece)) OVER (PARTITION BY {key} ORDER BY k) - length(piece) AS BIGINT) AS start FROM {name}1)"""


_SPAN = "|".join(P.PATTERNS.values())
_KIND = "CASE WHEN starts_with(piece, '《') THEN 'title' WHEN starts_with(piece, '`') THEN 'code' ELSE 'address' END"
_REPLACED = f"""{sequence_sql('documents', 'doc_id', '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+', 'w')},
{pieces_sql('documents', 'doc_id', _SPAN, 'g')},
top AS (SELECT piece AS term, row_number() OVER (ORDER BY count(*) DESC, piece) AS n FROM w WHERE regexp_full_match(piece, '[a-z]{{5,}}') GROUP BY piece QUALIFY n <= {RULES}),
rule AS (SELECT term, n, coalesce(lead(term) OVER (ORDER BY n), first_value(term) OVER (ORDER BY n)) AS one, coalesce(lead(term, 2) OVER (ORDER BY n), first_value(term) OVER (ORDER BY n)) AS two FROM top),
near AS (SELECT doc_id, k, piece, start, lead(piece) OVER o AS behind, coalesce(lag(piece, 2) OVER o, '') || coalesce(lag(piece) OVER o, '') AS ahead FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
site AS (
  SELECT doc_id, k, term, md5(doc_id || ':' || start || ':' || term) AS h, one, two FROM near JOIN rule ON piece = term
  WHERE NOT (n % 3 = 0 AND (ends_with(ahead, 'the ') OR ends_with(ahead, 'de '))) AND NOT (n % 2 = 0 AND starts_with(coalesce(behind, ''), ','))
    AND NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = near.doc_id AND g.start < near.start + length(near.piece) AND g.start + length(g.piece) > near.start)),
taken AS (
  SELECT doc_id, k, term, CASE WHEN CAST('0x' || h[9:16] AS BIGINT) % 2 = 0 THEN one ELSE two END AS instead
  FROM site WHERE CAST('0x' || h[1:8] AS BIGINT) < {SHARE * 2**32!r}::DOUBLE),
new AS (
  SELECT doc_id, count(taken.k) AS sites, string_agg(coalesce(taken.instead, w.piece), '' ORDER BY w.k) AS rewritten
  FROM w LEFT JOIN taken USING (doc_id, k) GROUP BY doc_id)"""
_REVISED = f"""{_REPLACED},
rev AS (
  SELECT doc_id, coalesce(text, '') AS before, coalesce(CASE doc_id % 4 WHEN 1 THEN regexp_replace(r, {lit('^[^!?' + chr(10) + ']*[!?' + chr(10) + ']+')}, '') WHEN 2 THEN r || chr(10) || 'By the way, this came later!'
    WHEN 3 THEN r || chr(10) || 'It ends here (so to speak)!' ELSE r END, '') AS after
  FROM (SELECT d.doc_id, d.text, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(new.rewritten, '') END AS r FROM documents AS d LEFT JOIN new USING (doc_id)))"""
_TEXTS = f"WITH {_REVISED} SELECT doc_id, md5(before) AS before_md5, md5(after) AS after_md5 FROM rev"

QUERIES = {f.__name__: f for f in (guarded_cuts, replaced_terms, term_tally, sentence_diff, sentence_diff_texts, inline_diff_texts, inline_diff_share, explained_changes)}
ORACLE_SQL = {
    "guarded_cuts": f"""WITH t AS (SELECT 'document' AS source, doc_id AS id, text FROM documents UNION ALL SELECT 'page', page_id, html FROM pages),
        {pieces_sql('t', 'source, id', CUT, 'c')}, {pieces_sql('t', 'source, id', _SPAN, 'g')},
        x AS (SELECT c.source, c.id, (SELECT any_value({_KIND}) FROM g WHERE g.source = c.source AND g.id = c.id AND g.start <= c.start AND c.start < g.start + length(g.piece)) AS kind FROM c)
        SELECT source, id, count(*) AS cuts, {', '.join(f"count(*) FILTER (kind = '{k}') AS in_{k}" for k in P.PATTERNS)} FROM x GROUP BY source, id""",
    "replaced_terms": f"WITH {_REPLACED} SELECT d.doc_id, coalesce(sites, 0) AS sites, md5(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(rewritten, '') END) AS rewritten_md5 FROM documents AS d LEFT JOIN new USING (doc_id)",
    "term_tally": f"WITH {_REPLACED} SELECT term, instead, count(*) AS sites FROM taken GROUP BY term, instead",
    "sentence_diff_texts": _TEXTS,
    "inline_diff_texts": _TEXTS,
}
