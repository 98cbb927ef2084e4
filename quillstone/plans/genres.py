"""Queries of genres, signatures and predictions by genre, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import genre as G
from quillstone.operators import local_score as L
from quillstone.operators import spans as S
from quillstone.plans.fixtures import sql_table, table_of
from quillstone.plans.measure import bare, docs, has, lit, n_of, trim
from quillstone.plans.scores import score_sql
from quillstone.sources.tables import read_table

SHOWN = ("quotes", "colons", "short", "exposition", "past", "scenes")


def _shown(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, "genre", F.col("rule").cast("long").alias("rule"), "effective", *(F.round(c, 6).alias(c) for c in ("confidence",)), *(F.round(F.element_at("evidence", F.lit(c)), 6).alias(c) for c in SHOWN))


def document_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(G.genres(docs(spark, sf_dir)), "doc_id")


def conversation_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genres of whole conversations, a line for each turn."""
    return _shown(G.genres(G.transcripts(read_table(spark, sf_dir, "conversations"))), "conv_id")


def document_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents, pages and conversations show which signature, with those that show none."""
    texts = [docs(spark, sf_dir).select(F.lit("document").alias("source"), "text"), read_table(spark, sf_dir, "pages").select(F.lit("page").alias("source"), F.col("html").alias("text"))]
    texts.append(G.transcripts(read_table(spark, sf_dir, "conversations")).select(F.lit("conversation").alias("source"), "text"))
    rows = texts[0].unionByName(texts[1]).unionByName(texts[2]).select("source", F.explode_outer(G.signatures("text")).alias("signature"))
    return rows.groupBy("source", F.coalesce("signature", F.lit("none")).alias("signature")).agg(F.count("*").alias("texts"))


def genre_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local scores of documents by the calibration line of their own genre. A document's genre goes through the score beside its id,
    so that each text is read once and no row moves; documents without an id are left out."""
    rows = G.genres(docs(spark, sf_dir).where("doc_id IS NOT NULL")).select(F.struct("doc_id", "effective").alias("doc_id"), "text")
    found = L.local_score(rows, L.LATIN_MARKS).select(F.col("doc_id.doc_id").alias("id"), F.col("doc_id.effective").alias("genre"), "score")
    return L.predicted(found, table_of(spark, "tracks")).withColumn("percent", F.round("percent", 6))


# --- SQL ----------------------------------------------------------------------------------------------------------------


def _literals(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"(len(string_split(t, {lit(w)})) - 1)" for w in words) + ")"


def _not_before(expr: str) -> str:
    for w in ("了", *(w for w in G.PAST if w not in ("了", "过了", "曾经"))):
        expr = f"replace({expr}, {lit(w + G.PAST_NOT_BEFORE)}, chr(1))"
    return expr


def genre_sql(source: str, key: str, x: G.GenreConfig = G.GenreConfig()) -> str:
    """Table gn (key, genre, rule, confidence, effective and the densities)."""
    d = G.DELIMITERS
    masked = f"array_to_string(list_transform(list_zip(s, m), lambda z: coalesce(z[1], '') || translate(coalesce(z[2], ''), {lit(d)}, repeat(chr(1), {len(d)}))), '')"
    parts = f"list_filter(list_transform(regexp_extract_all(k, {lit(f'[^{d}]*[{d}]+|[^{d}]+$')}), lambda s: {trim('s')}), lambda s: s <> '')"
    start = f"regexp_replace(y, {lit('^' + T.SPACE_CLASS + '+')}, '')"
    head = trim(f"regexp_replace(regexp_extract({start}, {lit(G.SPEAKER)}), '[：:]$', '')")
    labels = lit("(?:" + "|".join(G.LABELS) + ")$")
    speaks = f"{has(start, G.SPEAKER)} AND NOT {has(start, G.SCHEME)} AND NOT regexp_matches({head}, {labels})"
    share = lambda f: f"len(list_filter(sents, lambda y: {f})) / greatest(1, len(sents))::DOUBLE"
    per = lambda n: f"({n}) / greatest(1, pure)::DOUBLE"
    part = lambda v, full, weight: f"least(1.0::DOUBLE, {v} / {full!r}::DOUBLE) * {weight!r}::DOUBLE"
    past = "(?:" + "|".join(G.PAST) + ")"
    story = f"p >= {x.past!r}::DOUBLE AND s >= {x.scenes!r}::DOUBLE AND e < {x.below!r}::DOUBLE"
    cases = [
        (f"length({trim('t')}) < {x.least_trimmed}", "main", 4, "0.3::DOUBLE"),
        (f"pure < {x.least_pure}", "main", 4, "0.35::DOUBLE"),
        (f"b > 0 OR q >= {x.quotes!r}::DOUBLE OR c >= {x.colons!r}::DOUBLE OR k >= {x.combined!r}::DOUBLE", "dialogue", 1, "least(0.95::DOUBLE, CASE WHEN k > 0 THEN 0.45::DOUBLE + k * 0.55::DOUBLE ELSE 0.6::DOUBLE END)"),
        (f"e >= {x.exposition!r}::DOUBLE", "main", 2, f"least(0.92::DOUBLE, 0.5::DOUBLE + (e - {x.exposition!r}::DOUBLE) * 2 + CASE WHEN p < 0.012::DOUBLE THEN 0.08::DOUBLE ELSE 0 END)"),
        (story, "narrative", 3, f"least(0.9::DOUBLE, 0.35::DOUBLE + least(0.25::DOUBLE, (p - {x.past!r}::DOUBLE) * 6) + least(0.2::DOUBLE, (s - {x.scenes!r}::DOUBLE) * 8) + CASE WHEN q < 0.02::DOUBLE THEN 0.08::DOUBLE ELSE 0 END)"),
        (f"e < {x.weak_exposition!r}::DOUBLE AND p >= {x.weak_past!r}::DOUBLE AND o < {x.official!r}::DOUBLE", "narrative", 4, "least(0.75::DOUBLE, greatest(0.4::DOUBLE, 0.35::DOUBLE + p * 8 + s * 6))"),
        ("true", "main", 4, "least(0.75::DOUBLE, greatest(0.4::DOUBLE, 0.35::DOUBLE + e * 0.4::DOUBLE))"),
    ]
    case = "CASE " + " ".join(f"WHEN {c} THEN {{'genre': '{g}', 'rule': {r}, 'confidence': {conf}}}" for c, g, r, conf in cases) + " END"
    score = f"""least(0.55::DOUBLE, ({_literals(G.STRONG)} * 0.18::DOUBLE + {_literals(G.WEAK)} * 0.06::DOUBLE) / greatest(0.4::DOUBLE, length({bare('t')}) / 1000.0::DOUBLE))
      - CASE WHEN dh >= 2 THEN 0.45::DOUBLE WHEN dh = 1 THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN sh >= 3 THEN 0.2::DOUBLE ELSE 0 END
      - CASE WHEN oh >= 3 THEN 0.35::DOUBLE WHEN oh >= 1 THEN 0.1::DOUBLE ELSE 0 END"""
    return f"""n0 AS (SELECT {key}, coalesce(text, '') AS t FROM {source}),
n1 AS (SELECT *, regexp_split_to_array(t, {lit(T.ADDRESS)}) AS s, regexp_extract_all(t, {lit(T.ADDRESS)}) AS m FROM n0),
n2 AS (SELECT {key}, t, {n_of('t', G.PURE)} AS pure, {masked} AS k FROM n1),
n3 AS (SELECT {key}, t, pure, {parts} AS sents, {n_of('t', G.DIALOGUE.replace('(?md)', '(?m)'))} AS dh, {n_of('t', G.SAID)} AS sh, {_literals(G.OWN_STORY)} AS oh FROM n2),
n4 AS (
  SELECT {key}, t, pure, {per(' + '.join(n_of('t', p) for p in G.QUOTED))} AS q, {share(speaks)} AS c, {share(n_of('y', G.PURE) + ' BETWEEN 1 AND 5')} AS h, {per(n_of('t', G.SCENE_BLOCK))} AS b,
    CASE WHEN length({trim('t')}) < 40 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, {score})) END AS e,
    {per(n_of(_not_before('t'), past))} AS p, {per(n_of('t', G.SCENE))} AS s, {per(n_of('t', G.OFFICIAL))} AS o FROM n3),
n5 AS (SELECT *, least(1.0::DOUBLE, CASE WHEN b > 0 THEN 0.35::DOUBLE ELSE 0 END + {part('c', x.colons, 0.3)} + {part('q', x.quotes, 0.25)} + {part('h', x.short, 0.12)}) AS k FROM n4),
n6 AS (SELECT *, {case} AS f FROM n5),
gn AS (SELECT {key}, f.genre AS genre, CAST(f.rule AS BIGINT) AS rule, CASE WHEN f.genre = 'dialogue' AND q < 0.002::DOUBLE AND h = 0 AND b = 0 AND c < 0.15::DOUBLE THEN 'main' ELSE f.genre END AS effective,
  round(f.confidence, 6) AS confidence, round(q, 6) AS quotes, round(c, 6) AS colons, round(h, 6) AS short, round(e, 6) AS exposition, round(p, 6) AS past, round(s, 6) AS scenes FROM n6)"""


_TALK = "talk AS (SELECT conv_id, string_agg(coalesce(role, '') || '：' || coalesce(text, ''), chr(10) ORDER BY turn, coalesce(role, ''), coalesce(role, '') || '：' || coalesce(text, '')) AS text FROM conversations GROUP BY conv_id)"
_SIGNED = ", ".join([f"CASE WHEN {has('t', p)} THEN '{k}' END" for k, p in G.SIGNATURES.items()] + [f"CASE WHEN {n_of('t', G.ITEM_HEAD)} >= 2 AND {n_of('t', G.LIMIT)} >= 2 THEN 'specification' END"])

QUERIES = {f.__name__: f for f in (document_genres, conversation_genres, document_signatures, genre_predictions)}
ORACLE_SQL = {
    "document_genres": f"WITH {genre_sql('documents', 'doc_id')} SELECT * FROM gn",
    "conversation_genres": f"WITH {_TALK}, {genre_sql('talk', 'conv_id')} SELECT * FROM gn",
    "document_signatures": f"""WITH {_TALK}, t AS (SELECT 'document' AS source, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'page', coalesce(html, '') FROM pages UNION ALL SELECT 'conversation', text FROM talk),
        f AS (SELECT source, list_filter([{_SIGNED}], lambda k: k IS NOT NULL) AS found FROM t),
        e AS (SELECT source, unnest(CASE WHEN len(found) = 0 THEN ['none'] ELSE found END) AS signature FROM f)
        SELECT source, signature, count(*) AS texts FROM e GROUP BY source, signature""",
    "genre_predictions": f"""WITH {genre_sql('documents', 'doc_id')}, {score_sql(L.LATIN_MARKS, 'documents')}, tracks AS ({sql_table('tracks')}),
        k AS (SELECT doc_id AS id, effective AS track, score FROM gn JOIN ls USING (doc_id)),
        p AS (SELECT *, least(100.0::DOUBLE, greatest(0.0::DOUBLE, a * score + b)) AS pct FROM k JOIN tracks USING (track))
        SELECT id, track, round(pct, 6) AS percent, CASE WHEN pct >= {S.OFFICIAL_AI} THEN 'ai' WHEN pct >= {S.OFFICIAL_SUSPECTED} THEN 'suspected' ELSE 'human' END AS label,
          CASE WHEN pct <= 20 THEN 'safe' WHEN pct <= 40 THEN 'fair' WHEN pct <= 60 THEN 'doubtful' WHEN pct <= 80 THEN 'heavy' ELSE 'rewrite' END AS advice, coalesce(score >= sat, false) AS saturated FROM p""",
}
