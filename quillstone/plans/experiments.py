"""Queries of left-out errors and paired experiments over the documents' scores, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import local_score as L
from quillstone.operators import validation as V
from quillstone.plans.measure import docs, lit
from quillstone.plans.scores import score_sql
from quillstone.sources.tables import read_table

MARKS = L.LATIN_MARKS
_HEAD = "It is important to note what follows: in today's world it plays a crucial role. ".lower()
#: Edits with the direction in which the score should go: stock phrases and slips raise it, shorter sentences don't.
EDITS = {
    "phrases": (lambda t: F.concat(F.lit(_HEAD), t), f"{lit(_HEAD)} || t", 1),
    "slip": (lambda t: F.regexp_replace(t, " the ", " teh "), "regexp_replace(t, ' the ', ' teh ', 'g')", 1),
    "shorter sentences": (lambda t: F.regexp_replace(t, ", ", ". "), "regexp_replace(t, ', ', '. ', 'g')", -1),
}


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local scores of documents and their versions; their ids and edits go through the score as one name."""
    rows = V.edited(docs(spark, sf_dir), {k: e[0] for k, e in EDITS.items()})
    named = rows.select(F.struct("doc_id", "edit").alias("doc_id"), "text")
    return L.local_score(named, MARKS).select("doc_id.doc_id", "doc_id.edit", "score")


def paired_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against its edits: how often and how far the score goes where it should."""
    out = V.paired_changes(_scored(spark, sf_dir), {k: e[2] for k, e in EDITS.items()})
    return out.select("edit", "pairs", "up", "down", "same", F.col("least").cast("long").alias("least"), F.col("most").cast("long").alias("most"), *(F.round(c, 6).alias(c) for c in ("mean", "right", "apart")))


def label_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points (lang, x, y): the local score of a labelled document, and 100 where its quality is low. A document's language goes through
    the score beside its id, so that each text is read once."""
    texts = read_table(spark, sf_dir, "documents", ("doc_id", "text", "lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    labels = read_table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", "quality")
    scored = L.local_score(texts.select(F.struct("doc_id", "lang").alias("doc_id"), "text"), MARKS).select("doc_id.doc_id", "doc_id.lang", "score")
    return scored.join(labels, "doc_id").select("lang", F.col("score").cast("double").alias("x"), F.when(F.col("quality") == 0, 100.0).otherwise(0.0).alias("y"))


def left_out_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far lines from scores to labels are off on the documents that they weren't fitted to, by language."""
    return V.left_out_errors(label_points(spark, sf_dir), "lang").select("lang", "n", *(F.round(c, 6).alias(c) for c in ("mae", "rmse", "most")))


_VERSIONS = ", ".join(f"{{'edit': {lit(k)}, 'made': {e[1]}}}" for k, e in EDITS.items())
_WANTED = "CASE edit " + " ".join(f"WHEN {lit(k)} THEN {e[2]}" for k, e in EDITS.items()) + " END"

QUERIES = {f.__name__: f for f in (paired_experiment, left_out_errors)}
ORACLE_SQL = {
    "paired_experiment": f"""WITH d AS (SELECT doc_id AS id, text AS t FROM documents WHERE text IS NOT NULL),
        v AS (SELECT id, t, unnest([{{'edit': '', 'made': t}}, {_VERSIONS}]) AS v FROM d),
        e AS (SELECT {{'id': id, 'edit': v.edit}} AS doc_id, v.made AS text FROM v WHERE v.edit = '' OR v.made <> t),
        {score_sql(MARKS, 'e')},
        s AS (SELECT doc_id.id AS id, doc_id.edit AS edit, score FROM ls),
        c AS (SELECT a.edit, a.score - b.score AS change FROM s AS a JOIN s AS b ON a.id = b.id AND b.edit = '' WHERE a.edit <> ''),
        g AS (SELECT edit, count(*) AS pairs, count(*) FILTER (change > 0) AS up, count(*) FILTER (change < 0) AS down, count(*) FILTER (change = 0) AS same,
          avg(change) AS mean, CAST(min(change) AS BIGINT) AS least, CAST(max(change) AS BIGINT) AS most, stddev_samp(change) AS s FROM c GROUP BY edit)
        SELECT edit, pairs, up, down, same, least, most, round(mean, 6) AS mean, round(CASE WHEN {_WANTED} > 0 THEN up WHEN {_WANTED} < 0 THEN down END / pairs, 6) AS "right",
          round(CASE WHEN s > 0 THEN mean / (s / sqrt(pairs)) END, 6) AS apart FROM g""",
    "left_out_errors": f"""WITH {score_sql(MARKS, 'documents')},
        p AS (SELECT row_number() OVER () AS k, d.lang, ls.score::DOUBLE AS x, CASE WHEN quality = 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS y
          FROM documents AS d JOIN labels USING (doc_id) JOIN ls USING (doc_id) WHERE d.text IS NOT NULL AND d.lang IS NOT NULL AND quality IS NOT NULL),
        f AS (SELECT a.k, a.lang, a.x, a.y, avg(b.x) AS mx, avg(b.y) AS my, var_pop(b.x) AS v, regr_slope(b.y, b.x) AS slope FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.k <> b.k GROUP BY a.k, a.lang, a.x, a.y),
        r AS (SELECT lang, abs(y - (my + CASE WHEN v > 0 THEN slope ELSE 1 END * (x - mx))) AS r FROM f)
        SELECT lang, count(*) AS n, round(avg(r), 6) AS mae, round(sqrt(avg(r * r)), 6) AS rmse, round(max(r), 6) AS most FROM r GROUP BY lang""",
}
