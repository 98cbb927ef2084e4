"""Inputs of the reports and calibrations, derived from the given tables, with the small written rows beside them.

Each is one statement that both engines read: {documents} and the like stand for the given tables. Ids begin at 1000, or with a letter
of their own, so that derived and written rows don't meet.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.plans.fixtures import sql_table, table_of
from quillstone.sources.tables import read_table

_LENGTH = "length(coalesce(text, ''))"
_HUNDREDS = f"CAST(least(100, floor({_LENGTH} / 100)) AS BIGINT)"
_LABELLED = "(SELECT d.doc_id, d.text, d.lang, d.source, l.quality FROM {documents} AS d JOIN {labels} AS l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL AND d.lang IS NOT NULL) AS x"
_WANT = "CAST(100 * (1 - quality) AS DOUBLE)"

DERIVED: dict[str, str] = {
    # an event is a judgement of its user: its type is the seat
    "judgements": "SELECT 1000 + user_id AS doc_id, event_type AS seat, 1 + event_id % 3 AS weight, CAST(floor(value) AS BIGINT) AS score, concat('c', CAST(event_id % 7 AS STRING)) AS critique FROM {events}",
    # labelled documents are points: their length in hundreds of characters, and their label
    "calib_points": f"SELECT lang AS track, CAST({_LENGTH} AS DOUBLE) / 100 AS x, {_WANT} AS y FROM {_LABELLED}",
    "baseline": f"SELECT concat('d', CAST(doc_id AS STRING)) AS id, {_WANT} AS want, CAST({_HUNDREDS} AS DOUBLE) AS score, CASE WHEN quality = 1 THEN 'down' ELSE 'up' END AS direction FROM {_LABELLED}",
    "external": f"SELECT concat('d', CAST(doc_id AS STRING)) AS id, source, CAST({_HUNDREDS} AS DOUBLE) AS local, {_WANT} AS score FROM {_LABELLED}",
    "scale": f"SELECT 1000 + doc_id AS id, CASE WHEN quality = 1 THEN 'human' ELSE 'machine' END AS kind, {_HUNDREDS} AS score FROM {_LABELLED}",
    # the turns of a conversation are stages of a run, candidates, and rounds
    "stages": f"SELECT 1000 + conv_id AS run, turn AS seq, role AS id, CAST(turn AS DOUBLE) AS ms, CAST({_LENGTH} AS BIGINT) AS chars, {_LENGTH} = 0 AS skipped FROM {{conversations}}",
    "candidates": f"SELECT 1000 + conv_id AS doc_id, turn AS candidate, CAST({_LENGTH} AS BIGINT) AS score, coalesce(role = 'system', true) AS vetoed FROM {{conversations}}",
    "rounds": f"SELECT 1000 + conv_id AS doc_id, turn AS round, 20 + conv_id % 60 AS anchor, CAST({_LENGTH} AS BIGINT) AS score, coalesce(role, '') AS issues, concat('x,', CASE WHEN {_LENGTH} % 2 = 0 THEN 'y' ELSE 'z' END) AS critiques FROM {{conversations}}",
    "samples": f"SELECT 1000 + doc_id AS id, CAST({_HUNDREDS} AS DOUBLE) AS local, CAST({_LENGTH} % 101 AS DOUBLE) AS semantic, {_WANT} AS official FROM {_LABELLED}",
    # documents are lines of a ledger, with the page of the same number as their address; an older one holds the even ones
    "ledger": """SELECT 1000 + d.doc_id AS line, concat('d', CAST(d.doc_id AS STRING)) AS id, p.url, CAST(length(coalesce(d.text, '')) % 110 AS DOUBLE) AS pct, CASE WHEN length(coalesce(d.text, '')) % 110 >= 50 THEN 'ai' ELSE 'human' END AS label,
        md5(coalesce(d.text, '')) AS sha FROM {documents} AS d LEFT JOIN {pages} AS p ON d.doc_id = p.page_id""",
    "ledger_old": "SELECT 1000 + doc_id AS line, CASE WHEN doc_id % 98 = 0 THEN 'other' ELSE md5(coalesce(text, '')) END AS sha FROM {documents} WHERE doc_id % 2 = 0",
    "raw_scores": "SELECT 1000 + event_id AS id, concat('{{\"data\":{{\"score\":', CAST(value AS STRING), '}}, \"status\":\"', event_type, '\"}}') AS raw FROM {events}",
    "official_results": f"SELECT 1000 + doc_id AS id, concat(CASE doc_id % 4 WHEN 0 THEN '疑似AI ' WHEN 1 THEN '人工特征 ' WHEN 2 THEN 'AI特征 ' ELSE '' END, CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat(CAST({_LENGTH} % 101 AS STRING), '%') END) AS said FROM {{documents}}",
    "nll_windows": "SELECT 1000 + user_id AS doc_id, CAST(length(event_type) AS BIGINT) AS win, count(*) AS scored, CAST(floor(avg(value)) AS DOUBLE) / 64 AS mean_nll FROM {events} GROUP BY user_id, event_type",
    "layers": f"SELECT 1000 + doc_id AS doc_id, CAST({_LENGTH} % 101 AS DOUBLE) AS surface, CAST({_HUNDREDS} AS DOUBLE) AS semantic FROM {{documents}}",
    "scored": f"SELECT 1000 + doc_id AS id, CASE lang WHEN 'fr' THEN 'narrative' WHEN 'de' THEN 'dialogue' WHEN 'es' THEN 'humanHand' ELSE 'main' END AS genre, {_HUNDREDS} AS score FROM {{documents}}",
    "spaced": "SELECT 1000 + doc_id AS doc_id, concat('文 a ', coalesce(text, '')) AS original, concat('文a', replace(coalesce(text, ''), ' ', '')) AS rewritten FROM {documents}",
}


def _nll_windows(events: DataFrame, order: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """The statement of nll_windows, with each mean's values added one after the other by order, as an engine that reads them in this
    order adds them: where a mean is a whole number, the order of the additions decides what its floor is."""
    place = F.struct(*order)
    so_far = F.sum("value").over(Window.partitionBy("user_id", "event_type").orderBy("_place"))
    sums = events.select("user_id", "event_type", "value", place.alias("_place")).withColumn("_sum", so_far).groupBy("user_id", "event_type")
    found = sums.agg(F.count("*").alias("scored"), (F.max_by("_sum", "_place") / F.nullif(F.count("value"), F.lit(0))).alias("_mean"))
    return found.select((1000 + F.col("user_id")).alias("doc_id"), F.length("event_type").cast("long").alias("win"), "scored", (F.floor("_mean").cast("double") / 64).alias("mean_nll"))


def _nll_windows_as_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nll_windows with values added as the rows lie in the files, in the order of their names, which is how one thread reads them,
    whatever ids the events have."""
    places = (F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return _nll_windows(read_table(spark, sf_dir, "events", ("user_id", "event_type", "value", *places)), ("_file", "_row"))


#: Statements that this engine's own plans stand for.
PLANS = {"nll_windows": _nll_windows_as_stored}


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived rows of a small table, and its written ones."""
    query, written = DERIVED[name], table_of(spark, name)
    if name in PLANS:
        rows = PLANS[name](spark, sf_dir)
    else:
        used = {*re.findall(r"(?<!\{)\{(\w+)\}", query)}
        rows = spark.sql(query, **{t: read_table(spark, sf_dir, t) for t in used})
    return rows.select(*(rows[c].cast(written.schema[c].dataType).alias(c) for c in written.columns)).unionByName(written)


def given_sql(name: str) -> str:
    """The same as a SELECT of the oracle's SQL."""
    names = {t: t for t in ("documents", "labels", "conversations", "events", "pages")}
    columns = ", ".join(f'"{c}"' for c in re.findall(r'AS "(\w+)"', sql_table(name).split(" FROM ")[0]))
    return f"SELECT {columns} FROM ({DERIVED[name].format(**names)}) AS derived UNION ALL {sql_table(name)}"
