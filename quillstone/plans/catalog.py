"""All queries by name, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.plans import audits, cleaning, experiments, gate, genres, measure, passages, revisions, scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**measure.QUERIES, **audits.QUERIES, **cleaning.QUERIES, **scores.QUERIES, **revisions.QUERIES, **passages.QUERIES, **genres.QUERIES, **experiments.QUERIES, **gate.QUERIES}
ORACLE_SQL: dict[str, str] = {**measure.ORACLE_SQL, **audits.ORACLE_SQL, **cleaning.ORACLE_SQL, **scores.ORACLE_SQL, **revisions.ORACLE_SQL, **passages.ORACLE_SQL, **genres.ORACLE_SQL, **experiments.ORACLE_SQL, **gate.ORACLE_SQL}
