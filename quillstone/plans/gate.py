"""The query of the hard gate, which puts all audits and the fingerprint together, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.operators import audit as A
from quillstone.operators import local_score as L
from quillstone.plans.audits import _COHERENCE, _COLLAPSED, _NUMBERS, _SIZES, _STRUCTURE, _STUBS, _TERMS, PAIRS, _signal_sql, pairs
from quillstone.plans.measure import lit
from quillstone.plans.scores import issues_sql, score_sql


def hard_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the rewrites of documents and the written ones are refused for."""
    return A.hard_gate(pairs(spark, sf_dir), L.LATIN_MARKS, A.LATIN_PREDICATE)


QUERIES = {"hard_gate": hard_gate}
ORACLE_SQL = {
    "hard_gate": f"""WITH {PAIRS}, {_NUMBERS}, {_TERMS}, {_SIZES}, {_STRUCTURE}, {_COLLAPSED}, {_STUBS}, ch AS ({_COHERENCE}), fs AS ({_signal_sql}),
  tx AS (SELECT doc_id, rewritten AS text FROM pr), {score_sql(L.LATIN_MARKS, 'tx')}, fi AS ({issues_sql(L.LATIN_MARKS)})
SELECT doc_id, 'number ' || kind AS issue, token AS detail FROM nd UNION ALL SELECT doc_id, 'term lost', token FROM tl
UNION ALL SELECT doc_id, kind, '' FROM sz UNION ALL SELECT doc_id, kind || ' lost', '' FROM st UNION ALL SELECT doc_id, 'collapsed', clause FROM co
UNION ALL SELECT doc_id, 'stub', stub FROM du UNION ALL SELECT doc_id, 'unpaired', connective FROM ch UNION ALL SELECT doc_id, 'experience added', phrase FROM fs
UNION ALL SELECT doc_id, 'trace', kind FROM fi WHERE kind NOT IN ({', '.join(map(lit, A.NOT_VETOING))})"""
}
