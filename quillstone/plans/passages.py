"""Queries of shared stretches, chunks and budgets, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import chunks as C
from quillstone.operators import overlap as O
from quillstone.plans.measure import docs, lit
from quillstone.sources.tables import read_table

OVERLAP = O.OverlapConfig()
CHUNKS = C.ChunkConfig(1000, ".。！？!?")
BUDGET, BUDGET_STOPS = 500, ".。！？!?；;"


def shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's longest stretch of at least 24 characters that a benchmark item has too."""
    return O.longest_shared(docs(spark, sf_dir), read_table(spark, sf_dir, "benchmark"), OVERLAP).select("doc_id", "item_id", "shared", "doc_start", "item_start", "passage")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_rows(docs(spark, sf_dir), CHUNKS)


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's start of whole sentences within a budget."""
    cut = C.within_budget(docs(spark, sf_dir), BUDGET, BUDGET_STOPS)
    return cut.select("doc_id", F.col("chars").cast("long").alias("chars"), "truncated", "submitted")


def _fold(parts: str, between: str) -> str:
    """Neighbours joined while they fit, by a fold over lists of one."""
    sep, size = (f" || {between}" if between else ""), CHUNKS.size
    room = f"length(acc[-1]) + {2 if between else 0} + length(x[1]) <= {size}"
    return f"coalesce(list_reduce(list_transform({parts}, lambda p: [p]), lambda acc, x: CASE WHEN {room} THEN acc[:-2] || [acc[-1]{sep} || x[1]] ELSE acc || x END), [])"


_S = CHUNKS.stops
_CUT = f"list_filter({_fold('regexp_extract_all(q, ' + lit(f'[^{_S}]*[{_S}]|[^{_S}]+$') + ')', '')}, lambda p: regexp_matches(p, '[^ ' || chr(9) || chr(10) || chr(13) || ']'))"
_G, _K, _B = OVERLAP.least, OVERLAP.gram, BUDGET_STOPS
_WHITE = "[ " + "".join(chr(c) for c in (9, 10, 11, 12, 13)) + "]"



def _grams_sql(source: str, key: str, place: str) -> str:
    """Stretches of the least length at every place: those that follow each other, from each of the first places on."""
    found = f"SELECT {key}, s, regexp_extract_all(substring(text, s + 1), '(?s).{{{_G}}}') AS m FROM {source}, range({_G}) AS r(s)"
    return f"SELECT {key}, s + {_G} * unnest(range(len(m))) AS {place}, unnest(m) AS g FROM ({found})"


QUERIES = {f.__name__: f for f in (shared_passages, document_chunks, submissions)}
ORACLE_SQL = {
    "shared_passages": f"""WITH bg AS ({_grams_sql('benchmark', 'item_id', 'j')}), dg AS ({_grams_sql('documents', 'doc_id', 'i')}),
        m AS (SELECT doc_id, item_id, i, j, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM dg JOIN bg USING (g)),
        r AS (SELECT doc_id, item_id, min(i) AS doc_start, min(j) AS item_start, count(*) + {_G - 1} AS shared FROM m GROUP BY doc_id, item_id, i - j, run),
        best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, item_id, doc_start, item_start) = 1)
        SELECT doc_id, item_id, coalesce(shared, 0) AS shared, doc_start, item_start, substring(text, doc_start + 1, shared) AS passage FROM documents LEFT JOIN best USING (doc_id)""",
    "document_chunks": f"""WITH q AS (SELECT doc_id, list_filter(regexp_split_to_array(text, chr(10) || '{{2,}}'), lambda p: regexp_matches(p, '[^ ' || chr(9) || chr(10) || chr(13) || ']')) AS qs FROM documents WHERE text IS NOT NULL),
        u AS (SELECT doc_id, flatten(list_transform(qs, lambda q: CASE WHEN length(q) <= {CHUNKS.size} THEN [q] ELSE {_CUT} END)) AS us FROM q),
        c AS (SELECT doc_id, {_fold('us', 'chr(10) || chr(10)')} AS cs FROM u WHERE len(us) > 0)
        SELECT doc_id, unnest(range(len(cs))) AS chunk, unnest(cs) AS piece FROM c""",
    "submissions": f"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^{_WHITE}+|{_WHITE}+$', '', 'g') AS t FROM documents),
        n AS (SELECT *, length(regexp_replace(t, '{_WHITE}+', '', 'g')) AS chars FROM t),
        p AS (SELECT doc_id, unnest(m) AS piece, unnest(range(len(m))) AS k FROM (SELECT doc_id, regexp_extract_all(t, {lit(f'[^{_B}]*[{_B}]')}) AS m FROM n WHERE chars > {BUDGET})),
        s AS (SELECT doc_id, sum(length(regexp_replace(piece, '{_WHITE}+', '', 'g'))) OVER o AS used, sum(length(piece)) OVER o AS last FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
        c AS (SELECT doc_id, CAST(max(last) AS BIGINT) AS last FROM s WHERE used <= {BUDGET} GROUP BY doc_id)
        SELECT doc_id, chars, chars > {BUDGET} AS truncated,
          regexp_replace(CASE WHEN chars <= {BUDGET} THEN t ELSE substring(t, 1, coalesce(last, {BUDGET})) END, '^{_WHITE}+|{_WHITE}+$', '', 'g') AS submitted
        FROM n LEFT JOIN c USING (doc_id)""",
}
