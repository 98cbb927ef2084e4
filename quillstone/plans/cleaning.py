"""Queries of the clean-up, of versions' differences and of windows of events, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions.lexicon import LATIN
from quillstone.operators import cleanup as C
from quillstone.plans.derived import given, given_sql
from quillstone.plans.fixtures import sql_table, table_of
from quillstone.plans.measure import docs, lit
from quillstone.sources.tables import read_table
from quillstone.streaming.scores import event_windows as windows


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, and written ones that hold what is cleaned up, under ids below 0."""
    return docs(spark, sf_dir).unionByName(table_of(spark, "cliche_docs"))


def limit_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", C.limit_marks("text").alias("cleaned"))


def dedupe_pads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", C.dedupe_pads("text", PADS).alias("cleaned"))


def strip_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", C.strip_leading(C.strip_cliches("text")).alias("cleaned"))


def typed_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "spaced").select("doc_id", C.strip_typed_spaces("original").alias("stripped"), C.restore_typed_spaces("original", "rewritten").alias("restored"))


def strip_edge_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", C.strip_edges("text").alias("cleaned"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", C.markup_text("html").alias("shown"))


def diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against itself after clean-up."""
    pairs = docs(spark, sf_dir).select("doc_id", F.col("text").alias("before"), C.strip_edges(C.limit_marks("text")).alias("after"))
    return C.diff_stats(pairs, LATIN.delimiters).select("doc_id", "kept", "deleted", "inserted")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(read_table(spark, sf_dir, "events"))


def _limited(marks) -> str:
    """Nested SELECTs, one for each mark, over a table with text."""
    out = "SELECT doc_id, text AS cleaned FROM t"
    for mark, most, instead in marks:
        rest = f"array_to_string(list_transform(p[{most + 2}:], lambda x: {lit(instead)} || x), '')"
        out = f"SELECT doc_id, array_to_string(p[1:{most + 1}], {lit(mark)}) || {rest} AS cleaned FROM (SELECT doc_id, string_split(cleaned, {lit(mark)}) AS p FROM ({out}))"
    return out


#: Pads of either script, each with its comma.
PADS = ("with, ", "from, ", "说真的，", "讲真，", "说白了，", "反正，", "总之，", *(f"{p} " for p in LATIN.pads))


def _shown() -> str:
    out = f"regexp_replace(regexp_replace(html, {lit(C.HIDDEN)}, ' ', 'g'), {lit(C.BREAKS)}, chr(10), 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', '', 'g')"
    for name, sign in C.ENTITIES:
        out = f"replace({out}, {lit(name)}, {lit(sign)})"
    lines = f"list_transform(string_split({out}, chr(10)), lambda s: regexp_replace(regexp_replace(s, '[ \t\r]+', ' ', 'g'), '^ | $', '', 'g'))"
    return f"array_to_string(list_filter({lines}, lambda s: s <> ''), chr(10))"


_ALL = f"SELECT doc_id, text FROM documents UNION ALL {sql_table('cliche_docs')}"


def _strip(expr: str, phrases, marks: str, comma: str, space: str = "") -> str:
    return f"regexp_replace({expr}, {lit(f'(^|[{marks}' + chr(10) + f']){space}{T.alternation(phrases, literal=True)}{comma}')}, '\\1', 'g')"


def _instead(expr: str) -> str:
    for phrase in sorted(C.INSTEAD, key=len, reverse=True):
        expr = f"replace({expr}, {lit(phrase)}, {lit(C.INSTEAD[phrase])})"
    return expr


def _closed(expr: str) -> str:
    blank = "[ " + chr(9) + "]+"
    return f"regexp_replace(regexp_replace({expr}, {lit('([一-龥，。；：、])' + blank + '([A-Za-z0-9])')}, '\\1\\2', 'g'), {lit('([A-Za-z0-9%）)' + chr(92) + ']])' + blank + '([一-龥])')}, '\\1\\2', 'g')"


def _opened(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '([一-龥])([A-Za-z0-9])', '\\1 \\2', 'g'), '([A-Za-z0-9])([一-龥])', '\\1 \\2', 'g')"


_EDGES = "array_to_string(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^[ \t]+|[ \t]+$', '', 'g')), chr(10))"

QUERIES = {f.__name__: f for f in (limit_marks, dedupe_pads, strip_phrases, typed_spaces, strip_edge_spaces, page_text, diff_stats, event_windows)}
ORACLE_SQL = {
    "limit_marks": f"WITH t AS ({_ALL}) {_limited(C.MARKS)}",
    "dedupe_pads": f"WITH t AS ({_ALL}) {_limited([(p, 1, '') for p in PADS])}",
    "strip_phrases": f"""WITH t AS ({_ALL}), c AS (SELECT doc_id, {_strip('text', C.CLICHES, '。！？；，、', '，?')} AS x FROM t), r AS (SELECT doc_id, {_instead('x')} AS x FROM c)
        SELECT doc_id, {_strip('x', C.CONNECTIVES, '。！？!?', '[，,]?', '[ ' + chr(9) + ']*')} AS cleaned FROM r""",
    "typed_spaces": f"""WITH p AS ({given_sql('spaced')}) SELECT doc_id, CASE WHEN regexp_matches(original, {lit(C.TYPED)}) THEN original ELSE {_closed('original')} END AS stripped,
        CASE WHEN regexp_matches(original, {lit(C.TYPED)}) THEN {_opened('rewritten')} ELSE rewritten END AS restored FROM p""",
    "strip_edge_spaces": f"SELECT doc_id, {_EDGES} AS cleaned FROM documents",
    "page_text": f"SELECT page_id, {_shown()} AS shown FROM pages",
    "event_windows": """
        SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS starts, event_type, count(*) AS n, count(DISTINCT user_id) AS users,
            min(value) AS low, max(value) AS high
        FROM events GROUP BY ALL""",
}
