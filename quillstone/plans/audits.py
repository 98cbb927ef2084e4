"""Queries of the audits, calibrations and reports, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions.lexicon import LATIN
from quillstone.operators import audit as A
from quillstone.operators import calibration as C
from quillstone.operators import detector as D
from quillstone.operators import spans as S
from quillstone.plans.derived import given, given_sql
from quillstone.plans.fixtures import sql_table, table_of
from quillstone.sources.tables import read_table
from quillstone.plans.measure import bare, base_sql, docs, feature_sql, has, lit, n_of, trim

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


#: What the pairs of documents add to a text, by what is to be found: a connective without its partner and somebody's experience; a
#: heading and a scene that only the original has.
ADDED, STRUCTURED = "\n其次，我见过。", "# Title\n【场景：hall】\n"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a rewrite, by the remainder of the id: digits changed, the first third kept, the text doubled, a connective and an
    experience added, heading and scene dropped, a stub of the first words put before; and the written pairs, one of which at least
    each audit finds and one it doesn't, under ids below 0."""
    text = F.coalesce("text", F.lit(""))
    kind = F.col("doc_id") % 6
    third = F.substring(text, F.lit(1), F.floor(F.length(text) / 3).cast("int"))
    new = F.when(kind == 0, F.regexp_replace(text, "[0-9]", "7")).when(kind == 1, third).when(kind == 2, F.concat(text, F.lit(" Zebra 42. "), text))
    new = new.when(kind == 3, F.concat(text, F.lit(ADDED))).when(kind == 5, F.concat(F.substring(text, 3, 4), F.lit("\n"), text)).otherwise(text)
    old = F.when(kind == 4, F.concat(F.lit(STRUCTURED), text)).otherwise(text)
    return docs(spark, sf_dir).select("doc_id", old.alias("original"), new.alias("rewritten")).unionByName(table_of(spark, "zh_pairs"))


PAIRS = f"""pr AS (
  SELECT doc_id, CASE doc_id % 6 WHEN 4 THEN {lit(STRUCTURED)} ELSE '' END || t AS original,
         CASE doc_id % 6 WHEN 0 THEN regexp_replace(t, '[0-9]', '7', 'g') WHEN 1 THEN substring(t, 1, CAST(floor(length(t) / 3) AS INT))
                         WHEN 2 THEN t || ' Zebra 42. ' || t WHEN 3 THEN t || {lit(ADDED)} WHEN 5 THEN substring(t, 3, 4) || chr(10) || t ELSE t END AS rewritten
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) UNION ALL {sql_table('zh_pairs')})"""


def _side(column: str, pattern: str, made: str = "{}") -> str:
    return f"SELECT doc_id, {made.format(f'unnest(regexp_extract_all({column}, {lit(pattern)}))')} AS token FROM pr"


_NUMBERS = f"""nb AS (SELECT doc_id, token, count(*) AS before FROM ({_side('original', A.NUMBER)}) GROUP BY ALL),
na AS (SELECT doc_id, token, count(*) AS after FROM ({_side('rewritten', A.NUMBER)}) GROUP BY ALL),
nf AS (SELECT doc_id, token, coalesce(before, 0) AS before, coalesce(after, 0) AS after FROM nb FULL JOIN na USING (doc_id, token)),
nd AS (SELECT *, CASE WHEN after < before THEN 'lost' ELSE 'invented' END AS kind FROM nf WHERE after < before OR before = 0)"""
_TERMS = f"tl AS (SELECT * FROM (SELECT DISTINCT * FROM ({_side('original', A.TERM, 'upper({})')})) ANTI JOIN (SELECT DISTINCT * FROM ({_side('rewritten', A.TERM, 'upper({})')})) USING (doc_id, token))"
_SIZES = f"""sz AS (
  SELECT doc_id, before, after, unnest(list_filter([CASE WHEN t = '' THEN 'empty' END, CASE WHEN t <> '' AND NOT {has('t', A.FINISHED)} THEN 'unfinished' END,
      CASE WHEN t <> '' AND after < 0.4::DOUBLE * before THEN 'shrunk' END, CASE WHEN before >= 60 AND after > 1.5::DOUBLE * before AND after - before > 60 THEN 'inflated' END], lambda k: k IS NOT NULL)) AS kind
  FROM (SELECT doc_id, length({bare('original')}) AS before, length({bare('rewritten')}) AS after, {trim('rewritten')} AS t FROM pr))"""
_LOST = (("scene", A.SCENE, "after < before"), ("heading", A.HEADING, "after < before"), ("role", A.ROLE, "before >= 2 AND after = 0"))
_STRUCTURE = "st AS (" + " UNION ALL ".join(f"SELECT doc_id, kind, before, after FROM (SELECT doc_id, '{k}' AS kind, {n_of('original', p)} AS before, {n_of('rewritten', p)} AS after, {trim('rewritten')} AS t FROM pr) WHERE {w} AND t <> ''" for k, p, w in _LOST) + ")"
_CLAUSES = lambda c: f"list_filter(list_transform(regexp_split_to_array({c}, {lit(A.CLAUSE_CUT)}), lambda q: {trim('q')}), lambda q: q <> '')"
_COLLAPSED = f"""c0 AS (SELECT doc_id, {_CLAUSES('original')} AS a, {_CLAUSES('rewritten')} AS b FROM pr),
c1 AS (SELECT doc_id, list_filter(a, lambda q: length(q) >= 4 AND NOT list_contains(b, q)) AS gone, unnest(list_transform(b, lambda q: regexp_replace(q, {lit(A.PARTICLES)}, ''))) AS clause FROM c0),
cl AS (SELECT doc_id, clause, list_filter(gone, lambda q: starts_with(q, clause) AND length(q) - length(clause) >= 2)[1] AS source FROM c1 WHERE length(clause) BETWEEN 4 AND 16),
co AS (SELECT * FROM cl WHERE source IS NOT NULL)"""


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


_add("number_fidelity", lambda s, d: A.number_fidelity(pairs(s, d)), f"WITH {PAIRS}, {_NUMBERS} SELECT doc_id, token, before, after, kind FROM nd")
_add("term_loss", lambda s, d: A.term_loss(pairs(s, d)), f"WITH {PAIRS}, {_TERMS} SELECT doc_id, token FROM tl")
_add("size_issues", lambda s, d: A.size_issues(pairs(s, d)), f"WITH {PAIRS}, {_SIZES} SELECT doc_id, before, after, kind FROM sz")
_add("structure_loss", lambda s, d: A.structure_loss(pairs(s, d)), f"WITH {PAIRS}, {_STRUCTURE} SELECT * FROM st")
_add("collapse", lambda s, d: A.collapsed_clauses(pairs(s, d)), f"WITH {PAIRS}, {_COLLAPSED} SELECT doc_id, clause, source FROM co")
_STUBS = f"""s0 AS (SELECT doc_id, original, unnest(list_transform(regexp_split_to_array(rewritten, {lit(A.SENTENCE_CUT)}), lambda q: {trim('q')})) AS stub FROM pr),
s1 AS (SELECT *, instr(original, stub) AS k FROM s0 WHERE length(stub) BETWEEN 2 AND 6 AND NOT {has('stub', A.LATIN_PREDICATE)}),
du AS (SELECT doc_id, stub FROM s1 WHERE k > 0 AND NOT ((k = 1 OR {has('substring(original, k - 1, 1)', A.SENTENCE_CUT)})
  AND (k + length(stub) > length(original) OR {has('substring(original, k + length(stub), 1)', A.SENTENCE_CUT)})))"""
_add("deletion_stubs", lambda s, d: A.deletion_stubs(pairs(s, d), A.LATIN_PREDICATE), f"WITH {PAIRS}, {_STUBS} SELECT doc_id, stub FROM du")
_MORE = lambda p: f"{n_of('rewritten', p)} - {n_of('original', p)}"
_add(
    "added_content",
    lambda s, d: A.added_content(pairs(s, d)),
    f"""WITH {PAIRS}, m0 AS (SELECT doc_id, {_MORE('我')} AS f, {_MORE(A.SPECIFIC)} AS c, length({bare('original')}) AS n, length({bare('rewritten')}) AS m FROM pr),
m1 AS (SELECT *, CASE WHEN n > 0 THEN m / n::DOUBLE ELSE 0 END AS r FROM m0)
SELECT doc_id, 'first person' AS signal, f AS n FROM m1 WHERE f >= 3 UNION ALL SELECT doc_id, 'concrete', c FROM m1 WHERE c >= 2
UNION ALL SELECT doc_id, 'longer', CAST(floor(r * 100 + 0.5) AS INT) FROM m1 WHERE r > 1.1::DOUBLE AND r <= 1.5::DOUBLE""",
)
_add(
    "adjacent_duplicates",
    lambda s, d: A.adjacent_duplicates(D.sentence_table(docs(s, d), LATIN, "doc_id")),
    f"WITH {base_sql(LATIN, 'documents')} SELECT doc_id, sent_idx FROM (SELECT doc_id, sent_idx, sent, lag(sent) OVER (PARTITION BY doc_id ORDER BY sent_idx) AS b FROM s) WHERE sent = b",
)
_signal_sql = " UNION ALL ".join(f"SELECT doc_id, {lit(p)} AS phrase FROM pr WHERE contains(rewritten, {lit(p)}) AND NOT contains(original, {lit(p)})" for p in A.EXPERIENCE)
_partner_sql = " UNION ALL ".join(f"SELECT doc_id, {lit(a)} AS connective FROM pr WHERE contains(rewritten, {lit(a)}) AND NOT (" + " OR ".join(f"contains(rewritten, {lit(b)})" for b in bs) + ")" for a, bs in A.PARTNERS.items())
_COHERENCE = f"{_partner_sql} UNION ALL SELECT doc_id, 'opening pronoun' FROM pr WHERE {has(trim('rewritten'), A.OPENING_PRONOUN)}"
_add("fabrication_signals", lambda s, d: A.new_signals(pairs(s, d)), f"WITH {PAIRS} {_signal_sql}")
_add("coherence", lambda s, d: A.unpaired(pairs(s, d)), f"WITH {PAIRS} {_COHERENCE}")


def _fixture(name: str, source: str, query, sql: str) -> None:
    _add(name, lambda s, d: query(given(s, d, source)), f"WITH {source} AS ({given_sql(source)}) {sql}")


def _rounded(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, 6) for c in columns})


_LINES = """CASE WHEN var_pop(x) = 0 THEN 1.0::DOUBLE ELSE regr_slope(y, x) END AS slope,
  CASE WHEN var_pop(x) = 0 THEN avg(y) - avg(x) ELSE regr_intercept(y, x) END AS intercept, CASE WHEN var_pop(x) <> 0 THEN regr_r2(y, x) END AS r2"""
_OUT = "track, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2"
_fixture("ols_fit", "calib_points", lambda f: _rounded(C.ols_lines(f), "slope", "intercept", "r2"), f"SELECT {_OUT} FROM (SELECT track, count(*) AS n, {_LINES} FROM calib_points GROUP BY track)")
_fixture(
    "robust_fit", "calib_points", lambda f: _rounded(C.robust_lines(f), "slope", "intercept", "r2"),
    f""", l AS (SELECT track, count(*) AS n, {_LINES} FROM calib_points GROUP BY track),
r AS (SELECT p.*, l.n, row_number() OVER (PARTITION BY track ORDER BY abs(y - slope * x - intercept) DESC, x, y) AS k FROM calib_points p JOIN l USING (track)),
k AS (SELECT track, x, y FROM r WHERE k > 1 OR n < 3)
SELECT {_OUT} FROM (SELECT track, count(*) AS n, {_LINES} FROM k GROUP BY track)""",
)
_fixture(
    "weight_grid", "samples", C.weight_grid,
    """, g AS (SELECT w, round(sum(((1 - w) * "local" + w * semantic - official) ** 2), 6) AS sse, count(*) AS n
  FROM samples, (SELECT unnest(range(0, 21)) / 20.0::DOUBLE AS w) WHERE semantic IS NOT NULL AND official IS NOT NULL GROUP BY w)
SELECT w, sse, n FROM g ORDER BY sse, w LIMIT 1""",
)
_fixture(
    "panel_weighted_median", "judgements", C.weighted_panel,
    """, v AS (SELECT doc_id, score, unnest(range(0, greatest(1, CAST(floor(coalesce(weight, 1) + 0.5) AS BIGINT)))) FROM judgements WHERE score IS NOT NULL)
SELECT doc_id, CAST(floor(median(score) + 0.5) AS BIGINT) AS median, (SELECT max(score) - min(score) FROM judgements j WHERE j.doc_id = v.doc_id) AS spread,
       (SELECT count(score) FROM judgements j WHERE j.doc_id = v.doc_id) AS valid FROM v GROUP BY doc_id""",
)
_BUCKETS = {"rhythm": "整齐|单一", "cliche": "套话"}
_fixture(
    "critique_votes", "judgements", lambda f: C.cross_votes(f, _BUCKETS),
    """SELECT doc_id, bucket, count(DISTINCT seat) AS seats FROM (
  SELECT *, CASE WHEN regexp_matches(critique, '整齐|单一') THEN 'rhythm' WHEN regexp_matches(critique, '套话') THEN 'cliche' ELSE critique END AS bucket FROM judgements)
GROUP BY doc_id, bucket HAVING count(DISTINCT seat) >= 2""",
)
_fixture("drift_report", "baseline", C.drift, "SELECT *, drifted <= 6 AND largest <= 35 AS ok FROM (SELECT count(*) AS n, count(*) FILTER (WHERE abs(score - want) > 3) AS drifted, max(abs(score - want)) AS largest FROM baseline)")
_fixture(
    "ratchet", "baseline", C.ratchet,
    """SELECT *, score - want AS delta, CASE WHEN CASE WHEN direction = 'down' THEN score > want ELSE score < want END THEN 'regressed'
  WHEN score = want THEN 'same' ELSE 'improved' END AS verdict FROM baseline""",
)
_fixture(
    "score_conflict", "external", C.conflicts,
    """SELECT id, source, "local", score, gap, severe FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY severe DESC, gap DESC, source) AS k FROM (
  SELECT *, score - "local" AS gap, "local" <= 27 AS severe FROM external WHERE score >= 60 AND score - "local" >= 30)) WHERE k = 1""",
)
_fixture(
    "stage_trace", "stages", C.stage_report,
    """, t AS (SELECT *, coalesce(chars - lag(chars) OVER (PARTITION BY run ORDER BY seq), 0) AS delta FROM stages)
SELECT id, sum(ms) AS ms, CAST(sum(delta) AS BIGINT) AS delta, max_by(chars, run * 1000 + seq) AS last_chars, count(*) AS runs, bool_and(skipped) AS all_skipped FROM t GROUP BY id""",
)
_fixture("best_of_n", "candidates", C.best_of, "SELECT doc_id, candidate, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score, candidate) AS k FROM candidates WHERE NOT vetoed) WHERE k = 1")
_PARTS = lambda c: f"list_distinct(list_filter(string_split({c}, ','), lambda x: x <> ''))"
_fixture(
    "stop_rules", "rounds", C.stop_rules,
    f""", p AS (SELECT *, {_PARTS('issues')} AS i, {_PARTS('critiques')} AS c FROM rounds),
w AS (SELECT *, last_value(CASE WHEN len(i) > 0 THEN i END IGNORE NULLS) OVER v AS pi, last_value(CASE WHEN len(c) > 0 THEN c END IGNORE NULLS) OVER v AS pc, min(score) OVER v AS best
  FROM p WINDOW v AS (PARTITION BY doc_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN anchor <= 28 THEN anchor ELSE greatest(10, CAST(floor(0.35::DOUBLE * anchor + 0.5) AS BIGINT)) END AS target FROM w)
SELECT doc_id, round, target, CASE WHEN round > 0 AND len(list_filter(i, lambda x: NOT list_contains(coalesce(pi, []), x))) > 0 THEN 'new issue'
  WHEN len(list_intersect(c, coalesce(pc, []))) >= 2 THEN 'repeated critiques' WHEN round > 0 AND score <= target THEN 'target'
  WHEN score >= best THEN 'no improvement' ELSE 'go on' END AS why FROM t""",
)
_KNOWN = ["a", "b", "c", "d", "e"]
_fixture(
    "ledger_audit", "ledger", lambda f: C.ledger_audit(f, _KNOWN),
    """, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line) AS nth FROM ledger)
SELECT id, 'repeated id' AS problem FROM n WHERE nth > 1 UNION ALL SELECT id, 'missing url' FROM n WHERE url IS NULL
UNION ALL SELECT id, 'label contradicts' FROM n WHERE label <> CASE WHEN pct >= 60 THEN 'ai' WHEN pct >= 30 THEN 'suspected' ELSE 'human' END
UNION ALL SELECT id, 'out of range' FROM n WHERE NOT pct BETWEEN 0 AND 100 UNION ALL SELECT id, 'unknown id' FROM n WHERE id NOT IN ('a', 'b', 'c', 'd', 'e')
UNION ALL SELECT id, 'no line' FROM (VALUES ('a'), ('b'), ('c'), ('d'), ('e')) AS k(id) WHERE id NOT IN (SELECT id FROM ledger)""",
)
_add(
    "append_only_check", lambda s, d: C.append_only(given(s, d, "ledger_old"), given(s, d, "ledger").select("line", "sha")),
    f"""WITH o AS ({given_sql('ledger_old')}), n AS ({given_sql('ledger')})
SELECT line, what FROM (SELECT o.line, CASE WHEN n.sha IS NULL THEN 'truncated' ELSE 'modified' END AS what FROM o LEFT JOIN n USING (line) WHERE n.sha IS NULL OR n.sha <> o.sha) ORDER BY line LIMIT 1""",
)
_fixture(
    "outside_scores", "raw_scores", C.outside_scores,
    """, n AS (SELECT id, coalesce(json_extract_string(raw, '$.status') = 'error', false) AS failed, TRY_CAST(json_extract_string(raw, '$.data.score') AS DOUBLE) AS x FROM raw_scores)
SELECT id, CASE WHEN NOT failed THEN CAST(floor(least(100.0, greatest(0.0, CASE WHEN x <= 1 THEN x * 100 ELSE x END)) + 0.5) AS BIGINT) END AS score FROM n""",
)
_fixture(
    "official_results", "official_results", C.said_results,
    """, l AS (SELECT id, said, CASE WHEN contains(said, '疑似') THEN 'suspected' WHEN contains(said, '人工') THEN 'human' WHEN contains(said, 'AI') THEN 'ai' END AS label FROM official_results)
SELECT id, label, coalesce(TRY_CAST(nullif(regexp_extract(said, '([0-9]+(?:[.][0-9]+)?) *%', 1), '') AS DOUBLE),
  CASE label WHEN 'ai' THEN 90.0 WHEN 'suspected' THEN 45.0 WHEN 'human' THEN 10.0 END) AS pct FROM l""",
)
_fixture(
    "ppl_layer", "nll_windows", lambda f: _rounded(S.perplexity_layer(S.nll_windows(f)), "mean_nll", "window_std", "perplexity", "layer").withColumn("issues", F.array_join("issues", ", ")),
    """, a AS (SELECT doc_id, sum(mean_nll * scored) / sum(scored) AS m, coalesce(stddev_samp(mean_nll), 0) AS d, CAST(sum(scored) AS BIGINT) AS scored, count(*) AS windows FROM nll_windows WHERE scored > 0 GROUP BY doc_id)
SELECT doc_id, round(m, 6) AS mean_nll, round(d, 6) AS window_std, scored, windows, round(exp(m), 6) AS perplexity,
  CASE WHEN scored >= 60 THEN round((0.7::DOUBLE * least(1.0, greatest(0.0, (0.98::DOUBLE - m) / 0.56::DOUBLE)) + 0.3::DOUBLE * CASE WHEN windows >= 3 THEN least(1.0, greatest(0.0, 1 - d / 0.35::DOUBLE)) ELSE 0.5 END) * 100, 6) END AS layer,
  array_to_string(list_filter([CASE WHEN scored >= 60 AND m < 0.7::DOUBLE THEN 'low perplexity' END, CASE WHEN scored >= 60 AND windows >= 3 AND d < 0.12::DOUBLE THEN 'flat perplexity' END], lambda z: z IS NOT NULL), ', ') AS issues FROM a""",
)
_fixture(
    "fuse_layers", "layers", S.fuse_layers,
    """SELECT *, CAST(floor((1 - 0.8::DOUBLE) * surface + 0.8::DOUBLE * semantic + 0.5) AS BIGINT) AS fused, abs(surface - semantic) AS divergence,
  CAST(floor(least(100.0, greatest(0.0, 92 - 0.52::DOUBLE * abs(surface - semantic))) + 0.5) AS BIGINT) AS fused_confidence FROM layers""",
)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels").select("doc_id", "quality")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect(docs(spark, sf_dir), LATIN).select("doc_id", F.col("probability").alias("score"))


_SCORED = f"{feature_sql(LATIN, 'documents')}, z AS (SELECT v.probability AS score, l.quality FROM v JOIN labels l USING (doc_id))"
_add(
    "separation", lambda s, d: C.separation(scored(s, d), labels(s, d)),
    f"WITH {_SCORED} SELECT count(*) AS n, round(avg(score) FILTER (WHERE quality = 0), 6) AS low, round(avg(score) FILTER (WHERE quality = 1), 6) AS high, round(avg(score) FILTER (WHERE quality = 0) - avg(score) FILTER (WHERE quality = 1), 6) AS apart FROM z",
)
_add(
    "threshold_sweep", lambda s, d: C.threshold_sweep(scored(s, d), labels(s, d), 30, 70, 5),
    f"WITH {_SCORED} SELECT threshold, count(*) FILTER (WHERE quality = 1 AND score >= threshold) AS false_alarms, count(*) FILTER (WHERE quality = 0 AND score < threshold) AS misses FROM z, (SELECT unnest(range(30, 71, 5)) AS threshold) GROUP BY threshold",
)
_add(
    "score_rollup",
    lambda s, d: read_table(s, d, "documents").select("lang", "source", T.visible_length("text").alias("n")).rollup("lang", "source").agg(F.count("*").alias("docs"), F.sum("n").alias("chars")),
    f"SELECT lang, source, count(*) AS docs, CAST(sum(length({bare('text')})) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang, source)",
)
_add(
    "dialogue_turns",
    lambda s, d: read_table(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.countDistinct("role").alias("roles"), F.max_by("role", "turn").alias("last_role"), F.sum(T.visible_length("text")).alias("chars")),
    f"SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, max_by(role, turn) AS last_role, CAST(sum(length({bare('text')})) AS BIGINT) AS chars FROM conversations GROUP BY conv_id",
)
