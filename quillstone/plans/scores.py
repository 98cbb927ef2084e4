"""Queries of the local score, fingerprint, radar and calibrated predictions, each with its SQL twin."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quillstone.functions.lexicon import CHINESE, LATIN, Lexicon
from quillstone.operators import calibration as C
from quillstone.operators import local_score as L
from quillstone.operators import spans as S
from quillstone.plans.derived import given, given_sql
from quillstone.plans.fixtures import sql_table, table_of
from quillstone.plans.measure import W, bare, docs, feature_sql, has, lit, n_of, n_sum, spans_sql, trim
from quillstone.sources.tables import read_table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

THRESHOLDS = (0.1, 0.25, 0.4, 0.6)


def _held(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains(t, {lit(w)})::INT" for w in words) + ")"


def _occurrences(word: str) -> str:
    return f"CAST((length(t) - length(replace(t, {lit(word)}, ''))) / {len(word)} AS INT)"


def _at_most(pattern: str, rule: tuple[int, int]) -> str:
    return f"least({rule[1]}, {n_of('t', pattern)}) * {rule[0]}"


def score_sql(m: L.Marks, source: str) -> str:
    """Table ls: the columns of local_score; lt: those of the sentences beside the text."""
    d = m.delimiters
    parts = f"regexp_extract_all(t, {lit(f'[^{d}]*[{d}]+|[^{d}]+$')})"
    lens = f"list_transform(list_filter(list_transform({parts}, lambda s: {trim('s')}), lambda s: s <> ''), lambda s: length(regexp_replace(s, {lit(f'[{d}]')}, '', 'g')))"
    pieces = f"list_filter(list_transform(regexp_extract_all(t, {lit(f'[^{m.stops}{chr(10)}]*[{m.stops}]|[^{m.stops}{chr(10)}]+')}), lambda s: {trim('s')}), lambda s: s <> '')"
    plain = f"regexp_replace(s, {lit(f'[{m.stops}]+$')}, '')"
    bad = " OR ".join(has(plain if k.startswith("bare") else "s", p) for k, p in L.polluted_patterns(m).items())
    structure = " + ".join([_at_most(L.tail_particle(m), (L.TAIL[0], L.TAIL[1])), _at_most(L.orphan(m), L.ORPHAN), *(_at_most(L.pad_sentence(m, w), L.PAD_SENTENCE) for w in m.pad_sentences)])
    points = "CASE " + " ".join(f"WHEN polluted >= {a!r}::DOUBLE THEN {n}" for a, n in L.POLLUTED) + " ELSE 0 END"
    capped = lambda c, rule: f"least({rule[1]}, {c} * {rule[0]})"
    total = f"""{capped('hits', L.PHRASE)} + {capped('broken', L.BROKEN)} + {capped('typos', L.TYPO)} + least({L.STRUCTURE_MOST}, structure)
      + least(1.0::DOUBLE, greatest(0.0::DOUBLE, (avg_len - {L.LONG_FROM}) / {L.LONG_SPAN})) * {L.LONG_MOST}
      + CASE WHEN std_len BETWEEN {L.EVEN_STD[0]!r}::DOUBLE AND {L.EVEN_STD[1]!r}::DOUBLE THEN {L.EVEN_POINTS} ELSE 0 END"""
    return f"""
l0 AS (SELECT doc_id, coalesce(text, '') AS t FROM {source}),
l1 AS (SELECT *, {lens} AS lens, {pieces} AS pieces FROM l0),
lt AS (SELECT doc_id, t, pieces, len(lens) AS sentences, coalesce(list_avg(lens), 0.0)::DOUBLE AS avg_len, coalesce(list_stddev_pop(lens), 0.0)::DOUBLE AS std_len FROM l1),
l2 AS (SELECT *, {_held(m.phrases)} AS hits, {_held(m.broken)} AS broken, {n_sum('t', m.typos)} AS typos,
         CASE WHEN len(pieces) > 0 THEN len(list_filter(pieces, lambda s: {bad}))::DOUBLE / len(pieces) ELSE 0.0::DOUBLE END AS polluted, {structure} AS made FROM lt),
l3 AS (SELECT *, made + {points} AS structure FROM l2),
l4 AS (SELECT *, CASE WHEN sentences > 0 THEN CAST(floor(least(100.0::DOUBLE, greatest(0.0::DOUBLE, {total})) + 0.5) AS INT) ELSE 0 END AS score FROM l3),
ls AS (SELECT doc_id, sentences, hits, broken, typos, structure, round(polluted, 6) AS polluted, round(avg_len, 6) AS avg_len, round(std_len, 6) AS std_len, score,
         CASE WHEN score <= {L.HUMAN_MOST} THEN 'human' WHEN score >= {L.MACHINE_LEAST} THEN 'machine' WHEN score >= {L.CUT_OFF} THEN 'grey, machine side' ELSE 'grey, human side' END AS band FROM l4)"""


def issues_sql(m: L.Marks) -> str:
    """Of lt, fingerprint issues."""
    half, full = _occurrences(m.half_comma), _occurrences(m.full_comma)
    cv = "round(CASE WHEN avg_len > 0 THEN std_len / avg_len ELSE 0 END, 2)"
    lead = f"(?:^|[{m.stops}!?\n]{W}*)" + "(?:" + "|".join(map(re.escape, m.transitions)) + ")"
    kinds = [
        ("mixed spacing", n_sum("t", m.spaced), 0),
        *((f"repeated pad {w}", _occurrences(w + m.full_comma.strip()), 1) for w in m.pads),
        ("dashes", _occurrences(m.dash), 1),
        ("ellipses", _occurrences(m.ellipsis), 1),
        ("leading transition", n_of("t", lead), 0),
        ("stock phrase", _held(m.phrases), 0),
        ("even rhythm", f"(sentences >= {L.LEAST_CV[0]} AND {cv} < {L.LEAST_CV[1]!r}::DOUBLE)::INT", 0),
        ("suspect deviation", f"(sentences >= {L.SUSPECT_STD[0]} AND round(std_len, 1) BETWEEN {L.SUSPECT_STD[1]!r}::DOUBLE AND {L.SUSPECT_STD[2]!r}::DOUBLE)::INT", 0),
        ("half commas", f"CASE WHEN {half} > 0 AND {half}::DOUBLE / ({half} + {full}) > {L.HALF_SHARE!r}::DOUBLE THEN {half} ELSE 0 END", 0),
    ]
    made = ", ".join(f"{{'kind': {lit(k)}, 'n': CAST({c} AS INT), 'over': {over}}}" for k, c, over in kinds)
    return f"SELECT doc_id, x.kind AS kind, x.n AS n FROM (SELECT doc_id, unnest([{made}]) AS x FROM lt) WHERE x.n > x.over"


def _norm(value: str, low: float, high: float, invert: bool = False) -> str:
    r = f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({value} - {low!r}::DOUBLE) / ({high!r}::DOUBLE - {low!r}::DOUBLE)))"
    return f"(1 - {r})" if invert else r


def radar_sql(x: Lexicon, source: str) -> str:
    even = _norm("CASE WHEN len(lens) >= 2 AND list_avg(lens) > 0 THEN list_stddev_samp(lens) / list_avg(lens) ELSE 0.0::DOUBLE END", *L.RHYTHM, True)
    low, high = L.SUSPECT_STD[1:]
    suspect = f"len(lens) >= {L.SUSPECT_STD[0]} AND list_stddev_samp(lens) BETWEEN {low!r}::DOUBLE AND {high!r}::DOUBLE"
    share = f"CASE WHEN len(lens) > 0 THEN len(list_filter(lens, lambda n: n >= {L.LONG_SENTENCE}))::DOUBLE / len(lens) ELSE 0.0::DOUBLE END"
    made = {
        **{n: _norm(f"f_{n}", lo, hi, inv) for n, lo, hi, inv in L.DENSITIES},
        "rhythm": f"CASE WHEN {suspect} THEN greatest({even}, {L.RHYTHM_LEAST!r}::DOUBLE) ELSE {even} END",
        "long_share": _norm(share, *L.LONG_SHARE),
        "triple": _norm("tr", *L.TRIPLE),
    }
    return f"""{feature_sql(x, source)}, {spans_sql(x, source)},
r0 AS (SELECT doc_id, list(length({bare('sent')})) AS lens FROM a3 GROUP BY doc_id),
r1 AS (SELECT doc_id, {n_of('t', x.triple)} * 100.0::DOUBLE / greatest(1, chars) AS tr FROM b),
r2 AS (SELECT f.*, tr, coalesce(lens, []) AS lens FROM f JOIN r1 USING (doc_id) LEFT JOIN r0 USING (doc_id))
SELECT doc_id, {', '.join(f'round({v}, 6) AS r_{k}' for k, v in made.items())} FROM r2"""


def _six(frame, *columns: str):
    return frame.withColumns({c: F.round(c, 6) for c in columns})


def _register(suffix: str, m: L.Marks, x: Lexicon, source: str | None) -> None:
    read = docs if source is None else (lambda spark, _: table_of(spark, source))
    name, prefix = ("documents", "") if source is None else (source, f"{source} AS ({sql_table(source)}),")
    QUERIES[f"local_score{suffix}"] = lambda s, d: _six(L.local_score(read(s, d), m), "polluted", "avg_len", "std_len")
    ORACLE_SQL[f"local_score{suffix}"] = f"WITH {prefix}{score_sql(m, name)} SELECT * FROM ls"
    QUERIES[f"fingerprint_issues{suffix}"] = lambda s, d: L.fingerprint_issues(read(s, d), m)
    ORACLE_SQL[f"fingerprint_issues{suffix}"] = f"WITH {prefix}{score_sql(m, name)} {issues_sql(m)}"

    def rounded(s, d):
        found = L.radar(read(s, d), x)
        return _six(found, *(c for c in found.columns if c != "doc_id"))

    QUERIES[f"radar{suffix}"] = rounded
    ORACLE_SQL[f"radar{suffix}"] = f"WITH {prefix}{radar_sql(x, name)}"


_register("", L.LATIN_MARKS, LATIN, None)
_register("_zh", L.CHINESE_MARKS, CHINESE, "score_docs")

QUERIES["pollution_sweep"] = lambda s, d: L.pollution_sweep(docs(s, d), read_table(s, d, "labels"), L.LATIN_MARKS, THRESHOLDS)
ORACLE_SQL["pollution_sweep"] = f"""WITH {score_sql(L.LATIN_MARKS, 'documents')},
th AS (SELECT unnest([{', '.join(f'{x!r}::DOUBLE' for x in THRESHOLDS)}]) AS threshold), r AS (SELECT polluted, quality FROM l2 JOIN labels USING (doc_id))
SELECT threshold, count(*) FILTER (WHERE polluted >= threshold AND quality = 1) AS good, count(*) FILTER (WHERE polluted >= threshold AND quality = 0) AS bad FROM r, th GROUP BY threshold"""

QUERIES["score_totals"] = lambda s, d: L.local_score(docs(s, d), L.LATIN_MARKS).agg(F.count("*").alias("texts"), F.sum("sentences").alias("sentences"), F.count_if(F.col("sentences") == 0).alias("empty"), F.round(F.avg("score"), 6).alias("mean_score"))
ORACLE_SQL["score_totals"] = f"WITH {score_sql(L.LATIN_MARKS, 'documents')} SELECT count(*) AS texts, CAST(sum(sentences) AS BIGINT) AS sentences, count(*) FILTER (WHERE sentences = 0) AS empty, round(avg(score), 6) AS mean_score FROM ls"

QUERIES["score_predictions"] = lambda s, d: _six(L.predicted(given(s, d, "scored"), table_of(s, "tracks")), "percent")
ORACLE_SQL["score_predictions"] = f"""WITH scored AS ({given_sql('scored')}), tracks AS ({sql_table('tracks')}),
k AS (SELECT *, CASE WHEN genre IN ('narrative', 'dialogue') THEN genre WHEN genre = 'humanHand' THEN 'human' ELSE 'main' END AS track FROM scored),
p AS (SELECT *, least(100.0::DOUBLE, greatest(0.0::DOUBLE, a * score + b)) AS pct FROM k JOIN tracks USING (track))
SELECT id, track, round(pct, 6) AS percent, CASE WHEN pct >= {S.OFFICIAL_AI} THEN 'ai' WHEN pct >= {S.OFFICIAL_SUSPECTED} THEN 'suspected' ELSE 'human' END AS label,
       CASE WHEN pct <= 20 THEN 'safe' WHEN pct <= 40 THEN 'fair' WHEN pct <= 60 THEN 'doubtful' WHEN pct <= 80 THEN 'heavy' ELSE 'rewrite' END AS advice,
       coalesce(score >= sat, false) AS saturated FROM p"""

QUERIES["scale_guard"] = lambda s, d: _six(L.scale_guard(given(s, d, "scale")), "apart")
ORACLE_SQL["scale_guard"] = f"""WITH scale AS ({given_sql('scale')}),
g AS (SELECT max(score) FILTER (WHERE kind = 'human') AS human_most, min(score) FILTER (WHERE kind = 'machine') AS machine_least,
        avg(score) FILTER (WHERE kind = 'machine') - avg(score) FILTER (WHERE kind = 'human') AS apart FROM scale)
SELECT human_most, machine_least, round(apart, 6) AS apart, human_most <= {L.HUMAN_MOST} AND machine_least >= {L.MACHINE_LEAST} AND apart >= {L.LEAST_APART} AS ok FROM g"""

_ERRORS = ("slope", "se", "se_slope", "se_intercept", "slope_low", "slope_high", "max_residual")
QUERIES["ols_errors"] = lambda s, d: _six(C.ols_errors(given(s, d, "calib_points")), *_ERRORS)
ORACLE_SQL["ols_errors"] = f"""WITH calib_points AS ({given_sql('calib_points')}),
l AS (SELECT track, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS c, avg(x) AS mx, var_pop(x) * count(*) AS sxx FROM calib_points GROUP BY track HAVING count(*) > 2 AND var_pop(x) > 0),
r AS (SELECT track, any_value(n) AS n, any_value(slope) AS slope, any_value(mx) AS mx, any_value(sxx) AS sxx, sum((y - c - slope * x) ** 2) AS ssr, max(abs(y - c - slope * x)) AS max_residual FROM calib_points JOIN l USING (track) GROUP BY track),
e AS (SELECT *, sqrt(ssr / (n - 2)) AS se, CASE n - 2 WHEN 1 THEN 12.706::DOUBLE WHEN 2 THEN 4.303::DOUBLE WHEN 3 THEN 3.182::DOUBLE ELSE 2.776::DOUBLE END AS t FROM r)
SELECT track, n, round(slope, 6) AS slope, round(se, 6) AS se, round(se / sqrt(sxx), 6) AS se_slope, round(se * sqrt(1.0::DOUBLE / n + mx * mx / sxx), 6) AS se_intercept,
       round(slope - t * se / sqrt(sxx), 6) AS slope_low, round(slope + t * se / sqrt(sxx), 6) AS slope_high, round(max_residual, 6) AS max_residual FROM e"""

QUERIES["judge_median"] = lambda s, d: C.plain_median(given(s, d, "judgements"))
ORACLE_SQL["judge_median"] = f"WITH judgements AS ({given_sql('judgements')}) SELECT doc_id, CAST(floor(median(score) + 0.5) AS BIGINT) AS median FROM judgements WHERE score IS NOT NULL GROUP BY doc_id"
