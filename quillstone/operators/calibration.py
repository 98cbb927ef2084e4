"""Calibration, panels, ratchets and run reports: aggregates over scored samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import text as T


def ols_lines(points: DataFrame, by: str = "track") -> DataFrame:
    """Slope, intercept, R squared of y over x; one point shifts, points of one x have slope 1."""
    n, flat = F.count("*"), F.coalesce(F.var_pop("x"), F.lit(0.0)) == 0
    slope = F.when(flat, 1.0).otherwise(F.regr_slope("y", "x"))
    return points.groupBy(by).agg(n.alias("n"), slope.alias("slope"), F.when(flat, F.avg("y") - F.avg("x")).otherwise(F.regr_intercept("y", "x")).alias("intercept"), F.when(~flat, F.regr_r2("y", "x")).alias("r2"))


#: 95 % points of Student's t by degrees of freedom, and of all from four up.
STUDENT, STUDENT_MORE = {1: 12.706, 2: 4.303, 3: 3.182}, 2.776


def ols_errors(points: DataFrame, by: str = "track") -> DataFrame:
    """Of each line with three points or more at different x: standard errors, 95 % bounds of its slope, largest residual."""
    lines = ols_lines(points, by).where("n > 2 AND r2 IS NOT NULL")
    both = points.join(lines, by).withColumn("residual", F.col("y") - F.col("slope") * F.col("x") - F.col("intercept"))
    out = both.groupBy(by, "n", "slope").agg(F.sum(F.col("residual") * F.col("residual")).alias("ssr"), F.avg("x").alias("mx"), (F.var_pop("x") * F.count("*")).alias("sxx"), F.max(F.abs("residual")).alias("max_residual"))
    se = F.sqrt(F.col("ssr") / (F.col("n") - 2))
    t = F.lit(STUDENT_MORE)
    for degrees, value in STUDENT.items():
        t = F.when(F.col("n") - 2 == degrees, value).otherwise(t)
    out = out.withColumns({"se": se, "se_slope": se / F.sqrt("sxx"), "se_intercept": se * F.sqrt(1 / F.col("n") + F.col("mx") * F.col("mx") / F.col("sxx"))})
    away = t * F.col("se_slope")
    return out.select(by, "n", "slope", "se", "se_slope", "se_intercept", (F.col("slope") - away).alias("slope_low"), (F.col("slope") + away).alias("slope_high"), "max_residual")


def plain_median(judgements: DataFrame) -> DataFrame:
    """Median score of each document, of an even number the mean of the middle two, halves upwards."""
    return judgements.where("score IS NOT NULL").groupBy("doc_id").agg(T.half_up(F.median("score")).alias("median"))


def robust_lines(points: DataFrame, by: str = "track") -> DataFrame:
    """Lines fitted again without each track's point of largest residual."""
    lines = ols_lines(points, by)
    residual = points.join(lines, by).withColumn("residual", F.abs(F.col("y") - F.col("slope") * F.col("x") - F.col("intercept")))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("residual"), "x", "y"))
    kept = residual.withColumn("rank", rank).where((F.col("rank") > 1) | (F.col("n") < 3)).select(by, "x", "y")
    return ols_lines(kept, by)


def weight_grid(samples: DataFrame, steps: int = 20) -> DataFrame:
    """Weight of the semantic score that fits the official one best, the least weight of ties; the grid has fixed size."""
    known = samples.where("semantic IS NOT NULL AND official IS NOT NULL")
    grid = known.withColumn("w", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: k / steps)))
    error = (1 - F.col("w")) * F.col("local") + F.col("w") * F.col("semantic") - F.col("official")
    sums = grid.groupBy("w").agg(F.sum(error * error).alias("sse"), F.count("*").alias("n"))
    return sums.agg(F.min(F.struct(F.round("sse", 6).alias("sse"), "w", "n")).alias("best")).select("best.w", "best.sse", "best.n")


def weighted_panel(judgements: DataFrame) -> DataFrame:
    """Weighted median (weights are counts, rounded, 1 at least and if unknown), spread and number of scores of each document."""
    votes = judgements.where("score IS NOT NULL").withColumn("w", F.greatest(F.lit(1), T.half_up(F.coalesce("weight", F.lit(1)))))
    by = Window.partitionBy("doc_id").orderBy("score", "seat")
    whole = Window.partitionBy("doc_id")
    ranked = votes.withColumns({"upto": F.sum("w").over(by), "total": F.sum("w").over(whole)})
    low = F.min(F.when(F.col("upto") >= F.floor((F.col("total") + 1) / 2), F.col("score")))
    high = F.min(F.when(F.col("upto") >= F.floor((F.col("total") + 2) / 2), F.col("score")))
    return ranked.groupBy("doc_id").agg(T.half_up((low + high) / 2).alias("median"), (F.max("score") - F.min("score")).alias("spread"), F.count("*").alias("valid"))


def cross_votes(judgements: DataFrame, buckets: dict[str, str], seats: int = 2) -> DataFrame:
    """Kinds of critique that several seats share; a critique is of the first bucket whose pattern it has."""
    bucket = F.lit(None).cast("string")
    for name, pattern in reversed(buckets.items()):
        bucket = F.when(F.col("critique").rlike(pattern), name).otherwise(bucket)
    votes = judgements.withColumn("bucket", F.coalesce(bucket, "critique"))
    return votes.groupBy("doc_id", "bucket").agg(F.countDistinct("seat").alias("seats")).where(F.col("seats") >= seats)


def drift(baseline: DataFrame, limit: float = 3, points: int = 6, most: float = 35) -> DataFrame:
    away = F.abs(F.col("score") - F.col("want"))
    out = baseline.agg(F.count("*").alias("n"), F.sum((away > limit).cast("long")).alias("drifted"), F.max(away).alias("largest"))
    return out.withColumn("ok", (F.col("drifted") <= points) & (F.col("largest") <= most))


def ratchet(baseline: DataFrame) -> DataFrame:
    """A score may only move in the direction that is locked."""
    worse = F.when(F.col("direction") == "down", F.col("score") > F.col("want")).otherwise(F.col("score") < F.col("want"))
    return baseline.withColumn("delta", F.col("score") - F.col("want")).withColumn("verdict", F.when(worse, "regressed").when(F.col("delta") == 0, "same").otherwise("improved"))


def conflicts(external: DataFrame) -> DataFrame:
    """Of each text the outside score that contradicts the local one most: severe ones first, then the larger gap."""
    gap = F.col("score") - F.col("local")
    found = external.where((F.col("score") >= 60) & (gap >= 30)).withColumns({"gap": gap, "severe": F.col("local") <= 27})
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("severe"), F.desc("gap"), "source"))
    return found.withColumn("rank", rank).where("rank = 1").drop("rank")


def separation(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean score of each quality label and how far the two stand apart."""
    both = scored.join(labels, "doc_id")
    mean = lambda q: F.avg(F.when(F.col("quality") == q, F.col("score")))
    return both.agg(F.count("*").alias("n"), F.round(mean(0), 6).alias("low"), F.round(mean(1), 6).alias("high"), F.round(mean(0) - mean(1), 6).alias("apart"))


def threshold_sweep(scored: DataFrame, labels: DataFrame, first: int, last: int, step: int) -> DataFrame:
    """False alarms and misses at each threshold; the thresholds are a fixed list, and scores are counted before they meet it."""
    counts = scored.join(labels, "doc_id").groupBy("score", "quality").agg(F.count("*").alias("c"))
    t = F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step)))
    grid = counts.withColumn("threshold", t)
    return grid.groupBy("threshold").agg(F.sum(F.when((F.col("quality") == 1) & (F.col("score") >= F.col("threshold")), F.col("c")).otherwise(0)).alias("false_alarms"), F.sum(F.when((F.col("quality") == 0) & (F.col("score") < F.col("threshold")), F.col("c")).otherwise(0)).alias("misses"))


def stage_report(stages: DataFrame) -> DataFrame:
    """Per stage: time, change of length against the stage before in its run, runs, and whether all were skipped."""
    before = F.lag("chars").over(Window.partitionBy("run").orderBy("seq"))
    delta = F.coalesce(F.col("chars") - before, F.lit(0))
    return stages.withColumn("delta", delta).groupBy("id").agg(F.sum("ms").alias("ms"), F.sum("delta").alias("delta"), F.max_by("chars", F.struct("run", "seq")).alias("last_chars"), F.count("*").alias("runs"), F.bool_and("skipped").alias("all_skipped"))


def best_of(candidates: DataFrame) -> DataFrame:
    """Candidate of least score that isn't vetoed, the first of ties; documents with none left out."""
    return candidates.where("NOT vetoed").groupBy("doc_id").agg(F.min(F.struct("score", "candidate")).alias("b")).select("doc_id", "b.candidate", "b.score")


def stop_rules(rounds: DataFrame) -> DataFrame:
    """Why each round would stop the loop: an issue that the last round with issues had not, two critiques repeated from the last round
    with any, the target reached, no score below the best so far; else it goes on."""
    before = Window.partitionBy("doc_id").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    parts = lambda c: F.array_distinct(F.filter(F.split(c, ","), lambda x: x != ""))
    none = F.array().cast("array<string>")
    last = lambda c: F.coalesce(F.last(F.when(F.size(c) > 0, F.col(c)), ignorenulls=True).over(before), none)
    df = rounds.withColumns({"i": parts("issues"), "c": parts("critiques")})
    df = df.withColumns({"prior_issues": last("i"), "prior_critiques": last("c"), "best": F.min("score").over(before)})
    target = F.when(F.col("anchor") <= 28, F.col("anchor")).otherwise(F.greatest(F.lit(10), T.half_up(0.35 * F.col("anchor"))))
    later = F.col("round") > 0
    new = later & (F.size(F.array_except("i", "prior_issues")) > 0)
    repeated = F.size(F.array_intersect("c", "prior_critiques")) >= 2
    why = F.when(new, "new issue").when(repeated, "repeated critiques").when(later & (F.col("score") <= target), "target").when(F.col("score") >= F.col("best"), "no improvement").otherwise("go on")
    return df.select("doc_id", "round", target.alias("target"), why.alias("why"))


def ledger_audit(ledger: DataFrame, known: list[str]) -> DataFrame:
    """Problems of a ledger (line, id, url, pct, label): repeated ids, missing urls, labels that the percentage contradicts,
    percentages out of range, ids that nobody registered; and registered ids that have no line."""
    expected = F.when(F.col("pct") >= 60, "ai").when(F.col("pct") >= 30, "suspected").otherwise("human")
    first = F.row_number().over(Window.partitionBy("id").orderBy("line"))
    rows = ledger.withColumn("nth", first)
    checks = {"repeated id": F.col("nth") > 1, "missing url": F.col("url").isNull(), "label contradicts": F.col("label") != expected, "out of range": ~F.col("pct").between(0, 100), "unknown id": ~F.col("id").isin(known)}
    kinds = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())), lambda k: k.isNotNull())
    found = rows.select("id", F.explode(kinds).alias("problem"))
    registered = ledger.sparkSession.createDataFrame([(k,) for k in known], "id string")
    return found.unionByName(registered.join(ledger, "id", "left_anti").withColumn("problem", F.lit("no line")))


def append_only(old: DataFrame, new: DataFrame) -> DataFrame:
    """First line at which a ledger isn't the old one with lines added, and what happened there."""
    both = old.select("line", F.col("sha").alias("was")).join(new.select("line", F.col("sha").alias("now")), "line", "full_outer").where("was IS NOT NULL")
    bad = both.where("now IS NULL OR now <> was").withColumn("what", F.when(F.col("now").isNull(), "truncated").otherwise("modified"))
    return bad.agg(F.min(F.struct("line", "what")).alias("b")).select("b.line", "b.what")


def outside_scores(raw: DataFrame, path: str = "$.data.score") -> DataFrame:
    """Scores of JSON answers on a scale of 100, null where the answer tells of failure or has no number."""
    failed = F.coalesce(F.get_json_object("raw", "$.status") == "error", F.lit(False))
    number = F.expr(f"try_cast(get_json_object(raw, '{path}') AS DOUBLE)")
    scaled = F.when(number <= 1, number * 100).otherwise(number)
    return raw.select("id", F.when(~failed, T.half_up(T.clamp(scaled, 0, 100))).alias("score"))


def said_results(results: DataFrame) -> DataFrame:
    """Label and percentage of what an outside page said; a label without a percentage has its usual one."""
    label = F.when(F.contains("said", F.lit("疑似")), "suspected").when(F.contains("said", F.lit("人工")), "human").when(F.contains("said", F.lit("AI")), "ai")
    found = F.expr(r"try_cast(regexp_extract(said, '([0-9]+(?:[.][0-9]+)?) *%', 1) AS DOUBLE)")
    usual = F.when(label == "ai", 90.0).when(label == "suspected", 45.0).when(label == "human", 10.0)
    return results.select("id", label.alias("label"), F.coalesce(found, usual).alias("pct"))
