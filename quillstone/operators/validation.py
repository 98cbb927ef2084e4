"""Errors of calibration lines on what they weren't fitted to, and paired experiments of texts against edits of themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def left_out_residuals(points: DataFrame, by: str) -> DataFrame:
    """points (by, x, y and others) with predicted and residual: of y, by the line that is fitted to all other points of by.

    No line is fitted again: with n, the means and the sums of squares of a group, what a point takes from them when it is left out is
    known. Where the others have one x only, their line has slope 1 through their means, as a fit of such points has. Rows with a
    null x or y, and points that are alone, are left out. One aggregate a group, joined to its points; the sums are of centred
    values, so that large means cost no digits.
    """
    known = points.where("x IS NOT NULL AND y IS NOT NULL")
    known = known.repartition(points.sparkSession.sparkContext.defaultParallelism)  # an exchange that means and points share: points are made once
    means = known.groupBy(by).agg(F.count("*").alias("_n"), F.avg("x").alias("_mx"), F.avg("y").alias("_my"), F.covar_pop("x", "y").alias("_cov"), F.var_pop("x").alias("_var"))
    df = known.join(means.where("_n > 1"), by)
    n, dx, dy = F.col("_n"), F.col("x") - F.col("_mx"), F.col("y") - F.col("_my")
    rest = F.col("_var") * n - dx * dx * n / (n - 1)  # the others' sum of squares of x
    both = F.col("_cov") * n - dx * dy * n / (n - 1)
    slope = F.when(rest > 1e-9 * (F.col("_var") * n + dx * dx), both / rest).otherwise(1.0)
    predicted = F.col("_my") - dy / (n - 1) + slope * (dx + dx / (n - 1))
    df = df.withColumn("predicted", predicted).withColumn("residual", F.col("y") - F.col("predicted"))
    return df.select(*(c for c in points.columns if c not in ("predicted", "residual")), "predicted", "residual")


def left_out_errors(points: DataFrame, by: str) -> DataFrame:
    """Of each group: n, and the mean, root mean square and largest amount of left_out_residuals."""
    r = F.abs("residual")
    return left_out_residuals(points, by).groupBy(by).agg(F.count("*").alias("n"), F.avg(r).alias("mae"), F.sqrt(F.avg(r * r)).alias("rmse"), F.max(r).alias("most"))


def edited(docs: DataFrame, edits: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Rows of docs (doc_id, text) once as they are, as edit "", and once for each edit that changes the text: doc_id, edit, text. Null
    texts have no rows. Each row's versions are made beside each other, so nothing moves."""
    versions = F.array(F.struct(F.lit("").alias("edit"), F.col("text").alias("made")), *(F.struct(F.lit(k).alias("edit"), f(F.col("text")).alias("made")) for k, f in edits.items()))
    rows = docs.where("text IS NOT NULL").select("doc_id", "text", F.explode(versions).alias("v"))
    return rows.where((F.col("v.edit") == "") | (F.col("v.made") != F.col("text"))).select("doc_id", "v.edit", F.col("v.made").alias("text"))


def paired_changes(scored: DataFrame, directions: dict[str, int]) -> DataFrame:
    """scored (doc_id, edit, score) of edited documents: of each edit, pairs, up, down and same (how many scores rose, fell, stayed), the
    mean, least and most change, right (the share that went in the direction expected, 1 or -1) and apart (the mean change in
    standard errors; null for fewer than two pairs or equal changes). A document's versions meet by its id,
    edits are few; scored is made once."""
    base = F.collect_list(F.when(F.col("edit") == "", F.col("score"))).over(Window.partitionBy("doc_id"))
    both = scored.where("doc_id IS NOT NULL").withColumn("_base", base).where("edit <> ''").withColumn("before", F.explode("_base")).withColumn("change", F.col("score") - F.col("before"))
    c = F.col("change")
    out = both.groupBy("edit").agg(
        F.count("*").alias("pairs"), F.count_if(c > 0).alias("up"), F.count_if(c < 0).alias("down"), F.count_if(c == 0).alias("same"), F.avg(c).alias("mean"),
        F.min(c).alias("least"), F.max(c).alias("most"), F.stddev_samp(c.cast("double")).alias("_s"),
    )
    wanted = F.create_map(*(x for k, d in directions.items() for x in (F.lit(k), F.lit(d))))[F.col("edit")]
    right = F.when(wanted > 0, F.col("up")).when(wanted < 0, F.col("down")) / F.col("pairs")
    apart = F.when(F.col("_s") > 0, F.col("mean") / (F.col("_s") / F.sqrt("pairs")))
    return out.select("edit", "pairs", "up", "down", "same", "mean", "least", "most", right.alias("right"), apart.alias("apart"))
