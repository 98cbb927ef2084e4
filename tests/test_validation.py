"""Left-out residuals against lines that are fitted again, and paired changes by hand."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.plans import experiments
from quillstone.operators import validation as V


def refitted(points):
    """Residual of each point by a line through all others of its group."""
    out = []
    for k, (g, x, y) in enumerate(points):
        rest = [(a, b) for j, (h, a, b) in enumerate(points) if h == g and j != k]
        if not rest:
            continue
        xs, ys = np.array(rest, float).T
        slope = 1.0 if np.ptp(xs) == 0 else np.cov(xs, ys, bias=True)[0, 1] / np.var(xs)
        out.append((g, x, y, y - (ys.mean() + slope * (x - xs.mean()))))
    return sorted(out)


def test_left_out_residuals_equal_refits(spark):
    r = random.Random(3)
    points = [(r.choice("abc"), float(r.randrange(40)), r.gauss(50, 20)) for _ in range(150)]
    points += [("one", 3.0, 4.0), ("two", 1.0, 5.0), ("two", 4.0, 9.0), ("same", 7.0, 1.0), ("same", 7.0, 3.0), ("same", 7.0, 8.0), ("apart", 1.0, 2.0), ("apart", 1.0, 4.0), ("apart", 6.0, 5.0)]
    points += [("far", 1e6 + k, 2e6 + 3 * k + (k % 2)) for k in range(6)] + [("a", 5.0, 6.0)] * 3
    rows = spark.createDataFrame([*points, ("a", None, 1.0), ("a", 1.0, None)], "g string, x double, y double").withColumn("residual", F.lit("old"))
    got = sorted((q.g, q.x, q.y, q.residual) for q in V.left_out_residuals(rows, "g").collect())
    want = refitted(points)
    assert [p[:3] for p in got] == [p[:3] for p in want]
    assert [p[3] for p in got] == pytest.approx([p[3] for p in want], rel=1e-6, abs=1e-6)
    errors = {e.g: e for e in V.left_out_errors(rows, "g").collect()}
    for g in {p[0] for p in want}:
        res = [abs(p[3]) for p in want if p[0] == g]
        assert (errors[g].n, errors[g].mae, errors[g].most) == (len(res), pytest.approx(sum(res) / len(res), rel=1e-6), pytest.approx(max(res), rel=1e-6))
    assert "one" not in errors and V.left_out_errors(rows.limit(0), "g").collect() == []


def test_paired_changes_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b b"), (3, "c"), (4, None)], "doc_id long, text string")
    rows = V.edited(docs, {"drop b": lambda t: F.regexp_replace(t, "b", ""), "add": lambda t: F.concat(t, F.lit("xy"))})
    assert sorted((r.doc_id, r.edit) for r in rows.collect()) == [(1, ""), (1, "add"), (1, "drop b"), (2, ""), (2, "add"), (2, "drop b"), (3, ""), (3, "add")]
    scored = rows.select("doc_id", "edit", F.length("text").alias("score"))
    got = {r.edit: r for r in V.paired_changes(scored, {"drop b": -1, "add": -1}).collect()}
    d, a = got["drop b"], got["add"]
    assert (d.pairs, d.up, d.down, d.same, d.mean, d.least, d.most, d.right) == (2, 0, 2, 0, -1.5, -2, -1, 1.0)
    assert d.apart == pytest.approx(-1.5 / (0.5**0.5 / 2**0.5))
    assert (a.pairs, a.up, a.down, a.right, a.apart) == (3, 3, 0, 0.0, None)


@pytest.mark.parametrize("name", ["paired_experiment", "left_out_errors"])
def test_experiments_score_each_text_once(spark, name):
    found = experiments.QUERIES[name](spark, "/root/testdata/sf0.001")
    run = found._jdf.queryExecution()
    found.collect()  # the same plan is run, and is the final one then
    plan = run.executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"FileScan parquet \[doc_id#\d+L?,text", plan)) == 1
