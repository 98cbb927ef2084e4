"""Tables that are derived by plans of this engine."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from quillstone.plans import audits, derived


def test_means_of_windows_are_added_in_the_order_of_events(spark):
    up, down = [1.95, 1.27, 2.21, 2.57], [2.57, 2.21, 1.27, 1.95]  # means 2 and 1 when rounded down, by their order alone
    rows = [(u, "x", k, v) for u, vs in enumerate((up, down)) for k, v in enumerate(vs)] + [(2, "x", 0, None), (3, "x", 0, 1.5), (3, "x", 1, None)]
    events = spark.createDataFrame(rows, "user_id long, event_type string, event_id long, value double")
    wanted = {}
    for u, vs in enumerate((up, down)):
        total = 0.0
        for v in vs:
            total += v
        wanted[1000 + u] = float(total / 4 // 1) / 64
    wanted |= {1002: None, 1003: 1 / 64}
    for seed in range(8):
        found = derived._nll_windows(events.orderBy(F.rand(seed)).repartition(4)).collect()
        assert {r.doc_id: r.mean_nll for r in found} == wanted
        assert {r.doc_id: r.scored for r in found} == {1000: 4, 1001: 4, 1002: 1, 1003: 2}


def test_means_of_windows_are_those_of_rows_as_they_lie_in_the_files(spark, tmp_path):
    """Ids that run against the files' order, repeat or are null, held against the SQL on one thread."""
    values = [1.95, 1.27, 2.21, 2.57], [2.57, 2.21, 1.27, 1.95]
    con = duckdb.connect()
    con.execute("SET threads = 1")
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for part, at in enumerate((slice(0, 2), slice(2, 4))):
        rows = [(u, "x", e, v) for u, vs in enumerate([*values, *values, *values]) for v, e in zip(vs[at], [[9, 8, 7, 6], [0, 0, 0, 0], [None] * 4][u // 2][at])]
        con.execute(f"COPY (SELECT * FROM (VALUES {', '.join(f'({u}, {t!r}, CAST({"NULL" if e is None else e} AS BIGINT), {v}::DOUBLE)' for u, t, e, v in rows)}) AS t(user_id, event_type, event_id, value)) TO '{folder}/part-{part}.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/*.parquet')")
    found = derived.given(spark, str(tmp_path), "nll_windows").where("doc_id >= 1000").collect()
    wanted = con.execute(f"SELECT doc_id, win, scored, mean_nll FROM ({derived.given_sql('nll_windows')}) WHERE doc_id >= 1000").fetchall()
    assert sorted(map(tuple, found)) == sorted(wanted) and {r[3] for r in wanted} == {1 / 64, 2 / 64}
    layer = audits.QUERIES["ppl_layer"](spark, str(tmp_path))
    names = [c[0] for c in con.execute(audits.ORACLE_SQL["ppl_layer"]).description]
    assert sorted(map(tuple, layer.select(*names).collect())) == sorted(con.execute(audits.ORACLE_SQL["ppl_layer"]).fetchall())
