"""Every query of the catalog against its SQL twin, which DuckDB runs on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from quillstone.plans import catalog

DATA = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")


def plain(value):
    """A value as both engines give it: numbers to nine digits, rows and arrays as lists."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return [plain(v) for v in value.values()]
    try:
        number = float(value)
    except (TypeError, ValueError):
        return str(value)
    return "nan" if math.isnan(number) else float(f"{number:.9g}") + 0.0


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(([plain(r[i]) for i in order] for r in found), key=repr)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    found = catalog.QUERIES[name](spark, str(DATA))
    wanted = tables.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, found.collect()) == rows(names, wanted.fetchall())


def test_each_sql_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
