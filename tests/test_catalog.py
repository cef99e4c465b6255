"""Every registered query equals its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, canonical

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert rows
        return
    res = con.execute(ORACLE[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert canonical(df.columns, rows) == canonical(cols, res.fetchall())


def test_survey_ids_are_covered():
    ids = {n.split("_")[0] for n in QUERIES}
    for prefix, last in (("s", 16), ("n", 11), ("f", 15), ("c", 17), ("j", 6), ("a", 21), ("w", 4),
                         ("o", 6), ("u", 4), ("t", 7), ("x", 4), ("d", 6)):
        for i in range(1, last + 1):
            assert f"{prefix}{i:02d}" in ids, f"{prefix}{i:02d}"
    assert {f"ts{i:02d}" for i in range(1, 11)} <= ids


def test_entry(spark):
    assert entry.entry(spark).count() > 0
