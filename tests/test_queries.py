"""Every query of the engine against its SQL, on the smallest driver tables."""

from pathlib import Path

import duckdb
import pytest

from blockloom.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sql, name):
    df = plans.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((repr([r[c] for c in columns]) for r in df.collect()))
    want = plans.oracle_sql().get(name)
    if want is None:
        assert rows
        return
    found = sql.execute(want)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows == sorted(repr([r[names.index(c)] for c in columns]) for r in found.fetchall())
