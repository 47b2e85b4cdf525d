"""Registered queries against their SQL."""

from pathlib import Path

import duckdb
import pytest

from blockloom.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = registry.queries()[name](spark, SF)
    found = con.execute(registry.oracle_sql()[name])
    names, columns = [d[0] for d in found.description], sorted(df.columns)
    assert sorted(names) == columns
    want = sorted(repr([r[names.index(c)] for c in columns]) for r in found.fetchall())
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == want
