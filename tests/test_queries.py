"""Every registered query against its SQL, over the smallest tables where they are there."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from frameloom.plans import conversions, registry, sinks  # noqa: F401

DATA = Path("/root/testdata/sf0.001")


def value(v):
    return None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.skipif(not DATA.is_dir(), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, name):
    got = registry.QUERIES[name](spark, str(DATA)).toPandas()
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = con.sql(registry.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    rows = lambda df: sorted(repr([value(x) for x in r]) for r in df[columns].astype(object).values.tolist())
    assert rows(got) == rows(want)
