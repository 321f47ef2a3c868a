"""Every query with SQL gives the rows that DuckDB gives, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from strandloom.plans import campaign, catalog, run_checks  # noqa: F401

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "documents orders lineitem events customer supplier part nation region".split():
        c.sql(f"CREATE VIEW {t} AS FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, D).toPandas()
    assert len(got)
    if name in catalog.SQL:
        want = duck.sql(catalog.SQL[name]).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
        pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1e-9)
