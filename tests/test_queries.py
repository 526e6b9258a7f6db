"""Every query of the order tables against DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from cohortlens.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def canonical(df: pd.DataFrame) -> list[str]:
    def value(v):
        if v is None or v is pd.NA or v != v:
            return None
        v = v.item() if hasattr(v, "item") else v
        return round(v, 9) if isinstance(v, float) else v

    return sorted(repr(tuple(map(value, r))) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
