"""Every catalogue query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from lodestrata.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def values(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v
    return sorted(str([plain(v) for v in r]) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sf, sql, name):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), sql.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and values(got) == values(want)


def test_entry_imports_without_the_optional_parts():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and os.path.exists(__spark_entry__.__file__)
