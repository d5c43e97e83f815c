"""Every query with an oracle, against DuckDB at the smallest scale."""

import math

import duckdb
import pytest

from fernlake import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float) or hasattr(x, "dtype") and getattr(x, "ndim", 1) == 0:
        return repr(float(x)) if not math.isnan(float(x)) else "nan"
    return str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(plain(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_oracle(spark, db, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), db.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["hashed_sample", "stratified_sample", "forest", "kmeans", "linear_svc", "link_prediction", "tfidf_encode"])
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
