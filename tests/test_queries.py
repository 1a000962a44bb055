"""Every registered query of the library against its SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from corpusloom.plans import registry

SF = "/root/testdata/sf0.001"
# Queries without SQL are tested in files of their own.
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    return round(float(v), 8) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


def test_few_queries_have_no_sql():
    assert sorted(set(QUERIES) - set(SQL)) == ["a43_bootstrap_ratio", "a44_bootstrap_kappa", "a69_text_similarity", "p02_stress_round_robin"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    wanted = duck.execute(SQL[name])
    names = [x[0] for x in wanted.description]
    assert sorted(names) == columns
    assert found == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in wanted.fetchall()), key=repr)
