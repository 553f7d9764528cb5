"""The queries against their SQL, over whole tables."""

import duckdb
import pytest

from tidewatch.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    got = queries.queries()[name](spark, SF)
    base = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    found = base.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda row: tuple(str(x) for x in row)
    assert sorted(map(key, got.select(columns).collect())) == sorted(map(key, found.fetchall()))
