"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidewatch import plans

SF = "/root/testdata/sf0.001"


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = [tuple(_norm(r[names.index(c)]) for c in cols) for r in found.fetchall()]
    have = [tuple(_norm(v) for v in r) for r in df.select(*cols).collect()]
    assert sorted(have, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0
