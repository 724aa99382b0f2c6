"""Every registered query of the engine against its oracle on the smallest tables."""

import math
import os

import duckdb
import pytest
from brightwater.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "is_finite"):
        return float(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def test_all_but_one_have_oracles():
    assert set(QUERIES) - set(SQL) == {"fts_stemmed"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=str)
    r = oracle.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted([tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall()], key=str)
    assert got == want
