import math

import duckdb
import pytest

from kinetrace.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    got = [tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in registry.oracles():
        assert got
        return
    found = con.execute(registry.oracles()[name])
    names = [c[0] for c in found.description]
    want = [tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(names) == sorted(df.columns)
    assert sorted(got, key=key) == sorted(want, key=key)
