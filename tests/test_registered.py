"""Every registered page query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from quirework.plans import queries, queries_state  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, int) and not isinstance(v, bool):
        return round(float(v), 8)
    return v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([norm(r[c]) for c in columns]) for r in df.collect())
    res = duck.execute(queries.ORACLES[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == columns
    assert got == sorted(repr([norm(row[names.index(c)]) for c in columns]) for row in res.fetchall())
