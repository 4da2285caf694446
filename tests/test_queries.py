"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from siltstone.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(value):
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in registry.SQL:
        assert got.columns
        return
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        found = con.execute(registry.SQL[name])
        names = [d[0] for d in found.description]
        want = found.fetchall()
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in rows) == sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in want)
