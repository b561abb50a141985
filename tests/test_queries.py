"""Every registered query of the table operators against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.plans import queries as plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return float(f"{v:.9g}") if isinstance(v, float) and math.isfinite(v) else v

    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = plans.queries()[name](spark, DATA)
    want = duck.sql(plans.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    mine, theirs = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert a == pytest.approx(b, rel=1e-6, nan_ok=True) if all(isinstance(x, (int, float)) for x in a) else a == b


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
