"""Every query beside its SQL, on the tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from querylark.plans import registry

D = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    norm = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return [columns[k] for k in order], sorted((tuple(norm(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, D)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in registry.ORACLE_SQL:
        rel = con.execute(registry.ORACLE_SQL[name])
        assert got == rows([c[0] for c in rel.description], rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
