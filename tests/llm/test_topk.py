import math

import duckdb
import numpy as np
import pytest
from querylark.llm import topk


def brute(rows, every, k=5):
    ok = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and None not in v and all(map(math.isfinite, v))]
    out = set()
    for i, v in dict(reversed([r for r in ok if r[0] % every == 0])).items():
        best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j) for j, w in ok if j != i and len(w) == len(v))[:k]
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("shard", [8192, 50])
def test_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "LEAF", 8)
    monkeypatch.setattr(topk, "QUERIES", 10)
    r = np.random.default_rng(1)
    rows = [(i, r.integers(-3, 4, 6).astype(float).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(2000, None), (2001, []), (2002, [1.0, None, 1, 1, 1, 1]), (2004, [float("inf")] * 6), (2005, [1.0, 2.0])]
    df = spark.createDataFrame([(i, [None if c is None else float(c) for c in v] if v is not None else None, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    assert {tuple(x) for x in topk.top_k(df, every=10).collect()} == brute(rows, 10)


def test_large_components_few_rows_and_empty(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(x) for x in topk.top_k(df).collect()} == brute(rows, 50)
    assert topk.top_k(df.limit(0)).count() == 0


def test_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    assert sorted(tuple(r) for r in topk.op2_topk(spark, d).collect()) == sorted(con.execute(topk.SQL).fetchall())
