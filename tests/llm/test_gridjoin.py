import numpy as np
import pyarrow.parquet as pq
import pytest
from querylark.llm import gridjoin


def brute(rows, least=0.95):
    ok = [(i, np.asarray(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.asarray(v, float)).all() and np.any(np.asarray(v))]
    x = np.stack([v / np.linalg.norm(v) for _, v in ok])
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    root = {}
    for s in range(len(ok)):
        if s in root:
            continue
        todo, seen = [s], {s}
        while todo:
            for t in np.flatnonzero(near[todo.pop()]).tolist():
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        for t in seen:
            root[t] = min(ok[u][0] for u in seen)
    good = {ok[k][0]: (ok[k][0], int(near[k].sum()), root[k], root[k] == ok[k][0]) for k in range(len(ok))}
    return {good.get(i, (i, 0, i, True)) for i, _ in rows}


@pytest.mark.parametrize("size", [1024, 40])
def test_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(gridjoin, "BLOCK", size)
    monkeypatch.setattr(gridjoin, "LEAF", 16)
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 12))
    rows = [(i, (base[i % 60] + r.normal(size=12) * (0.05 + 0.4 * (i % 3))).tolist()) for i in range(600)]
    rows += [(600 + i, rows[7][1]) for i in range(30)] + [(700, None), (701, []), (702, [0.0] * 12), (703, [float("nan")] + [1.0] * 11), (704, [None] + [1.0] * 11), (705, (np.array(rows[3][1]) * 1e30).tolist())]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, n_links int")
    assert {tuple(x) for x in gridjoin.near_duplicates(df).collect()} == brute(rows)


def test_documents_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table("/root/testdata/sf0.01/embeddings.parquet").to_pylist()]
    assert {tuple(x) for x in gridjoin.op10_gridjoin(spark, "/root/testdata/sf0.01").collect()} == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert gridjoin.near_duplicates(df).count() == 0
