import random
from collections import defaultdict

import pytest
from querylark.llm import common, packing


def brute(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters):
        fit = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= size and (s is None or s not in b["s"]) and c not in b["c"]]
        if fit:
            k = min(fit)[1]
        else:
            k = len(bins)
            bins.append({"room": capacity, "s": set(), "c": set()})
        out.append((k, capacity - bins[k]["room"]))
        bins[k]["room"] -= size
        bins[k]["s"].add(s)
        bins[k]["c"].add(c)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_equals_brute_force(seed):
    r = random.Random(seed)
    n = 400
    sizes = sorted((r.randrange(1, 60) for _ in range(n)), reverse=True)
    sources = [None if r.random() < 0.1 else 0 if r.random() < 0.4 else r.randrange(30) for _ in range(n)]
    clusters = [r.randrange(200) for _ in range(n)]
    assert packing.best_fit(sizes, sources, clusters, 100) == brute(sizes, sources, clusters, 100)


def check(rows, docs, capacity):
    bins, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.start)
        assert all(a.start + a.n_tokens == b.start for a, b in zip(own, own[1:])) and own[0].start == 0 and own[-1].start + own[-1].n_tokens <= capacity
        named = [docs[r.doc_id][1] for r in own if docs[r.doc_id][1] is not None]
        assert len(named) == len(set(named))
        texts = [docs[r.doc_id][0] for r in own]
        assert len(texts) == len(set(texts))
    for i, (text, _) in docs.items():
        assert sum(r.n_tokens for r in parts[i]) == len((text or "").split()) and len({r.part for r in parts[i]}) == len(parts[i])


def test_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: (r.text, r.source) for r in common.read(spark, d, "documents").collect()}
    rows = packing.op8_packing(spark, d).collect()
    check(rows, docs, packing.CAPACITY)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, packing.op8_packing(spark, d).collect()))


def test_edges(spark):
    rows = [(1, None, "a"), (2, " \n", "a"), (3, "w " * 25, "a"), (4, "x y", None), (5, "x  Y", None), (6, "long " * 100000, "b"), (7, "q " * 10, "c"), (8, "z", "a")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, bin_id int")
    got = packing.pack(docs, capacity=10).collect()
    check(got, {i: ((t or "").lower().strip() and t, s) for i, t, s in rows}, 10)
    assert {r.doc_id for r in got if r.bin_id is None} == {1, 2}
    assert len({r.bin_id for r in got if r.doc_id in (4, 5)}) == 2  # one cluster
    twice = packing.pack(docs.where("doc_id = 8").unionAll(docs.where("doc_id = 8")), capacity=10).collect()
    assert len({r.bin_id for r in twice}) == 2
    assert packing.pack(docs.limit(0)).count() == 0
    by = packing.pack(docs.where("doc_id IN (4, 8)").withColumn("c", docs.bin_id), capacity=10, cluster_col="c").collect()
    assert len({r.bin_id for r in by}) == 2
