import re

import pytest
import pyarrow.parquet as pq
from querylark.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=85):
    sets = [(i, shingle_set(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)):
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {(i, len(s), root(i), root(i) == i) for i, s in sets}


def test_equals_brute_force_on_documents(spark):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet").select(["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in t]
    got = {tuple(r) for r in minhash.op1_minhash(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute(rows)


def near_copies(n, templates=1, seed=5):
    import random

    r = random.Random(seed)
    bases = [[f"t{b}w{k}" for k in range(120)] for b in range(templates)]
    rows = []
    for i in range(n):
        w = ["common", "words", "of", "a", "passage", *bases[r.randrange(templates)]][: r.choice([125, 125, 100, 60])]
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("templates", "exact", "direct"), [(1, False, 1), (9, False, 1), (9, True, 1), (9, False, 16)])
def test_large_group_over_several_blocks(spark, monkeypatch, templates, exact, direct):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "DIRECT", direct)
    rows = near_copies(150, templates)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(x) for x in minhash.near_duplicates(df, exact=exact).collect()} == brute(rows)


def test_second_pass_meets_all_that_the_first_leaves(spark, monkeypatch):
    """Short texts around one passage: long lists of sets that are mostly not linked, of several sizes."""
    import random

    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "DIRECT", 1)
    r = random.Random(9)
    passage = [f"p{k}" for k in range(40)]
    rows = []
    for i in range(120):
        w = passage + [f"y{r.randrange(6)}z{k}" for k in range(r.choice([6, 8, 12, 20]))]
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (85, 75):
        want = brute(rows, percent)
        assert len({x[2] for x in want}) > 1
        assert {tuple(x) for x in minhash.near_duplicates(df, percent=percent, exact=True).collect()} == want


def test_hot_list_stays_within_blocks(spark, monkeypatch):
    """No group has more than two blocks' members, however many texts share a list."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "DIRECT", 1)
    sizes = []
    join = minhash.common.join_per_key

    def spy(rows, per_key, keys, total):
        out = join(rows, per_key, keys, total)
        if keys == ["p", "k"]:
            sizes.append(per_key.agg({"b1": "max", "b2": "max"}).first())
        return out

    monkeypatch.setattr(minhash.common, "join_per_key", spy)
    cut = minhash.common.cut

    def seen(df):
        out = cut(df)
        if "side" in out.columns:
            assert (out.groupBy("p", "k", "i", "j").count().agg({"count": "max"}).first()[0] or 0) <= 4 * 16
        return out

    monkeypatch.setattr(minhash.common, "cut", seen)
    rows = near_copies(400, 3, seed=2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(x) for x in minhash.near_duplicates(df).collect()} == brute(rows)


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "a b", 0), (4, "A  b", 0), (5, " \n", 0), (6, "x " * 50000, 0), (6, "x " * 50000, 0), (7, "x " * 40000, 1), (None, "a b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int").selectExpr("*", "1 AS lost", "'x' AS __lost", "2 AS n")
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id or -1, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(-1, 1, -1, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 1, 6, True), (6, 1, 6, True), (7, 1, 6, False)]
    assert minhash.drop_near_duplicates(df).count() == 7
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_pair_at_a_lower_threshold_with_few_shared_hashes(spark):
    import numpy as np
    import pyarrow as pa

    words = [f"w{k}" for k in range(110)]
    batch = pa.record_batch([pa.array(range(110), pa.int64()), pa.array(words)], ["id", "text"])
    hashes = [np.frombuffer(x, np.uint64)[0] for out in minhash._sets(1)([batch]) for x in out.column(1).to_pylist()]
    w = [x for _, x in sorted(zip(hashes, words))]
    # 88 of 110 words are shared, but only 5 of the 16 smallest hashes of each.
    rows = [(1, " ".join(w[0:22:2] + w[22:])), (2, " ".join(w[1:22:2] + w[22:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(df, percent=80, width=1).collect()} == {1}


def test_exact_lists_equal_brute_force_on_documents(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").select(["doc_id", "text"]).to_pylist()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {tuple(r) for r in minhash.near_duplicates(docs, percent=70, exact=True).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in t], 70)


def test_overlaps_in_slices():
    import numpy as np

    r = np.random.default_rng(1)
    rows = [np.unique(r.integers(0, 300, 100)).astype(np.uint64) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) for b in rows] for a in rows]
    for most in (12, 100, 1 << 22):
        got = minhash._overlap(rows, most)
        np.fill_diagonal(got, 0)
        assert (got == np.array(want) - np.diag(np.diag(want))).all()
