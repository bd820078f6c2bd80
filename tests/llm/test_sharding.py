import threading

import pytest
from querylark.llm import sharding

D = "/root/testdata/sf0.01/documents.parquet"


def test_compaction_keeps_rows_and_reaches_target(spark, tmp_path):
    docs = spark.read.parquet(D)
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target=400_000, tier_0=30_000)
    for k in range(12):
        assert store.append(docs.where(f"doc_id % 12 = {k}")) == k + 1
    assert store.append(docs.limit(0)) == 13
    small = store.runs()
    assert len(small) == 12 and not any(r.merged for r in small)
    assert store.compact() == 14
    big = store.runs()
    assert all(r.merged for r in big) and sum(r.shards for r in big) < 6
    assert sum(r.bytes for r in big) > 0.5 * sum(r.bytes for r in small)
    want = sorted(map(tuple, docs.collect()))
    assert sorted(map(tuple, store.read().collect())) == want == sorted(map(tuple, store.read(13).collect()))
    assert store.append(docs.where("doc_id < 100")) == 15
    assert store.vacuum() == 13  # the arrivals, and the empty one
    assert sorted(map(tuple, store.read().collect())) == sorted([*want, *map(tuple, docs.where("doc_id < 100").collect())])
    assert store._listed("pending") == [] and len(store._listed("manifest")) == 1


def test_tiers_and_settled_runs(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target=1000, fanout=4, tier_0=10)
    run = lambda size, shards=1: sharding.Run("t", size * shards, shards, False)
    assert [[r.bytes for r in t] for t in store.tiers([run(n) for n in (161, 1, 40, 10, 41, 160, 499, 500)])] == [[1, 10, 40], [41, 160, 161], [499]]
    assert store.settled(run(500, 7)) and not store.settled(run(499, 7))


def test_commit_never_overwrites(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    df = spark.createDataFrame([(1, None), (1, None), (2, "x" * 200_000)], "doc_id long, path string")
    store.append(df)
    with pytest.raises(sharding.Conflict):
        store._commit(0, [], None)
    assert store.version() == 1 and store.read().count() == 3
    assert [n for n, _ in store._listed("manifest") if "json" not in n] == []


def test_vacuum_leaves_a_writer_alone(spark, tmp_path, monkeypatch):
    a, b = (sharding.ShardStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    a.append(spark.range(5).toDF("id"))
    commit = a._commit

    def late(*args):
        assert b.vacuum() == 0
        return commit(*args)

    monkeypatch.setattr(a, "_commit", late)
    assert a.append(spark.range(5, 9).toDF("id")) == 2
    assert sorted(r.id for r in b.read().collect()) == list(range(9))


def test_vacuum_sees_a_commit_that_comes_between_its_steps(spark, tmp_path, monkeypatch):
    a, b = (sharding.ShardStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    a.append(spark.range(5).toDF("id"))
    run = a._write(spark.range(5, 9).toDF("id"), False)
    version = b.version

    def newest():
        monkeypatch.setattr(b, "version", version)
        a._commit_on_newest(lambda runs: [*runs, run], None, (run,))
        a._release(run)
        return version()

    monkeypatch.setattr(b, "version", newest)  # the commit happens after the leases were listed
    assert b.vacuum() == 0
    assert b.read().count() == 9


def test_lapsed_lease(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", grace=0.0)
    lost = store._write(spark.range(3).toDF("id"), False)  # its driver is gone
    assert store.vacuum() == 1 and store._listed("data") == [] and store._listed("pending") == []
    with pytest.raises(sharding.Lapsed):
        store._commit(0, [lost], None, (lost,))
    assert store.version() == 0


def test_concurrent_writers_lose_nothing(spark, tmp_path):
    stores = [sharding.ShardStore(spark, f"file://{tmp_path}/s") for _ in range(3)]
    stores[0].append(spark.range(10).toDF("id"))
    failed = []

    def work(k):
        try:
            for i in range(3):
                stores[k].append(spark.range(100 * k + 10 * i + 1000, 100 * k + 10 * i + 1010).toDF("id"))
                stores[k].compact()
                stores[k].vacuum(keep_versions=100)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    want = sorted([*range(10), *(100 * k + 10 * i + 1000 + j for k in range(3) for i in range(3) for j in range(10))])
    assert sorted(r.id for r in stores[0].read().collect()) == want


def test_empty(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    with pytest.raises(ValueError):
        store.read()
    store.append(spark.createDataFrame([], "doc_id long, text string"))
    assert store.read().count() == 0 and store.compact() == 1


def test_query(spark):
    got = sharding.op9_sharding(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet(D).selectExpr("doc_id", "lang", "source", "n_chars", "md5(cast(text AS binary)) AS text_md5", "true", "5", "0")
    assert sorted(map(tuple, got.select("doc_id", "lang", "source", "n_chars", "text_md5", "merged", "version", "arrivals").collect())) == sorted(map(tuple, docs.collect()))
