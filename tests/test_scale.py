"""What queries hold and shuffle, at two sizes of their input."""

import numpy as np
from pyspark.sql import functions as F

from querylark.functions import text as T
from querylark.operators import boolean, evidence, ranking, vectors
from querylark.plans import pipeline, registry
from querylark.operators import index as ix


def records(spark, df):
    """Rows that the stages of a query write for others to read."""
    sc = spark.sparkContext
    store, bus, none = sc._jsc.sc().statusStore(), sc._jsc.sc().listenerBus(), sc._jvm.java.util.ArrayList

    def total():
        bus.waitUntilEmpty(30_000)
        stages = store.stageList(none(), False, False, sc._gateway.new_array(sc._jvm.double, 0), none())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return sum(n for k, n in total().items() if k not in before)


def plan(df):
    return df._jdf.queryExecution().toString()


def cloud(spark, n, dim=8):
    x = np.random.default_rng(1).normal(size=(n, dim)) / dim**0.5
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "vec_id long, embedding array<double>")
    return x, v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def test_ann_lsh_shuffles_no_pairs(spark):
    x, v, q = cloud(spark, 4000)
    b = vectors.buckets(x, 8, 1.5, 7)
    met = [(i, j) for i in range(0, 4000, 20) for j in range(4000) if (b[:, i] == b[:, j]).any()]
    assert len(met) > 200 * 4000 / 2  # nearly all pairs share a bucket
    df = vectors.nearest_approximate(v, q, 5)
    d = lambda i, j: round(float(((x[i] - x[j]) ** 2).sum()), 6)
    want = {}
    for i, j in met:
        want.setdefault(i, []).append((d(i, j), j))
    got = {}
    for r in df.collect():
        got.setdefault(r.qid, []).append((r.rk, r.score, r.vec_id))
    assert {i: [(s, j) for _, s, j in sorted(rows)] for i, rows in got.items()} == {i: sorted(rows)[:5] for i, rows in want.items()}
    assert records(spark, df) < len(met) / 10


def test_buckets_sum_like_expressions(spark):
    x, v, _ = cloud(spark, 300)
    r = np.random.default_rng(7)
    planes, shift = r.normal(size=(8, 8)), r.uniform(0, 1.5, 8)
    keys = F.array(*[F.floor((vectors.dot(F.col("embedding"), F.array(*[F.lit(float(y)) for y in planes[t]])) + float(shift[t])) / 1.5) for t in range(8)])
    want = [r.k for r in v.select("vec_id", keys.alias("k")).orderBy("vec_id").collect()]
    assert (vectors.buckets(x, 8, 1.5, 7).T == np.array(want)).all()


def _brute(x, qs, k, by):
    s = {i: [(round(float(((x[i] - y) ** 2).sum() if by == "l2" else -(x[i] @ y)), 6), j) for j, y in enumerate(x)] for i in qs}
    return {i: [j for _, j in sorted(rows)[:k]] for i, rows in s.items()}


def test_knn_batch_holds_a_bounded_part(spark, monkeypatch):
    x, v, q = cloud(spark, 400)
    monkeypatch.setattr(vectors, "SHARD", 50)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    df = vectors.nearest(v, q, 5)
    assert "collect_list" not in plan(df)  # no row holds a block or a shard
    got = {}
    for r in df.orderBy("qid", "rk").collect():
        got.setdefault(r.qid, []).append(r.vec_id)
    assert got == _brute(x, range(0, 400, 20), 5, "l2")


def test_cosine_rank_holds_few_distances_at_a_time(monkeypatch):
    x = np.random.default_rng(2).normal(size=(300, 4))
    x[100:200] = x[:100]  # ties go to the smaller id
    ids, most = np.arange(300)[::-1].copy(), []
    monkeypatch.setattr(vectors, "CELLS", 1000)
    seen = np.round
    monkeypatch.setattr(vectors.np, "round", lambda a, *b, **c: (most.append(a.size), seen(a, *b, **c))[1])
    got = vectors.best(np.arange(60), x[:60], ids, x, 5, "dot").to_pydict()
    assert max(most) <= 1000 and len(most) == 20
    by = {}
    for i, j in zip(got["qid"], got["vec_id"]):
        by.setdefault(i, []).append(j)
    s = {i: sorted((-round(float(x[i] @ y), 6), int(j)) for j, y in zip(ids, x)) for i in range(60)}
    assert by == {i: [j for _, j in rows[:5]] for i, rows in s.items()}


def texts(spark, n, words=60):
    r = np.random.default_rng(3)
    rows = [(i, " ".join(f"W{k}" for k in r.zipf(1.3, words) % 500)) for i in range(n)]
    return spark.createDataFrame([*rows, (n, ""), (n + 1, None), (n + 2, "...")], "doc_id long, text string")


def both(docs):
    """The index from texts, and the one that keeps postings."""
    return ix.Index.of(docs, persist=False), ix.Index.of(docs)


def listed(df):
    return sorted(map(repr, df.collect()))


def test_posting_positions_come_without_shuffle(spark):
    docs = texts(spark, 200)
    plain, kept = both(docs)
    assert "Exchange" not in plan(ix.postings(docs)) and "Exchange" not in plan(plain.lookup("w1", "w2"))
    want = {}
    for r in docs.where("text IS NOT NULL").collect():
        ws = [w.lower() for w in r.text.split() if w != "..."]
        for at, w in enumerate(ws):
            want.setdefault((w, r.doc_id, len(ws)), []).append(at)
    got = {(r.term, r.doc_id, r.dl): list(r.positions) for r in ix.postings(docs).collect()}
    assert got == want and all(r.tf == len(r.positions) for r in kept.postings.collect())
    assert listed(plain.lookup("w1", "w2", "none")) == listed(kept.lookup("w1", "w2", "none"))


def test_arrays_are_made_once(spark):
    text = plan(ix.Index.of(texts(spark, 5), persist=False).lookup("w1"))
    optimized = text[text.index("Optimized Logical Plan") : text.index("Physical Plan ==")]
    assert optimized.count("regexp_extract_all") == 1


def test_phrase_2_joins_no_positions(spark):
    plain, kept = both(texts(spark, 300))
    assert "Join" not in plan(boolean.phrase_docs(plain, ["w1", "w2"]))
    for words in (["w1"], ["w1", "w1"], ["w2", "w1"], ["W1", "w2"], ["w-1", "w2"], []):
        assert listed(boolean.phrase_docs(plain, words)) == listed(boolean.phrase_docs(kept, words))


def test_bm25_batch_shuffles_the_best_rows_alone(spark):
    wanted = spark.createDataFrame([(q, f"w{t}") for q in range(20) for t in (1, 2, 3, 10 + q)], "qid long, term string")
    for n in (300, 1200):
        plain, kept = both(texts(spark, n))
        df = ranking.bm25_batch(plain, wanted, 3)
        assert listed(df) == listed(ranking.bm25_batch(kept, wanted, 3))
        assert records(spark, df) < n + 3 * 20 * 8 + 8 * 100  # texts once, 3 rows a query and task, terms of queries
    one, two = (ranking.scored(i, ["w1", "w7"]) for i in (plain, kept))
    assert listed(one.withColumn("score", F.round("score", 9))) == listed(two.withColumn("score", F.round("score", 9)))


def test_vocab_ids_shuffle_each_term_twice_at_most(spark):
    docs = texts(spark, 300)
    plain, kept = both(docs)
    assert listed(plain.vocabulary()) == listed(kept.vocabulary())
    df = plain.vocabulary()
    assert [r.tid for r in df.orderBy("term").collect()] == list(range(df.count())) and "Window" not in plan(df)


def test_tokens_are_those_of_ascii_letters(spark):
    every = "".join(chr(c) + " " for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000)
    df = spark.createDataFrame([(every,), ("aİbKc ÀB ﬀ ΑΣ",), (None,), ("",)], "t string")
    old = F.regexp_extract_all(F.translate("t", T.UPPER, T.LOWER), F.lit("[a-z0-9]+"), F.lit(0))
    for r in df.select(T.tokens("t").alias("a"), old.alias("b"), T.fold("t").alias("c"), F.translate("t", T.UPPER, T.LOWER).alias("d")).collect():
        assert r.a == r.b and r.c == r.d


def test_hybrid_bow_embeds_documents_where_they_lie(spark, monkeypatch):
    docs = texts(spark, 40)
    plain, kept = both(docs)
    e = vectors.Embedder.bootstrap(plain)
    assert "Exchange" not in plan(e.documents(plain))
    got = {r.vec_id: r.embedding for r in e.documents(plain).collect()}
    assert set(got) == set(range(40)) and got == {r.vec_id: r.embedding for r in vectors.Embedder.bootstrap(kept).documents(kept).collect()}
    w2 = np.random.default_rng(42).uniform(-1, 1, (32, 64))
    p = ix.postings(docs).select("doc_id", F.xxhash64("term", F.lit(42)).alias("tid"), "tf").where("doc_id = 7").orderBy("tid").toPandas()
    v = np.maximum(0, w2 @ np.maximum(0, p.tf.to_numpy(float) @ vectors.drawn(p.tid.to_numpy(), 64)))
    assert np.allclose(got[7], v / np.linalg.norm(v), atol=1e-6)
    wanted = spark.createDataFrame([(1, "w1"), (1, "w1"), (1, "unknown"), (2, "unknown")], "qid long, term string")
    assert set(r.qid for r in e.queries(wanted).collect()) == {1} and "collect_list(struct" not in plan(e.queries(wanted))


def test_ask_pipeline_searches_once_for_evidence(spark):
    def search(wanted):
        found = spark.createDataFrame([(1000, 1, 1.0, 1)], "qid long, doc_id long, score double, rk int")
        return found.where(F.udf(lambda d: seen_by.add(1) or True, "boolean")("doc_id"))

    seen_by = spark.sparkContext.accumulator(0)
    i = ix.Index.of(spark.createDataFrame([(1, "Japan is an island country located in east Asia, in the Pacific Ocean.")], "doc_id long, text string"), persist=False)
    q = spark.createDataFrame([(1, "where is japan")], "qid long, query string")
    from querylark.operators.hybrid import Retriever

    got = pipeline.ask(i, q, by=Retriever("one", search)).collect()
    assert [r.sources for r in got if not r.is_support] == [[1]] and seen_by.value == 1


def _docs(spark, path, n=40):
    rows = [(k, f"The ering of the number {k} is a thing und it is of the text. Wher it goes no one is.", "en") for k in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_confidence_basic_reads_each_text_once_for_all_keywords(spark, tmp_path):
    text = plan(registry.QUERIES["confidence_basic"](spark, _docs(spark, tmp_path)))
    optimized = text[text.index("Optimized Logical Plan") : text.index("Physical Plan ==")]
    assert optimized.count("regexp_extract_all") == 1
    e = spark.createDataFrame([(1, "a b", ["a", "a", "z"]), (1, "c", ["a", "a", "z"]), (2, "q", ["a"]), (3, "q", []), (4, None, ["a"])], "need_id long, text string, keywords array<string>")
    for whole in (True, False):
        assert {r.need_id: round(r.coverage, 6) for r in evidence.coverage(e, whole_words=whole).collect()} == {1: 0.333333, 2: 0.0, 4: 0.0}


def test_confidence_refined_joins_no_texts_for_pairs(spark, tmp_path):
    claimed = evidence.claims(registry._evidence(spark, _docs(spark, tmp_path)))
    assert "Join" not in plan(evidence.pairs(claimed)) and evidence.pairs(claimed).count() == 2 * 105 + 45


def test_definition_rank_makes_each_score_once(spark, tmp_path):
    text = plan(registry.QUERIES["definition_rank"](spark, _docs(spark, tmp_path)))
    optimized = text[text.index("Optimized Logical Plan") : text.index("Physical Plan ==")]
    assert not [x for x in optimized.splitlines() if "Filter" in x and "regexp_extract_all" in x]


def test_chunk_topk_shuffles_no_texts(spark, tmp_path):
    text = plan(registry.QUERIES["chunk_topk"](spark, _docs(spark, tmp_path)))
    optimized = text[text.index("Optimized Logical Plan") : text.index("Physical Plan ==")]
    below = optimized[optimized.index("Window ") :]
    assert "rlike" not in optimized[: optimized.index("Window ")].lower() and "rlike" in below.lower()
