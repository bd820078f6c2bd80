import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from querylark.llm import common, pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_equals_library_on_odd_texts(library):
    v = pieces.load()
    r = random.Random(1)
    texts = ["", " ", "a", "  two  spaces ", "line\n\nbreak \n x", "é漢字🙂 ok\t\ttab", "x" * 500, "ab" * 3000 + " " * 300, "\n", "▁mark", "password=b7db7aa4a5fcc78305"]
    texts += ["".join(r.choice("abctheingr .,\n ééß漢") for _ in range(r.randrange(1, 200))) for _ in range(800)]
    got = pieces.encode_texts(texts, v)
    for t, x in zip(texts, got):
        assert x.tolist() == library.encode(t), repr(t)
        if "▁" not in t:
            assert pieces.decode_ids(x, v) == t or not len(x)
    assert [x.tolist() for x in pieces.encode_texts(texts[5:7], v)] == [library.encode(t) for t in texts[5:7]]


def test_query_equals_library(spark, library):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in common.read(spark, d, "documents").collect()}
    rows = pieces.op6_pieces(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(library.encode(texts[r.doc_id]), "<i4")
        assert r.decoded and r.n_pieces == len(ids) and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()


def test_encode_decode_edges(spark):
    rows = [(1, None), (2, ""), (3, "so  it\nis é"), (3, "so  it\nis é"), (None, "a" * 100_000), (5, "word " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(0))
    back = pieces.decode(pieces.encode(docs)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((i or -1, t or "") for i, t in rows)
    assert pieces.encode(docs.limit(0)).count() == 0


def test_viterbi_equals_brute_force(spark):
    r = random.Random(3)
    table = {p: -round(r.uniform(1, 9), 3) for p in {"".join(r.choice("abc") for _ in range(r.randrange(1, 5))) for _ in range(40)} if p != "c"}
    units = ["".join(r.choice("abcd") for _ in range(r.randrange(1, 12))) for _ in range(150)]

    def brute(u):
        best = {0: (0.0, [])}
        for b in range(1, len(u) + 1):
            best[b] = max(((best[a][0] + table.get(u[a:b], -100.0), best[a][1] + [u[a:b]]) for a in range(max(0, b - 4), b) if u[a:b] in table or b - a == 1), key=lambda x: x[0])
        return best[len(u)]

    got = pieces.viterbi(spark.createDataFrame([(u,) for u in units], "unit string"), spark.createDataFrame(list(table.items()), "piece string, score double"), 4).collect()
    assert {x.unit for x in got} == set(units)
    for x in got:
        assert "".join(x.pieces) == x.unit
        assert abs(sum(table.get(p, -100.0) for p in x.pieces) - brute(x.unit)[0]) < 1e-6
