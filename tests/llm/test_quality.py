import numpy as np
from querylark.llm import common, quality, stats


def test_held_out_accuracy(spark):
    got = quality.op3_quality(spark, "/root/testdata/sf0.01")
    labels = common.read(spark, "/root/testdata/sf0.01", "labels")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert got.count() == 1000 and all(0 <= r.score <= 1 for r in rows)


def test_labels_that_are_held_out_are_not_learned(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(1, None, 0), (None, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.id: r.y for r in stats.training_labels(labels, "quality").collect()}
    import zlib

    assert got == {i: i % 2 for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2}


def test_edges(spark):
    rows = [(i, ("The quick brown fox, so it seems. " * (1 + i % 5)) if i % 2 else "BUY!!! $$$ NOW!!! " * (1 + i % 7), 9.0) for i in range(60)]
    rows += [(100, None, 1.0), (101, "", 1.0), (102, "word " * 60000, 1.0), (None, "text", 1.0), (1, rows[1][1], 9.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = quality.scores(docs, labels).collect()
    assert len(got) == 65 and all(r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 60)
    assert quality.scores(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.scores(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 0").count() == 0 and kept.count() == sum(r.predicted for r in got)


def test_isotonic():
    assert np.allclose(quality.isotonic(np.array([0.0, 3, 1, 9]), np.array([9.0, 4, 4, 9])), [0.05, 4.5 / 9, 4.5 / 9, 9.5 / 10])
