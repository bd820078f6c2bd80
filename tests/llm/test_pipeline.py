import re

import corpus_pipeline
from querylark.llm import common, quality
from test_linededup import brute as without_repeats
from test_minhash import brute as near_duplicates
from test_packing import check
from test_pii import brute as base_spans

from querylark.llm import packing


def test_stages_equal_plain_versions(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    docs = common.read(spark, d, "documents")
    columns, kept = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], d).write.parquet(f"file://{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"file://{tmp_path}/{k}"))
    assert all(x.columns == columns for x in kept[:-1])
    texts = [{r.doc_id: (r.text, r.source) for r in x.collect()} for x in kept[:-1]]
    good = {r.doc_id for r in quality.op3_quality(spark, d).where("predicted = 1").collect()}
    assert set(texts[1]) == good and all(texts[0][i] == v for i, v in texts[1].items())
    assert {i: t for i, (t, _) in texts[2].items()} == without_repeats([(i, t) for i, (t, _) in texts[1].items()])
    assert set(texts[3]) == {i for i, _, _, keep in near_duplicates([(i, t) for i, (t, _) in texts[2].items()], 80) if keep}
    for i, (t, _) in texts[4].items():
        assert not base_spans(t)
        assert t == texts[3][i][0] or re.search(r"\[(EMAIL|IP|CARD|PHONE|SECRET|ID)\]", t)
    check(kept[-1].collect(), texts[4], packing.CAPACITY)
    assert sorted(map(str, corpus_pipeline.run(spark, d).collect())) == sorted(map(str, kept[-1].collect()))


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, clashing names, and no rows at all."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words of a text", "en", None, 20), (3, "good text " * 40_000, None, "a", 400_000), (3, "good text " * 40_000, None, "a", 400_000)]
    rows += [(10 + k, f"The quick brown fox number {k} mails jo{k}@site.org, and so on. " * 3, "en", "a", 1) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS id", "2 AS lost", "3 AS gone", "4 AS score", "5 AS kept", "'x' AS spans")
    spark.createDataFrame([(10, 1, 0), (11, 0, 0), (None, 1, 1), (12, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for k, table in enumerate((docs, docs.limit(0))):
        kept = table
        for j, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, kept, f"file://{tmp_path}")
            if name != "packing":
                assert out.columns == docs.columns
            out.write.parquet(f"file://{tmp_path}/{k}-{j}")
            kept = spark.read.parquet(f"file://{tmp_path}/{k}-{j}")
        assert k == 0 or kept.count() == 0
