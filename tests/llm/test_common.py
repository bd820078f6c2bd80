import pytest
from pyspark.sql import functions as F
from querylark.llm import common, minhash


def joined_rows(df, on="["):
    """Rows that came out of all joins, or those on a column, of a DataFrame that was collected."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "Join" in name and on in node.simpleString(1000):
            total += node.metrics().get("numOutputRows").get().value()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            todo += [node.children().apply(k) for k in range(node.children().size())]
    return total


@pytest.mark.parametrize("keys", [["v"], ["v", "k"], ["s", "v"]])
@pytest.mark.parametrize("hot", [0, 1000, 4000])
def test_each_row_goes_through_one_join(spark, keys, hot):
    i = F.col("id")
    v = F.when(i < hot, i % 3 - 1).when(i >= 5500, F.lit(None)).otherwise(i.bitwiseXOR(F.lit(1)) + 10**12)
    rows = spark.range(6000).select("id", v.alias("v"), (i % 2).cast("int").alias("k"), (i % 2).cast("string").cast("binary").alias("s"))
    per_key = rows.groupBy(*keys).agg(F.count("*").alias("c"), F.min("id").alias("least"))
    got = common.join_per_key(rows, per_key, keys, 6000)
    want = rows.join(per_key, keys).select(*got.columns)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    assert joined_rows(got) == got.count() == 5500


def test_hashes_of_near_copies_go_through_one_join(spark, monkeypatch):
    """A group of near copies of any size adds its hashes to the joins with what is known of each hash, each once."""
    seen = []
    join = common.join_per_key

    def spy(rows, per_key, keys, total):
        out = join(rows, per_key, keys, total)
        if keys == ["v"]:
            out.collect()
            seen.append((rows.count(), joined_rows(out, "[v#"), per_key.where(F.col("c") * common.HOT > total).count()))
        return out

    monkeypatch.setattr(common, "join_per_key", spy)
    for copies in (50, 100):
        passage = " ".join(f"w{k}" for k in range(100))
        texts = [f"{passage} x{i}" for i in range(copies)] + [" ".join(f"t{i}w{k}" for k in range(30)) for i in range(100)]
        out = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        assert out.where("kept").count() == 101
    assert len(seen) == 4
    for n, joined, hot in seen:
        assert joined == n and hot
