"""BM25 over an index, for one query or a batch of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import Index

K1, B = 1.2, 0.75


def idf(df: Column, n: int) -> Column:
    return F.when(df > 0, F.log((F.lit(float(n)) - df + 0.5) / (df + 0.5) + 1.0)).otherwise(0.0)


def idf_table(index: Index) -> DataFrame:
    """(term, df, idf)."""
    return index.terms.select("term", "df", idf(F.col("df"), index.n).alias("idf"))


def weight(tf: Column, dl: Column, avgdl: float, k1: float = K1, b: float = B) -> Column:
    """The term frequency part of BM25."""
    return tf * (k1 + 1.0) / (tf + k1 * (F.lit(1.0 - b) + b * dl / F.lit(float(avgdl))))


def scored(index: Index, terms: Sequence[str], k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, score) of documents with one of the terms or more; each term counts once."""
    found = index.lookup(*dict.fromkeys(terms))
    # One row for each term of the query, so its size is that of the query.
    weights = F.broadcast(found.groupBy("term").agg(F.count("*").alias("df")).select("term", idf(F.col("df"), index.n).alias("idf")))
    return found.join(weights, "term").groupBy("doc_id").agg(F.sum(F.col("idf") * weight(F.col("tf"), F.col("dl"), index.avgdl, k1, b)).alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best by rounded score, ties by doc_id."""
    return scores.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def bm25(index: Index, terms: Sequence[str], k: int = 10, **options: float) -> DataFrame:
    return top(scored(index, terms, **options), k)


def bm25_within(index: Index, terms: Sequence[str], docs: DataFrame, **options: float) -> DataFrame:
    """(doc_id, score) of the given documents alone; frequencies and lengths stay those of the corpus."""
    return scored(index, terms, **options).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")


def bm25_batch(index: Index, wanted: DataFrame, k: int = 10, key: str = "qid", k1: float = K1, b: float = B) -> DataFrame:
    """(key, doc_id, score, rk) for wanted(key, term): the k best documents of each query.

    Postings come dealt by document, so sums are made and the k best of a task are found where they lie; k rows a query and task are shuffled.
    """
    asked = wanted.select(key, "term").distinct()
    weights = index.frequencies(asked).select("term", idf(F.col("df"), index.n).alias("idf"))
    # A row for each query and term, so its size is that of the batch.
    met = index.matched(asked).join(F.broadcast(asked.join(weights, "term")), "term")
    sums = met.groupBy(key, "doc_id").agg(F.round(F.sum(F.col("idf") * weight(F.col("tf"), F.col("dl"), index.avgdl, k1, b)), 6).alias("score"))
    best = Window.partitionBy(key).orderBy(F.desc("score"), "doc_id")
    return sums.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= k)
