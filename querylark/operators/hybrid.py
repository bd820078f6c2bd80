"""Lexical and vector rankings together, and the retrievers that questions go through."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranking, vectors
from .index import Index

LEXICAL, SEMANTIC = 0.7, 0.3


def _scaled(score: Column, key: str) -> Column:
    """Score over the query's best; 0 without a positive one."""
    best = F.max(score).over(Window.partitionBy(key))
    return F.when(best > 0, score / best).otherwise(0.0)


def reranked(lexical: DataFrame, near: DataFrame | None, key: str = "qid", shares: tuple[float, float] = (LEXICAL, SEMANTIC)) -> DataFrame:
    """(key, doc_id, score): lexical hits alone, scaled; those that `near` (key, doc_id, dot) has, too, get its share.

    Without vectors the lexical scores stay as they are.
    """
    if near is None:
        return lexical.select(key, "doc_id", "score")
    base = shares[0] * _scaled(F.col("score"), key)
    met = lexical.select(key, "doc_id", base.alias("base")).join(near.select(key, "doc_id", "dot"), [key, "doc_id"], "left")
    return met.select(key, "doc_id", (F.col("base") + F.coalesce(shares[1] * vectors.unit_score(F.col("dot")), F.lit(0.0))).alias("score"))


def united(lexical: DataFrame, near: DataFrame, key: str = "qid", shares: tuple[float, float] = (LEXICAL, SEMANTIC)) -> DataFrame:
    """(key, doc_id, score) of documents in either; a missing side counts as score 0 or dot 0, negative dots as 0."""
    base = lexical.select(key, "doc_id", _scaled(F.col("score"), key).alias("base"))
    met = base.join(near.select(key, "doc_id", "dot"), [key, "doc_id"], "full")
    dot = F.greatest(F.lit(0.0), F.coalesce("dot", F.lit(0.0)))
    return met.select(key, "doc_id", (shares[0] * F.coalesce("base", F.lit(0.0)) + shares[1] * vectors.unit_score(dot)).alias("score"))


def ranked(scores: DataFrame, k: int, key: str = "qid") -> DataFrame:
    """(key, doc_id, score, rk): the k best by rounded score, ties by doc_id."""
    s = scores.select(key, "doc_id", F.round("score", 6).alias("score"))
    return s.withColumn("rk", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "doc_id"))).where(F.col("rk") <= k)


def with_texts(ranked_docs: DataFrame, docs: DataFrame) -> DataFrame:
    """Ranked documents with their texts."""
    return ranked_docs.join(docs.select("doc_id", "text"), "doc_id")


@dataclass
class Retriever:
    """search(wanted) for wanted(qid, term) gives (qid, doc_id, score, rk); fallback likewise, or None."""

    name: str
    search: Callable[[DataFrame], DataFrame]
    fallback: Callable[[DataFrame], DataFrame] | None = None


def near_documents(doc_vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, dot): the k documents nearest to each of asked(qid, q)."""
    found = vectors.nearest(doc_vectors, asked, k, "dot")
    return found.select("qid", F.col("vec_id").alias("doc_id"), F.col("score").alias("dot"))


def retriever(option: str, index: Index, doc_vectors: DataFrame | None = None, embed_queries: Callable[[DataFrame], DataFrame] | None = None, k: int = 10, top_k: int | None = None, k1: float = ranking.K1, b: float = ranking.B, shares: tuple[float, float] = (LEXICAL, SEMANTIC)) -> Retriever:
    """bm25, hnsw (nearest vectors, exact here) or hybrid. doc_vectors(vec_id, embedding) has vec_id = doc_id;
    embed_queries takes wanted(qid, term) to (qid, q). Without vectors hybrid is bm25. BM25 gives top_k documents (k, if
    None), of which k stay."""
    best = lambda wanted: ranking.bm25_batch(index, wanted, top_k or k, k1=k1, b=b)
    lexical = lambda wanted: best(wanted).where(F.col("rk") <= k)
    if option == "bm25":
        return Retriever("bm25", lexical)
    if option not in ("hnsw", "hybrid"):
        raise ValueError(f"unknown retriever: {option}")

    def near(wanted: DataFrame) -> DataFrame:
        return near_documents(doc_vectors, embed_queries(wanted), k)

    if doc_vectors is None or embed_queries is None:
        if option == "hnsw":
            raise ValueError("hnsw needs vectors")
        return Retriever("hybrid", lexical, lexical)
    if option == "hnsw":
        return Retriever("hnsw", lambda w: ranked(near(w).select("qid", "doc_id", vectors.unit_score(F.col("dot")).alias("score")), k))
    return Retriever("hybrid", lambda w: ranked(reranked(best(w), near(w), shares=shares), k), lexical)
