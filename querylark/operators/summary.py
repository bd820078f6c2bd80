"""Summaries of ranked documents: their sentences that match the query best."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from querylark.functions import text as T

DOCS, SENTENCES, SHARE, SAME = 3, 5, 0.3, 20
NONE = "No relevant information found."


def sentence_score(sentence: Column, kws: Column) -> Column:
    """3 for each distinct word found, 3 more for each if there are several; a little for length, less for headings and items."""
    n = T.hits(T.tokens(sentence), F.array_distinct(kws))
    size = F.length(sentence)
    return n * 3.0 + F.when(n > 1, n * 3.0).otherwise(0.0) + F.when((size > 30) & (size < 300), 0.5).otherwise(0.0) - F.when(sentence.startswith("#"), 2.0).otherwise(0.0) - F.when(sentence.startswith("-"), 1.0).otherwise(0.0)


def chosen_docs(ranked: DataFrame, key: str = "qid", docs: int = DOCS) -> DataFrame:
    """(key, doc_id, score, rk) of the first documents with SHARE of the best score or more; the first always counts."""
    by = Window.partitionBy(key)
    near = ranked.withColumn("best", F.max("score").over(by)).where((F.col("rk") == 1) | (F.col("score") >= F.col("best") * SHARE)).drop("best")
    return near.withColumn("place", F.row_number().over(by.orderBy("rk"))).where(F.col("place") <= docs).drop("place")


def scored_sentences(texts: DataFrame, key: str = "qid") -> DataFrame:
    """(key, rk, sent_ord, sentence, score) with a score of 1 or more, for texts(key, rk, text, keywords)."""
    s = texts.select(key, "rk", "keywords", F.posexplode(T.sentences("text")).alias("sent_ord", "sentence"))
    return s.withColumn("score", sentence_score(F.col("sentence"), F.col("keywords"))).where("score >= 1").drop("keywords")


def pick(sentences: list[tuple[int, str]], total: int = SENTENCES) -> str:
    """From (document place, sentence), best first in each document: the same number of each, without those that
    begin like a part of an earlier one."""
    docs = list(dict.fromkeys(d for d, _ in sentences))
    each = max(1, -(-total // max(1, len(docs))))
    out: list[str] = []
    count = dict.fromkeys(docs, 0)
    for d, s in sentences:
        again = len(s) > SAME and any(s[:SAME] in x for x in out)
        if len(out) < total and count[d] < each and not again:
            out.append(s)
            count[d] += 1
    return " ".join(out) or NONE


@F.pandas_udf(StringType())
def _picked(sentences: pd.Series) -> pd.Series:
    return sentences.map(lambda rows: pick([(r["rk"], r["sentence"]) for r in rows]))


def summaries(ranked: DataFrame, docs: DataFrame, wanted: DataFrame, key: str = "qid") -> DataFrame:
    """(key, summary) for ranked(key, doc_id, score, rk) and wanted(key, keywords); a query without keywords has none."""
    # DOCS rows a query.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen_docs(ranked, key)), "doc_id").join(wanted.select(key, "keywords"), key)
    s = scored_sentences(texts, key)
    # All scored sentences of a query's few documents: how many fall away as repeated ones isn't known before.
    listed = s.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rk", (-F.col("score")).alias("k"), "sent_ord", "sentence"))).alias("rows"))
    return wanted.select(key).distinct().join(listed.select(key, _picked("rows").alias("summary")), key, "left").select(key, F.coalesce("summary", F.lit(NONE)).alias("summary"))
