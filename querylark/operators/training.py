"""Text pairs and template questions for training encoders and analyzers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylark.functions import text as T
from querylark.functions import vocabulary as V


def encoder_pairs(docs: DataFrame, query: int = 5, window: int = 15, stride: int = 5, least: int = 10) -> DataFrame:
    """(doc_id, start, query, passage): every `stride` words, the first words of a window and the window."""
    w = docs.select("doc_id", T.tokens("text").alias("w")).where(F.size("w") >= least)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - query, F.lit(0)), F.lit(stride))
    at = w.select("doc_id", "w", F.explode(starts).alias("start"))
    return at.select("doc_id", "start", F.array_join(F.slice("w", F.col("start") + 1, query), " ").alias("query"), F.array_join(F.slice("w", F.col("start") + 1, window), " ").alias("passage"))


def template_questions(docs: DataFrame, per_doc: int = 20, shortest: int = 3, longest: int = 40) -> DataFrame:
    """(doc_id, entity, question, intent, answer_type) for the first names of each document and all templates."""
    found = F.filter(T.names("text"), lambda n: (F.length(n) >= shortest) & (F.length(n) <= longest))
    e = docs.select("doc_id", F.explode(F.slice(found, 1, per_doc)).alias("entity"))
    t = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(i).alias("intent"), F.lit(k).alias("answer_type")) for a, b, i, k in V.TEMPLATES])
    q = F.concat_ws(" ", F.col("t.a"), "entity", F.when(F.col("t.b") != "", F.col("t.b")))
    return e.select("doc_id", "entity", F.explode(t).alias("t")).select("doc_id", "entity", q.alias("question"), "t.intent", "t.answer_type")


def bio_tags(questions: DataFrame) -> DataFrame:
    """questions(question, entity) with tags: 1 and then 2 on the first match of the entity's words, else 0."""
    w, e = T.tokens("question"), T.tokens("entity")
    n = F.size("ew")
    fits = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1)), lambda p: F.slice("w", p, n) == F.col("ew"))
    at = F.coalesce(F.get(fits, F.lit(0)), F.lit(1 << 30))
    met = questions.withColumn("w", w).withColumn("ew", e).withColumn("at", at)
    return met.withColumn("tags", F.transform("w", lambda _, i: F.when(i + 1 == F.col("at"), 1).when((i + 1 > F.col("at")) & (i + 1 < F.col("at") + n), 2).otherwise(0))).drop("w", "ew", "at")
