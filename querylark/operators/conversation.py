"""What a conversation remembers: the last entity and property, turn after turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def carried(needs: DataFrame, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """needs with the last entity of the conversation where they have none; behind their keywords, too."""
    before = Window.partitionBy(conversation).orderBy(order, "need_ord").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("entity") != "", F.col("entity")), ignorenulls=True).over(before)
    met = needs.withColumn("__last", last)
    takes = (F.col("entity") == "") & F.col("__last").isNotNull()
    return met.withColumn("keywords", F.when(takes, F.concat("keywords", F.array("__last"))).otherwise(F.col("keywords"))).withColumn("entity", F.when(takes, F.col("__last")).otherwise(F.col("entity"))).drop("__last")


def memory(needs: DataFrame, key: str = "qid") -> DataFrame:
    """(key, last_entity, last_property) after all needs, in the order of answering."""
    order = F.col("plan_ord") if "plan_ord" in needs.columns else F.col("need_ord")
    return needs.groupBy(key).agg(F.max_by(F.when(F.col("entity") != "", F.col("entity")), F.when(F.col("entity") != "", order)).alias("last_entity"), F.max_by("property", order).alias("last_property"))


def prior_context(answers: DataFrame, key: str = "qid") -> DataFrame:
    """answers with prior_context, the text of the answer before."""
    return answers.withColumn("prior_context", F.lag("answer").over(Window.partitionBy(key).orderBy("plan_ord")))
