"""Questions to answers, for a whole batch of questions in one plan.

questions -> needs -> ranked documents -> passages -> evidence -> answer, confidence, length, validation.
Evidence is written once (checkpoint) because the answer, its confidence and its coverage all read it.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylark.functions import text as T
from querylark.operators import chunks, conversation, evidence, needs, synthesis
from querylark.operators.hybrid import Retriever, retriever
from querylark.operators.index import Index, dense_ids

from .config import Config


def _cut(df: DataFrame) -> DataFrame:
    """Written once, to the shared checkpoint folder that the session names. Where it names none: to a local one in local mode,
    as in tests; on a cluster that is an error."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="querylark-"))
    return df.checkpoint()


def need_id() -> Column:
    return (F.col("qid") * 1000 + F.col("need_ord")).alias("need_id")


def understood(queries: DataFrame, memory: DataFrame | None = None, brief: bool = False, detailed: bool = False) -> DataFrame:
    """Needs in the order of answering, support needs included, with need_id.

    Both steps in between are written once, as what follows reads each of them several times.
    """
    found = needs.analyzed(queries)
    found = _cut(found if memory is None else needs.remembered(found, memory))
    plan = needs.planned(_cut(needs.overridden(needs.expanded(found), brief, detailed)))
    return plan.withColumn("need_id", need_id())


def evidence_for(wanted: DataFrame, ranked: DataFrame, docs: DataFrame, per_doc: int, most: int, merge: bool = True, config: Config = Config()) -> DataFrame:
    """(need_id, ev_ord, doc_id, type, text, score, keywords) for wanted needs and ranked(need_id, doc_id, score, rk)."""
    # Documents are cut once, however many needs found them.
    # As many documents as needs found: a number for each need.
    found = chunks.chunks(docs.join(F.broadcast(ranked.select("doc_id").distinct()), "doc_id", "left_semi"), config.least_chunk)
    pieces = ranked.join(found, "doc_id").join(wanted.select("need_id", "property", "keywords"), "need_id")
    chosen = chunks.selected(pieces, per_doc, boosts=(config.keyword_boost, config.own_type_boost, config.place_boost, config.preferred_boost))
    chosen = chunks.merged(chosen, pieces) if merge else chosen
    return chunks.capped(chosen, most).select("need_id", "ev_ord", "doc_id", "type", "text", "score", "keywords")


def _retrieved(wanted: DataFrame, search) -> DataFrame:
    terms = wanted.select(F.col("need_id").alias("qid"), F.explode("keywords").alias("term"))
    return search(terms).select(F.col("qid").alias("need_id"), "doc_id", "score", "rk")


def _judged(wanted: DataFrame, ev: DataFrame, with_refined: bool, config: Config) -> DataFrame:
    """needs with answer, confidence, agreement, n_evidence, counts of pairs."""
    text = synthesis.answered(wanted, ev)
    a = evidence.analysis(ev)
    cov = evidence.coverage(ev, whole_words=not with_refined)
    mean = ev.groupBy("need_id").agg(F.avg("score").alias("mean_score"))
    met = wanted.join(text, "need_id").join(a, "need_id", "left").join(cov, "need_id", "left").join(mean, "need_id", "left")
    n = F.coalesce("n_evidence", F.lit(0))
    c = evidence.refined_confidence(F.col("coverage"), n, F.col("agreement"), F.col("penalty"), (config.coverage_share, config.volume_share, config.agreement_share, config.penalty_share), config.enough_evidence) if with_refined else evidence.basic_confidence(F.col("coverage"), F.col("mean_score"), n)
    empty = (n == 0) | (F.size("keywords") == 0)
    return met.select(*wanted.columns, "answer", F.when(empty, 0.0).otherwise(F.coalesce(c, F.lit(0.0))).alias("confidence"), F.coalesce("agreement", F.lit(0.5)).alias("agreement"), n.alias("n_evidence"), F.coalesce("contradiction_pairs", F.lit(0)).alias("contradictions"), F.coalesce("agreement_pairs", F.lit(0)).alias("agreements"))


def retriever_of(config: Config, index: Index, doc_vectors: DataFrame | None = None, embed_queries: Callable[[DataFrame], DataFrame] | None = None) -> Retriever:
    """The retriever that settings name, over an index and, where there are some, its vectors."""
    return retriever(config.retriever, index, doc_vectors, embed_queries, config.max_ranked_docs, config.top_k, config.k1, config.b, (config.lexical_share, config.semantic_share))


def ask(index: Index, queries: DataFrame, config: Config = Config(), by: Retriever | None = None, memory: DataFrame | None = None, brief: bool = False, detailed: bool = False) -> DataFrame:
    """One row a need of queries(qid, query), in plan_ord: answer, confidence, sources, validation, compression, context.

    The result has support needs, too; where(~is_support) is what a user sees.
    """
    by = by or retriever_of(config, index)
    plan = _cut(understood(queries, memory, brief, detailed))
    # Ranked documents, a few rows a need, are written once: three steps read them, and each would search all texts.
    ev = _cut(evidence_for(plan, _cut(_retrieved(plan, by.search)), index.docs, config.chunks_per_doc, config.max_evidence, config=config))
    judged = _judged(plan, ev, True, config)
    level = evidence.compression(F.col("scope"), F.col("confidence"), F.col("agreement"), F.col("n_evidence"), config.compressed_confidence, config.compressed_agreement)
    note = F.when(F.col("contradictions") > 0, F.concat(F.col("contradictions").cast("string"), F.lit(" contradiction(s) detected."), F.when(F.col("agreements") > 0, F.concat(F.lit(" "), F.col("agreements").cast("string"), F.lit(" agreement(s)."))).otherwise("")))
    short = judged.withColumn("compression", level).withColumn("pair_note", note).withColumn("answer", evidence.compressed("answer", F.col("compression")))
    short = short.withColumn("scope", evidence.adjusted_scope(F.col("scope"), F.col("confidence"), config.high_confidence, config.low_confidence)).withColumn("answer", T.truncated("answer", evidence.most_chars(F.col("scope"), config.strict_chars, config.normal_chars, config.expanded_chars)))
    valid = lambda: evidence.validated(F.col("answer"), F.col("property"), F.col("confidence"), config.signals_fail, config.signals_weak, config.fail_factor, config.weak_factor)
    checked = short.withColumn("v", valid())
    supports = needs.support_needs(plan).withColumn("need_id", need_id())
    cov = evidence.support_coverage(supports, ev, ["need_id"])
    met = checked.join(cov, "need_id", "left")
    low = F.coalesce(F.col("support_coverage") < config.support_coverage, F.lit(False))
    covered = F.concat(F.lit("Self-ask coverage: "), F.floor(F.col("support_coverage") * 100).cast("string"), F.lit("%."))
    notes = F.concat_ws(" ", F.coalesce(F.when(F.col("v.note") != "", F.col("v.note")), F.col("pair_note")), F.when(low, covered))
    first = met.select("need_id", *[c for c in plan.columns if c not in ("need_id", "scope")], "scope", "answer", F.when(low, F.col("v.confidence") * (F.col("support_coverage") + 0.5)).otherwise(F.col("v.confidence")).alias("confidence"), "v.validated", notes.alias("note"), "compression")
    src = evidence.sources(ev)
    out = first.join(src, "need_id", "left")
    if by.fallback is not None:
        first = _cut(out)
        failed = first.where("NOT validated").select(*plan.columns)
        again = evidence_for(failed, _cut(_retrieved(failed, by.fallback)), index.docs, 5, config.max_evidence, merge=False, config=config)
        again = _cut(again)
        retry = _judged(failed, again, False, config).withColumn("v", valid())
        retry = retry.join(evidence.sources(again), "need_id", "left").select("need_id", F.struct(F.col("answer"), F.col("v.confidence").alias("confidence"), F.col("v.validated").alias("validated"), F.concat(F.col("v.note"), F.lit(" (retried with fallback)")).alias("note"), F.col("sources")).alias("r"))
        met = first.join(retry, "need_id", "left")
        better = F.coalesce(F.col("r.validated") | (F.col("r.confidence") > F.col("confidence")), F.lit(False))
        pick = lambda c: F.when(better, F.col(f"r.{c}")).otherwise(F.col(c)).alias(c)
        replaced = ["answer", "confidence", "validated", "note", "sources"]
        out = met.select(*[pick(c) if c in replaced else F.when(better, "NONE").otherwise(F.col(c)).alias(c) if c == "compression" else F.col(c) for c in first.columns])
    return conversation.prior_context(out.withColumn("sources", F.coalesce("sources", F.array().cast("array<long>"))))


def overall(answers: DataFrame) -> DataFrame:
    """(qid, confidence, n_parts, text): mean confidence of all parts; the parts of the user's own needs joined by blank lines."""
    own = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("plan_ord", "is_support", "answer"))), lambda p: ~p["is_support"]), lambda p: p["answer"])
    return answers.groupBy("qid").agg(F.avg("confidence").alias("confidence"), F.count("*").alias("n_parts"), F.array_join(own, "\n\n").alias("text"))


def as_json(answers: DataFrame) -> DataFrame:
    """(qid, json): what a user asked for, one object a question."""
    part = F.struct("plan_ord", F.struct("property", F.col("answer").alias("text"), F.round("confidence", 2).alias("confidence"), "validated", "note", "compression", "sources").alias("p"))
    parts = F.transform(F.array_sort(F.collect_list(part)), lambda x: x["p"])
    return answers.where("NOT is_support").groupBy("qid").agg(F.to_json(F.struct(parts.alias("answers"))).alias("json"))


def hybrid_json(ranked: DataFrame, summaries: DataFrame) -> DataFrame:
    """(qid, json): results and summary of each query."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("rk", "doc_id", "score"))), lambda x: F.struct(x["doc_id"].alias("doc"), x["score"].alias("score")))
    found = ranked.groupBy("qid").agg(rows.alias("results"))
    return found.join(summaries, "qid", "left").select("qid", F.to_json(F.struct("results", "summary")).alias("json"))


def search_json(found: DataFrame) -> DataFrame:
    """(json) with all results of one search."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id"))), lambda x: F.struct(x["doc_id"].alias("doc"), (-x["s"]).alias("score")))
    return found.agg(F.to_json(F.struct(rows.alias("results"))).alias("json"))


def latency_stats(times: DataFrame, value: str = "ms") -> DataFrame:
    """(n, p50, p95, mean, max) of one column; p is the value at place floor(p * n) from 0."""
    n = times.count()
    ranked = dense_ids(times.select(F.col(value).alias("v")), "v", "i").withColumn("n", F.lit(n).cast("long"))
    at = lambda p: F.max(F.when(F.col("i") == F.floor(F.col("n") * p), F.col("v")))
    return ranked.agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.avg("v").alias("mean"), F.max("v").alias("max"))
