"""Command line: ingest, build, search, ask, hybrid.

    python -m querylark.cli ingest DATA INDEX
    python -m querylark.cli build INDEX
    python -m querylark.cli search INDEX QUERY [--json]
    python -m querylark.cli ask INDEX QUESTION... [--json] [--brief | --detailed] [--config FILE] [--memory PATH]
    python -m querylark.cli hybrid INDEX QUERY [--config FILE] [-k K]

build embeds the documents of an index; without it, hybrid rankings are those of BM25. All questions of a call know what
the memory file holds from the call before; what the last one is about is remembered for the next call.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from querylark.functions import text as T
from querylark.functions import vocabulary as V
from querylark.operators import boolean, conversation, hybrid, ranking, summary
from querylark.operators.index import Index
from querylark.plans import config as C
from querylark.plans import pipeline, profile
from querylark.shipping import ship
from querylark.sources import corpus


#: Documents of each ranking that `hybrid` unites.
NEAREST = 20


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="querylark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("data")
    a.add_argument("index")
    a = sub.add_parser("build")
    a.add_argument("index")
    for name in ("search", "ask", "hybrid"):
        a = sub.add_parser(name)
        a.add_argument("index")
        a.add_argument("query", nargs="+")
        a.add_argument("--json", action="store_true")
        a.add_argument("--brief", action="store_true")
        a.add_argument("--detailed", action="store_true")
        a.add_argument("--config")
        a.add_argument("--memory")
        a.add_argument("-k", type=int, default=10)
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("querylark").getOrCreate()
    ship(spark)
    if args.command == "ingest":
        corpus.write_index(Index.of(corpus.scan(spark, args.data)), args.index)
        return 0
    index = corpus.read_index(spark, args.index)
    if args.command == "build":
        corpus.write_vectors(index, args.index)
        return 0
    if args.command == "search":
        for r in pipeline.search_json(boolean.search(index, " ".join(args.query), args.k)).collect():
            print(r.json)
        return 0
    queries = spark.createDataFrame(list(enumerate(args.query)), "qid long, query string")
    settings = C.parse("\n".join(r.value for r in spark.read.text(args.config).collect())) if args.config else C.Config()
    built = corpus.read_vectors(spark, args.index, index)
    if args.command == "hybrid":
        wanted = queries.select("qid", T.keywords("query", V.STOP_WORDS).alias("keywords"))
        terms = wanted.select("qid", F.explode("keywords").alias("term"))
        found = ranking.bm25_batch(index, terms, NEAREST, k1=settings.k1, b=settings.b)
        if built:
            scores = hybrid.united(found, hybrid.near_documents(built[0], built[1].queries(terms), NEAREST), shares=(settings.lexical_share, settings.semantic_share))
        else:
            scores = hybrid.reranked(found, None)
        best = hybrid.ranked(scores, args.k)
        for r in pipeline.hybrid_json(best, summary.summaries(best, index.docs, wanted)).orderBy("qid").collect():
            print(r.json)
        return 0
    last = corpus.read_memory(spark, args.memory) if args.memory else (None, None)
    memory = queries.select("qid", F.lit(last[0]).cast("string").alias("last_entity")) if last[0] else None
    by = pipeline.retriever_of(settings, index, *((built[0], built[1].queries) if built else ()))
    watch = profile.Profiler(" | ".join(args.query), settings.analyzer, settings.retriever)
    with watch.stage("ask"):
        answers = pipeline.ask(index, queries, settings, by=by, memory=memory, brief=args.brief, detailed=args.detailed).cache()
        answers.count()
    if args.json:
        for r in pipeline.as_json(answers).orderBy("qid").collect():
            print(r.json)
    else:
        for r in answers.where("NOT is_support").orderBy("qid", "plan_ord").collect():
            print(f"{r.answer}\n  [{r.property}, confidence {r.confidence:.1f}, sources {r.sources}] {r.note}".rstrip())
    if args.memory:
        now = {r.qid: r for r in conversation.memory(answers).collect()}  # a row a question of the command line
        entities = [now[q].last_entity for q in sorted(now) if now[q].last_entity]
        corpus.write_memory(spark, (entities[-1] if entities else last[0], now[max(now)].last_property if now else last[1]), args.memory)
    if settings.profile_path:
        watch.answers(answers)
        profile.append(watch.record(spark), settings.profile_path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
