"""Queries of the search and question answering engine, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylark.functions import text as T
from querylark.functions import vocabulary as V
from querylark.operators import boolean, chunks, conversation, evidence, hybrid, needs, ranking, summary, synthesis, training, vectors
from querylark.operators import index as ix
from querylark.operators.index import open_index
from querylark.plans import pipeline
from querylark.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return ix.spread(df) if name == "documents" else df


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _sql_count(low: str, words: list[str]) -> str:
    return f"len(list_filter({_sql_list(words)}, lambda w: contains({low}, w)))"


def _low(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: Words of questions and signs that occur in the tables' invented prose.
WORDS = ["the", "and", "thtion"]
_TOK = f"tok AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: {_low('x')}) AS w FROM documents)"
_POS = _TOK + ", pos AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term, unnest(range(len(w))) AS position FROM tok)"
_POST = _POS + ", post AS (SELECT term, doc_id, any_value(dl) AS dl, count(*) AS tf, list(position ORDER BY position) AS positions FROM pos GROUP BY term, doc_id)"
_STATS = _POST + ", st AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM tok), df AS (SELECT term, count(*) AS df FROM post GROUP BY term), idf AS (SELECT term, df, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) AS idf FROM df, st)"
_BM = "sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))"
_SCORED = _STATS + f", sc AS (SELECT doc_id, term, {_BM} AS s FROM post JOIN idf USING (term), st GROUP BY doc_id, term)"


# Text and index ---------------------------------------------------------------------------------------------------
@query(f"WITH {_TOK} SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, array_to_string(w[1:20], ' ') AS head FROM tok")
def tok_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ix.tokenized(table(spark, sf_dir, "documents"))
    return t.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join(F.slice("tokens", 1, 20), " ").alias("head"))


@query(f"WITH {_TOK} SELECT doc_id, CAST(len(w) AS BIGINT) AS dl FROM tok")
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_index(spark, sf_dir).lengths.select("doc_id", F.col("dl").cast("long").alias("dl"))


@query(f"WITH {_TOK} SELECT CAST(count(*) AS BIGINT) AS n, round(CAST(sum(len(w)) AS DOUBLE) / count(*), 6) AS avgdl FROM tok")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = open_index(spark, sf_dir)
    return spark.createDataFrame([(i.n, round(i.avgdl, 6))], "n long, avgdl double")


@query(f"WITH {_POST} SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term")
def term_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_index(spark, sf_dir).terms


@query(f"WITH {_POST} SELECT term, doc_id, CAST(tf AS BIGINT) AS tf FROM post")
def postings_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_index(spark, sf_dir).postings.select("term", "doc_id", F.col("tf").cast("long").alias("tf"))


@query(f"WITH {_POST} SELECT doc_id, CAST(tf AS BIGINT) AS tf, array_to_string(positions, ',') AS positions FROM post WHERE term = 'the'")
def posting_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_index(spark, sf_dir).lookup("the").select("doc_id", F.col("tf").cast("long").alias("tf"), F.array_join("positions", ",").alias("positions"))


@query(f"WITH {_POST} SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS total FROM (SELECT unnest(positions) AS p FROM post WHERE term = 'the' AND doc_id = 1)")
def positions_of_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = open_index(spark, sf_dir).positions_of("the", 1).select(F.explode("positions").alias("p"))
    return p.agg(F.count("*").alias("n"), F.sum("p").cast("long").alias("total"))


@query(
    f"WITH {_POST} SELECT term, doc_id, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS doc_gap, "
    "array_to_string(list_concat(list_transform(range(1, CAST(tf AS BIGINT) + 1), lambda i: positions[i] - CASE WHEN i > 1 THEN positions[i - 1] ELSE 0 END + 1), [0]), ',') AS gaps FROM post WHERE term IN ('the', 'and', 'of')"
)
def posting_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ix.gaps(open_index(spark, sf_dir).lookup("the", "and", "of"))
    return g.select("term", "doc_id", "doc_gap", F.array_join("position_gaps", ",").alias("gaps"))


@query(f"WITH {_POST} SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS tid FROM (SELECT DISTINCT term FROM post)")
def vocab_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_index(spark, sf_dir).vocabulary()


@query(
    "SELECT n_chars, lower(array_to_string(list_transform(range(0, CAST(greatest(1, ceil(length(bin(n_chars)) / 7.0)) AS BIGINT)), "
    "lambda k: lpad(hex((n_chars >> CAST(7 * k AS INTEGER)) % 128 + CASE WHEN k < greatest(1, ceil(length(bin(n_chars)) / 7.0)) - 1 THEN 128 ELSE 0 END), 2, '0')), '')) AS bytes, n_chars AS back FROM (SELECT DISTINCT n_chars FROM documents)"
)
def varint_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("n_chars").distinct()
    return d.select("n_chars", F.lower(ix.varint("n_chars")).alias("bytes"), ix.varint_value(ix.varint("n_chars")).alias("back"))


# Ranking and boolean ----------------------------------------------------------------------------------------------
def _top_sql(where: str, k: int = 10) -> str:
    return f"SELECT doc_id, round(sum(s), 6) AS score FROM sc WHERE {where} GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {k}"


@query(f"WITH {_SCORED} " + _top_sql(f"term IN ({', '.join(repr(w) for w in WORDS)})"))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.bm25(open_index(spark, sf_dir), WORDS)


@query(f"WITH {_STATS} SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM idf")
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.idf_table(open_index(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


_ASKED = f"q AS (SELECT item_id AS qid, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: {_low('x')}), lambda x: len(x) > 1 AND NOT list_contains({_sql_list(V.STOP_WORDS)}, x)))) AS term FROM benchmark)"
_BATCH = _SCORED + f", {_ASKED}, b AS (SELECT qid, doc_id, round(sum(s), 6) AS score FROM q JOIN sc USING (term) GROUP BY qid, doc_id), r AS (SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rk FROM b)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("qid"), T.keywords("text", V.STOP_WORDS).alias("keywords"))


def _terms(asked: DataFrame) -> DataFrame:
    return asked.select("qid", F.explode("keywords").alias("term"))


@query(f"WITH {_BATCH} SELECT qid, doc_id, score, rk FROM r WHERE rk <= 10")
def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.bm25_batch(open_index(spark, sf_dir), _terms(_asked(spark, sf_dir)))


@query(f"WITH {_SCORED} SELECT doc_id, round(sum(s), 6) AS score FROM sc JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) USING (doc_id) WHERE term IN ('the', 'and', 'thtion') GROUP BY doc_id")
def bm25_docset(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return ranking.bm25_within(open_index(spark, sf_dir), WORDS, good).withColumn("score", F.round("score", 6))


def _leaf_sql(term: str) -> str:
    return f"SELECT doc_id, s FROM sc WHERE term = '{term}'"


def _phrase_sql(words: list[str]) -> str:
    from_ = " JOIN ".join(f"(SELECT doc_id, position - {k} AS p FROM pos WHERE term = '{w}') t{k}" + (" USING (doc_id, p)" if k else "") for k, w in enumerate(words))
    return f"SELECT DISTINCT doc_id FROM {from_}"


def _phrase_scored_sql(words: list[str]) -> str:
    return f"SELECT doc_id, sum(s) AS s FROM sc WHERE term IN ({', '.join(repr(w) for w in words)}) AND doc_id IN ({_phrase_sql(words)}) GROUP BY doc_id"


def _bool_sql(body: str, k: int = 50) -> str:
    return f"WITH {_SCORED} SELECT doc_id, round(s, 6) AS score FROM ({body}) ORDER BY score DESC, doc_id LIMIT {k}"


_A, _B, _C, _D = (_leaf_sql(t) for t in ("thtion", "ndthe", "inthe", "the"))


def _both(a: str, b: str) -> str:
    return f"SELECT a.doc_id, a.s + b.s AS s FROM ({a}) a JOIN ({b}) b USING (doc_id)"


def _either(a: str, b: str) -> str:
    return f"SELECT doc_id, coalesce(a.s, 0) + coalesce(b.s, 0) AS s FROM ({a}) a FULL JOIN ({b}) b USING (doc_id)"


def _search(q: str, k: int = 50) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: boolean.search(open_index(spark, sf_dir), q, k)


for _name, _q, _body in (
    ("bool_and", "thtion AND the", _both(_A, _D)),
    ("bool_or", "thtion OR ndthe", _either(_A, _B)),
    ("bool_not", "thtion NOT ndthe", f"SELECT doc_id, s FROM ({_A}) WHERE doc_id NOT IN (SELECT doc_id FROM ({_B}))"),
    ("bool_chain", "thtion AND the OR inthe", _either(_both(_A, _D), _C)),
    ("bool_words_without_operator", "thtion ndthe the", _both(_A, _D)),
    ("bool_dup_term", "thtion OR thtion", _either(_A, _A)),
    ("phrase_2", '"of the"', _phrase_scored_sql(["of", "the"])),
    ("phrase_3", '"is of the"', _phrase_scored_sql(["is", "of", "the"])),
    ("phrase_or_term", '"of the" OR ndthe', _either(_phrase_scored_sql(["of", "the"]), _B)),
    ("bool_case", "Thtion", _leaf_sql("Thtion")),
):
    QUERIES[_name] = _search(_q)
    ORACLE_SQL[_name] = _bool_sql(_body)


@query(f"WITH {_SCORED} SELECT '{{\"results\":[' || coalesce(string_agg('{{\"doc\":' || doc_id || ',\"score\":' || score || '}}', ',' ORDER BY score DESC, doc_id), '') || ']}}' AS json FROM ({_top_sql(chr(116) + 'erm IN (' + chr(39) + 'thtion' + chr(39) + ')', 5)})")
def search_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.search_json(boolean.search(open_index(spark, sf_dir), "thtion", 5))


# Vectors and fusion -----------------------------------------------------------------------------------------------
_DIST = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))"
_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


@query(f"SELECT b.vec_id, round({_DIST}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY score, b.vec_id LIMIT 10")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return vectors.nearest_columns(e, e.where("vec_id = 0").first().embedding, 10)


def _near_sql(score: str, order: str) -> str:
    return f"WITH s AS (SELECT a.vec_id AS qid, b.vec_id, round({score}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score {order}, vec_id) AS INTEGER) AS rk FROM s) SELECT qid, vec_id, score, rk FROM r WHERE rk <= 5"


def _twentieth(e: DataFrame) -> DataFrame:
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


@query(_near_sql(_DIST, ""))
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return vectors.nearest(e, _twentieth(e), 5)


@query(_near_sql(_DOT, "DESC"))
def cosine_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return vectors.nearest(e, _twentieth(e), 5, "dot")


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_DIST}, 6) AS d FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id")
def l2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("a") + 1 == F.col("b")).select("a", "b", F.round(vectors.l2(F.col("x"), F.col("y")), 6).alias("d"))


@query()
def ann_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return vectors.nearest_approximate(e, _twentieth(e), 5)


@query(f"WITH {_POST}, v AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS tid FROM (SELECT DISTINCT term FROM post)) SELECT doc_id, tid, CAST(tf AS BIGINT) AS tf FROM post JOIN v USING (term)")
def bow_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = open_index(spark, sf_dir)
    return vectors.bags(i, i.vocabulary()).select("doc_id", "tid", F.col("tf").cast("long").alias("tf"))


#: A small vocabulary and weights by formula, so that both sides can state them.
_BAG = ["the", "of", "and", "in", "de", "la", "und", "der"]


@query(
    f"WITH {_POST}, v AS (SELECT unnest({_sql_list(_BAG)}) AS term, unnest(range({len(_BAG)})) AS tid), bag AS (SELECT doc_id, tid, tf FROM post JOIN v USING (term)), d AS (SELECT DISTINCT doc_id FROM bag), "
    "hid AS (SELECT d.doc_id, h.h, greatest(0, coalesce(sum(tf * (((tid * 7 + h.h * 3) % 11) - 5) / 10.0::DOUBLE), 0) + h.h * 0.01::DOUBLE) AS a FROM d CROSS JOIN (SELECT unnest(range(6)) AS h) h LEFT JOIN bag USING (doc_id) GROUP BY d.doc_id, h.h), "
    "o AS (SELECT doc_id, o.o, greatest(0, sum(a * (((h * 5 + o.o * 2) % 7) - 3) / 10.0::DOUBLE) + o.o * 0.02::DOUBLE) AS v FROM hid CROSS JOIN (SELECT unnest(range(4)) AS o) o GROUP BY doc_id, o.o), "
    "n AS (SELECT doc_id, o, v, sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS n FROM o) SELECT doc_id, CAST(o AS INTEGER) AS o, round(CASE WHEN n > 0 THEN v / n ELSE 0 END, 6) AS v FROM n"
)
def embed_two_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.createDataFrame([(w, k) for k, w in enumerate(_BAG)], "term string, tid int")
    w1 = spark.createDataFrame([(t, h, (((t * 7 + h * 3) % 11) - 5) / 10.0) for t in range(len(_BAG)) for h in range(6)], "tid int, h int, w double")
    w2 = spark.createDataFrame([(h, o, (((h * 5 + o * 2) % 7) - 3) / 10.0) for h in range(6) for o in range(4)], "h int, o int, w double")
    e = vectors.embed(vectors.bags(open_index(spark, sf_dir), v), w1, F.col("h") * 0.01, w2, F.col("o") * 0.02)
    return e.select("doc_id", "o", F.round("v", 6).alias("v"))


#: Query vectors: the vector whose id is the question's. Documents: the vector whose id is theirs.
_NEAR = f", near AS (SELECT qid, vec_id AS doc_id, dot FROM (SELECT a.vec_id AS qid, b.vec_id, round({_DOT}, 6) AS dot, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 6) DESC, b.vec_id) AS k FROM embeddings a JOIN (SELECT DISTINCT item_id FROM benchmark) i ON a.vec_id = i.item_id, embeddings b) WHERE k <= 20)"
_LEX = _BATCH + ", lex AS (SELECT qid, doc_id, score, rk, CASE WHEN max(score) OVER (PARTITION BY qid) > 0 THEN score / max(score) OVER (PARTITION BY qid) ELSE 0 END AS scaled FROM r WHERE rk <= 20)"


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")).distinct().join(e, "vec_id").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return vectors.nearest(e, q, 20, "dot").select("qid", F.col("vec_id").alias("doc_id"), F.col("score").alias("dot"))


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.bm25_batch(open_index(spark, sf_dir), _terms(_asked(spark, sf_dir)), 20)


def _fused_sql(score: str, joins: str) -> str:
    return f"WITH {_LEX}{_NEAR}, f AS (SELECT qid, doc_id, round({score}, 6) AS score FROM lex {joins}), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rk FROM f) SELECT qid, doc_id, score, rk FROM o WHERE rk <= 10"


@query(_fused_sql("0.7::DOUBLE * coalesce(scaled, 0) + 0.3::DOUBLE * (greatest(0, coalesce(dot, 0)) + 1) / 2", "FULL JOIN near USING (qid, doc_id)"))
def hybrid_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.ranked(hybrid.united(_lexical(spark, sf_dir), _near(spark, sf_dir)), 10)


@query(_fused_sql("0.7::DOUBLE * scaled + coalesce(0.3::DOUBLE * (dot + 1) / 2, 0)", "LEFT JOIN near USING (qid, doc_id)"))
def hybrid_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.ranked(hybrid.reranked(_lexical(spark, sf_dir), _near(spark, sf_dir)), 10)


@query(f"WITH {_BATCH} SELECT qid, doc_id, score, rk FROM r WHERE rk <= 10")
def hybrid_no_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.ranked(hybrid.reranked(_lexical(spark, sf_dir), None), 10)


@query(f"WITH {_BATCH} SELECT qid, doc_id, rk, n_chars FROM r JOIN documents USING (doc_id) WHERE rk <= 3")
def ranked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _lexical(spark, sf_dir).where("rk <= 3")
    # Three rows a question.
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(F.broadcast(best), "doc_id").select("qid", "doc_id", "rk", "n_chars")


@query()
def hybrid_bow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid retriever over embedded bags of words."""
    i = open_index(spark, sf_dir)
    e = vectors.Embedder.bootstrap(i)
    return hybrid.retriever("hybrid", i, e.documents(i), e.queries).search(_terms(_asked(spark, sf_dir)))


@query(f"WITH {_TOK}, v AS (SELECT unnest({_sql_list(_BAG)}) AS term, unnest(range({len(_BAG)})) AS tid), x AS (SELECT doc_id, unnest(w) AS term FROM tok) SELECT doc_id AS qid, CAST(tid AS INTEGER) AS tid, count(*) AS tf FROM x JOIN v USING (term) GROUP BY doc_id, tid")
def bow_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.createDataFrame([(w, k) for k, w in enumerate(_BAG)], "term string, tid int")
    return vectors.bag_of_texts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), "text"), v)


# Passages ---------------------------------------------------------------------------------------------------------
_PARA = r"par AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda p: regexp_replace(p, '^[ \t\r\n]+', '')), lambda p: len(p) > 0) AS ps FROM documents), chk AS (SELECT doc_id, unnest(range(len(ps))) AS chunk_id, unnest(ps) AS text FROM par)"


def _doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with doubled newlines: the tables' texts have no blank lines."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))


@query(f"WITH {_PARA} SELECT doc_id, CAST(chunk_id AS INTEGER) AS chunk_id, text FROM chk WHERE len(text) >= 10")
def para_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunks(_doubled(spark, sf_dir)).select("doc_id", "chunk_id", "text")


#: Signs that the invented prose has, by type.
_SIGNS = {"LOCATION": ["wher"], "ADVANTAGES": ["thtion"], "LIMITATIONS": ["nicht", " no "], "USAGE": ["avec"], "DEFINITION": ["is a"], "TEMPORAL": ["when", "19"], "HISTORY": ["ering"]}


def _type_sql(low: str) -> str:
    whens = []
    for t, ws in _SIGNS.items():
        cond = f"{_sql_count(low, ws)} > 0"
        if t == "LOCATION":
            cond = f"({cond} OR (contains({low}, 'capital') AND {_sql_count(low, V.CAPITAL_CONTEXT)} > 0))"
        whens.append(f"WHEN {cond} THEN '{t}'")
    return "CASE " + " ".join(whens) + " ELSE 'GENERAL' END"


_TYPED = _PARA + f", typ AS (SELECT doc_id, CAST(chunk_id AS INTEGER) AS chunk_id, text, {_type_sql(_low('text'))} AS type, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: {_low('x')}) AS w FROM chk WHERE len(text) >= 10)"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunks(_doubled(spark, sf_dir)).withColumn("type", chunks.chunk_type("text", _SIGNS))


@query(f"WITH {_TYPED} SELECT doc_id, chunk_id, type FROM typ")
def chunk_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir).select("doc_id", "chunk_id", "type")


_NEED = ["the", "erea", "the"]
_CSCORE = f"CAST(3 * len(list_filter({_sql_list(_NEED)}, lambda k: list_contains(w, k))) + CASE WHEN type = 'DEFINITION' THEN 10 WHEN type = 'LOCATION' THEN 6 WHEN type = 'GENERAL' THEN 1 ELSE 0 END AS DOUBLE)"
_CHOSEN = _TYPED + f", cs AS (SELECT doc_id, chunk_id, text, type, {_CSCORE} AS s FROM typ), ck AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, chunk_id) AS INTEGER) AS k FROM cs)"


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir).select(F.lit(1).alias("need_id"), "doc_id", "chunk_id", "text", "type", F.lit("DEFINITION").alias("property"), T.words_of(_NEED).alias("keywords"))


@query(f"WITH {_TYPED} SELECT doc_id, chunk_id, {_CSCORE} AS score FROM typ")
def chunk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pieces(spark, sf_dir)
    return p.select("doc_id", "chunk_id", chunks.score(F.col("property"), F.col("type"), T.tokens("text"), F.col("keywords")).alias("score"))


@query(f"WITH {_CHOSEN} SELECT doc_id, chunk_id, k AS sel_ord, s AS chunk_score FROM ck WHERE k <= 4")
def chunk_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.selected(_pieces(spark, sf_dir), 4).select("doc_id", "chunk_id", "sel_ord", "chunk_score")


#: Texts in which each full stop before a newline is a colon, so that passages go on.
_OPEN_PARA = _PARA.replace("replace(text, chr(10), chr(10) || chr(10))", "replace(text, '.' || chr(10), ':' || chr(10) || chr(10))")
_OPEN_CHOSEN = _CHOSEN.replace(_PARA, _OPEN_PARA)
_GOES_ON = _OPEN_CHOSEN + r", nx AS (SELECT *, lag(k <= 2 AND regexp_matches(text, ':[ \t\r\n]*\z'), 1, false) OVER (PARTITION BY doc_id ORDER BY chunk_id) AS on_ FROM ck), kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN k <= 2 THEN k ELSE 2 + chunk_id + 1 END) AS sel_ord FROM nx WHERE k <= 2 OR on_)"


def _open_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\.\n", ":\n\n").alias("text"))
    c = chunks.chunks(d).withColumn("type", chunks.chunk_type("text", _SIGNS))
    return c.select(F.lit(1).alias("need_id"), "doc_id", "chunk_id", "text", "type", F.lit("DEFINITION").alias("property"), T.words_of(_NEED).alias("keywords"))


@query(f"WITH {_GOES_ON} SELECT doc_id, chunk_id, CAST(sel_ord AS INTEGER) AS sel_ord FROM kept")
def chunk_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.selected(_open_pieces(spark, sf_dir), 2).select("doc_id", "chunk_id", "sel_ord")


@query(
    rf"WITH {_GOES_ON}, m AS (SELECT a.doc_id, a.chunk_id, CASE WHEN regexp_matches(a.text, ':[ \t\r\n]*\z') AND b.text IS NOT NULL THEN a.text || chr(10) || b.text ELSE a.text END AS text FROM kept a LEFT JOIN typ b ON a.doc_id = b.doc_id AND a.chunk_id + 1 = b.chunk_id) SELECT doc_id, chunk_id, CAST(length(text) AS INTEGER) AS n, md5(text) AS text_md5 FROM m"
)
def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _open_pieces(spark, sf_dir)
    m = chunks.merged(chunks.selected(p, 2), p)
    return m.select("doc_id", "chunk_id", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"WITH {_CHOSEN}, e AS (SELECT doc_id, chunk_id, row_number() OVER (ORDER BY doc_id, k) AS ev_ord FROM ck WHERE k <= 2 AND doc_id < 60) SELECT doc_id, chunk_id, CAST(ev_ord AS INTEGER) AS ev_ord FROM e WHERE ev_ord <= 15")
def evidence_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks.selected(_pieces(spark, sf_dir), 2).withColumn("rk", F.col("doc_id"))
    return chunks.capped(c).select("doc_id", "chunk_id", "ev_ord")


# Sentences, segments, summaries -----------------------------------------------------------------------------------
_SENT = r"sen AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+\z'), lambda s: regexp_replace(s, '^[ \n]+', '')), lambda s: len(s) > 15) AS ss FROM documents)"


@query(f"WITH {_SENT} SELECT doc_id, CAST(len(ss) AS INTEGER) AS n, md5(array_to_string(ss, '|')) AS joined FROM sen")
def sent_split_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", T.sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|").cast("binary")).alias("joined"))


@query(r"WITH c AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])([ \n])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^[ \n]+', '')), lambda s: len(s) > 10) AS ss FROM documents) SELECT doc_id, CAST(len(ss) AS INTEGER) AS n, md5(array_to_string(ss, '|')) AS joined FROM c")
def sent_split_comp(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", T.clear_sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|").cast("binary")).alias("joined"))


_WANTED = ["the", "thtion", "erea"]
_SSCORE = "3.0::DOUBLE * n + CASE WHEN n > 1 THEN 3.0 * n ELSE 0 END + CASE WHEN len(s) > 30 AND len(s) < 300 THEN 0.5 ELSE 0 END - CASE WHEN starts_with(s, '#') THEN 2 ELSE 0 END - CASE WHEN starts_with(s, '-') THEN 1 ELSE 0 END"
_SCORED_SENT = _SENT + f", x AS (SELECT doc_id, unnest(range(len(ss))) AS sent_ord, unnest(ss) AS s FROM sen), y AS (SELECT *, len(list_filter({_sql_list(_WANTED)}, lambda k: list_contains(list_transform(regexp_extract_all(s, '[A-Za-z0-9]+'), lambda z: {_low('z')}), k))) AS n FROM x), z AS (SELECT doc_id, CAST(sent_ord AS INTEGER) AS sent_ord, s, CAST({_SSCORE} AS DOUBLE) AS score FROM y)"


@query(f"WITH {_SCORED_SENT} SELECT doc_id, sent_ord, score FROM z WHERE score >= 1")
def sent_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("rk"), "text", T.words_of(_WANTED).alias("keywords"))
    return summary.scored_sentences(d, "doc_id").select("doc_id", "sent_ord", "score")


@query(f"WITH {_LEX}, m AS (SELECT qid, doc_id, score, rk, max(score) OVER (PARTITION BY qid) AS best FROM lex), k AS (SELECT qid, doc_id, rk, row_number() OVER (PARTITION BY qid ORDER BY rk) AS place FROM m WHERE rk = 1 OR score >= best * 0.3::DOUBLE) SELECT qid, doc_id, rk FROM k WHERE place <= 3")
def summary_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.chosen_docs(_lexical(spark, sf_dir)).select("qid", "doc_id", "rk")


@query()
def summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.summaries(_lexical(spark, sf_dir), table(spark, sf_dir, "documents"), _asked(spark, sf_dir))


@query()
def hybrid_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.hybrid_json(QUERIES["hybrid_union"](spark, sf_dir), summary_text(spark, sf_dir))


@query(
    r"WITH m AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '(?m)^[ \t]*([-#*][^\n]*)$', chr(1) || '\1' || chr(1), 'g'), '\n([ \t\r]*\n)+', chr(1) || chr(10), 'g'), chr(1)) AS runs FROM documents), "
    r"c AS (SELECT doc_id, flatten(list_transform(runs, lambda r: CASE WHEN regexp_matches(r, '^[-#*]') THEN [r] ELSE regexp_extract_all(regexp_replace(replace(r, chr(10), ' '), '^[ \t\r\n]+', ''), '[^.!?]*[.!?]|[^.!?]+\z') END)) AS cut FROM m), "
    r"s AS (SELECT doc_id, list_filter(list_transform(cut, lambda x: regexp_replace(x, '^[ \t\r\n-]+', '')), lambda x: len(x) >= 15) AS segs FROM c) "
    r"SELECT doc_id, CAST(unnest(range(len(segs))) AS INTEGER) AS seg_ord, unnest(segs) AS seg FROM s"
)
def segment_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.segments("text")).alias("seg_ord", "seg"))


# Query understanding ----------------------------------------------------------------------------------------------
def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as clauses."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", F.col("text").alias("query"), T.fold("text").alias("clause"), T.keywords("text", V.STOP_WORDS).alias("keywords"))


_KW = f"list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: {_low('x')}), lambda x: len(x) > 1 AND NOT list_contains({_sql_list(V.STOP_WORDS)}, x))"
_TURNS = f"t AS (SELECT conv_id, turn, text, {_low('text')} AS low, {_KW} AS kw FROM conversations WHERE role = 'user')"


@query(f"WITH {_TURNS} SELECT conv_id, turn, array_to_string(kw, ' ') AS keywords FROM t")
def keyword_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", F.array_join("keywords", " ").alias("keywords"))


_PROPS = [f"{{'s': {V.WEIGHTS[p]}::DOUBLE * {_sql_count('low', V.QUERY_SIGNALS[p])}, 'r': {-k}, 'p': '{p}'}}" for k, p in enumerate(V.QUERY_SIGNALS)]
_BEST = _TURNS + f", b AS (SELECT *, list_max([{', '.join(_PROPS)}]) AS best FROM t), p AS (SELECT *, CASE WHEN best.s > 0 THEN best.p ELSE 'GENERAL' END AS property FROM b)"


@query(f"WITH {_BEST} SELECT conv_id, turn, property, CAST(best.s AS DOUBLE) AS score FROM p")
def property_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir).withColumn("best", needs.best_property("clause"))
    return t.select("conv_id", "turn", "best.property", "best.score")


_MAPS = "CASE property " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.TYPE_OF_PROPERTY.items()) + " ELSE 'SUMMARY' END"


@query(f"WITH {_BEST}, m AS (SELECT conv_id, turn, {_MAPS} AS answer_type FROM p) SELECT conv_id, turn, answer_type, CASE answer_type " + " ".join(f"WHEN '{k}' THEN '{p}/{f}'" for k, (p, f) in V.ANSWER_TYPES.items()) + " ELSE 'GENERAL/SUMMARY' END AS back FROM m")
def answer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir).withColumn("a", needs.answer_type(needs.best_property("clause")["property"], F.lit("LIST"))["answer_type"])
    return t.select("conv_id", "turn", F.col("a").alias("answer_type"), F.concat_ws("/", needs.of_answer_type(F.col("a"))["property"], needs.of_answer_type(F.col("a"))["form"]).alias("back"))


_OWN = f"list_filter(kw, lambda x: NOT list_contains({_sql_list(V.NO_ENTITIES)}, x))"
_ENTITY = f"coalesce(list_filter({_OWN}, lambda x: len(x) >= 2 AND regexp_matches(substr(text, CAST(instr(low, x) AS BIGINT), len(x)), '^[A-Z]+\\z'))[1], list_filter({_OWN}, lambda x: len(x) = list_max(list_transform({_OWN}, lambda y: len(y))))[1], '')"


@query(f"WITH {_TURNS} SELECT conv_id, turn, {_ENTITY} AS entity FROM t")
def entity_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", needs.entity("keywords", "query").alias("entity"))


_FORMS = " ".join(f"WHEN property = '{p}' THEN '{f}'" for p, f in V.DEFAULT_FORM.items())


_FORM_SQL = f"CASE {_FORMS} WHEN {_sql_count('low', V.EXPLANATION_HINTS)} > 0 THEN 'EXPLANATION' WHEN {_sql_count('low', V.SUMMARY_HINTS)} > 0 THEN 'SUMMARY' ELSE 'SHORT_FACT' END"
_SCOPE_SQL = f"CASE WHEN {_sql_count('low', V.STRICT_HINTS)} > 0 THEN 'STRICT' WHEN {_sql_count('low', V.EXPANDED_HINTS)} > 0 THEN 'EXPANDED' WHEN property IN ('LOCATION', 'DEFINITION', 'TIME') THEN 'STRICT' WHEN property IN ('HISTORY', 'COMPARISON') THEN 'EXPANDED' ELSE 'NORMAL' END"


@query(f"WITH {_BEST} SELECT conv_id, turn, {_FORM_SQL} AS form, {_SCOPE_SQL} AS scope FROM p")
def scope_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir).withColumn("p", needs.best_property("clause")["property"])
    return t.select("conv_id", "turn", needs.form("clause", F.col("p")).alias("form"), needs.scope("clause", F.col("p")).alias("scope"))


_CARRY = f"WITH {_TURNS}, e AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 2 THEN '' ELSE {_ENTITY} END AS entity FROM t), l AS (SELECT conv_id, turn, entity AS own, last_value(nullif(entity, '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM e)"


@query(_CARRY + " SELECT conv_id, turn, CASE WHEN own = '' THEN coalesce(last, '') ELSE own END AS entity FROM l")
def entity_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.when(F.col("turn") % 4 == 2, "").otherwise(needs.entity("keywords", "query"))
    return conversation.carried(_turns(spark, sf_dir).withColumn("entity", e).withColumn("need_ord", F.lit(0))).select("conv_id", "turn", "entity")


@query("SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prior_context FROM conversations")
def prior_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("plan_ord"), F.col("text").alias("answer"))
    return conversation.prior_context(c).select(F.col("qid").alias("conv_id"), F.col("plan_ord").alias("turn"), "prior_context")


#: Questions with signals of several properties, made of names in the tables.
_ASKS = ["Where is {} and how does it work?", "What is {}; what are the advantages of {}?", "history of {}", "explain {} in detail and tell me its limitations", "compare {} and SQL", "what are the parts of {}?"]


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("qid"), F.lower("n_name").alias("name"))
    patterns = T.words_of(_ASKS)
    return n.select("qid", F.replace(F.get(patterns, (F.col("qid") % len(_ASKS)).cast("int")), F.lit("{}"), F.col("name")).alias("query"))


def _joined(n: DataFrame) -> DataFrame:
    return n.withColumn("keywords", F.array_join("keywords", " "))


_CLAUSE_CUT = (
    "array_to_string(list_transform(range(1, len(a) + 1), lambda i: a[i] || CASE WHEN i = len(a) THEN '' "
    f"WHEN regexp_matches(array_to_string(a[i + 1:], ' and '), '{'|'.join(V.CLAUSE_TRIGGERS)}') THEN ';' ELSE ' and ' END), '')"
)


def _needs_sql(query: str) -> str:
    """Common tables up to needs: the needs of a question for each nation, with their columns."""
    return (
        f"q AS (SELECT n_nationkey AS qid, {query} AS text FROM nation), a AS (SELECT *, {_low('text')} AS low, string_split({_low('text')}, ' and ') AS a FROM q), "
        f"x AS (SELECT *, list_filter(list_transform(regexp_split_to_array({_CLAUSE_CUT}, '[;?]'), lambda p: regexp_replace(p, '^[ \\t]+', '')), lambda p: len(p) > 0) AS cs FROM a), "
        "y AS (SELECT qid, text, low, CASE WHEN len(cs) > 0 THEN cs ELSE [low] END AS cs FROM x), "
        "z AS (SELECT qid, text, low, CAST(unnest(range(len(cs))) AS INTEGER) AS need_ord, unnest(cs) AS clause FROM y), "
        f"t AS (SELECT *, {_KW.replace('(text,', '(clause,')} AS kw FROM z), o AS (SELECT qid, need_ord, clause, kw, {_ENTITY} AS own FROM t), "
        "f AS (SELECT *, clause AS low, coalesce(last_value(nullif(own, '') IGNORE NULLS) OVER (PARTITION BY qid ORDER BY need_ord), '') AS entity FROM o), "
        f"b AS (SELECT *, list_max([{', '.join(_PROPS)}]) AS best FROM f), p AS (SELECT *, CASE WHEN best.s > 0 THEN best.p ELSE 'GENERAL' END AS property FROM b), "
        f"needs AS (SELECT qid, need_ord, clause, array_to_string(CASE WHEN own = '' AND entity <> '' AND NOT list_contains(kw, entity) THEN list_prepend(entity, kw) ELSE kw END, ' ') AS keywords, entity, property, CAST(best.s AS DOUBLE) AS property_score, {_FORM_SQL} AS form, {_SCOPE_SQL} AS scope, false AS is_support FROM p)"
    )


_NEEDS = _needs_sql(f"replace({_sql_list(_ASKS)}[CAST(n_nationkey % {len(_ASKS)} AS INTEGER) + 1], '{{}}', lower(n_name))")


@query(f"WITH {_NEEDS} SELECT * FROM needs")
def needs_analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(needs.analyzed(_questions(spark, sf_dir)))


@query(f"WITH {_needs_sql(chr(39) + 'how does it work' + chr(39))} SELECT * REPLACE (CASE WHEN entity = '' THEN concat_ws(' ', nullif(keywords, ''), 'engine') ELSE keywords END AS keywords, CASE WHEN entity = '' THEN 'engine' ELSE entity END AS entity) FROM needs")
def needs_remembered(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _questions(spark, sf_dir)
    return _joined(needs.remembered(needs.analyzed(q.withColumn("query", F.lit("how does it work"))), q.select("qid", F.lit("engine").alias("last_entity"))))


_RULES = "r(trigger, rule, property, form, words) AS (VALUES " + ", ".join(f"('{a}', {k}, '{b}', '{f}', '{' '.join(w)}')" for k, (a, b, f, w) in enumerate(V.SELF_ASK)) + ")"
_WAITS = _sql_list([f"{a}>{b}" for a, bs in V.DEPENDENCIES.items() for b in bs])
#: Needs and, behind them, what they ask themselves.
_EXPANDED = (
    f"WITH RECURSIVE {_NEEDS}, {_RULES}, "
    "s AS (SELECT qid, need_ord, rule, r.property AS property, r.form AS form, r.words || ' ' || entity AS keywords, entity FROM needs JOIN r ON needs.property = r.trigger), "
    "s1 AS (SELECT *, row_number() OVER (PARTITION BY qid, property, entity ORDER BY need_ord, rule) AS k FROM s WHERE NOT EXISTS (SELECT 1 FROM needs n WHERE n.qid = s.qid AND n.property = s.property AND n.entity = s.entity)), "
    "s2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY need_ord, rule) AS place FROM s1 WHERE k = 1), l AS (SELECT qid, max(need_ord) AS last FROM needs GROUP BY qid), "
    "e AS (SELECT * FROM needs UNION ALL SELECT qid, CAST(last + place AS INTEGER), '', keywords, entity, property, 0.0::DOUBLE, form, 'NORMAL', true FROM s2 JOIN l USING (qid))"
)


@query(
    _EXPANDED + ", w(qid, rest, done) AS (SELECT qid, list({'o': need_ord, 'p': property} ORDER BY need_ord), CAST([] AS INTEGER[]) FROM e GROUP BY qid UNION ALL "
    "SELECT qid, list_filter(rest, lambda x: x.o <> pick), list_append(done, pick) FROM (SELECT *, "
    f"list_filter(rest, lambda x: len(list_filter(rest, lambda y: y.o <> x.o AND list_contains({_WAITS}, x.p || '>' || y.p))) = 0)[1].o AS pick FROM w WHERE len(rest) > 0) AS next), "
    "d AS (SELECT qid, CAST(unnest(range(len(done))) AS INTEGER) AS plan_ord, unnest(done) AS need_ord FROM w WHERE len(rest) = 0) "
    "SELECT e.* REPLACE (CASE WHEN is_support THEN scope ELSE 'STRICT' END AS scope), plan_ord FROM e JOIN d USING (qid, need_ord)"
)
def plan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(needs.planned(needs.overridden(needs.expanded(needs.analyzed(_questions(spark, sf_dir))), brief=True)))


@query(_EXPANDED + f" SELECT DISTINCT a.qid, b.need_ord AS before, a.need_ord AS after FROM e a JOIN e b ON a.qid = b.qid AND a.need_ord <> b.need_ord WHERE list_contains({_WAITS}, a.property || '>' || b.property)")
def plan_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return needs.dependencies(needs.expanded(needs.analyzed(_questions(spark, sf_dir))))


_SUPPORT = f"WITH {_BEST}, {_RULES}, n AS (SELECT conv_id, turn, property AS trigger, {_ENTITY} AS entity FROM p)"


@query(_SUPPORT + " SELECT conv_id, turn, rule, r.property, form, words || ' ' || entity AS keywords FROM n JOIN r USING (trigger)")
def self_ask_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir).select(F.struct("conv_id", "turn").alias("qid"), F.lit(0).alias("need_ord"), needs.entity("keywords", "query").alias("entity"), needs.best_property("clause")["property"].alias("property"))
    return needs.support_needs(t).select("qid.conv_id", "qid.turn", "rule", "property", "form", F.array_join("keywords", " ").alias("keywords"))


# Segments of answers ----------------------------------------------------------------------------------------------
#: A need whose words the invented prose has.
_KWS, _ENT = ["the", "erea"], "of"
_SEG = _SENT + f", seg AS (SELECT doc_id, unnest(range(len(ss))) AS o, unnest(ss) AS s FROM sen), g AS (SELECT doc_id, CAST(o AS INTEGER) AS sent_ord, s, {_low('s')} AS low, list_transform(regexp_extract_all(s, '[A-Za-z0-9]+'), lambda x: {_low('x')}) AS w FROM seg)"
_HITS = f"3.0::DOUBLE * len(list_filter({_sql_list(_KWS)}, lambda k: list_contains(w, k)))"
_HAS = f"list_contains(w, '{_ENT}')"
_SHAPE = "(CASE WHEN len(s) > 30 AND len(s) < 300 THEN 0.5 ELSE 0 END - CASE WHEN starts_with(s, '#') THEN 2 ELSE 0 END)"


def _rank_sql(score: str, where: str = "true", k: int = 30) -> str:
    return f"WITH {_SEG}, q AS (SELECT doc_id, sent_ord, round(CAST({score} AS DOUBLE), 6) AS score FROM g WHERE {where}) SELECT doc_id, sent_ord, score FROM q WHERE score > 0 ORDER BY score DESC, doc_id, sent_ord LIMIT {k}"


def _rank(spark: SparkSession, sf_dir: str, score, k: int = 30) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("sent_ord", "seg")).withColumn("tokens", T.tokens("seg"))
    out = s.select("doc_id", "sent_ord", F.round(score(F.col("seg"), F.col("tokens"), T.words_of(_KWS), F.lit(_ENT)), 6).alias("score"))
    # The best first, what is not over 0 goes then: a filter before would make each score twice.
    return out.orderBy(F.desc("score"), "doc_id", "sent_ord").limit(k).where("score > 0")


_STEMS = "list_sum(list_transform([('the', 'the'), ('erea', 'erea')], lambda k: CASE WHEN list_contains(w, k[1]) THEN 2.0 WHEN contains(low, k[2]) THEN 1.5 ELSE 0 END))"


@query(_rank_sql(f"{_STEMS} + CASE WHEN regexp_matches(low, '\\b(1[0-9]{{3}}|20[0-9]{{2}})\\b') THEN 6 ELSE 0 END + CASE WHEN {_HAS} THEN 4 ELSE 0 END + {_SHAPE}"))
def temporal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank(spark, sf_dir, synthesis.temporal_score)


@query(_rank_sql(f"{_HITS} + CASE WHEN {_HAS} THEN 4 ELSE 0 END + {_SHAPE}"))
def list_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank(spark, sf_dir, synthesis.list_score)


@query(
    _rank_sql(
        f"{_HITS} + CASE WHEN {_HAS} THEN 4 ELSE 0 END + 5 * {_sql_count('low', V.DEFINITION_SEGMENT_PATTERNS)} + CASE WHEN instr(low, '{_ENT}') BETWEEN 1 AND 30 THEN 6 + CASE WHEN contains(low, '{_ENT} is ') OR contains(low, '{_ENT} are ') THEN 8 ELSE 0 END ELSE 0 END - 3 * {_sql_count('low', V.DEFINITION_SEGMENT_PENALTIES)}",
        "len(s) >= 20 AND NOT starts_with(s, '#')",
    )
)
def definition_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank(spark, sf_dir, synthesis.definition_score)


_LOCW = f"(5 * {_sql_count('low', V.LOCATION_WORDS)} + 3 * len(list_filter({_sql_list(V.LOCATION_NOUNS)}, lambda k: list_contains(w, k))) + CASE WHEN list_contains(w, 'capital') THEN 4 ELSE 0 END)"


@query(_rank_sql(f"{_HITS} + 4 + {_LOCW} - CASE WHEN {_LOCW} = 0 THEN 5 * {_sql_count('low', V.LOCATION_PENALTIES)} ELSE 0 END + {_SHAPE}", _HAS))
def location_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank(spark, sf_dir, synthesis.location_score)


_SOME = ["tion", "the", "wher"]


@query(_rank_sql(f"{_HITS} + CASE WHEN {_HAS} THEN 4 ELSE 0 END + 2 * {_sql_count('low', _SOME)} + CASE WHEN len(s) > 60 THEN 1 ELSE 0 END", "len(s) >= 30 AND NOT starts_with(s, '#')"))
def boost_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank(spark, sf_dir, lambda s, t, k, e: synthesis.boosted_score(s, t, k, e, _SOME))


@query(_rank_sql(f"{_HITS} + {_SHAPE}"))
def general_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank(spark, sf_dir, lambda s, t, k, e: synthesis.general_score(s, t, k))


@query(_rank_sql(f"{_HITS} + CASE WHEN {_HAS} THEN 5 ELSE 0 END"))
def explanation_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank(spark, sf_dir, lambda s, t, k, e: synthesis.explanation_score(t, k, e))


# Evidence ---------------------------------------------------------------------------------------------------------
#: Evidence: every document is evidence of a need, up to 15 in a row of one; words that the invented prose has.
_DOMAIN, _NEG = ["tion", "wher", "ering", "mente", "keit", "eau"], ["not", "nicht", "sans"]
_OPP = [("tion", "wher"), ("mente", "ering")]
_EV = f"ev AS (SELECT CAST(doc_id // 15 AS BIGINT) AS need_id, doc_id, text, lang AS type, CAST(row_number() OVER (PARTITION BY doc_id // 15 ORDER BY doc_id) AS INTEGER) AS ev_ord, {_low('text')} AS low FROM documents), e15 AS (SELECT *, list_filter({_sql_list(_DOMAIN)}, lambda w: contains(low, w)) AS words, list_filter({_sql_list(_NEG)}, lambda w: contains(low, w)) AS neg FROM ev WHERE ev_ord <= 15)"
_PAIRS = (
    _EV
    + ", pr AS (SELECT a.need_id, a.ev_ord AS i, b.ev_ord AS j, CASE WHEN a.type = b.type AND (len(a.neg) > 0) = (len(b.neg) > 0) AND greatest(len(a.words), len(b.words)) > 0 THEN CAST(len(list_intersect(a.words, b.words)) AS DOUBLE) / greatest(len(a.words), len(b.words)) ELSE 0 END AS agreement, a.type = b.type AND a.doc_id <> b.doc_id AND ((len(a.neg) > 0) <> (len(b.neg) > 0) OR "
    + " OR ".join(f"(list_contains(a.words, '{x}') AND list_contains(b.words, '{y}')) OR (list_contains(a.words, '{y}') AND list_contains(b.words, '{x}'))" for x, y in _OPP)
    + ") AS contradicts FROM e15 a JOIN e15 b ON a.need_id = b.need_id AND a.ev_ord < b.ev_ord)"
)


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 15").alias("need_id"), "doc_id", "text", F.col("lang").alias("type"))
    e = d.withColumn("ev_ord", F.row_number().over(Window.partitionBy("need_id").orderBy("doc_id"))).where("ev_ord <= 15")
    return e.withColumn("keywords", T.words_of(_KW5)).withColumn("score", F.col("ev_ord") / 20.0)


_KW5 = ["the", "ering", "und", "the", "zzz"]


def _claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.claims(_evidence(spark, sf_dir), _DOMAIN, _NEG)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = evidence.met_pairs(_claimed(spark, sf_dir))
    return met.select("need_id", F.col("a.ev_ord").alias("i"), F.col("b.ev_ord").alias("j"), F.round(evidence.agreement(), 6).alias("agreement"), evidence.contradiction(opposites=_OPP).alias("contradicts"))


@query(f"WITH {_EV} SELECT doc_id, array_to_string(words, ',') AS words, array_to_string(neg, ',') AS negations FROM e15")
def claim_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claimed(spark, sf_dir).select("doc_id", F.array_join("words", ",").alias("words"), F.array_join("negations", ",").alias("negations"))


@query(f"WITH {_PAIRS} SELECT need_id, i, j, round(agreement, 6) AS agreement FROM pr WHERE agreement > 0")
def agree_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).where("agreement > 0").drop("contradicts")


@query(f"WITH {_PAIRS} SELECT need_id, i, j FROM pr WHERE contradicts")
def contradict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).where("contradicts").select("need_id", "i", "j")


_DEFAULT_PAIRS = _PAIRS.replace(_sql_list(_DOMAIN), _sql_list(V.DOMAINS)).replace(_sql_list(_NEG), _sql_list(V.NEGATIONS))
for _x, _y in _OPP:
    _DEFAULT_PAIRS = _DEFAULT_PAIRS.replace(f"(list_contains(a.words, '{_x}') AND list_contains(b.words, '{_y}')) OR (list_contains(a.words, '{_y}') AND list_contains(b.words, '{_x}'))", "OPPOSED", 1)
_DEFAULT_PAIRS = _DEFAULT_PAIRS.replace("OPPOSED OR OPPOSED", " OR ".join(f"(list_contains(a.words, '{x}') AND list_contains(b.words, '{y}')) OR (list_contains(a.words, '{y}') AND list_contains(b.words, '{x}'))" for x, y in V.OPPOSITES))
_ANALYSIS = _DEFAULT_PAIRS + ", an AS (SELECT need_id, avg(agreement) FILTER (WHERE NOT contradicts AND agreement > 0) AS mean, count(*) FILTER (WHERE NOT contradicts AND agreement > 0) AS agreement_pairs, count(*) FILTER (WHERE contradicts) AS contradiction_pairs FROM pr GROUP BY need_id), n AS (SELECT need_id, count(*) AS n_evidence FROM e15 GROUP BY need_id), al AS (SELECT need_id, n_evidence, coalesce(mean, 0.5) AS agreement, coalesce(agreement_pairs, 0) AS agreement_pairs, coalesce(contradiction_pairs, 0) AS contradiction_pairs, least(0.4::DOUBLE, coalesce(contradiction_pairs, 0) * 0.15::DOUBLE) AS penalty FROM n LEFT JOIN an USING (need_id))"


@query(f"WITH {_ANALYSIS} SELECT need_id, n_evidence, round(agreement, 6) AS agreement, agreement_pairs, contradiction_pairs, round(penalty, 6) AS penalty FROM al")
def agreement_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.analysis(_evidence(spark, sf_dir)).withColumn("agreement", F.round("agreement", 6)).withColumn("penalty", F.round("penalty", 6))


_COVER = f", cv AS (SELECT need_id, CAST(count(DISTINCT k) FILTER (WHERE HIT) AS DOUBLE) / {len(_KW5)} AS coverage FROM (SELECT need_id, low, text, unnest({_sql_list(_KW5)}) AS k FROM e15) GROUP BY need_id)"
_WORDHIT = f"list_contains(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: {_low('x')}), k)"


@query(f"WITH {_EV}{_COVER.replace('HIT', _WORDHIT)}, m AS (SELECT need_id, count(*) AS n, avg(ev_ord / 20.0::DOUBLE) AS mean FROM e15 GROUP BY need_id) SELECT need_id, round(0.4::DOUBLE * coverage + 0.3::DOUBLE * least(1, mean) + 0.3::DOUBLE * least(1, n / 3.0::DOUBLE), 6) AS confidence FROM cv JOIN m USING (need_id)")
def confidence_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evidence(spark, sf_dir)
    m = e.groupBy("need_id").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    return evidence.coverage(e, whole_words=True).join(m, "need_id").select("need_id", F.round(evidence.basic_confidence(F.col("coverage"), F.col("mean"), F.col("n")), 6).alias("confidence"))


@query(f"WITH {_ANALYSIS}{_COVER.replace('HIT', 'contains(low, k)')} SELECT need_id, round(greatest(0, least(1, 0.3::DOUBLE * coverage + 0.2::DOUBLE * least(1, n_evidence / 3.0::DOUBLE) + 0.3::DOUBLE * agreement + 0.2::DOUBLE * (1 - penalty))), 6) AS confidence FROM al JOIN cv USING (need_id)")
def confidence_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evidence(spark, sf_dir)
    met = evidence.analysis(e).join(evidence.coverage(e), "need_id")
    return met.select("need_id", F.round(evidence.refined_confidence(F.col("coverage"), F.col("n_evidence"), F.col("agreement"), F.col("penalty")), 6).alias("confidence"))


@query(f"WITH {_EV} SELECT need_id, array_to_string(list(doc_id ORDER BY ev_ord), ',') AS sources FROM e15 GROUP BY need_id")
def source_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.sources(_evidence(spark, sf_dir)).select("need_id", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {_EV}, s(need_id, k) AS (SELECT need_id, unnest(['the', 'zzz', 'Ering']) FROM (SELECT DISTINCT need_id FROM e15)), a AS (SELECT need_id, string_agg(' ' || low, '' ORDER BY ev_ord) AS t FROM e15 GROUP BY need_id) SELECT need_id, round(avg(CASE WHEN contains(t, {_low('k')}) THEN 1.0 ELSE 0 END), 6) AS support_coverage, count(*) AS n_support FROM s JOIN a USING (need_id) GROUP BY need_id")
def support_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evidence(spark, sf_dir)
    s = e.select("need_id").distinct().withColumn("keywords", T.words_of(["the", "zzz", "Ering"]))
    return evidence.support_coverage(s, e, ["need_id"]).withColumn("support_coverage", F.round("support_coverage", 6))


# Finishing --------------------------------------------------------------------------------------------------------
_SHARES = "CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN CAST({_sql_count('low', V.VALIDATION[p])} AS DOUBLE) / {len(V.VALIDATION[p])}" for k, p in enumerate(V.VALIDATION)) + " END"


@query(
    f"WITH a AS (SELECT doc_id, text, {_low('text')} AS low, 0.8::DOUBLE AS c FROM documents), s AS (SELECT *, {_SHARES} AS share FROM a), v AS (SELECT doc_id, CASE WHEN len(text) = 0 OR contains(text, 'not found') THEN false WHEN share <= 0 THEN false ELSE true END AS ok, CASE WHEN len(text) = 0 OR contains(text, 'not found') THEN least(c, 0.1::DOUBLE) WHEN share <= 0 THEN c * 0.3::DOUBLE WHEN share < 0.15 THEN c * 0.7::DOUBLE ELSE c END AS confidence FROM s) SELECT doc_id, ok, round(confidence, 6) AS confidence FROM v"
)
def validate_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    prop = F.get(T.words_of([*V.VALIDATION, "GENERAL"]), (F.col("doc_id") % 10).cast("int"))
    d = table(spark, sf_dir, "documents").withColumn("v", evidence.validated(F.col("text"), prop, F.lit(0.8)))
    return d.select("doc_id", F.col("v.validated").alias("ok"), F.round("v.confidence", 6).alias("confidence"))


_GRID = "g AS (SELECT doc_id, (doc_id % 21) / 20.0::DOUBLE AS c, (doc_id % 11) / 10.0::DOUBLE AS a, doc_id % 6 AS n, ['STRICT', 'NORMAL', 'EXPANDED'][doc_id % 3 + 1] AS scope, text FROM documents)"
_LEVEL = "CASE WHEN c < 0.6 OR a < 0.6 OR scope = 'STRICT' THEN 'NONE' WHEN n >= 4 AND c >= 0.9 THEN 'STRONG' WHEN scope = 'NORMAL' AND c >= 0.85 AND a >= 0.7 THEN 'STRONG' WHEN scope = 'EXPANDED' AND c >= 0.85 AND a >= 0.7 THEN 'LIGHT' ELSE 'NONE' END"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select("doc_id", ((i % 21) / 20.0).alias("c"), ((i % 11) / 10.0).alias("a"), (i % 6).alias("n"), F.get(T.words_of(["STRICT", "NORMAL", "EXPANDED"]), (i % 3).cast("int")).alias("scope"), "text")


@query(f"WITH {_GRID} SELECT doc_id, {_LEVEL} AS level FROM g")
def compress_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("doc_id", evidence.compression(F.col("scope"), F.col("c"), F.col("a"), F.col("n")).alias("level"))


@query(
    rf"WITH {_GRID}, l AS (SELECT doc_id, text, {_LEVEL} AS level, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])([ \n])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^[ \n]+', '')), lambda s: len(s) > 10) AS ss FROM g) SELECT doc_id, md5(CASE WHEN level = 'STRONG' AND len(ss) > 0 THEN ss[1] WHEN level = 'LIGHT' AND len(ss) > 2 THEN ss[1] || ' ' || ss[2] ELSE text END) AS text_md5 FROM l"
)
def compress_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grid(spark, sf_dir)
    level = evidence.compression(F.col("scope"), F.col("c"), F.col("a"), F.col("n"))
    return g.withColumn("level", level).select("doc_id", F.md5(evidence.compressed("text", F.col("level")).cast("binary")).alias("text_md5"))


@query(f"WITH {_GRID} SELECT doc_id, CASE WHEN c > 0.85 AND scope = 'NORMAL' THEN 'STRICT' WHEN c < 0.5 AND scope = 'STRICT' THEN 'NORMAL' ELSE scope END AS scope, CASE scope WHEN 'STRICT' THEN 200 WHEN 'EXPANDED' THEN 700 ELSE 400 END AS most_chars, CASE scope WHEN 'STRICT' THEN 2 WHEN 'EXPANDED' THEN 8 ELSE 4 END AS most_segments FROM g")
def scope_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("scope")
    return _grid(spark, sf_dir).select("doc_id", evidence.adjusted_scope(s, F.col("c")).alias("scope"), evidence.most_chars(s).alias("most_chars"), evidence.most_segments(s).alias("most_segments"))


@query("WITH t AS (SELECT doc_id, text, substr(text, 1, 201) AS head FROM documents), c AS (SELECT doc_id, text, head, CASE WHEN contains(head, '.') THEN len(head) - instr(reverse(head), '.') ELSE -1 END AS cut FROM t) SELECT doc_id, md5(CASE WHEN len(text) <= 200 THEN text WHEN cut > 100 THEN substr(text, 1, cut + 1) ELSE substr(text, 1, 200) END) AS text_md5 FROM c")
def trunc_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.truncated("text", 200).cast("binary")).alias("text_md5"))


@query("SELECT count(*) AS n, list_sort(list(n_chars))[count(*) // 2 + 1] AS p50, list_sort(list(n_chars))[CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95, round(avg(n_chars), 6) AS mean, max(n_chars) AS max FROM documents")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.latency_stats(table(spark, sf_dir, "documents"), "n_chars").withColumn("mean", F.round("mean", 6))


# Training data ----------------------------------------------------------------------------------------------------
@query(f"WITH {_TOK}, s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 5, 0) + 1, 5)) AS start FROM tok WHERE len(w) >= 10) SELECT doc_id, CAST(start AS INTEGER) AS start, array_to_string(w[start + 1:start + 5], ' ') AS query, array_to_string(w[start + 1:start + 15], ' ') AS passage FROM s")
def encoder_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.encoder_pairs(table(spark, sf_dir, "documents"))


_NAMES = r"list_sort(list_distinct(list_concat(regexp_extract_all(text, '\b[A-Z][a-z]+(?:[ \t\n\x0B\f\r]+[A-Z][a-z]+)*\b'), regexp_extract_all(text, '\b[A-Z]{2,}\b'))))"
_TEMPLATES = "t(a, b, intent, answer_type) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{i}', '{k}')" for a, b, i, k in V.TEMPLATES) + ")"
_ASKED_OF = f"WITH n AS (SELECT doc_id, {_NAMES} AS ns FROM documents), {_TEMPLATES}, e AS (SELECT doc_id, unnest(list_filter(ns, lambda x: len(x) BETWEEN 3 AND 40)[1:20]) AS entity FROM n), q AS (SELECT doc_id, entity, concat_ws(' ', a, entity, nullif(b, '')) AS question, intent, answer_type FROM e CROSS JOIN t)"


@query(_ASKED_OF + " SELECT * FROM q")
def template_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.template_questions(table(spark, sf_dir, "documents"))


@query(
    _ASKED_OF + f", w AS (SELECT doc_id, entity, question, regexp_extract_all({_low('question')}, '[a-z0-9]+') AS w, regexp_extract_all({_low('entity')}, '[a-z0-9]+') AS ew FROM q), "
    "m AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: w[i:i + len(ew) - 1] = ew)[1] AS place FROM w) "
    "SELECT doc_id, entity, question, array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i = place THEN 1 WHEN i > place AND i < place + len(ew) THEN 2 ELSE 0 END), ' ') AS tags FROM m"
)
def bio_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.bio_tags(training.template_questions(table(spark, sf_dir, "documents"))).select("doc_id", "entity", "question", F.array_join("tags", " ").alias("tags"))


@query(f"SELECT item_id AS doc_id, array_to_string({_NAMES}, '|') AS names FROM benchmark")
def entity_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.array_join(T.names("text"), "|").alias("names"))


# All together -----------------------------------------------------------------------------------------------------
@query()
def ask_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions over all documents: each benchmark passage is asked for by its own words."""
    b = table(spark, sf_dir, "benchmark")
    q = b.select(F.col("item_id").alias("qid"), F.concat(F.lit("what is "), "text").alias("query"))
    return pipeline.ask(open_index(spark, sf_dir), q)


@query()
def ask_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _questions(spark, sf_dir).withColumn("query", F.replace("query", F.lit("SQL"), F.lit("thtion")))
    return pipeline.as_json(pipeline.ask(open_index(spark, sf_dir), q))
