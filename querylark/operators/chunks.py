"""Passages: paragraphs of documents, their types, and the choice of passages for a need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylark.functions import text as T
from querylark.functions import vocabulary as V

LEAST, PER_DOC, EVIDENCE = 10, 8, 15
KEYWORD, PRIMARY, SECONDARY, PREFERRED = 3.0, 10.0, 6.0, 1.0


def chunk_type(c: Column | str, signals: dict[str, list[str]] = V.CHUNK_SIGNALS, capital: list[str] = V.CAPITAL_WORDS, context: list[str] = V.CAPITAL_CONTEXT) -> Column:
    """The first type with a signal in the folded text; a capital with a place beside it is LOCATION, too; else GENERAL."""
    low = T.fold(c)
    out = None
    for t in signals:
        found = T.contains_any(low, signals[t])
        if t == "LOCATION":
            found = found | (T.contains_any(low, capital) & T.contains_any(low, context))
        out = F.when(found, t) if out is None else out.when(found, t)
    return out.otherwise("GENERAL")


def chunks(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, chunk_id, text, type); chunk_id counts all paragraphs, short ones are left out."""
    cut = docs.select("doc_id", F.posexplode(T.paragraphs("text")).alias("chunk_id", "text")).where(F.length("text") >= least)
    return cut.withColumn("type", chunk_type("text"))


def preferred(prop: Column) -> Column:
    out = F.array().cast("array<string>")
    for p, types in V.PREFERRED_TYPES.items():
        out = F.when(prop == p, T.words_of(types)).otherwise(out)
    return out


def primary(prop: Column) -> Column:
    out = F.lit(None).cast("string")
    for p, t in V.PRIMARY_TYPE.items():
        out = F.when(prop == p, t).otherwise(out)
    return out


def score(prop: Column, type_: Column, token_array: Column, kws: Column, boosts: tuple[float, float, float, float] = (KEYWORD, PRIMARY, SECONDARY, PREFERRED)) -> Column:
    """3 for each keyword in the passage; and for its type: 10, if it is the property's own, 6 for a LOCATION where a
    definition is asked for, 1 for another preferred one."""
    keyword, own, place, other = boosts
    by_type = F.when(type_ == primary(prop), own).when((prop == "DEFINITION") & (type_ == "LOCATION"), place).when(F.array_contains(preferred(prop), type_), other).otherwise(0.0)
    return T.hits(token_array, kws) * keyword + by_type


def ends_open(c: Column | str) -> Column:
    """Whether the last character that isn't white space is a colon."""
    return F.rlike(T.col(c), F.lit(r":[ \t\r\n]*\z"))


def selected(pieces: DataFrame, per_doc: int = PER_DOC, keys: tuple[str, ...] = ("need_id",), boosts: tuple[float, float, float, float] = (KEYWORD, PRIMARY, SECONDARY, PREFERRED)) -> DataFrame:
    """The best passages of each document for each need, with sel_ord from 1, and passages that go on from them.

    pieces: (keys, doc_id, chunk_id, text, type, property, keywords). Where a chosen one ends in a colon, the next
    passage follows behind all chosen ones.
    """
    by = Window.partitionBy(*keys, "doc_id")
    s = pieces.withColumn("tokens", T.tokens("text")).withColumn("chunk_score", score(F.col("property"), F.col("type"), F.col("tokens"), F.col("keywords"), boosts)).withColumn("open", ends_open("text")).drop("tokens")
    ranked = s.withColumn("sel_ord", F.row_number().over(by.orderBy(F.desc("chunk_score"), "chunk_id"))).withColumn("chosen", F.col("sel_ord") <= per_doc)
    goes_on = F.lag(F.col("chosen") & F.col("open"), 1, False).over(by.orderBy("chunk_id"))
    kept = ranked.withColumn("goes_on", goes_on).where("chosen OR goes_on")
    behind = F.when(F.col("chosen"), F.col("sel_ord")).otherwise(F.lit(per_doc) + F.col("chunk_id") + 1)
    return kept.withColumn("sel_ord", F.row_number().over(by.orderBy(behind))).drop("chosen", "goes_on", "open")


def merged(chosen: DataFrame, pieces: DataFrame, keys: tuple[str, ...] = ("need_id",)) -> DataFrame:
    """Chosen passages that end in a colon with the text of the passage numbered next, if there is one."""
    nxt = pieces.select(*keys, "doc_id", (F.col("chunk_id") - 1).alias("chunk_id"), F.col("text").alias("next")).distinct()
    met = chosen.join(nxt, [*keys, "doc_id", "chunk_id"], "left")
    return met.withColumn("text", F.when(ends_open("text") & F.col("next").isNotNull(), F.concat("text", F.lit("\n"), "next")).otherwise(F.col("text"))).drop("next")


def capped(chosen: DataFrame, most: int = EVIDENCE, keys: tuple[str, ...] = ("need_id",)) -> DataFrame:
    """Evidence: by document rank (rk), then order of choice; the first `most` of each need, with ev_ord from 1."""
    by = Window.partitionBy(*keys).orderBy("rk", "doc_id", "sel_ord")
    return chosen.withColumn("ev_ord", F.row_number().over(by)).where(F.col("ev_ord") <= most)
