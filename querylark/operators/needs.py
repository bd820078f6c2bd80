"""Query understanding: clauses, keywords, entity, property, form and scope of each information need; planning.

All as column expressions over queries(qid, query), so a batch of any size is one plan. Only the order of needs within
a query, which follows dependencies step by step, is a function on the (few) properties of a query.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from querylark.functions import text as T
from querylark.functions import vocabulary as V

#: Columns of needs, in their order.
COLUMNS = ["qid", "need_ord", "clause", "keywords", "entity", "property", "property_score", "form", "scope", "is_support"]


def clauses(query: Column | str) -> Column:
    """Folded clauses: cut at ; and ?, and at " and " where a word that begins a question is in the rest."""
    low = T.fold(query)
    cut = "[;?]| and (?=(?s:.*)(?:" + "|".join(V.CLAUSE_TRIGGERS) + "))"
    parts = F.filter(F.transform(F.split(low, cut), lambda p: F.regexp_replace(p, r"^[ \t]+", "")), lambda p: F.length(p) > 0)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(low))


def entity(kws: Column | str, query: Column | str) -> Column:
    """The first keyword in capitals where the query first has it, else the longest one; "" without any. Words that
    only describe are none."""
    k, q = T.col(kws), T.col(query)
    own = F.filter(k, lambda w: ~F.array_contains(T.words_of(V.NO_ENTITIES), w))
    capital = F.filter(own, lambda w: (F.length(w) >= 2) & F.rlike(F.substring(q, F.position(w, T.fold(q)), F.length(w)), F.lit("^[A-Z]+$")))
    numbered = F.transform(own, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w")))
    return F.coalesce(F.get(capital, F.lit(0)), F.array_max(numbered)["w"], F.lit(""))


def property_scores(clause: Column | str, signals: dict[str, list[str]] = V.QUERY_SIGNALS, weights: dict[str, float] = V.WEIGHTS) -> Column:
    """Array of (score, -rank, property), one for each property in order."""
    return F.array(*[F.struct((T.count_contained(clause, signals[p]) * F.lit(weights[p])).alias("score"), F.lit(-k).alias("rank"), F.lit(p).alias("property")) for k, p in enumerate(signals)])


def best_property(clause: Column | str, **options: dict) -> Column:
    """(property, score): the highest score, ties to the earlier property; GENERAL without any signal."""
    best = F.array_max(property_scores(clause, **options))
    return F.struct(F.when(best["score"] > 0, best["property"]).otherwise("GENERAL").alias("property"), best["score"].alias("score"))


def _mapped(c: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def form(clause: Column | str, prop: Column) -> Column:
    hinted = F.when(T.contains_any(clause, V.EXPLANATION_HINTS), "EXPLANATION").when(T.contains_any(clause, V.SUMMARY_HINTS), "SUMMARY").otherwise("SHORT_FACT")
    return F.coalesce(_mapped(prop, V.DEFAULT_FORM), hinted)


def default_scope(prop: Column) -> Column:
    return F.when(prop.isin("LOCATION", "DEFINITION", "TIME"), "STRICT").when(prop.isin("HISTORY", "COMPARISON"), "EXPANDED").otherwise("NORMAL")


def scope(clause: Column | str, prop: Column) -> Column:
    return F.when(T.contains_any(clause, V.STRICT_HINTS), "STRICT").when(T.contains_any(clause, V.EXPANDED_HINTS), "EXPANDED").otherwise(default_scope(prop))


def analyzed(queries: DataFrame) -> DataFrame:
    """Needs of queries(qid, query, ...). A clause without an entity takes that of the clause before, in front of its keywords."""
    split = queries.select("qid", "query", F.posexplode(clauses("query")).alias("need_ord", "clause"))
    found = split.withColumn("keywords", T.keywords("clause", V.STOP_WORDS)).withColumn("own", entity("keywords", "query")).withColumn("best", best_property("clause"))
    before = Window.partitionBy("qid").orderBy("need_ord").rowsBetween(Window.unboundedPreceding, 0)
    shared = F.coalesce(F.last(F.when(F.col("own") != "", F.col("own")), ignorenulls=True).over(before), F.lit(""))
    named = found.withColumn("entity", shared)
    missing = (F.col("own") == "") & (F.col("entity") != "") & ~F.array_contains("keywords", F.col("entity"))
    kws = F.when(missing, F.concat(F.array("entity"), F.col("keywords"))).otherwise(F.col("keywords"))
    prop = F.col("best.property")
    return named.select("qid", "need_ord", "clause", kws.alias("keywords"), "entity", prop.alias("property"), F.col("best.score").alias("property_score"), form("clause", prop).alias("form"), scope("clause", prop).alias("scope"), F.lit(False).alias("is_support"))


def of_answer_type(answer_type: Column) -> Column:
    """(property, form, scope) for the answer type that a classifier gives a question."""
    prop = F.coalesce(_mapped(answer_type, {k: p for k, (p, _) in V.ANSWER_TYPES.items()}), F.lit("GENERAL"))
    shape = F.coalesce(_mapped(answer_type, {k: f for k, (_, f) in V.ANSWER_TYPES.items()}), F.lit("SUMMARY"))
    return F.struct(prop.alias("property"), shape.alias("form"), default_scope(prop).alias("scope"))


def answer_type(prop: Column, shape: Column) -> Column:
    """(answer_type, intent) of a need."""
    return F.struct(F.coalesce(_mapped(prop, V.TYPE_OF_PROPERTY), F.lit("SUMMARY")).alias("answer_type"), F.coalesce(_mapped(shape, V.INTENT_OF_FORM), F.lit("GENERAL")).alias("intent"))


#: What a setting query.analyzer may name; without a trained classifier, auto is rule.
ANALYZERS = {"rule": analyzed, "auto": analyzed}


def remembered(needs: DataFrame, memory: DataFrame) -> DataFrame:
    """Needs without an entity take that of memory(qid, last_entity), behind their keywords."""
    met = needs.join(memory.select("qid", "last_entity"), "qid", "left")
    takes = (F.col("entity") == "") & (F.coalesce("last_entity", F.lit("")) != "")
    return met.select(*[F.when(takes, F.concat("keywords", F.array("last_entity"))).otherwise(F.col(c)).alias(c) if c == "keywords" else F.when(takes, F.col("last_entity")).otherwise(F.col(c)).alias(c) if c == "entity" else F.col(c) for c in COLUMNS])


def rules() -> Column:
    return F.array(*[F.struct(F.lit(a).alias("trigger"), F.lit(k).alias("rule"), F.lit(b).alias("property"), F.lit(f).alias("form"), T.words_of(w).alias("words")) for k, (a, b, f, w) in enumerate(V.SELF_ASK)])


def support_needs(needs: DataFrame) -> DataFrame:
    """(qid, need_ord, rule, property, form, entity, keywords): what each need asks itself."""
    asked = needs.select("qid", "need_ord", "entity", F.col("property").alias("trigger"), F.explode(rules()).alias("r")).where("r.trigger = trigger")
    return asked.select("qid", "need_ord", F.col("r.rule").alias("rule"), F.col("r.property").alias("property"), F.col("r.form").alias("form"), "entity", F.concat("r.words", F.array("entity")).alias("keywords"))


def expanded(needs: DataFrame) -> DataFrame:
    """Needs with their support needs behind them, each (property, entity) of a query once."""
    more = support_needs(needs).join(needs.select("qid", "property", "entity"), ["qid", "property", "entity"], "left_anti")
    first = Window.partitionBy("qid", "property", "entity").orderBy("need_ord", "rule")
    once = more.withColumn("k", F.row_number().over(first)).where("k = 1")
    last = needs.groupBy("qid").agg(F.max("need_ord").alias("last"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("need_ord", "rule"))
    added = once.withColumn("place", place).join(last, "qid").select("qid", (F.col("last") + F.col("place")).cast("int").alias("need_ord"), F.lit("").alias("clause"), "keywords", "entity", "property", F.lit(0.0).alias("property_score"), "form", F.lit("NORMAL").alias("scope"), F.lit(True).alias("is_support"))
    return needs.select(*COLUMNS).unionByName(added.select(*COLUMNS))


def overridden(needs: DataFrame, brief: bool = False, detailed: bool = False) -> DataFrame:
    """Scopes forced from outside, but for support needs; brief goes before detailed."""
    if not (brief or detailed):
        return needs
    return needs.withColumn("scope", F.when(F.col("is_support"), F.col("scope")).otherwise("STRICT" if brief else "EXPANDED"))


def plan_order(properties: list[str], depends: dict[str, list[str]] = V.DEPENDENCIES) -> list[int]:
    """Places in which needs are answered: always the first one that waits for nothing; what is left of a cycle comes last."""
    left = list(range(len(properties)))
    out: list[int] = []
    while left:
        ready = next((i for i in left if not any(j != i and properties[j] in depends.get(properties[i], ()) for j in left)), None)
        if ready is None:
            return out + left
        out.append(ready)
        left.remove(ready)
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def _planned(properties: pd.Series) -> pd.Series:
    return properties.map(lambda p: plan_order(list(p)))


def planned(needs: DataFrame) -> DataFrame:
    """Needs with plan_ord, their place in the order of answering."""
    listed = needs.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("need_ord", "property"))).alias("ns"))
    order = listed.select("qid", "ns", _planned(F.col("ns.property")).alias("o")).select("qid", F.posexplode("o").alias("plan_ord", "i"), "ns")
    return needs.join(order.select("qid", "plan_ord", F.get(F.col("ns"), F.col("i"))["need_ord"].alias("need_ord")), ["qid", "need_ord"])


def dependencies(needs: DataFrame) -> DataFrame:
    """(qid, before, after): needs that another one of the query waits for."""
    pairs = F.array(*[F.struct(F.lit(a).alias("after"), F.lit(b).alias("before")) for a, bs in V.DEPENDENCIES.items() for b in bs])
    waits = needs.select("qid", F.col("need_ord").alias("after"), F.explode(F.filter(pairs, lambda p: p["after"] == F.col("property"))).alias("p"))
    met = waits.join(needs.select("qid", F.col("need_ord").alias("before"), F.col("property").alias("bp")), "qid").where("p.before = bp AND before <> after")
    return met.select("qid", "before", "after").distinct()
