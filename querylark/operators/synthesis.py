"""Answers from evidence: for each property, the passage or the segments that score best, within a length.

Every way to answer is a row of settings; all needs of a batch go through one plan. A need may be answered by one
passage of the right type that is about the entity; where there is none, by scored segments of the evidence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylark.functions import text as T
from querylark.functions import vocabulary as V

from .chunks import preferred


@dataclass(frozen=True)
class Route:
    """How segments are chosen: the best `top` of all (or of each evidence), while the text before is within `most` characters."""

    top: int
    most: int
    missing: str
    each: bool = False  # ranks within each evidence; the length is looked at between evidences
    spaced: bool = True  # blanks between segments count


ROUTES = {
    "LOCATION": Route(3, 300, "Location information not found."),
    "DEFINITION": Route(4, 500, "No definition found."),
    "TIME": Route(3, 300, "Temporal information not found.", each=True),
    "ADVANTAGES": Route(6, 600, "No advantages information found.", spaced=False),
    "LIMITATIONS": Route(6, 600, "No limitations information found.", spaced=False),
    "USAGE": Route(6, 600, "No usage information found.", spaced=False),
    "HISTORY": Route(4, 500, "No history information found.", spaced=False),
    "COMPARISON": Route(6, 600, "No comparison information found.", spaced=False),
    "EXPLANATION": Route(1 << 30, 1500, "No relevant explanation found."),
    "LIST": Route(6, 600, "No relevant information found."),
    "GENERAL": Route(2, 600, "No relevant information found.", each=True),
}
NO_EVIDENCE = "No relevant information found."
#: Properties with a way of their own; the others go by form.
_OWN = ["LOCATION", "DEFINITION", "TIME", "ADVANTAGES", "LIMITATIONS", "USAGE", "HISTORY", "COMPARISON"]


def route(prop: Column, form: Column) -> Column:
    by_form = F.when(form == "EXPLANATION", "EXPLANATION").when(form == "LIST", "LIST").when(form == "SHORT_FACT", "LOCATION").otherwise("GENERAL")
    return F.when(prop.isin(_OWN), prop).otherwise(by_form)


def _setting(r: Column, name: str) -> Column:
    out = None
    for k, v in ROUTES.items():
        out = F.when(r == k, F.lit(getattr(v, name))) if out is None else out.when(r == k, F.lit(getattr(v, name)))
    return out


def _about(low: Column, entity: Column, within: int) -> Column:
    """No entity, or it begins within the first characters."""
    return (entity == "") | (F.coalesce(T.offset(low, entity), F.lit(1 << 30)) <= within)


def passage_score(r: Column, type_: Column, text: Column, entity: Column) -> Column:
    """Score of a passage as the whole answer; null where it can't be."""
    low, n = T.fold(text), F.length(text)
    is_at = F.coalesce(T.offset(low, F.concat(entity, F.lit(" is "))), F.lit(1 << 30)) < 50
    definition = F.when((entity != "") & is_at, 10.0).otherwise(0.0) + T.count_contained(low, V.DEFINITION_PATTERNS) * 3.0 - T.count_contained(low, V.DEFINITION_PENALTIES) * 4.0
    history = T.count_contained(low, V.HISTORY_SIGNALS).cast("double")
    return (
        F.when((r == "LOCATION") & (type_ == "LOCATION") & (n > 50) & _about(low, entity, 100), T.count_contained(low, V.LOCATION_COMPARE).cast("double"))
        .when((r == "DEFINITION") & type_.isin("DEFINITION", "LOCATION") & (n >= 30) & _about(low, entity, 30) & (definition > 5), definition)
        .when((r == "ADVANTAGES") & (type_ == "ADVANTAGES") & (n > 50) & _about(low, entity, 50), 0.0)
        .when((r == "LIMITATIONS") & (type_ == "LIMITATIONS") & (n > 50), 0.0)
        .when((r == "USAGE") & (type_ == "USAGE") & (n > 50), 0.0)
        .when((r == "HISTORY") & (type_ == "HISTORY") & (n > 50) & _about(low, entity, 200) & (history >= 1), history)
    )


def _shape(seg: Column) -> Column:
    """A little for a usual length, less for headings."""
    n = F.length(seg)
    return F.when((n > 30) & (n < 300), 0.5).otherwise(0.0) - F.when(seg.startswith("#"), 2.0).otherwise(0.0)


def location_score(seg: Column, tokens: Column, kws: Column, entity: Column) -> Column:
    low = T.fold(seg)
    words = T.count_contained(low, V.LOCATION_WORDS) * 5.0 + T.hits(tokens, T.words_of(V.LOCATION_NOUNS)) * 3.0 + F.when(F.array_contains(tokens, "capital") & (entity != ""), 4.0).otherwise(0.0)
    other = F.when(words == 0, T.count_contained(low, V.LOCATION_PENALTIES) * 5.0).otherwise(0.0)
    s = T.hits(tokens, kws) * 3.0 + F.when(entity != "", 4.0).otherwise(0.0) + words - other + _shape(seg)
    return F.when((entity == "") | F.array_contains(tokens, entity), s)


def definition_score(seg: Column, tokens: Column, kws: Column, entity: Column) -> Column:
    low = T.fold(seg)
    known = entity != ""
    subject = known & (F.coalesce(T.offset(low, entity), F.lit(1 << 30)) < 30)
    verb = low.contains(F.concat(entity, F.lit(" is "))) | low.contains(F.concat(entity, F.lit(" are ")))
    s = (
        T.hits(tokens, kws) * 3.0
        + F.when(known & F.array_contains(tokens, entity), 4.0).otherwise(0.0)
        + T.count_contained(low, V.DEFINITION_SEGMENT_PATTERNS) * 5.0
        + F.when(subject, 6.0).otherwise(0.0)
        + F.when(subject & verb, 8.0).otherwise(0.0)
        - T.count_contained(low, V.DEFINITION_SEGMENT_PENALTIES) * 3.0
    )
    return F.when((F.length(seg) >= 20) & ~seg.startswith("#"), s)


def temporal_score(seg: Column, tokens: Column, kws: Column, entity: Column) -> Column:
    low = T.fold(seg)
    by_word = T.let(low, lambda t: F.aggregate(kws, F.lit(0.0), lambda s, k: s + F.when(F.array_contains(tokens, k), 2.0).when(F.contains(t, T.stem(k)), 1.5).otherwise(0.0)))
    return by_word + F.when(T.has_year(low), 6.0).otherwise(0.0) + F.when((entity != "") & F.array_contains(tokens, entity), 4.0).otherwise(0.0) + _shape(seg)


def list_score(seg: Column, tokens: Column, kws: Column, entity: Column) -> Column:
    return T.hits(tokens, kws) * 3.0 + F.when((entity != "") & F.array_contains(tokens, entity), 4.0).otherwise(0.0) + _shape(seg)


def general_score(seg: Column, tokens: Column, kws: Column) -> Column:
    return T.hits(tokens, kws) * 3.0 + _shape(seg)


def explanation_score(tokens: Column, kws: Column, entity: Column) -> Column:
    return T.hits(tokens, kws) * 3.0 + F.when((entity != "") & F.array_contains(tokens, entity), 5.0).otherwise(0.0)


def boosted_score(seg: Column, tokens: Column, kws: Column, entity: Column, boosts: list[str]) -> Column:
    s = T.hits(tokens, kws) * 3.0 + F.when((entity != "") & F.array_contains(tokens, entity), 4.0).otherwise(0.0) + T.count_contained(T.fold(seg), boosts) * 2.0 + F.when(F.length(seg) > 60, 1.0).otherwise(0.0)
    return F.when(~seg.startswith("#") & (F.length(seg) >= 30), s)


def segment_score(r: Column, seg: Column, tokens: Column, kws: Column, entity: Column) -> Column:
    """Score of a segment on its need's route; only what is over 0 counts."""
    out = (
        F.when(r == "LOCATION", location_score(seg, tokens, kws, entity))
        .when(r == "DEFINITION", definition_score(seg, tokens, kws, entity))
        .when(r == "TIME", temporal_score(seg, tokens, kws, entity))
        .when(r == "LIST", list_score(seg, tokens, kws, entity))
        .when(r == "EXPLANATION", explanation_score(tokens, kws, entity))
        .when(r == "GENERAL", general_score(seg, tokens, kws))
    )
    for p, words in V.BOOSTS.items():
        out = out.when(r == p, boosted_score(seg, tokens, kws, entity, words))
    return out


def typed(evidence: DataFrame, key: str = "need_id") -> DataFrame:
    """Evidence of the types that the route prefers, or all where there is none of these. Other routes take all."""
    r = F.col("route")
    wanted = F.when(r == "TIME", T.words_of(V.PREFERRED_TYPES["TIME"])).when(r == "HISTORY", T.words_of(["HISTORY", "TEMPORAL", "GENERAL"])).when(r == "EXPLANATION", preferred(F.col("property")))
    fits = F.coalesce(F.array_contains(wanted, F.col("type")), F.lit(True))
    some = F.max(fits).over(Window.partitionBy(key))
    return evidence.withColumn("__fits", fits | ~some).where("__fits").drop("__fits")


def ranked_segments(evidence: DataFrame, key: str = "need_id") -> DataFrame:
    """(key, place, seg, route, entity): the segments that make the answer, in their order."""
    segs = typed(evidence, key).select(key, "route", "entity", "keywords", "ev_ord", F.posexplode(T.segments("text")).alias("seg_ord", "seg")).withColumn("tokens", T.tokens("seg"))
    scored = segs.withColumn("s", segment_score(F.col("route"), F.col("seg"), F.col("tokens"), F.col("keywords"), F.col("entity"))).where("s > 0").drop("tokens", "keywords")
    r = F.col("route")
    each, text_order = _setting(r, "each"), r == "EXPLANATION"
    keyed = scored.withColumn("k1", F.when(each | text_order, F.col("ev_ord").cast("double")).otherwise(-F.col("s"))).withColumn("k2", F.when(each, -F.col("s")).when(text_order, F.col("seg_ord")).otherwise(F.col("ev_ord")).cast("double"))
    order = ["k1", "k2", "seg_ord"]
    need = Window.partitionBy(key)
    blank = F.when(_setting(r, "spaced"), 1).otherwise(0)
    size = F.length("seg") + blank
    place = F.row_number().over(need.orderBy(*order))
    within = F.row_number().over(Window.partitionBy(key, "ev_ord").orderBy(*order))
    rank = F.when(each, within).otherwise(place)
    top = keyed.withColumn("place", place).withColumn("rank", rank).where(F.col("rank") <= _setting(r, "top"))
    # Characters before this segment (or before this evidence), as joined so far.
    before = F.sum(size).over(need.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    earlier = F.sum(size).over(need.orderBy("ev_ord").rangeBetween(Window.unboundedPreceding, -1))
    so_far = F.coalesce(F.when(each, earlier).otherwise(before), F.lit(0)) - blank
    kept = top.withColumn("so_far", so_far).where(F.col("so_far") <= _setting(r, "most"))
    # Advantages: segments that begin with the entity, if there are some; and no more than the length again.
    about = (r != "ADVANTAGES") | _about(T.fold("seg"), F.col("entity"), 50)
    kept = kept.withColumn("about", about).withColumn("some", F.max("about").over(need)).where("about OR NOT some")
    again = F.coalesce(F.sum(F.length("seg") + 1).over(need.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - 1
    return kept.withColumn("again", again).where((r != "ADVANTAGES") | (F.col("again") <= 600)).select(key, "place", "seg", "route", "entity")


def answered(needs: DataFrame, evidence: DataFrame, key: str = "need_id") -> DataFrame:
    """(key, answer) for needs(key, property, form, entity, keywords, scope): cut to the scope's length."""
    from .evidence import most_chars

    n = needs.select(key, "property", "entity", "keywords", "scope", route(F.col("property"), F.col("form")).alias("route"))
    ev = evidence.select(key, "ev_ord", "type", "text").join(n, key)
    whole = ev.withColumn("s", passage_score(F.col("route"), F.col("type"), F.col("text"), F.col("entity"))).where("s IS NOT NULL")
    passage = whole.groupBy(key).agg(F.max_by("text", F.struct("s", -F.col("ev_ord"))).alias("passage"))
    joined = ranked_segments(ev, key).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "seg"))), lambda x: x["seg"]), " ").alias("joined"))
    some = evidence.select(key).distinct().withColumn("some", F.lit(True))
    met = n.join(some, key, "left").join(passage, key, "left").join(joined, key, "left")
    r = F.col("route")
    chars = F.when(r == "LOCATION", 400).when(r.isin("DEFINITION", "HISTORY"), 500).otherwise(700)
    text = F.coalesce(F.substring(F.col("passage"), F.lit(1), chars), F.col("joined"), F.when(F.col("some"), _setting(r, "missing")), F.lit(NO_EVIDENCE))
    return met.select(key, T.truncated(text, most_chars(F.col("scope"))).alias("answer"))
