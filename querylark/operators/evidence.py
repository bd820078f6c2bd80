"""Agreement of evidence, confidence, validation, compression and scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylark.functions import text as T
from querylark.functions import vocabulary as V

PENALTY, MOST_PENALTY = 0.15, 0.4


def claims(evidence: DataFrame, domains: list[str] = V.DOMAINS, negations: list[str] = V.NEGATIONS) -> DataFrame:
    """evidence with words (distinct domain words in the folded text) and negations."""
    low = T.fold("text")
    inside = lambda ws: T.let(low, lambda t: F.filter(F.array_distinct(T.words_of(ws)), lambda w: F.contains(t, w)))
    return evidence.withColumn("words", inside(domains)).withColumn("negations", inside(negations))


def agreement(a: str = "a", b: str = "b") -> Column:
    """Share of common words, if type and use of negations agree; else 0."""
    wa, wb = F.col(f"{a}.words"), F.col(f"{b}.words")
    most = F.greatest(F.size(wa), F.size(wb))
    same = (F.col(f"{a}.type") == F.col(f"{b}.type")) & ((F.size(f"{a}.negations") > 0) == (F.size(f"{b}.negations") > 0))
    return F.when(same & (most > 0), F.size(F.array_intersect(wa, wb)) / most).otherwise(0.0)


def contradiction(a: str = "a", b: str = "b", opposites: list[tuple[str, str]] = V.OPPOSITES) -> Column:
    """Same type, other documents, and either one alone negates or they hold the two words of a pair of opposites."""
    wa, wb = F.col(f"{a}.words"), F.col(f"{b}.words")
    pairs = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in opposites])
    has = F.array_contains
    opposed = F.exists(pairs, lambda p: (has(wa, p["x"]) & has(wb, p["y"])) | (has(wa, p["y"]) & has(wb, p["x"])))
    negated = (F.size(f"{a}.negations") > 0) != (F.size(f"{b}.negations") > 0)
    return (F.col(f"{a}.type") == F.col(f"{b}.type")) & (F.col(f"{a}.doc_id") != F.col(f"{b}.doc_id")) & (negated | opposed)


def met_pairs(claimed: DataFrame, key: str = "need_id") -> DataFrame:
    """(key, a, b) with a before b, from one list of the few claims of a need: texts are read once, not for each side of a join."""
    listed = claimed.select(key, F.struct("ev_ord", "doc_id", "type", "words", "negations").alias("c")).groupBy(key).agg(F.collect_list("c").alias("cs"))
    first = listed.select(key, "cs", F.explode_outer("cs").alias("a"))
    return first.select(key, "a", F.explode_outer("cs").alias("b")).where("a.ev_ord < b.ev_ord")


def pairs(claimed: DataFrame, key: str = "need_id") -> DataFrame:
    """(key, i, j, agreement, contradicts) for the pairs of evidence of a need (15 rows at most, so 105 pairs)."""
    met = met_pairs(claimed, key)
    return met.select(key, F.col("a.ev_ord").alias("i"), F.col("b.ev_ord").alias("j"), agreement().alias("agreement"), contradiction().alias("contradicts"))


def analysis(evidence: DataFrame, key: str = "need_id") -> DataFrame:
    """(key, n_evidence, agreement, agreement_pairs, contradiction_pairs, penalty)."""
    p = pairs(claims(evidence), key)
    good = ~F.col("contradicts") & (F.col("agreement") > 0)
    summed = p.groupBy(key).agg(F.avg(F.when(good, F.col("agreement"))).alias("mean"), F.count(F.when(good, 1)).alias("agreement_pairs"), F.count(F.when(F.col("contradicts"), 1)).alias("contradiction_pairs"))
    counted = evidence.groupBy(key).agg(F.count("*").alias("n_evidence"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = counted.join(summed, key, "left").select(key, "n_evidence", F.coalesce("mean", F.lit(0.5)).alias("agreement"), zero("agreement_pairs"), zero("contradiction_pairs"))
    return out.withColumn("penalty", F.least(F.lit(MOST_PENALTY), F.col("contradiction_pairs") * PENALTY))


def coverage(evidence: DataFrame, key: str = "need_id", whole_words: bool = False) -> DataFrame:
    """(key, coverage): distinct keywords found in evidence over all keywords (repetitions count below the line)."""
    asked = evidence.where(F.size("keywords") > 0)
    # Each text is read once for all keywords.
    inside = T.let(T.tokens("text"), lambda t: F.filter("keywords", lambda w: F.array_contains(t, w))) if whole_words else T.let(T.fold("text"), lambda t: F.filter("keywords", lambda w: F.contains(t, w)))
    found = asked.select(key, F.size("keywords").alias("n"), inside.alias("found")).select(key, "n", F.explode_outer("found").alias("w"))
    return found.groupBy(key).agg((F.countDistinct("w") / F.max("n")).alias("coverage"))


def volume(n: Column, enough: float = 3.0) -> Column:
    return F.least(F.lit(1.0), n / F.lit(enough))


def basic_confidence(cov: Column, mean_score: Column, n: Column) -> Column:
    return cov * 0.4 + F.least(F.lit(1.0), mean_score) * 0.3 + volume(n) * 0.3


#: Shares of coverage, volume, agreement and absence of contradictions.
CONFIDENCE = (0.3, 0.2, 0.3, 0.2)


def refined_confidence(cov: Column, n: Column, agreed: Column, penalty: Column, weights: tuple[float, float, float, float] = CONFIDENCE, enough: float = 3.0) -> Column:
    wc, wv, wa, wp = weights
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cov * wc + volume(n, enough) * wv + agreed * wa + (1.0 - penalty) * wp))


def signal_share(text: Column | str, prop: Column) -> Column:
    """Share of the property's signs of a fitting answer in the folded text; null for a property without signs."""
    out = F.lit(None).cast("double")
    for p, words in V.VALIDATION.items():
        out = F.when(prop == p, T.count_contained(T.fold(text), words) / float(len(words))).otherwise(out)
    return out


def validated(text: Column, prop: Column, confidence: Column, fail: float = 0.0, weak_share: float = 0.15, fail_factor: float = 0.3, weak_factor: float = 0.7) -> Column:
    """(validated, confidence, note) of an answer."""
    missing = (F.length(text) == 0) | text.contains("not found")
    share = signal_share(text, prop)
    make = lambda ok, c, note: F.struct(F.lit(ok).alias("validated"), c.alias("confidence"), note.alias("note"))
    weak = F.concat(F.lit("Weak property match ("), F.format_number(share * 100, 0), F.lit("% of signals)."))
    return (
        F.when(missing, make(False, F.least(confidence, F.lit(0.1)), F.lit("No relevant content found for this property.")))
        .when(share <= fail, make(False, confidence * fail_factor, F.concat(F.lit("Answer does not appear to address "), prop, F.lit(" (0 signal words found)."))))
        .when(share < weak_share, make(True, confidence * weak_factor, weak))
        .otherwise(make(True, confidence, F.lit("")))
    )


def compression(scope: Column, confidence: Column, agreed: Column, n: Column, least_confidence: float = 0.6, least_agreement: float = 0.6) -> Column:
    high = (confidence >= 0.85) & (agreed >= 0.7)
    return (
        F.when((confidence < least_confidence) | (agreed < least_agreement) | (scope == "STRICT"), "NONE")
        .when((n >= 4) & (confidence >= 0.9), "STRONG")
        .when((scope == "NORMAL") & high, "STRONG")
        .when((scope == "EXPANDED") & high, "LIGHT")
        .otherwise("NONE")
    )


def compressed(text: Column | str, level: Column) -> Column:
    """STRONG keeps the first sentence, LIGHT the first two of more."""
    t, s = T.col(text), T.clear_sentences(text)
    return F.when((level == "STRONG") & (F.size(s) > 0), F.get(s, F.lit(0))).when((level == "LIGHT") & (F.size(s) > 2), F.array_join(F.slice(s, 1, 2), " ")).otherwise(t)


def adjusted_scope(scope: Column, confidence: Column, high: float = 0.85, low: float = 0.5) -> Column:
    return F.when((confidence > high) & (scope == "NORMAL"), "STRICT").when((confidence < low) & (scope == "STRICT"), "NORMAL").otherwise(scope)


def most_chars(scope: Column, strict: int = 200, normal: int = 400, wide: int = 700) -> Column:
    return F.when(scope == "STRICT", strict).when(scope == "EXPANDED", wide).otherwise(normal)


def most_segments(scope: Column) -> Column:
    return F.when(scope == "STRICT", 2).when(scope == "EXPANDED", 8).otherwise(4)


def support_coverage(supports: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, support_coverage, n_support): share of the support keywords that all evidence of a need together holds."""
    all_text = evidence.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ev_ord", "text"))), lambda s: F.concat(F.lit(" "), T.fold(s["text"]))), "").alias("all"))
    k = supports.select(*keys, F.explode("keywords").alias("w")).join(all_text, keys, "left")
    found = F.contains(F.coalesce("all", F.lit("")), T.fold("w"))
    return k.groupBy(*keys).agg(F.avg(found.cast("double")).alias("support_coverage"), F.count("*").alias("n_support"))


def sources(evidence: DataFrame, key: str = "need_id") -> DataFrame:
    """(key, sources): documents in the order of their first evidence."""
    return evidence.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ev_ord", "doc_id"))), lambda s: s["doc_id"])).alias("sources"))
