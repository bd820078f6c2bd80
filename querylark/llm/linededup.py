"""Repeated passages by overlapping windows of three lines.

Every run of WINDOW consecutive lines is hashed to 128 bits, from two hashes of every line; that any two different windows
of 10 ** 13 have the same has a probability of about 10 ** -13. The first occurrence of a window is the one with the smallest
(doc_id, position); all later ones are repeats. The lines that repeats cover, merged, are removed. A repeat that
overlaps its own first occurrence (same document, fewer than WINDOW lines on) covers only lines behind it.

Only hashes and positions are shuffled to find repeats; texts move once, to meet their covered positions.

Edge cases: null texts stay null; texts of fewer than WINDOW lines (the empty one too) hold no window and stay as
they are; lines end at "\\n" alone and are compared as they are; a text whose lines all go becomes empty; rows
without doc_id stay as they are and are nobody's first occurrence; rows of one doc_id that occur again are told apart by
their text: equal rows count as one document and stay both; of differing rows with one id the positions are joined under
that id and text; an empty table gives an empty result; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Lines in a window.
WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, key, gone): sorted line positions (from 0) that repeats cover, for each text that has some."""
    common.prepare(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").contains("\n"))
    # Hash each line once, twice over, then the windows of hashes.
    lines = _lines(F.col("text"))
    hashed = common.cut(d.select("id", F.xxhash64("text").alias("key"), F.transform(lines, lambda x: F.xxhash64(x)).alias("h"), F.transform(lines, lambda x: F.xxhash64(F.lit(window), x)).alias("g")).where(F.size("h") >= window))
    over = lambda c, p: F.xxhash64(*[F.get(c, p + k) for k in range(window)])
    windows = F.transform(F.sequence(F.lit(0), F.size("h") - window), lambda p: F.struct(over("h", p).alias("w"), over("g", p).alias("w2")))
    rows = hashed.select("id", "key", F.posexplode(windows).alias("p", "x")).select("id", "key", "p", "x.w", "x.w2")
    both = ["w", "w2"]
    first = rows.groupBy(*both).agg(F.min(F.struct("id", "p", "key")).alias("f"), F.count("*").alias("c")).where("c > 1")
    # A repeat of a window in the same document that begins before the first occurrence has ended.
    near = (F.col("f.id") == F.col("id")) & (F.col("f.key") == F.col("key")) & (F.col("p") - F.col("f.p") < window)
    start = F.when(near, F.col("f.p") + window).otherwise(F.col("p"))
    n_rows = hashed.agg(F.coalesce(F.sum(F.size("h") - (window - 1)), F.lit(0))).first()[0]
    repeats = common.join_per_key(rows, first, both, n_rows).where((F.col("id") != F.col("f.id")) | (F.col("p") != F.col("f.p"))).select("id", "key", start.alias("a"), (F.col("p") + window).alias("b"))
    lines = repeats.distinct().select("id", "key", F.explode(F.sequence("a", F.col("b") - 1)).alias("line"))
    return lines.groupBy("id", "key").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the covered lines removed from text; n_chars, if there is such a column, counts the new text."""
    out, gone = _removed(docs, id_col, text_col, window)
    return out.drop(gone)


def _removed(docs: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, str]:
    """docs after removal, with a column more: the positions that went. And that column's name."""
    id_, key, hash_, new = (common.fresh(docs, c) for c in ("id_", "key_", "hash_", "new_"))
    gone = common.fresh(docs, "gone")
    found = covered(docs, id_col, text_col, window).select(F.col("id").alias(id_), F.col("key").alias(key), F.col("gone").alias(gone))
    text = F.col(text_col)
    both = docs.withColumn(hash_, F.xxhash64(text)).join(found, (F.col(id_col).cast("long") == F.col(id_)) & (F.col(hash_) == F.col(key)), "left").drop(id_, key, hash_)
    lines = _lines(text)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    out = both.withColumn(new, F.when(F.col(gone).isNotNull(), F.array_join(F.transform(left, lambda p: F.get(lines, p)), "\n")).otherwise(text))
    cols = [F.col(new).alias(c) if c == text_col else F.when(F.col(gone).isNotNull(), F.length(new)).otherwise(F.col(c)).cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes]
    return out.select(*cols, gone), gone


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_removed, text_md5) of every document after removal."""
    out, gone = _removed(common.read(spark, sf_dir, "documents"), "doc_id", "text", WINDOW)
    return out.select("doc_id", F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, p, l[p+1] || chr(10) || l[p+2] || chr(10) || l[p+3] AS w
      FROM (SELECT doc_id, l, unnest(range(len(l) - 2)) AS p FROM d WHERE len(l) >= 3)),
f AS (SELECT w, min({'doc_id': doc_id, 'p': p}) AS f FROM w GROUP BY w HAVING count(*) > 1),
r AS (SELECT w.doc_id, CASE WHEN f.f.doc_id = w.doc_id AND w.p - f.f.p < 3 THEN f.f.p + 3 ELSE w.p END AS a, w.p + 3 AS b
      FROM w JOIN f USING (w) WHERE w.doc_id <> f.f.doc_id OR w.p <> f.f.p),
g AS (SELECT doc_id, list_distinct(list(x)) AS gone FROM (SELECT doc_id, unnest(range(a, b)) AS x FROM r) GROUP BY doc_id),
o AS (SELECT d.doc_id, d.text, l, gone FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       md5(CASE WHEN gone IS NULL THEN coalesce(text, '')
                ELSE coalesce(array_to_string(list_transform(list_filter(range(len(l)), lambda i: NOT list_contains(gone, i)), lambda i: l[i+1]), chr(10)), '') END) AS text_md5
FROM o
"""
