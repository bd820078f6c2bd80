"""Text functions as column expressions: tokens, words, sentences, paragraphs, truncation.

Letters are folded in ASCII alone and a word is a run of ASCII letters and digits, whatever the language; lengths
count characters.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
YEAR = r"(?<![A-Za-z0-9_])(1[0-9]{3}|20[0-9]{2})(?![A-Za-z0-9_])"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once, however often f uses it: inside other lambdas, c would be computed for each element."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def fold(c: Column | str) -> Column:
    """A-Z to a-z; other letters stay. Texts of ASCII alone go the short way; translate() looks up character by character."""
    return let(col(c), lambda t: F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER)))


def tokens(c: Column | str) -> Column:
    """Folded words in their order. lower() makes letters of words of A-Z and of two other letters alone, which are taken out
    before; what it makes of the rest belongs to no word."""
    bare = F.replace(F.replace(col(c), F.lit("\u0130"), F.lit(" ")), F.lit("\u212a"), F.lit(" "))
    return F.regexp_extract_all(F.lower(bare), F.lit("[a-z0-9]+"), F.lit(0))


def words_of(values: Sequence[str]) -> Column:
    """A constant array. One literal that is cut when the plan is made: hundreds of words cost no hundreds of expressions."""
    return F.split(F.lit("\u0001".join(values)), "\u0001") if values else F.array().cast("array<string>")


def keywords(c: Column | str, stop_words: Sequence[str]) -> Column:
    """Tokens of two letters or more that are no stop words; order and repetitions stay."""
    stop = words_of(stop_words)
    return F.filter(tokens(c), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def contains_any(c: Column | str, values: Sequence[str]) -> Column:
    """Whether one of the values is a substring."""
    return let(col(c), lambda t: F.exists(words_of(values), lambda w: F.contains(t, w)))


def count_contained(c: Column | str, values: Sequence[str]) -> Column:
    """How many of the values are substrings."""
    return let(col(c), lambda t: F.size(F.filter(words_of(values), lambda w: F.contains(t, w))))


def contains_word(c: Column | str, word: Column | str) -> Column:
    """Whether a (folded) text has the word with no letter or digit beside it."""
    quoted = F.regexp_replace(col(word), r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.rlike(col(c), F.concat(F.lit("(^|[^A-Za-z0-9])"), quoted, F.lit(r"($|[^A-Za-z0-9])")))


def hits(token_array: Column | str, wanted: Column | str) -> Column:
    """How many entries of `wanted` (words; repetitions count) are among the tokens."""
    return let(col(token_array), lambda t: F.size(F.filter(col(wanted), lambda w: F.array_contains(t, w))))


def paragraphs(c: Column | str) -> Column:
    """Cut before a newline or heading that follows a newline; blanks on the left go, blank ones too."""
    cut = F.split(col(c), r"\n(?=[\n#])")
    return F.filter(F.transform(cut, lambda p: F.regexp_replace(p, r"^[ \t\r\n]+", "")), lambda p: F.length(p) > 0)


def sentences(c: Column | str, longer_than: int = 15) -> Column:
    """Cut after each . ! ?"""
    found = F.regexp_extract_all(col(c), F.lit(r"[^.!?]*[.!?]|[^.!?]+\z"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.regexp_replace(s, r"^[ \n]+", "")), lambda s: F.length(s) > longer_than)


def clear_sentences(c: Column | str, longer_than: int = 10) -> Column:
    """Cut after . ! ? only where a blank, a newline or the end follows."""
    found = F.split(col(c), r"(?<=[.!?])(?=[ \n])")
    return F.filter(F.transform(found, lambda s: F.regexp_replace(s, r"^[ \n]+", "")), lambda s: F.length(s) > longer_than)


def segments(c: Column | str, least: int = 15) -> Column:
    """Lines that begin with - # * are segments of their own; a blank line ends one; other lines are joined by a
    blank and cut after each . ! ?. Blanks and dashes on the left go, short ones too."""
    own_line = r"(?m)^[ \t]*([-#*][^\n]*)$"
    marked = F.regexp_replace(F.regexp_replace(col(c), own_line, "\u0001$1\u0001"), r"\n[ \t\r]*(?=\n)", "\u0001")
    runs = F.split(marked, "\u0001")
    bare = r"^[ \t\r\n]+"

    def cut(run: Column) -> Column:
        flat = F.regexp_replace(run, r"\n", " ")
        listed = F.rlike(run, F.lit(r"^[-#*]"))
        return F.when(listed, F.array(run)).otherwise(F.regexp_extract_all(F.regexp_replace(flat, bare, ""), F.lit(r"[^.!?]*[.!?]|[^.!?]+\z"), F.lit(0)))

    found = F.flatten(F.transform(runs, cut))
    return F.filter(F.transform(found, lambda s: F.regexp_replace(s, r"^[ \t\r\n-]+", "")), lambda s: F.length(s) >= least)


def has_year(c: Column | str) -> Column:
    return F.rlike(col(c), F.lit(YEAR))


def stem(c: Column | str) -> Column:
    """A word of over four letters without its last two."""
    return F.when(F.length(col(c)) > 4, F.substring(col(c), F.lit(1), F.length(col(c)) - 2)).otherwise(col(c))


def truncated(c: Column | str, limit: Column | int) -> Column:
    """At most `limit` characters, up to the last full stop if that is in the second half (the stop may be at the limit)."""
    t, n = col(c), limit if isinstance(limit, Column) else F.lit(limit)
    head = F.substring(t, F.lit(1), n + 1)
    stop = n + 1 - F.locate(".", F.reverse(head))  # place of the last full stop, from 0; n + 1 without any
    found = head.contains(".") & (stop > F.floor(n / 2))
    return F.when(F.length(t) <= n, t).when(found, F.substring(t, F.lit(1), stop + 1)).otherwise(F.substring(t, F.lit(1), n))


def offset(c: Column | str, part: Column | str) -> Column:
    """Place of the first occurrence, from 0; null without any."""
    at = F.position(col(part), col(c))
    return F.when(at > 0, at - 1)


def names(c: Column | str) -> Column:
    """Runs of capitalised words and of capitals, sorted and distinct. Only A-Z, a-z, digits and _ are letters of words, so
    a name may stand beside any other letter."""
    alone = r"(?<![A-Za-z0-9_])(?:%s)(?![A-Za-z0-9_])"
    found = [F.regexp_extract_all(col(c), F.lit(alone % p), F.lit(0)) for p in (r"[A-Z][a-z]+(?:[ \t\n\x0B\f\r]+[A-Z][a-z]+)*", "[A-Z]{2,}")]
    return F.array_sort(F.array_distinct(F.concat(*found)))
