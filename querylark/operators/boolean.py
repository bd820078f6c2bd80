"""Boolean and phrase queries: a chain of terms, "phrases" and AND, OR, NOT, from left to right without precedence.

A word in an operator's place that is none of these means AND and is skipped; an operator at the end is dropped; an
empty query matches nothing. Terms aren't folded: they are looked up as they stand.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import Index
from .ranking import scored, top


@dataclass(frozen=True)
class Term:
    word: str


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]


@dataclass(frozen=True)
class Both:
    op: str  # AND, OR or NOT
    left: Term | Phrase | Both
    right: Term | Phrase | Both


Query = Term | Phrase | Both


def lex(query: str) -> list[str]:
    """Words between blanks; from a quotation mark to the next one (or the end) is one item."""
    return re.findall(r'"[^"]*(?:"|\Z)|[^ "]+', query)


def _leaf(item: str) -> Term | Phrase:
    if len(item) > 2 and item[0] == item[-1] == '"':
        return Phrase(tuple(item[1:-1].split()))
    return Term(item)


def parse(query: str) -> Query:
    items = lex(query)
    if not items:
        return Term(" ")
    pairs = zip(items[1::2], items[2::2])
    return reduce(lambda left, p: Both(p[0] if p[0] in ("OR", "NOT") else "AND", left, _leaf(p[1])), pairs, _leaf(items[0]))


def phrase_docs(index: Index, words: Sequence[str]) -> DataFrame:
    """(doc_id) with the words at positions that follow each other."""
    return index.phrase(words)


def matches(index: Index, q: Query) -> DataFrame:
    """(doc_id) of a query tree, without repetitions."""
    if isinstance(q, Term):
        return index.lookup(q.word).select("doc_id")
    if isinstance(q, Phrase):
        return phrase_docs(index, q.words)
    left, right = matches(index, q.left), matches(index, q.right)
    if q.op == "OR":
        return left.union(right).distinct()
    return left.join(right, "doc_id", "left_anti" if q.op == "NOT" else "left_semi")


def scores(index: Index, q: Query) -> DataFrame:
    """(doc_id, score): leaves by BM25 over what they match, AND and OR add both sides, NOT keeps the left ones."""
    if isinstance(q, Term):
        return scored(index, [q.word])
    if isinstance(q, Phrase):
        return scored(index, q.words).join(phrase_docs(index, q.words), "doc_id", "left_semi")
    left = scores(index, q.left)
    if q.op == "NOT":
        return left.join(matches(index, q.right), "doc_id", "left_anti")
    right = scores(index, q.right).withColumnRenamed("score", "more")
    met = left.join(right, "doc_id", "full" if q.op == "OR" else "inner")
    return met.select("doc_id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))).alias("score"))


def search(index: Index, query: str, k: int = 10) -> DataFrame:
    """The k best documents of a query."""
    return top(scores(index, parse(query)), k)
