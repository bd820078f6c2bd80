"""Statistics of whole texts for classifiers, computed on bytes; and which labelled rows may be learned from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", b".,;:?'\"()-", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:192] = 10  # bytes that continue a character
_CLASS[192:] = 11  # bytes that begin one outside ASCII
_N_CLASSES = 12

NAMES = ("words", "word_length", "upper", "digits", "newlines", "punctuation", "exclaimed", "pipes", "symbols", "beyond_ascii", "distinct_words", "distinct_triples", "control")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame, name: str, id_col: str = "doc_id") -> DataFrame:
    """(id, y) with one row per id, without the held-out ids and null labels; of differing labels the larger counts."""
    kept = labels.where(~held_out(F.col(id_col)) & F.col(id_col).isNotNull() & F.col(name).isin(0, 1))
    return kept.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(name).cast("int")).alias("y"))


def _distinct(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    out = np.zeros(len(begin) - 1)
    for t, (a, b) in enumerate(zip(begin[:-1], begin[1:])):
        if b > a:
            s = np.sort(x[a:b])
            out[t] = 1 + np.count_nonzero(s[1:] != s[:-1])
    return out


def text_statistics(data: np.ndarray, at: np.ndarray, i: int, j: int) -> np.ndarray:
    """One row of len(NAMES) transformed statistics for each of the texts i..j-1; all zeros for an empty text."""
    lo, hi, n = int(at[i]), int(at[j]), j - i
    sizes = np.diff(at[i : j + 1])
    own = np.repeat(np.arange(n) * _N_CLASSES, sizes)
    own += _CLASS[data[lo:hi]]
    c = np.bincount(own, minlength=n * _N_CLASSES).reshape(n, _N_CLASSES).astype(float)
    chars = np.maximum(1, c.sum(1) - c[:, 10])
    h, text, _, _ = common.words(data, at, i, j)
    count = np.bincount(text, minlength=n)
    begin = np.concatenate([[0], np.cumsum(count)])
    triple = common.mix64(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)) if len(h) > 2 else np.zeros(0, np.uint64)
    inner = np.stack([begin[:-1], np.maximum(begin[:-1], begin[1:] - 2)], 1)
    triples = np.array([len(np.unique(triple[a:b])) if b > a else 0 for a, b in inner.tolist()], float)
    words = np.maximum(1, count)
    some = sizes > 0
    share = lambda x: np.sqrt(x / chars)
    out = np.stack([
        np.log1p(count), np.log1p((chars - c[:, 4] - c[:, 5]) / words), share(c[:, 2]), share(c[:, 3]), share(c[:, 5]), share(c[:, 6]), share(c[:, 7]), share(c[:, 8]), share(c[:, 9]), share(c[:, 11]),
        _distinct(h, begin) / words ** 0.9, np.where(count > 2, triples / np.maximum(1, count - 2), 1.0), share(c[:, 0]),
    ], 1)
    return np.where(some[:, None], out, 0.0)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = common.utf8(batch.column(1))
            got = [text_statistics(data, at, i, j) for i, j in common.slices(at)]
            if got:
                x = np.concatenate(got)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.record_batch([batch.column(0), flat], ["id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, x array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)) if len(column) else np.zeros((0, len(NAMES)))
