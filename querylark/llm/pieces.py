"""SentencePiece encoding and decoding.

A text is cut into units (a run of word marks with what follows up to the next mark; a newline) that no piece can
cross. Spans of at most the longest piece's length are joined to the piece table; the edges of a unit make its lattice.

* Unigram models: the lattice is a relation. Substrings are exploded, equi-joined to the piece table, grouped by
  unit, and the best path is folded with the higher-order function aggregate (viterbi()).
* BPE models, as the public vocabulary here: a best path isn't what such a model means. Its encoding merges the
  neighbouring pair of highest score first, so the fold is one over merges (encode()). It runs over all distinct
  units of a slice of text at once, in arrays: spans are looked up by their hashes in the sorted piece table, the
  best pair of every unit is merged, until no pair of a unit is a piece. Units longer than LONG characters go through
  a heap. README has the figures of the relational form beside those of this one.

Characters that no piece has become byte pieces, so decoding gives back every text: decode(encode(t)) == t.
(As in the public library, the mark itself, U+2581, comes back as a space.)

Edge cases: null and empty texts have no pieces (their decoding is the empty text); white space is kept as it is;
long texts are encoded whole; repeated rows and rows without doc_id are encoded alike; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The vocabulary file: found beside the installed public tokenizers, or given.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Characters from which a unit is merged by a heap of its own.
LONG = 64
_M = 0x9E3779B97F4A7C15 | 1
_M_INV = pow(_M, -1, 1 << 64)


class Vocabulary:
    """Piece table of a model: pieces that text can match, byte pieces, scores."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_: dict[int, int], unknown: int, others: dict[int, bytes] | None = None) -> None:
        """pieces: (text, score) by id, text empty for ids that text never matches; bytes_: byte to id."""
        self.pieces, self.byte_ids, self.unknown = pieces, bytes_, unknown
        self.ids = {p: i for i, (p, _) in enumerate(pieces) if p}
        if any(a != MARK and b == MARK for p in self.ids for a, b in zip(p, p[1:])) or any("\n" in p and len(p) > 1 for p in self.ids):
            raise ValueError("pieces that cross units are not supported")
        self.longest = max(map(len, self.ids))
        order = np.array(list(self.ids.values()))
        code = [np.array([ord(c) for c in p], np.uint64) for p in self.ids]
        hashes = np.array([int((self.mixed(c) * common.powers(_M, len(c))).sum(dtype=np.uint64)) for c in code], np.uint64)
        hashes = common.mix64(hashes ^ np.array([len(c) for c in code], np.uint64))
        at = np.argsort(hashes)
        self.hashes, self.hash_ids = hashes[at], order[at]
        # Merges go by score, ties by place: rank 0 merges first, and equal scores have equal ranks.
        scores = np.array([pieces[i][1] for i in order])
        _, rank = np.unique(-scores, return_inverse=True)
        self.rank_of = dict(zip(order.tolist(), rank.tolist()))
        self.hash_ranks = rank[at]
        self.out = np.array([(others or {}).get(i, p.replace(MARK, " ").encode()) for i, (p, _) in enumerate(pieces)], object)
        for b, i in bytes_.items():
            self.out[i] = bytes([b])

    @staticmethod
    def mixed(code: np.ndarray) -> np.ndarray:
        return common.mix64(code + np.uint64(0x632BE59BD9B4E019))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, rank) of hashed spans; rank is a large number where there is no piece."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        return np.where(hit, self.hash_ids[at], -1), np.where(hit, self.hash_ranks[at], 1 << 40)


@lru_cache(maxsize=2)
def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.vocab_size()
    special = {i for i in range(n) if p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)}
    bytes_ = {int(p.id_to_piece(i)[3:5], 16): i for i in special if p.is_byte(i)}
    pieces = [("" if i in special else p.id_to_piece(i), p.get_score(i)) for i in range(n)]
    return Vocabulary(pieces, bytes_, p.unk_id(), {i: b"" for i in special if not p.is_byte(i)})


def merge_long(unit: str, v: Vocabulary) -> list[int]:
    """The merges of one unit by a heap: (rank, place) first."""
    n = len(unit)
    left, right, end, live = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j < n and end[j] - i <= v.longest and (k := v.ids.get(unit[i : end[j]])) is not None:
            heapq.heappush(heap, (v.rank_of[k], i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = right[i] if live[i] else n
        if j >= n or end[j] != e:
            continue
        live[j] = False
        end[i], right[i] = e, right[j]
        if right[j] < n:
            left[right[j]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out, i = [], 0
    while i < n:
        piece = v.ids.get(unit[i : end[i]])
        out += [piece] if piece is not None else [v.byte_ids.get(b, v.unknown) for b in unit[i : end[i]].encode()]
        i = end[i]
    return out


def merge_units(code: np.ndarray, begin: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of units (unit u is code[begin[u]:begin[u + 1]]) and the offsets of each unit's ids."""
    n_units, n = len(begin) - 1, len(code)
    size = np.diff(begin)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v.mixed(code.astype(np.uint64)) * common.powers(_M, n), dtype=np.uint64)])
    inverse = common.powers(_M_INV, n + 1)

    def spans(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, ranks = v.find(common.mix64((total[b] - total[a]) * inverse[a] ^ (b - a).astype(np.uint64)))
        wide = b - a > v.longest
        ids[wide], ranks[wide] = -1, 1 << 40
        return ids, ranks

    unit = np.repeat(np.arange(n_units), size)
    short = size[unit] <= LONG
    start = np.flatnonzero(short)
    end, own = start + 1, unit[start]
    none = np.int64(1) << 62

    def keyed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ranks = spans(a, b)[1]
        return np.where(ranks < 1 << 40, (ranks << 21) | (a - begin[unit[a]]), none)

    key = np.full(len(start), none)
    if len(start) > 1:
        pair = np.flatnonzero(own[:-1] == own[1:])
        key[pair] = keyed(start[pair], end[pair + 1])
    final_start, final_end = [], []
    while len(start):
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        count = np.diff(np.append(first, len(own)))
        best = np.minimum.reduceat(key, first)
        over = np.repeat(best == none, count)
        if over.any():
            final_start.append(start[over])
            final_end.append(end[over])
            go = ~over
            start, end, own, key = start[go], end[go], own[go], key[go]
            if not len(start):
                break
            count, best = count[best != none], best[best != none]
        hit = np.flatnonzero(key == np.repeat(best, count))  # one place in each unit: the key holds it
        end[hit] = end[hit + 1]
        keep = np.ones(len(start), bool)
        keep[hit + 1] = False
        place = np.cumsum(keep) - 1
        start, end, own, key = start[keep], end[keep], own[keep], key[keep]
        hit = place[hit]
        near = np.zeros(len(start), bool)
        near[hit] = near[hit[hit > 0] - 1] = True
        redo = np.flatnonzero(near)
        last = redo == len(own) - 1
        pair = redo[~last][own[redo[~last]] == own[redo[~last] + 1]]
        key[redo] = none
        key[pair] = keyed(start[pair], end[pair + 1])
    start = np.concatenate(final_start) if final_start else np.zeros(0, np.int64)
    end = np.concatenate(final_end) if final_end else np.zeros(0, np.int64)
    ids = spans(start, end)[0]
    # Characters without a piece, and long units, are written out one by one.
    extra: dict[int, list[int]] = {int(a): [v.byte_ids.get(b, v.unknown) for b in chr(code[a]).encode("utf-8", "replace")] for a in start[ids < 0].tolist()}
    for u in np.flatnonzero(size > LONG).tolist():
        extra[int(begin[u])] = merge_long("".join(map(chr, code[begin[u] : begin[u + 1]].tolist())), v)
    plain = ids >= 0
    at = np.concatenate([start[plain], *[np.full(len(x), a) for a, x in extra.items()]]).astype(np.int64)
    nth = np.concatenate([np.zeros(int(plain.sum()), np.int64), *[np.arange(len(x)) for x in extra.values()]]).astype(np.int64)
    flat = np.concatenate([ids[plain], *[np.array(x, np.int64) for x in extra.values()]]).astype(np.int64)
    order = np.lexsort((nth, at)) if extra else np.argsort(at)
    return flat[order].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(unit[at] if len(at) else at, minlength=n_units))])


def encode_texts(texts: list[str], v: Vocabulary) -> list[np.ndarray]:
    """Ids of each text."""
    lens = np.array([len(t) + (len(t) > 0) for t in texts], np.int64)
    joined = "".join(MARK + t if t else "" for t in texts)
    if not joined:
        return [np.zeros(0, np.int32) for _ in texts]
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    code[code == 32] = ord(MARK)
    n = len(code)
    mark, line = code == ord(MARK), code == 10
    cut = np.zeros(n, bool)
    cut[1:] = mark[1:] & ~mark[:-1] | line[1:] | line[:-1]
    cut[np.cumsum(lens)[:-1][np.cumsum(lens)[:-1] < n]] = True
    cut[0] = True
    begin = np.append(np.flatnonzero(cut), n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v.mixed(code.astype(np.uint64)) * common.powers(_M, n), dtype=np.uint64)])
    h = common.mix64((total[begin[1:]] - total[begin[:-1]]) * common.powers(_M_INV, n)[begin[:-1]] ^ np.diff(begin).astype(np.uint64))
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    size = np.diff(begin)[first]
    shift = np.concatenate([[0], np.cumsum(size)])
    pick = np.repeat(begin[:-1][first] - shift[:-1], size) + np.arange(shift[-1])
    ids, bound = merge_units(code[pick], shift, v)
    count = np.diff(bound)[which]
    stop = np.cumsum(count)
    flat = ids[np.repeat(bound[:-1][which] - (stop - count), count) + np.arange(int(stop[-1]))]
    text_of = np.searchsorted(np.cumsum(lens), begin[:-1], side="right")
    per = np.bincount(text_of, weights=count, minlength=len(texts)).astype(np.int64)
    return np.split(flat, np.cumsum(per)[:-1])


def decode_ids(ids: np.ndarray, v: Vocabulary) -> str:
    out = b"".join(v.out[ids].tolist()).decode("utf-8", "replace")
    return out[1:] if out.startswith(" ") else out


def encode(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for every row."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(path)
        for batch in batches:
            ids = [x for texts in common.text_runs(batch.column(1), 2 * common.SLICE_BYTES) for x in encode_texts(texts, v)]
            if ids:
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())
                yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) for every row of ids."""
    common.prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(path)
        for batch in batches:
            texts = [decode_ids(np.asarray(x, np.int64), v) if x is not None and len(x) else "" for x in batch.column(1).to_numpy(zero_copy_only=False)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col)).mapInArrow(run, "doc_id long, text string")


def viterbi(units: DataFrame, pieces: DataFrame, longest: int, unknown_score: float = -100.0) -> DataFrame:
    """(unit, pieces): the best path of each distinct unit(unit) over pieces(piece, score), a table of bounded size.

    Higher score sums win; of equal ones the path whose last piece is longer. A character that no piece covers is a
    piece of its own with unknown_score.
    """
    distinct = units.where(F.length("unit") > 0).select("unit").distinct()
    starts = distinct.select("unit", F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("a"))
    spans = starts.select("unit", "a", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("unit") - F.col("a") + 1))).alias("n"))
    spans = spans.select("unit", "a", "n", F.substring(F.col("unit"), F.col("a"), F.col("n")).alias("piece"))
    known = spans.join(F.broadcast(pieces.select("piece", "score")), "piece", "left")
    edges = known.where(F.col("score").isNotNull() | (F.col("n") == 1)).withColumn("score", F.coalesce("score", F.lit(unknown_score)))
    lattice = edges.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct((F.col("a") + F.col("n") - 1).alias("b"), F.col("n").alias("n"), F.col("piece").alias("piece"), F.col("score").cast("double").alias("score")))).alias("edges"))
    # The state has, for each place reached, the best sum and the last piece's length; edges come by their end.
    state = "array<struct<s:double,n:int>>"
    zero = F.array(F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))).cast(state)

    def step(acc, e):
        s = F.get(acc, e["b"] - e["n"])["s"] + e["score"]
        new = F.struct(s.alias("s"), e["n"].cast("int").alias("n"))
        known = F.size(acc) > e["b"]
        better = ~known | (s >= F.get(acc, e["b"])["s"])
        return F.when(~better, acc).otherwise(F.concat(F.slice(acc, 1, e["b"]), F.array(new))).cast(state)

    best = lattice.select("unit", F.aggregate("edges", zero, step).alias("best"))
    back = F.aggregate(
        F.sequence(F.lit(1), F.length("unit")),
        F.struct(F.length("unit").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, _: F.when(acc["at"] <= 0, acc).otherwise(
            F.struct((acc["at"] - F.get("best", acc["at"])["n"]).alias("at"), F.concat(F.array(F.substring(F.col("unit"), acc["at"] - F.get("best", acc["at"])["n"] + 1, F.get("best", acc["at"])["n"])), acc["out"]).alias("out"))
        ),
    )
    return best.select("unit", back["out"].alias("pieces"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids_sha256, decoded): sha256 of the ids as little-endian 32-bit integers; decoding gives the text back."""
    common.prepare(spark)
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(MODEL)
        for batch in batches:
            parts = list(common.text_runs(batch.column(1), 2 * common.SLICE_BYTES))
            texts = [t for part in parts for t in part]
            ids = [x for part in parts for x in encode_texts(part, v)]
            yield pa.record_batch([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string()), pa.array([decode_ids(x, v) == t if len(x) else t == "" for x, t in zip(ids, texts)], pa.bool_())], ["doc_id", "n_pieces", "ids_sha256", "decoded"])

    return docs.mapInArrow(run, "doc_id long, n_pieces long, ids_sha256 string, decoded boolean")
