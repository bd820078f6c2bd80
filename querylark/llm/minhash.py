"""Near-duplicate texts by bottom-k sketches.

One hash function orders all word shingles. Each distinct shingle set keeps its k smallest hashes (its sketch).
The smallest of these go to inverted lists; of them, each set uses the ones with the shortest lists, as many as a
pair that is similar enough is bound to meet in (INDEXED, MISSED, indexing() below). Lists that have the same smallest
member are read as one. In a group of sets the union-sketch estimate drops those without a likely partner; for the
others the full sets are compared exactly, and a spanning forest of the links goes on to the components.

A list is dealt to blocks of at most BLOCK members on average, so that no task gets a whole list. A list of at most DIRECT blocks
is read block against block. Longer ones are read in two passes, so that a list of near copies costs no more than its length:

1. blocks of BLOCK members, each with the list's smallest member beside them. What these link, and what they link
   together with all other lists, are components.
2. members whose component is not that of the list's smallest member meet all members of the list, block by block,
   but for those whose sets are too small or too large to be linked (size classes). Members that share
   the smallest one's component need no further links among them.

No pairs are written out that the components don't need.

The sketches miss a linked pair with a small probability (MISSED for one just at the threshold); exact=True finds
all: its lists are those of the rarest hashes of the full sets, as many as any linked pair is bound to share one of, and
nothing is dropped by estimates. It indexes (100 - percent) percent of all shingles instead of a few a text.

Equal sets, recognised by a 128-bit digest of the whole set and its size, are one set; that two different ones of
10 ** 10 have the same digest has a probability below 10 ** -18.

Edge cases: a null or empty text, or one of white space only, has no shingles and is linked with nothing; rows
with the same set are linked without comparing; repeated rows give repeated results; a row without doc_id is
linked with nothing, has no component and is kept; an empty table gives an empty result; other columns are
not looked at, whatever their names. Rows that share a doc_id are one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Hashes in a sketch.
SKETCH = 64
#: Smallest hashes of a sketch that can go to inverted lists, at least; the probability that a pair just at the
#: threshold shares too few of them.
INDEXED, MISSED = 16, 2e-6
#: Members in a block of a list, and shingles that they have together.
BLOCK, WEIGHT = 256, 1 << 20
#: Blocks up to which a list is read in one pass, block against block: no member is then written more often than this.
DIRECT = 16
#: Ids that are broadcast to find their texts; more are met by a shuffle.
BROADCAST_IDS = 200_000
#: Standard deviations of the estimate below the threshold that are still compared exactly.
SLACK = 6.0


def indexing(percent: int) -> tuple[int, int]:
    """How many hashes are indexed, and how many of these a linked pair shares at least, but for MISSED."""
    t = percent / 100
    for size in range(INDEXED, SKETCH + 1):
        missed = np.cumsum([comb(size, k) * t**k * (1 - t) ** (size - k) for k in range(size)])
        if shared := int((missed < MISSED).sum()):
            return size, shared
    raise ValueError(f"no sketch of {SKETCH} hashes finds pairs at {percent} percent")


def _sketches(width: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = common.utf8(batch.column(1))
            n, digests, kept = [], [], []
            for i, j in common.slices(at):
                h, text, _, _ = common.words(data, at, i, j)
                s, bound = common.shingles(h, text, j - i, width)
                n.append(np.diff(bound))
                digests += [hashlib.blake2b(s[a:b], digest_size=16).digest() for a, b in zip(bound[:-1], bound[1:])]
                kept += [s[a : min(b, a + size)].tobytes() for a, b in zip(bound[:-1], bound[1:])]
            if n:
                f = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.record_batch([batch.column(0), pa.array(np.concatenate(n)), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy()), pa.array(kept, pa.binary())], ["id", "n", "f1", "f2", "sketch"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = common.utf8(batch.column(1))
            out = []
            for i, j in common.slices(at):
                h, text, _, _ = common.words(data, at, i, j)
                s, bound = common.shingles(h, text, j - i, width)
                out += [s[a:b].tobytes() for a, b in zip(bound[:-1], bound[1:])]
            if out:
                yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["id", "members"])

    return run


def _indexed(size: int | None):
    """(id, n, v, s) for the `size` smallest hashes of each sketch or set (all, if None); s is how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.frombuffer(x, np.int64)[:size] for x in batch.column(2).to_pylist()]
            lens = np.array([len(x) for x in got], np.int64)
            if len(got):
                yield pa.record_batch([pa.array(np.repeat(batch.column(k).to_numpy(), lens)) for k in (0, 1)] + [pa.array(np.concatenate(got)), pa.array(np.repeat(lens, lens).astype(np.int32))], ["id", "n", "v", "s"])

    return run


def _overlap(rows: list[np.ndarray], most: int = 1 << 22) -> np.ndarray:
    """Sizes of the intersections of all pairs of rows, by 0/1 matrices of the values that two rows or more hold; none has more than `most` cells or one column."""
    m = len(rows)
    flat = np.concatenate(rows)
    own = np.repeat(np.arange(m), [len(x) for x in rows])
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    shared = ~new
    shared[:-1] |= ~new[1:]
    col = np.cumsum(new[shared]) - 1
    own = own[shared]
    total = np.zeros((m, m))
    step = max(1, most // m)
    for k in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        a, b = np.searchsorted(col, [k, k + step])
        x = np.zeros((m, step), np.float32)
        x[own[a:b], col[a:b] - k] = 1
        total += x @ x.T
    return total.astype(np.int64)


#: A group is one (p, k, i, j): a list, a size class, two blocks. Members of side 1 meet those of side 2; all meet those of side 3.
_KEYS = ["p", "k", "i", "j"]
_GROUP = "p long, k int, i int, j int"


def _meet(side: np.ndarray) -> np.ndarray:
    """Which pairs of a group's members have to be looked at, each once."""
    return np.triu((side[:, None] | side[None, :]) == 3, 1)


def _allowed(shared: np.ndarray, union: np.ndarray, exact: np.ndarray, n: np.ndarray, n2: np.ndarray, percent: int, slack: float) -> np.ndarray:
    """Which pairs of sets of n and n2 shingles the union sketch, and their sizes, allow."""
    t = percent / 100
    union = np.maximum(union, 1)
    least = np.where(exact, t - 1e-9, t - slack * np.sqrt(t * (1 - t) / union))
    return (shared / union >= least) & (np.minimum(n, n2) * 100 >= percent * np.maximum(n, n2))


def _allowed_pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray, n2: np.ndarray, size: int, percent: int, slack: float) -> np.ndarray:
    """The same for pairs (row of a, row of b) of sketches padded to `size` with the largest value."""
    pad = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = np.minimum(a[:, -1], b[:, -1])[:, None]
    both = np.sort(np.concatenate([a, b], 1), 1)
    shared = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != pad)).sum(1)
    mine, yours = ((x <= low) & (x != pad) for x in (a, b))
    return _allowed(shared, mine.sum(1) + yours.sum(1) - shared, low[:, 0] == pad, n, n2, percent, slack)


def _likely(percent: int, size: int, slack: float):
    """(p, k, i, j, id, side) of the members of a group with a partner that the sketches allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, at in common.whole_groups(batches, _KEYS):
            rows = [np.frombuffer(x, np.uint64) for x in g["sketch"].to_pylist()]
            n, side = g["n"].to_numpy(), g["side"].to_numpy()
            keep = np.zeros(len(rows), bool)
            two = at[:-1][np.diff(at) == 2]
            two = two[(side[two] | side[two + 1]) == 3]
            for part in np.array_split(two, max(1, len(two) // 10_000)):
                x = np.full((2, len(part), size), np.uint64(0xFFFFFFFFFFFFFFFF))
                for k in (0, 1):
                    lens = np.array([len(rows[p]) for p in (part + k).tolist()], np.int64)
                    x[k][np.arange(size)[None, :] < lens[:, None]] = np.concatenate([rows[p] for p in (part + k).tolist()]) if len(part) else []
                ok = _allowed_pairs(x[0], x[1], n[part], n[part + 1], size, percent, slack)
                keep[part[ok]] = keep[part[ok] + 1] = True
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                if b - a < 3:
                    continue
                own, m = rows[a:b], n[a:b]
                shared = _overlap(own).astype(float)
                top = np.array([float(x[-1]) if len(x) >= size else np.inf for x in own])
                below = np.array([np.searchsorted(x.astype(float), top, side="right") for x in own])  # of row a, under b's limit
                mine = np.array([len(x) for x in own], float)
                union = np.where(top[:, None] <= top[None, :], mine[:, None] + below.T, mine[None, :] + below) - shared
                exact = np.isinf(top)[:, None] & np.isinf(top)[None, :]
                ok = _allowed(shared, union, exact, m[:, None], m[None, :], percent, slack) & _meet(side[a:b])
                keep[a:b] = ok.any(0) | ok.any(1)
            if keep.any():
                yield from g.select([*_KEYS, "id", "side"]).filter(pa.array(keep)).to_batches()

    return run


def _exact(percent: int):
    """(a, b): a spanning forest of the exact links in each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, at in common.whole_groups(batches, _KEYS):
            ids, members = g["id"].to_numpy(), g["members"]
            found: list[tuple[int, int]] = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                if b - a < 2:
                    continue
                rows = [np.frombuffer(x, np.uint64) for x in members[a:b].to_pylist()]
                n = np.array([len(x) for x in rows], np.int64)
                if len(rows) == 2:
                    both = len(np.intersect1d(rows[0], rows[1], assume_unique=True))
                    edges = [(0, 1)] if 100 * both >= percent * (n.sum() - both) else []
                else:
                    both = _overlap(rows)
                    linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
                    np.fill_diagonal(linked, False)
                    edges = common.spanning(len(rows), linked)
                found += [(a + x, a + y) for x, y in edges]
            if found:
                yield pa.record_batch([pa.array(ids[[a for a, _ in found]]), pa.array(ids[[b for _, b in found]])], ["a", "b"])

    return run


def _blocks(n: str, weight: str) -> Column:
    return F.ceil(F.greatest(F.col(n) / BLOCK, F.col(weight) / WEIGHT)).cast("int")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = 5, exact: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs; see the module's text for the edge cases."""
    spark = common.prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    all_ = common.cut(texts.mapInArrow(_sketches(width, SKETCH), "id long, n long, f1 long, f2 long, sketch binary"))
    named = all_.where("id IS NOT NULL AND n > 0")
    n_rows = named.count()
    same = ["f1", "f2", "n"]
    reps = named.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("c"))
    members = common.join_per_key(named.select("id", *same), reps, same, n_rows).select("id", "rep").distinct()
    sketches = named.join(reps.select(*same, F.col("rep").alias("id")), [*same, "id"], "left_semi").select("id", "n", "f1", "sketch").dropDuplicates(["id", "f1"]).select("id", "n", "sketch")

    def sets(wanted: DataFrame) -> DataFrame:
        ids = wanted.select("id").distinct()
        few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        return texts.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInArrow(_sets(width), "id long, members binary")

    if exact:
        whole = sets(sketches).select("id", F.expr("length(members) div 8").alias("n"), "members")
        posts = common.cut(whole.mapInArrow(_indexed(None), "id long, n long, v long, s int").distinct())
        fewest = F.ceil(F.col("s") * percent / 100)
        n_posts = posts.count()
    else:
        size, shared = indexing(percent)
        posts = sketches.mapInArrow(_indexed(size), "id long, n long, v long, s int")
        # A linked pair shares `shared` of its `size` smallest hashes, in proportion for small sets.
        fewest = F.greatest(F.lit(1), F.floor(F.col("s") * shared / size))
        n_posts = size * n_rows
    lengths = posts.groupBy("v").agg(F.count("*").alias("c"))
    # What shares `fewest` of s hashes meets in one of the rarest s - fewest + 1 of either set.
    ranked = common.join_per_key(posts, lengths, ["v"], n_posts).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("c", "v")))
    lists = common.cut(ranked.where((F.col("r") <= F.col("s") - fewest + 1) & (F.col("c") > 1)).select("v", "id", "n"))
    first = lists.groupBy("v").agg(F.min("id").alias("p"), F.count("*").alias("c")).where("c > 1")
    pairs = common.cut(common.join_per_key(lists, first, ["v"], lists.count()).select("p", "id", "n").distinct())
    n_pairs = pairs.count()
    counts = pairs.groupBy("p").agg(F.count("*").alias("c"), F.sum("n").alias("w")).withColumn("blocks", _blocks("c", "w"))
    dealt = common.cut(common.join_per_key(pairs, counts, ["p"], n_pairs))

    def links(groups: DataFrame) -> DataFrame:
        """(a, b): enough links of the members of groups(p, k, i, j, id, side) for their components."""
        if exact:
            likely = groups
        else:
            met = groups.join(sketches, "id").select(*_KEYS, "id", "side", "n", "sketch").repartition(*_KEYS).sortWithinPartitions(*_KEYS)
            likely = common.cut(met.mapInArrow(_likely(percent, SKETCH, SLACK), f"{_GROUP}, id long, side int"))
        checked = likely.join(sets(likely), "id").select(*_KEYS, "id", "members").repartition(*_KEYS).sortWithinPartitions(*_KEYS)
        return common.cut(checked.mapInArrow(_exact(percent), "a long, b long").distinct())

    none = F.lit(0)
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    direct = dealt.where(F.col("blocks") <= DIRECT).select("p", "id", block.alias("b"), F.explode(F.sequence(none, F.col("blocks") - 1)).alias("o"))
    direct = direct.select("p", none.alias("k"), F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "id", F.when(F.col("b") == F.col("o"), 3).when(F.col("b") < F.col("o"), 1).otherwise(2).alias("side"))
    long_lists = dealt.where(F.col("blocks") > DIRECT)
    own = long_lists.where("id <> p").select("p", none.alias("k"), block.alias("i"), none.alias("j"), "id", F.lit(3).alias("side"))
    beside = long_lists.where("id = p").select("p", none.alias("k"), F.explode(F.sequence(none, F.col("blocks") - 1)).alias("i"), none.alias("j"), "id", F.lit(3).alias("side"))
    edges = links(direct.unionByName(own).unionByName(beside)).unionByName(members.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    roots = common.cut(common.components(edges))
    groups = _second_pass(long_lists, roots, percent)
    if groups is not None:
        more = links(groups)
        if not more.isEmpty():
            roots = common.components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more))
    out = all_.select("id", "n").join(roots, "id", "left")
    root = F.coalesce("root", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), root.alias("component_id"), (F.coalesce(root == F.col("id"), F.lit(True))).alias("kept"))


def _second_pass(long_lists: DataFrame, roots: DataFrame, percent: int) -> DataFrame | None:
    """Groups in which the members of long lists(p, id, n) that lie outside their first member's component meet all others."""
    if long_lists.isEmpty():
        return None
    known = common.cut(long_lists.select("p", "id", "n").join(roots, "id", "left").select("p", "id", "n", F.coalesce("root", "id").alias("root")))
    n = known.count()
    main = known.where("id = p").select("p", F.col("root").alias("main"))
    sizes = known.groupBy("p").agg(F.count("*").alias("c"), F.countDistinct("root").alias("roots")).where("roots > 1").join(main, "p")
    step = log(100 / percent)
    apart = common.join_per_key(known, sizes, ["p"], n).select("p", "id", "n", (F.col("root") != F.col("main")).alias("outside"), F.floor(F.log("n") / step).cast("int").alias("k"))
    apart = common.cut(apart)
    if apart.isEmpty():
        return None
    # Sets whose sizes differ by two classes or more can't be linked.
    asked = apart.where("outside").select("p", "k", "id", "n", F.lit(1).alias("side"))
    others = apart.select("p", F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)).alias("k"), "id", "n", F.lit(2).alias("side"))
    both = asked.unionByName(others)
    sized = both.groupBy("p", "k").agg(F.count("*").alias("c"), *[f(F.when(F.col("side") == s, x)).alias(f"{name}{s}") for s in (1, 2) for f, x, name in ((F.count, F.lit(1), "m"), (F.sum, F.col("n"), "w"))]).where("m1 > 0")
    sized = sized.select("p", "k", "c", _blocks("m1", "w1").alias("b1"), _blocks("m2", "w2").alias("b2"))
    placed = common.join_per_key(both, sized, ["p", "k"], 4 * n)
    first = F.col("side") == 1
    mine = F.pmod(F.xxhash64("id"), F.when(first, F.col("b1")).otherwise(F.col("b2"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(first, F.col("b2")).otherwise(F.col("b1")) - 1)).alias("o")
    spread = placed.select("p", "k", "id", "side", mine.alias("b"), other)
    met = spread.select("p", "k", F.when(first, F.col("b")).otherwise(F.col("o")).alias("i"), F.when(first, F.col("o")).otherwise(F.col("b")).alias("j"), "id", "side")
    # A member that meets itself is there once, for both sides.
    return met.groupBy(*_KEYS, "id").agg(F.bit_or("side").alias("side"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each component: rows of the smallest doc_id. Rows without doc_id stay."""
    name = common.fresh(docs, "lost")
    lost = near_duplicates(docs, **options).where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(lost, docs[options.get("id_col", "doc_id")].cast("long") == lost[name], "left_anti")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"))
