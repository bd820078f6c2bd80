"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are projected on the leading principal dimensions and sorted by grid cells of side epsilon, the
distance that the least cosine allows. The sorted sequence is cut into intervals (blocks) with bounding boxes. Two
blocks are compared only if their boxes come within epsilon: their names meet by an equi-join on the cells of the first
JOINED dimensions that they cover (one more to either side), and each pair is taken in one of the cells that both cover, the
last in all dimensions. A task gets a block with at most PARTNERS others to compare it with. What is left of a pair is
split recursively into half sequences, leaving out halves that are provably distant. Halves that are provably near, as
all their vectors lie within a ball that is small enough, are linked without comparing. At the other leaves cosines are
computed exactly in double precision.
Copies of a vector are one row with a weight. Counts of links are sums over blocks and only spanning forests of
links leave a task, so no task writes all pairs.

Edge cases: null or empty vectors, zero vectors and those with null or non-finite components link with nothing,
have n_links 0 and are kept; vectors of differing lengths are never linked; repeated rows of one id are that many
copies (of differing vectors, the id has the links of all of them together in component_id, and the most of one in n_links);
a cosine of exactly the least is a link, as far as double precision tells; rows without id take no part in links and are kept; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_COSINE = 0.95
#: Leading principal dimensions of the grid, and rows of a deterministic sample that finds them. Any directions
#: give the same links; these only decide how much is skipped.
DIMENSIONS, SAMPLE = 6, 4096
#: Vectors in a block, and in a leaf of the recursive join.
BLOCK, LEAF = 4096, 256
#: Grid dimensions by which blocks meet, and blocks that a task compares with one block.
JOINED, PARTNERS = 3, 8


def usable(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each length of the vectors that are not empty and have finite components only, in double precision."""
    if pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    flat = column.flatten()
    bad = pc.is_null(flat).to_numpy(zero_copy_only=False) if flat.null_count else np.zeros(len(flat), bool)
    x = np.asarray((pc.fill_null(flat, 0) if flat.null_count else flat).to_numpy(zero_copy_only=False), np.float64)
    bad = bad | ~np.isfinite(x)
    end = np.cumsum(size)
    wrong = np.concatenate([[0], np.cumsum(bad)])
    good = (size > 0) & (wrong[end] == wrong[end - size])
    for n in np.unique(size[good]).tolist():
        at = np.flatnonzero(good & (size == n))
        yield at, x[(end[at] - n)[:, None] + np.arange(n)[None, :]]


def packed(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    return pa.array([r.tobytes() for r in x], pa.binary())


def _usable_rows(kind: str):
    """(id, v): ids and packed components, in their own precision, of the vectors that can have links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for at, x in usable(batch.column(1)):
                some = known[at] & x.any(1)
                if some.any():
                    yield pa.record_batch([batch.column(0).take(pa.array(at[some])), packed(x[some].astype(kind))], ["id", "v"])

    return run


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; by the largest component first, so squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal(sample: list[bytes], dims: int, kind: str = "f8") -> np.ndarray:
    """Orthonormal leading directions (dim x dims) of the sample's most frequent length."""
    rows = [np.frombuffer(x, kind) for x in sample]
    size = max({len(x) for x in rows}, key=lambda n: (sum(len(x) == n for x in rows), n))
    x = unit(np.stack([r for r in rows if len(r) == size]))
    _, vectors = np.linalg.eigh(np.cov(x.T) if len(x) > 1 else np.eye(size))
    return np.ascontiguousarray(np.atleast_2d(vectors)[:, ::-1][:, :dims])


def _blocks(turn: np.ndarray, epsilon: float, size: int, kind: str):
    """Cuts a partition, sorted by cell, into blocks with their boxes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pack(t: pa.Table) -> pa.RecordBatch:
            v = t["v"].to_pylist()
            x = unit(np.stack([np.frombuffer(a, kind) for a in v]))
            y = x @ turn if x.shape[1] == turn.shape[0] else np.zeros((len(x), turn.shape[1]))
            low, high = y.min(0), y.max(0)
            ids = t["id"].to_numpy()
            name = int(common.mix64(ids[:1].view(np.uint64) ^ np.uint64(crc32(v[0]) << 32))[0].view(np.int64))
            return pa.record_batch([[name], [x.shape[1]], [np.floor(low / epsilon).astype(int).tolist()], [np.floor(high / epsilon).astype(int).tolist()], [low.tolist()], [high.tolist()], [ids.tobytes()], [t["w"].to_numpy().tobytes()], pa.array([b"".join(v)], pa.binary())], schema=_PACKED)

        def cut_up(t: pa.Table, last: bool) -> Iterator[pa.Table]:
            lens = np.array([len(a) for a in t["v"].to_pylist()])
            at = 0
            while at < t.num_rows:
                end = min(at + size, t.num_rows)
                same = np.flatnonzero(lens[at:end] != lens[at])
                whole = len(same) or end - at == size
                if not (whole or last):
                    break
                end = at + int(same[0]) if len(same) else end
                yield t.slice(at, end - at)
                at = end
            rest[:] = [t.slice(at)] if at < t.num_rows else []

        rest: list[pa.Table] = []
        for batch in batches:
            if batch.num_rows:
                for block in cut_up(pa.concat_tables([*rest, pa.Table.from_batches([batch])]), False):
                    yield pack(block)
        if rest:
            for block in cut_up(rest[0], True):
                yield pack(block)

    return run


_PACKED = pa.schema([("name", pa.int64()), ("dim", pa.int32()), ("c0", pa.list_(pa.int32())), ("c1", pa.list_(pa.int32())), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("ids", pa.binary()), ("w", pa.binary()), ("x", pa.binary())])
_PACKED_SQL = "name long, dim int, c0 array<int>, c1 array<int>, low array<double>, high array<double>, ids binary, w binary, x binary"


def _cells(turn: np.ndarray, epsilon: float, kind: str):
    """(id, w, v, dim, cell) with the grid cell of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            dim = np.array([len(a) for a in rows], np.int64) // np.dtype(kind).itemsize
            cells = np.zeros((len(rows), turn.shape[1]), np.int32)
            at = np.flatnonzero(dim == turn.shape[0])
            if len(at):
                x = unit(np.frombuffer(b"".join(rows[k] for k in at.tolist()), kind).reshape(len(at), -1))
                cells[at] = np.floor(x @ turn / epsilon)
            yield pa.record_batch([*batch.columns, pa.array(dim.astype(np.int32)), pa.array(list(cells), pa.list_(pa.int32()))], ["id", "w", "v", "dim", "cell"])

    return run


def ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    """A point and the largest distance of a row from it."""
    c = x.mean(0)
    return c, float(np.sqrt((((x - c) ** 2).sum(1)).max()))


def leaf_pairs(a: np.ndarray, b: np.ndarray, ya: np.ndarray, yb: np.ndarray, epsilon: float, same: bool) -> Iterator[tuple[int, int, int, int]]:
    """Pairs of runs (a0, a1, b0, b1) of at most LEAF rows each that aren't provably distant, by recursive halving."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if same and b1 <= a0:
            continue
        gap = np.maximum(0, np.maximum(ya[a0:a1].min(0) - yb[b0:b1].max(0), yb[b0:b1].min(0) - ya[a0:a1].max(0)))
        if gap @ gap > epsilon * epsilon + 1e-9:
            continue
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            yield a0, a1, b0, b1
        elif a1 - a0 >= b1 - b0:
            m = (a0 + a1) // 2
            todo += [(a0, m, b0, b1), (m, a1, b0, b1)]
        else:
            m = (b0 + b1) // 2
            todo += [(a0, a1, b0, m), (a0, a1, m, b1)]


def _joined(turn: np.ndarray, epsilon: float, least: float, kind: str):
    """Rows sorted by block, turn and other: a block, then the blocks to compare it with; in its first turn with itself, too.

    Gives (a, b, n): b null and n links found for vector a, or a link (a, b) of a spanning forest.
    """

    def opened(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x = unit(np.frombuffer(r["x"], kind).reshape(-1, r["dim"]))
        y = x @ turn if x.shape[1] == turn.shape[0] else np.zeros((len(x), turn.shape[1]))
        return np.frombuffer(r["ids"], np.int64), np.frombuffer(r["w"], np.int64), x, y

    def compared(one: tuple, two: tuple, same: bool) -> Iterator[pa.RecordBatch]:
        (ids, w, x, y), (ids2, w2, x2, y2) = one, two
        n, n2 = np.zeros(len(ids), np.int64), np.zeros(len(ids2), np.int64)
        shift = 0 if same else len(ids)
        up = common.Forest(shift + len(ids2))
        edges: list[tuple[int, int]] = []
        for a0, a1, b0, b1 in leaf_pairs(x, x2, y, y2, epsilon, same):
            if not (same and a0 == b0):
                (c, r), (c2, r2) = ball(x[a0:a1]), ball(x2[b0:b1])
                if np.sqrt(((c - c2) ** 2).sum()) + r + r2 < epsilon - 1e-6:  # any two are nearer than epsilon
                    n[a0:a1] += w2[b0:b1].sum()
                    n2[b0:b1] += w[a0:a1].sum()
                    edges += [(a0, t) for t in range(b0, b1) if up.join(a0, shift + t)]
                    edges += [(s, b0) for s in range(a0, a1) if up.join(s, shift + b0)]
                    continue
            linked = x[a0:a1] @ x2[b0:b1].T >= least
            if same:
                linked &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :]
            if not linked.any():
                continue
            n[a0:a1] += linked @ w2[b0:b1]
            n2[b0:b1] += linked.T @ w[a0:a1]
            rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
            part = linked[np.ix_(rows, cols)]
            k = len(rows)
            around = np.zeros((k + len(cols), k + len(cols)), bool)
            around[:k, k:], around[k:, :k] = part, part.T
            for s, t in common.spanning(len(around), around):
                s, t = min(s, t), max(s, t)
                s, t = a0 + int(rows[s]), b0 + int(cols[t - k])
                if up.join(s, shift + t):
                    edges.append((s, t))
        for own, c in ((ids, n + n2),) if same else ((ids, n), (ids2, n2)):
            some = np.flatnonzero(c)
            if len(some):
                yield pa.record_batch([pa.array(own[some]), pa.nulls(len(some), pa.int64()), pa.array(c[some])], ["a", "b", "n"])
        if edges:
            yield pa.record_batch([pa.array(ids[[a for a, _ in edges]]), pa.array(ids2[[b for _, b in edges]]), pa.nulls(len(edges), pa.int64())], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                if r["other"] == 0:
                    mine = opened(r)
                    if r["turn"] == 0:
                        yield from compared(mine, mine, True)
                else:
                    yield from compared(mine, opened(r), False)

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least_cosine: float = LEAST_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors; see the module's text for the edge cases."""
    spark = common.prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    kind = "f4" if rows.schema["v"].dataType.elementType.typeName() == "float" else "f8"
    known = common.cut(rows.mapInArrow(_usable_rows(kind), "id long, v binary"))
    copies = known.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("c"))
    # Distinct vectors have a number of their own: one id may have several.
    reps = common.cut(copies.select(F.monotonically_increasing_id().alias("id"), F.col("c").alias("w"), "v", "rep"))
    sample = [r.v for r in common.bounded_sample(reps.select("id", "v"), "id", SAMPLE).collect()]
    turn = principal(sample, DIMENSIONS, kind) if sample else np.zeros((1, 1))
    epsilon = float(np.sqrt(2 - 2 * least_cosine))
    cells = reps.select("id", "w", "v").mapInArrow(_cells(turn, epsilon, kind), "id long, w long, v binary, dim int, cell array<int>")
    order = ["dim", "cell", "id"]
    # In one sequence over all partitions, each partition holds a run of it; blocks are cut within partitions.
    blocks = common.cut(cells.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "w", "v").mapInArrow(_blocks(turn, epsilon, BLOCK, kind), _PACKED_SQL))
    dims = range(min(JOINED, turn.shape[1]))

    def covered(df: DataFrame, more: int) -> DataFrame:
        """A row for each cell, in the leading dimensions, that a block covers, and `more` to either side."""
        for d in dims:
            df = df.withColumn(f"cell{d}", F.explode(F.sequence(F.get("c0", F.lit(d)) - more, F.get("c1", F.lit(d)) + more)))
        return df

    box = ["name", "dim", "c0", "low", "high"]
    near = covered(blocks.select(*box, "c1"), 0).drop("c1")
    wide = covered(blocks.select(*box, "c1"), 1).drop("c1").select("dim", *[f"cell{d}" for d in dims], *[F.col(c).alias(f"{c}2") for c in ("name", "c0", "low", "high")])
    gap = F.aggregate(F.zip_with(F.zip_with("low", "high2", lambda a, b: a - b), F.zip_with("low2", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0))), F.lit(0.0), lambda s, g: s + g * g)
    # Two blocks meet in every cell that both cover; the one with the smallest coordinates counts.
    once = [F.col(f"cell{d}") == F.greatest(F.get("c0", F.lit(d)), F.get("c02", F.lit(d)) - 1) for d in dims]
    pairs = near.join(wide, ["dim", *[f"cell{d}" for d in dims]]).where((F.col("name") < F.col("name2")) & (gap <= epsilon * epsilon + 1e-9) & reduce(and_, once)).select("name", "name2")
    pairs = common.cut(pairs)
    partners = pairs.groupBy("name").agg(F.count("*").alias("c"), F.ceil(F.count("*") / PARTNERS).cast("int").alias("turns"))
    packed_ = ["dim", "ids", "w", "x"]
    dealt = common.join_per_key(pairs, partners, ["name"], pairs.count()).select("name", "name2", F.pmod(F.xxhash64("name2"), F.col("turns")).cast("int").alias("turn"))
    others = dealt.join(blocks.select(F.col("name").alias("name2"), *packed_), "name2").select("name", "turn", F.lit(1).alias("other"), *packed_)
    turns = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("turns"), F.lit(1)) - 1)).alias("turn")
    own = blocks.select("name", *packed_).join(partners, "name", "left").select("name", turns, F.lit(0).alias("other"), *packed_)
    met = own.unionByName(others).repartition("name", "turn").sortWithinPartitions("name", "turn", "other").drop("name")
    found = common.cut(met.mapInArrow(_joined(turn, epsilon, least_cosine, kind), "a long, b long, n long"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    linked = reps.join(counts, "id", "left").select("v", "rep", F.col("w").alias("c"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"))
    members = common.cut(common.join_per_key(known, linked, ["v"], known.count()).select("id", "rep", "n"))
    named = reps.select("id", "rep")
    edges = found.where("b IS NOT NULL").select("a", "b").join(named.select(F.col("id").alias("a"), F.col("rep").alias("u")), "a").join(named.select(F.col("id").alias("b"), F.col("rep").alias("v")), "b")
    roots = common.components(edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(members.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))))
    linked = members.groupBy("id").agg(F.max("n").alias("n"))
    out = rows.select("id").join(linked, "id", "left").join(roots, "id", "left")
    root = F.coalesce("root", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(root == F.col("id"), F.lit(True)).alias("kept"))


def op10_gridjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "embeddings"))
