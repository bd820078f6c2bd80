"""Exact top-k by integer inner product over KD-trees.

Every vector becomes integers floor(scale * x). A coarse KD-tree over a bounded sample cuts space into at most CELLS cells;
the vectors of a cell are dealt to shards by a hash, and each shard is a KD-tree of its own: median splits (dimension of the
largest spread) with tight bounding boxes at all nodes. The bound of a box and a query is the sum over dimensions of the
larger of q * low and q * high.

Queries travel to shards, in two passes. In the first, each query searches one shard of the cell with its best bound; that
gives a first k-th score. In the second, it goes only to those other shards of cells whose bound, over the tight box of all
their vectors, isn't below that score. In a shard the traversal goes best first, and leaves out boxes whose bound is below
the k-th score, the propagated one or a better one found since. What a shard's search returns are candidates that
are not below that score, at most k a query. Shards meet their queries in groups of at most QUERIES on average, so no task
gets all queries or all shards.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without
id; vectors of another length than the query's are no candidates; a query never finds its own id, so repeated rows
of its id aren't candidates either, while repeated rows of another id are candidates each; where a query's id has
differing vectors, the shortest is asked, of equally long ones the one whose packed integers have the smallest bytes;
ties go to the smaller id; fewer candidates than k give fewer rows; an empty table gives an empty result. Scores beyond 64 bits are
clipped to the range of a long. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .gridjoin import packed, usable

SCALE = 256
TOP = 5
EVERY = 50
#: Vectors in a shard, queries that a task asks of a shard, vectors in a leaf.
SHARD, QUERIES, LEAF = 8192, 512, 256
#: Cells of the coarse tree, and rows of a deterministic sample that finds them. Any cells give the same result; these only
#: decide how much is skipped.
CELLS, SAMPLE = 256, 8192
#: Products are summed exactly in doubles below this; larger vectors go by Python integers.
_EXACT = 2.0**52
_LONG = (1 << 63) - 1


def _integers(scale: int):
    """(id, dim, v): the integers of the vectors that take part, as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for at, x in usable(batch.column(1)):
                at, x = at[known[at]], x[known[at]]
                if len(at):
                    yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), x.shape[1]), pa.int32()), packed(np.floor(x * scale) + 0.0)], ["id", "dim", "v"])

    return run


class Tree:
    """KD-tree over the rows of x: `order` lists rows leaf by leaf; nodes carry boxes."""

    def __init__(self, x: np.ndarray, leaf: int) -> None:
        self.order = np.arange(len(x))
        self.run: list[tuple[int, int]] = []
        self.kids: list[tuple[int, int] | None] = []
        boxes: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [(0, len(x), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = x[self.order[a:b]]
            low, high = own.min(0), own.max(0)
            me = len(self.run)
            self.run.append((a, b))
            self.kids.append(None)
            boxes.append((low, high))
            if parent >= 0:
                left, right = self.kids[parent] or (-1, -1)
                self.kids[parent] = (me, right) if side == 0 else (left, me)
            if b - a > leaf and (high > low).any():
                axis = int(np.argmax(high - low))
                m = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], m)]
                todo += [(a + m, b, me, 1), (a, a + m, me, 0)]
        self.low, self.high = np.stack([p for p, _ in boxes]), np.stack([q for _, q in boxes])


def merge_best(score: np.ndarray, ids: np.ndarray, new_score: np.ndarray, new_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of both lists for each row: by score, ties by the smaller id."""
    s, i = np.concatenate([score, new_score], 1), np.concatenate([ids, new_ids], 1)
    at = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, at, 1), np.take_along_axis(i, at, 1)


def search(tree: Tree, x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, score: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Takes the shard's candidates into (score, found), each query's k best so far (-inf where there are fewer)."""
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    bound = plus @ tree.high.T + minus @ tree.low.T  # queries x nodes
    leaves = np.array([n for n, kids in enumerate(tree.kids) if kids is None])
    # Best first for all queries at once: in round r each query opens its r-th best leaf, if its bound still allows;
    # queries with the same leaf share one product. Inner nodes cut whole branches before.
    alive = np.zeros((len(q), len(tree.kids)), bool)
    alive[:, 0] = True
    for n, kids in enumerate(tree.kids):
        if kids is not None:
            go = alive[:, n] & (bound[:, n] >= score[:, -1])
            alive[:, kids[0]], alive[:, kids[1]] = go, go
    reach = np.where(alive[:, leaves], bound[:, leaves], -np.inf)
    order = np.argsort(-reach, axis=1, kind="stable")
    rows = np.arange(len(q))
    for r in range(len(leaves)):
        at = order[:, r]
        b = reach[rows, at]
        active = np.isfinite(b) & (b >= score[:, -1])
        if not active.any():
            break  # bounds only fall and the k-th scores only rise
        for leaf in np.unique(at[active]).tolist():
            own = np.flatnonzero(active & (at == leaf))
            a, e = tree.run[leaves[leaf]]
            member = tree.order[a:e]
            s = q[own] @ x[member].T
            s[q_ids[own][:, None] == ids[member][None, :]] = -np.inf
            near = np.broadcast_to(ids[member], s.shape)
            if s.shape[1] > 4 * k:
                top = np.partition(s, -k, axis=1)[:, -k]
                width = int((s >= top[:, None]).sum(1).max())
                pick = np.argpartition(-s, min(width, s.shape[1] - 1), axis=1)[:, :width] if width < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)
                s, near = np.take_along_axis(s, pick, 1), np.take_along_axis(near, pick, 1)
            score[own], found[own] = merge_best(score[own], found[own], s, near, k)
    return score, found


def _exhaustive(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The same by Python integers, for vectors too large for doubles."""
    out = []
    rows = [[int(c) for c in v] for v in x]
    for i, v in zip(q_ids.tolist(), q):
        v = [int(c) for c in v]
        best = sorted((max(-_LONG - 1, min(_LONG, sum(a * b for a, b in zip(v, w)))) * -1, j) for j, w in zip(ids.tolist(), rows) if j != i)[:k]
        out += [(i, j, -s) for s, j in best]
    return out


class Cells:
    """The coarse tree: where a vector lies, by splits alone, so that it is defined for all vectors of the dimension."""

    def __init__(self, x: np.ndarray, most: int) -> None:
        tree = Tree(x, max(1, -(-len(x) // most)))
        self.kids, self.n = tree.kids, 0
        self.axis, self.cut, self.cell = [-1] * len(tree.kids), [0.0] * len(tree.kids), [-1] * len(tree.kids)
        for n, kids in enumerate(tree.kids):
            if kids is None:
                self.cell[n], self.n = self.n, self.n + 1
            else:
                self.axis[n] = int(np.argmax(tree.high[n] - tree.low[n]))
                a, b = tree.run[kids[1]]
                self.cut[n] = float(x[tree.order[a:b], self.axis[n]].min())

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            n, at = todo.pop()
            kids = self.kids[n]
            if kids is None:
                out[at] = self.cell[n]
            elif len(at):
                right = x[at, self.axis[n]] >= self.cut[n]
                todo += [(kids[0], at[~right]), (kids[1], at[right])]
        return out


def _in_cells(cells: dict[int, Cells]):
    """(id, dim, v, cell); vectors of dimensions without cells are in cell 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, rows = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            cell = np.zeros(len(rows), np.int32)
            for d in np.unique(dim).tolist():
                if d in cells:
                    at = np.flatnonzero(dim == d)
                    cell[at] = cells[d].of(np.frombuffer(b"".join(rows[k] for k in at.tolist())).reshape(len(at), d))
            yield pa.record_batch([*batch.columns, pa.array(cell)], ["id", "dim", "v", "cell"])

    return run


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, cell, low, high) of the vectors of a partition: a row for each cell."""
    low: dict[tuple[int, int], np.ndarray] = {}
    high: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        dim, cell, rows = batch.column(1).to_numpy(), batch.column(3).to_numpy(), batch.column(2).to_pylist()
        for d, c in set(zip(dim.tolist(), cell.tolist())):
            x = np.frombuffer(b"".join(rows[k] for k in np.flatnonzero((dim == d) & (cell == c)).tolist())).reshape(-1, d)
            a, b = x.min(0), x.max(0)
            low[d, c], high[d, c] = (np.minimum(low[d, c], a), np.maximum(high[d, c], b)) if (d, c) in low else (a, b)
    keys = list(low)
    yield pa.record_batch([pa.array([d for d, _ in keys], pa.int32()), pa.array([c for _, c in keys], pa.int32()), pa.array([low[k].tolist() for k in keys], pa.list_(pa.float64())), pa.array([high[k].tolist() for k in keys], pa.list_(pa.float64()))], ["dim", "cell", "low", "high"])


def _cell_bounds(boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], first: bool):
    """Rows (id, dim, v, kth): with the cell of the best bound, or each cell whose bound isn't below kth."""
    by_dim = {d: [c for e, c in sorted(boxes) if e == d] for d, _ in boxes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, rows = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            kth = batch.column(3).to_numpy()
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                q = np.frombuffer(b"".join(rows[k] for k in at.tolist())).reshape(len(at), d)
                own = by_dim[d]
                low, high = np.stack([boxes[d, c][0] for c in own]), np.stack([boxes[d, c][1] for c in own])
                bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                rounded = max(np.abs(low).max(), np.abs(high).max()) * np.abs(q).max() * d >= _EXACT  # such bounds prove nothing
                take = bound.argmax(1)[:, None] == np.arange(len(own))[None, :] if first else (bound >= kth[at][:, None]) | rounded
                r, c = np.nonzero(take)
                if len(r):
                    yield pa.record_batch([batch.column(k).take(pa.array(at[r])) for k in range(4)] + [pa.array(np.array(own, np.int32)[c])], ["id", "dim", "v", "kth", "cell"])

    return run


def _searched(k: int, leaf: int):
    """Rows sorted by shard and part, the shard's packed vectors first, then queries: (query, vec, score) of the candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, bounds in common.whole_groups(batches, ["dim", "cell", "shard", "part"]):
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                rows = g.slice(a, b - a)
                if rows["ids"][0].as_py() is None or b - a < 2:
                    continue
                d = rows["dim"][0].as_py()
                x, ids = np.frombuffer(rows["v"][0].as_py()).reshape(-1, d), np.frombuffer(rows["ids"][0].as_py(), np.int64)
                q, q_ids, kth = np.frombuffer(b"".join(rows["v"][1:].to_pylist())).reshape(-1, d), rows["id"][1:].to_numpy(), rows["kth"][1:].to_numpy()
                if np.abs(x).max() * np.abs(q).max() * d < _EXACT:
                    # The propagated k-th score is a score that k others have: it may be met again, but not undercut.
                    score, found = np.repeat(np.nextafter(kth, -np.inf)[:, None], k, 1), np.full((len(q), k), -1, np.int64)
                    seeded = found.copy()
                    score, found = search(Tree(x, leaf), x, ids, q, q_ids, score, seeded, k)
                    r, c = np.nonzero((found >= 0) & np.isfinite(score))
                    out = (q_ids[r], found[r, c], score[r, c].astype(np.int64))
                else:
                    out = tuple(np.array(z, np.int64) for z in zip(*_exhaustive(x, ids, q, q_ids, k))) or (np.zeros(0, np.int64),) * 3
                if len(out[0]):
                    yield pa.record_batch([pa.array(z) for z in out], ["query_id", "vec_id", "score"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shard: its ids and vectors."""
    for g in common.sorted_groups(batches, ["dim", "cell", "shard"]):
        yield pa.record_batch([*[g[c].slice(0, 1).combine_chunks() for c in ("dim", "cell", "shard")], pa.array([g["id"].to_numpy().tobytes()], pa.binary()), pa.array([b"".join(g["v"].to_pylist())], pa.binary())], ["dim", "cell", "shard", "ids", "v"])


def top_k(vectors: DataFrame, k: int = TOP, every: int = EVERY, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each row whose id `every` divides."""
    common.prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col))
    ints = common.cut(rows.mapInArrow(_integers(scale), "id long, dim int, v binary"))
    n = ints.count()
    most = max(1, min(CELLS, n // SHARD))
    sample = common.bounded_sample(ints, "id", SAMPLE).collect() if most > 1 else []
    of_dim = {d: np.stack([np.frombuffer(r.v) for r in sample if r.dim == d]) for d in {r.dim for r in sample}}
    placed = common.cut(ints.mapInArrow(_in_cells({d: Cells(x, most) for d, x in of_dim.items()}), "id long, dim int, v binary, cell int")) if of_dim else ints.withColumn("cell", F.lit(0))
    boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    sides = placed.mapInArrow(_boxes, "dim int, cell int, low array<double>, high array<double>").select("dim", "cell", F.posexplode(F.arrays_zip("low", "high")).alias("at", "x"))
    # As many numbers as cells have dimensions reach the driver, however many tasks there are.
    for r in sides.groupBy("dim", "cell", "at").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high")).collect():
        low, high = boxes.setdefault((r.dim, r.cell), (np.zeros(r.dim), np.zeros(r.dim)))
        low[r.at], high[r.at] = r.low, r.high
    if not boxes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    in_cell = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    keys = ["dim", "cell", "shard"]
    dealt = placed.join(F.broadcast(in_cell), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.col("shards")).cast("int"))
    shards = common.cut(dealt.select(*keys, "id", "v").repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(_packed, "dim int, cell int, shard int, ids binary, v binary"))
    asked = ints.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("q")).select("id", "q.dim", "q.v")

    def searched(asked: DataFrame) -> DataFrame:
        """(query_id, vec_id, score) of asked(id, dim, v, kth, cell, shard)."""
        parts = asked.groupBy(*keys).agg(F.count("*").alias("c")).withColumn("parts", F.ceil(F.col("c") / QUERIES).cast("int"))
        sent = common.join_per_key(asked, parts, keys, asked.count()).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        own = shards.join(parts, keys).select(*keys, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("kth"), "ids", "v")
        met = own.unionByName(sent.select(*keys, "part", "id", "kth", F.lit(None).cast("binary").alias("ids"), "v"))
        met = met.repartition(*keys, "part").sortWithinPartitions(*keys, "part", F.col("id").asc_nulls_first())
        return common.cut(met.mapInArrow(_searched(k, LEAF), "query_id long, vec_id long, score long"))

    bounded = "id long, dim int, v binary, kth double, cell int"
    least = F.lit(float("-inf")).alias("kth")
    home = asked.select("id", "dim", "v", least).mapInArrow(_cell_bounds(boxes, True), bounded).join(F.broadcast(in_cell), ["dim", "cell"])
    home = common.cut(home.select("id", "dim", "v", "kth", "cell", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int").alias("shard")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = searched(home)
    if n <= SHARD:
        # No more than one shard of any dimension.
        return first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    kth = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("kth"))
    # A long that a double doesn't hold is rounded; the next smaller one is no more than it.
    kth = kth.withColumn("kth", F.col("kth") - F.abs("kth") * 1e-15)
    again = asked.join(kth, "id", "left").select("id", "dim", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
    reached = again.mapInArrow(_cell_bounds(boxes, False), bounded).join(F.broadcast(in_cell), ["dim", "cell"])
    reached = reached.select("id", "dim", "v", "kth", "cell", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    rest = common.cut(reached.join(home.select("id", *keys), ["id", *keys], "left_anti"))
    found = first.unionByName(searched(rest))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.read(spark, sf_dir, "embeddings"))


#: The contract's result by brute force.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
           FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
