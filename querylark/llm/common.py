"""Shared pieces: session settings, checkpoints, byte-level hashing of texts, connected components."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylark.shipping import ship

#: Most bytes of text that one numpy pass looks at (a longer single text is a pass of its own).
SLICE_BYTES = 1 << 21
#: A key with more than one in HOT of all rows is hot.
HOT = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by rows and bytes, and makes sure that checkpoint() has a shared folder."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local one in local mode, as in tests; on a cluster an error, since a machine's own folder would be lost with it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    return named or _local_dir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate data in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_LOCAL: list[str] = []


def _local_dir() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="querylark-checkpoint-"))
    return _LOCAL[0]


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and cuts its lineage; a lost executor loses nothing."""
    return df.checkpoint(eager=True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows, chosen by a hash of a column. What tasks send to the driver is bounded, too, however many there are."""
    total = df.count()
    few = df.where(F.pmod(F.xxhash64(key), F.lit(total)) < 2 * n) if total > 2 * n else df
    return few.orderBy(F.xxhash64(key), key).limit(n)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, a bijection of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Byte codes hashed after folding A-Z to a-z.
_BYTE_FOLDED = _BYTE[_FOLD]
_SEP = np.zeros(256, dtype=bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_POW: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * SLICE_BYTES:
            _POW[base] = have
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as the empty text."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts that hold up to `most` bytes together, or one text."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_runs(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[list[str]]:
    """The texts of a column in runs of about `most` characters; null counts as the empty text."""
    held: list[str] = []
    n = 0
    for t in column.to_pylist():
        held.append(t or "")
        n += len(held[-1])
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def words(data: np.ndarray, at: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes that are not ASCII white space, A-Z folded) of the texts i..j-1.

    Returns for each word its 64-bit hash, its text (from 0), its first byte and the byte behind it (in `data`).
    """
    lo, hi = int(at[i]), int(at[j])
    b = data[lo:hi]
    if not len(b):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    inside = ~_SEP[b]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = at[i + 1 : j] - lo
    bounds = bounds[bounds < len(b)]
    first[bounds] |= inside[bounds]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    inner = bounds[bounds > 0] - 1
    last[inner] |= inside[inner]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = _BYTE_FOLDED[b]
    total *= powers(_P, len(b))
    np.add.accumulate(total, out=total)
    h = total[end - 1].copy()
    h[start > 0] -= total[start[start > 0] - 1]
    h *= powers(_P_INV, len(b))[start]
    text = np.searchsorted(at[i : j + 1] - lo, start, side="right") - 1
    return mix64(h ^ (end - start).astype(np.uint64)), text, start + lo, end + lo


def shingles(h: np.ndarray, text: np.ndarray, n_texts: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of `width` words, sorted, for each text, and n_texts + 1 offsets.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    count = np.bincount(text, minlength=n_texts)
    begin = np.concatenate([[0], np.cumsum(count)])
    n = len(h)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled += h[k : n - width + 1 + k] * np.uint64(pow(_P, 2 * k + 1, 1 << 64)) if len(rolled) else rolled
    rolled = mix64(rolled)
    out, sizes = [], np.zeros(n_texts, np.int64)
    for t in range(n_texts):
        c, s = int(count[t]), int(begin[t])
        if c >= width:
            own = np.sort(rolled[s : s + c - width + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif c:
            own = mix64(np.array([sum(int(x) * pow(_P, 2 * k + 1, 1 << 64) for k, x in enumerate(h[s : s + c])) + c & (1 << 64) - 1], np.uint64))
        else:
            continue
        out.append(own)
        sizes[t] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of a partition sorted by `keys`; holds one group and one batch at a time."""
    held: list[pa.Table] = []
    mark = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        n = table.num_rows
        if not n:
            continue
        cols = [table[k].to_numpy() for k in keys]
        new = np.zeros(n, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = mark is not None and tuple(c[0] for c in cols) != mark
        at = [0, *np.flatnonzero(new).tolist(), n]
        for k in range(len(at) - 1):
            if (k or new[0]) and held:
                yield pa.concat_tables(held)
                held = []
            if at[k + 1] > at[k]:
                held.append(table.slice(at[k], at[k + 1] - at[k]))
        mark = tuple(c[-1] for c in cols)
    if held:
        yield pa.concat_tables(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of whole groups of a partition sorted by `keys`, and where each group begins (the end of the last one, too).

    Holds one batch, or one group where that is larger.
    """
    held: list[pa.RecordBatch] = []
    mark = None

    def out() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(table.num_rows, bool)
        for k in keys:
            c = table[k].to_numpy()
            new[1:] |= c[1:] != c[:-1]
        new[0] = True
        return table, np.append(np.flatnonzero(new), table.num_rows)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        new = np.zeros(n, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = mark is not None and tuple(c[0] for c in cols) != mark
        at = np.flatnonzero(new)
        if len(at):
            last = int(at[-1])
            if last:
                held.append(batch.slice(0, last))
            yield out()
            held = []
            batch = batch.slice(last)
        held.append(batch)
        mark = tuple(c[-1] for c in cols)
    if held:
        yield out()


class Forest:
    """Union-find over 0..n-1 with path halving; the smaller root wins."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def spanning(n: int, linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph with boolean adjacency `linked` (n x n), by breadth-first search."""
    left = np.ones(n, bool)
    out: list[tuple[int, int]] = []
    for s in range(n):
        if not left[s]:
            continue
        left[s] = False
        todo = [s]
        while todo:
            x = todo.pop()
            near = np.flatnonzero(linked[x] & left)
            left[near] = False
            out += [(x, int(y)) for y in near]
            todo += near.tolist()
    return out


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with per_key, which has one row a key and in c the number of rows with it, all in `total` or fewer.

    Keys with more than one in HOT of the rows are hot; there can't be more than HOT of them, so they are broadcast and
    their rows stay where they are. No task of the other join gets more than that share through one key. A filter tells
    the two kinds of rows apart, so that each row goes through one join, as it does where no key is hot.
    """
    set_ = [F.col(k).isNotNull() for k in keys]
    hot = per_key.where(reduce(and_, set_, F.col("c") * HOT > total))
    found = hot.collect()  # HOT rows at most
    if not found:
        return rows.join(per_key, keys)
    hot = rows.sparkSession.createDataFrame(found, hot.schema)
    parts = {k: [F.lit(r[k]).cast(rows.schema[k].dataType).alias(k) for r in found] for k in keys}
    is_hot = F.col(keys[0]).isin(parts[keys[0]])
    if len(keys) > 1:  # few rows get past the first key
        is_hot &= F.struct(*keys).isin([F.struct(*x) for x in zip(*parts.values())])
    return rows.where(~is_hot).join(per_key, keys).unionByName(rows.where(is_hot).join(F.broadcast(hot), keys))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in edges(a, b): the smallest id that it reaches.

    Alternates large-star and small-star steps until nothing changes; each step is joins and partial
    aggregates over edges, checkpointed, so no component has to fit in a task or the driver. The centre of a star,
    which has as many edges as its component has members, is a hot key of these joins (join_per_key).
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    n = e.count()
    while n:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        large = cut(join_per_key(both, least, ["u"], 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = join_per_key(large, least, ["u"], 2 * n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark, n = now, now[0]
    roots = e.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
