"""Best-fit packing of documents into token budgets, with conflicts.

Documents are dealt by a hash to packing shards of about SHARD items. In a shard, items come longest first; bins
are kept ordered by residual room and carry bitmaps of the sources and duplicate clusters that they hold. From the
smallest residual that fits, the search goes on to the next larger one until a bin has neither the item's source
nor its cluster; that is the tightest compatible bin, else a new one is opened. A text of more tokens than a bin
holds is cut into parts of full bins and one remainder; a full bin holds nothing else.

A token is a word (run of characters that aren't ASCII white space). The cluster is the hash of the words in their
order, or a given column. Only ids, hashes and counts are shuffled, never texts.

Edge cases: null, empty and blank texts have no tokens: one row with part 0 and no bin; a null source conflicts
with nothing; rows without doc_id are packed like others; repeated rows are packed once each and, being of one
cluster, never in one bin; ties are ordered by cluster, doc_id and part; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Tokens in a bin, and items in a packing shard on average.
CAPACITY = 2048
SHARD = 4096
_SCHEMA = "doc_id long, part int, bin_id long, start int, n_tokens int"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = common.utf8(batch.column(1))
        counts, clusters = [], []
        for i, j in common.slices(at):
            h, text, _, _ = common.words(data, at, i, j)
            count = np.bincount(text, minlength=j - i)
            begin = np.concatenate([[0], np.cumsum(count)])
            place = np.arange(len(h)) - begin[text]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix64(h + common.mix64(place)), dtype=np.uint64)])
            counts.append(count)
            clusters.append((total[begin[1:]] - total[begin[:-1]]).view(np.int64))
        if counts:
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(counts).astype(np.int64)), pa.array(np.concatenate(clusters)), batch.column(2)], ["id", "n", "cluster", "source"])


def best_fit(sizes: list[int], sources: list[int | None], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, start) for each item, taken in the given order. Sources and clusters may be any hashable names."""
    source_bit: dict[int, int] = {}
    cluster_bit: dict[int, int] = {}
    rooms: list[tuple[int, int]] = []  # (residual, bin), ordered
    held: list[list[int]] = []  # source and cluster bitmaps of each bin
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        c = 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        at = bisect_left(rooms, (size, -1))
        while at < len(rooms) and (held[rooms[at][1]][0] & s or held[rooms[at][1]][1] & c):
            at += 1
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(held)
            held.append([0, 0])
        held[b][0] |= s
        held[b][1] |= c
        out.append((b, capacity - room))
        insort(rooms, (room - size, b))
    return out


def _packed(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in common.sorted_groups(batches, ["shard"]):
            shard = g["shard"][0].as_py()
            n, part = g["rest"].to_numpy(), g["n"].to_numpy() // capacity
            ids, sources, clusters = g["id"].to_pylist(), g["source"].to_pylist(), g["cluster"].to_pylist()
            some = np.flatnonzero(n)
            placed = best_fit(n[some].tolist(), [sources[k] for k in some], [clusters[k] for k in some], capacity)
            rows = [(ids[k], int(part[k]), b, at, int(n[k])) for k, (b, at) in zip(some.tolist(), placed)]
            bins = 1 + max((b for b, _ in placed), default=-1)
            for k in range(len(ids)):
                for p in range(int(part[k])):
                    rows.append((ids[k], p, bins, 0, capacity))
                    bins += 1
            cols = list(zip(*rows))
            first = shard << 32
            if rows:
                yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array([first + b for b in cols[2]], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32())], ["doc_id", "part", "bin_id", "start", "n_tokens"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, cluster_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, part, bin_id, start, n_tokens): where each part of each document lies; bins never exceed capacity."""
    common.prepare(docs.sparkSession)
    given = [F.xxhash64(cluster_col).alias("given")] if cluster_col else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(F.col(source_col).cast("string").alias("s"), *given).alias("source"))
    items = rows.mapInArrow(_items, f"id long, n long, cluster long, source struct<s:string{', given:bigint' if given else ''}>")
    items = common.cut(items.select("id", "n", F.col("source.given").alias("cluster") if given else "cluster", F.when(F.col("source.s").isNotNull(), F.xxhash64("source.s")).alias("source")))
    shards = max(1, -(-items.count() // SHARD))
    rest = F.col("n") % capacity
    dealt = items.where("n > 0").select("id", "n", rest.alias("rest"), "cluster", "source", F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.rand(7))), F.lit(shards)).alias("shard"))
    packed = dealt.repartition("shard").sortWithinPartitions("shard", F.desc("rest"), "cluster", "id").mapInArrow(_packed(capacity), _SCHEMA)
    none = items.where("n = 0").select(F.col("id").alias("doc_id"), F.lit(0).alias("part"), F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("start"), F.lit(0).alias("n_tokens"))
    return packed.unionByName(none)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.read(spark, sf_dir, "documents"))
