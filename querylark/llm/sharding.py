"""Size-tiered compaction of immutable shards under a versioned manifest. DataFrame operations only.

Layout under a root folder in any store that Spark's file systems reach:

    data/<token>/part-*.parquet      a run: immutable shards that one write made; nobody sees them before a manifest names the run
    pending/<token>                  a lease: its writer has begun the run and may still commit it
    manifest/v00000001.json          one file for each version: every live run with its bytes, number of shards and origin

An append writes the arriving rows as a run of small shards (of about ARRIVAL bytes), without a shuffle, and commits a manifest
that names it besides the runs of the version before. Compaction groups runs by tiers of their shards' mean size (within a
factor of FANOUT); a tier with FANOUT shards or more is merged into files of about the target size by reading it with
fewer partitions (no shuffle: shards of a tier are of similar size), and all merges of a pass are committed as one version. Runs
whose shards have about the target size are never written again. A manifest has an entry a run, not a file.

Writers need no lock. A commit renames a finished file to the next version's name and fails if that name is taken. The writer
then takes the new version and tries again: an append adds its run to it; a compaction gives up if another one has
replaced a run that it merged. No reader sees half a version.

vacuum() deletes runs that none of the newest versions name. It lists runs first, then leases, then manifests; since a writer
takes its lease before it writes and gives it back after its commit, a run that is being written or committed meanwhile has
a lease in that list or is named by a manifest, and stays. A lease lapses after `grace` seconds; its writer commits only within
half of that, so a lost driver's run is deleted some time and a slow writer's commit is refused, never left dangling.
A lost executor's tasks are repeated by Spark's commit protocol.

Edge cases: an empty arrival commits a version without new shards; nulls, repeated rows, long texts and any columns
are stored as they are; all arrivals have the columns of the first, in any order; a column name may not occur twice.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of a file that compaction aims at, shards of a tier that make it due, bytes up to which shards are tier 0.
TARGET = 128 << 20
FANOUT = 4
TIER_0 = 256 << 10
#: Bytes that an arriving shard may have, about, before compression.
ARRIVAL = 8 << 20
#: Seconds for which a lease holds.
GRACE = 24 * 3600.0


@dataclass(frozen=True)
class Run:
    token: str
    bytes: int
    shards: int
    merged: bool  # written by a compaction

    @property
    def path(self) -> str:
        return f"data/{self.token}"


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Lapsed(RuntimeError):
    """The lease of a run has lapsed or its files are gone; nothing was committed."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fanout: int = FANOUT, tier_0: int = TIER_0, grace: float = GRACE) -> None:
        self.spark, self.root, self.target, self.fanout, self.tier_0, self.grace = spark, root.rstrip("/"), target, fanout, tier_0, grace
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path().getFileSystem(self._conf)

    def _path(self, below: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}" if below else self.root)

    def _listed(self, below: str) -> list[tuple[str, int]]:
        """(name, bytes) of the files in a folder; none if there is no such folder."""
        path = self._path(below)
        return sorted((s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def version(self) -> int:
        return max((int(n[1:9]) for n, _ in self._listed("manifest") if n.startswith("v")), default=0)

    def runs(self, version: int | None = None) -> list[Run]:
        version = self.version() if version is None else version
        return [Run(**x) for x in self._manifest(version)["runs"]] if version else []

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"manifest/v{version:08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, before: int, runs: list[Run], schema: str | None, fresh: tuple[Run, ...] = ()) -> int:
        """Commits version before + 1; `fresh` are the runs that it names first."""
        for run in fresh:
            lease = self._path(f"pending/{run.token}")
            if not self._fs.exists(lease) or time.time() - self._fs.getFileStatus(lease).getModificationTime() / 1000 > self.grace / 2 or not self._fs.exists(self._path(run.path)):
                raise Lapsed(f"run {run.token} was not committed in time")
        after, temp = before + 1, self._path(f"manifest/.{uuid.uuid4().hex}")
        stream = self._fs.create(temp, False)
        stream.write(json.dumps({"version": after, "schema": schema, "runs": [asdict(r) for r in runs]}).encode())
        stream.close()
        final = self._path(f"manifest/v{after:08d}.json")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri() if final.toUri().getScheme() else self._fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(temp, final, options)  # never overwrites
        except Exception as e:
            self._fs.delete(temp, False)
            if self._fs.exists(final):
                raise Conflict(f"version {after} exists") from e
            raise
        return after

    def _commit_on_newest(self, change: Callable[[list[Run]], list[Run] | None], schema: str | None, fresh: tuple[Run, ...]) -> int | None:
        """Commits change(runs of the newest version), again on a newer one as long as other writers are faster; None if change gives up."""
        while True:
            before = self.version()
            runs = change(self.runs(before))
            if runs is None:
                return None
            try:
                return self._commit(before, runs, schema or self._schema(before), fresh)
            except Conflict:
                continue

    def _schema(self, version: int) -> str | None:
        return self._manifest(version)["schema"] if version else None

    def _write(self, df: DataFrame, merged: bool) -> Run:
        """Writes a run under a lease, which stays until _release()."""
        token = uuid.uuid4().hex
        self._fs.create(self._path(f"pending/{token}"), False).close()
        df.write.parquet(f"{self.root}/data/{token}")
        sizes = [size for n, size in self._listed(f"data/{token}") if n.endswith(".parquet")]
        if len(sizes) == 1 and self.spark.read.schema(df.schema).parquet(f"{self.root}/data/{token}").isEmpty():
            sizes = []  # Spark writes one file for no rows; the run is never named
        return Run(token, sum(sizes), len(sizes), merged)

    def _release(self, *runs: Run) -> None:
        for run in runs:
            self._fs.delete(self._path(f"pending/{run.token}"), False)

    def append(self, df: DataFrame, shard_bytes: int = ARRIVAL) -> int:
        """Commits the rows of df as a run of small shards; the new version."""
        before = self.version()
        schema = self._schema(before) or df.schema.json()
        columns = [c["name"] for c in json.loads(schema)["fields"]]
        # Shards are input splits of about this size: the rows stay where they are read.
        name = "spark.sql.files.maxPartitionBytes"
        old = self.spark.conf.get(name)
        self.spark.conf.set(name, str(shard_bytes))
        try:
            run = self._write(df.select(*columns), False)
        finally:
            self.spark.conf.set(name, old)
        try:
            return self._commit_on_newest(lambda runs: [*runs, run] if run.shards else runs, schema, (run,))
        finally:
            self._release(run)

    def tiers(self, runs: list[Run]) -> list[list[Run]]:
        """Runs that aren't settled, by the mean size of their shards: those of a tier differ by a factor of `fanout` at most; sizes up to tier_0 count as that."""
        out: list[list[Run]] = []
        size = lambda r: max(self.tier_0, r.bytes / max(1, r.shards))
        for r in sorted((r for r in runs if not self.settled(r)), key=size):
            if not out or size(r) > self.fanout * size(out[-1][0]):
                out.append([])
            out[-1].append(r)
        return out

    def settled(self, run: Run) -> bool:
        """Whether a run's shards are so large that no compaction touches them."""
        return run.bytes >= run.shards * self.target / 2

    def compact(self) -> int:
        """Merges all tiers that are due, smallest first, and commits once; the version then (the old one, if none is due)."""
        before = self.version()
        live = self.runs(before)
        fresh: list[Run] = []
        while True:
            own = next((t for t in self.tiers(live) if self.fanout <= sum(r.shards for r in t) > self._files(t)), None)
            if own is None:
                break
            merged = self._write(self._read([r.path for r in own], before).coalesce(self._files(own)), True)
            live = [r for r in live if r not in own] + [merged]
            fresh.append(merged)
        if not fresh:
            return before
        kept = tuple(r for r in fresh if r in live)  # a run that a later merge of this pass took in is never named
        gone = set(self.runs(before)) - set(live)
        try:
            done = self._commit_on_newest(lambda runs: [r for r in runs if r not in gone] + list(kept) if gone <= set(runs) else None, None, kept)
        finally:
            self._release(*fresh)
        return self.version() if done is None else done

    def _files(self, runs: list[Run]) -> int:
        return max(1, round(sum(r.bytes for r in runs) / self.target))

    def _read(self, paths: list[str], version: int) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(self._schema(version)))
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the newest, if none is named)."""
        version = self.version() if version is None else version
        if not version:
            raise ValueError("nothing has been committed")
        return self._read([r.path for r in self.runs(version)], version)

    def vacuum(self, keep_versions: int = 1) -> int:
        """Deletes runs that none of the newest versions name and no writer has a lease for, and older manifests; how many runs went."""
        tokens = [token for token, _ in self._listed("data")]
        leased = {token for token, _ in self._listed("pending") if time.time() - self._fs.getFileStatus(self._path(f"pending/{token}")).getModificationTime() / 1000 <= self.grace}
        newest = self.version()
        named = {r.token for v in range(max(1, newest - keep_versions + 1), newest + 1) for r in self.runs(v)}
        dead = [t for t in tokens if t not in leased and t not in named]
        for token in dead:
            self._fs.delete(self._path(f"pending/{token}"), False)
            self._fs.delete(self._path(f"data/{token}"), True)
        for name, _ in self._listed("manifest"):
            if name.startswith("v") and int(name[1:9]) <= newest - keep_versions:
                self._fs.delete(self._path(f"manifest/{name}"), False)
        return len(dead)


#: Arrivals that the query deals the documents to.
ARRIVALS = 4


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the compacted snapshot holds it, with what the store knows of it.

    (doc_id, lang, source, n_chars, text_md5, version, merged, arrivals): the version read, whether a compaction wrote the row's shard, and
    the runs of arrivals that the version still names. The documents come in ARRIVALS appends, dealt by doc_id.
    """
    docs = common.read(spark, sf_dir, "documents")
    store = ShardStore(spark, f"{common.shared_dir(spark)}/op9-{uuid.uuid4().hex}")
    for k in range(ARRIVALS):
        store.append(docs.where(F.coalesce(F.pmod(F.col("doc_id"), F.lit(ARRIVALS)), F.lit(0)) == k))
    version = store.compact()
    store.vacuum()
    runs = store.runs(version)
    written = F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9a-f]+)/", 1).isin([r.token for r in runs if r.merged])
    rows = store.read(version).select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"), written.alias("merged"))
    return rows.withColumns({"version": F.lit(version), "arrivals": F.lit(sum(not r.merged for r in runs))})


#: The documents, after as many versions as arrivals and one compaction, which has merged all of them.
SQL = f"SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5, true AS merged, {ARRIVALS + 1} AS version, 0 AS arrivals FROM documents"
