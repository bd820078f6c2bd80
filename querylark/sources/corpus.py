"""Where documents come from and where indexes, memories and models go. Paths are of any store that Spark reaches."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylark.operators.index import Index, dense_ids
from querylark.operators.vectors import Embedder


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, text) of all files below a folder, whole and of any name; ids from 1 in the order of paths; empty files don't count."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(F.length("text") > 0)
    ids = dense_ids(files.select("path"), "path", "i")
    return files.join(ids, "path").select((F.col("i") + 1).cast("long").alias("doc_id"), "path", "text")


def write_index(index: Index, path: str, files: int = 0) -> None:
    """Three tables; postings are sorted by term within range partitions, so a lookup reads few row groups. Vectors of an
    index that was there before are deleted."""
    remove(index.docs.sparkSession, f"{path}/vectors")
    remove(index.docs.sparkSession, f"{path}/model")
    posted = index.postings.repartitionByRange(files, "term") if files else index.postings.repartitionByRange("term")
    posted.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    index.docs.select("doc_id", "text").write.mode("overwrite").parquet(f"{path}/docs")
    index.docs.sparkSession.createDataFrame([(index.n, index.avgdl)], "n long, avgdl double").write.mode("overwrite").parquet(f"{path}/stats")


def read_index(spark: SparkSession, path: str) -> Index:
    r = spark.read.parquet(f"{path}/stats").first()
    return Index(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings").persist(StorageLevel.MEMORY_AND_DISK), r.n, r.avgdl)


def parts(spark: SparkSession, path: str) -> DataFrame:
    """(path, rows) of the files of an index's postings, as a manifest lists them."""
    return spark.read.parquet(f"{path}/postings").groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"))


def write_vectors(index: Index, path: str, hidden: int = 64, out: int = 32, seed: int = 42) -> None:
    """Embedded documents of an index, and what draws their model again."""
    Embedder.bootstrap(index, hidden, out, seed).documents(index).write.mode("overwrite").parquet(f"{path}/vectors")
    index.docs.sparkSession.createDataFrame([(hidden, out, seed)], "hidden int, out int, seed int").write.mode("overwrite").json(f"{path}/model")


def read_vectors(spark: SparkSession, path: str, index: Index) -> tuple[DataFrame, Embedder] | None:
    """(vec_id, embedding) of an index's documents, and what embeds queries; None where none were written."""
    if not exists(spark, f"{path}/model"):
        return None
    m = spark.read.schema("hidden int, out int, seed int").json(f"{path}/model").first()
    return spark.read.parquet(f"{path}/vectors"), Embedder.bootstrap(index, m.hidden, m.out, m.seed)


#: What a conversation remembers between calls: one row.
MEMORY = "last_entity string, last_property string"


def write_memory(spark: SparkSession, remembered: tuple[str | None, str | None], path: str) -> None:
    spark.createDataFrame([remembered], MEMORY).write.mode("overwrite").json(path)


def read_memory(spark: SparkSession, path: str) -> tuple[str | None, str | None]:
    """(last_entity, last_property); nulls where nothing was written yet."""
    r = spark.read.schema(MEMORY).json(path).first() if exists(spark, path) else None
    return (r.last_entity, r.last_property) if r else (None, None)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _at(spark, path)
    return store.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what is at a path, if anything is."""
    store, at = _at(spark, path)
    store.delete(at, True)


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    vocabulary.select("term", "tid").write.mode("overwrite").parquet(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
