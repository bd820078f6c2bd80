"""Times of stages and qualities of answers, as JSON lines."""

from __future__ import annotations

import resource
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "query string, analyzer string, retriever string, stages map<string,double>, total_ms double, rss_mb double, confidence double, validated long, parts long"


class Profiler:
    """Adds up milliseconds by stage; of a stage that runs twice both count."""

    def __init__(self, query: str, analyzer: str = "rule", retriever: str = "hybrid") -> None:
        self.query, self.analyzer, self.retriever = query, analyzer, retriever
        self.stages: dict[str, float] = {}
        self.began, self.rss = time.perf_counter(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        self.quality: tuple[float, int, int] = (0.0, 0, 0)

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        t = time.perf_counter()
        try:
            yield
        finally:
            self.stages[name] = self.stages.get(name, 0.0) + (time.perf_counter() - t) * 1000

    def answers(self, df: DataFrame) -> None:
        r = df.agg(F.avg("confidence"), F.sum(F.col("validated").cast("int")), F.count("*")).first()
        self.quality = (float(r[0] or 0), int(r[1] or 0), int(r[2]))

    def record(self, spark: SparkSession) -> DataFrame:
        total = (time.perf_counter() - self.began) * 1000
        grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - self.rss) / 1024
        return spark.createDataFrame([(self.query, self.analyzer, self.retriever, self.stages, total, grown, *self.quality)], SCHEMA)


def append(record: DataFrame, path: str) -> None:
    record.write.mode("append").json(path)
