"""Quality of texts: a regularised quadratic discriminant.

Each class (label 1 and 0) is a Gaussian over transformed document statistics, its covariance shrunk towards a
pooled diagonal. The score comes from the difference of the two log densities, each a Mahalanobis distance through
a Cholesky factor that is computed once, and is then mapped to the share of label 1 among training rows with such
a difference (isotonic over BINS bins). Class moments and bin counts are sums over all training rows, so nothing
is sampled and no more than a few hundred numbers reach the driver.

Edge cases: null and empty texts are scored like any other (their statistics are zeros); rows without doc_id are
scored and never learned from; repeated rows are scored alike; without training rows of both classes every score
is the share of label 1, or 0.5 without any; an empty table gives an empty result; other columns are not inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, stats

#: Weight of the pooled diagonal in each class covariance.
SHRINKAGE = 0.1
#: Bins of the calibration.
BINS = 200
#: Score from which a text counts as good.
THRESHOLD = 0.7
_CLIP = 60.0


@dataclass(frozen=True)
class Model:
    means: np.ndarray  # (2, d)
    factors: np.ndarray  # (2, d, d): inverses of the lower Cholesky factors
    offsets: np.ndarray  # (2,): log prior - log determinant of the factor
    constant: float | None = None  # every score, where no discriminant could be fitted
    knots: np.ndarray | None = None
    values: np.ndarray | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-density difference, label 1 minus label 0."""
        logs = [self.offsets[k] - 0.5 * (((x - self.means[k]) @ self.factors[k].T) ** 2).sum(1) for k in (0, 1)]
        return np.clip(logs[1] - logs[0], -_CLIP, _CLIP)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        m = self.margin(x)
        if self.knots is None:
            return 1 / (1 + np.exp(-m))
        # A little of the plain posterior keeps the order within a level of the isotonic steps.
        return 0.999 * np.interp(m, self.knots, self.values) + 0.001 / (1 + np.exp(-m / 4))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        x, y = stats.matrix(batch.column(0)), batch.column(1).to_numpy()
        for k in (0, 1):
            z = x[y == k]
            if len(z):
                own = np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
                total[k] = total[k] + own if k in total else own
    y = [k for k, v in total.items() for _ in v]
    yield pa.record_batch([pa.array(y, pa.int32()), pa.array([p for v in total.values() for p in range(len(v))], pa.int32()), pa.array([float(a) for v in total.values() for a in v], pa.float64())], ["y", "at", "v"])


def isotonic(ones: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Non-decreasing shares ones / all_ over bins with rows, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for a, b in zip(ones, all_):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.concatenate([np.full(int(n), (a + 0.5) / (b + 1)) for a, b, n in blocks])


def fit(training: DataFrame, shrinkage: float = SHRINKAGE) -> Model:
    """training: (x, y) rows."""
    d = len(stats.NAMES)
    sums = np.zeros((2, 1 + d + d * d))
    for r in training.select("x", "y").mapInArrow(_moments, "y int, at int, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).collect():
        sums[r.y, r.at] = r.v
    n = sums[:, 0]
    if min(n) < 2:
        return Model(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), constant=float(n[1] / n.sum()) if n.sum() else 0.5)
    means = sums[:, 1 : 1 + d] / n[:, None]
    covs = [sums[k, 1 + d :].reshape(d, d) / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = np.diag(np.maximum(sum(n[k] * np.diag(covs[k]) for k in (0, 1)) / n.sum(), 1e-6))
    factors, offsets = [], []
    for k in (0, 1):
        low = np.linalg.cholesky((1 - shrinkage) * covs[k] + shrinkage * pooled)
        factors.append(np.linalg.inv(low))
        offsets.append(np.log(n[k] / n.sum()) - np.log(np.diag(low)).sum())
    plain = Model(means, np.stack(factors), np.array(offsets))
    width = 2 * _CLIP / BINS

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BINS), np.int64)
        for batch in batches:
            if batch.num_rows:
                at = np.minimum(((plain.margin(stats.matrix(batch.column(0))) + _CLIP) / width).astype(int), BINS - 1)
                np.add.at(seen, (batch.column(1).to_numpy(), at), 1)
        y, at = np.nonzero(seen)
        yield pa.record_batch([pa.array(y, pa.int32()), pa.array(at, pa.int32()), pa.array(seen[y, at])], ["y", "at", "v"])

    seen = np.zeros((2, BINS))
    for r in training.select("x", "y").mapInArrow(binned, "y int, at int, v long").groupBy("y", "at").agg(F.sum("v").alias("v")).collect():
        seen[r.y, r.at] = r.v
    used = np.flatnonzero(seen.sum(0))
    return Model(plain.means, plain.factors, plain.offsets, knots=(used + 0.5) * width - _CLIP, values=isotonic(seen[1, used], seen.sum(0)[used]))


def scores(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", shrinkage: float = SHRINKAGE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; labels(doc_id, quality) of rows not held out are learned."""
    common.prepare(docs.sparkSession)
    x = common.cut(stats.statistics(docs, id_col, text_col))
    model = fit(common.cut(x.join(stats.training_labels(labels, label, id_col), "id").select("x", "y")), shrinkage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(np.round(model.score(stats.matrix(batch.column(1))), 9))], ["id", "score"])

    scored = x.mapInArrow(run, "id long, score double")
    return scored.select(F.col("id").alias("doc_id"), stats.held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", shrinkage: float = SHRINKAGE, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the classifier rejects. Texts are scored again where they lie, so none is shuffled."""
    common.prepare(docs.sparkSession)
    x = stats.statistics(docs, id_col, text_col)
    model = fit(common.cut(x.join(stats.training_labels(labels, label, id_col), "id").select("x", "y")), shrinkage)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = common.utf8(batch.column(at))
            good = [np.round(model.score(stats.text_statistics(data, bounds, i, j)), 9) >= threshold for i, j in common.slices(bounds)]
            yield batch.filter(pa.array(np.concatenate(good))) if good else batch

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
