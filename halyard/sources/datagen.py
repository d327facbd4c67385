"""Clustered synthetic vectors, equal for equal seeds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from halyard.functions.rng import Gaussian, Uniform

QUERIES = 100
# fixed values: spread of the centers, of the points and of the queries
CENTER_SPREAD, POINT_SPREAD, QUERY_SPREAD = 3, 0.7, 0.3


@dataclass
class Clusters:
    vectors: np.ndarray
    labels: np.ndarray
    queries: np.ndarray

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(id, vec, label) and (qid, vec)."""
        base = [(str(i), v.tolist(), int(c)) for i, (v, c) in enumerate(zip(self.vectors, self.labels, strict=True))]
        queries = [(i, v.tolist()) for i, v in enumerate(self.queries)]
        return spark.createDataFrame(base, "id string, vec array<float>, label int"), spark.createDataFrame(queries, "qid int, vec array<float>")


def clusters(n: int, dim: int, k: int, seed: int) -> Clusters:
    """Points around k centers, the i-th around center i mod k, and queries near random points."""
    uniform = Uniform(seed)
    normal = Gaussian(uniform)

    def draw(rows: int) -> np.ndarray:
        return np.array([normal() for _ in range(rows * dim)]).reshape(rows, dim)

    centers = (CENTER_SPREAD * draw(k)).astype(np.float32)
    labels = np.arange(n) % k
    vectors = (centers[labels].astype(np.float64) + POINT_SPREAD * draw(n)).astype(np.float32)
    queries = np.zeros((QUERIES, dim), np.float32)
    for i in range(QUERIES):
        near = vectors[int(uniform() * n) % n].astype(np.float64)
        queries[i] = near + QUERY_SPREAD * draw(1)[0]
    return Clusters(vectors, labels.astype(np.int32), queries)
