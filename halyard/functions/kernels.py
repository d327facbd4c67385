"""Vector kernels as Column expressions: they stay in the JVM and optimise like any arithmetic.

Inputs are arrays of float; products and sums are double, left to right.  Normalised vectors are rounded to
float again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "dot")
ENCODINGS = ("none", "sq8", "sq4", "pq")


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}: expected one of {METRICS}")
    return metric


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def sq_euclidean(a: Column, b: Column) -> Column:
    def square(x, y):
        d = x.cast("double") - y.cast("double")
        return d * d

    return _sum(F.zip_with(a, b, square))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """a / |a| as floats; the zero vector stays."""
    return F.transform(F.array(norm(a)), lambda n: F.when(n == 0, F.transform(a, lambda x: x.cast("float"))).otherwise(F.transform(a, lambda x: (x.cast("double") / n).cast("float"))))[0]


def require_dim(a: Column, dim: int) -> Column:
    """``a``, or an error that names expected and found dimension."""
    return F.when(a.isNull() | (F.size(a) == dim), a).otherwise(F.raise_error(F.concat(F.lit(f"vector dimension mismatch: expected {dim}, got "), F.size(a).cast("string"))).cast("array<float>"))


def prepare(a: Column, metric: str, dim: int | None = None) -> Column:
    """Check the dimension, cast to float, normalise iff cosine."""
    check_metric(metric)
    a = require_dim(a, dim) if dim is not None else a
    return normalize(a) if metric == "cosine" else F.transform(a, lambda x: x.cast("float"))


def distance(a: Column, b: Column, metric: str) -> Column:
    """Distance of prepared vectors: 1 - dot for cosine, the root of the squared differences, or minus dot."""
    if check_metric(metric) == "euclidean":
        return F.sqrt(sq_euclidean(a, b))
    return 1 - dot(a, b) if metric == "cosine" else -dot(a, b)


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def bytes_per_vector(encoding: str, dim: int, pq_subspaces: int = 8) -> int:
    return {"none": 4 * dim, "sq8": dim, "sq4": -(-dim // 2), "pq": min(pq_subspaces, dim)}[encoding]
