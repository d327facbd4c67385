"""Product quantization: segments, codebooks, codes and distances by table.

Training is a k-means per subspace (k-means++ seeding, fixed Lloyd rounds) on a bounded sample of vectors in a
stated order, one task per subspace; coding and scoring run on Arrow batches with the codebook broadcast
(its size is subspaces x 256 x segment, whatever the number of vectors).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.functions.rng import DEFAULT_SEED, Uniform

ROUNDS, CENTROIDS = 12, 256
#: Rows that are compared with all centroids at once.
STEP_ROWS = 4096
#: Training rows: a documented bound; a larger table is sampled by hash of the id.
TRAIN_ROWS = 100_000
#: Rows are drawn by hashes of this many numbers.
SPACE = 1 << 62
# fixed values: salts of the subspaces' seeds
SUBSPACE_SALT, SUBSPACE_STEP = 0x5051, 0x9E37


def segments(dim: int, m: int) -> list[tuple[int, int]]:
    """(offset, length) of each segment: ceil(dim / m) wide, the last may be shorter, and there may be fewer than m."""
    if m < 1 or dim < 1:
        raise ValueError("dimension and subspaces must be at least 1")
    width = -(-dim // min(m, dim))
    return [(o, min(width, dim - o)) for o in range(0, dim, width)]


@dataclass(frozen=True)
class Codebook:
    """``books[i]`` holds the centroids of segment i, one per row."""

    parts: list[tuple[int, int]]
    books: list[np.ndarray]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes of rows; the lowest code wins ties."""
        out = np.empty((len(x), len(self.parts)), np.int32)
        for i, (o, n) in enumerate(self.parts):
            seg, book = x[:, o : o + n].astype(np.float64), self.books[i].astype(np.float64)
            for lo in range(0, len(x), 4096):
                out[lo : lo + 4096, i] = ((seg[lo : lo + 4096, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)

    def table(self, query: np.ndarray, metric: str) -> np.ndarray:
        """Per subspace and centroid: squared distance to the query's segment, or their product."""
        out = np.zeros((len(self.parts), max(len(b) for b in self.books)))
        for i, (o, n) in enumerate(self.parts):
            q, b = query[o : o + n].astype(np.float64), self.books[i].astype(np.float64)
            out[i, : len(b)] = ((b - q) ** 2).sum(axis=1) if metric == "euclidean" else b @ q
        return out

    def distances(self, query: np.ndarray, codes: np.ndarray, metric: str) -> np.ndarray:
        """Asymmetric distances of one exact query to coded rows, by table."""
        s = self.table(query, metric)[np.arange(len(self.parts)), codes].sum(axis=1)
        if metric == "euclidean":
            return np.sqrt(np.maximum(0, s))
        if metric == "dot":
            return -s
        den = np.linalg.norm(query.astype(np.float64)) * np.linalg.norm(self.decode(codes).astype(np.float64), axis=1)
        return np.where(den == 0, 1.0, 1 - s / np.where(den == 0, 1, den))

    def between(self, queries: np.ndarray, codes: np.ndarray, metric: str) -> np.ndarray:
        """``distances`` of several queries (queries x rows), one subspace after the other."""
        s = np.zeros((len(queries), len(codes)))
        for i, (o, n) in enumerate(self.parts):
            q, b = queries[:, o : o + n].astype(np.float64), self.books[i].astype(np.float64)
            s += np.take(((q[:, None] - b[None]) ** 2).sum(axis=2) if metric == "euclidean" else q @ b.T, codes[:, i], axis=1)
        if metric == "euclidean":
            return np.sqrt(np.maximum(0, s))
        if metric == "dot":
            return -s
        den = np.linalg.norm(queries.astype(np.float64), axis=1)[:, None] * np.linalg.norm(self.decode(codes).astype(np.float64), axis=1)[None]
        return np.where(den == 0, 1.0, 1 - s / np.where(den == 0, 1, den))


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids (float32) of the rows of ``x``: weighted seeding, then ``rounds`` of assignment and mean."""
    n, uniform = len(x), Uniform(seed)
    wide = x.astype(np.float64)
    chosen = [int(uniform() * n) % n]
    nearest = np.full(n, np.inf)
    while len(chosen) < k:
        nearest = np.minimum(nearest, ((wide - wide[chosen[-1]]) ** 2).sum(axis=1))
        mass = np.cumsum(nearest)
        chosen.append(min(int(np.searchsorted(mass, uniform() * mass[-1])), n - 1))
    centers = x[chosen].astype(np.float32)
    square = (wide**2).sum(axis=1)

    def closest(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest centroid and squared distance, in steps."""
        c = c.astype(np.float64)
        own, far = np.empty(n, np.int64), np.empty(n)
        for lo in range(0, n, STEP_ROWS):
            part = slice(lo, lo + STEP_ROWS)
            d = square[part, None] - 2 * wide[part] @ c.T + (c**2).sum(axis=1)[None]
            own[part] = d.argmin(axis=1)
            far[part] = d.min(axis=1)
        return own, far

    for _ in range(rounds):
        owner, _ = closest(centers)
        size = np.bincount(owner, minlength=k)
        mean = np.stack([np.bincount(owner, weights=wide[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        for c in range(k):
            # an empty cluster takes the point farthest from its centroid
            centers[c] = mean[c] / size[c] if size[c] else x[int(closest(centers)[1].argmax())]
    return centers


def train(df: DataFrame, m: int, k: int = CENTROIDS, seed: int = DEFAULT_SEED, order: str = "vid", vec: str = "vec", rows: int = TRAIN_ROWS) -> Codebook:
    """A codebook from at most ``rows`` vectors, taken in order of ``order``; one task per subspace."""
    n = df.count()
    if not n:
        raise ValueError("cannot calibrate an empty index")
    if n > rows:
        df = df.where(F.pmod(F.xxhash64(order), F.lit(SPACE)) < SPACE * rows // n)
    parts = segments(len(df.select(vec).first()[0]), m)
    cut = F.array(*(F.struct(F.lit(i).alias("sub"), F.slice(vec, o + 1, size).alias("x")) for i, (o, size) in enumerate(parts)))
    each = df.select(F.col(order).alias("id"), F.explode(cut).alias("s")).select("id", "s.sub", "s.x")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        sub, x = int(pdf["sub"].iloc[0]), np.stack(pdf["x"].to_numpy()).astype(np.float32)
        c = _kmeans(x, max(1, min(k, len(x))), seed ^ (SUBSPACE_SALT + sub * SUBSPACE_STEP))
        return pd.DataFrame({"sub": sub, "code": np.arange(len(c)), "centroid": list(c)})

    # sorted here: Spark would fit once to sample the order and once more to sort
    found = sorted(each.groupBy("sub").applyInPandas(fit, "sub int, code int, centroid array<float>").collect(), key=lambda r: (r["sub"], r["code"]))
    return Codebook(parts, [np.array([r["centroid"] for r in found if r["sub"] == i], np.float32) for i in range(len(parts))])


def fixed(df: DataFrame, m: int, k: int, order: str = "vid", vec: str = "vec") -> Codebook:
    """A codebook made of the segments of the first ``k`` vectors."""
    x = np.array([r[0] for r in df.orderBy(order).limit(k).select(vec).collect()], np.float32)
    parts = segments(x.shape[1], m)
    return Codebook(parts, [x[:, o : o + n] for o, n in parts])


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def _mapped(df: DataFrame, book: Codebook, name: str, kind: T.DataType, source: str, work) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(book)
    keep = [c for c in df.columns if c != name]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(name, T.ArrayType(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = work(shared.value, batch.column(source)) if batch.num_rows else np.zeros((0, 1))
            n = got.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1) * n, pa.int32()), pa.array(got.ravel(), pa.int32() if isinstance(kind, T.IntegerType) else pa.float32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], names=[*keep, name])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, book: Codebook, vec: str = "vec", codes: str = "codes") -> DataFrame:
    return _mapped(df, book, codes, T.IntegerType(), vec, lambda b, col: b.encode(matrix(col)))


def decode(df: DataFrame, book: Codebook, codes: str = "codes", vec: str = "vec") -> DataFrame:
    return _mapped(df, book, vec, T.FloatType(), codes, lambda b, col: b.decode(matrix(col)))
