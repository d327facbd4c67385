"""k nearest neighbours, exact: a stated set of queries against all rows, in blocks.

Two physical forms give the same rows.  ``expressions`` keeps everything in the JVM and fits few queries; ``blocks``
scores Arrow batches against slices of the queries by matrix products and keeps the best k per query of all rows that
a task has seen, so what a task holds and sends on doesn't grow with its rows.  Few queries with few neighbours are
broadcast, and the final rank is a window over (partitions x k) rows per query.  Otherwise a task takes blocks of
queries and passes over all rows for each, so that its best are final and nothing but the packed rows is shuffled.

Ties: rows rank by (distance rounded to ``digits``, id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from halyard.functions import kernels as K
from halyard.functions.product_quant import matrix

#: Bytes of queries that are broadcast as one block; a larger set is worked off in several.
BLOCK_BYTES = 32 << 20
#: Distances that are computed at once, neighbours that a task keeps for a block of queries, and for a broadcast set.
CELLS, KEPT, KEPT_SHARED = 1 << 18, 1 << 20, 1 << 18
#: Rows of a packed block, and bytes of packed rows that a task passes over for each block of queries.
PACKED_ROWS, PART_BYTES = 2048, 192 << 20
#: Rows of a batch that is sent on.
OUT_ROWS = 1 << 16
DIGITS = 6


def clamp(k: int, ef: int | None = None) -> tuple[int, int]:
    """(k, ef): k under 1 means no rows; ef is max(k, 16) unless given, and k at least."""
    if isinstance(k, bool) or not isinstance(k, int):
        raise TypeError("k must be an integer")
    return max(k, 0), max(ef if ef is not None else max(k, 16), k)


def _empty(base: DataFrame, queries: DataFrame, vid: str, qid: str) -> DataFrame:
    kinds = dict(queries.dtypes)[qid], dict(base.dtypes)[vid]
    return base.sparkSession.createDataFrame([], f"qid {kinds[0]}, vid {kinds[1]}, dist double, rk long")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("dist", "vid")
    return scored.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k).withColumn("rk", F.col("rk").cast("long"))


def expressions(queries: DataFrame, base: DataFrame, k: int, metric: str = "cosine", where: Column | None = None, exclude_self: bool = False, digits: int = DIGITS, qid: str = "qid", vid: str = "vid", vec: str = "vec") -> DataFrame:
    """qid, vid, dist, rk by built-in functions only; the queries must fit a block."""
    K.check_metric(metric)
    k, _ = clamp(k)
    if not k:
        return _empty(base, queries, vid, qid)
    base = base.where(where) if where is not None else base
    q = queries.select(F.col(qid).alias("qid"), K.prepare(F.col(vec), metric).alias("q"))
    rows = _collected(q, "q")
    if rows is None:
        raise ValueError("too many queries for this form; use blocks")
    q = F.broadcast(base.sparkSession.createDataFrame(rows, q.schema))
    scored = base.select(F.col(vid).alias("vid"), K.prepare(F.col(vec), metric).alias("v")).crossJoin(q)
    scored = scored.where("qid != vid") if exclude_self else scored
    return _ranked(scored.select("qid", "vid", K.rounded(K.distance(F.col("q"), F.col("v"), metric), digits).alias("dist")), k)


def _collected(queries: DataFrame, vec: str, limit: int = BLOCK_BYTES) -> list | None:
    """The queries, if their size, measured first, is within ``limit``; else None."""
    size = queries.agg(F.sum(F.size(vec).cast("long") * 4 + 16)).first()[0] or 0
    return queries.collect() if size <= limit else None


def scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances (queries x rows) in double precision from float inputs."""
    x, q = x.astype(np.float64), q.astype(np.float64)
    if metric == "euclidean":
        near = (q**2).sum(axis=1)[:, None] - 2 * (q @ x.T) + (x**2).sum(axis=1)[None]
        return np.sqrt(np.maximum(near, 0))
    s = q @ x.T
    return 1 - s if metric == "cosine" else -s


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return np.where(n == 0, x, x / np.where(n == 0, 1, n)).astype(np.float32)


def _order(r: np.ndarray, d: np.ndarray, ids: pa.Array) -> np.ndarray:
    """The order of rows by (query, distance, id)."""
    if pa.types.is_integer(ids.type):
        return np.lexsort((ids.to_numpy(zero_copy_only=False), d, r))
    return pc.sort_indices(pa.table([pa.array(r), pa.array(d), ids], names=["r", "d", "id"]), sort_keys=[(n, "ascending") for n in ("r", "d", "id")]).to_numpy()


def _same(qids: pa.Array, vids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of equal ids, in order of query."""
    if qids.type != vids.type and not (pa.types.is_integer(qids.type) and pa.types.is_integer(vids.type)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    q, v = qids.to_numpy(zero_copy_only=False), vids.to_numpy(zero_copy_only=False)
    order = np.argsort(v, kind="stable")
    lo, hi = (np.searchsorted(v[order], q, side) for side in ("left", "right"))
    r = np.repeat(np.arange(len(q)), hi - lo)
    return r, order[np.arange(len(r)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[r]]


class Nearest:
    """The k best rows of each of a block of queries among the rows met so far: queries x k are held, and half as many wait."""

    def __init__(self, qids: pa.Array, q: np.ndarray, k: int, metric: str, exclude_self: bool, digits: int, score=None):
        self.qids, self.k, self.metric, self.exclude_self, self.digits, self.score = qids, k, metric, exclude_self, digits, score
        n = len(q)
        if score:
            self.q, self.shift = q, np.zeros(n)
        else:
            # a matrix product plus a shift per query is the distance, or its square
            q = (unit(q) if metric == "cosine" else q).astype(np.float64)
            self.q = np.hstack([-2 * q, np.ones((n, 1))]) if metric == "euclidean" else -q
            self.shift = (q**2).sum(axis=1) if metric == "euclidean" else np.full(n, float(metric == "cosine"))
        self.limit = np.full(n, np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.waiting = 0

    def _distance(self, key: np.ndarray, shift: np.ndarray) -> np.ndarray:
        d = key + shift
        return np.sqrt(np.maximum(d, 0)) if self.metric == "euclidean" and not self.score else d

    def _key(self, limit: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (np.square(limit) * np.sign(limit) if self.metric == "euclidean" and not self.score else limit) - shift

    def meet(self, vids: pa.Array, x: np.ndarray) -> None:
        if not len(x):
            return
        if not self.score:
            x = (unit(x) if self.metric == "cosine" else x).astype(np.float64)
            x = np.hstack([x, (x**2).sum(axis=1)[:, None]]) if self.metric == "euclidean" else x
        same = _same(self.qids, vids) if self.exclude_self else None
        step = max(1, CELLS // len(x))
        for lo in range(0, len(self.q), step):
            q, shift, limit = (a[lo : lo + step] for a in (self.q, self.shift, self.limit))
            key = self.score(x, q, self.metric) if self.score else q @ x.T
            if same is not None:
                i, j = np.searchsorted(same[0], (lo, lo + len(q)))
                key[same[0][i:j] - lo, same[1][i:j]] = np.inf
            if len(x) > self.k and not np.isfinite(limit).all():
                last = np.partition(key, self.k - 1, axis=1)[:, self.k - 1]
                limit = np.fmin(limit, self._distance(last, shift) + 10.0**-self.digits)
            at = np.flatnonzero(key <= self._key(limit, shift)[:, None])
            r, c = at // len(x), at % len(x)
            d = self._distance(key.ravel()[at], shift[r])
            ok = np.isfinite(d)
            if not ok.all():
                r, c, d = r[ok], c[ok], d[ok]
            if len(r):
                self.held.append(((r + lo).astype(np.int32), np.round(d, self.digits) + 0.0, vids.take(pa.array(c))))
                self.waiting += len(r)
                if self.waiting > max(len(self.q) * self.k // 2, OUT_ROWS):
                    self._cut()

    def _joined(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        r, d, ids = zip(*self.held, strict=True)
        return np.concatenate(r), np.concatenate(d), pa.concat_arrays(ids)

    def _cut(self, last: bool = False) -> np.ndarray:
        """Keep the best k of each query, and settle what can't be among them any more; their ranks."""
        r, d, ids = self._joined()
        if self.k > 256 and not last:
            # long lists are cut at their k-th distance; ties with it are settled at the end, or when they are many
            order = np.argsort(r.astype(np.int16) if len(self.q) < 1 << 15 else r, kind="stable")
            ends = np.searchsorted(r[order], np.arange(len(self.q) + 1))
            keep = np.ones(len(r), bool)
            for n in range(len(self.q)):
                mine = order[ends[n] : ends[n + 1]]
                if len(mine) >= self.k:
                    worst = np.partition(d[mine], self.k - 1)[self.k - 1]
                    self.limit[n] = worst + 10.0**-self.digits
                    keep[mine[d[mine] > worst]] = False
            if keep.sum() <= len(self.q) * self.k * 5 // 4:
                at = np.flatnonzero(keep)
                self.held, self.waiting = [(r[at], d[at], ids.take(pa.array(at)))], 0
                return at
        order = _order(r, d, ids)
        r = r[order]
        rank = np.arange(len(r)) - np.searchsorted(r, np.arange(len(self.q)))[r]
        keep = rank < self.k
        order, r, rank = order[keep], r[keep], rank[keep]
        d = d[order]
        full = rank == self.k - 1
        self.limit[r[full]] = d[full] + 10.0**-self.digits
        self.held, self.waiting = [(r, d, ids.take(pa.array(order)))], 0
        return rank

    def found(self) -> Iterator[pa.RecordBatch]:
        """qid, vid, dist, rk of the rows met, in batches."""
        if not self.held:
            return
        rank = self._cut(last=True)
        r, d, ids = self.held[0]
        for lo in range(0, len(r), OUT_ROWS):
            part = slice(lo, lo + OUT_ROWS)
            yield pa.RecordBatch.from_arrays([self.qids.take(pa.array(r[part])), ids[part], pa.array(d[part]), pa.array(rank[part] + 1, pa.int64())], names=["qid", "vid", "dist", "rk"])


def blocks(queries: DataFrame, base: DataFrame, k: int, metric: str = "cosine", where: Column | None = None, exclude_self: bool = False, digits: int = DIGITS, qid: str = "qid", vid: str = "vid", vec: str = "vec", score=None) -> DataFrame:
    """qid, vid, dist, rk by matrix products; rejected rows are filtered before ranking.

    A query set that fits a block, and whose neighbours do, is broadcast.  A larger one is cut into packed blocks, rows
    of a table; each meets the packed blocks of the base one after the other in one task, so no side has to fit in
    memory.  Null vectors and ids take no part.  ``score(rows, queries, metric)`` may replace the distance, for coded rows.
    """
    K.check_metric(metric)
    k, _ = clamp(k)
    if not k:
        return _empty(base, queries, vid, qid)
    base = base.where(where) if where is not None else base
    base = base.select(F.col(vid).alias("vid"), F.col(vec).alias("vec")).where("vid is not null and vec is not null")
    queries = queries.select(F.col(qid).alias("qid"), F.col(vec).alias("vec")).where("qid is not null and vec is not null")
    schema = T.StructType([queries.schema["qid"], base.schema["vid"], T.StructField("dist", T.DoubleType()), T.StructField("rk", T.LongType())])

    rows = _collected(queries, "vec")
    if rows is not None and not rows:
        return _empty(base, queries, "vid", "qid")
    if rows is not None and len(rows) * k <= KEPT_SHARED:
        table = pa.Table.from_pylist([{"qid": r["qid"], "vec": r["vec"]} for r in rows])
        qids = table.column("qid").combine_chunks().cast(_arrow(schema["qid"].dataType))
        shared = base.sparkSession.sparkContext.broadcast((qids, np.array([r["vec"] for r in rows], np.float32)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = Nearest(*shared.value, k, metric, exclude_self, digits, score)
            for batch in batches:
                for lo in range(0, batch.num_rows, 4096):
                    part = batch.slice(lo, 4096)
                    near.meet(part.column("vid"), matrix(part.column("vec")))
            yield from near.found()

        return _ranked(base.mapInArrow(run, schema).drop("rk"), k)

    n, size = base.agg(F.count(F.lit(1)), F.sum(F.size("vec").cast("long") * 4 + 16)).first()
    if not n:
        return _empty(base, queries, "vid", "qid")
    k = min(k, n)
    kind = np.dtype(_arrow(base.schema["vec"].dataType.elementType).to_pandas_dtype())

    def packed(df: DataFrame, key: str, names: tuple[str, str], rows: int, kind: np.dtype) -> DataFrame:
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, rows):
                    part = batch.slice(lo, rows)
                    ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(key))
                    flat = np.ascontiguousarray(matrix(part.column("vec")), kind)
                    yield pa.RecordBatch.from_arrays([ids, pa.array([flat.tobytes()], pa.binary())], names=list(names))

        return df.mapInArrow(pack, f"{names[0]} array<{dict(df.dtypes)[key]}>, {names[1]} binary")

    many = len(rows) if rows is not None else queries.count()
    block = max(1, min(PACKED_ROWS, KEPT // k))
    tasks = max(1, min(-(-many // block), 4 * base.sparkSession.sparkContext.defaultParallelism))
    parts = -(-size // PART_BYTES)
    asked = packed(queries, "qid", ("qids", "q"), block, np.dtype(np.float32)).repartition(tasks).withColumn("block", F.monotonically_increasing_id())
    # the left side's rows are the outer loop: a block of queries meets all rows of a part before the next block comes
    pairs = asked.hint("shuffle_replicate_nl").crossJoin(packed(base, "vid", ("vids", "x"), PACKED_ROWS, kind).repartition(parts))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, at, done = None, None, set()
        for batch in batches:
            for i in range(batch.num_rows):
                if (now := batch.column("block")[i].as_py()) != at:
                    if near is not None:
                        yield from near.found()
                    if now in done:
                        raise RuntimeError("a block of queries came in pieces")
                    at = now
                    done.add(at)
                    qids = batch.column("qids")[i].values
                    near = Nearest(qids, np.frombuffer(batch.column("q")[i].as_buffer(), np.float32).reshape(len(qids), -1), k, metric, exclude_self, digits, score)
                vids = batch.column("vids")[i].values
                near.meet(vids, np.frombuffer(batch.column("x")[i].as_buffer(), kind).reshape(len(vids), -1))
        if near is not None:
            yield from near.found()

    out = pairs.mapInArrow(meet, schema)
    return out if parts == 1 else _ranked(out.drop("rk"), k)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def recall(truth: DataFrame, answers: DataFrame) -> DataFrame:
    """qid, recall: the share of each query's true neighbours that the answers hold; 1 where there are none."""
    hit = truth.select("qid", "vid").join(answers.select("qid", "vid").withColumn("hit", F.lit(1)), ["qid", "vid"], "left")
    return hit.groupBy("qid").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
