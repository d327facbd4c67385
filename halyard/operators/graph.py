"""Neighbour graphs: exact k-NN graphs, their statistics, diverse selection, and sharded navigable graphs.

The hierarchical graph is built per shard (rows dealt out by a hash of the id), each by one task, and searched
shard by shard with a final merge; a shard holds a bounded number of rows, so more data means more shards, not
larger ones.  Graphs are rows of a table: (shard, graph), searched where they lie.
"""

from __future__ import annotations

import heapq
import io
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.functions import kernels as K
from halyard.functions.product_quant import matrix
from halyard.functions.rng import DEFAULT_SEED, level
from halyard.operators import knn
from halyard.operators.knn import clamp, scores, unit

#: Rows of a shard, and rows up to which a shard is built from one matrix of distances.
SHARD_ROWS, BULK_ROWS = 2000, 4096
#: Of stored graphs.
MAGIC, FORMAT, MOST_LEVELS = b"hlyg", 1, 32


def knn_graph(base: DataFrame, m: int, metric: str = "cosine", vid: str = "vid", vec: str = "vec") -> DataFrame:
    """src, dst, dist, pos: each row's m nearest others."""
    found = knn.blocks(base.select(F.col(vid).alias("qid"), vec), base, m, metric, exclude_self=True, vid=vid, vec=vec)
    return found.select(F.col("qid").alias("src"), F.col("vid").alias("dst"), "dist", F.col("rk").alias("pos"))


def degree_stats(edges: DataFrame, nodes: DataFrame, vid: str = "vid") -> DataFrame:
    """nodes, avg_out, max_out, max_in: one row; 0 where there are no nodes.  The edges are read once."""
    end = lambda c, o: F.struct(F.col(c).alias(vid), F.lit(o).alias("o"), F.lit(1 - o).alias("i"))
    degrees = edges.select(F.explode(F.array(end("src", 1), end("dst", 0))).alias("e")).groupBy(F.col(f"e.{vid}").alias(vid)).agg(F.sum("e.o").alias("o"), F.sum("e.i").alias("i"))
    all_ = nodes.select(vid).join(degrees, vid, "left").fillna(0, ["o", "i"])
    zero = lambda c: F.coalesce(c, F.lit(0))
    return all_.agg(F.count(F.lit(1)).alias("nodes"), zero(F.round(F.avg("o"), 6)).cast("double").alias("avg_out"), zero(F.max("o")).alias("max_out"), zero(F.max("i")).alias("max_in"))


def adjacency(edges: DataFrame) -> DataFrame:
    """src and the ids it points to, in order."""
    return edges.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"]).alias("links"))


def select_diverse(order: list[int], to_base: np.ndarray, between, m: int) -> list[int]:
    """From candidates in order of distance, those closer to the base than to any already kept, up to m."""
    kept: list[int] = []
    for i in order:
        if len(kept) == m:
            break
        if not kept or (between(i, kept) >= to_base[i]).all():
            kept.append(i)
    return kept


def diverse(x: np.ndarray, d: np.ndarray, m: int, metric: str) -> np.ndarray:
    """What ``select_diverse`` keeps of the candidates ``x`` (bases x candidates x dimensions), in order of their distances ``d``
    to their base, for all bases together."""
    wide = x.astype(np.float64)
    between = wide @ wide.transpose(0, 2, 1)
    if metric == "euclidean":
        square = (wide**2).sum(axis=2)
        between = np.sqrt(np.maximum(square[:, :, None] - 2 * between + square[:, None], 0))
    else:
        between = 1 - between if metric == "cosine" else -between
    kept, closest = np.zeros(d.shape, bool), np.full(d.shape, np.inf)
    for i in range(d.shape[1]):
        kept[:, i] = (closest[:, i] >= d[:, i]) & (kept.sum(axis=1) < m)
        closest = np.where(kept[:, i, None], np.minimum(closest, between[:, i]), closest)
    return kept


def diverse_graph(base: DataFrame, candidates: int, m: int, metric: str = "cosine", vid: str = "vid", vec: str = "vec") -> DataFrame:
    """src, dst, dist, pos: the ``candidates`` nearest of each row, thinned to at most m diverse ones."""
    edges = knn_graph(base, candidates, metric, vid, vec)
    with_vec = edges.join(base.select(F.col(vid).alias("dst"), F.col(vec).alias("v")), "dst")
    rows = with_vec.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dist", "dst", "v"))).alias("near"))
    kind = dict(base.dtypes)[vid]

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                near = part.column("near")
                each, size = near.flatten(), near.value_lengths().to_numpy()
                x, d = matrix(each.field("v")).astype(np.float32), each.field("dist").to_numpy()
                x = unit(x) if metric == "cosine" else x
                start, keep = np.cumsum(size) - size, np.zeros(len(d), bool)
                for n in np.unique(size):
                    at = start[size == n, None] + np.arange(n)
                    keep[at] = diverse(x[at], d[at], m, metric)
                row = np.repeat(np.arange(len(size)), size)[keep]
                first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(size)))])
                pos = np.arange(len(row)) - first[row] + 1
                yield pa.RecordBatch.from_arrays([part.column("src").take(pa.array(row)), each.field("dst").filter(pa.array(keep)), pa.array(d[keep]), pa.array(pos)], names=["src", "dst", "dist", "pos"])

    return rows.mapInArrow(thin, f"src {kind}, dst {kind}, dist double, pos long")


class Hnsw:
    """A navigable small-world graph over the rows of one shard, built by insertion."""

    def __init__(self, metric: str, m: int = 16, ef_construction: int = 200, seed: int = DEFAULT_SEED, extend: bool = False):
        if not 2 <= m <= 32767 or ef_construction < 1:
            raise ValueError("m must be in [2, 32767] and ef_construction at least 1")
        self.metric, self.m, self.efc, self.seed, self.extend = K.check_metric(metric), m, ef_construction, seed, extend
        self.ids: list = []
        self.levels: list[int] = []
        self.links: list[list[list[int]]] = []
        self.dead: set[int] = set()
        self.at: dict = {}
        self.x = np.zeros((0, 0), np.float32)
        self.n, self.entry, self.top = 0, -1, -1
        #: Distances of the query that is searched for to all nodes, where they were computed together.
        self.far: list[float] | None = None

    def _grow(self, dim: int) -> None:
        if self.n == len(self.x):
            wider = np.zeros((max(256, 2 * self.n), dim), np.float32)
            if self.n:
                wider[: self.n] = self.x
            self.x = wider

    def prepared(self, v: np.ndarray) -> np.ndarray:
        v = np.asarray(v, np.float32)
        if self.n and len(v) != self.x.shape[1]:
            raise ValueError(f"vector dimension mismatch: expected {self.x.shape[1]}, got {len(v)}")
        return unit(v[None])[0] if self.metric == "cosine" else v

    def _dist(self, q: np.ndarray, nodes: list[int]) -> list[float]:
        if self.far is not None:
            return [self.far[n] for n in nodes]
        return scores(self.x[nodes], q[None], self.metric)[0].tolist()

    def _descend(self, q: np.ndarray, node: int, lvl: int, hops: list | None = None) -> int:
        d = self._dist(q, [node])[0]
        while True:
            near = self.links[node][lvl]
            if not near:
                return node
            dist = self._dist(q, near)
            if hops is not None:
                hops += [(node, b, x) for b, x in zip(near, dist, strict=True)]
            i = int(np.argmin(dist))
            if dist[i] >= d:
                return node
            node, d = near[i], dist[i]

    def _beam(self, q: np.ndarray, starts: list[int], ef: int, lvl: int, ok=None, hops: list | None = None) -> tuple[list[tuple[float, int]], int]:
        """The ef nearest admissible nodes reached (in order) and the number visited; others are passed through."""
        seen = set(starts)
        front = list(zip(self._dist(q, starts), starts, strict=True))
        found = [(-d, -n) for d, n in front if ok is None or ok(n)]
        heapq.heapify(front)
        heapq.heapify(found)
        while front:
            d, node = heapq.heappop(front)
            if len(found) >= ef and d > -found[0][0]:
                break
            fresh = [b for b in self.links[node][lvl] if b not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for x, b in zip(self._dist(q, fresh), fresh, strict=True):
                if hops is not None:
                    hops.append((node, b, x))
                if len(found) < ef or x < -found[0][0]:
                    heapq.heappush(front, (x, b))
                    if ok is None or ok(b):
                        heapq.heappush(found, (-x, -b))
                        if len(found) > ef:
                            heapq.heappop(found)
        return sorted((-d, -n) for d, n in found), len(seen)

    def _select(self, q: np.ndarray, near: list[tuple[float, int]], m: int) -> list[int]:
        nodes, d = [n for _, n in near], np.array([x for x, _ in near])
        kept = select_diverse(list(range(len(nodes))), d, lambda i, kept: scores(self.x[[nodes[j] for j in kept]], self.x[nodes[i]][None], self.metric)[0], m)
        return [nodes[i] for i in kept]

    def add(self, id_, v) -> None:
        """Insert, or replace: the earlier version becomes a tombstone."""
        v = self.prepared(v)
        self.remove(id_)
        lvl, node = level(str(id_), self.n, self.m, self.seed), self.n
        self._grow(len(v))
        self.x[node] = v
        self.n += 1
        self.ids.append(id_)
        self.levels.append(lvl)
        self.links.append([[] for _ in range(lvl + 1)])
        self.at[id_] = node
        if self.entry < 0:
            self.entry, self.top = node, lvl
            return
        starts = [self.entry]
        for at in range(self.top, lvl, -1):
            starts = [self._descend(v, starts[0], at)]
        for at in range(min(lvl, self.top), -1, -1):
            near, _ = self._beam(v, starts, self.efc, at, lambda n: n not in self.dead)
            if not near:
                last = [n for n in range(node - 1, -1, -1) if self.levels[n] >= at][: self.m]
                near = sorted(zip(self._dist(v, last), last, strict=True))
            if self.extend:
                known = {n for _, n in near}
                more = list(dict.fromkeys(b for _, n in near for b in self.links[n][at] if b not in known and b != node and b not in self.dead))
                near = sorted(near + list(zip(self._dist(v, more), more, strict=True)))[: 2 * self.efc] if more else near
            chosen = self._select(v, near, self.m)
            self.links[node][at] = chosen
            cap = 2 * self.m if at == 0 else self.m
            for b in chosen:
                own = self.links[b][at]
                own.append(node)
                if len(own) > cap:
                    self.links[b][at] = self._select(self.x[b], sorted(zip(self._dist(self.x[b], own), own, strict=True)), cap)
            starts = [n for _, n in near]
        if lvl > self.top:
            self.entry, self.top = node, lvl

    def bulk(self, ids: list, vecs: np.ndarray) -> None:
        """Insert distinct ids into an empty graph, in order, as ``add`` would with candidates that are exact: all distances come
        from one matrix product.  For shards of up to BULK_ROWS rows."""
        x = np.asarray(vecs, np.float32)
        x = unit(x) if self.metric == "cosine" else x
        n = len(ids)
        far = scores(x, x, self.metric)
        self.x, self.n, self.ids, self.at = x, n, list(ids), {id_: i for i, id_ in enumerate(ids)}
        self.levels = [level(str(id_), i, self.m, self.seed) for i, id_ in enumerate(ids)]
        self.links = [[[] for _ in range(lvl + 1)] for lvl in self.levels]
        levels = np.array(self.levels)
        reach = [np.flatnonzero(levels >= at) for at in range(int(levels.max()) + 1 if n else 0)]

        def thin(base: int, nodes: np.ndarray, m: int) -> list[int]:
            """Of nodes in order of distance those closer to the base than to any kept before."""
            d, kept, at = far[base, nodes], [], 0
            closest = np.full(len(nodes), np.inf)
            while at < len(nodes) and len(kept) < m:
                kept.append(int(nodes[at]))
                closest = np.minimum(closest, far[nodes[at], nodes])
                left = np.flatnonzero(closest[at + 1 :] >= d[at + 1 :])
                at = at + 1 + int(left[0]) if len(left) else len(nodes)
            return kept

        for i, lvl in enumerate(self.levels):
            for at in range(min(lvl, self.top), -1, -1):
                nodes = reach[at][: np.searchsorted(reach[at], i)]
                d = far[i, nodes]
                if len(nodes) > self.efc:
                    pick = np.argpartition(d, self.efc - 1)[: self.efc]
                    nodes, d = nodes[pick], d[pick]
                chosen = thin(i, nodes[np.lexsort((nodes, d))], self.m)
                self.links[i][at] = chosen
                cap = 2 * self.m if at == 0 else self.m
                for b in chosen:
                    mine = self.links[b][at]
                    mine.append(i)
                    if len(mine) > cap:
                        near = np.array(mine)
                        self.links[b][at] = thin(b, near[np.lexsort((near, far[b, near]))], cap)
            if lvl > self.top:
                self.entry, self.top = i, lvl

    def remove(self, id_) -> bool:
        node = self.at.pop(id_, None)
        if node is None:
            return False
        self.dead.add(node)
        return True

    def search(self, v, k: int, ef: int | None = None, ok=None, trace: list | None = None) -> list[tuple]:
        """(id, distance) of the k nearest, by (distance, order of insertion).  ``trace`` gets a dict per layer."""
        k, ef = clamp(k, ef)
        if not k or self.entry < 0:
            return []
        q, node = self.prepared(v), self.entry
        for at in range(self.top, 0, -1):
            hops: list | None = [] if trace is not None else None
            start, node = node, self._descend(q, node, at, hops)
            if trace is not None:
                trace.append({"level": at, "entry": self.ids[start], "visited": len(hops) + 1, "hops": hops})
        hops = [] if trace is not None else None
        near, seen = self._beam(q, [node], ef, 0, lambda n: n not in self.dead and (ok is None or ok(self.ids[n])), hops)
        if trace is not None:
            trace.append({"level": 0, "entry": self.ids[node], "visited": seen, "hops": hops})
        return [(self.ids[n], d) for d, n in near[:k]]

    def searches(self, q: np.ndarray, k: int, ef: int | None = None, ok=None, traced: bool = False) -> Iterator[tuple[list[tuple], list | None]]:
        """What ``search`` finds for each row of ``q``, and its trace.  The distances of a few queries to all nodes of a shard of up to
        BULK_ROWS rows come from one matrix product."""
        for lo in range(0, len(q), 64):
            part = q[lo : lo + 64]
            far = scores(self.x[: self.n], np.stack([self.prepared(v) for v in part]), self.metric) if 0 < self.n <= BULK_ROWS else [None] * len(part)
            for v, row in zip(part, far, strict=True):
                layers: list | None = [] if traced else None
                self.far = None if row is None else row.tolist()
                try:
                    found = self.search(v, k, ef, ok, layers)
                finally:
                    self.far = None
                yield found, layers

    def compacted(self) -> Hnsw:
        """A fresh graph of the live rows in order of insertion."""
        out = Hnsw(self.metric, self.m, self.efc, self.seed, self.extend)
        for n in range(self.n):
            if n not in self.dead:
                out.add(self.ids[n], self.x[n])
        return out

    def dumps(self) -> bytes:
        """Everything as bytes: magic, checksum, then a header and arrays that hold no code."""
        lists = [near for levels in self.links for near in levels]
        head = {"version": FORMAT, "metric": self.metric, "m": self.m, "efc": self.efc, "seed": self.seed, "extend": self.extend, "dim": int(self.x.shape[1]), "count": self.n, "entry": self.entry, "top": self.top}
        out = io.BytesIO()
        np.savez(
            out, head=np.frombuffer(json.dumps(head).encode(), np.uint8), ids=np.frombuffer(json.dumps(self.ids).encode(), np.uint8), levels=np.array(self.levels, np.int16), x=self.x[: self.n],
            sizes=np.array([len(x) for x in lists], np.int32), near=np.array([b for x in lists for b in x], np.int32), dead=np.array(sorted(self.dead), np.int32),
        )
        body = out.getvalue()
        return MAGIC + struct.pack("<I", zlib.crc32(body)) + body

    @classmethod
    def loads(cls, data: bytes) -> Hnsw:
        """The graph that ``dumps`` wrote; ValueError if anything in it can't be."""
        body = data[8:]
        if data[:4] != MAGIC or struct.unpack("<I", data[4:8])[0] != zlib.crc32(body):
            raise ValueError("not a graph, or a damaged one")
        a = np.load(io.BytesIO(body), allow_pickle=False)
        head, ids = json.loads(a["head"].tobytes()), json.loads(a["ids"].tobytes())
        if head["version"] != FORMAT:
            raise ValueError(f"unknown graph version {head['version']}")
        n, levels, sizes, near, entry = head["count"], a["levels"], a["sizes"], a["near"], head["entry"]
        if not len(ids) == len(levels) == len(a["x"]) == n or (n and (levels.min() < 0 or levels.max() > MOST_LEVELS)) or (n and a["x"].shape[1] != head["dim"]):
            raise ValueError("a graph whose nodes don't agree")
        if len(sizes) != int((levels.astype(np.int64) + 1).sum()) or int(sizes.sum()) != len(near) or (len(near) and (near.min() < 0 or near.max() >= n)):
            raise ValueError("a graph with links to nowhere")
        if (n == 0) != (entry < 0) or (n and (entry >= n or levels[entry] != head["top"])) or (len(a["dead"]) and (a["dead"].min() < 0 or a["dead"].max() >= n)):
            raise ValueError("a graph without a valid entry")
        g = cls(head["metric"], head["m"], head["efc"], head["seed"], head["extend"])
        g.ids, g.levels, g.x, g.n, g.entry, g.top, g.dead = ids, levels.tolist(), a["x"], n, entry, head["top"], set(a["dead"].tolist())
        ends = np.cumsum(sizes)
        lists = [x.tolist() for x in np.split(near, ends[:-1])] if len(sizes) else []
        first = np.concatenate([[0], np.cumsum(levels.astype(np.int64) + 1)])
        g.links = [lists[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        g.at = {id_: i for i, id_ in enumerate(ids) if i not in g.dead}
        return g

    def level_stats(self) -> list[tuple[int, int, float, int]]:
        """(level, live nodes, average degree, largest degree) of each level."""
        out = []
        for at in range(self.top + 1):
            degree = [len(self.links[n][at]) for n in range(self.n) if n not in self.dead and self.levels[n] >= at]
            out.append((at, len(degree), float(np.mean(degree)) if degree else 0.0, max(degree, default=0)))
        return out


def build(base: DataFrame, metric: str = "cosine", m: int = 16, ef_construction: int = 200, shards: int | None = None, seed: int = DEFAULT_SEED, vid: str = "vid", vec: str = "vec") -> DataFrame:
    """shard, rows, graph (binary): rows are inserted in order of id within their shard."""
    if shards is None:
        shards = max(1, -(-base.count() // SHARD_ROWS))
    rows = base.select(F.pmod(F.xxhash64(F.col(vid)), F.lit(shards)).cast("int").alias("shard"), F.col(vid).alias("vid"), F.col(vec).alias("vec"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        g = Hnsw(metric, m, ef_construction, seed)
        pdf = pdf.sort_values("vid")
        if len(pdf) <= BULK_ROWS and pdf["vid"].is_unique:
            g.bulk(pdf["vid"].tolist(), np.stack(pdf["vec"].to_numpy()))
        else:
            for id_, v in pdf[["vid", "vec"]].itertuples(index=False):
                g.add(id_, v)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "rows": [len(pdf)], "graph": [g.dumps()]})

    return rows.groupBy("shard").applyInPandas(one, "shard int, rows long, graph binary")


def _over(graphs: DataFrame, queries: list[tuple] | DataFrame, schema: str, work) -> DataFrame:
    """``work(shard, graph, qids, vectors, fields)`` for each shard and the queries: a set that fits a block is broadcast, a larger one
    is cut into blocks, rows of a table that meet every shard.  What is made is sent on in batches as it is made."""
    kinds = T.StructType.fromDDL(schema)
    fields = pa.schema([pa.field(f.name, knn._arrow(f.dataType)) for f in kinds])
    held = queries if isinstance(queries, list) else knn._collected(queries, "vec")
    if held is not None:
        asked = pa.array([r[0] for r in held], fields.field("qid").type), [np.asarray(r[1], np.float32) for r in held]
        shared = graphs.sparkSession.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield from work(batch.column("shard")[i].as_py(), Hnsw.loads(batch.column("graph")[i].as_py()), *shared.value, fields)

        return graphs.select("shard", "graph").mapInArrow(run, kinds)
    size = queries.agg(F.sum(F.size("vec").cast("long") * 4 + 16)).first()[0]
    cut = queries.groupBy(F.pmod(F.xxhash64("qid"), F.lit(-(-size // knn.BLOCK_BYTES))).alias("block")).agg(F.collect_list(F.struct("qid", "vec")).alias("asked"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked = batch.column("asked")[i].values
                q = matrix(asked.field("vec")).astype(np.float32)
                yield from work(batch.column("shard")[i].as_py(), Hnsw.loads(batch.column("graph")[i].as_py()), asked.field("qid"), q, fields)

    return graphs.select("shard", "graph").crossJoin(cut.drop("block")).mapInArrow(meet, kinds)


def search(graphs: DataFrame, queries: list[tuple] | DataFrame, k: int, ef: int | None = None, ok=None, kind: str = "long") -> DataFrame:
    """qid, vid, dist, rk: every shard is searched for every query (qid, vec); the best of all shards are ranked."""
    qid = "long" if isinstance(queries, list) else dict(queries.dtypes)["qid"]

    def work(_, g: Hnsw, qids: pa.Array, q, fields: pa.Schema) -> Iterator[pa.RecordBatch]:
        step = max(1, knn.OUT_ROWS // max(1, k))
        for lo in range(0, len(q), step):
            out = [(i, id_, round(d, knn.DIGITS) + 0.0) for i, (found, _) in enumerate(g.searches(q[lo : lo + step], k, ef, ok), lo) for id_, d in found]
            at, ids, d = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(at, pa.int64())), pa.array(ids, fields.field("vid").type), pa.array(d, pa.float64())], schema=fields)

    return knn._ranked(_over(graphs, queries, f"qid {qid}, vid {kind}, dist double", work), k)


def trace(graphs: DataFrame, queries: list[tuple] | DataFrame, k: int, ef: int | None = None, kind: str = "long") -> DataFrame:
    """qid, shard, level, entry, visited, hops (array of from, to, dist) of each layer of each search."""
    qid = "long" if isinstance(queries, list) else dict(queries.dtypes)["qid"]
    schema = f"qid {qid}, shard int, level int, entry {kind}, visited long, hops array<struct<from: {kind}, to: {kind}, dist: double>>"

    def work(shard: int, g: Hnsw, qids: pa.Array, q, fields: pa.Schema) -> Iterator[pa.RecordBatch]:
        ids = pa.array(g.ids, fields.field("entry").type)
        hop = fields.field("hops").type

        def made(layers: list[tuple[int, dict]]) -> pa.RecordBatch:
            ends = np.cumsum([0] + [len(t["hops"]) for _, t in layers])
            a, b, d = zip(*(h for _, t in layers for h in t["hops"]), strict=True) if ends[-1] else ((), (), ())
            each = pa.StructArray.from_arrays([ids.take(pa.array(a, pa.int64())), ids.take(pa.array(b, pa.int64())), pa.array(d, pa.float64())], fields=list(hop.value_type))
            hops = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each).cast(hop)
            return pa.RecordBatch.from_arrays(
                [
                    qids.take(pa.array([i for i, _ in layers])), pa.array([shard] * len(layers), pa.int32()), pa.array([t["level"] for _, t in layers], pa.int32()),
                    pa.array([t["entry"] for _, t in layers], ids.type), pa.array([t["visited"] for _, t in layers], pa.int64()), hops,
                ],
                schema=fields,
            )

        layers, waiting = [], 0
        for i, (_, got) in enumerate(g.searches(q, k, ef, traced=True)):
            layers += [(i, t) for t in got]
            waiting += sum(len(t["hops"]) for t in got)
            if waiting >= knn.OUT_ROWS:
                yield made(layers)
                layers, waiting = [], 0
        if layers:
            yield made(layers)

    return _over(graphs, queries, schema, work)


def visited(traced: DataFrame) -> DataFrame:
    """qid, visited: the nodes that each search looked at, over all layers and shards."""
    return traced.groupBy("qid").agg(F.sum("visited").alias("visited"))


def stats(graphs: DataFrame) -> DataFrame:
    """level, nodes, avg_degree, max_degree over all shards."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for g in map(Hnsw.loads, pdf["graph"]):
                yield pd.DataFrame(g.level_stats(), columns=["level", "nodes", "avg_degree", "max_degree"])

    each = graphs.mapInPandas(run, "level int, nodes long, avg_degree double, max_degree int")
    mean = F.coalesce(F.try_divide(F.sum(F.col("avg_degree") * F.col("nodes")), F.sum("nodes")), F.lit(0.0))
    return each.groupBy("level").agg(F.sum("nodes").alias("nodes"), F.round(mean, 6).alias("avg_degree"), F.max("max_degree").alias("max_degree"))
