"""A durable store of vectors: an ordered change log with snapshots, on any file system Spark reads.

Layout: ``meta.json`` (fixed options), ``log/`` (Parquet batches, one folder per write, named by sequence), ``snap-N/``
(live and dead versions up to sequence N), ``CURRENT`` (the valid snapshot), ``calibration`` (scales or codebooks, made
once), ``graph-N/`` and ``GRAPH`` (navigable graphs of sequence N), ``lock``.  Writes go to the log first; state is derived
from snapshot and log, so a crash loses nothing that was acknowledged.  Pointers are numbered files of which the newest counts.
"""

from __future__ import annotations

import hashlib
import json
import os
import socket
import uuid
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import kernels as K
from halyard.functions import product_quant as PQ
from halyard.functions import scalar_quant as SQ
from halyard.operators import graph, knn
from halyard.plans import planner
from halyard.sources.fs import Files
from halyard.sources.wal import MAX_ID_BYTES

VERSION, CHECKPOINT_EVERY = 1, 4096
SCHEMA = "seq long, kind string, id string, vec array<float>"


@dataclass
class Options:
    dim: int
    metric: str = "cosine"
    m: int = 16
    ef_construction: int = 200
    seed: int = 0x5356
    quantization: str = "none"
    pq_subspaces: int = 8
    version: int = field(default=VERSION)

    def check(self) -> Options:
        K.check_metric(self.metric)
        if self.dim < 1 or not 2 <= self.m <= 32767 or self.ef_construction < 1 or self.pq_subspaces < 1:
            raise ValueError("dim, ef_construction and pq_subspaces must be at least 1 and m in [2, 32767]")
        if self.quantization not in K.ENCODINGS:
            raise ValueError(f"unknown quantization {self.quantization!r}")
        return self


class VectorStore:
    def __init__(self, spark: SparkSession, path: str, checkpoint_every: int = CHECKPOINT_EVERY, **options):
        """Open or create.  Options given must agree with those the store was made with; omitted ones are inherited."""
        self.spark, self.path, self.every, self.files = spark, path.rstrip("/"), checkpoint_every, Files(spark)
        self._lock()
        try:
            self.options = self._meta(options)
            self.snapshot = int(self.files.get(f"{self.path}/CURRENT") or 0)
            self.calibration = self._calibration()
            batches = self._batches()
            self.seq = max([self.snapshot, *(int(b.split("-")[1]) for b in batches)])
            self.since = sum(int(b.split("-")[1]) - int(b.split("-")[0]) + 1 for b in batches)
        except BaseException:
            self.close()
            raise

    # -- files
    def _lock(self) -> None:
        self.lock = f"{self.path}/lock"
        mine = {"pid": os.getpid(), "host": socket.gethostname()}
        while not self.files.create(self.lock, json.dumps(mine)):
            try:
                held = json.loads(self.files.read(self.lock))
            except ValueError:
                held = {}
            if held == mine:
                return
            alive = held.get("host") != mine["host"]
            if not alive:
                try:
                    os.kill(held["pid"], 0)
                    alive = True
                except PermissionError:
                    alive = True
                except (OSError, KeyError):
                    pass
            if alive and held:
                raise RuntimeError(f"store is locked by process {held.get('pid')} on {held.get('host')}")
            self.files.delete(self.lock)

    def _meta(self, given: dict) -> Options:
        path = f"{self.path}/meta.json"
        found = self.files.get(path)
        if found is None:
            made = Options(**given).check()
            self.files.put(path, json.dumps(asdict(made)))
            return made
        kept = Options(**json.loads(found))
        if kept.version != VERSION:
            raise ValueError(f"unknown store version {kept.version}")
        odd = [f"{k}: store has {getattr(kept, k)}, got {v}" for k, v in given.items() if k != "seed" and getattr(kept, k) != v]
        if odd:
            raise ValueError("conflicting options: " + "; ".join(odd))
        return kept

    def _batches(self) -> list[str]:
        return sorted(b for b in self.files.names(f"{self.path}/log") if "-" in b and int(b.split("-")[1]) > self.snapshot and self.files.exists(f"{self.path}/log/{b}/_SUCCESS"))

    # -- writes
    def upsert(self, df: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Append id, vec rows; all are checked before any is written.  Of rows with one id the last (by ``ord``, if
        there is such a column) wins; earlier ones count as tombstones.  A ``batch`` (source, rising number) that was
        written before is passed over."""
        if batch and (int(self.files.get(f"{self.path}/from-{batch[0]}") or -1) >= batch[1] or any(b.endswith(f"-{batch[0]}.{batch[1]}") for b in self._batches())):
            return 0
        order = ["ord"] if "ord" in df.columns else []
        rows = df.select(F.col("id").cast("string"), F.col("vec").cast("array<float>"), *order)
        bad = rows.where((F.size("vec") != self.options.dim) | F.col("vec").isNull() | F.col("id").isNull() | (F.octet_length("id") > MAX_ID_BYTES)).select(F.size("vec")).first()
        if bad is not None:
            raise ValueError(f"vector dimension mismatch or bad id: expected {self.options.dim}, got {bad[0]}")
        return self._append(rows.withColumn("kind", F.lit("upsert")), order, batch)

    def upsert_codes(self, df: DataFrame) -> int:
        """Append id, codes rows: codes of this store's calibration, kept as what they stand for."""
        if self.calibration is None:
            raise RuntimeError("codes need a calibrated store")
        return self.upsert(self._decoded(df.select("id", "codes")))

    def remove(self, ids: list[str]) -> int:
        """Log deletes of those ids that are live; returns how many were."""
        found = self.live().where(F.col("id").isin(ids)).select("id", F.lit("delete").alias("kind"), F.lit(None).cast("array<float>").alias("vec"))
        return self._append(found, [])

    def _append(self, rows: DataFrame, order: list[str], batch: tuple[str, int] | None = None) -> int:
        # numbers without a single-task sort: place within the partition plus the sizes of those before it
        beside = f"{self.path}/log/.new-{uuid.uuid4().hex}"
        (rows.orderBy(*order) if order else rows).withColumn("_m", F.monotonically_increasing_id()).write.parquet(beside)
        held = self.spark.read.parquet(beside).withColumn("_p", F.shiftright("_m", 33))
        counts = held.groupBy("_p").count().orderBy("_p").collect()
        n, start = 0, []
        for r in counts:
            start.append((r["_p"], n))
            n += r["count"]
        if n:
            offset = F.create_map(*(F.lit(x) for p in start for x in p))[F.col("_p")]
            numbered = held.select((F.lit(self.seq + 1) + offset + F.col("_m").bitwiseAND((1 << 33) - 1)).alias("seq"), "kind", "id", "vec")
            # what a crash left under this name never counted
            tag = f"-{batch[0]}.{batch[1]}" if batch else ""
            numbered.write.mode("overwrite").parquet(f"{self.path}/log/{self.seq + 1:020d}-{self.seq + n:020d}{tag}")
        self.files.delete(beside)
        self.seq += n
        self.since += n
        if batch:
            self.files.put(f"{self.path}/from-{batch[0]}", str(batch[1]))
        if self.every and self.since >= self.every:
            self.checkpoint()
        return n

    # -- state
    def versions(self) -> DataFrame:
        """All versions and deletes: seq, kind, id, vec."""
        out = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/snap-{self.snapshot}") if self.snapshot else self.spark.createDataFrame([], SCHEMA)
        paths = [f"{self.path}/log/{b}" for b in self._batches()]
        return out.unionByName(self.spark.read.schema(SCHEMA).parquet(*paths)) if paths else out

    def live(self) -> DataFrame:
        last = self.versions().groupBy("id").agg(F.max_by(F.struct("kind", "seq", "vec"), "seq").alias("r"))
        return last.where("r.kind = 'upsert'").select("id", "r.seq", "r.vec")

    def checkpoint(self) -> None:
        """Fold the log into a new snapshot, move the pointer, drop what came before."""
        if self.seq == self.snapshot:
            return
        old, batches = self.snapshot, self._batches()
        self.versions().write.mode("overwrite").parquet(f"{self.path}/snap-{self.seq}")
        self._move(self.seq, old, batches)

    def _move(self, to: int, old: int, batches: list[str]) -> None:
        self.files.put(f"{self.path}/CURRENT", str(to))
        self.snapshot, self.since = to, 0
        for b in batches:
            self.files.delete(f"{self.path}/log/{b}")
        if old and old != to:
            self.files.delete(f"{self.path}/snap-{old}")

    def compact(self) -> dict:
        """Keep live versions only; {before: live and dead, after: live}."""
        n = self.sizes()
        old, batches = self.snapshot, self._batches()
        self.seq += 1
        self.live().select("seq", F.lit("upsert").alias("kind"), "id", "vec").write.mode("overwrite").parquet(f"{self.path}/snap-{self.seq}")
        self._move(self.seq, old, batches)
        return {"before": n["live"] + n["deleted"], "after": n["live"]}

    def sizes(self) -> dict:
        from halyard.streaming.changelog import sizes

        return sizes(self.versions()).first().asDict()

    def info(self) -> dict:
        n, o = self.sizes(), self.options
        return {"count": n["live"], "deleted": n["deleted"], "dataDir": self.path, "walBytes": sum(self.files.size(f"{self.path}/log/{b}") for b in self._batches()), "opsSinceCheckpoint": self.since, "bytesPerVector": K.bytes_per_vector(o.quantization, o.dim, o.pq_subspaces), "params": asdict(o)}

    # -- reads
    def get(self, id_: str) -> list[float] | None:
        row = self.live().where(F.col("id") == id_).select(K.prepare(F.col("vec"), self.options.metric).alias("v")).first()
        return row["v"] if row else None

    def search(self, queries: DataFrame, k: int = 10, where=None, ef: int | None = None) -> DataFrame:
        """qid, vid, dist, rk for the rows (qid, vec); over decoded codes once calibrated.

        Exact, unless ``ef`` asks for the graphs (see ``index``) and they are of this sequence; a filter is always exact.
        """
        return planner.search(queries, self.encoded(), k, self.options.metric, ef, where, self.graphs(), "id")

    def search_with_trace(self, queries: DataFrame, k: int = 10, ef: int | None = None) -> tuple[DataFrame, DataFrame]:
        """The search by graphs, which are built if there are none of this sequence, and its trace (see ``graph.trace``)."""
        graphs = self.graphs()
        graphs = self.index() if graphs is None else graphs
        k, width = knn.clamp(k, ef)
        return graph.search(graphs, queries, k, width, kind="string"), graph.trace(graphs, queries, k, width, "string")

    def index(self) -> DataFrame:
        """Build the navigable graphs of the present sequence and keep them; those of earlier ones go."""
        o, path, old = self.options, f"{self.path}/graph-{self.seq}", self.files.get(f"{self.path}/GRAPH")
        graph.build(self.encoded(), o.metric, o.m, o.ef_construction, seed=o.seed, vid="id").write.mode("overwrite").parquet(path)
        self.files.put(f"{self.path}/GRAPH", str(self.seq))
        if old is not None and int(old) != self.seq:
            self.files.delete(f"{self.path}/graph-{old}")
        return self.graphs()

    def graphs(self) -> DataFrame | None:
        """shard, rows, graph of the present sequence, if ``index`` made them."""
        found = self.files.get(f"{self.path}/GRAPH")
        return self.spark.read.schema("shard int, rows long, graph binary").parquet(f"{self.path}/graph-{found}") if found == str(self.seq) else None

    # -- codes
    def calibrate(self) -> None:
        """Make scales or codebooks from what is there, once; from then on searches are over codes.  Graphs keep their
        links, so those made before are dropped."""
        o = self.options
        if o.quantization == "none":
            raise ValueError("a store without quantization has nothing to calibrate")
        if self.calibration is not None:
            raise RuntimeError("already calibrated")
        ready = self.live().select("id", K.prepare(F.col("vec"), o.metric).alias("vec"))
        if ready.isEmpty():
            raise ValueError("cannot calibrate an empty store")
        if o.quantization == "pq":
            book = PQ.train(ready, o.pq_subspaces, seed=o.seed, order="id")
            made = {"dim": o.dim, "parts": book.parts, "books": [b.tolist() for b in book.books]}
        else:
            c = SQ.calibrate(ready, o.quantization)
            made = {"dim": o.dim, "levels": c.levels, "k": float(c.k)} | {k: getattr(c, k).astype(float).tolist() for k in ("low", "high", "step", "c")}
        self.adopt(made)
        self.checkpoint()

    def adopt(self, made: dict) -> None:
        """Take over the calibration of another store of the same dimension (the content of its file)."""
        if made["dim"] != self.options.dim:
            raise ValueError(f"calibration dimension mismatch: expected {self.options.dim}, got {made['dim']}")
        self.files.put(f"{self.path}/calibration", json.dumps(made))
        self.calibration = self._calibration()
        self.files.put(f"{self.path}/GRAPH", "-1")

    def _calibration(self) -> PQ.Codebook | SQ.Calibration | None:
        found = self.files.get(f"{self.path}/calibration")
        if found is None:
            return None
        made = json.loads(found)
        if "books" in made:
            return PQ.Codebook([tuple(p) for p in made["parts"]], [np.array(b, np.float32) for b in made["books"]])
        return SQ.Calibration(*(np.array(made[k], np.float32) for k in ("low", "high", "step", "c")), made["k"], made["levels"])

    def _decoded(self, coded: DataFrame) -> DataFrame:
        if isinstance(self.calibration, PQ.Codebook):
            return PQ.decode(coded, self.calibration).drop("codes")
        return coded.withColumn("vec", SQ.decode(F.col("codes"), self.calibration)).drop("codes")

    def encoded(self) -> DataFrame:
        """id, vec as the store's encoding keeps them: exact until it is calibrated, then decoded from codes."""
        if self.calibration is None:
            return self.live().select("id", "vec")
        ready = self.live().select("id", K.prepare(F.col("vec"), self.options.metric).alias("vec"))
        if isinstance(self.calibration, PQ.Codebook):
            return self._decoded(PQ.encode(ready, self.calibration).drop("vec"))
        return self._decoded(ready.select("id", SQ.encode(F.col("vec"), self.calibration).alias("codes")))

    def close(self, checkpoint: bool = False) -> None:
        if self.lock:
            if checkpoint:
                self.checkpoint()
            self.files.delete(self.lock)
            self.lock = ""


class SearchPool:
    """Readers of a pinned version; ``refresh`` moves them to the store's present one."""

    def __init__(self, store: VectorStore, readers: int = 4):
        self.store, self.pinned = store, None
        self.threads = ThreadPoolExecutor(readers)
        self.refresh()

    def refresh(self) -> None:
        self._open()
        old, self.pinned = self.pinned, self.store.encoded().persist()
        self.pinned.count()
        if old is not None:
            old.unpersist()

    def _open(self) -> None:
        if self.store is None:
            raise RuntimeError("pool is closed")

    def search(self, queries: DataFrame, k: int = 10, where=None) -> DataFrame:
        self._open()
        return knn.blocks(queries, self.pinned, k, self.store.options.metric, where, vid="id")

    def search_async(self, queries: DataFrame, k: int = 10, where=None) -> Future:
        """The rows of the search, when it is done; searches run side by side."""
        found = self.search(queries, k, where)
        return self.threads.submit(found.collect)

    def close(self) -> None:
        """Take no more searches, wait for those under way, then let go of the pinned version."""
        if self.store is not None:
            self.store = None
            self.threads.shutdown(wait=True)
            self.pinned.unpersist()


def ingest(stream: DataFrame, store: VectorStore, checkpoint: str):
    """Upsert every micro-batch of a stream of (id, vec) into the store; the query runs until what is there is read.  A batch
    that a restarted query replays is written once."""
    source = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    return stream.writeStream.foreachBatch(lambda df, n: store.upsert(df, (source, n))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
