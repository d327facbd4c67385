"""Kernels, codes, search, graphs, logs and store against plain mirrors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.functions import kernels as K
from halyard.functions import product_quant as PQ
from halyard.functions import scalar_quant as SQ
from halyard.functions import rng
from halyard.operators import graph, knn
from halyard.plans import planner
from halyard.sources import datagen, jsonl, wal
from halyard.streaming import changelog
from halyard.streaming.store import SearchPool, VectorStore, ingest


@pytest.fixture(scope="module")
def data():
    return datagen.clusters(600, 16, 12, 7)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vid long, vec array<float>")


def truth(base, q, k, metric, keep=None):
    x, y = (knn.unit(base), knn.unit(q)) if metric == "cosine" else (base, q)
    d = knn.scores(x, y, metric)
    rows = set()
    for i, row in enumerate(np.round(d, 6)):
        ids = [j for j in range(len(base)) if keep is None or keep(j)]
        rows |= {(i, j) for j in sorted(ids, key=lambda j: (row[j], j))[:k]}
    return rows


def test_generators_match_golden_values():
    assert rng.uniforms(42, 2).tolist() == [0.6011037519201636, 0.44829055899754167]
    assert rng.hash_seed("a") == 2596035572 and rng.hash_seed("β-unicode") == 2626166759
    levels = [rng.level(str(i), i) for i in range(10_000)]
    assert [levels.count(n) for n in range(4)] == [9414, 553, 31, 2]


@pytest.mark.parametrize("metric", K.METRICS)
def test_search_forms_agree_with_brute_force(spark, data, metric):
    base = frame(spark, data.vectors)
    q = frame(spark, data.queries[:5]).withColumnRenamed("vid", "qid")
    want = truth(data.vectors, data.queries[:5], 10, metric)
    for form in (knn.expressions, knn.blocks):
        assert {(r.qid, r.vid) for r in form(q, base, 10, metric).collect()} == want
    even = truth(data.vectors, data.queries[:5], 10, metric, lambda j: j % 10 == 0)
    assert {(r.qid, r.vid) for r in planner.search(q, base, 10, metric, where=F.expr("vid % 10 = 0")).collect()} == even


def test_packed_blocks_equal_broadcast(spark, data, monkeypatch):
    base, q = frame(spark, data.vectors), frame(spark, data.queries).withColumnRenamed("vid", "qid")
    one = knn.blocks(q, base, 3).collect()
    monkeypatch.setattr(knn._collected, "__defaults__", (100,))
    assert sorted(knn.blocks(q, base, 3).collect()) == sorted(one)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("score", [None, lambda x, q, metric: knn.scores(x, q, metric)])
def test_long_neighbour_lists_are_ranked_where_they_are_found(spark, data, monkeypatch, score):
    """A task passes over all rows for a block of queries: its ranks are final, no pair is shuffled or sorted by Spark."""
    base, q = frame(spark, data.vectors).repartition(3), frame(spark, data.vectors[:50]).withColumnRenamed("vid", "qid")
    want = {(i, j) for i in range(50) for j in range(600) if i != j}
    monkeypatch.setattr(knn, "KEPT_SHARED", 10_000)
    monkeypatch.setattr(knn, "PACKED_ROWS", 100)
    monkeypatch.setattr(knn, "KEPT", 4_000)
    all_ = knn.blocks(q, base, 100_000, "euclidean", exclude_self=True, score=score)
    assert "Window" not in plan(all_) and {(r.qid, r.vid) for r in all_.collect()} == want
    some = knn.blocks(q, base, 300, "euclidean", exclude_self=True, score=score)
    monkeypatch.setattr(knn, "KEPT_SHARED", 1 << 20)
    shared = sorted(knn.blocks(q, base, 300, "euclidean", exclude_self=True, score=score).collect())
    assert "Window" not in plan(some) and sorted(some.collect()) == shared and len(shared) == 15_000
    # parts of the rows are ranked apart, then together
    monkeypatch.setattr(knn, "KEPT_SHARED", 10_000)
    monkeypatch.setattr(knn, "PART_BYTES", 20_000)
    assert sorted(knn.blocks(q, base, 300, "euclidean", exclude_self=True, score=score).collect()) == shared


@pytest.mark.parametrize("k", [5, 300])
@pytest.mark.parametrize("kind", ["int64", "string"])
def test_what_a_search_holds_does_not_grow_with_the_rows(monkeypatch, k, kind):
    import pyarrow as pa

    monkeypatch.setattr(knn, "OUT_ROWS", 64)
    g = np.random.default_rng(9)
    # few values, so many ties
    x, q = (g.integers(0, 3, (n, 4)).astype(np.float32) for n in (20_000, 7))
    ids, asked = pa.array(range(len(x))).cast(kind), pa.array(range(7)).cast(kind)
    near = knn.Nearest(asked, q, k, "euclidean", True, knn.DIGITS)
    for lo in range(0, len(x), 500):
        near.meet(ids[lo : lo + 500], x[lo : lo + 500])
        assert sum(len(r) for r, _, _ in near.held) <= max(64, 7 * k * 7 // 4) + 7 * 500
    got = [(r["qid"], r["vid"], r["rk"]) for batch in near.found() for r in batch.to_pylist()]
    names, d = ids.to_pylist(), np.round(knn.scores(x, q, "euclidean"), 6)
    want = [(names[i], names[j], n) for i in range(7) for n, j in enumerate(sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], names[j]))[:k], 1)]
    assert got == want


def test_degrees_take_one_pass_over_the_edges(spark, data):
    base = frame(spark, data.vectors)
    edges = graph.knn_graph(base, 4)
    one = graph.degree_stats(edges, base)
    assert plan(one).count("MapInArrow") == plan(edges).count("MapInArrow")
    into = np.bincount([r.dst for r in edges.collect()], minlength=600)
    assert one.first().asDict() == {"nodes": 600, "avg_out": 4.0, "max_out": 4, "max_in": int(into.max())}
    assert graph.degree_stats(edges.limit(0), base.limit(2)).first().asDict() == {"nodes": 2, "avg_out": 0.0, "max_out": 0, "max_in": 0}


@pytest.mark.parametrize("metric", K.METRICS)
def test_diverse_selection_of_many_bases_equals_one_by_one(spark, data, metric):
    base = frame(spark, data.vectors[:120])
    rows = graph.diverse_graph(base, 12, 5, metric)
    assert "MapInPandas" not in plan(rows)
    edges = {}
    for r in sorted(graph.knn_graph(base, 12, metric).collect(), key=lambda r: r.pos):
        edges.setdefault(r.src, []).append((r.dst, r.dist))
    x, want = knn.unit(data.vectors) if metric == "cosine" else data.vectors, set()
    for src, near in edges.items():
        y, d = x[[j for j, _ in near]], np.array([v for _, v in near])
        kept = graph.select_diverse(list(range(len(near))), d, lambda i, kept, y=y: knn.scores(y[kept], y[i : i + 1], metric)[0], 5)
        want |= {(src, near[i][0], near[i][1], p) for p, i in enumerate(kept, 1)}
    assert {tuple(r) for r in rows.collect()} == want


def test_search_edges(spark):
    base = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (None, [1.0, 1.0])], "vid long, vec array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, vec array<float>")
    assert [(r.vid, r.dist) for r in knn.blocks(q, base, 9).orderBy("rk").collect()] == [(2, 0.0), (1, 1.0)]
    assert knn.blocks(q, base, 0).collect() == [] and knn.blocks(q, base.limit(0), 3).collect() == []
    assert knn.clamp(10, 4) == (10, 10) and knn.clamp(0) == (0, 16)
    with pytest.raises(Exception, match="dimension mismatch"):
        base.select(K.prepare(F.col("vec"), "cosine", 3)).collect()


@pytest.mark.parametrize("encoding", ["sq8", "sq4"])
def test_scalar_codes(spark, data, encoding):
    base = frame(spark, data.vectors)
    cal = SQ.calibrate(base, encoding)
    coded = base.withColumn("q", SQ.encode(F.col("vec"), cal))
    for r in coded.withColumn("back", SQ.unpack(SQ.pack(F.col("q"), cal), cal)).withColumn("d", SQ.decode(F.col("q"), cal)).limit(50).collect():
        assert r.q == r.back and (np.abs(np.array(r.d) - np.array(r.vec)) <= cal.step / 2 + 1e-5).all()
    x = coded.withColumn("a", SQ.aux(F.col("q"), cal)).limit(20)
    y = F.array(*(F.lit(float(v)) for v in data.queries[0])).cast("array<float>")
    d = SQ.decode(F.col("q"), cal)
    got = x.select(SQ.asymmetric_euclidean(y, F.col("q"), F.col("a"), cal).alias("a"), K.distance(y, d, "euclidean").alias("b"), SQ.symmetric(F.col("q"), F.col("a"), F.col("q"), F.col("a"), cal, "cosine").alias("c")).collect()
    assert all(abs(r.a - r.b) < 1e-3 and abs(r.c) < 1e-6 for r in got)
    q = frame(spark, data.queries[:20]).withColumnRenamed("vid", "qid")
    exact = knn.blocks(q, base, 10, "euclidean")
    found = knn.blocks(q, coded.select("vid", SQ.decode(F.col("q"), cal).alias("vec")), 10, "euclidean")
    assert knn.recall(exact, found).agg(F.avg("recall")).first()[0] >= {"sq8": 0.85, "sq4": 0.6}[encoding]


def test_product_codes(spark, data):
    assert PQ.segments(10, 8) == [(0, 2), (2, 2), (4, 2), (6, 2), (8, 2)]
    base = frame(spark, data.vectors)
    book = PQ.train(base, 8, k=64)
    again = PQ.train(base.repartition(3), 8, k=64)
    assert all((a == b).all() for a, b in zip(book.books, again.books, strict=True))
    coded = PQ.encode(base, book)
    codes = np.array([r.codes for r in coded.orderBy("vid").collect()])
    assert (codes == book.encode(data.vectors)).all()
    d = book.distances(data.queries[0], codes, "euclidean")
    assert np.allclose(d, np.linalg.norm(book.decode(codes).astype(float) - data.queries[0], axis=1), atol=1e-5)
    with pytest.raises(ValueError, match="empty"):
        PQ.train(base.limit(0), 8)


def test_graph_is_exact_at_full_width_and_keeps_degrees(data):
    g = graph.Hnsw("euclidean", 8, 60)
    for i, v in enumerate(data.vectors[:300]):
        g.add(i, v)
    want = truth(data.vectors[:300], data.queries[:10], 5, "euclidean")
    assert {(i, n) for i, q in enumerate(data.queries[:10]) for n, _ in g.search(q, 5, 300)} == want
    assert all(len(links) <= (16 if at == 0 else 8) for node in g.links for at, links in enumerate(node))
    for i in range(150):
        assert g.remove(i)
    assert not g.remove(0) and all(n >= 150 for n, _ in g.search(data.queries[0], 20, 100))
    assert {n for n, _ in g.search(data.queries[0], 5, 400, lambda n: n % 10 == 0)} <= set(range(150, 300, 10))
    c = g.compacted()
    assert c.n == 150 and not c.dead and c.level_stats()[0][1] == 150
    layers = []
    assert g.search(data.queries[0], 3, 50, trace=layers) == g.search(data.queries[0], 3, 50) and layers[-1]["level"] == 0
    assert graph.Hnsw("dot").search([1.0], 3) == []
    with pytest.raises(ValueError):
        graph.Hnsw("dot", m=1)


def test_sharded_search(spark, data):
    base, q = frame(spark, data.vectors), frame(spark, data.queries[:20]).withColumnRenamed("vid", "qid")
    graphs = graph.build(base, "euclidean", ef_construction=50, shards=3)
    found = graph.search(graphs, [(i, v.tolist()) for i, v in enumerate(data.queries[:20])], 10, 64)
    assert knn.recall(knn.blocks(q, base, 10, "euclidean"), found).agg(F.avg("recall")).first()[0] >= 0.9
    assert graph.stats(graphs).where("level = 0").first().nodes == 600
    assert graph.trace(graphs, [(0, data.queries[0].tolist())], 3).where("level = 0").count() == 3


@pytest.mark.parametrize("work", ["trace", "search"])
def test_searches_of_graphs_are_sent_on_as_they_are_made(spark, data, monkeypatch, work):
    import pyarrow as pa

    base = frame(spark, data.vectors[:200])
    graphs = graph.build(base, "euclidean", 8, 40, 1).cache()
    asked = [(i, v.tolist()) for i, v in enumerate(data.queries[:30])]
    f = getattr(graph, work)
    want = sorted(f(graphs, asked, 5, 20).collect())
    monkeypatch.setattr(knn, "OUT_ROWS", 100)
    sizes, over = [], graph._over
    monkeypatch.setattr(graph, "_over", lambda graphs, queries, schema, work: sizes.append((schema, work)) or over(graphs, queries, schema, work))
    assert sorted(f(graphs, asked, 5, 20).collect()) == want
    schema, work = sizes[0]
    fields = pa.schema([(n, knn._arrow(t.dataType)) for n, t in zip(T.StructType.fromDDL(schema).names, T.StructType.fromDDL(schema), strict=True)])
    g = graph.Hnsw.loads(bytes(graphs.first().graph))
    batches = list(work(0, g, pa.array(range(30)), [np.array(v) for _, v in asked], fields))
    held = [sum(len(h) for h in b.column("hops")) if "hops" in fields.names else b.num_rows for b in batches]
    assert len(batches) >= 2 and max(held) <= 100 + 3 * 200
    one = [g.search(v, 5, 20) for _, v in asked]
    assert [found for found, _ in g.searches(np.array([v for _, v in asked], np.float32), 5, 20)] == [[(i, pytest.approx(d)) for i, d in x] for x in one]


def test_training_and_table_sums_work_in_steps(monkeypatch):
    g = np.random.default_rng(4)
    x = g.normal(size=(5000, 2)).astype(np.float32)
    whole = PQ._kmeans(x, 64, 3)
    import tracemalloc

    tracemalloc.start()
    monkeypatch.setattr(PQ, "STEP_ROWS", 100)
    steps = PQ._kmeans(x, 64, 3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all rows by all centroids would be 2.5 MB
    assert np.allclose(whole, steps) and most < 1 << 20
    v = g.normal(size=(300, 8)).astype(np.float32)
    book = PQ.Codebook(PQ.segments(8, 4), [v[:16, o : o + 2] for o in range(0, 8, 2)])
    for metric in K.METRICS:
        assert np.allclose(book.between(v[:9], book.encode(v), metric), np.stack([book.distances(q, book.encode(v), metric) for q in v[:9]]))


def test_gate_and_state_follow_a_mirror(spark):
    r = random.Random(5)
    ops = [(i + (5.5 if r.random() < 0.1 else 0.0), i, f"k{r.randrange(40)}", "delete" if r.random() < 0.2 else "upsert", r.random()) for i in range(2000)]
    log = spark.createDataFrame(ops, "pos double, seq long, id string, kind string, value double")
    seen, live, versions = -1, {}, 0
    applied = []
    for _, seq, key, kind, value in sorted(ops):
        if seq <= seen:
            continue
        seen = seq
        applied.append(seq)
        if kind == "upsert":
            live[key] = (seq, value)
            versions += 1
        else:
            live.pop(key, None)
    got = changelog.gated(log)
    assert sorted(x.seq for x in got.collect()) == applied
    assert {x.id: (x.seq, x.value) for x in changelog.live(got, "value").collect()} == live
    assert changelog.sizes(got).first().asDict() == {"live": len(live), "deleted": versions - len(live)}
    assert changelog.gated(log.limit(0)).count() == 0


def test_log_frames(spark, tmp_path):
    ops = [(11 + i, "delete" if i % 4 == 3 else "upsert", f"né {i % 5} 日", None if i % 4 == 3 else [i / 8, -i / 2]) for i in range(9)]
    frames = [wal.encode(*op) for op in ops]
    good = b"".join(frames)
    ends = np.cumsum([len(f) for f in frames]).tolist()
    p = wal.parse(good, 2)
    assert [op[1:] for op in p.ops] == ops and [op[0] for op in p.ops] == [0, *ends[:-1]] and not p.torn
    # cut off anywhere or with a bit turned anywhere, what lies before stays readable
    for at in range(0, len(good), 7):
        whole = sum(e <= at for e in ends)
        cut = wal.parse(good[:at], 2)
        assert len(cut.ops) == whole and cut.valid_bytes == ([0, *ends][whole]) and cut.torn == (at != cut.valid_bytes)
        turned = bytearray(good)
        turned[at] ^= 16
        assert len(wal.parse(bytes(turned), 2).ops) == whole
    path = f"{tmp_path}/a.log"
    (tmp_path / "a.log").write_bytes(good[: ends[5] + 3])
    assert wal.read(spark, path, 2).count() == 6
    assert wal.repair(spark, path, 2) == 3 and (tmp_path / "a.log").read_bytes() == good[: ends[5]] and wal.repair(spark, path, 2) == 0
    # broken off between its steps
    (tmp_path / "a.log").rename(tmp_path / "a.log.repaired")
    assert wal.repair(spark, path, 2) == 0 and wal.read(spark, path, 2).count() == 6


def test_store_lifecycle(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    s = VectorStore(spark, path, dim=2, metric="euclidean")
    rows = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [3.0, 4.0]), ("c", [9.0, 9.0])], "id string, vec array<float>")
    assert s.upsert(rows) == 3 and s.remove(["c", "nobody"]) == 1
    q = spark.createDataFrame([(0, [0.0, 0.0])], "qid long, vec array<float>")
    pool = SearchPool(s)
    s.upsert(rows.limit(1).withColumn("vec", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")))
    assert [(r.vid, r.dist) for r in s.search(q, 5).orderBy("rk").collect()] == [("a", 1.0), ("b", 5.0)]
    assert [r.dist for r in pool.search(q, 1).collect()] == [0.0]
    pool.refresh()
    assert [r.dist for r in pool.search(q, 1).collect()] == [1.0]
    pool.close()
    with pytest.raises(RuntimeError, match="closed"):
        pool.search(q)
    with pytest.raises(ValueError, match="dimension mismatch"):
        s.upsert(spark.createDataFrame([("d", [1.0])], "id string, vec array<float>"))
    s.checkpoint()
    assert s.sizes() == {"live": 2, "deleted": 2} and s.info()["opsSinceCheckpoint"] == 0
    s.close()
    with pytest.raises(ValueError, match="conflicting"):
        VectorStore(spark, path, dim=3)
    s = VectorStore(spark, path)
    assert s.get("b") == [3.0, 4.0] and s.get("c") is None
    assert s.compact() == {"before": 4, "after": 2} and s.sizes() == {"live": 2, "deleted": 0}
    s.close()


def test_pointer_survives_a_crash_at_any_step(spark, tmp_path, monkeypatch):
    from halyard.sources.fs import Files

    path = f"file://{tmp_path}/store"
    rows = lambda x: spark.createDataFrame([("a", [x, 0.0]), ("b", [3.0, x])], "id string, vec array<float>")
    for step in ("write_bytes", "rename", "delete"):
        s = VectorStore(spark, path, dim=2)
        s.upsert(rows(1.0))
        s.checkpoint()
        s.upsert(rows(2.0))
        before = {r.id: r.vec for r in s.live().collect()}
        with monkeypatch.context() as m:
            m.setattr(Files, step, lambda *a: (_ for _ in ()).throw(OSError("crash")))
            with pytest.raises(OSError, match="crash"):
                s.checkpoint()
        s.close()
        s = VectorStore(spark, path)
        assert {r.id: r.vec for r in s.live().collect()} == before, step
        s.upsert(rows(5.0))
        s.checkpoint()
        assert s.get("a") is not None and s.sizes()["live"] == 2
        s.close()


@pytest.mark.parametrize("quantization", ["sq8", "sq4", "pq"])
def test_calibration_is_made_once_and_kept(spark, tmp_path, monkeypatch, quantization):
    g = np.random.default_rng(3)
    x = g.normal(size=(300, 8)).astype(np.float32)
    rows = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(x)], "id string, vec array<float>")
    s = VectorStore(spark, f"file://{tmp_path}/store", dim=8, metric="euclidean", quantization=quantization, pq_subspaces=4)
    with pytest.raises(ValueError, match="empty"):
        s.calibrate()
    s.upsert(rows)
    exact = {r.id: r.vec for r in s.encoded().collect()}
    assert np.allclose(exact["v7"], x[7])
    s.calibrate()
    with pytest.raises(RuntimeError, match="already"):
        s.calibrate()
    coded = {r.id: r.vec for r in s.encoded().collect()}
    assert 0 < np.abs(np.array([coded[f"v{i}"] for i in range(300)]) - x).max() < 2
    s.close()
    monkeypatch.setattr(PQ, "train", None)
    s = VectorStore(spark, f"file://{tmp_path}/store")
    assert {r.id: r.vec for r in s.encoded().collect()} == coded
    codes = [3] * (4 if quantization == "pq" else 8)
    assert s.upsert_codes(spark.createDataFrame([("c", codes)], "id string, codes array<int>")) == 1 and len(s.get("c")) == 8
    other = VectorStore(spark, f"file://{tmp_path}/other", dim=3, quantization=quantization)
    import json

    made = json.loads(s.files.get(f"{s.path}/calibration"))
    with pytest.raises(ValueError, match="dimension mismatch"):
        other.adopt(made)
    s.close()
    other.close()
    with pytest.raises(ValueError, match="nothing to calibrate"):
        VectorStore(spark, f"file://{tmp_path}/plain", dim=2).calibrate()


def test_store_searches_its_graphs(spark, tmp_path):
    g = np.random.default_rng(5)
    x = g.normal(size=(400, 16)).astype(np.float32)
    s = VectorStore(spark, f"file://{tmp_path}/store", dim=16, metric="euclidean")
    s.upsert(spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(x)], "id string, vec array<float>"))
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(20)], "qid long, vec array<float>")
    exact = {(r.qid, r.vid) for r in s.search(q, 10).collect()}
    assert s.graphs() is None and {(r.qid, r.vid) for r in s.search(q, 10, ef=64).collect()} == exact
    s.index()
    near = {(r.qid, r.vid) for r in s.search(q, 10, ef=64).collect()}
    few = {(r.qid, r.vid) for r in s.search(q, 10, ef=10).collect()}
    assert len(near & exact) >= 0.95 * len(exact) and len(few) == 200 and len(few & exact) <= len(near & exact)
    even = {r.vid for r in s.search(q, 10, F.expr("id like '%0'"), ef=64).collect()}
    assert all(v.endswith("0") for v in even)
    hits, traced = s.search_with_trace(q, 10, 64)
    assert {(r.qid, r.vid) for r in hits.collect()} == near
    seen = {r.qid: r.visited for r in graph.visited(traced).collect()}
    assert len(seen) == 20 and all(10 <= n <= 500 for n in seen.values())
    s.remove(["v0"])
    assert s.graphs() is None and "v0" not in {r.vid for r in s.search(q, 10, ef=64).collect()}
    s.close()


def test_stored_graphs_are_checked():
    g = np.random.default_rng(6)
    h = graph.Hnsw("cosine", 4, 20)
    for i in range(60):
        h.add(f"n{i % 55}", g.normal(size=5))
    data = h.dumps()
    back = graph.Hnsw.loads(data)
    q = g.normal(size=5)
    assert back.search(q, 7, 20) == h.search(q, 7, 20) and back.dead == h.dead and back.links == h.links
    back.add("new", g.normal(size=5))
    assert graph.Hnsw.loads(graph.Hnsw("dot").dumps()).search([1.0], 3) == []
    with pytest.raises(ValueError, match="damaged"):
        graph.Hnsw.loads(data[:-1] + bytes([data[-1] ^ 1]))
    for change, what in ((lambda x: x.links[3][0].append(99), "nowhere"), (lambda x: x.levels.append(0), "agree"), (lambda x: setattr(x, "entry", 77), "entry")):
        bad = graph.Hnsw.loads(data)
        change(bad)
        with pytest.raises(ValueError, match=what):
            graph.Hnsw.loads(bad.dumps())


@pytest.mark.parametrize("metric", K.METRICS)
def test_bulk_build_is_a_graph_like_any(metric):
    g = np.random.default_rng(8)
    x = g.normal(size=(900, 12)).astype(np.float32)
    one, two = graph.Hnsw(metric, 8, 60), graph.Hnsw(metric, 8, 60)
    one.bulk([f"n{i}" for i in range(900)], x)
    for i, v in enumerate(x):
        two.add(f"n{i}", v)
    assert one.levels == two.levels and (one.entry, one.top) == (two.entry, two.top)
    assert all(len(near) <= (16 if at == 0 else 8) for links in one.links for at, near in enumerate(links))
    y = knn.unit(x) if metric == "cosine" else x
    found = []
    for h in (one, two):
        hits = 0
        for q in range(0, 900, 30):
            truth = {f"n{i}" for i in np.argsort(knn.scores(y, y[q][None], metric)[0], kind="stable")[:10]}
            hits += len(truth & {id_ for id_, _ in h.search(x[q], 10, 80)})
        found.append(hits / 300)
    assert found[0] >= 0.9 and found[0] >= found[1] - 0.05
    back = graph.Hnsw.loads(one.dumps())
    back.add("n5", x[6])
    assert back.search(x[6], 2, 60)[0][1] <= back.search(x[6], 2, 60)[1][1] and 5 in back.dead
    empty = graph.Hnsw(metric)
    empty.bulk([], np.zeros((0, 3)))
    assert empty.search(np.zeros(3), 2) == []


def test_large_query_sets_go_as_blocks(spark, monkeypatch):
    g = np.random.default_rng(7)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(g.normal(size=(200, 8)))], "vid long, vec array<float>")
    graphs = graph.build(base, "euclidean", 8, 40, 2).cache()
    q = base.select(F.col("vid").alias("qid"), "vec").limit(30)
    want = sorted(map(tuple, graph.search(graphs, q, 5, 40).collect()))
    monkeypatch.setattr(knn, "BLOCK_BYTES", 300)
    monkeypatch.setattr(knn._collected, "__defaults__", (300,))
    assert sorted(map(tuple, graph.search(graphs, q, 5, 40).collect())) == want and len(want) == 150


def test_replayed_batches_are_written_once(spark, tmp_path):
    s = VectorStore(spark, f"file://{tmp_path}/store", dim=1, checkpoint_every=0)
    rows = spark.createDataFrame([("a", [1.0])], "id string, vec array<float>")
    assert [s.upsert(rows, ("one", n)) for n in (0, 0, 1, 1, 0)] == [1, 0, 1, 0, 0] and s.upsert(rows, ("two", 0)) == 1
    s.checkpoint()
    assert s.upsert(rows, ("one", 1)) == 0 and s.sizes() == {"live": 1, "deleted": 2}
    s.close()


def test_pool_closes_after_what_is_under_way(spark, tmp_path):
    s = VectorStore(spark, f"file://{tmp_path}/store", dim=1, metric="euclidean")
    s.upsert(spark.createDataFrame([(f"v{i}", [float(i)]) for i in range(5)], "id string, vec array<float>"))
    pool = SearchPool(s)
    found = [pool.search_async(spark.createDataFrame([(0, [float(i)])], "qid long, vec array<float>"), 1) for i in range(5)]
    pool.close()
    assert [f.result()[0]["vid"] for f in found] == [f"v{i}" for i in range(5)]
    with pytest.raises(RuntimeError, match="closed"):
        pool.search_async(None)
    s.close()


def test_training_rows_are_drawn_at_any_size():
    assert PQ.SPACE * PQ.TRAIN_ROWS // 10**13 * 10**13 // PQ.SPACE in (PQ.TRAIN_ROWS - 1, PQ.TRAIN_ROWS)


def test_stream_into_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(f'{{"id": "v{j}", "vec": [{i}, {j}]}}' for j in range(4)) + "\n\n")
    s = VectorStore(spark, f"file://{tmp_path}/store", dim=2)
    ingest(jsonl.read_stream(spark, str(tmp_path / "in"), 1), s, str(tmp_path / "cp")).awaitTermination()
    assert s.sizes() == {"live": 4, "deleted": 8}
    s.close(checkpoint=True)
    assert VectorStore(spark, f"file://{tmp_path}/store").live().count() == 4


def test_http_routes(spark, tmp_path):
    import json
    import urllib.error
    import urllib.request

    from halyard.server import Server

    s = VectorStore(spark, f"file://{tmp_path}/store", dim=2, metric="euclidean")
    server = Server(s, port=0)

    def call(method, path, body=None):
        data = json.dumps(body).encode() if body is not None else None
        try:
            with urllib.request.urlopen(urllib.request.Request(server.url + path, data, method=method)) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    rows = [{"id": "é/1", "vec": [0, 1]}, {"id": "b", "vec": [3, 4]}, {"id": "b", "vec": [3, 3]}]
    assert call("POST", "/vectors", {"vectors": rows}) == (200, {"upserted": 3, "count": 2})
    assert call("GET", "/vectors/%C3%A9%2F1") == (200, {"id": "é/1", "vec": [0.0, 1.0]})
    status, found = call("POST", "/search", {"vec": [0, 0], "k": 1, "trace": True})
    assert status == 200 and found["results"] == [{"id": "é/1", "dist": 1.0}] and found["trace"][-1]["level"] == 0
    assert call("POST", "/search", {"vec": [0]})[0] == 400 and call("POST", "/vectors", {"vectors": 1})[0] == 400
    assert call("DELETE", "/vectors/b") == (200, {"removed": True}) and call("DELETE", "/vectors/b") == (200, {"removed": False})
    assert call("GET", "/vectors/b")[0] == 404 and call("GET", "/nowhere")[0] == 404
    assert call("POST", "/checkpoint") == (200, {"ok": True}) and call("GET", "/stats")[1]["deleted"] == 2
    assert call("GET", "/healthz") == (200, {"ok": True, "count": 1})
    server.close()
    s.close()
