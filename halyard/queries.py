"""Queries over the driver's tables, one per operator, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import kernels as K
from halyard.functions import product_quant as PQ
from halyard.functions import scalar_quant as SQ
from halyard.functions.rng import level
from halyard.operators import graph, knn
from halyard.session import shared_dir
from halyard.sources import datagen, wal
from halyard.streaming import changelog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return register


def base(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("vid"), F.col("embedding").alias("vec"), "label")


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """The query vectors: every id divisible by 50."""
    return base(spark, sf).where("vid % 50 = 0").select(F.col("vid").alias("qid"), "vec")


# SQL fragments: B raw vectors, N normalised ones (rounded to float), long forms by dimension
_B = "b AS (SELECT vec_id AS vid, embedding AS v, label FROM embeddings)"
_UNIT = "list_transform(v, lambda x: CAST(CASE WHEN sqrt(list_inner_product(v::DOUBLE[], v::DOUBLE[])) = 0 THEN x ELSE x::DOUBLE / sqrt(list_inner_product(v::DOUBLE[], v::DOUBLE[])) END AS FLOAT))"
_N = f"{_B}, n AS (SELECT vid, label, {_UNIT} AS v FROM b)"
_DIST = {
    "cosine": "1 - list_inner_product(q.v::DOUBLE[], n.v::DOUBLE[])",
    "euclidean": "list_distance(q.v::DOUBLE[], n.v::DOUBLE[])",
    "dot": "-list_inner_product(q.v::DOUBLE[], n.v::DOUBLE[])",
}


def _prepared(metric: str) -> str:
    return _N if metric == "cosine" else f"{_B}, n AS (SELECT * FROM b)"


def knn_sql(metric: str, k: int, where: str = "true", queries: str = "q.vid % 50 = 0", head: str | None = None, dist: str | None = None, q: str = "n", skip_self: bool = True) -> str:
    """Top k of ``n`` for the rows ``q`` of the prepared vectors ``head``."""
    return f"""WITH {head or _prepared(metric)},
s AS (SELECT q.vid AS qid, n.vid AS vid, round({dist or _DIST[metric]}, 6) + 0.0 AS dist FROM {q} q, n WHERE {queries} AND {'q.vid <> n.vid' if skip_self else 'true'} AND {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vid) AS rk FROM s)
SELECT qid, vid, dist, CAST(rk AS BIGINT) AS rk FROM r WHERE rk <= {k}"""


# -- kernels
def _kernel(name: str, value, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        one = base(spark, sf).where("vid = 0").select(F.col("vec").alias("q"))
        # the other side is one row
        return base(spark, sf).crossJoin(F.broadcast(one.limit(1))).select("vid", K.rounded(value(F.col("q"), F.col("vec"))).alias("value"))

    query(f"WITH {_N}, one AS (SELECT v FROM b WHERE vid = 0), u AS (SELECT v FROM n WHERE vid = 0) SELECT vid, round({sql}, 6) + 0.0 AS value FROM (SELECT b.vid, b.v AS x, n.v AS w, one.v AS y, u.v AS z FROM b JOIN n USING (vid), one, u)", name)(run)


_kernel("vec_dot", K.dot, "list_inner_product(x::DOUBLE[], y::DOUBLE[])")
_kernel("vec_sq_euclidean", K.sq_euclidean, "list_sum(list_transform(list_zip(x, y), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))")
_kernel("vec_norm", lambda q, v: K.norm(v), "sqrt(list_inner_product(x::DOUBLE[], x::DOUBLE[]))")
_kernel("dist_cosine", lambda q, v: K.distance(K.normalize(q), K.normalize(v), "cosine"), "1 - list_inner_product(w::DOUBLE[], z::DOUBLE[])")
_kernel("dist_euclidean", lambda q, v: K.distance(q, v, "euclidean"), "list_distance(x::DOUBLE[], y::DOUBLE[])")
_kernel("dist_dot", lambda q, v: K.distance(q, v, "dot"), "-list_inner_product(x::DOUBLE[], y::DOUBLE[])")


@query(f"WITH {_N} SELECT vid, CAST(unnest(range(64)) AS BIGINT) AS d, round(unnest(v)::DOUBLE, 6) + 0.0 AS x FROM n")
def vec_normalize(spark, sf):
    return base(spark, sf).select("vid", F.posexplode(K.normalize(F.col("vec"))).alias("d", "x")).select("vid", F.col("d").cast("long").alias("d"), K.rounded(F.col("x").cast("double")).alias("x"))


# -- exact search
for _m in K.METRICS:
    query(knn_sql(_m, 10), f"knn_{_m}")(lambda spark, sf, m=_m: knn.blocks(asked(spark, sf), base(spark, sf), 10, m, exclude_self=True))


@query(knn_sql("cosine", 5, queries="q.vid = 3", skip_self=False))
def knn_single(spark, sf):
    return knn.expressions(base(spark, sf).where("vid = 3").select(F.col("vid").alias("qid"), "vec"), base(spark, sf), 5)


@query(knn_sql("euclidean", 100_000))
def knn_k_gt_n(spark, sf):
    return knn.blocks(asked(spark, sf), base(spark, sf), 100_000, "euclidean", exclude_self=True)


@query("SELECT * FROM (VALUES (0, -1, 0, 16), (5, -1, 5, 16), (10, 4, 10, 10), (20, -1, 20, 20), (10, 64, 10, 64)) t(k_asked, ef_asked, k, ef)")
def knn_ef_clamp(spark, sf):
    rows = [(k, -1 if ef is None else ef, *knn.clamp(k, ef)) for k, ef in ((0, None), (5, None), (10, 4), (20, None), (10, 64))]
    return spark.createDataFrame(rows, "k_asked int, ef_asked int, k int, ef int")


def _filtered(name: str, where: str) -> None:
    sql = where.replace("vid", "n.vid").replace("label", "n.label")
    query(knn_sql("cosine", 10, where=sql), name)(lambda spark, sf: knn.blocks(asked(spark, sf), base(spark, sf), 10, where=F.expr(where), exclude_self=True))


_filtered("knn_filter_even", "vid % 2 = 0")
_filtered("knn_filter_10pct", "vid % 10 = 0")
_filtered("knn_filter_label", "label = 3")
_filtered("knn_tombstones", "vid % 4 <> 0")


@query(f"WITH {_N} SELECT vid, CAST(unnest(range(64)) AS BIGINT) AS d, round(unnest(v)::DOUBLE, 6) + 0.0 AS x FROM n WHERE vid = 7")
def point_lookup(spark, sf):
    return vec_normalize(spark, sf).where("vid = 7")


@query("SELECT * FROM (VALUES ('none', 256), ('sq8', 64), ('sq4', 32), ('pq', 8)) t(encoding, bytes)")
def bytes_per_vector(spark, sf):
    return spark.createDataFrame([(e, K.bytes_per_vector(e, 64)) for e in K.ENCODINGS], "encoding string, bytes int")


# -- scalar quantization
def _cal(levels: int, source: str = "n") -> str:
    """CTEs: x long form of the vectors, cal the calibration, code and deq."""
    return f"""x AS (SELECT vid, unnest(range(64)) AS d, unnest(v) AS x FROM {source}),
ranges AS (SELECT d, min(x) AS low, max(x) AS h FROM x GROUP BY d),
hi AS (SELECT d, low, CASE WHEN h <= low THEN CAST(low::DOUBLE + 1e-6 AS FLOAT) ELSE h END AS high FROM ranges),
cal AS (SELECT d, low, high, CAST((high::DOUBLE - low) / {levels} AS FLOAT) AS step FROM hi),
code AS (SELECT vid, d, CASE WHEN step = 0 THEN CASE WHEN x > low THEN {levels} ELSE 0 END ELSE least(greatest(floor((x::DOUBLE - low) / step::DOUBLE + 0.5), 0), {levels}) END AS q, low, step FROM x JOIN cal USING (d)),
deq AS (SELECT vid, d, CAST(q * step::DOUBLE + low AS FLOAT) AS y FROM code)"""


def _calibrated(spark, sf, encoding: str, metric: str = "cosine"):
    data = base(spark, sf).select("vid", "label", K.prepare(F.col("vec"), metric).alias("vec"))
    return data, SQ.calibrate(data, encoding)


@query(f"WITH {_B}, x AS (SELECT unnest(range(64)) AS d, unnest(v) AS x FROM b) SELECT CAST(d AS BIGINT) AS d, min(x)::DOUBLE AS low, max(x)::DOUBLE AS high FROM x GROUP BY d")
def calib_minmax(spark, sf):
    return SQ.dimension_ranges(base(spark, sf)).select(F.col("d").cast("long").alias("d"), F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))


for _e, _l in SQ.LEVELS.items():

    def _steps(spark, sf, e=_e):
        _, c = _calibrated(spark, sf, e)
        rows = [(d, round(float(s), 9), round(float(m), 6)) for d, (s, m) in enumerate(zip(c.step, c.low, strict=True))]
        return spark.createDataFrame(rows, "d long, step double, low double")

    query(f"WITH {_N}, {_cal(_l)} SELECT CAST(d AS BIGINT) AS d, round(step::DOUBLE, 9) AS step, round(low::DOUBLE, 6) AS low FROM cal", f"calib_{_e}")(_steps)

    def _codes(spark, sf, e=_e):
        data, c = _calibrated(spark, sf, e)
        # through the packed bytes and back
        codes = SQ.unpack(SQ.pack(SQ.encode(F.col("vec"), c), c), c)
        return data.select("vid", F.posexplode(codes).alias("d", "code")).select("vid", F.col("d").cast("long").alias("d"), F.col("code").cast("int").alias("code"))

    query(f"WITH {_N}, {_cal(_l)} SELECT vid, CAST(d AS BIGINT) AS d, CAST(q AS INTEGER) AS code FROM code", f"{_e}_encode")(_codes)

    for _m in K.METRICS:

        def _coded_knn(spark, sf, e=_e, m=_m):
            data, c = _calibrated(spark, sf, e, m)
            decoded = data.select("vid", SQ.decode(SQ.encode(F.col("vec"), c), c).alias("vec"))
            if m == "euclidean":
                return knn.blocks(asked(spark, sf), decoded, 10, m, exclude_self=True)
            # the query is coded too; cosine divides by the lengths of the decoded vectors
            q = decoded.where("vid % 50 = 0").select(F.col("vid").alias("qid"), "vec")
            return knn.blocks(q, decoded, 10, m, exclude_self=True, score=_cosine_of if m == "cosine" else None)

        _head = f"{_prepared(_m).replace(' n AS', ' p AS')}, {_cal(_l, 'p')}, n AS (SELECT vid, list(y ORDER BY d) AS v FROM deq GROUP BY vid)"
        _exact = _m == "euclidean"
        _sum = "1 - list_inner_product(q.v::DOUBLE[], n.v::DOUBLE[]) / sqrt(list_inner_product(q.v::DOUBLE[], q.v::DOUBLE[]) * list_inner_product(n.v::DOUBLE[], n.v::DOUBLE[]))" if _m == "cosine" else None
        query(knn_sql(_m, 10, head=_head, q="p" if _exact else "n", dist=_sum), f"{_e}_knn_{_m}")(_coded_knn)


def _cosine_of(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    x, q = x.astype(np.float64), q.astype(np.float64)
    den = np.sqrt((q**2).sum(axis=1))[:, None] * np.sqrt((x**2).sum(axis=1))[None]
    return np.where(den == 0, 1.0, 1 - q @ x.T / np.where(den == 0, 1, den))


@query(f"WITH {_N}, {_cal(255)} SELECT vid, CAST(d AS BIGINT) AS d, round(y::DOUBLE, 6) + 0.0 AS x FROM deq")
def sq8_dequant(spark, sf):
    data, c = _calibrated(spark, sf, "sq8")
    out = data.select("vid", F.posexplode(SQ.decode(SQ.encode(F.col("vec"), c), c)).alias("d", "x"))
    return out.select("vid", F.col("d").cast("long").alias("d"), K.rounded(F.col("x").cast("double")).alias("x"))


@query(
    f"""WITH {_N}, {_cal(255)}, t AS (SELECT vid, q, step::DOUBLE AS step, low::DOUBLE AS low, CAST(step::DOUBLE * low AS FLOAT)::DOUBLE AS c FROM code)
SELECT vid, round(sum(q * c), 6) + 0.0 AS dot_c, round(sqrt(sum((q * step + low) * (q * step + low))), 6) + 0.0 AS norm, round(sum(q * q * step * step), 6) + 0.0 AS self_w, round(sum(q * step * low), 6) + 0.0 AS xsm FROM t GROUP BY vid"""
)
def sq_aux(spark, sf):
    data, c = _calibrated(spark, sf, "sq8")
    a = data.select("vid", SQ.aux(SQ.encode(F.col("vec"), c), c).alias("a"))
    return a.select("vid", *(K.rounded(F.col(f"a.{k}")).alias(k) for k in ("dot_c", "norm", "self_w", "xsm")))


_CODED = f"WITH {_B}, {_cal(255, 'b')}, y AS (SELECT vid, d, q, step::DOUBLE AS step, low::DOUBLE AS low FROM code), one AS (SELECT d, q FROM y WHERE vid = 0), x0 AS (SELECT d, x::DOUBLE AS x FROM x WHERE vid = 0)"


def _with_first(spark, sf):
    """Codes and scalars of all rows, with the first row's vector, codes and scalars (one row, broadcast)."""
    data, c = _calibrated(spark, sf, "sq8", "euclidean")
    coded = data.select("vid", "vec", SQ.encode(F.col("vec"), c).alias("codes")).withColumn("aux", SQ.aux(F.col("codes"), c))
    return coded.crossJoin(F.broadcast(coded.where("vid = 0").limit(1).select(F.col("vec").alias("v0"), F.col("codes").alias("c0"), F.col("aux").alias("a0")))), c


@query(f"{_CODED} SELECT vid, round(sqrt(sum((x0.x - (q * step + low)) * (x0.x - (q * step + low)))), 5) + 0.0 AS value FROM y JOIN x0 USING (d) GROUP BY vid")
def sq8_asymmetric_euclidean(spark, sf):
    rows, c = _with_first(spark, sf)
    return rows.select("vid", K.rounded(SQ.asymmetric_euclidean(F.col("v0"), F.col("codes"), F.col("aux"), c), 5).alias("value"))


# step * low is kept as a float
_INNER = "sum(y.q * one.q * step * step + (y.q + one.q) * CAST(step * low AS FLOAT)::DOUBLE + low * low)"
_SYMMETRIC = {
    "euclidean": "sqrt(sum((y.q - one.q) * step * (y.q - one.q) * step))",
    "dot": f"-{_INNER}",
    "cosine": f"1 - {_INNER} / sqrt(sum((y.q * step + low) * (y.q * step + low)) * sum((one.q * step + low) * (one.q * step + low)))",
}
for _m in K.METRICS:

    def _symmetric(spark, sf, m=_m):
        rows, c = _with_first(spark, sf)
        return rows.select("vid", K.rounded(SQ.symmetric(F.col("codes"), F.col("aux"), F.col("c0"), F.col("a0"), c, m), 5).alias("value"))

    query(f"{_CODED} SELECT y.vid, round({_SYMMETRIC[_m]}, 5) + 0.0 AS value FROM y JOIN one USING (d) GROUP BY y.vid", f"sq8_symmetric_{_m}")(_symmetric)


def _recall_sql(levels: int) -> str:
    exact, coded = knn_sql("euclidean", 10), knn_sql("euclidean", 10, head=f"{_B}, p AS (SELECT * FROM b), {_cal(levels, 'p')}, n AS (SELECT vid, list(y ORDER BY d) AS v FROM deq GROUP BY vid)", q="p")
    return f"SELECT qid, round(count(c.vid) / count(*)::DOUBLE, 6) AS recall FROM ({exact}) e LEFT JOIN ({coded}) c USING (qid, vid) GROUP BY qid"


for _e, _l in SQ.LEVELS.items():

    def _recall(spark, sf, e=_e):
        return knn.recall(QUERIES["knn_euclidean"](spark, sf), QUERIES[f"{e}_knn_euclidean"](spark, sf)).select("qid", F.round("recall", 6).alias("recall"))

    query(_recall_sql(_l), f"recall_{_e}")(_recall)

# -- product quantization: a codebook of the first 16 vectors' segments, eight subspaces of eight dimensions
def _pq(metric: str) -> str:
    return (f"b0 AS (SELECT vec_id AS vid, embedding AS v FROM embeddings), b AS (SELECT vid, {_UNIT} AS v FROM b0)" if metric == "cosine" else _B) + _PQ_REST


_PQ_REST = """, seg AS (SELECT vid, unnest(range(8)) AS s, v FROM b),
g AS (SELECT vid, s, list_slice(v, CAST(8 * s + 1 AS BIGINT), CAST(8 * s + 8 AS BIGINT)) AS x FROM seg),
cb AS (SELECT s, vid AS c, x AS y FROM g WHERE vid < 16),
dd AS (SELECT g.vid, g.s, cb.c, list_sum(list_transform(list_zip(g.x, cb.y), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS d FROM g JOIN cb USING (s)),
code AS (SELECT vid, s, arg_min(c, (d, c)) AS c FROM dd GROUP BY vid, s),
n AS (SELECT code.vid, flatten(list(cb.y ORDER BY code.s)) AS v FROM code JOIN cb USING (s, c) GROUP BY code.vid)"""
_PQ = _pq("euclidean")


def _fixed(spark, sf, metric: str = "euclidean"):
    data = base(spark, sf).select("vid", K.prepare(F.col("vec"), metric).alias("vec"))
    book = PQ.fixed(data, 8, 16)
    return data, book, PQ.encode(data, book)


@query(f"WITH {_PQ} SELECT vid, CAST(s AS BIGINT) AS sub, CAST(c AS INTEGER) AS code FROM code")
def pq_encode_fixed(spark, sf):
    _, _, coded = _fixed(spark, sf)
    return coded.select("vid", F.posexplode("codes").alias("sub", "code")).select("vid", F.col("sub").cast("long").alias("sub"), "code")


@query(f"WITH {_PQ} SELECT vid, CAST(unnest(range(64)) AS BIGINT) AS d, round(unnest(v)::DOUBLE, 6) + 0.0 AS x FROM n")
def pq_reconstruct_fixed(spark, sf):
    _, book, coded = _fixed(spark, sf)
    out = PQ.decode(coded.drop("vec"), book).select("vid", F.posexplode("vec").alias("d", "x"))
    return out.select("vid", F.col("d").cast("long").alias("d"), K.rounded(F.col("x").cast("double")).alias("x"))


def _by_table(book: PQ.Codebook, metric: str):
    """A score for coded rows: table sums per query."""
    return lambda codes, q, _: book.between(q, codes, metric)


def _coded(coded: DataFrame) -> DataFrame:
    return coded.select("vid", F.col("codes").alias("vec"))


_BOTH_LENGTHS = "1 - list_inner_product(q.v::DOUBLE[], n.v::DOUBLE[]) / sqrt(list_inner_product(q.v::DOUBLE[], q.v::DOUBLE[]) * list_inner_product(n.v::DOUBLE[], n.v::DOUBLE[]))"
for _m in K.METRICS:
    _name, _by = "" if _m == "euclidean" else f"_{_m}", _BOTH_LENGTHS if _m == "cosine" else None

    def _adc(spark, sf, m=_m):
        data, book, coded = _fixed(spark, sf, m)
        q = data.where("vid % 50 = 0").select(F.col("vid").alias("qid"), "vec")
        return knn.blocks(q, _coded(coded), 10, m, exclude_self=True, score=_by_table(book, m))

    def _sym(spark, sf, m=_m):
        _, book, coded = _fixed(spark, sf, m)
        decoded = PQ.decode(coded.drop("vec"), book)
        return knn.blocks(decoded.where("vid % 50 = 0").select(F.col("vid").alias("qid"), "vec"), decoded, 10, m, exclude_self=True, score=_cosine_of if m == "cosine" else None)

    query(knn_sql(_m, 10, head=_pq(_m), q="b", dist=_by), f"pq_adc_fixed{_name}")(_adc)
    query(knn_sql(_m, 10, head=_pq(_m), dist=_by), f"pq_sym_fixed{_name}")(_sym)


@query(f"WITH {_PQ}, a AS (SELECT code.s, code.c, unnest(range(8)) AS d, unnest(g.x) AS x FROM code JOIN g USING (vid, s)) SELECT CAST(s AS BIGINT) AS sub, CAST(c AS INTEGER) AS code, CAST(d AS BIGINT) AS d, count(*) AS n, round(avg(x::DOUBLE), 6) + 0.0 AS center FROM a GROUP BY s, c, d")
def pq_lloyd_step(spark, sf):
    _, _, coded = _fixed(spark, sf)
    each = coded.select(F.posexplode("codes").alias("sub", "code"), "vec").select("sub", "code", F.posexplode(F.expr("slice(vec, 8 * sub + 1, 8)")).alias("d", "x"))
    out = each.groupBy("sub", "code", "d").agg(F.count(F.lit(1)).alias("n"), K.rounded(F.avg(F.col("x").cast("double"))).alias("center"))
    return out.select(F.col("sub").cast("long").alias("sub"), "code", F.col("d").cast("long").alias("d"), "n", "center")


def _trained(spark, sf, metric: str = "euclidean", m: int = 32):
    data = base(spark, sf).select("vid", K.prepare(F.col("vec"), metric).alias("vec"))
    book = PQ.train(data, m)
    return book, PQ.encode(data, book)


@query()
def pq_train(spark, sf):
    book, _ = _trained(spark, sf)
    return spark.createDataFrame([(i, c, v.tolist()) for i, b in enumerate(book.books) for c, v in enumerate(b)], "sub int, code int, centroid array<float>")


for _m in K.METRICS:

    def _pq_knn(spark, sf, m=_m):
        book, coded = _trained(spark, sf, m)
        q = asked(spark, sf).select("qid", K.prepare(F.col("vec"), m).alias("vec"))
        return knn.blocks(q, _coded(coded), 10, m, exclude_self=True, score=_by_table(book, m))

    query(None, f"pq_knn_{_m}")(_pq_knn)


@query()
def recall_pq(spark, sf):
    return knn.recall(QUERIES["knn_euclidean"](spark, sf), QUERIES["pq_knn_euclidean"](spark, sf))


# -- change log: events as operations, every tenth of them late
_LOG = """l AS (SELECT event_id + CASE WHEN event_id % 10 = 3 THEN 5.5 ELSE 0 END AS pos, event_id AS seq, user_id AS id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS kind, value FROM events),
g AS (SELECT *, max(seq) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM l),
a AS (SELECT * FROM g WHERE seq > coalesce(seen, -1)),
z AS (SELECT id, arg_max(kind, seq) AS kind, max(seq) AS seq, arg_max(value, seq) AS value, count(*) FILTER (WHERE kind = 'upsert') AS n FROM a GROUP BY id)"""


def event_log(spark, sf) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    late = F.when(F.col("event_id") % 10 == 3, 5.5).otherwise(0.0)
    kind = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    return e.select((F.col("event_id") + late).alias("pos"), F.col("event_id").alias("seq"), F.col("user_id").alias("id"), kind.alias("kind"), "value")


@query(f"WITH {_LOG} SELECT seq, id, kind FROM a")
def log_gate(spark, sf):
    return changelog.gated(event_log(spark, sf)).select("seq", "id", "kind")


@query(f"WITH {_LOG} SELECT id, seq, value FROM z WHERE kind = 'upsert'")
def log_live_state(spark, sf):
    return changelog.live(changelog.gated(event_log(spark, sf)), "value")


@query(f"WITH {_LOG} SELECT CAST(sum(n) - count(*) FILTER (WHERE kind = 'upsert') AS BIGINT) AS deleted FROM z")
def log_tombstones(spark, sf):
    return changelog.sizes(changelog.gated(event_log(spark, sf))).select("deleted")


@query(f"WITH {_LOG} SELECT count(*) FILTER (WHERE kind = 'upsert') AS live, CAST(sum(n) - count(*) FILTER (WHERE kind = 'upsert') AS BIGINT) AS deleted FROM z")
def log_size(spark, sf):
    return changelog.sizes(changelog.gated(event_log(spark, sf)))


@query(f"WITH {_LOG} SELECT CAST(sum(n) AS BIGINT) AS before, count(*) FILTER (WHERE kind = 'upsert') AS after FROM z")
def log_compact(spark, sf):
    n = changelog.sizes(changelog.gated(event_log(spark, sf)))
    return n.select((F.col("live") + F.col("deleted")).alias("before"), F.col("live").alias("after"))


@query(f"WITH {_LOG} SELECT id, seq, value FROM z WHERE kind = 'upsert'")
def log_checkpoint_replay(spark, sf):
    log = event_log(spark, sf)
    half = log.agg(F.max("pos")).first()[0] // 2
    early = changelog.gated(log.where(F.col("pos") < half))
    done = early.agg(F.max("seq")).first()[0]
    # deletes of the snapshot's time are gone with it: what it lacks isn't live
    return changelog.replay(changelog.live(early, "value"), log.where(F.col("pos") >= half), done, "value")


# -- graphs
@query(knn_sql("cosine", 16, queries="true").replace("SELECT qid, vid, dist, CAST(rk AS BIGINT) AS rk", "SELECT qid AS src, vid AS dst, dist, CAST(rk AS BIGINT) AS pos"))
def graph_knn(spark, sf):
    return graph.knn_graph(base(spark, sf), 16)


@query(f"WITH e AS ({ORACLE['graph_knn']}), i AS (SELECT dst, count(*) AS c FROM e GROUP BY dst), o AS (SELECT src, count(*) AS c FROM e GROUP BY src), n AS (SELECT vec_id, coalesce(o.c, 0) AS o, coalesce(i.c, 0) AS i FROM embeddings LEFT JOIN o ON vec_id = src LEFT JOIN i ON vec_id = dst) SELECT count(*) AS nodes, round(avg(o), 6) AS avg_out, max(o) AS max_out, max(i) AS max_in FROM n")
def graph_degree_stats(spark, sf):
    return graph.degree_stats(graph_knn(spark, sf), base(spark, sf))


@query(f"WITH e AS ({ORACLE['graph_knn']}) SELECT src, pos, dst FROM e WHERE src % 50 = 0")
def graph_adjacency(spark, sf):
    links = graph.adjacency(graph_knn(spark, sf).where("src % 50 = 0"))
    return links.select("src", F.posexplode("links").alias("p", "dst")).select("src", (F.col("p") + 1).cast("long").alias("pos"), "dst")


@query()
def graph_alg4_prune(spark, sf):
    return graph.diverse_graph(base(spark, sf), 32, 16)


@query()
def level_assign(spark, sf):
    def run(frames):
        for pdf in frames:
            yield pdf.assign(level=[level(str(v), int(v)) for v in pdf["vid"]])

    return base(spark, sf).select("vid").mapInPandas(run, "vid long, level int")


def _graphs(spark, sf) -> DataFrame:
    """The shards' graphs, kept as a table: built once, searched where they lie."""
    path = f"{shared_dir(spark)}/halyard/graphs-{spark.sparkContext.applicationId}-{abs(hash(sf))}"
    built = graph.build(base(spark, sf), "euclidean", ef_construction=64)
    built.write.mode("overwrite").parquet(path)
    return spark.read.schema(built.schema).parquet(path)


@query()
def ann_search(spark, sf):
    return graph.search(_graphs(spark, sf), asked(spark, sf), 10, 64)


@query()
def ann_trace(spark, sf):
    return graph.trace(_graphs(spark, sf), asked(spark, sf), 10, 64)


@query()
def ann_stats(spark, sf):
    return graph.stats(_graphs(spark, sf))


@query()
def recall_ann(spark, sf):
    truth = knn.blocks(asked(spark, sf), base(spark, sf), 10, "euclidean")
    return knn.recall(truth, ann_search(spark, sf))


# -- sources and streams
@query("SELECT 'check' AS name, CAST(3421780262 AS BIGINT) AS crc UNION ALL SELECT 'empty', 0")
def crc32_check(spark, sf):
    rows = spark.createDataFrame([("check", "123456789"), ("empty", "")], "name string, data string")
    return rows.select("name", F.crc32(F.col("data").cast("binary")).alias("crc"))


@query("SELECT vec_id + 1 AS seq, 'upsert' AS kind, CAST(vec_id AS VARCHAR) AS id, CAST(unnest(range(len(embedding))) AS BIGINT) AS d, round(unnest(embedding)::DOUBLE, 6) + 0.0 AS x FROM embeddings")
def wal_roundtrip(spark, sf):
    """Embeddings written as frames and parsed again."""
    ops = base(spark, sf).select((F.col("vid") + 1).alias("seq"), F.lit("upsert").alias("kind"), F.col("vid").cast("string").alias("id"), "vec")

    def run(frames):
        import pandas as pd

        for pdf in frames:
            got = wal.parse(b"".join(map(bytes, pdf["frame"])), 64)
            yield pd.DataFrame([(s, k, i, v) for _, s, k, i, v in got.ops], columns=["seq", "kind", "id", "vec"])

    back = wal.frames(ops).mapInPandas(run, "seq long, kind string, id string, vec array<float>")
    return back.select("seq", "kind", "id", F.posexplode("vec").alias("d", "x")).withColumns({"d": F.col("d").cast("long"), "x": K.rounded(F.col("x").cast("double"))})


@query("SELECT 'v' || vec_id AS id, CAST(unnest(range(len(embedding))) AS BIGINT) AS d, round(unnest(embedding)::DOUBLE, 6) + 0.0 AS x FROM embeddings")
def stream_upserts(spark, sf):
    """What a store holds after a stream has upserted every vector in micro-batches: id, d, x.  Ids are distinct, so the state
    doesn't depend on the order in which files are read; overwriting is tested with ordered batches."""
    import uuid

    from halyard.sources import jsonl
    from halyard.streaming.store import VectorStore, ingest

    root = f"{shared_dir(spark)}/halyard/stream-{uuid.uuid4().hex}"
    base(spark, sf).select(F.concat(F.lit("v"), "vid").alias("id"), "vec").repartition(4, "vid").write.json(f"{root}/in")
    store = VectorStore(spark, f"{root}/store", dim=64)
    ingest(jsonl.read_stream(spark, f"{root}/in", 2), store, f"{root}/checkpoint").awaitTermination()
    out = store.live().select("id", F.posexplode("vec").alias("d", "x")).select("id", F.col("d").cast("long").alias("d"), K.rounded(F.col("x").cast("double")).alias("x"))
    store.close()
    return out


@query()
def datagen_clusters(spark, sf):
    return datagen.clusters(1000, 16, 10, 42).frames(spark)[0]
