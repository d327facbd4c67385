"""Benchmark decontamination by a prefix-filtered set join.

A window is ``window`` consecutive words of an item (a shorter item is one window).  The shingles of a window are
ordered by rarity in the corpus; a document that holds the window holds all of its shingles, so for containment
the necessary prefix is the single rarest one.  Documents are searched for prefix shingles only; the place of
a shingle in its window fixes where the window would lie (positional bound), which must be inside the document
(length bound); then the words there are compared exactly.

Passes over the documents are vectorised on hashes and emit few rows: (1) counts of the items' shingles, (2) the
places of prefix shingles with the words around them.  What tasks get from the driver is a bitmap of fixed
size (``FILTER_BITS``), whatever the size of the benchmark; candidates meet windows in an ordinary join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import Words, bit_filter, row_key, shingle_hashes, stage, steps

WINDOW, SHINGLE = 13, 4
FILTER_BITS = 23


def _item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """Distinct (words, n_words) of windows, with the items that hold them and their shingles: arrays of hash and offset."""
    schema = "item_id string, words string, n int, size int, hashes array<long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w = Words(pa.array(pdf["text"], pa.string()))
            out = []
            for k, item in enumerate(pdf["item_id"]):
                lo, hi = w.first[k], w.first[k + 1]
                names = [w.data[w.start[i] : w.end[i]].tobytes().decode() for i in range(lo, hi)]
                n = min(window, len(names))
                size = min(shingle, n)
                sh = shingle_hashes(w.hash[lo:hi], size).view(np.int64) if n else []
                for i in range(len(names) - n + 1 if n else 0):
                    out.append((item, " ".join(names[i : i + n]), n, size, sh[i : i + n - size + 1].tolist()))
            yield pd.DataFrame(out, columns=["item_id", "words", "n", "size", "hashes"])

    return items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, schema)


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, and ``found``: an array of (start, n, item_id), null where none.

    Null and wordless texts have no words; items without words have no windows.  Rows that agree in doc_id and
    text have the same result.  item_ids are strings; a null item_id is "".
    """
    spark = docs.sparkSession
    windows = stage(_item_windows(items, window, shingle), "windows")
    shingles = windows.select("size", F.explode("hashes").alias("h")).distinct()
    sizes = [r["size"] for r in windows.select("size").distinct().orderBy("size").collect()]
    bits = spark.sparkContext.broadcast(bit_filter(shingles, FILTER_BITS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for part in steps(batch):
                w = Words(part.column("text"))
                for size in sizes:
                    h = shingle_hashes(w.hash, size)
                    values, n = np.unique(h[bits.value.passing(h)], return_counts=True)
                    for v, k in zip(values.view(np.int64).tolist(), n.tolist(), strict=True):
                        total[v] = total.get(v, 0) + k
            if len(total) > 1 << 17:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["h", "n"])
                total = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["h", "n"])

    counts = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("df"))

    # the rarest shingle of each window, ties by hash and offset
    each = windows.select("item_id", "words", "n", "size", F.posexplode("hashes").alias("off", "h"))
    ranked = each.join(counts, "h", "left").groupBy("item_id", "words", "n", "size")
    prefix = stage(ranked.agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "off")).alias("r")).select("item_id", "words", "n", "size", "r.df", "r.h", "r.off"), "prefix")
    # a shingle that no document holds leads nowhere
    prefix = prefix.where("df > 0")
    need = spark.sparkContext.broadcast(bit_filter(prefix.select("h"), FILTER_BITS))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.struct([("size", pa.int32()), ("h", pa.int64()), ("at", pa.int64()), ("lo", pa.int64()), ("around", pa.string())])
        for batch in batches:
            for part in steps(batch):
                w = Words(part.column("text"))
                found: list[list] = [[] for _ in range(part.num_rows)]
                for size in sizes:
                    h = shingle_hashes(w.hash, size)
                    at = need.value.passing(h)
                    at = at[w.doc[at] == w.doc[at + size - 1]] if len(at) else at
                    for i in at.tolist():
                        d = int(w.doc[i])
                        lo, hi = max(w.first[d], i - window + 1), min(w.first[d + 1], i + window)
                        around = " ".join(w.data[a:b].tobytes().decode() for a, b in zip(w.start[lo:hi].tolist(), w.end[lo:hi].tolist(), strict=True))
                        found[d].append((size, h[i].view(np.int64).item(), i - int(w.first[d]), int(lo - w.first[d]), around))
                names = ("size", "h", "at", "lo", "around")
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("doc_id"), pa.array(w.counts(), pa.int64()), pa.array([[dict(zip(names, f, strict=True)) for f in x] for x in found], pa.list_(place))],
                    names=["key", "doc_id", "n_words", "places"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    keyed = docs.select(row_key("doc_id", "text").alias("key"), "doc_id", "text")
    seen = stage(keyed.mapInArrow(search, f"key string, doc_id {kind}, n_words long, places array<struct<size int, h long, at long, lo long, around string>>"), "places")

    places = seen.select("key", "n_words", F.explode("places").alias("p")).select("key", "n_words", "p.*")
    start = F.col("at") - F.col("off")
    inside = (start >= F.col("lo")) & (start + F.col("n") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("around", " "), (start - F.col("lo") + 1).cast("int"), F.col("n")), " ") == F.col("words")
    # the slice is taken only where the bounds hold
    matched = places.join(prefix.drop("df"), ["h", "size"]).where(F.when(inside, same).otherwise(False))
    per = matched.groupBy("key").agg(F.collect_set(F.struct(start.alias("start"), "n", "item_id")).alias("found"))
    return seen.select("key", "doc_id", "n_words").join(per, "key", "left").drop("key")


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``."""
    covered = F.aggregate(
        F.array_sort(F.col("found")),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(a["end"], x["start"]))).alias("n"), F.greatest(a["end"], x["start"] + x["n"]).alias("end")),
        lambda a: a["n"],
    )
    ids = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["item_id"])))
    none = F.array().cast("array<string>")
    out = hits(docs, items, window, shingle).withColumn("n_hit", F.coalesce(covered, F.lit(0).cast("long"))).withColumn("ids", F.coalesce(ids, none))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The report by plain loops, for tests: docs (doc_id, text), items (item_id, text)."""
    import re

    lower = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wanted: dict[tuple, set] = {}
    for item, text in items:
        w = lower(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wanted.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    lengths = {len(x) for x in wanted}
    out = []
    for doc, text in docs:
        w, hit, ids = lower(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wanted:
                    hit |= set(range(i, i + n))
                    ids |= wanted[tuple(w[i : i + n])]
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


ORACLE = r"""
WITH bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bn AS (SELECT item_id, w, least(13, len(w)) AS n FROM bw WHERE len(w) > 0),
bs AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bs),
dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
ns AS (SELECT DISTINCT n FROM win),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns WHERE len(w) >= n),
m AS (SELECT doc_id, i, d.n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM ds) d JOIN win USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
