"""Line dedup by content-defined line chunks.

A rolling hash over the hashes of ROLL lines marks the places where it falls on a boundary value.  Chunks start with the
lines of a mark and end with those of a mark, so both boundaries follow from lines of the chunk itself, wherever it stands:
inserted or deleted lines, and the text around a passage, change nothing inside.  A text's start and end are boundaries too.

From each start a chunk goes to the nearest end that leaves it MIN_LINES lines with something in them, and another to the end after
that; to a text's end one comes from the nearest such start.  So chunks overlap, each line of a text of two such lines or
more is in a chunk, and all chunks have several lines.  Chunks found elsewhere in the corpus are candidates; the first
occurrence (by doc_id, then place) stays, and the lines of a later one go once its bytes have been compared with
the first's.  A line that goes stands in an earlier occurrence; of each chain of such occurrences the first stays.

Chunk hashes are aggregated map-side, so a chunk shared by a third of all documents costs one row per task.
A bitmap of fixed size tells the second pass which chunk texts to send at all; a false positive there only
sends more.  Texts are compared in a join whose skew Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.llm.common import _ODD, bit_filter, drop_staged, may_pass, mix64, only, own, row_key, span_hashes, stage, steps, text_bytes

ROLL, DIVISOR, MIN_LINES = 2, 2, 2
_NEWLINE, FILTER_BITS = 10, 25


def boundary(rolled: np.ndarray) -> np.ndarray:
    return mix64(rolled) % np.uint64(DIVISOR) == 0


class Chunks:
    """Lines and chunks of the texts of one step.

    Line i is ``data[starts[i]:ends[i]]``; lines ``first[d]`` to ``first[d + 1]`` are those of text d.  Chunks are lines [head, tail) of
    text ``doc``, in order.
    """

    def __init__(self, col: pa.Array, least: int = MIN_LINES):
        self.data, offsets = text_bytes(col)
        breaks = np.flatnonzero(self.data == _NEWLINE)
        n = len(offsets) - 1
        # a line ends at each newline and at each text's end
        ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
        last = np.zeros(len(ends), bool)
        last[np.searchsorted(breaks, offsets[1:]) + np.arange(n)] = True
        self.starts = np.concatenate([[0], (ends + ~last)[:-1]]) if n else ends
        self.ends = ends
        self.first = np.concatenate([[0], np.flatnonzero(last) + 1])
        lines = span_hashes(self.data, self.starts, ends)
        with np.errstate(over="ignore"):
            # of each line and the ROLL - 1 before it
            rolled = lines.copy()
            for k in range(1, ROLL):
                rolled[k:] += lines[:-k] * (_ODD ** np.uint64(k))
        inside = np.arange(len(ends)) - self.first[np.searchsorted(self.first, np.arange(len(ends)), side="right") - 1] >= ROLL - 1
        mark = np.flatnonzero(boundary(rolled) & inside)
        head, tail = np.union1d(self.first[:-1], mark - (ROLL - 1)), np.union1d(self.first[1:], mark + 1)
        filled = np.concatenate([[0], np.cumsum(ends > self.starts)])
        stop = self.first[np.searchsorted(self.first, head, side="right")]
        near = np.searchsorted(filled[tail], filled[head] + least)
        pairs = []
        for to in (near, near + 1):
            ok = np.flatnonzero(to < len(tail))
            ok = ok[tail[to[ok]] <= stop[ok]]
            pairs.append(np.stack([head[ok], tail[to[ok]]], axis=1))
        back = np.searchsorted(filled[head], filled[self.first[1:]] - least, side="right") - 1
        ok = np.flatnonzero(back >= 0)
        ok = ok[head[back[ok]] >= self.first[ok]]
        pairs = np.unique(np.concatenate([*pairs, np.stack([head[back[ok]], self.first[ok + 1]], axis=1)]), axis=0)
        self.head, self.tail = pairs.T
        self.doc = np.searchsorted(self.first, self.head, side="right") - 1
        self.n_lines = np.diff(self.first)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[self.head[i]] : self.ends[self.tail[i] - 1]].tobytes()

    def kept(self, doc: int, gone: list[tuple[int, int]]) -> tuple[bytes, int]:
        """The text without the lines of the chunks ``gone``, and how many lines those are."""
        lo, hi = self.first[doc], self.first[doc + 1]
        left = np.ones(hi - lo, bool)
        for a, b in gone:
            left[a:b] = False
        data = self.data
        return b"\n".join(data[a:b].tobytes() for a, b in zip(self.starts[lo:hi][left].tolist(), self.ends[lo:hi][left].tolist(), strict=True)), int((~left).sum())


def _hash(b: bytes) -> int:
    return xxhash.xxh3_64_intdigest(b) - (1 << 63)


def _occurrences(keyed: DataFrame, k: dict[str, str], least: int, with_text=None) -> DataFrame:
    """h, key, doc_id, head, tail (, chunk) of every chunk, or of those that the filter ``with_text`` lets pass."""
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("key", T.StringType()), T.StructField("doc_id", keyed.schema["doc_id"].dataType), T.StructField("head", T.IntegerType()), T.StructField("tail", T.IntegerType())])
    if with_text is not None:
        schema = schema.add("chunk", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                c = Chunks(part.column("text"), least)
                every = range(len(c.head))
                h = np.array([_hash(c.text(i)) for i in every], np.int64)
                pick = np.arange(len(h))
                if with_text is not None:
                    pick = with_text.value.passing(h)
                rows, base = pa.array(c.doc[pick]), c.first[c.doc[pick]]
                cols = [pa.array(h[pick], pa.int64()), part.column(k["key"]).take(rows), part.column("doc_id").take(rows), pa.array(c.head[pick] - base, pa.int32()), pa.array(c.tail[pick] - base, pa.int32())]
                if with_text is not None:
                    cols.append(pa.array([c.text(i) for i in pick.tolist()], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return keyed.select(k["key"], "doc_id", "text").mapInArrow(run, schema)


def dedup(df: DataFrame, least: int = MIN_LINES, most: int = 100) -> DataFrame:
    """``df`` with repeated chunks taken out of ``text``, and n_lines, n_removed_lines (both long).

    Chunks have ``least`` lines or more that hold something.  Null text stays null and has no lines; the empty text
    has one, empty, line.  A text with fewer such lines has no chunk and stays.  So does a text of whose lines more than
    ``most`` percent, but not all, would go: it is a near copy rather than a text with repeated passages.  Rows equal in doc_id and text count as one occurrence.  Other columns stay,
    but for those named like the two made here.  Texts of which nothing is left are empty.
    """
    spark = df.sparkSession
    made = ("n_lines", "n_removed_lines")
    keep = [c for c in df.columns if c not in made]
    k = own(df, "key", "gone", "h")
    keyed = df.select(*keep, row_key("doc_id", "text").alias(k["key"]))
    place = F.struct("doc_id", "key", "head", "tail")
    repeated = _occurrences(keyed, k, least).groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("h", "first")
    repeated = stage(repeated, "chunks")
    bits = spark.sparkContext.broadcast(bit_filter(repeated.select("h"), FILTER_BITS))
    found = stage(_occurrences(keyed, k, least, bits).join(repeated, "h").withColumn("is_first", place.eqNullSafe(F.col("first"))).drop("first"), "occurrences")
    firsts = found.where("is_first").select("h", F.col("chunk").alias("kept")).dropDuplicates(["h"])
    gone = found.where("not is_first").join(firsts, "h").where("chunk = kept")
    gone = stage(gone.groupBy(F.col("key").alias(k["key"])).agg(F.collect_set(F.struct("head", "tail")).alias(k["gone"])), "gone")
    for old in (repeated, found):
        drop_staged(old)
    # only texts that may lose something are shuffled, to a join of one form at any size
    keyed = keyed.withColumn(k["h"], F.xxhash64(k["key"]))
    changed = spark.sparkContext.broadcast(bit_filter(gone.select(F.xxhash64(k["key"]).alias("h")), FILTER_BITS))
    joined = only(keyed, k["h"], changed).join(gone.hint("merge"), k["key"], "left")
    schema = T.StructType([*df.select(*keep).schema.fields, *(T.StructField(m, T.LongType()) for m in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if k["gone"] not in batch.schema.names:
                batch = batch.filter(pa.array(~may_pass(batch, k["h"], changed)))
            for part in steps(batch):
                col = part.column("text")
                c = Chunks(col, least)
                texts, removed = [], []
                gone = part.column(k["gone"]).to_pylist() if k["gone"] in part.schema.names else [None] * part.num_rows
                for i, (text, out) in enumerate(zip(col, gone, strict=True)):
                    if not out:
                        texts.append(text.as_py())
                        removed.append(0)
                        continue
                    left, n = c.kept(i, [(g["head"], g["tail"]) for g in out])
                    if 100 * n > most * c.n_lines[i] and left.strip():
                        left, n = text.as_buffer().to_pybytes(), 0
                    texts.append(left.decode())
                    removed.append(n)
                lines = np.where(np.asarray(col.is_valid()), c.n_lines, 0)
                new = {"text": pa.array(texts, pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_removed_lines": pa.array(removed, pa.int64())}
                yield pa.RecordBatch.from_arrays([new.get(x.name, None) if x.name in new else part.column(x.name) for x in schema.fields], names=schema.names)

    return joined.mapInArrow(run, schema).unionByName(keyed.mapInArrow(run, schema))


def result(docs: DataFrame) -> DataFrame:
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(docs: list[tuple], least: int = MIN_LINES) -> list[tuple]:
    """(doc_id, text left) by plain loops over lines and boundaries, for tests; doc_ids are distinct."""

    def is_boundary(one: bytes, two: bytes) -> bool:
        a, b = (int(span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0]) for x in (one, two))
        return bool(boundary(np.array([(b + a * int(_ODD)) % (1 << 64)], np.uint64))[0])

    first: dict[bytes, tuple] = {}
    found = []
    for d, text in sorted(docs):
        lines = (text or "").encode().split(b"\n")
        marks = [i for i in range(len(lines) - 1) if is_boundary(lines[i], lines[i + 1])]
        starts, ends = sorted({0, *marks}), sorted({len(lines), *(i + 2 for i in marks)})
        chunks = set()
        for a in starts:
            chunks |= {(a, b) for b in [e for e in ends if sum(map(bool, lines[a:e])) >= least][:2]}
        chunks |= {(a, len(lines)) for a in [x for x in starts if sum(map(bool, lines[x:])) >= least][-1:]}
        gone: set[int] = set()
        for a, b in sorted(chunks):
            if first.setdefault(b"\n".join(lines[a:b]), (d, a, b)) != (d, a, b):
                gone |= set(range(a, b))
        found.append((d, None if text is None else b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode()))
    return found
