"""Suffix-array dedup: remove every byte that a long repeated substring covers.

A string of ``span`` bytes that starts twice anywhere is found through an anchor: of its 32-byte grams the one
with the least hash, which depends on the string alone.  So equal strings agree in the anchor and in the 200
bytes after it (or before it, if most of the string lies there), and only texts around anchors that agree in
those have to be sorted together.

1. A pass counts anchors; a bitmap of fixed size keeps those met twice.
2. A pass emits, for each such anchor and side, the hash of the 200 bytes (``h``) and of the whole region of
   strings with this anchor (``r``).  Equal regions fold into one with a count, map-side first: copies in any
   number cost a row per task.  All strings of a region met twice are repeated.
3. Where regions with the same ``h`` differ, one text of each is sent, and groups are sorted by two-stage suffix
   sorting; adjacent common prefixes tell which strings start elsewhere.  Large groups are first split by
   the bytes next to those they share, until they are small; a string is in one part only.
4. Intervals are gathered per document and cut out of its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import LONG_STEP_BYTES, _ODD, _TABLE, _powers, bit_filter, mix64, own, stage, steps, text_bytes
from halyard.llm.suffix import repeated

SPAN, GRAM, FILTER_BITS = 400, 32, 26
#: Bytes that are sorted at once, and members from which a group is split first.
SORT_BYTES, SPLIT_MEMBERS = 1 << 20, 512
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_inverse_powers = np.ones(1, np.uint64)


def _down(n: int) -> np.ndarray:
    global _inverse_powers
    if len(_inverse_powers) < n:
        size = 1 << int(n - 1).bit_length()
        with np.errstate(over="ignore"):
            _inverse_powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE, np.uint64)]))
    return _inverse_powers[:n]


class Rolling:
    """Hashes of any substrings of ``data``, from prefix sums."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[data] * _powers(max(1, len(data)))[: len(data)], dtype=np.uint64)])
        self.down = _down(len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            value = (self.sums[end] - self.sums[start]) * self.down[start]
            return mix64(value + (end - start).astype(np.uint64) * _ODD + np.uint64(salt * 0x51ED27))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    size = -(-len(x) // width) * width
    padded = np.full(size, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


class Anchors:
    """Anchors of the texts of one step: place, the first and last start of the strings that have it, doc, gram hash."""

    def __init__(self, col: pa.Array, span: int):
        self.data, self.offsets = text_bytes(col)
        n = len(self.data)
        self.roll = Rolling(self.data)
        grams = n - GRAM + 1
        if grams <= span - GRAM:
            self.at = self.lo = self.hi = self.doc = np.zeros(0, np.int64)
            self.h = np.zeros(0, np.uint64)
            return
        place = np.arange(grams)
        with np.errstate(over="ignore"):
            h = mix64((self.roll.sums[GRAM:] - self.roll.sums[:-GRAM]) * self.roll.down[:grams])
        # least hash first, then leftmost: both follow from the string alone
        least = sliding_min((h & np.uint64(0xFFFFFFFF00000000)) | place.astype(np.uint64), span - GRAM + 1)
        starts = np.arange(len(least))
        doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))[: len(starts)]
        ok = starts + span <= self.offsets[doc + 1]
        starts, doc = starts[ok], doc[ok]
        at = (least[ok] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(at)) - 1 if len(at) else begin
        self.at, self.lo, self.hi, self.doc = at[begin], starts[begin], starts[end] if len(at) else starts, doc[begin]
        self.h = h[self.at]

    def sides(self, pick: np.ndarray, span: int):
        """For the picked anchors and either side: (anchor index, first start, last start, h, r)."""
        half = span // 2
        at, lo, hi = self.at[pick], self.lo[pick], self.hi[pick]
        right = hi >= at - half
        left = lo < at - half
        i = np.concatenate([pick[right], pick[left]])
        a = np.concatenate([np.maximum(lo, at - half)[right], lo[left]])
        b = np.concatenate([hi[right], np.minimum(hi, at - half - 1)[left]])
        h = np.concatenate([self.roll.of(at[right], at[right] + half, 1), self.roll.of(at[left] - half, at[left], 2)])
        with np.errstate(over="ignore"):
            r = self.roll.of(a, b + span, 3) + mix64((self.at[i] - a).astype(np.uint64))
        return i, a, b, h.view(np.int64), r.view(np.int64)


def _pass(docs: DataFrame, make, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, limit=LONG_STEP_BYTES):
                yield make(part)

    return docs.mapInArrow(run, schema)


def _split(rows: list[tuple], span: int, left: int, right: int, share: int) -> Iterator[list[tuple]]:
    """Split a group until small.  rows: (id, text, offset of the shared bytes); strings reach ``left`` to ``right`` bytes
    before the shared bytes (``share`` long) and so hold at least ``left`` bytes before and span - share - right after.
    A row may be in several parts; in each it is trimmed to the strings that are the part's, so none is in two."""
    if len(rows) <= SPLIT_MEMBERS or right - left < 2:
        if len(rows) > 1:
            yield [(k, text[max(0, off - right) : max(0, off - left + span)], off - max(0, off - right)) for k, text, off in rows]
        return
    mid = (left + right + 1) // 2
    parts: dict[tuple, list] = {}
    for row in rows:
        _, text, off = row
        if off >= mid:
            parts.setdefault((0, text[off - mid : off + share]), []).append(row)
        after = span - mid + 1
        if off + after <= len(text) and off >= left:
            parts.setdefault((1, text[off - left : off + after]), []).append(row)
    for (side, _), group in parts.items():
        # strings starting mid or more bytes before the shared ones, or fewer
        if side == 0:
            yield from _split(group, span, mid, right, share)
        else:
            yield from _split(group, span, left, mid - 1, share)


def _sort_group(rows: list[tuple], span: int) -> np.ndarray:
    """For rows (id, text, offset): (row, first, last) of runs of starts whose strings start elsewhere too."""
    sizes = np.array([len(t) + 1 for _, t, _ in rows])
    begin = np.cumsum(sizes) - sizes
    symbols = np.zeros(int(sizes.sum()), np.int64)
    for b, (_, t, _) in zip(begin.tolist(), rows, strict=True):
        symbols[b : b + len(t)] = np.frombuffer(t, np.uint8)
    symbols[:] += 1
    symbols[begin + sizes - 1] = 0
    places = np.flatnonzero(repeated(symbols, span))
    if not len(places):
        return np.zeros((0, 3), np.int64)
    row = np.searchsorted(begin, places, side="right") - 1
    new = np.ones(len(places), bool)
    new[1:] = (places[1:] != places[:-1] + 1) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(places)) - 1
    return np.stack([row[first], places[first] - begin[row[first]], places[last] - begin[row[first]]], axis=1)


def intervals(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """k1, k2, gone: the byte intervals (lo, hi) to remove from the text of the rows (k1, k2, text)."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        h = Anchors(part.column("text"), span).h
        b = (h % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(b, kind="stable")
        h, b = h[by], b[by]
        cut = np.flatnonzero(np.diff(b, prepend=-1))
        ends = np.append(cut[1:], len(b))[: len(cut)]
        return pa.RecordBatch.from_arrays([pa.array(b[cut], pa.int32()), pa.array([h[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary())], names=["b", "packed"])

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(parts):
            values, n = np.unique(np.frombuffer(b"".join(parts), np.uint64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values[n > 1].view(np.int64))], names=["h"])

        now, parts = None, []
        for batch in batches:
            for b, p in zip(batch.column("b").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if b != now and parts:
                    yield close(parts)
                    parts = []
                now = b
                parts.append(p)
        if parts:
            yield close(parts)

    anchors = _pass(docs.select("text"), count, "b int, packed binary").repartition("b").sortWithinPartitions("b").mapInArrow(twice, "h long")
    met = spark.sparkContext.broadcast(bit_filter(anchors, FILTER_BITS))

    def regions(part: pa.RecordBatch) -> pa.RecordBatch:
        x = Anchors(part.column("text"), span)
        i, a, b, h, r = x.sides(met.value.passing(x.h), span)
        rows = pa.array(x.doc[i])
        base = x.offsets[x.doc[i]]
        return pa.RecordBatch.from_arrays(
            [part.column("k1").take(rows), part.column("k2").take(rows), pa.array(h), pa.array(r), pa.array(a - base, pa.int64()), pa.array(b - base, pa.int64())], names=["k1", "k2", "h", "r", "a", "b"]
        )

    found = stage(_pass(docs.select("k1", "k2", "text"), regions, "k1 long, k2 long, h long, r long, a long, b long"), "regions")
    folded = stage(found.groupBy("h", "r").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "a")).alias("one")), "folded")
    whole = found.join(folded.where("n > 1").select("h", "r"), ["h", "r"]).select("k1", "k2", F.col("a").alias("lo"), (F.col("b") + span).alias("hi"))

    differ = folded.groupBy("h").agg(F.count(F.lit(1)).alias("regions"), F.min("n").alias("least")).where("regions > 1 and least = 1").select("h")
    needed = stage(folded.join(differ, "h").select("h", "r", "n", F.col("one.k1").alias("k1"), F.col("one.k2").alias("k2"), F.col("one.a").alias("a")), "needed")
    wanted = spark.sparkContext.broadcast(bit_filter(needed.select(F.expr("h ^ r").alias("h")), FILTER_BITS))

    def texts(part: pa.RecordBatch) -> pa.RecordBatch:
        x = Anchors(part.column("text"), span)
        i, a, b, h, r = x.sides(met.value.passing(x.h), span)
        ok = wanted.value.passing(h ^ r)
        i, a, b, h, r = i[ok], a[ok], b[ok], h[ok], r[ok]
        rows, base = pa.array(x.doc[i]), x.offsets[x.doc[i]]
        # where the 200 shared bytes begin in the region's text
        half = span // 2
        off = np.where(b >= x.at[i] - half, x.at[i], x.at[i] - half) - a
        text = pa.array([x.data[p : q + span].tobytes() for p, q in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())
        names = ["k1", "k2", "h", "r", "a", "off", "text"]
        return pa.RecordBatch.from_arrays([part.column("k1").take(rows), part.column("k2").take(rows), pa.array(h), pa.array(r), pa.array(a - base, pa.int64()), pa.array(off, pa.int64()), text], names=names)

    sent = _pass(docs.select("k1", "k2", "text"), texts, "k1 long, k2 long, h long, r long, a long, off long, text binary")
    sent = sent.join(needed, ["h", "r", "k1", "k2", "a"]).dropDuplicates(["h", "r"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(groups):
            flat, held, cover = [], 0, {}

            def found(row, text_off, first, last):
                # strings of a region overlap all, so one interval holds them
                k1, k2, a, _, off, n = row
                if n == 1:
                    first, last = first + off - text_off, last + off - text_off
                    lo, hi = cover.get((k1, k2, a), (first, last))
                    cover[k1, k2, a] = min(lo, first), max(hi, last)

            def sorted_rows():
                for row, first, last in _sort_group(flat, span).tolist():
                    found(flat[row][0], flat[row][2], first, last)

            for g in groups:
                # ids index the rows of the group; left sides hold their shared bytes at the end of the reach
                side = [(k, t, o) for k, (t, o) in enumerate((r[3], r[4]) for r in g)]
                half, reach = span // 2, max(o for _, _, o in side)
                for part in _split(side, span, 0, max(reach, 1), half):
                    # equal once trimmed: all strings are repeated, and one text stands for all
                    equal: dict[bytes, list] = {}
                    for k, t, o in part:
                        equal.setdefault(t, []).append((k, o))
                    for t, members in equal.items():
                        if len(members) > 1:
                            for k, o in members:
                                found(g[k], o, 0, len(t) - span)
                        if len(equal) > 1:
                            flat.append((g[members[0][0]], t, members[0][1]))
                            held += len(t)
                    if held > SORT_BYTES:
                        sorted_rows()
                        flat, held = [], 0
            if flat:
                sorted_rows()
            ids = [(k1, k2, a + first, a + last + span) for (k1, k2, a), (first, last) in cover.items()]
            cols = zip(*ids, strict=True) if ids else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["k1", "k2", "lo", "hi"])

        groups, group, now, held = [], [], None, 0
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("h", "k1", "k2", "a", "text", "off", "n")]
            for h, k1, k2, a, text, off, n in zip(*cols, strict=True):
                if h != now:
                    if group:
                        groups.append(group)
                    if held > 2 * SORT_BYTES:
                        yield close(groups)
                        groups, held = [], 0
                    group, now = [], h
                group.append((k1, k2, a, text, off, n))
                held += len(text)
        if group:
            groups.append(group)
        if groups:
            yield close(groups)

    parts = sent.select("h", "k1", "k2", "a", "text", "off", "n").repartition("h").sortWithinPartitions("h").mapInArrow(sort, "k1 long, k2 long, lo long, hi long")
    return whole.unionByName(parts).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("gone"))


def remove(df: DataFrame, text: str = "text", span: int = SPAN) -> DataFrame:
    """``df`` with ``text`` replaced by what is kept as bytes (``kept``), and n_bytes, n_removed, n_spans.

    A byte goes if a string of ``span`` bytes that covers it also starts at another place of any row, this one
    included, judged on the input.  Null text is empty.  Repeated rows are rows like any other: each is a
    copy of the other.  Columns named like the made ones are replaced, the others stay.
    """
    made = {"kept": "binary", "n_bytes": "long", "n_removed": "long", "n_spans": "long"}
    keep = [c for c in df.columns if c not in made and c != text]
    k = own(df, "text", "k1", "k2", "lo", "hi")
    value = F.coalesce(F.col(text), F.lit(""))
    ids = [F.hash(F.col(c).cast("string")) for c in keep if c == "doc_id"]
    keyed = df.select(*keep, value.alias(k["text"]), F.xxhash64(*ids, value).alias(k["k1"]), F.xxhash64(F.lit(11), value).alias(k["k2"]))
    gone = intervals(keyed.select(F.col(k["k1"]).alias("k1"), F.col(k["k2"]).alias("k2"), F.col(k["text"]).alias("text")), span)
    gone = gone.select(F.col("k1").alias(k["k1"]), F.col("k2").alias(k["k2"]), F.col("gone").alias(k["lo"]))
    places = lambda c: F.transform(k["lo"], lambda x: x[c])
    joined = keyed.join(gone, [k["k1"], k["k2"]], "left").select(*keep, k["text"], places("lo").alias(k["lo"]), places("hi").alias(k["hi"]))
    from pyspark.sql import types as T

    names = {"binary": T.BinaryType(), "long": T.LongType()}
    schema = T.StructType([*df.select(*keep).schema.fields, *(T.StructField(c, names[k]) for c, k in made.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, k["text"], LONG_STEP_BYTES):
                out = []
                for t, lo, hi in zip(part.column(k["text"]), part.column(k["lo"]).to_pylist(), part.column(k["hi"]).to_pylist(), strict=True):
                    data = t.as_buffer().to_pybytes()
                    if not lo:
                        out.append((data, len(data), 0, 0))
                        continue
                    pieces, end, spans = [], 0, 0
                    for a, b in sorted(zip(lo, hi, strict=True)):
                        if a > end or not spans:
                            pieces.append(data[end:a])
                            spans += 1
                        end = max(end, b)
                    pieces.append(data[end:])
                    left = b"".join(pieces)
                    out.append((left, len(data), len(data) - len(left), spans))
                cols = [pa.array([r[i] for r in out], k) for i, k in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *cols], names=[*keep, *made])

    return joined.mapInArrow(run, schema)


def result(docs: DataFrame) -> DataFrame:
    out = remove(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple], span: int = SPAN) -> list[tuple]:
    """The result by a table of all strings of ``span`` bytes, for tests."""
    seen: dict[bytes, int] = {}
    datas = [(d, (t or "").encode()) for d, t in docs]
    for _, b in datas:
        for i in range(len(b) - span + 1):
            k = hashlib.md5(b[i : i + span]).digest()
            seen[k] = seen.get(k, 0) + 1
    out = []
    for d, b in datas:
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - span + 1):
            if seen[hashlib.md5(b[i : i + span]).digest()] > 1:
                gone[i] += 1
                gone[i + span] -= 1
        cover = np.cumsum(gone)[: len(b)] > 0
        spans = int((np.diff(cover.astype(int), prepend=0) == 1).sum())
        out.append((d, len(b), int(cover.sum()), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest()))
    return out
