"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact intersection of sorted arrays.

A document's set is its distinct shingles, as 64-bit hashes in order.  Documents with the same set are one class
from the start, named by a hash of the set.  Links between classes are found in two steps.

1. Stars: classes that agree in one of a few minimum hashes are compared with one leader each.  This ties
   large groups of near copies together by about as many comparisons as they have members.
2. Completion, which loses nothing: two sets at the threshold share a shingle of their prefixes (the rarest
   shingles of each; the lengths of prefixes follow from the threshold, and that of the smaller set is shorter).  Classes
   that share a prefix shingle but are not tied yet meet in tiles of (shingle, size band): sizes further apart than the
   threshold allows never meet, and the bits in which two hashed bitmaps differ bound the overlap from above.  Rows that
   the bitmaps allow a partner which isn't tied get their arrays and are compared, tiles that share them together.  What
   is compared in one place gives the links that tie it: fewer than it has rows, whatever the number of pairs.

Comparisons are exact.  Frequent shingles come last in the order, so that a line in a third of all documents
is nobody's prefix.  Passes over the texts are vectorised and recompute sets rather than store them; arrays
are kept only for classes that are compared.  Components come from contraction on tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import NONSPACE, _ODD, Words, bit_filter, drop_staged, mix64, only, own, row_key, shingle_hashes, stage, steps
from halyard.llm.components import components

SHINGLE, PERCENT = 4, 85
LEAST_BITS, MOST_BITS, HASHES, FILTER_BITS = 512, 1 << 13, 6, 24
#: Rows from which a tile is dealt out by parts of that many, and rows of a family that are compared in one task.
PART, FAMILY = 2048, 4096
#: Tiles of more rows than SMALL are compared row by row, smaller ones many at once.
SMALL = 64
#: Pairs of one leader that are compared in one task.
LEADER_PAIRS = 1000
#: A shingle is frequent from this share of the documents (and this count) on: their number is bounded by the
#: mean set size over the share, whatever the size of the corpus.
FREQUENT_SHARE, FREQUENT_LEAST = 2e-4, 32
#: Shingles counted in a worker at once; those met once are forgotten beyond it.
COUNTED = 1 << 21


class Sets:
    """Shingle sets of the texts of one step: ``h`` in order of (doc, hash), ``first`` where each doc's begin."""

    def __init__(self, col: pa.Array, size: int, kind: np.ndarray = NONSPACE):
        w = Words(col, kind)
        counts, n = w.counts(), len(col)
        h = shingle_hashes(w.hash, size)
        inside = w.doc[: len(h)] == w.doc[size - 1 :] if len(h) else np.zeros(0, bool)
        h, doc = h[inside], w.doc[: len(h)][inside]
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            own = np.array([shingle_hashes(w.hash[w.first[d] : w.first[d + 1]], int(counts[d]))[0] for d in short.tolist()], np.uint64)
            h, doc = np.concatenate([h, own]), np.concatenate([doc, short])
        if len(short):
            order = np.argsort(doc, kind="stable")
            h, doc = h[order], doc[order]
        first = np.searchsorted(doc, np.arange(n + 1)).tolist()
        for a, b in zip(first[:-1], first[1:], strict=True):
            h[a:b].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.h, self.doc = h[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(n + 1))

    def names(self, seed: int) -> np.ndarray:
        """A 64-bit name of each set."""
        data = self.h.tobytes()
        return np.array([xxhash.xxh3_64_intdigest(data[8 * a : 8 * b], seed) for a, b in zip(self.first[:-1], self.first[1:], strict=True)], np.uint64).view(np.int64)


def _bitmap(h: np.ndarray) -> bytes:
    """Bits at the low ends of the hashes: six to twelve for each shingle, a power of two and 8192 at most."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << int(6 * len(h)).bit_length()))
    bits = np.zeros(size, bool)
    bits[(h & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


class Bitmaps:
    """Bitmaps of several sizes; two are compared at the smaller size, to which the larger is folded."""

    def __init__(self, col):
        rows = col.to_pylist()
        self.size = np.array([len(b) // 8 for b in rows], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.words = np.frombuffer(b"".join(rows), np.uint64)

    def _at(self, rows: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((len(rows), size), np.uint64)
        for own in np.unique(self.size[rows]).tolist():
            pick = np.flatnonzero(self.size[rows] == own)
            full = self.words[self.begin[rows[pick]][:, None] + np.arange(own)]
            out[pick] = np.bitwise_or.reduce(full.reshape(len(pick), own // size, size), axis=1)
        return out

    def differ(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Bits in which rows p and q differ."""
        out, least = np.zeros(len(p), np.int64), np.minimum(self.size[p], self.size[q])
        for size in np.unique(least).tolist():
            for pick in np.array_split(np.flatnonzero(least == size), 1 + int((least == size).sum()) * size // (1 << 18)):
                out[pick] = np.bitwise_count(self._at(p[pick], size) ^ self._at(q[pick], size)).sum(axis=1, dtype=np.int64)
        return out


def _describe(docs: DataFrame, size: int, kind: np.ndarray, seed: int) -> DataFrame:
    """doc_id, key, n, name of the set, a second digest, its minimum hashes and its bitmap."""
    kinds = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kinds}, key string, n long, name long, check binary, least array<long>, bits binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                s, m = Sets(part.column("text"), size, kind), part.num_rows
                some = np.flatnonzero(np.diff(s.first) > 0)
                least = np.zeros((m, HASHES), np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(HASHES if len(some) else 0):
                        least[some, k] = np.minimum.reduceat(mix64(s.h ^ (_ODD * np.uint64(2 * k + 3))), s.first[some])
                data = s.h.tobytes()
                packed = [_bitmap(s.h[a:b]) for a, b in zip(s.first[:-1].tolist(), s.first[1:].tolist(), strict=True)]
                check = [xxhash.xxh3_128_digest(data[8 * a : 8 * b]) for a, b in zip(s.first[:-1], s.first[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * HASHES, pa.int32()), pa.array(least.view(np.int64).ravel()))
                cols = [part.column("doc_id"), part.column("key"), pa.array(np.diff(s.first), pa.int64()), pa.array(s.names(seed)), pa.array(check, pa.binary()), lists, pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", "key", "text").mapInArrow(run, schema)


def _frequent(docs: DataFrame, size: int, kind: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles in order of hash, and the documents that hold each, as counted by the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c, pending, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def merge(h, c):
            every = np.concatenate([h, *pending])
            weight = np.concatenate([c, np.ones(len(every) - len(h), np.int64)])
            values, back = np.unique(every, return_inverse=True)
            total = np.bincount(back, weights=weight, minlength=len(values)).astype(np.int64)
            return values[total > 1], total[total > 1]

        for batch in batches:
            for part in steps(batch):
                pending.append(Sets(part.column("text"), size, kind).h)
                held += len(pending[-1])
                if held > COUNTED:
                    h, c = merge(h, c)
                    pending, held = [], 0
        h, c = merge(h, c)
        h, c = h[c >= 4], c[c >= 4]
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "n"])

    counts = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= max(FREQUENT_LEAST, int(FREQUENT_SHARE * n_docs))).toPandas()
    h, n = rows["h"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _shared_prefixes(docs: DataFrame, size: int, kind: np.ndarray, percent: int, seed: int, frequent) -> DataFrame:
    """token, name for each group of at least two classes that share a prefix shingle; token names the group.

    Tokens travel packed, a row per bucket and a million tokens, and are sorted by numpy where they meet.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = spark.sparkContext.broadcast(frequent)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, df = order.value
        tokens, names, held = [], [], 0

        def packed():
            t, c = np.concatenate(tokens), np.concatenate(names)
            pair = np.stack([t, c.view(np.uint64)], axis=1)
            b = (mix64(t >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(b, kind="stable")
            pair, b = np.ascontiguousarray(pair[by]), b[by]
            cut = np.flatnonzero(np.diff(b, prepend=-1))
            ends = np.append(cut[1:], len(b))
            return pa.RecordBatch.from_arrays([pa.array(b[cut], pa.int32()), pa.array([pair[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary())], names=["bucket", "pairs"])

        for batch in batches:
            for part in steps(batch):
                s = Sets(part.column("text"), size, kind)
                if not len(s.h):
                    continue
                last = np.zeros(len(s.h), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, s.h), len(often) - 1)
                    last = np.where(often[at] == s.h, df[at], 0)
                # within a document frequent shingles go last; hashes are in order already
                rank = np.argsort(s.doc << 40 | last, kind="stable")
                n = np.diff(s.first)
                length = n - (percent * n + 99) // 100 + 1
                inside = np.arange(len(s.h)) - s.first[s.doc]
                held_in = inside < length[s.doc]
                pick = rank[held_in]
                # the shorter of two sets shares a shingle of its index prefix with the longer's prefix: the lowest bit
                short = n - (2 * percent * n + 99 + percent) // (100 + percent) + 1
                tokens.append(s.h[pick] & ~np.uint64(1) | (inside < short[s.doc])[held_in].astype(np.uint64))
                names.append(s.names(seed)[s.doc[pick]])
                held += len(pick)
                if held > 1 << 20:
                    yield packed()
                    tokens, names, held = [], [], 0
        if held:
            yield packed()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def several(parts):
            pair = np.frombuffer(b"".join(parts), np.uint64).reshape(-1, 2)
            by = np.argsort(pair[:, 0])
            pair = pair[by[_together(pair[by, 0] >> np.uint64(1))]]
            pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
            new = np.ones(len(pair), bool)
            new[1:] = (pair[1:] != pair[:-1]).any(axis=1)
            pair = pair[new]
            token, name = pair[_together(pair[:, 0] >> np.uint64(1))].T
            indexed, token = (token & np.uint64(1)).astype(bool), token >> np.uint64(1)
            # tokens met by the same classes are one: the name of a group is a hash of its members
            head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
            with np.errstate(over="ignore"):
                group = mix64(np.add.reduceat(mix64(name), head)) if len(head) else name
            # without a member in whose index prefix it is, a shingle leads to no pair
            wanted = np.logical_or.reduceat(indexed, head) if len(head) else indexed
            sizes = np.diff(np.append(head, len(token)))
            group, name = np.repeat(group, sizes)[np.repeat(wanted, sizes)], name[np.repeat(wanted, sizes)]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(group).view(np.int64)), pa.array(np.ascontiguousarray(name).view(np.int64))], names=["token", "name"])

        now, parts = None, []
        for batch in batches:
            for b, p in zip(batch.column("bucket").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                if b != now and parts:
                    yield several(parts)
                    parts = []
                now = b
                parts.append(p)
        if parts:
            yield several(parts)

    sent = docs.select("text").mapInArrow(emit, "bucket int, pairs binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "token long, name long").distinct()


def _together(x: np.ndarray) -> np.ndarray:
    """True for the values of a sorted array that aren't alone."""
    out = np.zeros(len(x), bool)
    same = x[1:] == x[:-1]
    out[1:] |= same
    out[:-1] |= same
    return out


def _fitting(bits: Bitmaps, n, p, q, percent: int) -> np.ndarray:
    """Which pairs (p, q) may meet the threshold: every bit in which bitmaps differ is a shingle that only one has."""
    total = n[p] + n[q]
    overlap = (total - bits.differ(p, q)) // 2
    return 100 * overlap >= percent * (total - overlap)


class Tile:
    """Rows of one tile or of several small ones, in order of tile and size.  Two rows may meet if they are of one tile, their
    classes aren't tied, one of them is at home in the size band and, in a tile that is dealt out, they are of different parts."""

    def __init__(self, rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows)
        self.table = t
        self.token, self.band, self.sub, self.name, self.comp, self.n, self.side, self.part = (t.column(c).to_numpy().copy() for c in (*_TILE, "name", "comp", "n", "side", "part"))
        self.tile = np.cumsum(np.concatenate([[True], (self.token[1:] != self.token[:-1]) | (self.band[1:] != self.band[:-1]) | (self.sub[1:] != self.sub[:-1])]))

    def may(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether rows p and q of one tile, p not the larger, may meet."""
        # a sub-tile names its two parts; within one part all meet, else rows of different parts do
        across = (self.sub[p] >> 16 == self.sub[p] & 0xFFFF) | (self.part[p] != self.part[q])
        return across & (self.comp[p] != self.comp[q]) & ((self.side[p] == 0) | (self.side[q] == 0))

    def near(self, bits: Bitmaps, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that fit of many small tiles at once: each row is compared with the d-th next."""
        left = np.arange(len(self.n))
        for d in range(1, len(self.n)):
            left = left[left + d < len(self.n)]
            left = left[(self.tile[left] == self.tile[left + d]) & (100 * self.n[left] >= percent * self.n[left + d])]
            if not len(left):
                return
            p = left[self.may(left, left + d)]
            p = p[_fitting(bits, self.n, p, p + d, percent)]
            if len(p):
                yield p, p + d

    def fits(self, bits: Bitmaps, percent: int, i: int, q: np.ndarray) -> np.ndarray:
        """Those of the rows q with which row i may meet the threshold, in one tile."""
        lo, hi = np.searchsorted(self.n, [-(-percent * self.n[i] // 100), self.n[i] * 100 // percent + 1])
        q = q[(q >= lo) & (q < hi) & (q != i)]
        q = q[self.may(np.full(len(q), i), q)]
        return q[_fitting(bits, self.n, np.full(len(q), i), q, percent)]


def _gathered(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[list[pa.RecordBatch], bool]]:
    """Rows sorted by ``keys`` as (slices, alone): a tile of over SMALL rows comes alone, smaller ones by a few thousand rows."""
    held, size, tile, rows, now = [], 0, [], 0, None
    for batch in batches:
        cols = [batch.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in cols])])).tolist() if batch.num_rows else []
        for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            key = tuple(c[lo] for c in cols)
            if now != key:
                if rows > SMALL:
                    yield tile, True
                elif rows > 1:
                    held, size = held + tile, size + rows
                    if size > 4096:
                        yield held, False
                        held, size = [], 0
                tile, rows, now = [], 0, key
            tile.append(batch.slice(lo, hi - lo))
            rows += hi - lo
    if rows > SMALL:
        yield tile, True
        tile = []
    if held or len(tile):
        yield held + tile, False


def _bounded(pairs: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps leave the threshold possible."""
    one, two = (about.select(F.col("name").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in ("a", "b"))
    full = pairs.join(one, "a").join(two, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            bits = Bitmaps(pa.chunked_array([batch.column("bitsa"), batch.column("bitsb")]))
            n = np.concatenate([batch.column("na").to_numpy(), batch.column("nb").to_numpy()])
            ok = _fitting(bits, n, np.arange(m), np.arange(m) + m, percent) if m else np.zeros(0, bool)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return full.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(run, "a long, b long")


_TILE = ("token", "band", "sub")


def _tiles(met: DataFrame, about: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """token, band, sub, name, comp, n, side, part, bits: the rows of all tiles in which two classes may meet that aren't tied.

    A class is at home in its size band and a visitor in the next; tiles with nobody at home or one component go
    before bitmaps are sent.  A tile of more than PART rows is dealt out: every two parts, and each with itself, are a tile.
    """
    c = met.join(comps.withColumnRenamed("node", "name"), "name", "left").withColumn("comp", F.coalesce("comp", "name")).join(about.select("name", "n"), "name")
    band = F.floor(F.log("n") / F.lit(float(np.log(100 / percent))) + 1e-9).cast("int")
    rows = stage(c.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", band + F.col("side")), "rows")
    apart = rows.groupBy("token", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("side").alias("home"), F.count(F.lit(1)).alias("rows"))
    apart = apart.where("lo != hi and home = 0").select("token", "band", F.least(F.lit(0x7FFF), F.ceil(F.col("rows") / PART)).cast("int").alias("parts"))
    full = rows.join(apart, ["token", "band"]).withColumn("part", F.pmod(F.xxhash64("name", "token"), "parts").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.shiftleft(F.least(x, "part"), 16) + F.greatest(x, F.col("part")))
    full = full.withColumn("sub", F.explode(F.when(F.col("parts") > 1, pairs).otherwise(F.array(F.lit(0)))))
    return full.join(about.select("name", "bits"), "name").select(*_TILE, "name", "comp", "n", "side", "part", "bits")


def _clumps(tiles: DataFrame, percent: int) -> DataFrame:
    """The rows of tiles, without bitmaps, that the bitmaps allow a pair with another of their tile.

    What pairs hang together within a tile is a clump and gets a name from its members in place of the token, so
    that classes which meet in many tiles but only with each other are one clump.
    """
    cols = ["band", "sub", "name", "comp", "n", "side", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, alone in _gathered(batches, _TILE):
            t = Tile(rows)
            bits = Bitmaps(t.table.column("bits"))
            m = len(t.n)
            lot, some = np.arange(m), np.zeros(m, bool)
            if alone:
                for i in range(m):
                    # later rows only: each pair once
                    q = np.append(t.fits(bits, percent, i, np.arange(i + 1, m)), i)
                    if len(q) > 1:
                        some[q] = True
                        lots = np.unique(lot[q])
                        if len(lots) > 1:
                            lot[np.isin(lot, lots)] = lots[0]
            else:
                pairs = list(t.near(bits, percent))
                p, q = (np.concatenate([x[k] for x in pairs]) if pairs else lot[:0] for k in (0, 1))
                some[p] = some[q] = True
                while len(p):
                    before = lot.copy()
                    np.minimum.at(lot, p, lot[q])
                    np.minimum.at(lot, q, lot[p])
                    if (before == lot).all():
                        break
            order = np.flatnonzero(some)[np.argsort(lot[some], kind="stable")]
            head = np.flatnonzero(np.diff(lot[order], prepend=-1))
            with np.errstate(over="ignore"):
                own = mix64(t.name[order].view(np.uint64) * _ODD + t.side[order].astype(np.uint64))
                clump = mix64(np.add.reduceat(own, head)) if len(head) else own
            clump = np.repeat(clump, np.diff(np.append(head, len(order)))).view(np.int64)
            left = t.table.select(cols).take(pa.array(order)).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array(clump), *(pa.array(left.column(c).to_numpy()) for c in cols)], names=["token", *cols])

    met = tiles.repartition(*_TILE).sortWithinPartitions(*_TILE, "n", "name").mapInArrow(run, "token long, band int, sub int, name long, comp long, n long, side int, part int")
    return met.distinct()


def _families(clumps: DataFrame) -> DataFrame:
    """``clumps`` with those that share classes made one tile, in which each class is once, up to FAMILY rows."""
    hung = clumps.groupBy(*_TILE).agg(F.min("name").alias("a"))
    family = components(clumps.join(hung, list(_TILE)).select("a", F.col("name").alias("b"))).withColumnRenamed("node", "name").withColumnRenamed("comp", "family")
    sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("rows"))
    known = clumps.join(family.join(sizes, "family"), "name", "left")
    small = F.col("rows") <= FAMILY
    keep = {"token": F.col("family"), "band": F.lit(-1), "sub": F.lit(0), "side": F.lit(0), "part": F.lit(0)}
    return known.select(*(F.when(small, keep[c]).otherwise(F.col(c)).alias(c) if c in keep else c for c in clumps.columns)).distinct()


def _arrays(docs: DataFrame, names: DataFrame, leads: DataFrame, size: int, kind: np.ndarray) -> DataFrame:
    """name, set: the sorted array of each class in ``names``, packed.

    Arrays come from one row per class (``leads``: name, key); a bitmap of fixed size tells the pass over the
    texts whose arrays to send, the join is exact.
    """
    keys = stage(leads.join(names.distinct(), "name").select(F.xxhash64("key").alias("h"), "key", "name"), "keys")
    wanted = docs.sparkSession.sparkContext.broadcast(bit_filter(keys.select("h"), FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = wanted.value.passing(batch.column("h").to_numpy())
            batch = batch.take(pa.array(rows))
            for part in steps(batch):
                s = Sets(part.column("text"), size, kind)
                data = s.h.tobytes()
                got = [data[8 * a : 8 * b] for a, b in zip(s.first[:-1], s.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(got, pa.binary())], names=["key", "set"])

    sets = docs.select("key", F.xxhash64("key").alias("h"), "text").mapInArrow(run, "key string, set binary")
    sets = stage(sets.join(keys.select("key", "name"), "key").select("name", "set").dropDuplicates(["name"]), "sets")
    drop_staged(keys)
    return sets


def _linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def _links(pairs: DataFrame, arrays, percent: int) -> DataFrame:
    """The pairs (leader a, b) that meet the threshold, by intersecting sorted arrays.

    A leader's pairs are dealt out by LEADER_PAIRS; its array goes once to each of these.
    """
    pairs = stage(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    sets = arrays(pairs.select(F.col("a").alias("name")).union(pairs.select("b")))
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / LEADER_PAIRS).alias("parts"))
    dealt = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("sub"), "b")
    heads = counts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("sub"))
    heads = heads.join(sets.withColumnRenamed("name", "a"), "a").select("a", "sub", F.lit(0).alias("kind"), F.col("a").alias("b"), "set")
    rows = heads.unionByName(dealt.join(sets.withColumnRenamed("name", "b"), "b").select("a", "sub", F.lit(1).alias("kind"), "b", "set"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            found = []
            for a, k, b, data in zip(*(batch.column(c).to_pylist() for c in ("a", "kind", "b", "set")), strict=True):
                array = np.frombuffer(data, np.uint64)
                if not k:
                    own = array
                elif _linked(own, array, percent):
                    found.append((a, b))
            cols = zip(*found, strict=True) if found else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["a", "b"])

    links = stage(rows.repartition("a", "sub").sortWithinPartitions("a", "sub", "kind").mapInArrow(compare, "a long, b long"), "verified")
    drop_staged(sets)
    drop_staged(pairs)
    return links


def _tile_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that tie what tiles hold: within a tile every pair that the bitmaps allow is compared unless links found there
    tie it already, so a tile gives fewer links than it has rows, and loses no component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, alone in _gathered(batches, _TILE):
            t = Tile(rows)
            arrays = [np.frombuffer(x.as_py(), np.uint64) for x in t.table.column("set")]
            bits = Bitmaps(pa.array([_bitmap(x) for x in arrays], pa.binary()))
            found = []

            def compare(p: int, q: int) -> None:
                # t.comp changes as links tie classes of this tile
                if t.comp[p] != t.comp[q] and _linked(arrays[p], arrays[q], percent):
                    found.append((t.name[p], t.name[q]))
                    here = t.tile == t.tile[p] if not alone else slice(None)
                    t.comp[here] = np.where(t.comp[here] == t.comp[q], t.comp[p], t.comp[here])

            if alone:
                for i in range(len(t.n)):
                    for j in t.fits(bits, percent, i, np.arange(i + 1, len(t.n))).tolist():
                        compare(i, j)
            else:
                for p, q in t.near(bits, percent):
                    for i, j in zip(p.tolist(), q.tolist(), strict=True):
                        compare(i, j)
            cols = zip(*found, strict=True) if found else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["a", "b"])

    full = rows.join(sets, "name").select(*_TILE, "name", "comp", "n", "side", "part", "set")
    return stage(full.repartition(*_TILE).sortWithinPartitions(*_TILE, "n", "name").mapInArrow(run, "a long, b long"), "verified")


def groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, kind: np.ndarray = NONSPACE) -> DataFrame:
    """doc_id, key (``row_key`` of doc_id and text), n (size of the set), comp (a name of the component) for each row of ``docs``."""
    keyed = docs.select("doc_id", "text", row_key("doc_id", "text").alias("key"))
    for seed in range(4):
        about = stage(_describe(keyed, size, kind, seed), "sets")
        full = about.where("n > 0")
        classes = stage(full.groupBy("name").agg(F.min("key").alias("key"), F.min("check").alias("c0"), F.max("check").alias("c1"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("least").alias("least"), F.count(F.lit(1)).alias("rows")), "classes")
        if classes.where("c0 != c1").isEmpty():
            break
        drop_staged(about)
        drop_staged(classes)
    n_docs = classes.agg(F.sum("rows")).first()[0] or 0
    sizes = classes.select("name", "n", "bits")

    def arrays(names: DataFrame) -> DataFrame:
        return _arrays(keyed, names, classes.select("name", "key"), size, kind)

    # stars: every class that agrees with others in a minimum hash is compared with the least of them
    least = classes.select("name", F.posexplode("least").alias("k", "m"))
    leaders = least.groupBy("k", "m").agg(F.min("name").alias("a"), F.max("name").alias("last")).where("a != last")
    stars = least.join(leaders.select("k", "m", "a"), ["k", "m"]).where("a != name").select("a", F.col("name").alias("b")).distinct()
    links = _links(_bounded(stars, sizes, percent), arrays, percent)
    comps = components(links)

    frequent = _frequent(keyed, size, kind, n_docs)
    met = stage(_shared_prefixes(keyed, size, kind, percent, seed, frequent), "met")
    rest = stage(_families(stage(_clumps(_tiles(met, sizes, comps, percent), percent), "clumps")), "rest")
    if not rest.isEmpty():
        links = links.unionByName(_tile_links(rest, arrays(rest.select("name")), percent))
        comps = components(links)

    rows = about.select("doc_id", "key", "n", "name").join(comps.withColumnRenamed("node", "name"), "name", "left")
    out = stage(rows.select("doc_id", "key", "n", F.coalesce("comp", "name").alias("comp")), "groups")
    for old in (about, classes, met, rest, links, comps):
        drop_staged(old)
    return out


def join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, kind: np.ndarray = NONSPACE) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``.

    Documents link when 100 * intersection >= ``percent`` * union of their shingle sets; component_id is the
    smallest doc_id reachable.  Null, empty and wordless texts have no shingles and link with nothing.  Equal
    sets link, repeated rows too.  A null doc_id can be linked but never names a component that has another id.
    An empty table gives an empty result.
    """
    rows = groups(docs, size, percent, kind)
    smallest = rows.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    linked = rows.where("n > 0").join(smallest, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, kind: np.ndarray = NONSPACE) -> DataFrame:
    """``docs`` with one row of each component: of its rows with the smallest doc_id (null last) one.

    Rows are told apart by doc_id and text, so rows that share a doc_id but not a text are judged apart.  Rows
    without shingles all stay.
    """
    key = own(docs, "key")["key"]
    rows = groups(docs, size, percent, kind).where("n > 0")
    best = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("best"))
    each = rows.groupBy("comp", "key").agg(F.count(F.lit(1)).alias("rows"))
    # rows equal in both stand or fall together, but of several only one stays
    fate = each.join(best, "comp").select(F.col("key").alias(key), F.when(F.col("key") != F.col("best.key"), "none").when(F.col("rows") > 1, "one").alias("fate")).where("fate is not null")
    fate = stage(fate.withColumnRenamed("fate", fate_name := own(docs, "fate")["fate"]), "fate")
    # only rows that may go are shuffled, to a join of one form at any size
    keyed = docs.withColumn(key, row_key("doc_id", "text")).withColumn(h := own(docs, "h")["h"], F.xxhash64(key))
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(fate.select(F.xxhash64(key).alias("h")), FILTER_BITS))
    judged = only(keyed, h, shared).join(fate.hint("merge"), key, "left")
    several = judged.where(F.col(fate_name) == "one").dropDuplicates([key])
    return judged.where(F.col(fate_name).isNull()).unionByName(several).select(*docs.columns).unionByName(only(keyed, h, shared, False).select(*docs.columns))


def brute_force(docs: list[tuple], size: int = SHINGLE, percent: int = PERCENT) -> list[tuple]:
    """The join by plain loops, for tests."""
    import re

    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    comp = list(range(len(docs)))

    def root(i: int) -> int:
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                comp[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs)]
