"""What the operators of this subpackage share: staging tables, batching, row keys, word hashing."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.session import shared_dir

#: Bytes of text that one vectorised step takes at once; longer single texts form a step of their own.  A step's arrays
#: are many times its text, in each Python worker: at 2 MB language ID takes 100 MB for them, at 512 KB 26 MB in the same time.
STEP_BYTES = 512 << 10
#: For what is found out from all rows of a step together.
LONG_STEP_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/halyard/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = stage_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Remove the folder that ``stage`` wrote for ``df``, once nothing reads it any more."""
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in folders:
        if "/halyard/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def row_key(*cols: str) -> Column:
    """128 bits that name a row by content, null-safe; rows equal in all of ``cols`` share it.

    Two seeded 64-bit hashes: a join key where ids may be null or repeated.
    """
    tagged = [x for c in cols for x in (F.col(c).isNull(), F.col(c))]
    return F.concat_ws("-", F.hex(F.xxhash64(*tagged)), F.hex(F.xxhash64(F.lit(17), *reversed(tagged))))


def own(df: DataFrame, *names: str) -> dict[str, str]:
    """Names for columns of an operator's own that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, {}
    for n in names:
        own_name = f"_{n}"
        while own_name.lower() in taken:
            own_name = "_" + own_name
        out[n] = own_name
    return out


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``column`` holds about ``limit`` bytes each; no row is dropped."""
    col = batch.column(column)
    sizes = np.zeros(len(col), np.int64) if len(col) == 0 else col_sizes(col)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(col):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def col_sizes(col: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty.  offsets has one entry more than rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        import pyarrow.compute as pc

        col = pc.fill_null(col, b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


_M = np.uint64
_ODD = _M(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply), vectorised."""
    x = x ^ (x >> _M(30))
    x = x * _M(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _M(27))
    x = x * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([[_M(1)], np.full(size - 1, _ODD, np.uint64)]))
    return _POWERS[:n]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A-Z lower-cased, words of digits, letters and bytes of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Words divided by ASCII white space.
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False


class Words:
    """Words of the texts of one step, as byte spans with 64-bit hashes.

    ``start``/``end`` index ``data`` (lower-cased bytes of all texts in a row), ``doc`` is the row of
    each word, ``first`` the index of each row's first word (one entry more than rows).
    """

    def __init__(self, col: pa.Array, kind: np.ndarray = ALNUM, lower: bool = True):
        data, offsets = text_bytes(col)
        self.offsets = offsets
        self.data = LOWER[data] if lower else data
        n = len(offsets) - 1
        # a separator after each text keeps words of neighbouring texts apart
        is_word = np.zeros(len(data) + 1, np.int8)
        is_word[:-1] = kind[self.data]
        turns = np.diff(is_word, prepend=np.int8(0))
        joins = offsets[1:-1]
        joins = joins[(joins > 0) & (joins < len(data))]
        joins = joins[(is_word[joins] == 1) & (is_word[joins - 1] == 1)]
        start, end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        if len(joins):
            joins = np.unique(joins)
            start, end = np.sort(np.concatenate([start, joins])), np.sort(np.concatenate([end, joins]))
        self.start, self.end = start, end
        self.first = np.searchsorted(start, offsets)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        self.hash = span_hashes(self.data, start, end)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for spans in order that don't overlap; equal bytes give equal hashes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    total = int(length.sum())
    begin = np.cumsum(length) - length
    where = np.arange(total) - np.repeat(begin - start, length)
    inside = np.arange(total) - np.repeat(begin, length)
    with np.errstate(over="ignore"):
        values = _TABLE[data[where]] * _powers(int(length.max()))[inside]
        full = length > 0
        out = np.zeros(len(start), np.uint64)
        out[full] = np.add.reduceat(values, begin[full]) if full.any() else 0
        return mix64(out + length.astype(np.uint64) * _TABLE[7])


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` word hashes; shorter by size - 1."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out = out * _ODD + words[k : k + n]
        return mix64(out + _M(size))


class BitFilter:
    """A hashed set of fixed size: 2**bits bits, whatever went in; it lets some other hashes pass too."""

    def __init__(self, bits: int):
        self.bits = bits
        self.store = np.zeros(1 << (bits - 3), np.uint8)

    def passing(self, h: np.ndarray) -> np.ndarray:
        """Indexes of the 64-bit hashes that may have gone in."""
        place = h.view(np.uint64) >> _M(64 - self.bits)
        return np.flatnonzero(self.store[place >> _M(3)] >> (place & _M(7)).astype(np.uint8) & 1)


def bit_filter(hashes: DataFrame, bits: int) -> BitFilter:
    """A filter of the column ``h``, made by aggregation: the driver gets at most 2**(bits - 15) rows of 4 KB."""
    place = F.shiftrightunsigned("h", 64 - bits)
    rows = hashes.groupBy(F.shiftright(place, 15).cast("int").alias("b")).agg(F.bitmap_construct_agg((place % 32768).cast("long")).alias("bits")).collect()
    out = BitFilter(bits)
    for r in rows:
        out.store[r["b"] * 4096 : (r["b"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def may_pass(batch: pa.RecordBatch, h: str, shared) -> np.ndarray:
    """Which rows' hashes (column ``h``) may be in the broadcast filter."""
    out = np.zeros(batch.num_rows, bool)
    out[shared.value.passing(batch.column(h).to_numpy())] = True
    return out


def only(df: DataFrame, h: str, shared, inside: bool = True) -> DataFrame:
    """The rows whose hash ``h`` may be in the broadcast filter, or those for which it can't: of a large table only rows that may
    have a partner need to be shuffled to a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_pass(batch, h, shared) == inside))

    return df.mapInArrow(run, df.schema)


def sql_words(expr: str, pattern: str) -> str:
    """DuckDB: list of matches of ``pattern`` in ``expr``."""
    return f"regexp_extract_all({expr}, '{pattern}')"


def sanitize(name: str) -> str:
    return re.sub(r"\W", "_", name)
