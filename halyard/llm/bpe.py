"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves every pre-token that is itself a token.
Tier two: the rest is merged with a heap over a doubly linked list of bytes, O(n log n) for any length.
The vocabulary (a fixed file of about 50 thousand entries) is read on the driver from a path that the
caller gives, and broadcast; its size does not depend on the corpus.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import steps

#: Pre-tokens kept resolved in a worker, and the longest that is kept: bounds the memo's memory.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 48
_MASK = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a rank file (base64 token, space, rank); ranks must be 0..n-1."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def _slot(h: int, d: int, n: int) -> int:
    x = (h + d * 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & _MASK
    return (x ^ (x >> 32)) % n


def _slots(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """``_slot`` over arrays."""
    with np.errstate(over="ignore"):
        x = h + d * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


def spelled_out(pattern: str) -> str:
    r"""``pattern`` for the standard ``re`` module, which is faster but lacks ``\p{L}`` and ``\p{N}``.

    These classes and ``\s`` (which the two modules define differently) become explicit code point ranges.
    """
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x10000))))

    def ranges(cls: str) -> str:
        return "".join(f"\\U{ord(m[0][0]):08x}-\\U{ord(m[0][-1]):08x}" for m in regex.finditer(f"{cls}+", every))

    inside, out = False, []
    named = {r"\p{L}": ranges(r"\p{L}"), r"\p{N}": ranges(r"\p{N}"), r"\s": ranges(r"\s")}
    for t in regex.findall(r"\\p\{\w+\}|\\.|.", pattern, flags=regex.S):
        if t in named:
            t = named[t] if inside else f"[{named[t]}]"
        elif t == r"\S":
            if inside:
                raise ValueError(t)
            t = f"[^{named[r'\s']}]"
        elif t.startswith(r"\p"):
            raise ValueError(t)
        inside = t == "[" or inside and t != "]"
        out.append(t)
    return "".join(out)


class PerfectHash:
    """A minimal perfect hash: n keys on n slots, by hash and displace.

    Keys are dealt to buckets of about four; the largest buckets first look for a displacement that sends
    all of their keys to free slots; buckets of one key then name a free slot directly (as ~slot).
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = max(1, len(keys))
        self.keys = keys
        self.buckets = max(1, n // 4)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(hashes)) != len(keys):
            raise ValueError("vocabulary keys collide or repeat")
        groups: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            groups.setdefault(h % self.buckets, []).append(i)
        self.displace = [0] * self.buckets
        self.at = [-1] * n
        taken = np.zeros(n, bool)
        for b, members in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                break
            h, found = np.array([hashes[i] for i in members], np.uint64)[:, None], None
            for lo in range(0, 1 << 30, 1024):
                slots = _slots(h, np.arange(lo, lo + 1024, dtype=np.uint64), n)
                for k in np.flatnonzero(~taken[slots].any(axis=0)):
                    if len(set(one := slots[:, k].tolist())) == len(one):
                        found = lo + int(k)
                        break
                if found is not None:
                    break
            self.displace[b] = found
            taken[one] = True
            for i, s in zip(members, one, strict=True):
                self.at[s] = i
        free = iter([s for s, i in enumerate(self.at) if i < 0])
        for b, members in groups.items():
            if len(members) == 1:
                s = next(free)
                self.displace[b] = ~s
                self.at[s] = members[0]

    def get(self, key: bytes) -> int:
        """Index of ``key``, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displace[h % self.buckets]
        i = self.at[~d if d < 0 else _slot(h, d, self.n)]
        return i if i >= 0 and self.keys[i] == key else -1


class Codec:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.hash = PerfectHash(tokens)
        try:
            self.spelled = spelled_out(pattern)
        except ValueError:
            self.spelled = ""
        self._ready()

    def _ready(self) -> None:
        self.ranks = {t: i for i, t in enumerate(self.tokens)}
        self.find_any = regex.compile(self.pattern).findall
        self.find_basic = re.compile(self.spelled).findall if self.spelled else self.find_any
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search
        self.memo: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("tokens", "pattern", "hash", "spelled")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._ready()

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge by rank, lowest first and leftmost among equals, with a heap over linked bytes."""
        n = len(piece)
        if n >= 1 << 20:
            return self._merge_long(piece)
        ranks = self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # an entry is rank, start and stop of a pair in one integer
        heap = [ranks[t] << 40 | i << 20 | i + 2 for i in range(n - 1) if (t := piece[i : i + 2]) in ranks]
        heapify(heap)
        while heap:
            x = heappop(heap)
            i, stop = x >> 20 & 0xFFFFF, x & 0xFFFFF
            mid = after[i]
            # stale if the left part was swallowed (after is 0) or either part has grown since
            if not mid or mid == n or after[mid] != stop:
                continue
            after[mid], after[i] = 0, stop
            if stop < n:
                before[stop] = i
                end = after[stop]
                if (t := piece[i:end]) in ranks:
                    heappush(heap, ranks[t] << 40 | i << 20 | end)
            p = before[i]
            if p >= 0 and (t := piece[p:stop]) in ranks:
                heappush(heap, ranks[t] << 40 | p << 20 | stop)
        out, i = [], 0
        while i < n:
            j = after[i]
            out.append(ranks[piece[i:j]])
            i = j
        return tuple(out)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """``merge`` for pieces whose places don't fit the packed entries."""
        n, rank = len(piece), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            mid = after[i]
            if not mid or mid == n or after[mid] != stop:
                continue
            after[mid], after[i] = 0, stop
            if stop < n:
                before[stop] = i
            for lo, hi in ((i, after[stop] if stop < n else 0), (before[i], stop)):
                if lo >= 0 and hi and (r := rank(piece[lo:hi])) is not None:
                    heappush(heap, (r, lo, hi))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def resolve(self, pre: str) -> tuple[int, ...]:
        piece = pre.encode()
        i = self.hash.get(piece)
        ids = (i,) if i >= 0 else self.merge(piece)
        if len(pre) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[pre] = ids
        return ids

    def find(self, text: str) -> list[str]:
        return (self.find_any if self.beyond(text) else self.find_basic)(text)

    def encode(self, text: str) -> list[int]:
        get, resolve = self.memo.get, self.resolve
        return list(chain.from_iterable([get(p) or resolve(p) for p in self.find(text)]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the column ``ids`` (array of int): the whole of ``text`` as token ids.

    Null text gives no ids, like the empty text.  A column already named ``ids`` is replaced; others,
    repeated rows and their order within a partition stay.  No shuffle.
    """
    codec = df.sparkSession.sparkContext.broadcast(load(path, pattern))
    keep = [c for c in df.columns if c != ids]
    schema = df.select(*keep, F.array().cast("array<int>").alias(ids)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_one = codec.value.encode
        for batch in batches:
            for part in steps(batch, text):
                values = [encode_one(t) if t else [] for t in part.column(text).to_pylist()]
                ends = np.cumsum([0, *map(len, values)])
                flat = np.fromiter(chain.from_iterable(values), np.int32, int(ends[-1]))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists], names=[*keep, ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the binary column ``out``: the bytes that ``ids`` stand for; null ids give no bytes."""
    codec = df.sparkSession.sparkContext.broadcast(load(path, pattern))
    keep = [c for c in df.columns if c != out]
    schema = df.select(*keep, F.lit(b"").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode_one = codec.value.decode
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column(ids)
                flat, ends = lists.flatten().to_numpy().tolist(), np.cumsum(pc.fill_null(pc.list_value_length(lists), 0)).tolist()
                got = [decode_one(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(got, pa.binary())], names=[*keep, out])

    return df.mapInArrow(run, schema)


def digest(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id with the number and digest of the ids of its text and the digest of what they decode to."""
    coded = encode(df.select("doc_id", "text"), path, pattern).drop("text")
    back = decode(coded, path, pattern)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
