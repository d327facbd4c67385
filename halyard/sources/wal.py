"""A framed binary change log: parsing with torn-tail recovery, and encoding.

A frame is the payload's length and CRC-32 (unsigned 32-bit, little endian) and the payload: sequence number (32
bits), operation (8 bits: 1 upsert, 2 delete), length of the id (16 bits), the id in UTF-8, and for upserts
the vector's floats.  Parsing stops at the first bad frame of a file; what follows is dropped.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from halyard.sources.fs import Files

UPSERT, DELETE = 1, 2
NAMES = {UPSERT: "upsert", DELETE: "delete"}
_FRAME, _HEAD = struct.Struct("<II"), struct.Struct("<IBH")
MAX_ID_BYTES = 65535
SCHEMA = "path string, pos long, seq long, kind string, id string, vec array<float>"


@dataclass
class Parsed:
    ops: list[tuple]
    valid_bytes: int
    torn: bool


def encode(seq: int, kind: str, id_: str, vec=None) -> bytes:
    name = id_.encode()
    if len(name) > MAX_ID_BYTES:
        raise ValueError(f"id is longer than {MAX_ID_BYTES} bytes")
    op = UPSERT if kind == "upsert" else DELETE
    payload = _HEAD.pack(seq, op, len(name)) + name + (struct.pack(f"<{len(vec)}f", *vec) if op == UPSERT else b"")
    return _FRAME.pack(len(payload), zlib.crc32(payload)) + payload


def parse(data: bytes, dim: int) -> Parsed:
    """(position, seq, kind, id, vec) of each good frame up to the first bad one."""
    ops, at = [], 0
    while at + _FRAME.size <= len(data):
        size, crc = _FRAME.unpack_from(data, at)
        payload = data[at + _FRAME.size : at + _FRAME.size + size]
        if size < _HEAD.size or len(payload) < size or zlib.crc32(payload) != crc:
            break
        seq, op, length = _HEAD.unpack_from(payload)
        rest = payload[_HEAD.size + length :]
        if op not in NAMES or _HEAD.size + length > size or len(rest) != (4 * dim if op == UPSERT else 0):
            break
        vec = list(struct.unpack(f"<{dim}f", rest)) if op == UPSERT else None
        ops.append((at, seq, NAMES[op], payload[_HEAD.size : _HEAD.size + length].decode(), vec))
        at += _FRAME.size + size
    return Parsed(ops, at, at < len(data))


def read(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """The good frames of each log file under ``path``, one task per file."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [(p, *op) for p, data in zip(pdf["path"], pdf["content"], strict=True) for op in parse(bytes(data), dim).ops]
            yield pd.DataFrame(out, columns=["path", "pos", "seq", "kind", "id", "vec"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def repair(spark: SparkSession, path: str, dim: int) -> int:
    """Cut a log file off after its last good frame; returns the bytes that went.  The good part is written beside first, and a
    repair that was broken off is ended by the next."""
    files, beside = Files(spark), f"{path}.repaired"
    if not files.exists(path) and files.exists(beside):
        files.rename(beside, path)
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    got = parse(data, dim)
    if got.torn:
        files.write_bytes(beside, data[: got.valid_bytes])
        files.delete(path)
        files.rename(beside, path)
    return len(data) - got.valid_bytes


def frames(ops: DataFrame) -> DataFrame:
    """seq and the encoded frame of each operation (seq, kind, id, vec)."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"seq": pdf["seq"], "frame": [encode(int(s), k, i, v) for s, k, i, v in zip(pdf["seq"], pdf["kind"], pdf["id"], pdf["vec"], strict=True)]})

    return ops.select("seq", "kind", "id", "vec").mapInPandas(run, "seq long, frame binary")
