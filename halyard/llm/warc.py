r"""WARC: a content-addressed archive.

``write`` stores each distinct payload once under its SHA-256 digest and keeps the exact header block of every
record (WARC and HTTP headers) in a table of its own; ``records`` reconstructs the original records by joining
the two, and ``parse`` takes a record apart again and verifies its digests and lengths.

Payloads meet by digest after a map-side aggregation, so a payload that a third of all rows share is sent once
per task.  The payload table is bucketed by digest: reconstruction joins it where it lies, without moving
payloads again.  Joins of small columns on a hot digest are left to adaptive skew splitting.

Nulls and ties: a null body is the empty payload; a null url gives no target header; of rows that tie for the
smallest id of a payload (repeated rows) all are responses; a row with a null id is the response only where no
row of that payload has an id.  No rows: two empty tables.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import stage_path

_HEX32, _B32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a 40-digit hex string: five bytes give eight characters."""
    parts = [F.translate(F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0"), _HEX32, _B32) for i in range(4)]
    return F.concat(*parts)


@dataclass
class Archive:
    payloads: DataFrame
    records: DataFrame


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _uri(url: Column) -> Column:
    """Header values can't hold line breaks or tabs; they are percent-encoded."""
    for code in (9, 10, 13):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def headers(record_id: Column, kind: Column, url: Column, refers: Column, n_bytes: Column, sha1: Column, sha256: Column, date: str) -> Column:
    """The exact header block: WARC headers, an empty line, HTTP headers, an empty line."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", n_bytes.cast("string")), F.lit("\r\n"))
    revisit = kind == "revisit"
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(n_bytes)
    name = lambda c: F.concat(F.lit("<urn:halyard:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", kind), _line("WARC-Record-ID", name(record_id)), F.lit(f"WARC-Date: {date}\r\n"),
        F.coalesce(_line("WARC-Target-URI", _uri(url)), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)), _line("X-Payload-SHA256", sha256),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), _line("WARC-Refers-To", name(refers)))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), _line("Content-Length", block.cast("string")), F.lit("\r\n"), http,
    ).cast("binary")


def write(df: DataFrame, record_id: str = "page_id", url: str = "url", body: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Archive every row of ``df``; payloads under ``min_bytes`` bytes are never deduplicated into revisits."""
    spark = df.sparkSession
    rows = df.select(F.col(record_id).alias("record_id"), F.col(url).alias("url"), F.coalesce(F.col(body), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))

    path, buckets = stage_path(spark, "warc"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    store = rows.groupBy("digest").agg(F.min("record_id").alias("first_id"), F.first("payload").alias("payload"), F.first("n_bytes").alias("n_bytes"))
    store = store.withColumn("sha1", base32_of_hex(F.sha1("payload")))
    name = f"halyard_warc_{uuid.uuid4().hex}"
    store.repartition(buckets, "digest").write.bucketBy(buckets, "digest").option("compression", "zstd").option("path", f"{path}/payloads").saveAsTable(name)
    payloads = spark.table(name)

    keys = payloads.select("digest", "first_id", "sha1")
    kept = rows.drop("payload").join(keys, "digest")
    kind = F.when((F.col("n_bytes") < min_bytes) | F.col("record_id").eqNullSafe(F.col("first_id")), "response").otherwise("revisit")
    kept = kept.withColumn("kind", kind)
    made = kept.select("record_id", "digest", "kind", headers(F.col("record_id"), F.col("kind"), F.col("url"), F.col("first_id"), F.col("n_bytes"), F.col("sha1"), F.col("digest"), date).alias("headers"))
    made.write.option("compression", "zstd").parquet(f"{path}/records")
    return Archive(payloads, spark.read.schema(made.schema).parquet(f"{path}/records"))


def records(archive: Archive, full: bool = False) -> DataFrame:
    """record_id, kind and the record as it stands in a WARC file, payload and end mark included.

    Revisit records carry no payload of their own; with ``full`` they get that of the record they refer to.
    """
    end, r = F.lit("\r\n\r\n").cast("binary"), archive.records
    own = r if full else r.where("kind = 'response'")
    out = own.join(archive.payloads.select("digest", "payload"), "digest").select("record_id", "kind", F.concat("headers", "payload", end).alias("record"))
    if full:
        return out
    return out.unionByName(r.where("kind = 'revisit'").select("record_id", "kind", F.concat("headers", end).alias("record")))


_FIELD = re.compile(rb"^([A-Za-z0-9-]+): (.*)\r$", re.M)


def split_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record; raises if lengths or marks are wrong."""
    warc, _, rest = record.partition(b"\r\n\r\n")
    if not warc.startswith(b"WARC/1.1\r\n") or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("not a WARC record")
    fields = {k.decode(): v.decode() for k, v in _FIELD.findall(warc + b"\r\n")}
    block = rest[:-4]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("wrong block length")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k.decode(): v.decode() for k, v in _FIELD.findall(http + b"\r\n")}, payload


def parse(df: DataFrame) -> DataFrame:
    """Take records apart: record_id, payload_bytes, payload_digest, record_type, refers_to, url, digest (SHA-256).

    A record with a payload has its length and both digests recomputed; a mismatch is an error.
    """
    schema = "record_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, digest string"

    def number(text: str | None) -> int | None:
        found = re.fullmatch(r"<urn:halyard:(-?\d+)>", text or "")
        return int(found[1]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for record in batch.column("record"):
                fields, http, payload = split_record(record.as_py())
                kind, n, sha1 = fields["WARC-Type"], int(http["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (
                    n != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != sha1 or hashlib.sha256(payload).hexdigest() != fields["X-Payload-SHA256"]
                ):
                    raise ValueError("payload does not match its digest")
                out.append((number(fields["WARC-Record-ID"]), n, sha1, kind, number(fields.get("WARC-Refers-To")), fields.get("WARC-Target-URI"), fields["X-Payload-SHA256"]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    return df.select("record").mapInArrow(run, schema)


def result(pages: DataFrame) -> DataFrame:
    read = parse(records(write(pages)))
    return read.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS f FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(p.h, 1 + 10 * (k // 8), 10) AS BIGINT) >> CAST(35 - 5 * (k % 8) AS BIGINT)) & 31 AS INTEGER), 1) FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM p JOIN f USING (h)
"""
