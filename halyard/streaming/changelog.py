"""Ordered change logs: the sequence gate, last-writer-wins state, tombstone counts.

A log is rows of (pos, seq, kind, id, ...): pos is the place in the log, seq the number the writer gave, kind
``upsert`` or ``delete``.  Replay applies an operation only if its seq is above a floor and above every seq
applied before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGES = 64


def gated(log: DataFrame, floor: int = -1, ranges: int = RANGES) -> DataFrame:
    """The operations that replay applies.

    A running maximum over a whole log would be one task.  So the log is cut into ranges of pos of about equal
    size; the maximum of each (a few numbers) is collected, and inside a range the running maximum starts
    from that of the ranges before it.
    """
    cuts = sorted(set(log.approxQuantile("pos", [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    part = F.lit(0)
    for c in cuts:
        part = part + (F.col("pos") >= c).cast("int")
    cut = log.withColumn("_range", part)
    top, start = floor, {}
    for r in cut.groupBy("_range").agg(F.max("seq").alias("m")).orderBy("_range").collect():
        start[r["_range"]] = top
        top = max(top, r["m"])
    before = F.coalesce(*(F.when(F.col("_range") == k, F.lit(v)) for k, v in start.items()), F.lit(floor)) if start else F.lit(floor)
    w = Window.partitionBy("_range").orderBy("pos", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("_seen", F.greatest(before, F.coalesce(F.max("seq").over(w), before))).where("seq > _seen").drop("_range", "_seen")


def live(ops: DataFrame, *payload: str) -> DataFrame:
    """id, seq and payload of the last operation of each id, where that is an upsert; combined map-side."""
    last = ops.groupBy("id").agg(F.max_by(F.struct("kind", "seq", *payload), "seq").alias("r"))
    return last.where("r.kind = 'upsert'").select("id", F.col("r.seq").alias("seq"), *(F.col(f"r.{p}").alias(p) for p in payload))


def sizes(ops: DataFrame) -> DataFrame:
    """One row: live ids and tombstones (versions overwritten or removed)."""
    last = ops.groupBy("id").agg(F.max_by("kind", "seq").alias("kind"), F.count_if(F.col("kind") == "upsert").alias("versions"))
    alive = F.count_if(F.col("kind") == "upsert")
    return last.agg(alive.alias("live"), (F.coalesce(F.sum("versions"), F.lit(0)) - alive).alias("deleted"))


def replay(snapshot: DataFrame, log: DataFrame, cutoff: int, *payload: str) -> DataFrame:
    """State of a snapshot (id, seq, payload) taken at ``cutoff`` with the later part of a log applied."""
    ops = gated(log, cutoff).select("id", "seq", "kind", *payload)
    base = snapshot.select("id", "seq", F.lit("upsert").alias("kind"), *payload)
    return live(base.unionByName(ops), *payload)
