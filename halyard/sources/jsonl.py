"""JSON lines of vectors: {"id": ..., "vec": [...]} per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "id string, vec array<float>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """All vectors of the file or folder; empty lines are skipped, malformed ones are an error."""
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)
