"""The corpus pipeline: five stages over ``documents``, each on all that its predecessor kept.

Every stage is a function of (spark, docs, sf_dir); ``run`` writes each stage's rows as Parquet to the shared
folder and reads them again for the next, so a lost executor costs a stage at most.  All but the last stage
return the columns of documents.  Rows are told apart by doc_id and text; rows equal in both are copies of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import bpe, decontaminate, jaccard, langid, lines
from halyard.llm.common import drop_staged, row_key, stage, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Mean marginal under which a text is in no language known here; a quarter is chance for four languages.
LEAST_SCORE = 0.3
#: Lines of a chunk at least, and percentage of a text's lines that may go unless all do: shorter chunks and larger cuts
#: leave pieces of near copies, which the next stage can no longer know as copies; whole it drops them.
CHUNK_LINES, MOST_LINES = 4, 50


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters or in no known language go; ``lang`` becomes the prediction."""
    got = langid.predict(docs, langid.train(docs))
    return got.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go; so does a text of which they were all.  Near copies are left to the next stage."""
    got = lines.dedup(docs, CHUNK_LINES, MOST_LINES)
    return got.where("n_removed_lines = 0 or trim(text) != ''").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) one row of the smallest doc_id stays."""
    return jaccard.one_of_each(docs.select(*COLUMNS), size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.hits(docs.select(row_key("doc_id", "text").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = found.where("found is not null").select(F.col("doc_id").alias("_key")).distinct()
    return docs.withColumn("_key", row_key("doc_id", "text")).join(gone, "_key", "left_anti").select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, counted and digested, and the digest of what they decode to."""
    import public_tokenizers as P

    return bpe.digest(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]
#: Rolling hashes, trained models and merges aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop_staged(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
