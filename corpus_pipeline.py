"""A training-corpus pipeline over ``documents``: five operators, one after the other.

Each stage gets what the one before kept, written as Parquet and read again, and works on all of it.  All but
the last return the columns of ``documents``, whatever others there are and whatever their names.

Defined results: documents without text, or with an empty one, are rejected by the classifier.  Of near duplicates the
document with the smallest doc_id stays, of its repeated rows one; rows with one doc_id but different texts are documents of
their own.  A document without a doc_id stays only if nothing with one is near it, and of such documents with equal
texts one does.  An empty table goes through all stages.  Written stages are removed once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, decontaminate, jaccard_join, quality, secrets
from spanloom.llm.workspace import dropped, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  Its training documents are those of this stage's input."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays (see the module for the other cases).

    Documents are told apart by a digest of doc_id and text.  Of each component the document with the least (doc_id, digest) is
    kept; null ids come last.
    """
    columns = docs.columns
    key = F.unhex(F.sha2(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))), 256))
    name = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), key.alias("key"))
    first = jaccard_join.jaccard_classes(docs.select(name.alias("doc_id"), "text")).where("doc_id = component_id").select("doc_id.key").distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), key.alias("key"))
    return keyed.join(first, "key", "left_semi").dropDuplicates(["key"]).select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; n_chars follows."""
    return secrets.masked(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of ids and decoded text."""
    return bpe.bpe_digests(docs)


STAGES = [("quality_classifier", good_quality), ("jaccard_join", one_of_each), ("decontamination", clean_of_benchmarks), ("secret_scans", without_secrets), ("bpe", encoded)]

#: A fitted classifier cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        dropped(before)
    return docs


QUERY = {"pipeline": run}
