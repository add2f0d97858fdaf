"""A training corpus in five stages: classify, drop exact copies, drop near copies, decontaminate, pack.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that the stage before kept; its result is
written as Parquet and read again as the next one's docs. All but the last return the columns of `documents`, with any others that the
table has, whatever their names.

Null, empty and wordless texts don't pass the first stage. Texts may be of any length. Of rows alike in text, the largest identifier stays;
of rows alike in text and identifier, one. Rows with null identifiers lose to all others. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, exact_dedup, jaccard_join, packing, quality
from plumbline.plans.storage import Scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier accepts."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased), the document with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of their five-word shingles."""
    return jaccard_join.keep_one(docs, width=5, num=80, den=100)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text"))
    return decontaminate.decontaminate(whole, benchmark, keep=["_row"]).where(F.col("n_hit") == 0).select("_row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("decontaminate", benchmark_leaks),
    ("packing", sequences),
]

#: SQL can express neither the classifier nor the packing; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; returns the last one's rows."""
    scratch, before = Scratch(spark, "pipeline"), []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)
        before = [name]
    return docs
