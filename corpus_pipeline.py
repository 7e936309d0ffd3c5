"""The corpus pipeline: documents to token ids. Each stage is written as Parquet and read again by the next.

1. quality: documents that fail the base rules, or whose source fails them too often, go.
2. near duplicates: one document of each class on five-word shingles at 0.8 stays.
3. personal data: spans are replaced by the name of their kind.
4. mixing: sources are drawn at tempered weights under a token budget; a document of a small source may
   come up to three times, and of a large one some are left out.
5. pieces: token ids take the place of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.host_rules import passing
from strandline.llm.minhash_bayes import drop_near_duplicates
from strandline.llm.pii_bootstrap import redact
from strandline.llm.temperature_mix import temperature_mix
from strandline.llm.unigram_pieces import default_model, encode_pieces
from strandline.plans.runtime import cut, table

#: The last stages cannot be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    redacted = redact(docs)
    if "n_chars" in redacted.columns:
        redacted = redacted.withColumn("n_chars", F.length("text").cast("long"))
    return redacted


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return temperature_mix(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_pieces(docs, default_model(spark), keep_text=False).withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixing),
    ("pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
