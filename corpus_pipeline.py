"""From documents to token ids: quality, near duplicates, benchmark passages, mixture, token files.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; run() writes each result as Parquet in the shared folder and reads it back.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, mixing, near_join, quality, rans
from tessera.llm.common import remainder, scratch_path, stored, table
from tessera.llm.queries import domain_of, language_weights


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects."""
    labels = spark.read.parquet(table(sf_dir, "labels"))
    return quality.accepted(docs, labels, remainder(F.col("doc_id"), 5) == 0)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component of similar documents."""
    return near_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontamination.without_contaminated(docs, spark.read.parquet(table(sf_dir, "benchmark")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps four fifths of the tokens, by language targets and evenly by domain and source."""
    return mixing.selected(docs, domain=domain_of(F.col("source")), weights=language_weights(), share=0.8, seed=7)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what they hold: doc_id, start, n_tokens, ids_crc32."""
    path = scratch_path(spark, "tokens")
    rans.write_tokens(docs, path, tokenizer=rans.public_tokenizer())
    return rans.read_tokens(spark, path)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_stage),
]

#: Neither the classifier nor the tokenizer can be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from documents."""
    docs = spark.read.parquet(table(sf_dir, "documents"))
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
