"""A training corpus from `documents`, in five stages; each calls one operator of treesift.llm.

Every stage function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns that docs
has, with `text` as the stage leaves it and `n_chars`, where there is one, to match. Null texts fail the quality rules and
go first; repeated rows are judged alike, and of those with equal texts the near-duplicate stage keeps one. An empty table
passes every stage as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesift.llm import decontam, line_dedup, quality, simhash, unigram
from treesift.llm.common import documents, shared_dir
from treesift.llm.queries import PIECE_MODEL, model_path


def _recounted(df: DataFrame) -> DataFrame:
    """df with n_chars of the text it now has."""
    return df.withColumn("n_chars", F.char_length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else df


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go, then documents that fail the base rules or lose too much text."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    judged = quality.quality(docs.withColumnsRenamed({c: f"c_{k}" for k, c in enumerate(others)}), carry=tuple(f"c_{k}" for k in range(len(others))))
    kept = judged.where("kept").select(F.col("doc_id"), F.col("clean_text").alias("text"), *[F.col(f"c_{k}").alias(c) for k, c in enumerate(others)])
    return _recounted(kept.select(*docs.columns))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; documents stay, if need be with an empty text."""
    return _recounted(line_dedup.with_kept_text(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, linked at a similarity of 0.8 or more of 5-word shingles, the document with the smallest doc_id stays; rows without an id stay."""
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; of several texts under one id each is judged by itself."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, with the checksum of the text decoded from them."""
    return unigram.encode_decode(docs, model_path(PIECE_MODEL), with_ids=True)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("sentencepiece_encoding", encoding_stage),
]

#: SQL can't express fingerprints, components and the Viterbi search; tests/llm/test_pipeline.py compares each stage, and all of them, with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what one returns is written to the shared folder and read again by the next."""
    docs, folder = documents(spark, sf_dir), shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
