"""The queries op1 to op10 with production parameters, each over the whole table it is meant for, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesift.llm import decontam, feistel_shards, line_dedup, quality, simhash, token_binary, token_counts, unigram, url_filter, warc
from treesift.llm.common import documents, pages

WORD_MODEL, PIECE_MODEL = "word_bpe_49k.json", "piece_bpe_32k.model"


def model_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = warc.warc_round_trip(pages(spark, sf_dir))
    return done.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(documents(spark, sf_dir))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.token_files(documents(spark, sf_dir), model_path(WORD_MODEL))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), model_path(PIECE_MODEL))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards.feistel_shards(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.quality(documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode_decode(documents(spark, sf_dir), model_path(PIECE_MODEL))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(pages(spark, sf_dir)).select("page_id", "host", "path", "rule", "verdict")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_warc, op2_line_dedup, op3_token_binary, op4_token_counts, op5_sharding, op6_quality, op7_simhash, op8_sentencepiece, op9_url_filter, op10_decontamination)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.oracle_sql(), "op9_url_filter": url_filter.oracle_sql(), "op10_decontamination": decontam.oracle_sql()}
