"""Thin queries of the training-data operators: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, hard_negatives, line_chunks, media, nn_descent, resample, shingle_join
from .block_mix import mix
from .common import table
from .piece_codec import digests, encode_decode
from .ring_shards import ring_shards
from .token_counts import token_counts
from .toxicity import fit, toxicity
from .word_ids import read_ids, write_ids

TOKEN_LIMIT = 4096
END_ID = 1


def op1_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), TOKEN_LIMIT)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))


def op4_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.write_media(table(spark, sf_dir, "documents")))


def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.digest(line_chunks.line_dedup(table(spark, sf_dir, "documents")))


def op6_word_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ids(write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID))


def op7_block_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op9_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_shards(table(spark, sf_dir, "documents"))


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.digest(best_fit.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows, F.col("id") % 100 == 0)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_shingle_join, op2_token_counts, op3_toxicity, op4_webp_media, op5_line_chunks, op6_word_ids, op7_block_mix, op8_nn_descent, op9_ring_shards, op10_piece_codec, op11_best_fit, op12_hard_negatives, op13_resample)}
ORACLES: dict[str, str] = {"op1_shingle_join": shingle_join.ORACLE, "op5_line_chunks": line_chunks.ORACLE, "op8_nn_descent": nn_descent.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE, "op13_resample": resample.ORACLE}
