"""Training-data pipeline over ``documents``: reject toxic texts, remove repeated chunks of lines, keep one document of each
group of near-duplicates, mix the sources to their weights, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``; the last returns the mix's rows encoded. After mixing, a
document has a row for each repeat in which some of its words are taken.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.block_mix import mixed_documents
from blockloom.llm.common import table, written
from blockloom.llm.line_chunks import without_repeats
from blockloom.llm.piece_codec import encode_decode
from blockloom.llm.shingle_join import without_near_copies
from blockloom.llm.toxicity import fit, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the classifier's threshold; it learns from this corpus's labels."""
    return without_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs and chunks of lines that came before; a document of which nothing is left goes."""
    return without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 0.8 or more over five-word shingles, the document with the smallest id."""
    return without_near_copies(docs, 5, 8, 10)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, as rows like the input's."""
    return mixed_documents(docs).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids (little-endian unsigned 32-bit integers, with begin and end) of each row, and its decoded text's hash."""
    coded = encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("source_mixing", mixing), ("sentencepiece", encoding)]

#: No stage but the second and third is SQL's: the classifier, the draw of the mix and the tokens aren't. Tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
