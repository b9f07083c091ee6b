"""Texts stored as lossless WebP media and read back as pixel arrays (see ``webp``).

A text's UTF-8 bytes, with spaces up to a positive multiple of 192, are 8-bit samples; the stored form is a run of WebP files.
Null and empty texts are 192 spaces. Equal texts have equal media. Repeated rows are stored row by row; other columns of the
input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, slices, written
from .webp import decode_samples, encode_samples, pad

SLICE = 6 << 20


def write_media(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The table (id, n_bytes, media) in the shared folder."""
    arrow_rows(docs.sparkSession, 4000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
            media = [encode_samples(pad(x)) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return written(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary"), "media").withColumnRenamed("id", id_col)


def read_media(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, media, payload): the samples of each row's media, read back."""
    arrow_rows(stored.sparkSession, 4000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", SLICE // 2):
            media = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(decode_samples(media), pa.binary())], ["id", "n_bytes", "media", "payload"])

    kind = stored.schema[id_col].dataType.simpleString()
    return stored.select(F.col(id_col).alias("id"), "n_bytes", "media").mapInArrow(run, f"id {kind}, n_bytes long, media binary, payload binary").withColumnRenamed("id", id_col)


def features(payload: bytes) -> str:
    """Rows, mean, spread, share of changes from sample to sample, and a histogram of 16 bands, of a payload's samples."""
    x = np.frombuffer(payload, np.uint8)
    bands = np.bincount(x >> 4, minlength=16)
    return f"rows={len(x) // 192};mean={x.mean():.6f};std={x.std():.6f};edges={np.count_nonzero(np.diff(x)) / len(x):.6f};bands=" + ",".join(map(str, bands.tolist()))


def digest(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sizes, hashes and features of each row's media and of the payload read back from it."""
    arrow_rows(stored.sparkSession, 4000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", SLICE // 2):
            media = batch.column(2).to_pylist()
            back = decode_samples(media)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(p) for p in back], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in back]),
                    pa.array([zlib.crc32(p[-16:]) for p in back], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                    pa.array([features(p) for p in back]),
                ],
                ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    kind = stored.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select(F.col(id_col).alias("id"), "n_bytes", "media").mapInArrow(run, schema).withColumnRenamed("id", id_col)
