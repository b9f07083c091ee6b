"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of the lengths of frequent pre-tokens, gathered as bounded per-partition heavy-hitter
summaries over all rows and broadcast; tier two encodes what it misses with the library and keeps that in a bounded cache
of each worker. No pre-token is shuffled: only the summaries are. Both tiers give the library's own lengths, so neither
the table's content nor the cache's bound changes a count.

Null and empty texts have 0 bytes and 0 tokens; repeated rows and ids are counted row by row; further columns of the input
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, slices
from .pieces import encode_keys, keys, model

#: Rows of the broadcast table, characters of its longest key, rows that one partition's summary keeps, and a worker's cache.
TABLE_ROWS, KEY_CHARS, SUMMARY_ROWS, CACHE_ROWS = 32_768, 24, 4_096, 400_000
_CACHE: dict[tuple, dict[str, int]] = {}


def frequent_keys(docs: DataFrame, text: str = "text", rows: int = TABLE_ROWS) -> list[str]:
    """The keys found most often by summing the partitions' bounded summaries (Misra and Gries): at most ``rows``."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches, text):
            for x in batch.column(text).to_pylist():
                if x:
                    seen.update(keys(x))
            if len(seen) > 8 * SUMMARY_ROWS:  # keep the top and take the next one's count from all, as in the published sketch
                top = seen.most_common(4 * SUMMARY_ROWS + 1)
                less = top[-1][1]
                seen = Counter({k: v - less for k, v in top if v > less})
        top = [(k, v) for k, v in seen.most_common(SUMMARY_ROWS) if len(k) <= KEY_CHARS and "\0" not in k]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([v for _, v in top], pa.int64())], ["k", "n"])

    found = docs.select(text).mapInArrow(summary, "k string, n long").groupBy("k").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k").limit(rows)
    return [r.k for r in found.select("k").collect()]


def token_counts(docs: DataFrame, model_path: str, limit: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text, without begin, end or other added tokens."""
    sc = docs.sparkSession.sparkContext
    arrow_rows(docs.sparkSession)
    frequent = frequent_keys(docs, text)
    lens = np.array([len(x) for x in encode_keys(model(model_path), frequent)], np.uint16)
    hot = sc.broadcast((uuid.uuid4().hex, "\0".join(frequent), lens.tobytes()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, (at, names, packed) = model(model_path), hot.value
        if at not in _CACHE:
            _CACHE.clear()
            _CACHE[at] = dict(zip(names.split("\0"), np.frombuffer(packed, np.uint16).tolist(), strict=True)) if packed else {}
        cache, base = _CACHE[at], len(packed) // 2
        for batch in slices(batches, text):
            parts = [keys(x) if x else [] for x in batch.column(text).to_pylist()]
            missing = list(set().union(*parts).difference(cache)) if parts else []
            cache.update(zip(missing, map(len, encode_keys(sp, missing)), strict=True))
            n = [sum(map(cache.__getitem__, p)) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(batch.column(text)).fill_null(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )
            if len(cache) > base + CACHE_ROWS:
                for k in list(cache)[base:]:  # the frequent ones came first
                    del cache[k]

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias(text)).mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
