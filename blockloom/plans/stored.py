"""Queries over stored chains: all ``orders`` as one chain, written through the sink, rewound, and read again by ranges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.plans.views import blocks
from blockloom.sources import segments
from blockloom.storage import shared_dir


def _chain(s: SparkSession, d: str) -> DataFrame:
    return blocks(s, d).select(F.col("key").alias("number"), "hash", F.md5(F.concat(F.lit("b"), F.col("key") - 1)).alias("parent_hash"))


def _from(rows: DataFrame, share: int) -> DataFrame:
    """Blocks from that many tenths of the head's height on."""
    low = rows.agg((F.max("number") * share).alias("_low"))  # one row
    return rows.crossJoin(F.broadcast(low)).filter("number * 10 >= _low").drop("_low")


def _stored(s: SparkSession, d: str) -> str:
    """A store of the whole chain whose last tenth was replaced by another branch."""
    path = f"{shared_dir(s)}/blockloom/stored-{uuid.uuid4().hex}"
    chain = _chain(s, d)
    segments.store(chain, path)
    segments.store(_from(chain, 9).withColumn("hash", F.md5(F.concat(F.lit("r"), "number"))), path, rewind="true")
    return path


def stored_chain(s, d):
    """What a store holds after a reorganisation of its last tenth."""
    return segments.held(s, _stored(s, d)).select("number", "hash", "parent_hash")


def stored_suffix(s, d):
    """Blocks from a height on where a window holds the last half of them: the store's below it, whose files of other heights aren't read."""
    chain = _chain(s, d)
    window = _from(chain, 5).withColumn("hash", F.upper("hash"))
    return segments.suffix(s, _stored(s, d), window, 100)


_CHAIN = "SELECT key AS number, hash, md5('b' || (key - 1)) AS parent_hash, key * 10 >= (SELECT max(key) FROM blk) * {} AS late FROM blk"
REGISTERED = {
    "stored_chain": (stored_chain, f"SELECT number, CASE WHEN late THEN md5('r' || number) ELSE hash END AS hash, parent_hash FROM ({_CHAIN.format(9)})"),
    "stored_suffix": (stored_suffix, f"SELECT number, CASE WHEN late THEN upper(hash) ELSE hash END AS hash, parent_hash FROM ({_CHAIN.format(5)}) WHERE number >= 100"),
}
