"""Commitments of a block: hashes, roots, bloom filter, senders, and the check of a header against them.

Plain functions over parsed JSON, and Arrow UDFs over JSON columns for DataFrames. Whole batches share one vectorised hash call
where the messages don't depend on each other (header hashes, bloom items).
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rlp, secp256k1, wire
from .keccak import keccak256, keccak256_many


def _hex(x: bytes) -> str:
    return "0x" + x.hex()


def block_hash(block: dict) -> str:
    return _hex(keccak256(rlp.encode(wire.header_fields(block))))


def tempo_block_hash(block: dict) -> str:
    """Hash of a header that wraps the common one behind two gas limits and a fraction of its time."""
    outer = [wire.lenient(wire._need(block, k)) for k in ("mainBlockGeneralGasLimit", "sharedGasLimit", "timestampMillisPart")]
    return _hex(keccak256(rlp.encode([*outer, wire.header_fields(block)])))


def transactions_root(txs: list[dict]) -> str:
    return _hex(rlp.ordered_root([wire.encode_transaction(t) for t in txs]))


def receipts_root(receipts: list[dict], by_gas_used: bool = False) -> str:
    return _hex(rlp.ordered_root([wire.encode_receipt(r, by_gas_used) for r in receipts]))


def withdrawals_root(withdrawals: list[dict]) -> str:
    return _hex(rlp.ordered_root([wire.encode_withdrawal(w) for w in withdrawals]))


def bloom_bits(digest: bytes) -> list[int]:
    return [int.from_bytes(digest[i : i + 2]) & 2047 for i in (0, 2, 4)]


def logs_bloom(logs: list[dict]) -> str:
    """The 2048-bit filter over the addresses and topics of logs."""
    items = {wire.bytes_or_none(x) for log in logs for x in (log["address"], *log["topics"])}
    out = 0
    for digest in keccak256_many(list(items)):
        for bit in bloom_bits(digest):
            out |= 1 << bit
    return _hex(out.to_bytes(256))


def state_sync_hash(number: str, block_hash_: str) -> str:
    return _hex(keccak256(b"matic-bor-receipt-" + (wire.lenient(number) & (2**64 - 1)).to_bytes(8) + wire.bytes_or_none(block_hash_)))


def sender(tx: dict) -> str | None:
    """The address that signed; None for types that carry no signature of a known form."""
    payload = wire.signing_payload(tx)
    if payload is None:
        return None
    digest = keccak256(payload)
    if tx.get("type") == "0x76":
        sig = wire._need(tx, "signature")
        if "userAddress" in sig:
            return _hex(wire._sized(sig["userAddress"], 20))
        if sig["type"] != "secp256k1":  # the key itself is in the signature
            return secp256k1.address(wire._sized(sig["pubKeyX"], 32) + wire._sized(sig["pubKeyY"], 32))
        raw = wire._tempo_primitive(sig)
        r, s, odd = int.from_bytes(raw[:32]), int.from_bytes(raw[32:64]), raw[64] - 27
    else:
        r, s, odd = wire.integer(wire._need(tx, "r")), wire.integer(wire._need(tx, "s")), wire.recovery_bit(tx)
    key = secp256k1.recover(digest, r, s, odd)
    if key is None:
        raise ValueError("the signature can't be recovered")
    return secp256k1.address(key)


def header_issue(block: dict, chain_id: int, checks: frozenset[str] = frozenset(("hash", "transactions", "senders", "withdrawals")), receipts: list[dict] | None = None, by_gas_used: bool = False) -> str | None:
    """The first commitment that a block breaks, or None. Comparison ignores case.

    With receipts and the check ``receipts``, their root and the filter over their logs are held against the header too, without
    those that the network doesn't commit to. ``by_gas_used``: the root is over each receipt's own gas.
    """
    from .networks import TEMPO_HEADER, Network

    net = Network(chain_id)
    try:
        if "hash" in checks:
            got = (tempo_block_hash if net.has(TEMPO_HEADER) else block_hash)(block)
            if got.lower() != block["hash"].lower():
                return "block hash mismatch"
        if "transactions" in checks and not any(net.unencodable(t) for t in block["transactions"]):
            if transactions_root(net.committed_txs(block)).lower() != block["transactionsRoot"].lower():
                return "transactions root mismatch"
        if "senders" in checks:
            for t in block["transactions"]:
                if not net.unsigned(t):
                    got = sender(t)
                    if got is not None and got.lower() != t["from"].lower():
                        return f"sender mismatch in {t['hash']}"
        if "withdrawals" in checks:
            has_list, has_root = block.get("withdrawals") is not None, block.get("withdrawalsRoot") is not None
            if has_list != has_root:
                return "withdrawals and their root don't come together"
            if has_list and withdrawals_root(block["withdrawals"]).lower() != block["withdrawalsRoot"].lower():
                return "withdrawals root mismatch"
        if "receipts" in checks and receipts is not None:
            own = net.committed_receipts(block, receipts)
            if receipts_root(own, by_gas_used).lower() != block["receiptsRoot"].lower():
                return "receipts root mismatch"
            logs = net.committed_logs(block, [x for r in own for x in r["logs"]])
            if logs_bloom(logs).lower() != block["logsBloom"].lower():
                return "logs bloom mismatch"
    except (ValueError, KeyError) as e:
        return f"not verifiable: {e}"
    return None


def _json_udf(kind: T.DataType, run):
    @F.pandas_udf(kind)
    def one(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else run(json.loads(x)))

    return one


@F.pandas_udf(T.StringType())
def block_hash_udf(column: pd.Series) -> pd.Series:
    """Header hashes of a batch of blocks, hashed at once."""
    held = column.notna()
    out = pd.Series([None] * len(column), dtype=object, index=column.index)
    out[held] = [_hex(h) for h in keccak256_many([rlp.encode(wire.header_fields(json.loads(x))) for x in column[held]])]
    return out


transactions_root_udf = _json_udf(T.StringType(), transactions_root)
receipts_root_udf = _json_udf(T.StringType(), receipts_root)
withdrawals_root_udf = _json_udf(T.StringType(), withdrawals_root)
logs_bloom_udf = _json_udf(T.StringType(), logs_bloom)
sender_udf = _json_udf(T.StringType(), sender)


@F.pandas_udf(T.BinaryType())
def keccak_udf(column: pd.Series) -> pd.Series:
    """The hash of each binary value; a batch is hashed at once."""
    held = column.notna()
    out = pd.Series([None] * len(column), dtype=object, index=column.index)
    out[held] = keccak256_many([bytes(x) for x in column[held]])
    return out


@F.pandas_udf(T.StringType())
def state_sync_udf(number: pd.Series, hash_: pd.Series) -> pd.Series:
    return pd.Series([state_sync_hash(n, h) for n, h in zip(number, hash_, strict=True)])


def with_header_issue(blocks: DataFrame, block_json: str = "block_json", chain_id: str = "chain_id", checks: frozenset[str] | None = None, receipts_json: str | None = None) -> DataFrame:
    """``blocks`` with ``header_issue``: each block's first broken commitment; ``receipts_json``: a column with its receipts, to be checked too."""
    wanted = checks if checks is not None else frozenset(("hash", "transactions", "senders", "withdrawals"))

    @F.pandas_udf(T.StringType())
    def issue(block: pd.Series, chain: pd.Series, receipts: pd.Series) -> pd.Series:
        return pd.Series([header_issue(json.loads(b), int(c), wanted, json.loads(r) if r is not None else None) for b, c, r in zip(block, chain, receipts, strict=True)])

    if receipts_json is not None:
        wanted |= {"receipts"}
    own = F.col(receipts_json) if receipts_json is not None else F.lit(None).cast("string")
    return blocks.withColumn("header_issue", issue(F.col(block_json), F.col(chain_id), own))


def bloom_of_logs(logs: DataFrame, key: str = "block_hash", address: str = "address", topics: str = "topics") -> DataFrame:
    """(key, logs_bloom): the filter of each block's logs, as an aggregate of single bits.

    Items are hashed where they are, and each block's set of bits, at most 2048, is gathered partially before the one shuffle, so no
    block's logs gather in a task and the shuffle carries bits alone.
    """
    from .quantities import hex_or_empty

    items = logs.select(key, F.explode(F.concat(F.array(address), F.col(topics))).alias("item"))
    digest = items.select(key, F.hex(keccak_udf(hex_or_empty("item"))).alias("d"))
    bits = digest.select(key, F.explode(F.array(*[F.conv(F.substring("d", 1 + 4 * i, 4), 16, 10).cast("int").bitwiseAND(2047) for i in range(3)])).alias("bit"))
    powers = F.array(*[F.lit(1 << i).cast("long") for i in range(32)])
    held = bits.groupBy(key).agg(F.collect_set("bit").alias("bits"))
    words = F.transform(F.sequence(F.lit(63), F.lit(0)), lambda w: F.aggregate(F.filter("bits", lambda b: F.shiftright(b, 5) == w), F.lit(0).cast("long"), lambda n, b: n + F.element_at(powers, b.bitwiseAND(31) + 1)))
    return held.select(key, F.concat(F.lit("0x"), F.array_join(F.transform(words, lambda n: F.lpad(F.lower(F.hex(n)), 8, "0")), "")).alias("logs_bloom"))
