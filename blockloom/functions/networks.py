"""Deviations of networks from the common rules, and what they exempt."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .commitments import state_sync_hash

STATE_SYNC, ZERO_GAS, FAKE_SIGNATURE, LEGACY_FAKE_SIGNATURE, TEMPO_HEADER, LOG_INDEXES, TRACE_GAPS = (
    "state_sync_tx", "zero_gas_system_tx", "fake_signature_system_tx", "legacy_fake_signature_system_tx", "tempo_header", "non_sequential_log_indexes", "partial_trace_coverage",
)
#: chain id -> (deviations, transaction types that have no known wire form): fixed values.
NETWORKS: dict[int, tuple[tuple[str, ...], tuple[str, ...]]] = {
    109: ((STATE_SYNC, TRACE_GAPS), ("0x7f",)),
    137: ((STATE_SYNC, TRACE_GAPS), ("0x7f",)),
    988: ((FAKE_SIGNATURE, LOG_INDEXES), ()),
    998: ((ZERO_GAS,), ()),
    999: ((ZERO_GAS,), ()),
    2201: ((FAKE_SIGNATURE, LOG_INDEXES), ()),
    4217: ((TEMPO_HEADER, LEGACY_FAKE_SIGNATURE), ()),
    42161: ((), ("0x66", "0x68", "0x69")),
    42429: ((TEMPO_HEADER, LEGACY_FAKE_SIGNATURE), ()),
    42431: ((TEMPO_HEADER, LEGACY_FAKE_SIGNATURE), ()),
    80002: ((STATE_SYNC, TRACE_GAPS), ("0x7f",)),
}


def network_table(spark: SparkSession) -> DataFrame:
    """The registry as a table (chain_id, quirks, unencodable), a row for each known network: small enough to broadcast."""
    return spark.createDataFrame([(c, list(q), list(u)) for c, (q, u) in NETWORKS.items()], "chain_id long, quirks array<string>, unencodable array<string>")


@dataclass(frozen=True)
class Network:
    chain_id: int

    def has(self, quirk: str) -> bool:
        return quirk in NETWORKS.get(self.chain_id, ((), ()))[0]

    def unencodable(self, tx: dict) -> bool:
        return tx.get("type") in NETWORKS.get(self.chain_id, ((), ()))[1]

    def phantom(self, block: dict) -> str | None:
        """Hash of the transaction that the network adds outside the block's commitments."""
        return state_sync_hash(block["number"], block["hash"]) if self.has(STATE_SYNC) else None

    def committed_txs(self, block: dict) -> list[dict]:
        phantom = self.phantom(block)
        return [t for t in block["transactions"] if t["hash"] != phantom and not (self.has(ZERO_GAS) and t.get("gasPrice") == "0x0")]

    def committed_receipts(self, block: dict, receipts: list[dict]) -> list[dict]:
        phantom = self.phantom(block)
        return [r for r in receipts if r["transactionHash"] != phantom and not (self.has(ZERO_GAS) and r["cumulativeGasUsed"] == "0x0")]

    def committed_logs(self, block: dict, logs: list[dict]) -> list[dict]:
        kept = {t["hash"] for t in self.committed_txs(block)}
        out = {t["hash"] for t in block["transactions"]} - kept
        return [x for x in logs if x["transactionHash"] not in out]

    def unsigned(self, tx: dict) -> bool:
        """Whether a transaction carries no signature that could be recovered."""
        fake = tx.get("r") == "0x0" and tx.get("s") == "0x0"
        return (self.has(ZERO_GAS) and tx.get("gasPrice") == "0x0") or (fake and (self.has(FAKE_SIGNATURE) or (self.has(LEGACY_FAKE_SIGNATURE) and tx.get("type") == "0x0")))
