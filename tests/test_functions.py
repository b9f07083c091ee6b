import hashlib
import json

import pytest
from pyspark.sql import functions as F

from blockloom.functions import commitments as c
from blockloom.functions import quantities as q
from blockloom.functions import rlp, secp256k1, wire
from blockloom.functions.keccak import keccak256, keccak256_many
from blockloom.functions.networks import Network

EIP155 = {
    "nonce": "0x9", "gasPrice": "0x4a817c800", "gas": "0x5208", "to": "0x" + "35" * 20, "value": "0xde0b6b3a7640000", "input": "0x", "chainId": "0x1", "v": "0x25",
    "r": "0x28ef61340bd939bc2195fe537567866003e1a15d3c71ff63e1590620aa636276", "s": "0x67cbe9d8997f761aecb703304b3800ccf555c9f3dc64214b297fb1966a3b6d83",
}


def test_keccak_vectors():
    assert keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keccak256(b"abc").hex() == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"
    messages = [bytes([n % 251]) * n for n in (0, 1, 135, 136, 137, 271, 272, 1000)]
    assert keccak256_many(messages) == [keccak256(m) for m in messages]
    assert keccak256(b"abc") != hashlib.sha3_256(b"abc").digest()


def test_rlp_and_roots():
    assert rlp.encode([b"cat", b"dog"]).hex() == "c88363617483646f67"
    assert rlp.encode(0) == b"\x80" and rlp.encode(1024).hex() == "820400" and rlp.encode(b"x" * 56)[:2].hex() == "b838"
    assert rlp.EMPTY_ROOT.hex() == "56e81f171bcc55a6ff8345e692c0f86e5b48e01b996cadc001622fb5e363b421"
    assert c.withdrawals_root([]) == "0x" + rlp.EMPTY_ROOT.hex()
    roots = {rlp.ordered_root([bytes([i % 251]) * 40 for i in range(n)]) for n in range(1, 300, 37)}
    assert len(roots) == len(range(1, 300, 37))


def test_eip155_sender():
    assert keccak256(wire.signing_payload(EIP155)).hex() == "daf5a779ae972f972197303d7b574746c7ef83eadac0f2791ad23db92e4c8e53"
    assert c.sender(EIP155) == "0x9d8a62f656a8d1615c1294fd71e9cfb3e4855a4f"
    assert c.sender(EIP155 | {"value": "0x1"}) != "0x9d8a62f656a8d1615c1294fd71e9cfb3e4855a4f"


@pytest.mark.parametrize("kind", ["0x1", "0x2", "0x3", "0x4", "0x3f", "0x76"])
def test_signed_types_give_their_sender(kind):
    secret = 0xC0FFEE
    x, y = secp256k1.multiply_sum(secret, secp256k1.G, 0, secp256k1.G)
    who = secp256k1.address(x.to_bytes(32) + y.to_bytes(32))
    tx = EIP155 | {
        "type": kind, "maxPriorityFeePerGas": "0x1", "maxFeePerGas": "0x2", "maxFeePerBlobGas": "0x3", "blobVersionedHashes": ["0x" + "01" * 32], "nonceKey": "0x0",
        "accessList": [{"address": "0x" + "11" * 20, "storageKeys": ["0x" + "22" * 32]}], "calls": [{"to": None, "value": "0x1", "input": "0x"}],
        "authorizationList": [{"chainId": "0x1", "address": "0x" + "33" * 20, "nonce": "0x1", "yParity": "0x0", "r": "0x1", "s": "0x2"}],
    }
    r, s, odd = secp256k1.sign(keccak256(wire.signing_payload(tx)), secret, 77777)
    tx |= {"r": hex(r), "s": hex(s), "yParity": hex(odd), "signature": {"type": "secp256k1", "r": hex(r), "s": hex(s), "yParity": hex(odd)}}
    assert c.sender(tx) == who
    assert wire.encode_transaction(tx)[0] == int(kind, 16)


def test_header_issue_names_the_first_broken_commitment():
    block = {n: "0x" + "00" * 32 for n in ("parentHash", "sha3Uncles", "stateRoot", "receiptsRoot", "mixHash")}
    block |= {"number": "0x1", "gasLimit": "0x1", "gasUsed": "0x0", "timestamp": "0x1", "difficulty": "0x0", "extraData": "0x", "miner": "0x" + "00" * 20, "nonce": "0x" + "00" * 8, "logsBloom": "0x" + "00" * 256}
    tx = EIP155 | {"hash": "0xT", "from": "0x9d8a62f656a8d1615c1294fd71e9cfb3e4855a4f"}
    block |= {"transactions": [tx], "transactionsRoot": c.transactions_root([tx])}
    block["hash"] = c.block_hash(block)
    assert c.header_issue(block, 1) is None
    assert c.header_issue(block | {"hash": "0x00"}, 1) == "block hash mismatch"
    assert c.header_issue(block | {"transactions": []}, 1) == "transactions root mismatch"
    assert c.header_issue(block | {"withdrawals": []}, 1) == "withdrawals and their root don't come together"
    forged = block | {"transactions": [tx | {"from": "0x" + "01" * 20}]}
    assert c.header_issue(forged, 1).startswith("sender mismatch")
    assert c.header_issue(forged, 1, frozenset({"hash"})) is None


def _with_receipts():
    logs = [{"address": "0x" + "aa" * 20, "topics": ["0x" + "bb" * 32], "data": "0x01", "transactionHash": "0xT"}]
    receipt = {"transactionHash": "0xT", "type": "0x0", "status": "0x1", "gasUsed": "0x5208", "cumulativeGasUsed": "0x5208", "logsBloom": c.logs_bloom(logs), "logs": logs}
    block = {"transactions": [{"hash": "0xT"}], "receiptsRoot": c.receipts_root([receipt]), "logsBloom": receipt["logsBloom"]}
    return block, receipt


def test_receipts_are_held_against_the_header():
    block, receipt = _with_receipts()
    only = frozenset({"receipts"})
    assert c.header_issue(block, 1, only, [receipt]) is None and c.header_issue(block, 1, only) is None
    assert c.header_issue(block, 1, only, [receipt | {"status": "0x0"}]) == "receipts root mismatch"
    assert c.header_issue(block, 1, only, []) == "receipts root mismatch"
    assert c.header_issue(block | {"logsBloom": "0x" + "00" * 256}, 1, only, [receipt]) == "logs bloom mismatch"
    assert c.header_issue(block, 1, only, [{"transactionHash": "0xT"}]).startswith("not verifiable")
    own = {**block, "receiptsRoot": c.receipts_root([receipt], by_gas_used=True)}
    assert c.header_issue(own, 1, only, [receipt | {"cumulativeGasUsed": "0x1"}], by_gas_used=True) is None


def test_receipts_of_tables(spark):
    import json

    block, receipt = _with_receipts()
    rows = [(1, json.dumps(block), json.dumps([receipt]), 1), (2, json.dumps(block), json.dumps([receipt | {"gasUsed": "0x1", "status": "0x0"}]), 1), (3, json.dumps(block), None, 1)]
    got = c.with_header_issue(spark.createDataFrame(rows, "n int, block_json string, r string, chain_id int"), checks=frozenset(), receipts_json="r")
    assert {r.n: r.header_issue for r in got.collect()} == {1: None, 2: "receipts root mismatch", 3: None}


def test_option_validation():
    from blockloom.operators.coherence import validate_options

    assert validate_options({}) == [] and len(validate_options({"call_frames": "loud"})) == 1
    assert validate_options({"call_frames": "reject", "verify_tx_root": True, "verify_sender": True}) == [] and len(validate_options({"call_frames": "reject", "verify_tx_root": True})) == 1
    assert len(validate_options({"gas_used_receipts": True})) == 1 and len(validate_options({"verify_receipts_root": True})) == 1
    assert validate_options({"verify_receipts_root": True, "with_receipts": True, "gas_used_receipts": True}) == []


def test_networks_exempt():
    assert Network(999).unsigned({"gasPrice": "0x0"}) and not Network(1).unsigned({"gasPrice": "0x0"})
    assert Network(988).unsigned({"r": "0x0", "s": "0x0", "type": "0x2"}) and not Network(4217).unsigned({"r": "0x0", "s": "0x0", "type": "0x2"})
    block = {"number": "0x10", "hash": "0x" + "ab" * 32, "transactions": []}
    block["transactions"] = [{"hash": c.state_sync_hash(block["number"], block["hash"])}, {"hash": "0x1"}]
    assert [t["hash"] for t in Network(137).committed_txs(block)] == ["0x1"] and len(Network(1).committed_txs(block)) == 2


def test_receipt_forms():
    base = {"cumulativeGasUsed": "0x5", "gasUsed": "0x5", "logsBloom": "0x", "logs": []}
    assert wire.encode_receipt(base | {"root": "0x" + "01" * 32})[0] >= 0xC0
    assert wire.encode_receipt(base | {"status": "0x1", "type": "0x2"})[0] == 2
    with pytest.raises(wire.Missing):
        wire.encode_receipt(base | {"type": "0x2"})
    with pytest.raises(wire.Missing):
        wire.encode_receipt(base | {"status": "0x1", "type": "0x7e"})


def test_quantity_expressions(spark):
    rows = [("0x1f",), ("1F",), ("0x",), ("0xzz",), ("0xffffffffffffffff",), ("0x10000000000000000",), (None,), ("0x20000000000000",)]
    got = spark.createDataFrame(rows, "x string").select("x", q.qty_u64("x").cast("string").alias("u"), q.qty_safe("x").alias("s"), q.qty_u128("x").alias("w"), F.hex(q.hex_strict("x")).alias("h")).collect()
    assert [r.u for r in got] == ["31", "31", "0", "0", "18446744073709551615", "0", None, "9007199254740992"]
    assert [r.s for r in got] == [31, 31, None, None, None, None, None, None]
    assert got[5].w == "18446744073709551616" and got[3].w == "0" and got[6].w is None
    assert [r.h for r in got][:4] == ["1F", "1F", "", None]


def test_revert_reason(spark):
    tail = {"0x" + "0" * 134 + "03616263": "abc", "0x" + "0" * 134 + "05616263": "abc", "0x" + "0" * 134: "", "0x12": "", "0x" + "0" * 134 + "0161zz": "a"}
    got = spark.createDataFrame([(k,) for k in tail], "x string").select("x", q.revert_reason("x").alias("r")).collect()
    assert {r.x: r.r for r in got} == tail


def test_bloom_aggregate_equals_the_function(spark):
    logs = [{"address": "0x" + f"{i:02x}" * 20, "topics": ["0x" + f"{i * 7 % 256:02x}" * 32]} for i in range(30)]
    df = spark.createDataFrame([("b", x["address"], x["topics"]) for x in logs], "block_hash string, address string, topics array<string>")
    bloom = c.bloom_of_logs(df).first().logs_bloom
    assert bloom == c.logs_bloom(logs)
    one = c.logs_bloom(logs[:1])
    got = spark.createDataFrame([(bytes.fromhex(bloom[2:]), bytes.fromhex(one[2:]))], "a binary, b binary").select(q.bloom_superset("a", "b").alias("x"), q.bloom_superset("b", "a").alias("y")).first()
    assert got.x and not got.y


def test_bloom_aggregate_shuffles_bits_once(spark):
    df = spark.createDataFrame([(f"b{i}", "0x" + f"{i:02x}" * 20, ["0x" + "07" * 32]) for i in range(9)], "block_hash string, address string, topics array<string>")
    blooms = c.bloom_of_logs(df)
    plan = blooms._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("bit_or") == 0
    assert {r.block_hash: r.logs_bloom for r in blooms.collect()} == {r.block_hash: c.logs_bloom([{"address": r.address, "topics": r.topics}]) for r in df.collect()}


def test_header_hashes_in_batches(spark):
    block = {n: "0x" + "00" * 32 for n in ("parentHash", "sha3Uncles", "stateRoot", "receiptsRoot", "mixHash", "transactionsRoot")}
    block |= {"number": "0x1", "gasLimit": "0x1", "gasUsed": "0x0", "timestamp": "0x1", "difficulty": "0x0", "extraData": "0x", "miner": "0x" + "00" * 20, "nonce": "0x" + "00" * 8, "logsBloom": "0x"}
    rows = [block | {"number": hex(i)} for i in range(5)]
    df = spark.createDataFrame([(json.dumps(b),) for b in rows], "j string")
    assert [r[0] for r in df.select(c.block_hash_udf("j")).collect()] == [c.block_hash(b) for b in rows]


def test_sketches_merge_within_their_error(spark):
    from blockloom.plans import metrics as me

    rows = spark.range(200_000).selectExpr("cast(pow(id, 1.5) AS double) AS v", "id % 37 AS day", "id % 2 AS side").unionAll(spark.createDataFrame([(None, 99, 0)], "v double, day long, side long"))
    got = {r.side: r for r in me.sketch_summary(me.sketched(rows, "v", ["side", "day"]), ["side"]).collect()}
    for side in (0, 1):
        r = got[side]
        assert (r.n, r.least) == (100_000, float(side)) and abs(r.most - (199_998 + side) ** 1.5) < 1e-3
        for q, rank in ((r.median, 0.5), (r.p90, 0.9)):
            assert abs(q ** (2 / 3) / 200_000 - rank) < me.RANK_ERROR
    assert me.sketch_summary(me.sketched(rows.filter("false"), "v", ["side"]), ["side"]).count() == 0
