"""Normalisation of raw bundles to one canonical record: projections over nested columns, in the order of the output's keys."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.functions.quantities import digits, hex_node_style, qty_digits, qty_safe, qty_u64, to_qty

from .frames import FRAME_TYPE, LEVELS, debug_traces, flatten, lists, low_frames
from .schema import BUNDLE

#: Header fields in output order, and how each is given.
HEADER = (
    ("number", "integer"),
    ("hash", "as it is"),
    ("parentHash", "as it is"),
    ("timestamp", "integer"),
    ("transactionsRoot", "as it is"),
    ("receiptsRoot", "as it is"),
    ("stateRoot", "as it is"),
    ("logsBloom", "as it is"),
    ("sha3Uncles", "as it is"),
    ("extraData", "as it is"),
    ("miner", "as it is"),
    ("nonce", "as it is"),
    ("mixHash", "as it is"),
    ("size", "integer"),
    ("gasLimit", "as it is"),
    ("gasUsed", "as it is"),
    ("difficulty", "as it is"),
    ("totalDifficulty", "as it is"),
    ("baseFeePerGas", "as it is"),
    ("uncles", "list"),
    ("withdrawals", "as it is"),
    ("withdrawalsRoot", "as it is"),
    ("blobGasUsed", "as it is"),
    ("excessBlobGas", "as it is"),
    ("parentBeaconBlockRoot", "as it is"),
    ("requestsHash", "as it is"),
    ("l1BlockNumber", "integer"),
    ("mainBlockGeneralGasLimit", "as it is"),
    ("sharedGasLimit", "as it is"),
    ("timestampMillisPart", "as it is"),
)


def parse_bundles(lines: DataFrame, column: str = "value", parts: tuple[str, ...] | None = None) -> DataFrame:
    """Raw JSON lines to bundles; unknown fields are ignored, malformed lines give a null ``number``.

    With ``parts``, only number, hash and these fields are read, the others are null; ``header`` is the block without its transactions.
    """
    fields = T.StructType.fromDDL(BUNDLE)
    if parts is None:
        return lines.select(F.from_json(column, fields, {"mode": "PERMISSIVE"}).alias("raw")).select("raw.*")
    block = fields["block"].dataType
    own = {f.name: f.dataType for f in fields if f.name in ("number", "hash", *parts)}
    if "header" in parts:
        own["block"] = T.StructType([f for f in block if f.name != "transactions"])
    raw = F.from_json(column, T.StructType([T.StructField(n, t) for n, t in own.items()]), {"mode": "PERMISSIVE"})
    shown = {f.name: F.col(f"raw.{f.name}") if f.name in own else F.lit(None).cast(f.dataType) for f in fields}
    if "header" in parts:
        shown["block"] = F.when(F.col("raw.block").isNotNull(), F.struct(*[(F.lit(None).cast(f.dataType) if f.name == "transactions" else F.col(f"raw.block.{f.name}")).alias(f.name) for f in block]))
    return lines.select(raw.alias("raw")).select(*[c.alias(n) for n, c in shown.items()])


def header(block: Column) -> Column:
    none = F.expr("cast(array() AS array<string>)")
    shown = {"integer": qty_u64, "list": lambda x: F.coalesce(x, none), "as it is": lambda x: x}
    return F.struct(*[shown[kind](block[name]).alias(name) for name, kind in HEADER])


def access_item(i: Column) -> Column:
    return F.struct(i["address"].alias("address"), F.coalesce(i["storageKeys"], i["storage_keys"], F.expr("cast(array() AS array<string>)")).alias("storageKeys"))


def authorization(a: Column, nonce: Column) -> Column:
    """Both shapes of a set-code authorization; the one with a nested signature counts its chain id in decimal."""
    sig = a["signature"]
    return F.struct(
        F.when(sig.isNotNull(), to_qty(a["chainId"].try_cast("long"))).otherwise(a["chainId"]).alias("chainId"),
        a["address"].alias("address"),
        nonce.alias("nonce"),
        F.when(sig.isNotNull(), sig["oddYParity"].cast("int").cast("decimal(20,0)")).otherwise(qty_u64(a["yParity"])).alias("yParity"),
        F.coalesce(sig["r"], a["r"]).alias("r"),
        F.coalesce(sig["s"], a["s"]).alias("s"),
    )


def _primitive(s: Column) -> Column:
    key = s["type"] != "secp256k1"
    return F.struct(
        s["type"].alias("type"), s["r"].alias("r"), s["s"].alias("s"), F.when(~key, qty_u64(s["yParity"])).alias("yParity"), F.when(~key, qty_u64(s["v"])).alias("v"),
        F.when(key, s["pubKeyX"]).alias("pubKeyX"), F.when(key, s["pubKeyY"]).alias("pubKeyY"),
        F.when(s["type"] == "p256", s["preHash"]).alias("preHash"), F.when(s["type"] == "webAuthn", s["webauthnData"]).alias("webauthnData"),
    )


def _signature(s: Column) -> Column:
    """A key chain's signature with its account, or a plain one: one struct, as nulls leave the output."""
    chain, own = s["userAddress"].isNotNull(), _primitive(s)
    plain = [F.when(~chain, own[n]).alias(n) for n in ("type", "r", "s", "yParity", "v", "pubKeyX", "pubKeyY", "preHash", "webauthnData")]
    wrapped = [F.lower(s["userAddress"]).alias("userAddress"), F.when(chain, _primitive(s["signature"])).alias("signature"), F.when(chain, s["version"]).alias("version")]
    return F.when(s.isNotNull(), F.struct(*plain, *wrapped))


def _each(a: Column, run) -> Column:
    return F.when(a.isNotNull(), F.transform(a, run))


def transaction(t: Column, r: Column, nonces: Column) -> Column:
    """A transaction with its receipt's fields. ``nonces``: the decimal nonces of its authorizations."""
    own = {
        "transactionIndex": qty_u64(t["transactionIndex"]), "hash": t["hash"], "nonce": qty_u64(t["nonce"]), "from": F.lower(t["from"]), "to": F.lower(t["to"]), "input": t["input"], "value": t["value"], "type": qty_u64(t["type"]),
        **{n: t[n] for n in ("gas", "gasPrice", "maxFeePerGas", "maxPriorityFeePerGas", "v", "r", "s")},
        "yParity": qty_u64(t["yParity"]), "accessList": _each(t["accessList"], access_item), "chainId": qty_safe(t["chainId"]),
        "maxFeePerBlobGas": t["maxFeePerBlobGas"], "blobVersionedHashes": t["blobVersionedHashes"],
        "authorizationList": F.when(t["authorizationList"].isNotNull(), F.transform(F.arrays_zip(t["authorizationList"].alias("a"), nonces.alias("n")), lambda z: authorization(z["a"], z["n"]))),
        "calls": _each(t["calls"], lambda c: F.struct(F.lower(c["to"]).alias("to"), c["value"].alias("value"), c["input"].alias("input"))),
        "nonceKey": t["nonceKey"], "signature": _signature(t["signature"]), "feeToken": F.lower(t["feeToken"]),
        "feePayerSignature": F.when(t["feePayerSignature"].isNotNull(), F.struct(qty_u64(t["feePayerSignature"]["v"]).alias("v"), t["feePayerSignature"]["r"].alias("r"), t["feePayerSignature"]["s"].alias("s"))),
        "validBefore": t["validBefore"], "validAfter": t["validAfter"],
        "aaAuthorizationList": _each(t["aaAuthorizationList"], lambda a: F.struct(a["chainId"].alias("chainId"), F.lower(a["address"]).alias("address"), qty_u64(a["nonce"]).alias("nonce"), _signature(a["signature"]).alias("signature"))),
        "keyAuthorization": F.when(
            t["keyAuthorization"].isNotNull(),
            F.struct(
                t["keyAuthorization"]["chainId"].alias("chainId"), t["keyAuthorization"]["keyType"].alias("keyType"), F.lower(t["keyAuthorization"]["keyId"]).alias("keyId"), t["keyAuthorization"]["expiry"].alias("expiry"),
                _each(t["keyAuthorization"]["limits"], lambda x: F.struct(F.lower(x["token"]).alias("token"), x["limit"].alias("limit"))).alias("limits"), _primitive(t["keyAuthorization"]["signature"]).alias("signature"),
            ),
        ),
    }
    paid = {
        "contractAddress": F.lower(r["contractAddress"]), **{n: r[n] for n in ("cumulativeGasUsed", "effectiveGasPrice", "gasUsed", "logsBloom")}, "status": qty_u64(r["status"]),
        "blobGasUsed": r["blobGasUsed"], "blobGasPrice": r["blobGasPrice"], "l1BaseFeeScalar": qty_u64(r["l1BaseFeeScalar"]), "l1BlobBaseFee": r["l1BlobBaseFee"], "l1BlobBaseFeeScalar": qty_u64(r["l1BlobBaseFeeScalar"]),
        "l1Fee": r["l1Fee"], "l1FeeScalar": r["l1FeeScalar"].try_cast("double"), "l1GasPrice": r["l1GasPrice"], "l1GasUsed": r["l1GasUsed"],
    }
    return F.struct(*[v.alias(k) for k, v in (own | paid).items()])


def log(x: Column) -> Column:
    return F.struct(qty_u64(x["logIndex"]).alias("logIndex"), qty_u64(x["transactionIndex"]).alias("transactionIndex"), x["transactionHash"].alias("transactionHash"), F.lower(x["address"]).alias("address"), x["data"].alias("data"), x["topics"].alias("topics"))


def trace(f: Column, tx: Column) -> Column:
    """A replayed frame, the fields of every kind in one struct, as nulls leave the output. Its reason is given only beside an error."""
    a, r = f["action"], f["result"]
    creates = a["init"].isNotNull()
    rewards = ~creates & a["author"].isNotNull()
    gone = ~creates & ~rewards & a["refundAddress"].isNotNull()
    call = ~creates & ~rewards & ~gone
    action = F.struct(
        F.when(rewards, F.lower(a["author"])).alias("author"), F.when(creates | call, F.lower(a["from"])).alias("from"), F.when(call, F.lower(a["to"])).alias("to"), F.when(~gone, a["value"]).alias("value"), F.when(creates | call, a["gas"]).alias("gas"),
        F.when(call, a["input"]).alias("input"), F.when(call, a["callType"]).alias("callType"), F.when(creates, a["init"]).alias("init"), F.when(creates, a["creationMethod"]).alias("creationMethod"), F.when(rewards, a["rewardType"]).alias("rewardType"),
        F.when(gone, F.lower(a["address"])).alias("address"), F.when(gone, F.lower(a["refundAddress"])).alias("refundAddress"), F.when(gone, a["balance"]).alias("balance"),
    )
    made = r["code"].isNotNull()
    result = F.when(r.isNotNull(), F.struct(r["gasUsed"].alias("gasUsed"), F.when(~made, r["output"]).alias("output"), F.when(made, r["code"]).alias("code"), F.when(made, F.lower(r["address"])).alias("address")))
    return F.struct(
        tx.alias("transactionIndex"), f["traceAddress"].alias("traceAddress"), F.when(f["type"] == "suicide", "selfdestruct").otherwise(f["type"]).alias("type"), f["subtraces"].alias("subtraces"), f["error"].alias("error"),
        f["reason"].alias("revertReason"), action.alias("action"), result.alias("result"),
    )


# -- state diffs ------------------------------------------------------------------------------------------------------

_ACCOUNT = "map<string, struct<balance: string, code: string, nonce: string, storage: map<string, string>>>"


def diff_row(tx: Column, address: Column, key: Column, prev: Column, then: Column) -> Column:
    kind = F.when(prev.isNull() & then.isNull(), "=").when(prev.isNull(), "+").when(then.isNull(), "-").otherwise("*")
    return F.struct(tx.cast("long").alias("transactionIndex"), F.lower(address).alias("address"), key.alias("key"), kind.alias("kind"), prev.alias("prev"), then.alias("next"))


def _once(value: Column, run) -> Column:
    """``run`` of a value that is worked out once: lambdas hold an expression as often as they name it."""
    return F.transform(F.array(value), run)[0]


def debug_diffs(result: Column, tx: Column) -> Column:
    """Diff rows of a pre/post state. Addresses and slots keep source order, those of pre first; code, balance and nonce
    only where post has them; a nonce that pre lacks counts as 0x0."""
    both = F.struct(*[F.coalesce(F.from_json(F.get_json_object(result, f"$.{k}"), _ACCOUNT), F.expr(f"cast(map() AS {_ACCOUNT})")).alias(k) for k in ("pre", "post")])
    none = F.expr("cast(array() AS array<string>)")

    def count(x: Column) -> Column:
        return F.when(x.rlike("^[0-9]+$"), to_qty(x.try_cast("long"))).otherwise(x)

    def rows(address: Column, x: Column) -> Column:
        a, b = x["a"], x["b"]
        slots = _once(F.struct(F.coalesce(F.map_keys(a["storage"]), none).alias("a"), F.coalesce(F.map_keys(b["storage"]), none).alias("b")), lambda s: F.concat(s["a"], F.array_except(s["b"], s["a"])))
        own = F.array(
            F.when(b["code"].isNotNull(), diff_row(tx, address, F.lit("code"), a["code"], b["code"])),
            F.when(b["balance"].isNotNull(), diff_row(tx, address, F.lit("balance"), a["balance"], b["balance"])),
            F.when(b["nonce"].isNotNull(), diff_row(tx, address, F.lit("nonce"), F.coalesce(count(a["nonce"]), F.lit("0x0")), count(b["nonce"]))),
        )
        return F.concat(F.array_compact(own), F.transform(slots, lambda k: diff_row(tx, address, k, F.try_element_at(a["storage"], k), F.try_element_at(b["storage"], k))))

    def accounts(s: Column) -> Column:
        addresses = F.array_distinct(F.concat(F.map_keys(s["pre"]), F.map_keys(s["post"])))
        return F.flatten(F.transform(addresses, lambda address: _once(F.struct(F.try_element_at(s["pre"], address).alias("a"), F.try_element_at(s["post"], address).alias("b")), lambda x: rows(address, x))))

    return _once(both, accounts)


def replay_diffs(diff: Column, tx: Column) -> Column:
    """Diff rows of a replay's state diff; unchanged and unreadable entries leave."""
    accounts = F.coalesce(F.from_json(diff, _ACCOUNT), F.expr(f"cast(map() AS {_ACCOUNT})"))

    def row(address: Column, key: Column, p: Column) -> Column:
        before, after = F.get_json_object(p["*"], "$.from"), F.get_json_object(p["*"], "$.to")
        changed = _once(F.struct(before.alias("before"), after.alias("after")), lambda c: F.when(c["before"].isNotNull() & c["after"].isNotNull(), diff_row(tx, address, key, c["before"], c["after"])))
        plain = F.when(p["-"].isNotNull(), diff_row(tx, address, key, p["-"], F.lit(None).cast("string")))
        return F.when(p["+"].isNotNull(), diff_row(tx, address, key, F.lit(None).cast("string"), p["+"])).otherwise(F.coalesce(changed, plain))

    def one(e: Column) -> Column:
        v = e["value"]
        own = F.array(*[F.struct(F.lit(k).alias("key"), v[k].alias("value")) for k in ("code", "balance", "nonce")])
        slots = F.coalesce(F.map_entries(v["storage"]), F.expr("cast(array() AS array<struct<key: string, value: string>>)"))
        # entries that say "=" hold no object and aren't parsed
        parts = F.filter(F.concat(own, slots), lambda s: s["value"].contains("{"))
        return F.array_compact(F.transform(parts, lambda s: _once(F.from_json(s["value"], "struct<`+`: string, `-`: string, `*`: string>"), lambda p: row(e["key"], s["key"], p))))

    return F.flatten(F.transform(F.map_entries(accounts), one))


# -- the record -------------------------------------------------------------------------------------------------------


def normalize(bundles: DataFrame, with_traces: bool = False, with_state_diffs: bool = False) -> DataFrame:
    """(number, hash, parent_number, parent_hash, timestamp, json_line) of parsed bundles: the texts of ``record_parts`` in one line.

    ``traces`` and ``stateDiffs`` are keys exactly where they are selected.
    """
    rows = record_parts(bundles, with_traces, with_state_diffs)
    parts = [F.concat(F.lit(f'"{name}":'), F.col(name)) for name in rows.columns if name in PARTS]
    line = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}\n"))
    return rows.select(*[c for c in rows.columns if c not in PARTS], line.alias("json_line"))


#: The keys of a record.
PARTS = ("header", "transactions", "logs", "traces", "stateDiffs")


def record_parts(bundles: DataFrame, with_traces: bool = False, with_state_diffs: bool = False) -> DataFrame:
    """(number, hash, parent_number, parent_hash, timestamp) of parsed bundles, and the JSON text of each part of their records, so that
    a reader of one part has no other made.

    Receipts join transactions by position. A bundle's own logs win over its receipts'; debug frames over replayed traces; debug
    state diffs over replayed ones.
    """
    txs = F.coalesce("block.transactions", F.array())
    zipped = F.transform(txs, lambda t, i: F.struct(t.alias("t"), F.get("receipts", i).alias("r")))

    def nonces(t: Column) -> Column:
        return F.transform(F.coalesce(t["authorizationList"], F.array()), lambda a: qty_digits(a["nonce"]))

    logs = F.coalesce(F.col("logs"), F.flatten(F.transform(F.coalesce("receipts", F.array()), lambda r: F.coalesce(r["logs"], F.array()))))
    parts = [F.to_json(header(F.col("block"))).alias("header"), F.to_json(F.transform(zipped, lambda z: transaction(z["t"], z["r"], nonces(z["t"])))).alias("transactions"), F.to_json(F.transform(logs, log)).alias("logs")]
    hashes = F.transform(txs, lambda t: t["hash"])
    index = F.when(F.col("traceReplays").isNotNull(), F.map_from_entries(F.transform(F.reverse(F.array_distinct(hashes)), lambda h: F.struct(h, F.array_position(hashes, h) - 1))))
    rows = bundles.withColumn("_index", index)
    if with_traces:
        deep = F.exists("debugFrames", lambda e: F.coalesce(lists(e["result"]), F.lit(0)) >= LEVELS)
        low = F.transform("debugFrames", lambda e: F.when(e["result"].isNotNull(), low_frames(e["result"])))
        rows = rows.withColumn("_deep", deep).withColumn("_trees", F.when(F.col("_deep"), trees(F.when(F.col("_deep"), F.to_json(F.transform("debugFrames", lambda e: e["result"]))))).otherwise(low)).withColumn("_reasons", reasons(F.col("traceReplays")))
        debug = F.flatten(F.array_compact(F.transform("_trees", lambda f, i: F.when(f.isNotNull(), debug_traces(f, i)))))
        known = F.filter(F.coalesce("_reasons", F.array()), lambda p: F.try_element_at("_index", p["hash"]).isNotNull())
        replayed = F.flatten(F.transform(known, lambda p: F.transform(p["trace"], lambda f: trace(f, F.try_element_at("_index", p["hash"])))))
        parts.append(F.when(F.col("debugFrames").isNotNull(), F.to_json(debug)).otherwise(F.to_json(replayed)).alias("traces"))
    if with_state_diffs:
        rows_type = "array<struct<transactionIndex: bigint, address: string, key: string, kind: string, prev: string, next: string>>"
        debug = F.flatten(F.transform("debugStateDiffs", lambda d, i: F.when(d.isNull(), F.expr(f"cast(array() AS {rows_type})")).otherwise(debug_diffs(d["result"], i))))
        replayed = F.flatten(F.transform(F.filter(F.coalesce("traceReplays", F.array()), lambda p: F.try_element_at("_index", p["transactionHash"]).isNotNull() & p["stateDiff"].isNotNull()), lambda p: replay_diffs(p["stateDiff"], F.try_element_at("_index", p["transactionHash"]))))
        parts.append(F.to_json(F.when(F.col("debugStateDiffs").isNotNull(), debug).otherwise(replayed)).alias("stateDiffs"))
    number = qty_u64(F.col("block.number")).cast("long")
    return rows.select(number.alias("number"), F.col("block.hash").alias("hash"), F.greatest(number - 1, F.lit(0)).alias("parent_number"), F.col("block.parentHash").alias("parent_hash"), (qty_u64(F.col("block.timestamp")).cast("long") * 1000).alias("timestamp"), *parts)


def reasons(replays: Column) -> Column:
    """Replays as (hash, trace), each frame with its revert reason."""

    def with_reason(f: Column) -> Column:
        call = f["result"].isNotNull() & f["result"]["code"].isNull()
        reason = F.when((F.coalesce(f["error"], F.lit("")) != "") & call, plain_reason(f["result"]["output"]))
        return F.struct(*[f[n].alias(n) for n in ("type", "error", "traceAddress", "subtraces", "action", "result")], reason.alias("reason"))

    return F.transform(replays, lambda p: F.struct(p["transactionHash"].alias("hash"), F.transform(F.coalesce(p["trace"], F.array()), with_reason).alias("trace")))


def plain_reason(output: Column) -> Column:
    """``revert_reason`` with built-in functions alone, for use within arrays."""
    raw = hex_node_style(F.substring(digits(output), 135, 1 << 30))
    size = F.when(F.octet_length(raw) > 0, F.conv(F.hex(F.substring(raw, 1, 1)), 16, 10).cast("int")).otherwise(0)
    return F.make_valid_utf8(F.substring(raw, F.lit(2), size).cast("string"))


@F.pandas_udf(T.ArrayType(T.ArrayType(FRAME_TYPE)))
def trees(column: pd.Series) -> pd.Series:
    """A JSON list of call trees' texts to their flattened frames; a null entry stays null. Text, as Arrow lists are walked anew for each row of a batch."""

    def one(tree):
        return None if tree is None else [dict(zip(FRAME_TYPE.names, r, strict=True)) for r in flatten(json.loads(tree))]

    return column.map(lambda texts: None if texts is None else [one(t) for t in json.loads(texts)])
