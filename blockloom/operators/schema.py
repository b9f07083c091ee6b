"""Schemas of raw block bundles. Quantities and bytes are hex strings; fields that a source leaves out are null."""

from __future__ import annotations


def _strings(*names: str) -> list[str]:
    return [f"`{n}` string" for n in names]


def _struct(*fields: str) -> str:
    return f"struct<{', '.join(f.replace(' ', ': ', 1) for f in fields)}>"


#: Fixed values from here on: the field names of the published JSON forms.
LOG = _struct(*_strings("address", "blockHash", "blockNumber", "transactionHash", "transactionIndex", "logIndex", "data"), "`topics` array<string>")
PRIMITIVE = _strings("type", "r", "s", "yParity", "v", "pubKeyX", "pubKeyY", "webauthnData") + ["`preHash` boolean"]
SIGNATURE = _struct(*PRIMITIVE, *_strings("userAddress", "version"), f"`signature` {_struct(*PRIMITIVE)}")
TRANSACTION = _struct(
    *_strings("transactionIndex", "hash", "blockHash", "blockNumber", "nonce", "from", "to", "input", "value", "type", "gas", "gasPrice", "maxFeePerGas", "maxPriorityFeePerGas", "v", "r", "s", "yParity", "chainId", "maxFeePerBlobGas", "nonceKey", "feeToken", "validBefore", "validAfter", "sourceHash", "mint", "requestId", "timeoutTimestamp"),
    f"`accessList` array<{_struct('`address` string', '`storageKeys` array<string>', '`storage_keys` array<string>')}>",
    "`blobVersionedHashes` array<string>",
    f"`authorizationList` array<{_struct(*_strings('chainId', 'address', 'nonce', 'yParity', 'r', 's'), '`signature` ' + _struct('`r` string', '`s` string', '`oddYParity` boolean'))}>",
    f"`calls` array<{_struct(*_strings('to', 'value', 'input'))}>",
    f"`signature` {SIGNATURE}",
    f"`feePayerSignature` {_struct(*_strings('v', 'r', 's'))}",
    f"`aaAuthorizationList` array<{_struct(*_strings('chainId', 'address', 'nonce'), '`signature` ' + SIGNATURE)}>",
    f"`keyAuthorization` {_struct(*_strings('chainId', 'keyType', 'keyId', 'expiry'), '`limits` array<' + _struct(*_strings('token', 'limit')) + '>', '`signature` ' + _struct(*PRIMITIVE))}",
)
RECEIPT = _struct(
    *_strings("transactionHash", "transactionIndex", "blockHash", "blockNumber", "type", "status", "root", "contractAddress", "cumulativeGasUsed", "effectiveGasPrice", "gasUsed", "logsBloom", "blobGasUsed", "blobGasPrice", "l1BaseFeeScalar", "l1BlobBaseFee", "l1BlobBaseFeeScalar", "l1Fee", "l1FeeScalar", "l1GasPrice", "l1GasUsed", "depositNonce", "depositReceiptVersion"),
    f"`logs` array<{LOG}>",
)
BLOCK = _struct(
    *_strings("number", "hash", "parentHash", "difficulty", "totalDifficulty", "excessBlobGas", "extraData", "gasLimit", "gasUsed", "sha3Uncles", "logsBloom", "transactionsRoot", "receiptsRoot", "stateRoot", "miner", "mixHash", "nonce", "baseFeePerGas", "blobGasUsed", "parentBeaconBlockRoot", "size", "timestamp", "withdrawalsRoot", "requestsHash", "l1BlockNumber", "mainBlockGeneralGasLimit", "sharedGasLimit", "timestampMillisPart"),
    f"`transactions` array<{TRANSACTION}>",
    "`uncles` array<string>",
    f"`withdrawals` array<{_struct(*_strings('index', 'validatorIndex', 'address', 'amount'))}>",
)
TRACE = _struct(
    *_strings("type", "error", "transactionHash", "blockHash"),
    "`traceAddress` array<bigint>",
    "`subtraces` bigint",
    f"`action` {_struct(*_strings('from', 'to', 'value', 'gas', 'input', 'init', 'callType', 'creationMethod', 'author', 'rewardType', 'address', 'refundAddress', 'balance'))}",
    f"`result` {_struct(*_strings('gasUsed', 'output', 'code', 'address'))}",
)
#: ``*Frames`` and ``*Diffs`` stay JSON text: call trees are recursive, and diffs are keyed by addresses in source order.
BUNDLE = ", ".join(
    [
        "`number` bigint",
        "`hash` string",
        f"`block` {BLOCK}",
        f"`logs` array<{LOG}>",
        f"`receipts` array<{RECEIPT}>",
        f"`debugFrames` array<{_struct('`result` string', '`txHash` string')}>",
        f"`traceReplays` array<{_struct('`output` string', '`stateDiff` string', '`transactionHash` string', f'`trace` array<{TRACE}>')}>",
        f"`debugStateDiffs` array<{_struct('`result` string', '`txHash` string')}>",
    ]
)
#: A flattened debug frame: ``path`` is its place in the call tree, ``place`` its rank in pre-order, ``parent`` its caller's rank.
FRAME = _struct("`place` int", "`parent` int", "`path` array<bigint>", "`subtraces` bigint", *_strings("type", "from", "to", "value", "gas", "gasUsed", "input", "output", "error", "revertReason"))
