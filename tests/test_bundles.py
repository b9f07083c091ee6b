"""Normalisation, call trees, encoders and sources."""

import json
import random

from blockloom.operators import frames as fr
from blockloom.operators.normalize import normalize, parse_bundles
from blockloom.sources import encode as en
from blockloom.sources import rpc

A = "0x" + "Ab" * 20
RAW = {
    "number": 5, "hash": "0xh5",
    "block": {
        "number": "0x5", "hash": "0xh5", "parentHash": "0xh4", "timestamp": "0x64", "transactionsRoot": "0x1", "receiptsRoot": "0x2", "stateRoot": "0x3", "logsBloom": "0x0", "sha3Uncles": "0x4", "extraData": "0x", "miner": A, "size": "0x10", "gasLimit": "0x1", "gasUsed": "0x0", "zz": 1,
        "transactions": [
            {"transactionIndex": "0x0", "hash": "0xT", "nonce": "0x1", "from": A, "to": A, "gas": "0x5", "type": "0x4", "chainId": "0x1", "accessList": [{"address": A, "storage_keys": ["0x1"]}],
             "authorizationList": [{"chainId": "0x1", "address": A, "nonce": "0xffffffffffffffffffff", "yParity": "0x1", "r": "0x1", "s": "0x2"}, {"chainId": 5, "address": A, "nonce": "0x2", "signature": {"r": "0x3", "s": "0x4", "oddYParity": True}}]}
        ],
    },
    "receipts": [{"transactionHash": "0xT", "cumulativeGasUsed": "0x5", "gasUsed": "0x5", "logsBloom": "0x0", "status": "0x1", "l1FeeScalar": "0.5", "logs": [{"address": A, "logIndex": "0x0", "transactionIndex": "0x0", "transactionHash": "0xT", "data": "0x", "topics": ["0x1"]}]}],
}
TREE = {"type": "CALL", "from": A, "to": A, "gas": "0x1", "gasUsed": "0x1", "input": "0x", "calls": [{"type": "CREATE", "from": A, "gas": "0x2"}, {"type": "SELFDESTRUCT", "from": A, "to": A, "gas": "0x0", "value": "0x7", "calls": [{"type": "CALL", "from": A, "gas": "0x1"}]}]}


def record(spark, raw, **k):
    df = parse_bundles(spark.createDataFrame([(json.dumps(raw),)], "value string"))
    return normalize(df, **k).first()


def test_record(spark):
    r = record(spark, RAW)
    d = json.loads(r.json_line)
    assert (r.number, r.parent_number, r.timestamp, r.json_line[-1]) == (5, 4, 100000, "\n")
    assert list(d) == ["header", "transactions", "logs"] and d["header"]["miner"] == A and d["header"]["uncles"] == [] and d["header"]["number"] == 5
    tx = d["transactions"][0]
    assert tx["from"] == A.lower() and tx["accessList"][0] == {"address": A, "storageKeys": ["0x1"]} and tx["status"] == 1 and tx["l1FeeScalar"] == 0.5
    assert [a["nonce"] for a in tx["authorizationList"]] == ["1208925819614629174706175", "2"] and [a["chainId"] for a in tx["authorizationList"]] == ["0x1", "0x5"] and tx["authorizationList"][1]["yParity"] == 1
    assert d["logs"] == [{"logIndex": 0, "transactionIndex": 0, "transactionHash": "0xT", "address": A.lower(), "data": "0x", "topics": ["0x1"]}]
    assert json.loads(record(spark, RAW | {"logs": []}).json_line)["logs"] == []


def test_traces_and_diffs_are_keys_where_selected(spark):
    d = json.loads(record(spark, RAW, with_traces=True, with_state_diffs=True).json_line)
    assert d["traces"] == [] and d["stateDiffs"] == []


def test_debug_traces(spark):
    d = json.loads(record(spark, RAW | {"debugFrames": [{"result": TREE, "txHash": "0xT"}]}, with_traces=True).json_line)
    assert [(t["type"], t["traceAddress"], t["subtraces"]) for t in d["traces"]] == [("call", [], 2), ("create", [0], 0), ("selfdestruct", [1], 1)]
    assert d["traces"][2]["action"] == {"address": A.lower(), "refundAddress": A.lower(), "balance": "0x7"}
    stop = record(spark, RAW | {"debugFrames": [{"result": {"type": "STOP", "from": A, "gas": "0x0"}}]}, with_traces=True)
    assert json.loads(stop.json_line)["traces"] == []


def test_replays(spark):
    call = {"type": "call", "traceAddress": [0], "subtraces": 0, "error": "Reverted", "action": {"from": A, "to": A, "value": "0x0", "gas": "0x1", "input": "0x", "callType": "call"}, "result": {"gasUsed": "0x1", "output": "0x" + "0" * 134 + "03616263"}}
    gone = {"type": "suicide", "traceAddress": [], "subtraces": 0, "action": {"address": A, "refundAddress": A, "balance": "0x1"}}
    diff = {"0xA": {"balance": {"*": {"from": "0x1", "to": "0x2"}}, "code": "=", "nonce": {"+": "0x1"}, "storage": {"s": {"-": "0x9"}}}}
    raw = RAW | {"traceReplays": [{"transactionHash": "0xT", "trace": [gone, call], "stateDiff": diff}, {"transactionHash": "0xZ", "trace": [gone]}]}
    d = json.loads(record(spark, raw, with_traces=True, with_state_diffs=True).json_line)
    assert [t["type"] for t in d["traces"]] == ["selfdestruct", "call"] and d["traces"][1]["revertReason"] == "abc" and "revertReason" not in d["traces"][0]
    assert [(x["key"], x["kind"]) for x in d["stateDiffs"]] == [("balance", "*"), ("nonce", "+"), ("s", "-")]


def test_debug_state_diffs_keep_order(spark):
    result = {"pre": {"0xB": {"balance": "0x1", "storage": {"k2": "0x1", "k1": "0x2"}}, "0xA": {}}, "post": {"0xA": {"nonce": 5}, "0xC": {"code": "0x6"}, "0xB": {"storage": {"k1": "0x3", "k3": "0x4"}}}}
    d = json.loads(record(spark, RAW | {"debugStateDiffs": [{"result": result}]}, with_state_diffs=True).json_line)
    assert [(x["address"], x["key"], x["kind"]) for x in d["stateDiffs"]] == [("0xb", "k2", "-"), ("0xb", "k1", "*"), ("0xb", "k3", "+"), ("0xa", "nonce", "*"), ("0xc", "code", "+")]
    assert d["stateDiffs"][3]["prev"] == "0x0" and d["stateDiffs"][3]["next"] == "0x5"


def test_frame_checks(spark):
    other = "0x" + "cd" * 20
    bad = {**TREE, "calls": [{"type": "DELEGATECALL", "from": A, "to": other, "input": "0x", "gasUsed": "0x1", "gas": "0x1", "calls": [{"type": "CALL", "from": other, "to": A, "input": "0x", "gasUsed": "0x1", "gas": "0x1"}]}, {"type": "STOP", "from": A, "gas": "0x0"}]}
    blocks = parse_bundles(spark.createDataFrame([(json.dumps(RAW | {"debugFrames": [{"result": bad, "txHash": "0xU"}]}),)], "value string"))
    frames = fr.frames_of(blocks)
    assert [(r.place, r.parent) for r in frames.orderBy("place").collect()] == [(0, None), (1, 0), (2, 1), (3, 0)]
    assert [(r.place, r.violation) for r in fr.structure_violations(frames).collect()] == [(3, "nested STOP frame")]
    txs = spark.createDataFrame([(5, 0, A, other)], "number long, tx int, from_address string, to_address string")
    found = fr.tree_violations(frames, txs)
    assert sorted((r.place, r.violation) for r in found.collect()) == [(0, "root to is not the receiver"), (2, "from is not the executing account")]
    assert fr.report_violations(found, "observe").first()["count"] == 2 and fr.report_violations(found, "reject").first().reason == "root to is not the receiver"
    assert fr.report_violations(found, "off").count() == 0
    assert fr.mismatched_labels(blocks).count() == 1


def test_deep_trees_flatten(spark):
    tree = {"type": "CALL", "from": A, "gas": "0x1"}
    for _ in range(900):
        tree = {"type": "CALL", "from": A, "to": A, "gas": "0x1", "calls": [tree]}
    assert len(fr.flatten(tree)) == 901 and len(fr.flatten(tree)[-1][2]) == 900


def test_frames_by_levels_equal_the_walk(spark):
    rng = random.Random(6)

    def grown(depth):
        node = {"type": rng.choice(["CALL", "CREATE", "STATICCALL"]), "from": A, "gas": hex(rng.randint(0, 99)), "value": None if rng.random() < 0.2 else "0x1", 'note "calls" [': {"x": [1]}}
        if depth and rng.random() < (1 if depth > 20 else 0.95):
            node["calls"] = [grown(depth - 1 if k == 0 else rng.randint(0, min(2, depth - 1))) for k in range(rng.choice([1, 1, 1, 2, 3]))]
        elif rng.random() < 0.3:
            node["calls"] = []
        return node

    trees = [grown(d) for d in (0, 1, 5, 8, 9, 16, 33, 66)] + [None]
    deep = {"type": "CALL", "from": A}
    for _ in range(450):
        deep = {"type": "CALL", "from": A, "calls": [deep, {"type": "STOP"}]}
    lines = [(json.dumps(RAW | {"number": 5, "debugFrames": [None if t is None else {"result": t, "txHash": f"0x{i}"} for i, t in enumerate(trees)]}),), (json.dumps(RAW | {"number": 6, "debugFrames": None}),)]
    got = fr.frames_of(parse_bundles(spark.createDataFrame(lines, "value string"))).orderBy("tx", "place").collect()
    want = [(i, f"0x{i}", *row) for i, t in enumerate(trees) if t is not None for row in fr.flatten(t)]
    names = ["tx", "tx_hash", *fr.FRAME_TYPE.names]
    assert [tuple(r[n] for n in names) for r in got] == want and max(len(r.path) for r in got) > 40
    # trees nested beyond the parser's bound
    rows = spark.createDataFrame([(7, [(json.dumps(deep), "0xd"), ('{"type":"CALL"}', "0xe")])], "number long, debugFrames array<struct<result string, txHash string>>")
    assert [(r.tx, r.place, r.parent) for r in fr.frames_of(rows).orderBy("tx", "place").collect()] == [(0, r[0], r[1]) for r in fr.flatten(deep)] + [(1, 0, None)]


def test_frames_of_bytes(spark):
    df = spark.createDataFrame([(1, "a\n"), (2, "b\n")], "number long, json_line string")
    e = en.encoded(df)
    assert [r[0] for r in e.orderBy("number").select(en.record_of("frame")).collect()] == ["a\n", "b\n"]
    import gzip

    assert b"".join(gzip.decompress(bytes(r.frame)) for r in en.body(None, e, zstd=False).collect()) == b"a\nb\n"


def test_client_retries_and_order():
    log = []

    def send(calls):
        log.append(len(calls))
        if len(log) == 1:
            raise rpc.RpcError("busy", http=503)
        return [{"id": c["id"], **({"error": {"code": -32005, "message": "slow down"}} if len(log) == 2 and c["params"] == [1] else {"result": c["params"][0] * 10})} for c in reversed(calls)]

    client = rpc.Client(send, batch=2, sleep=lambda s: None)
    assert client.batch_call([("m", [i]) for i in range(3)]) == [0, 10, 20] and log == [2, 2, 1, 1]

    def odd(calls):
        return [{"id": c["id"], "result": c["params"][0]} for c in calls][: 1 if len(calls) > 1 else None]

    assert rpc.Client(odd, sleep=lambda s: None).batch_call_reduce([("m", [i]) for i in range(5)]) == [0, 1, 2, 3, 4]


def test_block_source(spark, tmp_path):
    rpc.register(spark)
    blocks = {hex(n): {"number": hex(n), "hash": f"0xh{n}", "parentHash": f"0xh{n - 1}", "transactions": []} for n in range(9)}
    tape = {"eth_getBlockByNumber": blocks | {"latest": blocks["0x8"], "0x3": None, "0x5": {"number": "0x9", "hash": "0x"}}, "eth_getBlockReceipts": {k: [] for k in blocks} | {"0x7": None}}
    options = {"cassette": json.dumps(tape), "to": "8", "stride": "4"}
    rows = spark.read.format("evm_blocks").options(**options).load().orderBy("number").collect()
    assert [r.issue for r in rows] == [None, None, None, "missing", None, "wrong number", None, "not ready", None]
    run = spark.readStream.format("evm_blocks").options(**options).load().writeStream.format("memory").queryName("tape").option("checkpointLocation", str(tmp_path)).start()
    try:
        run.processAllAvailable()
        assert spark.sql("SELECT count(*) FROM tape").first()[0] == 9
    finally:
        run.stop()


def test_probe_and_method():
    assert rpc.method_for_receipts(rpc.Client(lambda calls: [{"id": c["id"], "result": []} for c in calls])) == "by block"
    assert rpc.method_for_receipts(rpc.Client(lambda calls: [{"id": c["id"], "error": {"code": -32601, "message": "no"}} for c in calls])) == "by transaction"
    assert [rpc.trace_method(*x) for x in ((False, False, True), (True, True, True), (True, True, False), (True, False, False))] == [None, "debug_traceBlockByHash", "trace_replayBlockTransactions", "trace_block"]


def test_bundles_are_made_after_lines_are_gathered(spark, sf):
    from blockloom.plans.views import bundles

    plan = bundles(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    above, gathered, below = plan.partition("Aggregate [")
    assert gathered and "sha2(" in above and "sha2(" not in below and "Join" not in plan


def test_parts_of_records_are_read_alone(spark, sf):
    from blockloom.operators.normalize import record_parts
    from blockloom.plans import records

    lines = spark.createDataFrame([(json.dumps(RAW | {"debugFrames": [{"result": TREE, "txHash": "0xT"}]}),)], "value string")
    whole = json.loads(normalize(parse_bundles(lines), with_traces=True).first().json_line)
    for part, read in records._READ.items():
        row = record_parts(parse_bundles(lines, parts=read), with_traces=part == "traces").first()
        assert json.loads(row[part]) == whole[part] and (row.number, row.hash, row.timestamp) == (5, "0xh5", 100000)
    for query in (records.canonical_headers, records.canonical_transactions, records.canonical_logs):
        plan = query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "EvalPython" not in plan and plan.count("from_json(") + plan.count("jsontostructs(") <= 2


def test_low_trees_equal_the_walk(spark):
    rng = random.Random(8)

    def grown(depth):
        return {"type": "CALL", "from": A, "gas": hex(rng.randint(0, 99)), **({"calls": [grown(depth - 1 if k == 0 else 0) for k in range(rng.randint(1, 4))]} if depth else {})}

    trees = [grown(d % fr.LEVELS) for d in range(24)]
    rows = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "i int, result string").select("i", fr.low_frames(fr.F.col("result")).alias("f"))
    assert [[tuple(f) for f in r.f] for r in rows.orderBy("i").collect()] == [fr.flatten(t) for t in trees]


def test_quantities_as_digits(spark):
    from blockloom.functions import quantities as q

    values = ["0x0", "0x9", "0xa", "0x" + "f" * 16, "0x1" + "0" * 16, "0x" + "f" * 32, "0x1" + "0" * 32, "0x000" + "f" * 32, "0x", "x1", "", "0x0x1", "0xzz", "12", None, hex(10**38), hex(10**38 - 1), hex(10**20 + 10)]
    got = spark.createDataFrame([(v,) for v in values], "x string").select("x", q.qty_digits("x").alias("d"), q.qty_u64("x").cast("string").alias("u")).collect()
    assert [r.d for r in got] == [str(q.parse_u128(v) or 0) if v is not None else "0" for v in values]
    assert [r.u for r in got] == [None if v is None else str(n if (n := q.parse_u128(v) or 0) < 1 << 64 else 0) for v in values]


def test_state_diffs_parse_each_text_once(spark):
    from pyspark.sql import functions as F

    from blockloom.operators.normalize import debug_diffs, replay_diffs

    debug = '{"pre":{"0xA":{"nonce":7,"storage":{"s1":"0x1","s2":"0x2"}}},"post":{"0xA":{"nonce":"8","code":"0x6","storage":{"s3":"0x3","s1":"0x1"}},"0xB":{"balance":"0x5"}}}'
    replay = '{"0xA":{"balance":{"*":{"from":"0x1","to":"0x5"}},"nonce":"=","code":{"-":"0x6"},"storage":{"s1":{"+":"0x4"},"s2":"=","s3":{"*":{"from":"0x1"},"-":"0x2"},"s4":"{"}}}'
    rows = spark.createDataFrame([(debug, replay), (None, "x")], "debug string, replay string")
    shown = rows.select(debug_diffs(F.col("debug"), F.lit(0)).alias("debug"), replay_diffs(F.col("replay"), F.lit(0)).alias("replay"))
    first, second = ([[tuple(x)[1:] for x in r[c]] for c in ("debug", "replay")] for r in shown.collect())
    assert first[0] == [("0xa", "code", "+", None, "0x6"), ("0xa", "nonce", "*", "0x7", "0x8"), ("0xa", "s1", "*", "0x1", "0x1"), ("0xa", "s2", "-", "0x2", None), ("0xa", "s3", "+", None, "0x3"), ("0xb", "balance", "+", None, "0x5")]
    assert first[1] == [("0xa", "code", "-", "0x6", None), ("0xa", "balance", "*", "0x1", "0x5"), ("0xa", "s1", "+", None, "0x4"), ("0xa", "s3", "-", "0x2", None)] and second == [[], []]
    assert str(shown._jdf.queryExecution().optimizedPlan()).count("from_json(") <= 4  # one for each text that is parsed


def test_deep_trees_are_walked_in_place(spark):
    def nested(depth):
        node = {"type": "CALL", "gas": 21000, "value": None, "error": True, "input": {"a": [1]}, "calls": "none"}
        for _ in range(depth):
            node = {"type": "CALL", "gas": "0x1", "calls": [node, None]}
        return json.dumps(node, separators=(",", ":"))

    rows = spark.createDataFrame([(k, [(nested(d), f"0x{d}"), None]) for k, d in enumerate((1, 2, 9, 30))], "number long, debugFrames array<struct<result string, txHash string>>")
    frames = fr.frames_of(rows)
    got = {}
    for r in frames.orderBy("number", "place").collect():
        got.setdefault(r.tx_hash, []).append(r)
    assert {h: len(x) for h, x in got.items()} == {f"0x{d}": 2 * d + 1 for d in (1, 2, 9, 30)}
    for d in (1, 2, 9, 30):
        last = next(r for r in got[f"0x{d}"] if list(r.path) == [0] * d)
        assert (last.type, last.gas, last.value, last.error, last.input, last.subtraces, last.place, last.parent) == ("CALL", "21000", None, "true", '{"a":[1]}', 0, d, d - 1)
        assert all(r.type is None and r.parent == r.path[:-1].count(0) for r in got[f"0x{d}"] if r.path and r.path[-1] == 1)
    assert "Exchange" not in frames._jdf.queryExecution().executedPlan().toString()


def test_callers_are_found_without_a_join(spark):
    odd = ["0X" + "aB" * 20, "0x" + "zz" * 20, "", None, "É" * 42, "0x1"]
    frames = [(1, 0, 0, None, "CALL", A, odd[0])] + [(1, 0, 1 + i, 0, "CALL", x, A) for i, x in enumerate(odd)] + [(1, 1, 0, None, "DELEGATECALL", odd[4].lower(), "x"), (1, 1, 1, 0, "CALL", odd[4], None), (1, 1, 2, 1, "CALL", A, A), (1, 1, 3, 9, "CALL", A, A)]
    frames = spark.createDataFrame([(*f[:4], [] if f[3] is None else [0], *f[4:]) for f in frames], "number long, tx long, place int, parent int, path array<long>, type string, `from` string, `to` string")
    txs = spark.createDataFrame([(1, 0, A.lower(), A.upper()), (1, 1, odd[1], "X")], "number long, tx long, from_address string, to_address string")
    found = fr.tree_violations(frames, txs)
    name = "from is not the executing account"
    assert sorted(tuple(r)[1:] for r in found.collect()) == [(0, 2, name), (0, 3, name), (0, 5, name), (0, 6, name), (1, 0, "root from is not the sender")]
    assert str(found._jdf.queryExecution().optimizedPlan()).count("Join") == 1  # roots with their transactions


def test_lines_of_frame_queries_are_shuffled_once(spark, sf):
    from blockloom.plans import catalog

    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        plans = {n: catalog.QUERIES[n](spark, sf)._jdf.queryExecution().executedPlan().toString() for n in ("call_trees", "frame_reports_rejected", "receipts_by_position", "flat_frame_checks")}
    finally:
        for k in off:
            spark.conf.unset(k)
    exchanges = {n: [line for line in p.splitlines() if " Exchange " in line] for n, p in plans.items()}
    assert {n: len(x) for n, x in exchanges.items()} == {"call_trees": 5, "frame_reports_rejected": 1, "receipts_by_position": 4, "flat_frame_checks": 6}
    # what a join shuffles holds no hash that can be made behind it
    below = plans["receipts_by_position"].split("SortMergeJoin")[1]
    assert "md5" not in below
    assert "IS NOT NULL" not in plans["frame_reports_rejected"] and plans["frame_reports_rejected"].count("unknown frame type") == 1


def test_kinds_of_frames_are_worked_out_once(spark):
    a = A.lower()
    kinds = [
        ({"type": "CALL", "from": A, "to": A, "value": "0x1", "gas": "0x2", "gasUsed": "0x3", "input": "0x4", "output": "0x5"}, {"type": "call", "action": {"callType": "call", "from": a, "to": a, "value": "0x1", "gas": "0x2", "input": "0x4"}, "result": {"gasUsed": "0x3", "output": "0x5"}}),
        ({"type": "staticcall", "from": A, "to": A, "error": "out of gas"}, {"error": "out of gas", "type": "call", "action": {"callType": "staticcall", "from": a, "to": a, "input": "0x"}}),
        ({"type": "CALL", "from": A}, None),
        ({"type": "CREATE2", "from": A, "to": A, "gas": "0x2", "output": "0x5", "input": "0x6"}, {"type": "create", "action": {"from": a, "gas": "0x2", "init": "0x6"}, "result": {"gasUsed": "", "code": "0x5", "address": a}}),
        ({"type": "CREATE", "gasUsed": "", "output": "", "to": ""}, {"type": "create", "action": {"init": "0x"}}),
        ({"type": "SUICIDE", "from": A, "to": A, "value": "0x7", "gasUsed": "0x1"}, {"type": "selfdestruct", "action": {"address": a, "refundAddress": a, "balance": "0x7"}}),
        ({"type": "STOP", "to": A}, None), ({"type": "odd", "to": A}, None), ({"to": A}, None),
    ]
    root = {"type": "CALL", "from": A, "to": A, "calls": [k for k, _ in kinds]}
    deep = {"type": "CALL", "from": A, "to": A, "calls": [root]}
    for _ in range(fr.LEVELS):
        deep = {"type": "CALL", "from": A, "to": A, "calls": [deep]}
    lines = [(json.dumps(RAW | {"debugFrames": [{"result": t} if t else t for t in trees]}),) for trees in ([root, None, {"type": "STOP"}], [None, deep, root])]
    rows = normalize(parse_bundles(spark.createDataFrame(lines, "value string")), with_traces=True)
    low, high = (json.loads(r.json_line)["traces"] for r in rows.collect())
    want = [{"subtraces": 0} | w | {"traceAddress": [i]} for i, (_, w) in enumerate(kinds) if w]
    assert [{k: v for k, v in t.items() if k != "transactionIndex"} for t in low[1:]] == want and {t["transactionIndex"] for t in low} == {0}
    assert list(low[1]["action"]) == ["callType", "from", "to", "value", "gas", "input"]
    assert [t["transactionIndex"] for t in high] == [1] * (fr.LEVELS + 2 + len(want)) + [2] * (1 + len(want)) and [t | {"transactionIndex": 0} for t in high if t["transactionIndex"] == 2] == low
    plan = str(rows._jdf.queryExecution().optimizedPlan())
    # a frame's kind and whether its tree stopped; and what Python reads is a text
    assert plan.count("upper(") <= 2 and "trees(" in plan and "THEN debugFrames" not in plan


def test_frames_are_made_a_few_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(en, "HELD", 1000)
    texts = [None if i % 7 == 0 else "é" * i for i in range(600)] + ["x" * 5000, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(602)), pa.array(texts)], names=["number", "json_line"])
    parts = list(en._framed(iter([batch, batch.slice(0, 0), batch.slice(595)])))
    assert len(parts) > 10 and all(sum(len(f.as_py() or b"") for f in p.column(1)[:-1]) < 1000 for p in parts)
    assert pa.Table.from_batches(parts).column("number").to_pylist() == [*range(602), *range(595, 602)]
    frames = [f for p in parts for f in p.column(1)]
    read = [t for p in en.record_of.func(iter([pa.array(frames, pa.binary())])) for t in p.to_pylist()]
    assert read == texts + texts[595:] and max(len(p) for p in en.record_of.func(iter([pa.array(frames, pa.binary())]))) < 100

    rows = spark.range(3000, numPartitions=2).selectExpr("id AS number", "named_struct('é x', id) AS own", "if(id % 7 = 0, null, concat(repeat('é', cast(id AS int)), '\n')) AS json_line")
    e = en.encoded(rows)
    assert e.columns == ["number", "own", "frame"] and e.schema["own"].dataType == rows.schema["own"].dataType
    back = e.select("number", "own", en.record_of("frame").alias("json_line"))
    assert back.exceptAll(rows).count() == 0 and back.count() == 3000


def test_records_wait_for_python_without_their_bundle(spark, sf):
    from blockloom.plans import catalog

    plan = str(catalog.QUERIES["compressed_records"](spark, sf)._jdf.queryExecution().optimizedPlan())
    assert plan.count("MapInArrow") == 1 and plan.count("ArrowEvalPython") == 1
    waits = plan.partition("ArrowEvalPython")[2].partition("MapInArrow")
    assert "raw#" not in waits[0] and "raw#" not in waits[2].splitlines()[0]
