import gzip
import json
import threading
import urllib.error
import urllib.request

from blockloom.plans.service import Service, serve
from blockloom.sources import rpc


def test_routes(spark):
    rows = [(n, f"a{n}", n - 1, f"a{n - 1}", json.dumps({"n": n}) + "\n") for n in range(100, 110)]
    w = spark.createDataFrame(rows, "number long, hash string, parent_number long, parent_hash string, json_line string").cache()
    service = Service(lambda: w, lambda: 105, metrics=lambda name: "m 1\n" if name in (None, "m") else "", block_time=lambda n: 7 if n == 100 else None, wait_s=0.1)
    assert service.get("/head") == (200, '{"number": 109, "hash": "a109"}') and service.get("/finalized-head")[1].startswith('{"number": 105')
    assert [service.get(p)[0] for p in ("/", "/readiness", "/metrics", "/metrics/m", "/metrics/x", "/block-time/100", "/block-time/5", "/x")] == [200, 200, 200, 200, 404, 200, 404, 404]
    assert [service.stream(b)[0] for b in (b"x", b"{}", b'{"fromBlock": -1}', b" " * 2000, b'{"fromBlock": 500}', b'{"fromBlock": 5}')] == [400, 400, 400, 413, 204, 500]
    status, text, _ = service.stream(b'{"fromBlock": 105, "parentBlockHash": "zz"}')
    assert status == 409 and json.loads(text)["previousBlocks"][-1] == {"number": 104, "hash": "a104"}
    server = serve(service, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_address[1]}"
        got = urllib.request.urlopen(urllib.request.Request(f"{url}/stream", b'{"fromBlock": 107}')).read()
        assert gzip.decompress(got).decode() == "".join(r[4] for r in rows[7:])
        assert urllib.request.urlopen(f"{url}/head").status == 200
    finally:
        server.shutdown()


def block(n, tag="h"):
    return {"number": hex(n), "hash": f"0x{tag}{n}", "parentHash": f"0xh{n - 1}", "transactions": [], "logsBloom": "0x0"}


def answers(method, params, state):
    if method == "eth_getBlockByNumber":
        n = int(params[0], 16)
        return block(n, "x" if n == 6 else "h")
    if method == "eth_getBlockReceipts":
        state[params[0]] = state.get(params[0], 0) + 1
        return [] if params[0] != "0x3" or state[params[0]] > 2 else None
    if method == "eth_getLogs":
        return [{"blockHash": "0xh2", "logIndex": "0x0"}, {"blockHash": "0xother"}]
    if method == "debug_traceBlockByHash":
        return [{"type": "CALL"}, {"result": {"type": "CREATE"}, "txHash": "0xT"}]
    return [{"transactionHash": "0xT", "type": "call"}, {"transactionHash": "0xU"}, {"transactionHash": "0xT"}, {"type": "reward"}]


def test_components_and_strides():
    state: dict = {}
    client = rpc.Client(lambda calls: [{"id": c["id"], "result": answers(c["method"], c["params"], state)} for c in calls], sleep=lambda s: None)
    rows = rpc.acquire(client, list(range(1, 9)), logs=True, traces="debug_traceBlockByHash", diffs=True)
    assert [r[0] for r in rows] == [1, 2, 3, 4, 5, 6]  # 7 names another parent
    one = json.loads(rows[1][2])
    assert one["logs"] == [{"blockHash": "0xh2", "logIndex": "0x0"}] and one["debugFrames"] == [{"result": {"type": "CALL"}}, {"result": {"type": "CREATE"}, "txHash": "0xT"}] and len(one["debugStateDiffs"]) == 2
    flat = json.loads(next(rpc.read_bundles(client, [2], traces="trace_block"))[2])["traceReplays"]
    assert [(r["transactionHash"], len(r["trace"])) for r in flat] == [("0xT", 2), ("0xU", 1)]
    assert "traceReplays" not in json.loads(next(rpc.read_bundles(client, [0], traces="trace_block"))[2])


def test_answers_are_cut_at_their_budget(spark):
    from blockloom.plans.queries import Answer, Response

    rows = spark.range(20).selectExpr("cast(id AS string) AS json_line")

    def clock(*ticks):
        left = list(ticks)
        return lambda: left.pop(0) if len(left) > 1 else left[0]

    whole = Response(Answer("data", rows))
    assert len(list(whole)) == 20 and whole.truncated is None and whole.kind == "data"
    late = Response(Answer("data", rows), seconds=5, clock=clock(0, 9))
    assert list(late) == [] and late.kind == "empty" and late.truncated == "budget"
    cut = Response(Answer("data", rows), seconds=5, clock=clock(0, 1, 2, 3, 9))
    assert len(list(cut)) == 3 and cut.kind == "data" and cut.truncated == "budget"
    left = Response(Answer("data", rows))
    reader = iter(left)
    next(reader)
    reader.close()
    assert left.truncated == "disconnect" and list(Response(Answer("empty"))) == []


def test_errors_by_class():
    import pytest

    from blockloom.sources.rpc import Client, RpcError

    assert RpcError("request timed out").retryable() and RpcError("execution timeout").retryable() and not RpcError("timeout of the vote").retryable()
    assert not RpcError("internal error").retryable() and RpcError("internal error").retryable(internal=True) and RpcError("x", code=-32000).retryable_batch() and not RpcError("x", code=-32000).retryable()
    asked = []

    def send(calls):
        asked.append(len(calls))
        if len(calls) > 2:
            raise RpcError("response too large")
        return [{"id": x["id"], "result": x["params"]} for x in calls]

    assert Client(send, sleep=lambda _: None).batch_call_reduce([("m", [k]) for k in range(5)]) == [[k] for k in range(5)] and asked == [5, 2, 3, 1, 2]
    asked.clear()

    def broken(calls):
        asked.append(len(calls))
        raise RpcError("no such method", code=-32601)

    with pytest.raises(RpcError):
        Client(broken, sleep=lambda _: None).batch_call_reduce([("m", [k]) for k in range(5)])
    assert asked == [5]  # no split could mend it


def test_registry_has_every_series_at_zero(spark):
    from blockloom.plans import metrics as me

    none = spark.createDataFrame([], "name string, label string, value double")
    rows = me.registered(spark, none).collect()
    assert len({r.name for r in rows}) == 39 and {r.value for r in rows} == {0.0} and len(rows) == sum(max(1, len(v)) for *_, v in me.SERIES)
    text = "".join(r.text for r in me.exposition(me.registered(spark, none).withColumn("type", me.F.col("kind"))).collect())
    assert 'response_truncations_total{cause="budget"} 0.0' in text
    assert {r.name for r in me.families_json(me.registered(spark, none).withColumn("type", me.F.col("kind")), "commits_total").collect()} == {"commits_total"}
