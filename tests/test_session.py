"""The source as nodes are read: ladders, forks, transports, finality, and the supervised ingestion over a node of its own."""

import json
import socket
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from blockloom.sources import rpc, ws
from blockloom.streaming.buffer import Block, Violation, Window
from blockloom.streaming.session import Diverged, Fault, Prober, Supervisor


def block(n, tag="h", parent=None):
    return {"number": hex(n), "hash": f"0x{tag}{n}", "parentHash": parent or f"0x{tag}{n - 1}", "timestamp": hex(1000 + n), "transactions": [{"hash": f"0xt{n}"}], "logsBloom": "0x0"}


def client(answer, sleep=lambda s: None):
    return rpc.Client(lambda calls: [{"id": c["id"], "result": answer(c["method"], c["params"])} for c in calls], sleep=sleep)


def test_what_lags_is_asked_for_by_itself():
    asked = []

    def answer(method, params):
        asked.append((method, params[0]))
        if method == "eth_getBlockByNumber":
            return block(int(params[0], 16))
        return None if sum(a == (method, params[0]) for a in asked) < 6 and params[0] == "0x2" else [{"blockHash": f"0xh{int(params[0], 16)}"}]

    rows, failure = rpc.acquire_stride(client(answer), [1, 2, 3])
    assert [r[0] for r in rows] == [1, 2, 3] and failure is None
    # three times with the header kept, then with a new one
    assert asked.count(("eth_getBlockByNumber", "0x2")) == 2 and asked.count(("eth_getBlockReceipts", "0x2")) == 6


def test_ladders_end():
    ticks = iter(range(1000))
    late = client(lambda m, p: block(int(p[0], 16)) if m == "eth_getBlockByNumber" else None)
    rows, failure = rpc.acquire_stride(late, [1, 2], budget=30, clock=lambda: next(ticks))
    assert rows == [] and failure == (1, "0xh1", None, "not ready")
    asked = []
    gone = client(lambda m, p: asked.append(p) or (None if p[0] == "0x2" else block(int(p[0], 16))) if m == "eth_getBlockByNumber" else [])
    rows, failure = rpc.acquire_stride(gone, [1, 2, 3])
    assert [r[0] for r in rows] == [1] and failure == (2, None, None, "missing") and asked.count(["0x2", True]) == 11
    other = client(lambda m, p: block(int(p[0], 16)) if m == "eth_getBlockByNumber" else [{"blockHash": "0xother"}])
    assert rpc.acquire_stride(other, [1], budget=0)[1][3] == "contested"


def test_forks_and_links():
    def answer(method, params):
        n = int(params[0], 16)
        return [] if method != "eth_getBlockByNumber" else block(n, parent="0xzz" if n == 4 else None)

    rows, failure = rpc.acquire_stride(client(answer), [2, 3, 4], "0xh1")
    assert [r[0] for r in rows] == [2, 3] and failure[3] == "parent mismatch"
    rows, failure = rpc.acquire_stride(client(answer), [2, 3], "0xother")
    assert rows == [] and failure[3] == "fork" and json.loads(failure[2]) == [[0, "0xh0"], [1, "0xh1"]]


def test_receipts_by_transaction():
    lag = {"left": 2}

    def answer(method, params):
        if method == "eth_getBlockByNumber":
            return block(int(params[0], 16))
        assert method == "eth_getTransactionReceipt"
        lag["left"] -= 1
        return None if lag["left"] >= 0 else {"transactionHash": params[0], "blockHash": "0xh" + params[0][3:]}

    rows, failure = rpc.acquire_stride(client(answer), [1, 2, 3], receipts="by transaction")
    assert failure is None and [json.loads(r[2])["receipts"][0]["transactionHash"] for r in rows] == ["0xt1", "0xt2", "0xt3"]


def test_finalized_view():
    now, heads = [0.0], iter([(5, "a"), (4, "b"), (9, "c")])
    view = rpc.FinalizedView(clock=lambda: now[0])
    node = client(lambda m, p: {"number": hex((h := next(heads))[0]), "hash": h[1]})
    assert view.get(node) == (5, "a") and view.get(node) == (5, "a")
    now[0] = 6
    assert view.get(node) == (5, "a") and view.fresh  # a lower answer renews the time
    old = view.epoch
    view.reseed((2, "x"))
    view.store(old, (8, "late"))
    assert view.seen == (2, "x")
    now[0] = 20
    assert view.get(node) == (9, "c")


def test_prober():
    now = [0.0]
    p = Prober(cap=3, batch=2, clock=lambda: now[0])
    for ref in [(1, "a1"), (2, "b2"), (3, "a3"), (5, "a5")]:
        p.offer(ref)
    assert list(p.queue) == [(1, "a1"), (2, "b2"), (5, "a5")]
    node = client(lambda m, params: {"hash": f"a{int(params[0], 16)}"})
    assert p.round(node, (0, "a0")) is None and p.last is None
    assert p.round(node, (9, "a9")) == (1, "a1") and list(p.queue) == [(5, "a5")]
    assert p.round(node, (9, "a9")) is None  # too soon
    now[0] = 1
    assert p.round(node, (9, "a9")) == (5, "a5")
    p.offer((4, "a4"))
    assert not p.queue


def test_reseed():
    w = Window(tuple(Block(n, f"h{n}", n - 1, f"h{n - 1}") for n in range(3, 9))).finalize(5, "h5")
    new, outcome = w.reseed(Block(7, "h7", 6, "h6"))
    assert outcome == "replaced" and new.blocks == (Block(7, "h7", 6, "h6"),)
    assert w.reseed(Block(4, "h4", 3, "h3"))[1] == "lower" and w.reseed(Block(50, "x", 49, "y"))[1] == "replaced"
    for bad in (Block(7, "z", 6, "h6"), Block(7, "h7", 6, "z")):
        with pytest.raises(Violation):
            w.reseed(bad)


class Node:
    """A node over HTTP whose chain can be changed while it is read."""

    def __init__(self, blocks, final):
        self.blocks, self.final, self.asked = {int(b["number"], 16): b for b in blocks}, final, 0
        self.calls: list = []
        node = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                got = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                calls = got if isinstance(got, list) else [got]
                body = json.dumps([{"id": c["id"], "result": node.answer(c["method"], c["params"])} for c in calls]).encode()
                self.send_response(200)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}"

    def answer(self, method, params):
        self.calls.append((method, params[0]))
        if method != "eth_getBlockByNumber":
            return []
        top = max(self.blocks)
        return self.blocks.get({"latest": top, "finalized": min(self.final, top)}.get(params[0]) if params[0] in ("latest", "finalized") else int(params[0], 16))


def test_supervised_ingestion(spark, tmp_path):
    node = Node([block(n) for n in range(1, 31)], final=3)
    sup = Supervisor(spark, {"url": node.url, "stride": "4", "max_blocks": "8"}, str(tmp_path / "archive"), str(tmp_path / "cp"), most=100, sleep=lambda s: None, ttl=0.0)
    try:
        sup.seed()
        assert sup.window.head.ref == (3, "0xh3")
        node.final = 20
        w = sup.run(lambda w: w.head.number >= 30)
        assert [b.number for b in w.blocks] == list(range(3, 31)) and w.finalized.ref == (20, "0xh20") and sup.log == []
        # the upstream leaves the chain above 26
        for n in range(27, 34):
            node.blocks[n] = block(n, "f", parent="0xh26" if n == 27 else None)
        w = sup.run(lambda w: w.head.number >= 33)
        assert [b.hash for b in w.blocks][-8:] == ["0xh26", *[f"0xf{n}" for n in range(27, 34)]] and [e[0] for e in sup.log] == ["fork"]
        held = spark.read.parquet(str(tmp_path / "archive")).filter("issue IS NULL")
        refs = spark.createDataFrame([b.ref for b in w.blocks[1:]], "number long, hash string")
        assert refs.join(held, ["number", "hash"]).select("number").distinct().count() == 30
        # one that goes behind what is final
        for n in range(15, 37):
            node.blocks[n] = block(n, "g")
        with pytest.raises(Diverged):
            sup.run()
    finally:
        node.server.shutdown()


@pytest.fixture
def pushing(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def heights(node, method="eth_getBlockByNumber"):
    return sorted({int(p, 16) for m, p in node.calls if m == method and p not in ("latest", "finalized")})


def test_filters_bound_what_is_asked_for(spark, pushing):
    node = Node([block(n) for n in range(0, 60)], final=50)
    rpc.register(spark)
    try:
        read = spark.read.format("evm_blocks").option("url", node.url).option("stride", "4").option("pushdown", "true")
        for where, want, left in [
            ("number BETWEEN 7 AND 12", range(7, 13), []), ("number > 50", range(51, 60), []), ("number < 3 AND number >= 1", range(1, 3), []), ("number = 9", [9], []),
            ("number IN (3, 4, 20, 900)", [3, 4, 20], []), ("number IN (3, 4, 20) AND number > 3 AND hash = '0xh20'", [20], ["hash"]), ("number > 9 AND number < 9", [], []),
            ("number < 8 AND number % 2 = 1", [1, 3, 5, 7], ["%"]), ("number <=> 11", [11], []), ("number BETWEEN 2 AND 5 AND number <> 3", [2, 4, 5], ["NOT"]),
        ]:
            node.calls.clear()
            df = read.load().filter(where)
            plan = df._jdf.queryExecution().executedPlan().toString()
            shown = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            assert "PushedFilters: [" in shown and "number" in shown.split("PushedFilters: [")[1].split("\n")[0], shown
            above = plan.split("BatchScan")[0]
            assert all(x in above for x in left) and (left or "Filter" not in above), plan
            assert sorted(r.number for r in df.filter("issue IS NULL").collect()) == list(want)
            asked = heights(node)
            bounds = {"number < 8 AND number % 2 = 1": range(8), "number BETWEEN 2 AND 5 AND number <> 3": range(2, 6), "number IN (3, 4, 20, 900)": [3, 4, 20, 900], "number IN (3, 4, 20) AND number > 3 AND hash = '0xh20'": [4, 20]}
            assert asked == list(bounds.get(where, want))
            assert set(heights(node, "eth_getBlockReceipts")) <= set(asked)
    finally:
        node.server.shutdown()


def test_without_values_headers_are_asked_for_alone(spark):
    node = Node([block(n) for n in range(0, 9)], final=5)
    rpc.register(spark)
    try:
        read = spark.read.format("evm_blocks").option("url", node.url).option("to", "8").option("logs", "true").option("traces", "true")
        got = read.schema("hash string, number bigint").load().orderBy("number").collect()
        assert [(r.hash, r.number) for r in got] == [(f"0xh{n}", n) for n in range(9)] and {m for m, _ in node.calls} == {"eth_getBlockByNumber"}
        node.calls.clear()
        assert read.schema(rpc.SCHEMA).option("mode", "each").load().filter("number > 6").count() == 2 and "eth_getLogs" in {m for m, _ in node.calls}
    finally:
        node.server.shutdown()


def test_stalls_lead_to_a_new_start(spark, tmp_path):
    node = Node([block(n) for n in range(1, 6)], final=5)
    pauses: list = []
    sup = Supervisor(spark, {"url": node.url}, str(tmp_path / "archive"), str(tmp_path / "cp"), sleep=pauses.append)
    ends = iter([("error", "x")] * 6 + [("stopped", None)])
    sup.session = lambda base: next(ends)  # the ladder alone
    with pytest.raises(Fault):
        sup.run()
    sup._started = True
    ends = iter([("error", "x")] * 6 + [("stopped", None)])
    node.final = 5
    sup.ladder.stalled = 0
    w = sup.run()
    assert w.head.number == 5 and pauses == [30.0] * 5 and ("reset", 5) in sup.log
    node.server.shutdown()


def test_web_socket():
    server = socket.create_server(("127.0.0.1", 0))
    seen: list = []

    def serve():
        for round_ in range(2):
            conn, _ = server.accept()
            stream = conn.makefile("rb")
            key = ""
            while (line := stream.readline().strip()):
                if line.lower().startswith(b"sec-websocket-key"):
                    key = line.split()[1].decode()
            import base64
            import hashlib

            mark = base64.b64encode(hashlib.sha1((key + ws.ACCEPT).encode()).digest()).decode()
            conn.sendall(f"HTTP/1.1 101 x\r\nUpgrade: websocket\r\nSec-WebSocket-Accept: {mark}\r\n\r\n".encode())
            calls = json.loads(ws.read_frame(stream)[2])
            calls = calls if isinstance(calls, list) else [calls]
            seen.append(len(calls))
            if round_ == 0:  # breaks before it answers
                stream.close()
                conn.close()
                continue
            conn.sendall(ws.frame(ws.PING, b"p", None) + ws.frame(ws.TEXT, b'{"method": "notice"}', None))
            for c in reversed(calls):  # one by one, in another order, with a long one
                conn.sendall(ws.frame(ws.TEXT, json.dumps({"id": c["id"], "result": c["params"][0] * 70000}).encode(), None))
            assert ws.read_frame(stream)[:1] == (ws.PONG,)
            return

    thread = threading.Thread(target=serve, daemon=True)
    thread.start()
    node = rpc.Client(ws.ws_transport(f"ws://127.0.0.1:{server.getsockname()[1]}/x"), sleep=lambda s: None)
    got = node.batch_call([("m", ["a"]), ("m", ["b"])])
    assert got == ["a" * 70000, "b" * 70000] and seen == [2, 2]
    thread.join(10)
    with pytest.raises(rpc.RpcError):
        ws.ws_transport("ws://127.0.0.1:9", dials=1)([{"id": 1}])


def test_look_ahead_keeps_order():
    chain, asked = {n: block(n) for n in (1, 2, 4, 5)}, []

    def answer(method, params):
        asked.append(int(params[0], 16))
        return chain.get(asked[-1])

    node, ahead = client(answer), rpc.LookAhead(stride=5, depth=4)
    assert ahead.run(node, 1) == 3 and asked == [1, 2, 3, 4]
    ahead.settled(3)
    asked.clear()
    assert ahead.run(node, 3) == 3 and asked == [3, 5, 6]  # what is above waits for it and isn't asked for again
    chain[3] = block(3)
    asked.clear()
    assert ahead.run(node, 3) == 6 and asked == [3, 6] and ahead.parents(3, 6) == {4: "0xh3", 5: "0xh4"}
    # a block of another branch isn't taken with the one below, and is asked for anew
    chain |= {6: block(6), 7: block(7, parent="0xother")}
    assert ahead.run(node, 6) == 7 and 7 not in ahead.seen
    chain[7] = block(7)
    assert ahead.run(node, 7) == 8


def test_look_ahead_ends_at_contradictions():
    answers = iter([block(9), None] * 20)
    ahead = rpc.LookAhead(5, 1, attempts=3)
    node = client(lambda m, p: next(answers))
    for _ in range(7):  # heights that aren't there yet neither count nor start the count anew
        assert ahead.run(node, 1) == 1 or ahead.wrong < 4
        if ahead.wrong == 3:
            break
    ahead.run(node, 1)
    with pytest.raises(rpc.RpcError, match="contradicts itself"):
        ahead.run(node, 1)
    # waiting for a height has no end of its own
    idle = rpc.LookAhead(5, 2, attempts=3)
    assert all(idle.run(client(lambda m, p: None), 1) == 1 for _ in range(50))


def test_look_ahead_gives_way_to_strides():
    node = Node([block(n) for n in range(1, 40)], final=2)
    try:
        options = {"url": node.url, "from": "3", "parent_hash": "0xh2", "stride": "4", "depth": "3", "fresh": "true", "speculate": "true", "max_blocks": "20", "finality_ttl": "1000", "receipts": "false"}
        reader, places = rpc.BlockStreamReader(options, rpc.ALL), [3]
        while True:
            began = reader._last
            end = reader.latestOffset()
            if end == began:
                break
            parts = reader.partitions(began, end)
            rows = [r for p in parts for r in reader.read(p)]
            assert [r[0] for r in rows] == list(range(began["next"], end["next"])) and not any(r[3] for r in rows)
            reader.commit(end)
            places.append(end["next"])
        # three triggers of three heights without a gap, then ranges (above finality) up to the head
        assert places[:4] == [3, 6, 9, 12] and places[4] == 32 and places[-1] == 40 and not reader._ahead.far
        node.calls.clear()
        node.blocks |= {40: block(40), 41: block(41)}
        began, end = reader._last, reader.latestOffset()
        assert end == {"next": 42, "hash": "0xh41"} and ("eth_getBlockByNumber", "latest") not in node.calls
        # the chain changes between the look and the reading: blocks read side by side don't follow, and the second says so
        node.blocks |= {40: block(40, "f", parent="0xh39"), 41: block(41, "f")}
        rows = [r for p in reader.partitions(began, end) for r in reader.read(p)]
        assert [(r[0], r[1], r[3]) for r in rows] == [(40, "0xf40", None), (41, "0xf41", "fork")]
    finally:
        node.server.shutdown()


def test_supervised_ingestion_that_speculates(spark, tmp_path):
    node = Node([block(n) for n in range(1, 31)], final=25)
    sup = Supervisor(spark, {"url": node.url, "stride": "4", "max_blocks": "8", "speculate": "true"}, str(tmp_path / "archive"), str(tmp_path / "cp"), most=100, sleep=lambda s: None, ttl=0.0)
    try:
        w = sup.run(lambda w: w.head.number >= 30)
        assert [b.number for b in w.blocks] == list(range(25, 31)) and sup.log == []
        for n in range(29, 34):
            node.blocks[n] = block(n, "f", parent="0xh28" if n == 29 else None)
        w = sup.run(lambda w: w.head.number >= 33)
        assert [b.hash for b in w.blocks][-6:] == ["0xh28", *[f"0xf{n}" for n in range(29, 34)]] and [e[0] for e in sup.log] == ["fork"]
    finally:
        node.server.shutdown()


def test_retries_and_failures_are_counted_apart():
    broken = {"left": 2}

    def send(calls):
        out = []
        for c in calls:
            limited = c["params"] == [1] and broken["left"] > 0
            broken["left"] -= limited
            out.append({"id": c["id"]} | ({"error": {"code": -32005, "message": "limit exceeded"}} if limited else {"error": {"code": -32602, "message": "bad"}} if c["params"] == [2] else {"result": c["params"]}))
        return out

    c = rpc.Client(send, sleep=lambda s: None)
    got = c.batch_call([("a", [0]), ("a", [1]), ("a", [2])])
    assert got[:2] == [[0], [1]] and isinstance(got[2], rpc.RpcError)
    assert c.figures == {("upstream_requests_total", "batch"): 1, ("upstream_requests_total", "single"): 2, ("upstream_calls_total", ""): 5, ("upstream_retries_total", "rpc"): 2, ("upstream_errors_total", "rpc"): 1}

    def down(calls):
        raise rpc.RpcError("no answer in time", kind="timeout")

    c = rpc.Client(down, attempts=3, sleep=lambda s: None)
    with pytest.raises(rpc.RpcError):
        c.batch_call([("a", [0]), ("a", [1])])
    assert c.figures["upstream_retries_total", "timeout"] == 2 and c.figures["upstream_errors_total", "timeout"] == 1 and c.figures["upstream_errors_total", "rpc"] == 0


def test_figures_of_readers_feed_the_registry(spark):
    from blockloom.plans import metrics as me

    node, lagging = Node([block(n) for n in range(1, 13)], final=3), {5: 2, 9: 1}
    plain = node.answer

    def answer(method, params):
        if method == "eth_getBlockReceipts" and params[0] != "latest":
            n = int(params[0], 16) if params[0].startswith("0x") and "h" not in params[0] else int(params[0].removeprefix("0xh"))
            if lagging.get(n):
                lagging[n] -= 1
                return None
            return [{"blockHash": f"0xh{n}"}]
        return plain(method, params)

    node.answer = answer
    try:
        rpc.register(spark)
        rows = spark.read.format("evm_blocks").schema(f"{rpc.SCHEMA}, {rpc.FIGURES}").options(url=node.url, **{"from": "1", "to": "12", "stride": "4"}).load().persist()
        assert [r.number for r in rows.orderBy("number").collect()] == list(range(1, 13)) and rows.filter("figures IS NOT NULL").count() == 3
        got = {(r.name, r.label): r.value for r in me.registered(spark, me.upstream(rows)).filter("value > 0").collect()}
        rows.unpersist()
        assert got[("enrichment_retries_total", "data_lagging")] == 3 and got[("upstream_requests_total", "batch")] >= 6 and ("upstream_errors_total", "rpc") not in got
    finally:
        node.server.shutdown()
