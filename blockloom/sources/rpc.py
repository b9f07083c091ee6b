"""JSON-RPC: a batching client with retries, and Python data sources that read blocks through it.

The client runs in readers on executors. Its transport is a function from a list of calls to a list of answers, so that fixtures stand
in for a node; ``http_transport`` is the real one.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)

from blockloom.plans.metrics import INTERNAL_RPC, INTERNAL_TEXT, RETRY_HTTP, RETRY_RPC, RETRY_TEXT, TOO_LARGE
from blockloom.sources.ws import ws_transport

#: Pauses before repeated attempts, in milliseconds.
SCHEDULE = (10, 100, 500, 2000, 10000, 20000)
Transport = Callable[[list[dict]], list[dict]]


class RpcError(Exception):
    """``kind``: what failed where no answer names it: connection, timeout or protocol."""

    def __init__(self, message: str, code: int | None = None, http: int | None = None, kind: str | None = None):
        super().__init__(message)
        self.code, self.http, self.kind = code, http, kind

    def retryable(self, internal: bool = False) -> bool:
        """Whether a plain call may be asked again; ``internal``: also where the other side reports an error of its own."""
        text, codes = RETRY_TEXT + (f"|{INTERNAL_TEXT}" if internal else ""), RETRY_RPC + (INTERNAL_RPC if internal else ())
        return self.kind in ("connection", "timeout") or self.http in RETRY_HTTP or self.code in codes or bool(re.search(text, str(self).lower()))

    @property
    def label(self) -> str:
        """Its class among the registry's."""
        return self.kind or ("http" if self.http else "rpc")

    @property
    def shape(self) -> bool:
        """Whether only a smaller batch can mend it."""
        return self.kind == "protocol" or str(self) == TOO_LARGE

    def retryable_batch(self, internal: bool = False) -> bool:
        return self.retryable(internal) or self.shape or self.code == -32000


def http_transport(url: str, timeout: float = 10.0) -> Transport:
    """Posts a batch and puts the answers in the order of the calls."""

    def send(calls: list[dict]) -> list[dict]:
        body = json.dumps(calls if len(calls) > 1 else calls[0]).encode()
        ask = urllib.request.Request(url, body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(ask, timeout=timeout) as got:  # noqa: S310
                answers = json.load(got)
        except urllib.error.HTTPError as e:
            raise RpcError(str(e), http=e.code) from e
        except TimeoutError as e:
            raise RpcError(f"no answer in time: {e}", kind="timeout") from e
        except urllib.error.URLError as e:
            raise RpcError(f"no connection: {e}", kind="connection") from e
        except json.JSONDecodeError as e:
            raise RpcError(f"broken answer: {e}", kind="protocol") from e
        return answers if isinstance(answers, list) else [answers]

    return send


class Client:
    """``batch``: at most so many calls at once. Items of a batch that fail are asked for again by themselves.

    ``figures`` counts by (series, label) of the registry: requests, their calls, failures that were asked again, and those that stayed.
    A request that fails as one counts once.
    """

    def __init__(self, send: Transport, batch: int = 100, attempts: int = 5, sleep: Callable[[float], None] = time.sleep, internal: bool = False, per_second: float | None = None):
        self.send, self.batch, self.attempts, self.sleep, self.internal = send, batch, attempts, sleep, internal
        self.per_second, self._next, self._id = per_second, 0.0, 0
        self.figures: Counter = Counter()

    def _count(self, series: str, errors: list[RpcError]) -> None:
        self.figures.update((series, e.label) for e in {id(e): e for e in errors}.values())

    def call(self, method: str, params: list):
        got = self.batch_call([(method, params)])[0]
        if isinstance(got, RpcError):
            raise got
        return got

    def batch_call(self, calls: list[tuple[str, list]]) -> list:
        """Results in order; an item that fails for good is its error."""
        out: list = []
        for at in range(0, len(calls), self.batch):
            out.extend(self._chunk(calls[at : at + self.batch]))
        return out

    def batch_call_reduce(self, calls: list[tuple[str, list]]) -> list:
        """As ``batch_call``, halving a batch that the other side finds too large or answers in a wrong shape."""
        if len(calls) > self.batch:
            return [x for at in range(0, len(calls), self.batch) for x in self.batch_call_reduce(calls[at : at + self.batch])]
        if not calls:
            return []
        try:
            return self._chunk(calls, whole=True)
        except RpcError as e:
            if len(calls) == 1 or not e.shape:
                raise
            half = len(calls) // 2
            return self.batch_call_reduce(calls[:half]) + self.batch_call_reduce(calls[half:])

    def _pace(self, n: int) -> None:
        if self.per_second:
            now = time.monotonic()
            if self._next > now:
                self.sleep(self._next - now)
            self._next = max(now, self._next) + n / self.per_second

    def _ask(self, calls: list[tuple[str, list]]) -> list:
        self._pace(len(calls))
        self.figures["upstream_requests_total", "batch" if len(calls) > 1 else "single"] += 1
        self.figures["upstream_calls_total", ""] += len(calls)
        ids = range(self._id + 1, self._id + 1 + len(calls))
        self._id += len(calls)
        answers = self.send([{"jsonrpc": "2.0", "id": i, "method": m, "params": p} for i, (m, p) in zip(ids, calls, strict=True)])
        by = {a.get("id"): a for a in answers}
        if len(answers) != len(calls) or set(by) != set(ids):
            raise RpcError("the answers don't match the calls", kind="protocol")
        return [RpcError(by[i]["error"].get("message", ""), by[i]["error"].get("code")) if by[i].get("error") else by[i].get("result") for i in ids]

    def _chunk(self, calls: list[tuple[str, list]], whole: bool = False) -> list:
        out: list = [None] * len(calls)
        todo = list(range(len(calls)))
        for attempt in range(self.attempts):
            try:
                got = self._ask([calls[i] for i in todo])
            except RpcError as e:
                if (whole and e.shape) or not e.retryable_batch(self.internal) or attempt == self.attempts - 1:
                    self._count("upstream_errors_total", [e])
                    raise
                got = [e] * len(todo)
            for i, x in zip(todo, got, strict=True):
                out[i] = x
            todo = [i for i in todo if isinstance(out[i], RpcError) and out[i].retryable(self.internal)]
            if not todo or attempt == self.attempts - 1:
                break
            self._count("upstream_retries_total", [out[i] for i in todo])
            self.sleep(SCHEDULE[min(attempt, len(SCHEDULE) - 1)] / 1000)
        self._count("upstream_errors_total", [x for x in out if isinstance(x, RpcError)])
        return out


def read_bundles(
    client: Client, numbers: list[int], receipts: bool | str = True, logs: bool = False, traces: str | None = None, diffs: bool = False, held: dict[int, dict] | None = None
) -> Iterator[tuple]:
    """(number, hash, bundle JSON, issue) of each height: missing, invalid, wrong number, contested or not ready, or with all that is asked for.

    ``receipts`` may be one of ``method_for_receipts``'s answers, ``traces`` one of ``trace_method``'s. Genesis has no traces. Debug
    answers may be bare frames or wrapped ones. contested: receipts of another block than the header's. Of a block that isn't ready
    the JSON has what came; as ``held`` it spares asking for that again.
    """
    held = held or {}
    fresh = [n for n in numbers if n not in held]
    blocks = {n: x["block"] for n, x in held.items()} | dict(zip(fresh, client.batch_call([("eth_getBlockByNumber", [hex(n), True]) for n in fresh]), strict=True))
    good = {n: blocks[n] for n in numbers if isinstance(blocks[n], dict) and blocks[n].get("hash") and int(blocks[n]["number"], 16) == n}
    parts: dict[int, dict] = {n: dict(held[n]) if n in held else {"number": n, "hash": b["hash"], "block": b} for n, b in good.items()}
    late: set[int] = set()

    def ask(key: str, wanted: list[int], method: str, params, shape=lambda x: x) -> None:
        wanted = [n for n in wanted if key not in parts[n]]
        for n, x in zip(wanted, client.batch_call_reduce([(method, params(n)) for n in wanted]), strict=True):
            if isinstance(x, list):
                parts[n][key] = shape(x)
            else:
                late.add(n)

    if receipts == "by transaction":
        wanted = [n for n in good if "receipts" not in parts[n]]
        hashes = {n: [t["hash"] if isinstance(t, dict) else t for t in good[n].get("transactions") or []] for n in wanted}
        got = iter(client.batch_call_reduce([("eth_getTransactionReceipt", [h]) for n in wanted for h in hashes[n]]))
        for n in wanted:
            rows = [next(got) for _ in hashes[n]]
            if all(isinstance(r, dict) for r in rows):
                parts[n]["receipts"] = rows
            else:
                late.add(n)
    elif receipts:
        ask("receipts", list(good), "eth_getBlockReceipts", lambda n: [hex(n)])
    contested = {n for n, b in good.items() if any((r.get("blockHash") or b["hash"]).lower() != b["hash"].lower() for r in parts[n].get("receipts") or [])}
    lacking = [n for n in good if "logs" not in parts[n]]
    if logs and lacking:
        ends = [hex(min(lacking)), hex(max(lacking))]
        try:
            rows = client.call("eth_getLogs", [{"fromBlock": ends[0], "toBlock": ends[1]}]) or []
        except RpcError as e:  # a range behind the last accepted block has none yet
            if "after last accepted block" not in str(e):
                raise
            rows = []
        by_block: dict[str, list] = {}
        for x in rows:
            by_block.setdefault(x.get("blockHash"), []).append(x)
        for n in lacking:
            own = by_block.get(good[n]["hash"], [])
            if own or not set((good[n].get("logsBloom") or "").removeprefix("0x")) - {"0"}:
                parts[n]["logs"] = own
            else:
                late.add(n)
    traced = [n for n in good if n]
    if traces == "debug_traceBlockByHash":
        def wrapped(xs):
            return [None if x is None else {"result": x.get("result", x), **({"txHash": x["txHash"]} if x.get("txHash") else {})} for x in xs]

        ask("debugFrames", traced, traces, lambda n: [good[n]["hash"], {"tracer": "callTracer", "tracerConfig": {"onlyTopCall": False, "withLog": True}}], wrapped)
        if diffs:
            ask("debugStateDiffs", traced, traces, lambda n: [good[n]["hash"], {"tracer": "prestateTracer", "tracerConfig": {"diffMode": True}}], wrapped)
    elif traces == "trace_replayBlockTransactions":
        ask("traceReplays", traced, traces, lambda n: [good[n]["hash"], ["trace", "stateDiff"] if diffs else ["trace"]])
    elif traces == "trace_block":
        def by_tx(frames):
            groups: dict[str, list] = {}
            for f in frames:
                if f.get("transactionHash"):
                    groups.setdefault(f["transactionHash"], []).append(f)
            return [{"transactionHash": h, "trace": fs} for h, fs in groups.items()]

        ask("traceReplays", traced, traces, lambda n: [hex(n)], by_tx)
    for n in numbers:
        b = blocks[n]
        if n in good:
            yield n, b["hash"], json.dumps(parts[n]), "contested" if n in contested else "not ready" if n in late else None
        elif b is None:
            yield n, None, None, "missing"
        else:
            yield n, "", None, "invalid" if isinstance(b, RpcError) or not isinstance(b, dict) or not b.get("hash") else "wrong number"


def _parent(row: tuple) -> str:
    return json.loads(row[2])["block"]["parentHash"].lower()


#: Why a block is asked for again, among the registry's reasons; all else is incoherent.
REASONS = {"not ready": "data_lagging", "contested": "header_contested"}


def acquire_stride(client: Client, numbers: list[int], parent_hash: str | None = None, attempts: int = 10, delay: float = 0.05, late: float = 0.1, budget: float = 30.0, legs_only: int = 3, clock: Callable[[], float] = time.monotonic, **selection) -> tuple[list[tuple], tuple | None]:
    """(whole and linked rows, what ended them before the stride did).

    The stride is read at once; a height that isn't whole or doesn't link is read again by itself. What contradicts the header or the
    chain, or isn't there, is asked for at most ``attempts`` times; data behind the header for ``budget`` seconds from its first
    sight, keeping what came for up to ``legs_only`` times in a row, then with its header anew. A first block that doesn't follow
    ``parent_hash`` ends the stride as a fork, its value the upstream's refs below it.
    """
    rows = {r[0]: r for r in read_bundles(client, numbers, **selection)}
    out: list[tuple] = []
    for n in numbers:
        wrong, kept, end = 0, 0, None
        while True:
            row = rows[n]
            issue = row[3]
            if not issue and out and _parent(row) != out[-1][1].lower():
                issue = "parent mismatch"
            if not issue:
                break
            waits = issue in ("not ready", "contested")
            if waits:
                end = clock() + budget if end is None else end
            if (clock() >= end) if waits else (wrong >= attempts):
                client.figures["acquisition_retry_exhaustions_total", ""] += 1
                return out, (n, row[1], None, issue)
            client.figures["enrichment_retries_total", REASONS.get(issue, "incoherent")] += 1
            client.sleep(late if waits else delay)
            wrong += not waits
            kept = kept + 1 if issue == "not ready" and kept < legs_only else 0
            rows[n] = next(read_bundles(client, [n], held={n: json.loads(row[2])} if kept else None, **selection))
        if not out and parent_hash and _parent(row) != parent_hash.lower():
            return out, (n, row[1], json.dumps(refs_below(client, n)), "fork")
        out.append(row)
    return out, None


def acquire(client: Client, numbers: list[int], **how) -> list[tuple]:
    """The rows of ``acquire_stride`` alone."""
    return acquire_stride(client, numbers, **how)[0]


def refs_below(client: Client, number: int, depth: int = 50) -> list[tuple[int, str]]:
    """(number, hash) of the upstream's blocks below a height, ascending."""
    heights = range(max(0, number - depth), number)
    got = client.batch_call([("eth_getBlockByNumber", [hex(n), False]) for n in heights])
    return [(n, b["hash"]) for n, b in zip(heights, got, strict=True) if isinstance(b, dict) and b.get("hash")]


def read_ref(client: Client, at: str) -> tuple[int, str] | None:
    """(number, hash) of a tag or a height in hex, None where the node has none."""
    got = client.batch_call([("eth_getBlockByNumber", [at, False])])[0]
    return (int(got["number"], 16), got["hash"]) if isinstance(got, dict) and got.get("hash") else None


class FinalizedView:
    """The finalized head as last seen, asked for again after ``ttl`` seconds. Within an epoch it never falls: a lower answer renews
    only the time. ``reseed`` opens an epoch; answers asked for in an older one don't count."""

    def __init__(self, ttl: float = 5.0, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock, self.epoch = ttl, clock, 0
        self.seen: tuple[int, str] | None = None
        self.at: float | None = None

    @property
    def fresh(self) -> bool:
        return self.at is not None and self.clock() - self.at < self.ttl

    def store(self, epoch: int, ref: tuple[int, str]) -> None:
        if epoch == self.epoch:
            self.at = self.clock()
            if self.seen is None or ref[0] > self.seen[0]:
                self.seen = ref

    def get(self, client: Client) -> tuple[int, str] | None:
        """The view, renewed if it is too old; where the node doesn't answer, as it was."""
        if not self.fresh:
            epoch, ref = self.epoch, read_ref(client, "finalized")
            if ref:
                self.store(epoch, ref)
        return self.seen

    def reseed(self, ref: tuple[int, str]) -> None:
        self.epoch += 1
        self.seen, self.at = ref, self.clock()


class _Stride(InputPartition):
    def __init__(self, start: int, end: int, parent_hash: str | None = None, receipts: bool | str = True):
        super().__init__((start, end))
        self.start, self.end, self.parent_hash, self.receipts = start, end, parent_hash, receipts


SCHEMA = "number bigint, hash string, value string, issue string"
#: What a reader's schema may ask for besides: the client's counts, on the last row of each partition.
FIGURES = "figures map<string, bigint>"
ALL = [*(part.split()[0] for part in SCHEMA.split(", ")), "figures"]


def _client(options: dict) -> Client:
    """A fixture (a JSON file of {method: {first parameter: result}} in the option's text) or a node's address."""
    if options.get("cassette"):
        tape = json.loads(options["cassette"])

        def send(calls):
            return [{"id": c["id"], "result": tape.get(c["method"], {}).get(str(c["params"][0]) if c["params"] else "")} for c in calls]

        return Client(send)
    rate, url = options.get("per_second"), options["url"]
    return Client(ws_transport(url) if url.startswith(("ws:", "wss:")) else http_transport(url), int(options.get("batch", 100)), per_second=float(rate) if rate else None)


class _Ranges:
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.stride, self.columns = options, int(options.get("stride", 5)), columns
        self.place = [ALL.index(c) for c in columns]
        self.whole = options.get("mode", "each" if options.get("cassette") else "whole") == "whole"

    def _on(self, name: str, default: str = "false") -> bool:
        return self.options.get(name, default) == "true"

    def strides(self, start: int, end: int, parent_hash: str | None = None, final: int | None = None, parents: dict[int, str] | None = None) -> list[_Stride]:
        """Heights from start to end (exclusive): strides up to ``final``, above it (where ranges may still change) each block a partition,
        which must follow what ``parents`` names for it.

        What receipts can be asked for is probed once, here on the driver.
        """
        if not hasattr(self, "_receipts"):
            self._receipts = "value" in self.columns and self._on("receipts", "true") and (not self.whole or method_for_receipts(_client(self.options)))
        top = end if final is None else min(end, max(start, final + 1))
        cuts = [*range(start, top, self.stride), *range(top, end), end]
        return [_Stride(a, b, parent_hash if a == start else (parents or {}).get(a), self._receipts) for a, b in zip(cuts, cuts[1:], strict=False)]

    def read(self, part: _Stride) -> Iterator[tuple]:
        client, last = _client(self.options) if part.end > part.start else None, None
        for row in self._rows(part, client) if client else ():
            if last is not None:
                yield self._shown(last, None)
            last = row
        if last is not None:
            yield self._shown(last, {"/".join(k): n for k, n in client.figures.items()})

    def _shown(self, row: tuple, figures: dict | None) -> tuple:
        return tuple((*row, figures)[i] for i in self.place)

    def _rows(self, part: _Stride, client: Client) -> Iterator[tuple]:
        if "value" not in self.columns:  # headers alone answer it
            part.receipts, self.options = False, self.options | dict.fromkeys(("logs", "traces", "statediffs"), "false")
        selection = {"receipts": part.receipts, "logs": self._on("logs"), "diffs": self._on("statediffs")}
        selection["traces"] = trace_method(self._on("traces"), selection["diffs"], self._on("debug"))
        numbers = list(range(part.start, part.end))
        if not self.whole:
            yield from read_bundles(client, numbers, **selection)
            return
        rows, failure = acquire_stride(client, numbers, part.parent_hash, budget=float(self.options.get("budget", 30)), **selection)
        yield from rows
        if failure:
            yield failure


class BlockReader(_Ranges, DataSourceReader):
    """Heights from ``from`` to ``to`` (or the other side's head), a partition for each stride of heights in a row."""

    def __init__(self, options: dict, columns: list[str]):
        super().__init__(options, columns)
        self.low, self.high, self.among = int(options.get("from", 0)), int(options["to"]) if "to" in options else None, None

    def partitions(self):
        if self.high is None:
            head = read_ref(_client(self.options), "latest")
            self.high = head[0] if head else -1
        if self.among is None:
            runs = [(self.low, self.high + 1)]
        else:
            runs = []
            for n in sorted(x for x in self.among if self.low <= x <= self.high):
                if runs and runs[-1][1] == n:
                    runs[-1] = runs[-1][0], n + 1
                else:
                    runs.append((n, n + 1))
        first = int(self.options.get("from", 0))
        # a query that no height can answer still has a partition, as Spark asks for one
        return [p for a, b in runs if a < b for p in self.strides(a, b, self.options.get("parent_hash") if a == first else None)] or [_Stride(0, 0)]


class PushingReader(BlockReader):
    """With the option ``pushdown``: what filters on ``number`` leave of the heights.

    Spark hands a query's comparisons of ``number`` with constants over, and they bound what the other side is asked for; filters of other
    kinds and columns stay with Spark. The session must have ``spark.sql.python.filterPushdown.enabled``, without which Spark refuses
    readers that take filters.
    """

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("number",) or not (isinstance(f, (In, IsNotNull)) or isinstance(value, int)):
                yield f
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self._end(value - isinstance(f, LessThan))
            elif isinstance(f, (EqualTo, EqualNullSafe, In)):
                own = {v for v in (value if isinstance(f, In) else [value]) if v is not None}
                self.among = own if self.among is None else self.among & own
                self._end(max(own, default=-1))
            elif not isinstance(f, IsNotNull):  # every row has a height
                yield f

    def _end(self, last: int) -> None:
        self.high = last if self.high is None else min(self.high, last)


class LookAhead:
    """Heights above a stream's place, asked for before any head names them: the next ``depth`` in one batch.

    What came is kept between triggers. A run goes out as far as each block follows the one below, so a height that isn't there yet, or
    that contradicts itself, holds all above it and is never skipped. A contradiction is asked for ``attempts`` times more, whatever
    came in between, and then raised; what is below it went out before. More than two strides found without a gap are too many to take
    one by one: ``far`` is set until the head is within a stride again.
    """

    def __init__(self, stride: int, depth: int, attempts: int = 10):
        self.stride, self.depth, self.attempts = stride, depth, attempts
        self.seen: dict[int, tuple[str, str]] = {}
        self.hits, self.wrong, self.far = 0, 0, False

    def run(self, client: Client, at: int) -> int:
        """The height after the last that can go out, ``at`` if none can."""
        ask = [n for n in range(at, at + self.depth) if n not in self.seen]
        got = dict(zip(ask, client.batch_call([("eth_getBlockByNumber", [hex(n), False]) for n in ask]) if ask else [], strict=True))
        for n, b in got.items():
            if isinstance(b, dict) and b.get("hash") and b.get("parentHash") and b.get("number") == hex(n):
                self.seen[n] = b["hash"].lower(), b["parentHash"].lower()
        first = got.get(at)
        if isinstance(first, RpcError):
            raise first
        if first is not None and at not in self.seen:
            self.wrong += 1
            if self.wrong > self.attempts:
                raise RpcError(f"the block at {at} contradicts itself")
        to = at
        while to < at + self.depth and to in self.seen:
            if to > at and self.seen[to][1] != self.seen[to - 1][0]:
                del self.seen[to]  # of another branch, or the one below is
                break
            to += 1
        self.wrong = 0 if to > at else self.wrong
        self.hits = self.hits + self.depth if to == at + self.depth else 0
        self.far = self.hits > 2 * self.stride
        return to

    def parents(self, start: int, end: int) -> dict[int, str]:
        """The hash that each height's block must follow, as far as it is known."""
        return {n: self.seen[n - 1][0] for n in range(start + 1, end) if n - 1 in self.seen}

    def settled(self, at: int) -> None:
        """Nothing below ``at`` is asked for again."""
        self.seen = {n: x for n, x in self.seen.items() if n >= at}

    def near(self, gap: int) -> None:
        """The head is ``gap`` above the place of the stream."""
        if gap <= self.stride:
            self.far, self.hits = False, 0


class BlockStreamReader(_Ranges, DataSourceStreamReader):
    """Heights up to the head (or the finalized one) and ``to``; an offset is the next height and the hash of the block before it.

    More than a stride below the finalized head a trigger takes up to ``max_blocks``; near the head up to ``depth``, read side by side
    and committed in order. A process that begins doesn't know where its query stands, so its first trigger goes to the head, unless
    ``fresh`` says that the query has no checkpoint. With ``speculate``, after that, heights are looked for by themselves (``LookAhead``),
    and blocks read side by side must follow each other.
    """

    def __init__(self, options: dict, columns: list[str]):
        super().__init__(options, columns)
        self._view = FinalizedView(float(options.get("finality_ttl", 5)))
        self._last: dict | None = self.initialOffset() if self._on("fresh") else None
        plain = self.whole and options.get("tag", "latest") == "latest" and not int(options.get("confirmations", 0))
        self._ahead = LookAhead(self.stride, int(options.get("depth", 3))) if plain and self._on("speculate") else None

    def initialOffset(self) -> dict:
        return {"next": int(self.options.get("from", 0)), "hash": self.options.get("parent_hash", "")}

    def latestOffset(self) -> dict:
        client, tag = _client(self.options), self.options.get("tag", "latest")
        start = self._last or self.initialOffset()
        if self._last and self._ahead and not self._ahead.far:
            self._view.get(client)
            top = min(self._ahead.run(client, start["next"]), int(self.options["to"]) + 1 if "to" in self.options else 1 << 62)
            if top > start["next"]:
                self._last = {"next": top, "hash": self._ahead.seen[top - 1][0]}
            return self._last
        head = read_ref(client, tag)
        if head is None:
            return start
        if self._ahead:
            self._ahead.near(head[0] - start["next"])
        top = max(0, head[0] + 1 - int(self.options.get("confirmations", 0)))
        top = min(top, int(self.options.get("to", head[0])) + 1)
        at, final = start["next"], self._view.get(client)
        if self._last:
            far = self._ahead is not None and self._ahead.far
            near = tag != "finalized" and final is not None and final[0] - at <= self.stride and not far
            top = min(top, at + (int(self.options.get("depth", 3)) if near else int(self.options.get("max_blocks", 1000))))
            if not near and final and self.whole and not (far and final[0] < at):  # far above finality, heights go one by one, side by side
                top = min(top, final[0] + 1)
        if top <= at:
            return start
        last = read_ref(client, hex(top - 1))
        if last is None and self.whole:
            return start
        self._last = {"next": top, "hash": last[1] if last else ""}
        return self._last

    def partitions(self, start: dict, end: dict):
        parents = self._ahead.parents(start["next"], end["next"]) if self._ahead else None
        return self.strides(start["next"], end["next"], start.get("hash") or None, self._view.seen[0] if self._view.seen else None, parents)

    def commit(self, end: dict) -> None:
        if self._ahead:
            self._ahead.settled(end["next"])


class BlockSource(DataSource):
    """``spark.read.format("evm_blocks")`` and ``readStream``: options url (http or ws) or cassette, from, to, parent_hash, stride,
    receipts, logs, traces, statediffs, debug, mode, pushdown; of streams also tag, confirmations, max_blocks, depth, fresh, speculate.

    ``mode`` each gives a row for every height, with its issue; whole (as a node is read) asks again for what isn't whole and ends a
    stride before what stays so, with one row that names the issue. A first block that doesn't follow ``parent_hash`` is a fork.

    A schema given to the reader picks columns of ``SCHEMA``, and may add ``FIGURES``, which ``metrics.upstream`` sums to series; without
    ``value`` headers alone are asked for, whatever the options say.
    """

    @classmethod
    def name(cls) -> str:
        return "evm_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockReader:
        return (PushingReader if self.options.get("pushdown") == "true" else BlockReader)(dict(self.options), schema.fieldNames())

    def streamReader(self, schema) -> BlockStreamReader:
        return BlockStreamReader(dict(self.options), schema.fieldNames())


def register(spark) -> None:
    spark.dataSource.register(BlockSource)


def method_for_receipts(client: Client) -> str:
    """by block or by transaction: what the other side can do, asked once."""
    try:
        return "by block" if isinstance(client.call("eth_getBlockReceipts", ["latest"]), list) else "by transaction"
    except RpcError:
        return "by transaction"


def trace_method(traces: bool, diffs: bool, debug: bool) -> str | None:
    """The one method that serves a selection of traces and state diffs."""
    if not (traces or diffs):
        return None
    if debug:
        return "debug_traceBlockByHash"
    return "trace_replayBlockTransactions" if diffs else "trace_block"
