"""A supervised ingestion: sessions of a streaming query over ``evm_blocks``, restarted, rebased and seeded anew as they end.

Blocks go from the executors into a table; the driver sees the references of a trigger (at most ``max_blocks``) and moves the window
by them, so a block that was written but not taken into the window isn't part of the chain.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import deque
from collections.abc import Callable
from dataclasses import replace

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.sources import rpc
from blockloom.streaming.buffer import Block, RestartLadder, Violation, Window


class Diverged(Exception):
    """The upstream contradicts what is final here; no restart mends it."""


class Fault(Exception):
    """The upstream's answers contradict each other; the next attempt may do better."""


class Prober:
    """References that wait until the upstream's finalized chain has them: at most ``cap``, asked for ``batch`` at once and after
    ``interval`` seconds, from the highest down, as finality is a maximum. One that the finalized chain doesn't have is dropped."""

    def __init__(self, cap: int = 50, batch: int = 5, interval: float = 0.5, clock: Callable[[], float] = time.monotonic):
        self.cap, self.batch, self.interval, self.clock = cap, batch, interval, clock
        self.queue: deque[tuple[int, str]] = deque()
        self.confirmed: tuple[int, str] | None = None
        self.last: float | None = None

    def offer(self, ref: tuple[int, str]) -> None:
        """A candidate; in a full queue it takes the newest one's place, as what waits longest is what still needs an answer."""
        if self.confirmed and self.confirmed[0] >= ref[0]:
            return
        if len(self.queue) >= self.cap:
            self.queue.pop()
        self.queue.append(ref)

    def settled(self, ref: tuple[int, str]) -> None:
        """Confirmed otherwise: nothing at or below it needs an answer."""
        while self.queue and self.queue[0][0] <= ref[0]:
            self.queue.popleft()
        if self.confirmed is None or ref[0] > self.confirmed[0]:
            self.confirmed = ref

    def round(self, client: rpc.Client, finalized: tuple[int, str] | None) -> tuple[int, str] | None:
        """The highest reference that this round confirms."""
        if not self.queue or finalized is None or self.queue[0][0] > finalized[0] or (self.last is not None and self.clock() - self.last < self.interval):
            return None
        self.last = self.clock()
        asked: list[tuple[int, str]] = []
        while self.queue and len(asked) < self.batch and self.queue[0][0] <= finalized[0]:
            asked.append(self.queue.popleft())
        got = client.batch_call([("eth_getBlockByNumber", [hex(n), False]) for n, _ in asked])
        if any(isinstance(b, rpc.RpcError) for b in got):
            self.queue.extendleft(reversed(asked))
            return None
        hit = next((ref for ref, b in zip(reversed(asked), reversed(got), strict=True) if b and b.get("hash") == ref[1]), None)
        if hit:
            self.settled(hit)
        return hit


class Supervisor:
    """Keeps ``window`` at the chain's head. ``options`` are those of ``evm_blocks``; blocks go to ``archive``, a table's folder.

    ``run`` ends where ``until`` says so (asked with the window after each trigger), or raises: what ended the first session before its
    first block, or ``Diverged``. ``log`` has what happened: (event, detail). ``ttl`` is for how many seconds of ``clock`` a finalized head is
    taken as seen.
    """

    def __init__(self, spark: SparkSession, options: dict[str, str], archive: str, checkpoints: str, most: int = 1000, force: bool = False, sleep: Callable[[float], None] = time.sleep, ttl: float = 5.0, clock: Callable[[], float] = time.monotonic):
        rpc.register(spark)
        self.spark, self.options, self.archive, self.checkpoints = spark, {"mode": "whole", **options}, archive, checkpoints
        self.most, self.force, self.sleep = most, force, sleep
        self.client, self.view, self.prober, self.ladder = rpc._client(self.options), rpc.FinalizedView(ttl, clock), Prober(clock=clock), RestartLadder()
        self.window: Window | None = None
        self.log: list[tuple[str, object]] = []
        self._end: tuple[str, object] | None = None
        self._started = False
        self.until: Callable[[Window], bool] = lambda _: False

    def seed(self) -> None:
        """A window of the finalized block alone; one that was there must not contradict it."""
        head = rpc.read_ref(self.client, "finalized")
        if head is None:
            raise Fault("no finalized head")
        got = self.client.call("eth_getBlockByNumber", [hex(head[0]), False])
        if not isinstance(got, dict) or (int(got["number"], 16), got.get("hash")) != head:
            raise Fault(f"the block at {head[0]} isn't the finalized head that was named")
        block = Block(head[0], got["hash"], max(0, head[0] - 1), got["parentHash"], int(got["timestamp"], 16) if got.get("timestamp") else None)
        if self.window is None:
            self.window = Window((block,), most=self.most, force=self.force)
        else:
            try:
                self.window, outcome = self.window.reseed(block)
            except Violation as e:
                raise Diverged(str(e)) from e
            self.log.append((outcome, block.number))
        self.view.reseed(head)
        self.prober = Prober(clock=self.view.clock)

    def take(self, rows: list[tuple[int, str, str | None, int | None, str | None, str | None]]) -> None:
        """Moves the window by a trigger's rows (number, hash, parent hash, timestamp, issue, detail): those before the first issue."""
        blocks: list[Block] = []
        failure = None
        for number, hash_, parent, timestamp, issue, detail in rows:
            if issue:
                failure = ("fork", [tuple(r) for r in json.loads(detail)]) if issue == "fork" else ("error", f"{issue} at {number}")
                break
            blocks.append(Block(number, hash_, max(0, number - 1), parent, timestamp))
        report = self.view.get(self.client)
        try:
            self.window = self.window.apply(blocks)
            self._started |= bool(blocks)
            held = {b.ref for b in self.window.blocks}
            if report and report in held:
                self.prober.settled(report)
                self.window = self.window.apply([], report)
            else:
                if blocks:
                    self.prober.offer(blocks[-1].ref)
                hit = self.prober.round(self.client, report)
                if hit in held:
                    self.window = self.window.apply([], hit)
        except Violation as e:
            failure = failure or ("error", str(e))
        if failure is None and self.until(self.window):
            failure = ("stopped", None)
        if failure:
            self._end = failure
            raise Fault(failure[0])

    def _batch(self, session: str) -> Callable[[DataFrame, int], None]:
        def run(rows: DataFrame, batch: int) -> None:
            folder = f"{self.archive}/session={session}/batch={batch}"
            rows.write.mode("overwrite").parquet(folder)  # a trigger that runs again replaces its own rows
            block = F.get_json_object("value", "$.block.parentHash"), F.conv(F.substring(F.get_json_object("value", "$.block.timestamp"), 3, 16), 16, 10).cast("long")
            found = self.spark.read.parquet(folder).select("number", "hash", block[0].alias("parent"), block[1].alias("at"), "issue", F.when(F.col("issue") == "fork", F.col("value")).alias("detail"))
            self.take([tuple(r) for r in found.orderBy("number").collect()])

        return run

    def session(self, base: tuple[int, str]) -> tuple[str, object]:
        """One query from above ``base`` until it ends, and how."""
        self._end, name = None, uuid.uuid4().hex
        options = self.options | {"from": str(base[0] + 1), "parent_hash": base[1], "fresh": "true"}
        stream = self.spark.readStream.format("evm_blocks").options(**options).load()
        query = stream.writeStream.foreachBatch(self._batch(name)).option("checkpointLocation", f"{self.checkpoints}/{name}").start()
        try:
            query.awaitTermination()
        except StreamingQueryException as e:
            return self._end or ("error", str(e))
        finally:
            query.stop()
        return self._end or ("ended", None)

    def run(self, until: Callable[[Window], bool] = lambda _: False) -> Window:
        self.until = until
        if self.window is None:
            self.seed()
        base, anew = self.window.head.ref, False
        while True:
            try:
                if anew:
                    self.seed()
                    self.log.append(("reset", self.window.head.number))
                    base = self.window.head.ref
                end = self.session(base)
            except (Fault, rpc.RpcError) as e:
                end = ("error", str(e))
            if end[0] == "stopped":
                return self.window
            self.log.append(end)
            if end[0] == "fork":
                base = self.window.fork_base(end[1])
                if base is None:
                    raise Diverged(f"rollback behind {self.window.finalized.ref}")
                self.ladder.forked()
                anew = False
                continue
            if not self._started:
                raise Fault(f"ended before the first block: {end[1]}")
            self.window = replace(self.window, report=None)  # a session's highest report ends with it, but for a fork's
            pause, anew = self.ladder.ended(self.window.head.number != base[0])
            base = self.window.head.ref
            if pause:
                self.sleep(pause)
