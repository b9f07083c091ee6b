"""Waiting in state: blocks whose data come late, and alarms and rates that move while nothing arrives.

Both are stateful operators with timers, so what waits costs a state entry and no task sleeps. By ``EventTime`` a row's own ``at`` is the
time and the watermark fires timers; by ``ProcessingTime`` the cluster's clock does both, and timers fire in triggers without input.
``late_legs`` is the first one over a table of answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from blockloom.streaming.buffer import STORE

#: A block is given up after so many answers more that contradict it, or so long after the first answer where data are late.
ATTEMPTS, BUDGET_MS = 10, 30_000
LEGS_OUTPUT = "chain_id long, number long, outcome string, at_ms long, waited_ms long, missing string"
ALARM_OUTPUT = "chain_id long, event string, at_ms long, value double"


def late_legs(answers: DataFrame, legs: list[str], attempts: int = ATTEMPTS, budget_ms: int = BUDGET_MS) -> DataFrame:
    """(chain_id, number, outcome, at_ms, waited_ms, missing) of blocks from answers (chain_id, number, leg, answer, at_ms).

    An answer is ready, late or wrong. whole: each of ``legs`` has come. incoherent: one wrong answer more than ``attempts`` before that.
    not ready: neither within the budget from the first answer on; ``missing`` names what hasn't come by then. One of these is decided
    first; at the same time whole goes before incoherent, and either before not ready. Other legs count for their wrong answers only.
    """
    ready, known = F.col("answer") == "ready", F.col("leg").isin(*legs)
    came = [F.min(F.when(ready & (F.col("leg") == leg), F.col("at_ms"))).alias(f"_{i}") for i, leg in enumerate(legs)]
    wrong = F.array_sort(F.collect_list(F.when(F.col("answer") == "wrong", F.col("at_ms"))))  # the answers of a block
    per = answers.withColumn("_known", known).groupBy("chain_id", "number").agg(F.min("at_ms").alias("_from"), wrong.alias("_wrong"), *came)
    never = F.lit((1 << 62)).cast("long")
    whole = F.greatest(*[F.coalesce(f"_{i}", never) for i in range(len(legs))]) if len(legs) > 1 else F.coalesce("_0", never)
    per = per.withColumn("_whole", whole).withColumn("_bad", F.coalesce(F.try_element_at("_wrong", F.lit(attempts + 1)), never)).withColumn("_end", F.col("_from") + budget_ms)
    at = F.least("_whole", "_bad", "_end")
    outcome = F.when((F.col("_whole") <= F.col("_bad")) & (F.col("_whole") <= F.col("_end")), "whole").when(F.col("_bad") <= F.col("_end"), "incoherent").otherwise("not ready")
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(f"_{i}", never) > at, F.lit(leg)) for i, leg in enumerate(legs)])), ",")
    return per.select("chain_id", "number", outcome.alias("outcome"), at.alias("at_ms"), (at - F.col("_from")).alias("waited_ms"), missing.alias("missing"))


class _Clocked(StatefulProcessor):
    def __init__(self, event_time: bool):
        self.event_time = event_time

    def rows(self, chunks: Iterator[pd.DataFrame], timers, columns: list[str]) -> list[tuple]:
        """A key's rows of a trigger in order, their last entry being the time."""
        now = None if self.event_time else timers.getCurrentProcessingTimeInMs()
        out = [tuple(r) for chunk in chunks for r in chunk[columns].itertuples(index=False)]
        return sorted([r if now is None else (*r[:-1], now) for r in out], key=lambda r: r[-1]) if now is None else [(*r[:-1], now) for r in sorted(out, key=lambda r: r[-1])]

    def close(self) -> None:
        pass


class LegsProcessor(_Clocked):
    """Per block: what has come, as a list, and a timer at the end of the budget; emits a row once the block is decided."""

    def __init__(self, legs: list[str], attempts: int, budget_ms: int, event_time: bool):
        super().__init__(event_time)
        self.legs, self.attempts, self.budget_ms = legs, attempts, budget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.came = handle.getListState("came", "leg string, at_ms long")
        self.block = handle.getValueState("block", "since long, wrong int, done boolean")

    def _decided(self, key, outcome: str, at: int, since: int, came: set[str]) -> pd.DataFrame:
        return pd.DataFrame([(int(key[0]), int(key[1]), outcome, at, at - since, ",".join(x for x in self.legs if x not in came))], columns=[c.split()[0] for c in LEGS_OUTPUT.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        since, wrong, done = self.block.get() if self.block.exists() else (None, 0, False)
        came, new = {r[0] for r in self.came.get()}, []
        order = {"ready": 0, "wrong": 1}
        todo = sorted(self.rows(rows, timers, ["leg", "answer", "at_ms"]), key=lambda r: (r[-1], order.get(r[1], 2)))
        for leg, answer, at in todo:
            at = int(at)
            if since is None:
                since = at
                self.handle.registerTimer(since + self.budget_ms)
            if done or at > since + self.budget_ms:
                continue
            if answer == "ready" and leg in self.legs and leg not in came:
                came.add(leg)
                new.append((leg, at))
                if len(came) == len(self.legs):
                    done = True
                    yield self._decided(key, "whole", at, since, came)
            elif answer == "wrong":
                wrong += 1
                if wrong > self.attempts:
                    done = True
                    yield self._decided(key, "incoherent", at, since, came)
        if new and not done:
            self.came.appendList(new)
        self.block.update((since, wrong, done))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        since, _, done = self.block.get()
        if not done:
            at = since + self.budget_ms
            yield self._decided(key, "not ready", at, since, {r[0] for r in self.came.get()})
        self.came.clear()
        self.block.clear()


class AlarmProcessor(_Clocked):
    """Per chain: a stall alarm and a rate of commits.

    Rows are (chain_id, kind, number, at_ms): kind upstream (a height seen there) or commit (a height taken in). The alarm is raised
    where upstream has been ahead, and nothing came in, for ``stall_ms``, counted from whichever is later, and cleared by a commit. The
    meter is a ring of ``slots`` and the open one; each slot's rate is told as the slot closes, until the ring is empty.
    """

    def __init__(self, stall_ms: int, slot_ms: int, slots: int, event_time: bool):
        super().__init__(event_time)
        self.stall_ms, self.slot_ms, self.slots = stall_ms, slot_ms, slots

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heights = handle.getValueState("heights", "upstream long, committed long, commit_at long, behind_at long, raised boolean")
        self.ring = handle.getMapState("ring", "place int", "slot long, n long")
        self.open = handle.getValueState("open", "slot long")

    def _row(self, key, event: str, at: int, value: float) -> tuple:
        return int(key[0]), event, at, value

    def _close(self, key, slot: int, until: int) -> Iterator[tuple]:
        """Rates of the slots from one on that end by ``until`` (a slot)."""
        while slot < until:
            n = sum(v[1] for _, v in self.ring.iterator() if slot - self.slots <= v[0] <= slot)
            if not n:
                return
            yield self._row(key, "rate", (slot + 1) * self.slot_ms, n * 1000 / (self.slots * self.slot_ms))
            slot += 1

    def _told(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ALARM_OUTPUT.split(", ")])

    def _due(self, at: int, held: tuple) -> int | None:
        upstream, committed, commit_at, behind_at, raised = held
        return max(commit_at, behind_at) + self.stall_ms if upstream > committed and not raised else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        upstream, committed, commit_at, behind_at, raised = self.heights.get() if self.heights.exists() else (-1, -1, 0, 0, False)
        slot, out = self.open.get()[0] if self.open.exists() else None, []
        for kind, number, at in self.rows(rows, timers, ["kind", "number", "at_ms"]):
            number, at = int(number), int(at)
            due = self._due(at, (upstream, committed, commit_at, behind_at, raised))
            if due is not None and due <= at:  # before a timer could tell
                raised = True
                out.append(self._row(key, "stall raised", due, float(upstream - committed)))
            if kind == "upstream":
                if upstream <= committed < number:
                    behind_at = at
                upstream = max(upstream, number)
            else:
                now = at // self.slot_ms
                if slot is not None and now > slot:
                    out.extend(self._close(key, slot, now))
                slot = now if slot is None else max(slot, now)
                place = now % (self.slots + 1)
                old = self.ring.getValue((place,))
                if old is None or old[0] < now:
                    self.ring.updateValue((place,), (now, 1))
                elif old[0] == now:
                    self.ring.updateValue((place,), (now, old[1] + 1))
                committed, commit_at = max(committed, number), at
                if raised:
                    raised = False
                    out.append(self._row(key, "stall cleared", at, float(max(0, upstream - committed))))
        self.heights.update((upstream, committed, commit_at, behind_at, raised))
        if slot is not None:
            self.open.update((slot,))
            self.handle.registerTimer((slot + 1) * self.slot_ms)
        due = self._due(0, (upstream, committed, commit_at, behind_at, raised))
        if due is not None:
            self.handle.registerTimer(due)
        yield from self._told(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, out = expiredTimerInfo.getExpiryTimeInMs(), []
        upstream, committed, commit_at, behind_at, raised = self.heights.get()
        due = self._due(at, (upstream, committed, commit_at, behind_at, raised))
        if due is not None and due <= at:
            out.append(self._row(key, "stall raised", due, float(upstream - committed)))
            self.heights.update((upstream, committed, commit_at, behind_at, True))
        slot = self.open.get()[0] if self.open.exists() else None
        if slot is not None and (slot + 1) * self.slot_ms <= at:
            told = list(self._close(key, slot, at // self.slot_ms))
            out.extend(told)
            if len(told) == at // self.slot_ms - slot:
                self.open.update((at // self.slot_ms,))
                self.handle.registerTimer((at // self.slot_ms + 1) * self.slot_ms)
            else:  # the ring has run empty
                self.open.clear()
        yield from self._told(out)


def _timed(rows: DataFrame, keys: list[str], processor: StatefulProcessor, output: str, event_time: bool, delay: str) -> DataFrame:
    conf, spark = "spark.sql.streaming.stateStore.providerClass", rows.sparkSession
    if spark.conf.get(conf, "").rpartition(".")[2] in ("", "HDFSBackedStateStoreProvider"):
        spark.conf.set(conf, STORE)
    if event_time:
        rows = rows.withColumn("_at", F.timestamp_millis("at_ms")).withWatermark("_at", delay)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, output, "Append", "EventTime" if event_time else "ProcessingTime")


def late_legs_stream(answers: DataFrame, legs: list[str], attempts: int = ATTEMPTS, budget_ms: int = BUDGET_MS, event_time: bool = False, delay: str = "0 seconds") -> DataFrame:
    """``late_legs`` of a stream; each block's row comes when it is decided, within the budget whether or not anything arrives. An answer
    that comes for a block after the end of its budget opens it anew."""
    return _timed(answers, ["chain_id", "number"], LegsProcessor(legs, attempts, budget_ms, event_time), LEGS_OUTPUT, event_time, delay)


def alarms(rows: DataFrame, stall_ms: int = 60_000, slot_ms: int = 1_000, slots: int = 10, event_time: bool = False, delay: str = "0 seconds") -> DataFrame:
    """(chain_id, event, at_ms, value): stall raised or cleared (value: heights behind) and rate (commits per second)."""
    return _timed(rows, ["chain_id"], AlarmProcessor(stall_ms, slot_ms, slots, event_time), ALARM_OUTPUT, event_time, delay)
