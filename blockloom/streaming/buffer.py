"""The fork-aware window of recent blocks: pure transitions, and a stateful processor that applies them per chain.

A batch applies whole or not at all. ``Window`` is the model: transitions make a new window and the old one stays as it was; the
supervisor's driver holds one. ``KeyedWindow`` does the same over state kept by height, for the stateful processor: what it reads and
writes is in proportion to a batch. ``held_blocks`` and ``held_marks`` read that state as tables.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import astuple, dataclass, field, replace
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


@dataclass(frozen=True)
class Block:
    number: int
    hash: str
    parent_number: int
    parent_hash: str
    timestamp: int | None = None
    payload: str | None = None

    @property
    def ref(self) -> tuple[int, str]:
        return self.number, self.hash


class Violation(Exception):
    """Input that contradicts the window. ``kind``: equivocation, descending, parent mismatch, below finality, parent not
    buffered, finality not buffered, finality mismatch, conflicting reports."""

    def __init__(self, kind: str, number: int):
        super().__init__(f"{kind} at {number}")
        self.kind, self.number = kind, number


@dataclass(frozen=True)
class Window:
    """Linked blocks in ascending order, the place of the finalized one, and the session's highest finality report."""

    blocks: tuple[Block, ...]
    final: int = 0
    most: int = 1000
    force: bool = False
    report: tuple[int, str] | None = None
    forced_past: int | None = field(default=None, compare=False)

    @property
    def head(self) -> Block:
        return self.blocks[-1]

    @property
    def finalized(self) -> Block:
        return self.blocks[self.final]

    def at(self, number: int) -> int:
        """Place of the first block at or above a height."""
        return bisect_left(self.blocks, number, key=lambda b: b.number)

    def push(self, new: Block) -> Window:
        """Appends, or cuts back to the parent and appends; a block that is held already changes nothing."""
        i = self.at(new.number)
        if i < len(self.blocks) and self.blocks[i].ref == new.ref:
            held = self.blocks[i]
            if (held.parent_number, held.parent_hash) == (new.parent_number, new.parent_hash):
                return self
            raise Violation("equivocation", new.number)
        if new.parent_number >= new.number:
            raise Violation("descending", new.number)
        p = self.at(new.parent_number)
        if p < self.final:
            raise Violation("below finality", new.number)
        if p == len(self.blocks) or self.blocks[p].number != new.parent_number:
            raise Violation("parent not buffered", new.number)
        if self.blocks[p].hash != new.parent_hash:
            raise Violation("parent mismatch", new.number)
        return replace(self, blocks=(*self.blocks[: p + 1], new))

    def finalize(self, number: int, hash_: str) -> Window:
        """Moves the finalized place up. A lower report is ignored; one above the head finalizes all there is."""
        if number < self.finalized.number:
            return self
        if number > self.head.number:
            return replace(self, final=len(self.blocks) - 1)
        i = self.at(number)
        if self.blocks[i].number != number:
            raise Violation("finality not buffered", number)
        if self.blocks[i].hash != hash_:
            raise Violation("finality mismatch", number)
        return replace(self, final=max(self.final, i))

    @property
    def excess(self) -> int:
        return max(0, len(self.blocks) - self.most)

    def compact(self) -> Window:
        """Drops the oldest blocks over the bound, but none above the finalized one unless finality may be forced on."""
        over, final, past = self.excess, self.final, None
        if over and final < over and self.force:
            past, final = self.blocks[over - 1].number, over
        cut = min(over, final)
        return replace(self, blocks=self.blocks[cut:], final=final - cut, forced_past=past)

    def fork_base(self, prev: list[tuple[int, str]]) -> tuple[int, str] | None:
        """Where to go on after a fork: the newest unfinalized block that is in ``prev``, or else the newest below all of
        it; None where all of the chain above finality is gone."""
        refs = dict(prev)
        lowest = min(refs, default=None)
        for b in reversed(self.blocks[self.final :]):
            if lowest is None or b.number < lowest or refs.get(b.number) == b.hash:
                return b.ref
        return None

    def apply(self, blocks: list[Block], report: tuple[int, str] | None = None) -> Window:
        """A whole batch with its finality report, then eviction. Raises and leaves this window as it is on any violation."""
        best = self.report
        if report and best and report[0] >= self.finalized.number and report[0] == best[0] and report[1] != best[1]:
            raise Violation("conflicting reports", report[0])
        out = self
        for b in blocks:
            out = out.push(b)
        for known in (best, report):  # what was reported earlier may only now be checked
            if known:
                out = out.finalize(*known)
        if report and report[0] >= out.finalized.number and (best is None or report[0] > best[0]):
            best = report
        return replace(out, report=best).compact()

    def reseed(self, seed: Block) -> tuple[Window, str]:
        """A new start at a finalized block, which replaces all that was held: (window, outcome). lower: below what was final, an
        alarm. Violation, and nothing goes, where this window holds another block at that height, or the same one with other parents."""
        i = self.at(seed.number)
        if i < len(self.blocks) and self.blocks[i].number == seed.number:
            held = self.blocks[i]
            if (held.hash, held.parent_number, held.parent_hash) != (seed.hash, seed.parent_number, seed.parent_hash):
                raise Violation("finality mismatch", seed.number)
        return replace(self, blocks=(seed,), final=0, report=None, forced_past=None), "lower" if seed.number < self.finalized.number else "replaced"

    def dump(self) -> str:
        return json.dumps([[[b.number, b.hash, b.parent_number, b.parent_hash, b.timestamp, b.payload] for b in self.blocks], self.final, self.most, self.force, self.report])

    @staticmethod
    def load(text: str) -> Window:
        blocks, final, most, force, report = json.loads(text)
        return Window(tuple(Block(*b) for b in blocks), final, most, force, tuple(report) if report else None)


@dataclass
class RestartLadder:
    """When a session that ended goes on: at once after the first stall, later after a pause, with a new start after many."""

    stalled: int = 0
    pause_s: float = 30.0
    most: int = 5

    def ended(self, progressed: bool) -> tuple[float, bool]:
        """(seconds to wait, whether to start anew)."""
        self.stalled = 0 if progressed else self.stalled + 1
        if self.stalled > self.most:
            self.stalled = 0
            return self.pause_s, True
        return (self.pause_s if self.stalled > 1 else 0.0), False

    def forked(self) -> None:
        self.stalled = 0


@dataclass(frozen=True)
class Marks:
    """What a keyed window keeps beside its blocks: the ends, the finalized height, the session's highest report, counts."""

    first: int
    head: int
    final: int
    size: int
    version: int = 0
    report_number: int | None = None
    report_hash: str | None = None

    @property
    def report(self) -> tuple[int, str] | None:
        return None if self.report_number is None else (self.report_number, self.report_hash)


#: A height's entry: hash, parent's height and hash, height of the block behind it (null at the head), timestamp.
LINK = "hash string, parent_number long, parent_hash string, next long, timestamp long"


class KeyedWindow:
    """The transitions of ``Window`` over blocks that are kept by height: each touches the heights that it changes, no more.

    ``read(height)`` gives an entry of ``LINK`` or None. A batch's changes gather in ``changed`` (None: gone) and ``payloads`` until the
    caller writes them; ``undo`` forgets them. Walks follow parents and the heights behind, so gaps cost nothing.
    """

    def __init__(self, read: Callable[[int], tuple | None], marks: Marks | None, most: int = 1000, force: bool = False):
        self.read, self.marks, self.most, self.force = read, marks, most, force
        self.changed: dict[int, tuple | None] = {}
        self.payloads: dict[int, str | None] = {}
        self._old = marks

    def at(self, number: int) -> tuple | None:
        return self.changed[number] if number in self.changed else self.read(number)

    def ref(self, number: int) -> tuple[int, str]:
        return number, self.at(number)[0]

    def _put(self, b: Block) -> None:
        self.changed[b.number] = b.hash, b.parent_number, b.parent_hash, None, b.timestamp
        self.payloads[b.number] = b.payload

    def seed(self, b: Block) -> None:
        self._put(b)
        self.marks = Marks(b.number, b.number, b.number, 1)

    def undo(self) -> None:
        self.changed, self.payloads, self.marks = {}, {}, self._old

    def push(self, new: Block) -> None:
        m, held = self.marks, self.at(new.number) if self.marks.first <= new.number <= self.marks.head else None
        if held and held[0] == new.hash:
            if held[1:3] == (new.parent_number, new.parent_hash):
                return
            raise Violation("equivocation", new.number)
        if new.parent_number >= new.number:
            raise Violation("descending", new.number)
        if m.final != m.first and new.parent_number <= self.at(m.final)[1]:
            raise Violation("below finality", new.number)
        parent = self.at(new.parent_number) if m.first <= new.parent_number <= m.head else None
        if parent is None:
            raise Violation("parent not buffered", new.number)
        if parent[0] != new.parent_hash:
            raise Violation("parent mismatch", new.number)
        head, gone = m.head, 0
        while head > new.parent_number:
            below = self.at(head)[1]
            self.changed[head], self.payloads[head] = None, None
            head, gone = below, gone + 1
        self.changed[head] = (*parent[:3], new.number, parent[4])
        self._put(new)
        self.marks = replace(m, head=new.number, size=m.size - gone + 1)

    def finalize(self, number: int, hash_: str) -> None:
        m = self.marks
        if number < m.final:
            return
        if number > m.head:
            self.marks = replace(m, final=m.head)
            return
        held = self.at(number)
        if held is None:
            raise Violation("finality not buffered", number)
        if held[0] != hash_:
            raise Violation("finality mismatch", number)
        self.marks = replace(m, final=number)

    @property
    def excess(self) -> int:
        return max(0, self.marks.size - self.most)

    def compact(self) -> None:
        """Drops the oldest heights over the bound, none from the finalized one on unless finality may be forced on."""
        m, first, left, final = self.marks, self.marks.first, self.excess, self.marks.final
        while left and (first < final or self.force):
            behind = self.at(first)[3]
            self.changed[first], self.payloads[first] = None, None
            first, left = behind, left - 1
            final = max(final, first)
        self.marks = replace(m, first=first, final=final, size=m.size - (self.excess - left))

    def fork_base(self, prev: list[tuple[int, str]]) -> tuple[int, str] | None:
        refs, number = dict(prev), self.marks.head
        lowest = min(refs, default=None)
        while number >= self.marks.final:
            hash_, below = self.at(number)[:2]
            if lowest is None or number < lowest or refs.get(number) == hash_:
                return number, hash_
            if number == self.marks.first:
                return None
            number = below
        return None

    def apply(self, blocks: Iterable[Block], report: tuple[int, str] | None = None) -> None:
        """A whole batch with its finality report, then eviction. Raises on any violation: then ``undo``."""
        best = self.marks.report
        if report and best and report[0] >= self.marks.final and report[0] == best[0] and report[1] != best[1]:
            raise Violation("conflicting reports", report[0])
        for b in blocks:
            self.push(b)
        for known in (best, report):  # what was reported earlier may only now be checked
            if known:
                self.finalize(*known)
        if report and report[0] >= self.marks.final and (best is None or report[0] > best[0]):
            best = report
        self.marks = replace(self.marks, report_number=best[0] if best else None, report_hash=best[1] if best else None)
        self.compact()


OUTPUT = "chain_id string, batch long, outcome string, version long, head_number long, head_hash string, finalized_number long, finalized_hash string, first_number long, size int, excess int, written int"
INPUT = ["chain_id", "batch", "pos", "number", "hash", "parent_number", "parent_hash", "timestamp", "payload", "report_number", "report_hash", "fork_prev"]
MARKS = "first long, head long, final long, size long, version long, report_number long, report_hash string"


class WindowProcessor(StatefulProcessor):
    """Per chain: applies batches in order and emits one row for each: its outcome, the window's watermarks and how many heights of
    state it wrote.

    State is a map from heights to links, another from heights to payloads, which the transitions never read, and the marks. A batch
    reads and writes the heights that it touches, whatever the window holds. A row whose ``fork_prev`` is set is a fork signal: the
    outcome names the height to go on from. The first batch seeds the window with its first block. A trigger's rows of a chain are
    sorted before they are applied, as a stream brings them in no order: what a task holds is a trigger's share, never the window.
    """

    def __init__(self, most: int = 1000, force: bool = False):
        self.most, self.force = most, force

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.links = handle.getMapState("links", "number long", LINK)
        self.payloads = handle.getMapState("payloads", "number long", "payload string")
        self.marks = handle.getValueState("marks", MARKS)

    def _write(self, links: dict[int, tuple | None], payloads: dict[int, str | None], marks: Marks) -> None:
        for state, changes in ((self.links, links), (self.payloads, {n: None if p is None else (p,) for n, p in payloads.items()})):
            for number, value in changes.items():
                if value is not None:
                    state.updateValue((number,), value)
                elif state.containsKey((number,)):
                    state.removeKey((number,))
        self.marks.update(astuple(marks))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for part in rows:
            held.extend(part[INPUT].astype(object).where(part[INPUT].notna(), None).itertuples(index=False, name=None))
        held.sort(key=lambda r: (r[1], r[2]))
        marks = Marks(*self.marks.get()) if self.marks.exists() else None
        out, links, payloads = [], {}, {}  # what the trigger's batches changed, written once at its end

        def read(number: int) -> tuple | None:
            if number in links:
                return links[number]
            found = self.links.getValue((number,))
            return None if found is None else tuple(found)

        for batch, part in groupby(held, key=lambda r: r[1]):
            part, wrote, outcome = list(part), 0, "applied"
            window = KeyedWindow(read, marks, self.most, self.force)
            try:
                if part[0][11] is not None:
                    base = window.fork_base([tuple(p) for p in json.loads(part[0][11])]) if marks else None
                    outcome = f"rebase {base[0]}" if base else "diverged"
                else:
                    blocks = [Block(int(r[3]), r[4], int(r[5]), r[6], None if r[7] is None else int(r[7]), r[8]) for r in part]
                    report = None if part[-1][9] is None else (int(part[-1][9]), part[-1][10])
                    if marks is None:
                        window.seed(blocks.pop(0))
                    window.apply(blocks, report)
                    window.marks = replace(window.marks, version=window.marks.version + 1)
                    links.update(window.changed)
                    payloads.update(window.payloads)
                    wrote = len(window.changed)
            except Violation as e:
                window.undo()
                outcome = e.kind
            marks = window.marks
            if marks:
                window = KeyedWindow(read, marks, self.most, self.force)
                out.append((key[0], int(batch), outcome, marks.version, *window.ref(marks.head), *window.ref(marks.final), marks.first, marks.size, window.excess, wrote))
            else:
                out.append((key[0], int(batch), outcome, 0, None, None, None, None, None, 0, 0, 0))
        if links:
            self._write(links, payloads, marks)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def window_stream(events: DataFrame, most: int = 1000, force: bool = False, mode: str = "Append") -> DataFrame:
    """Outcomes of a stream (or table) of batches, columns ``INPUT``, chains independent of each other.

    The session's ``spark.sql.streaming.stateStore.providerClass`` must name the RocksDB store (``STORE``), which keeps states by key; a
    session that has set none gets it here.
    """
    conf = "spark.sql.streaming.stateStore.providerClass"
    if events.sparkSession.conf.get(conf, "").rpartition(".")[2] in ("", "HDFSBackedStateStoreProvider"):
        events.sparkSession.conf.set(conf, STORE)
    _ = events.sparkSession.streams.active  # starts the coordinator of state stores, which tables need as streams do
    return events.groupBy("chain_id").transformWithStateInPandas(WindowProcessor(most, force), OUTPUT, mode, "None")


# -- the window that a stream holds, as tables --------------------------------------------------------------------------


def held_blocks(spark: SparkSession, checkpoint: str, chain_id: str, version: int | None = None) -> DataFrame:
    """The blocks of a chain that a stream's state holds after its last trigger, or after trigger ``version``: number, hash, parent_number,
    parent_hash, timestamp, payload. Reads the checkpoint, so the stream needs neither stop nor know of it."""

    def state(name: str) -> DataFrame:
        source = spark.read.format("statestore").option("stateVarName", name)
        if version is not None:
            source = source.option("batchId", version)
        return source.load(checkpoint).filter(F.col("key.chain_id") == chain_id)

    links = state("links").select(F.col("user_map_key.number").alias("number"), "user_map_value.*").drop("next")
    payloads = state("payloads").select(F.col("user_map_key.number").alias("number"), F.col("user_map_value.payload").alias("payload"))
    return links.join(payloads, "number", "left")


def held_marks(spark: SparkSession, checkpoint: str, version: int | None = None) -> DataFrame:
    """(chain_id, first, head, final, size, version, report_number, report_hash) of all chains of a stream's state."""
    source = spark.read.format("statestore").option("stateVarName", "marks")
    if version is not None:
        source = source.option("batchId", version)
    return source.load(checkpoint).select("key.chain_id", "value.*")
