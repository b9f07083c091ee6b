"""Range queries, watermarks and readiness over a window of blocks given as a DataFrame.

A window has number, hash, parent_number, parent_hash (and whatever payload columns). Each verdict is a one-row aggregate; the
blocks themselves are a filter on height that reaches the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Refs that a conflict carries: own parents up to the asked block, or own blocks at the head.
PARENT_REFS, HEAD_REFS = 101, 100


@dataclass(frozen=True)
class Answer:
    """``kind``: data, empty, conflict or below; ``blocks`` for data, ``prev`` for a conflict."""

    kind: str
    blocks: DataFrame | None = None
    prev: list[tuple[int, str]] | None = None


def suffix(window: DataFrame, start: int) -> DataFrame:
    return window.filter(F.col("number") >= start).orderBy("number")


def watermarks(window: DataFrame, finalized: int | None = None) -> DataFrame:
    """One row: first, head, and the finalized block (the highest at or below a height)."""
    final = F.max_by(F.struct("number", "hash"), F.when(F.col("number") <= (finalized if finalized is not None else -1), F.col("number")))
    return window.agg(F.min_by(F.struct("number", "hash"), "number").alias("first"), F.max_by(F.struct("number", "hash"), "number").alias("head"), F.when(F.lit(finalized).isNotNull(), final).alias("finalized"))


def offset_finality(blocks: DataFrame, confirmations: int) -> DataFrame:
    """The block so many heights below the head, or the first at height 0: (number, hash), none where it wasn't produced."""
    head = blocks.agg(F.greatest(F.max("number") - confirmations, F.lit(0)).alias("number"))
    return blocks.join(F.broadcast(head), "number").select("number", "hash")  # one row


def finalized_batch(blocks: DataFrame, finalized: int) -> DataFrame:
    return blocks.filter(F.col("number") <= finalized)


def query(window: DataFrame, start: int, parent_hash: str | None = None) -> Answer:
    """What a reader who asks for blocks from a height on gets, having last seen a block with ``parent_hash``."""
    at = F.when(F.col("number") >= start, F.col("number"))
    row = window.agg(
        F.min_by(F.struct("number", "parent_number"), "number").alias("first"), F.max_by(F.struct("number", "hash"), "number").alias("head"), F.min_by(F.struct("number", "parent_hash"), at).alias("next"),
    ).first()
    if row.first is None:
        return Answer("empty")
    if row.first.number != row.first.parent_number and start <= row.first.parent_number:
        return Answer("below")
    if row.next is not None:
        if parent_hash is not None and row.next.parent_hash != parent_hash:
            return Answer("conflict", prev=conflict_refs(window, row.next.number))
        return Answer("data", suffix(window, start))
    if parent_hash is not None and start == row.head.number + 1 and parent_hash != row.head.hash:
        last = window.orderBy(F.desc("number")).limit(HEAD_REFS).select("number", "hash").collect()
        return Answer("conflict", prev=sorted((r.number, r.hash) for r in last))
    return Answer("empty")


def conflict_refs(window: DataFrame, number: int) -> list[tuple[int, str]]:
    """Parents of the asked block and of those before it, at most ``PARENT_REFS``, ascending; a root names itself if alone."""
    rows = window.filter(F.col("number") <= number).orderBy(F.desc("number")).limit(PARENT_REFS).select("number", "parent_number", "parent_hash").collect()
    refs = sorted((r.parent_number, r.parent_hash) for r in rows if r.parent_number != r.number)
    if not refs:
        first = window.orderBy("number").select("number", "hash").first()
        refs = [(first.number, first.hash)]
    return refs


def backfill(archive: DataFrame, window: DataFrame, start: int) -> DataFrame:
    """Finalized blocks below the window, then the window's. Raises where the archive has none or they don't join up."""
    from blockloom.operators.linkage import with_breaks_by_join

    first = window.agg(F.min_by(F.struct("number", "parent_number", "parent_hash"), "number").alias("b")).first().b
    below = archive.filter((F.col("number") >= start) & (F.col("number") < first.number))
    ends = below.agg(F.min("number").alias("low"), F.max_by(F.struct("number", "hash"), "number").alias("last")).first()
    if ends.last is None:
        raise LookupError("nothing below the window")
    if (ends.last.number, ends.last.hash) != (first.parent_number, first.parent_hash):
        raise LookupError("the archive doesn't join the window")
    # inside, each block finds its parent by an equi-join, in no order
    if not with_breaks_by_join(below.withColumn("chain_id", F.lit(0))).filter((F.col("number") > ends.low) & ~F.col("linked")).isEmpty():
        raise LookupError("the archive doesn't hang together")
    return below.unionByName(window.filter(F.col("number") >= start)).orderBy("number")


def resolve(archive: DataFrame, window: DataFrame, start: int, parent_hash: str | None = None) -> Answer:
    """``query``, going to the archive for what lies below the window."""
    got = query(window, start, parent_hash)
    return Answer("data", backfill(archive, window, start)) if got.kind == "below" else got


def wait_for(read, start: int, parent_hash: str | None = None, seconds: float = 5.0, step: float = 0.1) -> Answer:
    """Asks again, through ``read`` (which gives the newest window), until there is something or the time is over."""
    import time

    end = time.monotonic() + seconds
    while True:
        got = query(read(), start, parent_hash)
        if got.kind != "empty" or time.monotonic() >= end:
            return got
        time.sleep(step)


def fork_base(window: DataFrame, prev: DataFrame, finalized: int) -> DataFrame:
    """(number, hash) of the newest block at or above finality that is in ``prev``, or is below all of it."""
    low = prev.agg(F.min("number").alias("low"))
    live = window.filter(F.col("number") >= finalized).select("number", "hash")
    shared = live.join(prev.select("number", "hash"), ["number", "hash"])
    under = live.crossJoin(F.broadcast(low)).filter("low IS NULL OR number < low").select("number", "hash")
    return shared.unionByName(under).groupBy().agg(F.max("number").alias("number"), F.max_by("hash", "number").alias("hash")).filter("number IS NOT NULL")


def recover(own: DataFrame, prev: DataFrame) -> DataFrame:
    """A client's way back after a conflict: its newest block that the server names too."""
    return own.join(prev, ["number", "hash"]).groupBy().agg(F.max("number").alias("number"), F.max_by("hash", "number").alias("hash")).filter("number IS NOT NULL")


def compacted(window: DataFrame, most: int, finalized: int, force: bool = False) -> DataFrame:
    """The blocks that eviction leaves: the newest ``most``, and all from the finalized one on."""
    # the smallest number to stay comes from a top-k of the tasks, as one row
    least = window.select("number").orderBy(F.desc("number")).limit(most).agg(F.min("number").alias("_least"))
    keep = F.col("number") >= (F.col("_least") if force else F.least("_least", F.lit(finalized)))
    return window.crossJoin(F.broadcast(least)).filter(keep).drop("_least")


def is_ready(head: Column, observed: Column, observed_at: Column, now: Column, seconds: int = 60) -> Column:
    """Whether a service has what upstream had when it last looked, not long ago."""
    return F.coalesce((head >= observed) & (now - observed_at < seconds * 1000), F.lit(False))


def block_times(ingested: DataFrame, now: int, most: int = 1000, ttl_ms: int = 1_800_000) -> DataFrame:
    """(number, at_ms) of the newest ingests that are not too old, at most ``most``."""
    last = ingested.groupBy("number").agg(F.max("at_ms").alias("at_ms")).filter(F.col("at_ms") > now - ttl_ms)
    return last.orderBy(F.desc("at_ms"), F.desc("number")).limit(most)


def outcome_class(kind: Column, waited: Column, below: Column) -> Column:
    """window, wait_empty, backfill, conflict or error."""
    return F.when(kind == "conflict", "conflict").when(kind == "data", F.when(below, "backfill").otherwise("window")).when(kind == "empty", F.when(waited, "wait_empty").otherwise("window")).otherwise("error")


class Response:
    """The records of an answer one by one, as partitions come: the reader's pace is the job's.

    Within ``seconds``: where no record has gone out by then the answer is empty, else it is cut short; ``truncated`` names why (budget,
    error, disconnect). An error before the first record is raised, one behind it cuts the answer short.
    """

    def __init__(self, answer: Answer, column: str = "json_line", seconds: float = 60.0, clock=None):
        import time

        self.answer, self.column, self.seconds, self.clock = answer, column, seconds, clock or time.monotonic
        self.sent, self.truncated = 0, None

    @property
    def kind(self) -> str:
        """What has been answered: ``empty`` where the budget ran out before the first record."""
        return "empty" if self.answer.kind == "data" and not self.sent and self.truncated == "budget" else self.answer.kind

    def __iter__(self):
        if self.answer.kind != "data":
            return
        end = self.clock() + self.seconds
        try:
            for row in self.answer.blocks.select(self.column).toLocalIterator(prefetchPartitions=True):
                if self.clock() >= end:
                    self.truncated = "budget"
                    return
                yield row[0]
                self.sent += 1
        except GeneratorExit:
            self.truncated = "disconnect"
            raise
        except Exception:
            if not self.sent:
                raise
            self.truncated = "error"


def records(answer: Answer, column: str = "json_line", seconds: float = 60.0):
    """The records of an answer within the budget of a response."""
    return iter(Response(answer, column, seconds))
