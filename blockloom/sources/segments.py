"""Stored chains: Parquet segments that a log of commits names, with the heights each one holds.

A task writes segments and reports them with their heights; the driver names all of them in one log entry once every task is done.
Nothing reads a segment that no entry names, so what a killed task, a failed job or a second attempt left is never seen. An entry of a
stream carries its batch, and a batch that is run again adds nothing. An entry may *rewind*: it replaces what was stored at and above
its lowest height, as a reorganised chain does. Entries' names hold their heights, so a range opens only the entries and segments it needs.

A store has one writer at a time. Every ``FOLD`` commits the log becomes one entry.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

#: Rows of a segment, bytes gathered for a row group, commits before the log is folded.
ROWS, GROUP_BYTES, FOLD = 100_000, 16 << 20, 100


@dataclass
class Segment:
    """A file with its lowest and highest height and its rows; only heights below ``until`` still count, where it is set."""

    name: str
    low: int
    high: int
    rows: int
    until: int | None = None

    def cut(self, at: int | None) -> Segment:
        return self if at is None else Segment(self.name, self.low, self.high, self.rows, at if self.until is None else min(at, self.until))

    @property
    def top(self) -> int:
        return self.high if self.until is None else min(self.high, self.until - 1)


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote."""

    segments: list[Segment] = field(default_factory=list)


@dataclass
class Entry:
    """A commit, as its file's name tells it: number, heights, the height it rewinds to, the stream's name and batch."""

    seq: int
    low: int
    high: int
    rewind: int | None
    writer: str
    batch: int
    folded: bool = False

    @property
    def name(self) -> str:
        at = "" if self.rewind is None else self.rewind
        return f"{self.seq:012d}_{self.low}_{self.high}_{at}_{self.batch}_{'fold' if self.folded else 'one'}_{self.writer}.json"

    @classmethod
    def of(cls, name: str) -> Entry:
        seq, low, high, at, batch, kind, writer = name.removesuffix(".json").split("_", 6)
        return cls(int(seq), int(low), int(high), int(at) if at else None, writer, int(batch), kind == "fold")


class Store:
    """A store's files, on any file system that Arrow reaches by the path's scheme."""

    def __init__(self, path: str):
        path = path.rstrip("/")
        self.path = "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
        self.fs, self.base = fs.FileSystem.from_uri(self.path)

    def write(self, batches: Iterator[pa.RecordBatch], rows: int) -> list[Segment]:
        """Segments of at least ``rows`` and less than twice as many rows but for a task's last; holds one row group at a time."""
        out: list[Segment] = []
        sink, held, size = None, [], 0

        def flush() -> None:
            nonlocal sink, held, size
            if not held:
                return
            group = pa.Table.from_batches(held)
            if sink is None:
                self.fs.create_dir(f"{self.base}/data", recursive=True)
                out.append(Segment(f"{uuid.uuid4().hex}.parquet", 1 << 62, -1, 0))
                sink = pq.ParquetWriter(f"{self.base}/data/{out[-1].name}", group.schema, filesystem=self.fs, compression="zstd")
            sink.write_table(group)
            heights, last = pc.min_max(group["number"]).as_py(), out[-1]
            last.low, last.high, last.rows = min(last.low, heights["min"]), max(last.high, heights["max"]), last.rows + group.num_rows
            held, size = [], 0
            if last.rows >= rows:
                sink.close()
                sink = None

        try:
            for batch in batches:
                if batch.column("number").null_count:
                    raise ValueError("a stored block needs a height")
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    held, size = [*held, part], size + part.nbytes
                    if size >= GROUP_BYTES or sum(b.num_rows for b in held) >= rows:
                        flush()
            flush()
        finally:
            if sink is not None:
                sink.close()
        return [s for s in out if s.rows]

    def remove(self, segments: list[Segment]) -> None:
        for s in segments:
            self.fs.delete_file(f"{self.base}/data/{s.name}")

    def entries(self) -> list[Entry]:
        """The log in order, from its last fold on."""
        found = self.fs.get_file_info(fs.FileSelector(f"{self.base}/log", allow_not_found=True))
        log = sorted((Entry.of(f.base_name) for f in found if f.base_name[0].isdigit()), key=lambda e: (e.seq, e.folded))
        last = max((e.seq for e in log if e.folded), default=-1)
        return [e for e in log if e.seq > last or (e.seq == last and e.folded)]

    def content(self, entry: Entry) -> dict:
        with self.fs.open_input_stream(f"{self.base}/log/{entry.name}") as f:
            return json.loads(f.read())

    def put(self, entry: Entry, content: dict) -> None:
        """The entry appears whole or not at all."""
        self.fs.create_dir(f"{self.base}/log", recursive=True)
        draft = f"{self.base}/log/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps(content).encode())
        self.fs.move(draft, f"{self.base}/log/{entry.name}")

    def commit(self, segments: list[Segment], schema: str, writer: str, batch: int, rewind: bool, overwrite: bool = False) -> None:
        log = self.entries()
        if batch >= 0 and self._last(log, writer) >= batch:
            self.remove(segments)
            return
        low, high = min((s.low for s in segments), default=-1), max((s.high for s in segments), default=-1)
        at = 0 if overwrite else low if rewind and segments else None
        entry = Entry(log[-1].seq + 1 if log else 0, low, high, at, writer, batch)
        self.put(entry, {"schema": schema, "segments": [vars(s) for s in segments]})
        if len(log) + 1 >= FOLD:
            self.fold()

    def _last(self, log: list[Entry], writer: str) -> int:
        own = [e.batch for e in log if e.writer == writer and not e.folded]
        return max([*own, *[self.content(e)["writers"].get(writer, -1) for e in log if e.folded]], default=-1)

    def segments(self, low: int | None = None, high: int | None = None, log: list[Entry] | None = None) -> list[Segment]:
        """What is stored of heights from ``low`` to ``high``; entries wholly outside aren't opened."""
        out: list[Segment] = []
        cut = None
        for e in reversed(self.entries() if log is None else log):
            top = e.high if cut is None else min(e.high, cut - 1)
            if (low is None or top >= low) and (high is None or e.low <= high) and e.low <= top:
                own = [Segment(**s).cut(cut) for s in self.content(e)["segments"]]
                out += [s for s in own if s.low <= s.top and (low is None or s.top >= low) and (high is None or s.low <= high)]
            if e.rewind is not None:
                cut = e.rewind if cut is None else min(cut, e.rewind)
        return sorted(out, key=lambda s: (s.low, s.name))

    def fold(self) -> None:
        """One entry in place of all: segments that still count, and how far each stream is."""
        log = self.entries()
        if not log:
            return
        writers: dict[str, int] = {}
        for e in log:
            for name, batch in (self.content(e)["writers"] if e.folded else {e.writer: e.batch}).items():
                writers[name] = max(batch, writers.get(name, -1))
        left = self.segments(log=log)
        entry = Entry(log[-1].seq, min((s.low for s in left), default=-1), max((s.high for s in left), default=-1), None, "all", -1, True)
        self.put(entry, {"schema": self.content(log[-1])["schema"], "segments": [vars(s) for s in left], "writers": {w: b for w, b in writers.items() if b >= 0}})
        for e in log:
            if e.name != entry.name:
                self.fs.delete_file(f"{self.base}/log/{e.name}")

    def vacuum(self, seconds: float = 86_400) -> int:
        """Deletes files older than that which no entry names, or of which nothing counts any more; how many."""
        kept, gone = {s.name for s in self.segments()}, 0
        for f in self.fs.get_file_info(fs.FileSelector(f"{self.base}/data", allow_not_found=True)):
            if f.base_name not in kept and f.mtime.timestamp() <= time.time() - seconds:
                self.fs.delete_file(f.path)
                gone += 1
        return gone


class _Writer:
    def __init__(self, options: dict, schema: T.StructType, rewind: str, overwrite: bool):
        if "number" not in schema.fieldNames():
            raise ValueError("stored blocks need a column number")
        if "/" in options.get("writer", ""):
            raise ValueError("a writer's name is part of a file's")
        self.path, self.rows, self.schema = options["path"], int(options.get("rows", ROWS)), schema.json()
        self.rewind, self.overwrite, self.writer = options.get("rewind", rewind) == "true", overwrite, options.get("writer", "main")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return Written(Store(self.path).write(iterator, self.rows))

    def commit(self, messages: list[Written | None], batchId: int = -1) -> None:
        Store(self.path).commit(_all(messages), self.schema, self.writer, batchId, self.rewind, self.overwrite)

    def abort(self, messages: list[Written | None], batchId: int = -1) -> None:
        Store(self.path).remove(_all(messages))


def _all(messages: list[Written | None]) -> list[Segment]:
    return [s for m in messages if m is not None for s in m.segments]


class SegmentWriter(_Writer, DataSourceArrowWriter):
    pass


class SegmentStreamWriter(_Writer, DataSourceStreamArrowWriter):
    pass


class SegmentSink(DataSource):
    """``write.format("block_segments")`` and ``writeStream``: rows with a height ``number`` and any other columns.

    Options: path, rows (of a segment), rewind (batches append unless it is true; streams rewind unless it is false), writer (a stream's
    name, where several feed one store in turn). Mode overwrite replaces all in the same commit. Appending doesn't look for heights that
    are stored already.
    """

    @classmethod
    def name(cls) -> str:
        return "block_segments"

    def writer(self, schema: T.StructType, overwrite: bool) -> SegmentWriter:
        return SegmentWriter(dict(self.options), schema, "false", overwrite)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> SegmentStreamWriter:
        return SegmentStreamWriter(dict(self.options), schema, "true", False)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SegmentSink)


def store(blocks: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Writes blocks by ranges of heights, so that each segment holds a range of its own."""
    register(blocks.sparkSession)
    rows = blocks.repartitionByRange("number").sortWithinPartitions("number")
    rows.write.format("block_segments").options(path=path, **options).mode(mode).save()


def held(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The stored blocks of a range, read by Spark's own scan from the segments that hold any of it.

    Segments cut by a rewind are scanned apart, those of one cut together.
    """
    own = Store(path)
    log = own.entries()
    if not log:
        raise ValueError(f"nothing is stored at {path}")
    schema = T.StructType.fromJson(json.loads(own.content(log[-1])["schema"]))
    cuts: dict[int | None, list[str]] = {}
    for s in own.segments(low, high, log):
        cuts.setdefault(s.until if s.until is not None and s.until <= s.high else None, []).append(f"{own.path}/data/{s.name}")
    parts = [spark.read.schema(schema).parquet(*names).filter(F.lit(True) if at is None else F.col("number") < at) for at, names in sorted(cuts.items(), key=lambda c: (c[0] is not None, c[0]))]
    out = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)
    out = out if low is None else out.filter(F.col("number") >= low)
    return out if high is None else out.filter(F.col("number") <= high)


def suffix(spark: SparkSession, path: str, window: DataFrame, start: int) -> DataFrame:
    """(the window's columns) blocks from ``start``: the window's, and below its first what the store holds."""
    first = window.agg(F.min("number")).first()[0]
    below = held(spark, path, start, None if first is None else first - 1).select(window.columns)
    return below.unionByName(window.filter(F.col("number") >= start))
