"""Plumbing shared by the training-data operators: shared storage, Arrow slices, hashes."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most text bytes that a worker works on at once; one longer document is a slice of its own.
SLICE_BYTES = 4 << 20
_U64 = np.uint64
_TABLES: dict[int, tuple[weakref.ref, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a fresh one if all runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="blockloom-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/blockloom/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _TABLES[id(out)] = (weakref.ref(out), path)
    return out


def dealt(df: DataFrame, what: str, by: str, again: bool = True) -> DataFrame:
    """``df`` as a table in the shared folder that is bucketed by a column, so that joins on that column don't shuffle its rows.

    ``again``: whether rows still have to be dealt out by it.
    """
    spark, n = df.sparkSession, partitions(df.sparkSession)
    name = f"blockloom_{what}_{uuid.uuid4().hex}"
    rows = df.repartition(n, by) if again else df
    rows.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/blockloom/{name}").bucketBy(n, by).saveAsTable(name)
    return spark.table(name)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and nothing reads any more."""
    for df in tables:
        ref, path = _TABLES.pop(id(df), (None, None))
        if ref is not None and ref() is df:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def arrow_rows(spark: SparkSession, most: int = 1000) -> None:
    """Bounds the rows of an Arrow batch, so that one holds some MB of whole texts and not a hundred."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > most:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(most))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text each."""
    for batch in batches:
        n, col = batch.num_rows, batch.column(text)
        if batch.nbytes <= most or n <= 1:
            if n:
                yield batch
            continue
        ends = np.cumsum(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer, vectorised."""
    with np.errstate(over="ignore"):
        x = x.astype(_U64, copy=True)
        x ^= x >> _U64(33)
        x *= _U64(0xFF51AFD7ED558CCD)
        x ^= x >> _U64(33)
        x *= _U64(0xC4CEB9FE1A85EC53)
        x ^= x >> _U64(33)
    return x


def utf8(col: str = "text"):
    """UTF-8 bytes of a text column, empty for null."""
    return F.encode(F.coalesce(F.col(col), F.lit("")), "UTF-8")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of all nodes but the smallest ones, over the edges (a, b)."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least, after = np.minimum(label[x], label[y]), label.copy()
        for ends in (label[x], label[y]):
            np.minimum.at(after, ends, least)
        after = after[after]
        if (after == label).all():
            rest = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[rest], nodes[label[rest]]
        label = after


def _in_stars(most: int = 1 << 18):
    """Edges (a, b) of a task as stars (u, v), ``most`` edges at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))], ["u", "v"])

        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            n += batch.num_rows
            if n >= most:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return run


def components(edges: DataFrame, what: str, rounds: int = 40) -> DataFrame:
    """(node, component) of an undirected edge table (a, b), component being the smallest node reachable.

    Each task makes stars of its edges, then come large-star and small-star rounds over written tables of edges from a larger to a
    smaller node, until these are stars. A row moves to the smallest neighbour of its node, so no node's list of neighbours is
    ever gathered in one place; smallest neighbours are joined as a table of their own, so that Spark can split the rows of a node
    with many neighbours. Nothing but whether it is done reaches the driver.
    """
    now = written(edges.select("a", "b").filter("a <> b").mapInArrow(_in_stars(), "u long, v long").distinct(), f"{what}-edges")
    for _ in range(rounds):
        # stars: no node has two smaller neighbours, or a smaller one and a larger one
        ends = now.select(F.col("u").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(now.select(F.col("v").alias("k"), F.lit(0), F.lit(1)))
        if ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty():
            break
        least = now.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        large = now.join(least, F.col("v") == F.col("k"), "left").select("u", F.coalesce("m", "v").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(least, F.col("u") == F.col("k")).select(F.explode(F.expr("if(v = m, array(named_struct('u', u, 'm', m)), array(named_struct('u', u, 'm', m), named_struct('u', v, 'm', m)))")).alias("x"))
        after = written(small.select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).distinct(), f"{what}-star")
        discard(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
