"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations alone.

The ring has ``CELLS`` cells; the hash of a row's id and checksum gives its cell. ``VIRTUAL`` nodes of each shard stand at
hashed cells and serve the arc that ends there. A shard takes n/shards rows (rounded so that all add up to n); of those that
hash to it, the first in its own order stay, and the others continue clockwise: they queue along the ring, and each node whose
shard has room takes from the queue's head. Law: ``rows``: counts are at most one apart, whatever the hashes.

All of it but one numbering of the rows within their cells happens in tables of at most ``CELLS`` rows: counts of cells,
loads of shards, and a fold over the ring's nodes (two laps, after which the queue is empty) that lists which stretch of the
queue each node takes. A row's shard and slot follow from its rank by arithmetic. When a shard is added, rows move from arcs
that it takes over, and from where the bound is now lower; all others stay.

Null texts have 0 bytes and CRC 0, a null id hashes as its own value. Ties are ordered by id, size and checksum; rows alike in
all three are interchangeable. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Cells of the ring and virtual nodes of a shard: fixed, so every table made from them is bounded whatever the input.
CELLS, VIRTUAL, ROW_BYTES = 16_384, 64, 8
_WIDE = 2**48 // CELLS


def _place(key: str) -> str:
    return f"cast(conv(substr(md5({key}), 1, 12), 16, 10) AS bigint)"


def ring_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body).alias("crc"))
    rows = rows.withColumn("place", F.expr(_place("concat('key/', coalesce(cast(id AS string), 'null'), '/', crc)"))).withColumn("cell", F.expr(f"place DIV {_WIDE}"))
    cells = _cells(written(rows.groupBy("cell").agg(F.count("*").alias("n")), "ring-totals"), shards)
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("place", "id", "size", "crc")) - 1
    # at most CELLS rows
    out = rows.withColumn("rank", rank).join(F.broadcast(cells), "cell").withColumn("rank", F.col("rank") + F.col("prefix"))
    out = out.withColumn("y", F.col("queued") + F.col("rank") - F.greatest("room", "prefix"))
    out = out.withColumn("lot", F.when(F.col("rank") >= F.col("room"), F.expr("filter(lots, l -> l.lo <= y AND y < l.hi)[0]")))
    return out.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.coalesce("lot.shard", "home").cast("int").alias("shard"),
        F.coalesce(F.col("lot.base") + F.col("y") - F.col("lot.lo"), F.col("rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _cells(totals: DataFrame, shards: int) -> DataFrame:
    """Of each cell: its home shard with its room, the shard's rows in cells before it, where its overflow begins in the queue,
    and the stretches (shard, lo, hi, first slot) of the queue that its overflow falls into."""
    spark = totals.sparkSession
    ring = spark.range(0, CELLS, 1, 1).select(F.col("id").alias("cell")).join(totals, "cell", "left").fillna(0, ["n"])
    nodes = spark.range(0, shards * VIRTUAL, 1, 1).selectExpr(f"cast(id DIV {VIRTUAL} AS int) AS shard", f"id % {VIRTUAL} AS v")
    nodes = nodes.withColumn("at", F.expr(f"{_place("concat('node/', shard, '/', v)")} DIV {_WIDE}"))
    nodes = nodes.groupBy("at").agg(F.min("shard").alias("shard"))  # one node a cell
    ring = ring.join(F.broadcast(nodes), F.col("cell") == F.col("at"), "left")
    node = F.last(F.when(F.col("at").isNotNull(), F.struct("at", "shard")), ignorenulls=True)
    ahead = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a running frame, in one pass
    lead = nodes.agg(F.min(F.struct("at", "shard")).alias("lead"))  # cells behind the last node belong to the first
    ring = ring.withColumn("node", node.over(ahead)).crossJoin(F.broadcast(lead)).withColumn("node", F.coalesce("node", "lead"))
    ring = ring.select("cell", "n", F.col("node.at").alias("at"), F.col("node.shard").alias("home"))
    whole = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("whole"))
    ring = ring.crossJoin(F.broadcast(whole)).withColumn("room", F.expr(f"whole DIV {shards} + if(home < whole % {shards}, 1, 0)"))
    # a shard's own order of its cells is hashed, so that what it can't take comes from all over the ring
    ring = ring.withColumn("prefix", F.sum("n").over(Window.partitionBy("home").orderBy(F.md5(F.col("cell").cast("string")), "cell")) - F.col("n"))
    ring = ring.withColumn("over", F.greatest(F.lit(0), F.least("n", F.col("prefix") + F.col("n") - F.col("room"))).cast("long"))
    # the queue's order: along the ring from its first node on; cells behind the last node come first, at the first node
    turn = F.when(F.col("cell") > F.col("at"), F.col("cell") - CELLS).otherwise(F.col("cell"))
    ring = ring.withColumn("turn", turn).withColumn("queued", F.sum("over").over(Window.orderBy("turn")) - F.col("over"))

    ring = written(ring.coalesce(1), "ring")
    loads = ring.groupBy("home").agg(F.sum("n").alias("load"), F.first("room").alias("room"))
    every = spark.range(0, shards, 1, 1).select(F.col("id").cast("int").alias("shard")).crossJoin(F.broadcast(whole))
    every = every.join(loads.select(F.col("home").alias("shard"), "load"), "shard", "left").fillna(0, ["load"])
    every = every.withColumn("spare", F.expr(f"greatest(0L, whole DIV {shards} + if(shard < whole % {shards}, 1, 0) - load)"))
    rooms = every.agg(F.expr("transform(array_sort(collect_list(struct(shard, spare))), x -> x.spare)").alias("spare"), F.expr("transform(array_sort(collect_list(struct(shard, load))), x -> x.load)").alias("load"))
    stops = ring.groupBy("at", "home").agg(F.sum("over").alias("over")).agg(F.expr("array_sort(collect_list(struct(at, home, over)))").alias("stops"))
    # a step: what has queued up to this node, what its shard takes of it, and, only if it takes any, the new tables
    fold = """
        aggregate(sequence(0, 2 * size(stops) - 1),
          named_struct('carry', 0L, 'spare', spare, 'slot', load, 'done', 0L, 'lots', cast(array() AS array<struct<shard: int, lo: bigint, hi: bigint, base: bigint>>)),
          (a, i) -> transform(array(named_struct('home', stops[i % size(stops)].home, 'queue', a.carry + if(i < size(stops), stops[i].over, 0L))), s ->
            transform(array(least(s.queue, a.spare[s.home])), t -> if(t = 0, named_struct('carry', s.queue, 'spare', a.spare, 'slot', a.slot, 'done', a.done, 'lots', a.lots),
              named_struct(
                'carry', s.queue - t,
                'spare', transform(a.spare, (x, k) -> if(k = s.home, x - t, x)),
                'slot', transform(a.slot, (x, k) -> if(k = s.home, x + t, x)),
                'done', a.done + t,
                'lots', concat(a.lots, array(named_struct('shard', s.home, 'lo', a.done, 'hi', a.done + t, 'base', a.slot[s.home]))))))[0])[0],
          a -> a.lots)"""
    lots = written(stops.crossJoin(F.broadcast(rooms)).select(F.explode(F.expr(fold)).alias("l")), "ring-lots")
    # a stretch is a node's: at most two for each node of the ring
    met = ring.filter("`over` > 0").join(F.broadcast(lots), F.expr("l.lo < queued + `over` AND l.hi > queued")).groupBy("cell").agg(F.collect_list("l").alias("lots"))
    return ring.join(F.broadcast(met), "cell", "left").select("cell", "home", "room", "prefix", "queued", "lots")
