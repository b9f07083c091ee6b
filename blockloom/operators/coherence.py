"""Coherence of a block's components, as columns: each check adds a reason, one order of precedence decides.

Tables: ``blocks`` (chain_id, number, hash, logs_bloom, tx_count), ``transactions`` (.., tx, tx_hash), ``receipts`` (.., tx,
tx_hash, block_hash, gas_used, cumulative_gas), ``logs`` (.., block_hash, log_index, tx_hash). Checks aggregate by block with
map-side combine, so a block with many rows isn't gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions.quantities import is_zero_bloom

KEYS = ["chain_id", "number"]
LEVELS = {"invalid": 3, "not ready": 2, "contested": 1}


def mark(level: Column) -> dict[str, Column]:
    """Flags of a level of incoherence; a higher one is never lowered by another check."""
    return {"is_invalid": level == 3, "is_not_ready": level == 2, "header_contested": level == 1, "coherent": level == 0}


def verdict(blocks: DataFrame, *found: DataFrame) -> DataFrame:
    """``blocks`` with the flags and reason of the gravest of the (chain_id, number, level, rank, reason) rows found.

    Of one level, the check with the lowest rank speaks first, whatever order the rows come in.
    """
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    worst = rows.groupBy(*KEYS).agg(F.max_by(F.struct("level", "reason"), F.struct("level", -F.col("rank"))).alias("v"))
    out = blocks.join(worst, KEYS, "left").withColumn("_l", F.coalesce("v.level", F.lit(0)))
    return out.select(*blocks.columns, *[c.alias(n) for n, c in mark(F.col("_l")).items()], F.col("v.reason").alias("reason"))


def _found(df: DataFrame, level: str, rank: int, reason: Column | str) -> DataFrame:
    text = F.lit(reason) if isinstance(reason, str) else reason
    return df.select(*KEYS, F.lit(LEVELS[level]).alias("level"), F.lit(rank).alias("rank"), text.alias("reason"))


def log_index_gaps(logs: DataFrame) -> DataFrame:
    """Blocks whose log indexes aren't 0 to n-1: by count, extremes and distinct values, without an order."""
    per = logs.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("log_index").alias("lo"), F.max("log_index").alias("hi"), F.countDistinct("log_index").alias("d"))
    return _found(per.filter("lo <> 0 OR hi <> n - 1 OR d <> n"), "invalid", 10, "log indexes are not sequential")


def cumulative_gas_breaks(receipts: DataFrame) -> DataFrame:
    """(.., tx): receipts whose running gas isn't that of the one before plus their own; null gas breaks too.

    Sums are decimal(38,0); one that overflows is a break.
    """
    w = Window.partitionBy(*KEYS).orderBy("tx")
    gas, total = F.col("gas_used").cast("decimal(38,0)"), F.col("cumulative_gas").cast("decimal(38,0)")
    want = F.try_add(F.coalesce(F.lag(total).over(w), F.lit(0).cast("decimal(38,0)")), gas)
    return receipts.withColumn("_ok", F.coalesce(total == want, F.lit(False))).filter(~F.col("_ok")).drop("_ok")


def gas_issues(receipts: DataFrame) -> DataFrame:
    return _found(cumulative_gas_breaks(receipts).select(*KEYS).distinct(), "invalid", 20, "cumulative gas does not add up")


def receipt_gates(blocks: DataFrame, receipts: DataFrame) -> DataFrame:
    """Receipts of another block contest the header; fewer or more than the transactions are not ready yet."""
    # counted by hash before anything is joined: a block has one row, or a few where hashes differ
    per = receipts.groupBy(*KEYS, F.lower("block_hash").alias("_b")).agg(F.count("block_hash").alias("_n"))
    joined = blocks.select(*KEYS, F.lower("hash").alias("_h"), "tx_count").join(per, KEYS, "left")
    per = joined.groupBy(*KEYS, "tx_count").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.bool_or(F.col("_b") != F.col("_h")), F.lit(False)).alias("foreign"))
    short = _found(per.filter("n <> tx_count"), "not ready", 5, F.concat(F.lit("receipts: "), "n", F.lit(" of "), "tx_count"))
    return short.unionByName(_found(per.filter("foreign"), "contested", 1, "receipts of another block"))


def bloom_without_logs(blocks: DataFrame, logs: DataFrame) -> DataFrame:
    """Blocks whose filter isn't empty although no log came."""
    return _found(blocks.filter(~is_zero_bloom("logs_bloom")).join(logs.select(*KEYS).distinct(), KEYS, "left_anti"), "not ready", 6, "no logs under a filter that isn't empty")


def logs_of_blocks(blocks: DataFrame, logs: DataFrame) -> DataFrame:
    """Logs that name a block's hash exactly; all others leave."""
    return logs.join(blocks.select("chain_id", F.col("hash").alias("block_hash"), F.col("number").alias("block_number")), ["chain_id", "block_hash"])


def with_receipts(transactions: DataFrame, receipts: DataFrame) -> DataFrame:
    """Transactions with the receipt at their place, null where there is none."""
    return transactions.join(receipts.select(*KEYS, "tx", *[F.col(c).alias(f"receipt_{c}") for c in receipts.columns if c not in (*KEYS, "tx")]), [*KEYS, "tx"], "left")


def receipts_by_hash(transactions: DataFrame, receipts: DataFrame) -> DataFrame:
    """The fallback where a source gives receipts one by one: joined by transaction hash."""
    return transactions.join(receipts.drop("tx", "number"), ["chain_id", "tx_hash"], "left")


def numbered_logs(logs: DataFrame) -> DataFrame:
    """Logs of receipts, numbered from 0 within their block in order of (tx, log)."""
    return logs.withColumn("log_index", (F.row_number().over(Window.partitionBy(*KEYS).orderBy("tx", "log")) - 1).cast("long"))


def unmatched_labels(entries: DataFrame, transactions: DataFrame, tolerate_gaps: bool = False) -> DataFrame:
    """Transactions without an entry that names them (none where gaps are tolerated); entries that name others are ignored."""
    named = entries.select(*KEYS, F.lower("tx_hash").alias("_h")).distinct()
    gaps = transactions.withColumn("_h", F.lower("tx_hash")).join(named, [*KEYS, "_h"], "left_anti").drop("_h")
    return gaps.limit(0) if tolerate_gaps else gaps


def _ranked(order: int, reason: str) -> Column:
    return F.struct(F.lit(order).alias("o"), F.lit(reason).alias("r"))


def replay_issues(transactions: DataFrame, replays: DataFrame) -> DataFrame:
    """Per block: replays that are missing, come twice, or belong to another block's transaction, in this order."""
    a = transactions.select(*KEYS, F.lower("tx_hash").alias("_h"), F.lit(1).alias("_t"))
    b = replays.groupBy(*KEYS, F.lower("tx_hash").alias("_h")).agg(F.count("*").alias("_n"))
    full = a.join(b, [*KEYS, "_h"], "full_outer")
    issue = F.when(F.col("_n").isNull(), _ranked(1, "missing replay")).when(F.col("_t").isNull(), _ranked(3, "foreign replay")).when(F.col("_n") > 1, _ranked(2, "duplicate replay"))
    bad = full.withColumn("_i", issue).filter("_i IS NOT NULL").groupBy(*KEYS).agg(F.min("_i").alias("_i"))
    return _found(bad, "invalid", 30, F.col("_i.r"))


def grouped_frames(frames: DataFrame) -> DataFrame:
    """Flat frames by transaction: groups in order of their first frame, frames in order of ``place``."""
    per = frames.groupBy(*KEYS, "tx_hash").agg(F.min("place").alias("first"), F.count("*").alias("frames"), F.sort_array(F.collect_list("place")).alias("places"))
    return per.withColumn("tx", (F.row_number().over(Window.partitionBy(*KEYS).orderBy("first", "tx_hash")) - 1).cast("long"))


def flat_frame_issues(blocks: DataFrame, transactions: DataFrame, frames: DataFrame) -> DataFrame:
    """Blocks whose flat frames name another block, miss a transaction, or name one that isn't there."""
    # counted by hash before anything is joined: a block has one row, or a few where hashes differ
    named = frames.groupBy(*KEYS, F.lower("block_hash").alias("_b")).agg(F.lit(True).alias("_any"))
    foreign = named.join(blocks.select(*KEYS, F.lower("hash").alias("_h")), KEYS).filter("_b <> _h OR _b IS NULL").select(*KEYS).distinct()
    own, txs = (df.select(*KEYS, F.lower("tx_hash").alias("_t")).distinct().withColumn(there, F.lit(True)) for df, there in ((frames, "_own"), (transactions, "_tx")))
    # both ways at once
    alone = txs.join(own, [*KEYS, "_t"], "full_outer").filter("_own IS NULL OR _tx IS NULL AND _t IS NOT NULL").select(*KEYS, F.col("_own").isNull().alias("_missing")).distinct()
    level, rank, reason = (F.when(F.col("_missing"), a).otherwise(b) for a, b in ((F.lit(LEVELS["not ready"]), F.lit(LEVELS["invalid"])), (F.lit(7), F.lit(31)), (F.lit("a transaction has no frames"), F.lit("frames of an unknown transaction"))))
    return _found(foreign, "contested", 1, "frames of another block").unionByName(alone.select(*KEYS, level.alias("level"), rank.alias("rank"), reason.alias("reason")))


def state_changes(pre: DataFrame, post: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Full outer join of two states: kind is + for new, - for gone, * for changed, = for the same."""
    both = pre.withColumnRenamed(value, "prev").join(post.withColumnRenamed(value, "next"), keys, "full_outer")
    kind = F.when(F.col("prev").isNull() & F.col("next").isNull(), "=").when(F.col("prev").isNull(), "+").when(F.col("next").isNull(), "-").when(F.col("prev") == F.col("next"), "=").otherwise("*")
    return both.withColumn("kind", kind)


def missing_components(requested: Column, present: Column) -> Column:
    """Requested components that aren't there, in the order of the request."""
    return F.array_except(requested, present)


def exempt(rows: DataFrame, networks: DataFrame, quirk: str, when: Column) -> DataFrame:
    """Rows less those that a network's deviation exempts; the registry is a fixed handful of rows."""
    joined = rows.join(F.broadcast(networks.select("chain_id", "quirks")), "chain_id", "left")
    return joined.filter(~(F.coalesce(F.array_contains("quirks", quirk), F.lit(False)) & F.coalesce(when, F.lit(False)))).drop("quirks")


def validate_options(options: dict) -> list[str]:
    """What is wrong with a set of verification options."""
    out = []
    if options.get("call_frames") not in (None, "off", "observe", "reject"):
        out.append(f"unknown call frame mode {options['call_frames']}")
    if options.get("call_frames") == "reject" and not (options.get("verify_tx_root") and options.get("verify_sender")):
        out.append("rejecting call frames needs the transactions root and the senders verified")
    if options.get("gas_used_receipts") and not options.get("verify_receipts_root"):
        out.append("the gas-used form needs the receipts root verified")
    if options.get("verify_receipts_root") and not options.get("with_receipts"):
        out.append("the receipts root needs receipts")
    return out
