"""Registered queries of the library's own operators over the driver's tables, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.functions import quantities as q
from blockloom.functions.networks import network_table
from blockloom.operators import coherence as co
from blockloom.operators import linkage as li
from blockloom.plans import metrics as me
from blockloom.plans import queries as qu
from blockloom.plans import parts, records, stored
from blockloom.plans.views import blocks, bundles, events, oracle, transactions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add


def _tx_blocks(s: SparkSession, d: str) -> DataFrame:
    """Blocks with the number of transactions that they claim: one more than there are where the parent is wrong."""
    n = transactions(s, d).groupBy("chain_id", "number").agg(F.count("*").alias("n"))
    return blocks(s, d).join(n, ["chain_id", "number"], "left").withColumn("tx_count", F.coalesce("n", F.lit(0)) + F.when(F.col("key") % 13 == 5, 1).otherwise(0)).drop("n")


# -- windows, watermarks, ranges --------------------------------------------------------------------------------------


@_register("SELECT chain_id, number, hash, parent_hash FROM blk WHERE number >= 100")
def window_suffix(s, d):
    return qu.suffix(blocks(s, d), 100).select("chain_id", "number", "hash", "parent_hash")


@_register("SELECT min(key) AS first_number, max(key) AS head_number, md5('b' || max(key)) AS head_hash, max(CASE WHEN key <= 120 THEN key END) AS finalized_number FROM blk")
def watermarks(s, d):
    w = qu.watermarks(blocks(s, d).select(F.col("key").alias("number"), "hash"), 120)
    return w.select(F.col("first.number").alias("first_number"), F.col("head.number").alias("head_number"), F.col("head.hash").alias("head_hash"), F.col("finalized.number").alias("finalized_number"))


@_register("SELECT key AS number, hash FROM blk WHERE key = (SELECT greatest(max(key) - 64, 0) FROM blk)")
def offset_finality(s, d):
    return qu.offset_finality(blocks(s, d).select(F.col("key").alias("number"), "hash"), 64)


@_register("SELECT chain_id, number, hash FROM blk WHERE key <= (SELECT greatest(max(key) - 64, 0) FROM blk)")
def finalized_batch(s, d):
    b = blocks(s, d)
    known = qu.offset_finality(b.select(F.col("key").alias("number"), "hash"), 64).first().number
    return qu.finalized_batch(b.drop("number").withColumnRenamed("key", "number"), known).join(b.select(F.col("key").alias("k"), F.col("number").alias("height")), F.col("number") == F.col("k")).select("chain_id", F.col("height").alias("number"), "hash")


@_register("SELECT key AS number, hash FROM blk ORDER BY key DESC LIMIT 100")
def compact_window(s, d):
    return qu.compacted(blocks(s, d).select(F.col("key").alias("number"), "hash"), 100, 0, True)


@_register("SELECT key - 1 AS number, parent_hash AS hash FROM blk WHERE key <= 700 AND key > 0 ORDER BY key DESC LIMIT 101")
def conflict_prev(s, d):
    b = blocks(s, d).select(F.col("key").alias("number"), "hash", F.greatest(F.col("key") - 1, F.lit(0)).alias("parent_number"), "parent_hash")
    return s.createDataFrame(qu.conflict_refs(b, 700), "number long, hash string")


@_register("SELECT max(b.key) AS number, max_by(b.hash, b.key) AS hash FROM blk b JOIN (SELECT key, parent_hash FROM blk) p ON b.hash = p.parent_hash AND b.key = p.key - 1")
def fork_base(s, d):
    b = blocks(s, d)
    prev = b.filter("key > 0").select((F.col("key") - 1).alias("number"), F.col("parent_hash").alias("hash"))
    return qu.fork_base(b.select(F.col("key").alias("number"), "hash"), prev, 0)


@_register("SELECT max(b.key) AS number, max_by(b.hash, b.key) AS hash FROM blk b JOIN blk p ON b.hash = p.parent_hash AND b.key = p.key - 1")
def client_recovery(s, d):
    b = blocks(s, d)
    return qu.recover(b.select(F.col("key").alias("number"), "hash"), b.select((F.col("key") - 1).alias("number"), F.col("parent_hash").alias("hash")))


@_register("SELECT chain_id, key AS number, hash FROM blk")
def backfill_union(s, d):
    b = blocks(s, d).select("chain_id", F.col("key").alias("number"), "hash", F.greatest(F.col("key") - 1, F.lit(0)).alias("parent_number"), F.md5(F.concat(F.lit("b"), F.col("key") - 1)).alias("parent_hash"))
    return qu.backfill(b.filter("number < 500"), b.filter("number >= 500"), 0).select("chain_id", "number", "hash")


# -- linkage ----------------------------------------------------------------------------------------------------------


@_register("SELECT chain_id, count(*) FILTER (NOT ok) AS breaks, count(*) AS blocks FROM (SELECT chain_id, coalesce(lag(number) OVER w = parent_number AND lag(hash) OVER w = parent_hash, lag(number) OVER w IS NULL) AS ok FROM blk WINDOW w AS (PARTITION BY chain_id ORDER BY number, hash)) GROUP BY chain_id")
def linkage_breaks(s, d):
    return li.with_breaks(blocks(s, d)).groupBy("chain_id").agg(F.count(F.when(~F.col("linked"), 1)).alias("breaks"), F.count("*").alias("blocks"))


@_register("SELECT b.chain_id, b.number, b.hash, EXISTS (SELECT 1 FROM blk p WHERE p.chain_id = b.chain_id AND p.number = b.parent_number AND p.hash = b.parent_hash) AS linked FROM blk b")
def linked_by_join(s, d):
    return li.with_breaks_by_join(blocks(s, d)).select("chain_id", "number", "hash", "linked")


@_register("SELECT chain_id, number, hash FROM (SELECT *, max(bad) OVER (PARTITION BY chain_id ORDER BY number) AS broken FROM (SELECT *, CASE WHEN lag(hash) OVER (PARTITION BY chain_id ORDER BY number) <> parent_hash THEN 1 ELSE 0 END AS bad FROM blk)) WHERE broken = 0")
def linked_prefix(s, d):
    return li.linked_prefix(blocks(s, d)).select("chain_id", "number", "hash")


@_register("SELECT chain_id, min(number) - 1 AS number, min_by(parent_hash, number) AS hash FROM (SELECT *, lag(number) OVER w AS pn, lag(hash) OVER w AS ph FROM blk WINDOW w AS (PARTITION BY chain_id ORDER BY number, hash)) WHERE pn IS NOT NULL AND NOT (pn = parent_number AND ph = parent_hash) GROUP BY chain_id")
def fork_signals(s, d):
    return li.fork_signals(blocks(s, d))


def _one_chain(s, d):
    """All blocks as one chain, by key."""
    b = blocks(s, d)
    return b.select(F.lit(0).alias("chain_id"), F.col("key").alias("number"), "hash", F.when(F.col("key") % 11 == 3, F.col("key") - 2).otherwise(F.col("key") - 1).alias("parent_number"), "parent_hash")


_ONE = "SELECT key AS number, hash, CASE WHEN key % 11 = 3 THEN key - 2 ELSE key - 1 END AS parent_number, parent_hash FROM blk"


@_register(f"SELECT number, hash, coalesce(lag(number) OVER w = parent_number AND lag(hash) OVER w = parent_hash, lag(number) OVER w IS NULL) AS linked FROM ({_ONE}) WINDOW w AS (ORDER BY number, hash)")
def whole_chain_links(s, d):
    return li.with_breaks(_one_chain(s, d)).select("number", "hash", "linked")


@_register("SELECT pos, amount AS number, max(amount) OVER w AS highest, amount < max(amount) OVER w AS regressive FROM ev WINDOW w AS (ORDER BY pos)")
def whole_chain_finality(s, d):
    r = events(s, d).select(F.lit(0).alias("chain_id"), "pos", F.col("amount").alias("number"), F.lit("h").alias("hash"))
    return li.running_finality(r).select("pos", "number", "highest", "regressive")


@_register("SELECT number, hash FROM (SELECT *, max(bad) OVER (ORDER BY number) AS broken FROM (SELECT *, CASE WHEN lag(lower(hash)) OVER w <> lower(parent_hash) OR lag(number) OVER w + 1 <> number THEN 1 ELSE 0 END AS bad FROM (SELECT key AS number, hash, CASE WHEN key = (SELECT max(key) // 2 FROM blk) THEN 'x' ELSE upper(md5('b' || (key - 1))) END AS parent_hash FROM blk) WINDOW w AS (ORDER BY number))) WHERE broken = 0")
def whole_chain_prefix(s, d):
    b = blocks(s, d)
    half = b.agg(F.expr("max(key) DIV 2").alias("_half"))  # one row
    b = b.crossJoin(F.broadcast(half)).select(F.lit(0).alias("chain_id"), F.col("key").alias("number"), "hash", F.when(F.col("key") == F.col("_half"), "x").otherwise(F.upper(F.md5(F.concat(F.lit("b"), F.col("key") - 1)))).alias("parent_hash"))
    return li.linked_prefix(b, ignore_case=True, contiguous=True).select("number", "hash")


#: Blocks of chains of a thousand, and a side branch of ten from each fortieth of fifty.
_FORKED = """, forked AS (
  SELECT chain_id, key AS number, hash, key - 1 AS parent_number, md5('b' || (key - 1)) AS parent_hash FROM blk
  UNION ALL SELECT chain_id, key, md5('f' || key), key - 1, md5((CASE WHEN key % 50 = 40 THEN 'b' ELSE 'f' END) || (key - 1)) FROM blk WHERE key % 50 >= 40),
heads AS (SELECT chain_id, max(number) AS number, max_by(hash, number) AS hash FROM forked WHERE hash = md5('b' || number) GROUP BY ALL)"""


def _forked(s, d):
    b = blocks(s, d)
    main = b.select("chain_id", F.col("key").alias("number"), "hash", (F.col("key") - 1).alias("parent_number"), F.md5(F.concat(F.lit("b"), F.col("key") - 1)).alias("parent_hash"))
    stem = F.when(F.col("key") % 50 == 40, "b").otherwise("f")
    side = b.filter("key % 50 >= 40").select("chain_id", F.col("key").alias("number"), F.md5(F.concat(F.lit("f"), "key")).alias("hash"), (F.col("key") - 1).alias("parent_number"), F.md5(F.concat(stem, F.col("key") - 1)).alias("parent_hash"))
    return main.unionByName(side), main.groupBy("chain_id").agg(F.max("number").alias("number"), F.max_by("hash", "number").alias("hash"))


@_register(f"""{_FORKED}, walk AS (
  SELECT * FROM (WITH RECURSIVE w AS (
    SELECT chain_id, number AS pair, 'b' AS side, number, hash, 0::BIGINT AS steps FROM forked WHERE number % 50 = 49 AND hash = md5('f' || number)
    UNION ALL SELECT h.chain_id, f.number, 'a', h.number, h.hash, 0 FROM heads h JOIN forked f ON f.chain_id = h.chain_id AND f.number % 50 = 49 AND f.hash = md5('f' || f.number)
    UNION ALL SELECT w.chain_id, w.pair, w.side, p.number, p.hash, w.steps + 1 FROM w JOIN forked b ON b.chain_id = w.chain_id AND b.number = w.number AND b.hash = w.hash JOIN forked p ON p.chain_id = b.chain_id AND p.number = b.parent_number AND p.hash = b.parent_hash)
  SELECT * FROM w)),
met AS (SELECT chain_id, pair, number, hash, min(steps) FILTER (side = 'a') AS steps_a, min(steps) FILTER (side = 'b') AS steps_b FROM walk GROUP BY ALL HAVING steps_a IS NOT NULL AND steps_b IS NOT NULL)
SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY chain_id, pair ORDER BY number DESC) = 1""")
def common_ancestors(s, d):
    arrivals, heads = _forked(s, d)
    tips = arrivals.filter((F.col("number") % 50 == 49) & (F.col("hash") == F.md5(F.concat(F.lit("f"), "number"))))
    tips = tips.select("chain_id", F.col("number").alias("pair"), F.col("number").alias("b_number"), F.col("hash").alias("b_hash"))
    pairs = tips.join(heads.select("chain_id", F.col("number").alias("a_number"), F.col("hash").alias("a_hash")), "chain_id")
    return li.common_ancestors(arrivals, pairs, 1000)


@_register(f"""{_FORKED}, walk AS (
  SELECT * FROM (WITH RECURSIVE w AS (
    SELECT *, 0::BIGINT AS depth FROM heads
    UNION ALL SELECT w.chain_id, p.number, p.hash, w.depth + 1 FROM w JOIN forked b ON b.chain_id = w.chain_id AND b.number = w.number AND b.hash = w.hash JOIN forked p ON p.chain_id = b.chain_id AND p.number = b.parent_number AND p.hash = b.parent_hash WHERE w.depth < 600)
  SELECT * FROM w)) SELECT chain_id, number, hash, depth FROM walk""")
def canonical_chains(s, d):
    arrivals, heads = _forked(s, d)
    return li.canonical_from(arrivals, heads, 600).select("chain_id", "number", "hash", "depth")


_BATCH = "SELECT chain_id, key // 5 AS batch, key AS pos, number, hash, parent_number, parent_hash FROM blk"


@_register(f"SELECT chain_id, batch, CASE WHEN NOT bool_and(up) THEN 'descending' WHEN NOT bool_and(link) THEN 'unlinked' END AS issue FROM (SELECT chain_id, batch, coalesce(lag(number) OVER w < number, true) AS up, coalesce(lag(number) OVER w = parent_number AND lag(hash) OVER w = parent_hash, true) AS link FROM ({_BATCH}) WINDOW w AS (PARTITION BY chain_id, batch ORDER BY pos)) GROUP BY chain_id, batch")
def batch_issues(s, d):
    return li.batch_issues(blocks(s, d).withColumn("batch", F.expr("key DIV 5")).withColumnRenamed("key", "pos"))


@_register("SELECT key, CASE WHEN key % 17 = 3 THEN 'missing' WHEN o = 'x' THEN 'invalid' WHEN parent_hash <> md5('b' || (key - 1)) THEN 'parent mismatch' END AS issue FROM (SELECT *, CASE WHEN key % 19 = 4 THEN 'x' ELSE 'y' END AS o FROM blk)")
def candidate_issues(s, d):
    n = F.when(F.col("key") % 17 != 3, F.col("number"))
    return blocks(s, d).select("key", li.candidate_issue(F.col("number"), n, F.col("key") % 19 == 4, F.col("parent_hash"), F.md5(F.concat(F.lit("b"), F.col("key") - 1))).alias("issue"))


_ARRIVALS = "SELECT chain_id, number, md5('b' || key || flag) AS hash, number - 1 AS parent_number, md5('p' || (part % 2)) AS parent_hash, key * 100 + tx AS pos FROM txs"


def _arrivals(s, d):
    return transactions(s, d).selectExpr("chain_id", "number", "md5(concat('b', key, flag)) AS hash", "number - 1 AS parent_number", "md5(concat('p', part % 2)) AS parent_hash", "key * 100 + tx AS pos")


@_register(f"SELECT chain_id, number, hash FROM ({_ARRIVALS}) GROUP BY ALL HAVING count(DISTINCT parent_hash) > 1")
def equivocations(s, d):
    return li.equivocations(_arrivals(s, d))


@_register(f"SELECT chain_id, number, max(pos) AS pos, max_by(hash, pos) AS hash FROM ({_ARRIVALS}) GROUP BY chain_id, number")
def reorg_last_wins(s, d):
    return li.last_per_height(_arrivals(s, d)).select("chain_id", "number", "pos", "hash")


@_register("SELECT count(*) AS new_blocks FROM blk WHERE key % 2 = 1 OR parent_hash <> md5('b' || (key - 1))")
def absorbed_duplicates(s, d):
    b = blocks(s, d).drop("key")
    held = blocks(s, d).filter("key % 2 = 0 AND parent_hash = md5(concat('b', key - 1))").drop("key")
    return li.absorbed(b, held).agg(F.count("*").alias("new_blocks"))


@_register("SELECT chain_id, pos, amount, max(amount) OVER w AS highest, amount < max(amount) OVER w AS regressive FROM ev WINDOW w AS (PARTITION BY chain_id ORDER BY pos)")
def finality_running(s, d):
    r = events(s, d).select("chain_id", "pos", F.col("amount").alias("number"), F.lit("h").alias("hash"))
    return li.running_finality(r).select("chain_id", "pos", F.col("number").alias("amount"), "highest", "regressive")


@_register("SELECT chain_id, amount AS number, count(DISTINCT event_type) AS hashes FROM ev GROUP BY ALL HAVING count(DISTINCT event_type) > 1")
def finality_conflicts(s, d):
    return li.finality_conflicts(events(s, d).select("chain_id", F.col("amount").alias("number"), F.col("event_type").alias("hash")))


@_register("SELECT chain_id, pos, epoch, max(amount) OVER (PARTITION BY chain_id, epoch ORDER BY pos) AS finalized FROM (SELECT *, max(epoch) OVER (PARTITION BY chain_id ORDER BY pos) AS newest FROM (SELECT *, (pos // 1000 + CASE event_type WHEN 'error' THEN 1 ELSE 0 END) AS epoch FROM ev)) WHERE epoch = newest")
def finality_epochs(s, d):
    e = events(s, d).withColumn("epoch", F.expr("pos DIV 1000 + if(event_type = 'error', 1, 0)")).withColumn("number", F.col("amount"))
    return li.epoch_finality(e).select("chain_id", "pos", "epoch", "finalized")


@_register("SELECT b.chain_id, max(b.number) AS number, max_by(b.hash, b.number) AS hash FROM blk b JOIN (SELECT chain_id, parent_number AS number, parent_hash AS hash FROM blk) p USING (chain_id, number, hash) GROUP BY b.chain_id")
def finality_confirmed(s, d):
    b = blocks(s, d)
    return li.confirmed_finality(b.select("chain_id", F.col("parent_number").alias("number"), F.col("parent_hash").alias("hash")), b.select("chain_id", "number", "hash"))


# -- coherence --------------------------------------------------------------------------------------------------------


def _logs(s, d):
    return transactions(s, d).select("chain_id", "number", F.expr("cast(line - 1 AS bigint)").alias("log_index"), "tx", "tx_hash", "block_hash", "key")


@_register("SELECT chain_id, number FROM txs GROUP BY ALL HAVING min(line) <> 1 OR max(line) <> count(*) OR count(DISTINCT line) <> count(*)")
def log_index_gaps(s, d):
    return co.log_index_gaps(_logs(s, d)).select("chain_id", "number")


@_register("SELECT chain_id, number, tx, tx_hash, total FROM (SELECT *, sum(gas_used) OVER (PARTITION BY key ORDER BY tx)::BIGINT + CASE WHEN part % 50 = 7 THEN 1 ELSE 0 END AS total, gas_used AS own FROM txs) QUALIFY total <> coalesce(lag(total) OVER (PARTITION BY chain_id, number ORDER BY tx), 0) + own")
def cumulative_gas(s, d):
    w = Window.partitionBy("key").orderBy("tx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = transactions(s, d).withColumn("cumulative_gas", F.sum("gas_used").over(w) + F.when(F.col("part") % 50 == 7, 1).otherwise(0))
    return co.cumulative_gas_breaks(r).select("chain_id", "number", "tx", "tx_hash", F.col("cumulative_gas").alias("total"))


_CLAIMS = "SELECT b.*, coalesce(n, 0) + CASE WHEN b.key % 13 = 5 THEN 1 ELSE 0 END AS tx_count, coalesce(n, 0) AS have FROM blk b LEFT JOIN (SELECT chain_id, number, count(*) AS n FROM txs GROUP BY ALL) USING (chain_id, number)"


@_register(f"SELECT c.chain_id, c.number, CASE WHEN have <> tx_count THEN 'receipts: ' || have || ' of ' || tx_count WHEN coalesce(bool_or(t.block_hash <> c.hash), false) THEN 'receipts of another block' END AS reason, have <> tx_count AS is_not_ready, have = tx_count AND coalesce(bool_or(t.block_hash <> c.hash), false) AS header_contested FROM ({_CLAIMS}) c LEFT JOIN txs t USING (chain_id, number) GROUP BY c.chain_id, c.number, have, tx_count")
def receipt_verdicts(s, d):
    b = _tx_blocks(s, d)
    v = co.verdict(b, co.receipt_gates(b, transactions(s, d)))
    return v.select("chain_id", "number", "reason", "is_not_ready", "header_contested")


@_register("SELECT chain_id, number FROM blk WHERE NOT regexp_matches(hash, '^(0x)?0*$') AND key NOT IN (SELECT key FROM txs)")
def bloom_without_logs(s, d):
    return co.bloom_without_logs(blocks(s, d).withColumn("logs_bloom", F.col("hash")), transactions(s, d)).select("chain_id", "number")


@_register("SELECT b.number AS block_number, count(*) AS logs FROM txs t JOIN blk b ON b.chain_id = t.chain_id AND b.hash = t.block_hash GROUP BY b.number")
def logs_of_blocks(s, d):
    return co.logs_of_blocks(blocks(s, d), _logs(s, d)).groupBy("block_number").agg(F.count("*").alias("logs"))


@_register("SELECT t.chain_id, t.number, t.tx, t.tx_hash, r.tx_hash AS receipt_tx_hash, r.gas_used AS receipt_gas_used FROM txs t LEFT JOIN (SELECT * FROM txs WHERE flag <> 'R') r USING (chain_id, number, tx)")
def receipts_by_position(s, d):
    t = transactions(s, d).select("chain_id", "number", "tx", "key", "part", "gas_used", "flag")
    both = co.with_receipts(t.drop("gas_used", "flag"), t.filter("flag <> 'R'").drop("flag"))
    # hashes are made of what names them behind the join, so that its shuffles don't carry them
    return both.selectExpr("chain_id", "number", "tx", "md5(concat('t', key, '/', part)) AS tx_hash", "md5(concat('t', receipt_key, '/', receipt_part)) AS receipt_tx_hash", "receipt_gas_used")


@_register("SELECT chain_id, number, (row_number() OVER (PARTITION BY chain_id, number ORDER BY tx, supp % 3, tx_hash) - 1)::BIGINT AS log_index, tx FROM txs")
def log_renumbering(s, d):
    t = transactions(s, d).withColumn("log", F.struct(F.col("supp") % 3, "tx_hash"))
    return co.numbered_logs(t.select("chain_id", "number", "tx", "log")).select("chain_id", "number", "log_index", "tx")


_REPLAYS = "SELECT chain_id, number, CASE WHEN supp % 10 = 1 THEN tx_hash || 'x' ELSE tx_hash END AS h FROM txs WHERE part % 40 <> 0"


@_register(f"SELECT chain_id, number, arg_min(r, o) AS reason FROM (SELECT chain_id, number, CASE WHEN n IS NULL THEN 1 WHEN t IS NULL THEN 3 ELSE 2 END AS o, CASE WHEN n IS NULL THEN 'missing replay' WHEN t IS NULL THEN 'foreign replay' ELSE 'duplicate replay' END AS r FROM (SELECT chain_id, number, tx_hash AS h, 1 AS t FROM txs) FULL JOIN (SELECT chain_id, number, h, count(*) AS n FROM ({_REPLAYS}) GROUP BY ALL) USING (chain_id, number, h) WHERE n IS NULL OR t IS NULL OR n > 1) GROUP BY ALL")
def replay_coverage(s, d):
    t = transactions(s, d)
    r = t.filter("part % 40 <> 0").withColumn("tx_hash", F.expr("if(supp % 10 = 1, concat(tx_hash, 'x'), tx_hash)"))
    return co.replay_issues(t, r).select("chain_id", "number", "reason")


@_register("SELECT chain_id, number, tx_hash, first, frames, (row_number() OVER (PARTITION BY chain_id, number ORDER BY first, tx_hash) - 1)::BIGINT AS tx FROM (SELECT chain_id, number, supp % 4 AS tx_hash, min(tx) AS first, count(*) AS frames FROM txs GROUP BY ALL)")
def frame_groups(s, d):
    f = transactions(s, d).select("chain_id", "number", F.expr("supp % 4").alias("tx_hash"), F.col("tx").alias("place"))
    return co.grouped_frames(f).drop("places")


@_register("SELECT chain_id, number, CASE WHEN bool_or(foreign_) THEN 'frames of another block' END AS reason FROM (SELECT b.chain_id, b.number, t.block_hash <> b.hash AS foreign_ FROM blk b JOIN txs t USING (chain_id, number)) GROUP BY ALL HAVING bool_or(foreign_)")
def flat_frame_checks(s, d):
    t = transactions(s, d).withColumnRenamed("tx", "place")
    return co.flat_frame_issues(blocks(s, d), t, t).select("chain_id", "number", "reason")


@_register("SELECT k, a.n AS prev, b.n AS next, CASE WHEN a.n IS NULL THEN '+' WHEN b.n IS NULL THEN '-' WHEN a.n = b.n THEN '=' ELSE '*' END AS kind FROM (SELECT part AS k, count(*) AS n FROM txs WHERE flag <> 'N' GROUP BY 1) a FULL JOIN (SELECT part AS k, count(*) AS n FROM txs WHERE flag <> 'A' GROUP BY 1) b USING (k)")
def state_changes(s, d):
    t = transactions(s, d)
    pre = t.filter("flag <> 'N'").groupBy(F.col("part").alias("k")).agg(F.count("*").alias("value"))
    post = t.filter("flag <> 'A'").groupBy(F.col("part").alias("k")).agg(F.count("*").alias("value"))
    return co.state_changes(pre, post, ["k"]).select("k", "prev", "next", "kind")


@_register("SELECT key, CASE WHEN number % 3 = 0 THEN 'logs,traces' WHEN number % 3 = 1 THEN 'traces' ELSE '' END AS missing FROM blk")
def missing_components(s, d):
    have = F.expr("CASE number % 3 WHEN 0 THEN array('header') WHEN 1 THEN array('logs', 'header') ELSE array('traces', 'logs') END")
    return blocks(s, d).select("key", F.array_join(co.missing_components(F.array(F.lit("logs"), F.lit("traces")), have), ",").alias("missing"))


@_register("SELECT chain, count(*) AS committed FROM (SELECT CASE WHEN flag = 'A' THEN 999 WHEN flag = 'N' THEN 137 ELSE 1 END AS chain, * FROM txs) WHERE NOT (chain = 999 AND gas_used < 10) GROUP BY chain")
def exempt_transactions(s, d):
    t = transactions(s, d).withColumn("chain_id", F.expr("cast(CASE flag WHEN 'A' THEN 999 WHEN 'N' THEN 137 ELSE 1 END AS bigint)"))
    left = co.exempt(t, network_table(s), "zero_gas_system_tx", F.col("gas_used") < 10)
    return left.groupBy(F.col("chain_id").cast("int").alias("chain")).agg(F.count("*").alias("committed"))


@_register("SELECT DISTINCT t.chain_id, t.number, t.tx, t.tx_hash FROM txs t WHERE NOT EXISTS (SELECT 1 FROM txs e WHERE e.chain_id = t.chain_id AND e.number = t.number AND e.tx_hash = t.tx_hash AND e.flag <> 'R')")
def unmatched_labels(s, d):
    t = transactions(s, d)
    return co.unmatched_labels(t.filter("flag <> 'R'").withColumn("tx_hash", F.upper("tx_hash")), t).select("chain_id", "number", "tx", "tx_hash").distinct()


# -- scalar functions -------------------------------------------------------------------------------------------------


@_register("SELECT key, '0x' || lower(hex(key)) AS qty, key::BIGINT AS back, CASE WHEN key % 5 = 0 THEN 0 ELSE key END::BIGINT AS lenient FROM blk")
def quantities(s, d):
    qty = q.to_qty("key")
    return blocks(s, d).select("key", qty.alias("qty"), q.qty_safe(qty).alias("back"), q.qty_long(F.when(F.col("key") % 5 == 0, F.concat(qty, F.lit("zz"))).otherwise(qty)).alias("lenient"))


@_register("SELECT key, substr(hash, 1, 40) AS h, length(regexp_extract(hash, '^([0-9a-f]{2})*')) // 2 AS n, regexp_matches(hash, '^[0-9]') AS digit, key % 2 = 0 AS address, key % 3 = 0 AS zero FROM blk")
def hex_functions(s, d):
    h = F.substring("hash", 1, 40)
    own = F.concat(F.lit("0x"), F.rpad("hash", 40, "0"), F.when(F.col("key") % 2 == 1, "1").otherwise(""))
    return blocks(s, d).select("key", F.substring(q.to_hex(q.hex_strict("hash")), 3, 40).alias("h"), F.octet_length(q.hex_node_style("hash")).cast("long").alias("n"), h.rlike("^[0-9]").alias("digit"), q.is_address(own).alias("address"), q.is_zero_bloom(F.when(F.col("key") % 3 == 0, F.concat(F.lit("0x"), F.repeat(F.lit("0"), 512))).otherwise(F.concat(F.lit("0x"), F.repeat(F.lit("0"), 480), "hash"))).alias("zero"))


@_register("SELECT event_type, count(*) FILTER (safe) AS safe, count(*) AS n FROM (SELECT event_type, pos % 3 > 0 AS safe FROM ev) GROUP BY event_type")
def header_safe_hashes(s, d):
    e = events(s, d).withColumn("h", F.concat("event_type", F.when(F.col("pos") % 3 == 0, F.lit("\x07")).otherwise(F.lit("\t"))))
    return e.groupBy("event_type").agg(F.count(F.when(q.is_header_safe("h"), 1)).alias("safe"), F.count("*").alias("n"))


_KINDS = "CASE flag WHEN 'A' THEN 'DelegateCall' WHEN 'N' THEN 'create2' ELSE 'nonsense' END"


@_register("SELECT CASE flag WHEN 'A' THEN 'DELEGATECALL' WHEN 'N' THEN 'CREATE2' ELSE 'UNKNOWN' END AS kind, CASE flag WHEN 'A' THEN 'call' WHEN 'N' THEN 'create' END AS type, count(*) AS n FROM txs GROUP BY ALL")
def frame_kinds(s, d):
    t = transactions(s, d).withColumn("t", F.expr(_KINDS))
    return t.groupBy(q.frame_kind("t").alias("kind"), q.frame_type("t").alias("type")).agg(F.count("*").alias("n"))


@_register("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM ev")
def parsed_props(s, d):
    return events(s, d).select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


# -- metrics ----------------------------------------------------------------------------------------------------------

_BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0]


@_register("SELECT event_type, le, count(*) FILTER (amount <= coalesce(le, 1e308)) AS count FROM ev, (SELECT unnest([5.0, 10.0, 25.0, 50.0, 100.0, NULL]::DOUBLE[]) AS le) GROUP BY ALL")
def latency_histogram(s, d):
    return me.histogram(events(s, d), "amount", _BOUNDS, ["event_type"])


@_register("SELECT event_type, min(amount) AS least, median(amount)::DOUBLE AS median, round(quantile_cont(amount, 0.9), 6)::DOUBLE AS p90, max(amount) AS most FROM ev GROUP BY ALL")
def latency_summary(s, d):
    return me.summary(events(s, d), "amount", ["event_type"]).withColumn("p90", F.round("p90", 6))


@_register("SELECT event_type, count(*) AS n, min(amount) AS least, max(amount) AS most, true AS median_within, true AS p90_within FROM ev GROUP BY ALL")
def latency_sketches(s, d):
    """Quantiles from stored daily sketches, each held against its rank among all values."""
    from blockloom.storage import Kept

    e = events(s, d).withColumn("day", F.expr("at_ms DIV 86400000"))
    found = me.sketch_summary(Kept(me.sketched(e, "amount", ["event_type", "day"]), "sketches").df, ["event_type"])
    per = e.select("event_type", "amount").join(found, "event_type").groupBy("event_type", "n", "least", "most")

    def within(q: str, rank: float):
        # the ranks of equal values are a stretch
        return ((F.count(F.when(F.col("amount") < F.col(q), 1)) <= (rank + me.RANK_ERROR) * F.col("n")) & (F.count(F.when(F.col("amount") <= F.col(q), 1)) >= (rank - me.RANK_ERROR) * F.col("n"))).alias(f"{q}_within")

    return per.agg(within("median", 0.5), within("p90", 0.9))


@_register("SELECT t AS event_type, f AS outcome, coalesce(n, 0) AS value FROM (SELECT * FROM (SELECT unnest(['view', 'click', 'error', 'none']) AS t) CROSS JOIN (SELECT unnest(['low', 'high', 'never']) AS f)) LEFT JOIN (SELECT event_type AS t, CASE WHEN amount < 20 THEN 'low' ELSE 'high' END AS f, count(*) AS n FROM ev GROUP BY ALL) USING (t, f)")
def zero_filled_counts(s, d):
    counts = events(s, d).groupBy("event_type", F.when(F.col("amount") < 20, "low").otherwise("high").alias("outcome")).agg(F.count("*").alias("value"))
    labels = s.createDataFrame([(t, f) for t in ("view", "click", "error", "none") for f in ("low", "high", "never")], "event_type string, outcome string")
    return me.zero_filled(counts, labels)


@_register("SELECT user_id, pos, gap, min(gap) OVER (PARTITION BY user_id ORDER BY at_ms ROWS 7 PRECEDING) AS floor FROM (SELECT *, at_ms - lag(at_ms) OVER (PARTITION BY user_id ORDER BY at_ms) AS gap FROM ev)")
def cadence(s, d):
    return me.shortest_gap(events(s, d), keys=["user_id"]).select("user_id", "pos", "gap", "floor")


@_register("SELECT pos, CASE WHEN floor IS NULL THEN 100 ELSE least(1000, greatest(25, floor - pos % 500 - 600)) END::BIGINT AS delay FROM (SELECT pos, CASE WHEN amount > 5 THEN amount * 20 END AS floor FROM ev)")
def poll_delays(s, d):
    e = events(s, d).withColumn("floor", F.when(F.col("amount") > 5, F.col("amount") * 20))
    return e.select("pos", me.poll_delay(F.col("floor"), F.col("pos") % 500).cast("long").alias("delay"))


@_register("SELECT event_type, slot, n, (sum(n) OVER (PARTITION BY event_type ORDER BY slot RANGE BETWEEN 10 PRECEDING AND CURRENT ROW))::BIGINT AS in_window FROM (SELECT event_type, at_ms // 3600000 AS slot, count(*) AS n FROM ev GROUP BY ALL)")
def rate_meter(s, d):
    per = events(s, d).groupBy("event_type", F.expr("at_ms DIV 3600000").alias("slot")).agg(F.count("*").alias("n"))
    return me.rate(per, "slot", "n", 3_600_000, ["event_type"]).select("event_type", "slot", "n", F.round(F.col("rate") * 36000).cast("long").alias("in_window"))


@_register("SELECT count(*) FILTER (amount > 20 AND pos - greatest(pos - 70000, pos - amount * 2000) >= 60000) AS stalled, count(*) AS n FROM ev")
def stall_alarm(s, d):
    alarm = me.stalled(F.col("amount"), F.lit(20), F.col("pos") - 70000, F.col("pos") - F.col("amount") * 2000, F.col("pos"))
    return events(s, d).agg(F.count(F.when(alarm, 1)).alias("stalled"), F.count("*").alias("n"))


@_register("SELECT event_type, count(*) FILTER (pos % 600 IN (408, 429, 502, 503, 504, 529) OR event_type = 'error') AS retryable FROM ev GROUP BY ALL")
def retryable_errors(s, d):
    text = F.when(F.col("event_type") == "error", "Too Many Requests").otherwise("no such method")
    return events(s, d).groupBy("event_type").agg(F.count(F.when(me.is_retryable(F.col("pos") % 600, F.lit(None).cast("int"), text), 1)).alias("retryable"))


@_register("SELECT CASE event_type WHEN 'error' THEN 'conflict' WHEN 'view' THEN CASE WHEN amount < 10 THEN 'backfill' ELSE 'window' END WHEN 'click' THEN CASE WHEN pos % 2 = 0 THEN 'wait_empty' ELSE 'window' END ELSE 'error' END AS class, count(*) AS n FROM ev GROUP BY ALL")
def query_outcomes(s, d):
    kind = F.expr("CASE event_type WHEN 'error' THEN 'conflict' WHEN 'view' THEN 'data' WHEN 'click' THEN 'empty' ELSE 'other' END")
    return events(s, d).groupBy(qu.outcome_class(kind, F.col("pos") % 2 == 0, F.col("amount") < 10).alias("class")).agg(F.count("*").alias("n"))


@_register("SELECT user_id AS number, max(at_ms) AS at_ms FROM ev GROUP BY 1 HAVING max(at_ms) > 1706659200000 - 36000000 ORDER BY 2 DESC, 1 DESC LIMIT 1000")
def block_times(s, d):
    return qu.block_times(events(s, d).withColumn("number", F.col("user_id")), 1706659200000, ttl_ms=36_000_000)


@_register("SELECT user_id, coalesce(max(amount) >= 90 AND 1706659200000 - max(at_ms) < 36000000, false) AS ready FROM ev GROUP BY user_id")
def readiness(s, d):
    per = events(s, d).groupBy("user_id").agg(F.max("amount").alias("head"), F.max("at_ms").alias("at"))
    return per.select("user_id", qu.is_ready(F.col("head"), F.lit(90), F.col("at"), F.lit(1706659200000), 36_000).alias("ready"))


@_register("SELECT 'events_total' AS name, '# HELP events_total events' || chr(10) || '# TYPE events_total counter' || chr(10) || string_agg('events_total{type=\"' || event_type || '\"} ' || n, chr(10) ORDER BY event_type) || chr(10) AS text FROM (SELECT event_type, count(*) AS n FROM ev GROUP BY ALL)")
def exposition_text(s, d):
    m = events(s, d).groupBy("event_type").agg(F.count("*").alias("value"))
    return me.exposition(m.select(F.lit("events_total").alias("name"), F.lit("events").alias("help"), F.lit("counter").alias("type"), F.create_map(F.lit("type"), "event_type").alias("labels"), "value"))


# -- operators that SQL can't express: tests hold these against independent models ------------------------------------


@_register()
def canonical_records(s, d):
    """Bundles normalised with traces; each record as its hash and size."""
    from blockloom.operators.normalize import normalize, parse_bundles

    r = normalize(parse_bundles(bundles(s, d)), with_traces=True)
    return r.select("number", "hash", "parent_number", "timestamp", F.md5("json_line").alias("record_md5"), F.length("json_line").cast("long").alias("record_chars"))


@_register()
def compressed_records(s, d):
    """Records as zstd frames, and the records read back from their gzip members' source."""
    from blockloom.operators.normalize import normalize, parse_bundles
    from blockloom.sources.encode import encoded, record_of

    r = encoded(normalize(parse_bundles(bundles(s, d), parts=("block", "logs", "receipts"))))
    return r.select("number", F.octet_length("frame").alias("frame_bytes"), F.md5(record_of("frame")).alias("record_md5"))


@_register(records.FLATTENED_FRAMES)
def flattened_frames(s, d):
    """Call trees as frames, with the violations of their structure counted by block."""
    from blockloom.operators.frames import frames_of
    from blockloom.operators.normalize import parse_bundles

    return frames_of(parse_bundles(bundles(s, d), parts=("debugFrames",))).select("number", "tx", "place", "parent", F.size("path").alias("depth"), "subtraces", "type")


@_register()
def header_hashes(s, d):
    from blockloom.functions.commitments import block_hash_udf

    return bundles(s, d).select(F.get_json_object("value", "$.number").cast("long").alias("number"), block_hash_udf(F.get_json_object("value", "$.block")).alias("header_hash"))


@_register()
def log_blooms(s, d):
    from blockloom.functions.commitments import bloom_of_logs

    t = transactions(s, d)
    logs = t.select("block_hash", F.concat(F.lit("0x"), F.substring(F.md5(F.col("part").cast("string")), 1, 32), F.lit("00000000")).alias("address"), F.array(F.concat(F.lit("0x"), F.sha2(F.col("supp").cast("string"), 256))).alias("topics"))
    return bloom_of_logs(logs)


@_register(""", b AS (SELECT chain_id, number, hash, number // 10 AS g, row_number() OVER (PARTITION BY chain_id ORDER BY key) - 1 AS i FROM blk),
w AS (
  SELECT *, least(e + 1, 100) AS held, e + 1 - least(e + 1, 100) AS f, greatest(e - 20, e + 1 - least(e + 1, 100), 0) AS fin,
    e - s + 1 + (version > 1)::INTEGER + greatest(e + 1 - 100, 0) - greatest(s - 100, 0) AS wrote
  FROM (SELECT chain_id, g, max(i) AS e, min(i) AS s, row_number() OVER (PARTITION BY chain_id ORDER BY g) AS version FROM b GROUP BY chain_id, g)),
r AS (
  SELECT w.chain_id::VARCHAR AS chain_id, g, version, x.number AS head_number, x.hash AS head_hash, y.number AS finalized_number, y.hash AS finalized_hash, z.number AS first_number, held::INTEGER AS size, 0::INTEGER AS excess, wrote
  FROM w JOIN (SELECT chain_id, i, number, hash FROM b) x ON x.chain_id = w.chain_id AND x.i = e JOIN (SELECT chain_id, i, number, hash FROM b) y ON y.chain_id = w.chain_id AND y.i = fin JOIN (SELECT chain_id, i, number FROM b) z ON z.chain_id = w.chain_id AND z.i = f)
SELECT 2 * g AS batch, 'applied' AS outcome, wrote::INTEGER AS written, r.* EXCLUDE (g, wrote) FROM r UNION ALL SELECT 2 * g + 1, 'parent mismatch', 0::INTEGER, r.* EXCLUDE (g, wrote) FROM r WHERE g % 3 = 1""")
def chain_windows(s, d):
    """Outcomes of the stateful window over blocks that come in batches of ten heights, chain by chain, with finality twenty blocks
    behind; a third of the batches are followed by one whose block has another parent."""
    from blockloom.streaming.buffer import window_stream

    none = ["cast(null AS bigint) AS timestamp", "cast(null AS string) AS payload"]
    back = "(key % 1000 - 20)"
    b = blocks(s, d)
    good = b.selectExpr(
        "cast(chain_id AS string) AS chain_id", "2 * (number DIV 10) AS batch", "key AS pos", "number", "hash", "parent_number", "md5(concat('b', key - 1)) AS parent_hash", *none,
        f"if({back} >= 0, {back} + {back} DIV 7, null) AS report_number", f"if({back} >= 0, md5(concat('b', key - 20)), null) AS report_hash", "cast(null AS string) AS fork_prev",
    )
    last = b.withColumn("g", F.expr("number DIV 10")).filter("g % 3 = 1").groupBy("chain_id", "g").agg(F.max("number").alias("number"), F.max("key").alias("key"))
    bad = last.selectExpr(
        "cast(chain_id AS string) AS chain_id", "2 * g + 1 AS batch", "key AS pos", "number + 1 AS number", "'bad' AS hash", "number AS parent_number", "'x' AS parent_hash", *none,
        "cast(null AS bigint) AS report_number", "cast(null AS string) AS report_hash", "cast(null AS string) AS fork_prev",
    )
    return window_stream(good.unionByName(bad), most=100, force=True)


@_register(""", a AS (
  SELECT chain_id, key AS number, ['receipts', 'logs', 'traces', 'header'][(line % 4 + 1)::INTEGER] AS leg, CASE WHEN part % 4 = 0 THEN 'wrong' WHEN part % 9 = 1 THEN 'late' ELSE 'ready' END AS answer, key * 100000 + (supp * 37 + part * 11) % 400 * 100 AS at_ms FROM txs),
p AS (
  SELECT chain_id, number, min(at_ms) AS since, coalesce(list_sort(list(at_ms) FILTER (answer = 'wrong'))[2], 1::BIGINT << 62) AS bad,
    coalesce(min(at_ms) FILTER (answer = 'ready' AND leg = 'receipts'), 1::BIGINT << 62) AS r, coalesce(min(at_ms) FILTER (answer = 'ready' AND leg = 'logs'), 1::BIGINT << 62) AS l FROM a GROUP BY ALL),
d AS (SELECT *, least(greatest(r, l), bad, since + 30000) AS at_ms FROM p)
SELECT chain_id, number, CASE WHEN greatest(r, l) = at_ms THEN 'whole' WHEN bad = at_ms THEN 'incoherent' ELSE 'not ready' END AS outcome, at_ms, at_ms - since AS waited_ms,
  array_to_string(list_filter([CASE WHEN r > at_ms THEN 'receipts' END, CASE WHEN l > at_ms THEN 'logs' END], lambda x: x IS NOT NULL), ',') AS missing FROM d""")
def late_data(s, d):
    """What becomes of blocks whose parts come late, contradict them or stay away: lines as answers, two of them wanted."""
    from blockloom.streaming.timers import late_legs

    leg = F.element_at(F.array(*[F.lit(x) for x in ("receipts", "logs", "traces", "header")]), (F.col("line") % 4 + 1).cast("int"))
    answer = F.when(F.col("part") % 4 == 0, "wrong").when(F.col("part") % 9 == 1, "late").otherwise("ready")
    a = transactions(s, d).select("chain_id", F.col("key").alias("number"), leg.alias("leg"), answer.alias("answer"), F.expr("key * 100000 + (supp * 37 + part * 11) % 400 * 100").alias("at_ms"))
    return late_legs(a, ["receipts", "logs"], attempts=1)


for _name, (_query, _sql) in (records.REGISTERED | parts.REGISTERED | stored.REGISTERED).items():
    QUERIES[_name], ORACLES[_name] = _query, oracle(_sql)
