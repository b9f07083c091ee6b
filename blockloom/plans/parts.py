"""Queries over parts of records that the bundles of ``views`` lack: state diffs, deep call trees, labels, access lists, authorizations.

``orders`` give a part each; what it holds goes by its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators import frames as fr
from blockloom.operators import normalize as no
from blockloom.operators.schema import RECEIPT, TRANSACTION


def _keys(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"))


def _shown(rows: DataFrame, diffs) -> DataFrame:
    return rows.select(F.col("k").alias("number"), F.explode(diffs).alias("d")).select("number", "d.address", "d.key", "d.kind", F.col("d.prev").alias("prev"), F.col("d.next").alias("next"))


def debug_state_diffs(s, d):
    """Pre and post states of an account as diff rows."""
    own = """concat('{"pre":{"', upper(md5(string(k))), '":{"balance":"0x1","storage":{"s1":"0x1","s2":"0x2"}}},"post":{"', upper(md5(string(k))), '":{', concat_ws(',',
      if(k % 3 = 0, '"balance":"0x5"', null), if(k % 4 = 0, concat('"nonce":', k), null), if(k % 5 = 0, '"code":"0x6"', null),
      concat('"storage":{', concat_ws(',', if(k % 2 = 0, '"s1":"0x9"', null), if(k % 7 = 0, '"s3":"0x3"', null)), '}')), '}}}')"""
    return _shown(_keys(s, d).withColumn("r", F.expr(own)), no.debug_diffs(F.col("r"), F.lit(0)))


_O = "(SELECT o_orderkey AS k, md5(o_orderkey::VARCHAR) AS address FROM orders)"
DEBUG_STATE_DIFFS = f"""
SELECT k AS number, address, 'balance' AS key, '*' AS kind, '0x1' AS prev, '0x5' AS next FROM {_O} WHERE k % 3 = 0
UNION ALL SELECT k, address, 'nonce', '*', '0x0', printf('0x%x', k) FROM {_O} WHERE k % 4 = 0
UNION ALL SELECT k, address, 'code', '+', NULL, '0x6' FROM {_O} WHERE k % 5 = 0
UNION ALL SELECT k, address, 's1', CASE WHEN k % 2 = 0 THEN '*' ELSE '-' END, '0x1', CASE WHEN k % 2 = 0 THEN '0x9' END FROM {_O}
UNION ALL SELECT k, address, 's2', '-', '0x2', NULL FROM {_O}
UNION ALL SELECT k, address, 's3', '+', NULL, '0x3' FROM {_O} WHERE k % 7 = 0"""


def replayed_state_diffs(s, d):
    """State diffs of replays; unchanged entries leave."""
    own = """concat('{"', upper(md5(string(k))), '":{"balance":', if(k % 3 = 0, '{"*":{"from":"0x1","to":"0x5"}}', '"="'), ',"nonce":', if(k % 4 = 0, '{"+":"0x7"}', '"="'), ',"code":', if(k % 5 = 0, '{"-":"0x6"}', '"="'),
      ',"storage":{"s1":{"*":{"from":"0x2","to":"0x3"}},"s2":', if(k % 2 = 0, '{"+":"0x4"}', '"="'), '}}}')"""
    return _shown(_keys(s, d).withColumn("r", F.expr(own)), no.replay_diffs(F.col("r"), F.lit(0)))


REPLAYED_STATE_DIFFS = f"""
SELECT k AS number, address, 'balance' AS key, '*' AS kind, '0x1' AS prev, '0x5' AS next FROM {_O} WHERE k % 3 = 0
UNION ALL SELECT k, address, 'nonce', '+', NULL, '0x7' FROM {_O} WHERE k % 4 = 0
UNION ALL SELECT k, address, 'code', '-', '0x6', NULL FROM {_O} WHERE k % 5 = 0
UNION ALL SELECT k, address, 's1', '*', '0x2', '0x3' FROM {_O}
UNION ALL SELECT k, address, 's2', '+', NULL, '0x4' FROM {_O} WHERE k % 2 = 0"""


def _trees(s, d):
    """A tree for each block: up to eleven calls within each other, a creation beside each; every fifth has another transaction's label."""
    tree = """concat(repeat('{"type":"CALL","from":"0xa","calls":[', int(k % 12)), '{"type":"STOP"}', repeat(',{"type":"CREATE","gas":"0x1"}]}', int(k % 12)))"""
    entry = F.struct(F.expr(tree).alias("result"), F.when(F.col("k") % 5 == 0, "0xother").otherwise(F.concat(F.lit("0xT"), "k")).alias("txHash"))
    txs = F.struct(F.array(F.struct(F.concat(F.lit("0xt"), "k").alias("hash"))).alias("transactions"))
    return _keys(s, d).select(F.col("k").alias("number"), txs.alias("block"), F.array(entry).alias("debugFrames"))


def deep_call_trees(s, d):
    """Frames of trees of any depth."""
    return fr.frames_of(_trees(s, d)).select("number", "place", "parent", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "subtraces", "type", "gas")


DEEP_CALL_TREES = """, RECURSIVE_ROWS AS (
  SELECT * FROM (WITH RECURSIVE t AS (
    SELECT o_orderkey AS number, o_orderkey % 12 AS d, 0 AS i, '' AS path FROM orders
    UNION ALL SELECT number, d, i + 1, CASE WHEN i = 0 THEN '0' ELSE path || '.0' END FROM t WHERE i < d)
  SELECT * FROM t))
SELECT number, i AS place, CASE WHEN i > 0 THEN i - 1 END AS parent, path, CASE WHEN i < d THEN 2 ELSE 0 END::BIGINT AS subtraces, CASE WHEN i < d THEN 'CALL' ELSE 'STOP' END AS type, NULL::VARCHAR AS gas FROM RECURSIVE_ROWS
UNION ALL SELECT number, (2 * d - i)::INTEGER, i, CASE WHEN i = 0 THEN '1' ELSE path || '.1' END, 0, 'CREATE', '0x1' FROM RECURSIVE_ROWS WHERE i < d"""


def frame_labels(s, d):
    """Debug entries whose label isn't the transaction at their place."""
    return fr.mismatched_labels(_trees(s, d)).select("number", "tx")


FRAME_LABELS = "SELECT o_orderkey AS number, 0 AS tx FROM orders WHERE o_orderkey % 5 = 0"


def delegated_transactions(s, d):
    """Access lists in both spellings, authorizations in both shapes, and calls within a transaction."""
    own = """concat('{"hash":"0x', k, '","from":"0xAB', k, '","nonce":"0x1",', if(k % 2 = 0, '"accessList":[{"address":"0xAB","storageKeys":["0x1","0x2"]},{"address":"0xCD","storage_keys":["0x3"]},{"address":"0xEF"}],', ''),
      '"authorizationList":[', if(k % 3 = 0, '{"chainId":"10","address":"0xA","nonce":"0x7","signature":{"r":"0x8","s":"0x9","oddYParity":true}}', '{"chainId":"0x1","address":"0xB","nonce":"0x7","yParity":"0x0","r":"0x2","s":"0x3"}'), '],',
      '"calls":[{"to":"0xCAFE","value":"0x1","input":"0x"}', if(k % 7 = 0, ',{"value":"0x2","input":"0x5"}', ''), ']}')"""
    t = _keys(s, d).withColumn("t", F.from_json(F.expr(own), TRANSACTION)).withColumn("r", F.lit(None).cast(RECEIPT))
    t = t.select(F.col("k").alias("number"), no.transaction(F.col("t"), F.col("r"), F.array(F.lit("7"))).alias("x"))
    access = F.array_join(F.transform("x.accessList", lambda a: F.concat(a["address"], F.lit(":"), F.array_join(a["storageKeys"], ","))), ";")
    a = F.col("x.authorizationList")[0]
    return t.select(
        "number", F.col("x.from").alias("sender"), access.alias("access"), a["chainId"].alias("chain"), a["address"].alias("account"), a["nonce"].cast("long").alias("nonce"), a["yParity"].cast("long").alias("parity"), a["r"].alias("r"), a["s"].alias("s"),
        F.array_join(F.transform("x.calls", lambda c: F.concat(F.coalesce(c["to"], F.lit("-")), F.lit("/"), c["value"], F.lit("/"), c["input"])), ";").alias("calls"),
    )


DELEGATED_TRANSACTIONS = """
SELECT k AS number, '0xab' || k AS sender, CASE WHEN k % 2 = 0 THEN '0xAB:0x1,0x2;0xCD:0x3;0xEF:' END AS access, CASE WHEN k % 3 = 0 THEN '0xa' ELSE '0x1' END AS chain, CASE WHEN k % 3 = 0 THEN '0xA' ELSE '0xB' END AS account,
  7::BIGINT AS nonce, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS parity, CASE WHEN k % 3 = 0 THEN '0x8' ELSE '0x2' END AS r, CASE WHEN k % 3 = 0 THEN '0x9' ELSE '0x3' END AS s,
  '0xcafe/0x1/0x' || CASE WHEN k % 7 = 0 THEN ';-/0x2/0x5' ELSE '' END AS calls FROM (SELECT o_orderkey AS k FROM orders)"""

REGISTERED = {
    "debug_state_diffs": (debug_state_diffs, DEBUG_STATE_DIFFS), "replayed_state_diffs": (replayed_state_diffs, REPLAYED_STATE_DIFFS), "deep_call_trees": (deep_call_trees, DEEP_CALL_TREES), "frame_labels": (frame_labels, FRAME_LABELS),
    "delegated_transactions": (delegated_transactions, DELEGATED_TRANSACTIONS),
}
