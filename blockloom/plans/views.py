"""Block-shaped views over the driver's tables, in DataFrames and in DuckDB's SQL.

``orders`` are blocks: a chain for each thousand keys, heights with a gap after each seventh block, a wrong parent where the
status is P. ``lineitem`` are transactions, receipts and logs of these blocks, ``events`` arrivals and finality reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_HEIGHT = "({k}) + ({k}) DIV 7"
_K = "o_orderkey % 1000"


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").selectExpr(
        "o_orderkey DIV 1000 AS chain_id",
        f"{_HEIGHT.format(k=_K)} AS number",
        "md5(concat('b', o_orderkey)) AS hash",
        f"{_HEIGHT.format(k=f'greatest({_K} - 1, 0)')} AS parent_number",
        "md5(concat(if(o_orderstatus = 'P', 'x', 'b'), o_orderkey - 1)) AS parent_hash",
        "o_orderkey AS key",
    )


def transactions(spark: SparkSession, d: str) -> DataFrame:
    """A row for each line; ``tx`` is its place, gas is its quantity. What is made of a line's columns is made behind the shuffle that numbers them."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(
        "l_orderkey AS key", "l_linenumber AS line", "l_partkey AS part", "l_suppkey AS supp", "l_returnflag AS flag", "l_linestatus AS _status", "l_quantity AS _quantity", "l_extendedprice AS _price"
    )
    return lines.selectExpr(
        "key DIV 1000 AS chain_id",
        f"{_HEIGHT.format(k='key % 1000')} AS number",
        "cast(row_number() OVER (PARTITION BY key ORDER BY line, part, supp, _price) - 1 AS bigint) AS tx",
        "md5(concat('t', key, '/', part)) AS tx_hash",
        "md5(concat('b', if(flag = 'A' AND _status = 'O', key + 1, key))) AS block_hash",
        "cast(_quantity AS bigint) AS gas_used",
        "key",
        "line",
        "part",
        "supp",
        "flag",
    )


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").selectExpr("user_id AS chain_id", "event_id AS pos", "event_id", "user_id", "event_type", "ts", "cast(floor(value) AS bigint) AS amount", "props", "cast(unix_micros(cast(ts AS timestamp)) DIV 1000 AS bigint) AS at_ms")


#: The same views as common table expressions.
SQL = """
blk AS (SELECT o_orderkey // 1000 AS chain_id, (o_orderkey % 1000) + (o_orderkey % 1000) // 7 AS number, md5('b' || o_orderkey) AS hash,
  greatest(o_orderkey % 1000 - 1, 0) + greatest(o_orderkey % 1000 - 1, 0) // 7 AS parent_number,
  md5(CASE WHEN o_orderstatus = 'P' THEN 'x' ELSE 'b' END || (o_orderkey - 1)) AS parent_hash, o_orderkey AS key FROM orders),
txs AS (SELECT l_orderkey // 1000 AS chain_id, (l_orderkey % 1000) + (l_orderkey % 1000) // 7 AS number, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::BIGINT AS tx,
  md5('t' || l_orderkey || '/' || l_partkey) AS tx_hash,
  md5('b' || CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN l_orderkey + 1 ELSE l_orderkey END) AS block_hash,
  l_quantity::BIGINT AS gas_used, l_orderkey AS key, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_returnflag AS flag FROM lineitem),
ev AS (SELECT user_id AS chain_id, event_id AS pos, event_id, user_id, event_type, ts, floor(value)::BIGINT AS amount, props, epoch_us(ts) // 1000 AS at_ms FROM events)
"""


def oracle(body: str) -> str:
    return f"WITH {SQL} {body}"


def bundles(spark: SparkSession, d: str) -> DataFrame:
    """Raw bundles (JSON lines) of block shape: orders as headers, their lines as transactions with receipts, logs and call trees.

    Lines are gathered by block with the few columns that a transaction is made of; what is made of them comes after that, so
    neither shuffles nor sorts carry it. Each word is hashed once.
    """
    from pyspark.sql import functions as F

    def word(*parts):
        return F.concat(F.lit("0x"), F.sha2(F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256))

    def account(*parts):
        return F.substring(word(*parts), 1, 42)

    def qty(c):
        return F.concat(F.lit("0x"), F.lower(F.hex(c.cast("long"))))

    line = F.struct(*[F.col(f"l_{n}").alias(n) for n in ("linenumber", "partkey", "suppkey", "extendedprice", "quantity")])
    order = F.struct(*[F.col(f"o_{n}").alias(n) for n in ("custkey", "orderdate", "totalprice")])
    lines = spark.read.parquet(f"{d}/lineitem.parquet").filter("l_orderkey IS NOT NULL").select(F.col("l_orderkey").alias("key"), line.alias("x"))
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("key"), order.alias("o"))
    # one grouping instead of a join, whose side of lists would be taken for small and broadcast; a block's transactions are a record
    rows = orders.unionByName(lines, allowMissingColumns=True).groupBy("key").agg(F.collect_list("o").alias("o"), F.array_sort(F.collect_list("x")).alias("x")).select("key", F.explode("o").alias("o"), "x")

    key = F.col("key")

    def parts(x, i):
        places = [word(n, i).alias(n) for n in ("r", "s")]
        return F.struct(qty(i).alias("tx"), word("t", key, i).alias("hash"), account("s", x["suppkey"]).alias("from"), account("p", x["partkey"]).alias("to"), account("q", i).alias("other"), word(x["partkey"]).alias("topic"), qty(x["quantity"]).alias("used"), qty(x["quantity"] * (i + 1)).alias("total"), qty(x["suppkey"]).alias("nonce"), qty(x["extendedprice"]).alias("value"), *places)

    def transaction(x):
        return F.struct(x["tx"].alias("transactionIndex"), x["hash"].alias("hash"), x["nonce"].alias("nonce"), F.upper(x["from"]).alias("from"), x["to"].alias("to"), F.lit("0x").alias("input"), x["value"].alias("value"), F.lit("0x0").alias("type"), F.lit("0x5208").alias("gas"), x["used"].alias("gasPrice"), F.lit("0x1b").alias("v"), x["r"].alias("r"), x["s"].alias("s"))

    def receipt(x):
        log = F.struct(x["to"].alias("address"), x["tx"].alias("logIndex"), x["tx"].alias("transactionIndex"), x["hash"].alias("transactionHash"), F.lit("0x").alias("data"), F.array(x["topic"]).alias("topics"))
        return F.struct(x["hash"].alias("transactionHash"), x["used"].alias("gasUsed"), x["total"].alias("cumulativeGasUsed"), F.lit("0x1").alias("status"), F.lit("0x00").alias("logsBloom"), F.array(log).alias("logs"))

    def frame(x):
        nested = F.struct(F.lit("DELEGATECALL").alias("type"), x["to"].alias("from"), x["other"].alias("to"), F.lit("0x1").alias("gas"), F.lit("0x1").alias("gasUsed"), F.lit("0x").alias("input"))
        return F.struct(F.struct(F.lit("CALL").alias("type"), x["from"].alias("from"), x["to"].alias("to"), F.lit("0x5208").alias("gas"), x["used"].alias("gasUsed"), F.lit("0x").alias("input"), F.array(nested).alias("calls")).alias("result"))

    rows = rows.withColumn("x", F.transform("x", parts))
    head = F.struct(
        qty(key).alias("number"), word("b", key).alias("hash"), word("b", key - 1).alias("parentHash"), qty(F.expr("unix_seconds(cast(o.orderdate AS timestamp))")).alias("timestamp"), *[word(n, key).alias(n) for n in ("transactionsRoot", "receiptsRoot", "stateRoot", "sha3Uncles", "mixHash")],
        F.lit("0x" + "00" * 256).alias("logsBloom"), F.lit("0x").alias("extraData"), account("m", key).alias("miner"), F.lit("0x0000000000000000").alias("nonce"), qty(F.col("o.custkey")).alias("size"), F.lit("0x1c9c380").alias("gasLimit"), qty(F.col("o.totalprice")).alias("gasUsed"), F.lit("0x0").alias("difficulty"), F.transform("x", transaction).alias("transactions"),
    )
    return rows.select(F.to_json(F.struct(key.alias("number"), word("b", key).alias("hash"), head.alias("block"), F.transform("x", receipt).alias("receipts"), F.transform("x", frame).alias("debugFrames"))).alias("value"))
