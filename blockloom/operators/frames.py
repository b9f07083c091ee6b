"""Call trees of debug frames: flattening, structural and semantic checks, normalised traces."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from blockloom.functions.quantities import frame_kind, frame_type, is_address
from blockloom.storage import Kept

_TEXT = ("type", "from", "to", "value", "gas", "gasUsed", "input", "output", "error", "revertReason")
FRAME_TYPE = T.StructType(
    [T.StructField("place", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("path", T.ArrayType(T.LongType())), T.StructField("subtraces", T.LongType()), *(T.StructField(n, T.StringType()) for n in _TEXT)]
)


def flatten(root: dict) -> list[tuple]:
    """The tree's frames in pre-order, without recursion, so that its depth is no limit."""
    out, todo = [], [(root, (), None)]
    while todo:
        frame, path, parent = todo.pop()
        calls = frame.get("calls") or []
        place = len(out)
        out.append((place, parent, list(path), len(calls), *(None if frame.get(k) is None else str(frame[k]) for k in _TEXT)))
        todo.extend((c, (*path, i), place) for i, c in reversed(list(enumerate(calls))))
    return out


def _text(value) -> str | None:
    return value if value is None or type(value) is str else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def _walked(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Frames of trees (keys, result: JSON text) of any depth, in pre-order, ``MOST_FRAMES`` or a tree more at a time."""
    for batch in batches:
        keys, trees = batch.select(range(batch.num_columns - 1)), batch.column(batch.num_columns - 1)
        rows, out = [], []

        def flushed():
            taken = keys.take(pa.array(rows, pa.int64()))
            own = [pa.array(c, schema.field(taken.num_columns + i).type) for i, c in enumerate(zip(*out, strict=True))]
            rows.clear(), out.clear()
            return pa.RecordBatch.from_arrays([*taken.columns, *own], schema=schema)

        for row, tree in enumerate(trees):
            todo, first = [(json.loads(tree.as_py()), (), None)], len(out)
            while todo:
                frame, path, parent = todo.pop()
                frame = frame if isinstance(frame, dict) else {}
                calls, place = frame.get("calls"), len(out) - first
                calls = calls if isinstance(calls, list) else ()
                out.append((place, parent, path, len(calls), *[_text(frame.get(k)) for k in _TEXT]))
                if calls:
                    todo += [(c, (*path, i), place) for i, c in zip(range(len(calls) - 1, -1, -1), reversed(calls), strict=True)]
            rows += [row] * (len(out) - first)
            if len(out) >= MOST_FRAMES:
                yield flushed()
        if out:
            yield flushed()


#: Levels of a tree that is read with a schema; and frames of deeper trees that a task makes at a time.
LEVELS, MOST_FRAMES = 4, 20_000


def _node_type(levels: int) -> str:
    fields = [f"`{n}`: string" for n in _TEXT] + ([f"`calls`: array<{_node_type(levels - 1)}>"] if levels > 1 else [])
    return f"struct<{', '.join(fields)}>"


def lists(tree: Column) -> Column:
    """How many call lists a tree's JSON text has, at most: one with fewer than ``LEVELS`` is no deeper."""
    return F.regexp_count(tree, F.lit('"calls"'))


def low_frames(tree: Column) -> Column:
    """Frames (``FRAME_TYPE``) in pre-order of the JSON text of a tree of at most ``LEVELS`` levels, read with a schema of that depth.

    Levels go from the root down; a frame's place is its caller's, one, and the sizes of what its caller calls before it.
    """

    def size(node: Column, levels: int) -> Column:
        if levels == 1:
            return F.lit(1)
        return F.when(F.size(node["calls"]) > 0, F.aggregate(node["calls"], F.lit(1), lambda n, c: n + size(c, levels - 1))).otherwise(1)

    def one(node: Column, path: Column, place: Column, parent: Column, levels: int) -> Column:
        calls = node["calls"] if levels > 1 else None
        n = F.when(calls.isNotNull(), F.size(calls)).otherwise(0) if levels > 1 else F.lit(0)
        own = F.array(F.struct(place.alias("place"), parent.alias("parent"), path.alias("path"), n.cast("long").alias("subtraces"), *[node[t].alias(t) for t in _TEXT]))
        if levels == 1:
            return own

        def kid(c: Column, i: Column) -> Column:
            before = place + 1 if levels == 2 else F.aggregate(F.slice(calls, F.lit(1), i), place + 1, lambda m, other: m + size(other, levels - 1))
            return one(c, F.array_append(path, i.cast("long")), before + i if levels == 2 else before, place, levels - 1)

        return F.when(n > 0, F.concat(own, F.flatten(F.transform(calls, kid)))).otherwise(own)

    root = F.from_json(tree, _node_type(LEVELS))
    return F.transform(F.array(root), lambda v: one(v, F.expr("cast(array() AS array<bigint>)"), F.lit(0), F.lit(None).cast("int"), LEVELS))[0]  # an array of one, so that it is parsed once


def frames_of(blocks: DataFrame) -> DataFrame:
    """A row for each frame of each block: number, tx (position), and the frame's columns. A null entry has none.

    A tree with fewer call lists than ``LEVELS``, and so no deeper, is read with a schema of so many levels; others are walked. Both are
    expanded where they are, without a shuffle.
    """
    # outer, as a filter inferred from an inner one would read each bundle once more
    per = blocks.select("number", F.posexplode_outer("debugFrames").alias("tx", "entry")).select("number", "tx", F.col("entry.txHash").alias("tx_hash"), F.col("entry.result").alias("result")).filter("result IS NOT NULL")
    per = Kept(per.withColumn("_lists", lists(F.col("result"))), "trees").df
    keys, shown = ["number", "tx", "tx_hash"], ["place", "parent", "path", "subtraces", *_TEXT]
    out = per.filter(F.col("_lists") < LEVELS).select(*keys, F.explode(low_frames(F.col("result"))).alias("f")).select(*keys, *[f"f.`{n}`" for n in shown])
    most = per.agg(F.max("_lists")).first()[0] or 0
    if most >= LEVELS:
        schema = out.schema
        own = to_arrow_schema(schema)
        deep = per.filter(F.col("_lists") >= LEVELS).select(*keys, "result").mapInArrow(lambda batches: _walked(batches, own), schema)
        out = out.unionByName(deep)
    return out


def _found(rows: DataFrame, violation: Column) -> DataFrame:
    """Rows with a violation, which is worked out once: generated, as a filter on a column would hold its expression again."""
    return rows.select("*", F.explode_outer(F.array(violation)).alias("violation")).filter("violation IS NOT NULL")


def structure_violations(frames: DataFrame) -> DataFrame:
    """(number, tx, place, violation): the first frame in pre-order that no node can have written."""
    kind = frame_kind("type")
    call_like = kind.isin("CALL", "CALLCODE", "DELEGATECALL", "STATICCALL")
    bad = (
        F.when(kind == "UNKNOWN", F.concat(F.lit("unknown frame type "), F.coalesce("type", F.lit("null"))))
        .when((kind == "STOP") & (F.size("path") > 0), "nested STOP frame")
        .when(~F.coalesce(is_address("from"), F.lit(False)), "malformed from")
        .when((call_like | kind.isin("SELFDESTRUCT", "SUICIDE")) & F.col("to").isNull(), "missing to")
        .when((F.coalesce("to", F.lit("")) != "") & ~is_address("to"), "malformed to")
        .when(call_like & F.col("input").isNull(), "missing input")
        .when((call_like | kind.isin("CREATE", "CREATE2")) & F.col("gasUsed").isNull(), "missing gasUsed")
    )
    found = _found(frames, bad)
    return found.groupBy("number", "tx").agg(F.min_by(F.struct("place", "violation"), "place").alias("v")).select("number", "tx", "v.*")


def _account(name: Column | str) -> Column:
    """An account for comparing without regard to case, in 21 bytes where it is an address; others keep their text."""
    c = F.col(name) if isinstance(name, str) else name
    twenty = F.when((F.length(c) == 42) & (F.lower(F.substring(c, 1, 2)) == "0x"), F.unhex(F.substring(c, 3, 40)))
    return F.coalesce(F.concat(F.lit(b"\x01"), twenty), F.concat(F.lit(b"\x00"), F.lower(c).cast("binary")))


def tree_violations(frames: DataFrame, txs: DataFrame) -> DataFrame:
    """(number, tx, place, violation) of frames that contradict their transaction or their caller.

    A root has its transaction's sender and receiver; a frame's ``from`` is the account in whose name its caller runs:
    the caller's ``to``, or its ``from`` where the caller is a delegated call. ``txs``: number, tx, from_address, to_address.
    """
    own = F.when(frame_kind("type").isin("DELEGATECALL", "CALLCODE"), F.col("from")).otherwise(F.col("to"))
    # each frame twice: as one that calls, at its place, and as one that was called, at its caller's; a window over both needs no join
    caller = F.struct(F.col("place").alias("at"), _account(own).alias("context"), F.lit(None).cast("binary").alias("name"), F.lit(None).cast("int").alias("place"))
    called = F.struct(F.col("parent").alias("at"), F.lit(None).cast("binary").alias("context"), _account("from").alias("name"), F.col("place").alias("place"))
    at = frames.select("number", "tx", F.inline_outer(F.array(caller, called))).filter("at IS NOT NULL")
    w = Window.partitionBy("number", "tx", "at")
    nested = at.withColumn("_least", F.min("context").over(w)).withColumn("_most", F.max("context").over(w)).filter("name <> _least OR name <> _most")
    nested = nested.select("number", "tx", "place", F.lit("from is not the executing account").alias("violation"))
    create = (frame_type("type") == "create").alias("create")
    roots = frames.filter("parent IS NULL").select("number", "tx", "place", create, _account("from").alias("from"), _account("to").alias("to"))
    roots = roots.join(txs.select("number", "tx", _account("from_address").alias("sender"), _account("to_address").alias("receiver")), ["number", "tx"])
    bad = (
        F.when(F.col("from") != F.col("sender"), "root from is not the sender")
        .when(F.col("receiver").isNull() & ~F.col("create"), "a creation's root must create")
        .when(F.col("receiver").isNotNull() & F.col("create"), "a call's root must not create")
        .when(F.col("receiver").isNotNull() & (F.col("to") != F.col("receiver")), "root to is not the receiver")
    )
    roots = _found(roots, bad).select("number", "tx", "place", "violation")
    return roots.unionByName(nested)


def report_violations(found: DataFrame, mode: str, samples: int = 3) -> DataFrame:
    """Validation by mode. off: nothing. observe: (number, count, samples), the first few in order. reject: (number, reason)."""
    if mode not in ("off", "observe", "reject"):
        raise ValueError(f"unknown validation mode {mode}")
    if mode == "off":
        return found.select("number").limit(0)
    if mode == "reject":
        return found.groupBy("number").agg(F.min_by("violation", F.struct("tx", "place")).alias("reason"))
    ranked = found.withColumn("_r", F.row_number().over(Window.partitionBy("number").orderBy("tx", "place", "violation")))
    text = F.when(F.col("_r") <= samples, F.struct("_r", F.concat_ws(" ", F.lit("tx"), "tx", F.lit("frame"), "place", "violation").alias("s")))
    return ranked.groupBy("number").agg(F.count("*").alias("count"), F.transform(F.array_sort(F.collect_list(text)), lambda x: x.s).alias("samples"))


def mismatched_labels(blocks: DataFrame) -> DataFrame:
    """(number, tx) of debug entries whose label names another transaction than the one at their place."""
    labels = blocks.select("number", F.posexplode("debugFrames").alias("tx", "entry")).filter("entry.txHash IS NOT NULL")
    txs = blocks.select("number", F.posexplode("block.transactions").alias("tx", "t"))
    return labels.join(txs, ["number", "tx"], "left").filter("t IS NULL OR lower(entry.txHash) <> lower(t.hash)").select("number", "tx")


#: The fields of a trace's action and result, of every kind.
_ACTION = ("callType", "from", "to", "value", "gas", "input", "init", "address", "refundAddress", "balance")
_RESULT = ("gasUsed", "output", "code", "address")


def debug_traces(frames: Column, tx: Column) -> Column:
    """A transaction's traces from its flattened frames, null for one that stopped. ``to_json`` leaves out their null fields, so one struct has the fields of
    every kind, in an order that is each kind's own. A frame's kind is worked out once: lambdas hold an expression as often as they name it."""

    def known(f: Column) -> Column:
        return F.struct(f.alias("f"), frame_type(f["type"]).alias("kind"), F.lower(f["from"]).alias("sender"), F.lower(f["to"]).alias("to"))

    def some(names: tuple[str, ...], given: dict[str, Column]) -> Column:
        return F.struct(*[given.get(n, F.lit(None).cast("string")).alias(n) for n in names])

    def one(w: Column) -> Column:
        f, create, call = w["f"], w["kind"] == "create", w["kind"] == "call"

        def given(name: str) -> Column:
            return F.when(f[name] != "", f[name])

        data = F.coalesce(f["input"], F.lit("0x"))
        paid = {"from": w["sender"], "value": f["value"], "gas": f["gas"]}
        action = (
            F.when(call, some(_ACTION, paid | {"callType": F.lower(f["type"]), "to": w["to"], "input": data}))
            .when(create, some(_ACTION, paid | {"init": data}))
            .otherwise(some(_ACTION, {"address": w["sender"], "refundAddress": w["to"], "balance": f["value"]}))
        )
        made = create & F.coalesce(given("gasUsed"), given("output"), given("to")).isNotNull()
        ran = call & F.coalesce(f["gasUsed"], f["output"]).isNotNull()
        result = F.when(ran, some(_RESULT, {"gasUsed": f["gasUsed"], "output": f["output"]})).when(
            made, some(_RESULT, {"gasUsed": F.coalesce(given("gasUsed"), F.lit("")), "code": given("output"), "address": F.lower(given("to"))})
        )
        body = F.struct(
            tx.alias("transactionIndex"), f["path"].alias("traceAddress"), f["subtraces"].alias("subtraces"), f["error"].alias("error"), f["revertReason"].alias("revertReason"), w["kind"].alias("type"),
            action.alias("action"), result.alias("result"),
        )
        return F.when(w["kind"].isNotNull() & (create | f["to"].isNotNull()), body)

    stopped = (F.upper(F.try_element_at(frames, F.lit(1))["type"]) == "STOP") & (F.size(frames) == 1)
    return F.when(~F.coalesce(stopped, F.lit(False)), F.array_compact(F.transform(F.transform(frames, known), one)))
