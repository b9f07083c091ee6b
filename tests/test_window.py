"""The window's transitions against an independent model, and the stateful operator against the transitions."""

import json
import random

import pytest

from blockloom.plans import queries as qu
from blockloom.streaming.buffer import Block, KeyedWindow, Marks, RestartLadder, Violation, Window, held_blocks, held_marks, window_stream


def chain(n, tag="a", start=0, parent=None):
    out, prev = [], parent or (start, f"g{start}")
    for i in range(start + (0 if parent is None else 1), start + n):
        out.append(Block(i, f"{tag}{i}", prev[0] if parent or i > start else i, prev[1] if parent or i > start else "root"))
        prev = out[-1].ref
    return out


def test_append_reorg_and_violations():
    w = Window(tuple(chain(5)))
    assert w.push(w.blocks[2]) is w
    fork = Block(4, "b4", 3, "a3")
    assert [b.hash for b in w.push(fork).blocks] == ["a0", "a1", "a2", "a3", "b4"]
    for bad, kind in [(Block(2, "a2", 1, "zz"), "equivocation"), (Block(9, "x", 9, "x"), "descending"), (Block(5, "x", 4, "zz"), "parent mismatch"), (Block(9, "x", 7, "x"), "parent not buffered")]:
        with pytest.raises(Violation) as e:
            w.push(bad)
        assert e.value.kind == kind
    final = w.finalize(3, "a3")
    with pytest.raises(Violation) as e:
        final.push(Block(3, "b3", 2, "a2"))
    assert e.value.kind == "below finality"


def test_finality():
    w = Window(tuple(chain(6))).finalize(3, "a3")
    assert w.finalize(1, "other").final == 3
    assert w.finalize(99, "later").final == 5
    with pytest.raises(Violation, match="finality mismatch"):
        w.finalize(4, "zz")
    with pytest.raises(Violation, match="conflicting reports"):
        w.apply([], (4, "a4")).apply([], (4, "zz"))


def test_batches_apply_whole_or_not():
    w = Window(tuple(chain(3)))
    with pytest.raises(Violation):
        w.apply([Block(3, "a3", 2, "a2"), Block(4, "a4", 3, "zz")])
    assert len(w.blocks) == 3


def test_compaction_keeps_finality():
    w = Window(tuple(chain(10)), most=4)
    assert len(w.compact().blocks) == 10 and w.compact().excess == 6
    assert [b.number for b in w.finalize(7, "a7").compact().blocks] == [6, 7, 8, 9]
    assert [b.number for b in w.finalize(3, "a3").compact().blocks] == list(range(3, 10))
    forced = Window(tuple(chain(10)), most=4, force=True).compact()
    assert forced.forced_past == 5 and forced.finalized.number == 6 and len(forced.blocks) == 4


def test_fork_base():
    w = Window(tuple(chain(10))).finalize(4, "a4")
    assert w.fork_base([(6, "b6"), (7, "b7")]) == (5, "a5")
    assert w.fork_base([(6, "a6"), (7, "b7")]) == (6, "a6")
    assert w.fork_base([(0, "b0"), (7, "b7")]) is None


def test_random_histories_keep_the_invariants():
    rng = random.Random(5)
    for _ in range(60):
        w, known = Window(tuple(chain(1)), most=6), {(0, "a0"): None}
        for step in range(60):
            parent = rng.choice(list(known))
            new = Block(parent[0] + rng.randint(1, 2), f"h{rng.randint(0, 40)}-{step}", *parent)
            report = rng.choice([None, rng.choice(w.blocks).ref])
            before = w
            try:
                w = w.apply([new], report)
                known[new.ref] = parent
            except Violation:
                assert w is before
            assert all((a.number, a.hash) == (b.parent_number, b.parent_hash) and a.number < b.number for a, b in zip(w.blocks, w.blocks[1:], strict=False))
            assert w.finalized.number >= before.finalized.number
            assert len(w.blocks) <= 6 or w.final == 0
            assert Window.load(w.dump()) == w


def same_window(keyed, store, model):
    """Whether a keyed window's state is the model's window."""
    m = keyed.marks
    assert (m.first, m.head, m.final, m.size, m.report) == (model.blocks[0].number, model.head.number, model.finalized.number, len(model.blocks), model.report)
    assert {n: (e[0], e[1], e[2]) for n, e in store.items()} == {b.number: (b.hash, b.parent_number, b.parent_hash) for b in model.blocks}
    assert all(store[a.number][3] == b.number for a, b in zip(model.blocks, model.blocks[1:], strict=False)) and store[model.head.number][3] is None


@pytest.mark.parametrize("force", [False, True])
def test_keyed_window_equals_the_model(force):
    rng = random.Random(9)
    for _ in range(80):
        seed = Block(0, "a0", 0, "root")
        model, store = Window((seed,), most=6, force=force), {}
        keyed = KeyedWindow(store.get, None, 6, force)
        keyed.seed(seed)
        known, kinds = {seed.ref: seed}, set()
        for step in range(70):
            for n, e in keyed.changed.items():
                store.pop(n, None) if e is None else store.__setitem__(n, e)
            same_window(keyed, store, model)
            keyed = KeyedWindow(store.get, keyed.marks, 6, force)
            batch = []
            for k in range(rng.choice([1, 1, 2, 4])):
                kind = rng.random()
                parent = rng.choice([*known.values(), model.head, model.head, *batch])
                new = Block(parent.number + rng.choice([1, 1, 1, 2, 7]), f"h{step}.{k}", *parent.ref)
                if kind < 0.1:
                    new = rng.choice(list(known.values()))
                elif kind < 0.2:
                    new = Block(*rng.choice(list(known.values())).ref, parent.number, "zz")
                elif kind < 0.25:
                    new = Block(new.number, new.hash, rng.randint(0, new.number + 2), "zz")
                batch.append(new)
            report = rng.choice([None, None, rng.choice(model.blocks).ref, (model.head.number + 3, "later"), (rng.choice(model.blocks).number + 1, "zz")])
            prev = [rng.choice(list(known)) for _ in range(rng.randint(0, 3))]
            assert keyed.fork_base(prev) == model.fork_base(prev)
            try:
                after = model.apply(batch, report)
            except Violation as e:
                with pytest.raises(Violation) as own:
                    keyed.apply(batch, report)
                assert (own.value.kind, own.value.number) == (e.kind, e.number)
                kinds.add(e.kind)
                keyed.undo()
            else:
                keyed.apply(batch, report)
                model = after
                known.update((b.ref, b) for b in batch)
        assert len(kinds) > 2


def test_state_that_is_written_grows_with_the_batch(spark):
    c = chain(3000)
    rows = events([(c[:2000], None, None), *[(c[2000 + 10 * k : 2010 + 10 * k], None, None) for k in range(100)]])
    got = window_stream(spark.createDataFrame(rows, SCHEMA), most=5000).orderBy("batch").collect()
    assert got[0].written == 2000 and all(r.written == 11 for r in got[1:]) and got[-1].size == 3000


def test_queries_over_the_live_window(spark, tmp_path):
    """A stream's state answers as the model does, after each trigger, and after a restart from the checkpoint."""
    c, src, cp = chain(40), str(tmp_path / "src"), str(tmp_path / "cp")
    batches = [(c[:12], None, None), (c[12:25], (9, "a9"), None), ([Block(23, "b23", 22, "a22"), Block(24, "b24", 23, "b23")], (15, "a15"), None)]
    model, want = Window((c[0],), most=10), []
    for k, (blocks, report, _) in enumerate(batches):
        model = model.apply(blocks[1:] if k == 0 else blocks, report)
        want.append(model)
        rows = [(*r[:1], k, *r[2:8], f"p{r[4]}", *r[9:]) for r in events([(blocks, report, None)])]
        spark.createDataFrame([*rows, *[("2", *r[1:]) for r in rows]], SCHEMA).coalesce(1).write.mode("append").json(src)
        stream = window_stream(spark.readStream.schema(SCHEMA).json(src), most=10)  # a new query each time, from the checkpoint
        stream.writeStream.format("noop").option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination(120)
        for version in range(k + 1):
            held, m = held_blocks(spark, cp, "1", version), want[version]
            assert sorted((r.number, r.hash, r.payload) for r in held.collect()) == [(b.number, b.hash, f"p{b.hash}") for b in m.blocks]
            marks = held_marks(spark, cp, version).filter("chain_id = '1'").first()
            assert (marks.first, marks.head, marks.final, marks.version) == (m.blocks[0].number, m.head.number, m.finalized.number, version + 1)
            w = qu.watermarks(held, marks.final).first()
            assert (tuple(w.head), tuple(w.finalized)) == (m.head.ref, m.finalized.ref)
    held = held_blocks(spark, cp, "1")
    assert [r.hash for r in qu.query(held, 22, "a21").blocks.collect()] == ["a22", "b23", "b24"]
    assert qu.query(held, 24, "a23").kind == "conflict" and qu.query(held, 3).kind == "below" and qu.query(held, 25, "b24").kind == "empty"
    assert Marks(*held_marks(spark, cp).filter("chain_id = '2'").drop("chain_id").first()).report == (15, "a15")


def test_restart_ladder():
    ladder = RestartLadder()
    assert [ladder.ended(False) for _ in range(6)] == [(0.0, False), (30.0, False), (30.0, False), (30.0, False), (30.0, False), (30.0, True)]
    assert ladder.ended(True) == (0.0, False)


def events(batches):
    rows = []
    for k, (blocks, report, fork) in enumerate(batches):
        for pos, b in enumerate(blocks or [Block(0, "", 0, "")]):
            rows.append(("1", k, pos, b.number, b.hash, b.parent_number, b.parent_hash, None, None, *(report or (None, None)), json.dumps(fork) if fork else None))
    return rows


SCHEMA = "chain_id string, batch long, pos long, number long, hash string, parent_number long, parent_hash string, timestamp long, payload string, report_number long, report_hash string, fork_prev string"


def test_stateful_operator(spark):
    c = chain(8)
    rows = events([(c[:3], None, None), (c[3:6], (2, "a2"), None), ([Block(9, "x", 8, "y")], None, None), (None, None, [[5, "b5"]]), ([Block(5, "b5", 4, "a4")], None, None)])
    got = window_stream(spark.createDataFrame(rows, SCHEMA)).orderBy("batch").collect()
    assert [r.outcome for r in got] == ["applied", "applied", "parent not buffered", "rebase 4", "applied"]
    assert (got[-1].head_hash, got[-1].finalized_hash, got[-1].size) == ("b5", "a2", 6)


def test_stream_equals_table(spark, tmp_path):
    c = chain(9)
    rows = events([(c[:3], None, None), (c[3:6], (2, "a2"), None), (c[6:], (4, "a4"), None)])
    df = spark.createDataFrame(rows, SCHEMA)
    src = str(tmp_path / "src")
    for k in range(3):
        df.filter(f"batch = {k}").coalesce(1).write.mode("append").json(src)
    stream = window_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(src))
    run = stream.writeStream.format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    head = spark.sql("SELECT max_by(struct(head_number, finalized_number, size), version) FROM windows").first()[0]
    want = window_stream(df).orderBy("batch").collect()[-1]
    assert tuple(head) == (want.head_number, want.finalized_number, want.size)


def test_queries(spark):
    b = [x for x in chain(200)][100:]
    w = spark.createDataFrame([(x.number, x.hash, x.parent_number, x.parent_hash) for x in b], "number long, hash string, parent_number long, parent_hash string")
    assert qu.query(w, 150, "a149").blocks.count() == 50
    assert qu.query(w, 50).kind == "below" and qu.query(w, 200, "a199").kind == "empty" and qu.query(w, 300, "zz").kind == "empty"
    got = qu.query(w, 150, "zz")
    assert got.kind == "conflict" and got.prev[0] == (99, "a99") and got.prev[-1] == (149, "a149") and len(got.prev) == 51
    top = qu.query(w, 200, "zz")
    assert top.kind == "conflict" and len(top.prev) == 100 and top.prev[-1] == (199, "a199")
    archive = spark.createDataFrame([(x.number, x.hash, x.parent_number, x.parent_hash) for x in chain(200)[:100]], w.schema)
    assert qu.resolve(archive, w, 40).blocks.count() == 160
    with pytest.raises(LookupError):
        qu.backfill(archive.filter("number < 90"), w, 40)
    assert qu.wait_for(lambda: w, 500, seconds=0.2).kind == "empty"
