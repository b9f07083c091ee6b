"""Late legs, alarms and rates: streams against their table forms and a plain model."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from blockloom.plans import metrics as me
from blockloom.streaming.timers import alarms, late_legs, late_legs_stream

ANSWERS = "chain_id long, number long, leg string, answer string, at_ms long"
LEGS = ["receipts", "logs", "traces"]


def faults():
    """Blocks whose data lag, contradict their header, heal, or never come."""
    rows, t = [], 1_000_000

    def block(number, *answers):
        rows.extend((1, number, leg, answer, t + at) for leg, answer, at in answers)

    whole = [("logs", "ready", 0), ("traces", "ready", 5)]
    block(1, *whole, ("receipts", "ready", 1))
    block(2, *whole, *[("receipts", "late", 50 * k) for k in range(15)], ("receipts", "ready", 800))  # beyond the bound of the incoherent
    block(3, *whole, *[("receipts", "wrong", 50 * k) for k in range(10)], ("receipts", "ready", 500))  # as often as is borne
    block(4, *whole, *[("receipts", "wrong", 50 * k) for k in range(11)], ("receipts", "ready", 600))  # once more
    block(5, *whole, *[("receipts", "late", 100 * k) for k in range(20)])
    block(6, ("receipts", "late", 0), ("logs", "ready", 4000), ("receipts", "ready", 5001))
    block(7, ("receipts", "ready", 0), ("header", "wrong", 10), ("logs", "ready", 4999), ("traces", "ready", 5000))
    block(8, *[("header", "wrong", 3) for _ in range(12)], *whole, ("receipts", "ready", 3))
    rows.append((9, 1, "logs", "ready", t + 60_000))
    return rows


WANT = {
    (1, 1): ("whole", 5, ""), (1, 2): ("whole", 800, ""), (1, 3): ("whole", 500, ""), (1, 4): ("incoherent", 500, "receipts"), (1, 5): ("not ready", 5000, "receipts"),
    (1, 6): ("not ready", 5000, "receipts,traces"), (1, 7): ("whole", 5000, ""), (1, 8): ("incoherent", 3, "traces"), (9, 1): ("not ready", 5000, "receipts,traces"),
}


def streamed(spark, tmp_path, df, schema, parts, make, name):
    """A stream over the rows in order of time, in so many triggers; its rows."""
    src = str(tmp_path / name)
    rows = sorted(df.collect(), key=lambda r: r.at_ms)
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").json(src)
        time.sleep(0.02)
    run = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)).writeStream.format("memory").queryName(name).option("checkpointLocation", src + "-cp").trigger(availableNow=True).start()
    run.awaitTermination(180)
    return spark.table(name).collect()


def test_late_legs(spark, tmp_path):
    df = spark.createDataFrame(faults(), ANSWERS)
    got = late_legs(df, LEGS, budget_ms=5000).collect()
    assert {(r.chain_id, r.number): (r.outcome, r.waited_ms, r.missing) for r in got} == WANT
    # the last block's own end needs a later row, of another block, to bring the watermark there
    later = df.unionAll(spark.createDataFrame([(7, 7, "logs", "ready", 1_200_000), (7, 8, "logs", "ready", 1_200_001)], ANSWERS))
    own = streamed(spark, tmp_path, later, ANSWERS, 5, lambda s: late_legs_stream(s, LEGS, budget_ms=5000, event_time=True), "legs")
    assert Counter(tuple(r) for r in own if r.chain_id != 7) == Counter(tuple(r) for r in got)


def test_blocks_wait_in_state(spark, tmp_path):
    """Without any further answer a block is given up when its time is over."""
    src = str(tmp_path / "src")
    spark.createDataFrame([(1, 5, "logs", "ready", 0)], ANSWERS).write.json(src)
    run = late_legs_stream(spark.readStream.schema(ANSWERS).json(src), LEGS, budget_ms=1500).writeStream.format("memory").queryName("waiting").option("checkpointLocation", src + "-cp").trigger(processingTime="200 milliseconds").start()
    end = time.time() + 90
    while not spark.table("waiting").count() and time.time() < end:
        time.sleep(0.3)
    run.stop()
    assert [(r.number, r.outcome, r.waited_ms, r.missing) for r in spark.table("waiting").collect()] == [(5, "not ready", 1500, "receipts,traces")]


ROWS = "chain_id long, kind string, number long, at_ms long"


def test_rates_and_stalls_equal_the_table_form(spark, tmp_path):
    rng, rows, t = random.Random(3), [], 10_000_000
    for chain in (1, 2):
        at, up, got = t, 0, 0
        for _ in range(150):
            at += rng.choice([50, 200, 700, 4000])
            up += rng.choice([0, 1, 2])
            rows.append((chain, "upstream", up, at))
            if rng.random() < 0.5 and got < up:
                got = rng.choice([got + 1, up])
                rows.append((chain, "commit", got, at + 1))
    df = spark.createDataFrame([*rows, (3, "upstream", 1, t + 10**7), (3, "upstream", 1, t + 10**7 + 1)], ROWS)
    got = [r for r in streamed(spark, tmp_path, df, ROWS, 6, lambda s: alarms(s, 3000, 1000, event_time=True), "alarms") if r.chain_id < 3]
    per = df.filter("kind = 'commit'").groupBy("chain_id", F.expr("at_ms DIV 1000").alias("slot")).agg(F.count("*").alias("n"))
    want = {(r.chain_id, (r.slot + 1) * 1000): r.rate for r in me.rate(per, "slot", "n", 1000, ["chain_id"]).collect()}
    rates = {(r.chain_id, r.at_ms): r.value for r in got if r.event == "rate"}
    assert {k: rates.get(k) for k in want} == want and len(rates) > len(want)
    events = []
    for chain in (1, 2):
        up, done, last, behind, raised = -1, -1, 0, 0, False
        for _, kind, number, at in sorted((r for r in rows if r[0] == chain), key=lambda r: r[3]) + [(chain, "end", 0, t + 10**7)]:
            if up > done and not raised and at >= max(last, behind) + 3000:
                raised = True
                events.append((chain, "stall raised", max(last, behind) + 3000))
            if kind == "upstream":
                behind, up = (at if up <= done < number else behind), max(up, number)
            elif kind == "commit":
                done, last = max(done, number), at
                events += [(chain, "stall cleared", at)] if raised else []
                raised = False
    assert sorted((r.chain_id, r.event, r.at_ms) for r in got if r.event != "rate") == sorted(events) and len(events) > 6


def test_an_alarm_without_input(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(1, "commit", 5, 0), (1, "upstream", 9, 1)], ROWS).coalesce(1).write.json(src)
    run = alarms(spark.readStream.schema(ROWS).json(src), 1500, 500).writeStream.format("memory").queryName("quiet").option("checkpointLocation", src + "-cp").trigger(processingTime="200 milliseconds").start()

    def seen(event):
        end = time.time() + 90
        while time.time() < end:
            found = [r for r in spark.table("quiet").collect() if r.event == event]
            if found:
                return found
            time.sleep(0.3)

    assert seen("stall raised")[0].value == 4.0 and seen("rate")
    spark.createDataFrame([(1, "commit", 9, 2)], ROWS).coalesce(1).write.mode("append").json(src)
    assert seen("stall cleared")[0].value == 0.0
    run.stop()
