import os

import pytest
from pyspark.sql import functions as F

from blockloom.sources import segments
from blockloom.sources.segments import Entry, Segment, Store, held, store, suffix


def chain(spark, low, high, tag="a"):
    return spark.range(low, high, 1, 4).select(F.col("id").alias("number"), F.concat(F.lit(tag), "id").alias("hash"))


def rows(df):
    return sorted((r.number, r.hash) for r in df.collect())


def want(low, high, tag="a"):
    return [(n, f"{tag}{n}") for n in range(low, high)]


def test_range_reads_only_its_segments(spark, tmp_path):
    path = str(tmp_path / "s")
    for low in range(0, 400, 100):
        store(chain(spark, low, low + 100), path, rows=10)
    assert rows(held(spark, path)) == want(0, 400)
    near = held(spark, path, 255, 262)
    assert rows(near) == want(255, 263)
    mine = [s for s in Store(path).segments() if s.low <= 262 and s.high >= 255]
    assert {os.path.basename(f) for f in near.inputFiles()} == {s.name for s in mine} and len(mine) < len(Store(path).segments()) / 4
    # entries outside the range aren't opened, but for the last, which holds the schema
    for e in Store(path).entries()[:-1]:
        if e.high < 255 or e.low > 262:
            with open(f"{path}/log/{e.name}", "w") as f:
                f.write("unreadable")
    assert rows(held(spark, path, 255, 262)) == want(255, 263)


def test_rewind_overwrite_and_suffix(spark, tmp_path):
    path = str(tmp_path / "s")
    store(chain(spark, 0, 100), path, rows=1000)
    store(chain(spark, 60, 80, "b"), path, rewind="true")
    assert rows(held(spark, path)) == want(0, 60) + want(60, 80, "b")
    store(chain(spark, 30, 40, "c"), path, rewind="true")
    assert rows(held(spark, path)) == want(0, 30) + want(30, 40, "c") and rows(held(spark, path, 50)) == []
    store(chain(spark, 40, 50, "d"), path)
    assert rows(held(spark, path, 35)) == want(35, 40, "c") + want(40, 50, "d")
    assert rows(suffix(spark, path, chain(spark, 45, 60, "w"), 38)) == want(38, 40, "c") + want(40, 45, "d") + want(45, 60, "w")
    Store(path).fold()
    assert len(Store(path).entries()) == 1 and rows(held(spark, path)) == want(0, 30) + want(30, 40, "c") + want(40, 50, "d")
    store(chain(spark, 5, 8, "z"), path, "overwrite")
    assert rows(held(spark, path)) == want(5, 8, "z")
    assert Store(path).vacuum(0) > 0 and rows(held(spark, path)) == want(5, 8, "z")


def test_failed_job_leaves_no_record(spark, tmp_path):
    path = str(tmp_path / "s")
    store(chain(spark, 0, 20), path)

    def dies(batches):
        for b in batches:
            yield b
        if b["number"].max() == 59:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        chain(spark, 20, 60).mapInPandas(dies, "number long, hash string").write.format("block_segments").options(path=path, rows=2).mode("append").save()
    assert rows(held(spark, path)) == want(0, 20) and len(Store(path).entries()) == 1
    Store(path).vacuum(0)
    assert set(os.listdir(f"{path}/data")) == {s.name for s in Store(path).segments()}
    store(chain(spark, 20, 60), path)
    assert rows(held(spark, path)) == want(0, 60)


def test_stream_run_again_adds_nothing(spark, tmp_path):
    segments.register(spark)
    path, src, ck = str(tmp_path / "s"), str(tmp_path / "in"), str(tmp_path / "ck")

    def feed(df):
        df.coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema("number long, hash string").option("maxFilesPerTrigger", 1).parquet(src)
        stream.writeStream.format("block_segments").options(path=path, checkpointLocation=ck).trigger(availableNow=True).start().awaitTermination()

    def uncommit():
        """As if the driver had died between the sink's commit and its own."""
        for name in (str(last), f".{last}.crc"):
            os.remove(f"{ck}/commits/{name}")

    feed(chain(spark, 0, 30))
    run()
    feed(chain(spark, 25, 40, "b"))  # a fork: the batch rewinds
    run()
    assert rows(held(spark, path)) == want(0, 25) + want(25, 40, "b")
    files = set(os.listdir(f"{path}/data"))
    last = max((int(f) for f in os.listdir(f"{ck}/commits") if f.isdigit()))
    uncommit()
    run()
    assert rows(held(spark, path)) == want(0, 25) + want(25, 40, "b") and set(os.listdir(f"{path}/data")) == files
    Store(path).fold()
    uncommit()
    run()
    assert rows(held(spark, path)) == want(0, 25) + want(25, 40, "b")
    assert Store(path)._last(Store(path).entries(), "main") == last


def test_log_folds_by_itself(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    own = Store(path)
    for n in range(2 * segments.FOLD + 5):
        own.commit([Segment(f"{n}.parquet", n, n, 1)], "{}", "main", n, True)
    assert len(own.entries()) < segments.FOLD and [s.low for s in own.segments()] == list(range(2 * segments.FOLD + 5))
    assert [s.low for s in own.segments(150, 152)] == [150, 151, 152] and own._last(own.entries(), "main") == 2 * segments.FOLD + 4


def test_odd_inputs(spark, tmp_path):
    path = str(tmp_path / "s")
    store(chain(spark, 0, 0), path)
    assert held(spark, path).columns == ["number", "hash"] and held(spark, path).count() == 0
    with pytest.raises(Exception, match="needs a height"):
        store(spark.createDataFrame([(None, "x")], "number long, hash string"), path)
    with pytest.raises(Exception, match="column number"):
        spark.range(1).write.format("block_segments").option("path", path).mode("append").save()
    with pytest.raises(ValueError, match="nothing is stored"):
        held(spark, str(tmp_path / "none"))
    e = Entry(7, 1, 9, None, "a_b", 3)
    assert Entry.of(e.name) == e and held(spark, path).count() == 0
