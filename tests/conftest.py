import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{shared}").config("spark.sql.warehouse.dir", f"{shared}/warehouse").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="session")
def same_rows():
    """Checks that a DataFrame has the rows of a DuckDB query; returns how many."""
    return _same_rows


def _same_rows(df, con, sql):
    cols = sorted(df.columns)
    got = con.sql(sql)
    assert sorted(got.columns) == cols
    at = [got.columns.index(c) for c in cols]
    mine = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    assert mine == sorted(tuple(str(r[i]) for i in at) for r in got.fetchall())
    return len(mine)
