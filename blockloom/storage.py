"""Tables in the folder that driver and executors share, which cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, as in tests, a folder of this process; the session's settings stay as they are."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that driver and executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="blockloom-shared-"))
    return base.rstrip("/")


_OWN: dict[str, str] = {}


class Kept:
    """A DataFrame written once; ``drop`` deletes it when nothing reads it any more."""

    def __init__(self, df: DataFrame, what: str):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/blockloom/{what}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        spark = self.df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
