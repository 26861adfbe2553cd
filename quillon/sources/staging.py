"""Tables in the folder that driver and executors share, which cut the lineage of iterative operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local session gets a temporary folder and a cluster is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="quillon-"))


class Rounds:
    """Tables of an iteration, one for each round, read together or one by one.  They last as long as the driver, as results that read them may."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}", []
        self.schema = None
        atexit.register(self.drop)

    def add(self, df: DataFrame) -> DataFrame:
        """Writes a round and returns it as read back."""
        path = f"{self.folder}/{len(self.paths)}"
        df.write.parquet(path)
        self.schema = self.schema or df.schema
        self.paths.append(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)

    def drop(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
