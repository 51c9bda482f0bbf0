"""Session helpers: shared scratch tables, size-checked broadcasts, table reading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a two- or three-column id table that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, as Spark reads it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local one only on a local master that names none, as in tests."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if conf:
        return conf.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pulselake-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get().rstrip("/")


class Scratch:
    """Tables one job writes to the shared folder to cut lineage; they outlive lost executors."""

    #: Those made so far in this process and not cleared.
    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/pulselake/{name}-{uuid.uuid4().hex}", 0
        Scratch.made.append(self)

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes df as Parquet and returns a DataFrame that reads it."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of write() that no later plan reads."""
        self._delete(df._scratch_path)

    def clear(self) -> None:
        """Deletes all tables of this job, once nothing reads them any more."""
        self._delete(self.root)
        if self in Scratch.made:
            Scratch.made.remove(self)

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit, else df as it is (a shuffle join)."""
    return F.broadcast(df) if rows <= limit else df
