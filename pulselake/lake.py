"""The lake: partitioned layers on any Hadoop path, lineage, purge, warehouse and export sinks."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from pulselake.operators.extract import QueryFilters
from pulselake.schemas import TABLES, TIME_COLUMNS

_LINEAGE = "layer string, table string, partition_date string, rows long, path string, operation string, recorded_at timestamp"


@dataclass
class StageResult:
    """What one run produced."""

    rows: dict[str, int] = field(default_factory=dict)
    gates: dict[str, bool] = field(default_factory=dict)
    dates: list[str] = field(default_factory=list)
    patients: int = 0


class Lake:
    """Tables under root/layer/table/partition_date=...; re-runs replace the partitions they write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, layer: str, table: str) -> str:
        return f"{self.root}/{layer}/{table}"

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def exists(self, layer: str, table: str) -> bool:
        fs, at = self._fs(self.path(layer, table))
        return fs.exists(at)

    def write(self, layer: str, table: str, df: DataFrame, mode: str = "overwrite", partition_by: tuple[str, ...] = ("partition_date",)) -> int:
        """Writes df in one run over it and returns its rows; an empty frame leaves the table as it is.

        overwrite replaces only the partitions that df has.
        """
        seen = Observation()
        day = F.col("partition_date").cast("string") if "partition_date" in df.columns else F.lit(None).cast("string")
        watched = df.observe(seen, F.count("*").alias("rows"), F.min(day).alias("first"), F.max(day).alias("last"))
        keys = [c for c in partition_by if c in df.columns]
        existed = self.exists(layer, table)
        if not keys and mode == "overwrite" and existed and df.isEmpty():
            return 0  # without partitions an empty write would replace the table
        writer = watched.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(*keys) if keys else writer).parquet(self.path(layer, table))
        got = seen.get
        if not got["rows"]:
            if not existed:
                fs, at = self._fs(self.path(layer, table))
                fs.delete(at, True)
            return 0
        self.record(layer, table, f"{got['first']}..{got['last']}", got["rows"], mode)
        return got["rows"]

    def read(self, layer: str, table: str, filters: QueryFilters = QueryFilters()) -> DataFrame:
        """A table with filters pushed to the scan; a missing table is empty, with its schema."""
        declared = TABLES.get((layer, table))
        schema = T._parse_datatype_string(declared) if declared else None
        if not self.exists(layer, table):
            return self.spark.createDataFrame([], schema or T.StructType([]))
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        df = reader.parquet(self.path(layer, table))
        time = next((c for c in TIME_COLUMNS.get(layer, []) if c in df.columns), None)
        return df.where(filters.predicate(df.columns, time))

    def partitions(self, layer: str, table: str) -> list[str]:
        """Sorted partition dates, from the partition column alone."""
        if not self.exists(layer, table):
            return []
        return [str(r[0]) for r in self.read(layer, table).select("partition_date").distinct().orderBy("partition_date").collect()]

    def record(self, layer: str, table: str, partition: str, rows: int, operation: str) -> None:
        """Appends a lineage line."""
        row = [(layer, table, partition, rows, self.path(layer, table), operation, datetime.now())]
        self.spark.createDataFrame(row, _LINEAGE).coalesce(1).write.mode("append").json(f"{self.root}/_lineage")

    def lineage(self) -> DataFrame:
        try:
            return self.spark.read.schema(_LINEAGE).json(f"{self.root}/_lineage").orderBy("recorded_at")
        except AnalysisException:
            return self.spark.createDataFrame([], _LINEAGE)

    def purge(self, layer: str, table: str, patients: DataFrame) -> bool:
        """Erases the patients' rows and returns whether any went.

        Touched partitions are rewritten in a folder of this run; each old one is moved aside before
        its replacement is moved in, and deleted only when all are in place. What a stopped run left
        is put back first, so a stop at any point loses no row: the partition that was aside without
        a replacement comes back, and the same call erases it anew. One purge of a table at a time.
        """
        runs = f"{self.root}/_purge/{layer}/{table}"
        self._restore(runs, self.path(layer, table))
        if not self.exists(layer, table):
            return False
        df = self.read(layer, table)
        hit = df.join(patients.select("patient_id"), "patient_id", "left_semi")
        dates = [r[0] for r in hit.select("partition_date").distinct().collect()]
        if not dates:
            return False
        kept, aside = df.where(F.col("partition_date").isin(*dates)).join(patients.select("patient_id"), "patient_id", "left_anti"), f"{runs}/{uuid.uuid4().hex}"
        kept.write.mode("overwrite").partitionBy("partition_date").parquet(f"{aside}/new")
        for d in dates:
            part = f"partition_date={d.isoformat() if isinstance(d, date) else d}"
            self._move(f"{self.path(layer, table)}/{part}", f"{aside}/old/{part}")
            if self._there(f"{aside}/new/{part}"):
                self._move(f"{aside}/new/{part}", f"{self.path(layer, table)}/{part}")
        self._remove(aside)
        for empty in (runs, f"{self.root}/_purge/{layer}", f"{self.root}/_purge"):
            fs, at = self._fs(empty)
            if fs.exists(at) and not len(fs.listStatus(at)):
                fs.delete(at, False)
        return True

    def _restore(self, runs: str, table: str) -> None:
        """Puts back the partitions that stopped runs moved aside and did not replace, then drops what they left."""
        for run in self._list(runs):
            for old in self._list(f"{run}/old"):
                target = f"{table}/{old.rpartition('/')[2]}"
                if not self._there(target):
                    self._move(old, target)
            self._remove(run)

    def _there(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def _list(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return [x.getPath().toString() for x in fs.listStatus(at)] if fs.exists(at) else []

    def _move(self, source: str, target: str) -> None:
        fs, at = self._fs(source)
        to = self._fs(target)[1]
        fs.mkdirs(to.getParent())
        if not fs.rename(at, to):
            raise OSError(f"{source} could not be moved to {target}")

    def _remove(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)


def write_warehouse(df: DataFrame, path: str, day: str, cluster: list[str]) -> None:
    """Day-partitioned, clustered within partitions."""
    df.withColumn("day", F.to_date(day)).repartition("day").sortWithinPartitions(*cluster).write.mode("overwrite").partitionBy("day").parquet(path)


def biometrics(silver: DataFrame) -> DataFrame:
    """Heart-rate rows of silver for the warehouse: rounded, with their LOINC code."""
    return silver.where("metric_type = 'heart_rate'").select("patient_id", "window_start", F.round("metric_value").cast("int").alias("heart_rate"), F.lit("8867-4").alias("loinc"))


def csv_to_trusted(spark: SparkSession, source: str, target: str, schema: str, required: list[str], ingestion_date: date) -> DataFrame:
    """CSV with a header to Parquet by ingestion date, without rows lacking a required column."""
    df = spark.read.schema(schema).option("header", True).csv(source).dropna(subset=required).withColumn("ingestion_date", F.lit(ingestion_date))
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ingestion_date").parquet(target)
    return spark.read.parquet(target)


def latest_knowledge(spark: SparkSession, target: str) -> DataFrame:
    """The rows of the newest ingestion date."""
    df = spark.read.parquet(target)
    return df.join(F.broadcast(df.agg(F.max("ingestion_date").alias("ingestion_date"))), "ingestion_date", "left_semi")


def export_features(df: DataFrame, path: str, form: str = "csv") -> None:
    """Training CSV or JSON lines; missing numbers are 0."""
    numeric = [n for n, t in df.dtypes if t in ("int", "bigint", "double", "float")]
    filled = df.fillna(0, subset=numeric)
    filled.write.mode("overwrite").option("header", True).csv(path) if form == "csv" else filled.write.mode("overwrite").json(path)


def export_training_text(corpus: DataFrame, path: str) -> None:
    """One text file set: a header line with the document id, then the text."""
    corpus.select(F.concat(F.lit("### document "), F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")))).write.mode("overwrite").text(path)


def export_predictions(predictions: DataFrame, path: str) -> None:
    """One JSON folder per scenario."""
    predictions.write.mode("overwrite").partitionBy("scenario").json(path)
