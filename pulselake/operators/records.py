"""Record keeping: statistics, minute buckets, summaries, registry, upserts, erasure, run log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def layer_stats(layers: dict[str, list[DataFrame]]) -> DataFrame:
    """Per layer: distinct partitions, rows, distinct patients."""
    light = [t.select(F.lit(layer).alias("layer"), "partition_date", "patient_id") for layer, tables in layers.items() for t in tables]
    return reduce(DataFrame.unionByName, light).groupBy("layer").agg(F.countDistinct("partition_date").alias("partitions"), F.count("*").alias("n_rows"), F.countDistinct("patient_id").alias("patients"))


def minute_buckets(readings: DataFrame, metrics: dict[str, str] | None = None) -> DataFrame:
    """Per user, source and minute the last value of each metric; every sleep stage row adds five minutes."""
    metrics = metrics or {"heart_rate": "heart_rate_bpm", "spo2": "spo2", "hrv": "hrv", "steps": "steps"}
    at = F.struct("timestamp_utc", "event_id")
    last = [F.max_by("metric_value", F.when(F.col("metric_type") == m, at)).alias(name) for m, name in metrics.items()]
    return readings.groupBy("user_id", "source", F.date_trunc("minute", "timestamp_utc").alias("minute")).agg(*last, (5 * F.count_if(F.col("metric_type") == "sleep_stage")).alias("sleep_duration_min"), F.count("*").alias("events"))


def user_summary(records: DataFrame, newest: int = 500) -> DataFrame:
    """Over each user's newest records: count, sources, newest non-zero vitals, newest clinical record."""
    nth = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("date"), F.desc("record_id")))
    at = F.struct("date", "record_id")
    latest = [F.max_by(c, F.when(F.coalesce(F.col(c), F.lit(0)) != 0, at)).alias(c) for c in ("heart_rate_bpm", "spo2", "steps")]
    kept = records.withColumn("nth", nth).where(F.col("nth") <= newest)
    return kept.groupBy("user_id").agg(F.count("*").alias("record_count"), F.sort_array(F.collect_set("source")).alias("sources"), *latest, F.max_by("record_id", F.when(F.col("source") == "fhir", at)).alias("latest_fhir"))


def source_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("source").agg(F.count("*").alias("records"), F.countDistinct("user_id").alias("users"))


def list_records(records: DataFrame, user_id: str | None = None, source: str | None = None, limit: int = 100) -> DataFrame:
    """Newest first, 1 to 1000 rows."""
    for column, value in (("user_id", user_id), ("source", source)):
        if value is not None:
            records = records.where(F.col(column) == value)
    return records.orderBy(F.desc("date"), F.desc("record_id")).limit(max(1, min(1000, limit)))


def purge(table: DataFrame, patients: DataFrame) -> DataFrame:
    """table without the rows of the listed patients."""
    return table.join(patients.select("patient_id"), "patient_id", "left_anti")


def register_devices(bindings: DataFrame) -> DataFrame:
    """The first binding of each patient and device, by nth."""
    return bindings.groupBy("patient_id", "device_id").agg(F.min("nth").alias("nth"), F.min_by("is_primary", "nth").alias("is_primary"))


def primary_devices(bindings: DataFrame) -> DataFrame:
    """Per patient its devices and the first primary one, else the first."""
    return bindings.groupBy("patient_id").agg(F.sort_array(F.collect_list("device_id")).alias("devices"), F.min_by("device_id", F.struct(~F.col("is_primary"), "nth")).alias("primary_device"))


def upsert(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row per key; of each column the latest non-null value."""
    return rows.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("nth = 1").drop("nth")


def latest_runs(log: DataFrame) -> DataFrame:
    """The last entry of each run of an append-only log (run_id, status, records, at), newest first."""
    return log.groupBy("run_id").agg(F.max_by(F.struct("status", "records"), "at").alias("r"), F.max("at").alias("at")).select("run_id", "r.*", "at").orderBy(F.desc("at"), "run_id")
