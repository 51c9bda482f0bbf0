"""The batch run from bronze to gold as one job that reports what it did (K8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.lake import Lake, StageResult
from pulselake.operators import bronze as bronze_ops
from pulselake.operators import gold
from pulselake.operators.silver import reconcile


def run_batch(spark: SparkSession, root: str, readings: DataFrame, window_seconds: int = 5) -> StageResult:
    """Validates, reconciles and aggregates readings into a lake; rows come from the writes' own observations.

    Each layer is read back from the lake for the next one, so no stage is computed twice. Gates are
    two one-row aggregates each.
    """
    lake, result = Lake(spark, root), StageResult()

    def stage(layer: str, table: str, df: DataFrame) -> DataFrame:
        result.rows[table] = lake.write(layer, table, df)
        return spark.read.parquet(lake.path(layer, table)) if result.rows[table] else df.limit(0)

    raw = stage("bronze", "device_readings", bronze_ops.validate(readings))
    silver = stage("silver", "vitals_reconciled", reconcile(raw, window_seconds))
    dated = lambda df, c: df.withColumn("partition_date", F.to_date(c))
    hourly = stage("gold", "hourly_vitals", dated(gold.hourly_vitals(silver, window_seconds), "hour_bucket"))
    daily = stage("gold", "daily_summary", dated(gold.daily_summary(silver, hourly, window_seconds), "summary_date"))
    stage("gold", "patient_alerts", dated(gold.patient_alerts(silver), "window_start"))
    result.gates["bronze"] = gold.bronze_gate(raw, silver).first()["passed"]
    result.gates["gold"] = gold.gold_gate(hourly, daily).first()["passed"]
    seen = silver.agg(F.min("partition_date").cast("string"), F.max("partition_date").cast("string"), F.count_distinct("patient_id")).first()
    result.dates, result.patients = [d for d in seen[:2] if d], seen[2]
    return result


def as_frame(spark: SparkSession, result: StageResult) -> DataFrame:
    """A result as one row."""
    names = {"device_readings": "bronze_rows", "vitals_reconciled": "silver_rows", "hourly_vitals": "hourly_rows", "daily_summary": "daily_rows", "patient_alerts": "alert_rows"}
    row = [result.rows.get(t, 0) for t in names] + [result.patients, *(result.dates or [None, None]), result.gates.get("bronze"), result.gates.get("gold")]
    schema = ", ".join(f"{c} long" for c in names.values()) + ", patients long, first_date string, last_date string, bronze_gate boolean, gold_gate boolean"
    return spark.createDataFrame([tuple(row)], schema)
