"""Silver: reconciliation of readings in tumbling windows and context-aware anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.functions.scalar import bucket, lookup, mean, rnd, stable_id

UNITS = {"heart_rate": "bpm", "spo2": "%", "hrv": "ms", "steps": "count", "stress_index": "index"}
#: metric: (low, high, critical high)
LIMITS = {"heart_rate": (45.0, 120.0, 150.0), "spo2": (92.0, 100.0, None), "hrv": (15.0, 200.0, None), "stress_index": (None, 75.0, 85.0)}


def anomaly_score(metric: Column, value: Column, activity: Column, sleep: Column) -> Column:
    """Relative distance outside the limits for the context, 1 beyond the critical one; null if none is crossed."""
    at = lambda k: lookup(metric, {m: v[k] for m, v in LIMITS.items() if v[k] is not None})
    hr = metric == "heart_rate"
    active, asleep = hr & (activity == "active"), hr & (activity != "active") & sleep.isin("deep_sleep", "light_sleep")
    low = F.when(asleep, 40.0).otherwise(at(0))
    high = F.when(active, 160.0).when(asleep, 90.0).otherwise(at(1))
    critical = F.when(active, 190.0).otherwise(at(2))
    return F.when(value > critical, 1.0).when(value > high, F.least(F.lit(1.0), (value - high) / high)).when(value < low, F.least(F.lit(1.0), (low - value) / low))


def context(payload: Column, key: str) -> Column:
    """A context name out of a JSON payload; null if it has none."""
    return F.get_json_object(payload, f"$.{key}")


def reconcile(readings: DataFrame, window_seconds: int = 5) -> DataFrame:
    """One row per patient, metric and window: mean, deviation, devices, quality, anomaly, contexts.

    One shuffle on (patient, metric, window); the first context by time is a minimum over
    (time, event), so no list of readings is gathered.
    """
    first = lambda key: F.coalesce(F.min_by(key, F.when(F.col(key).isNotNull(), F.struct("timestamp_utc", "event_id"))), F.lit("unknown"))
    given = readings.where(F.col("metric_value").isNotNull() & F.col("timestamp_utc").isNotNull()).withColumns(
        {"window_start": bucket(F.col("timestamp_utc"), window_seconds), "activity": context(F.col("raw_payload"), "activity_context"), "sleep": context(F.col("raw_payload"), "sleep_context")}
    )
    grouped = given.groupBy("patient_id", "metric_type", "window_start").agg(
        mean(F.col("metric_value"), 3).alias("value"),
        F.coalesce(F.stddev_samp("metric_value"), F.lit(0.0)).alias("std"),
        F.sort_array(F.collect_set("device_id")).alias("devices_involved"),
        F.count("event_id").cast("int").alias("reading_count"),
        F.avg("signal_confidence").alias("confidence"),
        first("activity").alias("activity_context"),
        first("sleep").alias("sleep_context"),
    )
    spread = F.least(F.col("std") / F.greatest(F.col("value"), F.lit(1.0)), F.lit(0.3))
    score = anomaly_score(F.col("metric_type"), F.col("value"), F.col("activity_context"), F.col("sleep_context"))
    scored = grouped.withColumn("score", score)
    odd = F.col("score").isNotNull()
    return scored.select(
        stable_id(F.col("patient_id"), F.col("metric_type"), F.unix_seconds("window_start")).alias("record_id"),
        "patient_id",
        "window_start",
        F.timestamp_seconds(F.unix_seconds("window_start") + window_seconds).alias("window_end"),
        "metric_type",
        rnd("value", 2).alias("metric_value"),
        rnd("std", 2).alias("metric_std"),
        lookup(F.col("metric_type"), UNITS, "unit").alias("unit"),
        "devices_involved",
        "reading_count",
        rnd(F.least(F.lit(1.0), F.col("confidence") * (1 - spread)), 3).alias("quality_score"),
        F.when(odd, F.array(F.lit("reconciled"), F.lit("out_of_range"))).otherwise(F.array(F.lit("reconciled"))).alias("quality_flags"),
        odd.alias("is_anomaly"),
        rnd(F.coalesce("score", F.lit(0.0)), 3).alias("anomaly_score"),
        "activity_context",
        "sleep_context",
        F.to_date("window_start").alias("partition_date"),
    )
