"""Feature rows for models: eleven batch features of a patient's day, eight online features of a window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulselake.functions.scalar import lookup

# Feature columns, label of each risk level, defaults of absent vitals.
BATCH = ("avg_resting_hr", "max_hr", "min_hr", "avg_spo2", "avg_hrv", "total_steps", "sleep_hours", "stress_peak", "anomaly_episodes", "coverage_24h", "total_alerts")
ONLINE = ("bpm", "spo2", "hrv", "stress", "quality_score", "hour_of_day", "is_active", "is_sleeping")
RISK_LABEL = {"low": 0, "moderate": 1, "elevated": 2, "critical": 3}
DEFAULTS = {"heart_rate": 0.0, "spo2": 97.0, "hrv": 50.0, "quality_score": 1.0}


def batch_features(daily: DataFrame, alerts: DataFrame) -> DataFrame:
    """daily with total_alerts, every feature a double (absent: 0), and risk_label (unknown level: 0)."""
    counted = alerts.groupBy("patient_id").agg(F.count("*").alias("total_alerts"))
    rows = daily.join(counted, "patient_id", "left")
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in rows.columns else F.lit(0.0) for c in BATCH}
    return rows.withColumns({**filled, "risk_label": lookup(F.col("clinical_risk_level"), RISK_LABEL, 0).cast("int")})


def online_features(vitals: DataFrame, newest: int | None = 50) -> DataFrame:
    """patient_id, ts and the ONLINE features of each patient's newest windows (all without newest)."""
    have = set(vitals.columns)
    value = lambda c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(DEFAULTS[c])) if c in have else F.lit(DEFAULTS[c])
    rows = vitals
    if newest:
        nth = F.row_number().over(W.partitionBy("patient_id").orderBy(F.desc("window_start")))
        rows = rows.withColumn("_nth", nth).where(F.col("_nth") <= newest)
    hour = F.hour("window_start")
    return rows.select(
        "patient_id", F.col("window_start").alias("ts"), value("heart_rate").alias("bpm"), value("spo2").alias("spo2"), value("hrv").alias("hrv"), F.lit(0.0).alias("stress"),
        value("quality_score").alias("quality_score"), hour.alias("hour_of_day"), hour.between(8, 17).cast("int").alias("is_active"), ((hour < 6) | (hour >= 22)).cast("int").alias("is_sleeping"),
    )
