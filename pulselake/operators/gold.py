"""Gold: hourly vitals, daily summaries, alerts, risk, wellness and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulselake.functions.scalar import all_of, rnd, stable_id

#: metric: [(alert, above?, threshold, severity)] in the order they are tried.
ALERTS = {"heart_rate": [("tachycardia", True, 120.0, "high"), ("bradycardia", False, 45.0, "medium")], "spo2": [("hypoxemia", False, 92.0, "critical")], "stress_index": [("high_stress", True, 80.0, "medium")]}


def of(metric: str, value: str = "metric_value") -> Column:
    """A value where the row is of a metric, else null."""
    return F.when(F.col("metric_type") == metric, F.col(value))


def risk_score(hr: Column, spo2: Column, stress: Column, anomalies: Column) -> Column:
    """Sum of penalties of null-aware means; 1 at most."""
    zero = F.lit(0.0)
    parts = F.when(hr > 100, F.least(F.lit(0.4), (hr - 100) / 100)).when(hr < 50, 0.3).otherwise(zero) + F.when(spo2 < 94, 0.3).otherwise(zero) + F.when(stress > 70, 0.2).otherwise(zero)
    return F.least(F.lit(1.0), rnd(parts + F.least(F.lit(0.3), anomalies * 0.05), 3))


def risk_level(risk: Column, episodes: Column) -> Column:
    return F.when((risk >= 0.7) | (episodes >= 10), "critical").when((risk >= 0.4) | (episodes >= 5), "elevated").when(risk >= 0.2, "moderate").otherwise("low")


def hourly_vitals(silver: DataFrame, window_seconds: int = 5) -> DataFrame:
    """One row per patient and hour by conditional aggregates; a metric without rows is 0."""
    none = lambda c, a: F.coalesce(c, F.lit(0.0)).alias(a)
    hr, spo2, stress = F.avg(of("heart_rate")), F.avg(of("spo2")), F.avg(of("stress_index"))
    anomalies = F.count_if("is_anomaly")
    return silver.groupBy("patient_id", F.date_trunc("hour", "window_start").alias("hour_bucket")).agg(
        none(hr, "avg_heart_rate"),
        none(F.min(of("heart_rate")), "min_heart_rate"),
        none(F.max(of("heart_rate")), "max_heart_rate"),
        none(spo2, "avg_spo2"),
        none(F.avg(of("hrv")), "avg_hrv"),
        F.coalesce(F.max(of("steps")), F.lit(0.0)).cast("int").alias("total_steps"),
        none(stress, "avg_stress"),
        F.least(F.lit(1.0), F.count(of("heart_rate")) * float(window_seconds) / 3600).alias("reading_coverage"),
        anomalies.cast("int").alias("anomaly_count"),
        risk_score(hr, spo2, stress, anomalies).alias("risk_score"),
    )


def daily_summary(silver: DataFrame, hourly: DataFrame, window_seconds: int = 5, match_date: bool = False) -> DataFrame:
    """One row per patient and day; coverage and risk come from the patient's hours (of the day with match_date).

    Resting heart rate is the mean of resting windows, else of the lowest quarter. The quarter is
    taken by rank within (patient, day), so no list is gathered.
    """
    dated = silver.withColumn("summary_date", F.to_date("window_start"))
    by_value = W.partitionBy("patient_id", "summary_date", "metric_type").orderBy("metric_value", "window_start")
    counted = dated.withColumn("nth", F.row_number().over(by_value)).withColumn("of", F.count("*").over(W.partitionBy("patient_id", "summary_date", "metric_type")))
    lowest = F.when(F.col("nth") <= F.greatest(F.lit(1), F.floor(F.col("of") / 4)), of("heart_rate"))
    zero = F.lit(0.0)
    days = counted.groupBy("patient_id", "summary_date").agg(
        F.coalesce(F.avg(F.when(F.col("activity_context") == "resting", of("heart_rate"))), F.avg(lowest), zero).alias("avg_resting_hr"),
        F.coalesce(F.max(of("heart_rate")), zero).alias("max_hr"),
        F.coalesce(F.min(of("heart_rate")), zero).alias("min_hr"),
        F.coalesce(F.max(of("steps")), zero).cast("int").alias("total_steps"),
        (F.count_if(F.col("sleep_context") != "awake") * float(window_seconds) / 3600).alias("sleep"),
        F.coalesce(F.avg(of("spo2")), zero).alias("avg_spo2"),
        F.coalesce(F.avg(of("hrv")), zero).alias("avg_hrv"),
        F.coalesce(F.max(of("stress_index")), zero).alias("stress_peak"),
        F.count_if("is_anomaly").cast("int").alias("anomaly_episodes"),
    )
    keys = ["patient_id", "summary_date"] if match_date else ["patient_id"]
    hours = hourly.withColumn("summary_date", F.to_date("hour_bucket")).groupBy(*keys).agg(F.avg("reading_coverage").alias("coverage"), F.max("risk_score").alias("risk"))
    return days.join(hours, keys, "left").select(
        "patient_id", "summary_date", "avg_resting_hr", "max_hr", "min_hr", "total_steps",
        rnd("sleep", 2).alias("sleep_hours"), rnd(F.col("sleep") / 24 * 100, 1).alias("deep_sleep_pct"),
        "avg_spo2", "avg_hrv", "stress_peak", "anomaly_episodes",
        F.least(F.lit(1.0), F.coalesce("coverage", zero)).alias("coverage_24h"),
        risk_level(F.coalesce("risk", zero), F.col("anomaly_episodes")).alias("clinical_risk_level"),
    )


def patient_alerts(silver: DataFrame) -> DataFrame:
    """One row per anomalous window that a rule matches."""
    alert = None
    for metric, rules in ALERTS.items():
        for name, above, limit, severity in rules:
            hit = (F.col("metric_type") == metric) & (F.col("metric_value") > limit if above else F.col("metric_value") < limit)
            made = F.struct(F.lit(name).alias("alert_type"), F.lit(severity).alias("severity"), F.lit(limit).alias("threshold"))
            alert = F.when(hit, made) if alert is None else alert.when(hit, made)
    return silver.where("is_anomaly").withColumn("a", alert).where("a is not null").select(
        stable_id(F.lit("alert"), F.col("patient_id"), F.col("metric_type"), F.unix_seconds("window_start")).alias("alert_id"),
        "patient_id", "a.alert_type", "a.severity", "metric_type", F.col("metric_value").alias("trigger_value"), "a.threshold", "window_start", "window_end",
        ((F.unix_seconds("window_end") - F.unix_seconds("window_start")) / 60).alias("duration_minutes"), "devices_involved",
    )


def wellness_daily(records: DataFrame) -> DataFrame:
    """Daily totals and means of wide records with the wellness score; a missing heart rate counts as 70."""
    days = records.groupBy("user_id", "date").agg(
        F.sum("steps").alias("total_steps"), rnd(F.avg("heart_rate_bpm"), 2).alias("avg_heart_rate"), rnd(F.sum("calories_burned"), 2).alias("total_calories"),
        rnd(F.avg("spo2"), 2).alias("avg_spo2"), F.sum("sleep_duration_min").alias("total_sleep_min"),
    )
    hr = F.coalesce("avg_heart_rate", F.lit(70.0))
    steps, sleep = F.least(F.lit(100.0), F.col("total_steps") / 100), F.least(F.lit(100.0), F.col("total_sleep_min") / 4.8)
    return days.withColumn("overall_score", rnd((steps + sleep + 100 - F.abs(hr - 70) * 1.5) / 3, 1))


def bronze_gate(bronze: DataFrame, silver: DataFrame, min_quality: float = 0.6) -> DataFrame:
    """One row: counts, named checks and whether all hold, from two one-row aggregates."""
    b = bronze.agg(F.count("*").alias("total"), F.count_if(F.col("signal_confidence") >= 0.5).alias("valid"))
    s = silver.agg(F.count("*").alias("produced"), F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("avg_quality"))
    ratio = F.col("produced") / F.nullif("total", F.lit(0))
    checks = all_of({"has_data": F.col("total") > 0, "silver_produced": F.col("produced") > 0, "ratio": F.coalesce(ratio.between(0.05, 1.0), F.lit(False)), "quality": F.col("avg_quality") >= min_quality})
    return b.join(s).withColumn("checks", checks).withColumn("passed", F.forall(F.map_values("checks"), lambda c: c))


def gold_gate(hourly: DataFrame, daily: DataFrame, min_coverage: float = 0.85) -> DataFrame:
    """One row: whether both gold tables have rows and the least daily coverage holds."""
    h = hourly.agg(F.count("*").alias("hourly_rows"))
    d = daily.agg(F.count("*").alias("daily_rows"), F.min("coverage_24h").alias("least_coverage"))
    checks = all_of({"gold_hourly_produced": F.col("hourly_rows") > 0, "gold_daily_produced": F.col("daily_rows") > 0, "coverage": F.coalesce(F.col("least_coverage") >= min_coverage * 0.5, F.lit(False))})
    return h.join(d).withColumn("checks", checks).withColumn("passed", F.forall(F.map_values("checks"), lambda c: c))
