"""Schemas of the lake's layers, and its limits."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Bronze readings, one row each.
BRONZE = (
    "event_id string, patient_id string, device_id string, device_type string, vendor string, metric_type string, metric_value double, unit string,"
    " timestamp_utc timestamp, ingested_at timestamp, source string, battery_level double, signal_confidence double, raw_payload string,"
    " quality_flags array<string>, rejection_reason string, partition_date date"
)
SILVER = (
    "record_id string, patient_id string, window_start timestamp, window_end timestamp, metric_type string, metric_value double, metric_std double, unit string,"
    " devices_involved array<string>, reading_count int, quality_score double, quality_flags array<string>, is_anomaly boolean, anomaly_score double,"
    " activity_context string, sleep_context string, processed_at timestamp, partition_date date"
)
GOLD_HOURLY = (
    "patient_id string, hour_bucket timestamp, avg_heart_rate double, min_heart_rate double, max_heart_rate double, avg_spo2 double, avg_hrv double,"
    " total_steps int, avg_stress double, reading_coverage double, anomaly_count int, risk_score double, partition_date date"
)
GOLD_DAILY = (
    "patient_id string, summary_date date, avg_resting_hr double, max_hr double, min_hr double, total_steps int, sleep_hours double, deep_sleep_pct double,"
    " avg_spo2 double, avg_hrv double, stress_peak double, anomaly_episodes int, coverage_24h double, clinical_risk_level string, partition_date date"
)
GOLD_ALERTS = (
    "alert_id string, patient_id string, alert_type string, severity string, metric_type string, trigger_value double, threshold double,"
    " window_start timestamp, window_end timestamp, duration_minutes double, devices_involved array<string>, created_at timestamp"
)
TABLES = {
    ("bronze", "telemetry"): BRONZE,
    ("silver", "telemetry"): SILVER,
    ("gold", "hourly_vitals"): GOLD_HOURLY,
    ("gold", "daily_summary"): GOLD_DAILY,
    ("gold", "patient_alerts"): GOLD_ALERTS,
}
#: The time column that a layer's time filter uses, first found.
TIME_COLUMNS = {"bronze": ["timestamp_utc"], "silver": ["window_start"], "gold": ["hour_bucket", "summary_date", "window_start"]}


def _ranges() -> dict[str, tuple[float, float]]:
    return {"heart_rate": (30, 220), "spo2": (70, 100), "hrv": (5, 250), "steps": (0, 500), "stress_index": (0, 100), "skin_temp": (30, 42), "respiratory_rate": (8, 40)}


@dataclass(frozen=True)
class LakeConfig:
    """Limits of the pipeline."""

    window_seconds: int = 5
    min_quality: float = 0.6
    min_coverage: float = 0.85
    ranges: dict[str, tuple[float, float]] = field(default_factory=_ranges)
