"""Driver tables seen as domain tables, in Spark and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.functions.scalar import bucket, lookup
from pulselake.operators.silver import reconcile
from pulselake.session import read_table

METRIC_OF = {"view": "heart_rate", "click": "spo2", "purchase": "hrv", "signup": "steps", "error": "stress_index"}
#: Window of the driver queries: the events of a user are days apart.
WINDOW = 3 * 86_400


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as readings."""
    e = read_table(spark, sf_dir, "events")
    hour, kind, value = F.hour("ts"), F.col("event_type"), F.col("value")
    sleep = F.when(hour < 6, "deep_sleep").when((hour < 8) | (hour >= 22), "light_sleep").otherwise("awake")
    activity = F.when((hour < 6) | (hour >= 22), "resting").when(hour < 8, "waking").when(hour < 18, "active").otherwise("moderate")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.lit("PAT-"), F.col("user_id").cast("string")).alias("patient_id"),
        F.concat_ws("-", F.lit("dev"), (F.col("user_id") % 5).cast("string"), (F.col("event_id") % 2).cast("string")).alias("device_id"),
        lookup(kind, METRIC_OF).alias("metric_type"),
        F.when(kind == "view", 40 + value).when(kind == "click", 100 - value / 10).otherwise(value).alias("metric_value"),
        F.col("ts").cast("timestamp").alias("timestamp_utc"),
        F.lit("device_stream").alias("source"),
        ((F.col("event_id") % 100) / 100.0).alias("battery_level"),
        (0.4 + 0.006 * k).alias("signal_confidence"),
        F.to_json(F.struct(activity.alias("activity_context"), sleep.alias("sleep_context"))).alias("raw_payload"),
        F.to_date("ts").alias("partition_date"),
    )


BRONZE_SQL = """bronze AS (SELECT CAST(event_id AS VARCHAR) AS event_id, 'PAT-' || user_id AS patient_id, 'dev-' || (user_id % 5) || '-' || (event_id % 2) AS device_id,
 CASE event_type WHEN 'view' THEN 'heart_rate' WHEN 'click' THEN 'spo2' WHEN 'purchase' THEN 'hrv' WHEN 'signup' THEN 'steps' WHEN 'error' THEN 'stress_index' END AS metric_type,
 CASE event_type WHEN 'view' THEN 40 + value WHEN 'click' THEN 100 - value / 10 ELSE value END AS metric_value, ts AS timestamp_utc,
 (event_id % 100) / 100.0 AS battery_level, 0.4 + 0.006 * CAST(props->>'k' AS DOUBLE) AS signal_confidence,
 CASE WHEN hour(ts) < 6 OR hour(ts) >= 22 THEN 'resting' WHEN hour(ts) < 8 THEN 'waking' WHEN hour(ts) < 18 THEN 'active' ELSE 'moderate' END AS activity,
 CASE WHEN hour(ts) < 6 THEN 'deep_sleep' WHEN hour(ts) < 8 OR hour(ts) >= 22 THEN 'light_sleep' ELSE 'awake' END AS sleep, CAST(ts AS DATE) AS partition_date FROM events)"""


def rnd(x: str, digits: int) -> str:
    """The rounding of functions.scalar.rnd, in SQL."""
    return f"(floor(({x}) * {10**digits} + 0.5 + 1e-7) / {float(10**digits)})"


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events reconciled in three-day windows."""
    return reconcile(bronze(spark, sf_dir), WINDOW)


SILVER_SQL = f"""{BRONZE_SQL},
win AS (SELECT patient_id, metric_type, to_timestamp(floor(epoch(timestamp_utc) / {WINDOW}) * {WINDOW})::TIMESTAMP AS window_start, avg(metric_value) AS v, coalesce(stddev_samp(metric_value), 0) AS s,
  list_sort(list_distinct(list(device_id))) AS devices_involved, count(*) AS reading_count, avg(signal_confidence) AS c,
  arg_min(activity, row(timestamp_utc, event_id)) AS activity_context, arg_min(sleep, row(timestamp_utc, event_id)) AS sleep_context
  FROM bronze WHERE metric_value IS NOT NULL GROUP BY 1, 2, 3),
lim AS (SELECT *, CASE WHEN metric_type = 'heart_rate' THEN CASE WHEN activity_context = 'active' THEN 45.0 WHEN sleep_context IN ('deep_sleep', 'light_sleep') THEN 40.0 ELSE 45.0 END WHEN metric_type = 'spo2' THEN 92.0 WHEN metric_type = 'hrv' THEN 15.0 END AS lo,
  CASE WHEN metric_type = 'heart_rate' THEN CASE WHEN activity_context = 'active' THEN 160.0 WHEN sleep_context IN ('deep_sleep', 'light_sleep') THEN 90.0 ELSE 120.0 END WHEN metric_type = 'spo2' THEN 100.0 WHEN metric_type = 'hrv' THEN 200.0 WHEN metric_type = 'stress_index' THEN 75.0 END AS hi,
  CASE WHEN metric_type = 'heart_rate' THEN CASE WHEN activity_context = 'active' THEN 190.0 ELSE 150.0 END WHEN metric_type = 'stress_index' THEN 85.0 END AS cr FROM win),
sc AS (SELECT *, CASE WHEN v > cr THEN 1.0 WHEN v > hi THEN least(1.0, (v - hi) / hi) WHEN v < lo THEN least(1.0, (lo - v) / lo) END::DOUBLE AS score FROM lim),
silver AS (SELECT substr(sha256(patient_id || ':' || metric_type || ':' || CAST(epoch(window_start) AS BIGINT)), 1, 16) AS record_id, patient_id, window_start, window_start + INTERVAL {WINDOW} SECOND AS window_end, metric_type,
  {rnd('v', 2)} AS metric_value, {rnd('s', 2)} AS metric_std, CASE metric_type WHEN 'heart_rate' THEN 'bpm' WHEN 'spo2' THEN '%' WHEN 'hrv' THEN 'ms' WHEN 'steps' THEN 'count' ELSE 'index' END AS unit,
  devices_involved, CAST(reading_count AS INTEGER) AS reading_count, {rnd('least(1.0, c * (1 - least(s / greatest(v, 1.0), 0.3)))', 3)} AS quality_score,
  CASE WHEN score IS NOT NULL THEN ['reconciled', 'out_of_range'] ELSE ['reconciled'] END AS quality_flags, score IS NOT NULL AS is_anomaly, {rnd('coalesce(score, 0)', 3)} AS anomaly_score,
  activity_context, sleep_context, CAST(window_start AS DATE) AS partition_date FROM sc)"""


def wide_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders and lineitem as multi-source health records: one row per order."""
    o, li = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")
    per = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.count("*").alias("n"))
    sources = F.array(*map(F.lit, ("fhir", "tcn", "google_fit", "apple_health")))
    return o.join(per, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").cast("string").alias("user_id"), F.element_at(sources, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("source"),
        F.col("o_orderkey").alias("record_id"), F.to_date("o_orderdate").alias("date"), (F.col("q") * 60).cast("long").alias("steps"),
        F.when(F.col("o_orderkey") % 7 != 0, 50 + F.col("q") / 4).cast("double").alias("heart_rate_bpm"), (F.col("q") * 2.5).cast("double").alias("calories_burned"),
        (90 + F.col("d").cast("double") * 100).alias("spo2"), (F.col("n") * 30).alias("sleep_duration_min"),
    )


WIDE_SQL = """wide AS (SELECT CAST(o_custkey AS VARCHAR) AS user_id, ['fhir', 'tcn', 'google_fit', 'apple_health'][o_orderkey % 4 + 1] AS source, o_orderkey AS record_id, CAST(o_orderdate AS DATE) AS date,
 CAST(q * 60 AS BIGINT) AS steps, CASE WHEN o_orderkey % 7 <> 0 THEN 50 + q / 4 END::DOUBLE AS heart_rate_bpm, (q * 2.5)::DOUBLE AS calories_burned, 90 + d::DOUBLE * 100 AS spo2, n * 30 AS sleep_duration_min
 FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q, avg(l_discount) AS d, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""


def gold_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Silver and the three gold tables of the driver's events."""
    from pulselake.operators import gold

    s = silver(spark, sf_dir)
    hourly = gold.hourly_vitals(s, WINDOW)
    return {"silver": s, "hourly": hourly, "daily": gold.daily_summary(s, hourly, WINDOW), "alerts": gold.patient_alerts(s)}


HOURLY_SQL = f"""{SILVER_SQL},
h0 AS (SELECT patient_id, date_trunc('hour', window_start) AS hour_bucket, avg(metric_value) FILTER (metric_type = 'heart_rate') AS hr, min(metric_value) FILTER (metric_type = 'heart_rate') AS hmin, max(metric_value) FILTER (metric_type = 'heart_rate') AS hmax,
  avg(metric_value) FILTER (metric_type = 'spo2') AS sp, avg(metric_value) FILTER (metric_type = 'hrv') AS hv, max(metric_value) FILTER (metric_type = 'steps') AS st, avg(metric_value) FILTER (metric_type = 'stress_index') AS ss,
  count(*) FILTER (metric_type = 'heart_rate') AS nh, count(*) FILTER (is_anomaly) AS an FROM silver GROUP BY 1, 2),
hourly AS (SELECT patient_id, hour_bucket, coalesce(hr, 0) AS avg_heart_rate, coalesce(hmin, 0) AS min_heart_rate, coalesce(hmax, 0) AS max_heart_rate, coalesce(sp, 0) AS avg_spo2, coalesce(hv, 0) AS avg_hrv,
  CAST(trunc(coalesce(st, 0)) AS INTEGER) AS total_steps, coalesce(ss, 0) AS avg_stress, least(1.0, nh * {float(WINDOW)} / 3600) AS reading_coverage, CAST(an AS INTEGER) AS anomaly_count,
  least(1.0, {rnd("CASE WHEN hr > 100 THEN least(0.4, (hr - 100) / 100) WHEN hr < 50 THEN 0.3 ELSE 0 END + CASE WHEN sp < 94 THEN 0.3 ELSE 0 END + CASE WHEN ss > 70 THEN 0.2 ELSE 0 END + least(0.3, an * 0.05)", 3)}) AS risk_score FROM h0)"""

DAILY_SQL = f"""{HOURLY_SQL},
rk AS (SELECT *, CAST(window_start AS DATE) AS summary_date, row_number() OVER (PARTITION BY patient_id, CAST(window_start AS DATE), metric_type ORDER BY metric_value, window_start) AS nth, count(*) OVER (PARTITION BY patient_id, CAST(window_start AS DATE), metric_type) AS n_of FROM silver),
d0 AS (SELECT patient_id, summary_date, coalesce(avg(metric_value) FILTER (metric_type = 'heart_rate' AND activity_context = 'resting'), avg(metric_value) FILTER (metric_type = 'heart_rate' AND nth <= greatest(1, n_of // 4)), 0) AS avg_resting_hr,
  coalesce(max(metric_value) FILTER (metric_type = 'heart_rate'), 0) AS max_hr, coalesce(min(metric_value) FILTER (metric_type = 'heart_rate'), 0) AS min_hr, CAST(trunc(coalesce(max(metric_value) FILTER (metric_type = 'steps'), 0)) AS INTEGER) AS total_steps,
  count(*) FILTER (sleep_context <> 'awake') * {float(WINDOW)} / 3600 AS sl, coalesce(avg(metric_value) FILTER (metric_type = 'spo2'), 0) AS avg_spo2, coalesce(avg(metric_value) FILTER (metric_type = 'hrv'), 0) AS avg_hrv,
  coalesce(max(metric_value) FILTER (metric_type = 'stress_index'), 0) AS stress_peak, CAST(count(*) FILTER (is_anomaly) AS INTEGER) AS anomaly_episodes FROM rk GROUP BY 1, 2),
hp AS (SELECT patient_id, avg(reading_coverage) AS coverage, max(risk_score) AS risk FROM hourly GROUP BY 1),
daily AS (SELECT d0.patient_id, summary_date, avg_resting_hr, max_hr, min_hr, total_steps, {rnd('sl', 2)} AS sleep_hours, {rnd('sl / 24 * 100', 1)} AS deep_sleep_pct, avg_spo2, avg_hrv, stress_peak, anomaly_episodes,
  least(1.0, coalesce(coverage, 0)) AS coverage_24h, CASE WHEN coalesce(risk, 0) >= 0.7 OR anomaly_episodes >= 10 THEN 'critical' WHEN coalesce(risk, 0) >= 0.4 OR anomaly_episodes >= 5 THEN 'elevated' WHEN coalesce(risk, 0) >= 0.2 THEN 'moderate' ELSE 'low' END AS clinical_risk_level
  FROM d0 LEFT JOIN hp ON d0.patient_id = hp.patient_id),
alerts AS (SELECT substr(sha256('alert:' || patient_id || ':' || metric_type || ':' || CAST(epoch(window_start) AS BIGINT)), 1, 16) AS alert_id, patient_id, a.t AS alert_type, a.s AS severity, metric_type, metric_value AS trigger_value, a.l AS threshold, window_start, window_end,
  CAST(epoch(window_end) - epoch(window_start) AS DOUBLE) / 60 AS duration_minutes, devices_involved FROM (SELECT *, CASE WHEN metric_type = 'heart_rate' AND metric_value > 120 THEN {{'t': 'tachycardia', 's': 'high', 'l': 120.0::DOUBLE}} WHEN metric_type = 'heart_rate' AND metric_value < 45 THEN {{'t': 'bradycardia', 's': 'medium', 'l': 45.0::DOUBLE}}
  WHEN metric_type = 'spo2' AND metric_value < 92 THEN {{'t': 'hypoxemia', 's': 'critical', 'l': 92.0::DOUBLE}} WHEN metric_type = 'stress_index' AND metric_value > 80 THEN {{'t': 'high_stress', 's': 'medium', 'l': 80.0::DOUBLE}} END AS a FROM silver WHERE is_anomaly) WHERE a IS NOT NULL)"""


#: Heart-rate readings fused by device in three-day windows, window by window (a patient has two devices).
FUSED_SQL = f"""WITH RECURSIVE {BRONZE_SQL},
h AS (SELECT patient_id AS series, CAST(floor(epoch(timestamp_utc) / {WINDOW}) AS BIGINT) AS w, device_id, arg_max(metric_value, row(timestamp_utc, event_id)) AS x FROM bronze WHERE metric_type = 'heart_rate' GROUP BY 1, 2, 3),
o AS (SELECT series, w, max(x) FILTER (device_id LIKE '%-0') AS a, max(x) FILTER (device_id LIKE '%-1') AS b, row_number() OVER (PARTITION BY series ORDER BY w) AS k FROM h GROUP BY 1, 2),
r AS (SELECT DISTINCT series, 0::BIGINT AS w, 0::BIGINT AS k, 4.0::DOUBLE AS va, 4.0::DOUBLE AS vb, NULL::DOUBLE AS fused, NULL::DOUBLE AS variance, 0 AS n_sensors FROM o UNION ALL
 SELECT o.series, o.w, o.k,
  CASE WHEN o.a IS NULL OR r.fused IS NULL THEN r.va ELSE 0.9 * r.va + 0.1 * (o.a - r.fused) ** 2 END, CASE WHEN o.b IS NULL OR r.fused IS NULL THEN r.vb ELSE 0.9 * r.vb + 0.1 * (o.b - r.fused) ** 2 END,
  CASE WHEN o.a IS NULL THEN o.b WHEN o.b IS NULL THEN o.a ELSE (o.a / r.va + o.b / r.vb) / (1 / r.va + 1 / r.vb) END,
  CASE WHEN o.a IS NULL THEN r.vb WHEN o.b IS NULL THEN r.va ELSE 1 / (1 / r.va + 1 / r.vb) END, CAST((o.a IS NOT NULL)::INT + (o.b IS NOT NULL)::INT AS INT)
 FROM r JOIN o ON o.series = r.series AND o.k = r.k + 1)"""
