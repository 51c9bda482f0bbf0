"""Queries of patient baselines, hidden signals, feature rows, jobs and their reports, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulselake.clinical import baselines, scores
from pulselake.functions.scalar import rnd as round_
from pulselake.ml import features, jobs
from pulselake.operators import gold, pipeline
from pulselake.plans import views
from pulselake.plans.base import Registry
from pulselake.plans.ml_queries import L_SQL, VALIDATION_SQL, scored_labels
from pulselake.plans.series_queries import FLOW_DOMAINS_SQL, WIDE_VITALS_SQL, lattice, wide_vitals
from pulselake.plans.views import DAILY_SQL, rnd
from pulselake.series import grid
from pulselake.session import Scratch

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

# ---- baselines

PROFILES_SQL = """ids AS (SELECT patient_id, row_number() OVER (ORDER BY patient_id) - 1 AS i FROM (SELECT DISTINCT patient_id FROM bronze)),
 prof AS (SELECT patient_id, CAST(45 + i % 20 AS INTEGER) AS age, (68 + i % 5)::DOUBLE AS resting_hr, 97.0::DOUBLE AS baseline_spo2,
  50.0::DOUBLE AS baseline_hrv, 0.1::DOUBLE * (i % 3) AS risk_factor FROM ids)"""


def profiles(spark, sf_dir):
    return baselines.default_profiles(views.bronze(spark, sf_dir).select("patient_id"))


@query(
    "patient_baselines",
    f"""WITH {views.BRONZE_SQL}, {PROFILES_SQL}
 SELECT patient_id, age, resting_hr, baseline_spo2, baseline_hrv, 'moderate' AS activity_level, {rnd('risk_factor', 4)} AS risk_factor,
  CASE WHEN age > 60 THEN 'age_related_risk' ELSE '' END AS clinical_conditions FROM prof""",
)
def patient_baselines(spark, sf_dir):
    """Default profiles of all patients as baselines."""
    return baselines.to_baseline(profiles(spark, sf_dir)).withColumn("risk_factor", round_("risk_factor", 4))


def vitals_with_baseline(spark, sf_dir):
    """Windows of each patient beside the baseline; patients of even age count as sedentary."""
    sedentary = F.when(F.col("age") % 2 == 0, "sedentary").otherwise(F.col("activity_level"))
    base = baselines.to_baseline(profiles(spark, sf_dir).withColumn("activity_level", sedentary))
    return baselines.with_baseline(wide_vitals(spark, sf_dir), base)


@query(
    "vitals_against_baseline",
    f"""WITH {WIDE_VITALS_SQL}, {PROFILES_SQL} SELECT v.patient_id, count(*) AS windows, {rnd('avg(heart_rate - resting_hr)', 5)} AS hr_deviation,
  {rnd('avg(spo2 - baseline_spo2)', 5)} AS spo2_deviation, {rnd('avg(hrv - baseline_hrv)', 5)} AS hrv_deviation
 FROM v JOIN prof USING (patient_id) GROUP BY 1""",
)
def vitals_against_baseline(spark, sf_dir):
    """Mean deviation of each vital from the patient's baseline."""
    off = lambda a, b: round_(F.avg(F.col(a) - F.col(b)), 5)
    return vitals_with_baseline(spark, sf_dir).groupBy("patient_id").agg(
        F.count("*").alias("windows"), off("heart_rate", "resting_hr").alias("hr_deviation"), off("spo2", "baseline_spo2").alias("spo2_deviation"), off("hrv", "baseline_hrv").alias("hrv_deviation")
    )


# ---- hidden signals

_SUPPRESSED = lambda part: f"greatest(0, (50 - list_avg(r[-{part}:])) / 50)"
GHOST_SQL = f"""{WIDE_VITALS_SQL}, {PROFILES_SQL},
 l AS (SELECT patient_id, coalesce(list(heart_rate ORDER BY window_start) FILTER (heart_rate IS NOT NULL), []) AS h,
   coalesce(list(hrv ORDER BY window_start) FILTER (hrv IS NOT NULL), []) AS r, coalesce(list(spo2 ORDER BY window_start) FILTER (spo2 IS NOT NULL), []) AS s,
   coalesce(list(stress ORDER BY window_start) FILTER (stress IS NOT NULL), []) AS t FROM v GROUP BY 1),
 m AS (SELECT l.*, prof.resting_hr AS b, prof.age % 2 = 0 AS still, len(h) AS n, least(12, len(h)) AS w, h[-12:] AS y, list_max(h) AS top,
   list_position(h, list_max(h)) AS pk FROM l JOIN prof USING (patient_id)),
 k AS (SELECT *, n - pk + 1 AS rest, least(10, n - pk + 1) AS size FROM m),
 g AS (SELECT patient_id,
   CASE WHEN n >= 5 AND len(r) > 0 THEN 0.6::DOUBLE * {_SUPPRESSED(10)} + 0.4::DOUBLE * greatest(0, list_avg(h[-10:]) - b) / 3 END AS autonomic_imbalance,
   CASE WHEN len(s) >= 10 THEN 2.5::DOUBLE * len(list_filter(s, lambda x: x < 95)) / len(s) + 0.5::DOUBLE * greatest(0, 97 - list_aggregate(s, 'quantile_cont', 0.1)) / 5 END AS hidden_hypoxemia,
   CASE WHEN n >= 5 AND still AND list_avg(t[-10:]) > 60 AND list_sum(list_transform(range(1, w + 1), lambda i: (i - (w + 1) / 2) * y[i])) / (w * (w * w - 1) / 12) > 0.3
     THEN list_avg(t[-10:]) / 100 END AS stress_activity_decoupling,
   CASE WHEN n >= 15 THEN 5 * list_aggregate(list_transform(range(2, n + 1), lambda i: h[i] - h[i - 1]), 'stddev_pop') / greatest(1, list_avg(h)) END AS pulse_irregularity,
   CASE WHEN n >= 20 AND len(r) > 0 AND rest > 5 THEN 0.5::DOUBLE * greatest(0, 1 - (top - h[pk + size - 1]) / size / 2) + 0.5::DOUBLE * {_SUPPRESSED(5)} END AS recovery_deficit,
   CASE WHEN n >= 24 THEN greatest(0, (b * 0.08::DOUBLE - (list_avg(h[1:n // 2]) - list_avg(h[n // 2 + 1:]))) / greatest(1, b * 0.08::DOUBLE)) END AS circadian_desync FROM k),
 u AS (UNPIVOT g ON COLUMNS(* EXCLUDE patient_id) INTO NAME signal VALUE raw),
 ghost AS (SELECT patient_id, signal, {rnd('least(1, raw)', 6)} AS value, {rnd("CASE signal WHEN 'autonomic_imbalance' THEN 0.9 WHEN 'hidden_hypoxemia' THEN 0.85 WHEN 'stress_activity_decoupling' THEN 0.7 WHEN 'pulse_irregularity' THEN 1.0 WHEN 'recovery_deficit' THEN 0.65 ELSE 0.55 END::DOUBLE", 6)} AS confidence
  FROM u WHERE {rnd('least(1, raw)', 6)} > 0.05)"""


@query("ghost_signals", f"WITH {GHOST_SQL} SELECT * FROM ghost")
def ghost_signals(spark, sf_dir):
    """Hidden signals of all patients against their baselines."""
    return scores.ghost_signals(vitals_with_baseline(spark, sf_dir))


@query(
    "ghost_domains",
    f"""WITH {GHOST_SQL} SELECT patient_id, {rnd("least(1, coalesce(sum(0.3::DOUBLE * value) FILTER (signal = 'autonomic_imbalance'), 0))", 6)} AS cardiovascular,
  {rnd("least(1, coalesce(sum(0.3::DOUBLE * value) FILTER (signal = 'hidden_hypoxemia'), 0))", 6)} AS respiratory, {rnd("least(1, sum(0.1::DOUBLE * confidence))", 6)} AS monitoring
 FROM ghost GROUP BY 1""",
)
def ghost_domains(spark, sf_dir):
    """Domain scores out of hidden signals."""
    return scores.ghost_domains(scores.ghost_signals(vitals_with_baseline(spark, sf_dir)))


@query("flow_domains", FLOW_DOMAINS_SQL)
def flow_domains(spark, sf_dir):
    """Domain scores out of the irregularities of every field."""
    return scores.flow_domains(grid.irregularities(grid.operators(lattice(spark, sf_dir))))


# ---- feature rows and jobs

_BATCH = ", ".join(f"{rnd(f'coalesce({c}, 0)::DOUBLE', 5)} AS {c}" for c in features.BATCH)


@query(
    "batch_features",
    f"""WITH {DAILY_SQL}, n AS (SELECT patient_id, count(*) AS total_alerts FROM alerts GROUP BY 1)
 SELECT patient_id, summary_date, {_BATCH}, CASE clinical_risk_level WHEN 'moderate' THEN 1 WHEN 'elevated' THEN 2 WHEN 'critical' THEN 3 ELSE 0 END AS risk_label
 FROM daily LEFT JOIN n USING (patient_id)""",
    dates=["summary_date"],
)
def batch_features(spark, sf_dir):
    """Feature rows of all patient days."""
    t = views.gold_tables(spark, sf_dir)
    rows = features.batch_features(t["daily"], t["alerts"])
    return rows.select("patient_id", "summary_date", *(round_(c, 5).alias(c) for c in features.BATCH), "risk_label")


@query(
    "online_features",
    f"""WITH {WIDE_VITALS_SQL}, q AS (SELECT patient_id, window_start, avg(quality_score) AS quality FROM silver GROUP BY 1, 2),
 o AS (SELECT v.*, quality, row_number() OVER (PARTITION BY v.patient_id ORDER BY v.window_start DESC) AS nth FROM v JOIN q USING (patient_id, window_start))
 SELECT patient_id, window_start AS ts, {rnd('coalesce(heart_rate, 0)::DOUBLE', 5)} AS bpm, {rnd('coalesce(spo2, 97)::DOUBLE', 5)} AS spo2, {rnd('coalesce(hrv, 50)::DOUBLE', 5)} AS hrv, 0.0::DOUBLE AS stress,
  {rnd('coalesce(quality, 1)::DOUBLE', 5)} AS quality_score, CAST(hour(window_start) AS INTEGER) AS hour_of_day, CASE WHEN hour(window_start) BETWEEN 8 AND 17 THEN 1 ELSE 0 END AS is_active,
  CASE WHEN hour(window_start) < 6 OR hour(window_start) >= 22 THEN 1 ELSE 0 END AS is_sleeping FROM o WHERE nth <= 50""",
    times=["ts"],
)
def online_features(spark, sf_dir):
    """Feature rows of the newest fifty windows of each patient."""
    s = views.silver(spark, sf_dir)
    quality = s.groupBy("patient_id", "window_start").agg(F.avg("quality_score").alias("quality_score"))
    rows = features.online_features(wide_vitals(spark, sf_dir).drop("quality_score").join(quality, ["patient_id", "window_start"]))
    return rows.select("patient_id", "ts", *(round_(c, 5).alias(c) for c in ("bpm", "spo2", "hrv", "stress", "quality_score")), "hour_of_day", "is_active", "is_sleeping")


@query("risk_model_job")
def risk_model_job(spark, sf_dir):
    """Training, batch scoring and export of the risk model; the report of its held-out rows."""
    t = views.gold_tables(spark, sf_dir)
    work = Scratch(spark, "risk_model")
    rows = work.write(features.batch_features(t["daily"], t["alerts"]), "features")
    return jobs.train_risk_model(rows, f"{work.root}/model", f"{work.root}/batch")


@query(
    "lake_pipeline",
    f"""WITH {DAILY_SQL} SELECT (SELECT count(*) FROM bronze) AS bronze_rows, (SELECT count(*) FROM silver) AS silver_rows, (SELECT count(*) FROM hourly) AS hourly_rows,
  (SELECT count(*) FROM daily) AS daily_rows, (SELECT count(*) FROM alerts) AS alert_rows, (SELECT count(DISTINCT patient_id) FROM silver) AS patients,
  (SELECT strftime(min(partition_date), '%Y-%m-%d') FROM silver) AS first_date, (SELECT strftime(max(partition_date), '%Y-%m-%d') FROM silver) AS last_date,
  (SELECT count(*) > 0 FROM bronze) AND (SELECT count(*) FROM silver) / (SELECT count(*) FROM bronze) BETWEEN 0.05 AND 1 AND (SELECT avg(quality_score) FROM silver) >= 0.6 AS bronze_gate,
  (SELECT min(coverage_24h) FROM daily) >= 0.425 AS gold_gate""",
)
def lake_pipeline(spark, sf_dir):
    """Bronze to gold into a lake of its own; what the run reports of itself."""
    lake = Scratch(spark, "lake_pipeline")
    result = pipeline.run_batch(spark, lake.root, views.bronze(spark, sf_dir), views.WINDOW)
    return pipeline.as_frame(spark, result)


# ---- calibration and validation

_CALIBRATED = f"""{L_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY doc_id) AS nth, count(*) OVER (PARTITION BY horizon) AS n FROM l),
 c AS (SELECT * FROM n WHERE n >= 20 AND nth > n - CASE WHEN n * 0.25::DOUBLE < 10 THEN n ELSE floor(n * 0.25::DOUBLE) END)"""


@query(
    "calibration_report",
    f"""WITH {_CALIBRATED}, s AS (SELECT horizon, CASE WHEN label >= 0.5 THEN 1 - prob ELSE prob END AS score FROM c), z AS (SELECT horizon, count(*) AS n FROM s GROUP BY 1),
 r AS (SELECT s.horizon, score, n, row_number() OVER (PARTITION BY s.horizon ORDER BY score) - 1 AS nth, least(1, ceil((n + 1) * 0.9::DOUBLE) / n) * (n - 1) AS a FROM s JOIN z ON z.horizon = s.horizon),
 h AS (SELECT horizon, sum(CASE WHEN nth = floor(a) THEN score * (1 - (a - floor(a))) WHEN nth = floor(a) + 1 THEN score * (a - floor(a)) ELSE 0 END) AS q_hat, any_value(n) AS n FROM r GROUP BY 1)
 SELECT h.horizon, {rnd('any_value(q_hat)', 6)} AS q_hat, any_value(n) AS n, {rnd('avg(CASE WHEN score <= q_hat + 1e-12 THEN 1.0 ELSE 0.0 END)', 6)} AS coverage, false AS skipped
 FROM h JOIN s ON s.horizon = h.horizon GROUP BY 1""",
)
def calibration_report(spark, sf_dir):
    """Conformal calibration on the newest quarter of each horizon."""
    c = jobs.calibrate(scored_labels(spark, sf_dir), "doc_id")
    return c.withColumns({"q_hat": round_("q_hat", 6), "coverage": round_("coverage", 6)})


@query("validation_report", VALIDATION_SQL)
def validation_report(spark, sf_dir):
    """Metrics of every horizon, their means, and the counts of rows and events."""
    report = jobs.validate(scored_labels(spark, sf_dir), Scratch(spark, "validation").root + "/report")
    return report.withColumns({c: round_(c, 6) for c in ("threshold", *jobs.METRICS)})
