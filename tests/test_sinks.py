"""Sinks, exports, packages, streams and jobs that no query covers in full."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake import lake as lakes
from pulselake.clinical import baselines, rules, scores
from pulselake.fhir import resources
from pulselake.ml import features, jobs, models
from pulselake.operators import extract, pipeline
from pulselake.series import temporal
from pulselake.streaming import jobs as streams
from pulselake.text import ontology

T0 = datetime(2026, 7, 1, 8)
SILVER = "record_id string, patient_id string, window_start timestamp, window_end timestamp, metric_type string, metric_value double, devices_involved array<string>, quality_score double, is_anomaly boolean, anomaly_score double, activity_context string, sleep_context string, partition_date date"


def silver(spark):
    rows = [(str(k), f"P{k % 2}", T0 + timedelta(seconds=5 * k), T0 + timedelta(seconds=5 * k + 5), "heart_rate", 70.4 + 40 * (k > 5), ["d"], 1.0, k > 5, 0.5, "active", "awake", T0.date()) for k in range(10)]
    return spark.createDataFrame(rows, SILVER)


def test_warehouse_rows_are_rounded_and_partitioned(spark, tmp_path):
    lakes.write_warehouse(lakes.biometrics(silver(spark)), f"{tmp_path}/wh", "window_start", ["patient_id"])
    back = spark.read.parquet(f"{tmp_path}/wh")
    assert back.count() == 10 and {r.heart_rate for r in back.collect()} == {70, 110} and (tmp_path / "wh" / "day=2026-07-01").is_dir()


def test_feature_exports_fill_missing_numbers(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1), ("b", 2.5, None)], "patient_id string, x double, n int")
    lakes.export_features(df, f"{tmp_path}/csv")
    lakes.export_features(df, f"{tmp_path}/json", form="json")
    assert {(r.patient_id, r.x, r.n) for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()} == {("a", "0.0", "1"), ("b", "2.5", "0")}
    assert {(r.patient_id, r.x, r.n) for r in spark.read.json(f"{tmp_path}/json").collect()} == {("a", 0.0, 1), ("b", 2.5, 0)}


def test_training_text_and_predictions(spark, tmp_path):
    lakes.export_training_text(spark.createDataFrame([(1, "one"), (2, None)], "doc_id long, text string"), f"{tmp_path}/text")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/text").collect()]
    assert "### document 1" in lines and "one" in lines and "### document 2" in lines
    lakes.export_predictions(spark.createDataFrame([("p", "rest", 0.5), ("q", "run", 0.7)], "patient_id string, scenario string, p double"), f"{tmp_path}/pred")
    assert spark.read.json(f"{tmp_path}/pred/scenario=run").first().patient_id == "q"


def test_fhir_files_and_active_events(spark, tmp_path):
    r = spark.createDataFrame([("Observation", '{"id":"1"}'), ("Flag", '{"id":"2"}')], "resource_type string, resource string")
    resources.write_ndjson(r, f"{tmp_path}/nd")
    assert spark.read.text(f"{tmp_path}/nd/resource_type=Flag").first().value == '{"id":"2"}'
    flags = spark.createDataFrame([("p", "tachycardia")], "patient_id string, code string")
    conditions = spark.createDataFrame([("p", "asthma", "active"), ("p", "flu", "resolved")], "patient_id string, code string, status string")
    assert {(e.kind, e.code) for e in resources.active_events(flags, conditions).collect()} == {("flag", "tachycardia"), ("condition", "asthma")}


def test_package_of_one_patient(spark):
    s = silver(spark)
    tables = {"silver": s, "alerts": spark.createDataFrame([("P0", T0)], "patient_id string, window_start timestamp")}
    got = extract.package_24h(tables, extract.QueryFilters(patient_id="P0"))
    assert {n: d.count() for n, d in got.items()} == {"timeline": 5, "vitals": 5, "anomalies": 1, "alerts": 1}


def test_purge_leaves_no_folder_beside_the_table(spark, tmp_path):
    lake = lakes.Lake(spark, f"{tmp_path}/lake")
    assert lake.write("silver", "telemetry", silver(spark)) == 10
    assert lake.write("silver", "telemetry", silver(spark).limit(0)) == 0 and lake.write("gold", "none", silver(spark).limit(0)) == 0
    assert lake.purge("silver", "telemetry", spark.createDataFrame([("P0",)], "patient_id string"))
    assert spark.read.parquet(lake.path("silver", "telemetry")).count() == 5 and not (tmp_path / "lake" / "_purge").exists() and not lake.exists("gold", "none")


def test_episode_and_ppg_streams(spark, tmp_path):
    silver(spark).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(silver(spark).schema).parquet(f"{tmp_path}/in")
    late = spark.createDataFrame([("z", "P9", T0 + timedelta(days=2), T0 + timedelta(days=2), "heart_rate", 1.0, ["d"], 1.0, True, 0.1, "a", "b", T0.date())], SILVER)
    late.write.mode("append").parquet(f"{tmp_path}/in")
    got = {r.patient_id: r for r in streams.drain(spark, streams.episode_stream(stream), f"{tmp_path}/out", f"{tmp_path}/cp").collect()}
    assert got["P0"].reading_count == 2 and got["P1"].reading_count == 2 and got["P0"].episode_start == T0 + timedelta(seconds=30) and got["P0"].episode_end == T0 + timedelta(seconds=45)
    ppg = spark.createDataFrame([([50.0, 52.0, 48.0, 50.0], 70.0), ([1.0], 71.0)], "ppg_signal array<double>, heart_rate double")
    a, b = streams.ppg_profile(ppg).collect()
    assert a.heart_rate == 50.0 and a.ppg_oscillation > 0 and b.heart_rate == 71.0 and b.ppg_mean is None


def test_user_rules_are_appended(spark):
    snap = spark.createDataFrame([(120.0, 80.0, 70.0, 98.0, 36.5, 100.0, 0.0, 0.0, 0.0, 0.0, False)], "pas double, pad double, hr double, spo2 double, temp_c double, glucose_mgdl double, steps_drop_pct double, sleep_worsen_pct double, hr_baseline_rise double, spo2_drop_points double, consciousness_altered boolean")
    assert not rules.evaluate(snap).first().is_true_alert
    own = rules.evaluate(snap, [*rules.RULES, ("own_1", "own", "critico", "hr = 70")]).first()
    assert own.primary_rule == "own_1" and own.severity == "critico"


def test_profiles_are_numbered_over_partitions(spark):
    ids = spark.createDataFrame([(f"p{k:03d}",) for k in range(50)] * 2, "patient_id string").repartition(7)
    got = {r.patient_id: r for r in baselines.default_profiles(ids).collect()}
    assert len(got) == 50 and all((got[f"p{k:03d}"].age, got[f"p{k:03d}"].resting_hr) == (45 + k % 20, 68.0 + k % 5) for k in range(50))
    made = baselines.to_baseline(spark.createDataFrame([("a", 70, 0.6, None), ("b", 30, None, "sedentary")], "patient_id string, age int, risk_factor double, activity_level string"))
    a, b = made.orderBy("patient_id").collect()
    assert a.clinical_conditions == ["elevated_cardiovascular_risk", "age_related_risk"] and a.activity_level == "moderate" and b.clinical_conditions == [] and b.risk_factor == 0.0


def test_risk_model_scores_what_it_saved(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(f"p{k}", k % 30, float(60 + 10 * (k % 4) + rng.normal()), ("low", "moderate", "elevated", "critical")[k % 4]) for k in range(300)]
    daily = spark.createDataFrame(rows, "patient_id string, summary_date int, avg_resting_hr double, clinical_risk_level string")
    f = features.batch_features(daily, spark.createDataFrame([("p1",)] * 3, "patient_id string"))
    assert f.where("patient_id = 'p1'").first().total_alerts == 3.0
    report = jobs.train_risk_model(f, f"{tmp_path}/m", f"{tmp_path}/b", trees=60)
    by_class = {r["class"]: r.f1 for r in report.collect()}
    assert min(by_class.values()) > 0.9, by_class
    batch = spark.read.json(f"{tmp_path}/b")
    assert batch.count() == 300 and batch.where("predicted_level = 'critical'").count() > 60
    assert jobs.train_risk_model(f.limit(0), f"{tmp_path}/x", f"{tmp_path}/y").count() == 0
    online = features.online_features(spark.createDataFrame([("p", T0 + timedelta(hours=h), None if h else 80.0, float("nan")) for h in range(4)], "patient_id string, window_start timestamp, heart_rate double, spo2 double"), newest=2)
    assert {(r.hour_of_day, r.bpm, r.spo2, r.is_active) for r in online.collect()} == {(10, 0.0, 97.0, 1), (11, 0.0, 97.0, 1)}
    mean, inverse = models.mahalanobis_fit(f, ["avg_resting_hr", "total_alerts"])
    assert jobs.score_online(f, ["avg_resting_hr", "total_alerts"], mean, inverse).where("is_alert").select("patient_id").distinct().count() >= 1


def test_calibration_takes_the_newest_quarter(spark, tmp_path):
    rows = [(6, k, float(k % 2), 0.5) for k in range(100)] + [(24, k, 1.0, 0.9) for k in range(12)]
    df = spark.createDataFrame(rows, "horizon int, k int, label double, prob double")
    assert sorted(r.k for r in jobs.newest_share(df.where("horizon = 6"), "k").collect()) == list(range(75, 100))
    assert jobs.newest_share(df.where("horizon = 24"), "k").count() == 12
    got = {r.horizon: r for r in jobs.calibrate(df, "k").collect()}
    assert got[6].n == 25 and not got[6].skipped and got[24].skipped and got[24].q_hat is None
    report = {r.horizon: r for r in jobs.validate(df, f"{tmp_path}/r").collect()}
    assert report[0].rows == 112 and report[6].events == 50 and spark.read.json(f"{tmp_path}/r").count() == 3


def test_batch_run_reports_itself(spark, tmp_path):
    r = pipeline.StageResult(rows={"device_readings": 3}, gates={"bronze": True})
    one = pipeline.as_frame(spark, r).first()
    assert one.bronze_rows == 3 and one.gold_gate is None and one.first_date is None


def test_topic_labels_are_jaccard(spark):
    words = {0: ["asma", "pulmonar", "xx", "yy"], 1: ["aa", "bb"]}
    df = spark.createDataFrame([(t, k, w) for t, ws in words.items() for k, w in enumerate(ws)], "topic int, rank int, word string")
    a, b = ontology.label_topics(df).orderBy("topic").collect()
    assert (a.label, a.category) == ("asma | pulmonar | xx", 1) and a.score == pytest.approx(2 / 12, abs=1e-6) and b.category is None and b.score == 0.0


def test_temporal_features_hold_for_a_stride(spark):
    rng = np.random.default_rng(1)
    rows = [("p", T0 + timedelta(minutes=k), float(70 + rng.normal() + 20 * (k > 50)), 97.0, 50.0 - (k > 50) * 30, None, 1.0, 70.0, 97.0, 50.0, "moderate", 0.2, 1) for k in range(70)]
    df = spark.createDataFrame(rows, "patient_id string, window_start timestamp, heart_rate double, spo2 double, hrv double, stress double, quality_score double, resting_hr double, baseline_spo2 double, baseline_hrv double, activity_level string, risk_factor double, n_conditions int")
    got = temporal.feature_matrix(df).orderBy("window_start").collect()
    flat = temporal.denoised(df).orderBy("t").toPandas()
    assert len(got) == 70 and len(temporal.FEATURES) == 24 and got[64].hr == got[67].hr == pytest.approx(flat.heart_rate[64])
    tail = flat.iloc[55:65]
    assert got[66].hr_deviation == pytest.approx(np.abs((tail.heart_rate - 70) / max(1.0, flat.heart_rate_noise[0])).mean())
    assert got[66].hrv_suppression == pytest.approx(max(0.0, (50 - tail.hrv.mean()) / 50))
    assert got[66].trajectory_slope == pytest.approx(np.polyfit(np.arange(12), flat.heart_rate[53:65], 1)[0])
    assert got[66].ghost_autonomic_imbalance > got[10].ghost_autonomic_imbalance and 0 <= got[66].fuzzy_event_prob <= 1 and got[66].persistence > got[10].persistence


def test_recommendations_name_the_event(spark):
    df = spark.createDataFrame([("p", 0.9, 0.9, 0.9, 0.9, 0.0, ["heart failure"], ["autonomic_imbalance"])], "patient_id string, wearable double, ghost double, clinical double, fuzzy double, fp_probability double, conditions array<string>, triggers array<string>")
    top = scores.fuse(df).orderBy("nth").first()
    assert top.recommendation.startswith(f"{top.event_type}: probability ") and top.horizon == ("hours" if top.lead_time_hours < 48 else "days")
