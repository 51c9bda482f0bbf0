"""Bronze to gold, extractors, storage and sources on small frames."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulselake.lake import Lake, csv_to_trusted, latest_knowledge
from pulselake.operators import bronze, extract, gold, records
from pulselake.operators.silver import reconcile
from pulselake.sources import readers

SCHEMA = "event_id string, patient_id string, device_id string, metric_type string, metric_value double, timestamp_utc timestamp, battery_level double, signal_confidence double, raw_payload string, partition_date date"
T0 = datetime(2026, 7, 1, 8, 0, 0)


def row(k, metric="heart_rate", value=72.0, at=T0, confidence=0.95, battery=0.8, payload=None, device="DEV-1", patient="PAT-1"):
    return (f"evt-{k}", patient, device, metric, value, at, battery, confidence, payload, at.date() if at else None)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_validation(spark):
    got = {r.event_id: r for r in bronze.validate(frame(spark, row(1), row(2, value=300.0), row(3, confidence=0.2), row(4, battery=0.05, confidence=0.2), row(5, at=None))).collect()}
    assert got["evt-1"].is_valid and got["evt-1"].quality_score >= 0.8
    assert "out_of_range" in got["evt-2"].quality_flags and not got["evt-2"].is_valid and got["evt-2"].rejection_reason == "quality_gate_failed"
    assert got["evt-3"].quality_flags == ["low_confidence"]
    assert got["evt-4"].quality_flags == ["low_confidence", "low_confidence"]
    assert got["evt-5"].quality_score == 0.0 and "missing_timestamp" in got["evt-5"].quality_flags


def test_reconcile_and_anomaly(spark):
    s = reconcile(frame(spark, row(1, value=150.0), row(2, value=160.0, at=T0 + timedelta(seconds=2), device="DEV-2"), row(3, value=70.0, at=T0 + timedelta(seconds=6), payload='{"activity_context": "resting"}'))).orderBy("window_start").collect()
    assert len(s) == 2 and s[0].metric_value == 155.0 and s[0].devices_involved == ["DEV-1", "DEV-2"] and s[0].is_anomaly and s[0].anomaly_score == 1.0
    assert s[1].activity_context == "resting" and not s[1].is_anomaly and s[0].window_end - s[0].window_start == timedelta(seconds=5)


def test_union_of_windows_keeps_every_reading(spark):
    rows = [row(k, value=60.0 + k, at=T0 + timedelta(seconds=3 * k)) for k in range(50)]
    assert reconcile(frame(spark, *rows)).agg(F.sum("reading_count")).first()[0] == 50


def test_episodes_split_on_gap(spark):
    at = [0, 5, 40, 200]
    s = reconcile(frame(spark, *(row(k, value=200.0, at=T0 + timedelta(seconds=x)) for k, x in enumerate(at))))
    e = extract.episodes(s).orderBy("episode_start").collect()
    assert [r.reading_count for r in e] == [3, 1] and e[0].duration_minutes == 0.75


def test_gates(spark):
    b = spark.createDataFrame([(c,) for c in (0.9, 0.8, 0.7, 0.95)], "signal_confidence double")
    s = spark.createDataFrame([(c,) for c in (0.9, 0.85, 0.8)], "quality_score double")
    assert gold.bronze_gate(b, s).first().passed
    r = gold.bronze_gate(b.limit(0), s.limit(0)).first()
    assert not r.passed and r.total == 0
    h, d = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([], "coverage_24h double")
    assert gold.gold_gate(h, d).first().checks["gold_daily_produced"] is False


def test_wellness(spark):
    rows = [("u", date(2026, 7, 1), 4000, 70.0, 200.0, 98.0, 0), ("u", date(2026, 7, 1), 3000, 80.0, 150.0, 97.0, 420), ("v", date(2026, 7, 1), 0, None, 0.0, 97.0, 0)]
    df = spark.createDataFrame(rows, "user_id string, date date, steps int, heart_rate_bpm double, calories_burned double, spo2 double, sleep_duration_min int")
    got = {r.user_id: r for r in gold.wellness_daily(df).collect()}
    assert got["u"].total_steps == 7000 and got["u"].avg_heart_rate == 75.0 and got["u"].overall_score is not None
    assert got["v"].overall_score == pytest.approx(33.3)


def test_timeline_needs_patient_and_names_are_listed(spark):
    s = reconcile(frame(spark, row(1)))
    with pytest.raises(ValueError):
        extract.timeline(s, extract.QueryFilters())
    with pytest.raises(KeyError, match="timeline"):
        extract.extract("nothing", {}, extract.QueryFilters())


def test_lake_round_trip_is_idempotent(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    s = reconcile(frame(spark, row(1), row(2, at=T0 + timedelta(days=1), patient="PAT-2"))).withColumn("processed_at", F.current_timestamp())
    assert lake.read("silver", "telemetry").count() == 0
    for _ in range(2):
        assert lake.write("silver", "telemetry", s) == 2
    assert lake.read("silver", "telemetry").count() == 2
    assert lake.partitions("silver", "telemetry") == ["2026-07-01", "2026-07-02"]
    assert lake.read("silver", "telemetry", extract.QueryFilters(patient_id="PAT-2")).count() == 1
    assert lake.lineage().count() == 2
    gone = spark.createDataFrame([("PAT-2",)], "patient_id string")
    assert lake.purge("silver", "telemetry", gone) and not lake.purge("silver", "telemetry", gone)
    assert lake.read("silver", "telemetry").count() == 1
    assert lake.write("silver", "telemetry", s.limit(0)) == 0


def test_csv_to_trusted(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title,abstract\na,text\nb,\n")
    csv_to_trusted(spark, str(tmp_path / "a.csv"), str(tmp_path / "t"), "title string, abstract string", ["abstract"], date(2026, 1, 2))
    assert latest_knowledge(spark, str(tmp_path / "t")).count() == 1


def test_phone_exports(spark, tmp_path):
    (tmp_path / "e.xml").write_text(
        '<HealthData><Record type="HKQuantityTypeIdentifierHeartRate" sourceName="w" unit="count/min" startDate="2026-07-01 08:00:00 +0000" value="72"/>'
        '<Record type="HKQuantityTypeIdentifierOxygenSaturation" sourceName="w" creationDate="2026-07-01 08:01:00 +0000" value="0.97"/><Record type="HKOther" value="1"/>'
        '<Record type="HKCategoryTypeIdentifierSleepAnalysis" startDate="2026-07-01 02:00:00 +0000" value="HKCategoryValueSleepAnalysisAsleepDeep"/></HealthData>'
    )
    got = {r.metric_type: r for r in readers.phone_xml(spark, str(tmp_path / "e.xml"), "P").collect()}
    assert set(got) == {"heart_rate", "spo2", "sleep_stage"} and got["spo2"].metric_value == 97.0 and got["sleep_stage"].metric_value == 2.0 and len(got["heart_rate"].event_id) == 16
    (tmp_path / "e.json").write_text(json.dumps([{"type": "heart_rate", "value": "80", "startDate": "2026-07-01T08:00:00Z"}]))
    assert readers.phone_json(spark, str(tmp_path / "e.json"), "P").first().metric_value == 80.0


def test_fitness(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"saved_at": "x", "readings": [{"metric_type": "steps", "value": 10.0, "timestamp": "2026-07-01T08:00:00"}]}))
    both, status = readers.collect_all(spark, {"google_fit": (str(tmp_path / "c.json"), "P"), "other": ("x", "P"), "apple_json": (str(tmp_path / "none.json"), "P")})
    assert both.count() == 1 and {r.source: r.status for r in status.collect()} == {"google_fit": "ok", "other": "skipped", "apple_json": "skipped"}
    (tmp_path / "b.json").write_text(json.dumps({"bucket": [{"dataset": [{"point": [{"startTimeNanos": "1782892800000000000", "value": [{"intVal": 7}]}, {"startTimeNanos": "1782892800000000000", "value": [{"fpVal": 7.5}]}]}]}]}))
    assert sorted(r.metric_value for r in readers.fitness_buckets(spark, str(tmp_path / "b.json"), "P", "steps").collect()) == [7.0, 7.5]


def test_band_envelopes(spark, tmp_path):
    device = {"device_id": "B", "origin_protocol_version": 2}
    lines = [
        {"message_type": "realtime", "payload": {"device": device, "timestamp": "2026-08-06T12:00:00Z", "heart_rate": 80, "spo2": 98, "blood_pressure_sys": 120, "blood_pressure_dia": 80}},
        {"message_type": "origin", "payload": {"device": device, "samples": [{"time": "2026-08-06 08:00:00", "rate": 72, "spo2": 98, "hrv": 44, "step": 120, "high": 118, "low": 76, "temp": 33.2, "resp": 16, "sport": 1000}]}},
        {"message_type": "sleep", "payload": {"device": device, "start": "2026-08-06 00:00:00", "sleep_quality": 8, "sleep_line": "0" * 12 + "2" * 12}},
        {"payload": {"device": device, "timestamp": "2026-08-06T12:00:00Z", "step": 8500, "distance_km": 6.2, "kcal": 320.5}},
    ]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    good, bad = readers.band_envelopes(spark, str(tmp_path / "e.jsonl"), "P0")
    kinds = [r.metric_type for r in good.collect()]
    assert kinds.count("heart_rate") == 2 and kinds.count("sleep_stage") == 2 and "stress_index" in kinds and "kcal" in kinds and bad.count() == 1
    assert good.where("metric_type = 'hrv'").first().signal_confidence == 0.85


def test_heart_rate_bytes(spark):
    df = spark.createDataFrame([(bytearray([0, 72]),), (bytearray([1, 44, 1]),), (bytearray(),)], "b binary")
    assert [r[0] for r in df.select(readers.heart_rate_bytes(F.col("b"))).collect()] == [72, 300, 0]


def test_fhir_bundle_scan(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"bundle": {"entry": [{"resource": {"resourceType": "Condition", "id": "c1"}}]}}))
    assert readers.fhir_bundle(spark, str(tmp_path / "b.json")).first().resource_type == "Condition"


def test_records(spark):
    rows = [("u", "fhir", 1, date(2026, 1, 1), 70.0, 97.0, 10), ("u", "tcn", 2, date(2026, 1, 2), 0.0, None, 20)]
    df = spark.createDataFrame(rows, "user_id string, source string, record_id int, date date, heart_rate_bpm double, spo2 double, steps int")
    s = records.user_summary(df).first()
    assert (s.record_count, s.heart_rate_bpm, s.spo2, s.steps, s.latest_fhir) == (2, 70.0, 97.0, 20, 1)
    assert records.list_records(df, user_id="u", limit=0).count() == 1
