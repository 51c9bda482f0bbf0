"""Rules, discrepancy, assembly, fuzzy scores, fusion and de-identification."""

import pytest
from pyspark.sql import functions as F

from pulselake.clinical import alerts, rules, scores
from pulselake.fhir import resources
from pulselake.text import corpus

SNAP = "pas double, pad double, hr double, spo2 double, temp_c double, glucose_mgdl double, steps_drop_pct double, sleep_worsen_pct double, hr_baseline_rise double, spo2_drop_points double, consciousness_altered boolean"


def snap(spark, *rows):
    return spark.createDataFrame([(*map(lambda v: None if v is None else float(v), r), False) for r in rows], SNAP)


def test_catalogue(spark):
    c = rules.catalogue(spark)
    assert c.count() == 51 and {"pa_alta", "hipoglicemia", "funcional"} <= {r.category for r in c.collect()}


@pytest.mark.parametrize(
    "vitals, alert, severities",
    [
        ((190, 115, 125, 96, 36.8, 110, 5, 5, 2, 0.5), True, {"critico"}),
        ((118, 76, 105, 98, 36.7, 105, 5, 5, 2, 0.5), None, {"none", "leve"}),
        ((120, 80, 80, 88, 36.6, 100, 5, 5, 2, 0.5), True, {"critico"}),
        ((120, 80, 80, 98, 36.6, 40, 5, 5, 2, 0.5), True, {"critico"}),
        ((118, 76, 72, 98, 36.6, 100, 5, 5, 2, 0.5), False, {"none"}),
        ((None,) * 10, False, {"none"}),
    ],
)
def test_matrix(spark, vitals, alert, severities):
    r = rules.evaluate(snap(spark, vitals)).first()
    assert r.severity in severities and (alert is None or r.is_true_alert == alert)


READING = "heart_rate double, spo2 double, skin_temp double, est_sbp double, est_dbp double, est_glucose double, est_glucose_reliable boolean, blood_pressure_sys double, blood_pressure_dia double"


def decided(spark, *row):
    return alerts.decide(alerts.assemble(spark.createDataFrame([row], READING))).first()


def test_ingest_decisions(spark):
    r = decided(spark, 80.0, 98.0, 36.5, 150.0, 95.0, None, None, 190.0, 115.0)
    assert (r.pas, r.pad, r.bp_source) == (190.0, 115.0, "measured")
    r = decided(spark, 78.0, 98.0, 36.5, 190.0, 115.0, 200.0, True, None, None)
    assert not r.alert and r.final_severity == "none"
    r = decided(spark, 85.0, 88.0, 36.5, None, None, None, None, None, None)
    assert r.alert and r.final_severity == "critico" and r.primary_rule
    r = decided(spark, 105.0, 98.0, 36.5, 118.0, 76.0, 105.0, True, None, None)
    assert not r.alert


def test_merge(spark):
    df = spark.createDataFrame([(True, False, "critico"), (False, True, "none")], "alert boolean, false_positive boolean, final_severity string")
    a, b = alerts.merge_anomaly(df, F.lit(True), F.lit(0.05)).collect()
    assert a.merged_alert and a.merged_score >= 0.9 and not b.merged_alert and b.suppressed_by_matrix and b.merged_score <= 0.15


def test_fuzzy_and_membership(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "x double").select(scores.triangle(F.col("x"), 0, 0, 2).alias("t"))
    assert [r.t for r in df.collect()] == [0.0, 0.5, 0.0]
    r = scores.fuzzy(spark.createDataFrame([(0.9, 0.9)], "spo2_risk double, ghost double")).first()
    assert r.event_probability > 0.75 and "high" in r.summary


def test_fusion_matches_conditions_by_words(spark):
    df = spark.createDataFrame([("p", 0.9, 0.9, 0.9, 0.9, 0.0, ["Heart failure"])], "patient_id string, wearable double, ghost double, clinical double, fuzzy double, fp_probability double, conditions array<string>")
    assert scores.fuse(df).first().event_type == "cardiovascular_event"
    assert scores.fuse(df, strict_reference=True).first().event_type == "unspecified_clinical_deterioration"


def test_posterior_sums(spark):
    df = spark.createDataFrame([("p", 165.0, 95.0, 97.0)], "patient_id string, systolic_bp double, diastolic_bp double, spo2 double")
    got = scores.posterior(df, top=5).orderBy("nth").collect()
    by = {r.category: r.posterior for r in got}
    assert by["cardiovascular"] > by["respiratory"] and sum(by.values()) == pytest.approx(1, abs=1e-4)


def test_nudges(spark):
    rows = [("p", 75, 0.8, m, v) for m, vs in (("heart_rate", [98, 99, 101]), ("hrv", [15, 18, 14]), ("stress_index", [80, 85, 82])) for v in map(float, vs)]
    r = scores.nudges(spark.createDataFrame(rows, "patient_id string, age int, temp_delta double, metric_type string, metric_value double")).first()
    assert r.elderly and r.risk == "CRITICO" and r.protocols and r.messages


def test_deidentify(spark):
    df = spark.createDataFrame(
        [("1", [("Silva",)], "1985-06-15", [("cpf", "123")], [("Town", "SP", "BR")])],
        "id string, name array<struct<family:string>>, birthDate string, identifier array<struct<system:string,value:string>>, address array<struct<city:string,state:string,country:string>>",
    )
    a, b = (resources.deidentify(df, "s").first() for _ in range(2))
    assert a == b and "name" not in a and a.birthDate == "1985-01-01" and len(a.id) == 16 and a.address[0].state == "SP" and "city" not in a.address[0] and a.meta.security[0].code == "HTEST"


def test_fhir_validation(spark):
    df = spark.createDataFrame([("Patient", '{"id":"1"}'), ("Observation", '{"status":"final"}'), ("Other", "{}")], "resource_type string, resource string")
    got = {r.resource_type: r for r in resources.validate(df).collect()}
    assert got["Patient"].valid and got["Observation"].missing == ["code", "subject"] and not got["Other"].valid


def test_html_and_tokens(spark):
    html = '<title>A b</title><meta name="DC.title" content="x"><h1>Top</h1><p>t</p><a href="u">l</a><table><tr><td>1</td><td><b>2</b></td></tr></table>'
    df = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    got = {r.page_id: r for r in corpus.html_fields(df).collect()}
    assert got[1].title == "A b" and got[1].metas[0].content == "x" and got[1].links == 1 and got[2].title is None
    assert corpus.table_cells(df).first().cells == ["1", "2"]
    t = spark.createDataFrame([("The <b>Cat</b> sat, 12 mats!",), (None,)], "text string").select(corpus.tokens(F.col("text")).alias("t")).collect()
    assert t[0].t == ["cat", "sat", "mats"] and t[1].t == []
