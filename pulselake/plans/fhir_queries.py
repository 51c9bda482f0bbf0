"""Queries of the FHIR builders, de-identification and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulselake.clinical import scores
from pulselake.fhir import resources
from pulselake.plans import views
from pulselake.plans.base import Registry
from pulselake.plans.clinical_queries import EVENTS_SQL, patient_evidence
from pulselake.plans.views import DAILY_SQL, SILVER_SQL, rnd
from pulselake.session import read_table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def patients(spark, sf_dir):
    """customer as FHIR patients."""
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("id"), F.array(F.struct(F.col("c_name").alias("family"))).alias("name"), F.concat((F.lit(1940) + F.col("c_custkey") % 70).cast("string"), F.lit("-06-15")).alias("birthDate"),
        F.array(F.struct(F.lit("ssn").alias("system"), F.col("c_custkey").cast("string").alias("value"))).alias("identifier"), F.array(F.struct(F.lit("Town").alias("city"), F.col("c_nationkey").cast("string").alias("state"), F.lit("BR").alias("country"))).alias("address"),
    )


@query("deid_patients", "SELECT substr(sha256(c_custkey || 'salt'), 1, 16) AS id, (1940 + c_custkey % 70) || '-01-01' AS birth_date, sha256(c_custkey || 'salt') AS identifier, CAST(c_nationkey AS VARCHAR) AS state, 'BR' AS country FROM customer")
def deid_patients(spark, sf_dir):
    d = resources.deidentify(patients(spark, sf_dir), "salt")
    return d.select("id", F.col("birthDate").alias("birth_date"), F.col("identifier")[0]["value"].alias("identifier"), F.col("address")[0]["state"].alias("state"), F.col("address")[0]["country"].alias("country"))


@query("fhir_observations", f"""WITH {SILVER_SQL} SELECT patient_id, substr(sha256(patient_id || ':' || metric_type || ':' || CAST(epoch(window_start) AS BIGINT)), 1, 16) AS id, CASE metric_type WHEN 'heart_rate' THEN '8867-4' WHEN 'spo2' THEN '59408-5' WHEN 'hrv' THEN '80404-7' WHEN 'steps' THEN '55423-8' WHEN 'stress_index' THEN '89592-0' END AS code,
 strftime(window_start, '%Y-%m-%dT%H:%M:%SZ') AS effective, {rnd('metric_value', 2)} AS value, CASE WHEN is_anomaly THEN 'A' END AS interpretation FROM silver""")
def fhir_observations(spark, sf_dir):
    o = resources.observation(views.silver(spark, sf_dir))
    at = lambda p: F.get_json_object("resource", p)
    return o.select("patient_id", "id", at("$.code.coding[0].code").alias("code"), at("$.effectiveDateTime").alias("effective"), at("$.valueQuantity.value").cast("double").alias("value"), at("$.interpretation[0].coding[0].code").alias("interpretation"))


@query("fhir_validity", f"WITH {DAILY_SQL} SELECT 'Observation' AS resource_type, count(*) AS entries, count(*) AS valid, 0 AS invalid, true AS all_valid FROM silver UNION ALL SELECT 'Flag', count(*), count(*), 0, true FROM alerts")
def fhir_validity(spark, sf_dir):
    t = views.gold_tables(spark, sf_dir)
    return resources.validity_summary(resources.validate(resources.observation(t["silver"]).unionByName(resources.flag(t["alerts"]))))


@query(
    "fhir_bundles",
    f"""WITH {DAILY_SQL}, r AS (SELECT patient_id, 'Observation' AS t, substr(sha256(patient_id || ':' || metric_type || ':' || CAST(epoch(window_start) AS BIGINT)), 1, 16) AS id FROM silver
   UNION ALL SELECT patient_id, 'Flag', alert_id FROM alerts), n AS (SELECT *, row_number() OVER (PARTITION BY patient_id, t ORDER BY id) AS nth FROM r)
 SELECT patient_id, count(*) AS total, string_agg(t || '/' || id, ',' ORDER BY t, id) AS entries FROM n WHERE nth <= CASE t WHEN 'Observation' THEN 20 ELSE 5 END GROUP BY 1""",
)
def fhir_bundles(spark, sf_dir):
    """Bundle of every patient: its entries by type and id, read back from the JSON."""
    t = views.gold_tables(spark, sf_dir)
    b = resources.bundles(resources.observation(t["silver"]).unionByName(resources.flag(t["alerts"])), {"Observation": 20, "Flag": 5})
    entries = F.from_json(F.get_json_object("bundle", "$.entry"), "array<struct<resource:struct<resourceType:string,id:string>>>")
    named = F.transform(entries, lambda e: F.concat_ws("/", e["resource"]["resourceType"], e["resource"]["id"]))
    return b.where(F.get_json_object("bundle", "$.type") == "collection").select("patient_id", "total", F.array_join(named, ",").alias("entries"))


BOOSTS = {"diabetes": 0.12, "hypert": 0.15, "metformin": 0.05}


@query("baseline_risk", f"""WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS patient_id, CASE c_custkey % 3 WHEN 0 THEN 0.12 WHEN 1 THEN 0.15 ELSE 0 END + CASE WHEN c_custkey % 2 = 0 THEN 0.05 ELSE 0 END AS g FROM customer)
 SELECT patient_id, {rnd('least(1.0, 0.05 + g::DOUBLE)', 4)} AS risk_factor FROM c""")
def baseline_risk(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("patient_id"), F.col("c_custkey").alias("k"))
    cond = c.select("patient_id", F.when(F.col("k") % 3 == 0, "Diabetes type 2").when(F.col("k") % 3 == 1, "Arterial hypertension").otherwise("Asthma").alias("name"))
    meds = c.where("k % 2 = 0").select("patient_id", F.lit("Metformin 500").alias("name"))
    return scores.baseline_risk(c, cond, meds, BOOSTS).select("patient_id", "risk_factor")


@query("horizon_labels", f"""WITH {DAILY_SQL}, w AS (SELECT DISTINCT patient_id, window_start AS ts FROM silver)
 SELECT w.patient_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, max(CASE WHEN a.window_start <= ts + INTERVAL 6 DAY THEN 1 ELSE 0 END) AS y6, max(CASE WHEN a.window_start <= ts + INTERVAL 24 DAY THEN 1 ELSE 0 END) AS y24
 FROM w LEFT JOIN alerts a ON a.patient_id = w.patient_id AND a.window_start > ts GROUP BY 1, 2""")
def horizon_labels(spark, sf_dir):
    from pyspark.sql import Window as W

    t = views.gold_tables(spark, sf_dir)
    points = t["silver"].select("patient_id", F.col("window_start").alias("ts")).distinct().withColumn("alert", F.lit(False))
    both = points.unionByName(t["alerts"].select("patient_id", F.col("window_start").alias("ts"), F.lit(True).alias("alert")))
    after = W.partitionBy("patient_id").orderBy(F.desc(F.unix_seconds("ts"))).rangeBetween(W.unboundedPreceding, -1)
    following = F.min(F.when(F.col("alert"), F.unix_seconds("ts"))).over(after)
    n = both.withColumn("next", following).where("not alert")
    within = lambda days: F.coalesce((F.col("next") <= F.unix_seconds("ts") + days * 86400).cast("int"), F.lit(0))
    return n.select("patient_id", "ts", within(6).alias("y6"), within(24).alias("y24"))


@query("patient_fusion", f"WITH {EVENTS_SQL} SELECT patient_id, {rnd('fusion', 4)} AS fusion_score, agreeing AS agreeing_sources, (SELECT count(*) FROM silver WHERE silver.patient_id = f.patient_id) AS windows FROM f")
def patient_fusion(spark, sf_dir):
    """Fused evidence of every patient, with the sources that agree and the windows behind it."""
    evidence = patient_evidence(spark, sf_dir)
    windows = views.silver(spark, sf_dir).groupBy("patient_id").agg(F.count("*").alias("windows"))
    fused = scores.fusion_score(evidence)
    return fused.join(windows, "patient_id").select("patient_id", "fusion_score", "agreeing_sources", "windows")


@query("prediction_summary", f"WITH {EVENTS_SQL} SELECT patient_id, event_type, probability, 1 AS n_predictions FROM events")
def prediction_summary(spark, sf_dir):
    return scores.prediction_summary(scores.fuse(patient_evidence(spark, sf_dir)))
