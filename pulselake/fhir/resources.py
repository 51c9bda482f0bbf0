"""FHIR: builders, validation, de-identification, exports, code systems (A13, D12, H8 terms, H19-H23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.functions.scalar import lookup, rnd, stable_id

# LOINC and UCUM codes by metric.
LOINC = {"heart_rate": "8867-4", "spo2": "59408-5", "hrv": "80404-7", "steps": "55423-8", "stress_index": "89592-0", "skin_temp": "39106-0", "respiratory_rate": "9279-1"}
UCUM = {"heart_rate": "/min", "spo2": "%", "hrv": "ms", "steps": "{steps}", "stress_index": "{score}", "skin_temp": "Cel", "respiratory_rate": "/min"}
REQUIRED = {"Patient": ["id"], "Device": ["id"], "Observation": ["status", "code", "subject"], "Flag": ["status", "code", "subject"], "Bundle": ["type"]}


def fhir_id(*parts: Column) -> Column:
    """Sixteen hexadecimal digits, stable."""
    return stable_id(*parts)


def observation(silver: DataFrame) -> DataFrame:
    """(resource_type, patient_id, id, resource) of silver windows."""
    ref = F.concat(F.lit("Patient/"), F.regexp_replace("patient_id", "_", "-"))
    body = F.struct(
        F.lit("Observation").alias("resourceType"), fhir_id(F.col("patient_id"), F.col("metric_type"), F.unix_seconds("window_start")).alias("id"), F.lit("final").alias("status"),
        F.struct(F.array(F.struct(F.lit("http://loinc.org").alias("system"), lookup(F.col("metric_type"), LOINC).alias("code"), F.col("metric_type").alias("display"))).alias("coding")).alias("code"),
        F.struct(ref.alias("reference")).alias("subject"), F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("effectiveDateTime"),
        F.struct(F.col("metric_value").alias("value"), lookup(F.col("metric_type"), UCUM).alias("unit")).alias("valueQuantity"),
        F.when(F.col("is_anomaly"), F.array(F.struct(F.array(F.struct(F.lit("A").alias("code"))).alias("coding")))).alias("interpretation"),
        F.array(F.struct(F.lit("quality-score").alias("url"), rnd("quality_score", 3).alias("valueDecimal"))).alias("extension"),
    )
    return silver.select(F.lit("Observation").alias("resource_type"), "patient_id", body.alias("r")).select("resource_type", "patient_id", "r.id", F.to_json("r").alias("resource"))


def flag(alerts: DataFrame) -> DataFrame:
    """(resource_type, patient_id, id, resource) of alerts."""
    body = F.struct(
        F.lit("Flag").alias("resourceType"), F.col("alert_id").alias("id"), F.lit("active").alias("status"), F.struct(F.array(F.struct(F.col("alert_type").alias("code"), F.col("severity").alias("display"))).alias("coding"), F.col("alert_type").alias("text")).alias("code"),
        F.struct(F.concat(F.lit("Patient/"), F.regexp_replace("patient_id", "_", "-")).alias("reference")).alias("subject"), F.struct(F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start"), F.date_format("window_end", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("end")).alias("period"),
    )
    return alerts.select(F.lit("Flag").alias("resource_type"), "patient_id", body.alias("r")).select("resource_type", "patient_id", "r.id", F.to_json("r").alias("resource"))


def patient(patients: DataFrame) -> DataFrame:
    """Patient resources of (patient_id, family, given, birth_date)."""
    body = F.struct(F.lit("Patient").alias("resourceType"), fhir_id(F.col("patient_id")).alias("id"), F.array(F.struct(F.col("family"), F.array("given").alias("given"))).alias("name"), F.date_format("birth_date", "yyyy-MM-dd").alias("birthDate"))
    return patients.select(F.lit("Patient").alias("resource_type"), "patient_id", body.alias("r")).select("resource_type", "patient_id", "r.id", F.to_json("r").alias("resource"))


def device(bindings: DataFrame) -> DataFrame:
    """Device resources of (patient_id, device_id, vendor)."""
    body = F.struct(F.lit("Device").alias("resourceType"), fhir_id(F.col("device_id")).alias("id"), F.col("vendor").alias("manufacturer"), F.struct(F.concat(F.lit("Patient/"), "patient_id").alias("reference")).alias("patient"))
    return bindings.select(F.lit("Device").alias("resource_type"), "patient_id", body.alias("r")).select("resource_type", "patient_id", "r.id", F.to_json("r").alias("resource"))


def validate(resources: DataFrame) -> DataFrame:
    """Adds missing (mandatory fields that are absent; unknown types have ``resourceType``) and valid."""
    missing = F.lit(None).cast("array<string>")
    for kind, fields in REQUIRED.items():
        gone = F.array_compact(F.array(*(F.when(F.get_json_object("resource", f"$.{f}").isNull(), F.lit(f)) for f in fields)))
        missing = F.when(F.col("resource_type") == kind, gone).otherwise(missing)
    m = F.coalesce(missing, F.array(F.lit("resourceType")))
    return resources.withColumn("missing", m).withColumn("valid", F.size("missing") == 0)


def validity_summary(validated: DataFrame) -> DataFrame:
    """Per type: entries, valid, invalid and whether all are valid."""
    return validated.groupBy("resource_type").agg(F.count("*").alias("entries"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), F.bool_and("valid").alias("all_valid"))


def bundles(resources: DataFrame, per_type: dict[str, int]) -> DataFrame:
    """One collection bundle per patient of the first so many resources of each type, by id (the caps are the feature)."""
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy("patient_id", "resource_type").orderBy("id"))
    kept = resources.withColumn("nth", nth).where(F.col("nth") <= lookup(F.col("resource_type"), per_type, 100))
    entries = F.transform(F.sort_array(F.collect_list(F.struct("resource_type", "id", "resource"))), lambda e: F.concat(F.lit('{"resource":'), e["resource"], F.lit("}")))
    return kept.groupBy("patient_id").agg(F.count("*").alias("total"), F.concat(F.lit('{"resourceType":"Bundle","type":"collection","entry":['), F.array_join(entries, ","), F.lit("]}")).alias("bundle"))


def deidentify(patients: DataFrame, salt: str) -> DataFrame:
    """Patient structs without direct identifiers: year of birth, hashed identifiers and id, state and country of addresses."""
    hashed = lambda c: F.sha2(F.concat(F.coalesce(c, F.lit("")), F.lit(salt)), 256)
    gone = [c for c in ("name", "telecom", "photo", "contact") if c in patients.columns]
    out = patients.drop(*gone).withColumn("id", F.substring(hashed(F.col("id")), 1, 16))
    if "birthDate" in patients.columns:
        out = out.withColumn("birthDate", F.concat(F.substring("birthDate", 1, 4), F.lit("-01-01")))
    if "identifier" in patients.columns:
        out = out.withColumn("identifier", F.transform("identifier", lambda i: F.struct(i["system"].alias("system"), hashed(i["value"]).alias("value"))))
    if "address" in patients.columns:
        out = out.withColumn("address", F.transform("address", lambda a: F.struct(a["state"].alias("state"), a["country"].alias("country"))))
    return out.withColumn("meta", F.struct(F.array(F.lit("deidentified")).alias("profile"), F.array(F.struct(F.lit("HTEST").alias("code"))).alias("security")))


def active_events(flags: DataFrame, conditions: DataFrame) -> DataFrame:
    """All flags and the active conditions."""
    return flags.withColumn("kind", F.lit("flag")).unionByName(conditions.where("status = 'active'").withColumn("kind", F.lit("condition")), allowMissingColumns=True)


def write_ndjson(resources: DataFrame, path: str) -> None:
    """Newline-delimited JSON by resource type."""
    resources.select("resource_type", F.col("resource").alias("value")).write.mode("overwrite").partitionBy("resource_type").text(path)
