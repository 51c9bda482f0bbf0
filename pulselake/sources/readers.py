"""Sources: phone export XML and JSON, fitness payloads, band envelopes, FHIR bundles, BLE bytes; registry and normalisers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pulselake.functions.scalar import lookup, parse_timestamp, stable_id

# Type names of the phone export and the metrics they carry.
PHONE_TYPES = {
    "HKQuantityTypeIdentifierHeartRate": "heart_rate",
    "HKQuantityTypeIdentifierOxygenSaturation": "spo2",
    "HKQuantityTypeIdentifierHeartRateVariabilitySDNN": "hrv",
    "HKQuantityTypeIdentifierStepCount": "steps",
    "HKQuantityTypeIdentifierRespiratoryRate": "respiratory_rate",
    "HKCategoryTypeIdentifierSleepAnalysis": "sleep_stage",
}
UNITS = {"heart_rate": "bpm", "spo2": "%", "hrv": "ms", "steps": "count", "stress_index": "index", "skin_temp": "Cel", "respiratory_rate": "/min", "sleep_stage": "stage", "blood_pressure_sys": "mmHg", "blood_pressure_dia": "mmHg", "glucose_mgdl": "mg/dL"}
_XML = "_type string, _sourceName string, _device string, _unit string, _creationDate string, _startDate string, _endDate string, _value string"


def normalise(rows: DataFrame, vendor: str, source: str, confidence: float = 0.95) -> DataFrame:
    """(patient_id, device_id, metric_type, metric_value, ts) as bronze rows with a deterministic event id."""
    iso = F.date_format("timestamp_utc", "yyyy-MM-dd'T'HH:mm:ss")
    made = rows.withColumn("timestamp_utc", F.col("ts")).drop("ts")
    return made.withColumns(
        {
            "event_id": stable_id(F.col("patient_id"), F.col("device_id"), F.col("metric_type"), iso, F.col("metric_value")),
            "vendor": F.lit(vendor),
            "source": F.lit(source),
            "unit": lookup(F.col("metric_type"), UNITS, "unit"),
            "signal_confidence": F.col("confidence") if "confidence" in rows.columns else F.lit(confidence),
            "partition_date": F.to_date("timestamp_utc"),
        }
    ).drop("confidence")


def _phone_value(metric: Column, raw: Column) -> Column:
    number = raw.try_cast("double")
    stage = F.when(raw.contains("Deep"), 2.0).when(raw.contains("Awake") | raw.contains("InBed"), 0.0).otherwise(1.0)
    return F.when(metric == "sleep_stage", stage).when((metric == "spo2") & (number <= 1.0), number * 100).otherwise(number)


def phone_xml(spark: SparkSession, path: str, patient_id: str, by_line: bool = False) -> DataFrame:
    """Records of a phone's XML export; types outside the six metrics are dropped.

    A file is an export; with by_line it holds any number of them, each record on a line of its own.
    """
    x = spark.read.format("xml").option("rowTag", "Record").option("multiLine", not by_line).schema(_XML).load(path)
    metric = lookup(F.col("_type"), PHONE_TYPES)
    rows = x.select(F.lit(patient_id).alias("patient_id"), F.coalesce("_sourceName", F.lit("phone")).alias("device_id"), metric.alias("metric_type"), _phone_value(metric, F.col("_value")).alias("metric_value"), parse_timestamp(F.regexp_replace(F.coalesce("_startDate", "_creationDate"), r" ([+-]\d{4})$", "$1")).alias("ts"))
    return normalise(rows.where("metric_type is not null"), "apple", "apple_health")


def phone_json(spark: SparkSession, path: str, patient_id: str, by_line: bool = False) -> DataFrame:
    """Records of a JSON export, in ``records`` or as a bare list; types by full or short name. A file is an export, or with by_line each of its lines."""
    raw = spark.read.text(path, wholetext=not by_line)
    item = "array<struct<type:string,value:string,startDate:string,creationDate:string,sourceName:string>>"
    rows = raw.select(F.explode(F.coalesce(F.from_json(F.get_json_object("value", "$.records"), item), F.from_json("value", item))).alias("r")).select("r.*")
    short = {v: v for v in PHONE_TYPES.values()}
    metric = F.coalesce(lookup(F.col("type"), PHONE_TYPES), lookup(F.lower("type"), short))
    out = rows.select(F.lit(patient_id).alias("patient_id"), F.coalesce("sourceName", F.lit("phone")).alias("device_id"), metric.alias("metric_type"), _phone_value(metric, F.col("value")).alias("metric_value"), parse_timestamp(F.coalesce("startDate", "creationDate")).alias("ts"))
    return normalise(out.where("metric_type is not null"), "apple", "apple_health")


def fitness_cache(spark: SparkSession, path: str, patient_id: str, by_line: bool = False) -> DataFrame:
    """Cached readings of a fitness service; a file is a payload, or with by_line each of its lines."""
    raw = spark.read.schema("saved_at string, readings array<struct<metric_type:string,value:double,timestamp:string>>").option("multiLine", not by_line).json(path)
    r = raw.select(F.explode("readings").alias("r")).select(F.lit(patient_id).alias("patient_id"), F.lit("google-fit").alias("device_id"), "r.metric_type", F.col("r.value").alias("metric_value"), parse_timestamp(F.col("r.timestamp")).alias("ts"))
    return normalise(r, "google", "google_fit")


def fitness_buckets(spark: SparkSession, path: str, patient_id: str, metric: str) -> DataFrame:
    """Bucketed API payload: bucket, dataset, point; nanoseconds; floating value before integer."""
    schema = "bucket array<struct<dataset:array<struct<point:array<struct<startTimeNanos:string,value:array<struct<fpVal:double,intVal:bigint>>>>>>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    p = raw.select(F.explode("bucket").alias("b")).select(F.explode("b.dataset").alias("d")).select(F.explode("d.point").alias("p"))
    v = p.select(F.timestamp_micros((F.col("p.startTimeNanos").cast("long") / 1000).cast("long")).alias("ts"), F.explode("p.value").alias("v"))
    r = v.select(F.lit(patient_id).alias("patient_id"), F.lit("google-fit").alias("device_id"), F.lit(metric).alias("metric_type"), F.coalesce("v.fpVal", F.col("v.intVal").cast("double")).alias("metric_value"), "ts")
    return normalise(r, "google", "google_fit")


_SAMPLE = "struct<time:string,rate:double,spo2:double,hrv:double,step:double,high:double,low:double,temp:double,base_temp:double,resp:double,sport:double>"
_ENVELOPE = (
    "message_type string, schema_version string, payload struct<patient_id:string,device:struct<patient_id:string,device_id:string,vendor:string,origin_protocol_version:int>,timestamp:string,heart_rate:double,spo2:double,hrv:double,"
    f"skin_temp:double,blood_pressure_sys:double,blood_pressure_dia:double,stress:double,respiratory_rate:double,samples:array<{_SAMPLE}>,sleep_quality:double,sleep_minutes:double,sleep_line:string,precise:boolean,start:string,step:double,distance_km:double,kcal:double>, _corrupt string"
)


def band_envelopes(spark: SparkSession, path: str, default_patient: str) -> tuple[DataFrame, DataFrame]:
    """(readings, errors) of a band companion's JSON lines; a bad envelope becomes an error row and the rest goes on."""
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    e = raw.select("value", F.from_json("value", _ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    bad = F.col("e._corrupt").isNotNull() | F.col("e.payload").isNull()
    errors = e.where(bad).select(F.col("value").alias("envelope"), F.lit("unreadable envelope").alias("error"))
    p = e.where(~bad).select("e.message_type", "e.payload.*").withColumns({"pid": F.coalesce("patient_id", "device.patient_id", F.lit(default_patient)), "did": F.coalesce("device.device_id", F.lit("band"))})
    row = lambda m, v: F.struct(F.lit(m).alias("metric_type"), v.cast("double").alias("metric_value"))
    kind = F.coalesce(F.col("message_type"), F.when(F.col("samples").isNotNull(), "origin").when(F.col("sleep_line").isNotNull(), "sleep").when(F.col("step").isNotNull(), "sport").otherwise("realtime"))
    p = p.withColumn("kind", kind)
    realtime = F.array(row("heart_rate", F.when(F.col("heart_rate") >= 20, F.col("heart_rate"))), row("spo2", F.col("spo2")), row("hrv", F.col("hrv")), row("skin_temp", F.col("skin_temp")), row("blood_pressure_sys", F.col("blood_pressure_sys")), row("blood_pressure_dia", F.col("blood_pressure_dia")), row("stress_index", F.col("stress")), row("respiratory_rate", F.col("respiratory_rate")))
    sport = F.array(row("steps", F.col("step")), row("distance_km", F.col("distance_km")), row("kcal", F.col("kcal")))
    wide = p.where(F.col("kind").isin("realtime", "sport")).select("pid", "did", parse_timestamp(F.col("timestamp")).alias("ts"), F.explode(F.when(F.col("kind") == "sport", sport).otherwise(realtime)).alias("m"), F.lit(0.95).alias("confidence"))
    s = p.where("kind = 'origin'").select("pid", "did", F.coalesce("device.origin_protocol_version", F.lit(3)).alias("protocol"), F.explode("samples").alias("s"))
    origin_rows = F.array(
        row("heart_rate", F.when(F.col("s.rate").between(20, 250), F.col("s.rate"))), row("spo2", F.when(F.col("s.spo2").between(50, 100), F.col("s.spo2"))), row("hrv", F.col("s.hrv")), row("steps", F.col("s.step")), row("blood_pressure_sys", F.col("s.high")), row("blood_pressure_dia", F.col("s.low")),
        row("skin_temp", F.coalesce("s.base_temp", "s.temp")), row("respiratory_rate", F.col("s.resp")), row("stress_index", F.least(F.lit(100.0), F.col("s.sport") / 655.35)),
    )
    origin = s.select("pid", "did", parse_timestamp(F.col("s.time")).alias("ts"), F.explode(origin_rows).alias("m"), F.when(F.col("protocol") < 3, 0.85).otherwise(0.95).alias("confidence"))
    every = F.when(F.coalesce("precise", F.lit(False)), 60).otherwise(12)
    stages = p.where("kind = 'sleep' and sleep_line is not null").select("pid", "did", parse_timestamp(F.coalesce("start", "timestamp")).alias("t0"), every.alias("every"), F.posexplode(F.split("sleep_line", "")).alias("k", "c")).where("c <> '' and k % every = 0")
    sleep = stages.select("pid", "did", F.timestamp_seconds(F.unix_seconds("t0") + F.col("k") * 60).alias("ts"), row("sleep_stage", F.col("c").try_cast("double")).alias("m"), F.lit(0.95).alias("confidence"))
    total = p.where("kind = 'sleep'").select("pid", "did", parse_timestamp(F.coalesce("timestamp", "start")).alias("ts"), row("sleep_quality", F.coalesce("sleep_quality", "sleep_minutes")).alias("m"), F.lit(0.95).alias("confidence"))
    long_ = reduce(DataFrame.unionByName, (wide, origin, sleep, total)).select(F.col("pid").alias("patient_id"), F.col("did").alias("device_id"), "m.*", "ts", "confidence").where("metric_value is not null")
    return normalise(long_, "hband", "device_stream"), errors


def fhir_bundle(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """(resource_type, id, resource as JSON) of every entry of cached bundles; a file is a bundle, or with by_line each of its lines."""
    raw = spark.read.text(path, wholetext=not by_line)
    entries = F.coalesce(F.from_json(F.get_json_object("value", "$.bundle.entry"), "array<struct<resource:string>>"), F.from_json(F.get_json_object("value", "$.entry"), "array<struct<resource:string>>"))
    r = raw.select(F.explode(entries).alias("e")).select(F.col("e.resource").alias("resource"))
    return r.select(F.get_json_object("resource", "$.resourceType").alias("resource_type"), F.get_json_object("resource", "$.id").alias("id"), "resource")


def heart_rate_bytes(payload: Column) -> Column:
    """Heart rate out of a measurement's bytes: flag bit 0 tells one byte from two little-endian bytes; empty is 0."""
    byte = lambda k: F.conv(F.hex(F.substring(payload, k, 1)), 16, 10).cast("int")
    return F.when(F.octet_length(payload) < 2, 0).when(byte(1) % 2 == 0, byte(2)).otherwise(byte(2) + 256 * F.coalesce(byte(3), F.lit(0)))


SOURCES: dict[str, Callable[..., DataFrame]] = {"apple_xml": phone_xml, "apple_json": phone_json, "google_fit": fitness_cache}


def collect_all(spark: SparkSession, wanted: dict[str, tuple[str, str]], registry: dict[str, Callable[..., DataFrame]] = SOURCES) -> tuple[DataFrame | None, DataFrame]:
    """(all readings, status per source) of sources by name: (path, patient).

    Unknown sources and those that cannot be opened are skipped with the reason; the rows of the others
    are counted by one aggregate, run when the status is read.
    """
    frames, skipped = {}, []
    for name, (path, patient) in wanted.items():
        if name not in registry:
            skipped.append((name, "skipped", 0, "unknown source"))
            continue
        try:
            frames[name] = registry[name](spark, path, patient)
        except (AnalysisException, OSError, ValueError) as error:
            skipped.append((name, "skipped", 0, str(error).splitlines()[0][:200]))
    status = spark.createDataFrame(skipped, "source string, status string, records long, error string")
    if not frames:
        return None, status
    union = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    tagged = reduce(union, (df.select(F.lit(name).alias("source")) for name, df in frames.items()))
    known = spark.createDataFrame([(n,) for n in frames], "source string")
    counted = known.join(tagged.groupBy("source").count(), "source", "left").withColumn("records", F.coalesce("count", F.lit(0)))
    told = counted.select("source", F.when(F.col("records") > 0, "ok").otherwise("empty").alias("status"), "records", F.lit("").alias("error"))
    return reduce(union, frames.values()), told.unionByName(status)
