"""Streaming queries run over what is available, each beside the SQL of its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulselake.functions.scalar import lookup
from pulselake.functions.scalar import rnd as round_
from pulselake.ml import models
from pulselake.ml.jobs import score_online
from pulselake.plans import clinical_queries, views
from pulselake.plans.base import Registry
from pulselake.plans.lake_queries import VALID_SQL
from pulselake.plans.views import rnd
from pulselake.session import Scratch, read_table
from pulselake.streaming import jobs

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
WIDTH = 3 * 86_400


def reading_stream(spark, sf_dir):
    """events as a stream of readings."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    kind, value = F.col("event_type"), F.col("value")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"), F.concat(F.lit("PAT-"), F.col("user_id").cast("string")).alias("patient_id"), F.concat_ws("-", F.lit("dev"), (F.col("user_id") % 5).cast("string"), (F.col("event_id") % 2).cast("string")).alias("device_id"),
        lookup(kind, views.METRIC_OF).alias("metric_type"), F.when(kind == "view", 40 + value).when(kind == "click", 100 - value / 10).otherwise(value).alias("metric_value"), F.col("ts").cast("timestamp").alias("timestamp_utc"),
        ((F.col("event_id") % 100) / 100.0).alias("battery_level"), (0.4 + 0.006 * F.get_json_object("props", "$.k").cast("double")).alias("signal_confidence"), F.to_date("ts").alias("partition_date"),
    )


def drained(spark, name, stream):
    work = Scratch(spark, name)
    return jobs.drain(spark, stream, f"{work.root}/out", f"{work.root}/checkpoint")


@query("stream_ingest", VALID_SQL + f"SELECT w.event_id, w.quality_flags, {rnd('w.quality_score', 3)} AS quality_score, w.is_valid FROM w", lists=["quality_flags"])
def stream_ingest(spark, sf_dir):
    """Validated rows as the stream wrote them."""
    work = Scratch(spark, "stream_ingest")
    jobs.ingest(reading_stream(spark, sf_dir), f"{work.root}/bronze", f"{work.root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{work.root}/bronze").select("event_id", "quality_flags", round_("quality_score", 3).alias("quality_score"), "is_valid")


_LAST = "(SELECT max(epoch(timestamp_utc)) - 600 AS mark FROM bronze)"


@query("stream_reconciliation", f"""WITH {views.BRONZE_SQL}, w AS (SELECT patient_id, metric_type, floor(epoch(timestamp_utc) / {WIDTH}) * {WIDTH} AS s, avg(metric_value) AS v, coalesce(stddev_samp(metric_value), 0) AS sd, count(*) AS n FROM bronze GROUP BY 1, 2, 3)
 SELECT patient_id, metric_type, CAST(s AS BIGINT) AS window_start, {rnd('v', 2)} AS metric_value, {rnd('sd', 2)} AS metric_std, n AS reading_count FROM w WHERE s + {WIDTH} <= (SELECT mark FROM {_LAST})""")
def stream_reconciliation(spark, sf_dir):
    s = drained(spark, "stream_reconciliation", jobs.reconcile_stream(reading_stream(spark, sf_dir), f"{WIDTH} seconds"))
    return s.select("patient_id", "metric_type", F.unix_seconds("window_start").alias("window_start"), "metric_value", "metric_std", "reading_count")


def snapshot_stream(spark, sf_dir, *more):
    """Line items as a stream of vital snapshots."""
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    li = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
    vitals = (f"cast({e} as double) as {c}" for c, e in clinical_queries._SNAP.items())
    return li.selectExpr("concat(l_orderkey, '-', l_linenumber) as event_id", *more, *vitals, "l_returnflag = 'R' and l_linenumber = 1 as consciousness_altered", *clinical_queries._split_sources())


@query(
    "stream_alerts",
    f"""WITH {clinical_queries.DECIDED_SQL} SELECT l_orderkey || '-' || l_linenumber AS event_id, is_true_alert AND reasons = '' AS alert,
  CASE WHEN is_true_alert AND reasons <> '' THEN 'suppressed_sample_discrepancy' WHEN is_true_alert THEN 'rule_only' WHEN fp_candidate THEN 'suppressed_false_positive' ELSE 'stable_or_noise' END AS decision,
  primary_rule FROM dis""",
)
def stream_alerts(spark, sf_dir):
    """Decision of every streamed snapshot, read back from its frame."""
    out = drained(spark, "stream_alerts", jobs.alert_stream(snapshot_stream(spark, sf_dir)))
    at = lambda k: F.get_json_object("frame", f"$.{k}")
    return out.select("event_id", (at("alert") == "true").alias("alert"), at("decision").alias("decision"), at("primary_rule").alias("primary_rule"))


@query("stream_cusum", f"""WITH {views.BRONZE_SQL}, o AS (SELECT patient_id AS series, timestamp_utc, event_id, metric_value - 60 - 10 AS u, 60 - 10 - metric_value AS d FROM bronze),
 c AS (SELECT *, sum(u) OVER w AS cu, sum(d) OVER w AS cd FROM o WINDOW w AS (PARTITION BY series ORDER BY timestamp_utc, CAST(event_id AS BIGINT) ROWS UNBOUNDED PRECEDING)),
 s AS (SELECT *, cu - least(0, min(cu) OVER w) AS up, cd - least(0, min(cd) OVER w) AS dn FROM c WINDOW w AS (PARTITION BY series ORDER BY timestamp_utc, CAST(event_id AS BIGINT) ROWS UNBOUNDED PRECEDING))
 SELECT series, count(*) AS n, count(*) FILTER (up > 200 OR dn > 200) AS alarms FROM s GROUP BY 1""")
def stream_cusum(spark, sf_dir):
    r = reading_stream(spark, sf_dir).select(F.col("patient_id").alias("series"), F.col("timestamp_utc").alias("ts"), F.col("event_id").cast("long").alias("idx"), F.col("metric_value").alias("x"))
    out = drained(spark, "stream_cusum", jobs.cusum_stream(r, 60.0, 10.0, 200.0))
    return out.groupBy("series").agg(F.count("*").alias("n"), F.count_if("alarm").alias("alarms"))


@query(
    "stream_ewma",
    f"""WITH RECURSIVE {views.BRONZE_SQL}, o AS (SELECT patient_id AS series, metric_value AS x, row_number() OVER (PARTITION BY patient_id ORDER BY timestamp_utc, metric_value) AS k FROM bronze),
 r AS (SELECT series, k, x AS mean, 0.0::DOUBLE AS var, 0.0::DOUBLE AS z FROM o WHERE k = 1 UNION ALL
  SELECT series, k, m, v, CASE WHEN sqrt(v) >= 1e-12 THEN (x - m) / sqrt(v) ELSE 0 END FROM (SELECT *, (x - m) ** 2 * 2 / 21 + var * 19 / 21 AS v FROM
   (SELECT o.series, o.k, o.x, r.var, o.x * 2 / 21 + r.mean * 19 / 21 AS m FROM r JOIN o ON o.series = r.series AND o.k = r.k + 1)))
 SELECT series, count(*) AS n, {rnd('sum(z)', 4)} AS z_sum, {rnd('max(abs(z))', 4)} AS z_max, count(*) FILTER (abs(z) > 3) AS alarms FROM r GROUP BY 1""",
)
def stream_ewma(spark, sf_dir):
    """Scores of the streamed readings, summed per patient."""
    r = reading_stream(spark, sf_dir).select(F.col("patient_id").alias("series"), F.col("timestamp_utc").alias("ts"), F.col("metric_value").alias("x"))
    out = drained(spark, "stream_ewma", jobs.ewma_stream(r))
    return out.groupBy("series").agg(F.count("*").alias("n"), round_(F.sum("z"), 4).alias("z_sum"), round_(F.max(F.abs("z")), 4).alias("z_max"), F.count_if("alarm").alias("alarms"))


@query("stream_latent_states", f"WITH {views.BRONZE_SQL} SELECT patient_id, count(*) AS n, least(100, count(*)) AS history FROM bronze WHERE metric_type IN ('heart_rate', 'hrv', 'steps') GROUP BY 1")
def stream_latent_states(spark, sf_dir):
    out = drained(spark, "stream_latent", jobs.latent_stream(latent_readings(spark, sf_dir).where("heart_rate is not null or hrv_rmssd is not null or activity_level is not null"), hours=None))
    return out.groupBy("patient_id").agg(F.count("*").alias("n"), F.max("history_size").cast("long").alias("history"))


def latent_readings(spark, sf_dir):
    """Streamed readings as observations of the latent model; stress stands for the skin's warmth, a degree a hundred points about its set point."""
    of = lambda m: F.when(F.col("metric_type") == m, F.col("metric_value"))
    r = reading_stream(spark, sf_dir)
    return r.select(
        "patient_id", F.col("timestamp_utc").alias("ts"), of("heart_rate").alias("heart_rate"), of("hrv").alias("hrv_rmssd"),
        (33 + (of("stress_index") - 50) / 100).alias("skin_temp"), of("steps").alias("activity_level"),
    )


@query("stream_latent_steps")
def stream_latent_steps(spark, sf_dir):
    """Every streamed reading's latent states; `latent_states` on the same readings gives the same (tests)."""
    r = latent_readings(spark, sf_dir).where("coalesce(heart_rate, hrv_rmssd, skin_temp, activity_level) is not null")
    return drained(spark, "stream_latent_steps", jobs.latent_stream(r, hours=None))


@query("stream_fusion", f"""{views.FUSED_SQL} SELECT series, w AS "window", {rnd('fused', 6)} AS fused, {rnd('variance', 6)} AS variance, n_sensors FROM r
 WHERE k > 0 AND (w + 1) * {views.WINDOW} <= (SELECT max(epoch(timestamp_utc)) - 600 FROM bronze WHERE metric_type = 'heart_rate')""")
def stream_fusion(spark, sf_dir):
    """Fused heart rate of every window that the watermark has passed."""
    r = reading_stream(spark, sf_dir).where("metric_type = 'heart_rate'")
    r = r.select(F.col("patient_id").alias("series"), F.col("timestamp_utc").alias("ts"), F.col("device_id").alias("sensor"), F.col("event_id").alias("tie"), F.col("metric_value").alias("x"))
    out = drained(spark, "stream_fusion", jobs.fusion_stream(r, views.WINDOW))
    return out.select("series", "window", round_("fused", 6).alias("fused"), round_("variance", 6).alias("variance"), "n_sensors")


@query(
    "stream_scoring",
    f"""WITH m AS (SELECT l_orderkey || '-' || l_linenumber AS event_id, l_quantity::DOUBLE AS q, l_extendedprice::DOUBLE AS p FROM lineitem),
 s AS (SELECT avg(q) AS mq, avg(p) AS mp, var_samp(q) AS a, covar_samp(q, p) AS b, var_samp(p) AS c FROM m),
 x AS (SELECT event_id, (c * (q - mq) * (q - mq) - 2 * b * (q - mq) * (p - mp) + a * (p - mp) * (p - mp)) / (a * c - b * b) AS d2 FROM m, s)
 SELECT event_id, {rnd('exp(-d2 / 2)', 4)} AS p_value, exp(-d2 / 2) < 0.01 AS is_alert FROM x""",
)
def stream_scoring(spark, sf_dir):
    """Streamed rows scored by a model fitted on the batch: distance from normal and its tail probability."""
    work = Scratch(spark, "stream_scoring")
    columns = ["q", "p"]
    measured = ["cast(l_quantity as double) as q", "cast(l_extendedprice as double) as p"]
    mean, inverse = models.mahalanobis_fit(read_table(spark, sf_dir, "lineitem").selectExpr(*measured), columns)
    rows = snapshot_stream(spark, sf_dir, *measured).select("event_id", *columns)
    jobs.score_stream(rows, lambda df: score_online(df, columns, mean, inverse), f"{work.root}/scored", f"{work.root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{work.root}/scored").select("event_id", round_("p_value", 4).alias("p_value"), "is_alert")
