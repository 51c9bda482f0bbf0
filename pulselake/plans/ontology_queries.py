"""Queries of the keyword ontology and of the temporal feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulselake.ml import features
from pulselake.plans import views
from pulselake.plans.base import Registry
from pulselake.plans.intelligence_queries import vitals_with_baseline
from pulselake.plans.text_queries import _WORDS
from pulselake.plans.views import DAILY_SQL, rnd
from pulselake.series import temporal
from pulselake.session import Scratch, read_table
from pulselake.text import corpus, ontology

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

#: Keywords of the driver queries with their counts.
KEYWORDS = {"tachycardia": 40, "heart": 30, "spo2": 20, "stress": 10, "hypoxemia": 25}


def _scores_sql(text: str, keywords=()) -> dict[str, str]:
    """Domain scores of a normalised text expression."""
    hit = lambda t: f"contains({text}, '{t}')::INTEGER"
    total = lambda terms: " + ".join(map(hit, [*terms, *(k for k in keywords if any(t in k for t in terms))]))
    return {d: f"{rnd(f'least(1, ({total(terms)}) / 5.0::DOUBLE)', 3)}" for d, terms in ontology.DOMAINS.items()}


_FLOOR = {"monitoring": ("anomaly_episodes > 0", 0.5), "cardiovascular": ("avg_resting_hr > 100", 0.7), "respiratory": ("avg_spo2 < 94", 0.7)}
_ENRICHED = ", ".join(
    f"CASE WHEN {_FLOOR[d][0]} THEN greatest({s}, {_FLOOR[d][1]}::DOUBLE) ELSE {s} END AS ont_{d}" if d in _FLOOR else f"{s} AS ont_{d}" for d, s in _scores_sql("low").items()
)


@query(
    "enriched_features",
    f"""WITH {DAILY_SQL}, n AS (SELECT patient_id, count(*) AS total_alerts FROM alerts GROUP BY 1),
 b AS (SELECT patient_id, summary_date, clinical_risk_level, anomaly_episodes, avg_resting_hr, avg_spo2, coalesce(total_alerts, 0) AS total_alerts FROM daily LEFT JOIN n USING (patient_id)),
 w AS (SELECT *, lower(concat_ws(' ', clinical_risk_level, patient_id, CASE WHEN anomaly_episodes > 0 THEN 'anomaly_episodes' END, CASE WHEN total_alerts > 0 THEN 'total_alerts' END,
   CASE WHEN avg_resting_hr > 0 THEN 'avg_resting_hr' END, CASE WHEN avg_spo2 > 0 THEN 'avg_spo2' END)) AS low FROM b)
 SELECT patient_id, summary_date, {_ENRICHED} FROM w""",
    dates=["summary_date"],
)
def enriched_features(spark, sf_dir):
    """Feature rows of all patient days with a score per domain."""
    t = views.gold_tables(spark, sf_dir)
    rows = ontology.enrich_features(features.batch_features(t["daily"], t["alerts"]))
    return rows.select("patient_id", "summary_date", *(f"ont_{d}" for d in ontology.DOMAINS))


_OWN = "CASE metric_type " + " ".join(f"WHEN '{m}' THEN '{d}'" for m, d in ontology.METRIC_DOMAIN.items()) + " ELSE '' END"
_ALERT_SCORES = ", ".join(f"{{'r': -(CASE WHEN {_OWN} = '{d}' THEN greatest({s}, 0.8::DOUBLE) ELSE {s} END), 'd': '{d}'}}" for d, s in _scores_sql("low", KEYWORDS).items())
_FOUND = "list_filter([" + ", ".join(f"CASE WHEN contains(low, '{k}') THEN '{k}' END" for k in sorted(KEYWORDS, key=lambda k: (-KEYWORDS[k], k))) + "], lambda x: x IS NOT NULL)"


@query(
    "enriched_alerts",
    f"""WITH {DAILY_SQL}, w AS (SELECT alert_id, metric_type, lower(alert_type || ' ' || metric_type) AS low FROM alerts), s AS (SELECT *, [{_ALERT_SCORES}] AS p FROM w)
 SELECT alert_id, array_to_string(({_FOUND})[1:5], ',') AS ontology_keywords, CASE WHEN list_min(p).r < 0 THEN list_min(p).d END AS top_domain,
  len(({_FOUND})[1:5]) + CASE WHEN list_min(p).r < 0 THEN 1 ELSE 0 END AS extensions FROM s""",
)
def enriched_alerts(spark, sf_dir):
    """Alerts with keywords, top domain and the extensions of their flags."""
    a = ontology.flag_extensions(ontology.enrich_alerts(views.gold_tables(spark, sf_dir)["alerts"], KEYWORDS))
    return a.select("alert_id", "ontology_keywords", "top_domain", F.json_array_length("extension").alias("extensions"))


@query(
    "ontology_code_system",
    f"""WITH {_WORDS}, t AS (SELECT token, count(*) AS n FROM words GROUP BY 1 ORDER BY n DESC, token LIMIT 100),
 a AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, source LIMIT 30)
 SELECT 'CodeSystem' AS resource_type, (SELECT count(*) FROM t) + (SELECT count(*) FROM a) AS concepts, (SELECT token FROM t ORDER BY n DESC, token LIMIT 1) AS first_code,
  (SELECT 'area-' || source FROM a ORDER BY n DESC, source LIMIT 1) AS first_area""",
)
def ontology_code_system(spark, sf_dir):
    """Code system of the most frequent tokens and sources."""
    d = read_table(spark, sf_dir, "documents")
    keywords = corpus.token_counts(d, ontology.MOST_KEYWORDS).select(F.col("token").alias("keyword"), "n")
    areas = d.where("source is not null").groupBy(F.col("source").alias("area")).agg(F.count("*").alias("n"))
    cs = Scratch(spark, "code_system").write(ontology.code_system(keywords, areas), "code_system")
    at = lambda p: F.get_json_object("resource", p)
    codes = F.from_json(at("$.concept"), "array<struct<code:string>>")
    first_area = F.get(F.filter(codes, lambda c: c["code"].startswith("area-")), F.lit(0))["code"]
    return cs.select("resource_type", F.col("concepts").cast("long").alias("concepts"), at("$.concept[0].code").alias("first_code"), first_area.alias("first_area"))


@query("temporal_features")
def temporal_features(spark, sf_dir):
    """The feature matrix of all windows of all patients."""
    v = vitals_with_baseline(spark, sf_dir).withColumn("n_conditions", F.size("clinical_conditions"))
    return temporal.feature_matrix(v)
