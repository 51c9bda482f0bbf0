"""Keyword ontology: code system, domain scores, enrichment of feature rows, alerts and flags, topic labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulselake.functions.scalar import lookup, rnd

# Terms of each domain.
DOMAINS = {
    "cardiovascular": ["cardio", "cardíaco", "cardiaco", "arritmia", "frequência cardíaca", "heart rate", "ecg", "eletrocardiografia", "hipertensão", "infarto", "coronária", "valvular", "insuficiência cardíaca"],
    "respiratory": ["respiratório", "respiratorio", "spo2", "oxigenação", "pulmonar", "pneumologia", "ventilação", "asma", "dpoc"],
    "monitoring": ["telemedicina", "wearable", "monitoramento", "sensor", "iot", "dispositivo", "biométrico", "biometrico", "sinais vitais", "telemetria", "remoto"],
    "neurology": ["neurologia", "neurológico", "eeg", "epilepsia", "avc", "demência", "parkinson", "neuropatia"],
    "oncology": ["oncologia", "câncer", "cancer", "tumor", "neoplasia", "quimioterapia"],
    "mental_health": ["psiquiatria", "saúde mental", "depressão", "ansiedade", "psicologia"],
    "imaging": ["imagem", "tomografia", "ressonância", "radiologia", "ultrassom", "segmentação", "visualização 3d"],
}
# Domain of each metric and alert type.
METRIC_DOMAIN = {
    "heart_rate": "cardiovascular",
    "tachycardia": "cardiovascular",
    "bradycardia": "cardiovascular",
    "spo2": "respiratory",
    "hypoxemia": "respiratory",
    "hrv": "cardiovascular",
    "stress_index": "mental_health",
    "high_stress": "mental_health",
}
# Seed words of each topic.
SEEDS = {
    0: ["hipertensão", "cardíaco", "arritmia", "infarto", "insuficiência", "pressão", "eletrocardiograma", "fibrilação", "taquicardia", "coronária"],
    1: ["respiratório", "pulmonar", "asma", "oxigenação", "dispneia", "ventilação", "apneia", "saturação", "brônquio", "pneumonia"],
    2: ["diabetes", "glicose", "metabólico", "insulina", "glicemia", "hemoglobina", "resistência", "obesidade", "colesterol", "triglicérides"],
    3: ["neurológico", "autônomo", "vagal", "simpático", "parassimpático", "sono", "insônia", "estresse", "ansiedade", "variabilidade"],
    4: ["telemedicina", "monitoramento", "wearable", "dispositivo", "digital", "aplicativo", "teleconsulta", "telemonitoramento", "sensor", "remoto"],
}
#: Keywords of an ontology that rows are matched against; a registry of this size is one literal of the plan.
MOST_KEYWORDS = 100


def normalise(text: Column) -> Column:
    """Lower case, runs of blanks as one."""
    return F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"\s+", " ")


def code_system(keywords: DataFrame, areas: DataFrame, version: str = "1.0.0") -> DataFrame:
    """One row: a code system's JSON of the MOST_KEYWORDS most frequent keywords (keyword, n) and 30 areas (area, n).

    The caps are the feature; both tables are cut by a distributed top-k before they meet.
    """
    code = lambda c, n: F.substring(F.regexp_replace(c, " ", "-"), 1, n)
    concept = lambda name, value, what: F.struct(name.alias("code"), value.alias("display"), F.concat(F.lit(what), F.col("n").cast("string")).alias("definition"))
    top = keywords.orderBy(F.desc("n"), "keyword").limit(MOST_KEYWORDS).select(F.lit(0).alias("part"), "n", F.col("keyword").alias("name"), concept(code(F.col("keyword"), 60), F.col("keyword"), "keyword, documents: ").alias("c"))
    area = F.concat(F.lit("area-"), code(F.col("area"), 40))
    more = areas.orderBy(F.desc("n"), "area").limit(30).select(F.lit(1).alias("part"), "n", F.col("area").alias("name"), concept(area, F.col("area"), "area, documents: ").alias("c"))
    both = top.unionByName(more).agg(F.sort_array(F.collect_list(F.struct("part", (-F.col("n")).alias("rank"), "name", "c"))).alias("all"))
    concepts = F.transform("all", lambda x: x["c"])
    head = {"resourceType": "CodeSystem", "version": version, "status": "active", "content": "complete"}
    resource = F.struct(*(F.lit(v).alias(k) for k, v in head.items()), concepts.alias("concept"))
    return both.select(F.lit("CodeSystem").alias("resource_type"), F.size("all").alias("concepts"), F.to_json(resource).alias("resource"))


def domain_hits(text: Column, keywords: list[str] = ()) -> dict[str, Column]:
    """Score of each domain: terms, and ontology keywords that hold one, found in the text, over five, 1 at most."""
    low = normalise(text)
    hit = lambda t: F.contains(low, F.lit(t)).cast("int")
    total = lambda ts: reduce(lambda a, b: a + b, map(hit, ts), F.lit(0))
    owned = {d: [k for k in keywords if any(t in k for t in terms)] for d, terms in DOMAINS.items()}
    return {d: rnd(F.least(F.lit(1.0), (total(terms) + total(owned[d])) / 5.0), 3) for d, terms in DOMAINS.items()}


def matched_keywords(text: Column, keywords: dict[str, int], top: int = 5) -> Column:
    """The top keywords found in the text, by their counts relative to the largest (ties by keyword)."""
    most = max(keywords.values(), default=1)
    low = normalise(text)
    found = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(k)), F.struct(F.lit(-n).alias("rank"), F.lit(k).alias("keyword"), F.lit(round(n / most, 4)).alias("score"))) for k, n in keywords.items())))
    return F.transform(F.slice(F.array_sort(found), 1, top), lambda x: F.struct(x["keyword"].alias("keyword"), x["score"].alias("score")))


def enrich_features(rows: DataFrame, keywords: list[str] = ()) -> DataFrame:
    """Feature rows with a score per domain, ont_<domain>; episodes, resting rates above 100 and low saturations set floors."""
    named = [F.when(F.col(c) > 0, F.lit(c)) for c in ("anomaly_episodes", "total_alerts", "avg_resting_hr", "avg_spo2")]
    scores = domain_hits(F.concat_ws(" ", "clinical_risk_level", "patient_id", *named), keywords)
    floor = {"monitoring": (F.col("anomaly_episodes") > 0, 0.5), "cardiovascular": (F.col("avg_resting_hr") > 100, 0.7), "respiratory": (F.col("avg_spo2") < 94, 0.7)}
    lifted = {d: F.when(floor[d][0], F.greatest(s, F.lit(floor[d][1]))).otherwise(s) if d in floor else s for d, s in scores.items()}
    return rows.withColumns({f"ont_{d}": s for d, s in lifted.items()})


def enrich_alerts(alerts: DataFrame, keywords: dict[str, int]) -> DataFrame:
    """Alerts with the keywords of their type and metric, domain scores (the metric's domain 0.8 at least) and the top domain."""
    text = F.concat_ws(" ", "alert_type", "metric_type")
    own = lookup(F.col("metric_type"), METRIC_DOMAIN)
    scores = {d: F.when(own == d, F.greatest(s, F.lit(0.8))).otherwise(s) for d, s in domain_hits(text, list(keywords)).items()}
    pairs = F.array(*(F.struct((-s).alias("rank"), F.lit(d).alias("domain")) for d, s in scores.items()))
    best = F.array_min(pairs)
    listed = F.array_join(F.transform(F.filter(F.array_sort(pairs), lambda p: p["rank"] < 0), lambda p: F.concat_ws(":", p["domain"], (-p["rank"]).cast("string"))), ",")
    return alerts.withColumns({"ontology_keywords": F.transform(matched_keywords(text, keywords), lambda k: k["keyword"]), "ontology_domains": listed, "top_domain": F.when(best["rank"] < 0, best["domain"])})


def flag_extensions(alerts: DataFrame) -> DataFrame:
    """Alerts of enrich_alerts with the extension array (JSON) of their flag: one entry per keyword, one for the top domain."""
    entry = lambda url, value: F.struct(F.lit(url).alias("url"), value.alias("value"))
    words = F.transform("ontology_keywords", lambda k: entry("ontology-keyword", F.substring(F.regexp_replace(k, " ", "-"), 1, 60)))
    domain = F.array_compact(F.array(F.when(F.col("top_domain").isNotNull(), entry("ontology-domain", F.col("top_domain")))))
    return alerts.withColumn("extension", F.to_json(F.concat(words, domain)))


def label_topics(topics: DataFrame, seeds: dict[int, list[str]] = SEEDS) -> DataFrame:
    """Per topic (topic, rank, word): its label of three words and the seed list of the largest Jaccard overlap with its words.

    Without overlap the category is null; ties go to the smaller one.
    """
    t = topics.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("words"))
    jaccard = lambda s: F.size(F.array_intersect("words", s)) / F.size(F.array_union("words", s))
    overlaps = F.array(*(F.struct(jaccard(F.array(*map(F.lit, w))).alias("score"), F.lit(-c).alias("before"), F.lit(c).alias("category")) for c, w in seeds.items()))
    best = F.array_max(overlaps)
    return t.select("topic", F.array_join(F.slice("words", 1, 3), " | ").alias("label"), F.when(best["score"] > 0, best["category"]).alias("category"), rnd(best["score"], 6).alias("score"))
