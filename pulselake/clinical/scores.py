"""Fuzzy inference, evidence fusion, Bayesian hypotheses, baselines and prevention nudges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulselake.functions.scalar import rnd


def triangle(x: Column, a: float, b: float, c: float) -> Column:
    """Triangular membership; at or below a it is 0 even where a = b."""
    up = (x - a) / (b - a) if b > a else F.lit(1.0)
    down = (c - x) / (c - b) if c > b else F.lit(1.0)
    return F.when((x <= a) | (x >= c), 0.0).when(x <= b, up).otherwise(down)


def trapezoid(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """Trapezoidal membership."""
    return F.when((x <= a) | (x >= d), 0.0).when(x < b, (x - a) / (b - a)).when(x <= c, 1.0).otherwise((d - x) / (d - c))


# Membership breakpoints by variable; three are triangles, four trapezoids.
MEMBERSHIP = {
    "hr_deviation": {"normal": (0, 0, 1.5), "elevated": (1.0, 2.5, 4.0), "critical": (3.0, 4.5, 8.0, 12.0)},
    "spo2_risk": {"safe": (0, 0, 0.3), "warning": (0.2, 0.5, 0.8), "danger": (0.6, 0.8, 1.0, 1.2)},
    "hrv_suppression": {"normal": (0, 0, 0.25), "moderate": (0.15, 0.4, 0.65), "severe": (0.5, 0.7, 1.0, 1.2)},
    "ghost": {"absent": (0, 0, 0.2), "present": (0.15, 0.45, 0.75), "strong": (0.55, 0.75, 1.0, 1.2)},
    "noise": {"low": (0, 0, 0.3), "medium": (0.2, 0.5, 0.8), "high": (0.6, 0.8, 1.2, 1.5)},
    "persistence": {"transient": (0, 0, 0.35), "sustained": (0.25, 0.55, 0.85), "persistent": (0.7, 0.85, 1.0, 1.2)},
    "burden": {"low": (0, 0, 0.35), "moderate": (0.25, 0.5, 0.75), "high": (0.6, 0.8, 1.0, 1.2)},
    "trajectory": {"stable": (0, 0, 0.3), "rising": (0.1, 0.5, 1.2)},
}
# Output levels.
LEVELS = {"very_low": 0.1, "low": 0.25, "moderate": 0.5, "high": 0.75, "very_high": 0.95}
# Rule, output, level, antecedents (variable.term, joined by and; | is or).
FUZZY_RULES = [
    ("R1_noise_suppress", "false_positive", 0.9, "noise.high persistence.transient"),
    ("R1_noise_gate", "noise_gate", 0.85, "noise.high persistence.transient"),
    ("R2_hypoxemia_ghost", "event", LEVELS["very_high"], "spo2_risk.danger ghost.strong"),
    ("R3_autonomic_event", "event", LEVELS["high"], "hrv_suppression.severe ghost.present persistence.sustained"),
    ("R4_cardiac_critical", "event", LEVELS["very_high"], "hr_deviation.critical burden.high"),
    ("R5_ghost_trajectory", "event", LEVELS["high"], "ghost.strong trajectory.rising noise.low"),
    ("R6_transient_hr", "false_positive", 0.7, "hr_deviation.elevated persistence.transient noise.medium"),
    ("R7_persistent_moderate", "event", LEVELS["moderate"], "hr_deviation.elevated|hrv_suppression.moderate persistence.persistent noise.low"),
    ("R8_clinical_ghost", "event", LEVELS["moderate"], "burden.moderate ghost.present"),
    ("R9_all_normal", "event", LEVELS["very_low"], "hr_deviation.normal spo2_risk.safe ghost.absent"),
]


def fuzzy(rows: DataFrame) -> DataFrame:
    """Adds event_probability, false_positive_risk, noise_gate, activations (rule to strength above 0) and a summary; absent inputs are 0."""
    have = set(rows.columns)
    x = {v: F.coalesce(F.col(v), F.lit(0.0)) if v in have else F.lit(0.0) for v in (*MEMBERSHIP, "artifact")}

    def grade(name: str) -> Column:
        variable, term = name.split(".")
        points = MEMBERSHIP[variable][term]
        value = F.abs(x[variable]) if variable == "hr_deviation" or term == "stable" else x[variable]
        return triangle(value, *points) if len(points) == 3 else trapezoid(value, *points)

    least = lambda cs: F.least(*cs) if len(cs) > 1 else cs[0]
    most = lambda cs: F.greatest(*cs) if len(cs) > 1 else cs[0]
    strength = {n: least([most([grade(a) for a in part.split("|")]) for part in when.split()]) for n, _, _, when in FUZZY_RULES}
    out = rows.withColumns({f"_{n}": c for n, c in strength.items()})

    def crisp(kind: str, default: float) -> Column:
        used = [(F.when(F.col(f"_{n}") > 0.01, F.col(f"_{n}")).otherwise(0.0), v) for n, k, v, _ in FUZZY_RULES if k == kind]
        return F.coalesce(F.try_divide(reduce(lambda a, b: a + b, (s * v for s, v in used)), reduce(lambda a, b: a + b, (s for s, _ in used))), F.lit(default))

    out = out.withColumns({"_p": crisp("event", 0.1), "_f": crisp("false_positive", 0.0), "_g": crisp("noise_gate", 0.0)})
    gated = F.greatest(F.lit(0.0), F.col("_p") * (1 - F.least(F.lit(0.85), F.col("_g") * 0.5 + x["artifact"] * 0.3)))
    level = F.when(gated > 0.75, "high").when(gated > 0.5, "moderate").when(gated > 0.25, "low to moderate").otherwise("low")
    doubt = F.when(F.col("_f") > 0.6, "high").when(F.col("_f") > 0.3, "moderate").otherwise("low")
    activations = F.map_filter(F.create_map(*(p for n, kind, *_ in FUZZY_RULES if kind != "noise_gate" for p in (F.lit(n), F.col(f"_{n}")))), lambda _, v: v > 0)
    return out.select(*rows.columns, rnd(gated, 4).alias("event_probability"), rnd("_f", 4).alias("false_positive_risk"), rnd("_g", 4).alias("noise_gate"), activations.alias("activations"), F.format_string("risk %s, false positive %s", level, doubt).alias("summary"))


def top_two(values: Column) -> Column:
    """0.6 of the largest and 0.4 of the second; a single value counts whole, none is 0."""
    s = F.sort_array(F.filter(values, lambda v: v.isNotNull()), asc=False)
    return F.least(F.lit(1.0), F.when(F.size(s) >= 2, 0.6 * s[0] + 0.4 * s[1]).when(F.size(s) == 1, s[0]).otherwise(0.0))


WEIGHTS = {"wearable": 0.30, "ghost": 0.25, "clinical": 0.25, "fuzzy": 0.20}
# Event, triggers, conditions, base lead in hours.
EVENTS = [
    ("cardiovascular_event", ["autonomic_imbalance", "pulse_irregularity", "recovery_deficit"], ["hypertension", "heart_failure", "coronary_artery_disease", "atrial_fibrillation"], 48.0),
    ("respiratory_decompensation", ["hidden_hypoxemia", "hemodynamic_irregularity_proxy"], ["copd", "asthma", "sleep_apnea"], 24.0),
    ("autonomic_crisis", ["autonomic_imbalance", "stress_activity_decoupling", "circadian_desync"], ["diabetes", "autonomic_neuropathy"], 12.0),
    ("arrhythmia_event", ["pulse_irregularity", "autonomic_imbalance"], ["atrial_fibrillation", "arrhythmia"], 6.0),
]


def _fused(have: set[str]) -> tuple[Column, Column]:
    """Weighted evidence, damped below two agreeing sources and by the chance of a false positive; and the sources that agree."""
    num = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in have else F.lit(0.0)
    score = {"wearable": num("wearable"), "ghost": num("ghost"), "clinical": num("clinical") if "clinical" in have else num("prognostic"), "fuzzy": num("fuzzy")}
    total = reduce(lambda a, b: a + b, (WEIGHTS[k] * v for k, v in score.items()))
    agreeing = reduce(lambda a, b: a + b, ((v > 0.35).cast("int") for v in score.values()))
    damped = F.when(agreeing < 2, total * 0.6).otherwise(total) * (1 - 0.7 * num("fp_probability"))
    return F.least(F.lit(1.0), damped + 0.1 * num("hemodynamic")), agreeing


def fusion_score(rows: DataFrame) -> DataFrame:
    """rows with fusion_score and agreeing_sources."""
    fusion, agreeing = _fused(set(rows.columns))
    return rows.withColumns({"fusion_score": rnd(fusion, 4), "agreeing_sources": agreeing})


def fuse(rows: DataFrame, strict_reference: bool = False) -> DataFrame:
    """One row per patient and predicted event, most probable first within the patient.

    Reads wearable, ghost, clinical (or prognostic), fuzzy scores, fp_probability, conditions and,
    where present, triggers, persistence and hemodynamic. Condition keys match with underscores as
    blanks unless strict_reference is set.
    """
    have = set(rows.columns)
    num = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in have else F.lit(0.0)
    arr = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in have else F.array().cast("array<string>")
    fusion, _ = _fused(have)
    text = F.lower(F.array_join(arr("conditions"), " "))
    text = text if strict_reference else F.regexp_replace(text, "_", " ")

    def event(name: str, triggers: list[str], conditions: list[str], base: float) -> Column:
        known = F.size(F.array_intersect(arr("triggers"), F.array(*map(F.lit, triggers))))
        clinical = reduce(lambda a, b: a | b, (text.contains(c if strict_reference else c.replace("_", " ")) for c in conditions))
        p = F.col("fusion") * (0.5 + 0.5 * known / len(triggers))
        p = F.when(clinical, F.least(F.lit(1.0), p * 1.15)).otherwise(p)
        lead = base * (1 - 0.6 * p * (0.5 + 0.5 * num("persistence")))
        lead = F.greatest(F.lit(2.0), F.least(F.lit(168.0), F.when(num("ghost") > 0.5, lead * 1.8).otherwise(lead)))
        made = F.struct(F.lit(name).alias("event_type"), rnd(p, 4).alias("probability"), rnd(lead, 1).alias("lead_time_hours"))
        return F.when(((known > 0) | clinical) & (p >= 0.2), made)

    found = rows.withColumn("fusion", fusion).withColumn("events", F.array_compact(F.array(*(event(*e) for e in EVENTS))))
    fallback = F.struct(F.lit("unspecified_clinical_deterioration").alias("event_type"), rnd("fusion", 4).alias("probability"), F.lit(36.0).alias("lead_time_hours"))
    events = F.when((F.size("events") == 0) & (F.col("fusion") > 0.3), F.array(fallback)).otherwise(F.col("events"))
    order = lambda a, b: F.when(a["probability"] > b["probability"], -1).when(a["probability"] < b["probability"], 1).otherwise(0)
    out = found.select("patient_id", "fusion", F.posexplode(F.array_sort(events, order)).alias("k", "e"))
    horizon = F.when(F.col("e.lead_time_hours") < 48, "hours").otherwise("days")
    advice = F.format_string("%s: probability %.0f%%, within %.0f h", F.col("e.event_type"), F.col("e.probability") * 100, F.col("e.lead_time_hours"))
    return out.select("patient_id", rnd("fusion", 4).alias("fusion_score"), (F.col("k") + 1).alias("nth"), "e.*", horizon.alias("horizon"), advice.alias("recommendation"))


def prediction_summary(predictions: DataFrame) -> DataFrame:
    """Top prediction per patient."""
    return predictions.groupBy("patient_id").agg(F.max_by(F.struct("event_type", "probability"), F.struct("probability", -F.col("nth"))).alias("top"), F.count("*").alias("n_predictions")).select("patient_id", "top.*", "n_predictions")


# Category, prior, {signal: (low, high)} of its normal ranges.
CATEGORIES = [
    ("cardiovascular", 0.06, {"systolic_bp": (90.0, 140.0), "diastolic_bp": (60.0, 90.0)}),
    ("respiratory", 0.05, {"spo2": (95.0, 100.0)}),
    ("metabolic", 0.06, {"glucose": (70.0, 140.0)}),
    ("neurological_autonomic", 0.04, {"vagal_tone": (20.0, 80.0)}),
    ("telemedicine_digital_health", 0.02, {}),
]
SIGMA = 0.15


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function by a rational approximation of erf (error below 2e-7), within codegen."""
    x = F.abs(z) / 1.4142135623730951
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.when(z >= 0, 1 - tail / 2).otherwise(tail / 2)


def posterior(rows: DataFrame, categories=CATEGORIES, top: int = 3) -> DataFrame:
    """The top hypotheses of each row: prior times Gaussian-tail likelihoods, heart-rate variability and anomaly factors, normalised."""
    have = set(rows.columns)
    known = [(f"{name}_{signal}", signal, *of) for name, _, ranges in categories for signal, of in ranges.items() if signal in have]
    # inside a range the distance to its nearer end counts, outside the distance beyond it; one tail of the normal law for both
    inside = {key: F.col(s).between(low, high) for key, s, low, high in known}
    z = {key: F.when(inside[key], F.least(F.col(s) - low, high - F.col(s))).otherwise(F.greatest(low - F.col(s), F.col(s) - high)) / ((high - low) * SIGMA) for key, s, low, high in known}
    # one lambda for all tails: their code written out for each would be too long to compile
    rows = rows.withColumn("_tails", F.transform(F.array(*z.values()), normal_cdf) if z else F.array().cast("array<double>"))
    at = {key: F.col("_tails")[k] for k, key in enumerate(z)}
    tail = {key: F.when(F.col(s).isNull(), 1.0).when(inside[key], F.greatest(F.lit(0.05), 1 - at[key])).otherwise(F.greatest(F.lit(0.1), at[key])) for key, s, _, _ in known}

    def likelihood(name: str) -> Column:
        return reduce(lambda a, b: a * b, (c for key, c in tail.items() if key.startswith(f"{name}_")), F.lit(1.0))

    num = lambda c: F.col(c) if c in have else F.lit(None).cast("double")
    sdnn, rmssd, ratio = num("sdnn"), num("rmssd"), num("lf_hf_ratio")
    variability = {
        "cardiovascular": F.when(sdnn < 50, 1 + (50 - sdnn) / 50).when(sdnn > 100, 0.7).otherwise(1.0) * F.when(rmssd < 20, 1.3).otherwise(1.0),
        "neurological_autonomic": F.when(ratio > 2.5, 1 + (ratio - 2.5) * 0.3).when(ratio < 0.5, 1.2).otherwise(1.0) * F.when(rmssd < 15, 1.4).otherwise(1.0),
    }
    odd = F.greatest(F.lit(0.5), 1 + F.coalesce(num("anomaly"), F.lit(0.0)) * 0.25)
    factor = lambda name: F.greatest(F.lit(0.5), variability.get(name, F.lit(1.0))) * odd
    joint = F.array(*(F.struct((prior * likelihood(name) * factor(name)).alias("j"), F.lit(name).alias("category"), F.lit(prior).alias("prior")) for name, prior, _ in categories))
    scored = rows.withColumn("joint", joint).withColumn("total", F.aggregate("joint", F.lit(0.0), lambda a, x: a + x["j"]))
    ranked = scored.withColumn("best", F.slice(F.sort_array("joint", asc=False), 1, top))
    p = F.col("h.j") / F.col("total")
    severity = F.when(p > 0.7, "critical").when(p > 0.4, "elevated").when(p > 0.2, "moderate").otherwise("low")
    out = ranked.select("patient_id", F.posexplode("best").alias("k", "h"), "total")
    return out.select("patient_id", (F.col("k") + 1).alias("nth"), "h.category", rnd(p, 6).alias("posterior"), severity.alias("severity"), F.when(p > 0.6, "high").when(p > 0.3, "medium").otherwise("low").alias("confidence"))


# Signal, confidence where it is constant.
GHOSTS = {
    "autonomic_imbalance": None,
    "hidden_hypoxemia": None,
    "stress_activity_decoupling": 0.7,
    "pulse_irregularity": None,
    "recovery_deficit": 0.65,
    "circadian_desync": 0.55,
    "hemodynamic_irregularity_proxy": 0.75,
    "semantic_cardiovascular_risk": 0.6,
}


def ghost_signals(vitals: DataFrame) -> DataFrame:
    """Hidden-signal scores (patient_id, signal, value, confidence) of each patient against the own baseline.

    vitals: patient_id, window_start, heart_rate, spo2, hrv, stress and, on every row of a patient, the
    baseline resting_hr, baseline_spo2, baseline_hrv, activity_level (baselines.with_baseline); where
    present also hr_noise (at least 1 counts), hr_quality, hrv_quality, spo2_quality, hr_artifacts,
    hemodynamic and cardiovascular. A vital's points are its values that are not null, in order of time;
    "last" points are counted from their end by running counts, so one shuffle on patient serves all.
    Signals above 0.05 stay; a patient without enough points of a vital lacks its signals.
    """
    have = set(vitals.columns)
    side = lambda c, d: F.coalesce(F.max(c), F.lit(d)) if c in have else F.lit(d)
    by = W.partitionBy("patient_id").orderBy("window_start")
    back = W.partitionBy("patient_id").orderBy(F.desc("window_start"))
    r = vitals.withColumns({f"{c}_back": F.count(c).over(back.rowsBetween(W.unboundedPreceding, 0)) for c in ("heart_rate", "hrv", "stress")})
    ahead = lambda f, k: F.expr(f"{f}(heart_rate, {k}) ignore nulls over (partition by patient_id order by window_start)")
    r = r.withColumns({"k": F.count("heart_rate").over(by.rowsBetween(W.unboundedPreceding, 0)) - 1, "step": F.col("heart_rate") - ahead("lag", 1), "tenth": ahead("lead", 9)})
    hr = F.col("heart_rate")
    known = hr.isNotNull()
    tail = lambda c, n: F.when(F.col(f"{c}_back") <= n, F.col(c))
    in_tail = known & (F.col("heart_rate_back") <= 12)
    n = F.col("k") + F.col("heart_rate_back")  # of the patient's heart rates, where the row has one
    g = r.groupBy("patient_id").agg(
        *(F.max(c).alias(c) for c in ("resting_hr", "baseline_spo2", "baseline_hrv", "activity_level")),
        *(F.count(c).alias(f"n_{c}") for c in ("heart_rate", "hrv", "spo2", "stress")),
        F.avg(tail("heart_rate", 10)).alias("hr10"), F.avg(tail("hrv", 10)).alias("hrv10"), F.avg(tail("hrv", 5)).alias("hrv5"), F.avg(tail("stress", 10)).alias("stress10"),
        F.avg((F.col("spo2") < F.col("baseline_spo2") - 2).cast("double")).alias("dips"), F.percentile("spo2", 0.1).alias("p10"),
        F.regr_slope(F.when(in_tail, hr), F.when(in_tail, F.col("k").cast("double"))).alias("slope"),
        F.stddev_pop(F.when(known, F.col("step"))).alias("step_sd"), F.avg(hr).alias("hr_mean"),
        F.max(hr).alias("top"), F.max_by(F.struct("k", "tenth"), F.when(known, F.struct(hr, -F.col("k")))).alias("peak"), F.max_by(hr, F.when(known, F.col("window_start"))).alias("hr_last"),
        F.avg(F.when(known & (F.col("k") < F.floor(n / 2)), hr)).alias("first_half"), F.avg(F.when(known & (F.col("k") >= F.floor(n / 2)), hr)).alias("second_half"),
        side("hr_noise", 1.0).alias("noise"), side("hr_quality", 1.0).alias("q_hr"), side("hrv_quality", 1.0).alias("q_hrv"), side("spo2_quality", 1.0).alias("q_spo2"),
        side("hr_artifacts", 0.0).alias("artifacts"), side("hemodynamic", 0.0).alias("flow"), side("cardiovascular", 0.0).alias("domain"),
    )
    c = F.col
    zero, one = F.lit(0.0), F.lit(1.0)
    up = lambda x: F.greatest(zero, x)
    suppressed = lambda tail_mean: up((c("baseline_hrv") - tail_mean) / c("baseline_hrv"))
    both = (c("n_hrv") > 0) & (c("n_heart_rate") > 0)
    raised = up((c("hr10") - c("resting_hr")) / F.greatest(c("noise"), one)) / 3
    left = c("n_heart_rate") - c("peak.k")  # points from the peak on
    rate = (c("top") - F.coalesce("peak.tenth", "hr_last")) / F.least(F.lit(10), left)
    expected = c("resting_hr") * 0.08
    rising = (c("stress10") > 60) & (c("slope") > 0.3) & (c("activity_level") == "sedentary")
    value = {
        "autonomic_imbalance": F.when(both & (c("n_heart_rate") >= 5), 0.6 * suppressed(c("hrv10")) + 0.4 * raised),
        "hidden_hypoxemia": F.when(c("n_spo2") >= 10, 0.5 * c("dips") * 5 + 0.5 * up(c("baseline_spo2") - c("p10")) / 5),
        "stress_activity_decoupling": F.when((c("n_heart_rate") >= 5) & rising, c("stress10") / 100),
        "pulse_irregularity": F.when(c("n_heart_rate") >= 15, c("step_sd") / F.greatest(one, c("hr_mean")) * 5),
        "recovery_deficit": F.when(both & (c("n_heart_rate") >= 20) & (left > 5), 0.5 * up(1 - rate / 2) + 0.5 * suppressed(c("hrv5"))),
        "circadian_desync": F.when(c("n_heart_rate") >= 24, up((expected - (c("first_half") - c("second_half"))) / F.greatest(one, expected))),
        "hemodynamic_irregularity_proxy": c("flow"),
        "semantic_cardiovascular_risk": F.when(c("domain") > 0.3, c("domain")),
    }
    sure = {
        "autonomic_imbalance": F.least("q_hr", "q_hrv") * 0.9,
        "hidden_hypoxemia": c("q_spo2") * 0.85,
        "pulse_irregularity": c("q_hr") * (1 - c("artifacts")),
    }
    items = [F.struct(F.lit(s).alias("signal"), rnd(F.when(v.isNotNull(), F.least(one, v)), 6).alias("value"), rnd(sure.get(s, F.lit(GHOSTS[s])), 6).alias("confidence")) for s, v in value.items()]
    return g.select("patient_id", F.explode(F.array(*items)).alias("g")).select("patient_id", "g.*").where("value > 0.05")


def ghost_domains(ghosts: DataFrame) -> DataFrame:
    """Domain scores of a patient's hidden signals: capped sums of 0.3 of the values and 0.1 of the confidences."""
    capped = lambda c, name: rnd(F.least(F.lit(1.0), F.coalesce(F.sum(c), F.lit(0.0))), 6).alias(name)
    of = lambda part: F.when(F.col("signal").contains(part), F.col("value") * 0.3)
    return ghosts.groupBy("patient_id").agg(capped(of("autonomic"), "cardiovascular"), capped(of("hypoxemia"), "respiratory"), capped(F.col("confidence") * 0.1, "monitoring"))


def flow_domains(irregularities: DataFrame) -> DataFrame:
    """Domain scores of a field's irregularities: 0.25 each, 0.2 for gradients and divergences, 0.3 for vortices; 1 at most."""
    capped = lambda c, name: rnd(F.least(F.lit(1.0), F.sum(c)), 6).alias(name)
    plain = F.col("operator").isin("gradient", "divergence")
    return irregularities.groupBy("field_id").agg(
        capped(F.lit(0.25), "cardiovascular"), capped(F.when(plain, 0.2).otherwise(0.0), "monitoring"), capped(F.when(F.col("type") == "vorticity", 0.3).otherwise(0.0), "imaging")
    )


def baseline_risk(patients: DataFrame, conditions: DataFrame, medications: DataFrame, boosts: dict[str, float]) -> DataFrame:
    """risk_factor and age of each patient: 0.05 + boosts of conditions and medications whose name contains a key, 1 at most."""
    named = conditions.select("patient_id", F.lower("name").alias("name")).unionByName(medications.select("patient_id", F.lower("name").alias("name")))
    gain = reduce(lambda a, b: a + b, (F.when(F.col("name").contains(k), v).otherwise(0.0) for k, v in boosts.items()))
    added = named.groupBy("patient_id").agg(F.sum(gain).alias("gain"), F.sort_array(F.collect_set("name")).alias("names"))
    return patients.join(added, "patient_id", "left").select(*patients.columns, rnd(F.least(F.lit(1.0), 0.05 + F.coalesce("gain", F.lit(0.0))), 4).alias("risk_factor"), F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def nudges(readings: DataFrame) -> DataFrame:
    """Prevention protocols of each patient from means of heart rate, variability and stress (defaults 70, 50, 30)."""
    mean = lambda m, d: F.coalesce(F.avg(F.when(F.col("metric_type") == m, F.col("metric_value"))), F.lit(d))
    g = readings.groupBy("patient_id").agg(F.max("age").alias("age"), F.max("temp_delta").alias("dt"), mean("heart_rate", 70.0).alias("hr"), mean("hrv", 50.0).alias("hrv"), mean("stress_index", 30.0).alias("stress"))
    dry = F.expr("age >= 60 and hr > 85 and hrv < 25")
    infection = F.expr("age >= 60 and hr > 90 and stress > 65 and dt > 0.5")
    overload = F.expr("stress > 75 and hrv < 20")
    risk = F.when(infection, "CRITICO").when(overload, "MEDIO").when(dry, F.when(F.col("hr") > 95, "ALTO").otherwise("MEDIO")).otherwise("BAIXO")
    named = [("dehydration", dry, "offer 200 ml of water within two hours"), ("urinary_infection", infection, "watch for fever and confusion; collect urine"), ("overload", overload, "five minutes of guided breathing")]
    pick = lambda k: F.array_compact(F.array(*(F.when(c, F.lit(n if k == 0 else m)) for n, c, m in named)))
    messages = F.when(dry | infection | overload, pick(1)).otherwise(F.array(F.lit("stable; keep the routine")))
    return g.select("patient_id", (F.col("age") >= 60).alias("elderly"), risk.alias("risk"), pick(0).alias("protocols"), messages.alias("messages"))
