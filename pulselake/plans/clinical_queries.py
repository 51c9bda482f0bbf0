"""Queries of the clinical rules and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulselake.clinical import alerts, rules, scores
from pulselake.functions.scalar import mean
from pulselake.plans import views
from pulselake.plans.base import Registry
from pulselake.plans.views import SILVER_SQL, rnd
from pulselake.session import read_table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

#: Vital snapshots out of line items, as text that both engines read.
_SNAP = {
    "pas": "80.0 + (l_orderkey * 7 + l_linenumber * 13) % 120", "pad": "50.0 + (l_orderkey * 5 + l_linenumber) % 75", "hr": "35.0 + l_partkey % 110", "spo2": "88.0 + (l_suppkey + l_linenumber) % 13",
    "temp_c": "34.5 + (l_orderkey % 60) / 10.0", "glucose_mgdl": "40.0 + (l_partkey * 3) % 600", "steps_drop_pct": "(l_orderkey % 61) * 1.0", "sleep_worsen_pct": "(l_partkey % 47) * 1.0", "hr_baseline_rise": "l_linenumber * 4.0", "spo2_drop_points": "(l_suppkey % 6) * 1.0",
}
_SNAP_COLUMNS = ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _SNAP.items())
_SOURCES = "CASE WHEN l_orderkey % 3 = 0 THEN 'phantom' WHEN l_orderkey % 3 = 1 THEN 'measured' ELSE 'unknown' END AS bp_source, CASE WHEN l_partkey % 2 = 0 THEN 'phantom' ELSE 'unknown' END AS glucose_source"
SNAP_SQL = f"snap AS (SELECT l_orderkey, l_linenumber, {_SNAP_COLUMNS}, l_returnflag = 'R' AND l_linenumber = 1 AS consciousness_altered, {_SOURCES} FROM lineitem)"


def snapshots(spark, sf_dir):
    """Line items as vital snapshots."""
    return read_table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", *(f"cast({e} as double) as {c}" for c, e in _SNAP.items()), "l_returnflag = 'R' and l_linenumber = 1 as consciousness_altered", *_split_sources())


def _split_sources():
    first, second = _SOURCES.split(" AS bp_source, ")
    return f"{first} as bp_source", second


_HITS = "list_filter([" + ", ".join(f"CASE WHEN {p} THEN {{'rank': {rules.SEVERITY[s]}, 'before': {-k}, 'rule': '{r}', 'severity': '{s}'}} END" for k, (r, _, s, p) in enumerate(rules.RULES)) + "], lambda x: x IS NOT NULL)"
MATRIX_SQL = f"""{SNAP_SQL}, hit AS (SELECT *, {_HITS} AS hits FROM snap),
mat AS (SELECT *, coalesce(list_max(hits).severity, 'none') AS severity, list_max(hits).rule AS primary_rule, len(hits) > 0 AS is_true_alert, len(hits) = 0 AND coalesce({rules.BORDERLINE}, false) AS fp_candidate, list_transform(hits, lambda h: h.rule) AS ids FROM hit)"""


@query("alert_matrix", f"WITH {MATRIX_SQL} SELECT l_orderkey, l_linenumber, severity, primary_rule, is_true_alert, fp_candidate, array_to_string(ids, ',') AS rules FROM mat")
def alert_matrix(spark, sf_dir):
    m = rules.evaluate(snapshots(spark, sf_dir))
    return m.select("l_orderkey", "l_linenumber", "severity", "primary_rule", "is_true_alert", "fp_candidate", F.array_join(F.col("hits.rule"), ",").alias("rules"))


@query("rule_hit_counts", f"WITH {MATRIX_SQL} SELECT h.rule AS rule, h.severity AS severity, count(*) AS n FROM (SELECT unnest(hits) AS h FROM mat) GROUP BY 1, 2")
def rule_hit_counts(spark, sf_dir):
    return rules.hit_counts(snapshots(spark, sf_dir))


@query("snapshot_features", f"WITH {SNAP_SQL} SELECT l_orderkey, l_linenumber, pas, pad, hr, (pas + 2 * pad) / 3 AS map_approx, pas - pad AS pulse_pressure, CASE WHEN consciousness_altered THEN 1.0 ELSE 0.0 END::DOUBLE AS consciousness_altered FROM snap")
def snapshot_features(spark, sf_dir):
    return rules.features(snapshots(spark, sf_dir)).select("l_orderkey", "l_linenumber", "pas", "pad", "hr", "map_approx", "pulse_pressure", "consciousness_altered")


_CORE = "(coalesce(hr BETWEEN 55 AND 95, false) AND spo2 >= 96 AND temp_c BETWEEN 35.5 AND 37.4 AND pas >= 95 AND pas < 160 AND pad >= 55 AND pad < 100)"
_ANY = lambda p: f"len(list_filter(ids, lambda r: {p})) > 0"
_TESTS = [
    ("tachycardia_not_in_sample", f"{_ANY("r IN ('pa_elev_2', 'pa_elev_3')")} AND hr < 111", 0.15),
    ("estimated_pressure_stable_sample", f"{_ANY("starts_with(r, 'pa_elev_')")} AND bp_source = 'phantom' AND hr <= 95 AND {_CORE}", 0.1),
    ("crisis_below_limits", f"{_ANY("r IN ('pa_elev_3', 'pa_elev_4', 'pa_elev_5', 'pa_elev_6')")} AND NOT (pas >= 180 AND pad >= 110) AND hr < 111", 0.12),
    ("stable_sample_against_crisis", f"{_ANY("r IN ('pa_elev_2', 'pa_elev_3')")} AND hr BETWEEN 70 AND 95 AND {_CORE}", 0.1),
    ("estimated_glucose_stable_sample", f"{_ANY("starts_with(r, 'hyper_')")} AND glucose_source = 'phantom' AND hr < 111 AND {_CORE}", 0.15),
    ("mild_estimated_glucose", f"{_ANY("starts_with(r, 'hyper_')")} AND glucose_source = 'phantom' AND glucose_mgdl >= 181 AND glucose_mgdl < 250 AND {_CORE}", 0.2),
    ("estimated_low_glucose", f"{_ANY("starts_with(r, 'hypo_')")} AND glucose_source = 'phantom' AND hr BETWEEN 60 AND 100 AND {_CORE}", 0.2),
    ("critical_metabolic_stable_sample", f"len(list_filter(hits, lambda h: h.severity = 'critico')) > 0 AND {_CORE} AND len(list_filter(hits, lambda h: h.severity = 'critico' AND NOT (starts_with(h.rule, 'pa_elev_') OR starts_with(h.rule, 'hyper_') OR starts_with(h.rule, 'hypo_')))) = 0 AND (bp_source = 'phantom' OR glucose_source = 'phantom')", 0.1),
    ("unmeasured_quiet_sample", f"hr BETWEEN 70 AND 92 AND temp_c BETWEEN 36.0 AND 37.2 AND spo2 >= 96 AND steps_drop_pct < 25 AND sleep_worsen_pct < 25 AND ({_ANY("starts_with(r, 'pa_elev_')")} OR {_ANY("starts_with(r, 'hyper_')")}) AND bp_source <> 'measured' AND glucose_source <> 'measured'", 0.08),
]
_REASONS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t, _ in _TESTS) + "], lambda x: x IS NOT NULL), ',')"
_PENALTY = "greatest(0.05, least(1.0, " + " * ".join(f"CASE WHEN {t} THEN {p}::DOUBLE ELSE 1.0::DOUBLE END" for _, t, p in _TESTS) + "))::DOUBLE"
DECIDED_SQL = f"{MATRIX_SQL}, dis AS (SELECT *, {_REASONS} AS reasons, {_PENALTY} AS penalty FROM mat)"


@query("discrepancy", f"WITH {DECIDED_SQL} SELECT l_orderkey, l_linenumber, reasons, {rnd('penalty', 6)} AS penalty FROM dis")
def discrepancy(spark, sf_dir):
    from pulselake.functions.scalar import rnd as round_

    d = alerts.discrepancy(rules.evaluate(snapshots(spark, sf_dir)))
    return d.select("l_orderkey", "l_linenumber", F.array_join("reasons", ",").alias("reasons"), round_("penalty", 6).alias("penalty"))


@query("alert_decision", f"""WITH {DECIDED_SQL} SELECT l_orderkey, l_linenumber, is_true_alert AND reasons = '' AS alert, (is_true_alert AND reasons <> '') OR (NOT is_true_alert AND fp_candidate) AS false_positive,
 CASE WHEN is_true_alert AND reasons <> '' THEN 'none' ELSE severity END AS final_severity, {rnd("CASE WHEN is_true_alert AND reasons <> '' THEN greatest(0.05, 0.9::DOUBLE * penalty) WHEN is_true_alert THEN 0.9 ELSE 0.7 END", 4)} AS confidence,
 CASE WHEN is_true_alert AND reasons <> '' THEN 'suppressed_sample_discrepancy' WHEN is_true_alert THEN 'rule_only' WHEN fp_candidate THEN 'suppressed_false_positive' ELSE 'stable_or_noise' END AS decision FROM dis""")
def alert_decision(spark, sf_dir):
    return alerts.decide(snapshots(spark, sf_dir)).select("l_orderkey", "l_linenumber", "alert", "false_positive", "final_severity", "confidence", "decision")


@query("alert_decision_ml", f"""WITH {DECIDED_SQL}, p AS (SELECT *, (l_partkey % 101) / 100.0::DOUBLE AS fp, (l_suppkey % 101) / 100.0::DOUBLE AS al FROM dis JOIN (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) USING (l_orderkey, l_linenumber)),
 q AS (SELECT *, fp < 0.25 AND al >= 0.8 AS soft FROM p) SELECT l_orderkey, l_linenumber, (is_true_alert OR soft) AND reasons = '' AS alert,
 CASE WHEN (is_true_alert OR soft) AND reasons <> '' THEN 'suppressed_sample_discrepancy' WHEN is_true_alert THEN CASE WHEN fp > 0.85 AND al < 0.25 THEN 'rule_match_low_ml_confidence' ELSE 'rule_match' END WHEN fp >= 0.55 OR (NOT soft AND (fp >= 0.35 OR fp_candidate)) THEN 'suppressed_false_positive' WHEN soft THEN 'ml_soft_alert_no_rule' ELSE 'stable_or_noise' END AS decision FROM q""")
def alert_decision_ml(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "(l_partkey % 101) / 100.0d as ml_fp_prob", "(l_suppkey % 101) / 100.0d as ml_alert_prob", "'critico' as ml_severity")
    return alerts.decide(snapshots(spark, sf_dir).join(li, ["l_orderkey", "l_linenumber"]), ml=True).select("l_orderkey", "l_linenumber", "alert", "decision")


@query("frame_estimates", f"""WITH {SNAP_SQL} SELECT l_orderkey, l_linenumber, {rnd('70 + 0.3::DOUBLE * (hr - 70) + 2 * (temp_c - 33)', 1)} AS map_mmhg, {rnd('95 + 0.2::DOUBLE * greatest(0.0, steps_drop_pct - 30)', 1)} AS glucose_est, {rnd('least(1.0, greatest(0.0, sleep_worsen_pct / 80))', 3)} AS vagal_tone,
 {rnd('70 + 0.3::DOUBLE * (hr - 70) + 2 * (temp_c - 33) + 13.3::DOUBLE', 1)} AS sbp_est, {rnd('70 + 0.3::DOUBLE * (hr - 70) + 2 * (temp_c - 33) - 6.7::DOUBLE', 1)} AS dbp_est, hr > 100 OR hr < 40 OR spo2 < 92 AS local_alert FROM snap""")
def frame_estimates(spark, sf_dir):
    e = alerts.frame_estimates(F.col("hr"), F.col("temp_c"), F.col("sleep_worsen_pct"), F.col("spo2"), F.col("steps_drop_pct"))
    return snapshots(spark, sf_dir).select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in e.items()))


@query("online_rule_score", f"""WITH {SILVER_SQL}, v AS (SELECT patient_id, window_start, avg(metric_value) FILTER (metric_type = 'heart_rate') AS hr, avg(metric_value) FILTER (metric_type = 'spo2') AS sp, min(activity_context) AS act, min(sleep_context) AS slp FROM silver GROUP BY 1, 2),
 t AS (SELECT *, CASE WHEN act = 'active' THEN 160.0 WHEN slp IN ('deep_sleep', 'light_sleep') THEN 90.0 ELSE 120.0 END AS hi, CASE WHEN act <> 'active' AND slp IN ('deep_sleep', 'light_sleep') THEN 40.0 ELSE 45.0 END AS lo FROM v),
 s AS (SELECT *, greatest(CASE WHEN hr > hi THEN least(1.0, 0.5 + (hr - hi) / 100) WHEN hr < lo THEN least(1.0, 0.5 + (lo - hr) / 100) ELSE 0.0 END, CASE WHEN sp < 92 THEN least(1.0, 0.5 + (92 - sp) / 20) ELSE 0.0 END)::DOUBLE AS b FROM t)
 SELECT patient_id, window_start, {rnd('b', 4)} AS rule_score, b >= 0.5 AS rule_anomaly FROM s""", times=["window_start"])
def online_rule_score(spark, sf_dir):
    s = views.silver(spark, sf_dir).groupBy("patient_id", "window_start").agg(F.avg(F.when(F.col("metric_type") == "heart_rate", F.col("metric_value"))).alias("hr"), F.avg(F.when(F.col("metric_type") == "spo2", F.col("metric_value"))).alias("sp"), F.min("activity_context").alias("act"), F.min("sleep_context").alias("slp"))
    return s.select("patient_id", "window_start", *(c.alias(n) for n, c in alerts.contextual_score(F.col("hr"), F.col("sp"), F.col("act"), F.col("slp")).items()))


@query("prevention_nudges", f"""WITH {views.BRONZE_SQL}, m AS (SELECT patient_id, 40 + CAST(substr(patient_id, 5) AS INTEGER) % 50 AS age, coalesce(avg(metric_value) FILTER (metric_type = 'heart_rate'), 70) AS hr, coalesce(avg(metric_value) FILTER (metric_type = 'hrv'), 50) AS hrv, coalesce(avg(metric_value) FILTER (metric_type = 'stress_index'), 30) AS st, (CAST(substr(patient_id, 5) AS INTEGER) % 10) / 10.0::DOUBLE AS dt FROM bronze GROUP BY 1),
 f AS (SELECT *, age >= 60 AND hr > 85 AND hrv < 25 AS p1, age >= 60 AND hr > 90 AND st > 65 AND dt > 0.5 AS p2, st > 75 AND hrv < 20 AS p3 FROM m)
 SELECT patient_id, age >= 60 AS elderly, CASE WHEN p2 THEN 'CRITICO' WHEN p3 THEN 'MEDIO' WHEN p1 AND hr > 95 THEN 'ALTO' WHEN p1 THEN 'MEDIO' ELSE 'BAIXO' END AS risk, array_to_string(list_filter([CASE WHEN p1 THEN 'dehydration' END, CASE WHEN p2 THEN 'urinary_infection' END, CASE WHEN p3 THEN 'overload' END], lambda x: x IS NOT NULL), ',') AS protocols FROM f""")
def prevention_nudges(spark, sf_dir):
    b = views.bronze(spark, sf_dir).withColumn("pid", F.substring("patient_id", 5, 20).cast("int")).withColumn("age", 40 + F.col("pid") % 50).withColumn("temp_delta", F.col("pid") % 10 / 10.0)
    return scores.nudges(b).drop("messages")


@query("fuzzy_membership", f"""WITH {SNAP_SQL} SELECT l_orderkey, l_linenumber, {rnd('greatest(0.0, CASE WHEN hr <= 60 OR hr >= 120 THEN 0 WHEN hr <= 90 THEN (hr - 60) / 30 ELSE (120 - hr) / 30 END)', 6)} AS tri, {rnd('CASE WHEN spo2 <= 88 OR spo2 >= 100 THEN 0 WHEN spo2 < 92 THEN (spo2 - 88) / 4 WHEN spo2 <= 96 THEN 1 ELSE (100 - spo2) / 4 END', 6)} AS trap FROM snap""")
def fuzzy_membership(spark, sf_dir):
    from pulselake.functions.scalar import rnd as round_

    return snapshots(spark, sf_dir).select("l_orderkey", "l_linenumber", round_(scores.triangle(F.col("hr"), 60, 90, 120), 6).alias("tri"), round_(scores.trapezoid(F.col("spo2"), 88, 92, 96, 100), 6).alias("trap"))


def _grade_sql(name: str) -> str:
    """Membership of a term over columns of the variables' names; variables without a column are 0."""
    variable, term = name.split(".")
    points = scores.MEMBERSHIP[variable][term]
    if variable not in _FUZZY_INPUTS:
        return "0.0"  # every term starts above 0
    a, b, *_, d = points
    c = points[-2] if len(points) == 4 else b
    up = f"({variable} - {a}) / {float(b - a)}" if b > a else "1"
    return f"CASE WHEN {variable} <= {a} OR {variable} >= {d} THEN 0 WHEN {variable} < {b} THEN {up} WHEN {variable} <= {c} THEN 1 ELSE ({d} - {variable}) / {float(d - c)} END"


_FUZZY_INPUTS = {"hr_deviation": "abs(hr - 70) / 75", "spo2_risk": "(100 - spo2) / 12", "persistence": "steps_drop_pct / 61", "ghost": "sleep_worsen_pct / 47", "artifact": "spo2_drop_points / 10"}
_STRENGTH = {
    n: "least(" + ", ".join("greatest(" + ", ".join(_grade_sql(a) for a in part.split("|")) + ")" for part in when.split()) + ")::DOUBLE AS " + n
    for n, _, _, when in scores.FUZZY_RULES
}


def _crisp_sql(kind: str, default: float) -> str:
    used = [(n, v) for n, k, v, _ in scores.FUZZY_RULES if k == kind]
    on = lambda n: f"CASE WHEN {n} > 0.01 THEN {n} ELSE 0 END"
    return f"coalesce(({' + '.join(f'({on(n)}) * {v}::DOUBLE' for n, v in used)}) / nullif({' + '.join(on(n) for n, _ in used)}, 0), {default}::DOUBLE)"


_FUZZY_SQL = f"""WITH {SNAP_SQL}, i AS (SELECT l_orderkey, l_linenumber, {', '.join(f'({e})::DOUBLE AS {c}' for c, e in _FUZZY_INPUTS.items())} FROM snap),
 r AS (SELECT *, {', '.join(_STRENGTH.values())} FROM i),
 c AS (SELECT *, {_crisp_sql('event', 0.1)} AS p, {_crisp_sql('false_positive', 0.0)} AS f, {_crisp_sql('noise_gate', 0.0)} AS g FROM r),
 o AS (SELECT *, greatest(0, p * (1 - least(0.85::DOUBLE, g * 0.5 + artifact * 0.3::DOUBLE))) AS gated FROM c)
 SELECT l_orderkey, l_linenumber, {', '.join(_FUZZY_INPUTS)}, {rnd('gated', 4)} AS event_probability, {rnd('f', 4)} AS false_positive_risk, {rnd('g', 4)} AS noise_gate,
  'risk ' || CASE WHEN gated > 0.75 THEN 'high' WHEN gated > 0.5 THEN 'moderate' WHEN gated > 0.25 THEN 'low to moderate' ELSE 'low' END
   || ', false positive ' || CASE WHEN f > 0.6 THEN 'high' WHEN f > 0.3 THEN 'moderate' ELSE 'low' END AS summary,
  array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN {n} > 0 THEN '{n}' END" for n, k, *_ in scores.FUZZY_RULES if k != 'noise_gate')}], lambda x: x IS NOT NULL)), ',') AS rules FROM o"""


@query("fuzzy_assessment", _FUZZY_SQL)
def fuzzy_assessment(spark, sf_dir):
    s = snapshots(spark, sf_dir)
    given = s.select("l_orderkey", "l_linenumber", (F.abs(F.col("hr") - 70) / 75).alias("hr_deviation"), ((100 - F.col("spo2")) / 12).alias("spo2_risk"), (F.col("steps_drop_pct") / 61).alias("persistence"), (F.col("sleep_worsen_pct") / 47).alias("ghost"), (F.col("spo2_drop_points") / 10).alias("artifact"))
    return scores.fuzzy(given).withColumn("rules", F.array_join(F.array_sort(F.map_keys("activations")), ",")).drop("activations")


@query("evidence_top_two", f"WITH {SNAP_SQL}, v AS (SELECT l_orderkey, l_linenumber, list_reverse_sort([hr / 145 * 0.9::DOUBLE, (100 - spo2) / 12 * 0.8::DOUBLE, steps_drop_pct / 61 * 0.7::DOUBLE]) AS a FROM snap) SELECT l_orderkey, l_linenumber, {rnd('0.6::DOUBLE * a[1] + 0.4::DOUBLE * a[2]', 6)} AS score FROM v")
def evidence_top_two(spark, sf_dir):
    from pulselake.functions.scalar import rnd as round_

    values = F.array(F.col("hr") / 145 * 0.9, (100 - F.col("spo2")) / 12 * 0.8, F.col("steps_drop_pct") / 61 * 0.7)
    return snapshots(spark, sf_dir).select("l_orderkey", "l_linenumber", round_(scores.top_two(values), 6).alias("score"))


def _share_sql(metric: str, low: float, high: float) -> str:
    return f"least(1, greatest(0, (avg(metric_value) FILTER (metric_type = '{metric}') - {low}) / ({high - low})))::DOUBLE"


EVENTS_SQL = f"""{SILVER_SQL}, e AS (SELECT patient_id, {_share_sql('heart_rate', 60, 140)} AS wearable, 1 - {_share_sql('spo2', 88, 99)} AS prognostic, {_share_sql('stress_index', 0, 90)} AS fuzzy,
   {_share_sql('hrv', 150, 0)} AS ghost, avg(anomaly_score) AS fp, max(anomaly_score) > 0.5 AS heart FROM silver GROUP BY 1),
 t AS (SELECT *, 0.3::DOUBLE * wearable + 0.25::DOUBLE * ghost + 0.25::DOUBLE * prognostic + 0.2::DOUBLE * fuzzy AS total,
   (wearable > 0.35)::INTEGER + (prognostic > 0.35)::INTEGER + (fuzzy > 0.35)::INTEGER + (ghost > 0.35)::INTEGER AS agreeing FROM e),
 f AS (SELECT *, least(1, CASE WHEN agreeing < 2 THEN total * 0.6::DOUBLE ELSE total END * (1 - 0.7::DOUBLE * fp)) AS fusion FROM t),
 p AS (SELECT *, least(1, fusion * 0.5 * 1.15::DOUBLE) AS p FROM f),
 d AS (SELECT *, CASE WHEN p >= 0.2 THEN CASE WHEN heart THEN 'cardiovascular_event' ELSE 'respiratory_decompensation' END WHEN fusion > 0.3 THEN 'unspecified_clinical_deterioration' END AS event_type,
   (CASE WHEN heart THEN 48 ELSE 24 END) * (1 - 0.6::DOUBLE * p * 0.5) * CASE WHEN ghost > 0.5 THEN 1.8::DOUBLE ELSE 1 END AS lead FROM p),
 events AS (SELECT patient_id, {rnd('fusion', 4)} AS fusion_score, 1 AS nth, event_type, {rnd('CASE WHEN p >= 0.2 THEN p ELSE fusion END', 4)} AS probability,
   CASE WHEN p >= 0.2 THEN {rnd('greatest(2, least(168, lead))', 1)} ELSE 36.0 END AS lead_time_hours FROM d WHERE event_type IS NOT NULL)"""


@query("event_predictions", f"WITH {EVENTS_SQL} SELECT *, CASE WHEN lead_time_hours < 48 THEN 'hours' ELSE 'days' END AS horizon FROM events")
def event_predictions(spark, sf_dir):
    return scores.fuse(patient_evidence(spark, sf_dir)).drop("recommendation")


def patient_evidence(spark, sf_dir):
    """Scores of each patient in 0 to 1, out of silver.

    Its values have two decimals, so a mean at a limit does not hang on the order of the rows.
    """
    s = views.silver(spark, sf_dir)
    risk = lambda m, lo, hi: F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (mean(F.when(F.col("metric_type") == m, F.col("metric_value")), 2) - lo) / (hi - lo))), F.lit(0.0))
    return s.groupBy("patient_id").agg(risk("heart_rate", 60.0, 140.0).alias("wearable"), (1 - risk("spo2", 88.0, 99.0)).alias("prognostic"), risk("stress_index", 0.0, 90.0).alias("fuzzy"), risk("hrv", 150.0, 0.0).alias("ghost"), F.avg("anomaly_score").alias("fp_probability"), F.array(F.when(F.max("anomaly_score") > 0.5, F.lit("heart failure")).otherwise(F.lit("asthma"))).alias("conditions"))


def _cdf_sql(z: str) -> str:
    x = f"(abs({z}) / 1.4142135623730951::DOUBLE)"
    t = f"(1 / (1 + 0.3275911::DOUBLE * {x}))"
    poly = f"{t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE))))"
    return f"(CASE WHEN {z} >= 0 THEN 1 - {poly} * exp(-{x} * {x}) / 2 ELSE {poly} * exp(-{x} * {x}) / 2 END)"


_BAYES_COLUMNS = {"systolic_bp": "pas", "diastolic_bp": "pad", "spo2": "spo2", "glucose": "glucose_mgdl", "vagal_tone": "sleep_worsen_pct"}
_BAYES_FACTORS = {"cardiovascular": "CASE WHEN steps_drop_pct < 20 THEN 1.3::DOUBLE ELSE 1 END", "neurological_autonomic": "CASE WHEN steps_drop_pct < 15 THEN 1.4::DOUBLE ELSE 1 END"}


def _joint_sql(name: str, prior: float, ranges: dict) -> str:
    parts = [f"{prior}::DOUBLE", _BAYES_FACTORS.get(name, "1"), "greatest(0.5, 1 + spo2_drop_points / 6 * 0.25)"]
    for signal, (low, high) in ranges.items():
        v, sigma = _BAYES_COLUMNS[signal], f"{(high - low) * scores.SIGMA}::DOUBLE"
        inside = f"greatest(0.05::DOUBLE, 1 - {_cdf_sql(f'(least({v} - {low}, {high} - {v}) / {sigma})')})"
        outside = f"greatest(0.1::DOUBLE, {_cdf_sql(f'(greatest({low} - {v}, {v} - {high}) / {sigma})')})"
        parts.append(f"(CASE WHEN {v} BETWEEN {low} AND {high} THEN {inside} ELSE {outside} END)")
    return f"{{'j': {' * '.join(parts)}, 'category': '{name}'}}"


_BAYES_SQL = f"""WITH {SNAP_SQL}, j AS (SELECT l_orderkey || '-' || l_linenumber AS patient_id, [{', '.join(_joint_sql(*c) for c in scores.CATEGORIES)}] AS joint FROM snap),
 b AS (SELECT patient_id, list_reverse_sort(joint) AS best, list_sum(list_transform(joint, lambda x: x.j)) AS total FROM j),
 h AS (SELECT patient_id, nth, best[nth].category AS category, best[nth].j / total AS p FROM b, (SELECT unnest([1, 2, 3]) AS nth))
 SELECT patient_id, nth, category, {rnd('p', 6)} AS posterior, CASE WHEN p > 0.7 THEN 'critical' WHEN p > 0.4 THEN 'elevated' WHEN p > 0.2 THEN 'moderate' ELSE 'low' END AS severity,
  CASE WHEN p > 0.6 THEN 'high' WHEN p > 0.3 THEN 'medium' ELSE 'low' END AS confidence FROM h"""


@query("bayes_hypotheses", _BAYES_SQL)
def bayes_hypotheses(spark, sf_dir):
    s = snapshots(spark, sf_dir).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("patient_id"), F.col("pas").alias("systolic_bp"), F.col("pad").alias("diastolic_bp"), F.col("glucose_mgdl").alias("glucose"), "spo2", F.col("sleep_worsen_pct").alias("vagal_tone"), F.col("steps_drop_pct").alias("rmssd"), (F.col("spo2_drop_points") / 6).alias("anomaly"))
    return scores.posterior(s)
