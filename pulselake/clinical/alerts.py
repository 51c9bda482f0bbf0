"""Snapshot assembly, sample-against-alert discrepancy, decision and merge with local anomalies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.clinical.rules import evaluate, stable_core
from pulselake.functions.scalar import clip, lookup, rnd


def assemble(readings: DataFrame) -> DataFrame:
    """Vital snapshot of wide readings with estimates.

    Measured pressures and glucose beat estimates (est_<name>, est_<name>_reliable); only reliable
    estimates count; mean pressure stands in for both. Absent estimate columns are null.
    """
    have = set(readings.columns)
    col = lambda c, kind="double": F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    trusted = lambda c: F.when(F.coalesce(col(f"est_{c}_reliable", "boolean"), F.lit(True)), col(f"est_{c}"))
    pas_m, pad_m = F.nullif(col("blood_pressure_sys"), F.lit(0.0)), F.nullif(col("blood_pressure_dia"), F.lit(0.0))
    measured = pas_m.isNotNull() | pad_m.isNotNull()
    est = trusted("sbp").isNotNull() | trusted("dbp").isNotNull()
    mean = trusted("map")
    glucose_m, glucose_e = F.nullif(col("glucose_mgdl"), F.lit(0.0)), trusted("glucose")
    skin = col("skin_temp")
    source = lambda m, e: F.when(m, "measured").when(e, "phantom").otherwise("unknown")
    return readings.withColumns(
        {
            "pas": F.when(measured, pas_m).when(est, trusted("sbp")).otherwise(mean + 13.3),
            "pad": F.when(measured, pad_m).when(est, trusted("dbp")).otherwise(mean - 6.7),
            "hr": col("heart_rate"),
            "spo2": col("spo2"),
            "temp_c": F.when((skin >= 25) & (skin < 35), F.coalesce(col("body_temp_c"), skin)).otherwise(skin),
            "glucose_mgdl": F.coalesce(glucose_m, glucose_e),
            "steps_drop_pct": F.coalesce(col("steps_drop_pct"), F.lit(5.0)),
            "sleep_worsen_pct": F.coalesce(col("sleep_worsen_pct"), F.lit(5.0)),
            "hr_baseline_rise": F.coalesce(col("hr_baseline_rise"), F.when(col("activity_level") > 40, F.least(F.lit(25.0), col("activity_level") * 0.2))),
            "spo2_drop_points": col("spo2_drop_points"),
            "consciousness_altered": F.coalesce(col("consciousness_altered", "boolean"), F.lit(False)),
            "bp_source": source(measured, est | mean.isNotNull()),
            "glucose_source": source(glucose_m.isNotNull(), glucose_e.isNotNull()),
        }
    )


def discrepancy(evaluated: DataFrame) -> DataFrame:
    """Adds reasons, suppress and penalty: nine tests of the alert against the sample, each with a factor.

    bp_reliable and glucose_reliable default to true, sources to unknown, when the columns are absent.
    """
    have = set(evaluated.columns)
    flag = lambda c: F.coalesce(F.col(c), F.lit(True)) if c in have else F.lit(True)
    src = lambda c: F.coalesce(F.col(c), F.lit("unknown")) if c in have else F.lit("unknown")
    listed = lambda hits: F.concat(F.lit(","), F.array_join(F.col(f"{hits}.rule"), ","), F.lit(","))
    # each is a column of its own, named often but computed once
    named = evaluated.withColumns({"_rules": listed("hits"), "_severe": F.filter("hits", lambda h: h["severity"] == "critico"), "_core": stable_core()})
    mild = F.regexp_count(listed("_severe"), F.lit(",(?:pa_elev_|hyper_|hypo_)"))
    named = named.withColumn("_metabolic", (F.size("_severe") > 0) & (mild == F.size("_severe")))
    any_rule = lambda *ids: reduce(lambda a, b: a | b, (F.col("_rules").contains(f",{r},") for r in ids))
    prefix = lambda p: F.col("_rules").contains(f",{p}")
    e, core, metabolic = F.expr, F.col("_core"), F.col("_metabolic")
    high, sugar, low_sugar = prefix("pa_elev_"), prefix("hyper_"), prefix("hypo_")
    bp_guess, glucose_guess = (src("bp_source") == "phantom") | ~flag("bp_reliable"), (src("glucose_source") == "phantom") | ~flag("glucose_reliable")
    quiet = e("hr between 70 and 92 and (temp_c is null or temp_c between 36.0 and 37.2) and (spo2 is null or spo2 >= 96) and (steps_drop_pct is null or steps_drop_pct < 25) and (sleep_worsen_pct is null or sleep_worsen_pct < 25)")
    tests = [
        ("tachycardia_not_in_sample", any_rule("pa_elev_2", "pa_elev_3") & e("hr < 111"), 0.15),
        ("estimated_pressure_stable_sample", high & bp_guess & e("hr <= 95") & core, 0.1),
        ("crisis_below_limits", any_rule("pa_elev_3", "pa_elev_4", "pa_elev_5", "pa_elev_6") & ~F.coalesce(e("pas >= 180 and pad >= 110"), F.lit(False)) & e("hr < 111"), 0.12),
        ("stable_sample_against_crisis", any_rule("pa_elev_2", "pa_elev_3") & e("hr between 70 and 95") & core, 0.1),
        ("estimated_glucose_stable_sample", sugar & glucose_guess & core & e("hr < 111"), 0.15),
        ("mild_estimated_glucose", sugar & glucose_guess & core & e("glucose_mgdl >= 181 and glucose_mgdl < 250"), 0.2),
        ("estimated_low_glucose", low_sugar & glucose_guess & core & e("hr between 60 and 100"), 0.2),
        ("critical_metabolic_stable_sample", core & metabolic & (bp_guess | glucose_guess), 0.1),
        ("unmeasured_quiet_sample", quiet & (high | sugar) & (src("bp_source") != "measured") & (src("glucose_source") != "measured"), 0.08),
    ]
    named = named.withColumn("_held", F.array(*(F.coalesce(t, F.lit(False)) for _, t, _ in tests)))
    held = [(n, F.col("_held")[k], p) for k, (n, _, p) in enumerate(tests)]
    penalty = reduce(lambda a, b: a * b, (F.when(t, p).otherwise(1.0) for _, t, p in held))
    reasons = F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t, _ in held)))
    found = {"reasons": reasons, "suppress": F.array_contains("_held", True), "penalty": F.greatest(F.lit(0.05), F.least(F.lit(1.0), penalty))}
    return named.select(*(c for c in evaluated.columns if c not in found), *(c.alias(n) for n, c in found.items()))


def discrepancy_features(bp_source: Column, glucose_source: Column) -> dict[str, Column]:
    """Flags for a classifier."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        "disc_stable_core": one(stable_core()),
        "disc_hr_mid_stable": one(F.col("hr").between(70, 95)),
        "disc_bp_phantom": one(bp_source == "phantom"),
        "disc_glucose_phantom": one(glucose_source == "phantom"),
        "disc_ui_fp_pattern": one(F.expr("hr between 70 and 92 and (temp_c is null or temp_c between 36.0 and 37.2) and (spo2 is null or spo2 >= 96)")),
    }


def decide(snapshots: DataFrame, ml: bool = False) -> DataFrame:
    """Rules, with ml also the columns ml_fp_prob, ml_alert_prob, ml_severity, then the discrepancy gate.

    Adds alert, false_positive, final_severity, confidence and decision.
    """
    d = discrepancy(evaluate(snapshots))
    hit, candidate = F.col("is_true_alert"), F.col("fp_candidate")
    if not ml:
        first = {"alert": hit, "fp": ~hit & candidate, "sev": F.col("severity"), "conf": F.when(hit, 0.9).otherwise(0.7), "dec": F.when(hit, "rule_only").when(candidate, "suppressed_false_positive").otherwise("stable_or_noise")}
    else:
        fp, alert, sev = F.col("ml_fp_prob"), F.col("ml_alert_prob"), F.col("ml_severity")
        doubtful = (fp > 0.85) & (alert < 0.25)
        soft = (fp < 0.55) & (alert >= 0.8) & (fp < 0.25) & sev.isin("leve", "moderado", "critico")
        sure = F.greatest(F.lit(0.55), 0.55 * alert + 0.45 * (1 - fp))
        noise = (fp >= 0.35) | candidate
        first = {
            "alert": hit | soft,
            "fp": ~hit & ((fp >= 0.55) | (~soft & noise)),
            "sev": F.when(hit, F.col("severity")).when(soft, F.when(sev == "critico", "moderado").otherwise(sev)).otherwise("none"),
            "conf": F.when(hit, F.when(doubtful, sure * 0.7).otherwise(sure)).when(fp >= 0.55, F.greatest(fp, 1 - alert)).when(soft, alert * 0.5).otherwise(F.greatest(1 - alert, fp, F.lit(0.6))),
            "dec": F.when(hit, F.when(doubtful, "rule_match_low_ml_confidence").otherwise("rule_match")).when((fp >= 0.55) | (~soft & noise), "suppressed_false_positive").when(soft, "ml_soft_alert_no_rule").otherwise("stable_or_noise"),
        }
    named = d.withColumns({f"_{k}": v for k, v in first.items()})
    gone = F.col("_alert") & F.col("suppress")
    return named.withColumns(
        {
            "alert": F.col("_alert") & ~gone,
            "false_positive": gone | F.col("_fp"),
            "final_severity": F.when(gone, "none").otherwise(F.col("_sev")),
            "confidence": rnd(F.when(gone, F.greatest(F.lit(0.05), F.col("_conf") * F.col("penalty"))).otherwise(F.col("_conf")), 4),
            "decision": F.when(gone, "suppressed_sample_discrepancy").otherwise(F.col("_dec")),
        }
    ).drop(*(f"_{k}" for k in first))


def merge_anomaly(decided: DataFrame, local_alert: Column, local_score: Column) -> DataFrame:
    """Adds merged_alert, merged_score, suppressed_by_matrix: a true alert raises, a false positive calms a local anomaly."""
    score = F.coalesce(local_score, F.lit(0.0))
    calm = ~F.col("alert") & F.col("false_positive") & F.coalesce(local_alert, F.lit(False))
    raised = F.greatest(score, lookup(F.col("final_severity"), {"leve": 0.65, "moderado": 0.85, "critico": 0.98}, 0.8))
    return decided.withColumns({"merged_alert": F.when(F.col("alert"), True).when(calm, False).otherwise(local_alert), "merged_score": F.when(F.col("alert"), raised).when(calm, F.least(score, F.lit(0.15))).otherwise(score), "suppressed_by_matrix": calm})


def frame_estimates(hr: Column, skin: Column, hrv: Column, spo2: Column, activity: Column) -> dict[str, Column]:
    """Simple per-frame estimates and the local anomaly."""
    mean = 70 + 0.3 * (hr - 70) + 2 * (skin - 33)
    odd = (hr > 100) | (hr < 40) | (spo2 < 92)
    return {"map_mmhg": rnd(mean, 1), "glucose_est": rnd(95 + 0.2 * F.greatest(F.lit(0.0), activity - 30), 1), "vagal_tone": rnd(clip(hrv / 80, 0, 1), 3), "sbp_est": rnd(mean + 13.3, 1), "dbp_est": rnd(mean - 6.7, 1), "local_alert": F.coalesce(odd, F.lit(False))}


def contextual_score(hr: Column, spo2: Column, activity: Column, sleep: Column) -> dict[str, Column]:
    """Online rule score by context: high heart rate limit 120, active 160, sleeping 90."""
    high = F.when(activity == "active", 160.0).when(sleep.isin("deep_sleep", "light_sleep"), 90.0).otherwise(120.0)
    low = F.when((activity != "active") & sleep.isin("deep_sleep", "light_sleep"), 40.0).otherwise(45.0)
    score = F.when(hr > high, F.least(F.lit(1.0), 0.5 + (hr - high) / 100)).when(hr < low, F.least(F.lit(1.0), 0.5 + (low - hr) / 100)).otherwise(0.0)
    both = F.greatest(score, F.when(spo2 < 92, F.least(F.lit(1.0), 0.5 + (92 - spo2) / 20)).otherwise(0.0))
    return {"rule_score": rnd(both, 4), "rule_anomaly": both >= 0.5}
