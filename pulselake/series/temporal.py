"""The feature matrix of a patient's steps: vitals, prognostic measures, hidden signals and fuzzy scores over a look-back."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulselake.clinical.scores import GHOSTS, fuzzy, ghost_signals
from pulselake.series.chunks import hampel_groups, kalman_groups, whole_groups
from pulselake.session import Scratch

# Half window of the outlier filter, process and measurement noise of each vital; its baseline column.
VITALS = {"heart_rate": (4, 1.0, 9.0, "resting_hr"), "spo2": (2, 0.1, 1.0, "baseline_spo2"), "hrv": (2, 2.0, 25.0, "baseline_hrv"), "stress": (3, 1.0, 15.0, None)}
PROGNOSTIC = ("hr_deviation", "spo2_risk", "hrv_suppression", "noise_level", "artifact_ratio", "trajectory_slope", "persistence")
FEATURES = ("hr", "spo2", "hrv", "stress", "quality_score", *PROGNOSTIC, *(f"ghost_{g}" for g in GHOSTS), "fuzzy_event_prob", "fuzzy_fp_risk", "fuzzy_noise_gate", "fuzzy_persistence")
BASELINE = ("resting_hr", "baseline_spo2", "baseline_hrv", "activity_level", "risk_factor", "n_conditions")


def denoised(vitals: DataFrame) -> DataFrame:
    """patient_id, window_start, t (place from 0), quality_score, the series' mean_quality, baseline, and each vital's filtered values, noise and artifacts.

    Sorted patients pass in batches, a patient's rows whole, and are filtered together. Gaps are filled forward, those at the start by the baseline (stress: 0).
    """
    extra = ", ".join(f"{v} double, {v}_noise double, {v}_artifacts double" for v in VITALS)
    schema = f"patient_id string, window_start timestamp, t int, quality_score double, mean_quality double, resting_hr double, baseline_spo2 double, baseline_hrv double, activity_level string, risk_factor double, n_conditions int, {extra}"
    given = vitals.select("patient_id", "window_start", F.coalesce("quality_score", F.lit(1.0)).alias("quality_score"), *BASELINE, *VITALS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, first, size in whole_groups(batches, ["patient_id"]):
            code = np.repeat(np.arange(len(first)), size)
            mean = lambda v: (np.add.reduceat(v, first) / size)[code]
            out = pdf[["patient_id", "window_start", "quality_score", *BASELINE]].assign(t=np.arange(len(pdf)) - first[code], mean_quality=pdf.groupby(code)["quality_score"].transform("mean"))
            for name, (half, q, r, base) in VITALS.items():
                filled = pdf.groupby(code)[name].ffill().to_numpy(float)
                fill = 0.0 if base is None else pdf[base].to_numpy(float)[first][code]
                x = np.where(np.isnan(filled), fill, filled)
                clean, odd = hampel_groups(x, first, size, half, fixed=size[code] < 3)
                start = x[first] if base is None else pdf[base].to_numpy(float)[first]
                even = kalman_groups(clean, first, size, np.zeros(len(first), int), q, r, start, np.zeros(len(first)))[0]
                off = clean - even
                out = out.assign(**{name: even, f"{name}_noise": np.sqrt(mean((off - mean(off)) ** 2)), f"{name}_artifacts": mean(odd.astype(float))})
            yield out

    return given.repartition("patient_id").sortWithinPartitions("patient_id", F.asc_nulls_last("window_start")).mapInPandas(run, schema)


def _longest_run(large: Column) -> Column:
    """Longest run of true in an array, by one fold."""
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, v: Column) -> Column:
        now = F.when(v, acc["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(large, zero, step, lambda a: a["most"])


def feature_matrix(vitals: DataFrame, stride: int = 4, look_back: int = 40) -> DataFrame:
    """patient_id, window_start and the FEATURES of every step.

    vitals: patient_id, window_start, heart_rate, spo2, hrv, stress, quality_score and the BASELINE
    columns. Every stride-th step is an anchor whose features come from the look_back steps up to it
    and hold for the stride steps from it on. A row is dealt to the look_back / stride anchors that
    see it, so a window is a small group of its own and a long series is many of them.
    """
    rows = Scratch(vitals.sparkSession, "features").write(denoised(vitals), "denoised")  # read three times
    last = rows.withColumn("end", F.max("t").over(W.partitionBy("patient_id")))
    first = (F.ceil(F.col("t") / stride) * stride).cast("int")
    anchors = F.filter(F.sequence(first, F.greatest(first, F.col("t") + look_back - 1), F.lit(stride)), lambda a: (a <= F.col("end")) & (a < F.col("t") + look_back))
    dealt = last.withColumn("anchor", F.explode(anchors)).drop("end")
    key = F.concat_ws("#", "patient_id", "anchor")

    seen = dealt.select(
        key.alias("patient_id"), F.col("t").alias("window_start"), *VITALS, "resting_hr", "baseline_spo2", "baseline_hrv", "activity_level",
        F.col("heart_rate_noise").alias("hr_noise"), F.col("heart_rate_artifacts").alias("hr_artifacts"), *(F.col("mean_quality").alias(f"{v}_quality") for v in ("hr", "hrv", "spo2")),
    )
    ghosts = ghost_signals(seen).groupBy("patient_id").agg(*(F.max(F.when(F.col("signal") == g, F.col("value") * F.col("confidence"))).alias(f"ghost_{g}") for g in GHOSTS))

    back = F.col("anchor") - F.col("t")
    tail = lambda c, n: F.when(back < n, c)
    deviation = lambda v, ref: (F.col(v) - ref) / F.greatest(F.col(f"{v}_noise"), F.lit(1.0))
    g = dealt.groupBy("patient_id", "anchor").agg(
        F.count("*").alias("n"), *(F.max(c).alias(c) for c in ("risk_factor", "n_conditions", "baseline_spo2", "baseline_hrv")),
        *(F.max_by(v, "t").alias(v) for v in VITALS), F.max_by("quality_score", "t").alias("quality_score"),
        *(F.max(f"{v}_{k}").alias(f"{v}_{k}") for v in VITALS for k in ("noise", "artifacts")), F.avg("stress").alias("stress_mean"),
        F.avg(tail(F.abs(deviation("heart_rate", F.col("resting_hr"))), 10)).alias("hr_deviation"), F.min(tail(F.col("spo2"), 10)).alias("spo2_low"), F.avg(tail(F.col("hrv"), 10)).alias("hrv10"),
        F.regr_slope(tail(F.col("heart_rate"), 12), tail(F.col("t").cast("double"), 12)).alias("slope"),
        F.sort_array(F.collect_list(tail(F.struct("t", *VITALS, *(f"{v}_noise" for v in VITALS), "resting_hr", "baseline_spo2", "baseline_hrv"), 20))).alias("near"),
    )

    def share(name: str) -> Column:
        base = VITALS[name][3]
        far = lambda r: F.abs((r[name] - (r[base] if base else F.col("stress_mean"))) / F.greatest(r[f"{name}_noise"], F.lit(1.0))) > 2
        return _longest_run(F.transform("near", far)) / F.size("near")

    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    mean = lambda cs: reduce(lambda a, b: a + b, cs) / len(VITALS)
    measures = {
        "spo2_risk": unit((F.col("baseline_spo2") - F.col("spo2_low")) / 5),
        "hrv_suppression": unit((F.col("baseline_hrv") - F.col("hrv10")) / F.col("baseline_hrv")),
        "noise_level": unit(mean([F.col(f"{v}_noise") / F.greatest(F.lit(1.0), F.abs(v)) for v in VITALS]) * 5),
        "artifact_ratio": mean([F.col(f"{v}_artifacts") for v in VITALS]),
        "trajectory_slope": F.when(F.col("n") >= 3, F.coalesce("slope", F.lit(0.0))).otherwise(0.0),
        "persistence": F.when(F.col("n") >= 5, mean([share(v) for v in VITALS])).otherwise(0.0),
        "burden": unit(F.col("risk_factor") + 0.15 * F.col("n_conditions")),
    }
    g = g.withColumns(measures).withColumn("key", key)
    joined = g.join(ghosts.withColumnRenamed("patient_id", "key"), "key", "left").fillna(0.0, [f"ghost_{x}" for x in GHOSTS])
    strongest = F.greatest(*(F.col(f"ghost_{x}") for x in GHOSTS))
    scored = fuzzy(joined.withColumns({"ghost": strongest, "noise": F.col("noise_level"), "artifact": F.col("artifact_ratio"), "trajectory": F.col("trajectory_slope")}))
    names = {"hr": "heart_rate", "fuzzy_event_prob": "event_probability", "fuzzy_fp_risk": "false_positive_risk", "fuzzy_persistence": "persistence"}
    gate = scored.withColumn("fuzzy_noise_gate", F.col("noise_gate"))
    per = gate.select(F.col("patient_id").alias("_p"), F.col("anchor").alias("_a"), *(F.col(names.get(f, f)).cast("double").alias(f) for f in FEATURES))
    steps = rows.select("patient_id", "window_start", (F.floor(F.col("t") / stride) * stride).alias("_s"))
    return steps.join(per, (F.col("patient_id") == F.col("_p")) & (F.col("_s") == F.col("_a"))).select("patient_id", "window_start", *FEATURES)
