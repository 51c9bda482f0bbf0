"""Patient baselines: default profiles from ids, profile to baseline, vitals beside the baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulselake.session import Scratch, small_side

#: Rows of a partition that monotonically_increasing_id can number.
_PER_PART = 1 << 33


def numbered(rows: DataFrame, by: str, work: Scratch | None = None) -> DataFrame:
    """rows with i, their place from 0 in the order of by (unique), without gathering them in one task.

    The sorted rows are written; a row's place is its place in its partition plus the rows of the
    partitions before, of which there is one small count each.
    """
    work = work or Scratch(rows.sparkSession, "numbered")
    placed = work.write(rows.orderBy(by).withColumn("_m", F.monotonically_increasing_id()), "sorted")
    part = F.floor(F.col("_m") / _PER_PART)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("_before", before).select("_part", "_before")
    at = placed.join(F.broadcast(offsets), part == F.col("_part"))
    return at.withColumn("i", F.col("_before") + F.pmod("_m", F.lit(_PER_PART))).drop("_m", "_part", "_before")


def default_profiles(patients: DataFrame, work: Scratch | None = None) -> DataFrame:
    """Minimal profiles of patient ids by their place i in order of the id."""
    i = F.col("i")
    return numbered(patients.select("patient_id").distinct(), "patient_id", work).select(
        "patient_id",
        (45 + i % 20).cast("int").alias("age"),
        (68 + i % 5).cast("double").alias("resting_hr"),
        F.lit(97.0).alias("baseline_spo2"),
        F.lit(50.0).alias("baseline_hrv"),
        F.lit("moderate").alias("activity_level"),
        (0.1 * (i % 3)).cast("double").alias("risk_factor"),
    )


def to_baseline(profiles: DataFrame) -> DataFrame:
    """Profiles with the conditions that follow from risk above 0.5 and age above 60."""
    risk = F.coalesce("risk_factor", F.lit(0.0))
    found = F.array_compact(F.array(F.when(risk > 0.5, F.lit("elevated_cardiovascular_risk")), F.when(F.col("age") > 60, F.lit("age_related_risk"))))
    activity = F.coalesce("activity_level", F.lit("moderate"))
    return profiles.withColumns({"risk_factor": risk, "activity_level": activity, "clinical_conditions": found})


def with_baseline(vitals: DataFrame, baselines: DataFrame) -> DataFrame:
    """Vitals beside the patient's baseline; patients without either are dropped. A small baseline table is broadcast."""
    return vitals.join(small_side(baselines, baselines.count()), "patient_id")
