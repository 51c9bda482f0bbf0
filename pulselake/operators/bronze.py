"""Bronze: validation, ingest statistics, range checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.functions.scalar import lookup
from pulselake.schemas import LakeConfig


def in_range(metric: Column, value: Column, config: LakeConfig = LakeConfig()) -> Column:
    """Whether a value is physiological; metrics without a range always are."""
    low, high = ({m: float(r[k]) for m, r in config.ranges.items()} for k in (0, 1))
    return F.coalesce(value.between(lookup(metric, low), lookup(metric, high)), lookup(metric, low).isNull())


def validate(readings: DataFrame, config: LakeConfig = LakeConfig()) -> DataFrame:
    """Adds quality_flags, quality_score, is_valid and rejection_reason; no row is dropped."""
    weak = F.coalesce(F.col("signal_confidence") < 0.5, F.lit(False))
    flat = F.coalesce(F.col("battery_level") < 0.1, F.lit(False))
    outside = ~in_range(F.col("metric_type"), F.col("metric_value"), config)
    undated = F.col("timestamp_utc").isNull()
    flag = lambda cond, name: F.when(cond, F.lit(name))
    flags = F.array_compact(F.array(flag(weak, "low_confidence"), flag(flat, "low_confidence"), flag(outside, "out_of_range"), flag(undated, "missing_timestamp")))
    score = 1.0 - weak.cast("double") * 0.2 - flat.cast("double") * 0.1 - outside.cast("double") * 0.4
    scored = readings.withColumn("quality_flags", flags).withColumn("quality_score", F.when(undated, 0.0).otherwise(F.greatest(F.lit(0.0), score)))
    ok = (F.col("quality_score") >= config.min_quality) & ~outside
    return scored.withColumn("is_valid", ok).withColumn("rejection_reason", F.when(~ok, "quality_gate_failed"))


def ingest_stats(validated: DataFrame) -> DataFrame:
    """One row: total, valid, invalid, partitions."""
    return validated.agg(
        F.count("*").alias("total"),
        F.count_if("is_valid").alias("valid"),
        F.count_if(~F.col("is_valid")).alias("invalid"),
        F.countDistinct("partition_date").alias("partitions"),
    )


def usable(validated: DataFrame) -> DataFrame:
    """Rows not out of range; low confidence stays."""
    return validated.where(~F.array_contains("quality_flags", "out_of_range"))


def check_request(rows: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Adds violations (names of columns outside their bounds) and valid; null is allowed."""
    bad = []
    for name, (low, high) in bounds.items():
        wrong = F.lit(False)
        if low is not None:
            wrong = wrong | (F.col(name) < low)
        if high is not None:
            wrong = wrong | (F.col(name) > high)
        bad.append(F.when(wrong, F.lit(name)))
    return rows.withColumn("violations", F.array_compact(F.array(*bad))).withColumn("valid", F.size("violations") == 0)
