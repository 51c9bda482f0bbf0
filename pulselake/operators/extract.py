"""Named extractors over the lake: filters, timeline, vitals, episodes, cohort, alerts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulselake.functions.scalar import rnd

VITALS = ("heart_rate", "spo2", "hrv")


@dataclass(frozen=True)
class QueryFilters:
    """What a query asks for; an absent field does not filter. One patient wins over a list."""

    patient_id: str | None = None
    patient_ids: tuple[str, ...] | None = None
    start_time: datetime | None = None
    end_time: datetime | None = None
    metrics: tuple[str, ...] | None = None
    min_quality: float | None = None
    anomalies_only: bool = False
    min_risk: float | None = None
    risk_levels: tuple[str, ...] | None = None
    partition_dates: tuple[date, ...] | None = None

    def predicate(self, columns: list[str], time_column: str | None = None) -> Column:
        """All conditions on columns that exist, as one predicate that reaches the scan."""
        p = F.lit(True)
        if self.patient_id is not None:
            p = p & (F.col("patient_id") == self.patient_id)
        elif self.patient_ids is not None:
            p = p & F.col("patient_id").isin(*self.patient_ids)
        if time_column and self.start_time is not None:
            p = p & (F.col(time_column) >= F.lit(self.start_time))
        if time_column and self.end_time is not None:
            p = p & (F.col(time_column) <= F.lit(self.end_time))
        if self.metrics and "metric_type" in columns:
            p = p & F.col("metric_type").isin(*self.metrics)
        if self.min_quality is not None and "quality_score" in columns:
            p = p & (F.col("quality_score") >= self.min_quality)
        if self.anomalies_only and "is_anomaly" in columns:
            p = p & F.col("is_anomaly")
        if self.min_risk is not None and "risk_score" in columns:
            p = p & (F.col("risk_score") >= self.min_risk)
        if self.risk_levels and "clinical_risk_level" in columns:
            p = p & F.col("clinical_risk_level").isin(*self.risk_levels)
        if self.partition_dates and "partition_date" in columns:
            p = p & F.col("partition_date").isin(*self.partition_dates)
        return p


def timeline(silver: DataFrame, filters: QueryFilters) -> DataFrame:
    """One patient's windows in order of time; the patient is mandatory."""
    if filters.patient_id is None:
        raise ValueError("a timeline needs patient_id")
    return silver.where(filters.predicate(silver.columns, "window_start")).orderBy("window_start", "metric_type")


def vitals(silver: DataFrame, metrics: tuple[str, ...] = VITALS) -> DataFrame:
    """A column per metric and window, with mean quality and whether any value is anomalous; one aggregate, no join."""
    columns = [F.avg(F.when(F.col("metric_type") == m, F.col("metric_value"))).alias(m) for m in metrics]
    kept = silver.where(F.col("metric_type").isin(*metrics))
    return kept.groupBy("patient_id", "window_start").agg(*columns, F.avg("quality_score").alias("quality_score"), F.bool_or("is_anomaly").alias("is_anomaly"))


def episodes(silver: DataFrame, gap_seconds: int = 30) -> DataFrame:
    """Runs of anomalous windows of a patient whose gaps are at most gap_seconds.

    The gap counts from the end of the row before, in order of start, metric: gaps and islands,
    one shuffle on patient.
    """
    by_time = W.partitionBy("patient_id").orderBy("window_start", "metric_type")
    gap = F.unix_seconds("window_start") - F.unix_seconds(F.lag("window_end").over(by_time))
    marked = silver.where("is_anomaly").withColumn("new", F.coalesce((gap > gap_seconds).cast("int"), F.lit(1))).withColumn("episode", F.sum("new").over(by_time))
    start, end = F.min("window_start"), F.max_by("window_end", F.struct("window_start", "metric_type"))
    return marked.groupBy("patient_id", "episode").agg(
        start.alias("episode_start"), end.alias("episode_end"),
        rnd((F.unix_seconds(end) - F.unix_seconds(start)) / 60, 2).alias("duration_minutes"),
        F.sort_array(F.collect_set("metric_type")).alias("metrics_involved"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("devices_involved")))).alias("devices_involved"),
        rnd(F.max("anomaly_score"), 3).alias("max_anomaly_score"), F.count("*").alias("reading_count"),
    ).drop("episode")


def cohort(daily: DataFrame, hourly: DataFrame, alerts: DataFrame, filters: QueryFilters) -> DataFrame:
    """Daily rows of the asked risk levels; patients whose highest hourly risk reaches min_risk; with alert counts."""
    rows = daily.where(filters.predicate(daily.columns, "summary_date"))
    if filters.min_risk is not None:
        risky = hourly.groupBy("patient_id").agg(F.max("risk_score").alias("top")).where(F.col("top") >= filters.min_risk)
        rows = rows.join(risky, "patient_id", "left_semi")
    counted = alerts.groupBy("patient_id").agg(F.count("*").alias("n"))
    joined = rows.join(counted, "patient_id", "left").withColumn("alert_count", F.coalesce("n", F.lit(0))).drop("n")
    return joined.orderBy(F.asc("clinical_risk_level"), F.desc("anomaly_episodes"), "patient_id", "summary_date")


#: Extractors by name: (tables, filters) -> DataFrame, where tables maps silver, hourly, daily, alerts.
EXTRACTORS: dict[str, Callable[[dict[str, DataFrame], QueryFilters], DataFrame]] = {
    "timeline": lambda t, f: timeline(t["silver"], f),
    "vitals": lambda t, f: vitals(t["silver"].where(f.predicate(t["silver"].columns, "window_start")), f.metrics or VITALS).orderBy("patient_id", "window_start"),
    "anomalies": lambda t, f: episodes(t["silver"].where(f.predicate(t["silver"].columns, "window_start"))),
    "cohort": lambda t, f: cohort(t["daily"], t["hourly"], t["alerts"], f),
    "alerts": lambda t, f: t["alerts"].where(f.predicate(t["alerts"].columns, "window_start")),
}


def extract(name: str, tables: dict[str, DataFrame], filters: QueryFilters) -> DataFrame:
    """Runs a named extractor; an unknown name is an error that lists the names."""
    if name not in EXTRACTORS:
        raise KeyError(f"unknown query {name!r}; known: {', '.join(sorted(EXTRACTORS))}")
    return EXTRACTORS[name](tables, filters)


def package_24h(tables: dict[str, DataFrame], filters: QueryFilters) -> dict[str, DataFrame]:
    """Timeline, vitals, anomalies and alerts of one patient."""
    return {name: extract(name, tables, filters) for name in ("timeline", "vitals", "anomalies", "alerts")}


def high_risk_cohort(tables: dict[str, DataFrame], min_risk: float | None = None) -> DataFrame:
    """The cohort of elevated and critical days."""
    return extract("cohort", tables, QueryFilters(risk_levels=("elevated", "critical"), min_risk=min_risk))
