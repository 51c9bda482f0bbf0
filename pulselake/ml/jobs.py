"""Training, batch and online scoring, calibration and validation as jobs with reports."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulselake.lake import export_features
from pulselake.ml import models
from pulselake.ml.features import BATCH, RISK_LABEL

SHARE = 0.25
LEAST_CALIBRATED = 10
LEAST_ROWS = 20
METRICS = ("sensitivity", "specificity", "ppv", "npv", "f1")


def train_risk_model(rows: DataFrame, model_path: str, batch_path: str, trees: int = 40, depth: int = 8) -> DataFrame:
    """Fits a scaled forest on the hash-kept part, saves it, scores and exports all rows; returns the report of the held-out part.

    Without training rows nothing is fitted and the report is empty.
    """
    named = rows.withColumn("id", F.struct("patient_id", "summary_date"))
    train, test = models.split(named)
    if not train.head(1):
        return models.classifier_report(test.withColumn("prediction", F.lit(0.0)), label="risk_label")
    forest = RandomForestClassifier(labelCol="risk_label", numTrees=trees, maxDepth=depth, seed=7)
    fitted = models.scaled_pipeline(list(BATCH), forest).fit(train)
    fitted.write().overwrite().save(model_path)
    export_features(score_batch(rows, model_path), batch_path, form="json")
    return models.classifier_report(fitted.transform(test), label="risk_label")


def score_batch(rows: DataFrame, model_path: str) -> DataFrame:
    """Feature rows with the saved model's predicted level."""
    scored = PipelineModel.load(model_path).transform(rows)
    level = F.element_at(F.array(*map(F.lit, RISK_LABEL)), F.col("prediction").cast("int") + 1)
    return scored.select("patient_id", "summary_date", *BATCH, F.col("prediction").cast("int").alias("predicted_label"), level.alias("predicted_level"))


def score_online(instances: DataFrame, columns: list[str], mean: list[float], inverse: list[list[float]], limit: float = 0.01) -> DataFrame:
    """Online feature rows with their distance from normal, its tail probability and an alert below the limit."""
    distance = models.mahalanobis_score(columns, mean, inverse)
    p = models.chi2_tail_even(distance * distance, len(columns))
    return instances.withColumns({"distance": distance, "p_value": p, "is_alert": p < limit})


def newest_share(rows: DataFrame, order: str, share: float = SHARE) -> DataFrame:
    """The last share of each horizon's rows in order (all of them if that is fewer than LEAST_CALIBRATED)."""
    of = W.partitionBy("horizon")
    placed = rows.withColumns({"_n": F.count("*").over(of), "_k": F.row_number().over(of.orderBy(order))})
    size = F.when(F.col("_n") * share < LEAST_CALIBRATED, F.col("_n")).otherwise(F.floor(F.col("_n") * share))
    return placed.where(F.col("_k") > F.col("_n") - size)


def calibrate(rows: DataFrame, order: str, alpha: float = 0.1) -> DataFrame:
    """Conformal quantile and coverage per horizon on the newest quarter; horizons of fewer than LEAST_ROWS rows are skipped."""
    part = newest_share(rows, order)
    done = models.conformal_fit(part.where(F.col("_n") >= LEAST_ROWS).drop("_n", "_k"), alpha).withColumn("skipped", F.lit(False))
    short = part.where(F.col("_n") < LEAST_ROWS).select("horizon").distinct()
    return done.unionByName(short.withColumn("skipped", F.lit(True)), allowMissingColumns=True)


def validate(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Metrics, rows and events per horizon, and their means in a row of horizon 0; written as JSON where a path is given."""
    counts = rows.groupBy("horizon").agg(F.count("*").alias("rows"), F.sum("label").cast("long").alias("events"))
    each = models.threshold_metrics(rows).join(F.broadcast(counts), "horizon").select("horizon", "threshold", *METRICS, "rows", "events")
    means = each.agg(F.lit(0).alias("horizon"), *(F.avg(c).alias(c) for c in ("threshold", *METRICS)), F.sum("rows").alias("rows"), F.sum("events").alias("events"))
    report = each.unionByName(means)
    if path:
        report.coalesce(1).write.mode("overwrite").json(path)
    return report
