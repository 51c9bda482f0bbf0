"""Exact order statistics of large groups by histograms: no sort, no buffer of a group.

A pass counts each group's values in BINS bins between two bounds, combined where they are read; the
bin that holds the wanted rank gives the next, narrower bounds (its least and greatest value). The
passes end when the bounds are one value: two or three for any double. Groups and ranks are few
(horizons), so what the driver holds between passes is a few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BINS = 4096


def order_statistics(rows: DataFrame, group: str, value: str, wanted: dict) -> dict:
    """{(group, rank): value} of the ranks (from 0) that wanted = {group: ranks} asks for; null values do not count."""
    given = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    spark, out = rows.sparkSession, {}
    bounds = {r["g"]: (r["lo"], r["hi"]) for r in given.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect() if r["g"] in wanted}
    open_ = [(g, int(k), *bounds[g], 0) for g in bounds for k in sorted({int(k) for k in wanted[g]})]
    kind = rows.schema[group].dataType.simpleString()
    while True:
        out |= {(g, k): lo for g, k, lo, hi, _ in open_ if lo == hi}
        open_ = [s for s in open_ if s[2] != s[3]]
        if not open_:
            return out
        state = F.broadcast(spark.createDataFrame(open_, f"g {kind}, k long, lo double, hi double, below long"))
        place = F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS))
        bins = given.join(state, "g").where("v between lo and hi").groupBy("g", "k", "below", place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.col("below") + F.sum("n").over(W.partitionBy("g", "k").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
        found = bins.withColumn("upto", upto).where("upto > k and upto - n <= k")
        open_ = [(r["g"], r["k"], r["lo"], r["hi"], r["upto"] - r["n"]) for r in found.collect()]


def quantiles(rows: DataFrame, group: str, value: str, level: dict) -> dict:
    """{group: value} at the group's level, between the two nearest ranks in proportion."""
    sizes = {r[0]: r[1] for r in rows.where(F.col(value).isNotNull()).groupBy(group).count().collect()}
    at = {g: level[g] * (n - 1) for g, n in sizes.items() if g in level}
    found = order_statistics(rows, group, value, {g: {int(p), min(int(p) + 1, sizes[g] - 1)} for g, p in at.items()})
    return {g: found[g, int(p)] * (1 - (p - int(p))) + found[g, min(int(p) + 1, sizes[g] - 1)] * (p - int(p)) for g, p in at.items()}
