"""Vector calculus on grids, flow irregularities and images."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulselake.functions.scalar import rnd
from pulselake.session import Scratch

AXES = ("i", "j", "k")


def derivative(value: Column, axis: str, spacing: Column) -> Column:
    """Central difference along an axis, second-order one-sided at the edges (first-order with two nodes)."""
    w = W.partitionBy("field_id", *(a for a in AXES if a != axis)).orderBy(axis)
    at = lambda d: F.lead(value, d).over(w)
    lag = lambda d: F.lag(value, d).over(w)
    inner = (at(1) - lag(1)) / (2 * spacing)
    start = F.when(at(2).isNotNull(), (-3 * value + 4 * at(1) - at(2)) / (2 * spacing)).otherwise((at(1) - value) / spacing)
    end = F.when(lag(2).isNotNull(), (3 * value - 4 * lag(1) + lag(2)) / (2 * spacing)).otherwise((value - lag(1)) / spacing)
    return F.coalesce(F.when(lag(1).isNull(), start).when(at(1).isNull(), end).otherwise(inner), F.lit(0.0))


def operators(field: DataFrame) -> DataFrame:
    """Adds gradient of p, divergence and curl of (fx, fy, fz), and magnitudes, per node."""
    d = lambda c, a: derivative(F.col(c), a, F.col("spacing"))
    made = field.withColumns({"gx": d("p", "i"), "gy": d("p", "j"), "gz": d("p", "k"), "dxx": d("fx", "i"), "dyy": d("fy", "j"), "dzz": d("fz", "k")}).withColumns(
        {"cx": d("fz", "j") - d("fy", "k"), "cy": d("fx", "k") - d("fz", "i"), "cz": d("fy", "i") - d("fx", "j")}
    )
    norm = lambda *c: F.sqrt(reduce(lambda a, b: a + b, (F.col(x) * F.col(x) for x in c)))
    return made.withColumns({"gradient": norm("gx", "gy", "gz"), "divergence": F.col("dxx") + F.col("dyy") + F.col("dzz"), "curl": norm("cx", "cy", "cz")}).drop("dxx", "dyy", "dzz")


# Type, operator, sign of the limit, limit.
IRREGULAR = [("pressure_gradient", "gradient", 1, 8.0), ("flow_source", "divergence", 1, 15.0), ("flow_sink", "divergence", -1, -12.0), ("vorticity", "curl", 1, 20.0)]


def irregularities(nodes: DataFrame, top: int = 2) -> DataFrame:
    """Of the top nodes by absolute value of each operator and field, those beyond a limit, with severity."""
    long_ = nodes.select("field_id", *AXES, F.explode(F.create_map(*(x for c in ("gradient", "divergence", "curl") for x in (F.lit(c), F.col(c))))).alias("operator", "value"))
    w = W.partitionBy("field_id", "operator").orderBy(rnd(F.abs("value"), 6).desc(), *AXES)
    hot = long_.withColumn("nth", F.row_number().over(w)).where((F.col("nth") <= top) & (F.col("value") != 0))
    kind = reduce(lambda a, r: a.when((F.col("operator") == r[1]) & ((F.col("value") >= r[3]) if r[2] > 0 else (F.col("value") <= r[3])), F.struct(F.lit(r[0]).alias("type"), F.lit(r[3]).alias("threshold"))), IRREGULAR, F.when(F.lit(False), None))
    severity = F.when(F.abs("value") >= 1.5 * F.abs("threshold"), "high").otherwise("moderate")
    return hot.withColumn("t", kind).where("t is not null").select("field_id", *AXES, "operator", "value", "nth", "t.*").withColumn("severity", severity)


def flow_summary(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Per field: extremes of the operators, irregularities and the flow score."""
    ext = nodes.groupBy("field_id").agg(F.max("gradient").alias("gradient_max"), F.min("divergence").alias("divergence_min"), F.max("divergence").alias("divergence_max"), F.max("curl").alias("curl_max"))
    n = found.groupBy("field_id").agg(F.count("*").alias("n"))
    return ext.join(n, "field_id", "left").withColumn("irregularities", F.coalesce("n", F.lit(0))).withColumn("flow_score", F.least(F.lit(1.0), F.col("irregularities") / 6)).drop("n")


def flow_alerts(found: DataFrame, descriptions: DataFrame) -> DataFrame:
    """The first irregularity of each field and type as an alert row with its description."""
    w = W.partitionBy("field_id", "type").orderBy("nth", *AXES)
    first = found.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    metric = F.when(F.col("type") == "pressure_gradient", "blood_pressure").when(F.col("type") == "vorticity", "hrv").otherwise("heart_rate")
    return first.join(F.broadcast(descriptions), "type", "left").select("field_id", "type", metric.alias("metric_type"), "severity", "threshold", F.lit(0.0).alias("duration_minutes"), "description")


def image_oscillation(image: DataFrame, width: int = 3) -> DataFrame:
    """Mean absolute deviation from the mean in the edge-truncated patch of each pixel, by exploding offsets.

    A pixel's value goes to the width^2 patches that hold it; one shuffle on the target pixel.
    """
    h = width // 2
    shifts = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-h, h + 1) for b in range(-h, h + 1)))
    spread = image.withColumn("s", F.explode(shifts)).select("image_id", (F.col("r") + F.col("s.a")).alias("r"), (F.col("c") + F.col("s.b")).alias("c"), F.col("v").alias("w"))
    mean = spread.groupBy("image_id", "r", "c").agg(F.avg("w").alias("m"), F.collect_list("w").alias("patch"))
    mo = F.aggregate("patch", F.lit(0.0), lambda a, v: a + F.abs(v - F.col("m"))) / F.size("patch")
    return image.join(mean, ["image_id", "r", "c"]).select("image_id", "r", "c", "v", mo.alias("mo"), F.col("m").alias("smooth"))


def image_denoise(image: DataFrame, width: int = 5, lam: float = 0.5) -> DataFrame:
    """Blend of each pixel and its smoothed value by the sigmoid of the patch's standardised oscillation; a flat image stays.

    image: (image_id, r, c, v), whole from (0, 0). The smoothed value is the mean of the width^2 pixels
    around, mirrored at the edges: a pixel near an edge is weighed by how often its mirror images fall in
    the patch. One shuffle on the target pixel, one small aggregate per image.
    """
    h = width // 2
    size = image.groupBy("image_id").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("columns"))
    shifts = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-h, h + 1) for b in range(-h, h + 1)))
    moved = image.join(F.broadcast(size), "image_id").withColumn("s", F.explode(shifts)).withColumns({"tr": F.col("r") + F.col("s.a"), "tc": F.col("c") + F.col("s.b")})
    inside = moved.where("tr >= 0 and tc >= 0 and tr < rows and tc < columns")
    times = lambda at, to, n: 1 + (F.col(at) + F.col(to) + 1 <= h).cast("int") + (2 * F.col(n) - 1 - F.col(at) - F.col(to) <= h).cast("int")
    weighed = inside.select("image_id", F.col("tr").alias("r"), F.col("tc").alias("c"), "v", (times("r", "tr", "rows") * times("c", "tc", "columns")).alias("w"), ((F.col("s.a") == 0) & (F.col("s.b") == 0)).alias("own"))
    patch = weighed.groupBy("image_id", "r", "c").agg(F.max(F.when(F.col("own"), F.col("v"))).alias("v"), F.avg("v").alias("m"), F.collect_list("v").alias("near"), (F.sum(F.col("v") * F.col("w")) / float(width * width)).alias("smooth"))
    mo = F.aggregate("near", F.lit(0.0), lambda a, v: a + F.abs(v - F.col("m"))) / F.size("near")
    local = Scratch(image.sparkSession, "image_denoise").write(patch.select("image_id", "r", "c", "v", "smooth", mo.alias("mo")), "local")
    whole = local.groupBy(F.col("image_id").alias("of")).agg(F.avg("mo").alias("mean"), F.stddev_pop("mo").alias("sd"))
    edge = 1 / (1 + F.exp(-(F.col("mo") - F.col("mean")) / (lam * F.col("sd") + 1e-8)))
    y = F.when(F.col("sd") < 1e-8, F.col("v")).otherwise(edge * F.col("v") + (1 - edge) * F.col("smooth"))
    return local.join(F.broadcast(whole), F.col("image_id") == F.col("of")).select("image_id", "r", "c", "v", "mo", "smooth", y.alias("denoised"))


def image_rows(vectors: DataFrame, image: str, key: str) -> DataFrame:
    """(image_id, r, row): the vectors of each image as its rows, numbered from 0 by key.

    Range partitions hold runs of (image, key); a row's number is its number in its run plus the rows of
    the image in earlier runs, so no task holds a whole image. Ties go by the vector's hash.
    """
    runs = vectors.select(F.col(image).alias("image_id"), F.col(key).alias("key"), F.col("embedding").alias("row")).withColumn("tie", F.xxhash64("row"))
    runs = Scratch(vectors.sparkSession, "image").write(runs.repartitionByRange("image_id", "key", "tie").withColumn("run", F.spark_partition_id()), "runs")
    before = W.partitionBy("image_id").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    starts = runs.groupBy("image_id", "run").agg(F.count("*").alias("n")).select(F.col("image_id").alias("of"), F.col("run").alias("nth"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    local = F.row_number().over(W.partitionBy("run", "image_id").orderBy("key", "tie")) - 1
    numbered = runs.withColumn("local", local).join(F.broadcast(starts), F.col("image_id").eqNullSafe(F.col("of")) & (F.col("run") == F.col("nth")))
    return numbered.select("image_id", (F.col("start") + F.col("local")).alias("r"), "row")


def row_oscillation(rows: DataFrame, width: int = 3) -> DataFrame:
    """image_oscillation of images given as rows (image_id, r, row): whole rows go to the width rows that see them."""
    h = width // 2
    spread = rows.withColumn("d", F.explode(F.sequence(F.lit(-h), F.lit(h)))).select("image_id", (F.col("r") + F.col("d")).alias("r"), F.struct("d", F.transform("row", lambda v: v.cast("double")).alias("row")).alias("s"))
    near = spread.groupBy("image_id", "r").agg(F.sort_array(F.collect_list("s")).alias("near"), F.max(F.when(F.col("s.d") == 0, F.col("s.row"))).alias("row")).where("row is not null")
    pixel = near.select("image_id", "r", "near", F.posexplode("row").alias("c", "v"))
    low = F.greatest(F.col("c") - h, F.lit(0))
    patch = F.filter(F.flatten(F.transform("near", lambda s: F.slice(s["row"], low + 1, F.col("c") + h + 1 - low))), lambda v: v.isNotNull())
    held = pixel.select("image_id", "r", "c", "v", patch.alias("patch"))
    mean = held.withColumn("m", F.try_divide(F.aggregate("patch", F.lit(0.0), lambda a, v: a + v), F.size("patch")))
    mo = F.try_divide(F.aggregate("patch", F.lit(0.0), lambda a, v: a + F.abs(v - F.col("m"))), F.size("patch"))
    return mean.select("image_id", "r", "c", "v", mo.alias("mo"), F.col("m").alias("smooth"))
