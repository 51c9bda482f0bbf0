"""Queries of the ordered-series operators over events (one series per user) and derived grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulselake.functions.scalar import rnd as round_
from pulselake.plans import views
from pulselake.plans.base import Registry
from pulselake.plans.views import rnd
from pulselake.series import chunks, grid, hrv, recursive, windows
from pulselake.session import read_table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def series(spark, sf_dir):
    """A user's events in order as (series, idx, x, ts)."""
    b = views.bronze(spark, sf_dir)
    return b.select(F.col("patient_id").alias("series"), F.col("event_id").cast("long").alias("idx"), F.col("metric_value").alias("x"), F.col("timestamp_utc").alias("ts"))


S_SQL = f"{views.BRONZE_SQL}, s AS (SELECT patient_id AS series, CAST(event_id AS BIGINT) AS idx, metric_value AS x, timestamp_utc AS ts FROM bronze)"


def rounded(df, *columns, digits=6):
    return df.withColumns({c: round_(c, digits) for c in columns})


@query("cusum", f"""WITH {S_SQL}, p AS (SELECT *, avg(x) OVER w AS mu, coalesce(nullif(stddev_samp(x) OVER w, 0), 1) AS sd FROM s WINDOW w AS (PARTITION BY series)),
 c AS (SELECT *, sum(x - mu - 1.5 * sd) OVER o AS u, sum(mu - 1.5 * sd - x) OVER o AS d FROM p WINDOW o AS (PARTITION BY series ORDER BY idx ROWS UNBOUNDED PRECEDING)),
 m AS (SELECT *, u - least(0, min(u) OVER o) AS s_up, d - least(0, min(d) OVER o) AS s_down FROM c WINDOW o AS (PARTITION BY series ORDER BY idx ROWS UNBOUNDED PRECEDING))
 SELECT series, idx, {rnd('s_up', 5)} AS s_up, {rnd('s_down', 5)} AS s_down, s_up > 5 * sd OR s_down > 5 * sd AS alarm, CASE WHEN s_up > 5 * sd AND s_up >= s_down THEN 'up' WHEN s_down > 5 * sd THEN 'down' ELSE 'none' END AS direction FROM m""")
def cusum(spark, sf_dir):
    return rounded(windows.cusum(series(spark, sf_dir)), "s_up", "s_down", digits=5).drop("x", "ts")


@query("change_point", f"""WITH {S_SQL}, z AS (SELECT series, idx, (x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 1e-9) AS x, row_number() OVER (PARTITION BY series ORDER BY idx) AS nth, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY series)),
 c AS (SELECT *, sum(x - 0.5) OVER o AS u, sum(-0.5 - x) OVER o AS d FROM z WHERE nth > 1 WINDOW o AS (PARTITION BY series ORDER BY idx ROWS UNBOUNDED PRECEDING)),
 m AS (SELECT *, greatest(u - least(0, min(u) OVER o), d - least(0, min(d) OVER o)) AS g FROM c WINDOW o AS (PARTITION BY series ORDER BY idx ROWS UNBOUNDED PRECEDING)),
 r AS (SELECT series, max(n) AS n, min(nth - 1) FILTER (g > 4) AS f, max(g) AS g FROM m GROUP BY 1)
 SELECT series, n >= 10 AND f IS NOT NULL AS detected, CAST(CASE WHEN n >= 10 THEN f END AS DOUBLE) AS change_index, {rnd('CASE WHEN n >= 10 AND f IS NOT NULL THEN g ELSE 0 END', 5)} AS magnitude FROM r""")
def change_point(spark, sf_dir):
    return rounded(windows.change_point(series(spark, sf_dir)), "magnitude", digits=5).withColumn("change_index", F.col("change_index").cast("double"))


_NEAR = lambda w: f"(PARTITION BY series ORDER BY idx ROWS BETWEEN {w // 2} PRECEDING AND {w // 2} FOLLOWING)"
_MO = lambda w: f"q AS (SELECT *, list(x) OVER {_NEAR(w)} AS l FROM s), mo AS (SELECT *, list_avg(list_transform(l, lambda v: abs(v - list_avg(l)))) AS mo FROM q)"


@query("mean_oscillation", f"WITH {S_SQL}, {_MO(8)} SELECT series, idx, {rnd('mo', 6)} AS mo FROM mo")
def mean_oscillation(spark, sf_dir):
    return rounded(windows.mean_oscillation(series(spark, sf_dir), 8), "mo").drop("x", "ts")


def _profile_sql(scales) -> str:
    one = lambda w: f"""SELECT series, {w} AS scale, avg(mo) AS mean_mo, max(mo) AS max_mo FROM (SELECT series, list_avg(list_transform(l, lambda v: abs(v - list_avg(l)))) AS mo
  FROM (SELECT series, list(x) OVER {_NEAR(w)} AS l, count(*) OVER (PARTITION BY series) AS n FROM s) WHERE n > {w}) GROUP BY 1"""  # noqa: E731
    return "prof AS (" + " UNION ALL ".join(map(one, scales)) + ")"


@query("oscillation_profile", f"WITH {S_SQL}, {_profile_sql((4, 8, 16, 32, 64))} SELECT series, scale, {rnd('mean_mo', 6)} AS mean_mo, {rnd('max_mo', 6)} AS max_mo FROM prof")
def oscillation_profile(spark, sf_dir):
    return rounded(windows.oscillation_profile(series(spark, sf_dir)), "mean_mo", "max_mo")


@query(
    "oscillation_index",
    f"""WITH {S_SQL}, {_profile_sql((4, 8, 16, 32))} SELECT series, {rnd('max(max_mo)', 6)} AS norm,
  {rnd('max(mean_mo) FILTER (scale = 4) / (arg_max(mean_mo, scale) + 1e-8)', 6)} AS vmo FROM prof GROUP BY 1""",
)
def oscillation_index(spark, sf_dir):
    return rounded(windows.oscillation_index(series(spark, sf_dir)), "norm", "vmo")


@query("bmo_anomalies", f"WITH {S_SQL}, {_MO(8)} SELECT series, idx, {rnd('mo', 6)} AS mo, mo > avg(mo) OVER w + 3 * (stddev_pop(mo) OVER w + 1e-8) AS is_anomaly FROM mo WINDOW w AS (PARTITION BY series)")
def bmo_anomalies(spark, sf_dir):
    return rounded(windows.oscillation_anomalies(series(spark, sf_dir)), "mo").drop("x", "ts")


_MA = lambda w: f"sum(x) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN {w // 2} PRECEDING AND {(w - 1) // 2} FOLLOWING) / {float(w)}"


@query("edge_denoise", f"""WITH {S_SQL}, {_MO(8)}, e AS (SELECT *, {_MA(8)} AS ma, avg(mo) OVER w AS m, stddev_pop(mo) OVER w AS sd, count(*) OVER w AS n, stddev_pop(x) OVER w AS sx FROM mo WINDOW w AS (PARTITION BY series)),
 f AS (SELECT *, 1 / (1 + exp(-((mo - m) / (0.5 * sd + 1e-8)))) AS k FROM e) SELECT series, idx, {rnd('CASE WHEN n < 4 OR sx < 1e-8 THEN x ELSE k * x + (1 - k) * ma END', 5)} AS y FROM f""")
def edge_denoise(spark, sf_dir):
    return rounded(windows.edge_denoise(series(spark, sf_dir)), "y", digits=5).drop("x", "ts")


@query("transient_filter", f"""WITH {S_SQL}, b AS (SELECT *, {_MA(5)} AS b FROM s), r AS (SELECT *, stddev_pop(x - b) OVER (PARTITION BY series) AS sd FROM b),
 w AS (SELECT *, 1 / (1 + exp(4 * (abs(x - b) / CASE WHEN sd <= 1e-6 THEN 1 ELSE sd END - 2))) AS w FROM r)
 SELECT series, idx, {rnd('w', 6)} AS weight, {rnd('w * x + (1 - w) * b', 5)} AS filtered FROM w""")
def transient_filter(spark, sf_dir):
    return rounded(windows.transient_filter(series(spark, sf_dir)), "weight").withColumn("filtered", round_("filtered", 5)).drop("x", "ts")


@query("vital_features", f"""WITH {S_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY idx DESC) AS back, avg(x) OVER w AS m, greatest(stddev_pop(x) OVER w, 1.0) AS noise FROM s WINDOW w AS (PARTITION BY series)),
 l AS (SELECT *, (x - m) / noise AS dev, CASE WHEN abs((x - m) / noise) > 2 THEN 1 ELSE 0 END AS large FROM r WHERE back <= 20),
 g AS (SELECT *, back - sum(large) OVER (PARTITION BY series ORDER BY back) AS grp FROM l),
 runs AS (SELECT series, max(c) AS run FROM (SELECT series, grp, count(*) AS c FROM g WHERE large = 1 GROUP BY 1, 2) GROUP BY 1),
 f AS (SELECT series, max(dev) FILTER (back = 1) AS deviation, CASE WHEN count(*) FILTER (back <= 12) >= 3 THEN regr_slope(x, -back::DOUBLE) FILTER (back <= 12) ELSE 0 END AS slope, count(*) AS n FROM l GROUP BY 1)
 SELECT f.series, {rnd('deviation', 6)} AS deviation, {rnd('slope', 6)} AS slope, {rnd('CASE WHEN n >= 5 THEN coalesce(run, 0) / n ELSE 0 END', 6)} AS persistence FROM f LEFT JOIN runs ON f.series = runs.series""")
def vital_features(spark, sf_dir):
    return rounded(windows.vital_features(series(spark, sf_dir)), "deviation", "slope", "persistence")


@query("last_n_history", "WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) SELECT conv_id, turn, role FROM c WHERE k <= 3")
def last_n_history(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("series"), F.col("turn").alias("idx"), "role")
    return windows.last_n(c, 3).select(F.col("series").alias("conv_id"), F.col("idx").alias("turn"), "role")


@query("subsampled_fill", f"""WITH {S_SQL}, n AS (SELECT series, idx, CASE WHEN idx % 4 = 0 THEN NULL ELSE x END AS x, row_number() OVER (PARTITION BY series ORDER BY idx) - 1 AS k FROM s),
 k AS (SELECT * FROM n WHERE k % 3 = 0)
 SELECT series, idx, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY series ORDER BY idx ROWS UNBOUNDED PRECEDING), first_value(x IGNORE NULLS) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x FROM k""")
def subsampled_fill(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("x", F.when(F.col("idx") % 4 != 0, F.col("x")))
    return windows.subsample(s, 3).drop("ts")


@query("horizon_steps", f"""WITH {S_SQL}, g AS (SELECT series, (epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY series ORDER BY ts, idx)))) / 60 AS g FROM s),
 m AS (SELECT series, median(g) AS m FROM g GROUP BY 1)
 SELECT series, {rnd('m', 4)} AS median_minutes, CAST(greatest(1, floor(360 / nullif(m, 0))) AS INTEGER) AS steps_6h, CAST(greatest(1, floor(1440 / nullif(m, 0))) AS INTEGER) AS steps_24h, CAST(greatest(1, floor(4320 / nullif(m, 0))) AS INTEGER) AS steps_72h FROM m""")
def horizon_steps(spark, sf_dir):
    s = series(spark, sf_dir)
    by_time = s.withColumn("idx", F.struct("ts", "idx"))
    return rounded(windows.horizon_steps(by_time), "median_minutes", digits=4)


_WIDE = f"""{views.SILVER_SQL}, v AS (SELECT patient_id, window_start, avg(metric_value) FILTER (metric_type = 'heart_rate') AS heart_rate, avg(metric_value) FILTER (metric_type = 'spo2') AS spo2, avg(metric_value) FILTER (metric_type = 'hrv') AS hrv, avg(metric_value) FILTER (metric_type = 'stress_index') AS stress, bool_or(is_anomaly) AS is_anomaly FROM silver GROUP BY 1, 2)"""


WIDE_VITALS_SQL = _WIDE


def wide_vitals(spark, sf_dir):
    """Silver with a column per vital and the vitals' mean quality."""
    s = views.silver(spark, sf_dir)
    of = lambda m: F.avg(F.when(F.col("metric_type") == m, F.col("metric_value")))
    return s.groupBy("patient_id", "window_start").agg(of("heart_rate").alias("heart_rate"), of("spo2").alias("spo2"), of("hrv").alias("hrv"), of("stress_index").alias("stress"), F.avg(F.when(F.col("metric_type").isin("heart_rate", "spo2", "hrv", "stress_index"), F.col("quality_score"))).alias("quality_score"), F.bool_or("is_anomaly").alias("is_anomaly"))


@query("risk_series", f"""WITH {_WIDE} SELECT patient_id, window_start, {rnd("0.30::DOUBLE * coalesce(least(1, greatest(0, (heart_rate - 78) / 45)), 0) + 0.30::DOUBLE * coalesce(least(1, greatest(0, (95.5 - spo2) / 10)), 0) + 0.20::DOUBLE * coalesce(least(1, greatest(0, (50 - hrv) / 50)), 0) + 0.10::DOUBLE * coalesce(least(1, greatest(0, stress / 100)), 0) + CASE WHEN is_anomaly THEN 0.10::DOUBLE ELSE 0 END", 6)} AS risk FROM v""", times=["window_start"])
def risk_series(spark, sf_dir):
    return rounded(windows.risk_series(wide_vitals(spark, sf_dir)), "risk").select("patient_id", "window_start", "risk")


@query("sliding_sequences", f"""WITH {S_SQL}, u AS (SELECT series, idx, least(1, x / 100) AS x FROM s),
 r AS (SELECT *, list(x) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS seq, count(x) OVER f AS n,
 max(x) OVER a AS m6, avg(x) OVER a AS a6, max(x) OVER b AS m24, avg(x) OVER b AS a24, max(x) OVER c AS m72, avg(x) OVER c AS a72 FROM u WINDOW f AS (PARTITION BY series ORDER BY idx ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING),
 a AS (PARTITION BY series ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING),
 b AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 3 FOLLOWING AND 5 FOLLOWING),
 c AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 6 FOLLOWING AND 8 FOLLOWING)),
 y AS (SELECT *, m6 > 0.5 AND a6 > 0.38 AS y6, a24 > 0.36 AND m24 > 0.48 AS z24, a72 > 0.34 AND m72 > 0.44 AND seq[8] < 0.3 AS z72 FROM r WHERE len(seq) = 8 AND n = 9)
 SELECT series, idx, {rnd('list_sum(seq)', 5)} AS seq_sum, CAST(y6 AS INTEGER) AS y6, CAST(NOT y6 AND z24 AS INTEGER) AS y24, CAST(NOT y6 AND NOT (NOT y6 AND z24) AND z72 AS INTEGER) AS y72 FROM y""")
def sliding_sequences(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("x", F.least(F.lit(1.0), F.col("x") / 100)).drop("ts")
    q = windows.sequences(s, 8, (3, 6, 9))
    return q.select("series", "idx", round_(F.aggregate("seq", F.lit(0.0), lambda a, v: a + v), 5).alias("seq_sum"), "y6", "y24", "y72")


_RR = "rr AS (SELECT series, idx, least(2500, greatest(200, 60000 / nullif(x, 0))) AS x FROM s)"


@query("hrv_time_domain", f"""WITH {S_SQL}, {_RR}, d AS (SELECT *, x - lag(x) OVER (PARTITION BY series ORDER BY idx) AS d FROM rr WHERE x > 0)
 SELECT series, count(*) AS n, {rnd('stddev_samp(x)', 5)} AS sdnn, {rnd('sqrt(avg(d * d))', 5)} AS rmssd, {rnd('100.0 * count(*) FILTER (abs(d) > 50) / count(d)', 5)} AS pnn50, {rnd('avg(x)', 5)} AS mean_rr, {rnd('max(x) - min(x)', 5)} AS range_rr, {rnd('60000 / avg(x)', 5)} AS mean_hr FROM d GROUP BY 1""")
def hrv_time_domain(spark, sf_dir):
    rr = series(spark, sf_dir).withColumn("x", windows.rr_from_rate(F.col("x")))
    return rounded(windows.hrv_time_domain(rr), "sdnn", "rmssd", "pnn50", "mean_rr", "range_rr", "mean_hr", digits=5).drop("min_rr", "max_rr")


@query("chunk_profile", f"""WITH {S_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY idx) - 1 AS k, count(*) OVER (PARTITION BY series) AS n FROM s),
 c AS (SELECT series, scale, k // scale AS c, max(x) - min(x) AS p, count(*) AS m FROM k, (VALUES (4), (8), (16)) v(scale) WHERE n >= 2 * scale GROUP BY 1, 2, 3)
 SELECT series, scale, {rnd('avg(p)', 6)} AS mean_p2p FROM c WHERE m = scale GROUP BY 1, 2""")
def chunk_profile(spark, sf_dir):
    return rounded(windows.chunk_profile(series(spark, sf_dir)), "mean_p2p")


@query(
    "blended_smooth",
    f"""WITH {S_SQL}, p AS (SELECT series, idx, x, row_number() OVER o - 1 AS k, count(*) OVER w AS n, list(x) OVER w AS l FROM s WINDOW w AS (PARTITION BY series),
 o AS (PARTITION BY series ORDER BY idx)),
 q AS (SELECT p.*, f.x AS a, e.x AS z FROM p JOIN p f ON f.series = p.series AND f.k = 0 JOIN p e ON e.series = p.series AND e.k = e.n - 1),
 m AS (SELECT *, sum(x) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) + greatest(0, 4 - k) * a + greatest(0, k + 4 - n) * z AS total FROM q)
 SELECT series, idx, {rnd('CASE WHEN n < 8 THEN x ELSE 0.5 * total / 8 + 0.5 * x END', 5)} AS y FROM m""",
)
def blended_smooth(spark, sf_dir):
    return rounded(windows.blended_smooth(series(spark, sf_dir)), "y", digits=5).drop("x", "ts")


@query(
    "hrv_summary",
    f"""WITH {S_SQL}, {_RR}, d AS (SELECT series, x, x - lag(x) OVER (PARTITION BY series ORDER BY idx) AS d FROM rr WHERE x > 0)
 SELECT series, {rnd('avg(x)', 2)} AS mean_rr_ms, {rnd('coalesce(stddev_samp(x), 0)', 2)} AS sdnn_ms, {rnd('coalesce(sqrt(avg(d * d)), 0)', 2)} AS rmssd_ms, count(*) AS n_intervals FROM d GROUP BY 1""",
)
def hrv_summary(spark, sf_dir):
    return windows.short_summary(hrv.real_intervals(beats(spark, sf_dir)))


@query("katz_dimension", f"""WITH {S_SQL}, d AS (SELECT series, abs(x - lag(x) OVER w) AS s, abs(x - first_value(x) OVER w) AS far FROM s WINDOW w AS (PARTITION BY series ORDER BY idx)),
 g AS (SELECT series, sum(s) AS l, max(far) AS d, count(s) AS n FROM d GROUP BY 1)
 SELECT series, {rnd('CASE WHEN n < 2 OR d <= 0 OR l <= 0 THEN 1 ELSE least(2, greatest(1, abs(log10(n) / (log10(n) + log10(d / l))))) END', 6)} AS katz FROM g""")
def katz_dimension(spark, sf_dir):
    return rounded(windows.katz_dimension(series(spark, sf_dir)), "katz")


@query(
    "higuchi_dimension",
    f"""WITH {S_SQL}, b AS (SELECT series, x, row_number() OVER (PARTITION BY series ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM s),
 d AS (SELECT b.series, b.n, k, b.i % k AS m, sum(abs(b.x - e.x)) AS d, count(*) AS c FROM b, (SELECT unnest(range(1, 11)) AS k), b e WHERE e.series = b.series AND e.i = b.i - k GROUP BY 1, 2, 3, 4),
 p AS (SELECT series, n, k, avg(d * (n - 1) / (c * k * k)) AS l FROM d GROUP BY 1, 2, 3 HAVING avg(d * (n - 1) / (c * k * k)) > 0),
 g AS (SELECT series, n, regr_slope(ln(l), ln(1.0::DOUBLE / k)) AS s FROM p GROUP BY 1, 2)
 SELECT series, {rnd('CASE WHEN n < 20 THEN 1 ELSE least(2, greatest(1, coalesce(s, 1))) END', 6)} AS higuchi FROM g""",
)
def higuchi_dimension(spark, sf_dir):
    return rounded(windows.higuchi_dimension(series(spark, sf_dir)), "higuchi")


def timed(spark, sf_dir):
    """Events with their time in days."""
    return series(spark, sf_dir).select("series", "idx", "x", (F.unix_seconds("ts") / 86400.0).alias("t"))


@query(
    "lomb_scargle",
    f"""WITH {S_SQL}, c AS (SELECT series, f, 2 * 3.141592653589793::DOUBLE * f * (epoch(date_trunc('second', ts)) / 86400.0::DOUBLE) AS w, x - avg(x) OVER (PARTITION BY series, f) AS x
  FROM s, (SELECT unnest(range(1, 17)) / 16.0::DOUBLE AS f)),
 p AS (SELECT series, f, atan2(sum(sin(2 * w)), sum(cos(2 * w))) / 2 AS phase FROM c GROUP BY 1, 2),
 q AS (SELECT c.series, c.f, x, cos(w - phase) AS c, sin(w - phase) AS s FROM c JOIN p ON p.series = c.series AND p.f = c.f)
 SELECT series, f, {rnd('0.5 * (sum(x * c) ** 2 / sum(c * c) + sum(x * s) ** 2 / sum(s * s))', 3)} AS power FROM q GROUP BY 1, 2""",
)
def lomb_scargle(spark, sf_dir):
    freq = spark.range(1, 17).select((F.col("id") / 16.0).alias("f"))
    return rounded(windows.lomb_scargle(timed(spark, sf_dir), freq), "power", digits=3)


def beats(spark, sf_dir):
    """Events as R-R intervals."""
    return series(spark, sf_dir).select("series", "idx", windows.rr_from_rate(F.col("x")).alias("x"))


@query(
    "hrv_entropies",
    f"""WITH {S_SQL}, r AS (SELECT series, idx, least(2500, greatest(200, 60000 / nullif(x, 0))) AS x FROM s), k AS (SELECT * FROM r WHERE x > 0),
 t AS (SELECT series, idx, x AS x0, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, 0.2::DOUBLE * stddev_samp(x) OVER w AS tol, count(*) OVER w AS n FROM k WINDOW w AS (PARTITION BY series),
 o AS (PARTITION BY series ORDER BY idx)),
 u AS (SELECT * FROM t WHERE n >= 4 AND tol > 2e-11 AND x1 IS NOT NULL),
 p AS (SELECT a.series, a.idx, any_value(a.n) AS n, count(*) AS c, count(*) FILTER (abs(a.x2 - b.x2) <= a.tol) AS d, count(*) FILTER (a.idx <> b.idx AND a.x2 IS NOT NULL AND b.x2 IS NOT NULL) AS q,
   count(*) FILTER (a.idx <> b.idx AND abs(a.x2 - b.x2) <= a.tol) AS r FROM u a JOIN u b ON a.series = b.series AND abs(a.x0 - b.x0) <= a.tol AND abs(a.x1 - b.x1) <= a.tol GROUP BY 1, 2),
 g AS (SELECT series, sum(ln(c / (n - 1))) / any_value(n - 1) - coalesce(sum(ln(d / (n - 2))) FILTER (d > 0), 0) / any_value(n - 2) AS apen, sum(q) AS b, sum(r) AS a FROM p GROUP BY 1)
 SELECT series, {rnd('apen', 6)} AS approximate_entropy, CASE WHEN a > 0 THEN {rnd('-ln(a / b)', 6)} END AS sample_entropy FROM g""",
)
def hrv_entropies(spark, sf_dir):
    """Entropies of every series; an infinite sample entropy is null here."""
    e = hrv.entropies(beats(spark, sf_dir)).withColumn("sample_entropy", F.when(F.col("sample_entropy") < float("inf"), F.col("sample_entropy")))
    return rounded(e, "approximate_entropy", "sample_entropy")


@query("hrv_report")
def hrv_report(spark, sf_dir):
    """Time domain, bands, entropies and oscillation of every series."""
    return hrv.report(beats(spark, sf_dir))


@query("hrv_bands_even")
def hrv_bands_even(spark, sf_dir):
    """Bands of the evenly resampled series."""
    return hrv.band_powers(hrv.even_spectrum(beats(spark, sf_dir)))


@query("sample_entropy", f"""WITH {S_SQL}, t AS (SELECT series, idx, x AS x0, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, 0.2 * stddev_pop(x) OVER (PARTITION BY series) AS r FROM s WINDOW o AS (PARTITION BY series ORDER BY idx)),
 k AS (SELECT * FROM t WHERE x2 IS NOT NULL AND r > 0),
 p AS (SELECT a.series, count(*) AS b, count(*) FILTER (abs(a.x2 - c.x2) <= a.r) AS a FROM k a JOIN k c ON a.series = c.series AND a.idx < c.idx AND abs(a.x0 - c.x0) <= a.r AND abs(a.x1 - c.x1) <= a.r GROUP BY 1)
 SELECT series, {rnd('CASE WHEN a > 0 THEN -ln(a / b) END', 6)} AS sampen FROM p""")
def sample_entropy(spark, sf_dir):
    return rounded(windows.sample_entropy(series(spark, sf_dir)), "sampen")


@query("ewma_zscore", f"""WITH RECURSIVE {S_SQL}, o AS (SELECT series, idx, x, row_number() OVER (PARTITION BY series ORDER BY idx) AS k FROM s),
 r AS (SELECT series, idx, k, x AS mean, 0.0::DOUBLE AS var, 0.0::DOUBLE AS z FROM o WHERE k = 1

 UNION ALL SELECT o.series, o.idx, o.k, a * o.x + (1 - a) * r.mean, a * (o.x - (a * o.x + (1 - a) * r.mean)) ** 2 + (1 - a) * r.var, coalesce((o.x - (a * o.x + (1 - a) * r.mean)) / nullif(sqrt(a * (o.x - (a * o.x + (1 - a) * r.mean)) ** 2 + (1 - a) * r.var), 0), 0) FROM r JOIN o ON o.series = r.series AND o.k = r.k + 1, (SELECT 2.0::DOUBLE / 21 AS a))
 SELECT series, idx, {rnd('z', 5)} AS z, abs(z) > 3 AS alarm FROM r""")
def ewma_zscore(spark, sf_dir):
    return rounded(recursive.ewma_zscore(series(spark, sf_dir).drop("ts")), "z", digits=5).drop("x")


@query("ewma_baseline", f"""WITH RECURSIVE {S_SQL}, o AS (SELECT series, idx, x, row_number() OVER (PARTITION BY series ORDER BY idx) AS k FROM s),
 r AS (SELECT series, idx, k, x AS b FROM o WHERE k = 1
 UNION ALL SELECT o.series, o.idx, o.k, 0.05::DOUBLE * o.x + 0.95::DOUBLE * r.b FROM r JOIN o ON o.series = r.series AND o.k = r.k + 1)
 SELECT series, idx, {rnd('b', 5)} AS baseline FROM r""")
def ewma_baseline(spark, sf_dir):
    return rounded(recursive.ewma_baseline(series(spark, sf_dir).drop("ts")), "baseline", digits=5).drop("x")


@query(
    "hampel_filter",
    f"""WITH RECURSIVE {S_SQL}, o AS (SELECT series, idx, x, row_number() OVER w AS k, list(x) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS ahead FROM s WINDOW w AS (PARTITION BY series ORDER BY idx)),
 r AS (SELECT DISTINCT series, 0::BIGINT AS k, []::DOUBLE[] AS prev, NULL::DOUBLE AS y, false AS odd FROM o UNION ALL
  SELECT series, k, list_slice(list_append(prev, z), -3, -1), z, z IS DISTINCT FROM x FROM (SELECT *, CASE WHEN mad >= 1e-6 AND abs(x - mid) > 3 * 1.4826::DOUBLE * mad THEN mid ELSE x END AS z FROM
   (SELECT *, list_median(list_transform(near, lambda v: abs(v - mid))) AS mad FROM (SELECT o.series, o.k, o.x, r.prev, list_concat(r.prev, o.ahead) AS near, list_median(list_concat(r.prev, o.ahead)) AS mid FROM r JOIN o ON o.series = r.series AND o.k = r.k + 1))))
 SELECT o.series, o.idx, o.x, r.y AS filtered, r.odd AS is_artifact FROM r JOIN o ON o.series = r.series AND o.k = r.k""",
)
def hampel_filter(spark, sf_dir):
    return chunks.hampel_rows(series(spark, sf_dir).drop("ts"))


@query("denoise_signal")
def denoise_signal(spark, sf_dir):
    d = chunks.denoise_rows(series(spark, sf_dir).drop("ts"))
    return d.groupBy("series").agg(F.count("*").alias("n"), F.stddev_pop("residual").alias("noise"), F.avg(F.col("is_artifact").cast("double")).alias("artifact_ratio"), F.max_by("filtered", "idx").alias("last_filtered")).withColumn("quality", F.greatest(F.lit(0.0), 1 - 2 * F.col("artifact_ratio")))


@query("window_fusion", f"""{views.FUSED_SQL} SELECT series, w AS "window", {rnd('fused', 6)} AS fused, {rnd('variance', 6)} AS variance, n_sensors FROM r WHERE k > 0""")
def window_fusion(spark, sf_dir):
    b = views.bronze(spark, sf_dir).where("metric_type = 'heart_rate'")
    r = b.groupBy(F.col("patient_id").alias("series"), F.floor(F.unix_seconds("timestamp_utc") / views.WINDOW).alias("window"), F.col("device_id").alias("sensor")).agg(F.max_by("metric_value", F.struct("timestamp_utc", "event_id")).alias("x"))
    return rounded(recursive.fuse_windows(r), "fused", "variance")


@query("blue_fusion")
def blue_fusion(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    s = e.select(F.col("label").cast("string").alias("series"), F.col("vec_id").alias("idx"), *(F.col("embedding")[k].cast("double").alias(f"s{k}") for k in range(4)))
    return recursive.blue_fusion(s, ["s0", "s1", "s2", "s3"])


@query("latent_states")
def latent_states(spark, sf_dir):
    return recursive.latent_states(latent_input(spark, sf_dir))


def latent_input(spark, sf_dir):
    """Windows of each patient with the observations of the latent model; a step of t is one window."""
    at = F.unix_seconds("window_start")
    v = wide_vitals(spark, sf_dir)
    return v.select(F.col("patient_id").alias("series"), at.alias("idx"), (at / float(views.WINDOW)).alias("t"), "heart_rate", F.col("hrv").alias("hrv_rmssd"))


@query("latent_report")
def latent_report(spark, sf_dir):
    """State report of the newest window of each patient, with 90 % bounds."""
    return recursive.state_report(recursive.latent_states(latent_input(spark, sf_dir), level=0.9))


@query("chaos_metrics")
def chaos_metrics(spark, sf_dir):
    return recursive.chaos_metrics(series(spark, sf_dir))


@query("signal_decomposition")
def signal_decomposition(spark, sf_dir):
    return recursive.split_trend(series(spark, sf_dir).drop("ts"))


def lattice(spark, sf_dir):
    """part as fields on a grid: one field per size, nodes by key."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    price = F.col("p_retailprice").cast("double")
    node = p.groupBy(F.concat(F.lit("F"), (k % 3).cast("string")).alias("field_id"), F.floor(k / 3 % 8).cast("long").alias("i"), F.floor(k / 24 % 8).cast("long").alias("j"), F.floor(k / 192 % 4).cast("long").alias("k"))
    return node.agg((F.avg(price) / 10).alias("p"), (F.max(price) / 10).alias("fx"), (F.min(price) / 10).alias("fy"), (F.count("*") * 1.0).cast("double").alias("fz")).withColumn("spacing", F.lit(0.5))


def _d(v: str, axis: str) -> str:
    w = f"(PARTITION BY field_id, {', '.join(a for a in 'ijk' if a != axis)} ORDER BY {axis})"
    at = lambda d: f"lead({v}, {d}) OVER {w}" if d > 0 else f"lag({v}, {-d}) OVER {w}"
    return f"coalesce(CASE WHEN {at(-1)} IS NULL THEN CASE WHEN {at(2)} IS NOT NULL THEN (-3 * {v} + 4 * {at(1)} - {at(2)}) / 1.0 ELSE ({at(1)} - {v}) / 0.5 END WHEN {at(1)} IS NULL THEN CASE WHEN {at(-2)} IS NOT NULL THEN (3 * {v} - 4 * {at(-1)} + {at(-2)}) / 1.0 ELSE ({v} - {at(-1)}) / 0.5 END ELSE ({at(1)} - {at(-1)}) / 1.0 END, 0)"


GRID_SQL = f"""f AS (SELECT 'F' || (p_partkey % 3) AS field_id, (p_partkey // 3) % 8 AS i, (p_partkey // 24) % 8 AS j, (p_partkey // 192) % 4 AS k, avg(p_retailprice::DOUBLE) / 10 AS p, max(p_retailprice::DOUBLE) / 10 AS fx, min(p_retailprice::DOUBLE) / 10 AS fy, count(*)::DOUBLE AS fz FROM part GROUP BY 1, 2, 3, 4),
 g AS (SELECT field_id, i, j, k, sqrt(gx * gx + gy * gy + gz * gz) AS gradient, dx + dy + dz AS divergence, sqrt(cx * cx + cy * cy + cz * cz) AS curl FROM (SELECT *, {_d('p', 'i')} AS gx, {_d('p', 'j')} AS gy, {_d('p', 'k')} AS gz, {_d('fx', 'i')} AS dx, {_d('fy', 'j')} AS dy, {_d('fz', 'k')} AS dz,
 {_d('fz', 'j')} - {_d('fy', 'k')} AS cx, {_d('fx', 'k')} - {_d('fz', 'i')} AS cy, {_d('fy', 'i')} - {_d('fx', 'j')} AS cz FROM f))"""


@query("grid_operators", f"WITH {GRID_SQL} SELECT field_id, i, j, k, {rnd('gradient', 5)} AS gradient, {rnd('divergence', 5)} AS divergence, {rnd('curl', 5)} AS curl FROM g")
def grid_operators(spark, sf_dir):
    g = grid.operators(lattice(spark, sf_dir)).select("field_id", "i", "j", "k", "gradient", "divergence", "curl")
    return rounded(g, "gradient", "divergence", "curl", digits=5)


@query("flow_irregularities", f"""WITH {GRID_SQL}, l AS (SELECT field_id, i, j, k, 'gradient' AS operator, gradient AS value FROM g
 UNION ALL SELECT field_id, i, j, k, 'divergence', divergence FROM g
 UNION ALL SELECT field_id, i, j, k, 'curl', curl FROM g),
 h AS (SELECT *, row_number() OVER (PARTITION BY field_id, operator ORDER BY {rnd('abs(value)', 6)} DESC, i, j, k) AS nth FROM l),
 t AS (SELECT *, CASE WHEN operator = 'gradient' AND value >= 8 THEN 8.0 WHEN operator = 'divergence' AND value >= 15 THEN 15.0 WHEN operator = 'divergence' AND value <= -12 THEN -12.0 WHEN operator = 'curl' AND value >= 20 THEN 20.0 END AS threshold FROM h WHERE nth <= 2 AND value <> 0)
 SELECT field_id, operator, {rnd('value', 5)} AS value, nth, CAST(threshold AS DOUBLE) AS threshold, CASE WHEN abs(value) >= 1.5 * abs(threshold) THEN 'high' ELSE 'moderate' END AS severity FROM t WHERE threshold IS NOT NULL""")
def flow_irregularities(spark, sf_dir):
    return rounded(grid.irregularities(grid.operators(lattice(spark, sf_dir))), "value", digits=5).select("field_id", "operator", "value", "nth", "threshold", "severity")


@query("flow_summary", f"""WITH {GRID_SQL}, l AS (SELECT field_id, 'gradient' AS operator, gradient AS value FROM g
 UNION ALL SELECT field_id, 'divergence', divergence FROM g
 UNION ALL SELECT field_id, 'curl', curl FROM g),
 h AS (SELECT *, row_number() OVER (PARTITION BY field_id, operator ORDER BY abs(value) DESC) AS nth FROM l),
 n AS (SELECT field_id, count(*) AS n FROM h WHERE nth <= 2 AND ((operator = 'gradient' AND value >= 8) OR (operator = 'divergence' AND (value >= 15 OR value <= -12)) OR (operator = 'curl' AND value >= 20)) GROUP BY 1),
 e AS (SELECT field_id, max(gradient) AS a, min(divergence) AS b, max(divergence) AS c, max(curl) AS d FROM g GROUP BY 1)
 SELECT e.field_id, {rnd('a', 5)} AS gradient_max, {rnd('b', 5)} AS divergence_min, {rnd('c', 5)} AS divergence_max, {rnd('d', 5)} AS curl_max, coalesce(n, 0) AS irregularities, {rnd('least(1.0, coalesce(n, 0) / 6)', 6)} AS flow_score FROM e LEFT JOIN n ON e.field_id = n.field_id""")
def flow_summary(spark, sf_dir):
    nodes = grid.operators(lattice(spark, sf_dir))
    return rounded(grid.flow_summary(nodes, grid.irregularities(nodes)), "gradient_max", "divergence_min", "divergence_max", "curl_max", digits=5).withColumn("flow_score", round_("flow_score", 6))


_FOUND_SQL = f"""{GRID_SQL}, l AS (SELECT field_id, i, j, k, 'gradient' AS operator, gradient AS value FROM g
 UNION ALL SELECT field_id, i, j, k, 'divergence', divergence FROM g
 UNION ALL SELECT field_id, i, j, k, 'curl', curl FROM g),
 h AS (SELECT *, row_number() OVER (PARTITION BY field_id, operator ORDER BY {rnd('abs(value)', 6)} DESC, i, j, k) AS nth FROM l),
 found AS (SELECT * FROM h WHERE nth <= 2 AND ((operator = 'gradient' AND value >= 8) OR (operator = 'divergence' AND (value >= 15 OR value <= -12)) OR (operator = 'curl' AND value >= 20)))"""
FLOW_DOMAINS_SQL = f"""WITH {_FOUND_SQL} SELECT field_id, {rnd('least(1, count(*) * 0.25::DOUBLE)', 6)} AS cardiovascular, {rnd("least(1, 0.2::DOUBLE * count(*) FILTER (operator <> 'curl'))", 6)} AS monitoring,
  {rnd("least(1, 0.3::DOUBLE * count(*) FILTER (operator = 'curl'))", 6)} AS imaging FROM found GROUP BY 1"""


@query(
    "flow_alerts",
    f"""WITH {_FOUND_SQL}, t AS (SELECT *, CASE WHEN operator = 'gradient' THEN 'pressure_gradient' WHEN operator = 'curl' THEN 'vorticity' WHEN value > 0 THEN 'flow_source' ELSE 'flow_sink' END AS type FROM found),
 a AS (SELECT *, row_number() OVER (PARTITION BY field_id, type ORDER BY nth, i, j, k) AS q, CASE type WHEN 'pressure_gradient' THEN 8.0::DOUBLE WHEN 'vorticity' THEN 20 WHEN 'flow_source' THEN 15 ELSE -12 END AS threshold FROM t)
 SELECT field_id, type, CASE type WHEN 'pressure_gradient' THEN 'blood_pressure' WHEN 'vorticity' THEN 'hrv' ELSE 'heart_rate' END AS metric_type, CASE WHEN abs(value) >= 1.5 * abs(threshold) THEN 'high' ELSE 'moderate' END AS severity, threshold,
  0.0::DOUBLE AS duration_minutes, operator || ' beyond ' || CASE type WHEN 'pressure_gradient' THEN '8.0' WHEN 'vorticity' THEN '20.0' WHEN 'flow_source' THEN '15.0' ELSE '-12.0' END AS description FROM a WHERE q = 1""",
)
def flow_alerts(spark, sf_dir):
    text = spark.createDataFrame([(t, f"{o} beyond {v}") for t, o, _, v in grid.IRREGULAR], "type string, description string")
    return grid.flow_alerts(grid.irregularities(grid.operators(lattice(spark, sf_dir))), text)


@query("image_oscillation", f"""WITH im AS (SELECT label AS image_id, vec_id // 10 AS r, k - 1 AS c, embedding[k]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS k) WHERE vec_id % 10 = label),
 q AS (SELECT a.image_id, a.r, a.c, any_value(a.v) AS v, list(b.v) AS l FROM im a JOIN im b ON a.image_id = b.image_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY 1, 2, 3)
 SELECT image_id, r, c, {rnd('v', 6)} AS v, {rnd('list_avg(list_transform(l, lambda x: abs(x - list_avg(l))))', 6)} AS mo, {rnd('list_avg(l)', 6)} AS smooth FROM q""")
def image_oscillation(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings").where("vec_id % 10 = label")
    im = e.select(F.col("label").alias("image_id"), F.floor(F.col("vec_id") / 10).alias("r"), F.posexplode("embedding").alias("c", "v")).withColumn("v", F.col("v").cast("double"))
    return rounded(grid.image_oscillation(im), "v", "mo", "smooth")


_MIRROR = "CASE WHEN {0} + {1} < 0 THEN -1 - {0} - {1} WHEN {0} + {1} >= {2} THEN 2 * {2} - 1 - {0} - {1} ELSE {0} + {1} END"


@query(
    "image_denoise",
    f"""WITH im AS (SELECT label AS image_id, CAST(row_number() OVER (PARTITION BY label, k ORDER BY vec_id) - 1 AS BIGINT) AS r, CAST(k - 1 AS BIGINT) AS c, embedding[k]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS k)),
 sz AS (SELECT image_id, max(r) + 1 AS rows FROM im GROUP BY 1), d AS (SELECT a.d AS dr, b.d AS dc FROM (SELECT unnest(range(-2, 3)) AS d) a, (SELECT unnest(range(-2, 3)) AS d) b),
 t AS (SELECT image_id, r, c, v, dr, dc, {_MIRROR.format('r', 'dr', 'rows')} AS mr, {_MIRROR.format('c', 'dc', '64')} AS mc, r + dr BETWEEN 0 AND rows - 1 AND c + dc BETWEEN 0 AND 63 AS inside FROM im JOIN sz USING (image_id), d),
 p AS (SELECT t.image_id, t.r, t.c, any_value(t.v) AS v, sum(o.v) / 25 AS smooth, list(o.v) FILTER (t.inside) AS l FROM t JOIN im o ON o.image_id = t.image_id AND o.r = t.mr AND o.c = t.mc GROUP BY 1, 2, 3),
 m AS (SELECT *, list_avg(list_transform(l, lambda x: abs(x - list_avg(l)))) AS mo FROM p), w AS (SELECT image_id, avg(mo) AS a, stddev_pop(mo) AS s FROM m GROUP BY 1),
 e AS (SELECT m.*, 1 / (1 + exp(-(mo - a) / (0.5 * s + 1e-8))) AS g, s FROM m JOIN w USING (image_id))
 SELECT image_id, r, c, {rnd('CASE WHEN s < 1e-8 THEN v ELSE g * v + (1 - g) * smooth END', 5)} AS denoised FROM e""",
)
def image_denoise(spark, sf_dir):
    """Every vector is a row of its label's image."""
    rows = grid.image_rows(read_table(spark, sf_dir, "embeddings"), "label", "vec_id")
    pixels = rows.select("image_id", "r", F.posexplode("row").alias("c", "v")).select("image_id", "r", F.col("c").cast("long").alias("c"), F.col("v").cast("double").alias("v"))
    return rounded(grid.image_denoise(pixels), "denoised", digits=5).select("image_id", "r", "c", "denoised")


@query("image_oscillation_all")
def image_oscillation_all(spark, sf_dir):
    """Every vector is a row of its label's image; image_oscillation keeps the part its SQL names."""
    return rounded(grid.row_oscillation(grid.image_rows(read_table(spark, sf_dir, "embeddings"), "label", "vec_id")), "v", "mo", "smooth")
