"""Queries of the models and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulselake.functions.scalar import rnd as round_
from pulselake.ml import detectors, models, quantiles
from pulselake.plans import views
from pulselake.plans.base import Registry
from pulselake.plans.text_queries import _TOK as TOKENS_SQL
from pulselake.plans.views import rnd
from pulselake.session import Scratch, read_table
from pulselake.text.corpus import tokens, top_tokens

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def measures(spark, sf_dir):
    """Per order: four measures."""
    li = read_table(spark, sf_dir, "lineitem")
    d = lambda c: F.col(c).cast("double")
    return li.groupBy(F.col("l_orderkey").alias("id")).agg(F.sum(d("l_quantity")).alias("q"), F.avg(d("l_discount")).alias("d"), F.avg(d("l_tax")).alias("t"), F.count("*").cast("double").alias("n"))


M_SQL = "m AS (SELECT l_orderkey AS id, sum(l_quantity::DOUBLE) AS q, avg(l_discount::DOUBLE) AS d, avg(l_tax::DOUBLE) AS t, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1)"


@query("mahalanobis", f"""WITH {M_SQL}, s AS (SELECT avg(q) AS mq, avg(n) AS mn, var_samp(q) AS a, covar_samp(q, n) AS b, var_samp(n) AS c FROM m),
 x AS (SELECT id, sqrt((c * (q - mq) * (q - mq) - 2 * b * (q - mq) * (n - mn) + a * (n - mn) * (n - mn)) / (a * c - b * b)) AS dist FROM m, s)
 SELECT id, {rnd('dist', 5)} AS distance, {rnd('exp(-dist * dist / 2)', 6)} AS p_value, exp(-dist * dist / 2) < 0.01 AS is_anomaly FROM x""")
def mahalanobis(spark, sf_dir):
    m = measures(spark, sf_dir)
    mean, inverse = models.mahalanobis_fit(m, ["q", "n"])
    s = m.withColumn("dist", models.mahalanobis_score(["q", "n"], mean, inverse))
    p = models.chi2_tail_even(F.col("dist") * F.col("dist"), 2)
    return s.select("id", round_("dist", 5).alias("distance"), round_(p, 6).alias("p_value"), (p < 0.01).alias("is_anomaly"))


@query("fisher_ensemble", f"""WITH {M_SQL}, z AS (SELECT id, exp(-greatest(q / 50, 0)) AS p1, exp(-greatest(n / 2, 0)) AS p2 FROM m),
 f AS (SELECT id, -2 * ln(greatest(p1, 1e-300)) - 2 * ln(greatest(p2, 1e-300)) AS st FROM z),
 p AS (SELECT id, st, least(1, exp(-st / 2) * (1 + st / 2)) AS p FROM f)
 SELECT id, {rnd('st', 5)} AS statistic, {rnd('p', 6)} AS p, CASE WHEN p < 0.001 THEN 'critical' WHEN p < 0.01 THEN 'high' WHEN p < 0.05 THEN 'moderate' ELSE 'normal' END AS severity FROM p""")
def fisher_ensemble(spark, sf_dir):
    e = models.ensemble(measures(spark, sf_dir), {"quantity": lambda: (F.col("q") / 50, None), "lines": lambda: (F.col("n") / 2, None)})
    return e.select("id", round_("anomaly_statistic", 5).alias("statistic"), round_("anomaly_p", 6).alias("p"), F.col("anomaly_severity").alias("severity"))


def scored_labels(spark, sf_dir):
    """Labels with a pseudo probability per horizon, out of document length."""
    d = read_table(spark, sf_dir, "documents").join(read_table(spark, sf_dir, "labels"), "doc_id")
    p = F.least(F.lit(1.0), F.col("n_chars") / 4000.0)
    return d.select("doc_id", F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), (p * (0.5 + h / 144)).alias("prob")) for h in (6, 24, 72)))).alias("s"), F.col("toxic").cast("double").alias("label")).select("doc_id", "s.horizon", "s.prob", "label")


L_SQL = "l AS (SELECT doc_id, h AS horizon, least(1.0::DOUBLE, n_chars / 4000.0::DOUBLE) * (0.5::DOUBLE + h::DOUBLE / 144) AS prob, toxic::DOUBLE AS label FROM documents JOIN labels USING (doc_id), (VALUES (6), (24), (72)) v(h))"
_COUNTS = lambda op: f"count(*) FILTER (label = 1 AND prob {op} threshold) AS tp, count(*) FILTER (label = 0 AND NOT prob {op} threshold) AS tn, count(*) FILTER (label = 0 AND prob {op} threshold) AS fp, count(*) FILTER (label = 1 AND NOT prob {op} threshold) AS fn"
_T_SQL = f"{L_SQL}, c AS (SELECT horizon, avg(label) AS pv, quantile_cont(prob, list_transform(range(0, 1001), lambda k: k / 1000)) AS q FROM l GROUP BY 1), t AS (SELECT horizon, greatest(0.15::DOUBLE, least(0.85::DOUBLE, q[CAST(round((1 - pv) * 1000) AS INTEGER) + 1])) AS threshold FROM c)"


_RATIOS = f"""{rnd('coalesce(tp / nullif(tp + fn, 0), 0)', 6)} AS sensitivity, {rnd('coalesce(tn / nullif(tn + fp, 0), 0)', 6)} AS specificity, {rnd('coalesce(tp / nullif(tp + fp, 0), 0)', 6)} AS ppv, {rnd('coalesce(tn / nullif(tn + fn, 0), 0)', 6)} AS npv, {rnd('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 6)} AS f1"""


def _metrics_sql(op: str) -> str:
    return f"""WITH {_T_SQL}, g AS (SELECT horizon, {rnd('any_value(threshold)', 6)} AS threshold, {_COUNTS(op)} FROM l JOIN t USING (horizon) GROUP BY 1)
 SELECT *, {_RATIOS} FROM g"""


VALIDATION_SQL = f"""WITH {_T_SQL}, g AS (SELECT horizon, any_value(threshold) AS threshold, {_COUNTS('>=')}, count(*) AS n, CAST(sum(label) AS BIGINT) AS events FROM l JOIN t USING (horizon) GROUP BY 1), e AS (SELECT *, {_RATIOS} FROM g)
 SELECT horizon, {rnd('threshold', 6)} AS threshold, sensitivity, specificity, ppv, npv, f1, n AS "rows", events FROM e UNION ALL
 SELECT 0, {rnd('avg(threshold)', 6)}, {', '.join(rnd(f'avg({c})', 6) for c in ('sensitivity', 'specificity', 'ppv', 'npv', 'f1'))}, CAST(sum(n) AS BIGINT), CAST(sum(events) AS BIGINT) FROM e"""


@query("clinical_metrics", _metrics_sql(">="))
def clinical_metrics(spark, sf_dir):
    return models.threshold_metrics(scored_labels(spark, sf_dir)).withColumn("threshold", round_("threshold", 6))


@query("threshold_metrics", _metrics_sql(">"))
def threshold_metrics(spark, sf_dir):
    return models.threshold_metrics(scored_labels(spark, sf_dir), inclusive=False).withColumn("threshold", round_("threshold", 6))


@query("classifier_report", """WITH p AS (SELECT quality AS l, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p FROM documents JOIN labels USING (doc_id)), c AS (SELECT l AS c FROM p UNION SELECT p FROM p), g AS (SELECT c, count(*) FILTER (l = c AND p = c) AS tp, count(*) FILTER (l = c) AS support, count(*) FILTER (p = c) AS predicted FROM c, p GROUP BY 1)
 SELECT c::DOUBLE AS class, floor(coalesce(tp / nullif(predicted, 0), 0) * 1000000 + 0.5 + 1e-7) / 1000000.0 AS precision, floor(coalesce(tp / nullif(support, 0), 0) * 1000000 + 0.5 + 1e-7) / 1000000.0 AS recall, floor(coalesce(2 * tp / nullif(support + predicted, 0), 0) * 1000000 + 0.5 + 1e-7) / 1000000.0 AS f1, support FROM g""")
def classifier_report(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").join(read_table(spark, sf_dir, "labels"), "doc_id")
    return models.classifier_report(d.select(F.col("quality").alias("label"), (F.col("n_chars") > 1000).cast("int").alias("prediction")))


@query("conformal", f"""WITH {L_SQL}, s AS (SELECT horizon, CASE WHEN label >= 0.5 THEN 1 - prob ELSE prob END AS score FROM l),
 q AS (SELECT horizon, count(*) AS n, quantile_cont(score, 0.5) AS med FROM s GROUP BY 1),
 r AS (SELECT s.horizon, score, row_number() OVER (PARTITION BY s.horizon ORDER BY score) - 1 AS nth, n, least(1, ceil((n + 1) * 0.9::DOUBLE) / n) * (n - 1) AS a FROM s JOIN q ON q.horizon = s.horizon),
 h AS (SELECT horizon, sum(CASE WHEN nth = floor(a) THEN score * (1 - (a - floor(a))) WHEN nth = floor(a) + 1 THEN score * (a - floor(a)) ELSE 0 END) AS q_hat, count(*) AS n FROM r GROUP BY 1)
 SELECT h.horizon, {rnd('any_value(q_hat)', 6)} AS q_hat, any_value(n) AS n, {rnd('avg(CASE WHEN score <= q_hat + 1e-12 THEN 1.0 ELSE 0.0 END)', 6)} AS coverage FROM h JOIN s ON s.horizon = h.horizon GROUP BY 1""")
def conformal(spark, sf_dir):
    c = models.conformal_fit(scored_labels(spark, sf_dir))
    return c.withColumns({"q_hat": round_("q_hat", 6), "coverage": round_("coverage", 6)})


@query("platt_calibration")
def platt_calibration(spark, sf_dir):
    rows = scored_labels(spark, sf_dir).where("horizon = 24")
    a, b = models.platt_fit(rows, "prob", "label")
    return rows.select("doc_id", models.platt(F.col("prob"), a, b).alias("calibrated"))


@query("isolation_forest")
def isolation_forest(spark, sf_dir):
    m = measures(spark, sf_dir)
    cols = ["q", "d", "t", "n"]
    scored = models.isolation_score(m, cols, models.isolation_fit(m, cols))
    scored = Scratch(spark, "isolation").write(scored.select("id", "iso_score"), "scored")  # the passes of the quantile read it again
    cut = quantiles.quantiles(scored.withColumn("all", F.lit(0)), "all", "iso_score", {0: 1 - models.contamination(0.15)})
    return scored.select("id", "iso_score", (F.col("iso_score") > F.lit(cut.get(0))).alias("is_anomaly"))


MEASURES = ["chars", "words", "digits", "upper", "marks", "lines", "word_length"]


def labelled_texts(spark, sf_dir):
    """Labelled documents with seven measures of the text; the labels are not among them.

    The texts are measured once, before the join, and the rows written: a fit passes over them many times.
    """
    text = F.coalesce("text", F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    chars = F.length(text).cast("double")
    share = lambda pattern: F.coalesce(F.try_divide(count(pattern), chars), F.lit(0.0))
    words = count(r"\S+")
    measured = read_table(spark, sf_dir, "documents").select(
        "doc_id", chars.alias("chars"), words.alias("words"), share("[0-9]").alias("digits"), share("[A-Z]").alias("upper"),
        share("[^A-Za-z0-9\\s]").alias("marks"), count("\n").alias("lines"), F.coalesce(F.try_divide(chars, words), F.lit(0.0)).alias("word_length"),
    )
    labels = read_table(spark, sf_dir, "labels")
    return Scratch(spark, "labelled").write(measured.join(labels, "doc_id").select(F.col("doc_id").alias("id"), "quality", "toxic", *MEASURES), "measures")


@query("severity_classifier")
def severity_classifier(spark, sf_dir):
    """Three levels (toxic 2, low quality 1, else 0) from the text's measures; the report of the held-out part."""
    m = labelled_texts(spark, sf_dir).withColumn("label", F.when(F.col("toxic") == 1, 2.0).when(F.col("quality") == 0, 1.0).otherwise(0.0))
    train, test = models.split(models.assemble(m, MEASURES))
    return models.classifier_report(models.severity_classifier(train).transform(test))


@query("balanced_forest")
def balanced_forest(spark, sf_dir):
    """Low quality or not from the text's measures, classes weighted alike; the report of the held-out part."""
    m = labelled_texts(spark, sf_dir).withColumn("label", (1 - F.col("quality")).cast("double"))
    train, test = models.split(models.assemble(m, MEASURES))
    return models.classifier_report(models.balanced_forest(train).transform(test))


@query("topic_model")
def topic_model(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("tokens"))
    return models.topic_model(d)[2]


@query(
    "topic_coherence",
    f"""WITH t AS (SELECT doc_id, lang, {TOKENS_SQL} AS w FROM documents),
 top AS (SELECT lang, word FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS nth FROM (SELECT lang, unnest(w) AS word FROM t WHERE lang IS NOT NULL) GROUP BY lang, word) WHERE nth <= 8),
 d AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(w) AS word FROM t) WHERE word IN (SELECT word FROM top)), s AS (SELECT word, count(*)::DOUBLE AS c FROM d GROUP BY 1), n AS (SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM documents),
 p AS (SELECT a.word AS a, b.word AS b, count(*) AS ab FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.word < b.word GROUP BY 1, 2),
 j AS (SELECT x.lang AS topic, coalesce(ab, 0) / n + 1e-12 AS pab, ca.c / n * (cb.c / n) AS apart FROM top x JOIN top y ON x.lang = y.lang AND x.word < y.word LEFT JOIN p ON p.a = x.word AND p.b = y.word JOIN s ca ON ca.word = x.word JOIN s cb ON cb.word = y.word, n)
 SELECT topic, {rnd('avg(ln(pab / apart) / -ln(pab))', 5)} AS npmi FROM j GROUP BY 1""",
)
def topic_coherence(spark, sf_dir):
    """Coherence of each language's eight most frequent words."""
    d = read_table(spark, sf_dir, "documents").select("lang", "doc_id", tokens(F.col("text")).alias("tokens"))
    topics = top_tokens(d, "lang", 8).select(F.col("lang").alias("topic"), F.col("token").alias("word"))
    topics = Scratch(spark, "coherence").write(topics, "topics")
    return models.npmi(d.select("doc_id", "tokens"), topics).withColumn("npmi", round_("npmi", 5))


@query("sequence_classifier")
def sequence_classifier(spark, sf_dir):
    from pulselake.plans.series_queries import series
    from pulselake.series.windows import sequences

    s = series(spark, sf_dir).withColumn("x", F.least(F.lit(1.0), F.col("x") / 100)).drop("ts")
    return sequence_report(sequences(s))


def sequence_report(q):
    """Report of a network per horizon on the windows that the hash of series and idx holds out; empty without windows."""
    names = ["y6", "y24", "y72"]
    flat = q.select(F.struct("series", "idx").alias("id"), *(F.col("seq")[k].alias(f"x{k}") for k in range(32)), *names)
    flat = Scratch(q.sparkSession, "windows").write(flat, "windows")
    train, test = models.split(models.assemble(flat, [f"x{k}" for k in range(32)]))
    nets = models.horizon_networks(train, names, 32) if train.head(1) else {}
    reports = [models.classifier_report((nets[y].transform(test) if nets else test.withColumn("prediction", F.lit(0.0))), label=y).select(F.lit(int(y[1:])).alias("horizon"), "*") for y in names]
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


def _pool_sql(t: str) -> str:
    """Scores of the three detectors on the values o.{t}, by relations: members of a window, their order, neighbours in it."""
    return f"""m_{t} AS (SELECT o.series, o.k, w, o.{t} AS xt, b.{t} AS v, b.k AS bk FROM o JOIN (VALUES (6), (24), (72)) z(w) ON true JOIN o b ON b.series = o.series AND b.k BETWEEN o.k - w + 1 AND o.k),
 s_{t} AS (SELECT *, row_number() OVER g AS j, count(*) OVER (PARTITION BY series, k, w) AS n, lag(v) OVER g AS lo, lead(v) OVER g AS hi, median(v) OVER (PARTITION BY series, k, w) AS mid FROM m_{t} WINDOW g AS (PARTITION BY series, k, w ORDER BY v, bk)),
 d_{t} AS (SELECT series, k, w, j, avg(away) AS d FROM (SELECT a.series, a.k, a.w, a.j, abs(a.v - b.v) AS away, row_number() OVER (PARTITION BY a.series, a.k, a.w, a.j ORDER BY abs(a.v - b.v), b.j) AS nth FROM s_{t} a JOIN s_{t} b ON b.series = a.series AND b.k = a.k AND b.w = a.w AND abs(a.j - b.j) BETWEEN 1 AND 5) WHERE nth <= 5 GROUP BY ALL),
 p_{t} AS (SELECT series, k, w, any_value(xt) AS xt, min(j) FILTER (v = xt) AS p, any_value(n) AS n, any_value(mid) AS mid, median(abs(v - mid)) AS mad, count(*) FILTER (v = xt) AS same,
   coalesce(sum((v - lo) / nullif(v - xt, 0)) FILTER (v > xt), 0) + coalesce(sum((hi - v) / nullif(xt - v, 0)) FILTER (v < xt), 0) AS cuts FROM s_{t} GROUP BY 1, 2, 3),
 e_{t} AS (SELECT series, k, w, avg(d) AS d FROM (SELECT p.series, p.k, p.w, d.d, row_number() OVER (PARTITION BY p.series, p.k, p.w ORDER BY abs(b.v - p.xt), b.j) AS nth FROM p_{t} p JOIN s_{t} b ON b.series = p.series AND b.k = p.k AND b.w = p.w AND abs(b.j - p.p) BETWEEN 1 AND 5
   JOIN d_{t} d ON d.series = b.series AND d.k = b.k AND d.w = b.w AND d.j = b.j) WHERE nth <= 5 GROUP BY ALL),
 f_{t} AS (SELECT p.*, d.d AS own, e.d AS others FROM p_{t} p LEFT JOIN d_{t} d ON d.series = p.series AND d.k = p.k AND d.w = p.w AND d.j = p.p LEFT JOIN e_{t} e ON e.series = p.series AND e.k = p.k AND e.w = p.w),
 n_{t} AS (SELECT series, k, w, CASE WHEN n < 5 OR mad < 1e-6 THEN 0 ELSE 1 / (1 + exp(2.5 - abs(xt - mid) / (1.4826 * mad))) END AS robust_z, CASE WHEN n < 5 OR own <= 0 THEN 0 ELSE greatest(0, 1 - others / own) END AS knn,
   CASE WHEN n < 5 THEN 0 ELSE pow(2, -(cuts + CASE WHEN same > 2 THEN 2 * (ln(same - 1) + 0.5772156649) - 2 * (same - 1)::DOUBLE / same WHEN same = 2 THEN 1 ELSE 0 END) / (2 * (ln(n - 1) + 0.5772156649) - 2 * (n - 1)::DOUBLE / n)) END AS isolation FROM f_{t})"""


_POOL_SQL = f"""WITH {views.BRONZE_SQL}, b0 AS (SELECT patient_id AS series, CAST(event_id AS BIGINT) AS idx, metric_value AS raw, row_number() OVER (PARTITION BY patient_id ORDER BY CAST(event_id AS BIGINT)) AS k FROM bronze),
 kz AS (SELECT a.series, a.k, count(*) - 1 AS steps, max(abs(b.raw - f.raw)) AS far, coalesce(sum(abs(b.raw - c.raw)), 0) AS length FROM b0 a JOIN b0 b ON b.series = a.series AND b.k BETWEEN a.k - 7 AND a.k JOIN b0 f ON f.series = a.series AND f.k = greatest(1, a.k - 7)
   LEFT JOIN b0 c ON c.series = a.series AND c.k = b.k - 1 AND c.k >= a.k - 7 GROUP BY 1, 2),
 o AS (SELECT series, idx, raw, k, CASE WHEN steps < 2 OR far <= 0 THEN 1.0::DOUBLE ELSE least(2, greatest(1, abs(log10(steps) / (log10(steps) + log10(far / length))))) END AS fractal FROM b0 JOIN kz USING (series, k)),
 {_pool_sql('raw')}, {_pool_sql('fractal')}"""


@query(
    "detector_pool",
    f"""{_POOL_SQL}, u AS (SELECT series, k, w, robust_z, knn, isolation FROM n_raw UNION ALL SELECT * FROM n_fractal),
 c AS (SELECT series, k, sum(robust_z + knn + isolation) / 18 AS score, sum((robust_z > 0.6)::INT + (knn > 0.6)::INT + (isolation > 0.6)::INT) AS n_high FROM u GROUP BY 1, 2),
 r AS (SELECT series, k, max(robust_z) FILTER (w = 24) AS z, max(knn) FILTER (w = 72) AS density, max(isolation) FILTER (w = 72) AS iso FROM n_raw GROUP BY 1, 2)
 SELECT o.series, o.idx, {rnd('z', 5)} AS robust_z_raw_24, {rnd('density', 5)} AS knn_raw_72, {rnd('iso', 5)} AS isolation_raw_72, {rnd('score', 5)} AS anomaly_score, CAST(n_high AS BIGINT) AS n_high,
  CASE WHEN n_high > 9 THEN 'high' WHEN n_high > 2.5 THEN 'medium' ELSE 'low' END AS consensus FROM o JOIN c ON c.series = o.series AND c.k = o.k JOIN r ON r.series = o.series AND r.k = o.k""",
)
def detector_pool(spark, sf_dir):
    """Every reading judged by the pool, with three of its nodes."""
    from pulselake.plans.series_queries import series

    judged = detectors.consensus(detectors.node_scores(series(spark, sf_dir).select("series", "idx", "x")))
    three = ("robust_z_raw_24", "knn_raw_72", "isolation_raw_72", "anomaly_score")
    return judged.select("series", "idx", *(round_(c, 5).alias(c) for c in three), F.col("n_high").cast("long").alias("n_high"), "consensus")
