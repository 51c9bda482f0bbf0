"""Models on DataFrames: Mahalanobis, isolation forest, ensemble p-values, Platt, classifiers, topics."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizerModel, IDF, NGram, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulselake.functions.scalar import rnd
from pulselake.ml.quantiles import quantiles
from pulselake.session import Scratch, small_side


# ---- Mahalanobis distance


def mahalanobis_fit(rows: DataFrame, columns: list[str]) -> tuple[list[float], list[list[float]]]:
    """Mean and inverse (pseudo) covariance of the columns: one aggregate, a p x p inverse on the driver."""
    aggs = [F.avg(c) for c in columns] + [F.covar_samp(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    v = list(rows.agg(*aggs).first())
    p = len(columns)
    cov = np.zeros((p, p))
    cov[np.triu_indices(p)] = [x or 0.0 for x in v[p:]]
    cov = cov + np.triu(cov, 1).T
    return v[:p], np.linalg.pinv(cov).tolist()


def mahalanobis_score(columns: list[str], mean: list[float], inverse: list[list[float]]) -> Column:
    """Distance as a column expression."""
    d = [F.col(c) - m for c, m in zip(columns, mean)]
    total = F.lit(0.0)
    for a, row in zip(d, inverse):
        for b, w in zip(d, row):
            total = total + a * b * w
    return F.sqrt(F.greatest(F.lit(0.0), total))


def chi2_tail_even(x: Column, df: int) -> Column:
    """Upper chi-square tail for even degrees of freedom, in closed form."""
    half, term, total = x / 2, F.lit(1.0), F.lit(1.0)
    for k in range(1, df // 2):
        term = term * half / k
        total = total + term
    return F.least(F.lit(1.0), F.exp(-half) * total)


# ---- ensemble of p-values


def fisher(p_values: list[Column]) -> tuple[Column, Column]:
    """(statistic, combined p) of independent p-values; null counts as 1, zero as 1e-300."""
    safe = [F.greatest(F.coalesce(p, F.lit(1.0)), F.lit(1e-300)) for p in p_values]
    stat = F.lit(0.0)
    for p in safe:
        stat = stat - 2 * F.log(p)
    return stat, chi2_tail_even(stat, 2 * len(safe))


def severity(p: Column) -> Column:
    return F.when(p < 0.001, "critical").when(p < 0.01, "high").when(p < 0.05, "moderate").otherwise("normal")


def ensemble(rows: DataFrame, detectors: dict[str, Callable[[], tuple[Column, Column | None]]]) -> DataFrame:
    """Adds anomaly_<name> scores, their combined p and severity; a detector without p uses exp(-max(score, 0))."""
    ps, out = [], rows
    for name, make in detectors.items():
        score, p = make()
        out = out.withColumn(f"anomaly_{name}", score)
        ps.append(p if p is not None else F.exp(-F.greatest(F.col(f"anomaly_{name}"), F.lit(0.0))))
    stat, p = fisher(ps)
    return out.withColumns({"anomaly_statistic": stat, "anomaly_p": p}).withColumn("anomaly_severity", severity(F.col("anomaly_p")))


def platt_fit(rows: DataFrame, score: str, label: str) -> tuple[float, float]:
    """(A, B) of P = sigmoid(-(A s + B)) by logistic regression."""
    v = VectorAssembler(inputCols=[score], outputCol="_s").transform(rows)
    m = LogisticRegression(featuresCol="_s", labelCol=label, regParam=0.0).fit(v)
    return -float(m.coefficients[0]), -float(m.intercept)


def platt(score: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(a * score + b))


# ---- isolation forest: one tree a group


def isolation_fit(rows: DataFrame, columns: list[str], trees: int = 50, sample: int = 256, seed: int = 7) -> list:
    """Trees as flat arrays, each grown in its own group from about sample rows drawn by a hash of id and tree.

    A row goes to a tree with probability sample / count, so a group holds a bounded number of rows
    whatever the input's size.
    """
    n = max(1, rows.count())
    share = min(1.0, 1.2 * sample / n)
    picks = rows.select("id", *columns).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).where(F.pmod(F.xxhash64("id", "tree", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("id")[columns].to_numpy(float)[:sample]
        rng, depth = np.random.default_rng(seed * 1000 + tree), math.ceil(math.log2(max(2, len(x))))
        nodes: list[list[float]] = []

        def make(idx: np.ndarray, level: int) -> int:
            at = len(nodes)
            nodes.append([-1.0, 0.0, 0.0, 0.0, float(level + _average_path(len(idx)))])
            spread = x[idx].max(axis=0) - x[idx].min(axis=0) if len(idx) else np.zeros(len(columns))
            if level < depth and len(idx) > 1 and spread.max() > 0:
                f = int(rng.choice(np.flatnonzero(spread > 0)))
                cut = rng.uniform(x[idx, f].min(), x[idx, f].max())
                low = idx[x[idx, f] < cut]
                high = idx[x[idx, f] >= cut]
                nodes[at][:2] = [float(f), float(cut)]
                nodes[at][2] = float(make(low, level + 1))
                nodes[at][3] = float(make(high, level + 1))
            return at

        make(np.arange(len(x)), 0)
        return pd.DataFrame({"tree": [tree], "n": [len(x)], "nodes": [[v for node in nodes for v in node]]})

    return picks.groupBy("tree").applyInPandas(grow, "tree int, n int, nodes array<double>").orderBy("tree").collect()


def _average_path(n: int) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def isolation_score(rows: DataFrame, columns: list[str], forest: list) -> DataFrame:
    """Adds iso_score in 0 to 1 (higher: more isolated) by vectorised traversal."""
    trees = [np.array(r["nodes"]).reshape(-1, 5) for r in forest]
    norm = np.mean([max(1e-9, _average_path(r["n"])) for r in forest])

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float) for c in cols], axis=1)
        total = np.zeros(len(x))
        for t in trees:
            at = np.zeros(len(x), int)
            while True:
                inner = t[at, 0] >= 0
                if not inner.any():
                    break
                f = t[at[inner], 0].astype(int)
                low = x[inner, f] < t[at[inner], 1]
                at[inner] = np.where(low, t[at[inner], 2], t[at[inner], 3]).astype(int)
            total += t[at, 4]
        return pd.Series(2.0 ** (-(total / len(trees)) / norm))

    return rows.withColumn("iso_score", score(*columns))


def contamination(label_rate: float) -> float:
    return min(0.3, max(0.05, label_rate / 3))


# ---- classifiers


def assemble(rows: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(rows)


def split(rows: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """A fixed split by a hash of id."""
    low = F.pmod(F.xxhash64("id"), F.lit(1000)) < int(share * 1000)
    return rows.where(low), rows.where(~low)


def severity_classifier(train: DataFrame, label: str = "label", iterations: int = 20, depth: int = 4):
    """Boosted trees, one against the rest."""
    return OneVsRest(classifier=GBTClassifier(maxIter=iterations, maxDepth=depth, stepSize=0.08, seed=7), labelCol=label).fit(train)


def balanced_forest(train: DataFrame, label: str = "label", trees: int = 40, depth: int = 12):
    """Random forest with weights inverse to class frequency."""
    n = train.count()
    per = train.groupBy(label).agg((F.lit(n) / (2 * F.count("*"))).alias("weight"))
    return RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=7).fit(train.join(F.broadcast(per), label))


def scaled_pipeline(columns: list[str], estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True), estimator])


def horizon_networks(train: DataFrame, horizons: list[str], width: int, iterations: int = 30) -> dict:
    """A multilayer perceptron per horizon on the flattened sequence."""
    return {h: MultilayerPerceptronClassifier(layers=[width, 32, 16, 2], labelCol=h, maxIter=iterations, seed=7).fit(train) for h in horizons}


def classifier_report(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class; division by zero is 0."""
    pairs = scored.groupBy(F.col(label).cast("double").alias("l"), F.col(prediction).cast("double").alias("p")).agg(F.count("*").alias("n"))
    t = pairs.select(F.explode(F.array(F.struct(F.col("l").alias("c"), F.lit("l").alias("side")), F.struct(F.col("p").alias("c"), F.lit("p").alias("side")))).alias("s"), "n", (F.col("l") == F.col("p")).alias("ok")).select("s.*", "n", "ok")
    g = t.groupBy("c").agg(F.sum(F.when((F.col("side") == "l") & F.col("ok"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("side") == "l", F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("side") == "p", F.col("n")).otherwise(0)).alias("predicted"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    r = g.withColumns({"precision": ratio("tp", "predicted"), "recall": ratio("tp", "support")})
    return r.select(F.col("c").alias("class"), rnd("precision", 6).alias("precision"), rnd("recall", 6).alias("recall"), rnd(F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)), 6).alias("f1"), "support")


# ---- thresholds and conformal calibration


def round_half_up(x: float) -> int:
    return math.floor(x + 0.5)


def threshold_metrics(rows: DataFrame, inclusive: bool = True) -> DataFrame:
    """Per horizon (horizon, label, prob): threshold at the prevalence quantile (held in .15 to .85; .5 with one class) and the metrics there."""
    spark, kind = rows.sparkSession, rows.schema["horizon"].dataType.simpleString()
    prevalence = {r[0]: r[1] for r in rows.groupBy("horizon").agg(F.avg("label")).collect()}  # one row a horizon
    mixed = {h: round_half_up((1 - v) * 1000) / 1000 for h, v in prevalence.items() if v is not None and 1e-12 <= v <= 1 - 1e-12}
    at = {h: min(0.85, max(0.15, q)) for h, q in quantiles(rows, "horizon", "prob", mixed).items()}
    cut = spark.createDataFrame([(h, at.get(h, 0.5)) for h in prevalence], f"horizon {kind}, threshold double")
    p = rows.join(F.broadcast(cut), "horizon").withColumn("hit", F.col("prob") >= F.col("threshold") if inclusive else F.col("prob") > F.col("threshold"))
    n = lambda cond, a: F.count_if(cond).alias(a)
    g = p.groupBy("horizon").agg(F.first("threshold").alias("threshold"), n((F.col("label") == 1) & F.col("hit"), "tp"), n((F.col("label") == 0) & ~F.col("hit"), "tn"), n((F.col("label") == 0) & F.col("hit"), "fp"), n((F.col("label") == 1) & ~F.col("hit"), "fn"))
    d = lambda a, b: rnd(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    c = F.col
    return g.withColumns({"sensitivity": d(c("tp"), c("tp") + c("fn")), "specificity": d(c("tn"), c("tn") + c("fp")), "ppv": d(c("tp"), c("tp") + c("fp")), "npv": d(c("tn"), c("tn") + c("fn")), "f1": d(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn"))})


def conformal_fit(rows: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Per horizon the quantile of 1 - p(true class) at ceil((n+1)(1-alpha))/n, and the empirical coverage."""
    s = rows.withColumn("score", F.when(F.col("label") >= 0.5, 1 - F.col("prob")).otherwise(F.col("prob")))
    sizes = {r[0]: r[1] for r in s.where("score is not null").groupBy("horizon").count().collect()}  # one row a horizon
    found = quantiles(s, "horizon", "score", {h: min(1.0, math.ceil((n + 1) * (1 - alpha)) / n) for h, n in sizes.items()})
    q = s.sparkSession.createDataFrame([(h, found[h], n) for h, n in sizes.items()], f"horizon {s.schema['horizon'].dataType.simpleString()}, q_hat double, n long")
    cover = s.join(F.broadcast(q), "horizon").groupBy("horizon").agg(F.avg((F.col("score") <= F.col("q_hat") + 1e-12).cast("double")).alias("coverage"))
    return q.join(cover, "horizon")


def conformal_interval(prob: Column, q_hat: Column) -> dict[str, Column]:
    """Clipped interval and prediction set; without calibration the margin is 0.15."""
    q = F.coalesce(q_hat, F.lit(0.15))
    both = F.array_compact(F.array(F.when(1 - prob <= q, F.lit(1)), F.when(prob <= q, F.lit(0))))
    return {"low": F.greatest(F.lit(0.0), prob - q), "high": F.least(F.lit(1.0), prob + q), "prediction_set": both}


# ---- topics


def frequent_terms(docs: DataFrame, top: int, least: int = 2, share: float = 0.9) -> list[str]:
    """The most frequent words and pairs of neighbours (joined by a space) of tokens, ties by term, that are in least or more rows and at most in a share of them.

    A pair is no more frequent than either of its words. So where top words qualify, pairs are only
    counted of words as frequent as the last of these, and no pair that could be among the top is left out.
    """
    most = share * docs.count()
    seen = lambda c, n, d: F.transform(c, lambda w: F.struct(w.alias("term"), F.lit(n).alias("n"), F.lit(d).alias("docs")))
    counted = lambda c, keep: keep(docs.select(c.alias("t")).select(F.explode(F.concat(seen("t", 1, 0), seen(F.array_distinct("t"), 0, 1))).alias("w")).select("w.*")).groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    qualify = lambda df: df.where((F.col("docs") >= least) & (F.col("docs") <= most)).orderBy(F.desc("n"), "term").limit(top).select("term", "n").collect()
    words = Scratch(docs.sparkSession, "terms").write(counted(F.col("tokens"), lambda df: df), "words")
    first = qualify(words)
    often = words.where(F.col("n") >= (first[-1]["n"] if len(first) == top else 1)).select("term")
    often = small_side(often, often.count())
    side = lambda k: often.select(F.col("term").alias(f"word{k}"))
    apart = lambda df: df.withColumn("word0", F.substring_index("term", " ", 1)).withColumn("word1", F.substring_index("term", " ", -1))
    pairs = F.transform(F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(0))), lambda a, i: F.concat_ws(" ", a, F.col("tokens")[i + 1]))
    second = qualify(counted(pairs, lambda df: apart(df).join(side(0), "word0", "left_semi").join(side(1), "word1", "left_semi")))
    return [r["term"] for r in sorted([*first, *second], key=lambda r: (-r["n"], r["term"]))[:top]]


def topic_model(docs: DataFrame, k: int = 4, vocabulary: int = 3000, iterations: int = 10):
    """(model, vocabulary, scored): TF-IDF of 1- and 2-grams and online LDA; scored has topic, confidence and entropy.

    Each iteration draws as many documents as there are (with replacement); the learning offset of 1 suits so
    few, whole batches: with the default 1024 the random start would keep most of its weight.
    """
    work = Scratch(docs.sparkSession, "topics")
    held = work.write(docs.select("doc_id", "tokens"), "tokens")
    both = NGram(n=2, inputCol="tokens", outputCol="bigrams").transform(held).withColumn("terms", F.concat("tokens", "bigrams"))
    cv = CountVectorizerModel.from_vocabulary(frequent_terms(held, vocabulary), inputCol="terms", outputCol="tf")
    counted = work.write(cv.transform(both).select("doc_id", "tf"), "counted")
    weighted = IDF(inputCol="tf", outputCol="features").fit(counted).transform(counted)
    weighted = work.write(weighted.select("doc_id", "features"), "features")
    model = LDA(k=k, maxIter=iterations, optimizer="online", subsamplingRate=1.0, learningOffset=1.0, seed=7).fit(weighted)
    from pyspark.ml.functions import vector_to_array

    p = model.transform(weighted).withColumn("p", vector_to_array("topicDistribution"))
    entropy = F.aggregate("p", F.lit(0.0), lambda a, v: a - F.when(v > 0, v * F.log(v)).otherwise(0.0))
    scored = p.select("doc_id", (F.array_position("p", F.array_max("p")) - 1).alias("topic"), F.array_max("p").alias("confidence"), entropy.alias("entropy"))
    scored._features = weighted
    return model, cv.vocabulary, scored


def choose_topics(docs: DataFrame, ks=range(3, 11), top: int = 10, iterations: int = 10) -> DataFrame:
    """(k, coherence, perplexity, chosen) of topic models of each size; the most coherent one is chosen, ties to the smaller.

    A model's vocabulary and topic words are bounded lists; the documents are tokenised and weighted once per size.
    """
    spark, rows = docs.sparkSession, []
    for k in ks:
        model, vocabulary, scored = topic_model(docs, k, iterations=iterations)
        words = [(r["topic"], vocabulary[t]) for r in model.describeTopics(top).collect() for t in r["termIndices"]]
        topics = spark.createDataFrame(words, "topic int, word string")
        both = docs.select("doc_id", F.concat("tokens", F.transform(F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(0))), lambda a, i: F.concat_ws(" ", a, F.col("tokens")[i + 1]))).alias("tokens"))
        coherence = npmi(both, topics).agg(F.avg("npmi")).first()[0]
        rows.append((k, coherence, model.logPerplexity(scored._features)))
    best = max(rows, key=lambda r: (r[1] if r[1] is not None else float("-inf"), -r[0]))[0]
    return spark.createDataFrame([(*r, r[0] == best) for r in rows], "k int, coherence double, perplexity double, chosen boolean")


def npmi(docs: DataFrame, topics: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Mean normalised pointwise mutual information of each topic's word pairs over document co-occurrence.

    topics (topic, word) is a short list, broadcast; documents contribute only its words.
    """
    n = docs.select("doc_id").distinct().agg(F.count("*").alias("n"))
    w = docs.select("doc_id", F.explode(F.array_distinct("tokens")).alias("word")).join(F.broadcast(topics.select("word").distinct()), "word")
    single = w.groupBy("word").agg(F.count("*").alias("c"))
    sets = w.groupBy("doc_id").agg(F.sort_array(F.collect_set("word")).alias("t"))
    pairs = sets.select(F.explode("t").alias("a"), "t").select("a", F.explode(F.filter("t", lambda b: b > F.col("a"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("ab"))
    tp = topics.select("topic", F.col("word").alias("a")).join(topics.select("topic", F.col("word").alias("b")), "topic").where("a < b")
    j = tp.join(pairs, ["a", "b"], "left").join(single.select(F.col("word").alias("a"), F.col("c").alias("ca")), "a").join(single.select(F.col("word").alias("b"), F.col("c").alias("cb")), "b").join(F.broadcast(n))
    pab = F.coalesce(F.col("ab"), F.lit(0)) / F.col("n") + eps
    value = F.log(pab / (F.col("ca") / F.col("n") * F.col("cb") / F.col("n"))) / -F.log(pab)
    return j.groupBy("topic").agg(F.avg(value).alias("npmi"))
