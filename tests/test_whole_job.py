"""Queries do their whole job: every vector, every word, every pair, every horizon."""

from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from pulselake.ml import models
from pulselake.plans import ml_queries, registry
from pulselake.series import grid, windows
from pulselake.text import corpus

SF = "/root/testdata/sf0.001"


def test_image_rows_and_patches(spark):
    rng = np.random.default_rng(1)
    rows = [(7 * k - 50, (None, 0, 1)[k % 3], [float(x) for x in rng.normal(size=5)]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = {(r.image_id, r.r, r.c): r for r in grid.row_oscillation(grid.image_rows(df, "label", "vec_id")).collect()}
    assert len(got) == 60 * 5
    for label in (None, 0, 1):
        im = np.array([np.float32(e) for _, g, e in rows if g == label], np.float64)
        for r in range(len(im)):
            for c in range(5):
                patch = im[max(r - 1, 0) : r + 2, max(c - 1, 0) : c + 2]
                x = got[label, r, c]
                assert abs(x.v - im[r, c]) < 1e-9 and abs(x.smooth - patch.mean()) < 1e-9 and abs(x.mo - np.abs(patch - patch.mean()).mean()) < 1e-9


def test_every_vector_is_an_image_row(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert registry.QUERIES["image_oscillation_all"](spark, SF).count() == 64 * n


def test_topic_similarity_reads_the_whole_text(spark):
    late = " ".join("abc" + chr(97 + k) * 3 for k in range(20)) + " tion"
    docs = spark.createDataFrame([(1, late), (None, "tion elle"), (None, "zzz"), (4, None), (5, ""), (5, "tio relle mmm")], "doc_id long, text string")
    seeds = ["tion", "elle", "heit", "shred"]
    got = sorted((r.doc_id or 0, round(r.similarity, 9)) for r in corpus.text_similarity(docs, seeds).collect())
    whole = F.array_distinct(corpus.tokens(F.col("text")))
    want = docs.select("doc_id", corpus.topic_similarity(whole, F.array(*map(F.lit, seeds))).alias("similarity")).collect()
    assert got == sorted((r.doc_id or 0, round(r.similarity, 9)) for r in want)
    assert dict(got)[1] > 0


def test_topic_similarity_query_scores_all_tokens(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = corpus.topic_similarity(F.array_distinct(corpus.tokens(F.col("text"))), F.array(*map(F.lit, ("tion", "elle", "heit", "shred"))))
    want = {r.doc_id: r.s for r in docs.select("doc_id", whole.alias("s")).collect()}
    got = {r.doc_id: r.similarity for r in registry.QUERIES["topic_similarity"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_topics_are_fitted_on_the_whole_corpus(spark):
    docs = spark.createDataFrame([(k, [f"{'ab'[k % 2]}{w}" for w in range(6)]) for k in range(40)], "doc_id long, tokens array<string>")
    model, _, scored = models.topic_model(docs, k=2)
    assert model.getOrDefault("subsamplingRate") * model.getOrDefault("maxIter") >= 5
    assert scored.count() == 40


def test_all_pairs_of_rare_words_are_counted(spark):
    rng = np.random.default_rng(2)
    word = lambda k: "w" + "".join(chr(97 + int(d)) for d in f"{k:03d}")
    texts = [" ".join(word(k) for k in rng.integers(0, 150, size=100)) for _ in range(12)] + ["xxrare yyrare", "xxrare yyrare xxrare", "", "alone"]
    docs = spark.createDataFrame([(None if k < 2 else k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    want = Counter(p for t in texts for p in combinations(sorted(set(t.split())), 2))
    edges = corpus.all_pairs(docs, piece=8)
    got = {(r.a, r.b): r.n for r in edges.collect()}
    assert got == {p: n for p, n in want.items() if n >= 2} and got["xxrare", "yyrare"] == 2
    top = {(r.term, r.nth): r.partner for r in corpus.strongest(edges).collect()}
    assert top["xxrare", 1] == "yyrare" and top["yyrare", 1] == "xxrare" and max(n for _, n in top) == 3


def test_sequence_report_has_all_horizons_held_out(spark):
    rng = np.random.default_rng(3)
    rows = [(str(g), k, float(x)) for g in range(2) for k, x in enumerate(rng.random(200))]
    q = windows.sequences(spark.createDataFrame(rows, "series string, idx long, x double"))
    got = ml_queries.sequence_report(q).collect()
    assert {r.horizon for r in got} == {6, 24, 72}
    for h in (6, 24, 72):
        assert 0 < sum(r.support for r in got if r.horizon == h) < q.count() / 2


def test_classifiers_run_with_their_own_defaults(spark, monkeypatch):
    seen = []

    class Stop(Exception):
        pass

    for name in ("severity_classifier", "balanced_forest"):
        def fit(train, **given):
            seen.append(given)
            raise Stop

        monkeypatch.setattr(ml_queries.models, name, fit)
        try:
            registry.QUERIES[name](spark, SF)
        except Stop:
            pass
    assert seen == [{}, {}]
