"""Cases of the third review."""

import duckdb
import pytest

from pulselake.plans import registry
from tests.test_queries import TABLES, plain

SF = "/root/testdata/sf0.001"


@pytest.fixture
def with_events(tmp_path):
    """Makes tables of which events holds given rows (event_id, ts, user_id, event_type, value, props); the others are the smallest ones."""

    def make(rows: str) -> str:
        for t in TABLES:
            if t != "events":
                (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
        duckdb.sql(f"COPY (SELECT event_id::BIGINT AS event_id, ts::TIMESTAMP AS ts, user_id::BIGINT AS user_id, event_type, value::DOUBLE AS value, props FROM ({rows})) TO '{tmp_path}/events.parquet'")
        return str(tmp_path)

    return make


def both(spark, name: str, sf: str) -> tuple[list, list]:
    """A query's rows and those of its SQL."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return plain(registry.QUERIES[name](spark, sf).toPandas()), plain(con.execute(registry.ORACLES[name]).df())


def test_online_quality_counts_every_metric(spark, with_events):
    sf = with_events("SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) HOUR AS ts, 1 AS user_id, ['view', 'signup'][i % 2 + 1] AS event_type, 50.0 AS value, '{\"k\": ' || (i % 2 * 60) || '}' AS props FROM range(8) t(i)")
    got, want = both(spark, "online_features", sf)
    assert got == want and len(got) == 1


@pytest.mark.parametrize("name", ["hrv_entropies", "hrv_summary", "hrv_time_domain"])
def test_intervals_without_a_rate(spark, with_events, name):
    sf = with_events("SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) HOUR AS ts, 1 AS user_id, 'signup' AS event_type, CASE WHEN i % 9 = 4 THEN 0 WHEN i <> 17 THEN 60.0 + i % 5 END AS value, '{\"k\": 5}' AS props FROM range(30) t(i)")
    got, want = both(spark, name, sf)
    assert got == want and len(got) == 1


def test_stream_cusum_ties_by_event(spark, with_events):
    sf = with_events("SELECT (i * 7) % 60 AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (((i * 7) % 60) // 20) HOUR AS ts, 1 AS user_id, 'purchase' AS event_type, (i * 7 % 60 * 37) % 101 * 3.0 AS value, '{\"k\": 5}' AS props FROM range(60) t(i)")
    got, want = both(spark, "stream_cusum", sf)
    assert got == want and len(got) == 1


def test_detectors_over_many_series_in_a_batch(spark):
    from pulselake.ml import detectors

    rows = [(f"s{k % 300}", k, float(k * k % 17)) for k in range(6000)]
    whole = detectors.node_scores(spark.createDataFrame(rows, "series string, idx long, x double"))
    alone = detectors.node_scores(spark.createDataFrame([r for r in rows if r[0] == "s7"], "series string, idx long, x double"))
    assert whole.count() == len(rows) and "mapInPandas" in str(whole._jdf.queryExecution().logical()).replace("MapInPandas", "mapInPandas")
    assert sorted(whole.where("series = 's7'").collect()) == sorted(alone.collect())


def test_hit_counts_are_those_of_the_matrix(spark):
    from pyspark.sql import functions as F

    from pulselake.clinical import rules

    rows = [(185.0, 115.0, 120.0, 90.0, 39.5, 30.0, True), (None, None, 130.0, None, None, None, None), (120.0, 80.0, 70.0, 98.0, 36.5, 100.0, False)] * 3
    df = spark.createDataFrame(rows, "pas double, pad double, hr double, spo2 double, temp_c double, glucose_mgdl double, consciousness_altered boolean")
    df = df.withColumns({c: F.lit(35.0) for c in ("steps_drop_pct", "sleep_worsen_pct", "hr_baseline_rise", "spo2_drop_points")})
    want = rules.evaluate(df).select(F.explode("hits").alias("h")).groupBy("h.rule", "h.severity").agg(F.count("*").alias("n")).collect()
    assert sorted(map(tuple, rules.hit_counts(df).collect())) == sorted(map(tuple, want))


def test_oscillation_scales_share_one_order(spark):
    from pulselake.series import windows

    df = spark.createDataFrame([(f"s{k % 2}", k, float(k * k % 13)) for k in range(40)], "series string, idx long, x double")
    out = windows.oscillation_profile(df, (4, 8, 32))
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.series, r.scale) for r in out.collect()) == [("s0", 4), ("s0", 8), ("s1", 4), ("s1", 8)]


@pytest.mark.parametrize("name", ["source_phone_xml", "source_phone_json", "source_fitness_cache", "source_fhir_bundles", "source_collected"])
def test_exports_of_many_patients_lie_in_few_files(spark, with_events, name):
    from pathlib import Path

    from pulselake.session import Scratch

    sf = with_events("SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) MINUTE AS ts, i // 2 AS user_id, ['view', 'click', 'error'][i % 3 + 1] AS event_type, 50.0 + i % 7 AS value, '{\"k\": 5}' AS props FROM range(120) t(i)")
    before = len(Scratch.made)
    got, want = both(spark, name, sf)
    assert got == want and got
    files = [f for s in Scratch.made[before:] for f in Path(s.root.removeprefix("file:")).rglob("part-*")]
    assert 0 < len(files) < 20  # 60 patients


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    import numpy as np

    from pulselake.text import corpus, vector_index

    monkeypatch.setattr(vector_index, "BLOCK", 50)
    monkeypatch.setattr(vector_index, "ASKED", 3)
    x = np.random.default_rng(3).normal(size=(120, 5)).round(3)
    x[60:90] = x[7]  # copies: ties by id
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1001, [None] * 5)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id % 10 = 7").selectExpr("vec_id as query_id", "embedding as q")
    got = sorted((r.query_id, r.nth, r.vec_id) for r in corpus.vector_topk(vectors, queries, 4).collect())
    d = {q: np.sqrt(((x - x[q]) ** 2).sum(axis=1)) for q in range(7, 120, 10)}
    assert got == [(q, n + 1, int(i)) for q in d for n, i in enumerate(np.lexsort((np.arange(120), d[q].round(12)))[:4])]


@pytest.mark.parametrize("unscented", [False, True])
def test_latent_states_of_many_series_in_small_batches(spark, unscented):
    import numpy as np

    from pulselake.series import recursive

    rng = np.random.default_rng(5)
    rows = [(f"s{k % 7}", k, float(k * (1 + k % 7 % 2)), *(float(v) if rng.random() < 0.6 else None for v in rng.normal([70, 40, 33, 3], 3))) for k in range(140)] + [("one", 1, 0.0, 70.0, None, None, None)]
    df = spark.createDataFrame(rows, "series string, idx long, t double, " + ", ".join(f"{c} double" for c in recursive.OBSERVED))
    out = recursive.latent_states(df, unscented=unscented)
    assert "FlatMapGroups" not in str(out._jdf.queryExecution().logical())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = {(r.series, r.idx): r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows)
    for name in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == name]
        dt = float(np.median(np.diff([r[2] for r in own]))) if len(own) > 1 else 1.0
        s, p = recursive._MEAN.copy(), recursive._P0.copy()
        for r in own:
            s, p, seen = recursive.latent_step(s, p, np.array(r[3:], float), dt, unscented)
            g = got[name, r[1]]
            assert np.allclose([g[c] for c in recursive.STATES], s, atol=1e-9) and np.isclose(g.trace, np.trace(p), atol=1e-9)
            assert np.allclose([np.nan if g[f"innovation_{c}"] is None else g[f"innovation_{c}"] for c in recursive.OBSERVED], seen, atol=1e-9, equal_nan=True)


def test_texts_are_measured_once_for_all_passes(spark):
    from pulselake.plans import ml_queries

    out = ml_queries.labelled_texts(spark, SF)
    assert not [f for f in out.inputFiles() if "documents" in f]  # a pass of a fit reads the measures, not the texts
    got = {r.id: r for r in out.collect()}
    want = duckdb.sql(f"SELECT doc_id, length(text), len(regexp_extract_all(text, '[0-9]')), quality, toxic FROM '{SF}/documents.parquet' JOIN '{SF}/labels.parquet' USING (doc_id)").fetchall()
    assert len(got) == len(want) > 0
    for doc, chars, digits, quality, toxic in want:
        r = got[doc]
        assert (r.chars, r.quality, r.toxic) == (chars, quality, toxic) and r.digits == pytest.approx(digits / chars if chars else 0.0)


def test_filters_of_many_series_in_a_batch(spark):
    import numpy as np

    from pulselake.series import chunks, recursive, temporal

    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 40, 60)
    x = rng.normal(70, 1, sizes.sum()).round(1) * np.where(rng.random(sizes.sum()) < 0.15, 9.0, 1.0)
    x[rng.random(len(x)) < 0.02] = np.nan
    first = np.cumsum(sizes) - sizes
    y, odd = chunks.hampel_groups(x, first, sizes)
    z = chunks.kalman_groups(y, first, sizes, 0 * first, 0.05, 2.0, y[first], 0.0 * first)[0]
    for at, n in zip(first, sizes):
        own = slice(at, at + n)
        want, marks = recursive.hampel_values(x[own])
        assert np.array_equal(y[own], want, equal_nan=True) and odd[own].tolist() == marks.tolist()
        assert np.allclose(z[own], recursive.kalman_values(want, 0.05, 2.0), atol=1e-9, equal_nan=True)
    df = spark.createDataFrame([(f"s{k % 300}", k, float(k % 17)) for k in range(900)], "series string, idx long, x double")
    vitals = df.selectExpr("series AS patient_id", "timestamp_seconds(idx) AS window_start", "x AS heart_rate", "x AS spo2", "x AS hrv", "x AS stress", "1D AS quality_score", "70D AS resting_hr", "97D AS baseline_spo2", "50D AS baseline_hrv", "'low' AS activity_level", "0.1D AS risk_factor", "1 AS n_conditions")
    for out in (chunks.denoise_rows(df), temporal.denoised(vitals)):
        assert "FlatMapGroups" not in out._jdf.queryExecution().logical().toString()
    assert chunks.denoise_rows(df).count() == temporal.denoised(vitals).count() == 900


def test_spectra_of_many_series_in_small_batches(spark):
    from pyspark.sql import functions as F

    from pulselake.series import hrv, windows

    sizes = {f"s{k:02}": 5 + 3 * k for k in range(20)}  # two are too short
    rows = [(s, k, 700.0 + (k * k * 31 + 7 * n) % 211) for s, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "series string, idx long, x double")
    spectrum = hrv.uneven_spectrum(df, 100)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {(r.series, round(r.f, 9)): r.psd for r in spectrum.collect()}
        bands = {r.series: r for r in hrv.uneven_bands(df, 100).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "Generate" not in spectrum._jdf.queryExecution().optimizedPlan().toString()  # no row per beat and frequency
    timed = df.select("series", "x", (F.sum("x").over(windows.in_order()) / 1000).alias("t"))
    f = spark.createDataFrame([(float(v),) for v in hrv._frequencies(100)], "f double")
    want = [r for r in windows.lomb_scargle(timed, f).collect() if sizes[r.series] >= hrv.LEAST]
    assert len(got) == len(want) == 1900
    for r in want:
        assert got[r.series, round(r.f, 9)] == pytest.approx(r.power * 2 / sizes[r.series], rel=1e-6, abs=1e-6)
    for r in hrv.band_powers(spectrum).collect():
        assert (r.vlf_power, r.lf_power, r.hf_power, r.total_power) == pytest.approx(tuple(bands[r.series])[1:5], rel=1e-9)


def test_vocabulary_is_that_of_all_words_and_pairs(spark):
    from collections import Counter

    from pulselake.ml import models

    texts = [[f"w{(k * j * j + j // 3) % (5 + k % 9)}" for j in range(k % 23)] + ["all"] for k in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, tokens array<string>")
    n, docs = Counter(), Counter()
    for t in texts:
        terms = t + [f"{a} {b}" for a, b in zip(t, t[1:])]
        n.update(terms)
        docs.update(set(terms))
    fit = sorted((t for t in n if 2 <= docs[t] <= 0.9 * len(texts)), key=lambda t: (-n[t], t))
    assert "all" not in fit
    for top in (5, 12, 40, 10_000):  # pairs of a word that is itself in too many rows count
        assert models.frequent_terms(df, top) == fit[:top]


def test_latent_stream_steps_a_group_of_patients_together():
    import numpy as np
    import pandas as pd

    from pulselake.series import recursive
    from pulselake.streaming import jobs

    class Held(dict):
        containsKey, getValue, updateValue = dict.__contains__, dict.__getitem__, dict.__setitem__

        def getMapState(self, *_):
            return self

    rng = np.random.default_rng(4)
    rows = [(f"P{k % 7}", pd.Timestamp(2026, 1, 1) + pd.Timedelta(minutes=k), *(v if rng.random() < 0.6 else np.nan for v in rng.normal([70, 40, 33, 3], 3))) for k in range(90)]
    pdf = pd.DataFrame(rows, columns=["patient_id", "ts", *recursive.OBSERVED])
    state, processor = Held(), jobs.LatentProcessor(5, None)
    processor.init(state)
    got = pd.concat([f for part in (pdf[:50][::-1], pdf[50:]) for f in processor.handleInputRows((0,), iter([part[:20], part[20:]]), None)])
    assert len(got) == len(rows) and len(state) == 7
    for name, own in pdf.groupby("patient_id"):
        mine = got[got.patient_id == name].sort_values("ts")
        s, p = recursive._MEAN, recursive._P0
        for k, z in enumerate(own[list(recursive.OBSERVED)].to_numpy()):
            s, p, _ = recursive.latent_step(s, p, z, 1.0)
            known = own.heart_rate.iloc[max(0, k - 4) : k + 1].dropna()
            assert np.allclose(mine[list(recursive.STATES)].iloc[k], s, atol=1e-9) and mine.history_size.iloc[k] == min(5, k + 1)
            assert np.isclose(mine.recent_mean.iloc[k], known.mean() if len(known) else np.nan, equal_nan=True)
