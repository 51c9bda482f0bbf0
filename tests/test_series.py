"""Series operators against loops and known shapes; streams against their batch twins."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulselake.ml import models
from pulselake.series import grid, hrv, recursive, windows


def rows(spark, x, name="s"):
    return spark.createDataFrame([(name, k, float(v)) for k, v in enumerate(x)], "series string, idx long, x double")


def column(df, name):
    return [r[name] for r in df.orderBy("idx").collect()]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=2, max_size=30))
def test_cusum_is_the_recursion(spark, x):
    up = down = 0.0
    want = []
    for v in x:
        up, down = max(0.0, up + v - 1 - 0.5), max(0.0, down + 1 - 0.5 - v)
        want.append((up, down))
    got = windows.cusum(rows(spark, x), 1.0, 0.5, 10.0).orderBy("idx").collect()
    assert [v for r in got for v in (r.s_up, r.s_down)] == pytest.approx([v for pair in want for v in pair])


def test_oscillation(spark):
    assert set(column(windows.mean_oscillation(rows(spark, [10.0] * 50), 5), "mo")) == {0.0}
    assert max(column(windows.mean_oscillation(rows(spark, [0.0] * 20 + [10.0] * 20), 6), "mo")) > 2
    x = [70.0] * 50
    x[30:35] = [130.0] * 5
    r = windows.oscillation_anomalies(rows(spark, x), 4, 2.0).where("is_anomaly").collect()
    assert {30, 31} & {k.idx for k in r}


def test_edge_denoise_and_transient(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([np.zeros(30), np.full(30, 20.0)]) + rng.normal(size=60)
    y = column(windows.edge_denoise(rows(spark, x), 6, 0.5), "y")
    assert np.std(y[8:22]) < np.std(x[8:22]) and abs(y[45] - 20) < 5
    f = windows.transient_filter(rows(spark, [70, 71, 70.5, 120, 70.2, 69.8]), 5, 4.0, 2.0).orderBy("idx").collect()
    assert f[3].weight < 0.5 and f[3].filtered < 120


def test_fractal(spark):
    t = np.arange(100)
    df = rows(spark, np.sin(t / 5) + 0.1 * np.random.default_rng(1).normal(size=100))
    assert 1 <= windows.katz_dimension(df).first().katz <= 2 and 1 <= windows.higuchi_dimension(df, 5).first().higuchi <= 2
    assert 0 <= recursive.chaos_metrics(df).first().hurst <= 1


def test_hampel_sees_earlier_corrections_and_kalman_smooths(spark):
    y, odd = recursive.hampel_values(np.array([1.0, 1.1, 0.9, 50.0, 1.0, 1.1, 0.9]))
    assert odd.tolist() == [False] * 3 + [True] + [False] * 3 and y[3] < 2
    assert recursive.denoise(rows(spark, [70, 72, 71, 180, 70, 69, 73, 70])).where("is_artifact").count() >= 1


def test_window_fusion(spark):
    df = spark.createDataFrame([("s", 1, "a", 70.0), ("s", 1, "b", 80.0), ("s", 2, "a", 72.0)], "series string, window long, sensor string, x double")
    got = recursive.fuse_windows(df).orderBy("window").collect()
    assert got[0].fused == 75.0 and got[0].variance == 2.0 and got[1].fused == 72.0


def test_grid(spark):
    nodes = [("f", i, j, k, float(i), 0.0, float(i), 0.0, 1.0) for i in range(4) for j in range(4) for k in range(4)]
    df = spark.createDataFrame(nodes, "field_id string, i long, j long, k long, p double, fx double, fy double, fz double, spacing double")
    got = grid.operators(df).collect()
    assert all(abs(r.gx - 1) < 1e-9 and abs(r.gy) < 1e-9 and abs(r.divergence) < 1e-9 and abs(r.cz - 1) < 1e-9 for r in got)


def test_latent_states_match_the_textbook_filters(spark):
    rng = np.random.default_rng(8)
    z = np.stack([rng.normal(72, 4, 30), rng.normal(38, 6, 30), rng.normal(33, 0.3, 30), rng.uniform(0, 60, 30)], axis=1)
    df = spark.createDataFrame([("p", k, float(k) * 2, *map(float, v)) for k, v in enumerate(z)], "series string, idx long, t double, heart_rate double, hrv_rmssd double, skin_temp double, activity_level double")
    mean, rate, sigma = np.array([120, 80, 97, 50, 100.0]), np.array([0.05, 0.05, 0.1, 0.08, 0.02]), np.array([2, 1.5, 0.5, 3, 5.0])
    h = np.array([[0.3, 0, 0, -0.2, 0.1], [-0.15, 0, 0, 0.8, 0], [0, 0, 0.01, 0.005, 0], [0, 0, 0, 0, 0]])
    r, base, dt = np.diag([4, 25, 0.04, 1.0]), np.array([60, 40, 33, 0.0]), 2.0
    f, q = np.diag(1 - rate * dt), np.diag(sigma**2 * (1 - np.exp(-2 * rate * dt)) / (2 * rate))
    for unscented in (False, True):
        x, p = mean.copy(), np.diag([25, 16, 1, 100, 400.0])
        got = recursive.latent_states(df, unscented=unscented).orderBy("idx").collect()
        for row, seen in zip(got, z):
            x, moved = x + rate * (mean - x) * dt, f @ p @ f.T
            p, y = moved + q, seen - base - h @ (x - mean)
            used = moved if unscented else p
            s = h @ used @ h.T + r
            k = used @ h.T @ np.linalg.inv(s)
            x = x + k @ y
            p = p - k @ s @ k.T if unscented else (np.eye(5) - k @ h) @ p
            assert [row[n] for n in recursive.STATES] == pytest.approx(x.tolist()) and row.trace == pytest.approx(np.trace(p))
            assert row.innovation_heart_rate == pytest.approx(y[0]) and row.spo2_high <= 100
            assert row.glucose_high - row.glucose_low == pytest.approx(2 * 1.96 * p[4, 4] ** 0.5) and row.spo2_reliable
    report = recursive.state_report(recursive.latent_states(df)).first()
    assert report.idx == 29 and report.innovation_heart_rate_std > 0
    wide = recursive.latent_states(df, level=0.99).orderBy("idx").first()
    assert wide.glucose_high - wide.glucose_low > got[0].glucose_high - got[0].glucose_low
    missing = recursive.latent_states(df.select("series", "idx", "t", F.lit(None).cast("double").alias("heart_rate"))).first()
    assert missing.systolic_bp == pytest.approx(120.0)


def test_spectrum_and_entropies(spark):
    n = 400
    rr = 800 + 40 * np.sin(2 * np.pi * 0.1 * np.arange(n) * 0.8) + np.random.default_rng(4).normal(0, 2, n)
    df = rows(spark, rr)
    for spectrum in (hrv.uneven_spectrum(df), hrv.even_spectrum(df)):
        b = hrv.band_powers(spectrum).first()
        assert b.lf_power > 5 * (b.hf_power + b.vlf_power) and b.lf_norm > 80 and b.total_power == pytest.approx(b.vlf_power + b.lf_power + b.hf_power)
    x = np.round(rr[:120], 0)
    tol, size = 0.2 * x.std(ddof=1), len(x)

    def phi(d):
        t = np.stack([x[k : size - d + 1 + k] for k in range(d)], axis=1)
        return np.mean(np.log((np.abs(t[:, None] - t[None]).max(axis=2) <= tol).mean(axis=1)))

    def matches(d, m):
        t = np.stack([x[k : size - m + k] for k in range(d)], axis=1)
        return int((np.abs(t[:, None] - t[None]).max(axis=2) <= tol).sum()) - len(t)

    e = hrv.entropies(rows(spark, x)).first()
    assert e.approximate_entropy == pytest.approx(phi(2) - phi(3))
    assert e.sample_entropy == pytest.approx(-np.log(matches(3, 2) / matches(2, 2)))
    flat = hrv.entropies(rows(spark, [800.0] * 20)).first()
    assert flat.approximate_entropy == flat.sample_entropy == 0.0
    short = hrv.report(rows(spark, [800.0, 810.0, 790.0])).first()
    assert short.total_power is None and "spectrum" in short.missing and short.sdnn == pytest.approx(10.0)


def test_filters_and_wavelets():
    rng = np.random.default_rng(3)
    x = rng.normal(size=101)
    low, detail = recursive.wavelet_split(x)
    assert len(low) == (101 + 7) // 2 and np.allclose(recursive.wavelet_join(low, detail, 101), x)
    t = np.arange(600)
    slow, wave = np.sin(2 * np.pi * t / 600), np.sin(2 * np.pi * t / 30)
    noisy = slow + wave + rng.normal(0, 0.2, 600)
    kept = recursive.zero_phase(slow + wave, 0.02, 2)
    assert np.abs(kept - slow)[50:-50].max() < 0.1
    clean = recursive.wavelet_shrink(noisy - wave)  # the wave's details lie near the threshold
    assert np.mean((clean - slow) ** 2) < 0.3 * np.mean((noisy - wave - slow) ** 2)
    assert recursive.wavelet_shrink(np.ones(5)).tolist() == [1.0] * 5 and recursive.zero_phase(np.ones(1), 0.1, 2).tolist() == [1.0]
    band = recursive.zero_phase(recursive.zero_phase(slow + wave, 0.03, 4, high=True), 0.2, 4)
    assert np.abs(band - wave)[60:-60].max() < 0.1


def test_spline_is_exact_on_cubics():
    t = np.sort(np.random.default_rng(1).uniform(0, 10, 12))
    f = lambda v: 2 * v**3 - v**2 + 3
    at = np.linspace(t[0], t[-1], 50)
    assert np.allclose(hrv.spline_values(t, f(t), at), f(at))


def test_ewma_zscore_is_the_loop(spark):
    x = np.random.default_rng(2).normal(50, 5, 40)
    a, mean, var, want = 2 / 21, x[0], 0.0, [0.0]
    for v in x[1:]:
        mean = a * v + (1 - a) * mean
        var = a * (v - mean) ** 2 + (1 - a) * var
        want.append((v - mean) / var**0.5)
    assert column(recursive.ewma_zscore(rows(spark, x)), "z") == pytest.approx(want)


def test_isolation_forest_finds_the_outlier(spark):
    x = np.random.default_rng(3).normal(size=(300, 2))
    x[0] = 12
    df = spark.createDataFrame(pd.DataFrame({"id": range(300), "a": x[:, 0], "b": x[:, 1]}))
    scored = models.isolation_score(df, ["a", "b"], models.isolation_fit(df, ["a", "b"], trees=20))
    assert scored.orderBy(F.desc("iso_score")).first().id == 0


def test_conformal_interval(spark):
    df = spark.createDataFrame([(0.9, 0.2), (0.9, None)], "p double, q double").select(*(c.alias(n) for n, c in models.conformal_interval(F.col("p"), F.col("q")).items()))
    a, b = df.collect()
    assert a.high == 1.0 and a.low == pytest.approx(0.7) and a.prediction_set == [1] and b.low == pytest.approx(0.75)
