"""Heart-rate variability beyond the time domain: spectra and bands, entropies, the whole report.

rows are (series, idx, x): R-R intervals in ms. Spectra come from sums per series and frequency
(uneven beats, by sorted series in batches) or from a grouped map (even resampling); entropies from a
join of near templates.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulselake.series.windows import hrv_time_domain, in_order, index_of, oscillation_profile, whole

# Bands in Hz, the frequency grid of uneven spectra.
BANDS = {"vlf": (0.003, 0.04), "lf": (0.04, 0.15), "hf": (0.15, 0.4)}
GRID = 1000
LEAST = 8


def real_intervals(rows: DataFrame) -> DataFrame:
    """Rows whose interval is a positive number."""
    return rows.where("x > 0 and not isnan(x) and x < double('infinity')").select("series", "idx", F.col("x").cast("double").alias("x"))


def _frequencies(points: int) -> np.ndarray:
    """Evenly spaced over the whole range of the bands."""
    low, high = BANDS["vlf"][0], BANDS["hf"][1]
    return low + np.arange(points) * ((high - low) / (points - 1))


def _spectra(batches: Iterator[pd.DataFrame], points: int) -> Iterator[tuple[list, np.ndarray]]:
    """Of beats sorted by series and place: series with LEAST or more, and their psd at each frequency (`windows.lomb_scargle` times 2 / n).

    The frequencies are even, so their turns are products of coarse and fine ones, and the sums over
    beats of turns, of x times turns and of squared turns are matrix products. They are carried over
    the end of a batch, so a long series is never held whole.
    """
    f = _frequencies(points)
    fine = 32
    coarse = 2j * np.pi * f[::fine]
    near = 2j * np.pi * np.arange(fine) * (f[1] - f[0])
    series, sums = None, None  # the open series: n, sum of x, time, sums of turns

    def add(x: np.ndarray) -> None:
        t = sums[2] + np.cumsum(x) / 1000
        a, b = np.exp(t[:, None] * coarse), np.exp(t[:, None] * near)
        sums[:] = sums[0] + len(x), sums[1] + x.sum(), t[-1], sums[3] + a.T @ b, sums[4] + (a * x[:, None]).T @ b, sums[5] + (a * a).T @ (b * b)

    def psd(done: list) -> np.ndarray:
        n, total = (np.array([d[k] for d in done], float)[:, None] for k in (0, 1))
        turns, with_x, squares = (np.stack([d[k].ravel()[:points] for d in done]) for k in (3, 4, 5))
        moved = with_x - total / n * turns
        cc, sq, cs = (n + squares.real) / 2, (n - squares.real) / 2, squares.imag / 2
        phase = np.arctan2(squares.imag, squares.real) / 2
        a, b = np.cos(phase), np.sin(phase)
        share = lambda num, den: np.divide(num * num, den, out=np.zeros(num.shape), where=den != 0)
        xc, xs = moved.real, moved.imag
        return (share(xc * a + xs * b, cc * a * a + 2 * cs * a * b + sq * b * b) + share(xs * a - xc * b, cc * b * b - 2 * cs * a * b + sq * a * a)) / n

    for pdf in chain(batches, [None]):
        names, done = [], []
        code = np.zeros(0, int) if pdf is None else pd.factorize(pdf["series"], use_na_sentinel=False)[0]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        for at, end in zip(first, [*first[1:], len(code)]):
            own = pdf["series"].iloc[at]
            if sums is None or own != series:
                if sums is not None:
                    names, done = [*names, series], [*done, sums]
                series, sums = own, [0, 0.0, 0.0, 0.0, 0.0, 0.0]
            x = pdf["x"].to_numpy(float)[at:end]
            for k in range(0, len(x), 1024):
                add(x[k : k + 1024])
        if pdf is None and sums is not None:
            names, done = [*names, series], [*done, sums]
        kept = [k for k, d in enumerate(done) if d[0] >= LEAST]
        for k in range(0, len(kept), 256):
            part = kept[k : k + 256]
            yield [names[j] for j in part], psd([done[j] for j in part])


def _in_order(rows: DataFrame) -> DataFrame:
    return real_intervals(rows).repartition("series").sortWithinPartitions(F.asc_nulls_last("series"), "idx").select("series", "x")


def uneven_spectrum(rows: DataFrame, points: int = GRID) -> DataFrame:
    """(series, f, psd) over the whole range of the bands, each beat at the sum of the intervals to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = _frequencies(points)
        for names, psd in _spectra(batches, points):
            yield pd.DataFrame({"series": np.repeat(np.array(names, object), points), "f": np.tile(f, len(names)), "psd": psd.ravel()})

    return _in_order(rows).mapInPandas(run, f"series {rows.schema['series'].dataType.simpleString()}, f double, psd double")


def uneven_bands(rows: DataFrame, points: int = GRID) -> DataFrame:
    """band_powers of uneven_spectrum without its rows: each series' powers are made where its spectrum is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = _frequencies(points)
        kind = np.select([(f >= low) & (f <= high) for low, high in BANDS.values()], range(len(BANDS)), -1)
        weight = np.zeros((points, len(BANDS)))
        for k in range(1, points):
            if kind[k] == kind[k - 1] >= 0:
                weight[k - 1 : k + 1, kind[k]] += (f[k] - f[k - 1]) / 2
        for names, psd in _spectra(batches, points):
            power = psd @ weight
            yield pd.DataFrame({"series": np.array(names, object)} | {f"{b}_power": power[:, k] for k, b in enumerate(BANDS)})

    powers = ", ".join(f"{b}_power double" for b in BANDS)
    return _shares(_in_order(rows).mapInPandas(run, f"series {rows.schema['series'].dataType.simpleString()}, {powers}"))


def spline_values(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through (t, y) whose third derivative is continuous at the second and last but one points."""
    h, n = np.diff(t), len(t)
    m = np.diff(y) / h
    low, mid, up, rhs = (np.zeros(n) for _ in range(4))
    low[1:-1], mid[1:-1], up[1:-1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    rhs[1:-1] = 3 * (h[1:] * m[:-1] + h[:-1] * m[1:])
    both = h[0] + h[1]
    mid[0], up[0], rhs[0] = h[1], both, ((h[0] + 2 * both) * h[1] * m[0] + h[0] ** 2 * m[1]) / both
    both = h[-1] + h[-2]
    mid[-1], low[-1], rhs[-1] = h[-2], both, (h[-1] ** 2 * m[-2] + (2 * both + h[-1]) * h[-2] * m[-1]) / both
    for k in range(1, n):  # elimination and back substitution of the three diagonals
        w = low[k] / mid[k - 1]
        mid[k] -= w * up[k - 1]
        rhs[k] -= w * rhs[k - 1]
    s = np.empty(n)
    s[-1] = rhs[-1] / mid[-1]
    for k in range(n - 2, -1, -1):
        s[k] = (rhs[k] - up[k] * s[k + 1]) / mid[k]
    i = np.clip(np.searchsorted(t, at, "right") - 1, 0, n - 2)
    d = at - t[i]
    c2, c3 = (3 * m[i] - 2 * s[i] - s[i + 1]) / h[i], (s[i] + s[i + 1] - 2 * m[i]) / h[i] ** 2
    return y[i] + d * (s[i] + d * (c2 + d * c3))


def welch_values(x: np.ndarray, fs: float, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """One-sided mean of the periodograms of half-overlapping segments under a Hann window, each without its mean."""
    segment = min(segment, len(x))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    starts = np.arange(0, len(x) - segment + 1, segment - segment // 2)
    parts = np.stack([x[s : s + segment] for s in starts])
    power = np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2 / (fs * (window**2).sum())
    power[:, 1 : -1 if segment % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(segment, 1 / fs), power.mean(axis=0)


def even_spectrum(rows: DataFrame, fs: float = 4.0, segment: int = 256) -> DataFrame:
    """(series, f, psd) of each series resampled evenly; series too short for it are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("idx", kind="stable")["x"].to_numpy(float)
        t = np.cumsum(x) / 1000
        n = int((t[-1] - t[0]) * fs) if len(x) >= LEAST else 0
        if n < LEAST:
            return pd.DataFrame({"series": [], "f": [], "psd": []})
        even = spline_values(t - t[0], x - x.mean(), np.linspace(0, t[-1] - t[0], n, endpoint=False))
        f, psd = welch_values(even, fs, max(16, min(segment, n)))
        return pd.DataFrame({"series": pdf["series"].iloc[0], "f": f, "psd": psd})

    return real_intervals(rows).groupBy("series").applyInPandas(run, "series string, f double, psd double")


def band_powers(spectrum: DataFrame) -> DataFrame:
    """Power in each band by trapezoids, their sum, the LF/HF ratio and shares of LF + HF, per series."""
    kind = None
    for name, (low, high) in BANDS.items():
        inside = F.col("f").between(low, high)
        kind = F.when(inside, name) if kind is None else kind.when(inside, name)
    by = W.partitionBy("series").orderBy("f")
    s = spectrum.withColumn("band", kind).where("band is not null")
    step = (F.col("psd") + F.lag("psd").over(by)) / 2 * (F.col("f") - F.lag("f").over(by))
    s = s.withColumn("area", F.when(F.lag("band").over(by) == F.col("band"), step).otherwise(0.0))
    of = lambda b: F.coalesce(F.sum(F.when(F.col("band") == b, F.col("area"))), F.lit(0.0)).alias(f"{b}_power")
    return _shares(s.groupBy("series").agg(*map(of, BANDS)))


def _shares(p: DataFrame) -> DataFrame:
    vlf, lf, hf = (F.col(f"{b}_power") for b in BANDS)
    share = lambda x: F.when(lf + hf > 1e-10, 100 * x / (lf + hf)).otherwise(0.0)
    ratio = F.when(hf > 1e-10, lf / hf).otherwise(F.lit(float("inf")))
    return p.withColumns({"total_power": vlf + lf + hf, "lf_hf_ratio": ratio, "lf_norm": share(lf), "hf_norm": share(hf)})


def entropies(rows: DataFrame, m: int = 2, r: float = 0.2) -> DataFrame:
    """Approximate and sample entropy per series (tolerance r sample deviations; a flat series: 0).

    Templates meet by a join on cells of the tolerance in their first two values. Approximate entropy
    counts each template itself; sample entropy is infinite without matches.
    """
    lead = {f"x{k}": F.lead("x", k).over(in_order()) for k in range(m + 1)}
    t = real_intervals(rows).withColumns({"n": F.count("*").over(whole()), "tol": r * F.stddev_samp("x").over(whole())}).withColumns(lead)
    flat = t.groupBy("series").agg(F.max("n").alias("n"), F.max("tol").alias("tol")).where(F.col("n") >= m + 2)
    t = t.where((F.col("n") >= m + 2) & (F.col("tol") > 1e-10 * r) & F.col(f"x{m - 1}").isNotNull())
    cell = lambda c: F.floor(F.col(c) / F.col("tol"))
    near3 = lambda c: F.explode(F.array(*(cell(c) + d for d in (-1, 0, 1))))
    own = t.withColumns({"c0": cell("x0"), "c1": cell("x1")})
    other = t.withColumn("c0", near3("x0")).withColumn("c1", near3("x1")).select("series", F.col("idx").alias("j"), "c0", "c1", *(F.col(f"x{k}").alias(f"y{k}") for k in range(m + 1)))
    close = " and ".join(f"abs(x{k} - y{k}) <= tol" for k in range(m))
    pairs = own.join(other, ["series", "c0", "c1"]).where(close)
    longer = F.expr(f"coalesce(abs(x{m} - y{m}) <= tol, false)")
    both = F.expr(f"x{m} is not null and y{m} is not null")
    per = pairs.groupBy("series", "idx").agg(
        F.max("n").alias("n"), F.count("*").alias("c"), F.count_if(longer).alias("d"), F.count_if(both & (F.col("idx") != F.col("j"))).alias("b"), F.count_if(longer & (F.col("idx") != F.col("j"))).alias("a")
    )
    phi = lambda count, size: F.sum(F.when(F.col(count) > 0, F.log(F.col(count) / size))) / F.first(size)
    g = per.groupBy("series").agg(
        (phi("c", F.col("n") - m + 1) - phi("d", F.col("n") - m)).alias("apen"), F.sum("a").alias("a"), F.sum("b").alias("b")
    )
    infinite = F.lit(float("inf"))
    sampen = F.when((F.col("a") > 0) & (F.col("b") > 0), -F.log(F.col("a") / F.col("b"))).otherwise(infinite)
    known = flat.join(g, "series", "left")
    moving = F.col("tol") > 1e-10 * r
    return known.select("series", F.when(moving, F.col("apen")).otherwise(0.0).alias("approximate_entropy"), F.when(moving, sampen).otherwise(0.0).alias("sample_entropy"))


def report(rows: DataFrame, uneven: bool = True) -> DataFrame:
    """Count, duration, time domain, bands, entropies and oscillation per series; a part without enough data is null, with its reason."""
    rr = real_intervals(rows)
    meta = rr.groupBy("series").agg(F.count("*").alias("n_intervals"), (F.sum("x") / 1000).alias("duration_seconds")).where("n_intervals >= 2")
    time = hrv_time_domain(rr).drop("n")
    bands = uneven_bands(rr) if uneven else band_powers(even_spectrum(rr))
    profile = oscillation_profile(rr, (4, 8, 16, 32))
    at = lambda s: F.coalesce(F.max(F.when(F.col("scale") == s, F.col("mean_mo"))), F.lit(0.0)).alias(f"mo_scale_{s}")
    oscillation = profile.groupBy("series").agg(*index_of(4), at(4), at(16))
    joined = meta
    for part in (time, bands, entropies(rr), oscillation):
        joined = joined.join(part, "series", "left")
    missing = lambda c, text: F.when(F.col(c).isNull(), F.lit(text))
    reasons: list[Column] = [missing("total_power", "spectrum: too few intervals"), missing("sample_entropy", "entropy: too few intervals"), missing("norm", "oscillation: too few intervals")]
    return joined.withColumn("missing", F.array_join(F.array_compact(F.array(*reasons)), "; "))
