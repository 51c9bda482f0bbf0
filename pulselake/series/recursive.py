"""Recursive filters by grouped maps over ordered series.

Each function gets one series at a time (series length bounds a task's memory), sorts it itself and
runs plain NumPy recursions. Rows go in by one shuffle on series. Hampel and Kalman over long series are in `chunks`.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulselake.series.chunks import denoise_rows as denoise  # noqa: F401  by pieces, like hampel_rows


def _mapped(rows: DataFrame, fn, extra: str) -> DataFrame:
    """rows with columns added by fn(sorted x array) -> dict of arrays."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + extra

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable").reset_index(drop=True)
        return pdf.assign(**fn(pdf["x"].to_numpy(float)))

    return rows.groupBy("series").applyInPandas(run, schema)


_BLOCK = 64


def decayed(x: np.ndarray, a: float, start: float) -> np.ndarray:
    """y[k] = a x[k] + (1 - a) y[k - 1] from y[-1] = start: a matrix product per block, one carried value between blocks."""
    n = len(x)
    k = np.arange(_BLOCK)
    inner = np.where(k[:, None] >= k[None, :], a * (1 - a) ** np.maximum(0, k[:, None] - k[None, :]), 0.0)
    fade = (1 - a) ** (k + 1)
    out = np.pad(x, (0, -n % _BLOCK)).reshape(-1, _BLOCK) @ inner.T
    for row in out:
        row += fade * start
        start = row[-1]
    return out.ravel()[:n]


def ewma_zscore(rows: DataFrame, span: int = 20, limit: float = 3.0) -> DataFrame:
    """Adaptive z-score: mean updated before variance and score; the first point scores 0."""
    a = 2.0 / (span + 1)

    def fn(x):
        mean = np.concatenate([x[:1], decayed(x[1:], a, x[0])]) if len(x) else x
        off = x - mean
        var = np.concatenate([np.zeros(min(1, len(x))), decayed(off[1:] ** 2, a, 0.0)])
        sd = np.sqrt(var)
        z = np.divide(off, sd, out=np.zeros(len(x)), where=sd >= 1e-12)
        return {"z": z, "alarm": np.abs(z) > limit}

    return _mapped(rows, fn, "z double, alarm boolean")


def ewma_baseline(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Exponential baseline from the first value on."""

    def fn(x):
        return {"baseline": np.concatenate([x[:1], decayed(x[1:], alpha, x[0])]) if len(x) else x}

    return _mapped(rows, fn, "baseline double")


def hampel_values(x: np.ndarray, half: int = 3, limit: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """In-place Hampel filter: earlier corrections are seen by later windows."""
    y, odd = x.copy(), np.zeros(len(x), bool)
    for k in range(len(x)):
        near = y[max(0, k - half) : k + half + 1]
        mid = np.median(near)
        mad = np.median(np.abs(near - mid))
        if mad >= 1e-6 and abs(y[k] - mid) > limit * 1.4826 * mad:
            y[k], odd[k] = mid, True
    return y, odd


def kalman_values(x: np.ndarray, q: float, r: float, start: float | None = None) -> np.ndarray:
    """Value-and-rate Kalman filter with F = [[1, 1], [0, .95]]."""
    f, h = np.array([[1.0, 1.0], [0.0, 0.95]]), np.array([1.0, 0.0])
    s, p, out = np.array([x[0] if start is None else start, 0.0]) if len(x) else None, 10.0 * np.eye(2), np.empty(len(x))
    for k, v in enumerate(x):
        s, p = f @ s, f @ p @ f.T + q * np.eye(2)
        gain = p @ h / (h @ p @ h + r)
        s = s + gain * (v - s[0])
        p = p - np.outer(gain, h @ p)
        out[k] = s[0]
    return out


#: Variance of a sensor that has not been seen, and the weight of its variance so far.
FIRST_VARIANCE, KEPT = 4.0, 0.9


def fuse_step(var: dict[str, float], last: float | None, z: dict[str, float], lam: float = KEPT, start: float = FIRST_VARIANCE) -> tuple[float, float]:
    """Fused value and variance of one window's readings by sensor; updates the sensors' variances by the residual against the window before."""
    own = {s: var.setdefault(s, start) for s in z}
    total = sum(1 / v for v in own.values())
    alone = len(z) == 1  # then its value and variance as they are, without the rounding of two divisions
    fused = next(iter(z.values())) if alone else sum(z[s] / own[s] for s in z) / total
    spread = next(iter(own.values())) if alone else 1 / total
    if last is not None:
        gain = round(1 - lam, 12)  # 0.1 of 0.9, not 0.09999999999999998
        for s in z:
            var[s] = lam * var[s] + gain * (z[s] - last) ** 2
    return float(fused), float(spread)


def fuse_windows(readings: DataFrame, lam: float = KEPT, start: float = FIRST_VARIANCE) -> DataFrame:
    """Inverse-variance fusion of (series, window, sensor, x): variances follow the residual against the window before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        var: dict[str, float] = {}
        last, out = None, []
        for window, g in pdf.sort_values(["window", "sensor"]).groupby("window", sort=True):
            last, spread = fuse_step(var, last, dict(zip(g["sensor"], g["x"])), lam, start)
            out.append((g["series"].iloc[0], window, last, spread, len(g)))
        return pd.DataFrame(out, columns=["series", "window", "fused", "variance", "n_sensors"])

    return readings.groupBy("series").applyInPandas(run, "series string, window long, fused double, variance double, n_sensors int")


def blue_fusion(rows: DataFrame, sensors: list[str], lam: float = 0.95) -> DataFrame:
    """Row-wise best linear fusion of sensor columns; variances follow the fused value; Grubbs flags one outlier a row.

    The two-sided 5 % Grubbs limit for three to six sensors is a fixed table.
    """
    limit = {3: 1.1543, 4: 1.4812, 5: 1.7150, 6: 1.8871}  # fixed values
    names = list(sensors)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable").reset_index(drop=True)
        x = pdf[names].to_numpy(float)
        var, fused, spread, n_on, odd = np.ones(len(names)), np.full(len(x), np.nan), np.full(len(x), np.nan), np.zeros(len(x), np.int32), np.zeros(len(x), bool)
        for k, row in enumerate(x):
            on = ~np.isnan(row)
            n_on[k] = on.sum()
            if not n_on[k]:
                continue
            w = 1 / var[on]
            fused[k], spread[k] = (w * row[on]).sum() / w.sum(), 1 / w.sum()
            if n_on[k] >= 3 and (sd := row[on].std(ddof=1)) > 0:
                odd[k] = np.abs(row[on] - row[on].mean()).max() / sd > limit.get(int(n_on[k]), 1.8871)
            if n_on[k] > 1:
                var[on] = np.maximum(1e-9, lam * var[on] + (1 - lam) * (row[on] - fused[k]) ** 2)
        return pd.DataFrame({"series": pdf["series"], "idx": pdf["idx"], "fused": fused, "variance": spread, "n_active": n_on, "has_outlier": odd})

    return rows.groupBy("series").applyInPandas(run, "series string, idx long, fused double, variance double, n_active int, has_outlier boolean")


STATES = ("systolic_bp", "diastolic_bp", "spo2", "vagal_tone", "glucose")
OBSERVED = ("heart_rate", "hrv_rmssd", "skin_temp", "activity_level")
# Fixed values of the latent model: set points, return rates, diffusion, start variances, variances that count as reliable;
# observations at the set points, their rows by state, their variances.
_MEAN = np.array([120.0, 80.0, 97.0, 50.0, 100.0])
_RATE = np.array([0.05, 0.05, 0.1, 0.08, 0.02])
_SIGMA = np.array([2.0, 1.5, 0.5, 3.0, 5.0])
_P0 = np.diag([25.0, 16.0, 1.0, 100.0, 400.0])
_RELIABLE = np.array([144.0, 64.0, 4.0, 225.0, 625.0])
_OBS = np.array([60.0, 40.0, 33.0, 0.0])
_H = np.array([[0.3, 0.0, 0.0, -0.2, 0.1], [-0.15, 0.0, 0.0, 0.8, 0.0], [0.0, 0.0, 0.01, 0.005, 0.0], [0.0, 0.0, 0.0, 0.0, 0.0]])
_R = np.array([4.0, 25.0, 0.04, 1.0])


def latent_step(s: np.ndarray, p: np.ndarray, z: np.ndarray, dt: float, unscented: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One predict-and-update of the mean-reverting latent model: (state, covariance, innovation).

    Missing observations (nan) are skipped and have innovation nan. Both models are linear, so sigma
    points carry mean and covariance exactly; unscented differs only in drawing them before the
    process noise is added, which its gain therefore leaves out.
    """
    decay = 1 - _RATE * dt
    noise = np.diag(_SIGMA**2 * (1 - np.exp(-2 * _RATE * dt)) / (2 * _RATE))
    s, moved = _MEAN + decay * (s - _MEAN), decay[:, None] * p * decay[None, :]
    p = moved + noise
    innovation = z - _OBS - _H @ (s - _MEAN)
    on = ~np.isnan(z)
    if on.any():
        h, r = _H[on], np.diag(_R[on])
        seen = moved if unscented else p
        spread = h @ seen @ h.T + r
        gain = seen @ h.T @ np.linalg.inv(spread)
        s = s + gain @ innovation[on]
        left = np.eye(len(s)) - gain @ h
        p = p - gain @ spread @ gain.T if unscented else left @ p @ left.T + gain @ r @ gain.T
    return s, (p + p.T) / 2, innovation


def latent_steps(s: np.ndarray, p: np.ndarray, z: np.ndarray, dt: np.ndarray, unscented: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """latent_step of many series at once: states (m, 5), covariances (m, 5, 5), observations (m, 4) and steps (m).

    A missing observation has a row of zeros in the model, so its gain is 0.
    """
    decay = 1 - _RATE * dt[:, None]
    noise = _SIGMA**2 * (1 - np.exp(-2 * _RATE * dt[:, None])) / (2 * _RATE)
    s, moved = _MEAN + decay * (s - _MEAN), decay[:, :, None] * p * decay[:, None, :]
    p = moved + noise[:, :, None] * np.eye(len(_MEAN))
    innovation = z - _OBS - (s - _MEAN) @ _H.T
    on = ~np.isnan(z)
    h, r = _H * on[:, :, None], np.diag(_R)
    across = h.transpose(0, 2, 1)
    seen = (moved if unscented else p) @ across
    spread = h @ seen + r
    gain = seen @ np.linalg.inv(spread)
    s = s + (gain @ np.where(on, innovation, 0.0)[:, :, None])[:, :, 0]
    left = np.eye(len(_MEAN)) - gain @ h
    back = gain.transpose(0, 2, 1)
    p = p - gain @ spread @ back if unscented else left @ p @ left.transpose(0, 2, 1) + gain @ r @ back
    return s, (p + p.transpose(0, 2, 1)) / 2, innovation


def normal_quantile(level: float) -> float:
    """Half-width in deviations of a central interval."""
    return 1.96 if level == 0.95 else NormalDist().inv_cdf(0.5 + level / 2)


def latent_states(vitals: DataFrame, level: float = 0.95, unscented: bool = False) -> DataFrame:
    """Filtered latent states of each series (idx, t and the OBSERVED columns), with bounds, reliability, trace and innovations.

    dt is the median step of t, 1 if that is not positive or a step is unknown. An absent column
    counts as its value at the set points; a null in a row is skipped. Sorted series pass in batches:
    the series of a batch take their steps together, and the one that a batch ends in goes on in the next.
    """
    fields = ", ".join(f"{n} double, {n}_low double, {n}_high double, {n}_reliable boolean" for n in STATES)
    more = ", ".join(f"innovation_{n} double" for n in OBSERVED)
    width, here = normal_quantile(level), [n for n in OBSERVED if n in vitals.columns]
    top = np.array([100.0 if n == "spo2" else np.inf for n in STATES])
    of, t = W.partitionBy("series"), F.col("t").cast("double")
    gap = t - F.lag(t).over(of.orderBy(F.asc_nulls_last("idx")))
    steps = vitals.withColumn("_gap", F.when(~F.isnan(gap), gap)).withColumns({"_dt": F.median("_gap").over(of), "_unknown": F.count("*").over(of) - 1 - F.count("_gap").over(of)})
    dt = F.when((F.col("_unknown") == 0) & (F.col("_dt") > 0), F.col("_dt")).otherwise(1.0)
    given = steps.select("series", "idx", dt.alias("dt"), *(F.col(n).cast("double").alias(n) for n in here)).repartition("series").sortWithinPartitions(F.asc_nulls_last("series"), F.asc_nulls_last("idx"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # series, state and covariance that the batch before ended in
        for pdf in batches:
            if not len(pdf):
                continue
            n = len(pdf)
            code = pd.factorize(pdf["series"], use_na_sentinel=False)[0]  # sorted, so series come one after the other
            first = np.flatnonzero(np.diff(code, prepend=-1))
            place, size = np.arange(n) - first[code], np.diff(first, append=n)
            z = np.stack([pdf[c].to_numpy(float) if c in here else np.full(n, v) for c, v in zip(OBSERVED, _OBS)], axis=1)
            step = pdf["dt"].to_numpy(float)
            s, p = np.tile(_MEAN, (len(first), 1)), np.tile(_P0, (len(first), 1, 1))
            if last is not None and last[0] == pdf["series"].iloc[0]:
                s[0], p[0] = last[1:]
            states, var, seen = np.empty((n, len(STATES))), np.empty((n, len(STATES))), np.empty((n, len(OBSERVED)))
            left = np.arange(len(first))
            for k in range(place.max() + 1):
                left = left[size[left] > k]
                at = first[left] + k
                s[left], p[left], seen[at] = latent_steps(s[left], p[left], z[at], step[at], unscented)
                states[at], var[at] = s[left], np.diagonal(p[left], axis1=1, axis2=2)
            last = pdf["series"].iloc[-1], s[-1], p[-1]
            half = width * np.sqrt(var)
            low, high = np.clip(states - half, 0.0, top), np.minimum(top, np.where(np.isfinite(top), np.maximum(0.0, states + half), states + half))
            out = {"series": pdf["series"], "idx": pdf["idx"]}
            for k, name in enumerate(STATES):
                out |= {name: states[:, k], f"{name}_low": low[:, k], f"{name}_high": high[:, k], f"{name}_reliable": var[:, k] < _RELIABLE[k]}
            yield pd.DataFrame(out | {"trace": var.sum(axis=1)} | {f"innovation_{name}": seen[:, k] for k, name in enumerate(OBSERVED)})

    return given.mapInPandas(run, f"series string, idx long, {fields}, trace double, {more}")


def state_report(states: DataFrame, last: int = 100) -> DataFrame:
    """The newest row of each series of latent_states, with mean and deviation of the last innovations."""
    back = W.partitionBy("series").orderBy(F.desc("idx"))
    near = states.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= last)
    newest = [c for c in states.columns if c not in ("series", "idx")]
    now = [F.max(F.when(F.col("_back") == 1, F.col(c))).alias(c) for c in ("idx", *newest)]
    real = lambda n: F.when(~F.isnan(f"innovation_{n}"), F.col(f"innovation_{n}"))
    spread = [f(real(n)).alias(f"innovation_{n}_{a}") for n in OBSERVED for f, a in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return near.groupBy("series").agg(*now, *spread)


def hurst_values(x: np.ndarray) -> float:
    """Rescaled-range exponent over eight log-spaced sizes; short series are 0.5."""
    n = len(x)
    if n < 20:
        return 0.5
    sizes = np.unique(np.logspace(np.log10(8), np.log10(n // 2), 8).astype(int))
    pts = []
    for size in sizes:
        parts = x[: n // size * size].reshape(-1, size)
        dev = np.cumsum(parts - parts.mean(axis=1, keepdims=True), axis=1)
        sd = parts.std(axis=1)
        ok = sd > 0
        if ok.any():
            pts.append((np.log(size), np.log(((dev.max(axis=1) - dev.min(axis=1))[ok] / sd[ok]).mean())))
    if len(pts) < 2:
        return 0.5
    return float(np.clip(np.polyfit(*zip(*pts), 1)[0], 0, 1))


def lyapunov_values(x: np.ndarray, dim: int = 3) -> float:
    """Mean log growth of the distance to the nearest neighbour in a delay embedding, clipped to -2..5."""
    if len(x) < dim + 8:
        return 0.0
    e = np.stack([x[k : len(x) - dim + 1 + k] for k in range(dim)], axis=1)
    m = len(e) - 1
    out = []
    for k in range(m):  # one row of distances at a time
        d = np.linalg.norm(e[:m] - e[k], axis=1)
        d[max(0, k - 2) : k + 3] = np.inf
        j = int(d.argmin())
        after = np.linalg.norm(e[k + 1] - e[j + 1])
        if np.isfinite(d[j]) and d[j] > 0 and after > 0:
            out.append(np.log(after / d[j]))
    return float(np.clip(np.mean(out), -2, 5)) if out else 0.0


def chaos_metrics(rows: DataFrame) -> DataFrame:
    """Hurst and local Lyapunov exponents of each series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("idx")["x"].to_numpy(float)
        return pd.DataFrame([(pdf["series"].iloc[0], hurst_values(x), lyapunov_values(x))], columns=["series", "hurst", "lyapunov"])

    return rows.groupBy("series").applyInPandas(run, "series string, hurst double, lyapunov double")


# Low-pass filter of the wavelet with four vanishing moments.
_WAVELET = np.array([-0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114, -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523])


def zero_phase(x: np.ndarray, cut: float, order: int, high: bool = False) -> np.ndarray:
    """Butterworth filter run forward and backward, as its squared gain over the odd extension of x; cut is a share of Nyquist."""
    n = len(x)
    pad = min(n - 1, 3 * max(order + 1, int(np.ceil(1 / cut))))
    if pad < 1:
        return x.copy()
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    f = np.fft.rfftfreq(len(wide), 0.5)  # shares of Nyquist
    with np.errstate(divide="ignore"):
        ratio = np.tan(np.pi * np.minimum(f, 1 - 1e-12) / 2) / np.tan(np.pi * cut / 2)
        gain = 1 / (1 + ratio ** (2 * order)) if not high else 1 - 1 / (1 + ratio ** (2 * order))
    return np.fft.irfft(np.fft.rfft(wide) * gain, len(wide))[pad : pad + n]


def wavelet_split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level of the wavelet transform of x with mirrored edges: (approximation, detail)."""
    size = len(_WAVELET)
    high = _WAVELET[::-1] * (-1.0) ** np.arange(1, size + 1)
    wide = np.pad(x, size - 1, mode="symmetric")
    return np.convolve(wide, _WAVELET, "valid")[1::2], np.convolve(wide, high, "valid")[1::2]


def wavelet_join(low: np.ndarray, detail: np.ndarray, n: int) -> np.ndarray:
    """The n values whose wavelet_split gave (low, detail)."""
    size = len(_WAVELET)
    high = _WAVELET[::-1] * (-1.0) ** np.arange(1, size + 1)
    up = lambda c: np.stack([c, np.zeros(len(c))], axis=1).ravel()[:-1]
    y = np.convolve(up(low), _WAVELET[::-1]) + np.convolve(up(detail), high[::-1])
    return y[size - 2 : size - 2 + n]


def wavelet_shrink(x: np.ndarray, level: int = 4) -> np.ndarray:
    """Soft thresholding of the details at the universal threshold of the finest ones' deviation; short series stay."""
    n, size = len(x), len(_WAVELET)
    level = min(level, int(np.log2(n / (size - 1))) if n >= size - 1 else 0)
    if level < 1:
        return x.copy()
    low, details = x, []
    for _ in range(level):
        sizes = len(low)
        low, detail = wavelet_split(low)
        details.append((detail, sizes))
    finest = details[0][0]
    limit = np.median(np.abs(finest - np.median(finest))) / 0.6745 * np.sqrt(2 * np.log(n))
    for detail, sizes in reversed(details):
        low = wavelet_join(low, np.sign(detail) * np.maximum(0.0, np.abs(detail) - limit), sizes)
    return low[:n]


def split_trend(rows: DataFrame, cut: float = 0.01, band: tuple[float, float] | None = None) -> DataFrame:
    """Trend (zero-phase low-pass of order 2), physiological part and noise, with the signal-to-noise ratio in dB.

    The physiological part is what wavelet shrinkage leaves of the rest, or with band its zero-phase
    band-pass of order 4. Without noise the ratio is infinite.
    """

    def fn(x):
        n = len(x)
        t = zero_phase(x, cut, 2)
        rest = x - t
        p = wavelet_shrink(rest) if band is None else zero_phase(zero_phase(rest, band[0], 4, high=True), band[1], 4)
        e = rest - p
        power = float(np.mean(e**2)) if n else 0.0
        ratio = 10 * np.log10(np.mean((t + p) ** 2) / power) if power >= 1e-15 else np.inf
        return {"trend": t, "physiological": p, "noise": e, "snr_db": np.full(n, ratio)}

    return _mapped(rows, fn, "trend double, physiological double, noise double, snr_db double")
