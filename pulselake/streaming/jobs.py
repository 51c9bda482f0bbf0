"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pulselake.clinical.alerts import decide
from pulselake.operators import bronze
from pulselake.operators.silver import anomaly_score
from pulselake.series.recursive import _MEAN, _P0, OBSERVED, STATES, decayed, fuse_step, latent_steps
from pulselake.functions.scalar import rnd


def ingest(readings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Validated bronze rows appended by date; replays are dropped by event id within the watermark."""
    once = readings.withWatermark("timestamp_utc", "10 minutes").dropDuplicatesWithinWatermark(["event_id"])
    valid = bronze.validate(once)
    return valid.writeStream.format("parquet").partitionBy("partition_date").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reconcile_stream(readings: DataFrame, width: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """Tumbling-window reconciliation with a watermark: mean, deviation, devices, count, anomaly."""
    w = readings.withWatermark("timestamp_utc", late).groupBy("patient_id", "metric_type", F.window("timestamp_utc", width).alias("w")).agg(
        F.avg("metric_value").alias("value"), F.coalesce(F.stddev_samp("metric_value"), F.lit(0.0)).alias("std"), F.sort_array(F.collect_set("device_id")).alias("devices_involved"), F.count("*").cast("int").alias("reading_count")
    )
    odd = anomaly_score(F.col("metric_type"), F.col("value"), F.lit("unknown"), F.lit("unknown"))
    return w.select("patient_id", "metric_type", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), rnd("value", 2).alias("metric_value"), rnd("std", 2).alias("metric_std"), "devices_involved", "reading_count", odd.isNotNull().alias("is_anomaly"), F.coalesce(odd, F.lit(0.0)).alias("anomaly_score"))


def episode_stream(silver: DataFrame, width_seconds: int = 5, gap_seconds: int = 30, late: str = "10 minutes") -> DataFrame:
    """Session windows of anomalous windows: a session merges while the next start is at most gap_seconds after the last end."""
    gap = f"{width_seconds + gap_seconds} seconds"
    g = silver.where("is_anomaly").withWatermark("window_start", late).groupBy("patient_id", F.session_window("window_start", gap).alias("s"))
    e = g.agg(F.sort_array(F.collect_set("metric_type")).alias("metrics_involved"), F.max("anomaly_score").alias("max_anomaly_score"), F.count("*").alias("reading_count"))
    return e.select("patient_id", F.col("s.start").alias("episode_start"), F.timestamp_seconds(F.unix_seconds("s.end") - gap_seconds).alias("episode_end"), "metrics_involved", "max_anomaly_score", "reading_count")


#: Keyed state with lists, maps, timers and expiry needs this store.
_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_STEPS = "patient_id string, ts timestamp, heart_rate double, history_size int, recent_mean double, " + ", ".join(f"{n} double" for n in STATES)


#: Groups of patients whose filters take their steps together; a patient's state is an entry of its group's map.
BUCKETS = 1024


class LatentProcessor(StatefulProcessor):
    """Of each patient of a group: the filter (state, covariance, readings so far) and the last heart rates, oldest first."""

    def __init__(self, keep: int, hours: int | None):
        self.keep, self.ttl = keep, hours and hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.patients = handle.getMapState("patients", "patient_id string", "s array<double>, p array<double>, n long, recent array<double>", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["patient_id", "ts", *OBSERVED], kind="stable", ignore_index=True)
        first = np.flatnonzero(np.diff(pd.factorize(pdf["patient_id"], use_na_sentinel=False)[0], prepend=-1))
        size = np.diff(first, append=len(pdf))
        ids = [None if pd.isna(v) else v for v in pdf["patient_id"].iloc[first]]
        s, p = np.tile(_MEAN, (len(ids), 1)), np.tile(_P0, (len(ids), 1, 1))
        held, before = [np.zeros(0)] * len(ids), np.zeros(len(ids), int)
        for j, name in enumerate(ids):
            if self.patients.containsKey((name,)):
                own = self.patients.getValue((name,))
                s[j], p[j], before[j], held[j] = own[0], np.reshape(own[1], _P0.shape), own[2], np.array(own[3], float)
        z, states, left = pdf[list(OBSERVED)].to_numpy(float), np.empty((len(pdf), len(STATES))), np.arange(len(ids))
        for k in range(size.max(initial=0)):
            left = left[size[left] > k]
            at = first[left] + k
            s[left], p[left], _ = latent_steps(s[left], p[left], z[at], np.ones(len(at)))
            states[at] = s[left]
        rate, mean = pdf["heart_rate"].to_numpy(float), np.full(len(pdf), np.nan)
        for j, (at, n) in enumerate(zip(first, size)):
            all_ = np.concatenate([np.full(self.keep - 1, np.nan), held[j], rate[at : at + n]])
            for k in range(0, n, 4096):  # windows of the keep rates up to a row
                last = np.lib.stride_tricks.sliding_window_view(all_[len(held[j]) + k :], self.keep)[: min(4096, n - k)]
                known = ~np.isnan(last)
                count = known.sum(axis=1)
                mean[at + k : at + k + len(last)] = np.divide(np.where(known, last, 0.0).sum(axis=1), count, out=np.full(len(last), np.nan), where=count > 0)
            recent = all_[self.keep - 1 :][-self.keep :]
            self.patients.updateValue((ids[j],), (s[j].tolist(), p[j].ravel().tolist(), int(before[j] + n), recent.tolist()))
        place = np.arange(len(pdf)) - np.repeat(first, size)
        history = np.minimum(np.repeat(before, size) + place + 1, self.keep)
        yield pd.DataFrame({"patient_id": pdf["patient_id"], "ts": pdf["ts"], "heart_rate": rate, "history_size": history, "recent_mean": mean} | {c: states[:, k] for k, c in enumerate(STATES)})

    def close(self) -> None:
        pass


def latent_stream(vitals: DataFrame, keep: int = 100, hours: int | None = 24) -> DataFrame:
    """Latent-state filter per patient carried between batches, one row a reading, with its last keep heart rates; state expires after idle hours.

    Patients are keyed in BUCKETS groups, so that a batch steps many of them at once; each has its own
    entry of the state. Without hours the state stays, as a run that ends by itself (availableNow)
    needs. A reading is one step of the model, so the states are those of `latent_states` on the same readings.

    vitals: patient_id, ts and the observations heart_rate, hrv_rmssd, skin_temp, activity_level; nulls are skipped.
    """
    dealt = vitals.withColumn("bucket", F.pmod(F.xxhash64("patient_id"), F.lit(BUCKETS))).groupBy("bucket")
    return dealt.transformWithStateInPandas(LatentProcessor(keep, hours), _STEPS, "Append", "ProcessingTime" if hours else "None")


_READING = ["series", "sensor", "at", "tie", "x"]
_FUSED = ["series", "window", "fused", "variance", "n_sensors"]


def _newest(readings: pd.DataFrame) -> pd.DataFrame:
    """The newest reading of each sensor of a series in a window (ties: the larger tie, then the first to come)."""
    return readings.sort_values(["at", "tie"], ascending=False, kind="stable").drop_duplicates(["window", "series", "sensor"])


class FusionProcessor(StatefulProcessor):
    """Of a group of series: each open window's newest reading of every sensor as one entry, and the sensors' variances and the last fused value of all series as one value."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "window long", "series array<string>, sensor array<string>, at array<long>, tie array<string>, x array<double>")
        self.filters = handle.getValueState("filters", "series array<string>, last array<double>, sensor array<array<string>>, variance array<array<double>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = _newest(pd.concat(list(rows), ignore_index=True)[["window", *_READING]])
        for window, own in new.groupby("window", sort=False):
            window = int(window)
            if self.open.containsKey((window,)):
                held = pd.DataFrame(dict(zip(_READING, self.open.getValue((window,))))).assign(window=window)
                own = _newest(pd.concat([held, own], ignore_index=True))
            else:
                self.handle.registerTimer((window + 1) * self.width * 1000)
            self.open.updateValue((window,), tuple([None if v is None or v is pd.NA else v for v in own[c].tolist()] for c in _READING))
        yield pd.DataFrame([], columns=_FUSED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) // (self.width * 1000)
        done, out = sorted(w for (w,) in self.open.keys() if w < closed), []  # those of later timers of this call too
        if done:
            held = zip(*self.filters.get()) if self.filters.exists() else ()
            state = {name: (last, dict(zip(sensors, var))) for name, last, sensors, var in held}
            for window in done:
                by: dict = {}
                names, sensors, _, _, x = self.open.getValue((window,))
                for name, sensor, v in sorted(zip(names, sensors, x), key=lambda r: (r[1] is not None, r[1] or "")):
                    by.setdefault(name, {})[sensor] = v
                for name, z in by.items():
                    last, var = state.get(name, (None, {}))
                    last, spread = fuse_step(var, last, z)
                    state[name] = last, var
                    out.append((name, window, last, spread, len(z)))
                self.open.removeKey((window,))
            kept = [(name, last, list(var), list(var.values())) for name, (last, var) in state.items()]
            self.filters.update(tuple(map(list, zip(*kept))))
        yield pd.DataFrame(out, columns=_FUSED)

    def close(self) -> None:
        pass


def fusion_stream(readings: DataFrame, width: int, late: str = "10 minutes") -> DataFrame:
    """Inverse-variance fusion of (series, ts, sensor, tie, x) in windows of width seconds; a window is fused once the watermark has passed it.

    Readings may come in any order until then; of a sensor's readings in a window the newest counts
    (ties: the larger tie). So the rows are those of `fuse_windows` on the closed windows. Later readings are dropped.
    Series are keyed in BUCKETS groups, whose windows close together.
    """
    schema = "series string, window long, fused double, variance double, n_sensors int"
    at = F.unix_micros("ts")
    dealt = readings.withWatermark("ts", late).select("series", "ts", "sensor", "tie", "x", at.alias("at"), F.floor(at / F.lit(width * 1_000_000)).alias("window"), F.pmod(F.xxhash64("series"), F.lit(BUCKETS)).alias("bucket"))
    return dealt.groupBy("bucket").transformWithStateInPandas(FusionProcessor(width), schema, "Append", "EventTime")


def cusum_stream(readings: DataFrame, mu: float, k: float, h: float) -> DataFrame:
    """Two-sided sums carried per series between batches: (series, ts, x) to (series, ts, s_up, s_down, alarm); ties of ts are in order of idx where there is one, and a reading without a value leaves the sums."""
    order = [c for c in ("ts", "idx") if c in readings.columns]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, down = state.get if state.exists else (0.0, 0.0)
        rows = []
        for row in pd.concat(list(frames)).sort_values(order, kind="stable").itertuples():
            if row.x == row.x:
                up, down = max(0.0, up + row.x - mu - k), max(0.0, down + mu - k - row.x)
            rows.append((key[0], row.ts, up, down, max(up, down) - h > 1e-9))  # at h itself sums of decimals differ in their last bits only
        state.update((up, down))
        yield pd.DataFrame(rows, columns=["series", "ts", "s_up", "s_down", "alarm"])

    return readings.groupBy("series").applyInPandasWithState(step, "series string, ts timestamp, s_up double, s_down double, alarm boolean", "up double, down double", "append", GroupStateTimeout.NoTimeout)


def ewma_stream(readings: DataFrame, span: int = 20, limit: float = 3.0) -> DataFrame:
    """Adaptive z-score carried per series between batches: (series, ts, x) to (series, ts, z, alarm); the first point scores 0."""
    a = 2.0 / (span + 1)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "x"], kind="stable")
        x = rows["x"].to_numpy(float)
        known = state.exists
        start, var = state.get if known else (x[0], 0.0)
        mean = decayed(x, a, start)  # from its own value the first point's mean is that value
        off = x - mean
        spread = decayed(off**2, a, var)
        state.update((float(mean[-1]), float(spread[-1])))
        sd = np.sqrt(spread)
        z = np.divide(off, sd, out=np.zeros(len(x)), where=sd >= 1e-12)
        yield pd.DataFrame({"series": key[0], "ts": rows["ts"].to_numpy(), "z": z, "alarm": np.abs(z) > limit})

    return readings.groupBy("series").applyInPandasWithState(step, "series string, ts timestamp, z double, alarm boolean", "mean double, var double", "append", GroupStateTimeout.NoTimeout)


def alert_stream(snapshots: DataFrame) -> DataFrame:
    """Stateless rule matrix, discrepancy and decision per row, as a JSON frame."""
    d = decide(snapshots)
    keep = [c for c in ("patient_id", "ts", "event_id") if c in d.columns]
    return d.select(*keep, F.to_json(F.struct("alert", "false_positive", "final_severity", "confidence", "decision", "primary_rule")).alias("frame"))


def ppg_profile(messages: DataFrame, width: int = 4) -> DataFrame:
    """Mean oscillation of each message's sample array (at least four samples) and its smoothed mean, which replaces the heart rate above 30."""
    at = lambda a, i: F.slice(a, F.greatest(F.lit(1), i + 1 - width // 2), F.least(F.lit(width + 1), i + 1 + width // 2))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    mo = F.transform("ppg_signal", lambda x, i: mean(F.transform(at(F.col("ppg_signal"), i), lambda v: F.abs(v - mean(at(F.col("ppg_signal"), i))))))
    has = F.size("ppg_signal") >= 4
    out = messages.withColumns({"ppg_mean": F.when(has, mean(F.col("ppg_signal"))), "ppg_oscillation": F.when(has, mean(mo))})
    return out.withColumn("heart_rate", F.when(F.col("ppg_mean") > 30, F.col("ppg_mean")).otherwise(F.col("heart_rate")))


def score_stream(rows: DataFrame, score, path: str, checkpoint: str) -> StreamingQuery:
    """Micro-batches scored by a function of a DataFrame and appended."""
    run = lambda df, _: score(df).write.mode("append").parquet(path)
    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is available now into Parquet, then reads it; keyed state lies in RocksDB under the checkpoint."""
    name, store = _ROCKS
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:  # a query keeps the setting that it starts with
        run = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
