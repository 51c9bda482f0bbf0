"""Keyed streams against their batch twins, over several batches and restarts; purge stopped at every move."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake import lake as lakes
from pulselake.series import recursive
from pulselake.streaming import jobs

T0 = datetime(2026, 7, 1)


def test_latent_stream_equals_the_batch_filter_over_restarts(spark, tmp_path):
    rng = np.random.default_rng(0)
    schema = "patient_id string, ts timestamp, heart_rate double, hrv_rmssd double, skin_temp double, activity_level double"
    rows = []
    for p in ("P0", "P1"):
        for k in range(60):
            seen = [float(v) if rng.random() < 0.7 else None for v in rng.normal([70, 45, 33, 0.5], [5, 5, 0.3, 0.2])]
            rows.append((p, T0 + timedelta(minutes=k), *seen))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    got = None
    for part in range(3):  # each drain is a start from the checkpoint
        some = [r for r in rows if part * 20 <= (r[1] - T0).seconds // 60 < (part + 1) * 20]
        spark.createDataFrame(some[::-1], schema).write.mode("append").parquet(f"{tmp_path}/in")
        got = jobs.drain(spark, jobs.latent_stream(stream, keep=25, hours=None), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = got.orderBy("patient_id", "ts").collect()
    batch = spark.createDataFrame(rows, schema).select(F.col("patient_id").alias("series"), (F.unix_seconds("ts") / 60).cast("long").alias("idx"), (F.unix_seconds("ts") / 60).alias("t"), *recursive.OBSERVED)
    want = recursive.latent_states(batch).orderBy("series", "idx").collect()
    assert len(got) == len(want) == 120
    for a, b in zip(got, want):
        assert np.allclose([a[s] for s in recursive.STATES], [b[s] for s in recursive.STATES], atol=1e-9)
    assert [r.history_size for r in got[:60]] == [min(25, k + 1) for k in range(60)]
    known = [r[2] for r in rows[35:60] if r[2] is not None]
    assert np.isclose(got[59].recent_mean, np.mean(known))


def test_fusion_stream_equals_the_batch_with_late_and_unordered_readings(spark, tmp_path):
    rng = np.random.default_rng(1)
    schema, width = "series string, ts timestamp, sensor string, tie string, x double", 60
    rows = [(s, T0 + timedelta(seconds=int(rng.integers(0, 3600))), f"d{rng.integers(0, 3)}", str(k), float(rng.normal(70, 5))) for s in ("A", "B") for k in range(200)]
    rows += [("A", T0 + timedelta(seconds=600), "d0", t, x) for t, x in (("x", 1.0), ("z", 3.0), ("y", 2.0))]
    rows.sort(key=lambda r: (r[1] - T0).seconds // 900 + (rng.random() < 0.3))  # some come a batch late
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for part in range(4):
        spark.createDataFrame(rows[part * 101 : (part + 1) * 101], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = jobs.drain(spark, jobs.fusion_stream(stream, width, "40 minutes"), f"{tmp_path}/out", f"{tmp_path}/cp")
    # all is closed by a reading far ahead; one that is far too late changes nothing
    spark.createDataFrame([("A", T0 + timedelta(days=1), "d0", "w", 0.0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    jobs.drain(spark, jobs.fusion_stream(stream, width, "40 minutes"), f"{tmp_path}/out", f"{tmp_path}/cp")
    spark.createDataFrame([("A", T0, "d0", "w", 999.0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = jobs.drain(spark, jobs.fusion_stream(stream, width, "40 minutes"), f"{tmp_path}/out", f"{tmp_path}/cp").orderBy("series", "window").collect()
    r = spark.createDataFrame(rows, schema).groupBy("series", F.floor(F.unix_seconds("ts") / width).alias("window"), "sensor").agg(F.max_by("x", F.struct("ts", "tie")).alias("x"))
    want = recursive.fuse_windows(r).orderBy("series", "window").collect()
    assert len(got) == len(want) > 100
    for a, b in zip(got, want):
        assert (a.series, a.window, a.n_sensors) == (b.series, b.window, b.n_sensors) and np.isclose(a.fused, b.fused, atol=1e-9) and np.isclose(a.variance, b.variance, atol=1e-9)


@pytest.mark.parametrize("stop", range(5))
def test_purge_stopped_at_any_move_loses_no_row(spark, tmp_path, monkeypatch, stop):
    day = lambda k: (T0 + timedelta(days=k)).date()
    rows = [("P0", day(0), 1.0), ("P1", day(0), 2.0), ("P0", day(1), 3.0), ("P1", day(1), 4.0), ("P0", day(3), 5.0)]  # the last partition is the erased patient's alone
    lake_rows = spark.createDataFrame(rows, "patient_id string, partition_date date, metric_value double")
    lake, gone = lakes.Lake(spark, f"{tmp_path}/lake"), spark.createDataFrame([("P0",)], "patient_id string")
    lake.write("own", "table", lake_rows)
    moved, move = [0], lakes.Lake._move

    def stopping(self, source, target):
        if moved[0] == stop:
            raise KeyboardInterrupt
        moved[0] += 1
        move(self, source, target)

    monkeypatch.setattr(lakes.Lake, "_move", stopping)
    with pytest.raises(KeyboardInterrupt):
        lake.purge("own", "table", gone)
    monkeypatch.setattr(lakes.Lake, "_move", move)
    lake.purge("own", "table", gone)
    left = spark.read.parquet(lake.path("own", "table")).select("patient_id", F.col("partition_date").cast("string")).collect()
    assert sorted(map(tuple, left)) == [("P1", "2026-07-01"), ("P1", "2026-07-02")]
    assert not (tmp_path / "lake" / "_purge").exists()
