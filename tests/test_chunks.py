"""Filters by pieces against the whole series at once; a long series is many groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake.series import chunks, recursive


@pytest.mark.parametrize("size", [8, 64, 4096])
def test_pieces_equal_the_whole_series(spark, monkeypatch, size):
    monkeypatch.setattr(chunks, "CHUNK", size)
    rng = np.random.default_rng(0)
    series = {"long": rng.normal(70, 1, 400).cumsum() / 20, "steps": np.repeat(rng.normal(0, 9, 50), 6), "one": np.array([3.0]), "two": np.array([3.0, 9.0])}
    series["long"][[7, 8, 9, 15, 16, 63, 64, 65, 127, 128, 200]] += 80  # corrections at the borders of pieces
    rows = [(s, 10 * k, float(v), f"{s}{k}") for s, x in series.items() for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "series string, idx long, x double, note string").repartition(5)
    got = {(r.series, r.idx): r for r in chunks.hampel_rows(df).collect()}
    both = {(r.series, r.idx): r for r in chunks.denoise_rows(df).collect()}
    assert len(got) == len(both) == len(rows) and got["long", 0].note == "long0"
    for s, x in series.items():
        y, odd = recursive.hampel_values(x)
        z = recursive.kalman_values(y, 0.05, 2.0)
        assert np.allclose([got[s, 10 * k].filtered for k in range(len(x))], y, atol=1e-12) and [got[s, 10 * k].is_artifact for k in range(len(x))] == odd.tolist()
        assert np.allclose([both[s, 10 * k].filtered for k in range(len(x))], z, atol=1e-9)
        assert np.allclose([both[s, 10 * k].residual for k in range(len(x))], x - z, atol=1e-9)


def test_a_long_series_is_many_groups(spark, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK", 100)
    df = spark.range(5000).select(F.lit("hot").alias("series"), F.col("id").alias("idx"), (F.col("id") % 17).cast("double").alias("x"))
    table = chunks.placed(df, chunks.Scratch(spark, "test"))
    sizes = [r["count"] for r in table.groupBy("series", "chunk").count().collect()]
    assert len(sizes) == 50 and max(sizes) == 100 and table.where("k <> idx").count() == 0
    assert chunks.denoise_rows(df).count() == 5000
    assert chunks.denoise_rows(df.where("false")).count() == 0 and chunks.hampel_rows(df.where("false")).count() == 0
