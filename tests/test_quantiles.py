"""Order statistics by histogram passes against a sort."""

import numpy as np

from pulselake.ml import models, quantiles


def test_order_statistics_and_quantiles(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BINS", 8)
    rng = np.random.default_rng(0)
    groups = {6: rng.normal(size=500), 24: np.repeat(rng.normal(size=40), 10), 72: np.full(30, 0.25), 96: np.concatenate([rng.normal(size=50) * 1e-300, [1e300, -1e300]])}
    rows = [(h, float(v)) for h, x in groups.items() for v in x] + [(6, None), (120, None)]
    df = spark.createDataFrame(rows, "horizon int, v double").repartition(3)
    wanted = {h: {0, len(x) // 3, len(x) - 1} for h, x in groups.items()}
    got = quantiles.order_statistics(df, "horizon", "v", wanted | {7: {0}})
    assert got == {(h, k): np.sort(x)[k] for h, x in groups.items() for k in wanted[h]}
    levels = {6: 0.9, 24: 0.333, 72: 0.5}
    q = quantiles.quantiles(df, "horizon", "v", levels)
    assert set(q) == set(levels) and all(np.isclose(q[h], np.quantile(groups[h], p)) for h, p in levels.items())
    assert quantiles.quantiles(df.where("false"), "horizon", "v", levels) == {}


def test_no_window_or_buffer_holds_a_horizon(spark):
    df = spark.createDataFrame([(6, k / 100, float(k % 2)) for k in range(100)], "horizon int, prob double, label double")
    for made in (models.threshold_metrics(df), models.conformal_fit(df)):
        plan = spark._jvm.PythonSQLUtils.explainString(made._jdf.queryExecution(), "simple")
        assert "Window" not in plan and "percentile" not in plan and "collect_list" not in plan
    assert models.threshold_metrics(df.where("false")).count() == 0 and models.conformal_fit(df.where("false")).count() == 0
