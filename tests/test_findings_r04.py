"""Cases of the fourth review."""

from inspect import signature
from itertools import permutations

import pytest

from pulselake.operators import silver
from pulselake.plans import clinical_queries, views
from pulselake.text import corpus
from tests.test_findings_r03 import both, with_events  # noqa: F401
from tests.test_findings_r03_more import _texts


def test_a_mean_is_the_sum_over_the_count(spark, monkeypatch):
    rows = [(f"N{n}", "spo2", 95.15, 0.0) for n in range(1, 30) for _ in range(n)]
    monkeypatch.setattr(views, "silver", lambda *_: spark.createDataFrame(rows, "patient_id string, metric_type string, metric_value double, anomaly_score double"))
    got = {r.patient_id: r.prognostic for r in clinical_queries.patient_evidence(spark, "").collect()}
    want = {f"N{n}": 1 - (9515 * n / 100 / n - 88) / 11 for n in range(1, 30)}
    assert got == want and {v > 0.35 for v in want.values()} == {True, False}


def test_a_window_at_a_limit_is_there_in_any_order(spark):
    orders = list(permutations([207.23, 81.73, 42.38, 8.66]))
    rows = [(f"{k}-{j}", f"P{k}", v) for k, o in enumerate(orders) for j, v in enumerate(o)]
    assert any(((o[0] + o[1]) + o[2]) + o[3] > 340 for o in orders)  # the sum in doubles depends on the order
    read = spark.createDataFrame(rows, "event_id string, patient_id string, metric_value double").coalesce(1)
    full = read.selectExpr("*", "'d' device_id", "'stress_index' metric_type", "timestamp '2024-01-01' timestamp_utc", "1.0D signal_confidence", "'{}' raw_payload")
    assert {r.anomaly_score for r in silver.reconcile(full).collect()} == {0.133}


def test_rows_are_read_by_no_more_blocks_where_pairs_are_more(spark, monkeypatch):
    made, partners = [], corpus._partners
    monkeypatch.setattr(corpus, "TASK_PAIRS", 1000)
    monkeypatch.setattr(corpus, "_partners", lambda *a: made.append(signature(partners).bind(*a).arguments["n_blocks"]) or partners(*a))
    assert corpus.strongest_partners(_texts(spark)).count() > 200
    assert made == [spark.sparkContext.defaultParallelism * 4]


@pytest.mark.parametrize("first", [2, 8])
def test_partners_counted_from_a_bound_are_those_of_all_pairs(spark, monkeypatch, first):
    monkeypatch.setattr(corpus, "FIRST_TERMS", first)
    want = corpus.strongest(corpus.all_pairs(_texts(spark)))
    assert sorted(corpus.strongest_partners(_texts(spark)).collect()) == sorted(want.select("term", "partner", "n", "nth").collect())


def test_stream_cusum_keeps_its_sums_over_a_reading_without_value(spark, with_events):  # noqa: F811
    sf = with_events("SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) HOUR AS ts, 1 + i % 2 AS user_id, 'purchase' AS event_type, CASE WHEN i NOT IN (0, 6, 7) THEN 150.0 END AS value, '{\"k\": 5}' AS props FROM range(12) t(i)")
    got, want = both(spark, "stream_cusum", sf)
    assert got == want and len(got) == 2
