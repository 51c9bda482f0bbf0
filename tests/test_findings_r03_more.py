"""Findings of the third review, continued."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulselake.plans import clinical_queries, text_queries, views
from pulselake.series import recursive
from pulselake.streaming import jobs
from pulselake.text import corpus


class Held:
    """A map or value state that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def __getattr__(self, name):
        self.calls += 1
        return {
            "containsKey": lambda k: k in self.held, "getValue": lambda k: self.held[k], "updateValue": self.held.__setitem__, "removeKey": self.held.pop,
            "keys": lambda: list(self.held), "exists": lambda: bool(self.held), "get": lambda: self.held[0], "update": lambda v: self.held.update({0: v}),
        }[name]


def test_windows_of_many_series_close_in_a_few_state_calls():
    state, timers, width = [], [], 60
    made = lambda *_: state.append(Held()) or state[-1]
    p = jobs.FusionProcessor(width)
    p.init(SimpleNamespace(getMapState=made, getValueState=made, registerTimer=timers.append))
    rows = [(w, f"S{k}", f"d{d}", w * 60_000_000 + o, str(o), 70.0 + k + d + o) for k in range(300) for w in (0, 1) for d in (0, 1) for o in (1, 2)]
    pdf = pd.DataFrame(rows, columns=["window", "series", "sensor", "at", "tie", "x"])
    for part in (pdf.iloc[::2], pdf.iloc[1::2]):  # newer readings meet the older ones in the state
        list(p.handleInputRows((0,), iter([part]), None))
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 120_000)
    got = pd.concat([f for t in sorted(timers) for f in p.handleExpiredTimer((0,), now, SimpleNamespace(getExpiryTimeInMs=lambda t=t: t))])
    assert sum(s.calls for s in state) < 30 and sorted(timers) == [60_000, 120_000]
    newest = pdf[pdf.tie == "2"].assign(o=0)
    assert len(got) == 600 and (got.n_sensors == 2).all()
    for k in (0, 299):
        var, last = {}, None
        for w in (0, 1):
            z = {r.sensor: r.x for r in newest[(newest.series == f"S{k}") & (newest.window == w)].itertuples()}
            last, spread = recursive.fuse_step(var, last, z)
            row = got[(got.series == f"S{k}") & (got.window == w)].iloc[0]
            assert (row.fused, row.variance) == (last, spread)


def test_a_sensor_alone_keeps_its_variance_to_the_last_bit():
    var, last = {}, None
    want = 4.0
    for x in (93.18, 60.07, 104.33, 81.4, 132.31, 77.77):
        before, was = want, last
        last, spread = recursive.fuse_step(var, last, {"d0": x})
        assert spread == before
        want = before if was is None else 0.9 * before + 0.1 * (x - was) ** 2


def _texts(spark):
    rng = np.random.default_rng(5)
    word = lambda k: "w" + "".join(chr(97 + int(d)) for d in f"{k:03d}")
    texts = [" ".join(word(k) for k in rng.zipf(1.3, size=80) % 200) for _ in range(60)] + ["xxrare yyrare élan", "xxrare yyrare zeta", "", None, "alone"]
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)


@pytest.mark.parametrize(("pairs", "held"), [(1 << 25, 1 << 24), (1000, 150)])
def test_strongest_partners_are_those_of_all_pairs(spark, monkeypatch, pairs, held):
    monkeypatch.setattr(corpus, "TASK_PAIRS", pairs)
    monkeypatch.setattr(corpus, "HELD_IDS", held)
    docs = _texts(spark)
    want = corpus.strongest(corpus.all_pairs(docs)).select("term", "partner", "n", "nth")
    got = corpus.strongest_partners(docs)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(got.collect()) == sorted(want.collect()) and got.where("term = 'xxrare'").count() == 1
    assert corpus.strongest_partners(docs.where(F.lit(False))).count() == 0


def test_no_pair_is_shuffled_by_keyword_cooccurrence_all(spark, tmp_path, monkeypatch):
    _texts(spark).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus, "all_pairs", lambda *_: pytest.fail("makes a row of every pair"))
    assert text_queries.keyword_cooccurrence_all(spark, str(tmp_path)).count() > 200
    assert text_queries.related_terms_all(spark, str(tmp_path)).count() == 20


def test_a_mean_at_a_limit_is_there_in_any_order(spark, monkeypatch):
    rng, kinds = np.random.default_rng(7), [None, None]
    for _ in range(10_000):  # orders of values of mean 88, whose sums in doubles fall to either side
        v = rng.integers(7000, 10600, 9)
        v = [int(x) / 100 for x in (*v, 88_000 - v.sum())]
        total = 0.0
        for x in v:
            total += x
        if total / 10 != 88.0:
            kinds[int(total / 10 > 88.0)] = v
    rows = [(f"P{k}", "heart_rate", x, 0.0) for k, v in enumerate(kinds) for x in v] + [("N", "heart_rate", float("nan"), 0.0)]
    silver = spark.createDataFrame(rows, "patient_id string, metric_type string, metric_value double, anomaly_score double").coalesce(1)
    monkeypatch.setattr(views, "silver", lambda *_: silver)
    got = {r.patient_id: r for r in clinical_queries.patient_evidence(spark, "").collect()}
    assert got["P0"].wearable == got["P1"].wearable == 0.35 and got["P0"].ghost == 0.0
