"""The vector index: recall of probing, exact search, appends, pruned partitions, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake.text.vector_index import VectorIndex

ROWS = "vec_id long, embedding array<float>, text string, metadata struct<author:string,url:string>"


def rows(spark, x, start=0):
    return spark.createDataFrame([(start + k, v.tolist(), f"text {start + k}", (f"a{k % 3}", f"u{k}")) for k, v in enumerate(x)], ROWS)


def brute(x, q, k):
    d = np.sqrt(((x[None].astype(float) - q[:, None].astype(float)) ** 2).sum(axis=2))
    return np.argsort(d, axis=1, kind="stable")[:, :k]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16)) * 2
    x = (centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16))).astype(np.float32)
    root = str(tmp_path_factory.mktemp("index"))
    VectorIndex(spark, root).learn(rows(spark, x[:2000])).append(rows(spark, x[:2000]))
    VectorIndex(spark, root).append(rows(spark, x[2000:], 2000))  # a later run appends
    return root, x, x[::100] + rng.normal(size=(30, 16)).astype(np.float32) * 0.3


def asked(spark, q):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)], "query_id long, q array<float>")


def hits(found):
    out = {}
    for r in found.orderBy("query_id", "nth").collect():
        out.setdefault(r.query_id, []).append(r)
    return out


def test_recall_of_probing_and_exact_search(spark, built):
    root, x, q = built
    want = brute(x, q, 3)
    near = hits(VectorIndex(spark, root).search(asked(spark, q)))
    recall = np.mean([len({r.vec_id for r in near[k]} & set(want[k].tolist())) / 3 for k in range(len(q))])
    print("recall at 3 with 8 probes", recall)
    assert recall >= 0.9
    exact = hits(VectorIndex(spark, root).search(asked(spark, q), probes=1, exact=True))
    for k in range(len(q)):
        assert [r.vec_id for r in exact[k]] == want[k].tolist() and [r.nth for r in exact[k]] == [1, 2, 3]
        first = exact[k][0]
        assert first.text == f"text {first.vec_id}" and first.metadata.url is not None and first.distance == pytest.approx(np.linalg.norm(x[first.vec_id].astype(float) - q[k].astype(float)))


def test_only_probed_partitions_are_read(spark, built):
    root, _, q = built
    index = VectorIndex(spark, root)
    found = index._nearest(asked(spark, q[:1]), spark.createDataFrame([(0, 3), (0, 5)], "query_id long, cell int"), 3)
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "IN (3,5)" in plan.split("PartitionFilters: [cell")[1][:60]
    assert {r.cell for r in found.collect()} <= {3, 5}


def test_odd_vectors_and_more_neighbours_than_rows(spark, tmp_path):
    good = [(1, [0.0, 1.0], "a", None), (2, [1.0, 0.0], "b", None), (3, [0.0, 1.0], None, None)]
    odd = [(4, None, "x", None), (5, [float("nan"), 1.0], "x", None), (6, [1.0], "x", None), (7, [None, 1.0], "x", None), (8, [float("inf"), 0.0], "x", None)]
    df = spark.createDataFrame(good + odd, ROWS)
    index = VectorIndex(spark, f"{tmp_path}/i").learn(df.where("vec_id < 4")).append(df)
    assert index.vectors().count() == 3
    found = hits(index.search(asked(spark, np.array([[0.0, 1.0]])).union(spark.createDataFrame([(9, [None, 1.0])], "query_id long, q array<float>")), k=5, probes=1, exact=True))
    assert [r.vec_id for r in found[0]] == [1, 3, 2] and set(found) == {0}
    assert index.search(asked(spark, np.zeros((1, 2))).where(F.lit(False)), exact=True).count() == 0
