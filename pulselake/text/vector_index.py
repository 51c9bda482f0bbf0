"""A persisted inverted-file index of document vectors: cells of a coarse clustering, probed by distance, reranked exactly (F8).

Under its root lie the clustering (learnt once, from at most SAMPLE vectors), the vectors with their
texts and metadata partitioned by cell, and the radii of the cells, to which every append adds its
own. A search reads the partitions of the cells that it probes and no others. An exact search then
also reads those cells that could hold something nearer: no vector of a cell is nearer than the
distance to its centre less its radius.

Rows whose vector is null, holds null or non-finite entries, or has another length than the
clustering are not indexed. Ties in distance go to the smaller id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulselake.session import Scratch, small_side

#: Vectors that the clustering is learnt from, and cells at most (as many as the root of the first rows' number).
SAMPLE, CELLS = 20_000, 1024
#: Vectors, and queries, of which one group compares all pairs.
BLOCK, ASKED = 16_384, 4_096


def distance(a: str, b: str) -> Column:
    """L2 distance of two arrays of numbers."""
    square = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + x))


def comparable(column: str, dim: int | None = None) -> Column:
    """Whether a vector can be compared; never null."""
    fit = F.size(column) > 0 if dim is None else F.size(column) == dim
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce(fit & ~F.exists(column, odd), F.lit(False))


def usable(rows: DataFrame, column: str, dim: int | None = None) -> DataFrame:
    """Rows whose vector can be compared."""
    return rows.where(comparable(column, dim))


def nearest_values(ids: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of y, row of x, distance) of the k rows of x nearest to each row of y, ties to the smaller id.

    A matrix product finds all that may be among them; their distances are then summed place by place, as `distance` does.
    """
    size, out = (x * x).sum(axis=1), []
    for lo in range(0, len(y), 256):
        part = y[lo : lo + 256]
        own = (part * part).sum(axis=1)
        near = size[None, :] + own[:, None] - 2 * (part @ x.T)
        kth = np.partition(near, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
        r, c = np.nonzero(near <= (kth + 1e-9 * (size.max() + own))[:, None])
        total = np.zeros(len(r))
        for j in range(x.shape[1]):
            total += (x[c, j] - part[r, j]) ** 2
        d = np.sqrt(total)
        order = np.lexsort((ids[c], d, r))
        r, c, d = r[order], c[order], d[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        out.append((lo + r[place < k], c[place < k], d[place < k]))
    return tuple(np.concatenate(v) for v in zip(*out))


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, distance): the k nearest of all vectors (vec_id, embedding) to each query (query_id, q); those of comparable vectors of equal length.

    Vectors and queries are dealt to blocks; a block of one meets a block of the other in a group, which
    keeps k of each query. So a group's size is bounded, and what is gathered is k rows a query and block.
    """
    parts, turns = (max(1, -(-df.count() // most)) for df, most in ((vectors, BLOCK), (queries, ASKED)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    v = usable(vectors, "embedding").select("vec_id", "embedding", F.size("embedding").alias("dim"), dealt("vec_id", parts).alias("part"), each(turns).alias("turn"))
    q = usable(queries, "q").select("query_id", "q", F.size("q").alias("dim"), dealt("query_id", turns).alias("turn"), each(parts).alias("part"))
    keys = ["dim", "part", "turn"]

    def run(here: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(here) or not len(asked):
            return pd.DataFrame([], columns=["query_id", "vec_id", "distance"])
        ids = here["vec_id"].to_numpy()
        r, c, d = nearest_values(ids, np.stack(here["embedding"]).astype(float), np.stack(asked["q"]).astype(float), k)
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[r], "vec_id": ids[c], "distance": d})

    near = v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, distance double")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))
    return near.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


class VectorIndex:
    """An index under a folder; rows are (vec_id, embedding, text, metadata)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.model: KMeansModel | None = None

    def learn(self, rows: DataFrame, cells: int | None = None) -> VectorIndex:
        """Learns the cells from a hash sample of the rows and keeps them."""
        good = usable(rows, "embedding")
        n = good.count()
        share = min(1.0, SAMPLE / max(1, n))
        some = good.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(2 * SAMPLE)
        k = max(2, min(CELLS, cells or round(n**0.5)))
        self.model = KMeans(k=k, maxIter=10, seed=7, featuresCol="point", predictionCol="cell").fit(self._points(some))
        self.model.write().overwrite().save(f"{self.root}/cells")
        return self

    def _points(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("point", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))

    def _cells(self) -> KMeansModel:
        if self.model is None:
            self.model = KMeansModel.load(f"{self.root}/cells")
        return self.model

    def _centres(self) -> DataFrame:
        """(cell, centre), at most CELLS rows."""
        return self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(self._cells().clusterCenters())], "cell int, centre array<double>")

    def append(self, rows: DataFrame) -> VectorIndex:
        """Adds rows to their cells."""
        dim = len(self._cells().clusterCenters()[0])
        placed = self._cells().transform(self._points(usable(rows, "embedding", dim))).drop("point")
        placed.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(8))).write.mode("append").partitionBy("cell").parquet(f"{self.root}/vectors")
        far = placed.join(F.broadcast(self._centres()), "cell").groupBy("cell").agg(F.max(distance("embedding", "centre")).alias("radius"))
        far.write.mode("append").parquet(f"{self.root}/radii")
        return self

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/vectors")

    def _nearest(self, queries: DataFrame, probed: DataFrame, k: int) -> DataFrame:
        """(query_id, vec_id, cell, distance): the k nearest of each query in its probed cells (query_id, cell), read from their partitions alone."""
        cells = [r[0] for r in probed.select("cell").distinct().collect()]  # at most CELLS
        asked = probed.join(small_side(queries, queries.count()), "query_id")
        found = self.vectors().where(F.col("cell").isin(cells)).select("vec_id", "embedding", "cell").join(small_side(asked, probed.count()), "cell")
        nth = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))
        return found.select("query_id", "vec_id", "cell", distance("embedding", "q").alias("distance")).withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")

    def _all_nearest(self, queries: DataFrame, probed: DataFrame, k: int) -> DataFrame:
        """As _nearest, over all cells that any query probes, each query in all of them."""
        cells = [r[0] for r in probed.select("cell").distinct().collect()]  # at most CELLS
        asked = queries.join(probed.select("query_id").distinct(), "query_id", "left_semi")
        held = self.vectors().where(F.col("cell").isin(cells))
        near = nearest(held.select("vec_id", "embedding"), asked, k)
        return near.join(held.select("vec_id", "cell"), "vec_id").select("query_id", "vec_id", "cell", "distance")

    def search(self, queries: DataFrame, k: int = 3, probes: int = 8, exact: bool = False, work: Scratch | None = None) -> DataFrame:
        """query_id, nth, vec_id, distance, text and metadata of the k nearest rows to each query (query_id, q).

        Without exact a neighbour in a cell that is not among the query's probes nearest ones is missed.
        """
        work = work or Scratch(self.spark, "search")
        dim = len(self._cells().clusterCenters()[0])
        queries = work.write(usable(queries, "q", dim).select("query_id", "q"), "queries")
        radii = self.spark.read.parquet(f"{self.root}/radii").groupBy("cell").agg(F.max("radius").alias("radius"))
        centres = F.broadcast(self._centres().join(F.broadcast(radii), "cell"))  # at most CELLS rows
        away = work.write(queries.crossJoin(centres).select("query_id", "cell", distance("q", "centre").alias("away"), "radius"), "cells")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy("away", "cell"))
        ranked = work.write(away.withColumn("rank", rank), "ranked")
        best = work.write(self._nearest(queries, ranked.where(F.col("rank") <= probes).select("query_id", "cell"), k), "best")
        if exact:
            have = best.groupBy("query_id").agg(F.max("distance").alias("worst"), F.count("*").alias("n"))
            more = ranked.where(F.col("rank") > probes).join(small_side(have, have.count()), "query_id", "left")
            # a little more than the bound, for rounding
            more = more.where(F.col("n").isNull() | (F.col("n") < k) | (F.col("away") - F.col("radius") <= F.col("worst") * (1 + 1e-9)))
            more = work.write(more.select("query_id", "cell"), "more")
            rest = self._all_nearest(queries, more, k)
            nth = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))
            best = work.write(best.unionByName(rest).dropDuplicates(["query_id", "vec_id", "cell"]).withColumn("nth", nth).where(F.col("nth") <= k).drop("nth"), "best")
        nth = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))
        best = best.withColumn("nth", nth)
        cells = [r[0] for r in best.select("cell").distinct().collect()]
        full = self.vectors().where(F.col("cell").isin(cells)).drop("embedding")
        same = reduce(lambda a, b: a & b, (full[c].eqNullSafe(best[c]) for c in ("cell", "vec_id")))
        return full.join(small_side(best, best.count()), same).select("query_id", "nth", best["vec_id"], "distance", "text", "metadata")
