"""Embedding whitening: principal components and scales by Golub-Kahan-Lanczos bidiagonalisation.

Every entry c of a vector becomes the whole number floor(256 c); the fit list holds each distinct
whole-number vector once. Let A be its centred rows. A step takes a direction v and makes, in one
pass over the written fit list, the long vector A v, its products with all earlier u and with A; u is
A v less its parts along these, and the next direction is the transposed product made orthogonal to
all earlier v, twice (full reorthogonalisation). As every u is A q for a short vector q, a pass computes the
rows of all u from q and nothing as long as the table is kept or sent: a task returns only sums of
the vectors' length. A in the bases of u and v is a small triangular matrix R (bidiagonal but for
rounding and restarts), whose singular value decomposition gives the components and deviations.

Steps end when the residuals of the leading components are at rounding level, and stay so after a
restart with a direction that the earlier ones never met, which brings out repeated eigenvalues; or
when the directions span the space. The driver holds vectors of the embedding's length only.

Cases: rows whose vector is null or holds null, NaN or infinite entries are dropped; each vector
length is fitted and numbered for itself; a length d has min(d, 4) components, and an empty vector
none, so it gives no row; a component with an eigenvalue at rounding level of the largest has whitened null (it has no
scale) and is left out of identity_error, which is 0 where none is left; explained is 0 when all vectors are equal; entries whose
number passes a long's range get its ends; a deviation beyond a long's range is null (deviation_text
has all its digits); repeated rows each get their rows, null ids too; ties in eigenvalue have any
orthogonal order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.llm.common import slices
from pulselake.session import Scratch, read_table

#: Components returned.
COMPONENTS = 4
SCALE = 256.0
#: A residual below this part of the largest singular value is rounding.
ROUNDING = 2e-14
#: Steps after a restart before the components count as settled.
CONFIRM = 6
#: Vectors of the fit list that stand in one row of its table.
BLOCK = 2048
#: Bytes of a file of the fit list.
FILE_BYTES = 1 << 23
#: Eigenvalues below this part of the largest have no scale.
FLAT = 1e-14


def whole(c: np.ndarray) -> np.ndarray:
    """floor(256 c) as long, at a long's ends beyond its range."""
    with np.errstate(over="ignore"):
        f = np.floor(SCALE * c.astype(np.float64)) + 0.0
    top = f >= 2.0**63
    return np.where(top, np.iinfo(np.int64).max, np.where(top, 0.0, np.maximum(f, -(2.0**63))).astype(np.int64))


def _usable(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each vector length d: d, the places of its usable rows in the batch, their whole numbers."""
    lists = batch.column("embedding").cast(pa.list_(pa.float64()))
    offsets, values = lists.offsets.to_numpy(), lists.values
    flat = values.to_numpy(zero_copy_only=False) if len(values) else np.empty(0)
    bad = ~np.isfinite(flat)  # nulls come as NaN
    width = np.diff(offsets)
    ok = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) & (width > 0))
    gone = np.concatenate(([0], np.cumsum(bad)))
    ok = ok[gone[offsets[ok + 1]] == gone[offsets[ok]]]
    for d in np.unique(width[ok]):
        at = ok[width[ok] == d]
        yield int(d), at, whole(flat[offsets[at][:, None] + np.arange(d)])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for d, _, x in _usable(batch):
            x = np.unique(x, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), d, np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], ["d", "x"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of one length in rows of up to BLOCK, as bytes."""
    held: dict[int, list[bytes]] = {}

    def block(d: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([b"".join(held.pop(d))], pa.binary())], ["d", "x"])

    for batch in batches:
        for d, x in zip(batch.column("d").to_pylist(), batch.column("x").to_pylist()):
            held.setdefault(d, []).append(x)
            if len(held[d]) >= max(1, BLOCK * 64 // d):
                yield block(d)
    for d in [*held]:
        yield block(d)


def fit_list(vectors: DataFrame, work: Scratch) -> DataFrame:
    """The distinct whole-number vectors of every length, packed in blocks (d, x), as a written table."""
    distinct = work.write(vectors.select("embedding").mapInArrow(_packed, "d int, x binary").distinct(), "distinct")
    size = distinct.agg(F.sum(F.length("x"))).first()[0] or 0
    # each step reads the list once, so it stands in few files, of FILE_BYTES
    return work.write(distinct.coalesce(1 + size // FILE_BYTES).mapInArrow(_blocks, "d int, x binary"), "fit_list")


def _matrix(row) -> np.ndarray:
    return np.frombuffer(bytes(row.x), "<i8").reshape(-1, row.d)


def _total(rows: RDD, fn) -> dict:
    """The sums of fn(matrix of a block, d) by length: each task adds its own, then they meet in a tree."""

    def task(part):
        out: dict = {}
        for row in part:
            _add(out, {row.d: fn(_matrix(row), row.d)})
        return [out]

    return rows.mapPartitions(task).treeReduce(_add, depth=2) if rows.getNumPartitions() else {}


def _add(a: dict, b: dict) -> dict:
    for d, sums in b.items():
        a[d] = [x + y for x, y in zip(a[d], sums)] if d in a else sums
    return a


class Lanczos:
    """The bidiagonalisation of one vector length; holds short vectors only."""

    def __init__(self, d: int, n: int, total: list[int], squares: float):
        self.d, self.n, self.total, self.squares = d, n, total, squares
        self.mean = np.array([t / n for t in total])
        self.rng = np.random.default_rng(d)
        self.v, self.q, self.z = np.empty((d, 0)), np.empty((d, 0)), np.empty((d, 0))
        self.r = np.empty((0, 0))
        self.restarted, self.before = None, None
        self.done = squares == 0.0 or n < 2
        self.next = self._fresh()

    def _fresh(self) -> np.ndarray:
        """A direction that the ones so far have not met."""
        w = self.rng.normal(size=self.d)
        for _ in range(3):
            w -= self.v @ (self.v.T @ w)
        return w / np.linalg.norm(w)

    def sums(self, x: np.ndarray) -> list[np.ndarray]:
        """What one block adds: Aᵀ A v, and the products of A v with every u and itself."""
        a = x - self.mean
        t = a @ self.next
        return [a.T @ t, (a @ self.q).T @ t, np.array([t @ t])]

    def take(self, at: np.ndarray, ut: np.ndarray, tt: float) -> None:
        """The step's sums: a new column of each basis and of R."""
        k, v = self.v.shape[1], self.next
        self.v = np.column_stack([self.v, v])
        r = np.zeros((k + 1, k + 1))
        r[:k, :k] = self.r
        r[:k, k] = ut
        left = max(0.0, tt - float(ut @ ut))
        rounding = 1e-15 * np.sqrt(self.squares)
        if left > rounding**2:
            r[k, k] = alpha = np.sqrt(left)
            self.q = np.column_stack([self.q, (v - self.q @ ut) / alpha])
            self.z = np.column_stack([self.z, (at - self.z @ ut) / alpha])
        else:  # v is in the null space of what is left
            self.q, self.z = np.column_stack([self.q, np.zeros(self.d)]), np.column_stack([self.z, np.zeros(self.d)])
        self.r = r
        w = self.z[:, -1].copy()
        for _ in range(2):
            w -= self.v @ (self.v.T @ w)
        size = np.linalg.norm(w)
        if self.v.shape[1] >= self.d:
            self.done = True
        elif self._settled():
            now = self.deviations()
            if self.restarted is not None and self.before is not None and np.allclose(now, self.before, rtol=1e-12, atol=0.0):
                self.done = True
            self.restarted, self.before, self.next = k, now, self._fresh()
        else:
            self.next = w / size if size > rounding else self._fresh()

    def _svd(self):
        p, s, qt = np.linalg.svd(self.r)
        return p, s, qt

    def deviations(self) -> np.ndarray:
        """The leading singular values so far."""
        return self._svd()[1][:COMPONENTS]

    def _settled(self) -> bool:
        if self.v.shape[1] < min(COMPONENTS, self.d) + 1 or (self.restarted is not None and self.v.shape[1] - self.restarted < CONFIRM):
            return False
        p, s, qt = self._svd()
        residual = self.z @ p[:, :COMPONENTS] - self.v @ qt[:COMPONENTS].T * s[:COMPONENTS]
        return bool((np.linalg.norm(residual, axis=0) <= ROUNDING * s[0]).all())

    def result(self) -> dict:
        """Components as columns, their eigenvalues and shares of the trace."""
        most = min(COMPONENTS, self.d)
        if not self.v.shape[1]:
            return {"n": self.n, "total": self.total, "mean": self.mean, "c": np.eye(self.d)[:, :most], "e": np.zeros(most), "explained": np.zeros(most)}
        _, s, qt = self._svd()
        c, e = (self.v @ qt[:most].T), s[:most] ** 2 / self.n
        c, _ = np.linalg.qr(c)  # unit length to the last digit
        return {"n": self.n, "total": self.total, "mean": self.mean, "c": c, "e": e, "explained": e / (self.squares / self.n)}


def fit(vectors: DataFrame, work: Scratch) -> dict[int, dict]:
    """By vector length: n, sums, mean, components c (columns), eigenvalues e, explained, identity_error."""
    rows = fit_list(vectors, work).rdd
    first = _total(rows, lambda x, d: [len(x), x.astype(object).sum(axis=0) if np.abs(x.astype(float)).max() * len(x) >= 2.0**62 else x.sum(axis=0).astype(object)])
    means = {d: np.array([t / n for t in total]) for d, (n, total) in first.items()}
    squares = _total(rows, lambda x, d: [float(((x - means[d]) ** 2).sum())])
    states = {d: Lanczos(d, n, [int(t) for t in total], squares[d][0]) for d, (n, total) in first.items()}
    while open_ := {d: s for d, s in states.items() if not s.done}:
        got = _total(rows, lambda x, d: open_[d].sums(x) if d in open_ else [])
        for d, s in open_.items():
            s.take(got[d][0], got[d][1], float(got[d][2][0]))
    models = {d: s.result() for d, s in states.items()}

    def moments(x: np.ndarray, d: int) -> list[np.ndarray]:
        w = _whitened(x, models[d])
        return [w.sum(axis=0), w.T @ w]

    for d, (total, products) in _total(rows, moments).items():
        n, has = models[d]["n"], _scaled(models[d])
        off = np.abs(products / n - np.outer(total, total) / n**2 - np.eye(len(total)))[np.ix_(has, has)]
        models[d]["identity_error"] = float(off.max()) if has.any() else 0.0
    return models


def _scaled(model: dict) -> np.ndarray:
    return model["e"] > FLAT * max(model["e"].max(), np.finfo(float).tiny)


def _whitened(x: np.ndarray, model: dict) -> np.ndarray:
    """Projections over deviations; 0 for a component without scale."""
    has = _scaled(model)
    return np.where(has, (x - model["mean"]) @ model["c"] / np.sqrt(np.where(has, model["e"], 1.0)), 0.0)


def _deviation(x: np.ndarray, model: dict) -> list[int]:
    """The sums over dimensions of (n x - S) squared, exact."""
    n, total = model["n"], np.array(model["total"], object)
    most = max(n * float(np.abs(x.astype(float)).max()), 1.0) + max(map(abs, model["total"]))
    if most**2 * x.shape[1] < 2.0**62:
        return ((n * x - total.astype(np.int64)) ** 2).sum(axis=1).tolist()
    return list(((n * x.astype(object) - total) ** 2).sum(axis=1))


def whiten(vectors: DataFrame, work: Scratch | None = None) -> DataFrame:
    """One row per usable row of vectors (vec_id, embedding) and component."""
    spark = vectors.sparkSession
    work = work or Scratch(spark, "whitening")
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    models = spark.sparkContext.broadcast(fit(given, work))
    names = "vec_id component n deviation whitened explained identity_error deviation_text".split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for d, at, x in _usable(batch):
                m = models.value[d]
                k = len(m["e"])
                has = np.tile(_scaled(m), len(at))
                deviation = [v for v in _deviation(x, m) for _ in range(k)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(k * len(at), m["n"], np.int64)),
                        pa.array([v if v < 2**63 else None for v in deviation], pa.int64()),
                        pa.array(_whitened(x, m).reshape(-1), mask=~has),
                        pa.array(np.tile(m["explained"], len(at))),
                        pa.array(np.full(k * len(at), m["identity_error"])),
                        pa.array(map(str, deviation), pa.string()),
                    ],
                    names,
                )

    return given.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings projected on their leading components."""
    return whiten(read_table(spark, sf_dir, "embeddings"))
