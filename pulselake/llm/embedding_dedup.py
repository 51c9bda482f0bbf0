"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation of the principal axes is learnt so that the signs of the rotated coordinates are
balanced codes (iterative quantisation on a bounded sample of SAMPLE_ROWS vectors in hash order).
ROTATIONS such codes are cut into substrings of w bits, w growing with the logarithm of the number
of vectors, so that a table's buckets stay small; vectors sharing a label and any substring are
candidates, and the cosine of the original vectors in double precision decides. Every vector is
indexed. A pair that shares several substrings is counted in the first table only.

Equal vectors of a label are one class (its size counts in the links). A bucket above BLOCK
vectors is cut into blocks whose pairs are separate pieces of work, so no task holds a bucket
whole; all its pairs are compared. Vectors of each length are compared among themselves, with codes
of their own; a length of which the sample holds fewer than LEARN vectors takes random rotations.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, or whose label or
vec_id is null, link with nothing; an empty label is a label (labels are compared by a 64-bit
hash); repeated rows of one vec_id are one vector (the first by its bytes) and each row is
returned; an empty table gives no rows; ties of ids cannot matter; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.llm.common import connected_components, map_batches
from pulselake.session import Scratch, read_table

THRESHOLD = 0.98
SAMPLE_ROWS = 20_000
LEARN = 100
#: Most frequent lengths whose vectors are counted; others are taken to be as many as the last of them.
LENGTHS = 1000
ROTATIONS = 4
ITERATIONS = 30
BLOCK = 1024
#: Widest substring of a code.
WIDEST = 20
#: Pairs whose cosines are computed at a time.
PAIRS = 400_000


def learn_codes(x: np.ndarray, rotations: int = ROTATIONS) -> np.ndarray:
    """Projections: sign(v @ projections) are the codes of all rotations side by side.

    Unit vectors are not centred: a small angle then flips few bits wherever the vectors lie, also
    when one tight group is most of the table.
    """
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    _, axes = np.linalg.eigh(x.T @ x / max(1, len(x)) + 1e-12 * np.eye(x.shape[1]))
    v = x @ axes
    out = []
    for k in range(rotations):
        r, _ = np.linalg.qr(np.random.default_rng(k).normal(size=(x.shape[1],) * 2))
        for _ in range(ITERATIONS if len(x) else 0):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(axes @ r)
    return np.hstack(out)


class Codes:
    """Projections and substring width of each vector length."""

    def __init__(self, sample: dict[int, list[np.ndarray]], counts: dict[int, int]):
        self.known = {d: learn_codes(np.stack(x)) for d, x in sample.items() if len(x) >= LEARN}
        self.counts, self.fewest, self.drawn = counts, min(counts.values(), default=1), {}

    def projections(self, dim: int) -> np.ndarray:
        if dim in self.known:
            return self.known[dim]
        if dim not in self.drawn:
            self.drawn = {dim: learn_codes(np.empty((0, dim)))}
        return self.drawn[dim]

    def width(self, dim: int) -> int:
        n = self.counts.get(dim, self.fewest)
        return max(1, min(dim, WIDEST, max(6, math.ceil(math.log2(n)) - 4)))


def _keys(bits: np.ndarray, dim: int, width: int) -> np.ndarray:
    """(rows, tables) substrings of the codes; a table's substring lies within one rotation."""
    weights, tables = 1 << np.arange(width, dtype=np.int64), []
    for start in range(0, ROTATIONS * dim, dim):
        tables += [bits[:, at : at + width].astype(np.int64) @ weights for at in range(start, start + dim - width + 1, width)]
    return np.stack(tables, axis=1)


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """Packed vectors of one length in double precision."""
    raw = batch.column("v").to_pylist()
    return np.stack([np.frombuffer(b, "<f4" if len(b) == 4 * dim else "<f8").astype(float) for b in raw])


def _pack(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Vectors as bytes: of 32-bit floats if they hold the components exactly, of 64-bit ones if not."""
    raw, sizes = [], []
    for v in batch.column("embedding").to_pylist():
        x = np.array(v, "<f8")
        with np.errstate(over="ignore"):
            y = x.astype("<f4")
        raw.append((y if (y == x).all() else x).tobytes())
        sizes.append(len(x))
    return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(sizes, pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "label", "d", "v"])


def _by_length(batch: pa.RecordBatch):
    """(length, rows) of each vector length of a batch."""
    d = batch.column("d").to_numpy()
    for dim in np.unique(d).tolist():
        yield dim, batch.filter(pa.array(d == dim))


def _indexer(codes):
    """Rows (t, key) of every table with the packed code of each vector."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for dim, part in _by_length(batch):
            bits = (_vectors(part, dim) @ codes.value.projections(dim) >= 0).astype(np.uint8)
            keys = _keys(bits, dim, codes.value.width(dim))
            rows = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
            code = pa.array([c.tobytes() for c in np.packbits(bits, axis=1)], pa.binary()).take(rows)
            t = pa.array(np.tile(np.arange(keys.shape[1]), len(keys)))
            wide = part.take(rows)
            out.append(pa.RecordBatch.from_arrays([t, pa.array(keys.ravel()), *(wide.column(c) for c in ("label", "d", "node", "copies", "v")), code], ["t", "key", "label", "d", "node", "copies", "v", "code"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    return run


def _compare(v: np.ndarray, ids: np.ndarray, copies: np.ndarray, keys: np.ndarray, table: int, pairs) -> tuple[np.ndarray, np.ndarray]:
    """Of index pairs (a, b) of one table, those that link and first meet there."""
    a, b = pairs
    first = (keys[a] == keys[b]).argmax(axis=1) == table
    a, b = a[first], b[first]
    ok = np.einsum("ij,ij->i", v[a], v[b]) >= THRESHOLD
    return a[ok], b[ok]


def _union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable by the pairs, of each of n."""
    parent = np.arange(n)
    while True:
        before = parent.copy()
        low = np.minimum(parent[a], parent[b])
        np.minimum.at(parent, a, low)
        np.minimum.at(parent, b, low)
        parent = parent[parent]
        if (parent == before).all():
            return parent


_CELL = ("t", "key", "label", "d", "i", "j")


def _matcher(codes):
    """Streams a partition sorted by _CELL: every cell's pairs are compared in numpy."""

    def solve(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = pa.Table.from_batches(rows).combine_chunks().to_batches()[0] if len(rows) > 1 else rows[0]
        for dim, part in _by_length(batch):
            if (out := solve_length(part, dim)) is not None:
                yield out

    def solve_length(batch: pa.RecordBatch, dim: int):
        v = _vectors(batch, dim)
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        ids, copies = batch.column("node").to_numpy(), batch.column("copies").to_numpy()
        code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(v), -1)
        keys = _keys(np.unpackbits(code, axis=1, count=ROTATIONS * dim), dim, codes.value.width(dim))
        cell = np.stack([batch.column(c).to_numpy() for c in _CELL], axis=1)
        block = batch.column("block").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]).any(axis=1))))
        sizes = np.diff(np.concatenate((starts, [len(cell)])))
        n_links, found_a, found_b = np.zeros(len(ids), np.int64), [], []
        for size in np.unique(sizes[sizes > 1]):
            up_a, up_b = np.triu_indices(size, 1)
            at = starts[sizes == size]
            for lo in range(0, len(at), step := max(1, PAIRS // len(up_a))):
                a, b = ((at[lo : lo + step, None] + up[None, :]).ravel() for up in (up_a, up_b))
                # a cell (i, j) of a cut bucket compares block i with block j only
                cross = (cell[a, 4] == cell[a, 5]) | (block[a] != block[b])
                a, b = a[cross], b[cross]
                for t in np.unique(cell[a, 0]):
                    of = cell[a, 0] == t
                    for cut in range(0, int(of.sum()), PAIRS):
                        x, y = _compare(v, ids, copies, keys, t, (a[of][cut : cut + PAIRS], b[of][cut : cut + PAIRS]))
                        found_a.append(x)
                        found_b.append(y)
        if not found_a:
            return None
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        np.add.at(n_links, a, copies[b])
        np.add.at(n_links, b, copies[a])
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        low = order[_union(len(ids), rank[a], rank[b])[rank]]
        hit = np.flatnonzero(n_links)
        return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(n_links[hit]), pa.array(ids[low[hit]])], ["node", "n", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column(c).to_numpy() for c in _CELL], axis=1)
            change = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1))
            if held and (np.array([held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in _CELL]) != cell[0]).any():
                yield from solve(held)
                held = []
            if len(change):  # all but the last cell is complete
                cut = int(change[-1]) + 1
                yield from solve([*held, batch.slice(0, cut)])
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield from solve(held)

    return run


def near_duplicates(embeddings: DataFrame, work: Scratch | None = None) -> DataFrame:
    """One row per row of embeddings: vec_id, n_links, component_id, kept."""
    spark = embeddings.sparkSession
    work = work or Scratch(spark, "embedding_dedup")
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("label").isNotNull(), F.xxhash64(F.col("label").cast("string"))).alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    e = F.col("embedding")
    real = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    sound = given.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(real, F.lit(False)))
    packed = map_batches(sound, _pack, "vec_id long, label long, d int, v binary")
    one = packed.groupBy("vec_id").agg(F.min(F.struct("v", "d", "label")).alias("s")).select("vec_id", "s.*")
    classes = work.write(one, "vectors")
    nodes = work.write(classes.groupBy("label", "d", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "classes")

    sample: dict[int, list[np.ndarray]] = {}
    for d, v in nodes.orderBy(F.xxhash64("v"), "node").limit(SAMPLE_ROWS).select("d", "v").collect():
        sample.setdefault(d, []).append(np.frombuffer(bytes(v), "<f4" if len(v) == 4 * d else "<f8").astype(float))
    counts = nodes.groupBy("d").count().orderBy(F.desc("count"), "d").limit(LENGTHS)
    codes = spark.sparkContext.broadcast(Codes(sample, {r[0]: r[1] for r in counts.collect()}))
    indexed = map_batches(nodes, _indexer(codes), "t long, key long, label long, d int, node long, copies long, v binary, code binary")
    bucket = ["t", "key", "label", "d"]
    large = map_batches(nodes, lambda b: _indexer(codes)(b).select(bucket), "t long, key long, label long, d int").groupBy(*bucket).agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    large = work.write(large.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).drop("size"), "large")
    cut = indexed.join(F.broadcast(large) if large.count() <= 100_000 else large, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cut.select(*bucket, F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "block", "node", "copies", "v", "code")
    links = work.write(cells.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(_matcher(codes), "node long, n long, low long"), "links")
    comp = connected_components(links.where("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v")), work)
    linked = nodes.join(links.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(comp, "node", "left").select("label", "d", "v", F.coalesce("component", "node").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    by_id = classes.join(linked, ["label", "d", "v"]).select("vec_id", "n_links", "component_id")
    out = given.select("vec_id").join(by_id, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
