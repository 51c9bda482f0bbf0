"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every text becomes FEATURES numbers (lengths, shares of character classes, repetition of words
and lines). A labelled, bounded sample in hash order (TRAIN_ROWS) is binned by quantiles and
boosted with log loss: per node, gradient sums by feature and bin give the best split. The trees
are flattened into arrays (feature, threshold, left child, leaf value) and a batch of documents
walks all of them at once in numpy, level by level.

Cases: null and empty texts have zero statistics and are scored like any other; repeated rows
score alike; without labels of both kinds every score is the share of label 1 (0.5 without any);
duplicate labels of a document are taken once, the smallest, and of the texts of a repeated id one; an empty table gives no rows; other
columns, also clashing ones, are ignored; texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.llm.common import in_fold, map_batches, utf8
from pulselake.session import read_table

FEATURES = ("bytes", "words", "mean_word", "max_word", "upper", "digit", "punct", "non_ascii", "blank", "lines", "mean_line", "repeated_lines", "distinct_words", "top_word", "shouted", "symbol_runs", "pipes", "stops", "distinct_per_root", "short_words")
TRAIN_ROWS = 20_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
MIN_LEAF = 8
L2 = 1.0
THRESHOLD = 0.3

_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 digit, 3 blank, 4 non-ASCII, 5 stop, 6 symbol, 7 pipe, 0 other letters
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
_CLASS[0x80:] = 4
_CLASS[[ord(c) for c in ".,;:?'\"-"]] = 5
_CLASS[[ord(c) for c in "!#$%&*+/<=>@\\^_`~()[]{}"]] = 6
_CLASS[ord("|")] = 7


def statistics(text: bytes | None) -> np.ndarray:
    """The FEATURES of one text."""
    out = np.zeros(len(FEATURES), np.float32)
    if not text:
        return out
    kinds = _CLASS[np.frombuffer(text, np.uint8)]
    n = np.bincount(kinds, minlength=8)
    words, lines = text.split(), text.split(b"\n")
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    k, size = max(1, len(words)), len(text)
    symbol = kinds == 6
    runs = int((symbol[2:] & symbol[1:-1] & symbol[:-2]).sum()) if size > 2 else 0
    shouted = text.count(b"!!")
    out[:] = (
        size, len(words), sizes.mean(), sizes.max(), n[1] / size, n[2] / size, (n[5] + n[6]) / size, n[4] / size, n[3] / size, len(lines), size / len(lines),
        1 - len(set(lines)) / len(lines), len(counts) / k, max(counts.values(), default=0) / k, shouted / k, runs / k, n[7] / k, n[5] / k, len(counts) / k**0.5, (sizes <= 3).mean(),
    )
    return out


class Trees:
    """Boosted trees as flat arrays; node 0 of a tree is its root, leaves loop on themselves."""

    def __init__(self, prior: float, trees: list[dict]):
        self.prior, width = prior, max((len(t["feature"]) for t in trees), default=0)
        grown = lambda key, kind: np.array([t[key] + [0] * (width - len(t[key])) for t in trees], kind).reshape(len(trees), width)
        self.feature, self.threshold, self.left, self.value = grown("feature", np.int32), grown("threshold", np.float32), grown("left", np.int32), grown("value", np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        raw = np.full(len(x), self.prior)
        if len(self.feature):
            tree = np.arange(len(self.feature))[None, :]
            node = np.zeros((len(x), len(self.feature)), np.int32)
            row = np.arange(len(x))[:, None]
            for _ in range(DEPTH):
                left = self.left[tree, node]
                go = x[row, self.feature[tree, node]] > self.threshold[tree, node]
                node = np.where(left > 0, left + go, node)
            raw = raw + self.value[tree, node].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def train(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosts DEPTH-level trees on binned features with the log loss."""
    share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    prior = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return Trees(prior, [])
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    raw, trees, offset = np.full(len(y), prior), [], np.arange(x.shape[1]) * BINS
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        tree = {"feature": [0], "threshold": [0.0], "left": [0], "value": [0.0]}
        level = [(0, np.arange(len(y)))]
        for depth in range(DEPTH + 1):
            after = []
            for node, rows in level:
                g, h = grad[rows].sum(), hess[rows].sum()
                best = None
                if depth < DEPTH and len(rows) >= 2 * MIN_LEAF:
                    cells = (binned[rows] + offset).ravel()
                    each = x.shape[1]
                    sums = [np.bincount(cells, np.repeat(v, each), minlength=BINS * each).reshape(each, BINS).cumsum(axis=1) for v in (grad[rows], hess[rows], np.ones(len(rows)))]
                    gl, hl, nl = sums
                    gain = gl**2 / (hl + L2) + (g - gl) ** 2 / (h - hl + L2) - g**2 / (h + L2)
                    gain[(nl < MIN_LEAF) | (len(rows) - nl < MIN_LEAF)] = -1
                    f, b = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[f, b] > 1e-6 and b < len(cuts[f]):
                        best = int(f), int(b)
                if best is None:
                    value = RATE * g / (h + L2)
                    tree["value"][node] = float(value)
                    raw[rows] += value
                    continue
                f, b = best
                left = len(tree["feature"])
                for key in tree:
                    tree[key] += [0, 0]
                tree["feature"][node], tree["threshold"][node], tree["left"][node] = f, float(cuts[f][b]), left
                low = binned[rows, f] <= b
                after += [(left, rows[low]), (left + 1, rows[~low])]
            level = after
        trees.append(tree)
    return Trees(prior, trees)


def fit(docs: DataFrame, labels: DataFrame) -> Trees:
    """Trees from the labelled rows outside the held-out fifth (TRAIN_ROWS of them at most, in hash order)."""
    taught = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~in_fold(F.col("doc_id"), 5, 0))
    picked = taught.groupBy(F.col("doc_id").alias("k")).agg(F.min("quality").cast("int").alias("y")).orderBy(F.xxhash64("k"), "k").limit(TRAIN_ROWS)
    known = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("k"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("k"), batch.column("y"), pa.array([statistics(t).tobytes() for t in utf8(batch, "text")], pa.binary())], ["k", "y", "x"])

    one_each = map_batches(known.select("k", "y", "text"), run, "k long, y int, x binary").groupBy("k", "y").agg(F.min("x").alias("x"))
    rows = sorted(one_each.collect(), key=lambda r: r[0])
    x = np.frombuffer(b"".join(bytes(r[2]) for r in rows), np.float32).reshape(len(rows), len(FEATURES))
    return train(x.astype(np.float64), np.array([r[1] for r in rows], np.float64))


def score(docs: DataFrame, model: Trees, block: int = 2000) -> DataFrame:
    """doc_id and score of each row of docs."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.stack([statistics(t) for t in utf8(batch, "text")])
        p = np.concatenate([model.score(x[lo : lo + block]) for lo in range(0, len(x), block)])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, "doc_id long, score double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
