"""Language identification with a string kernel.

Blended-spectrum presence kernel: a text is the set of its byte n-grams of 1 to 4 bytes (A-Z
lower-cased, digits and ASCII punctuation taken as blanks), hashed to DIM places; the kernel of
two texts is the size of their common set over the root of the product of their sizes. Landmark
texts give a Nyström map K(x, landmarks) K(landmarks, landmarks)^(-1/2); on it one ridge
regression per language is fitted against the others. Scoring a batch is three matrix products.

The fit reads at most PER_LANGUAGE labelled texts of each language, taken in hash order (a bounded
sample; TRAIN_ROWS in all); every text is scored whole.

Cases: null text, or a text without a letter, is ``und`` with score 0; ties go to the first
language by code point; repeated rows are predicted alike; an id with several languages teaches the first by code point, with the first of its texts' sets; without any labelled text every text
is ``und``; an empty table gives no rows; lang, source and doc_id are not read when predicting.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulselake.llm.common import in_fold, map_batches, utf8
from pulselake.session import read_table

DIM_BITS = 13
PER_LANGUAGE = 500
#: Shares of the ids in which the first of a language are sought.
SHARES = 64
LANDMARKS = 160
TRAIN_ROWS = 8000
RIDGE = 1e-2
#: Texts scored below this are rejected by keep_recognised (four languages score 0.25 each by chance).
MIN_SCORE = 0.35
SHARPNESS = 6.0
#: ASCII letters lower-cased, bytes of non-ASCII characters kept, the rest blank.
_FOLD = np.array([b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)], np.uint32)
_MULT = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263))
#: Bytes of a text turned into n-grams at a time.
SLICE = 1 << 20


def gram_set(text: bytes) -> np.ndarray:
    """Which of the DIM hashed n-grams (1 to 4 bytes) occur anywhere in the text."""
    present = np.zeros(1 << DIM_BITS, bool)
    for at in range(0, len(text), SLICE):
        b = _FOLD[np.frombuffer(text[max(0, at - 3) : at + SLICE], np.uint8)]
        b = b[np.concatenate(([True], (b[1:] != 0x20) | (b[:-1] != 0x20)))]
        h = np.zeros(len(b), np.uint32)
        for k in range(4):
            if len(b) <= k:
                break
            h = h[: len(b) - k] * np.uint32(0x01000193) + (b[k:] + np.uint32(1)) * _MULT[k]
            present[(h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - DIM_BITS)] = True
    return present


def has_letter(text: bytes | None) -> bool:
    """Whether any character is a letter (Unicode category L: digits, fractions, numerals and lone marks are none)."""
    return bool(text) and any(map(str.isalpha, text.decode("utf-8", "replace")))


def _unit(present: np.ndarray) -> np.ndarray:
    """Rows scaled so that their products are kernel values."""
    x = present.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1.0))


class Model:
    """Landmarks, Nyström map and regression weights."""

    def __init__(self, present: np.ndarray, labels: np.ndarray):
        self.languages = sorted(set(labels.tolist()))
        # landmarks in turn from each language, in the sample's (hash) order
        turn = np.zeros(len(labels), np.int64)
        for lang in self.languages:
            turn[labels == lang] = np.arange((labels == lang).sum())
        self.landmarks = _unit(present[np.argsort(turn, kind="stable")[:LANDMARKS]])
        values, vectors = np.linalg.eigh(self.landmarks @ self.landmarks.T)
        ok = values > 1e-6 * values.max()
        self.root = (vectors[:, ok] / np.sqrt(values[ok])).astype(np.float32)
        z = np.concatenate([self.features(_unit(present[at : at + 256])) for at in range(0, len(present), 256)])
        z1 = np.hstack([z, np.ones((len(z), 1), np.float32)])
        y = np.where(labels[:, None] == np.array(self.languages)[None, :], 1.0, -1.0)
        weight = 1.0 / np.array([(labels == lang).sum() for lang in labels])
        gram = (z1 * weight[:, None]).T @ z1
        self.weights = np.linalg.solve(gram + RIDGE * np.eye(len(gram)) * np.trace(gram) / len(gram), (z1 * weight[:, None]).T @ y).astype(np.float32)

    def features(self, x: np.ndarray) -> np.ndarray:
        """The Nyström coordinates of kernel rows."""
        return (x @ self.landmarks.T) @ self.root

    def predict(self, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number, score in 0 to 1) of each row."""
        f = self.features(_unit(present)) @ self.weights[:-1] + self.weights[-1]
        e = np.exp(SHARPNESS * (f - f.max(axis=1, keepdims=True)))
        p = e / e.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def fit(docs: DataFrame) -> Model | None:
    """A model from the labelled rows outside the held-out third; None if there is none."""
    light = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), 3, 1))
    one = light.groupBy("doc_id").agg(F.min("lang").alias("lang")).withColumn("h", F.xxhash64("doc_id"))
    # first within a share of the ids, then among the shares' first ones: no task sorts a whole language
    first = lambda df, *by: df.withColumn("nth", F.row_number().over(W.partitionBy("lang", *by).orderBy("h", "doc_id"))).where(F.col("nth") <= PER_LANGUAGE)
    picked = first(first(one, F.pmod("h", F.lit(SHARES)))).orderBy("nth", "lang").limit(TRAIN_ROWS).select(F.col("doc_id").alias("k"), F.col("lang").alias("label"), "nth")
    texts = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("k")).where(F.col("lang") == F.col("label")).select("label", "nth", "text")

    def grams(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keep = [k for k, t in enumerate(utf8(batch, "text")) if has_letter(t)]
        batch = batch.take(pa.array(keep, pa.int64()))
        packed = [np.packbits(gram_set(t)).tobytes() for t in utf8(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column("label"), batch.column("nth"), pa.array(packed, pa.binary())], ["label", "nth", "grams"])

    one_each = map_batches(texts, grams, "label string, nth int, grams binary").groupBy("label", "nth").agg(F.min("grams").alias("grams"))
    rows = sorted(one_each.collect(), key=lambda r: (r[1], r[0]))
    if not rows:
        return None
    present = np.unpackbits(np.frombuffer(b"".join(bytes(r[2]) for r in rows), np.uint8).reshape(len(rows), -1), axis=1)
    return Model(present, np.array([r[0] for r in rows]))


def _predictor(model, block: int = 512):
    def run(texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        known = [k for k, t in enumerate(texts) if model.value is not None and has_letter(t)]
        for lo in range(0, len(known), block):
            part = known[lo : lo + block]
            best, p = model.value.predict(np.stack([gram_set(texts[k]) for k in part]))
            for k, b, s in zip(part, best.tolist(), p.tolist()):
                lang[k], score[k] = model.value.languages[b], min(1.0, max(0.0, s))
        return lang, score

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of each row of docs."""
    run = _predictor(docs.sparkSession.sparkContext.broadcast(model))

    def batch_fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = run(utf8(batch, "text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), batch_fn, "doc_id long, lang_pred string, score double")


def keep_recognised(docs: DataFrame, model: Model | None, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs whose language is recognised with at least min_score, all columns as they are."""
    run = _predictor(docs.sparkSession.sparkContext.broadcast(model))

    def batch_fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = run(utf8(batch, "text"))
        return batch.filter(pa.array([a != "und" and s >= min_score for a, s in zip(lang, score)], pa.bool_()))

    return map_batches(docs, batch_fn, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = read_table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
