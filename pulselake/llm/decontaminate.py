"""Benchmark decontamination: Wu-Manber search for windows of benchmark words in whole documents.

Words are symbols (numbered by the benchmark's vocabulary; 0 is any other word). Windows of one
length form a table set: a shift table over blocks of two words tells how far the search may jump
(0 where the block ends a window), buckets by that block select the windows to test, and all words
of a candidate are compared directly. A batch of documents is searched in lockstep: every document
(in overlapping pieces of PIECE words) has its own position and jumps by its own shift, in numpy.

The windows are broadcast in parts of at most PART_WORDS words, so their size is bounded whatever
the benchmark's: more parts mean more passes, one part on the driver at a time, whose written hits
are united per text. A document's verdict depends on its text alone in either case.

Cases: null or word-less documents have no words, no hits, and are clean; items without words have
no window; repeated items with the same text are all named; repeated documents, and documents
without or with one id, are judged each by its own text; the windows of an item without id count as
hits, and the item is not counted or named; an empty table on either side gives no hits; other
columns are ignored; lengths are not limited.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.llm.common import alnum_words, map_batches, utf8
from pulselake.session import Scratch, read_table

WINDOW = 13
PIECE = 4096
#: Benchmark words in one broadcast part.
PART_WORDS = 2_000_000
#: Words of a batch that are searched at once.
BATCH_WORDS = 2_000_000
_M = np.uint64(0x9E3779B97F4A7C15)
SHIFT_BITS = 18


def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring symbols."""
    return (((a.astype(np.uint64) * _M) ^ (b.astype(np.uint64) + np.uint64(0x51ED27))) * _M >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)


class Tables:
    """Shift and bucket tables of windows of one length."""

    def __init__(self, windows: np.ndarray):
        self.windows, self.m = windows, windows.shape[1]
        if self.m == 1:
            keys, self.shift = windows[:, 0].astype(np.int64), None
        else:
            self.shift = np.full(1 << SHIFT_BITS, self.m - 1, np.int16)
            for end in range(1, self.m):
                at = _block(windows[:, end - 1], windows[:, end])
                np.minimum.at(self.shift, at, self.m - 1 - end)
            keys = _block(windows[:, -2], windows[:, -1])
        self.order = np.argsort(keys, kind="stable")
        self.sorted = keys[self.order]

    def find(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word's position, window) of every occurrence that lies within one [start, end)."""
        if self.m == 1:
            at = np.flatnonzero(words)
            keys = words[at].astype(np.int64)
        else:
            # pieces overlap by m - 1 words, so that each window lies wholly in one
            pieces = np.maximum(1, -(-(ends - starts) // PIECE))
            k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            left = np.repeat(starts, pieces) + k * PIECE
            right = np.minimum(np.repeat(ends, pieces), left + PIECE + self.m - 1)
            at, hits = left + self.m - 1, []
            while True:
                live = at < right
                at, right = at[live], right[live]
                if not len(at):
                    break
                shift = self.shift[_block(words[at - 1], words[at])]
                hits.append(at[shift == 0])
                at = at + np.maximum(shift, 1)
            at = np.unique(np.concatenate(hits)) if hits else np.empty(0, np.int64)
            keys = _block(words[at - 1], words[at])
        lo, hi = np.searchsorted(self.sorted, keys, "left"), np.searchsorted(self.sorted, keys, "right")
        n = hi - lo
        pos = np.repeat(at, n)
        which = self.order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        for back in range(self.m):  # direct comparison, word by word, on what is left
            same = words[pos - back] == self.windows[which, self.m - 1 - back]
            pos, which = pos[same], which[same]
        return pos, which


class Benchmark:
    """The windows of some items, ready to search."""

    def __init__(self, items: list[tuple[object, bytes | None]]):
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[str | None] = []
        by_length: dict[int, dict[tuple, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in alnum_words(text)]
            if words:
                m, own = min(WINDOW, len(words)), len(self.ids)
                self.ids.append(None if item_id is None else str(item_id))
                for k in range(len(words) - m + 1):
                    if own not in (of := by_length[m][tuple(words[k : k + m])]):
                        of.append(own)
        self.tables = [(Tables(np.array(list(ws), np.int32)), list(ws.values())) for ws in by_length.values()]

    def scan(self, texts: list[bytes | None]):
        """(words, hit spans as [first, last] positions, item ids) of each text."""
        number = self.vocabulary.get
        split = [[number(w, 0) for w in alnum_words(t)] for t in texts]
        ends = np.cumsum([len(s) for s in split])
        starts = ends - [len(s) for s in split]
        words = np.fromiter((w for s in split for w in s), np.int32, int(ends[-1]) if len(ends) else 0)
        spans, items = [[] for _ in texts], [set() for _ in texts]
        for table, owners in self.tables:
            pos, which = table.find(words, starts, ends)
            doc = np.searchsorted(ends, pos, "right")
            for p, w, d in zip((pos - starts[doc]).tolist(), which.tolist(), doc.tolist()):
                spans[d].append((p - table.m + 1, p))
                items[d].update(owners[w])
        return [(len(s), spans[d], {self.ids[i] for i in items[d]} - {None}) for d, s in enumerate(split)]


def covered(spans: list[tuple[int, int]], n: int) -> int:
    """Positions inside any span."""
    if not spans:
        return 0
    marks = np.zeros(n + 1, np.int64)
    at = np.array(spans)
    np.add.at(marks, at[:, 0], 1)
    np.add.at(marks, at[:, 1] + 1, -1)
    return int((np.cumsum(marks)[:n] > 0).sum())


def _chunks(texts: list[bytes | None]):
    """Runs of texts of about BATCH_WORDS words (by bytes), at least one text each."""
    lo = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t or b"") > 6 * BATCH_WORDS:
            yield lo, k
            lo, size = k, 0
        size += len(t or b"")
    yield lo, len(texts)


def _verdict(n: int, spans, items) -> tuple:
    hit = covered(spans, n)
    return n, hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0 and 20 * hit >= n


DIGEST = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _scanner(bench, keep_clean: bool):
    """A batch function: digest columns, or with keep_clean the batch's clean rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, rows = utf8(batch, "text"), []
        for lo, hi in _chunks(texts):
            rows += [_verdict(*r) for r in bench.value.scan(texts[lo:hi])]
        if keep_clean:
            return batch.filter(pa.array([not r[-1] for r in rows], pa.bool_()))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return run


def _parts(benchmark: DataFrame) -> Iterator[list]:
    """The items in lists of PART_WORDS words at most (one item at least); one list, maybe empty, at least."""
    items, size = [], 0
    for item_id, text in benchmark.select("item_id", "text").toLocalIterator():
        raw = text.encode() if text is not None else None
        if items and size + len(raw or b"") > 6 * PART_WORDS:
            yield items
            items, size = [], 0
        items.append((item_id, raw))
        size += len(raw or b"")
    yield items


def _passes(docs: DataFrame, benchmark: DataFrame, work: Scratch | None):
    """(broadcast windows, None) if they are one part, else (None, text key and digests of each distinct text)."""
    spark, parts = docs.sparkSession, _parts(benchmark)
    first, second = next(parts), next(parts, None)
    if second is None:
        return spark.sparkContext.broadcast(Benchmark(first)), None
    work, whole = work or Scratch(spark, "decontaminate"), None
    keyed = docs.select(_key().alias("row"), F.col("text").cast("string").alias("text"))
    for k, items in enumerate(chain((first, second), parts)):
        windows = spark.sparkContext.broadcast(Benchmark(items))
        found = map_batches(keyed, _part_scanner(windows), "row string, n long, spans array<array<long>>, items array<string>")
        found = work.write(found.groupBy("row").agg(F.first("n").alias("n"), F.first("spans").alias("spans"), F.first("items").alias("items")), f"part{k}")
        windows.destroy()
        whole = found if whole is None else whole.unionByName(found)
    joined = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)  # noqa: E731  one list of each part
    united = whole.groupBy("row").agg(F.max("n").alias("n"), joined("spans"), joined("items"))
    return None, work.write(map_batches(united, _unite, f"row string, {DIGEST}"), "digests")


def _key():
    """128 bits of a text; null is as an empty text."""
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))


def scan(docs: DataFrame, benchmark: DataFrame, work: Scratch | None = None) -> DataFrame:
    """doc_id and the digest columns of each row of docs."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    windows, digests = _passes(docs, benchmark, work)
    if windows is not None:
        return map_batches(docs, _scanner(windows, False), f"doc_id long, {DIGEST}")
    return docs.select("doc_id", _key().alias("row")).join(digests, "row").drop("row")


def _part_scanner(bench):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, rows = utf8(batch, "text"), []
        for lo, hi in _chunks(texts):
            rows += bench.value.scan(texts[lo:hi])
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array([r[0] for r in rows], pa.int64()), pa.array([[list(s) for s in set(r[1])] for r in rows], pa.list_(pa.list_(pa.int64()))), pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string()))],
            ["row", "n", "spans", "items"],
        )

    return run


def _unite(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = [_verdict(n, s, set(i)) for n, s, i in zip(*(batch.column(c).to_pylist() for c in ("n", "spans", "items")))]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], ["row", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, work: Scratch | None = None) -> DataFrame:
    """The rows of docs that are not contaminated, all columns as they are; a row is judged by its text only."""
    windows, digests = _passes(docs, benchmark, work)
    if windows is not None:
        return map_batches(docs, _scanner(windows, True), docs.schema)
    bad = digests.where("contaminated").select(F.col("row").alias("bad_row"))
    return docs.join(bad, _key() == F.col("bad_row"), "left_anti")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of all documents."""
    return scan(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT item_id, w, least(13, len(w)) AS m FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[k:k + m - 1], ' ') AS s FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM n)),
ms AS (SELECT DISTINCT m FROM win),
occ AS (SELECT DISTINCT g.doc_id, g.k, g.m, win.item_id FROM (SELECT doc_id, k, m, array_to_string(w[k:k + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, ms WHERE len(w) >= m)) g JOIN win ON win.m = g.m AND win.s = g.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
