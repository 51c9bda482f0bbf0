"""N-gram Jaccard join: documents whose sets of word shingles overlap by at least 3/4.

Method: rare-first prefix filtering. A fixed-size count table over the shingles of all documents
orders shingles by frequency; of each set only the rarest quarter (the prefix) is joined. The
length filter, the positional filter and the suffix filter (the parities of shingle counts in 1024
hash ranges differ in no more places than the sets do, which bounds their Hamming distance)
discard pairs, and each pair left is verified once against the two texts.

Groups of copies do not become all pairs. Equal sets are one class from the start. Of the other
candidates each set first meets one smallest set of its shingles' lists, the one it shares most
prefix shingles with. Then come rounds: each deals every shingle's list into random pieces (of MEET
sets, more in the later round), compares the sets of a piece that lie in different components, and
verifies at most PARTNERS of the pairs that pass the filters for each set. So a round's work grows
with the lists and not with their squares, and a group with many links is one component before its pairs are made. Only pairs that still lie in different components are joined after that, each at the
first prefix shingle it shares, and of those of two components a few are tried first: if they link,
the others need not be. All that still lie apart are tried, so the components are those of the full
link graph. The last join's keys are pairs of blocks of BLOCK sets of a shingle's list.

Cases: null or word-less text has an empty set and links with nothing; repeated rows are one
class; rows of one doc_id are one document with the smallest of their texts (n_shingles is each row's own); a null doc_id takes
no part (component null); an empty table gives no rows; other columns are ignored; ties in
frequency are ordered by hash. Shingles are compared by a 64-bit hash.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulselake.llm.common import connected_components, map_batches, slices, utf8
from pulselake.session import Scratch, read_table, small_side

WORDS = 5
SKETCH_BITS = 20
#: 64-bit words of the parity signature of the suffix filter.
PARITY = 16
#: The same in the last join, where every prefix shingle carries a signature.
COARSE = 8
#: Sets of a piece of a shingle's list, by round; pairs that a set verifies in a round. After the second
#: round the others run only while one links more than a set in SETTLED of those still open.
MEET, PARTNERS, SETTLED = (8, 64, 64, 64, 64), 2, 200
#: Sets of a shingle's list that stand under one key in the last join.
BLOCK = 2048
#: Candidates of two components that are tried at a time, before the components are taken anew; at last all.
TRIED = (4, 64, None)
#: A shingle's list is cut into pieces of this many times the mean of the count table's cells, so that no task sorts a hot one whole.
HOT = 50
#: Shingles before a prefix shingle that tell whether a pair was met already; further back it may come again, which distinct() mends.
EARLIER = 4
_P = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hash a worker keeps before it starts afresh.
CACHE_WORDS = 50_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles (of all its words if fewer)."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    width = min(n, WORDS)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * _P + h[k : n - width + 1 + k]
    out ^= out >> np.uint64(32)
    out *= _P
    out ^= out >> np.uint64(29)
    return np.unique(out)


def prefix_length(n: int) -> int:
    """Sets with Jaccard >= 3/4 share a shingle among their n - ceil(3n/4) + 1 rarest."""
    return n - -(-3 * n // 4) + 1


def _features(batches):
    """Per document: set size, digest of the set, parity signature; per task: its part of the count table."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    for batch in slices(batches):
        sizes, digests, parity, cells = [], [], [], []
        for text in utf8(batch, "text"):
            s = shingle_set(text)
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            odd = np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=64 * PARITY) & 1
            parity.append(np.packbits(odd.astype(np.uint8)).view("<i8"))
            cells.append((s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64))
        counts += np.bincount(np.concatenate(cells), minlength=1 << SKETCH_BITS).astype(np.uint32)
        n = len(sizes)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(parity, pa.list_(pa.int64())), pa.nulls(n, pa.binary())],
            ["doc_id", "n", "sig", "parity", "counts"],
        )
    if counts.any():
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.list_(pa.int64())), pa.array([_pack(counts)], pa.binary())],
            ["doc_id", "n", "sig", "parity", "counts"],
        )


def _pack(counts: np.ndarray) -> bytes:
    """A count table as compressed little-endian bytes."""
    return pa.compress(counts.astype("<u4").tobytes(), codec="lz4", asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, decompressed_size=4 << SKETCH_BITS, codec="lz4", asbytes=True), "<u4")


def _count_table(parts: DataFrame) -> np.ndarray:
    """The sum of the tasks' count tables (2**SKETCH_BITS numbers, whatever the input), added up in a tree."""
    rdd = parts.rdd.map(lambda r: _unpack(bytes(r[0])).astype(np.uint32))
    return np.zeros(1 << SKETCH_BITS, np.uint32) if rdd.isEmpty() else rdd.treeReduce(np.add, depth=3)


def _postings(table):
    """Prefix shingles of each document, rarest first by the broadcast count table; parts: pieces of its list."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = table.value
        piece = max(1.0, HOT * float(counts.mean()))
        tokens, sizes, parts = [], [], []
        for text in utf8(batch, "text"):
            s = shingle_set(text)
            often = counts[(s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
            order = np.argsort(often, kind="stable")[: prefix_length(len(s)) if len(s) else 0]
            tokens.append(s[order])
            parts.append(np.ceil(often[order] / piece))
            sizes.append(len(s))
        each = np.array([len(t) for t in tokens], np.int64)
        pos = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), each)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(ids.astype(np.int64)), pa.array(np.repeat(sizes, each).astype(np.int32))]
            + [pa.array(x.astype(np.int32)) for x in (pos, np.concatenate(parts))],
            ["token", "id", "n", "pos", "parts"],
        )

    return run


def _linked(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    keep = []
    for x, y in zip(utf8(batch, "x"), utf8(batch, "y")):
        a, b = shingle_set(x), shingle_set(y)
        both = len(np.intersect1d(a, b, assume_unique=True))
        keep.append(100 * both >= 75 * (len(a) + len(b) - both) > 0)
    return batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])


def _near(a: str, b: str, words: int) -> Column:
    """Suffix filter: sets of sizes na and nb that link differ in at most na + nb - 2 ceil(3 (na + nb) / 7) shingles."""
    differ = sum((F.bit_count(F.col(f"{a}parity")[k].bitwiseXOR(F.col(f"{b}parity")[k])) for k in range(words)), F.lit(0))
    both = F.col(f"{a}n") + F.col(f"{b}n")
    return differ <= both - 2 * F.ceil(3 * both / 7)


def _apart(x: DataFrame, y: DataFrame, keys: list[str], again: Column | None = None) -> DataFrame:
    """Pairs (u, v) of different components that stand together under the keys and pass the length, positional and coarse filters, without those that again marks."""
    y = y.select(*keys, *(F.col(c).alias(f"y_{c}") for c in ("id", "n", "pos", "component", "parity", "before")))
    filters = F.expr(
        "component <> y_component and (n < y_n or (n = y_n and id < y_id)) and 4 * n >= 3 * y_n"
        " and pos <= n - ceil(6 * n / 7) and least(n - pos, y_n - y_pos) >= ceil(3 * (n + y_n) / 7)"
    )
    same = reduce(lambda a, b: a & b, (x[c] == y[c] for c in keys))
    found = x.join(y, (same & filters & _near("", "y_", COARSE)) if again is None else (same & filters & _near("", "y_", COARSE) & ~again))
    return found.select(F.least("id", "y_id").alias("u"), F.greatest("id", "y_id").alias("v")).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    """Both ends (doc_id, first) of every pair (u, v, ...) of a written table, to join with rows of documents."""
    end = lambda k: F.struct(F.col(k).alias("doc_id"), F.lit(k == "u").alias("first"))
    ends = pairs.select("*", F.explode(F.array(end("u"), end("v"))).alias("end")).select(*pairs.columns, "end.*")
    return small_side(ends, 2 * pairs.count())


def _passing(pairs: DataFrame, features: DataFrame, work: Scratch) -> DataFrame:
    """The pairs (u, v, ...) that the suffix filter lets through."""
    pairs = work.write(pairs, "pairs")
    of = lambda c, first: F.max(F.when(F.col("first") == first, F.col(c))).alias(f"{'u' if first else 'v'}_{c}")
    both = features.select("doc_id", "n", "parity").join(_ends(pairs), "doc_id").groupBy(*pairs.columns)
    return both.agg(*(of(c, first) for c in ("n", "parity") for first in (True, False))).where(_near("u_", "v_", PARITY)).select(*pairs.columns)


def _verified(pairs: DataFrame, docs: DataFrame, work: Scratch) -> DataFrame:
    """The pairs (u, v) of a written table whose texts link."""
    texts = docs.join(_ends(pairs.select("u", "v")), "doc_id").groupBy("u", "v")
    texts = texts.agg(F.max(F.when(F.col("first"), F.col("text"))).alias("x"), F.max(F.when(~F.col("first"), F.col("text"))).alias("y"))
    return work.write(map_batches(texts, _linked, "u long, v long"), "links")


def _placed(shared: DataFrame, comp: DataFrame, work: Scratch) -> DataFrame:
    """The postings of shingles whose sets lie in several components, with these and the length of the shingle's list."""
    keep = [c for c in shared.columns if c not in ("component", "size")]
    shared = shared.select(*keep)
    placed = shared.join(small_side(comp.withColumnRenamed("node", "id"), comp.count()), "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("token", "size")
    return work.write(placed.join(split, "token").select(*keep, "component", "size"), "open")


def _between(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs (u, v) of different components, numbered (nth) among those of the same two components."""
    comp = small_side(comp, comp.count())
    of = lambda k: comp.select(F.col("node").alias(k), F.col("component").alias(f"{k}_component"))
    placed = pairs.select("u", "v").join(of("u"), "u", "left").join(of("v"), "v", "left")
    ends = [F.coalesce("u_component", "u"), F.coalesce("v_component", "v")]
    apart = placed.select("u", "v", F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).where("a <> b")
    nth = F.row_number().over(W.partitionBy("a", "b").orderBy(F.xxhash64("u", "v"), "u", "v"))
    return apart.select("u", "v", nth.alias("nth"))


def near_duplicate_components(docs: DataFrame, work: Scratch | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    spark = docs.sparkSession
    work = work or Scratch(spark, "ngram_join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = work.write(docs.mapInArrow(_features, "doc_id long, n long, sig binary, parity array<long>, counts binary"), "features")
    features = rows = made.where("counts is null").select("doc_id", "n", "sig", "parity")
    table = spark.sparkContext.broadcast(_count_table(made.where("counts is not null").select("counts")))
    docs = docs.where("doc_id is not null")
    if features.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).count():
        docs = work.write(docs.groupBy("doc_id").agg(F.min("text").alias("text")), "documents")
        features = work.write(docs.mapInArrow(_features, made.schema), "features").where("counts is null").select("doc_id", "n", "sig", "parity")
    features = features.where("doc_id is not null")

    # one class for each distinct set; its smallest id stands for it
    classes = features.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"))
    member = work.write(features.join(classes, "sig", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "classes")
    copies = member.where("doc_id <> rep or n = 0").select("doc_id")
    own = docs.join(small_side(copies, copies.count()), "doc_id", "left_anti")

    piece = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), "parts")
    in_list = W.partitionBy("token", piece(0)).orderBy("n", "id")
    found = map_batches(own, _postings(table), "token long, id long, n int, pos int, parts int").withColumns(
        {"prev": F.first("id").over(in_list), "prev_n": F.first("n").over(in_list), "next": F.lead("id").over(in_list)}
    )
    shared = work.write(found.where("parts > 1 or prev <> id or next is not null").drop("next"), "postings")

    # first: each set and, of the smallest sets of its shingles' lists, the one it shares most prefix shingles with
    chain = shared.where("prev <> id and 4 * prev_n >= 3 * n").groupBy("id", "prev").agg(F.count("*").alias("k"))
    best = chain.groupBy("id").agg(F.max_by("prev", F.struct("k", "prev")).alias("prev"))
    tried = work.write(_passing(best.select(F.least("prev", "id").alias("u"), F.greatest("prev", "id").alias("v")), features, work), "tried")
    comp = connected_components(_verified(tried, docs, work), work)

    # then: some pairs a set, of pieces of the lists
    open_ = _placed(shared.drop("prev", "prev_n"), comp, work)
    work.drop(shared)
    before = F.collect_list("token").over(W.partitionBy("id").orderBy("pos").rowsBetween(-EARLIER, -1))
    # ranges COARSE apart share a parity bit here; the whole signature judges the pairs found
    coarse = F.array(*(reduce(lambda a, b: a.bitwiseXOR(b), (F.col("parity")[j] for j in range(k, PARITY, COARSE))) for k in range(COARSE)))
    last, open_ = open_, work.write(open_.withColumn("before", before).join(features.select(F.col("doc_id").alias("id"), coarse.alias("parity")), "id"), "signed")
    work.drop(last)
    for k, most in enumerate(MEET, 1):
        # where both sets are of like size, both places are within the first seventh
        met = open_.where("pos <= n - ceil(6 * n / 7)").withColumn("part", F.pmod(F.xxhash64("id", "token", F.lit(k)), F.ceil(F.col("size") / most)))
        near = _apart(met, met, ["token", "part"])
        chosen = F.row_number().over(W.partitionBy("u").orderBy(F.xxhash64("v", F.lit(k)), "v")) <= PARTNERS
        near = near.withColumn("chosen", chosen).where("chosen").select("u", "v")
        fresh = work.write(_passing(near.join(tried, ["u", "v"], "left_anti"), features, work), "tried")
        tried = tried.union(fresh)
        links = _verified(fresh, docs, work)
        n_links = links.count()
        if n_links:
            comp = connected_components(comp.select(F.col("node").alias("u"), F.col("component").alias("v")).union(links), work)
            last, open_ = open_, _placed(open_, comp, work)
            work.drop(last)
        if k >= 2 and n_links * SETTLED <= open_.select("id").distinct().count():
            break

    # last: every other candidate pair whose ends are still apart, at the first prefix shingle that it shares
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("int")
    own, each = F.pmod(F.xxhash64("id", F.lit(0)), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    x = open_.select("token", "id", "n", "pos", "component", "parity", "before", own.alias("x_block"), each.alias("y_block"))
    y = open_.select("token", "id", "n", "pos", "component", "parity", "before", own.alias("y_block"), each.alias("x_block"))
    rest = _apart(x, y, ["token", "x_block", "y_block"], F.arrays_overlap("before", "y_before")).join(tried, ["u", "v"], "left_anti")
    rest = work.write(rest, "rest")
    work.drop(open_)
    for most in TRIED:
        rest = work.write(_between(rest, comp), "between")
        if rest.isEmpty():
            break
        now = rest if most is None else rest.where(F.col("nth") <= most)
        links = _verified(work.write(_passing(now.select("u", "v"), features, work), "passing"), docs, work)
        if not links.isEmpty():
            comp = connected_components(comp.select(F.col("node").alias("u"), F.col("component").alias("v")).union(links), work)
        rest = rest.where(F.lit(False)) if most is None else rest.where(F.col("nth") > most)
    final = comp.withColumnRenamed("node", "rep")

    placed = member.join(small_side(final, final.count()), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles")).join(placed, "doc_id", "left").select("doc_id", "n_shingles", "component_id")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates over all documents."""
    return near_duplicate_components(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, w, least(5, len(w)) AS m, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + m - 1], ' ') AS s FROM k),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, coalesce(min(r.c), d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""
