"""Conversation prefix trie: what conversations share when they are read from their first turn on.

Conversations are rebuilt on shared openings (see `rebuilt`) and every distinct sequence of first
turns is a node. A prefix is known by two 64-bit exclusive-or sums of hashes of (depth, SHA-256 of
the turn), so that a turn's row tells the digest of the prefix before it as well.

Method: count-min screening. Every task counts its prefixes in a sketch of ROWS rows (cells hold 1
or 2 and more); the sketches meet in a tree and the cells of 2 and more are sent to all tasks. An
estimate of one proves that no other conversation has the prefix. What follows such a prefix, the
tail, is a chain of nodes whose every value the row itself tells: it is emitted where it is read.
Only prefixes that may be shared are shuffled and grouped exactly. A wrong estimate (always too
high) costs a shuffled row, never a result.

Values over subtrees need no walk: a node belongs to its smallest member, a conversation's own nodes
are the last ones of its path, and a node's subtree holds the own nodes of its members. So a node's
leaves and savings are sums over its members of one number each, beside a running sum along its own
conversation.

Hot groups: counts, minima and sums are combined before they are shuffled. Turns are numbered by a
sort that deals out a long conversation too; running sums go by pieces of PIECE turns. A node's
closing ids are joined in ranges of RANGE ids; SHA-256 has one order, so a node with more ranges is
read by one task as a stream of these, in order. The joins that carry a hot key are plain joins of
a large with a unique side, which Spark splits.

Cases: a null conv_id is no conversation (its rows are left out); null role and text are empty, and
the two differ from nothing else; turns are in order of turn (null first), then role, then text, so
ties and repeated rows have a fixed order and every row is a turn; a conversation left without turns
is a member of the root; a long text is held one at a time; a table without conversations has no
node, not even the root; other columns are ignored. Remainders have the sign of the id, as in SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulselake.llm.common import slices
from pulselake.session import Scratch, read_table, small_side

#: Conversations of one block of so many ids share an opening, of at most SHARED - 1 turns.
BLOCK_IDS, SHARED = 100, 6
#: Rows of the sketch, and cells of a row: as many as prefixes times SPREAD, between these powers of two.
ROWS, SPREAD, LEAST_BITS, MOST_BITS = 3, 8, 16, 24
#: Turns of a piece of a running sum; ids of a range of closing ids.
PIECE, RANGE = 4096, 4096
_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _running(rows: DataFrame, key: str, at: str, down: bool, **sums) -> DataFrame:
    """rows with running aggregates along at within key, piece by piece; sums: name=(aggregate, column)."""
    piece = F.floor(F.col(at) / PIECE)
    order = lambda c: F.col(c).desc() if down else F.col(c).asc()
    inner = W.partitionBy(key, "_piece").orderBy(order(at)).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_piece", piece).withColumns({f"_{n}": f(c).over(inner) for n, (f, c) in sums.items()})
    # pieces beyond the first, of conversations longer than a piece
    before = W.partitionBy(key).orderBy(order("_piece")).rowsBetween(W.unboundedPreceding, -1)
    pieces = rows.groupBy(key, "_piece").agg(*(f(c).alias(f"_of_{n}") for n, (f, c) in sums.items()))
    start = pieces.select(key, "_piece", *(f(f"_of_{n}").over(before).alias(f"_before_{n}") for n, (f, c) in sums.items()))
    start = start.where(" or ".join(f"_before_{n} is not null" for n in sums))
    out = rows.join(small_side(start, start.count()), [key, "_piece"], "left")
    for n, (f, _) in sums.items():
        both = F.col(f"_{n}").bitwiseXOR(F.coalesce(f"_before_{n}", F.lit(0))) if f is F.bit_xor else F.col(f"_{n}") + F.coalesce(f"_before_{n}", F.lit(0))
        out = out.withColumn(n, both)
    return out.drop("_piece", *(f"_{n}" for n in sums), *(f"_before_{n}" for n in sums))


def numbered_turns(conversations: DataFrame, work: Scratch) -> DataFrame:
    """conv_id, j (place from 1), turn's SHA-256 and code points of its text; a sorted table, so no conversation meets in one task."""
    given = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    placed = given.orderBy("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    placed = work.write(placed.select("conv_id", said.alias("said"), F.length("text").cast("long").alias("n"), F.monotonically_increasing_id().alias("m")), "sorted")
    part = F.shiftright("m", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("before"))  # one row a partition
    at = placed.join(F.broadcast(starts), part == F.col("part")).withColumn("i", F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1)))
    first = at.groupBy("conv_id").agg(F.min("i").alias("first"))
    return at.join(small_side(first, first.count()), "conv_id").select("conv_id", (F.col("i") - F.col("first") + 1).alias("j"), "said", "n")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c as the first h turns of conversation c - c % 100 and its own after its first h; h = crc32(c) % 6.

    Returns the turns (conv_id, depth, said, n) and every conversation with its length (conv_id, length).
    """
    convs = turns.groupBy("conv_id").agg(F.max("j").alias("own"))
    block = F.col("conv_id") - F.col("conv_id") % BLOCK_IDS
    convs = convs.select("conv_id", "own", (F.crc32(F.col("conv_id").cast("string")) % SHARED).alias("h"), block.alias("base"))
    bases = convs.where("conv_id = base").select("base", F.col("own").alias("base_own"))
    convs = convs.join(small_side(bases, bases.count()), "base", "left").withColumn("k", F.least("h", F.coalesce("base_own", F.lit(0))))
    opening = turns.where((F.col("conv_id") == block) & (F.col("j") < SHARED)).select(F.col("conv_id").alias("base"), F.col("j").alias("depth"), "said", "n")
    shared = convs.where("k > 0").select("conv_id", "base", "k").join(small_side(opening, opening.count()), "base").where("depth <= k").select("conv_id", "depth", "said", "n")
    table = convs.select("conv_id", "h", "k")
    own = turns.join(small_side(table, table.count()), "conv_id").where("j > h").select("conv_id", (F.col("k") + F.col("j") - F.col("h")).alias("depth"), "said", "n")
    return shared.unionByName(own), convs.select("conv_id", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))


def prefixes(turns: DataFrame) -> DataFrame:
    """Turns with the digest (x, y) of the prefix that each ends and of the one before it (px, py)."""
    hashed = turns.withColumns({"hx": F.xxhash64("depth", "said"), "hy": F.xxhash64("said", "depth", F.lit(1))})
    summed = _running(hashed, "conv_id", "depth", False, x=(F.bit_xor, "hx"), y=(F.bit_xor, "hy"))
    return summed.select("conv_id", "depth", "n", "x", "y", F.col("x").bitwiseXOR(F.col("hx")).alias("px"), F.col("y").bitwiseXOR(F.col("hy")).alias("py"))


def _cells(x: np.ndarray, y: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each prefix in each row of the sketch."""
    x, y = x.view(np.uint64), y.view(np.uint64)
    return [((x * np.uint64(m) + (y ^ (y >> np.uint64(31))) * np.uint64(m | 2)) >> np.uint64(64 - bits)).astype(np.int64) for m in _MULT[:ROWS]]


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def screen(prefixed: DataFrame, rows: int) -> tuple[int, np.ndarray]:
    """Bits of a row's cells and which cells more than one prefix of the table hit."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(1, rows) * SPREAD)))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((ROWS, 1 << bits), np.uint8)
        for batch in batches:
            for row, cells in zip(seen, _cells(_longs(batch, "x"), _longs(batch, "y"), bits)):
                at, hits = np.unique(cells, return_counts=True)
                row[at] = np.minimum(row[at] + np.minimum(hits, 2).astype(np.uint8), 2)
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array([_pack(seen)], pa.binary())], ["seen"])

    def both(a: bytes, b: bytes) -> bytes:
        return _pack(np.minimum(_unpack(a, bits) + _unpack(b, bits), 2))

    parts = prefixed.select("x", "y").mapInArrow(count, "seen binary").rdd.map(lambda r: bytes(r.seen))
    found = parts.treeAggregate(b"", lambda a, b: both(a, b) if a else b, lambda a, b: both(a, b) if a and b else a or b, depth=3)
    many = _unpack(found, bits) > 1 if found else np.zeros((ROWS, 1 << bits), bool)
    return bits, np.packbits(many, axis=1)


def _pack(seen: np.ndarray) -> bytes:
    return pa.compress(seen.tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes, bits: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, decompressed_size=ROWS << bits, codec="zstd", asbytes=True), np.uint8).reshape(ROWS, -1)


def _screened(prefixed: DataFrame, sketch) -> DataFrame:
    """Rows with single (the prefix has one member for certain) and tail (the one before it has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, many = sketch.value

        def alone(x: str, y: str) -> np.ndarray:
            hits = [(row[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 for row, c in zip(many, _cells(_longs(batch, x), _longs(batch, y), bits))]
            return ~np.logical_and.reduce(hits)

        for batch in batches:
            tail = alone("px", "py") & (_longs(batch, "depth") > 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone("x", "y")), pa.array(tail)], [*batch.schema.names, "single", "tail"])

    names = "conv_id depth n x y px py length".split()
    return prefixed.select(*names).mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", single boolean, tail boolean")


def ends_digests(ends: DataFrame, work: Scratch) -> DataFrame:
    """(x, y, ends_sha256) of every node at which conversations (x, y, conv_id) end: their ids in order."""
    pieces = ends.groupBy("x", "y", F.floor(F.col("conv_id") / RANGE).alias("range")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    pieces = work.write(pieces, "ends")
    many = pieces.groupBy("x", "y").agg(F.count("*").alias("ranges"), F.first("ids").alias("ids"))
    one = many.where("ranges = 1").select("x", "y", F.sha2("ids", 256).alias("ends_sha256"))
    rest = many.where("ranges > 1").select("x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["x", "y", "ends_sha256"])
        for batch in slices(batches):
            for x, y, ids in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "ids"))):
                if (x, y) != at:
                    if at:
                        yield done()
                    at, state = (x, y), hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
        if at:
            yield done()

    ordered = pieces.join(small_side(rest, rest.count()), ["x", "y"]).repartition("x", "y").sortWithinPartitions("x", "y", "range").select("x", "y", "ids")
    return one.unionByName(ordered.mapInArrow(run, "x long, y long, ends_sha256 string"))


def trie(conversations: DataFrame, work: Scratch | None = None) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations."""
    spark = conversations.sparkSession
    work = work or Scratch(spark, "prefix_trie")
    turns, convs = rebuilt(work.write(numbered_turns(conversations, work), "turns"))
    convs = work.write(convs, "conversations")
    prefixed = work.write(prefixes(turns), "prefixes")
    sketch = spark.sparkContext.broadcast(screen(prefixed, prefixed.count()))
    lengths = small_side(convs, convs.count())
    rows = work.write(_screened(prefixed.join(lengths, "conv_id"), sketch), "screened")

    closing = lambda here: F.when(here, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(_EMPTY))
    alone = lambda parent: [  # noqa: E731  a node of one member
        "conv_id", "depth", parent.alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), (F.col("depth") < F.col("length")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), closing(F.col("depth") == F.col("length")).alias("ends_sha256"),
    ]
    tails = rows.where("tail").select(*alone(F.col("conv_id")))

    # prefixes that may be shared, grouped exactly
    open_ = rows.where("not tail and not single").select("conv_id", "depth", "n", "x", "y", "length")
    here = F.col("depth") == F.col("length")
    nodes = open_.groupBy("x", "y").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("rep"), F.sum(here.cast("long")).alias("n_ends"))
    nodes = work.write(nodes, "nodes")
    seen = work.write(open_.join(small_side(nodes, nodes.count()), ["x", "y"]), "members")

    # of each conversation: its first own depth, the owner of the node above, its savings, and whether it ends in a leaf
    foreign = F.col("rep") != F.col("conv_id")
    saved = (F.col("n_convs") - 1) * F.col("n")
    own = seen.groupBy("conv_id").agg(
        F.coalesce(F.max(F.when(foreign, F.col("depth"))), F.lit(0)).alias("above"),
        F.max_by(F.when(foreign, F.col("rep")), F.when(foreign, F.col("depth"))).alias("owner"),
        F.coalesce(F.sum(F.when(~foreign, saved)), F.lit(0)).alias("saves"),
        F.max(F.when(here, F.when(~foreign & (F.col("n_ends") == F.col("n_convs")), 1).otherwise(0))).alias("closes"),
    )
    # a last node that was not grouped has one member, which ends there
    own = convs.join(own, "conv_id", "left").select(
        "conv_id", "length", "owner", F.coalesce("above", F.lit(0)).alias("above"), F.coalesce("saves", F.lit(0)).alias("saves"),
        F.when(F.col("length") > 0, F.coalesce("closes", F.lit(1))).otherwise(F.lit(0)).cast("long").alias("leaf"),
    )
    own = work.write(own, "own")
    top = own.agg(F.min("conv_id").alias("root"), F.count("*").alias("n"), F.sum("leaf").alias("leaves"), F.sum("saves").alias("saves"), F.sum(((F.col("above") == 0) & (F.col("length") > 0)).cast("long")).alias("children")).first()
    if not top["n"]:
        return spark.createDataFrame([], NODE)
    parent = F.when(F.col("depth") > F.col("above") + 1, F.col("conv_id")).when(F.col("depth") == 1, F.lit(top["root"])).otherwise(F.col("owner"))

    owned = own.select("conv_id", "owner", "above", "saves", "leaf")
    owned = small_side(owned, own.count())
    heads = rows.where("single and not tail").select("conv_id", "depth", "length").join(owned, "conv_id").select(*alone(parent))

    # sums over members: what the other members own below, and whose own nodes begin just below
    members = seen.join(owned, "conv_id")
    other = F.when(foreign, F.col("saves")).otherwise(F.lit(0))
    sums = members.groupBy("x", "y").agg(F.sum("leaf").alias("n_leaves"), F.sum(other).alias("below"), F.sum((foreign & (F.col("above") == F.col("depth")) & (F.col("depth") < F.col("length"))).cast("long")).alias("branches"))
    chain = members.where(~foreign).withColumn("own_saved", saved)
    chain = _running(chain, "conv_id", "depth", True, along=(F.sum, "own_saved"))
    closed = ends_digests(open_.where(here).select("x", "y", "conv_id"), work)
    shared = chain.join(sums.drop("n_convs"), ["x", "y"]).join(closed, ["x", "y"], "left").select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", (F.col("branches") + (F.col("depth") < F.col("length")).cast("long")).alias("n_children"),
        sums["n_leaves"], (F.col("along") + F.col("below")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )

    bare = ends_digests(convs.where("length = 0").select(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "conv_id"), work).first()
    root = spark.createDataFrame([(top["root"], 0, None, top["n"], top["children"], max(1, top["leaves"]), top["saves"], bare["ends_sha256"] if bare else _EMPTY)], NODE)
    return tails.unionByName(heads).unionByName(shared).unionByName(root)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return trie(read_table(spark, sf_dir, "conversations"))


ORACLE_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS j
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, max(j) AS own, conv_id - conv_id % 100 AS base, list_reduce([4294967295::BIGINT] || list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT)),
             lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)) AS r FROM t GROUP BY conv_id),
h AS (SELECT c.conv_id, c.base, xor(c.r, 4294967295::BIGINT) % 6 AS h, least(xor(c.r, 4294967295::BIGINT) % 6, coalesce(b.own, 0)) AS k FROM c LEFT JOIN c b ON b.conv_id = c.base),
p AS (SELECT h.conv_id, t.j AS depth, t.role, t.text FROM h JOIN t ON t.conv_id = h.base AND t.j <= h.k
      UNION ALL SELECT h.conv_id, h.k + t.j - h.h, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id AND t.j > h.h),
d AS (SELECT conv_id, depth, length(text) AS n, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM p
      UNION ALL SELECT conv_id, 0, 0, '' FROM h),
g AS (SELECT key, any_value(depth) AS depth, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs FROM d GROUP BY key),
o AS (SELECT conv_id, max(depth) AS length FROM d GROUP BY conv_id),
e AS (SELECT d.key, count(*) AS n_ends, sha256(string_agg(d.conv_id::VARCHAR, ',' ORDER BY d.conv_id)) AS ends FROM d JOIN o ON o.conv_id = d.conv_id AND o.length = d.depth GROUP BY d.key),
u AS (SELECT a.key AS up, g.* FROM g JOIN d a ON a.conv_id = g.conv_id AND a.depth <= g.depth),
s AS (SELECT up, count(*) FILTER (e.n_ends = u.n_convs) AS n_leaves, sum((n_convs - 1) * n) AS saved FROM u LEFT JOIN e ON e.key = u.key GROUP BY up),
q AS (SELECT g.key, a.key AS parent FROM g JOIN d a ON a.conv_id = g.conv_id AND a.depth = g.depth - 1)
SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, g.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM g JOIN s ON s.up = g.key LEFT JOIN q ON q.key = g.key LEFT JOIN g up ON up.key = q.parent LEFT JOIN e ON e.key = g.key
LEFT JOIN (SELECT parent, count(*) AS n FROM q GROUP BY 1) k ON k.parent = g.key
"""
