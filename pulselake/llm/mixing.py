"""Mixing sources to target weights by pivotal dependent rounding, on DataFrames only.

Every document of a source gets the same expected number of copies, target / source size, so a
whole part and a fraction. The fractions are rounded in pairs: mass, measured in words, moves at
random from one document to the other until one of the two is 0 or 1, which keeps each document's
expectation and the source's sum of words. A block of about BLOCK documents folds to one residual
document, residuals meet in the next level's blocks, and so on: a reduction tree of
log(n)/log(BLOCK) levels, each a shuffle of light rows (no texts), with hot sources spread over
their blocks. Documents above their source's mean length fold first; their last residual exchanges
mass with the pool of all shorter ones, which then fold. The last residual of a source is rounded
by its probability, so a source misses its target by one document at most, a short one as a rule. Draws are hashes of ids and seed, so reruns agree.

Cases: null or word-less text has size 0 and takes nothing; null is a source of its own, last in
order; repeated rows (and null ids) are mixed each for itself, rows alike in source, id and text
beyond BLOCK of them spread over blocks by their place in the table; a corpus without words has targets
0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulselake.session import Scratch, read_table, small_side

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 64
SEED = 20240229


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blank, tab and line breaks (\\x09-\\x0D); null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, n, source_size, target): shares by weight, stopped at cap times the size, excess reshared.

    Sources in rising order of cap / weight fill up first; the first that does not fill sets the
    level of all after it. The window runs over one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    ordered = by_source.withColumn("k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    given = ordered.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int"))).withColumn("full", F.col("source_size") * cap)
    before = W.orderBy(F.col("full") / F.col("w"), "k").rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = given.withColumn("left", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("full").over(before), F.lit(0))).withColumn(
        "left_w", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0))
    )
    fits = F.col("full") * F.col("left_w") >= F.col("left") * F.col("w")
    first = level.withColumn("level", F.min(F.when(fits, F.struct(F.col("full") / F.col("w"), "k", F.col("left").cast("double").alias("a"), F.col("left_w").cast("double").alias("b")))).over(all_rows))
    share = F.when(fits & (F.col("left_w") > 0), F.col("level.a") / F.col("level.b") * F.col("w"))
    return first.select("source", "n", "source_size", F.coalesce(F.least(share, F.col("full").cast("double")), F.col("full").cast("double")).alias("target"))


def _draw(*of) -> Column:
    return F.pmod(F.xxhash64(*of, F.lit(SEED)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _meet(acc: Column, x: Column) -> Column:
    """One step of the fold: the carried open document meets the next one; the one that is settled leaves."""
    c = acc["carry"]
    up = F.least((1 - c["p"]) * c["size"], x["p"] * x["size"])  # words that may move to the carried one
    down = F.least(c["p"] * c["size"], (1 - x["p"]) * x["size"])  # words that may move from it
    to_c = _draw(c["h"], x["h"], c["doc_id"], x["doc_id"]) * (up + down) < down
    c_full, x_full = (1 - c["p"]) * c["size"] <= x["p"] * x["size"], c["p"] * c["size"] >= (1 - x["p"]) * x["size"]
    cp = F.when(to_c, F.when(c_full, F.lit(1.0)).otherwise(c["p"] + up / c["size"])).otherwise(F.when(x_full, c["p"] - down / c["size"]).otherwise(F.lit(0.0)))
    xp = F.when(to_c, F.when(c_full, x["p"] - up / x["size"]).otherwise(F.lit(0.0))).otherwise(F.when(x_full, F.lit(1.0)).otherwise(x["p"] + down / x["size"]))
    item = lambda d, p: F.struct(d["size"].alias("size"), d["h"].alias("h"), d["doc_id"].alias("doc_id"), d["place"].alias("place"), p.alias("p"))
    c_done = F.when(to_c, c_full).otherwise(~x_full)
    met = F.struct(
        F.when(c_done, item(x, xp)).otherwise(item(c, cp)).alias("carry"),
        F.concat(acc["done"], F.array(F.when(c_done, item(c, cp)).otherwise(item(x, xp)))).alias("done"),
    )
    return F.when(c.isNull(), F.struct(x.alias("carry"), acc["done"].alias("done"))).otherwise(met)


_ITEM = "struct<size:bigint,h:bigint,doc_id:bigint,place:bigint,p:double>"
_KEYS = ["source", "n", "source_size", "target", "whole"]


def _tree(open_: DataFrame, most: int, work: Scratch, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Folds open items (keys, size, h, doc_id, place, p) to one open item a source at most: (settled rows, what is left)."""
    blocks = F.ceil(F.col("n") / BLOCK)
    items = open_.select(*_KEYS, F.struct("size", "h", "doc_id", "place", "p").alias("item"), F.pmod(F.xxhash64("h", F.lit(SEED + 1)), blocks).alias("block"), blocks.alias("blocks"))
    empty = F.struct(F.expr(f"cast(null as {_ITEM})").alias("carry"), F.expr(f"cast(array() as array<{_ITEM}>)").alias("done"))
    settled, levels = [], math.ceil(math.log(max(most, 2), BLOCK)) + 1
    for level in range(levels):
        folded = items.groupBy(*_KEYS, "block", "blocks").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items")).withColumn("end", F.aggregate("items", empty, _meet))
        flagged = F.concat(F.transform("end.done", lambda d: F.struct(d.alias("item"), F.lit(False).alias("open"))), F.array(F.struct(F.col("end.carry").alias("item"), F.lit(True).alias("open"))))
        made = work.write(folded.select(*_KEYS, "block", "blocks", F.explode(flagged).alias("r")).select(*_KEYS, "block", "blocks", "r.*"), f"{name}{level}")
        still = F.col("open") & (F.col("item.p") > 0) & (F.col("item.p") < 1)
        settled.append(made.where(~still).select(*_KEYS, "item.*"))
        items = made.where(still).select(*_KEYS, "item", F.floor(F.col("block") / BLOCK).alias("block"), F.ceil(F.col("blocks") / BLOCK).alias("blocks"))
    return settled, items.select(*_KEYS, "item.*")


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, work: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    placed = docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("place"))
    return _mixed(placed, weights, cap, work or Scratch(docs.sparkSession, "mixing")).drop("place")


def mix_documents(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, work: Scratch | None = None) -> DataFrame:
    """The rows of docs with size, source_size, target, copies and taken (in place of columns of these names)."""
    work = work or Scratch(docs.sparkSession, "mixing")
    placed = work.write(docs.withColumn("mix_place", F.monotonically_increasing_id()), "placed")
    found = _mixed(placed.select("doc_id", "source", "text", F.col("mix_place").alias("place")), weights, cap, work)
    added = [c for c in found.columns if c not in ("doc_id", "source", "place")]
    return placed.drop(*added).join(found.select(F.col("place").alias("mix_place"), *added), "mix_place").drop("mix_place")


def _mixed(docs: DataFrame, weights, cap: int, work: Scratch) -> DataFrame:
    """Rows (doc_id, source, text, place) with their sizes, targets, copies and words taken; place is unique."""
    h = F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(SEED)).alias("h")
    sizes = work.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), h, "place"), "sizes")
    targets = work.write(source_targets(sizes, weights, cap), "targets")
    most = targets.agg(F.max("n")).first()[0] or 0
    per = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = sizes.withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    alike = sizes.groupBy("source", "h").count().where(F.col("count") > BLOCK).select(F.col("h").alias("hot")).distinct()
    alike = small_side(alike, alike.count())
    spread = F.when(F.col("hot").isNotNull(), F.xxhash64("h", "place")).otherwise(F.col("h"))
    rows = joined.join(alike, F.col("h") == F.col("hot"), "left").withColumns({"whole": F.floor(per), "p": per - F.floor(per), "h": spread}).drop("hot")
    fixed = (F.col("size") == 0) | (F.col("p") <= 0)
    reserve = F.col("size") * F.col("n") <= F.col("source_size")
    settled = [rows.where(fixed).select(*_KEYS, "size", "h", "doc_id", "place", F.lit(0.0).alias("p"))]

    # the longer documents first; what is left of them meets the pool of the shorter ones as one partner
    done, long_left = _tree(rows.where(~fixed & ~reserve), most, work, "long")
    settled += done
    pool = rows.where(~fixed & reserve).groupBy("source").agg(F.sum("size").alias("pool_size"), F.first("p").alias("f"))
    up = F.least((1 - F.col("p")) * F.col("size"), F.col("f") * F.col("pool_size"))
    down = F.least(F.col("p") * F.col("size"), (1 - F.col("f")) * F.col("pool_size"))
    to_long = _draw("h", "doc_id") * (up + down) < down
    met = long_left.join(pool.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumns({"up": up, "down": down, "to_long": to_long})
    moved = F.when(F.col("to_long"), F.col("up")).otherwise(-F.col("down"))
    filled = F.when(F.col("to_long") & (F.col("up") >= (1 - F.col("p")) * F.col("size")), 1.0).when(~F.col("to_long") & (F.col("down") >= F.col("p") * F.col("size")), 0.0).otherwise(F.col("p") + moved / F.col("size"))
    met = work.write(met.withColumn("pool_p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("f") - moved / F.col("pool_size")))).withColumn("p", filled), "met")
    alone = long_left.join(met.select(F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s")), "left_anti")
    short = rows.where(~fixed & reserve).join(met.select(F.col("source").alias("s"), "pool_p"), F.col("source").eqNullSafe(F.col("s")), "left").withColumn("p", F.coalesce("pool_p", "p"))
    both = met.select(*_KEYS, "size", "h", "doc_id", "place", "p").unionByName(alone).unionByName(short.select(*_KEYS, "size", "h", "doc_id", "place", "p"))
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    settled.append(both.where(~open_))
    done, left = _tree(both.where(open_), most, work, "short")
    settled += done
    settled.append(left.withColumn("p", F.when(_draw("h", "doc_id", F.lit(1)) < F.col("p"), 1.0).otherwise(0.0)))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.col("p").cast("long")).cast("long")
    return out.select("doc_id", "place", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op5_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by 5, 2, 1."""
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
