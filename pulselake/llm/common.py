"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.session import Scratch

#: Maps every byte outside 0-9, a-z, A-Z and the non-ASCII bytes to a blank and lower-cases A-Z.
WORD_BYTES = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased; null has none."""
    return text.translate(WORD_BYTES).split() if text else []


#: Rows that a function of map_batches sees at once; Arrow's own batches would hold 10,000 texts.
SLICE_ROWS = 512


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of SLICE_ROWS rows; after the last, freed memory goes back."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: a worker process lives on, idle, while later stages need the room."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """df.mapInArrow with a function of one record batch; None or no rows emits nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as bytes."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod modulus = remainder; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def connected_components(edges: DataFrame, work: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the edges (u, v): component is the smallest node it reaches.

    Alternating large and small stars. Each is a grouped minimum and a join, so no neighbour list
    is gathered; the star table of every round is written to the shared folder. Done when no centre
    of a star is a ray of another.
    """
    pair = lambda df: df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = work.write(pair(edges).distinct(), "edges")
    for _ in range(max_rounds):
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = work.write(small.union(low).distinct(), "stars")
        work.drop(stars)
        stars = after
        # a node has one centre, and no centre is a ray
        ends = stars.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("ray")), F.struct(F.col("v").alias("node"), F.lit(0).alias("ray")))).alias("e")).select("e.*")
        if ends.groupBy("node").agg(F.sum("ray").alias("rays"), F.min("ray").alias("least")).where("rays > 1 or (rays > 0 and least = 0)").isEmpty():
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")
