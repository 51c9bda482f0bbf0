"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(c: Column | str, digits: int) -> Column:
    """Rounds half up in double arithmetic; sums that differ in the last bit round alike."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 10**digits + 0.5 + 1e-7) / float(10**digits)


def mean(c: Column, digits: int) -> Column:
    """Mean of values of so many decimals, the same in any order: their sum, taken in whole units, is the nearest double.

    A group with other values (more decimals, large ones, no numbers) has the average of doubles.
    """
    unit = 10**digits
    small = F.when((F.abs(c) < 1e6) & (F.abs(c * unit - F.rint(c * unit)) < 0.01), F.rint(c * unit).cast("long"))
    return F.when(F.count(small) == F.count(c), F.sum(small) / unit / F.count(c)).otherwise(F.avg(c))


def clip(c: Column, low: float, high: float) -> Column:
    """c held between low and high; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def lookup(key: Column, values: Mapping, default=None) -> Column:
    """The value of key in a small literal map."""
    found = F.element_at(F.create_map(*map(F.lit, chain.from_iterable(values.items()))), key)
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def bucket(ts: Column, seconds: int) -> Column:
    """Start of the tumbling window of a timestamp, counted from the epoch."""
    return F.timestamp_seconds(F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000)) * seconds)


def stable_id(*parts: Column, length: int = 16) -> Column:
    """The first hexadecimal digits of the SHA-256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, length)


def parse_timestamp(text: Column) -> Column:
    """ISO, trailing Z, blank-separated or date only; naive is UTC; what does not parse is null."""
    return F.coalesce(F.try_to_timestamp(text), *(F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd")))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def all_of(checks: Mapping[str, Column]) -> Column:
    """map of named checks."""
    return F.create_map(*chain.from_iterable((F.lit(k), v) for k, v in checks.items()))
