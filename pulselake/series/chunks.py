"""Recursive filters over series of any length: pieces of CHUNK rows by themselves, then what one piece hands to the next.

Rows are numbered by one distributed sort, so a series that holds a third of all rows is as many
groups as it has pieces.

* Hampel: a piece runs from the raw values before it. Where the piece before ends in corrected
  values, it runs again from these, and so on until no start changes; corrections rarely reach
  across a border, so mostly one round is enough.
* Kalman: a step is an affine map of the state whose gain depends on the place alone. A piece's maps
  are composed, the compositions of a series (one row a piece) give each piece its start, and the
  pieces run from there.

Sorted pieces pass in Arrow batches and those of a batch are filtered together, so many short series
cost no group each.

Results are those of `hampel_values` and `kalman_values` on the whole series (to rounding). A null x
counts as NaN there and here: no correction sees it, and a Kalman state stays NaN after it. Ties of
idx are in the order of the other columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulselake.clinical.baselines import numbered
from pulselake.session import Scratch, small_side

#: Rows of a piece.
CHUNK = 4096


def placed(rows: DataFrame, work: Scratch) -> DataFrame:
    """rows (series, idx, ...) with k (place in the series from 0) and chunk, as a written table."""
    rest = [c for c in rows.columns if c not in ("series", "idx")]
    keyed = rows.select(F.struct("series", "idx", *rest, F.monotonically_increasing_id().alias("_m")).alias("key"))
    at = work.write(numbered(keyed, "key", work).select("key.series", "key.idx", *(f"key.{c}" for c in rest), "i"), "numbered")
    first = at.groupBy("series").agg(F.min("i").alias("first")).withColumnRenamed("series", "of")
    k = F.col("i") - F.col("first")
    joined = at.join(small_side(first, first.count()), F.col("series").eqNullSafe(F.col("of")))
    return work.write(joined.select("series", "idx", *rest, k.alias("k"), F.floor(k / CHUNK).alias("chunk")), "placed")


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Of rows sorted by keys: frames of whole groups, each with the groups' first rows and sizes.

    The group that a batch ends in goes on in the next frame, so a frame is a batch and at most one group more.
    """
    rest = None
    for pdf in chain(batches, [None]):
        last = pdf is None
        pdf = rest if last else pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if pdf is None or not len(pdf):
            continue
        new = np.zeros(len(pdf), bool)
        for key in keys:
            new |= np.diff(pd.factorize(pdf[key], use_na_sentinel=False)[0], prepend=-1) != 0
        first = np.flatnonzero(new)
        cut = len(pdf) if last else int(first[-1])
        rest = None if last else pdf.iloc[cut:].reset_index(drop=True)
        if cut:
            first = first if last else first[:-1]
            yield pdf.iloc[:cut].reset_index(drop=True), first, np.diff(first, append=cut)


def hampel_groups(x: np.ndarray, first: np.ndarray, size: np.ndarray, half: int = 3, limit: float = 3.0, fixed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """`hampel_values` of groups that lie one after the other; fixed rows are seen and not corrected.

    All rows are judged at once on the values so far, then those again that follow a change, until none
    changes: a row's last judgement sees the final values before it, as in a pass from left to right.
    """
    place = np.arange(len(x)) - np.repeat(first, size)
    back, ahead = np.minimum(place, half), np.minimum(np.repeat(size, size) - 1 - place, half)
    free = np.ones(len(x), bool) if fixed is None else ~fixed
    around = np.arange(-half, half + 1)
    y, odd, todo = x.copy(), np.zeros(len(x), bool), np.flatnonzero(free)

    def median(values: np.ndarray, inside: np.ndarray, n: np.ndarray) -> np.ndarray:
        s, r = np.sort(np.where(inside, values, np.inf), axis=1), np.arange(len(values))
        low, high = s[r, (n - 1) // 2], s[r, n // 2]
        return np.where((np.isnan(values) & inside).any(axis=1), np.nan, np.where(low == high, low, (low + high) / 2))

    while len(todo):
        inside = (around >= -back[todo, None]) & (around <= ahead[todo, None])
        at = np.where(inside, todo[:, None] + around, todo[:, None])
        near, n = np.where(around < 0, y[at], x[at]), back[todo] + ahead[todo] + 1
        with np.errstate(invalid="ignore"):
            mid = median(near, inside, n)
            mad = median(np.abs(near - mid[:, None]), inside, n)
            out = (mad >= 1e-6) & (np.abs(x[todo] - mid) > limit * 1.4826 * mad)
        now = np.where(out, mid, x[todo])
        changed = todo[(now != y[todo]) & ~(np.isnan(now) & np.isnan(y[todo]))]
        y[todo], odd[todo] = now, out
        after = changed[:, None] + np.arange(1, half + 1)
        todo = np.unique(after[np.arange(1, half + 1) <= ahead[changed, None]])
        todo = todo[free[todo]]
    return y, odd


def hampel(rows: DataFrame, half: int = 3, limit: float = 3.0, work: Scratch | None = None, table: DataFrame | None = None) -> DataFrame:
    """(series, k, chunk, filtered, is_artifact) of every row of (series, idx, x)."""
    work = work or Scratch(rows.sparkSession, "hampel")
    table = placed(rows, work) if table is None else table
    inside = F.col("k") - F.col("chunk") * CHUNK
    sides = F.array_compact(F.array(F.lit(0), F.when(inside >= CHUNK - half, F.lit(1)), F.when((inside < half) & (F.col("chunk") > 0), F.lit(-1))))
    dealt = table.select("series", "k", "chunk", "x", F.explode(sides).alias("side")).select("series", (F.col("chunk") + F.col("side")).alias("chunk"), "k", "x", F.col("side").alias("side"))
    none = F.lit(None).cast("array<double>")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, first, size in whole_groups(batches, ["series", "chunk"]):
            x, side = pdf["x"].to_numpy(float, copy=True), pdf["side"].to_numpy()
            for at, n in zip(first, size):  # the rows before a piece of a long series
                start = pdf["start"].iloc[at] if side[at] == 1 else None
                if start is not None:
                    x[at : at + n][side[at : at + n] == 1] = start
            y, odd = hampel_groups(x, first, size, half, limit, side != 0)
            own = side == 0  # not those handed to a piece that the series does not have
            yield pd.DataFrame({"series": pdf["series"][own], "k": pdf["k"][own], "chunk": pdf["chunk"][own], "filtered": y[own], "is_artifact": odd[own]})

    def pieces(df: DataFrame) -> DataFrame:
        return df.repartition("series", "chunk").sortWithinPartitions(F.asc_nulls_last("series"), "chunk", "k").mapInPandas(run, schema)

    schema = f"series {table.schema['series'].dataType.simpleString()}, k long, chunk long, filtered double, is_artifact boolean"
    out = work.write(pieces(dealt.withColumn("start", none)), "hampel")
    # the starts that pieces ran from: first the raw values
    tail = lambda df, c: df.where(inside >= CHUNK - half).groupBy("series", (F.col("chunk") + 1).alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce(c, F.lit(float("nan"))).alias("v")))), lambda s: s["v"]).alias("start"))
    used = work.write(tail(table, F.col("x").cast("double")), "used")
    while True:
        now = tail(out, F.col("filtered")).withColumnRenamed("start", "now")
        same = ["series", "chunk"]
        fresh = work.write(used.join(now, same).where("start <> now").select(*same, F.col("now").alias("start")), "starts")
        n = fresh.count()
        if not n:
            return out
        again = pieces(dealt.join(small_side(fresh, n), same))
        kept = out.join(small_side(fresh.select(*same), n), same, "left_anti")
        out = work.write(kept.unionByName(again), "hampel")
        used = work.write(used.join(small_side(fresh.select(*same), n), same, "left_anti").unionByName(fresh), "used")


@lru_cache(maxsize=8)
def _gains(q: float, r: float) -> np.ndarray:
    """Gains by place; all later ones are the last."""
    f, h, p, out = np.array([[1.0, 1.0], [0.0, 0.95]]), np.array([1.0, 0.0]), 10.0 * np.eye(2), []
    while len(out) < 2 or np.abs(out[-1] - out[-2]).max() > 1e-16:
        p = f @ p @ f.T + q * np.eye(2)
        gain = p @ h / (h @ p @ h + r)
        p = p - np.outer(gain, h @ p)
        out.append(gain)
        if len(out) >= 100_000:
            break
    return np.array(out)


def kalman_groups(x: np.ndarray, first: np.ndarray, size: np.ndarray, place: np.ndarray, q: float, r: float, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of groups that lie one after the other and their last states; a group starts at a place of its series, value a and rate b.

    The groups take their steps together.
    """
    gains = _gains(q, r)
    out, left = np.empty(len(x)), np.arange(len(first))
    a, b = a.astype(float), b.astype(float)
    for k in range(size.max(initial=0)):
        left = left[size[left] > k]
        g = gains[np.minimum(place[left] + k, len(gains) - 1)]
        value, rate = a[left] + b[left], 0.95 * b[left]
        off = x[first[left] + k] - value
        a[left], b[left] = value + g[:, 0] * off, rate + g[:, 1] * off
        out[first[left] + k] = a[left]
    return out, a, b


def kalman(rows: DataFrame, q: float = 0.05, r: float = 2.0, work: Scratch | None = None) -> DataFrame:
    """rows (series, k, chunk, x, ...) with smooth: the value-and-rate filter, started at a series' first value."""
    work = work or Scratch(rows.sparkSession, "kalman")
    kind = rows.schema["series"].dataType.simpleString()
    sorted_ = lambda df, *keys: df.repartition(*keys).sortWithinPartitions(F.asc_nulls_last("series"), "chunk", *(["k"] if "k" in df.columns else []))

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, first, size in whole_groups(batches, ["series", "chunk"]):
            x, place, none, one = pdf["x"].to_numpy(float), pdf["k"].to_numpy()[first], np.zeros(len(first)), np.ones(len(first))
            ends = [np.stack(kalman_groups(x, first, size, place, q, r, *s)[1:], axis=1) for s in ((none, none), (one, none), (none, one))]
            m0, m1 = ends[1] - ends[0], ends[2] - ends[0]
            m = np.stack([m0[:, 0], m1[:, 0], m0[:, 1], m1[:, 1]], axis=1)
            yield pd.DataFrame({"series": pdf["series"].iloc[first].array, "chunk": pdf["chunk"].to_numpy()[first], "x0": x[first], "m": list(m), "b": list(ends[0])})

    maps = work.write(sorted_(rows.select("series", "chunk", "k", "x"), "series", "chunk").mapInPandas(compose, f"series {kind}, chunk long, x0 double, m array<double>, b array<double>"), "maps")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = None
        for pdf in batches:
            out = []
            for chunk, x0, m, b in zip(pdf["chunk"], pdf["x0"], pdf["m"], pdf["b"]):
                s = (x0, 0.0) if chunk == 0 else s
                out.append(list(s))
                s = m[0] * s[0] + m[1] * s[1] + b[0], m[2] * s[0] + m[3] * s[1] + b[1]
            yield pdf[["series", "chunk"]].assign(start=out)

    starts = work.write(sorted_(maps, "series").mapInPandas(scan, f"series {kind}, chunk long, start array<double>"), "starts")
    ready = rows.join(small_side(starts.withColumnsRenamed({"series": "_of", "chunk": "_piece"}), starts.count()), F.col("series").eqNullSafe(F.col("_of")) & (F.col("chunk") == F.col("_piece"))).drop("_of", "_piece")
    ready = ready.select(*rows.columns, F.col("start")[0].alias("_value"), F.col("start")[1].alias("_rate"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + ["smooth double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, first, size in whole_groups(batches, ["series", "chunk"]):
            at = pdf.iloc[first]
            y = kalman_groups(pdf["x"].to_numpy(float), first, size, at["k"].to_numpy(), q, r, at["_value"].to_numpy(float), at["_rate"].to_numpy(float))[0]
            yield pdf.drop(columns=["_value", "_rate"]).assign(smooth=y)

    return sorted_(ready, "series", "chunk").mapInPandas(run, schema)


def hampel_rows(rows: DataFrame, half: int = 3, limit: float = 3.0, work: Scratch | None = None) -> DataFrame:
    """rows (series, idx, x, ...) with filtered and is_artifact."""
    work = work or Scratch(rows.sparkSession, "hampel")
    table = placed(rows, work)
    done = hampel(rows, half, limit, work, table).withColumnRenamed("series", "_of").withColumnRenamed("k", "_k").drop("chunk")
    return table.join(done, F.col("series").eqNullSafe(F.col("_of")) & (F.col("k") == F.col("_k"))).select(*rows.columns, "filtered", "is_artifact")


def denoise_rows(rows: DataFrame, q: float = 0.05, r: float = 2.0, work: Scratch | None = None) -> DataFrame:
    """rows (series, idx, x, ...) through Hampel, then Kalman: filtered, residual, is_artifact."""
    work = work or Scratch(rows.sparkSession, "denoise")
    table = placed(rows, work)
    smooth = kalman(hampel(rows, work=work, table=table).withColumnRenamed("filtered", "x"), q, r, work).select(F.col("series").alias("_of"), F.col("k").alias("_k"), "smooth", "is_artifact")
    joined = table.join(smooth, F.col("series").eqNullSafe(F.col("_of")) & (F.col("k") == F.col("_k")))
    return joined.select(*rows.columns, F.col("smooth").alias("filtered"), (F.col("x") - F.col("smooth")).alias("residual"), "is_artifact")
