"""Exact top-k search by vector-approximation files.

Components become integers. Each falls into one of 256 cells of about equal frequency, cut from a bounded sample, so
a vector's approximation takes a byte a component; approximations are stored as a table of their own. Queries
scan only these: a cell's ends bound a component, and so every inner product, from both sides. The k-th best
lower bound of a query, over all rows, leaves few rows whose upper bound reaches it. Their exact vectors are read in
the order of that bound, in growing portions for all queries at once, until no bound of a vector that is left
reaches a query's k-th exact score: then its result is certain.

Rows with the same integers are one point; of these, the k + 1 smallest ids can be results. Queries and points meet
in a grid of bounded blocks.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part; vectors of different
lengths don't meet; null ids take no part; rows that repeat an id are one vector (the greatest one); ties go to the
smaller id; inner products beyond the range of long become its ends; other columns don't matter; fewer rows than k
give all; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_SHARE, joined, written

CELLS = 256
#: Vectors from which cells are cut.
SAMPLE = 20_000
#: Points and queries that meet at once, and how many points are bounded together.
ROWS, QUERIES, STRIDE = 65_536, 1_024, 8_192
#: Exact vectors that a query reads first, a result, and how much more it reads up to in the next portion.
FIRST, GROWTH = 4, 8
#: Inner products up to here are exact in doubles.
EXACT = float(1 << 53)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def whole_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``(vec_id, n, x)`` with ``n`` components ``floor(scale * x)``, as doubles without a fraction: one valid vector for each id."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0")
    fine = fine.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    fine = fine.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    # F.floor gives a long; beyond 2**53 doubles have no fraction, and the greatest are kept from becoming infinite
    big = lambda v: F.abs(v * scale) >= EXACT
    end = float(np.finfo(np.float64).max)
    floor = lambda v: F.when(big(v), F.least(F.greatest(v * scale, F.lit(-end)), F.lit(end))).otherwise(F.floor(F.when(big(v), 0.0).otherwise(v * scale)).cast("double"))
    # minus zero is zero, so that equal vectors are equal
    fine = fine.groupBy("vec_id").agg(F.max("x").alias("x")).select("vec_id", F.size("x").alias("n"), F.transform("x", lambda v: floor(v) + 0.0).alias("x"))
    return written(fine, "whole", vectors.count())


def points(rows: DataFrame, k: int) -> DataFrame:
    """Rows of which at most ``k + 1``, those with the smallest ids, hold the same vector: others are in no result."""
    for by in (["x", F.pmod(F.xxhash64("vec_id"), F.lit(64))], ["x"]):  # a hot vector is cut in parts first
        place = F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))
        rows = rows.withColumn("_place", place).where(F.col("_place") <= k + 1).drop("_place")
    return rows


class Cells:
    """Ends of the cells of each component: ``cuts`` parts them, ``low`` and ``high`` bound what is in them."""

    def __init__(self, cuts: np.ndarray, least: np.ndarray, most: np.ndarray):
        self.cuts = cuts
        self.low = np.concatenate([least[None], cuts]).T.copy()
        # components are whole numbers: one below the next cut, where doubles can tell
        below = np.where(np.abs(cuts) < EXACT, cuts - 1, cuts)
        self.high = np.maximum(np.concatenate([below, most[None]]).T, self.low)

    @classmethod
    def fitted(cls, sample: np.ndarray, least: np.ndarray, most: np.ndarray) -> Cells:
        return cls(np.quantile(sample, np.arange(1, CELLS) / CELLS, axis=0, method="higher"), least, most)

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts.T, x.T, strict=True)], axis=1).astype(np.uint8)

    def bounds(self, queries: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the inner products of all queries and points, from cells alone: about the middle of each cell."""
        at = np.arange(cells.shape[1])
        low, high = self.low[at, cells], self.high[at, cells]
        middle, half = low / 2 + high / 2, high / 2 - low / 2
        size = np.abs(queries)
        with np.errstate(over="ignore", invalid="ignore"):
            centre, reach = queries @ middle.T, size @ half.T
            # doubles round sums of large products
            large = np.abs(size).max(initial=0.0) * np.maximum(np.abs(low), np.abs(high)).max(initial=0.0) * 2 * cells.shape[1]
            if large >= EXACT:
                reach = reach + (size @ np.maximum(np.abs(low), np.abs(high)).T) * 2.0**-40
            lower, upper = centre - reach, centre + reach
        return np.where(np.isnan(lower), -np.inf, lower), np.where(np.isnan(upper), np.inf, upper)


def candidates(ids: np.ndarray, cells: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, ends: Cells, k: int) -> pd.DataFrame:
    """``query_id, vec_id, lower, upper`` of points of a block that bounds don't keep from a query's ``k`` best within it."""
    parts = []
    order = np.argsort(ids, kind="stable")
    ids, cells = ids[order], cells[order]
    floor = np.full(len(queries), -np.inf)
    held = np.full((len(queries), k), -np.inf)
    for at in range(0, len(ids), STRIDE):
        here = ids[at : at + STRIDE]
        lower, upper = ends.bounds(queries, cells[at : at + STRIDE])
        own = query_ids[:, None] == here
        lower[own], upper[own] = -np.inf, -np.inf
        best = lower if lower.shape[1] <= k else -np.partition(-lower, k - 1, axis=1)[:, :k]
        held = -np.partition(-np.concatenate([held, best], axis=1), k - 1, axis=1)[:, :k]
        before, floor = floor, held.min(axis=1)
        # ids rise: a point that only reaches the bound of k points before it comes after them
        after = (upper > before[:, None]) | np.isneginf(before)[:, None]
        q, r = np.nonzero(~own & (upper >= floor[:, None]) & after)
        parts.append(pd.DataFrame({"query_id": query_ids[q], "vec_id": here[r], "lower": lower[q, r], "upper": upper[q, r], "q": q}))
    found = pd.concat(parts, ignore_index=True)
    return found[found["upper"].to_numpy() >= floor[found["q"]]].drop(columns="q")


def _scores(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Exact inner products of paired rows, held within the range of long."""
    safe = (np.abs(x).max(axis=1, initial=0.0) * np.abs(q).max(axis=1, initial=0.0) * x.shape[1] < EXACT).tolist()
    fast = np.einsum("ij,ij->i", np.where(np.array(safe)[:, None], x, 0.0), np.where(np.array(safe)[:, None], q, 0.0))
    exact = lambda a, b: max(_LEAST, min(_MOST, sum(int(u) * int(v) for u, v in zip(a, b, strict=True))))
    return [int(f) if s else exact(a, b) for s, f, a, b in zip(safe, fast, x, q, strict=True)]


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    values = column.to_pandas() if isinstance(column, pa.Array) else column
    return np.stack(values.to_numpy()).astype(np.float64)


def _of_length(rows: DataFrame, asked: DataFrame, n: int, k: int) -> DataFrame:
    """Candidates ``query_id, vec_id, lower, upper`` among vectors of ``n`` components."""
    spark = rows.sparkSession
    ends = rows.agg(F.count("*"), *[f(F.col("x")[i]) for f in (F.min, F.max) for i in range(n)]).first()
    least, most = np.array(ends[1 : n + 1], float), np.array(ends[n + 1 :], float)
    draw = F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < SAMPLE / max(ends[0], 1)).select("x").toPandas()["x"]
    sample = _matrix(sample) if len(sample) else np.stack([least, most])
    sent = spark.sparkContext.broadcast(Cells.fitted(sample, least, most))

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = [c.tobytes() for c in sent.value.of(_matrix(batch["x"]))]
                yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(cells, pa.binary())], ["vec_id", "cells"])

    files = written(points(rows, k).select("vec_id", "x").mapInArrow(approximate, "vec_id long, cells binary"), "approximations", ends[0])
    asked = asked.select("vec_id", "x")
    down, across = max(1, -(-ends[0] // ROWS)), max(1, -(-asked.count() // QUERIES))
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    nothing = {"x": F.lit(None).cast("array<double>"), "cells": F.lit(None).cast("binary")}
    data = files.withColumns({"row": F.pmod(F.xxhash64("vec_id"), F.lit(down)).cast("int"), "col": all_of(across), "x": nothing["x"]})
    asks = asked.withColumns({"col": F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(across)).cast("int"), "row": all_of(down), "cells": nothing["cells"]})

    def block(part: pd.DataFrame) -> pd.DataFrame:
        here, there = part[part["x"].isna()], part[part["cells"].isna()]
        if not len(here) or not len(there):
            return pd.DataFrame({"query_id": [], "vec_id": [], "lower": [], "upper": []}).astype({"query_id": "int64", "vec_id": "int64"})
        cells = np.frombuffer(b"".join(here["cells"]), np.uint8).reshape(len(here), -1)
        return candidates(here["vec_id"].to_numpy(), cells, there["vec_id"].to_numpy(), _matrix(there["x"]), sent.value, k)

    met = data.unionByName(asks).groupBy("row", "col")
    return met.applyInPandas(block, "query_id long, vec_id long, lower double, upper double")


def survivors(rows: DataFrame, is_query: Column, k: int) -> DataFrame | None:
    """``query_id, vec_id, upper, place`` of rows that bounds leave, in the order of their bounds; None without a query."""
    lengths = [r["n"] for r in rows.where(is_query).select("n").distinct().orderBy("n").collect()]
    parts = [_of_length(rows.where(F.col("n") == n), rows.where((F.col("n") == n) & is_query), n, k) for n in lengths]
    if not parts:
        return None
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    # a query has about k candidates a block
    best = Window.partitionBy("query_id").orderBy(F.desc("lower"), "vec_id")
    found = found.withColumn("_p", F.row_number().over(best))
    whole = Window.partitionBy("query_id")
    found = found.withColumns({"_floor": F.min(F.when(F.col("_p") == k, F.col("lower"))).over(whole), "_last": F.min(F.when(F.col("_p") == k, F.col("vec_id"))).over(whole)})
    reach = F.col("_floor").isNull() | (F.col("upper") > F.col("_floor")) | ((F.col("upper") == F.col("_floor")) & (F.col("vec_id") <= F.col("_last")))
    order = Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id")
    return found.where(reach).select("query_id", "vec_id", "upper", F.row_number().over(order).alias("place"))


def _scored(pairs: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``query_id, vec_id, score`` of stored pairs, from exact vectors."""
    # points near many queries are hot; they are at most 1 / HOT_SHARE
    n = pairs.count()
    often = pairs.groupBy("vec_id").agg(F.count("*").alias("_c")).where(F.col("_c") > F.lit(max(HOT_SHARE * n, 8.0)))
    exact = rows.select("vec_id", "x")
    near = joined(pairs, exact, exact.join(F.broadcast(often.select("vec_id")), "vec_id"), "vec_id").join(asked, "query_id")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch["x"].offsets.to_numpy())
            for n in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == n)))
                scores = pa.array(_scores(_matrix(part["x"]), _matrix(part["q"])), pa.int64())
                yield pa.RecordBatch.from_arrays([part["query_id"], part["vec_id"], scores], ["query_id", "vec_id", "score"])

    return near.select("query_id", "vec_id", "x", "q").mapInArrow(score, "query_id long, vec_id long, score long")


def _uncertain(left: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """Rows of ``left`` that may still be among their query's ``k`` best."""
    kth = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("_kth"))
    as_double = F.col("_kth").cast("double")
    # scores beyond 2 ** 53 are rounded as doubles; one at the least end of long may tie with any
    reach = F.col("_kth").isNull() | (F.col("_kth") == _LEAST) | (F.col("upper") >= as_double - F.abs(as_double) * 2.0**-50)
    return left.join(kth, "query_id", "left").where(reach).drop("_kth")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` greatest integer inner products of each query row."""
    rows = whole_vectors(vectors, scale)
    found = survivors(rows, is_query, k)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = written(found, "survivors")
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    left, upto, best = found, FIRST * k, None
    while True:
        portion = written(left.where(F.col("place") <= upto).select("query_id", "vec_id"), "portion")
        scored = _scored(portion, rows, asked)
        if best is not None:
            scored = scored.unionByName(best.select("query_id", "vec_id", "score"))
        best = written(scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "best")
        left = _uncertain(found.where(F.col("place") > upto), best, k)
        if left.isEmpty():
            return best
        upto *= GROWTH
