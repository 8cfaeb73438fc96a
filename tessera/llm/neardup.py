"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are split in halves; a codebook for each half, learned on a bounded sample, forms a product
grid of cells. Multi-sequence traversal lists cells in the order of their distance from a vector, without
those that planes between the codes prove to be too far for a link; how many are visited is set by the recall
that sampled distinct vectors reach against brute force, as an average over vectors and over groups. Where few
of the sampled vectors have partners, pairs made from them stand in for the missing answers. Every vector lies
in its own cell and probes its nearest cells; both meet in blocks of bounded size, and each pair is verified in
double precision and counted in one block. Blocks give link counts and a spanning forest. Equal vectors are one,
with a number of copies, so a vector that many rows share is compared once. Vectors of each length have an index
of their own; up to ``SMALL`` of a length are compared in one cell. One cell also serves a length for which even
the greatest number of visits finds less than ``LEAST`` of the links: an index can't help there.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
vectors of different lengths don't link; a null id gets its row without links and a null component;
rows that repeat an id are one vector (the greatest one), each gets its row; other columns don't matter;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, components, joined, written

THRESHOLD = 0.9
#: Vectors from which the codebooks are learned (more of them for larger codebooks), and groups with partners that set
#: the number of probes.
SAMPLE, QUERIES = 20_000, 1_000
#: Codes of a half: as many as leave about so many vectors in a cell, with a bound. Sampled vectors a code.
CELL, CODES, CODE_SAMPLE = 32, (4, 1_024), 40
#: Vectors that are asked for their partners: at first, and at most (where a table has more).
ASKED, MOST_ASKED = 1_600, 25_600
#: Recall that sets the number of visits, and the one that the greatest number of visits must reach.
RECALL, LEAST = 0.999, 0.95
#: Answers below which made pairs stand in for partners.
FEW = 100
#: Cells that are visited at most: more of them pay from half a million vectors on.
DEEP = 256
#: Nearest codes whose planes bound the distance of a cell.
PLANES = 4
#: Rows that meet at once: in the grid, and where all vectors lie in one cell. Vectors of a length that need no index.
BLOCK, WHOLE_BLOCK, SMALL = 512, 2_048, 256


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T, 0.0)


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centres of ``k`` clusters by Lloyd's rounds."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        of = _distances(x, centres).argmin(1)
        for c in range(len(centres)):
            if (of == c).any():
                centres[c] = x[of == c].mean(0)
    return centres


class MultiIndex:
    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = _halves(x)
        return _distances(a, self.first).argmin(1) * len(self.second) + _distances(b, self.second).argmin(1)

    def nearest(self, x: np.ndarray, n: int, threshold: float = -np.inf) -> np.ndarray:
        """The ``n`` nearest cells of each vector by multi-sequence traversal; -1 stands for those without a link.

        Cell (i, j) of the sorted halves can only be among the first n if (i + 1)(j + 1) <= n, as all cells
        with smaller ranks come before it; so these are the only ones put in order. A vector of another cell lies
        beyond the plane between its code and any other code; where the two halves' distances from these planes
        add up to more than links have, the cell is left out.
        """
        a, b = _halves(x)
        oa, sa, fa = _by_distance(a, self.first, n)
        ob, sb, fb = _by_distance(b, self.second, n)
        i, j = np.array([(i, j) for i in range(sa.shape[1]) for j in range(min(n // (i + 1), sb.shape[1]))], dtype=int).reshape(-1, 2).T
        far = np.where(fa[:, i] + fb[:, j] > 2 * (1 - threshold) + 1e-6, np.inf, sa[:, i] + sb[:, j])
        order = np.argsort(far, axis=1, kind="stable")[:, :n]
        rows = np.arange(len(x))[:, None]
        cells = oa[rows, i[order]] * len(self.second) + ob[rows, j[order]]
        return np.where(np.isinf(far[rows, order]), -1, cells)

    def visits(self, x: np.ndarray, n: int, deep: int, threshold: float) -> Iterator[np.ndarray]:
        """The first ``n`` cells of each vector's order of ``deep`` ones."""
        for lo in range(0, len(x), 256):
            for cells in self.nearest(x[lo : lo + 256], deep, threshold)[:, :n]:
                yield cells[cells >= 0]


def _by_distance(x: np.ndarray, centres: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``n`` nearest codes of each half vector: numbers, squared distances, and least squared distances of what they hold."""
    far = _distances(x, centres)
    order = np.argsort(far, axis=1, kind="stable")[:, :n]
    far = np.take_along_axis(far, order, 1)
    between = _distances(centres, centres) ** 0.5
    least = np.zeros_like(far)
    for r in range(min(PLANES, far.shape[1])):
        gap = between[order, order[:, r : r + 1]]
        # codes that are one up to rounding have no plane
        plane = np.where(gap > 1e-6, (far - far[:, r : r + 1]) / (2 * np.maximum(gap, 1e-6)), 0.0)
        least = np.maximum(least, plane)
    return order, far, least * least


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """``(vec_id, x)``: one valid vector for each id, scaled to length one."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    big = F.array_max(F.transform(x, lambda v: F.abs(v)))
    fine = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), big.alias("big"))
    fine = fine.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.col("big") > 0))
    fine = fine.select("vec_id", F.transform("x", lambda v: v / F.col("big")).alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    fine = fine.groupBy("vec_id").agg(F.max("x").alias("x")).select("vec_id", F.transform("x", lambda v: v / norm).alias("x"))
    return written(fine, "units", vectors.count())


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


def _share(seed: int, rows: float, n: int) -> Column:
    """Whether a row is among about ``rows`` of ``n``, by a seeded hash of its id."""
    return F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) / float(1 << 30) < rows / max(n, 1)


def whole(units: DataFrame) -> tuple[MultiIndex, int]:
    """An index of one cell: all pairs are compared."""
    wide = units.select(F.size("x").alias("n")).first()["n"]
    return MultiIndex(*_halves(np.zeros((1, wide)))), 1


def _places(ones: DataFrame, index: MultiIndex, asked: pd.DataFrame, threshold: float, deep: int) -> pd.DataFrame:
    """Of the asked vectors' partners, how many lie in the k-th visited cell (``deep``: in none): sums of ``n / t ** e``
    for e = 1, 2, 3, with ``t`` partners of a vector, ``n`` of them in that cell. Identical vectors are no partners."""
    q = _matrix(asked["x"])
    order = np.concatenate([index.nearest(q[lo : lo + 256], deep, threshold) for lo in range(0, len(q), 256)]).astype(np.int32)
    sent = ones.sparkSession.sparkContext.broadcast((index.first, index.second, q, order))
    cells = len(index.first) * len(index.second)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, q, order = sent.value
        index = MultiIndex(first, second)
        for batch in batches:
            x = _matrix(batch["x"].to_pandas()) if batch.num_rows else np.zeros((0, q.shape[1]))
            own = index.cells(x)
            for lo in range(0, len(q), 2048):
                cos = x @ q[lo : lo + 2048].T
                i, j = np.nonzero((cos >= threshold) & (cos < 1 - 1e-12))
                pairs, n = np.unique((j + lo) * cells + own[i], return_counts=True)
                j, cell = np.divmod(pairs, cells)
                hit = order[j] == cell[:, None]
                place = np.where(hit.any(1), hit.argmax(1), deep)
                yield pa.RecordBatch.from_arrays([pa.array(j, pa.int64()), pa.array(place, pa.int64()), pa.array(n, pa.int64())], ["q", "place", "n"])

    each = ones.select("x").mapInArrow(met, "q long, place long, n long").groupBy("q", "place").agg(F.sum("n").alias("n"))
    each = each.groupBy("q").agg(F.sum("n").alias("t"), F.collect_list(F.struct("place", "n")).alias("p"))
    each = each.select("t", F.inline("p")).groupBy("place").agg(*[F.sum(F.col("n") / F.col("t") ** e).alias(f"e{e}") for e in (1, 2, 3)])
    return each.orderBy("place").toPandas()


def made_places(index: MultiIndex, x: np.ndarray, threshold: float, deep: int, seed: int = 13) -> np.ndarray:
    """Shares of partners made for ``x`` that lie in the k-th visited cell (``deep``: in none).

    A partner's cosine is evenly drawn from ``threshold`` to 1; it departs towards another of the vectors (odd rows)
    or in any direction (even ones).
    """
    rng = np.random.default_rng(seed)
    aside = rng.standard_normal(x.shape)
    aside[1::2] = x[rng.permutation(len(x))][1::2]
    aside -= (aside * x).sum(1, keepdims=True) * x
    norm = np.sqrt((aside * aside).sum(1, keepdims=True))
    some = norm[:, 0] > 1e-9  # vectors of one component have no other direction
    if not some.any():
        return np.eye(1, deep + 1)[0]
    cos = rng.uniform(threshold, 1, (len(x), 1))
    made = (cos * x + np.sqrt(1 - cos * cos) * aside / np.maximum(norm, 1e-9))[some]
    own = index.cells(made)
    order = np.concatenate([index.nearest(x[some][lo : lo + 256], deep, threshold) for lo in range(0, len(own), 256)])
    hit = order == own[:, None]
    return np.bincount(np.where(hit.any(1), hit.argmax(1), deep), minlength=deep + 1) / len(own)


def build(units: DataFrame, recall: float = RECALL, threshold: float = THRESHOLD) -> tuple[MultiIndex, int, int]:
    """The index of different vectors, the number of cells to visit for the target recall, measured on sampled ones
    against all others, and the length of the order that they are taken from.

    Recall is an average over distinct vectors, and over groups (a vector weighs as one by its number of
    partners), the lower of both; so neither copies nor a dense group speak for the rest. More vectors are asked
    until enough groups have answered. Below ``FEW`` answers, made pairs fill up the number, as many vectors without
    a partner are no reason to compare all pairs.
    """
    ones, n = units, units.count()
    k = int(np.clip(round((n / CELL) ** 0.5), *CODES))
    sample = _matrix(ones.where(_share(11, max(SAMPLE, CODE_SAMPLE * k), n)).orderBy("vec_id").toPandas()["x"])
    index = MultiIndex(*(codebook(h.copy(), k) for h in _halves(sample)))
    cells = len(index.first) * len(index.second)
    deep = min(cells, max(DEEP, min(n // WHOLE_BLOCK, 4 * DEEP)))
    asks = ASKED
    while True:
        asked = ones.where(_share(12, asks, n)).orderBy("vec_id").toPandas()
        got = _places(ones, index, asked, threshold, deep) if len(asked) else pd.DataFrame(columns=["place", "e1", "e2", "e3"])
        answers = got["e2"].sum() ** 2 / got["e3"].sum() if len(got) else 0.0
        if answers >= QUERIES or asks >= min(n, MOST_ASKED):
            break
        asks *= 4
    reached = np.zeros((2, deep + 1))
    if len(got):
        reached[:, got["place"].astype(int)] = got[["e1", "e2"]].to_numpy(dtype=float).T
    if asks < n and answers < FEW:
        reached += (FEW - answers) * made_places(index, _matrix(asked["x"][:ASKED]) if len(asked) else sample, threshold, deep)
    if not reached.any():
        return index, min(4, cells), deep  # every vector was asked, and none has a partner
    # a pair is found if either of its vectors probes the other's cell, so both ends help
    reached = (reached.cumsum(1) / reached.sum(1, keepdims=True)).min(0)
    if reached[deep - 1] < min(recall, LEAST):
        return (*whole(units), 1)
    enough = int(np.searchsorted(reached, min(recall, 1 - 1e-9))) + 1
    return index, min(max(enough, 4), deep), deep


def _placed(units: DataFrame, recall: float, threshold: float) -> tuple[DataFrame, int]:
    """``vec_id, copies, x, n, own, probes`` of vectors of one length, and the rows of a block."""
    index, probes, deep = build(units, recall, threshold)
    sent = units.sparkSession.sparkContext.broadcast((index.first, index.second, probes, deep))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, n, deep = sent.value
        index = MultiIndex(first, second)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch["x"].to_pandas())
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"], batch["copies"], batch["x"], pa.array(index.cells(x)), pa.array(list(index.visits(x, n, deep, threshold)), pa.list_(pa.int64()))],
                    ["vec_id", "copies", "x", "own", "probes"],
                )

    placed = units.mapInArrow(dealt, "vec_id long, copies long, x array<double>, own long, probes array<long>")
    one_cell = len(index.first) * len(index.second) == 1
    return placed.withColumn("n", F.size("x")), WHOLE_BLOCK if one_cell else BLOCK


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding)``."""
    vectors_ = unit_vectors(vectors)
    alone = [F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")]
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    rows = vectors_.count()
    if not rows:
        return every.select("vec_id", *alone, F.lit(True).alias("kept"))
    units = vectors_.groupBy("x").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    units = written(units.select("vec_id", "copies", "x"), "ones", rows)
    # lengths with more than SMALL vectors get an index each; the others share the plan of one cell
    lengths = units.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("c"))
    large = [r["n"] for r in lengths.where(F.col("c") > SMALL).orderBy("n").collect()]
    parts = [_placed(units.where(F.size("x") == n), recall, threshold) for n in large]
    few = units.where(~F.size("x").isin(large)) if large else units
    few = few.withColumns({"own": F.lit(0).cast("long"), "probes": F.array(F.lit(0).cast("long")), "n": F.size("x")})
    placed = few.withColumn("block", F.lit(WHOLE_BLOCK))
    for part, block in parts:
        placed = placed.unionByName(part.withColumn("block", F.lit(block)))
    placed = written(placed, "cells")
    stored = placed.withColumns({"cell": F.col("own"), "asks": F.lit(False)})
    # a row that asks needs no list of cells
    asking = placed.withColumns({"cell": F.explode("probes"), "asks": F.lit(True)}).withColumn("probes", F.lit(None).cast("array<long>"))
    sizes = (
        placed.select("n", "block", F.col("own").alias("cell"), F.lit(1).alias("s"), F.lit(0).alias("a"))
        .union(placed.select("n", "block", F.explode("probes"), F.lit(0), F.lit(1)))
        .groupBy("n", "block", "cell")
        .agg(F.sum("s").alias("s"), F.sum("a").alias("a"))
        .where("s > 0 and a > 0")
    )
    # one row a cell that holds a vector: for each length, at most as many as the grid has, CODES[1] squared
    parts_of = lambda c: F.ceil(F.col(c) / F.col("block")).cast("int")
    sizes = F.broadcast(sizes.select("n", "cell", parts_of("s").alias("ns"), parts_of("a").alias("na")))
    spot = F.xxhash64("vec_id", "cell")
    stored = stored.join(sizes, ["n", "cell"]).withColumns({"i": F.pmod(spot, F.col("ns")).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("na") - 1))})
    asking = asking.join(sizes, ["n", "cell"]).withColumns({"j": F.pmod(spot, F.col("na")).cast("int"), "i": F.explode(F.sequence(F.lit(0), F.col("ns") - 1))})
    met = stored.drop("ns", "na", "block").unionByName(asking.drop("ns", "na", "block"))

    def verify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        here = rows[~rows["asks"]].sort_values("vec_id", ignore_index=True)
        there = rows[rows["asks"]].sort_values("vec_id", ignore_index=True)
        counts: dict[int, int] = {}
        root: dict[int, int] = {}

        def find(u: int) -> int:
            while root.setdefault(u, u) != u:
                root[u] = u = root[root[u]]
            return u

        if len(here) and len(there):
            a, b = here["vec_id"].to_numpy(), there["vec_id"].to_numpy()
            i, j = np.nonzero((_matrix(here["x"]) @ _matrix(there["x"]).T >= threshold) & (a[:, None] != b))
            # a pair that meets in both vectors' cells counts where the smaller id asks
            probes, own = here["probes"].to_numpy(), there["own"].to_numpy()
            grid = np.int64(CODES[1] ** 2)
            asked = np.concatenate([np.asarray(p, np.int64) + grid * at for at, p in enumerate(probes)])
            use = ~np.isin(own[j] + grid * i, asked) | (b[j] < a[i])
            i, j = i[use], j[use]
            for ids, at, other in ((a, i, there["copies"].to_numpy()[j]), (b, j, here["copies"].to_numpy()[i])):
                sums = np.bincount(at, weights=other, minlength=len(ids))
                for p in np.flatnonzero(sums):
                    counts[int(ids[p])] = counts.get(int(ids[p]), 0) + int(sums[p])
            for u, v in zip(a[i].tolist(), b[j].tolist(), strict=True):
                u, v = find(u), find(v)
                root[max(u, v)] = min(u, v)
        return pd.DataFrame({"vec_id": list(counts), "links": list(counts.values()), "root": [find(u) for u in counts]}, dtype="int64")

    found = written(met.groupBy("n", "cell", "i", "j").applyInPandas(verify, "vec_id long, links long, root long"), "links", rows, shuffled=False)
    sums = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("root").alias("u"), F.col("vec_id").alias("v")), rows)
    table = units.join(sums, "vec_id", "left").join(roots.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    links = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links")
    table = table.select("x", "copies", links, F.coalesce("component", "vec_id").alias("component_id"))
    hot = table.where(F.col("copies") > F.lit(max(HOT_SHARE * rows, 8.0)))
    linked = joined(vectors_, table, hot, "x").select("vec_id", "n_links", "component_id")
    out = every.join(linked, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
