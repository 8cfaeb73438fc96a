"""Distances between points in space, and areas of atoms."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Dots of a sphere that share one number, a bit each; pairs whose dots are tested at once, in the cache.
BITS, PAIRS = 60, 512


def near_pairs(points: DataFrame, others: DataFrame, by: Sequence[str], width: float | Column) -> DataFrame:
    """``points`` beside ``others``, whose places become ``qx, qy, qz``, at the distance ``_d``: at least all pairs nearer than ``width``.

    Points meet those of their own and the 26 next cells of a grid; only ``by`` may be in both tables beside ``x, y, z``.
    """
    cells = {f"c{a}": F.floor(F.col(a) / width) for a in "xyz"}
    there = others.withColumns(cells)
    for a in "xyz":
        there = there.withColumnRenamed(a, f"q{a}").withColumn("_s", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])))
        there = there.withColumn(f"c{a}", F.col(f"c{a}") + F.col("_s")).drop("_s")
    d = F.sqrt(reduce(lambda x, y: x + y, [F.pow(F.col(a) - F.col(f"q{a}"), 2) for a in "xyz"]))
    return points.withColumns(cells).join(there, [*by, *cells]).withColumn("_d", d).drop(*cells)


def contact_counts(points: DataFrame, key: str, radii: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """For each radius: how many other points lie strictly within it, at a distance above zero."""
    others = points.select(*by, F.col(key).alias("_k"), "x", "y", "z")
    pairs = near_pairs(points, others, by, max(radii.values())).where((F.col(key) != F.col("_k")) & (F.col("_d") > 0))
    counts = pairs.groupBy(*by, key).agg(*[F.count_if(F.col("_d") < v).alias(n) for n, v in radii.items()])
    return points.select(*by, key).join(counts, [*by, key], "left").fillna(0, list(radii))


def nearest_distance(points: DataFrame, others: DataFrame, key: str, by: Sequence[str], width: float) -> DataFrame:
    """``by, key, distance`` to the nearest of ``others``; null where there is none.

    A nearest point within a cell's width is certain; points without one ask again in cells four times as wide.
    """
    places = [*by, "x", "y", "z"]
    sides = points.select("x", "y", "z").union(others.select("x", "y", "z")).agg(*[(F.max(a) - F.min(a)).alias(a) for a in "xyz"]).first()
    span = max((s for s in sides if s is not None), default=0.0)
    left, found = points.select(key, *places), []
    while True:
        least = near_pairs(left, others.select(*places), by, width).groupBy(*by, key).agg(F.min("_d").alias("distance"))
        asked = stored(left.join(least, [*by, key], "left"), "nearest")
        if width > span:
            found.append(asked)
            break
        found.append(asked.where(F.col("distance") <= width))
        left = asked.where(F.col("distance").isNull() | (F.col("distance") > width)).drop("distance")
        if left.isEmpty():
            break
        width *= 4
    return reduce(DataFrame.unionByName, [f.select(*by, key, "distance") for f in found])


def sphere(n: int = 100) -> np.ndarray:
    """Even points on the unit sphere: equal steps from pole to pole, turned by the golden angle."""
    k = np.arange(n)
    z, turn = 1 - (2 * k + 1) / n, k * np.pi * (3 - 5**0.5)
    r = np.sqrt(1 - z**2)
    return np.stack([np.cos(turn) * r, np.sin(turn) * r, z], axis=1)


def accessible_area(atoms: DataFrame, probe: float = 1.4, n: int = 100, by: Sequence[str] = ("chain",), key: str = "atom_id") -> DataFrame:
    """Solvent-accessible area of each atom of ``atoms(by, key, x, y, z, radius)``, by rolling a probe over those of its group."""
    return accessible_areas(atoms, atoms, {"area": F.lit(True)}, probe, n, by, key)


def accessible_areas(
    atoms: DataFrame, others: DataFrame, seen: Mapping[str, Column], probe: float = 1.4, n: int = 100, by: Sequence[str] = ("chain",), key: str = "atom_id"
) -> DataFrame:
    """``by, key`` and an area of each name in ``seen``: that of ``atoms`` beside those of ``others`` for which its condition holds.

    A neighbour hides dots of an atom's sphere, one bit each; hidden dots of all neighbours add up by bitwise or, so
    neither dots nor neighbours are ever collected. Each pair's dots are tested once, whatever the number of areas.
    """
    wide = atoms.select(*by, key, "x", "y", "z", (F.col("radius") + probe).alias("_r"))
    width = F.broadcast(atoms.select("radius").union(others.select("radius")).agg((2 * (F.max("radius") + probe)).alias("_w")))  # one row
    there = others.select(*by, "x", "y", "z", F.col(key).alias("_k"), (F.col("radius") + probe).alias("_q"), *[c.alias(f"_s{i}") for i, c in enumerate(seen.values())])
    # the width is the same in every row, so it may stand among the join's keys
    pairs = near_pairs(wide.join(width), there.join(width), [*by, "_w"], F.col("_w")).where((F.col(key) != F.col("_k")) & (F.col("_d") < F.col("_r") + F.col("_q")))
    numbers = range(-(-n // BITS))
    pairs = pairs.withColumn("_m", _hidden_dots(n)("x", "y", "z", "_r", "qx", "qy", "qz", "_q"))
    masks = {f"_m{i}_{j}": F.bit_or(F.when(F.col(f"_s{i}"), F.col(f"_m._{j}"))) for i in range(len(seen)) for j in numbers}
    hidden = pairs.groupBy(*by, key).agg(*[m.alias(name) for name, m in masks.items()])
    free = [n - reduce(lambda a, b: a + b, [F.coalesce(F.bit_count(f"_m{i}_{j}"), F.lit(0)) for j in numbers]) for i in range(len(seen))]
    areas = [(4 * np.pi * F.col("_r") * F.col("_r") * f / n).alias(name) for f, name in zip(free, seen)]
    return wide.join(hidden, [*by, key], "left").select(*by, key, *areas)


def _hidden_dots(n: int) -> Callable[..., Column]:
    """Which dots of the sphere of radius ``r`` around ``x, y, z`` the one of ``q`` around ``qx, qy, qz`` covers: numbers of `BITS` bits."""
    parts, dots = -(-n // BITS), sphere(n).T.copy()

    @F.pandas_udf(", ".join(f"_{j} long" for j in range(parts)))
    def hidden(x: pd.Series, y: pd.Series, z: pd.Series, r: pd.Series, qx: pd.Series, qy: pd.Series, qz: pd.Series, q: pd.Series) -> pd.DataFrame:
        bits = np.zeros((len(x), parts, 64), bool)
        ends, radius, reach = [(a.to_numpy(), b.to_numpy()) for a, b in ((x, qx), (y, qy), (z, qz))], r.to_numpy(), q.to_numpy() ** 2
        for at in range(0, len(x), PAIRS):
            p, far = slice(at, at + PAIRS), 0.0
            for (a, b), d in zip(ends, dots):
                apart = a[p, None] + radius[p, None] * d - b[p, None]
                apart *= apart
                far = far + apart
            covered = far < reach[p, None]
            for j in range(parts):
                of = covered[:, j * BITS : (j + 1) * BITS]
                bits[p, j, : of.shape[1]] = of
        packed = np.packbits(bits, axis=2, bitorder="little").view("<i8")[:, :, 0]
        return pd.DataFrame({f"_{j}": packed[:, j] for j in range(parts)})

    return hidden
