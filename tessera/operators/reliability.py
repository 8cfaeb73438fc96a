"""Reliability, resampling and ranks of groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.digests import Digests
from ..functions.ranks import value_ranks
from ..functions.stats import pearson, spearman_brown
from ..sources.assay import draw


def icc(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: the one-way random-effects intraclass correlation of ``value`` by ``group``, and its parts."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").cast("double").alias("k"), F.avg(value).alias("m"), F.var_pop(value).alias("v"), F.sum(value).alias("s"))
    t = g.agg(
        F.count("*").cast("double").alias("a"), F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("k2"), F.sum("s").alias("s"),
        F.sum(F.col("k") * F.col("m") * F.col("m")).alias("kmm"), F.sum(F.col("k") * F.col("v")).alias("within"), F.avg("k").alias("mean_group_size"),
    )
    msb = F.try_divide(F.col("kmm") - F.try_divide(F.col("s") * F.col("s"), F.col("n")), F.col("a") - 1)
    msw = F.try_divide(F.col("within"), F.col("n") - F.col("a"))
    k0 = F.try_divide(F.col("n") - F.try_divide(F.col("k2"), F.col("n")), F.col("a") - 1)
    t = t.withColumns({"ms_between": msb, "ms_within": msw, "k0": k0})
    between = F.greatest(F.try_divide(F.col("ms_between") - F.col("ms_within"), F.col("k0")), F.lit(0.0))
    t = t.withColumn("icc", F.try_divide(between, between + F.col("ms_within")))
    return t.select(F.col("a").cast("long").alias("n_groups"), F.col("n").cast("long").alias("n"), "ms_between", "ms_within", "k0", "icc", F.sqrt("icc").alias("ceiling"), "mean_group_size")


#: Rows whose halves are dealt in one task, about.
HALVES_ROWS = 1 << 17
_MOMENTS = "rep int, g long, n long, mx double, my double, xx double, yy double, xy double, x_lo double, x_hi double, y_lo double, y_hi double"
_MOMENT_NAMES = [c.split()[0] for c in _MOMENTS.split(", ")]


class _Halves:
    """Groups of a block of rows, and how the two halves of each lie once rows are sorted by group and digest."""

    def __init__(self, codes: np.ndarray, least: int) -> None:
        """``codes``: each row's group, from 0; -1 for rows without one."""
        sizes = np.bincount(codes[codes >= 0])
        kept = sizes >= max(least, 1)
        number = np.append(np.where(kept, kept.cumsum() - 1, kept.sum()), kept.sum())
        self.groups, sizes = int(kept.sum()), sizes[kept]
        # rows of other groups come last
        self.codes = number[codes].astype(np.uint16 if self.groups < 65535 else np.int64)
        self.rows, self.half = int(sizes.sum()), sizes // 2
        starts = sizes.cumsum() - sizes
        self.cuts = np.stack([starts, starts + self.half, starts + 2 * self.half], 1).ravel()

    def _sums(self, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = np.add.reduceat(np.append(ordered, 0), self.cuts)
        return np.where(self.half > 0, sums[::3], 0), np.where(self.half > 0, sums[1::3], 0)

    def moments(self, order: np.ndarray, value: np.ndarray, there: np.ndarray | None) -> tuple:
        """Counts, means and squares of the groups' two means; ``value`` and ``there`` come in ``order``."""
        placed = np.argsort(self.codes[order], kind="stable")[: self.rows]
        x, y = self._sums(value[placed])
        n, m = (self.half, self.half) if there is None else self._sums(there[placed])
        both = (n > 0) & (m > 0)
        if not both.any():
            return (self.groups, 0, *[None] * 9)
        x, y = x[both] / n[both], y[both] / m[both]
        dx, dy = x - x.mean(), y - y.mean()
        ends = np.fmin.reduce(x), x.max(), np.fmin.reduce(y), y.max()
        return (self.groups, len(x), x.mean(), y.mean(), dx @ dx, dy @ dy, dx @ dy, *ends)


def _dealt(pdf: pd.DataFrame, reps: int, labels: dict[tuple, np.ndarray], least: int) -> list[tuple]:
    """Moments of each repeat under each label's groups: a digest is made once, whatever the labels."""
    halves = {k: h for k, codes in labels.items() if (h := _Halves(codes, least)).groups}
    digests = Digests([b"" if t is None else f":{t}".encode() for t in pdf["_key"]])
    value, there = pdf["_value"].to_numpy(np.float64, na_value=np.nan), pdf["_there"].to_numpy(bool)
    value, every = np.where(there, value, 0.0), there.all()
    out = []
    for rep in range(reps if halves else 0):
        high, low = digests.of(f"h:{rep}".encode())
        order = np.argsort(high)
        sorted_ = high[order]
        if (sorted_[1:] == sorted_[:-1]).any():
            order = np.lexsort((low, high))
        v, t = value[order], None if every else there[order].astype(np.int64)
        out += [(*k, rep, *h.moments(order, v, t)) for k, h in halves.items()]
    return out


def _correlated(parts: DataFrame, by: list[str]) -> DataFrame:
    """Mean correlation over repeats from the moments of blocks, which meet at the means of all of them."""
    every = Window.partitionBy(*by, "rep")
    for c in ("mx", "my"):
        parts = parts.withColumn(f"_{c}", F.try_divide(F.sum(F.col("n") * F.col(c)).over(every), F.sum("n").over(every).cast("double")))
    dx, dy = F.col("mx") - F.col("_mx"), F.col("my") - F.col("_my")
    total = lambda c, a, b: F.sum(F.col(c) + F.col("n") * a * b)
    lone = (F.min("x_lo") == F.max("x_hi")) | (F.min("y_lo") == F.max("y_hi"))
    r = F.when(~lone, F.try_divide(total("xy", dx, dy), F.sqrt(total("xx", dx, dx)) * F.sqrt(total("yy", dy, dy))))
    reps = parts.groupBy(*by, "rep").agg(r.alias("r"), F.sum("g").alias("n_groups"))
    out = reps.groupBy(*by).agg(F.avg("r").alias("split_half_r"), F.max("n_groups").alias("n_groups"))
    return out.withColumn("spearman_brown", spearman_brown(F.col("split_half_r")))


def _told(df: DataFrame, value: str, key: str, *columns: str | Column) -> DataFrame:
    return df.select(*columns, F.col(key).cast("string").alias("_key"), F.col(value).cast("double").alias("_value"), F.col(value).isNotNull().alias("_there"))


def split_half(df: DataFrame, group: list[str], value: str, key: str, reps: int, least: int = 4, by: list[str] | None = None) -> DataFrame:
    """Mean correlation of random halves of each group over ``reps`` splits, and its Spearman-Brown step-up, for each ``by``.

    Halves are dealt by an md5 order within the group; an odd row is left out. A row is moved once, to the block of its
    group, where all repeats are dealt; blocks give sums alone.
    """
    by = by or []
    names = [f"_{i}" for i in range(len(by))]
    blocks = max(1, -(-df.count() // HALVES_ROWS))
    rows = _told(df, value, key, *[F.col(b).alias(n) for b, n in zip(by, names)], F.pmod(F.xxhash64(*by, *group), F.lit(blocks)).alias("_block"), F.struct(*by, *group).cast("string").alias("_group"))
    kinds = "".join(f"{n} {df.schema[b].dataType.simpleString()}, " for b, n in zip(by, names))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values(["_key", "_value"]), []
        for label, part in pdf.groupby(names, dropna=False, sort=False) if by else [((), pdf)]:
            label = tuple(None if pd.isna(x) else x for x in label)
            out += _dealt(part, reps, {label: pd.factorize(part["_group"])[0]}, least)
        return pd.DataFrame(out, columns=[*names, *_MOMENT_NAMES])

    parts = rows.groupBy("_block").applyInPandas(deal, kinds + _MOMENTS)
    return _correlated(parts, names).withColumnsRenamed(dict(zip(names, by)))


def split_half_windows(df: DataFrame, pos: str, value: str, key: str, reps: int, windows: Sequence[int], least: int = 4) -> DataFrame:
    """``split_half`` of the units of each width over a position axis from 1, as ``window_size``.

    Blocks are ranges of the axis. A unit belongs to the range of its first position; rows near a range's start are copied
    to the range before, so one digest a row and repeat serves all widths.
    """
    n, top = df.where(F.col(pos) > 0).agg(F.count("*"), F.max(pos)).first()
    width = max(2 * max(windows), -(-(top or 1) * HALVES_ROWS // max(n, 1)))
    at = F.col(pos).cast("long") - 1
    here = F.floor(at / width)
    near = F.array(here, F.when((here > 0) & (at % width < max(windows) - 1), here - 1))
    rows = _told(df.where(F.col(pos) > 0), value, key, at.alias("_at"), F.explode(F.array_compact(near)).alias("_block"))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_key", "_value"])
        at, first = pdf["_at"].to_numpy(np.int64), int(pdf["_block"].iloc[0]) * width
        units = {}
        for w in windows:
            unit = at // w
            mine = (unit * w >= first) & (unit * w < first + width)
            units[(w,)] = np.where(mine, unit - first // w, -1)
        return pd.DataFrame(_dealt(pdf, reps, units, least), columns=["window_size", *_MOMENT_NAMES])

    parts = rows.groupBy("_block").applyInPandas(deal, "window_size int, " + _MOMENTS)
    return _correlated(parts, ["window_size"])


def cluster_weights(df: DataFrame, cluster: str, reps: int, seed: str = "b") -> DataFrame:
    """``(rep, cluster, w)``: how often each cluster is drawn in each of ``reps`` draws with replacement.

    Clusters that are not null are numbered by their order; draw ``i`` of a repeat takes number md5(seed:rep:i) modulo their count.
    """
    ids = value_ranks(df.select(cluster).distinct(), cluster, prefix="i").select(cluster, (F.col("i_min") - 1).alias("_i"))
    n = F.broadcast(ids.agg(F.count("*").alias("_c")))
    picks = ids.join(n).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    picks = picks.select("rep", (draw(seed, F.col("rep"), F.col("_i")) % F.col("_c")).alias("_i"))
    return picks.groupBy("rep", "_i").agg(F.count("*").alias("w")).join(ids, "_i").select("rep", cluster, "w")


def weighted_spearman(df: DataFrame, y: str, preds: list[str], by: list[str], w: str = "w") -> DataFrame:
    """Spearman of ``y`` with each prediction for each ``by``, each row counted ``w`` times; rows without one of them are left out."""
    df = df.dropna(subset=[y, *preds])
    ranked = df
    for c in [y, *preds]:
        ranked = ranked.join(value_ranks(df, c, by, f"_r_{c}", weight=w).select(*by, c, f"_r_{c}_avg"), [*by, c])
    return ranked.groupBy(*by).agg(*[pearson(f"_r_{y}_avg", f"_r_{p}_avg", w).alias(p) for p in preds])


def percentile_interval(draws: DataFrame, column: str, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Percentile interval and two-sided p of a statistic over its draws; missing draws are left out."""
    p = 2 * F.least(F.avg((F.col(column) <= 0).cast("int")), F.avg((F.col(column) >= 0).cast("int")))
    return draws.where(F.col(column).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n_draws"), F.avg(column).alias("mean"), F.percentile(column, alpha / 2).alias("lo"), F.percentile(column, 1 - alpha / 2).alias("hi"), F.least(p, F.lit(1.0)).alias("p_two_sided")
    )
