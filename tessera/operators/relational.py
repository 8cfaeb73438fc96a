"""Joins and windows along a position axis."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Interval tables of at most so many rows are broadcast; larger ones are joined by bins.
SMALL = 10_000


def annotate_interval(df: DataFrame, intervals: DataFrame, pos: str = "pos", default: str = "UNANNOTATED", bin_width: int = 1024) -> DataFrame:
    """Adds ``domain`` and ``ordinal`` of the disjoint interval ``[lo, hi]`` that holds ``pos``; gaps get the default and null."""
    if intervals.limit(SMALL + 1).count() <= SMALL:
        hit = df.join(F.broadcast(intervals), F.col(pos).between(F.col("lo"), F.col("hi")), "left")
    else:
        bins = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("lo") / bin_width), F.floor(F.col("hi") / bin_width))))
        left = df.withColumn("_bin", F.floor(F.col(pos) / bin_width))
        hit = left.join(bins, (left["_bin"] == bins["_bin"]) & F.col(pos).between(F.col("lo"), F.col("hi")), "left").drop("_bin")
    return hit.withColumn("domain", F.coalesce("name", F.lit(default))).drop("name", "lo", "hi")


#: Positions of a range; ranges are dealt to tasks.
RANGE = 1 << 14


def spine(df: DataFrame, pos: str = "pos") -> DataFrame:
    """All positions from 1 to the largest, range by range."""
    top = df.agg(F.max(pos).cast("int").alias("top"))
    ranges = top.select("top", F.explode(F.sequence(F.lit(0), F.expr(f"top div {RANGE}"))).alias("_r"))
    first, last = F.greatest(F.col("_r") * RANGE, F.lit(1)), F.least((F.col("_r") + 1) * RANGE - 1, F.col("top"))
    return ranges.repartition("_r").select(F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias(pos))


def on_axis(dense: DataFrame, reach: int, columns: dict[str, Callable[[WindowSpec], Column]], pos: str = "pos") -> DataFrame:
    """``dense`` (one row a position) with columns over windows that reach at most ``reach`` positions to either side.

    Windows run within ranges; rows near a range's end are copied to the next one, and take no part in its result.
    """
    width = max(RANGE, 4 * reach)
    here = F.floor(F.col(pos) / width)
    near = F.array(here, F.when(F.pmod(F.col(pos), F.lit(width)) < reach, here - 1), F.when(F.pmod(F.col(pos), F.lit(width)) >= width - reach, here + 1))
    rows = dense.withColumn("_r", F.explode(F.array_compact(near)))
    axis = Window.partitionBy("_r").orderBy(pos)
    return rows.withColumns({name: make(axis) for name, make in columns.items()}).where(F.col("_r") == here).drop("_r")


def densify(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows of ``df``, one for each position, with nulls where it has none."""
    return spine(df, pos).join(df, pos, "left")


def neighbour_in_other_fold(df: DataFrame, pos: str, fold: str, reach: int) -> DataFrame:
    """Distinct ``(pos, fold)`` with ``near``: whether another fold has a position within ``reach``.

    A band join on bins of the reach's width: positions meet only those of their own and the two next bins.
    """
    keys = df.select(F.col(pos).alias("pos"), F.col(fold).alias("fold")).distinct()
    wide = keys.select(F.col("pos").alias("q"), F.col("fold").alias("g"), F.explode(F.array(*[F.floor(F.col("pos") / (reach + 1)) + i for i in (-1, 0, 1)])).alias("b"))
    near = keys.withColumn("b", F.floor(F.col("pos") / (reach + 1))).join(wide, "b", "left").where((F.abs(F.col("pos") - F.col("q")) <= reach) & (F.col("fold") != F.col("g")))
    hit = near.select("pos", "fold").distinct().withColumn("near", F.lit(True))
    return keys.join(hit, ["pos", "fold"], "left").withColumn("near", F.coalesce("near", F.lit(False)))


def rolling_means(dense: DataFrame, value: str, widths: Sequence[int], name: str = "m_w{}") -> DataFrame:
    """``dense`` with centred means over each number of rows, nulls left out."""
    mean = lambda w: lambda axis: F.avg(value).over(axis.rowsBetween(-(w // 2), w // 2))
    return on_axis(dense, max(widths) // 2, {name.format(w): mean(w) for w in widths})


def islands(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Runs of consecutive positions: ``lo, hi, n, label``.

    Runs are found range by range; only those that touch an end of their range, two a range at most, are joined in one task.
    """
    rows = df.select(pos).distinct().withColumn("_r", F.floor(F.col(pos) / RANGE))
    rows = rows.withColumn("_g", F.col(pos) - F.row_number().over(Window.partitionBy("_r").orderBy(pos)))
    runs = rows.groupBy("_r", "_g").agg(F.min(pos).alias("lo"), F.max(pos).alias("hi"))
    touches = (F.pmod("lo", F.lit(RANGE)) == 0) | (F.pmod("hi", F.lit(RANGE)) == RANGE - 1)
    inner, edge = runs.where(~touches).select("lo", "hi"), runs.where(touches).select("lo", "hi")
    order = Window.partitionBy(F.lit(0)).orderBy("lo")
    starts = F.coalesce((F.col("lo") != F.lag("hi").over(order) + 1).cast("int"), F.lit(1))
    edge = edge.withColumn("_s", starts).withColumn("_g", F.sum("_s").over(order)).groupBy("_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    label = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    return inner.unionByName(edge.select("lo", "hi")).select("lo", "hi", (F.col("hi") - F.col("lo") + 1).cast("long").alias("n"), label.alias("label"))


def mutate(reference: Column, pos: Column, symbol: Column) -> Column:
    """The reference with one symbol replaced."""
    return F.overlay(reference, symbol, pos, 1)


def difference_status(reference: Column, other: Column, pos: Column, symbol: Column) -> Column:
    """How ``other`` differs from the reference, position by position, against a stated single change."""
    pairs = F.zip_with(F.split(reference, ""), F.split(other, ""), lambda a, b: a != b)
    where = F.filter(F.transform(pairs, lambda d, i: F.when(d, i + 1).otherwise(0)), lambda i: i > 0)
    return (
        F.when(F.length(reference) != F.length(other), "wrong_length")
        .when(F.size(where) == 0, "identical")
        .when(F.size(where) > 1, "multiple")
        .when((where[0] == pos) & (F.substring(other, pos, F.lit(1)) == symbol), "ok")
        .otherwise("inconsistent")
    )


def out_of_fold(df: DataFrame, key: str | None, value: str, fold: str, name: str, base: DataFrame | None = None) -> DataFrame:
    """Adds ``name``: the mean of ``value`` over rows of the same key in other folds (null if there are none).

    Means are taken from ``base``, if given: the same rows with fewer steps behind them.
    """
    keys = [key] if key else []
    parts = (df if base is None else base).groupBy(*keys, fold).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    every = Window.partitionBy(*(keys or [F.lit(0)]))
    parts = parts.withColumn(name, F.try_divide(F.sum("_s").over(every) - F.col("_s"), (F.sum("_n").over(every) - F.col("_n")).cast("double")))
    parts = parts.drop("_s", "_n")
    return df.join(parts if key else F.broadcast(parts), [*keys, fold], "left")
