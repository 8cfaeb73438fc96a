"""Global ranks without a single-task window.

Ranks belong to distinct values, so equal values, however many, are one counted row. A value's rank is the
number of rows in lower buckets plus the rows below it in its own bucket. Buckets are cut at approximate
quantiles of the distinct values, so they are even; ranks are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets over all distinct values of a table: at least so many, more where a session shuffles to more partitions.
BUCKETS, MOST_BUCKETS = 64, 1024


def _bucketed(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """Adds ``_b``, a bucket number that rises with ``value``."""
    buckets = min(max(buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MOST_BUCKETS)
    # the cut points are one row: a broadcast of a fixed size
    cuts = df.agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10_000).alias("_cuts"))
    return df.join(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")


def value_ranks(df: DataFrame, value: str, by: list[str] | None = None, prefix: str = "rank", buckets: int = BUCKETS, weight: str | None = None) -> DataFrame:
    """``*by, value, {prefix}_min, {prefix}_avg, {prefix}_n``: one row a distinct value that is not null.

    ``_min`` is 1 + the rows below, ``_avg`` the mean rank of the tied rows, ``_n`` the rows of the group.
    A row counts ``weight`` times, if given.
    """
    by = by or []
    values = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(weight) if weight else F.count("*")).alias("_c"))
    return ranked(values, value, by, prefix, buckets).select(*by, value, *[f"{prefix}_{x}" for x in ("min", "avg", "n")])


def ranked(values: DataFrame, value: str, by: list[str], prefix: str = "rank", buckets: int = BUCKETS) -> DataFrame:
    """``values``, one row a distinct value that stands for ``_c`` rows, with the columns of ``value_ranks``."""
    group = by or [F.lit(0)]
    values = _bucketed(values, value, buckets)
    lower = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = values.groupBy(*by, "_b").agg(F.sum("_c").alias("_s"))
    counts = counts.withColumns({"_below": F.coalesce(F.sum("_s").over(lower), F.lit(0)), "_n": F.sum("_s").over(Window.partitionBy(*group))}).drop("_s")
    inside = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_below") + F.coalesce(F.sum("_c").over(inside), F.lit(0))
    ranks = values.join(counts, [*by, "_b"]).withColumn("_below", below)
    ranks = ranks.withColumns({f"{prefix}_min": F.col("_below") + 1, f"{prefix}_avg": F.col("_below") + (F.col("_c") + 1) / 2.0, f"{prefix}_n": F.col("_n")})
    return ranks.drop("_b", "_below", "_n")


def add_ranks(df: DataFrame, value: str, by: list[str] | None = None, prefix: str = "rank", buckets: int = BUCKETS) -> DataFrame:
    """``df`` with its ``value_ranks``; rows with a null value are dropped. ``by`` ranks within groups."""
    return df.join(value_ranks(df, value, by, prefix, buckets), [*(by or []), value])


def counts_by_part(df: DataFrame, value: str, part: str, parts: int, buckets: int = BUCKETS) -> DataFrame:
    """``value, below, own``: one row a distinct value that is not null, with arrays of how many rows of each ``part``
    (numbers from 0), and last of all parts, are below the value and have it.

    Ranks outside of a part are those of all less the part's, so the sets without each part are never made.
    """
    names = [f"_c{i}" for i in range(parts + 1)]
    each = [*[F.count_if(F.col(part) == i) for i in range(parts)], F.count("*")]
    values = df.where(F.col(value).isNotNull()).groupBy(value).agg(*[c.alias(n) for n, c in zip(names, each)])
    values = _bucketed(values, value, buckets)
    lower = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = values.groupBy("_b").agg(*[F.sum(n).alias(n) for n in names])
    counts = counts.select("_b", F.array(*[F.coalesce(F.sum(n).over(lower), F.lit(0)) for n in names]).alias("_lower"))
    inside = Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = F.array(*[F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in names])
    # at most MOST_BUCKETS rows
    out = values.select("_b", value, F.array(*names).alias("own"), below.alias("_inside")).join(F.broadcast(counts), "_b")
    return out.select(value, F.zip_with("_inside", "_lower", lambda a, b: a + b).alias("below"), "own")


def shuffled_number(df: DataFrame, digest: Column, *key: str, base: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Adds ``number``: each row's place, from 0, in the order of a hex digest (ties by ``key``), within each ``by``.

    Buckets are the digest's first four digits. They are counted on ``base``, if given: the same rows
    with fewer steps behind them.
    """
    by = by or []
    bucket = F.substring(digest, 1, 4)
    below = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = (df if base is None else base).groupBy(*by, bucket.alias("_b")).agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_below", F.coalesce(F.sum("_c").over(below), F.lit(0))).drop("_c")
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_d", *key))
    # at most 65,536 buckets over all rows: a broadcast of a fixed size
    # the digest travels as bytes, half as long, in the same order
    return df.withColumns({"_d": F.unhex(digest), "_b": bucket}).join(counts if by else F.broadcast(counts), [*by, "_b"]).withColumn("number", (inside + F.col("_below") - 1).cast("long")).drop("_d", "_b", "_below")


def exact_quantiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: the exact quantile of each name's share, between two neighbours by linear interpolation; nulls are left out.

    Spark's own exact percentile merges all distinct values in one task; here only counts of buckets meet.
    """
    ranks = value_ranks(df, value).withColumn("_last", 2 * F.col("rank_avg") - F.col("rank_min") - 1)
    out = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("rank_n") - 1)
        # the first value whose rows reach this index (from 0), and the next index's
        low = F.min(F.when(F.col("_last") >= F.floor(at), F.col(value)))
        high = F.min(F.when(F.col("_last") >= F.ceil(at), F.col(value)))
        part = F.max(at) - F.floor(F.max(at))
        out.append((low + (high - low) * part).alias(name))
    return ranks.agg(*out)
