"""Fold schemes and leakage between folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranks import shuffled_number
from ..sources.assay import DOMAINS, FOLDS
from .relational import on_axis

SCHEMES = ("random", "position", "region", "domain")
#: What a bootstrap draws under each scheme.
BOOTSTRAP_UNIT = {"random": "pos", "position": "pos", "region": "fold_region", "domain": "fold_domain"}


def assign(df: DataFrame, scheme: str, k: int = FOLDS, base: DataFrame | None = None) -> DataFrame:
    """Adds ``fold_{scheme}``: balanced over rows, balanced over positions, equal-width regions, or intervals.

    Counts and ranges are taken from ``base``, if given: the same rows with fewer steps behind them.
    """
    base = df if base is None else base
    name = f"fold_{scheme}"
    if scheme == "random":
        return shuffled_number(df, F.md5(F.concat(F.lit("r:"), F.col("row_id").cast("string"))), "row_id", base=base).withColumn(name, (F.col("number") % k).cast("int")).drop("number")
    if scheme == "position":
        keys = shuffled_number(base.select("pos").distinct(), F.md5(F.concat(F.lit("p:"), F.col("pos").cast("string"))), "pos")
        return df.join(keys.select("pos", (F.col("number") % k).cast("int").alias(name)), "pos")
    if scheme == "region":
        ends = base.agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
        bucket = F.floor((F.col("pos") - F.col("_lo") + 0.5) * k / (F.col("_hi") - F.col("_lo") + 1))
        return df.join(F.broadcast(ends)).withColumn(name, F.least(bucket, F.lit(k - 1)).cast("int")).drop("_lo", "_hi")
    if scheme == "domain":
        return df.withColumn(name, F.coalesce("ordinal", F.lit(DOMAINS)).cast("int"))
    raise ValueError(f"unknown scheme: {scheme}")


def leakage(df: DataFrame, fold: str, reach: int = 5) -> DataFrame:
    """One row: test sizes, and unweighted fold means of the shares of rows with a shared position, a near one, or a shared domain in training."""
    # folds at a position, and around it, are more than one's own where the least or the greatest is another
    counts = df.where(F.col("pos").isNotNull() & F.col(fold).isNotNull()).groupBy("pos", F.col(fold).alias("_f"), "domain").agg(F.count("*").alias("_n"))
    per_pos = counts.groupBy("pos").agg(F.min("_f").alias("_lo"), F.max("_f").alias("_hi"), F.collect_list(F.struct("_f", "domain", "_n")).alias("_rows"))
    around = lambda f, c: lambda axis: f(c).over(axis.rangeBetween(-reach, reach))
    axis = on_axis(per_pos, reach, {"_near_lo": around(F.min, "_lo"), "_near_hi": around(F.max, "_hi")})
    rows = axis.select(F.inline("_rows"), (F.col("_lo") != F.col("_hi")).alias("_shared"), "_near_lo", "_near_hi")
    near = (F.col("_near_lo") != F.col("_f")) | (F.col("_near_hi") != F.col("_f"))
    rows_where = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0))
    parts = rows.groupBy("_f", "domain").agg(F.sum("_n").alias("_n"), rows_where(F.col("_shared")).alias("_shared"), rows_where(near).alias("_near"))
    of_domain = Window.partitionBy("domain")
    parts = parts.where("domain is not null").withColumn("_other", F.min("_f").over(of_domain) != F.max("_f").over(of_domain))
    n = F.sum("_n")
    folds = parts.groupBy("_f").agg(n.alias("n"), (F.sum("_shared") / n).alias("shared"), (F.sum("_near") / n).alias("near"), (rows_where(F.col("_other")) / n).alias("domain"))
    return folds.agg(
        F.count("*").alias("n_folds"),
        F.min("n").alias("n_test_min"),
        F.max("n").alias("n_test_max"),
        F.avg("shared").alias("shared_position_rate"),
        F.avg("near").alias("neighbour_within_5_rate"),
        F.avg("domain").alias("same_domain_rate"),
    )
