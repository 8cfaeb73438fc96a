"""The annotated fact table that most queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import exact_quantiles
from ..operators import folds
from ..operators.relational import annotate_interval
from ..sources.assay import DOMAINS, assay, domains
from ..sources.shared import stored


def with_bin(df: DataFrame, base: DataFrame) -> DataFrame:
    """Adds ``bin``: whether the score is above the exact median of ``base``, the same rows with fewer steps behind them."""
    median = F.broadcast(exact_quantiles(base, "score", {"_m": 0.5}))  # one row
    return df.join(median).withColumn("bin", (F.col("score") > F.col("_m")).cast("int")).drop("_m")


def annotated(spark: SparkSession, sf_dir: str, bins: bool = True) -> DataFrame:
    """The assay with ``domain``, ``fold_domain`` and, as it costs a pass of its own, ``bin`` where it is read."""
    base = assay(spark, sf_dir)
    df = annotate_interval(base, domains(spark, sf_dir)).withColumn("fold_domain", F.coalesce("ordinal", F.lit(DOMAINS)).cast("int")).drop("ordinal")
    return with_bin(df, base) if bins else df


def folded(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The annotated assay with folds; if columns are named, with those folds, and the bin, that are among them."""
    asked = lambda c: not columns or c in columns
    df, base = annotated(spark, sf_dir, asked("bin")), assay(spark, sf_dir)
    for scheme in ("random", "position", "region"):
        if asked(f"fold_{scheme}"):
            df = folds.assign(df, scheme, base=base)
    return df


def folded_table(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the folded assay (all, if none are named), stored: for queries that read it several times."""
    return stored(folded(spark, sf_dir, *columns).select(*(columns or ["*"])), "folds")
