"""Ladders over feature vectors: what a channel of features predicts of ever wider units, and what one channel adds to another."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import columns_of, groups_of
from ..operators.ladder import DRAWS, NULLS, READABLE, interval, ladder_metrics, ridge_ladder, unit_vectors, window_unit_draws, with_ceiling, with_shuffled_targets, with_unit_folds
from ..operators.models import ridge_out_of_fold
from ..sources.assay import ANNOTATED_SQL, DOMAINS
from ..sources.shared import stored
from .design import _design_sql, design
from .registry import query
from .reliability import WINDOWS, stat_split_half_windows
from .scores import metric_bundle

#: Columns of other groups that say something of a position, not of a change there.
NAMED = ("wt_hyd", "wt_vol", "wt_chg", "wt_pol")


def channel(df: DataFrame, groups: Sequence[str] = ("position",), named: Sequence[str] = NAMED) -> list[str]:
    """Columns of the groups that the table has, and the named ones, in the schema's order."""
    keep = {*columns_of(df, [g for g in groups if g in groups_of(df)]), *named}
    if gone := set(named) - set(df.columns):
        raise ValueError(f"unknown columns {sorted(gone)}")
    return [c for c in df.columns if c in keep]


_CHANNEL = ["rel_pos", "pos_abs", "is_core", *[f"dom_{d:02d}" for d in range(DOMAINS)], *NAMED]


@query(
    f"WITH {ANNOTATED_SQL}, dz AS MATERIALIZED (WITH {_design_sql()}) "
    f"SELECT CAST(w AS INTEGER) AS window_size, CAST((pos - 1) // w AS INTEGER) AS unit, count(*) AS n, avg(score) AS target, {', '.join(f'avg({c}) AS {c}' for c in _CHANNEL)} "
    f"FROM dz JOIN assay USING (row_id), (VALUES {', '.join(f'({w})' for w in WINDOWS)}) t(w) GROUP BY ALL"
)
def agg_unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the target and of eighteen features over the rows of each unit, for seven widths."""
    df = design(spark, sf_dir, signal=False, schemes=(), bins=False)
    names = channel(df)
    units = unit_vectors(df, WINDOWS, "score", names)
    return units.select("window_size", "unit", "n", F.col("y").alias("target"), *[F.col("x")[i].alias(c) for i, c in enumerate(names)])


def dealt_units(df: DataFrame, features: Sequence[str], windows: Sequence[int] = WINDOWS, nulls: int = NULLS) -> DataFrame:
    """Units of each width with folds and shuffled targets, stored."""
    units = stored(unit_vectors(df, windows, "score", features), "units")
    return stored(with_shuffled_targets(with_unit_folds(units), nulls), "units")


def fitted_ladder(units: DataFrame) -> DataFrame:
    """What a ridge predicts of the units of each width, stored."""
    return stored(ridge_ladder(units).drop("x"), "fitted")


def _reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven rows, stored."""
    return stored(stat_split_half_windows(spark, sf_dir).select("window_size", "split_half_r", F.col("spearman_brown").alias("reliability")), "reliability")


def single_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The ladder's anchor, width 0: rows as they are, by position."""
    fitted = ridge_out_of_fold(df.select("pos", "score", "bin", "fold_position", *features), features, "score", "fold_position")
    m = metric_bundle(stored(fitted.select("score", "bin", "pred", F.lit(0).alias("window_size")), "single"), ["window_size"])
    return m.select("window_size", F.col("n").alias("n_units"), F.lit(1.0).alias("mean_rows_a_unit"), "spearman", "pearson")


@query()
def stat_feature_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold correlations of each width by blocks, their null of 20 refits, random folds, and the reliability's ceiling."""
    df = design(spark, sf_dir, signal=False, schemes=("position",))
    names = channel(df)
    df = stored(df.select("pos", "score", "bin", "fold_position", *names), "design")
    out = with_ceiling(ladder_metrics(fitted_ladder(dealt_units(df, names))), _reliability(spark, sf_dir))
    return out.unionByName(single_rows(df, names), allowMissingColumns=True)


def channel_ladders(df: DataFrame, channels: Mapping[str, Sequence[str]], baseline: str, windows: Sequence[int] = WINDOWS, nulls: int = NULLS, draws: int = DRAWS) -> DataFrame:
    """A row for each channel and width; from `READABLE` units on, other channels have a paired difference to the baseline's correlation."""
    spark = df.sparkSession
    every = list(dict.fromkeys(f for names in channels.values() for f in names))
    # units, folds and shuffled targets are the same in all channels
    units = dealt_units(df, every, windows, nulls)
    fitted = {c: fitted_ladder(units.withColumn("x", F.array(*[F.col("x")[every.index(f)] for f in names]))) for c, names in channels.items()}
    out, gains = None, []
    for c, f in fitted.items():
        part = ladder_metrics(f).withColumn("channel", F.lit(c))
        out = part if out is None else out.unionByName(part)
    out = stored(out, "ladders")
    readable = [r["window_size"] for r in out.where(F.col("n_units") >= READABLE).select("window_size").distinct().collect()]  # one row a width
    keys, base = ["window_size", "unit"], fitted[baseline]
    for c in fitted:
        if c != baseline and readable:
            both = fitted[c].select(*keys, "y", F.col("preds")[0].alias("a")).join(base.select(*keys, F.col("preds")[0].alias("b")), keys)
            found = window_unit_draws(both.where(F.col("window_size").isin(readable)), "y", "a", "b", draws)
            gains += [(c, w, *interval(found.get(w, np.zeros(0)))) for w in sorted(readable)]
    table = F.broadcast(spark.createDataFrame(gains, "channel string, window_size int, n_draws long, delta_lo double, delta_hi double, delta_p double"))
    level = F.broadcast(out.where(F.col("channel") == baseline).select("window_size", F.col("pearson").alias("_b")))
    delta = F.when(F.col("n_draws").isNotNull(), F.col("pearson") - F.col("_b"))
    return out.join(level, "window_size", "left").join(table, ["channel", "window_size"], "left").withColumn("delta_vs_baseline", delta).drop("_b")


@query()
def stat_feature_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position's channel with and without signals at each width, with paired intervals of 2,000 draws of units."""
    df = design(spark, sf_dir, schemes=(), bins=False)
    channels = {"position": channel(df), "position_signal": channel(df, ("position", "signal"))}
    names = dict.fromkeys(f for c in channels.values() for f in c)
    ladders = channel_ladders(stored(df.select("pos", "score", *names), "design"), channels, "position")
    return with_ceiling(ladders, _reliability(spark, sf_dir).drop("split_half_r"))
