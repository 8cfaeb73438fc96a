"""Models of aggregated units, and indicator columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.assay import ANNOTATED_SQL, ASSAY_SQL, DOMAINS, FOLDS, assay
from ..sources.shared import stored
from ..sources.text import LETTERS
from .base import annotated
from .registry import query

#: Positions that one unit spans.
LADDER = (1, 3, 5, 11, 25, 51, 137)
#: A fold's training set of fewer units gives no prediction.
LEAST = 5

_FLAGS = ", ".join(
    [f"CAST(substr('{LETTERS}', 1 + pos % 20, 1) = '{a}' AS INTEGER) AS wt_{a}" for a in LETTERS]
    + [f"CAST(substr('{LETTERS}', CAST(1 + row_id % 20 AS INTEGER), 1) = '{a}' AS INTEGER) AS mt_{a}" for a in LETTERS]
)


@query(f"WITH {ASSAY_SQL} SELECT row_id, {_FLAGS} FROM assay")
def project_symbol_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty flags: each of twenty symbols, before and after a change."""
    at = {"wt": 1 + F.col("pos") % 20, "mt": (1 + F.col("row_id") % 20).cast("int")}
    symbols = assay(spark, sf_dir).select("row_id", *[F.substring(F.lit(LETTERS), i, F.lit(1)).alias(s) for s, i in at.items()])
    return symbols.select("row_id", *[(F.col(s) == a).cast("int").alias(f"{s}_{a}") for s in at for a in LETTERS])


@query(f"WITH {ANNOTATED_SQL} SELECT row_id, {', '.join(f'CAST(fold_domain = {d} AS INTEGER) AS in_dom{d:02d}' for d in range(DOMAINS))} FROM full_")
def project_interval_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flag for each interval; a row outside all of them has none."""
    return annotated(spark, sf_dir, bins=False).select("row_id", *[(F.col("fold_domain") == d).cast("int").alias(f"in_dom{d:02d}") for d in range(DOMAINS)])


@query(f"WITH {ASSAY_SQL} SELECT row_id, pos, score FROM assay ORDER BY score DESC, row_id LIMIT 1")
def sort_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assay(spark, sf_dir).select("row_id", "pos", "score").orderBy(F.desc("score"), "row_id").limit(1)


def linear_out_of_fold(units: DataFrame, x: str, y: str, fold: str, by: str) -> DataFrame:
    """``pred`` of ``y`` by a straight line through ``x``, fitted for each ``by`` on all other folds.

    Sums of a fold are taken from those of all, so the table is read once; null for less than five training rows or an ``x`` without variance.
    """
    sums = units.groupBy(by, fold).agg(
        F.count("*").alias("n"), *[F.sum(c).alias(n) for n, c in {"sx": F.col(x), "sy": F.col(y), "sxx": F.col(x) * F.col(x), "sxy": F.col(x) * F.col(y)}.items()]
    )
    # as many rows as there are folds
    rest = sums.select(by, fold, *[(F.sum(c).over(Window.partitionBy(by)) - F.col(c)).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    slope = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    line = rest.where(F.col("n") >= LEAST).select(by, fold, slope.alias("_b"), F.try_divide("sx", "n").alias("_x"), F.try_divide("sy", "n").alias("_y"))
    return units.join(F.broadcast(line), [by, fold], "left").withColumn("pred", F.col("_y") + F.col("_b") * (F.col(x) - F.col("_x"))).drop("_b", "_x", "_y")


_UNITS = f"""u AS (SELECT w AS span, (pos - 1) // w AS unit, avg(pred_a) AS x, avg(score) AS y FROM assay, (SELECT unnest([{', '.join(map(str, LADDER))}]) AS w) GROUP BY ALL),
uf AS MATERIALIZED (SELECT *, CAST(least(floor((unit + 0.5::DOUBLE) * {FOLDS} / (max(unit) OVER (PARTITION BY span) + 1)), {FOLDS - 1}) AS INTEGER) AS fold FROM u)"""


@query(f"WITH {ASSAY_SQL}, {_UNITS}, tr AS (SELECT a.span, k.f AS fold, count(*) AS n, regr_slope(y, x) AS b, avg(x) AS mx, avg(y) AS my FROM uf a, range(0, {FOLDS}) k(f) WHERE a.fold <> k.f GROUP BY ALL HAVING count(*) >= {LEAST}) SELECT uf.span, unit, uf.fold, y AS target, round(my + b * (x - mx), 3) AS pred FROM uf LEFT JOIN tr ON tr.span = uf.span AND tr.fold = uf.fold")
def model_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of ever wider units, predicted out of fold (folds are regions of the axis)."""
    rows = assay(spark, sf_dir).withColumn("span", F.explode(F.array(*[F.lit(w) for w in LADDER])))
    units = rows.groupBy("span", F.floor((F.col("pos") - 1) / F.col("span")).cast("int").alias("unit")).agg(F.avg("pred_a").alias("x"), F.avg("score").alias("target"))
    units = stored(units, "units")
    top = F.broadcast(units.groupBy("span").agg(F.max("unit").alias("top")))
    fold = F.least(F.floor((F.col("unit") + 0.5) * FOLDS / (F.col("top") + 1)), F.lit(FOLDS - 1)).cast("int")
    units = units.join(top, "span").withColumn("fold", fold).drop("top")
    return linear_out_of_fold(units, "x", "target", "fold", "span").select("span", "unit", "fold", "target", F.round("pred", 3).alias("pred"))
