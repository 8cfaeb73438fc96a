"""The fact table of grouped, position-indexed measurements, and its dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOMAINS = 11
FOLDS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def draw(*parts: str | Column) -> Column:
    """A reproducible integer in [0, 2**32): the first eight hex digits of an md5 over the joined parts."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 8), 16, 10).cast("long")


def assay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, pos, score, wt_sym, mt_sym, pred_a, pred_b, pred_c``: a noisy, a coarse and a constant prediction."""
    orders = table(spark, sf_dir, "orders")
    score = F.col("o_totalprice")
    return orders.select(
        F.col("o_orderkey").alias("row_id"),
        (F.col("o_custkey") + 1).cast("int").alias("pos"),
        score.alias("score"),
        F.col("o_orderstatus").alias("wt_sym"),
        F.substring("o_orderpriority", 1, 1).alias("mt_sym"),
        (0.3 * score + draw("n", F.col("o_orderkey")) / 4294967296.0 * 200000).alias("pred_a"),
        F.floor(score / 50000).cast("double").alias("pred_b"),
        F.lit(1.0).alias("pred_c"),
    )


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``name, lo, hi``: eleven disjoint intervals over the positions; the last fiftieth of them stays outside."""
    top = F.expr("max(o_custkey) + 1 - (max(o_custkey) + 1) div 50")
    m = table(spark, sf_dir, "orders").agg(top.cast("long").alias("m"))
    d = m.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(DOMAINS - 1))))
    return d.select(
        F.format_string("dom%02d", "d").alias("name"),
        (F.expr(f"d * m div {DOMAINS}") + 1).cast("int").alias("lo"),
        F.expr(f"(d + 1) * m div {DOMAINS}").cast("int").alias("hi"),
        F.col("d").alias("ordinal"),
    )


# The same as DuckDB common table expressions.
ASSAY_SQL = """assay AS (SELECT o_orderkey AS row_id, CAST(o_custkey + 1 AS INTEGER) AS pos, o_totalprice AS score,
  o_orderstatus AS wt_sym, substr(o_orderpriority, 1, 1) AS mt_sym,
  0.3::DOUBLE * o_totalprice + ('0x' || substr(md5('n:' || o_orderkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 200000 AS pred_a,
  CAST(floor(o_totalprice / 50000) AS DOUBLE) AS pred_b, 1.0::DOUBLE AS pred_c FROM orders)"""
DOMAINS_SQL = f"""dom AS (SELECT printf('dom%02d', d) AS name, CAST((d * m) // {DOMAINS} + 1 AS INTEGER) AS lo,
  CAST(((d + 1) * m) // {DOMAINS} AS INTEGER) AS hi, CAST(d AS INTEGER) AS ordinal
  FROM (SELECT max(o_custkey) + 1 - (max(o_custkey) + 1) // 50 AS m FROM orders), range(0, {DOMAINS}) t(d))"""
ANNOTATED_SQL = f"""{ASSAY_SQL}, {DOMAINS_SQL},
ann AS (SELECT a.*, coalesce(name, 'UNANNOTATED') AS domain, coalesce(ordinal, {DOMAINS}) AS fold_domain FROM assay a LEFT JOIN dom ON pos BETWEEN lo AND hi),
med AS (SELECT median(score) AS m FROM assay),
full_ AS (SELECT ann.*, CAST(score > m AS INTEGER) AS bin FROM ann, med)"""
# Fold schemes; ``folds`` needs ``full_``.
FOLDS_SQL = f"""rnd AS (SELECT row_id, CAST((row_number() OVER (ORDER BY md5('r:' || row_id), row_id) - 1) % {FOLDS} AS INTEGER) AS fold_random FROM assay),
grp AS (SELECT pos, CAST((row_number() OVER (ORDER BY md5('p:' || pos), pos) - 1) % {FOLDS} AS INTEGER) AS fold_position FROM (SELECT DISTINCT pos FROM assay)),
ext AS (SELECT min(pos) AS lo, max(pos) AS hi FROM assay),
folds AS (SELECT f.*, fold_random, fold_position,
  CAST(least(floor((pos - lo + 0.5::DOUBLE) * {FOLDS} / (hi - lo + 1)), {FOLDS - 1}) AS INTEGER) AS fold_region
  FROM full_ f JOIN rnd USING (row_id) JOIN grp USING (pos), ext)"""
