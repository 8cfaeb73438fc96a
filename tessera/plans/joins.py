"""Lookup, interval, semi, anti, band, sequence and distance joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.geometry import contact_counts
from ..operators.relational import difference_status, mutate, neighbour_in_other_fold, out_of_fold, spine
from ..sources.assay import ANNOTATED_SQL, ASSAY_SQL, FOLDS_SQL, assay, table
from .base import annotated, folded_table
from .registry import query

#: A small symbol scale and a pair score by rule: the test tables have no amino acids.
SCALE_SQL = "sc(sym, hyd) AS (VALUES ('F', 1.8::DOUBLE), ('O', -4.5), ('P', 2.5), ('1', 0.5), ('2', -0.7), ('3', 3.1), ('4', -3.9))"


def _scale(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("F", 1.8), ("O", -4.5), ("P", 2.5), ("1", 0.5), ("2", -0.7), ("3", 3.1), ("4", -3.9)], "sym string, hyd double")


@query(f"WITH {ANNOTATED_SQL} SELECT domain, count(*) AS n, min(pos) AS start_, max(pos) AS end_, avg(score) AS mean FROM full_ GROUP BY domain")
def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotated(spark, sf_dir, bins=False).groupBy("domain").agg(F.count("*").alias("n"), F.min("pos").alias("start_"), F.max("pos").alias("end_"), F.avg("score").alias("mean"))


@query(f"WITH {ASSAY_SQL}, {SCALE_SQL} SELECT row_id, w.hyd AS hyd_wt, m.hyd AS hyd_mt, m.hyd - w.hyd AS d_hyd, (ascii(wt_sym) * 7 + ascii(mt_sym) * 3) % 9 - 4 AS pair_score FROM assay LEFT JOIN sc w ON w.sym = wt_sym LEFT JOIN sc m ON m.sym = mt_sym")
def join_lookup_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    sc = F.broadcast(_scale(spark))
    w, m = sc.select(F.col("sym").alias("wt_sym"), F.col("hyd").alias("hyd_wt")), sc.select(F.col("sym").alias("mt_sym"), F.col("hyd").alias("hyd_mt"))
    df = assay(spark, sf_dir).join(w, "wt_sym", "left").join(m, "mt_sym", "left")
    return df.select("row_id", "hyd_wt", "hyd_mt", (F.col("hyd_mt") - F.col("hyd_wt")).alias("d_hyd"), ((F.ascii("wt_sym") * 7 + F.ascii("mt_sym") * 3) % 9 - 4).alias("pair_score"))


def _oof_sql(keys: list[str], fold: str) -> str:
    """Out-of-fold means by subtraction, for DuckDB."""
    out = []
    for k in keys:
        by = f"PARTITION BY {k}, " if k else "PARTITION BY "
        whole = f"(PARTITION BY {k})" if k else "()"
        out.append(f"(sum(score) OVER {whole} - sum(score) OVER ({by}{fold})) / nullif(count(*) OVER {whole} - count(*) OVER ({by}{fold}), 0)")
    return f"coalesce({', '.join(out)})"


@query(f"WITH {ANNOTATED_SQL}, {FOLDS_SQL} SELECT row_id, {_oof_sql(['pos', 'domain', ''], 'fold_random')} AS pred FROM folds")
def join_fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = folded_table(spark, sf_dir, "row_id", "pos", "domain", "score", "fold_random")
    for key, name in (("pos", "p1"), ("domain", "p2"), (None, "p3")):
        df = out_of_fold(df, key, "score", "fold_random", name)
    return df.select("row_id", F.coalesce("p1", "p2", "p3").alias("pred"))


@query(f"WITH {ASSAY_SQL}, e AS (SELECT vec_id, embedding FROM embeddings) SELECT row_id, embedding[CAST(mt_sym AS INTEGER)]::DOUBLE AS at_mt, embedding[CAST(mt_sym AS INTEGER)]::DOUBLE - embedding[ascii(wt_sym) - 60]::DOUBLE AS llr FROM assay JOIN e ON vec_id = pos % (SELECT max(vec_id) + 1 FROM embeddings)")
def join_array_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    df = assay(spark, sf_dir).join(F.broadcast(vectors.agg((F.max("vec_id") + 1).alias("_top")))).withColumn("_at", F.col("pos") % F.col("_top"))
    df = df.join(vectors, F.col("vec_id") == F.col("_at"))
    at = F.element_at("embedding", F.col("mt_sym").cast("int")).cast("double")
    return df.select("row_id", at.alias("at_mt"), (at - F.element_at("embedding", F.ascii("wt_sym") - 60).cast("double")).alias("llr"))


@query(f"WITH {ASSAY_SQL}, s AS (SELECT unnest(range(1, (SELECT max(pos) FROM assay) + 1)) AS pos), g AS (SELECT pos, count(*) AS n FROM assay WHERE wt_sym = 'P' GROUP BY pos) SELECT CAST(pos AS INTEGER) AS pos, coalesce(n, 0) AS n FROM s LEFT JOIN g USING (pos)")
def join_densify_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = assay(spark, sf_dir)
    g = df.where("wt_sym = 'P'").groupBy("pos").agg(F.count("*").alias("n"))
    return spine(df).join(g, "pos", "left").select("pos", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {ANNOTATED_SQL}, {FOLDS_SQL} SELECT row_id FROM folds a WHERE fold_random = 0 AND EXISTS (SELECT 1 FROM folds b WHERE b.fold_random <> 0 AND b.pos = a.pos)")
def join_semi_shared_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = folded_table(spark, sf_dir, "row_id", "pos", "fold_random")
    return df.where("fold_random = 0").join(df.where("fold_random <> 0").select("pos").distinct(), "pos", "left_semi").select("row_id")


@query(f"WITH {ANNOTATED_SQL}, {FOLDS_SQL}, fo AS MATERIALIZED (SELECT row_id, domain, fold_region FROM folds) SELECT row_id FROM fo WHERE fold_region = 3 AND domain IN (SELECT DISTINCT domain FROM fo WHERE fold_region <> 3)")
def join_semi_shared_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = folded_table(spark, sf_dir, "row_id", "domain", "fold_region")
    return df.where("fold_region = 3").join(df.where("fold_region <> 3").select("domain").distinct(), "domain", "left_semi").select("row_id")


@query(f"WITH {ANNOTATED_SQL}, {FOLDS_SQL}, k AS (SELECT DISTINCT pos, fold_region AS fold FROM folds) SELECT pos, fold, EXISTS (SELECT 1 FROM k b WHERE b.pos BETWEEN k.pos - 5 AND k.pos + 5 AND b.fold <> k.fold) AS near FROM k")
def join_band_other_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_in_other_fold(folded_table(spark, sf_dir, "pos", "fold_region"), "pos", "fold_region", 5)


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey AS c_custkey FROM orders WHERE o_orderstatus = 'P') USING (c_custkey)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT c_custkey, s_suppkey, c_nationkey, s_nationkey FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE c_nationkey <> s_nationkey")
def join_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.join(s, F.col("c_custkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey").select("c_custkey", "s_suppkey", "c_nationkey", "s_nationkey")


_SEQUENCES = "s AS (SELECT p_partkey, p_name AS ref, CAST(1 + p_partkey % 4 AS INTEGER) AS at_, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 1, p_partkey % 4) || '#' || substr(p_name, p_partkey % 4 + 2) WHEN 2 THEN p_name || 'x' WHEN 3 THEN '##' || substr(p_name, 3) ELSE '#' || substr(p_name, 2) END AS other FROM part)"


@query(f"WITH {_SEQUENCES}, d AS (SELECT *, list_filter(range(1, length(ref) + 1), lambda i: substr(ref, i, 1) <> substr(other, i, 1)) AS w FROM s), t AS (SELECT CASE WHEN length(ref) <> length(other) THEN 'wrong_length' WHEN len(w) = 0 THEN 'identical' WHEN len(w) > 1 THEN 'multiple' WHEN w[1] = at_ AND substr(other, at_, 1) = '#' THEN 'ok' ELSE 'inconsistent' END AS status FROM d) SELECT status, count(*) AS n FROM t GROUP BY status")
def join_sequence_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    p = table(spark, sf_dir, "part").withColumns({"ref": F.col("p_name"), "at_": (1 + key % 4).cast("int")})
    other = (
        F.when(key % 5 == 0, F.col("ref"))
        .when(key % 5 == 1, mutate(F.col("ref"), F.col("at_"), F.lit("#")))
        .when(key % 5 == 2, F.concat("ref", F.lit("x")))
        .when(key % 5 == 3, F.overlay("ref", F.lit("##"), 1, 2))
        .otherwise(mutate(F.col("ref"), F.lit(1), F.lit("#")))
    )
    return p.select(difference_status(F.col("ref"), other, F.col("at_"), F.lit("#")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {ASSAY_SQL}, {SCALE_SQL}, f AS (SELECT row_id, pred_a - pred_b AS f1 FROM assay), g AS (SELECT row_id, coalesce(hyd, 0) AS f2 FROM assay LEFT JOIN sc ON sym = mt_sym) SELECT row_id, f1, f2 FROM f JOIN g USING (row_id)")
def join_row_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = assay(spark, sf_dir)
    f = df.select("row_id", (F.col("pred_a") - F.col("pred_b")).alias("f1"))
    g = df.join(F.broadcast(_scale(spark)), F.col("sym") == F.col("mt_sym"), "left").select("row_id", F.coalesce("hyd", F.lit(0.0)).alias("f2"))
    return f.join(g, "row_id")


@query("WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings), d AS (SELECT a.vec_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d, b.label = a.label AS same FROM e a JOIN e b ON a.vec_id <> b.vec_id) SELECT vec_id, count(*) FILTER (WHERE d < 0.5 AND d > 0) AS n_near, count(*) FILTER (WHERE d < 1 AND d > 0) AS n_far FROM d GROUP BY vec_id")
def geom_contact_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    xyz = [(F.element_at("embedding", i + 1).cast("double") * 10).alias(c) for i, c in enumerate("xyz")]
    return contact_counts(table(spark, sf_dir, "embeddings").select("vec_id", *xyz), "vec_id", {"n_near": 0.5, "n_far": 1.0})


@query("WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), c AS (SELECT label AS other, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM e GROUP BY label), d AS (SELECT vec_id, label, other, sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) AS d FROM e, c) SELECT vec_id, min(d) FILTER (WHERE other = label) AS own, min(d) FILTER (WHERE other <> label) AS nearest_other, min(d) FILTER (WHERE other = label) - min(d) FILTER (WHERE other <> label) > 0 AS buried FROM d GROUP BY vec_id")
def geom_min_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate("xyz")])
    # the centres are one row: an array of at most as many as there are labels
    c = e.groupBy("label").agg(*[F.avg(a).alias(a) for a in "xyz"]).agg(F.collect_list(F.struct("label", "x", "y", "z")).alias("centres"))
    dist = lambda p: F.sqrt(F.pow(F.col("x") - p["x"], 2) + F.pow(F.col("y") - p["y"], 2) + F.pow(F.col("z") - p["z"], 2))
    e = e.join(F.broadcast(c))
    own = F.array_min(F.transform(F.filter("centres", lambda p: p["label"] == F.col("label")), dist))
    other = F.array_min(F.transform(F.filter("centres", lambda p: p["label"] != F.col("label")), dist))
    return e.select("vec_id", own.alias("own"), other.alias("nearest_other"), (own - other > 0).alias("buried"))
