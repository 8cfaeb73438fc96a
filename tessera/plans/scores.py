"""Metrics of predictions, label checks, aggregation ladders and feature screens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranks import add_ranks, exact_quantiles, ranked, value_ranks
from ..functions.stats import order_free_sum, paired_ranks, pearson, pearson_sql
from ..operators.relational import out_of_fold
from ..operators.bootstrap import REPS, bootstrap_sql, rank_correlations
from ..operators.reliability import icc, percentile_interval
from ..sources.assay import ANNOTATED_SQL, ASSAY_SQL, DOMAINS, FOLDS, FOLDS_SQL, assay, table
from ..sources.shared import stored
from .base import annotated, folded, folded_table
from .registry import query

PREDS = ("pred_a", "pred_b", "pred_c")


def long_predictions(df: DataFrame, *keep: str) -> DataFrame:
    """``row_id, score, bin, model, pred``: one row a prediction; ``df`` is stored, as metrics read it several times."""
    wide = stored(df.select("row_id", "score", "bin", *keep, *PREDS), "predictions")
    return wide.unpivot(["row_id", "score", "bin", *keep], list(PREDS), "model", "pred")


def with_score_ranks(wide: DataFrame, preds: list[str]) -> DataFrame:
    """``wide``, stored, with average ranks ``ry`` of the score, where these hold for each prediction: where none is missing."""
    rows = stored(wide.join(value_ranks(wide, "score", prefix="ry").select("score", F.col("ry_avg").alias("ry")), "score"), "ranked")
    missing = rows.agg(*[F.count_if(F.col(f"`{p}`").isNull()).alias(f"n{i}") for i, p in enumerate(preds)]).first()
    return rows.drop("ry") if any(missing) else rows


def metric_bundle(long: DataFrame, by: list[str]) -> DataFrame:
    """Spearman, Pearson and AUROC for each group; a constant prediction has 0, 0 and 0.5.

    A prediction's rank belongs to its value, so rows are summed to values first and meet no table of ranks. ``ry``, if it is
    there, are the score's ranks within each group.
    """
    df = long.where(F.col("score").isNotNull() & F.col("pred").isNotNull())
    if "ry" not in df.columns:
        df = df.join(value_ranks(df, "score", by, "ry").select(*by, "score", F.col("ry_avg").alias("ry")), [*by, "score"])
    values = df.groupBy(*by, "pred").agg(
        F.count("*").alias("_c"), F.avg("score").alias("m"), F.var_pop("score").alias("v"), F.sum("ry").alias("s1"), F.sum(F.col("ry") * F.col("ry")).alias("s2"),
        F.sum("bin").alias("pos"), F.count_if(F.col("bin") == 1).alias("ones"), *[f(c).alias(f"{c}_{f.__name__}") for c in ("score", "ry") for f in (F.min, F.max)],
    )
    c = F.col("_c")
    # a row a group
    means = values.groupBy(*by).agg((F.sum(c * F.col("pred")) / F.sum(c)).alias("mp"), (F.sum(c * F.col("m")) / F.sum(c)).alias("ms"), ((F.sum(c) + 1) / 2).alias("mr"))
    rows = ranked(values, "pred", by, "rp").join(F.broadcast(means), by).withColumn("rp", F.col("rp_avg"))
    dp, ds, dr = F.col("pred") - F.col("mp"), F.col("m") - F.col("ms"), F.col("rp") - F.col("mr")
    lone = F.min("pred") == F.max("pred")
    vp, vs = F.sum(c * dp * dp), F.sum(c * (F.col("v") + ds * ds))
    vr, vy = F.sum(c * dr * dr), F.sum(F.col("s2") - 2 * F.col("mr") * F.col("s1") + c * F.col("mr") * F.col("mr"))
    rho = F.when(~(lone | (F.min("ry_min") == F.max("ry_max"))), F.try_divide(F.sum(dr * (F.col("s1") - c * F.col("mr"))), F.sqrt(vr) * F.sqrt(vy)))
    r = F.when(~(lone | (F.min("score_min") == F.max("score_max"))), F.try_divide(F.sum(c * ds * dp), F.sqrt(vs) * F.sqrt(vp)))
    n, pos = F.sum(c), F.sum("pos").cast("double")
    au = F.try_divide(F.sum(F.when(F.col("ones") > 0, F.col("ones") * F.col("rp"))) - pos * (pos + 1) / 2, pos * (n - pos))
    g = rows.groupBy(*by).agg(n.alias("n"), F.when(lone, 0.0).otherwise(F.sqrt(vp / n)).alias("sd"), rho.alias("rho"), r.alias("r"), au.alias("au"))
    flat = F.col("sd") <= 1e-8
    return g.select(*by, "n", F.when(flat, 0.0).otherwise(F.col("rho")).alias("spearman"), F.when(flat, 0.0).otherwise(F.col("r")).alias("pearson"), F.when(flat, 0.5).otherwise(F.col("au")).alias("auroc"))


def wide_metrics(df: DataFrame, preds: Sequence[str], cluster: str, reps: int = 0, fold: str | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The metrics of `metric_bundle` for columns of a stored table, from one order of each column that serves all of them.

    Three small tables: ``model, n, spearman, pearson, auroc``; ``model, fold, n, spearman`` of each fold, if one is named (whole
    numbers, at most as many as there are domains); and ``model, rep, r`` of each draw of clusters. A prediction has a value in
    each row with a score.
    """
    spark, y = df.sparkSession, F.col("score").cast("double")
    ranks = stored(rank_correlations(df, "score", preds, cluster, reps, part=fold, parts=max(FOLDS, DOMAINS + 1) if fold else 0, ones="bin"), "ranks")

    def moments(p: str) -> Column:
        x = F.when(y.isNotNull(), F.col(f"`{p}`").cast("double"))
        return F.struct(F.lit(p).alias("model"), F.count(x).alias("n"), (F.stddev_pop(x) <= 1e-8).alias("_flat"), pearson(x, y).alias("_r"))

    each = F.array(*[moments(p) for p in preds]).alias("_m")
    flat = lambda value, c: F.when(F.col("_flat"), value).otherwise(F.col(c))
    # a row a prediction, or a prediction and fold
    points = df.agg(each).select(F.inline("_m")).where("n > 0").join(F.broadcast(ranks.where("rep = -1").select("model", "r", "auc")), "model", "left")
    points = points.select("model", "n", flat(0.0, "r").alias("spearman"), flat(0.0, "_r").alias("pearson"), flat(0.5, "auc").alias("auroc"))
    folds_ = None
    if fold:
        folds_ = df.groupBy(F.col(fold).cast("int").alias("fold")).agg(each).select("fold", F.inline("_m")).where("n > 0")
        of_fold = ranks.where("rep < -1").select("model", (-2 - F.col("rep")).alias("fold"), "r")
        folds_ = folds_.join(F.broadcast(of_fold), ["model", "fold"], "left").select("model", "fold", "n", flat(0.0, "r").alias("spearman"))
    return points, folds_, ranks.where("rep >= 0").select("model", "rep", "r")


_LONG = "lg AS (" + " UNION ALL ".join(f"SELECT row_id, score, bin, '{p}' AS model, {p} AS pred FROM full_" for p in PREDS) + ")"


def _metrics_sql(by: str) -> str:
    rank = lambda c: f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0::DOUBLE"
    return f"""rk AS (SELECT *, {rank('score')} AS ry, {rank('pred')} AS rp FROM lg),
mb AS (SELECT {by}, count(*) AS n, CASE WHEN stddev_pop(pred) <= 1e-8 THEN 0.0::DOUBLE ELSE {pearson_sql('ry', 'rp')} END AS spearman,
  CASE WHEN stddev_pop(pred) <= 1e-8 THEN 0.0::DOUBLE ELSE {pearson_sql('score', 'pred')} END AS pearson,
  CASE WHEN stddev_pop(pred) <= 1e-8 THEN 0.5::DOUBLE ELSE (sum(rp) FILTER (WHERE bin = 1) - sum(bin) * (sum(bin) + 1) / 2) / nullif(sum(bin)::DOUBLE * (count(*) - sum(bin)), 0) END AS auroc FROM rk GROUP BY {by})"""


@query(f"WITH {ANNOTATED_SQL}, {_LONG}, {_metrics_sql('model')} SELECT * FROM mb")
def stat_metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = with_score_ranks(annotated(spark, sf_dir).select("row_id", "score", "bin", *PREDS), list(PREDS))
    keep = [c for c in wide.columns if c not in PREDS]
    return metric_bundle(wide.unpivot(keep, list(PREDS), "model", "pred"), ["model"])


_LONG_FOLD = "lg AS (" + " UNION ALL ".join(f"SELECT row_id, score, bin, fold_position AS fold, '{p}' AS model, {p} AS pred FROM folds" for p in PREDS) + ")"


@query(f"WITH {ANNOTATED_SQL}, {FOLDS_SQL}, {_LONG_FOLD}, {_metrics_sql('model, fold')} SELECT * FROM mb")
def stat_per_fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_bundle(long_predictions(folded(spark, sf_dir, "fold_position", "bin").withColumnRenamed("fold_position", "fold"), "fold"), ["model", "fold"])


@query(f"WITH {ANNOTATED_SQL}, {FOLDS_SQL}, {_LONG_FOLD}, {_metrics_sql('model, fold')}, pool AS (SELECT model, {pearson_sql('ry', 'rp')} AS pooled FROM (SELECT model, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0::DOUBLE AS ry, rank() OVER (PARTITION BY model ORDER BY pred) + (count(*) OVER (PARTITION BY model, pred) - 1) / 2.0::DOUBLE AS rp FROM lg) GROUP BY model), {bootstrap_sql('folds', 'pos', ('pred_a', 'pred_b'))}, ci AS (SELECT model, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM (UNPIVOT st ON pred_a, pred_b INTO NAME model VALUE r) GROUP BY model) SELECT model, coalesce(any_value(pooled), 0) AS pooled_spearman, any_value(ci.lo) AS spearman_ci_lo, any_value(ci.hi) AS spearman_ci_hi, avg(spearman) AS per_fold_spearman_mean, stddev_pop(spearman) AS per_fold_spearman_sd, sum(n)::BIGINT AS n, count(*) AS n_folds FROM mb JOIN pool USING (model) LEFT JOIN ci USING (model) GROUP BY model")
def stat_summary_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled metrics of each prediction with the interval over draws of positions, and their mean over folds."""
    df = folded_table(spark, sf_dir, "pos", "score", "bin", *PREDS, "fold_position")
    points, per_fold, draws = wide_metrics(df, PREDS, "pos", REPS, "fold_position")
    ci = percentile_interval(draws, "r", ["model"]).select("model", F.col("lo").alias("spearman_ci_lo"), F.col("hi").alias("spearman_ci_hi"))
    pooled = points.select("model", F.coalesce("spearman", F.lit(0.0)).alias("pooled_spearman"))
    macro = per_fold.groupBy("model").agg(
        F.avg("spearman").alias("per_fold_spearman_mean"), F.stddev_pop("spearman").alias("per_fold_spearman_sd"), F.sum("n").alias("n"), F.count("*").alias("n_folds")
    )
    return pooled.join(macro, "model").join(ci, "model", "left")


@query(f"WITH {ANNOTATED_SQL}, {_LONG}, k AS (SELECT greatest(CAST(round_even(0.05::DOUBLE * count(*), 0) AS BIGINT), 1) AS k, count(*) AS n FROM full_), o AS (SELECT model, row_number() OVER (PARTITION BY model ORDER BY pred DESC, row_id) AS rp, row_number() OVER (PARTITION BY model ORDER BY score DESC, row_id) AS rt FROM lg) SELECT model, any_value(k) AS k, CASE WHEN any_value(k) < any_value(n) THEN avg(CAST(rt <= k AS INTEGER)) FILTER (WHERE rp <= k) END AS precision_at_5pct FROM o, k GROUP BY model")
def stat_precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = long_predictions(annotated(spark, sf_dir))
    k = long.groupBy("model").agg(F.greatest(F.bround(F.count("*") * 0.05, 0).cast("long"), F.lit(1)).alias("k"), F.count("*").alias("n"))
    # only the rows at or above the k-th value can be in a top k: bucketed ranks find them, ties go by row_id
    neg = long.withColumns({"_p": -F.col("pred"), "_t": -F.col("score")}).join(F.broadcast(k), "model")

    def top(c: str) -> DataFrame:
        near = add_ranks(neg, c, ["model"], "x").where("x_min <= k")
        return near.withColumn("r", F.row_number().over(Window.partitionBy("model").orderBy(c, "row_id"))).where("r <= k").select("model", "row_id")

    both = top("_p").join(top("_t").withColumn("hit", F.lit(1)), ["model", "row_id"], "left")
    share = both.groupBy("model").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("p"))
    return k.join(share, "model").select("model", "k", F.when(F.col("k") < F.col("n"), F.col("p")).alias("precision_at_5pct"))


@query(f"WITH {ASSAY_SQL} SELECT 'pred_a' AS a, 'pred_b' AS b, {pearson_sql('pred_a', 'pred_b')} AS r FROM assay UNION ALL SELECT 'score', 'pred_a', {pearson_sql('score', 'pred_a')} FROM assay UNION ALL SELECT 'score', 'pred_b', {pearson_sql('score', 'pred_b')} FROM assay UNION ALL SELECT 'score', 'pred_c', {pearson_sql('score', 'pred_c')} FROM assay")
def stat_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [("pred_a", "pred_b"), ("score", "pred_a"), ("score", "pred_b"), ("score", "pred_c")]
    one = assay(spark, sf_dir).agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), pearson(a, b).alias("r")) for a, b in pairs]).alias("p"))
    return one.select(F.inline("p"))


@query("WITH l AS (SELECT vec_id, label::DOUBLE AS y, i AS feature, embedding[i]::DOUBLE AS x FROM embeddings, range(1, (SELECT max(len(embedding)) FROM embeddings) + 1) t(i) WHERE i <= len(embedding)), r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0::DOUBLE AS ry FROM l) SELECT CAST(feature AS INTEGER) AS feature, " + pearson_sql("rx", "ry") + " AS rho, count(*) AS n FROM r GROUP BY feature HAVING count(*) >= 50")
def stat_feature_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("double").alias("y"), F.posexplode("embedding").alias("p", "v"))
    e = e.select("vec_id", "y", (F.col("p") + 1).alias("feature"), F.col("v").cast("double").alias("x"))
    return paired_ranks(e, "y", "x", ["feature"]).groupBy("feature").agg(pearson("rp", "ry").alias("rho"), F.count("*").alias("n")).where("n >= 50")


@query(f"WITH {ANNOTATED_SQL}, {FOLDS_SQL}, lg AS (SELECT row_id, score, bin, 'train_mean' AS model, fold_region AS fold, ((SELECT sum(score) FROM folds) - sum(score) OVER (PARTITION BY fold_region)) / ((SELECT count(*) FROM folds) - count(*) OVER (PARTITION BY fold_region)) AS pred FROM folds), {_metrics_sql('model')} SELECT model, spearman AS pooled_spearman, 0.0::DOUBLE AS per_fold_spearman FROM mb")
def stat_constant_artefact(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = folded_table(spark, sf_dir, "row_id", "score", "bin", "fold_region")
    df = out_of_fold(df, None, "score", "fold_region", "pred").withColumn("model", F.lit("train_mean"))
    pooled = metric_bundle(df, ["model"]).select("model", F.col("spearman").alias("pooled_spearman"))
    folds_ = metric_bundle(df, ["model", "fold_region"]).groupBy("model").agg(F.avg("spearman").alias("per_fold_spearman"))
    return pooled.join(folds_, "model")


@query(f"WITH {ASSAY_SQL}, k(pos, annotation) AS (VALUES (10, 'a'), (20, 'a'), (31, 'b'), (77, 'b'), (102, 'c')), e AS (SELECT pos, score, (rank() OVER (ORDER BY score) - 1) / (count(*) OVER ())::DOUBLE AS pct FROM assay) SELECT pos, annotation, count(score) AS n, avg(score) AS mean_score, min(score) AS min_score, avg(pct) AS mean_percentile, min(pct) AS min_percentile FROM k LEFT JOIN e USING (pos) GROUP BY ALL")
def stat_label_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame([(10, "a"), (20, "a"), (31, "b"), (77, "b"), (102, "c")], "pos int, annotation string")
    e = add_ranks(assay(spark, sf_dir), "score", prefix="s").withColumn("pct", (F.col("s_min") - 1) / F.col("s_n"))
    rows = keys.join(e.join(F.broadcast(keys.select("pos")), "pos", "left_semi"), "pos", "left")
    return rows.groupBy("pos", "annotation").agg(F.count("score").alias("n"), F.avg("score").alias("mean_score"), F.min("score").alias("min_score"), F.avg("pct").alias("mean_percentile"), F.min("pct").alias("min_percentile"))


@query(f"WITH {ANNOTATED_SQL} SELECT (SELECT m FROM med) AS median, count(*) FILTER (WHERE bin = 1) AS n_above, bool_and((score > (SELECT m FROM med)) = (bin = 1)) AS consistent FROM full_")
def stat_median_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = annotated(spark, sf_dir)
    return df.join(F.broadcast(exact_quantiles(assay(spark, sf_dir), "score", {"m": 0.5}))).agg(F.max("m").alias("median"), F.count_if(F.col("bin") == 1).alias("n_above"), F.bool_and((F.col("score") > F.col("m")) == (F.col("bin") == 1)).alias("consistent"))


_LADDER_W = (1, 3, 5, 11, 25, 51, 137)


@query(f"WITH {ASSAY_SQL}, un AS (SELECT CAST(w AS INTEGER) AS window_size, (pos - 1) // w AS unit, avg(score) AS y, avg(pred_a) AS a, count(*) AS k FROM assay, (VALUES {', '.join(f'({w})' for w in _LADDER_W)}) t(w) GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY window_size ORDER BY y) + (count(*) OVER (PARTITION BY window_size, y) - 1) / 2.0::DOUBLE AS ry, rank() OVER (PARTITION BY window_size ORDER BY a) + (count(*) OVER (PARTITION BY window_size, a) - 1) / 2.0::DOUBLE AS ra FROM un) SELECT window_size, count(*) AS n_units, avg(k) AS mean_labels, {pearson_sql('y', 'a')} AS pearson, {pearson_sql('ry', 'ra')} AS spearman, count(*) >= 100 AS interpretable FROM r GROUP BY window_size")
def stat_aggregation_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = assay(spark, sf_dir).groupBy("pos").agg(order_free_sum("score").alias("s"), order_free_sum("pred_a").alias("p"), F.count("*").alias("c"))
    units = per.withColumn("window_size", F.explode(F.array(*[F.lit(w) for w in _LADDER_W]))).groupBy("window_size", F.expr("(pos - 1) div window_size").alias("unit"))
    units = units.agg((order_free_sum("s") / F.sum("c")).alias("y"), (order_free_sum("p") / F.sum("c")).alias("a"), F.sum("c").alias("k"))
    r = paired_ranks(units, "y", "a", ["window_size"])
    return r.groupBy("window_size").agg(F.count("*").alias("n_units"), F.avg("k").alias("mean_labels"), pearson("y", "a").alias("pearson"), pearson("ry", "rp").alias("spearman"), (F.count("*") >= 100).alias("interpretable"))


@query(f"WITH p(name, p) AS (VALUES ('a', 0.001::DOUBLE), ('b', 0.004), ('c', 0.02), ('d', 0.3), ('e', 0.049)) SELECT count(*) AS m, 0.05::DOUBLE / count(*) AS alpha, count(*) FILTER (WHERE p < 0.05) AS n_raw, count(*) FILTER (WHERE p < 0.05::DOUBLE / (SELECT count(*) FROM p)) AS n_corrected FROM p")
def stat_bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.createDataFrame([("a", 0.001), ("b", 0.004), ("c", 0.02), ("d", 0.3), ("e", 0.049)], "name string, p double")
    m = p.agg(F.count("*").alias("m"))
    return p.join(F.broadcast(m)).groupBy("m").agg(F.count_if(F.col("p") < 0.05).alias("n_raw"), F.count_if(F.col("p") < 0.05 / F.col("m")).alias("n_corrected")).select("m", (0.05 / F.col("m")).alias("alpha"), "n_raw", "n_corrected")


@query(f"WITH {ASSAY_SQL}, g AS (SELECT wt_sym, pos, count(*)::DOUBLE AS k, avg(score) AS m, var_pop(score) AS v FROM assay GROUP BY ALL) SELECT wt_sym, count(*) AS n_groups, sum(k)::BIGINT AS n FROM g GROUP BY wt_sym")
def stat_groups_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = assay(spark, sf_dir).groupBy("wt_sym", "pos").agg(F.count("*").alias("k"))
    return g.groupBy("wt_sym").agg(F.count("*").alias("n_groups"), F.sum("k").alias("n"))


@query()
def verify_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``name, ok, observed``: identities that must hold on any table."""
    df = stored(folded(spark, sf_dir), "folds")
    sizes = df.groupBy("fold_random").agg(F.count("*").alias("n")).agg((F.max("n") - F.min("n")).cast("double").alias("x"))
    shared = df.groupBy("pos").agg(F.count_distinct("fold_position").alias("f")).agg(F.max("f").cast("double").alias("x"))
    one = metric_bundle(df.select("row_id", "score", "bin", F.col("score").alias("pred"), F.lit("self").alias("model")), ["model"])
    within = icc(df, "pos", "score").select(F.col("icc").alias("x"))
    checks = [
        sizes.select(F.lit("random folds differ by one row at most").alias("name"), (F.col("x") <= 1).alias("ok"), F.col("x").alias("observed")),
        shared.select(F.lit("a position lies in one grouped fold"), F.col("x") == 1, "x"),
        one.select(F.lit("the score ranks itself"), F.abs(F.col("spearman") - 1) < 1e-9, "spearman"),
        one.select(F.lit("the score separates its own halves"), F.abs(F.col("auroc") - 1) < 1e-9, "auroc"),
        within.select(F.lit("icc lies in [0, 1)"), (F.col("x") >= 0) & (F.col("x") < 1), "x"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.union(c)
    return out
