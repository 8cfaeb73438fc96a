"""Scans, projections, filters, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranks import add_ranks, exact_quantiles
from ..operators.relational import densify, islands, on_axis, rolling_means, spine
from ..sources.assay import ANNOTATED_SQL, ASSAY_SQL, FOLDS_SQL, assay, domains, table
from .base import annotated, folded
from .registry import query

WINDOWS = (1, 3, 5, 11, 25, 51, 137)


@query(f"WITH {ANNOTATED_SQL} SELECT row_id, pos, score, wt_sym, mt_sym, pred_a, pred_b, domain, bin, (pos - 1) / ((SELECT max(pos) FROM assay) - 1.0::DOUBLE) AS rel_pos, (SELECT count(*) FROM assay b WHERE b.pos = f.pos) AS n_at_pos FROM full_ f")
def scan_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = annotated(spark, sf_dir)
    top = F.broadcast(assay(spark, sf_dir).agg(F.max("pos").alias("top")))
    df = df.join(top).withColumn("rel_pos", F.try_divide(F.col("pos") - 1, F.col("top") - 1.0))
    df = df.withColumn("n_at_pos", F.count("*").over(Window.partitionBy("pos")))
    return df.select("row_id", "pos", "score", "wt_sym", "mt_sym", "pred_a", "pred_b", "domain", "bin", "rel_pos", "n_at_pos")


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, avg(value) AS mean_value FROM events GROUP BY ALL")
def scan_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return ev.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


@query("SELECT dim, avg(x) AS mean_x, min(x) AS min_x, max(x) AS max_x FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY dim")
def scan_array_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("dim", "v")).withColumn("x", F.col("v").cast("double"))
    return long.groupBy(F.col("dim").cast("long").alias("dim")).agg(F.avg("x").alias("mean_x"), F.min("x").alias("min_x"), F.max("x").alias("max_x"))


@query(f"WITH {ASSAY_SQL} SELECT row_id, {', '.join(f'CAST(wt_sym = {chr(39)}{s}{chr(39)} AS INTEGER) AS wt_{s}' for s in 'FOP')}, {', '.join(f'CAST(mt_sym = {chr(39)}{s}{chr(39)} AS INTEGER) AS mt_{s}' for s in '12345')} FROM assay")
def project_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = assay(spark, sf_dir)
    flags = [(F.col("wt_sym") == s).cast("int").alias(f"wt_{s}") for s in "FOP"] + [(F.col("mt_sym") == s).cast("int").alias(f"mt_{s}") for s in "12345"]
    return df.select("row_id", *flags)


@query(f"WITH {ANNOTATED_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE wt_sym IN ('F', 'O')) AS n_in, count(*) FILTER (WHERE NOT (wt_sym IN ('F', 'O'))) AS n_out, count(*) FILTER (WHERE pos BETWEEN 10 AND 60) AS n_between, count(*) FILTER (WHERE score IS NOT NULL AND isfinite(score)) AS n_finite, count(*) FILTER (WHERE NOT regexp_matches(wt_sym || CAST(pos AS VARCHAR) || mt_sym, '^[A-Z][0-9]+[0-9*]$')) AS n_bad_ids, count(*) FILTER (WHERE domain = 'UNANNOTATED') AS n_unannotated FROM full_")
def filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.concat("wt_sym", F.col("pos").cast("string"), "mt_sym")
    return annotated(spark, sf_dir, bins=False).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("wt_sym").isin("F", "O")).alias("n_in"),
        F.count_if(~F.col("wt_sym").isin("F", "O")).alias("n_out"),
        F.count_if(F.col("pos").between(10, 60)).alias("n_between"),
        F.count_if(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))).alias("n_finite"),
        F.count_if(~ids.rlike("^[A-Z][0-9]+[0-9*]$")).alias("n_bad_ids"),
        F.count_if(F.col("domain") == "UNANNOTATED").alias("n_unannotated"),
    )


@query(f"WITH {ASSAY_SQL} SELECT wt_sym, mt_sym, count(*) AS n, stddev_pop(score) AS sd FROM assay GROUP BY ALL HAVING count(*) >= 50 AND stddev_pop(score) > 0")
def filter_minimum_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = assay(spark, sf_dir).groupBy("wt_sym", "mt_sym").agg(F.count("*").alias("n"), F.stddev_pop("score").alias("sd"))
    return g.where("n >= 50 and sd > 0")


@query(f"WITH {ASSAY_SQL} SELECT row_id, round_even(score / 1000, 1) AS score_k FROM assay")
def project_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assay(spark, sf_dir).select("row_id", F.bround(F.col("score") / 1000, 1).alias("score_k"))


@query(f"WITH {ANNOTATED_SQL} SELECT pos, min(domain) AS domain, count(*) AS n, avg(score) AS mean_score, sum(score) AS sum_score, min(score) AS min_score, max(score) AS max_score, median(score) AS median_score, avg(bin) AS frac_above, CASE WHEN count(*) > 1 THEN stddev_samp(score) END AS sd, CASE WHEN count(*) > 1 THEN stddev_samp(score) / sqrt(count(*)) END AS sem FROM full_ GROUP BY pos")
def agg_group_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    sd = F.when(F.count("*") > 1, F.stddev_samp("score"))
    return annotated(spark, sf_dir).groupBy("pos").agg(
        F.min("domain").alias("domain"), F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.sum("score").alias("sum_score"),
        F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.median("score").alias("median_score"), F.avg("bin").alias("frac_above"),
        sd.alias("sd"), (sd / F.sqrt(F.count("*"))).alias("sem"),
    )


@query(f"WITH {ASSAY_SQL}, g AS (SELECT count(*) AS size FROM assay GROUP BY pos) SELECT size, count(*) AS n_groups FROM g GROUP BY size")
def agg_group_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assay(spark, sf_dir).groupBy("pos").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))


@query(f"WITH {ASSAY_SQL} SELECT count(*) AS n, avg(score) AS mean, median(score) AS median, quantile_cont(score, 0.01) AS q01, quantile_cont(score, 0.99) AS q99, stddev_samp(score) AS sd, stddev_pop(score) AS sd_pop, skewness(score) AS skew, kurtosis(score) AS kurt, count(DISTINCT score) AS n_distinct, count(*) - count(DISTINCT score) AS n_duplicates FROM assay")
def agg_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*").cast("double")
    skew = F.skewness("score") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = ((n + 1) * F.kurtosis("score") + 6) * (n - 1) / ((n - 2) * (n - 3))
    df = assay(spark, sf_dir)
    moments = df.agg(
        F.count("*").alias("n"), F.avg("score").alias("mean"),
        F.stddev_samp("score").alias("sd"), F.stddev_pop("score").alias("sd_pop"), skew.alias("skew"), kurt.alias("kurt"),
        F.count_distinct("score").alias("n_distinct"), (F.count("*") - F.count_distinct("score")).alias("n_duplicates"),
    )
    return moments.join(F.broadcast(exact_quantiles(df, "score", {"median": 0.5, "q01": 0.01, "q99": 0.99})))


@query(f"WITH {ANNOTATED_SQL} SELECT count(*) AS n, count(DISTINCT pos) AS n_pos, max(pos) AS length, count(*) / (max(pos) * 19.0::DOUBLE) AS coverage, avg(CAST(wt_sym = 'F' AS INTEGER)) AS frac_f, bool_and((score > m) = (bin = 1)) AS bin_consistent FROM full_, med")
def agg_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = annotated(spark, sf_dir)
    df = df.join(F.broadcast(exact_quantiles(assay(spark, sf_dir), "score", {"m": 0.5})))
    return df.agg(
        F.count("*").alias("n"), F.count_distinct("pos").alias("n_pos"), F.max("pos").alias("length"), (F.count("*") / (F.max("pos") * 19.0)).alias("coverage"),
        F.avg((F.col("wt_sym") == "F").cast("int")).alias("frac_f"), F.bool_and((F.col("score") > F.col("m")).eqNullSafe(F.col("bin") == 1)).alias("bin_consistent"),
    )


@query(f"WITH {ASSAY_SQL}, w(w) AS (VALUES {', '.join(f'({x})' for x in WINDOWS)}) SELECT CAST(w AS INTEGER) AS window_size, CAST((pos - 1) // w AS INTEGER) AS unit, count(*) AS n, avg(score) AS mean_score, avg(pred_a) AS mean_a, avg(pred_b) AS mean_b FROM assay, w GROUP BY ALL")
def agg_tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # positions are summed first: the windows then multiply one row a position, not one a measurement
    per = assay(spark, sf_dir).groupBy("pos").agg(F.count("*").alias("c"), *[F.sum(x).alias(f"s_{x}") for x in ("score", "pred_a", "pred_b")])
    per = per.withColumn("window_size", F.explode(F.array(*[F.lit(w) for w in WINDOWS])))
    g = per.groupBy("window_size", F.expr("cast((pos - 1) div window_size as int)").alias("unit"))
    n = F.sum("c")
    return g.agg(n.alias("n"), (F.sum("s_score") / n).alias("mean_score"), (F.sum("s_pred_a") / n).alias("mean_a"), (F.sum("s_pred_b") / n).alias("mean_b"))


@query(f"WITH {ANNOTATED_SQL}, {FOLDS_SQL}, g AS (SELECT fold_position, count(*) AS n, avg(score) AS m FROM folds GROUP BY 1) SELECT avg(m) AS macro_mean, stddev_pop(m) AS macro_sd, min(n) AS n_min, max(n) AS n_max FROM g")
def agg_macro_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = folded(spark, sf_dir, "fold_position").groupBy("fold_position").agg(F.count("*").alias("n"), F.avg("score").alias("m"))
    return g.agg(F.avg("m").alias("macro_mean"), F.stddev_pop("m").alias("macro_sd"), F.min("n").alias("n_min"), F.max("n").alias("n_max"))


@query(f"WITH {ASSAY_SQL} SELECT pos, string_agg(wt_sym || mt_sym, ',' ORDER BY row_id) AS variants FROM assay GROUP BY pos")
def agg_ordered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("row_id", F.concat("wt_sym", "mt_sym").alias("v"))))
    return assay(spark, sf_dir).groupBy("pos").agg(F.array_join(F.transform(rows, lambda r: r["v"]), ",").alias("variants"))


@query(f"WITH {ANNOTATED_SQL} SELECT domain, arg_max(row_id, (score, -row_id)) AS best_row, max(score) AS best_score FROM full_ GROUP BY domain")
def agg_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max(F.struct("score", (-F.col("row_id")).alias("k")))
    return annotated(spark, sf_dir, bins=False).groupBy("domain").agg(best.alias("b")).select("domain", (-F.col("b.k")).alias("best_row"), F.col("b.score").alias("best_score"))


@query(f"WITH {ANNOTATED_SQL} SELECT domain, {', '.join(f'avg(score) FILTER (WHERE mt_sym = {chr(39)}{s}{chr(39)}) AS mt_{s}' for s in '12345')} FROM full_ GROUP BY domain")
def agg_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = annotated(spark, sf_dir, bins=False).groupBy("domain").pivot("mt_sym", list("12345")).agg(F.avg("score"))
    return wide.withColumnsRenamed({s: f"mt_{s}" for s in "12345"})


@query(f"WITH {ASSAY_SQL}, g AS (SELECT pos, avg(score) AS m FROM assay GROUP BY pos) SELECT (SELECT stddev_samp(m) FROM g) AS sd_of_means, (SELECT stddev_samp(score) FROM assay) AS sd_of_rows")
def agg_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = assay(spark, sf_dir).groupBy("pos").agg(F.avg("score").alias("m"), F.count("score").alias("n"), F.sum("score").alias("s"), F.var_pop("score").alias("v"))
    n, grand = F.sum("n"), F.sum("s") / F.sum("n")
    ss = F.sum(F.col("n") * F.col("v")) + F.sum(F.col("n") * F.col("m") * F.col("m")) - n * grand * grand
    return g.agg(F.stddev_samp("m").alias("sd_of_means"), F.sqrt(ss / (n - 1)).alias("sd_of_rows"))


@query("WITH e AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings) SELECT label, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, avg((x + y + z) / 3) AS mean_of_three FROM e GROUP BY label")
def agg_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = (F.element_at("embedding", i).cast("double") for i in (1, 2, 3))
    e = table(spark, sf_dir, "embeddings").select("label", x.alias("x"), y.alias("y"), z.alias("z"))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"), F.avg((F.col("x") + F.col("y") + F.col("z")) / 3).alias("mean_of_three"))


@query(f"WITH {ASSAY_SQL} SELECT row_id, count(*) OVER p AS n_group, avg(score) OVER p AS group_mean, (sum(score) OVER p - score) / nullif(count(*) OVER p - 1, 0) AS loo_mean FROM assay WINDOW p AS (PARTITION BY pos)")
def win_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Window.partitionBy("pos")
    n, s = F.count("*").over(p), F.sum("score").over(p)
    return assay(spark, sf_dir).select("row_id", n.alias("n_group"), F.avg("score").over(p).alias("group_mean"), F.try_divide(s - F.col("score"), n - 1).alias("loo_mean"))


@query(f"WITH {ASSAY_SQL}, s AS (SELECT unnest(range(1, (SELECT max(pos) FROM assay) + 1)) AS pos), g AS (SELECT pos, avg(score) AS m FROM assay GROUP BY pos) SELECT CAST(pos AS INTEGER) AS pos, m, {', '.join(f'lag(m, {k}) OVER (ORDER BY pos) AS lag_{k}' for k in (1, 5, 100))} FROM s LEFT JOIN g USING (pos)")
def win_lags_on_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = densify(assay(spark, sf_dir).groupBy("pos").agg(F.avg("score").alias("m")))
    lag = lambda k: lambda axis: F.lag("m", k).over(axis)
    return on_axis(dense, 100, {f"lag_{k}": lag(k) for k in (1, 5, 100)})


@query(f"WITH {ASSAY_SQL} SELECT row_id, rank() OVER (ORDER BY pred_b) + (count(*) OVER (PARTITION BY pred_b) - 1) / 2.0::DOUBLE AS avg_rank, (rank() OVER (ORDER BY score) - 1) / (count(*) OVER ())::DOUBLE AS ecdf FROM assay")
def win_average_rank_and_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = add_ranks(add_ranks(assay(spark, sf_dir), "pred_b", prefix="b"), "score", prefix="s")
    return df.select("row_id", F.col("b_avg").alias("avg_rank"), ((F.col("s_min") - 1) / F.col("s_n")).alias("ecdf"))


@query("WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT vec_id, CAST(i AS INTEGER) AS i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) - 1 AS rank_in_row, max(x) OVER (PARTITION BY vec_id) AS row_max FROM e")
def win_rank_in_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    # ranks within the array: no row leaves its task
    e = table(spark, sf_dir, "embeddings").withColumn("x", F.transform("embedding", lambda v, i: F.struct((-v.cast("double")).alias("neg"), (i + 1).alias("i"))))
    e = e.select("vec_id", F.array_max(F.transform("embedding", lambda v: v.cast("double"))).alias("row_max"), F.posexplode(F.array_sort("x")).alias("r", "s"))
    return e.select("vec_id", F.col("s.i").alias("i"), F.col("r").cast("long").alias("rank_in_row"), "row_max")


@query(f"WITH {ASSAY_SQL}, s AS (SELECT unnest(range(1, (SELECT max(pos) FROM assay) + 1)) AS pos), g AS (SELECT pos, avg(score) AS m FROM assay GROUP BY pos) SELECT CAST(pos AS INTEGER) AS pos, {', '.join(f'avg(m) OVER (ORDER BY pos ROWS BETWEEN {w // 2} PRECEDING AND {w // 2} FOLLOWING) AS m_w{w}' for w in (5, 11, 25))} FROM s LEFT JOIN g USING (pos)")
def win_rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = densify(assay(spark, sf_dir).groupBy("pos").agg(F.avg("score").alias("m")))
    return rolling_means(dense, "m", (5, 11, 25)).drop("m")


@query("WITH m AS (SELECT o_custkey + 1 AS pos FROM orders WHERE o_custkey % 7 <> 3 AND o_custkey % 11 <> 4 GROUP BY 1), s AS (SELECT unnest(range(1, (SELECT max(pos) FROM m) + 1)) AS pos), miss AS (SELECT pos, pos - row_number() OVER (ORDER BY pos) AS g FROM s ANTI JOIN m USING (pos)) SELECT CAST(min(pos) AS INTEGER) AS lo, CAST(max(pos) AS INTEGER) AS hi, count(*) AS n, CASE WHEN min(pos) = max(pos) THEN CAST(min(pos) AS VARCHAR) ELSE concat(min(pos), '-', max(pos)) END AS label FROM miss GROUP BY g")
def win_gaps_and_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = assay(spark, sf_dir).where("(pos - 1) % 7 <> 3 and (pos - 1) % 11 <> 4").select("pos").distinct()
    return islands(spine(have).join(have, "pos", "left_anti"))


@query(f"WITH {ANNOTATED_SQL}, {FOLDS_SQL} SELECT row_id, fold_random, fold_position, fold_region, fold_domain FROM folds")
def folds_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(spark, sf_dir, "fold_random", "fold_position", "fold_region").select("row_id", "fold_random", "fold_position", "fold_region", "fold_domain")


@query("WITH s AS (SELECT i AS start_ FROM (VALUES (1), (86), (172), (258), (344)) t(i)), p AS (SELECT unnest(range(1, 1369)) AS pos), c AS (SELECT pos, start_, abs(pos - (start_ + 510.5::DOUBLE)) AS d FROM p, s WHERE pos BETWEEN start_ AND start_ + 1021) SELECT CAST(pos AS INTEGER) AS pos, CAST(start_ AS INTEGER) AS window_start FROM c QUALIFY row_number() OVER (PARTITION BY pos ORDER BY d, start_) = 1")
def win_most_central_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = [1, 86, 172, 258, 344]
    p = spark.range(1, 1369).select(F.col("id").cast("int").alias("pos"), F.explode(F.array(*[F.lit(s) for s in starts])).alias("s"))
    p = p.where(F.col("pos").between(F.col("s"), F.col("s") + 1021))
    best = F.min(F.struct(F.abs(F.col("pos") - (F.col("s") + 510.5)).alias("d"), "s"))
    return p.groupBy("pos").agg(best.alias("b")).select("pos", F.col("b.s").alias("window_start"))


@query(f"WITH {ANNOTATED_SQL}, g AS (SELECT domain, avg(score) AS m FROM full_ GROUP BY domain) (SELECT 'low' AS side, domain, m FROM g ORDER BY m, domain LIMIT 3) UNION ALL (SELECT 'high', domain, m FROM g ORDER BY m DESC, domain LIMIT 3)")
def sort_smallest_and_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = annotated(spark, sf_dir, bins=False).groupBy("domain").agg(F.avg("score").alias("m"))
    low = g.orderBy("m", "domain").limit(3).select(F.lit("low").alias("side"), "domain", "m")
    return low.unionByName(g.orderBy(F.desc("m"), "domain").limit(3).select(F.lit("high").alias("side"), "domain", "m"))


@query("WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 5000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'all', k FROM (SELECT k FROM a UNION ALL SELECT k FROM b)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")).distinct()
    b = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct()
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "all": a.unionByName(b)}
    return reduce(DataFrame.unionByName, [df.select(F.lit(op).alias("op"), "k") for op, df in parts.items()])


@query("SELECT 'customer' AS kind, c_nationkey AS nation, count(*) AS n, avg(c_acctbal) AS balance, NULL::BIGINT AS parts FROM customer GROUP BY 2 UNION ALL SELECT 'brand', NULL, count(*), NULL, count(DISTINCT p_type) FROM part GROUP BY p_brand")
def set_ragged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("balance")).withColumn("kind", F.lit("customer"))
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_distinct("p_type").alias("parts")).drop("p_brand").withColumn("kind", F.lit("brand"))
    return c.unionByName(p, allowMissingColumns=True)


@query(f"WITH {ANNOTATED_SQL}, {FOLDS_SQL} SELECT CAST(k AS INTEGER) AS fold, count(*) FILTER (WHERE fold_random = k) AS n_test, count(*) FILTER (WHERE fold_random <> k) AS n_train, avg(score) FILTER (WHERE fold_random <> k) AS train_mean FROM folds, range(0, 10) t(k) GROUP BY k")
def set_train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = folded(spark, sf_dir, "fold_random").groupBy("fold_random").agg(F.count("*").alias("n_test"), F.sum("score").alias("s"))
    every = Window.partitionBy(F.lit(0))
    n, s = F.sum("n_test").over(every), F.sum("s").over(every)
    return parts.select(F.col("fold_random").alias("fold"), "n_test", (n - F.col("n_test")).alias("n_train"), ((s - F.col("s")) / (n - F.col("n_test"))).alias("train_mean"))


@query("SELECT p_partkey, upper(p_name) AS up, length(p_name) AS len, substr(p_name, 2, 3) AS sub, nullif(regexp_extract(p_brand, '([A-Za-z]+)#?([0-9]+)', 2), '') AS digits, starts_with(p_type, 'S') AS starts_s, contains(p_name, 'a') AS has_a, split_part(p_type, ' ', 1) AS first_word, substr(p_name, 1, 1) || 'Z' || substr(p_name, 3) AS spliced, concat_ws('-', p_brand, p_type) AS joined FROM part")
def scalar_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.upper(n).alias("up"), F.length(n).cast("long").alias("len"), F.substring(n, 2, 3).alias("sub"), F.nullif(F.regexp_extract("p_brand", "([A-Za-z]+)#?([0-9]+)", 2), F.lit("")).alias("digits"),
        F.col("p_type").startswith("S").alias("starts_s"), n.contains("a").alias("has_a"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("first_word"),
        F.overlay(n, F.lit("Z"), 2, 1).alias("spliced"), F.concat_ws("-", "p_brand", "p_type").alias("joined"),
    )


@query("SELECT p_partkey, abs(p_size - 25) AS a, sqrt(p_retailprice) AS s, ln(p_retailprice) AS l, exp(-p_size / 10.0::DOUBLE) AS e, least(greatest(p_size, 10), 40) AS clip, CAST(floor(p_size / 7) AS BIGINT) AS fl, CAST(ceil(p_size / 7) AS BIGINT) AS ce, pow(p_size, 2)::DOUBLE AS sq FROM part")
def scalar_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.abs(p - 25).alias("a"), F.sqrt("p_retailprice").alias("s"), F.log("p_retailprice").alias("l"), F.exp(-p / 10.0).alias("e"),
        F.least(F.greatest(p, F.lit(10)), F.lit(40)).alias("clip"), F.floor(p / 7).alias("fl"), F.ceil(p / 7).alias("ce"), F.pow(p.cast("double"), 2.0).alias("sq"),
    )


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) SELECT vec_id, list_max(v) AS mx, CAST(list_position(v, list_max(v)) AS BIGINT) AS arg, list_avg(v) AS mean, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm, v[3] AS third, len(list_filter(v, lambda x: x > 0)) AS n_pos FROM e")
def scalar_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    total = lambda f: F.aggregate("v", F.lit(0.0), lambda a, x: a + f(x))
    return e.select(
        "vec_id", F.array_max("v").alias("mx"), F.array_position("v", F.array_max("v")).alias("arg"), (total(lambda x: x) / F.size("v")).alias("mean"),
        F.sqrt(total(lambda x: x * x)).alias("norm"), F.element_at("v", 3).alias("third"), F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("n_pos"),
    )


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS m FROM events")
def scalar_map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(m, F.lit("k")).cast("long"), F.lit(-1)).alias("k"), F.coalesce(F.try_element_at(m, F.lit("missing")), F.lit("none")).alias("m"))
