"""Reliability, autocorrelation, resampling and non-parametric tests."""

from __future__ import annotations

from math import isnan

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.ranks import add_ranks, shuffled_number
from ..functions.stats import chi2_upper, normal_two_sided, pearson, pearson_sql, spearman_brown
from ..operators import folds
from ..operators.relational import densify, out_of_fold
from ..operators.bootstrap import REPS, bootstrap_sql, drawn_spearman
from ..operators.ladder import paired_unit_draws
from ..operators.reliability import icc, percentile_interval, split_half, split_half_windows
from ..sources.assay import ANNOTATED_SQL, ASSAY_SQL, FOLDS_SQL, assay
from ..sources.shared import stored
from .base import annotated, folded_table
from .registry import query

#: Random halves, and draws of units. The operators take any number.
SPLITS, UNIT_DRAWS = 200, 2_000

_ICC = f"""g AS (SELECT pos, count(*)::DOUBLE AS k, avg(score) AS m, var_pop(score) AS v, sum(score) AS s FROM assay GROUP BY pos),
t AS (SELECT count(*)::DOUBLE AS a, sum(k) AS n, sum(k * k) AS k2, (SELECT avg(score) FROM assay) AS mu, sum(k * v) AS w, avg(k) AS mean_group_size FROM g),
u AS (SELECT *, (SELECT sum(k * (m - mu) ** 2) FROM g, t) / (a - 1) AS ms_between, w / (n - a) AS ms_within, (n - k2 / n) / (a - 1) AS k0 FROM t),
x AS (SELECT *, greatest((ms_between - ms_within) / k0, 0) / (greatest((ms_between - ms_within) / k0, 0) + ms_within) AS icc FROM u)"""


@query(f"WITH {ASSAY_SQL}, {_ICC} SELECT CAST(a AS BIGINT) AS n_groups, CAST(n AS BIGINT) AS n, ms_between, ms_within, k0, icc, sqrt(icc) AS ceiling, mean_group_size FROM x")
def stat_position_icc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icc(assay(spark, sf_dir), "pos", "score")


def _halves_sql(group: str, by: str = "", source: str = "assay", least: int = 4) -> str:
    keys = f"{by}, {group}" if by else group
    lead = f", {by}" if by else ""
    return f"""c AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n_ FROM {source}),
r AS (SELECT *, row_number() OVER (PARTITION BY rep, {keys} ORDER BY md5('h:' || rep || ':' || row_id), row_id) AS r_, n_ // 2 AS h_ FROM c, range(0, {SPLITS}) t(rep) WHERE n_ >= {least}),
h AS (SELECT rep, {keys}, avg(score) FILTER (WHERE r_ <= h_) AS x, avg(score) FILTER (WHERE r_ > h_ AND r_ <= 2 * h_) AS y FROM r GROUP BY ALL),
q AS (SELECT rep{lead}, {pearson_sql('x', 'y')} AS r, count(*) AS n_groups FROM h GROUP BY rep{lead})"""


@query(f"WITH {ASSAY_SQL}, {_halves_sql('pos')} SELECT avg(r) AS split_half_r, max(n_groups) AS n_groups, 2 * avg(r) / (1 + avg(r)) AS spearman_brown FROM q")
def stat_split_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_half(assay(spark, sf_dir), ["pos"], "score", "row_id", SPLITS)


WINDOWS = (1, 3, 5, 11, 25, 51, 137)
_UNITS = f"un AS (SELECT a.*, CAST(w AS INTEGER) AS window_size, CAST((pos - 1) // w AS INTEGER) AS unit FROM assay a, (VALUES {', '.join(f'({w})' for w in WINDOWS)}) t(w))"
_RELIABLE = "rel AS (SELECT window_size, CASE WHEN max(n_groups) >= 8 THEN avg(r) END AS split_half_r, max(n_groups) AS n_groups, CASE WHEN max(n_groups) >= 8 THEN 2 * avg(r) / (1 + avg(r)) END AS spearman_brown FROM q GROUP BY window_size)"


@query(f"WITH {ASSAY_SQL}, {_UNITS}, {_halves_sql('unit', 'window_size', 'un')}, {_RELIABLE} SELECT * FROM rel")
def stat_split_half_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = split_half_windows(assay(spark, sf_dir), "pos", "score", "row_id", SPLITS, WINDOWS)
    enough = F.col("n_groups") >= 8
    return out.withColumns({c: F.when(enough, F.col(c)) for c in ("split_half_r", "spearman_brown")})


_CHANNELS = ("pred_a", "pred_b")
_LADDER = "me AS (SELECT window_size, unit, avg(score) AS y, avg(pred_a) AS pred_a, avg(pred_b) AS pred_b FROM un GROUP BY ALL), lad AS (" + " UNION ALL ".join(f"SELECT window_size, '{c}' AS channel, {pearson_sql('y', c)} AS r, count(*) AS n_units FROM me GROUP BY window_size" for c in _CHANNELS) + ")"


def channel_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``window_size, channel, r, n_units``: correlation of unit means with each channel, at each window."""
    per = assay(spark, sf_dir).groupBy("pos").agg(F.count("*").alias("c"), *[F.sum(x).alias(x) for x in ("score", *_CHANNELS)])
    per = per.withColumn("window_size", F.explode(F.array(*[F.lit(w) for w in WINDOWS])))
    units = per.groupBy("window_size", F.expr("(pos - 1) div window_size").alias("unit")).agg(*[(F.sum(x) / F.sum("c")).alias(x) for x in ("score", *_CHANNELS)])
    wide = units.groupBy("window_size").agg(F.count("*").alias("n_units"), *[pearson("score", c).alias(c) for c in _CHANNELS])
    return wide.unpivot(["window_size", "n_units"], list(_CHANNELS), "channel", "r")


@query(f"WITH {ASSAY_SQL}, {_UNITS}, {_LADDER} SELECT l.window_size, l.channel, l.r, l.n_units, l.r - b.r AS delta_vs_baseline, l.n_units >= 100 AS interpretable FROM lad l LEFT JOIN lad b ON b.window_size = l.window_size AND b.channel = 'pred_b'")
def stat_channel_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each channel at each window, and what it gains over the baseline channel there."""
    ladder = channel_ladder(spark, sf_dir)
    base = ladder.where("channel = 'pred_b'").select("window_size", F.col("r").alias("_b"))
    out = ladder.join(F.broadcast(base), "window_size", "left")
    return out.select("window_size", "channel", "r", "n_units", (F.col("r") - F.col("_b")).alias("delta_vs_baseline"), (F.col("n_units") >= 100).alias("interpretable"))


_HEADROOM = "hd AS (SELECT l.window_size, l.channel, l.r AS pearson, spearman_brown AS reliability, CASE WHEN spearman_brown > 0 THEN sqrt(spearman_brown) END AS ceiling, CASE WHEN spearman_brown > 0 THEN sqrt(spearman_brown) END - l.r AS headroom FROM lad l JOIN rel USING (window_size))"


def headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``window_size, channel, pearson, reliability, ceiling, headroom``: what the channel leaves to the reliability's ceiling."""
    rel = stat_split_half_windows(spark, sf_dir).select("window_size", F.col("spearman_brown").alias("reliability"))
    ceiling = F.when(F.col("reliability") > 0, F.sqrt("reliability"))
    out = channel_ladder(spark, sf_dir).join(F.broadcast(rel), "window_size")
    return out.select("window_size", "channel", F.col("r").alias("pearson"), "reliability", ceiling.alias("ceiling"), (ceiling - F.col("r")).alias("headroom"))


@query(f"WITH {ASSAY_SQL}, {_UNITS}, {_halves_sql('unit', 'window_size', 'un')}, {_RELIABLE}, {_LADDER}, {_HEADROOM} SELECT * EXCLUDE (channel) FROM hd WHERE channel = 'pred_a'")
def stat_ceiling_headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability ceiling of each window and what the prediction's correlation leaves to it."""
    return headroom(spark, sf_dir).where("channel = 'pred_a'").drop("channel")


@query(f"WITH {ASSAY_SQL}, {_UNITS}, {_halves_sql('unit', 'window_size', 'un')}, {_RELIABLE}, {_LADDER}, {_HEADROOM} SELECT avg(b.headroom - a.headroom) AS mean_closed, count(b.headroom - a.headroom) AS n_windows FROM hd a JOIN hd b ON b.window_size = a.window_size AND a.channel = 'pred_a' AND b.channel = 'pred_b'")
def stat_headroom_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean share of the baseline channel's headroom that the other channel closes, over windows with a ceiling."""
    wide = headroom(spark, sf_dir).groupBy("window_size").pivot("channel", list(_CHANNELS)).agg(F.first("headroom"))
    gain = F.col("pred_b") - F.col("pred_a")
    return wide.agg(F.avg(gain).alias("mean_closed"), F.count(gain).alias("n_windows"))


@query(f"WITH {ASSAY_SQL}, {_ICC} SELECT icc, mean_group_size, mean_group_size * icc / (1 + (mean_group_size - 1) * icc) AS stepped_up, 1 / 20.0::DOUBLE AS alpha_over_20 FROM x")
def stat_spearman_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = icc(assay(spark, sf_dir), "pos", "score")
    return r.select("icc", "mean_group_size", spearman_brown(F.col("icc"), F.col("mean_group_size")).alias("stepped_up"), F.lit(1 / 20).alias("alpha_over_20"))


LAGS = (1, 2, 3, 5, 10, 20, 50, 100, 200)


@query(f"WITH {ASSAY_SQL}, s AS (SELECT unnest(range(1, (SELECT max(pos) FROM assay) + 1)) AS pos), g AS (SELECT pos, avg(score) AS m FROM assay GROUP BY pos), d AS (SELECT s.pos, m FROM s LEFT JOIN g USING (pos)), l AS (SELECT a.m AS x, b.m AS y, CAST(k AS INTEGER) AS lag_ FROM (VALUES {', '.join(f'({k})' for k in LAGS)}) t(k), d a JOIN d b ON b.pos = a.pos + k WHERE a.m IS NOT NULL AND b.m IS NOT NULL) SELECT lag_, {pearson_sql('x', 'y')} AS r, count(*) AS n FROM l GROUP BY lag_")
def stat_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = densify(assay(spark, sf_dir).groupBy("pos").agg(F.avg("score").alias("m"))).where("m is not null")
    here = dense.select((F.col("pos")).alias("p"), F.col("m").alias("x")).withColumn("lag_", F.explode(F.array(*[F.lit(k) for k in LAGS])))
    pairs = here.join(dense.select("pos", F.col("m").alias("y")), F.col("pos") == F.col("p") + F.col("lag_"))
    return pairs.groupBy("lag_").agg(pearson("x", "y").alias("r"), F.count("*").alias("n"))


def _leak_sql(fold: str) -> str:
    return f"""k_{fold} AS (SELECT DISTINCT pos, {fold} AS f FROM folds),
z_{fold} AS (SELECT {fold} AS f, count(*) AS n,
  avg(CAST(EXISTS (SELECT 1 FROM k_{fold} k WHERE k.pos = a.pos AND k.f <> a.{fold}) AS INTEGER)) AS shared,
  avg(CAST(EXISTS (SELECT 1 FROM k_{fold} k WHERE k.pos BETWEEN a.pos - 5 AND a.pos + 5 AND k.f <> a.{fold}) AS INTEGER)) AS near,
  avg(CAST(EXISTS (SELECT 1 FROM (SELECT DISTINCT domain, {fold} AS f FROM folds) k WHERE k.domain = a.domain AND k.f <> a.{fold}) AS INTEGER)) AS dom
  FROM folds a GROUP BY 1)"""


@query(
    f"WITH {ANNOTATED_SQL}, {FOLDS_SQL}, "
    + ", ".join(_leak_sql(f"fold_{s}") for s in folds.SCHEMES)
    + " "
    + " UNION ALL ".join(f"SELECT '{s}' AS scheme, count(*) AS n_folds, min(n) AS n_test_min, max(n) AS n_test_max, avg(shared) AS shared_position_rate, avg(near) AS neighbour_within_5_rate, avg(dom) AS same_domain_rate FROM z_fold_{s}" for s in folds.SCHEMES)
)
def stat_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, out = folded_table(spark, sf_dir, "pos", "domain", *[f"fold_{s}" for s in folds.SCHEMES]), None
    for s in folds.SCHEMES:
        row = folds.leakage(df, f"fold_{s}").withColumn("scheme", F.lit(s))
        out = row if out is None else out.unionByName(row)
    return out


# --- cluster bootstrap: draws as weights, never as copied rows


_DRAWS = bootstrap_sql("assay", "pos", ("pred_a", "pred_b"))
_CI = "count(*) AS n_draws, avg({x}) AS mean, quantile_cont({x}, 0.025) AS lo, quantile_cont({x}, 0.975) AS hi, least(2 * least(avg(CAST({x} <= 0 AS INTEGER)), avg(CAST({x} >= 0 AS INTEGER))), 1.0::DOUBLE) AS p_two_sided"


@query(f"WITH {ASSAY_SQL}, {_DRAWS} SELECT 'pred_a' AS model, {_CI.format(x='pred_a')} FROM st UNION ALL SELECT 'pred_b', {_CI.format(x='pred_b')} FROM st")
def stat_cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = drawn_spearman(assay(spark, sf_dir), "score", ["pred_a", "pred_b"], "pos", REPS)
    return percentile_interval(draws, "r", ["model"])


@query(f"WITH {ASSAY_SQL}, {_DRAWS}, d AS (SELECT pred_a - pred_b AS delta FROM st) SELECT {_CI.format(x='delta')} FROM d")
def stat_paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = drawn_spearman(assay(spark, sf_dir), "score", ["pred_a", "pred_b"], "pos", REPS)
    wide = draws.groupBy("rep").pivot("model", ["pred_a", "pred_b"]).agg(F.first("r"))
    return percentile_interval(wide.withColumn("delta", F.col("pred_a") - F.col("pred_b")), "delta", [])


_UNIT = f"""un AS (SELECT CAST((pos - 1) // 5 AS INTEGER) AS unit, avg(score) AS y, avg(pred_a) AS a, avg(pred_b) AS b FROM assay GROUP BY 1),
ix AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS i FROM un),
pk AS (SELECT rep, ('0x' || substr(md5('u:' || rep || ':' || i), 1, 8))::BIGINT % (SELECT count(*) FROM ix) AS i FROM ix, range(0, {UNIT_DRAWS}) t(rep)),
bw AS (SELECT rep, y, a, b FROM pk JOIN ix USING (i) JOIN un USING (unit)),
d AS (SELECT rep, {pearson_sql('y', 'a')} - {pearson_sql('y', 'b')} AS delta FROM bw GROUP BY rep)"""


@query(f"WITH {ASSAY_SQL}, {_UNIT} SELECT {_CI.format(x='delta')} FROM d WHERE delta IS NOT NULL")
def stat_unit_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = assay(spark, sf_dir).groupBy(F.expr("cast((pos - 1) div 5 as int)").alias("unit")).agg(F.avg("score").alias("y"), F.avg("pred_a").alias("a"), F.avg("pred_b").alias("b"))
    # a unit carries how often each draw takes it: no draw is a row
    deltas = paired_unit_draws(stored(units, "units"), "y", "a", "b", UNIT_DRAWS, seed="u")
    r = spark.createDataFrame([(float(d),) for d in deltas if not isnan(d)], "delta double")
    return percentile_interval(r, "delta", [])


_PERM = f"""u0 AS (SELECT CAST((pos - 1) // 11 AS INTEGER) AS unit, avg(score) AS y, avg(pred_a) AS a FROM assay GROUP BY 1),
p1 AS (SELECT rep, unit, a, row_number() OVER (PARTITION BY rep ORDER BY unit) AS i FROM u0, range(0, 20) t(rep)),
p2 AS (SELECT rep, y, row_number() OVER (PARTITION BY rep ORDER BY md5('q:' || rep || ':' || unit), unit) AS i FROM u0, range(0, 20) t(rep)),
p3 AS (SELECT rep, {pearson_sql('y', 'a')} AS r FROM p1 JOIN p2 USING (rep, i) GROUP BY rep)"""


@query(f"WITH {ASSAY_SQL}, {_PERM} SELECT avg(r) AS null_mean, stddev_samp(r) AS null_sd, (SELECT {pearson_sql('y', 'a')} FROM u0) AS observed, (SELECT {pearson_sql('y', 'a')} FROM u0) - avg(r) AS above_null, (SELECT count(*) FROM u0) >= 100 AS interpretable FROM p3")
def stat_permutation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = assay(spark, sf_dir).groupBy(F.expr("cast((pos - 1) div 11 as int)").alias("unit")).agg(F.avg("score").alias("y"), F.avg("pred_a").alias("a"))
    units = stored(units, "units")
    reps = units.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(19))))
    # both orders are numbered in buckets: a repeat has all units
    one = add_ranks(reps, "unit", ["rep"], "i").select("rep", "a", (F.col("i_min") - 1).alias("i"))
    two = shuffled_number(reps, F.md5(F.concat_ws(":", F.lit("q"), "rep", "unit")), "unit", by=["rep"]).select("rep", "y", F.col("number").alias("i"))
    null = one.join(two, ["rep", "i"]).groupBy("rep").agg(pearson("y", "a").alias("r")).agg(F.avg("r").alias("null_mean"), F.stddev_samp("r").alias("null_sd"))
    real = units.agg(pearson("y", "a").alias("observed"), (F.count("*") >= 100).alias("interpretable"))
    return null.join(real).select("null_mean", "null_sd", "observed", (F.col("observed") - F.col("null_mean")).alias("above_null"), "interpretable")


_REFIT = f"""u0 AS (SELECT CAST((pos - 1) // 11 AS INTEGER) AS unit, avg(score) AS y FROM assay GROUP BY 1),
u1 AS (SELECT unit, y, unit * 10 // ((SELECT max(unit) FROM u0) + 1) AS dom, unit % 5 AS fold FROM u0),
p1 AS (SELECT rep, dom, fold, row_number() OVER (PARTITION BY rep ORDER BY unit) AS i FROM u1, range(0, 20) t(rep)),
p2 AS (SELECT rep, y, row_number() OVER (PARTITION BY rep ORDER BY md5('q:' || rep || ':' || unit), unit) AS i FROM u1, range(0, 20) t(rep)),
p3 AS (SELECT rep, dom, fold, y FROM p1 JOIN p2 USING (rep, i) UNION ALL SELECT -1, dom, fold, y FROM u1),
p4 AS (SELECT rep, y, (sum(y) OVER (PARTITION BY rep, dom) - sum(y) OVER (PARTITION BY rep, dom, fold)) / nullif(count(*) OVER (PARTITION BY rep, dom) - count(*) OVER (PARTITION BY rep, dom, fold), 0) AS p FROM p3),
p5 AS (SELECT rep, {pearson_sql('y', 'p')} AS r FROM p4 WHERE p IS NOT NULL GROUP BY rep)"""


@query(f"WITH {ASSAY_SQL}, {_REFIT} SELECT avg(r) FILTER (WHERE rep >= 0) AS null_mean, stddev_samp(r) FILTER (WHERE rep >= 0) AS null_sd, max(r) FILTER (WHERE rep < 0) AS observed, max(r) FILTER (WHERE rep < 0) - avg(r) FILTER (WHERE rep >= 0) AS above_null, (SELECT count(*) FROM u0) >= 100 AS interpretable FROM p5")
def stat_permutation_null_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of cross-validated predictions with unit means, and its null: the model is fitted anew on each shuffled target.

    The model is the mean of a unit's stretch of the axis over the other folds.
    """
    units = assay(spark, sf_dir).groupBy(F.expr("cast((pos - 1) div 11 as int)").alias("unit")).agg(F.avg("score").alias("y"))
    units = stored(units, "units")
    top = F.broadcast(units.agg((F.max("unit") + 1).alias("_m"), F.count("*").alias("_n")))
    units = units.join(top).select("unit", "y", F.expr("unit * 10 div _m").alias("dom"), (F.col("unit") % 5).alias("fold"), "_n")
    reps = units.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(19))))
    one = add_ranks(reps, "unit", ["rep"], "i").select("rep", "dom", "fold", "_n", (F.col("i_min") - 1).alias("i"))
    two = shuffled_number(reps, F.md5(F.concat_ws(":", F.lit("q"), "rep", "unit")), "unit", by=["rep"]).select("rep", "y", F.col("number").alias("i"))
    rows = one.join(two, ["rep", "i"]).select("rep", "dom", "fold", "y", "_n")
    rows = rows.unionByName(units.select(F.lit(-1).alias("rep"), "dom", "fold", "y", "_n")).withColumn("key", F.concat_ws(":", "rep", "dom"))
    r = out_of_fold(rows, "key", "y", "fold", "p").where("p is not null").groupBy("rep").agg(pearson("y", "p").alias("r"), F.max("_n").alias("n"))
    null, real = F.when(F.col("rep") >= 0, F.col("r")), F.max(F.when(F.col("rep") < 0, F.col("r")))
    return r.agg(F.avg(null).alias("null_mean"), F.stddev_samp(null).alias("null_sd"), real.alias("observed"), (real - F.avg(null)).alias("above_null"), (F.max("n") >= 100).alias("interpretable"))


# --- rank tests

_RANKED = "rk AS (SELECT domain, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY score)::DOUBLE AS t FROM full_), n AS (SELECT count(*)::DOUBLE AS n, 1 - sum((t ** 3 - t) / t) / (count(*)::DOUBLE ** 3 - count(*)) AS tie FROM rk)"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the mean of t tied ranks lies (t - 1) / 2 above the lowest
    df = add_ranks(annotated(spark, sf_dir, bins=False), "score", prefix="r").withColumnRenamed("r_avg", "r")
    return df.withColumn("t", 2 * (F.col("r") - F.col("r_min")) + 1)


@query(f"WITH {ANNOTATED_SQL}, {_RANKED}, g AS (SELECT domain, count(*)::DOUBLE AS k, sum(r) AS s FROM rk GROUP BY domain) SELECT (12 / (n * (n + 1)) * (SELECT sum(s * s / k) FROM g) - 3 * (n + 1)) / tie AS h, (SELECT count(*) FROM g) - 1 AS df FROM n")
def stat_kruskal_wallis(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _ranked(spark, sf_dir).groupBy("domain").agg(F.count("*").cast("double").alias("k"), F.sum("r").alias("s"), F.sum((F.pow("t", 3) - F.col("t")) / F.col("t")).alias("ties"))
    t = g.agg(F.sum("k").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("k")).alias("q"), F.sum("ties").alias("ties"), (F.count("*") - 1).alias("df"))
    n = F.col("n")
    return t.select(((12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (F.pow(n, 3) - n))).alias("h"), "df")


@query()
def stat_kruskal_wallis_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.udf(lambda h, k: chi2_upper(h, k), DoubleType())
    return stat_kruskal_wallis(spark, sf_dir).withColumn("p", p("h", "df"))


@query(f"WITH {ANNOTATED_SQL}, {_RANKED}, s AS (SELECT count(*)::DOUBLE AS n1, sum(r) AS r1 FROM rk WHERE domain = 'dom03'), u AS (SELECT n1, n - n1 AS n2, n, tie, r1 - n1 * (n1 + 1) / 2 AS u FROM s, n) SELECT u, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5::DOUBLE) / sqrt(n1 * n2 * (n + 1) / 12 * tie) AS z FROM u")
def stat_mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked(spark, sf_dir)
    mine = F.col("domain") == "dom03"
    t = rows.agg(F.count_if(mine).cast("double").alias("n1"), F.sum(F.when(mine, F.col("r"))).alias("r1"), F.count("*").cast("double").alias("n"), F.sum((F.pow("t", 3) - F.col("t")) / F.col("t")).alias("ties"))
    n1, n = F.col("n1"), F.col("n")
    n2, u = n - n1, F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 * (n + 1) / 12 * (1 - F.col("ties") / (F.pow(n, 3) - n)))
    return t.select(u.alias("u"), F.try_divide(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5, spread).alias("z"))


@query()
def stat_mann_whitney_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stat_mann_whitney(spark, sf_dir).withColumn("p", F.udf(lambda z: normal_two_sided(z), DoubleType())("z"))
