"""Out-of-fold models, target transforms, ablation and feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranks import counts_by_part, shuffled_number
from ..functions.stats import pearson
from ..operators.folds import SCHEMES
from ..operators.boosting import boosted_out_of_fold
from ..operators.models import principal_components, ridge_out_of_fold
from ..operators.relational import densify, out_of_fold, rolling_means
from ..sources.assay import ANNOTATED_SQL, ASSAY_SQL, FOLDS, FOLDS_SQL, assay, table
from ..sources.shared import stored
from .base import folded, folded_table
from .joins import SCALE_SQL, _oof_sql as oof_sql, _scale
from .registry import query
from .scores import _metrics_sql as metrics_sql, metric_bundle, with_score_ranks

#: Named groups of feature columns; ablation keeps or drops whole groups.
GROUPS = {"symbols": ["wt_F", "wt_O", "hyd_wt", "hyd_mt"], "position": ["rel_pos", "m_w5", "m_w11"], "signal": ["pred_a", "pred_b"]}


def columns_only(groups: dict[str, list[str]], keep: list[str]) -> list[str]:
    """Columns of the kept groups, in catalog order, each once."""
    return list(dict.fromkeys(c for g, cs in groups.items() if g in keep for c in cs))


def columns_excluding(groups: dict[str, list[str]], drop: list[str]) -> list[str]:
    gone = {c for g in drop for c in groups[g]}
    return [c for c in dict.fromkeys(c for cs in groups.values() for c in cs) if c not in gone]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folded assay with symbol, position and signal features."""
    df = folded_table(spark, sf_dir)
    sc = F.broadcast(_scale(spark))
    df = df.join(sc.select(F.col("sym").alias("wt_sym"), F.col("hyd").alias("hyd_wt")), "wt_sym", "left").join(sc.select(F.col("sym").alias("mt_sym"), F.col("hyd").alias("hyd_mt")), "mt_sym", "left")
    dense = densify(df.groupBy("pos").agg(F.avg("pred_b").alias("m")))
    axis = rolling_means(dense, "m", (5, 11)).drop("m")
    top = F.broadcast(df.agg(F.max("pos").alias("top")))
    df = df.join(axis, "pos", "left").join(top).withColumn("rel_pos", F.try_divide(F.col("pos") - 1, F.col("top") - 1.0)).drop("top")
    return df.withColumns({"wt_F": (F.col("wt_sym") == "F").cast("int"), "wt_O": (F.col("wt_sym") == "O").cast("int")})


@query(f"WITH {ANNOTATED_SQL}, {SCALE_SQL}, s AS (SELECT unnest(range(1, (SELECT max(pos) FROM assay) + 1)) AS pos), g AS (SELECT pos, avg(pred_b) AS m FROM assay GROUP BY pos), x AS (SELECT pos, {', '.join(f'avg(m) OVER (ORDER BY pos ROWS BETWEEN {w // 2} PRECEDING AND {w // 2} FOLLOWING) AS m_w{w}' for w in (5, 11))} FROM s LEFT JOIN g USING (pos)) SELECT row_id, CAST(wt_sym = 'F' AS INTEGER) AS wt_F, CAST(wt_sym = 'O' AS INTEGER) AS wt_O, w.hyd AS hyd_wt, m.hyd AS hyd_mt, (f.pos - 1) / ((SELECT max(pos) FROM assay) - 1.0::DOUBLE) AS rel_pos, m_w5, m_w11 FROM full_ f LEFT JOIN sc w ON w.sym = wt_sym LEFT JOIN sc m ON m.sym = mt_sym LEFT JOIN x USING (pos)")
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("row_id", *columns_excluding(GROUPS, ["signal"]))


@query(f"WITH {ANNOTATED_SQL}, {FOLDS_SQL} SELECT row_id, (sum(score) OVER () - sum(score) OVER (PARTITION BY fold_random)) / (count(*) OVER () - count(*) OVER (PARTITION BY fold_random)) AS pred FROM folds")
def model_global_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out_of_fold(folded(spark, sf_dir, "fold_random"), None, "score", "fold_random", "pred").select("row_id", "pred")


@query(f"WITH {ANNOTATED_SQL}, {FOLDS_SQL} SELECT row_id, coalesce((sum(score) OVER (PARTITION BY domain) - sum(score) OVER (PARTITION BY domain, fold_region)) / nullif(count(*) OVER (PARTITION BY domain) - count(*) OVER (PARTITION BY domain, fold_region), 0), (sum(score) OVER () - sum(score) OVER (PARTITION BY fold_region)) / (count(*) OVER () - count(*) OVER (PARTITION BY fold_region))) AS pred FROM folds")
def model_domain_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = out_of_fold(out_of_fold(folded_table(spark, sf_dir, "row_id", "domain", "score", "fold_region"), "domain", "score", "fold_region", "p1"), None, "score", "fold_region", "p2")
    return df.select("row_id", F.coalesce("p1", "p2").alias("pred"))


#: The model zoo: keys of out-of-fold means, from the finest to the mean of all, or a column that needs no fit.
MEANS = {"mean": [None], "domain_mean": ["domain", None], "position_mean": ["pos", "domain", None]}
COLUMNS = {"signal": "pred_a", "column_score": "-pred_b"}
_GRID = "lg AS (" + " UNION ALL ".join(
    [f"SELECT row_id, score, bin, '{s}' AS split, '{m}' AS model, {oof_sql([k or '' for k in keys], f'fold_{s}')} AS pred FROM fo" for s in SCHEMES for m, keys in MEANS.items()]
    + [f"SELECT row_id, score, bin, '{s}', '{m}', {c} FROM fo" for s in SCHEMES for m, c in COLUMNS.items()]
) + ")"


@query(f"WITH {ANNOTATED_SQL}, {FOLDS_SQL}, fo AS MATERIALIZED (SELECT * FROM folds), {_GRID}, {metrics_sql('split, model')} SELECT a.*, round(a.spearman - b.spearman, 9) + 0.0::DOUBLE AS delta_vs_domain_mean FROM mb a JOIN mb b ON b.split = a.split AND b.model = 'domain_mean'")
def model_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model under every split: its metrics out of fold, and what it gains over the domain mean there."""
    df = folded_table(spark, sf_dir, "row_id", "pos", "domain", "score", "bin", "pred_a", "pred_b", *[f"fold_{s}" for s in SCHEMES])
    base, names = df, []
    for s in SCHEMES:
        for key in ("pos", "domain", None):
            # means come from the stored table: from the steps before, each step would double the work
            df = out_of_fold(df, key, "score", f"fold_{s}", f"_{s}_{key}", base)
        fitted = {m: F.coalesce(*[F.col(f"_{s}_{k}") for k in keys]) for m, keys in MEANS.items()}
        df = df.withColumns({f"{s}:{m}": c for m, c in fitted.items()})
        names += [f"{s}:{m}" for m in fitted]
    # what needs no fit is the same column under every split, and is ranked once
    df, names = df.withColumns({f"*:{m}": F.expr(c) for m, c in COLUMNS.items()}), names + [f"*:{m}" for m in COLUMNS]
    wide = stored(df.select("score", "bin", *[F.col(f"`{n}`") for n in names]), "grid")
    wide = with_score_ranks(wide, names)
    keep = [c for c in wide.columns if c not in names]
    long = wide.unpivot(keep, [F.col(f"`{n}`") for n in names], "_m", "pred")
    long = long.select(*keep, F.split_part("_m", F.lit(":"), F.lit(1)).alias("split"), F.split_part("_m", F.lit(":"), F.lit(2)).alias("model"), "pred")
    out = metric_bundle(long, ["split", "model"])
    of = F.when(F.col("split") == "*", F.array(*[F.lit(s) for s in SCHEMES])).otherwise(F.array("split"))
    out = stored(out.withColumn("split", F.explode(of)), "metrics")
    base = out.where("model = 'domain_mean'").select("split", F.col("spearman").alias("_b"))
    return out.join(F.broadcast(base), "split").withColumn("delta_vs_domain_mean", F.round(F.col("spearman") - F.col("_b"), 9) + 0.0).drop("_b")


LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def substitutions(spark: SparkSession, matrix: str) -> DataFrame:
    """``a, b, s`` of each cell of a text matrix: a line of symbols, then a line of whole numbers for each."""
    lines = spark.createDataFrame([(matrix,)], "m string").select(F.split("m", "\n").alias("l"))
    lines = lines.select(F.split(F.col("l")[0], " +").alias("names"), F.posexplode(F.slice("l", 2, 999)).alias("i", "row"))
    cells = lines.select("names", "i", F.posexplode(F.split("row", " +")).alias("j", "v"))
    return cells.select(F.get("names", F.col("i")).alias("a"), F.get("names", F.col("j")).alias("b"), F.col("v").cast("int").alias("s"))


def rule_matrix() -> str:
    """A symmetric matrix of twenty symbols by rule; any published one, read from its file, takes its place."""
    n = range(len(LETTERS))
    return "\n".join([" ".join(LETTERS), *(" ".join(str(5 + i % 4 if i == j else (i * j + i + j) % 7 - 4) for j in n) for i in n)])


_SUBSTITUTION = f"""n AS (SELECT CAST(i AS INTEGER) AS i, substr('{LETTERS}', CAST(i + 1 AS INTEGER), 1) AS c FROM range(0, 20) t(i)),
mx AS (SELECT x.c AS a, y.c AS b, CASE WHEN x.i = y.i THEN 5 + x.i % 4 ELSE (x.i * y.i + x.i + y.i) % 7 - 4 END AS s FROM n x, n y),
v AS (SELECT row_id, substr('{LETTERS}', 1 + pos % 20, 1) AS wt, substr('{LETTERS}', CAST(1 + row_id % 20 AS INTEGER), 1) AS mt FROM assay)"""


@query(f"WITH {ASSAY_SQL}, {_SUBSTITUTION} SELECT row_id, p.s AS pair_score, w.s AS self_score, CAST(p.s - w.s AS DOUBLE) AS pred FROM v LEFT JOIN mx p ON p.a = wt AND p.b = mt LEFT JOIN mx w ON w.a = wt AND w.b = wt")
def model_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The substitution model: a pair's score less the symbol's own, by two lookups with a key of two columns."""
    mx = F.broadcast(substitutions(spark, rule_matrix()))
    v = assay(spark, sf_dir).select("row_id", F.substring(F.lit(LETTERS), 1 + F.col("pos") % 20, F.lit(1)).alias("wt"), F.substring(F.lit(LETTERS), (1 + F.col("row_id") % 20).cast("int"), F.lit(1)).alias("mt"))
    v = v.join(mx.select(F.col("a").alias("wt"), F.col("b").alias("mt"), F.col("s").alias("pair_score")), ["wt", "mt"], "left")
    v = v.join(mx.where("a = b").select(F.col("a").alias("wt"), F.col("s").alias("self_score")), "wt", "left")
    return v.select("row_id", "pair_score", "self_score", (F.col("pair_score") - F.col("self_score")).cast("double").alias("pred"))


@query(f"WITH {ASSAY_SQL} SELECT row_id, -pred_b AS pred FROM assay")
def model_column_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assay(spark, sf_dir).select("row_id", (-F.col("pred_b")).alias("pred"))


@query(f"WITH {ANNOTATED_SQL}, {FOLDS_SQL}, tr AS (SELECT k.f, row_id, score FROM folds, range(0, 10) k(f) WHERE fold_position <> k.f), q AS (SELECT f, quantile_cont(score, 0.01) AS lo, quantile_cont(score, 0.99) AS hi FROM tr GROUP BY f) SELECT CAST(f AS INTEGER) AS fold, row_id, (rank() OVER (PARTITION BY f ORDER BY score) + (count(*) OVER (PARTITION BY f, score) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY f) AS rank_target, least(greatest(score, lo), hi) AS winsorised FROM tr JOIN q USING (f)")
def model_target_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets as each of ten training sets sees them: ranks over n, and clipped at its 1st and 99th percentiles."""
    df = folded_table(spark, sf_dir, "row_id", "score", "fold_position")
    values = stored(counts_by_part(df, "score", "fold_position", FOLDS), "counts")
    n = values.agg(F.array(*[F.max(_outside("below", f) + _outside("own", f)) for f in range(FOLDS)]).alias("n"))
    clips = {name: F.array(*[_clip(f, share) for f in range(FOLDS)]).alias(name) for name, share in (("lo", 0.01), ("hi", 0.99))}
    q = values.join(F.broadcast(n)).agg(F.first("n").alias("n"), *clips.values())  # one row
    each = df.join(values, "score").join(F.broadcast(q)).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))).where("fold_position <> fold")
    at = lambda c: F.get(c, F.col("fold"))
    rank = _outside("below", F.col("fold")) + (_outside("own", F.col("fold")) + 1) / 2.0
    return each.select("fold", "row_id", (rank / at("n")).alias("rank_target"), F.least(F.greatest("score", at("lo")), at("hi")).alias("winsorised"))


def _outside(c: str, part: int | Column) -> Column:
    """Of the arrays of `counts_by_part`: the rows of all parts but one."""
    return F.get(c, F.lit(FOLDS)) - F.get(c, F.lit(part) if isinstance(part, int) else part)


def _clip(fold: int, share: float) -> Column:
    """Aggregate over `counts_by_part`: the exact quantile of the rows outside of a fold, by linear interpolation."""
    last = _outside("below", fold) + _outside("own", fold) - 1
    at = F.lit(share) * (F.col("n")[fold] - 1)
    low, high = (F.min(F.when(last >= end, F.col("score"))) for end in (F.floor(at), F.ceil(at)))
    part = F.max(at) - F.floor(F.max(at))
    return F.when(low == high, low).otherwise(low * (1 - part) + high * part)


@query(f"WITH {ANNOTATED_SQL}, {FOLDS_SQL}, fo AS MATERIALIZED (SELECT row_id, domain, score, fold_position FROM folds), tr AS MATERIALIZED (SELECT f, domain, score, row_number() OVER (PARTITION BY f ORDER BY row_id) AS i, row_number() OVER (PARTITION BY f ORDER BY md5('y:' || f || ':' || row_id), row_id) AS j FROM fo, range(0, 10) k(f) WHERE fold_position <> f), g AS MATERIALIZED (SELECT a.f, a.domain, avg(b.score) AS m FROM tr a JOIN tr b ON b.f = a.f AND b.j = a.i GROUP BY a.f, a.domain) SELECT row_id, m AS pred FROM fo JOIN g ON g.f = fold_position AND g.domain = fo.domain")
def model_y_randomised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain means of training labels that were shuffled within each fold's training set."""
    df = folded_table(spark, sf_dir, "row_id", "domain", "score", "fold_position")
    # a row's place by row_id in a training set: the rows before it less those of the fold that is left out
    place = df.join(counts_by_part(df, "row_id", "fold_position", FOLDS).select("row_id", "below"), "row_id")
    sets = lambda d: d.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))).where("fold_position <> f")
    a = sets(place).select("f", "domain", _outside("below", F.col("f")).alias("i"))
    # both orders are numbered in buckets: a fold's training set is most of the table
    tr = sets(df).select("f", "row_id", "score")
    b = shuffled_number(tr, F.md5(F.concat_ws(":", F.lit("y"), "f", "row_id")), "row_id", by=["f"]).select("f", "score", F.col("number").alias("i"))
    g = a.join(b, ["f", "i"]).groupBy("f", "domain").agg(F.avg("score").alias("pred"))
    return df.join(F.broadcast(g), (F.col("f") == F.col("fold_position")) & (df["domain"] == g["domain"])).select("row_id", "pred")


@query()
def model_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features(spark, sf_dir)
    return ridge_out_of_fold(df, columns_excluding(GROUPS, []), "score", "fold_position").select("row_id", "fold_position", "pred")


@query()
def model_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features(spark, sf_dir).select("row_id", "score", "fold_position", *columns_excluding(GROUPS, []))
    return boosted_out_of_fold(df, columns_excluding(GROUPS, []), "score", {"fold_position": "pred"}).select("row_id", "fold_position", "pred")


@query()
def model_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return principal_components(table(spark, sf_dir, "embeddings"), "embedding", 32).select("vec_id", "pcs")


@query()
def model_score_new_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction of a change that was not measured, and its percentile among the predictions for the table's rows.

    The model is fitted on the table alone; the new row takes a measured row's place, another symbol, and mean signals.
    """
    df = features(spark, sf_dir).withColumn("part", F.lit(0))
    means = F.broadcast(df.agg(*[F.avg(c).alias(f"_{c}") for c in GROUPS["signal"]]))
    new = df.where("row_id = 1").join(means).withColumns({"row_id": F.lit(-1).cast(df.schema["row_id"].dataType), "score": F.lit(None).cast("double"), "hyd_mt": -F.col("hyd_mt")})
    new = new.withColumns({c: F.col(f"_{c}") for c in GROUPS["signal"]}).select(df.columns)
    # what is to be predicted forms a part of its own, so the fit sees part 0 only
    asked = df.unionByName(new).withColumn("part", F.lit(1))
    both = ridge_out_of_fold(stored(df.unionByName(asked), "parts"), columns_excluding(GROUPS, []), "score", "part").where("part = 1")
    one = both.where("row_id = -1").select(F.col("pred").alias("value"))
    return both.where("row_id <> -1").join(F.broadcast(one)).groupBy("value").agg(F.avg((F.col("pred") < F.col("value")).cast("int")).alias("percentile"), F.count("*").alias("n"))


@query()
def stat_model_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ridge_out_of_fold(features(spark, sf_dir), columns_only(GROUPS, ["signal"]), "score", "fold_position")
    return df.agg(pearson("score", "pred").alias("ridge_r"), pearson("score", "pred_a").alias("pred_a_r"))


