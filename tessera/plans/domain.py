"""Codon tables, symbol neighbourhoods, and log-probability operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import paired_ranks, pearson, pearson_sql
from ..operators.logprob import entropy, log_softmax, window_starts
from ..sources.assay import ASSAY_SQL, assay, table
from .registry import query

# The standard genetic code, in the order TCAG of the three bases.
BASES = "TCAG"
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

_CODONS = f"b AS (SELECT i, substr('{BASES}', CAST(i + 1 AS INTEGER), 1) AS c FROM range(0, 4) t(i)), codons AS (SELECT x.c || y.c || z.c AS codon, substr('{CODE}', CAST(x.i * 16 + y.i * 4 + z.i + 1 AS INTEGER), 1) AS aa FROM b x, b y, b z)"
_HAMMING = "(CAST(substr(a.codon, 1, 1) <> substr(b.codon, 1, 1) AS INTEGER) + CAST(substr(a.codon, 2, 1) <> substr(b.codon, 2, 1) AS INTEGER) + CAST(substr(a.codon, 3, 1) <> substr(b.codon, 3, 1) AS INTEGER))"


def codons(spark: SparkSession) -> DataFrame:
    """``codon, aa``: 64 rows by rule from the order of bases."""
    i = F.col("id").cast("int")
    base = lambda k: F.substring(F.lit(BASES), k + 1, F.lit(1))
    return spark.range(64).select(F.concat(base(F.floor(i / 16).cast("int")), base(F.floor(i / 4).cast("int") % 4), base(i % 4)).alias("codon"), F.substring(F.lit(CODE), i + 1, F.lit(1)).alias("aa"))


def one_edit(spark: SparkSession) -> DataFrame:
    """``aa, other, hits``: amino acids one base change apart, stops and the same one left out."""
    c = codons(spark).where("aa <> '*'")
    edits = c.withColumn("at", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("base", F.explode(F.split(F.lit(BASES), "")))
    edits = edits.select("aa", F.overlay("codon", "base", F.col("at"), F.lit(1)).alias("codon"), F.col("codon").alias("from_"))
    got = edits.where("codon <> from_").join(F.broadcast(c.withColumnRenamed("aa", "other")), "codon").where("aa <> other")
    return got.groupBy("aa", "other").agg(F.count("*").alias("hits"))


@query(f"WITH {_CODONS} SELECT codon, aa FROM codons")
def gen_codon_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codons(spark)


@query(f"WITH {_CODONS} SELECT a.aa, b.aa AS other, count(*) AS hits FROM codons a, codons b WHERE a.aa <> '*' AND b.aa <> '*' AND a.aa <> b.aa AND {_HAMMING} = 1 GROUP BY ALL")
def gen_one_edit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_edit(spark)


@query(f"WITH {_CODONS}, p AS (SELECT a.aa, b.aa AS other, min({_HAMMING}) AS d FROM codons a, codons b WHERE a.aa <> '*' AND b.aa <> '*' GROUP BY ALL) SELECT p.aa, (SELECT count(*) FROM codons c WHERE c.aa = p.aa) AS n_codons, count(*) FILTER (WHERE d = 1 AND other <> p.aa) AS n_neighbours, count(*) FILTER (WHERE d = 1 AND other <> p.aa) / 19.0::DOUBLE AS reachable, max(d) AS farthest FROM p GROUP BY p.aa")
def gen_codon_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = codons(spark).where("aa <> '*'")
    n = c.groupBy("aa").agg(F.count("*").alias("n_codons"), F.collect_list("codon").alias("mine"))
    # 20 rows against one array of 61 codons: all constants
    every = c.agg(F.collect_list(F.struct("codon", "aa")).alias("all"))
    apart = lambda a, b: sum(((F.substring(a, i, 1) != F.substring(b, i, 1)).cast("int") for i in (2, 3)), (F.substring(a, 1, 1) != F.substring(b, 1, 1)).cast("int"))
    rows = n.join(F.broadcast(every)).select("aa", "n_codons", F.explode("all").alias("o"), "mine").select("aa", "n_codons", F.col("o.aa").alias("other"), F.array_min(F.transform("mine", lambda m: apart(m, F.col("o.codon")))).alias("d"))
    near = rows.groupBy("aa", "n_codons", "other").agg(F.min("d").alias("d")).groupBy("aa", "n_codons").agg(F.count_if((F.col("d") == 1) & (F.col("other") != F.col("aa"))).alias("n_neighbours"), F.max("d").alias("farthest"))
    return near.select("aa", "n_codons", "n_neighbours", (F.col("n_neighbours") / 19.0).alias("reachable"), "farthest")


_MATRIX = "a b c\n1 2 3\n4 5 6\n7 8 9"


@query("SELECT * FROM (VALUES ('a','a',1),('a','b',2),('a','c',3),('b','a',4),('b','b',5),('b','c',6),('c','a',7),('c','b',8),('c','c',9)) t(a, b, score)")
def gen_unpivot_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = spark.createDataFrame([(_MATRIX,)], "m string")
    lines = text.select(F.split("m", "\n").alias("l")).select(F.split(F.col("l")[0], " ").alias("names"), F.posexplode(F.slice("l", 2, 99)).alias("i", "row"))
    cells = lines.select("names", "i", F.posexplode(F.split("row", " ")).alias("j", "v"))
    return cells.select(F.get("names", F.col("i")).alias("a"), F.get("names", F.col("j")).alias("b"), F.col("v").cast("int").alias("score"))


@query(f"WITH {_CODONS}, {ASSAY_SQL}, nb AS (SELECT DISTINCT a.aa, b.aa AS other FROM codons a, codons b WHERE a.aa <> '*' AND b.aa <> '*' AND a.aa <> b.aa AND {_HAMMING} = 1), v AS (SELECT row_id, substr('ACDEFGHIKLMNPQRSTVWY', 1 + pos % 20, 1) AS wt, substr('ACDEFGHIKLMNPQRSTVWY', CAST(1 + row_id % 20 AS INTEGER), 1) AS mt FROM assay), s AS (SELECT aa, count(*) AS k FROM nb GROUP BY aa) SELECT avg(k / 19.0::DOUBLE) AS expected, avg(CAST(other IS NOT NULL AS INTEGER)) AS observed FROM v JOIN s ON s.aa = wt LEFT JOIN nb ON nb.aa = wt AND nb.other = mt WHERE wt <> mt")
def gen_expected_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.lit("ACDEFGHIKLMNPQRSTVWY")
    v = assay(spark, sf_dir).select(F.substring(letters, 1 + F.col("pos") % 20, F.lit(1)).alias("aa"), F.substring(letters, (1 + F.col("row_id") % 20).cast("int"), F.lit(1)).alias("other")).where("aa <> other")
    nb = one_edit(spark).select("aa", "other", F.lit(1).alias("hit"))
    k = nb.groupBy("aa").agg(F.count("*").alias("k"))
    rows = v.join(F.broadcast(k), "aa").join(F.broadcast(nb), ["aa", "other"], "left")
    return rows.agg(F.avg(F.col("k") / 19.0).alias("expected"), F.avg(F.coalesce("hit", F.lit(0))).alias("observed"))


_SOFT = "e AS (SELECT vec_id, list_transform(embedding[1:20], lambda x: x::DOUBLE * 5) AS v FROM embeddings), lp AS (SELECT vec_id, list_transform(v, lambda x: x - list_max(v) - ln(list_sum(list_transform(v, lambda y: exp(y - list_max(v)))))) AS lp FROM e)"


def _logp(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform(F.slice("embedding", 1, 20), lambda x: x.cast("double") * 5)
    return table(spark, sf_dir, "embeddings").select("vec_id", log_softmax(scaled).alias("lp"))


@query(f"WITH {_SOFT} SELECT vec_id, list_sum(list_transform(lp, lambda x: exp(x))) AS total, list_max(lp) AS mx, -list_sum(list_transform(lp, lambda x: exp(x) * x)) AS entropy, lp[2] - lp[1] AS llr, len(list_filter(lp, lambda x: x > lp[2])) AS rank_mt FROM lp")
def lm_row_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lp = _logp(spark, sf_dir)
    total = F.aggregate("lp", F.lit(0.0), lambda a, x: a + F.exp(x))
    at = lambda i: F.element_at("lp", i)
    return lp.select("vec_id", total.alias("total"), F.array_max("lp").alias("mx"), entropy(F.col("lp")).alias("entropy"), (at(2) - at(1)).alias("llr"), F.size(F.filter("lp", lambda x: x > at(2))).cast("long").alias("rank_mt"))


@query("SELECT CAST(pos AS INTEGER) AS pos, CAST(pos % 20 AS INTEGER) AS pass_, count(*) OVER (PARTITION BY pos % 20) AS owned FROM range(0, 1368) t(pos)")
def lm_strided_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.range(1368).select(F.col("id").cast("int").alias("pos"), F.pmod(F.col("id"), F.lit(20)).cast("int").alias("pass_"))
    return p.withColumn("owned", F.count("*").over(Window.partitionBy("pass_")))


@query(f"WITH {_SOFT}, a AS (SELECT vec_id, i, lp[i] AS x, round_even(lp[i], 1) AS y FROM lp, range(1, 21) t(i)), r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM a) SELECT {pearson_sql('x', 'y')} AS pearson, {pearson_sql('rx', 'ry')} AS spearman, avg(abs(x - y)) AS mean_abs FROM r")
def lm_approximation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _logp(spark, sf_dir).select("vec_id", F.posexplode("lp").alias("i", "x")).withColumn("y", F.bround("x", 1))
    return paired_ranks(long, "x", "y").agg(pearson("x", "y").alias("pearson"), pearson("ry", "rp").alias("spearman"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_abs"))


@query("SELECT CAST(l AS INTEGER) AS length, CAST(i AS INTEGER) AS i, CAST(CASE WHEN l <= 1022 THEN 0 ELSE round_even(i * (l - 1022) / 4.0::DOUBLE, 0) END AS INTEGER) AS start_ FROM (VALUES (1368), (2000), (800)) t(l), range(0, 5) u(i) WHERE l > 1022 OR i = 0")
def lm_window_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = spark.createDataFrame([(1368,), (2000,), (800,)], "length int")
    return lengths.select("length", F.posexplode(window_starts(F.col("length"), 5, 1022)).alias("i", "start_"))
