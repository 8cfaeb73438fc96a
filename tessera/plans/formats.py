"""Tables written and read again by each writer and reader; columns over arrays and identifiers; sorted ids."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import hamming, inverse_permutation, parsed_change, sorting_order, stacked
from ..sources.assay import ASSAY_SQL, assay, table
from ..sources.shared import shared_folder, stored
from ..sources.text import LETTERS, read_csv, read_fasta, read_json, write_csv, write_fasta, write_json
from .registry import query

#: Letters of a record that the FASTA query writes.
RECORD = 500


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {ASSAY_SQL} SELECT row_id, pos, score, wt_sym, mt_sym, pred_a, CASE WHEN row_id % 7 = 0 THEN NULL ELSE 'a \"' || mt_sym || '\", \\' END AS note FROM assay")
def io_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table as CSV with a header, its key a column like others; quotes, commas, backslashes and nulls come back."""
    note = F.when(F.col("row_id") % 7 != 0, F.concat(F.lit('a "'), "mt_sym", F.lit('", \\')))
    df = assay(spark, sf_dir).select("row_id", "pos", "score", "wt_sym", "mt_sym", "pred_a", note.alias("note"))
    path = _path(spark, "csv")
    write_csv(df, path)
    return read_csv(spark, path, df.schema, df.columns)


@query(f"WITH {ASSAY_SQL} SELECT row_id, pos, wt_sym AS sym, pred_a AS first, pred_b AS second, CAST(CASE WHEN row_id % 5 = 0 THEN 1 ELSE 2 END AS INTEGER) AS n FROM assay")
def io_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with an object and an array inside, as lines of JSON; missing values are left out of the file."""
    second = F.when(F.col("row_id") % 5 != 0, F.lit("x"))
    df = assay(spark, sf_dir).select("row_id", F.struct("pos", F.col("wt_sym").alias("sym"), second.alias("more")).alias("at"), F.array("pred_a", "pred_b").alias("preds"))
    path = _path(spark, "json")
    write_json(df, path)
    back = read_json(spark, path, df.schema)
    n = F.when(F.col("at.more").isNull(), 1).otherwise(2)
    return back.select("row_id", "at.pos", "at.sym", F.col("preds")[0].alias("first"), F.col("preds")[1].alias("second"), n.alias("n"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, embedding[1]::DOUBLE AS first, embedding[len(embedding)]::DOUBLE AS last FROM embeddings")
def io_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as a stored table."""
    back = stored(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vectors")
    return back.select("vec_id", F.size("embedding").alias("n"), F.col("embedding")[0].cast("double").alias("first"), F.element_at("embedding", -1).cast("double").alias("last"))


@query(f"SELECT 'r' || (c_custkey // {RECORD}) AS header, count(*) AS n, md5(string_agg(substr('{LETTERS}', CAST(1 + c_custkey * 7 % 20 AS INTEGER), 1), '' ORDER BY c_custkey)) AS digest FROM customer GROUP BY c_custkey // {RECORD}")
def io_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of at most 500 letters, written in lines of 60 and read again."""
    letter = F.substring(F.lit(LETTERS), (1 + F.col("c_custkey") * 7 % 20).cast("int"), F.lit(1))
    rows = table(spark, sf_dir, "customer").select(F.expr(f"c_custkey div {RECORD}").alias("r"), F.struct("c_custkey", letter.alias("s")).alias("l"))
    records = rows.groupBy("r").agg(F.array_join(F.array_sort(F.collect_list("l"))["s"], "").alias("sequence"))
    path = _path(spark, "fasta")
    write_fasta(records.select(F.concat(F.lit("r"), "r").alias("header"), "sequence"), path)
    return read_fasta(spark, path).select("header", F.length("sequence").cast("long").alias("n"), F.md5("sequence").alias("digest"))


_WT, _MT = f"substr('{LETTERS}', 1 + pos % 20, 1)", f"substr('{LETTERS}', CAST(1 + row_id % 20 AS INTEGER), 1)"


@query(
    f"WITH {ASSAY_SQL}, i AS (SELECT row_id, CASE WHEN row_id % 3 = 0 THEN {_WT} || '*' || pos ELSE {_WT} || pos || {_MT} END AS id FROM assay), "
    f"p AS (SELECT *, regexp_matches(id, '^[{LETTERS}][1-9][0-9]*[{LETTERS}]$') AS fits FROM i) SELECT row_id, CASE WHEN fits THEN substr(id, 1, 1) END AS wt, "
    "CASE WHEN fits THEN CAST(substr(id, 2, length(id) - 2) AS INTEGER) END AS pos, CASE WHEN fits THEN right(id, 1) END AS mt FROM p"
)
def scalar_change_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of changes taken apart, null where an identifier is none."""
    letter = lambda at: F.substring(F.lit(LETTERS), at.cast("int"), F.lit(1))
    wt, mt = letter(1 + F.col("pos") % 20), letter(1 + F.col("row_id") % 20)
    name = F.when(F.col("row_id") % 3 == 0, F.concat(wt, F.lit("*"), "pos")).otherwise(F.concat(wt, "pos", mt))
    return assay(spark, sf_dir).select("row_id", parsed_change(name, LETTERS).alias("c")).select("row_id", "c.wt", "c.pos", "c.mt")


@query("SELECT p_partkey, CASE WHEN length(p_brand) = length(p_brand_) THEN hamming(p_brand, p_brand_) END AS apart FROM (SELECT *, right(p_type || '#######', 3 + CAST(p_partkey % 7 AS INTEGER)) AS p_brand_ FROM part)")
def scalar_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places where two strings differ; null for different lengths."""
    other = F.right(F.concat("p_type", F.lit("#######")), (3 + F.col("p_partkey") % 7).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", hamming(F.col("p_brand"), other).cast("long").alias("apart"))


@query(
    "WITH e AS (SELECT vec_id, embedding[1:8] AS v, list_grade_up(embedding[1:8]) AS o FROM embeddings) SELECT vec_id, CAST(o[1] - 1 AS INTEGER) AS least, "
    "CAST(list_grade_up(o)[3] - 1 AS INTEGER) AS rank_of_third, len(flatten([v, v])) AS n, flatten([v, list_reverse(v)])[9]::DOUBLE AS ninth, [v[2], list_reverse(v)[2]][2]::DOUBLE AS stacked FROM e"
)
def scalar_array_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of an array's values, its inverse, arrays end to end and arrays side by side."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("v"))
    order, both = sorting_order(F.col("v")), F.flatten(F.array("v", F.reverse("v")))
    return e.select(
        "vec_id", order[0].alias("least"), inverse_permutation(order)[2].alias("rank_of_third"), F.size(F.flatten(F.array("v", "v"))).cast("long").alias("n"),
        both[8].cast("double").alias("ninth"), stacked(F.col("v"), F.reverse("v"))[1][1].cast("double").alias("stacked"),
    )


@query(f"WITH {ASSAY_SQL} SELECT DISTINCT pos FROM assay ORDER BY pos")
def sort_unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct positions in order: ranges are sorted apart, one after the other."""
    return assay(spark, sf_dir).select("pos").distinct().orderBy("pos")
