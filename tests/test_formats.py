"""Writers and readers give back what they were given; columns over arrays and strings by hand."""

import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import arrays
from tessera.sources import text

DATA = "/root/testdata/sf0.001"


def _file(tmp_path, body):
    path = tmp_path / "one.fa"
    path.write_text(body)
    return str(path)


def test_one_record(spark, tmp_path):
    assert text.read_reference(spark, _file(tmp_path, "> a b\n\nACDEF\n  ghik \n")) == "ACDEFGHIK"
    for body, message in ((">a\nAC\n>b\nDE\n", "expected one record"), ("", "expected one record"), ("AC\n>a\nDE\n", "expected one record"), (">a\nACX*\n", "standard letters")):
        with pytest.raises(ValueError, match=message):
            text.read_reference(spark, _file(tmp_path, body))


def test_records_over_blocks_and_files(spark, tmp_path, monkeypatch):
    records = [(f"h{i}", "ACDEFGHIKLMNPQRSTVWY" * (i % 11)) for i in range(200)]
    df = spark.createDataFrame(records, "header string, sequence string").repartition(3)
    text.write_fasta(df, str(tmp_path / "many"), 7)
    want = sorted(records)
    assert sorted(map(tuple, text.read_fasta(spark, str(tmp_path / "many")).select("header", "sequence").collect())) == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", 512)
    try:
        assert spark.read.text(str(tmp_path / "many")).rdd.getNumPartitions() > 10
        assert sorted(map(tuple, text.read_fasta(spark, str(tmp_path / "many")).select("header", "sequence").collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    lines = [x for h, s in records for x in (">" + h, s[:9], s[9:])]
    numbered = spark.createDataFrame(list(enumerate(lines)), "n long, value string").repartition(4)
    monkeypatch.setattr(text, "BLOCK_LINES", 16)
    assert sorted(map(tuple, text.parse_fasta(numbered).select("header", "sequence").collect())) == want
    assert text.parse_fasta(numbered.limit(0)).count() == 0


def test_csv_keeps_odd_texts(spark, tmp_path):
    rows = [(1, "a,b", 0.1), (2, 'say "x"', 1e300), (3, "back\\", -0.0), (4, "", None), (5, None, 5e-324), (6, '\\"', 1 / 3), (None, " spaces ", 2.0), (7, "é\U0001f600", 3.0)]
    df = spark.createDataFrame(rows, "k int, t string, v double")
    text.write_csv(df, str(tmp_path / "csv"))
    key = lambda r: str(r[0])
    # a file of commas can't tell an empty text from none
    want = [(k, t or None, v) for k, t, v in rows]
    assert sorted(map(tuple, text.read_csv(spark, str(tmp_path / "csv"), df.schema).collect()), key=key) == sorted(want, key=key)
    text.write_json(df, str(tmp_path / "json"))
    assert sorted(map(tuple, text.read_json(spark, str(tmp_path / "json"), df.schema).collect()), key=key) == sorted(rows, key=key)


def test_array_columns(spark):
    df = spark.createDataFrame([([3.0, None, 1.0, 1.0], "abc", "abd", "A12V"), ([], "", "", "A012V"), (None, "ab", "abc", "A12"), ([2.0], None, "a", None)], "v array<double>, a string, b string, c string")
    order = arrays.sorting_order(F.col("v"))
    got = df.select(order.alias("o"), arrays.inverse_permutation(order).alias("i"), arrays.stacked(F.col("v"), F.col("v")).alias("s"), arrays.hamming(F.col("a"), F.col("b")).alias("h"), arrays.parsed_change(F.col("c"), "AV").alias("c")).collect()
    assert [r.o for r in got] == [[2, 3, 0, 1], [], None, [0]] and [r.i for r in got] == [[2, 3, 0, 1], [], None, [0]]
    assert got[0].s == [[3.0, 3.0], [None, None], [1.0, 1.0], [1.0, 1.0]]
    assert [r.h for r in got] == [1, 0, None, None] and [r.c and tuple(r.c) for r in got] == [("A", 12, "V"), None, None, None]
    back = spark.createDataFrame([([2, 0, 3, 1],)], "p array<int>").select(arrays.inverse_permutation(F.col("p")).alias("i")).first().i
    assert back == [1, 3, 0, 2]


def test_ids_come_in_order(spark):
    got = [r.pos for r in catalog.queries()["sort_unique_ids"](spark, DATA).collect()]
    assert got == sorted(set(got)) and got
