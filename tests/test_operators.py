"""Operators on small hand-made tables, with their edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.ranks import add_ranks, shuffled_number
from tessera.functions.stats import auroc, chi2_upper, normal_two_sided, paired_ranks, pearson, spearman_brown
from tessera.operators import folds, geometry
from tessera.operators.models import principal_components, ridge_out_of_fold
from tessera.operators.relational import annotate_interval, difference_status, islands, neighbour_in_other_fold
from tessera.operators.reliability import cluster_weights, icc, split_half, weighted_spearman
from tessera.plans.models import GROUPS, columns_excluding, columns_only
from tessera.sources import text


def test_ranks_with_ties_nulls_and_groups(spark):
    rng = np.random.default_rng(0)
    v = [None if x == 0 else float(x) for x in rng.integers(0, 9, 500)]
    g = rng.integers(0, 3, 500).tolist()
    df = spark.createDataFrame(list(zip(range(500), g, v)), "id int, g int, v double")
    got = add_ranks(df, "v", ["g"]).toPandas()
    want = df.toPandas().dropna()
    want["r"] = want.groupby("g").v.rank(method="average")
    both = got.merge(want[["id", "r"]], on="id")
    assert len(both) == len(want) and (both.rank_avg == both.r).all()


def test_shuffled_number_is_the_global_order(spark):
    df = spark.range(1000).withColumn("d", F.md5(F.col("id").cast("string")))
    got = shuffled_number(df, F.col("d"), "id").toPandas().sort_values("d")
    assert got.number.tolist() == list(range(1000))


def test_pearson_guards(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0), (4.0, 8.0, 5.0)], "x double, y double, c double")
    r = df.agg(pearson("x", "y").alias("r"), pearson("x", "c").alias("c"), pearson("x", "y", F.lit(2)).alias("w")).first()
    assert r.r == pytest.approx(1) and r.c is None and r.w == pytest.approx(1)
    assert df.limit(0).agg(pearson("x", "y").alias("r")).first().r is None


def test_auroc_ties_and_one_class(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1), (2.0, 1.0, 0), (3.0, 1.0, 1)], "y double, p double, bin int")
    assert paired_ranks(df, "y", "p").agg(auroc().alias("a")).first().a == 0.5
    assert paired_ranks(df.where("bin = 1"), "y", "y").agg(auroc().alias("a")).first().a is None


def test_tails():
    assert chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert chi2_upper(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-10)
    assert normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)


def test_spearman_brown(spark):
    r = spark.range(1).select(spearman_brown(F.lit(0.5)).alias("a"), spearman_brown(F.lit(-1.0)).alias("b")).first()
    assert r.a == pytest.approx(2 / 3) and r.b is None


def test_icc_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 7.0), ("b", 8.0), ("b", 9.0), ("c", None)], "g string, y double")
    r = icc(df, "g", "y").first()
    assert r.ms_between == pytest.approx(54) and r.ms_within == pytest.approx(1) and r.k0 == 3
    assert r.icc == pytest.approx((53 / 3) / (53 / 3 + 1))
    assert icc(df.limit(0), "g", "y").first().icc is None


def test_split_half_needs_groups(spark):
    df = spark.createDataFrame([(i, i // 2, float(i)) for i in range(20)], "id int, g int, y double")
    assert split_half(df, ["g"], "y", "id", 3).first().split_half_r is None


def test_weighted_spearman_equals_copied_rows(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i % 7, float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 20, (70, 2)))], "c int, y double, p double")
    w = cluster_weights(df, "c", 3)
    assert w.groupBy("rep").agg(F.sum("w").alias("n")).where("n <> 7").count() == 0
    got = {r.rep: r.p for r in weighted_spearman(df.join(w, "c"), "y", ["p"], ["rep"]).collect()}
    copied = df.join(w, "c").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("w").cast("int")))).toPandas()
    for rep, part in copied.groupby("rep"):
        assert got[rep] == pytest.approx(np.corrcoef(part.y.rank(), part.p.rank())[0, 1])


def test_intervals_gaps_and_both_ways(spark, monkeypatch):
    dom = spark.createDataFrame([("a", 1, 5, 0), ("b", 8, 3000, 1)], "name string, lo int, hi int, ordinal int")
    df = spark.createDataFrame([(1,), (5,), (6,), (8,), (2500,), (3001,), (None,)], "pos int")
    want = [(1, "a"), (5, "a"), (6, "UNANNOTATED"), (8, "b"), (2500, "b"), (3001, "UNANNOTATED"), (None, "UNANNOTATED")]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, annotate_interval(df, dom).select("pos", "domain").collect()), key=key) == want
    monkeypatch.setattr("tessera.operators.relational.SMALL", 1)
    assert sorted(map(tuple, annotate_interval(df, dom).select("pos", "domain").collect()), key=key) == want


def test_islands(spark):
    df = spark.createDataFrame([(p,) for p in (1, 2, 3, 5, 9, 10)], "pos int")
    assert sorted(r.label for r in islands(df).collect()) == ["1-3", "5", "9-10"]


def test_difference_status(spark):
    rows = [("ABCD", "ABCD", 1, "X"), ("ABCD", "XBCD", 1, "X"), ("ABCD", "XXCD", 1, "X"), ("ABCD", "ABC", 1, "X"), ("ABCD", "AXCD", 1, "X")]
    df = spark.createDataFrame(rows, "r string, o string, p int, s string")
    got = [r[0] for r in df.select(difference_status(F.col("r"), F.col("o"), F.col("p"), F.col("s"))).collect()]
    assert got == ["identical", "ok", "multiple", "wrong_length", "inconsistent"]


def test_band_join(spark):
    rng = np.random.default_rng(2)
    rows = {(int(p), int(f)) for p, f in zip(rng.integers(1, 300, 60), rng.integers(0, 3, 60))}
    got = {(r.pos, r.fold): r.near for r in neighbour_in_other_fold(spark.createDataFrame(list(rows), "pos int, fold int"), "pos", "fold", 5).collect()}
    assert got == {(p, f): any(abs(p - q) <= 5 and f != g for q, g in rows) for p, f in rows}


def test_fold_schemes(spark):
    df = spark.createDataFrame([(i, 1 + i % 125, "d", None if i % 125 > 100 else 3) for i in range(1000)], "row_id int, pos int, domain string, ordinal int")
    for s in folds.SCHEMES:
        df = folds.assign(df, s)
    p = df.toPandas()
    assert p.fold_random.value_counts().nunique() == 1 and p.groupby("pos").fold_position.nunique().max() == 1
    edge = p.drop_duplicates("pos").set_index("pos").fold_region
    assert edge[12] == 0 and edge[13] == 1 and edge[125] == 9  # the unit on a bucket's edge goes up
    assert set(p.fold_domain) == {3, 11}
    with pytest.raises(ValueError):
        folds.assign(df, "other")
    assert folds.leakage(df, "fold_position").first().shared_position_rate == 0


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=300)
    df = spark.createDataFrame([(i, int(i % 3), int(i % 50), *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id int, f int, pos int, a double, b double, c double, y double")
    got = ridge_out_of_fold(df, ["a", "b", "c"], "y", "f", alphas=[10.0]).toPandas().sort_values("id")
    for f in range(3):
        tr = np.arange(300) % 3 != f
        m, s = x[tr].mean(0), x[tr].std(0)
        z = (x[tr] - m) / s
        w = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y[tr] - y[tr].mean()))
        assert np.allclose(got.pred[~tr], ((x[~tr] - m) / s) @ w + y[tr].mean())


def test_ridge_of_many_folds_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, i % 2, i % 20, float(a) if i % 9 else None, None, float(a + b) if i % 11 else None) for i, (a, b) in enumerate(rng.normal(size=(200, 2)) + 1e6)]
    df = spark.createDataFrame(rows, "id int, f int, g int, pos int, a double, none double, y double")
    both = ridge_out_of_fold(df, ["a", "none"], "y", {"f": "p", "g": "q"})
    one = ridge_out_of_fold(df, ["a", "none"], "y", "g").toPandas().sort_values("id")
    both = both.toPandas().sort_values("id")
    assert np.allclose(both.q, one.pred) and both.p.notna().all()
    assert np.corrcoef(both.p[both.y.notna() & both.a.notna()], both.y[both.y.notna() & both.a.notna()])[0, 1] > 0.5
    assert ridge_out_of_fold(df.withColumn("f", F.lit(0)), ["a"], "y", "f").where("pred is not null").count() == 0


def test_components_are_centred(spark):
    x = np.random.default_rng(4).normal(size=(80, 5)) * [5, 3, 1, 1, 1]
    got = principal_components(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>"), "v", 2).toPandas()
    p = np.stack(got.pcs)
    assert np.allclose(p.mean(0), 0, atol=1e-9) and abs(np.corrcoef(p.T)[0, 1]) < 1e-9
    assert np.allclose(np.sort(p.var(0)), np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[-2:])


def test_group_catalog():
    assert columns_only(GROUPS, ["signal", "symbols"]) == [*GROUPS["symbols"], *GROUPS["signal"]]
    assert columns_excluding(GROUPS, ["position"]) == [*GROUPS["symbols"], *GROUPS["signal"]]


def test_area_of_lone_and_touching_spheres(spark):
    atoms = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0, 1.6), ("b", 1, 0.0, 0.0, 0.0, 1.6), ("b", 2, 2.0, 0.0, 0.0, 1.6)], "chain string, atom_id long, x double, y double, z double, radius double")
    got = {(r.chain, r.atom_id): r.area for r in geometry.accessible_area(atoms).collect()}
    assert got["a", 1] == pytest.approx(4 * np.pi * 9) and got["b", 1] < got["a", 1]


def test_text_sources(spark, tmp_path):
    df = spark.createDataFrame([("D10A", 1.5), ("K2*", None)], "mutant string, score double")
    text.write_csv(df, str(tmp_path / "c"))
    back = text.read_csv(spark, str(tmp_path / "c"), "mutant string, score double", ["mutant"])
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    with pytest.raises(ValueError):
        text.require_columns(back, ["other"])
    (tmp_path / "m.json").write_text('{"a": "1", "b": ""}')
    assert text.read_json_map(spark, str(tmp_path / "m.json")).first().entries == {"a": "1", "b": ""}
    lines = spark.createDataFrame(list(enumerate([">one", "MKV", "", "lla", ">two", "AXB"])), "n int, value string")
    records = text.parse_fasta(lines)
    assert {r.header: r.sequence for r in records.collect()} == {"one": "MKVLLA", "two": "AXB"}
    assert [r.header for r in text.bad_sequences(records).collect()] == ["two"]
    assert text.positions(records.where("header = 'one'")).count() == 6


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
