"""What the ladder moves does not grow with widths or draws; its packed steps equal plain ones."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import ladder


@pytest.fixture(scope="module")
def units(spark):
    """Two widths; targets with ties; a flag of a stretch that is a fold of its own."""
    rng = np.random.default_rng(4)
    rows = [(w, u, 1, float(rng.integers(0, 40)), [float(rng.normal()), float(u * 10 // n == 3), float(u / n)]) for w, n in ((1, 300), (3, 101)) for u in range(n)]
    return spark.createDataFrame(rows, "window_size int, unit int, n long, y double, x array<double>").repartition(3).cache()


def test_plans_are_not_exploded(units):
    rows = units.select("window_size", F.col("unit").alias("pos"), "y")
    for df in (ladder.unit_vectors(rows, (1, 3), "y", ["pos"]), ladder.with_shuffled_targets(units, 3)):
        plan = df._jdf.queryExecution().toString()
        assert "explode(sequence" not in plan and "explode(array(1" not in plan and "ObjectHashAggregate" not in plan


def test_units_of_stretches(spark, monkeypatch):
    monkeypatch.setattr(ladder, "STRETCH", 20)
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"pos": rng.integers(-70, 130, 900), "y": rng.normal(size=900)})
    for w, got in ladder.unit_vectors(spark.createDataFrame(pdf), (1, 4, 7), "y", ["y"]).toPandas().groupby("window_size"):
        want = pdf.groupby(np.trunc((pdf.pos - 1) / w).astype(int)).y.agg(["mean", "size"])
        got = got.sort_values("unit")
        assert got.unit.tolist() == want.index.tolist() and got.n.tolist() == want["size"].tolist() and np.allclose(got.y, want["mean"])
    none = ladder.unit_vectors(spark.createDataFrame([(None, 1.0), (None, 3.0), (2, 5.0)], "pos int, y double"), (1, 4), "y", ["y"])
    assert sorted((r.window_size, r.unit is None, r.n, r.y) for r in none.collect()) == [(1, False, 1, 5.0), (1, True, 2, 2.0), (4, False, 1, 5.0), (4, True, 2, 2.0)]


@pytest.fixture(scope="module")
def fitted(spark, units):
    from tessera.sources.shared import stored

    with pytest.MonkeyPatch.context() as m:
        m.setattr(ladder, "PLACES", 16)
        m.setattr(ladder, "SORTED", 50)
        ys = stored(ladder.with_shuffled_targets(ladder.with_unit_folds(units), 3), "ys")
        return stored(ladder.ridge_ladder(ys), "fitted"), ladder.ladder_metrics(ladder.ridge_ladder(ys)).toPandas().set_index("window_size")


def test_shuffles_of_ranges(fitted):
    for w, g in fitted[0].toPandas().sort_values("unit").groupby("window_size"):
        ys = np.stack(g.ys)
        for rep in range(3):
            order = sorted(range(len(g)), key=lambda i: hashlib.md5(f"q:{rep}:{w}:{g.unit.iloc[i]}".encode()).hexdigest())
            assert (ys[:, rep + 1] == g.y.to_numpy()[order]).all()


def test_equal_digests_are_told_apart():
    cells = np.zeros(6, ladder._DEALT)
    cells["unit"] = [5, 3, 9, 1, 7, 2]
    cells["digest"][-1] = 4
    want = sorted([5, 3, 9, 1, 7], key=lambda u: hashlib.md5(f"q:0:1:{u}".encode()).hexdigest())
    assert ladder._by_digest(cells, "q:0:1")["unit"].tolist() == [*want, 2]


def test_ranks_of_ranges(fitted):
    table, metrics = fitted
    for w, g in table.toPandas().groupby("window_size"):
        ys, preds = np.stack(g.ys), np.stack(g.preds)
        rho = [pd.Series(ys[:, k]).rank().corr(pd.Series(preds[:, k]).rank()) for k in range(4)]
        row = metrics.loc[w]
        assert np.allclose([row.spearman, row.null_mean, row.null_sd], [rho[0], np.mean(rho[1:]), np.std(rho[1:], ddof=1)], atol=1e-12)
        assert np.isclose(row.pearson, np.corrcoef(ys[:, 0], preds[:, 0])[0, 1]) and np.isclose(row.spearman_random_units, g.y.rank().corr(g.pred_random.rank()))


def test_a_feature_constant_in_training_is_no_feature(fitted):
    # rounding left a spread near 1e-9 of the flag where its only fold was held out; its weight was noise times 1e9
    g = fitted[0].where("window_size = 1").toPandas().sort_values("unit")
    held = np.stack(g.x)[:, 1] == 1
    assert set(g.fold_block[held]) == {3} and (g.fold_block[~held] != 3).all()
    assert np.abs(np.stack(g.preds)[held, 0] - g.y.mean()).max() < 15


def test_a_constant_feature_of_sums():
    d, n, c = 2, 1000, 0.1 + 0.2
    z = np.column_stack([np.ones(n), np.linspace(0, 1, n), np.full(n, c), np.linspace(0, 1, n) ** 2])
    w = ladder._paths(sum(z[i::7, : d + 1].T @ z[i::7] for i in range(7)), d, np.array([0.1]))
    assert w[0, 2, 0] == 0


def test_draws_of_all_widths_equal_those_of_each(spark, fitted, monkeypatch):
    monkeypatch.setattr(ladder, "PLACES", 32)
    monkeypatch.setattr(ladder, "STRIP", 96)
    monkeypatch.setattr(ladder, "GROUP_PICKS", 4000)
    both = fitted[0].select("window_size", "unit", "y", F.col("preds")[0].alias("a"), F.col("pred_random").alias("b"))
    got = ladder.window_unit_draws(both, "y", "a", "b", 40)
    assert set(got) == {1, 3}
    for w, d in got.items():
        assert np.allclose(d, ladder.paired_unit_draws(both.where(F.col("window_size") == w), "y", "a", "b", 40), atol=1e-10)
    assert ladder.window_unit_draws(both.limit(0), "y", "a", "b", 40) == {}
    assert np.isnan(ladder.window_unit_draws(both.withColumn("b", F.lit(1.0)), "y", "a", "b", 5)[1]).all()


def test_picks_are_not_moved(spark, fitted, monkeypatch):
    monkeypatch.setattr(ladder, "draw_arrays", lambda *a: 1 / 0)
    both = fitted[0].select("window_size", "unit", "y", F.col("preds")[0].alias("a"), F.col("pred_random").alias("b"))
    assert len(ladder.window_unit_draws(both, "y", "a", "b", 7)[3]) == 7
