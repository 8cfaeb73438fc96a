"""Ladders over feature vectors against brute force in numpy."""

import numpy as np
import pytest

from tessera.operators import ladder
from tessera.plans import ladder as plans

ALPHAS = (0.1, 10.0, 1000.0)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    pos = rng.integers(1, 91, 700)
    pos[:250] = 7  # a hot position
    x = rng.normal(size=(700, 3)) + np.sin(pos / 9)[:, None]
    y = x @ [1.0, -2.0, 0.0] + rng.normal(size=700) + 1e5
    data = [(int(p), float(t), *[float(v) for v in r]) for p, t, r in zip(pos, y, x)]
    data[5] = (*data[5][:2], None, float("nan"), 1.0)
    data += [(3, None, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(data, "pos int, score double, a double, b double, c double")


@pytest.fixture(scope="module")
def fitted(spark, rows):
    from tessera.sources.shared import stored

    units = stored(ladder.unit_vectors(rows, (1, 5, 40), "score", ["a", "b", "c"]), "units")
    units = stored(ladder.with_shuffled_targets(ladder.with_unit_folds(units), 3), "units")
    return stored(ladder.ridge_ladder(units, ALPHAS), "fitted")


def test_unit_means(rows, fitted):
    pdf = rows.toPandas().dropna(subset=["score"])
    for w in (1, 5, 40):
        want = pdf.groupby((pdf.pos - 1) // w)[["score", "a", "b", "c"]].mean()
        got = fitted.where(f"window_size = {w}").toPandas().sort_values("unit")
        assert got.unit.tolist() == want.index.tolist() and got.n.tolist() == pdf.groupby((pdf.pos - 1) // w).size().tolist()
        assert np.allclose(got.y, want.score, rtol=1e-12) and np.allclose(np.stack(got.x), want[["a", "b", "c"]], rtol=1e-9)


def test_folds_and_shuffles(fitted):
    for w, g in fitted.toPandas().groupby("window_size"):
        k = min(10, max(2, len(g) // 3))
        edges = np.linspace(g.unit.min() - 0.5, g.unit.max() + 0.5, k + 1)
        assert g.fold_block.tolist() == (np.digitize(g.unit, edges) - 1).clip(0, k - 1).tolist()
        sizes = np.bincount(g.fold_random)
        assert len(sizes) == k and sizes.max() - sizes.min() <= 1
        ys = np.stack(g.ys)
        assert (ys[:, 0] == g.y).all() and (np.sort(ys, axis=0) == np.sort(g.y)[:, None]).all()
        assert w == 40 or not (ys[:, 1] == ys[:, 2]).all()


def _ridge(x, y, alpha):
    mean, sd = x.mean(0), x.std(0)
    z = (x - mean) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda q: (q - mean) / sd @ w + y.mean()


def _by_hand(x, y, fold):
    out = np.full(len(y), np.nan)
    for f in np.unique(fold):
        train = fold != f
        if train.sum() < ladder.LEAST:
            continue
        inner = [g for g in np.unique(fold) if g != f]
        error = [sum(((_ridge(x[train & (fold != g)], y[train & (fold != g)], a)(x[fold == g]) - y[fold == g]) ** 2).sum() for g in inner) if len(inner) > 1 else 0 for a in ALPHAS]
        out[~train] = _ridge(x[train], y[train], ALPHAS[int(np.argmin(error))])(x[~train])
    return out


def test_ridge_equals_one_by_hand(fitted):
    for w, g in fitted.toPandas().groupby("window_size"):
        x, ys = np.stack(g.x), np.stack(g.ys)
        if w == 40:
            assert g.preds.isna().all() and g.pred_random.isna().all()  # three units: nothing to learn from
            continue
        got = np.stack(g.preds)
        for t in range(ys.shape[1]):
            assert np.allclose(got[:, t], _by_hand(x, ys[:, t], g.fold_block.to_numpy()), rtol=1e-8)
        assert np.allclose(g.pred_random, _by_hand(x, ys[:, 0], g.fold_random.to_numpy()), rtol=1e-8)


def test_metrics(fitted):
    got = ladder.ladder_metrics(fitted).toPandas().set_index("window_size")
    for w, g in fitted.where("window_size < 40").toPandas().groupby("window_size"):
        ys, preds = np.stack(g.ys), np.stack(g.preds)
        rank = lambda v: np.argsort(np.argsort(v))
        rho = [np.corrcoef(rank(ys[:, t]), rank(preds[:, t]))[0, 1] for t in range(4)]
        row = got.loc[w]
        assert np.allclose([row.spearman, row.null_mean, row.null_sd, row.above_null], [rho[0], np.mean(rho[1:]), np.std(rho[1:], ddof=1), rho[0] - np.mean(rho[1:])])
        assert np.isclose(row.pearson, np.corrcoef(ys[:, 0], preds[:, 0])[0, 1]) and row.n_units == len(g) and not row.interpretable
    assert got.loc[40].n_units == 3 and np.isnan(got.loc[40].spearman)


def test_paired_draws_equal_copied_units(spark):
    from tessera.operators.bootstrap import draw_arrays

    rng = np.random.default_rng(1)
    y = rng.normal(size=60) + 1e4
    df = spark.createDataFrame([(i, float(v), float(v + rng.normal()), float(v + 3 * rng.normal()), 1.0) for i, v in enumerate(y)], "unit int, y double, a double, b double, flat double")
    got = ladder.paired_unit_draws(df, "y", "a", "b", 200)
    table = draw_arrays(df, "unit", 200).join(df, "unit").toPandas()
    times = np.stack([np.frombuffer(w, np.uint16) for w in table["_w"]])
    assert (times.sum(0) == 60).all()
    for k in range(0, 200, 17):
        copies = table.loc[table.index.repeat(times[:, k])]
        want = np.corrcoef(copies.y, copies.a)[0, 1] - np.corrcoef(copies.y, copies.b)[0, 1]
        assert np.isclose(got[k], want, atol=1e-8)
    n, lo, hi, p = ladder.interval(got)
    assert n == 200 and np.allclose([lo, hi], np.percentile(got, [2.5, 97.5])) and p == 2 * min((got <= 0).mean(), (got >= 0).mean()) < 0.05
    assert ladder.interval(ladder.paired_unit_draws(df, "y", "a", "flat", 50)) == (0, None, None, None)
    assert ladder.interval(ladder.paired_unit_draws(df.limit(0), "y", "a", "b", 50)) == (0, None, None, None)


def test_an_empty_table(rows):
    none = ladder.ridge_ladder(ladder.with_shuffled_targets(ladder.with_unit_folds(ladder.unit_vectors(rows.limit(0), (1, 5), "score", ["a"])), 2))
    assert none.count() == 0 and ladder.ladder_metrics(none).count() == 0


def test_channels_gain(spark, rows):
    import pyspark.sql.functions as F

    from tessera.functions.catalog import grouped

    df = rows.select("pos", "score", grouped(F.col("a"), "a", "position"), grouped(F.col("b"), "b", "signal"), grouped(F.col("c"), "c", "other"))
    assert plans.channel(df, ["position"], ["c"]) == ["a", "c"] and plans.channel(df, ["position", "absent"], []) == ["a"]
    with pytest.raises(ValueError, match="unknown columns"):
        plans.channel(df, ["position"], ["d"])
    wide = df.withColumn("pos", F.col("pos") + 90 * F.pmod(F.monotonically_increasing_id(), F.lit(3)).cast("int"))
    got = plans.channel_ladders(wide, {"base": ["c"], "more": ["a", "b", "c"]}, "base", (1, 40), 2, 100).toPandas().set_index(["channel", "window_size"])
    row = got.loc["more", 1]
    assert np.isclose(row.delta_vs_baseline, row.pearson - got.loc["base", 1].pearson) and row.delta_lo > 0 and row.delta_p == 0 and row.n_draws == 100
    assert got.loc[[("base", 1), ("more", 40), ("base", 40)]].delta_vs_baseline.isna().all()
