"""Correlations over all rows and over parts are draws like others; many draws are summed side by side."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators import bootstrap
from tessera.plans.scores import wide_metrics


@pytest.mark.parametrize("rows_a_strip", [40, 4096])
def test_wide_metrics_equal_row_ranks(spark, monkeypatch, rows_a_strip):
    monkeypatch.setattr(bootstrap, "RANGE_ROWS", rows_a_strip)
    monkeypatch.setattr(bootstrap, "STEPS", 4)
    rng = np.random.default_rng(8)
    n = 130
    score = rng.normal(size=n).round(1)
    p = pd.DataFrame({"pos": rng.integers(0, 20, n), "score": score, "bin": (score > 0).astype(int), "a": score + rng.normal(size=n), "b": rng.integers(0, 3, n) * 1.0, "c": 1.0, "fold": rng.integers(0, 4, n)})
    p.loc[p.fold == 3, "b"] = 2.0  # a part without variance
    points, folds, draws = wide_metrics(spark.createDataFrame(p).repartition(3), ["a", "b", "c"], "pos", 9, "fold")
    want = lambda g, m: g.score.rank().corr(g[m].rank()) if g[m].nunique() > 1 else 0.0
    got = {r.model: r for r in points.collect()}
    assert set(got) == {"a", "b", "c"} and (got["c"].spearman, got["c"].pearson, got["c"].auroc) == (0.0, 0.0, 0.5)
    for m in "ab":
        n1, rank = p.bin.sum(), p[m].rank()
        auc = (rank[p.bin == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (n - n1))
        assert (got[m].n, got[m].spearman, got[m].pearson, got[m].auroc) == pytest.approx((n, want(p, m), p.score.corr(p[m]), auc), abs=1e-12)
    per = {(r.model, r.fold): r for r in folds.collect()}
    assert len(per) == 12
    for (m, f), r in per.items():
        g = p[p.fold == f]
        assert (r.n, r.spearman) == pytest.approx((len(g), want(g, m)), abs=1e-12)
    alone = {(r.model, r.rep): r.r for r in bootstrap.drawn_spearman(spark.createDataFrame(p), "score", ["a", "b", "c"], "pos", 9).collect()}
    assert {(r.model, r.rep): r.r for r in draws.collect()} == pytest.approx(alone, abs=1e-12) and len(alone) == 27
    assert [np.isnan(alone["c", d] or np.nan) for d in range(9)] == [True] * 9


def test_a_value_over_many_chunks(monkeypatch):
    monkeypatch.setattr(bootstrap, "STEPS", 2)
    monkeypatch.setattr(bootstrap, "LANES", 3)
    rng = np.random.default_rng(1)
    v = np.sort(np.concatenate([np.full(40, 5), rng.integers(0, 12, 31)]))
    new = np.append(True, v[1:] != v[:-1])
    c = rng.integers(0, 6, len(v)).astype(np.int32)
    w = np.concatenate([rng.integers(0, 9, (6, 2)), np.zeros((1, 2), int)]).astype(np.uint16)
    order = bootstrap._Order(c.tobytes(), bytes(len(v)), np.packbits(new).tobytes())
    got = [(a, b) for _, below, upto in order.walk(w, order.dealt(c, 6), np.zeros(2, np.int32)) for a, b in zip(below.tolist(), upto.tolist())]
    assert got == [(w[c[v < x]].sum(0).tolist(), w[c[v <= x]].sum(0).tolist()) for x in np.unique(v)]


def test_summary_row_ranks_no_long_table(spark, monkeypatch):
    from tessera.plans import scores

    monkeypatch.setattr(scores, "metric_bundle", lambda *a: 1 / 0)  # a row a prediction used to be ranked twice
    got = {r.model: r for r in scores.stat_summary_row(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == {"pred_a", "pred_b", "pred_c"} and got["pred_c"].pooled_spearman == 0 and got["pred_c"].spearman_ci_lo is None
    assert got["pred_a"].spearman_ci_lo < got["pred_a"].pooled_spearman < got["pred_a"].spearman_ci_hi and got["pred_a"].n_folds == 10
