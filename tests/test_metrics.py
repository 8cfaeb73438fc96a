"""Metrics from summed values, with and without ranks that hold for all predictions; means of the grid from one table."""

import numpy as np
import pandas as pd
import pytest

from tessera.plans import models
from tessera.plans.scores import metric_bundle, with_score_ranks


@pytest.mark.parametrize("missing", [False, True])
def test_metrics_equal_row_ranks(spark, missing):
    rng = np.random.default_rng(4)
    rows = [(i, float(s), int(s > 0), float(a), None if missing and i < 9 else float(b)) for i, (s, a, b) in enumerate(zip(rng.normal(size=80).round(1), rng.normal(size=80), rng.integers(0, 4, 80)))]
    wide = with_score_ranks(spark.createDataFrame(rows, "row_id long, score double, bin int, a double, b double"), ["a", "b"])
    assert ("ry" in wide.columns) is not missing
    long = wide.unpivot([c for c in wide.columns if c not in "ab"], ["a", "b"], "model", "pred")
    plain = pd.DataFrame(rows, columns=["row_id", "score", "bin", "a", "b"])
    for r in metric_bundle(long, ["model"]).collect():
        p = plain.dropna(subset=[r.model])
        rank = p[r.model].rank()
        n1 = p["bin"].sum()
        want = (np.corrcoef(p.score.rank(), rank)[0, 1], np.corrcoef(p.score, p[r.model])[0, 1], (rank[p["bin"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(p) - n1)))
        assert r.n == len(p) and (r.spearman, r.pearson, r.auroc) == pytest.approx(want, abs=1e-12)


def test_grid_means_come_from_the_stored_table(spark, monkeypatch):
    tables, plain = set(), models.out_of_fold

    def told(df, key, value, fold, name, base=None):
        tables.add(id(base))
        return plain(df, key, value, fold, name, base)

    monkeypatch.setattr(models, "out_of_fold", told)
    models.model_grid(spark, "/root/testdata/sf0.001")
    assert len(tables) == 1 and id(None) not in tables


def test_grid_ranks_a_column_once(spark, monkeypatch):
    asked, plain = [], models.with_score_ranks
    monkeypatch.setattr(models, "with_score_ranks", lambda wide, names: asked.extend(names) or plain(wide, names))
    got = models.model_grid(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 20 and len(asked) == 14  # two columns used to be ranked under each of four splits
    assert len({(r.spearman, r.auroc) for r in got if r.model == "signal"}) == 1 and len({r.delta_vs_domain_mean for r in got if r.model == "signal"}) > 1
