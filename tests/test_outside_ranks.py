"""Ranks and quantiles outside of each fold come from counts of folds; the sets without a fold are not made for them."""

import duckdb
import pytest

from tessera import catalog
from tessera.functions.ranks import counts_by_part
from tessera.plans import models


def test_counts_by_part(spark):
    rows = [(float(v % 5) if v % 11 else None, v % 3) for v in range(90)]
    got = counts_by_part(spark.createDataFrame(rows, "v double, p int"), "v", "p", 3, buckets=2).collect()
    known = [r for r in rows if r[0] is not None]
    assert len(got) == 5
    for value, below, own in got:
        for part in range(4):
            here = [v for v, p in known if part in (p, 3)]
            assert below[part] == sum(v < value for v in here) and own[part] == here.count(value)


@pytest.mark.parametrize("name, key", [("model_target_transforms", ["fold", "row_id"]), ("model_y_randomised", ["row_id"])])
def test_each_set_is_not_ranked_anew(spark, monkeypatch, name, key):
    # ranks within ten copies of the table used to be made here
    monkeypatch.setattr(models, "add_ranks", lambda *a, **k: 1 / 0, raising=False)
    con = duckdb.connect()
    con.execute("CREATE VIEW orders AS FROM '/root/testdata/sf0.001/orders.parquet'")
    want = con.execute(catalog.oracle_sql()[name]).df().sort_values(key).reset_index(drop=True)
    got = catalog.queries()[name](spark, "/root/testdata/sf0.001").toPandas().sort_values(key).reset_index(drop=True)
    assert len(got) == len(want) and list(got[key[-1]]) == list(want[key[-1]])
    for c in want.columns:
        assert got[c].to_numpy(float) == pytest.approx(want[c].to_numpy(float), rel=1e-12)
