"""Units whose means are equal tie, in whatever order their rows come."""

from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera import catalog
from tessera.sources.assay import assay


def test_equal_units_tie(spark, tmp_path):
    orders = "/root/testdata/sf0.001/orders.parquet"
    shifted = "o_orderkey + 1500 * k AS o_orderkey, o_custkey + 150 * k AS o_custkey, * EXCLUDE (o_orderkey, o_custkey)"
    duckdb.connect().execute(f"COPY (SELECT {shifted} FROM '{orders}', range(0, 6) t(k) ORDER BY hash(o_orderkey, k)) TO '{tmp_path}/orders.parquet' (ROW_GROUP_SIZE 2048)")
    rows = assay(spark, str(tmp_path)).toPandas()
    got = {r.window_size: r.spearman for r in catalog.queries()["stat_aggregation_ladder"](spark, str(tmp_path)).collect()}
    for w, r in got.items():
        units = rows.groupby((rows.pos - 1) // w)
        exact = [Fraction(sum(round(100 * x) for x in g), len(g)) for _, g in units.score]
        place = {v: i for i, v in enumerate(sorted(set(exact)))}
        ranks = pd.DataFrame({"y": [place[v] for v in exact], "a": units.pred_a.mean().to_numpy()}).rank()
        assert r == pytest.approx(np.corrcoef(ranks.y, ranks.a)[0, 1], abs=1e-12)
