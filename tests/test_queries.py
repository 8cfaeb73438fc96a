"""Every query with SQL gives the same rows as DuckDB at the smallest scale; the others run and keep their promises."""

import math

import duckdb
import pytest

from tessera import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-8, abs_tol=1e-8)
    return a == b


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: [(v is None, f"{v:.5g}" if isinstance(v, float) else str(v)) for v in r]
    return sorted(([_value(r[i]) for i in order] for r in rows), key=key)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    got, ref = _rows(df.columns, df.collect()), _rows(columns, want.fetchall())
    assert len(got) == len(ref)
    assert all(_same(x, y) for a, b in zip(got, ref) for x, y in zip(a, b))


def test_claims_hold(spark):
    assert all(r.ok for r in catalog.queries()["verify_claims"](spark, DATA).collect())


@pytest.mark.parametrize("name", ["stat_kruskal_wallis_p", "stat_mann_whitney_p"])
def test_tail_probabilities(spark, name):
    assert 0 <= catalog.queries()[name](spark, DATA).first().p <= 1


def test_every_query_without_sql_is_known():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {
        "stat_kruskal_wallis_p", "stat_mann_whitney_p", "verify_claims", "model_ridge",
        "model_boosted_trees", "model_ablation", "model_pca", "model_score_new_row", "stat_model_correlations",
        "model_zoo", "model_challengers", "model_capacity", "stat_feature_ladder", "stat_feature_channels",
    }
