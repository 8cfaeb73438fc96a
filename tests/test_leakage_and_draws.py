"""Leakage without joins, and draws by digest without rows of draws."""

import hashlib

import numpy as np
import pytest

from tessera.operators import bootstrap, folds


def test_leakage_equals_loops_and_joins_nothing(spark):
    rng = np.random.default_rng(8)
    rows = [(int(p), f"d{p // 40}", int(f)) for p, f in zip(rng.integers(1, 400, 120), rng.integers(0, 3, 120))]
    df = spark.createDataFrame(rows, "pos int, domain string, fold int")
    out = folds.leakage(df, "fold", 5)
    got = out.first()
    rates = []
    for f in {r[2] for r in rows}:
        mine, other = [r for r in rows if r[2] == f], [r for r in rows if r[2] != f]
        rates.append([np.mean([any(t(r, o) for o in other) for r in mine]) for t in (lambda r, o: r[0] == o[0], lambda r, o: abs(r[0] - o[0]) <= 5, lambda r, o: r[1] == o[1])])
    assert (got.shared_position_rate, got.neighbour_within_5_rate, got.same_domain_rate) == pytest.approx(tuple(np.mean(rates, 0)))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_digest_draws_equal_counted_picks(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "BLOCK", 7)
    df = spark.createDataFrame([(3 * i,) for i in range(30)], "unit int")
    got = {r.unit: np.frombuffer(r._w, np.uint16) for r in bootstrap.draw_arrays(df, "unit", 6, "u").collect()}
    want = np.zeros((30, 6), int)
    for rep in range(6):
        for i in range(30):
            want[int(hashlib.md5(f"u:{rep}:{i}".encode()).hexdigest()[:8], 16) % 30, rep] += 1
    assert all((got[3 * i] == want[i]).all() for i in range(30))
