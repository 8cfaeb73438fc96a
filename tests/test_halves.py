"""Split halves from blocks of rows against a loop over groups, and digests against hashlib."""

import hashlib

import numpy as np
import pytest

from tessera.functions.digests import Digests
from tessera.operators import reliability


@pytest.mark.parametrize("size", [0, 3, 45, 70])
def test_digests_equal_hashlib(size):
    tails = [(":" + str(i) * 9)[: size and 1 + i % size].encode() for i in range(300)]
    for head in (b"h:7", b"h:123"):
        high, low = Digests(tails).of(head)
        assert [f"{a:016x}{b:016x}" for a, b in zip(high, low)] == [hashlib.md5(head + t).hexdigest() for t in tails]


def _loop(rows, unit, reps):
    out = []
    for rep in range(reps):
        groups = {}
        for key, pos, y in rows:
            groups.setdefault(unit(pos), []).append((hashlib.md5(f"h:{rep}:{key}".encode()).hexdigest(), y))
        halves = []
        for g in groups.values():
            if len(g) >= 4:
                y, h = [v for _, v in sorted(g)], len(g) // 2
                sides = [[v for v in part if v is not None] for part in (y[:h], y[h : 2 * h])]
                halves.append([np.mean(s) if s else np.nan for s in sides])
        x = np.array(halves)
        x = x[~np.isnan(x).any(1)]
        out.append(np.corrcoef(x.T)[0, 1])
    return np.mean(out), len(halves)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    return [(i, int(p), None if rng.random() < 0.1 else float(y)) for i, (p, y) in enumerate(zip(rng.integers(1, 120, 900), rng.normal(size=900)))]


def test_halves_of_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(reliability, "HALVES_ROWS", 100)
    df = spark.createDataFrame(rows, "row_id long, pos int, y double").repartition(3)
    one = reliability.split_half(df, ["pos"], "y", "row_id", 5).first()
    r, n = _loop(rows, lambda p: p, 5)
    assert one.n_groups == n and one.split_half_r == pytest.approx(r, abs=1e-12)
    for row in reliability.split_half_windows(df, "pos", "y", "row_id", 5, (1, 3, 7)).collect():
        r, n = _loop(rows, lambda p: (p - 1) // row.window_size, 5)
        assert row.n_groups == n and row.split_half_r == pytest.approx(r, abs=1e-12)


def test_repeats_are_not_rows(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, pos int, y double")
    plan = reliability.split_half(df, ["pos"], "y", "row_id", 5)._jdf.queryExecution().toString()
    assert "explode(sequence" not in plan
