"""Operators on embeddings, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, neardup, queries, topk

DATA = "/root/testdata"

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, x string"


@pytest.fixture(scope="module")
def odd_vectors(spark):
    one = [1.0, 0.5, 0.0, -1.0]
    rows = [(1, one), (2, [2.0, 1.0, 0.0, -2.0]), (3, None), (4, []), (5, [0.0] * 4), (6, [float("nan"), 1.0, 1.0, 1.0])]
    rows += [(7, [None, 1.0, 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0, 1.0]), (None, one), (9, [1.0, 2.0]), (1, one), (20, one), (40, [-1.0, -0.5, 0.0, 1.0])]
    return spark.createDataFrame([(i, v, None, 1, "x") for i, v in rows], SCHEMA)


def _clusters(n=1500, groups=60, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 64))
    of = np.concatenate([np.zeros(n // 2, int), rng.integers(0, groups, n - n // 2)])
    return (centres[of] + rng.normal(size=(n, 64)) * rng.choice([0.05, 0.3, 0.45], size=n)[:, None]).astype(np.float32)


def test_near_duplicates_equal_brute_force(spark):
    x = _clusters()
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(7)
    got = neardup.near_duplicates(df).toPandas().sort_values("vec_id")
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    found = got.n_links.sum() / link.sum()
    assert 0.98 <= found <= 1 and (got.n_links.to_numpy() <= link.sum(1)).all()
    assert (got.kept == (got.vec_id == got.component_id)).all()


def _linked(spark, x):
    """Links found and links there are, of each vector."""
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(4)
    got = neardup.near_duplicates(df).toPandas().sort_values("vec_id")
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    return got.n_links.to_numpy(), link.sum(1)


def _pairs(rng, n, cosine):
    """Vectors two by two at about that cosine."""
    a, b = rng.normal(size=(2, n, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return np.concatenate([a, cosine * a + (1 - cosine**2) ** 0.5 * b])


def test_a_dense_group_does_not_speak_for_the_rest(spark):
    rng = np.random.default_rng(1)
    hot = rng.normal(size=64) + 0.02 * rng.normal(size=(1300, 64))
    got, want = _linked(spark, np.concatenate([hot, _pairs(rng, 1400, 0.91)]))
    assert got[1300:].sum() >= 0.995 * want[1300:].sum() and want[1300:].sum() >= 2800 and (got[:1300] == 1299).all()


def test_rare_near_copies_are_found(spark):
    rng = np.random.default_rng(2)
    rare = _pairs(rng, 12, 0.91)
    got, want = _linked(spark, np.concatenate([rare, rng.normal(size=(6000, 64))]))
    assert (got == want).all() and want.sum() == 24


def test_rare_links_and_lengths(spark, monkeypatch):
    """One vector in a hundred has partners, and lengths are mixed: few of one length, an index of another."""
    monkeypatch.setattr(neardup, "WHOLE_BLOCK", 500)
    rng = np.random.default_rng(5)
    x = np.concatenate([_pairs(rng, 60, 0.92), rng.normal(size=(11_880, 64))])
    short = _pairs(rng, 20, 0.93)[:, :40]
    short = np.concatenate([short, short[:5]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(50_000 + i, v.tolist()) for i, v in enumerate(short)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)).toPandas().sort_values("vec_id")
    found = 0
    for part, have in ((x, got.n_links[:12_000]), (short, got.n_links[12_000:])):
        u = part.astype(np.float32).astype(float)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        link = u @ u.T >= 0.9
        np.fill_diagonal(link, False)
        assert (have.to_numpy() <= link.sum(1)).all() and have.sum() >= 0.99 * link.sum() > 0
        found += have.sum()
    assert found >= 120


def test_a_vector_of_many_rows(spark):
    rng = np.random.default_rng(6)
    one = rng.normal(size=64)
    x = np.concatenate([np.tile(one, (700, 1)), [one * 2, one + 0.01], rng.normal(size=(800, 64))])
    got, want = _linked(spark, x)
    assert (got == want).all() and got[:702].tolist() == [701] * 702


def test_all_pairs_where_probes_do_not_reach(spark, monkeypatch):
    monkeypatch.setattr(neardup, "DEEP", 5)
    monkeypatch.setattr(neardup, "WHOLE_BLOCK", 700)
    got, want = _linked(spark, _pairs(np.random.default_rng(3), 1000, 0.91))
    assert (got == want).all() and want.sum() >= 2000


def test_traversal_visits_the_nearest_cells():
    x = _clusters(50, 5)
    index = neardup.MultiIndex(*(neardup.codebook(h.astype(float), 6) for h in neardup._halves(x)))
    a, b = neardup._halves(x.astype(float))
    every = (neardup._distances(a, index.first)[:, :, None] + neardup._distances(b, index.second)[:, None, :]).reshape(len(x), -1)
    got = index.nearest(x.astype(float), 9)
    assert np.allclose(np.take_along_axis(every, got, 1), np.sort(every, axis=1)[:, :9])


def test_near_duplicates_odd_rows(spark, odd_vectors):
    got = neardup.near_duplicates(odd_vectors).toPandas()
    assert len(got) == 13
    links = dict(zip(got.vec_id, got.n_links))
    assert links[1] == links[2] == links[20] == 2 and links[5] == links[6] == links[3] == links[9] == 0
    assert got[got.vec_id == 20].component_id.tolist() == [1] and got.kept.sum() == 11
    assert neardup.near_duplicates(odd_vectors.limit(0)).count() == 0


def _brute_top(ids, x, queries_, k):
    out = []
    for q in queries_:
        s = x @ x[ids.index(q)]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:k]
        out += [(q, r, ids[i], int(s[i])) for r, i in enumerate(order, 1)]
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 400)
    monkeypatch.setattr(topk, "QUERIES", 30)
    x = np.round(_clusters(1200), 1)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0).collect()
    whole = np.floor(64 * x.astype(np.float32).astype(float)).astype(int)
    assert sorted(map(tuple, got)) == sorted(_brute_top(list(range(1200)), whole, range(0, 1200, 20), 20))


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for top in (50, 1e9, 1e200):
        rows, q = np.floor(rng.uniform(-top, top, (600, 8))), np.floor(rng.uniform(-top, top, (9, 8)))
        ends = topk.Cells.fitted(rows[:300], rows.min(0), rows.max(0))
        low, high = ends.bounds(q, ends.of(rows))
        exact = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in rows] for x in q]
        assert all(int(a) <= e <= int(b) for la, le, lb in zip(low.tolist(), exact, high.tolist()) for a, e, b in zip(la, le, lb) if abs(a) < 1e308 and abs(b) < 1e308)


def test_few_exact_vectors_are_read(spark):
    df = spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet")
    rows = topk.whole_vectors(df)
    n, asked = rows.count(), rows.where("vec_id % 20 = 0").count()
    read = topk.survivors(rows, F.col("vec_id") % 20 == 0, 20).count()
    assert 20 * asked <= read < 0.1 * n * asked


def test_exact_vectors_are_read_until_certain(spark, monkeypatch):
    """With four cells a component, bounds leave many rows; in their order, few are read."""
    monkeypatch.setattr(topk, "CELLS", 4)
    monkeypatch.setattr(topk, "FIRST", 1)
    monkeypatch.setattr(topk, "GROWTH", 2)
    x = np.round(_clusters(900, 30, 3), 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    read, real = [], topk._scored
    monkeypatch.setattr(topk, "_scored", lambda pairs, *a: read.append(pairs.count()) or real(pairs, *a))
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 5).collect()
    whole = np.floor(64 * x.astype(np.float32).astype(float)).astype(int)
    assert sorted(map(tuple, got)) == sorted(_brute_top(list(range(900)), whole, range(0, 900, 20), 5))
    left = topk.survivors(topk.whole_vectors(df), F.col("vec_id") % 20 == 0, 5).count()
    assert len(read) > 1 and read[0] == 45 * 5 and sum(read) < left


def test_top_k_of_copies_and_large_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 64)
    rng = np.random.default_rng(4)
    x = [rng.normal(size=4).tolist() for _ in range(200)]
    x[50:150] = [[0.5, -0.25, 1.0, 0.0]] * 100  # copies
    x[7], x[21], x[40] = [1e30, 1.0, 0.0, -1e30], [2.0e9, 3.0, -5.0, 1.0e9], [1e300, -1e300, 1e308, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)] + [(1000, [1.0, 2.0]), (1020, [3.0, 4.0])], "vec_id long, embedding array<double>")
    whole = [[int(np.floor(64 * c)) if abs(64 * c) < 1e300 else int(max(min(64 * c, np.finfo(float).max), -np.finfo(float).max)) for c in v] for v in x]
    want = []
    for q in range(0, 200, 20):
        s = [max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(whole[q], v)))) for v in whole]
        order = sorted((i for i in range(200) if i != q), key=lambda i: (-s[i], i))[:20]
        want += [(q, r, i, s[i]) for r, i in enumerate(order, 1)]
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(r for r in got if r[0] < 1000) == sorted(want)
    assert sorted(r for r in got if r[0] >= 1000) == [(1000, 1, 1020, 64 * 64 * 11), (1020, 1, 1000, 64 * 64 * 11)]


def test_top_k_odd_rows(odd_vectors):
    got = topk.top_k(odd_vectors, F.col("vec_id") % 20 == 0).toPandas()
    assert got.query_id.drop_duplicates().tolist() and set(got.query_id) == {20, 40}
    assert got[got.query_id == 20].sort_values("rank").vec_id.tolist() == [2, 1, 5, 40]
    assert topk.top_k(odd_vectors.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(odd_vectors.where("vec_id is null"), F.lit(True)).count() == 0


def test_query_runs_on_all_rows(spark):
    assert queries.op8_embedding_dedup(spark, f"{DATA}/sf0.001").count() == spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").count()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7)] + [(1000, k) for k in range(1001, 1400)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert set(got[i] for i in range(41)) == {0} and got[150] == got[200] == got[100] == 100
    assert all(got[k] == 1000 for k in range(1000, 1400)) and len(got) == 41 + 3 + 400
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_planes_leave_out_no_link():
    """Cells without a link may be left out, others not; and in groups most are."""
    x = _clusters(1200, 40, 9).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = neardup.MultiIndex(*(neardup.codebook(h.copy(), 7) for h in neardup._halves(x)))
    own, near = index.cells(x), index.nearest(x, 49, 0.9)
    i, j = np.nonzero(x @ x.T >= 0.9)
    assert (near[i] == own[j][:, None]).any(1).all() and (near == -1).mean() > 0.5


def test_index_serves_few_and_sparse_vectors(spark):
    """A table of a few hundred vectors has a grid; so has one in which hardly a vector has a partner."""
    df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(neardup_units(_clusters(500, 30, 4)))], "vec_id long, copies long, x array<double>")
    index, _, _ = neardup.build(df)
    assert len(index.first) * len(index.second) > 1
    rng = np.random.default_rng(8)
    x = np.concatenate([_pairs(rng, 60, 0.95), rng.normal(size=(29_880, 64))])
    df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(neardup_units(x))], "vec_id long, copies long, x array<double>")
    index, probes, deep = neardup.build(df.repartition(8))
    cells = len(index.first) * len(index.second)
    assert cells > 500 and probes < cells / 2
    got, want = _linked(spark, x)
    assert (got <= want).all() and got.sum() >= 0.95 * want.sum() == 114


def neardup_units(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)
