"""Resampling, manifest and shards, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, manifest, queries, resampling, sharding

DATA = "/root/testdata"
MORE = "_row long, _part int, _g string, _i int, _p int, _c int, rank int, score double"


def _rows(docs):
    return [r.asDict() for r in docs.collect()]


def _noise(doc_id):
    h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def _resampled(docs, target, percent=5):
    s, t = Counter(), Counter()
    for d in docs:
        s.update(_features(d["text"])[1])
    for b in target:
        t.update(_features(b["text"])[1])
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    out = []
    for d in docs:
        n, f = _features(d["text"])
        w = sum(map(gain, f))
        out.append([d["doc_id"], len(f), w, w + _noise(d["doc_id"]), None, n])
    drawn = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = i + 1
    return sorted(map(repr, (tuple(r[:5]) for r in out)))


def _got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_resampling_equals_brute_force(spark):
    sf = f"{DATA}/sf0.01"
    got = queries.op11_resampling(spark, sf)
    assert [c for c, t in got.dtypes if t == "bigint"] == ["doc_id", "n_features", "weight", "score", "rank"]
    want = _resampled(_rows(common.documents(spark, sf)), _rows(common.benchmark(spark, sf)))
    assert _got(got) == want


def test_resampling_of_odd_rows(spark, odd_documents, no_documents):
    target = odd_documents.where("doc_id in (5, 6)").select("text")
    for docs in (odd_documents, odd_documents.union(odd_documents).withColumn("rank", F.lit(1)).repartition(3)):
        for percent in (5, 40):
            assert _got(resampling.resample(docs, target, percent)) == _resampled(_rows(docs), _rows(target), percent)
    assert resampling.resample(no_documents, target).collect() == []
    assert resampling.resample(odd_documents, target.limit(0)).count() == odd_documents.count()


def test_resampling_reads_texts_that_are_not_utf8(spark):
    docs = spark.sql("select 1L as doc_id, cast(X'61FF6220' as string) as text")
    assert resampling.resample(docs, docs).first().n_features == 1


@pytest.mark.parametrize("spread", [1, 3, 1 << 20, 1 << 40])
def test_border_is_the_exact_kth_key(spark, spread):
    rng = np.random.default_rng(spread)
    n = 2000
    score = rng.integers(-spread, spread, n, endpoint=True)
    score[: n // 3] = 7 % (spread + 1)  # a third of all rows share a score
    ids = [None if i % 50 == 0 else int(i) for i in rng.integers(-5, n // 4, n)]
    rows = [(i, int(s), int(f), k) for k, (i, s, f) in enumerate(zip(ids, score, rng.integers(0, 3, n)))]
    df = spark.createDataFrame(rows, "doc_id long, score long, n_features long, _row long")
    order = [r[3] for r in sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0, r[2], r[3]))]
    for k in (1, n // 3, n - 1, n):
        taken = {r[0] for r in df.where(resampling.border(df, k).takes()).select("_row").collect()}
        assert taken == set(order[:k])


# --- manifest


def _h(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def _leaf(d, **changed):
    out = []
    for c in ("doc_id", "source", "lang", "n_chars", "text"):
        v = changed.get(c, d[c])
        out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return _h(*out)


def _tree(nodes, fanout):
    """Levels from the leaves to the top."""
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [_h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        levels.append(nodes)
    return levels


def _path(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        a = i // fanout * fanout
        out.append((level[a:i], level[i + 1 : a + fanout]))
        i //= fanout
    return out


def _manifested(docs, fanout=2):
    by = defaultdict(list)
    for d in docs:
        by[d["lang"]].append((d["doc_id"] is not None, d["doc_id"] or 0, _leaf(d), d))
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _tree([x[2] for x in sorted(by[g], key=lambda x: x[:3])], fanout) for g in langs}
    top = _tree([trees[g][-1][0] for g in langs], fanout)
    out = []
    for n, g in enumerate(langs):
        for i, (_, _, leaf, d) in enumerate(sorted(by[g], key=lambda x: x[:3])):
            path = _path(trees[g], i, fanout) + _path(top, n, fanout)
            hit = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 7 == 0 and d["n_chars"] is not None
            h = _leaf(d, n_chars=d["n_chars"] + 1) if hit else leaf
            for left, right in path:
                h = _h(*left, h, *right)
            proof = _h(*[x for left, right in path for x in (*left, *right)])
            out.append(repr((d["doc_id"], leaf, trees[g][-1][0], top[-1][0], proof, h, h == top[-1][0])))
    return sorted(out)


def test_manifest_equals_brute_force(spark):
    got = queries.op12_merkle_manifest(spark, f"{DATA}/sf0.001")
    assert _got(got) == _manifested(_rows(common.documents(spark, f"{DATA}/sf0.001")))
    assert 0 < got.where("not verified").count() < got.count()


def test_manifest_sql_equals_brute_force(spark):
    docs = _rows(common.documents(spark, f"{DATA}/sf0.01"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/sf0.01/documents.parquet'")
    assert sorted(map(repr, con.execute(manifest.oracle_sql()).fetchall())) == _manifested(docs)


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest_of_odd_rows(spark, odd_documents, fanout):
    docs = odd_documents.drop("key").withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in MORE.split(", ")}).repartition(3)
    twice = docs.where("doc_id <> 8").union(docs)
    for df in (twice, docs.where("lang = 'en'"), docs.where("doc_id = 8")):
        assert _got(manifest.manifest(df, manifest.tampered(), fanout)) == _manifested(_rows(df), fanout)


def test_manifest_of_many_languages(spark):
    rows = [(i, f"t{i}", None if i % 37 == 0 else f"l{i % 37 % 23}é", "s", 2) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert _got(manifest.manifest(df, manifest.tampered())) == _manifested(_rows(df))


def test_manifest_of_no_rows(spark, no_documents):
    assert manifest.manifest(no_documents, manifest.tampered()).collect() == []


def test_manifest_numbers_a_hot_key_in_many_ranges(spark):
    rows = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), F.lit("a").alias("g"), "id")
    ranged = common.range_sorted(rows.repartition(5), [F.col("g"), F.col("k"), F.col("id")], "test")
    got = common.numbered(ranged, "n", "g", "c").orderBy("n").collect()
    assert [r.n for r in got] == list(range(4000)) and {r.c for r in got} == {4000}
    assert [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)


# --- shards


def _probability(k, good, bad, take):
    return math.comb(good, k) * math.comb(bad, take - k) / math.comb(good + bad, take)


@pytest.mark.parametrize("good, bad, take", [(7, 5, 4), (3, 40, 20), (0, 5, 3), (5, 0, 3), (30, 30, 30), (2, 3, 5)])
def test_hypergeometric_numbers_follow_their_law(good, bad, take):
    rng, n = np.random.default_rng(1), 20_000
    got = Counter(sharding.hypergeometric(rng, good, bad, take) for _ in range(n))
    for k in range(min(good, take) + 1):
        p = _probability(k, good, bad, take) if 0 <= take - k <= bad else 0
        assert abs(got[k] / n - p) <= 5 * math.sqrt(p * (1 - p) / n) + 1e-9


def test_hypergeometric_numbers_of_large_tables():
    rng, good, bad, take = np.random.default_rng(2), 10**11, 7 * 10**11, 10**8
    got = np.array([sharding.hypergeometric(rng, good, bad, take) for _ in range(400)])
    mean = take * good / (good + bad)
    sd = math.sqrt(take * good / (good + bad) * bad / (good + bad))
    assert abs(got.mean() - mean) < 5 * sd / 20 and 0.85 < got.std() / sd < 1.15


def test_matrix_has_both_margins():
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 50, 100).tolist()
    total = sum(sizes)
    room = [total // 8 + (s < total % 8) for s in range(8)]
    got = np.array(sharding.matrix(rng, sizes, room))
    assert got.sum(1).tolist() == sizes and got.sum(0).tolist() == room and got.min() >= 0


def test_shards_of_documents(spark):
    sf = f"{DATA}/sf0.01"
    docs = {d["doc_id"]: d["text"] or "" for d in _rows(common.documents(spark, sf))}
    got = queries.op13_sharding(spark, sf).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()}
    assert len(got) == len(docs) and all(r.law == "rows" and r.grown_shard is None for r in got)
    of = defaultdict(list)
    for r in got:
        of[r.shard].append(r.slot)
    assert set(of) == set(range(8)) and max(map(len, of.values())) - min(map(len, of.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in of.values())
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op13_sharding(spark, sf).collect()))


def test_every_row_may_go_anywhere(spark):
    """Shards and slots of 24 rows over many seeds: each place equally often, also for rows of one part."""
    df = spark.range(0, 24, 1, 3)
    n, where, together = 30, np.zeros((24, 8)), 0
    for seed in range(n):
        got = sorted(map(tuple, sharding.shuffled(df, 8, seed).collect()))
        assert Counter(s for _, s, _ in got) == {s: 3 for s in range(8)}
        for i, s, _ in got:
            where[i, s] += 1
        together += got[0][1] == got[1][1]
    chi = ((where - n / 8) ** 2 / (n / 8)).sum()
    assert 24 * 7 * 0.65 < chi < 24 * 7 * 1.4
    assert together / n < 0.4  # 2 of 23 are the law's share


def test_shards_of_odd_rows(spark, odd_documents, no_documents, monkeypatch):
    monkeypatch.setattr(sharding, "PART_BITS", 1)
    monkeypatch.setattr(sharding, "GROUP_PARTS", 2)
    got = sharding.sharded_documents(odd_documents.repartition(2)).collect()
    assert Counter(Counter(r.shard for r in got).values()) == {2: 5, 1: 3}
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((r.doc_id or -1, len((r.text or "").encode()) + 1) for r in odd_documents.collect())
    assert sharding.sharded_documents(no_documents).collect() == []
    few = sharding.sharded_documents(odd_documents.limit(3)).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]
