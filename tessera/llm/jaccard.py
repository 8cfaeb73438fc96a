"""N-gram Jaccard join by a MinHash LSH forest.

Every distinct set of word shingles gets MinHash values of one byte. Seven of them, with the tree's number below,
are a tree's label: a whole number whose bytes, from the top, are a path in the tree's prefix trie. Rows sorted by
label lie as in the trie, those under one prefix side by side. Prefixes are shortened value by value, from whole
labels on, until pairs at the threshold meet in some tree with the target recall, by the trees' law and as measured
on sampled rows, whose partners are counted exactly among all rows. Rows under a prefix meet in blocks of bounded
size; a pair is looked at in the first tree where it meets. Labels alone tell which rows may have a partner; only
these get their shingles, by which each pair is verified exactly. Blocks give link counts and a spanning forest,
never pairs.

Edge cases: texts of fewer than ``n`` words are one shingle of all their words; null texts and texts
without a word link with nothing; rows with the same shingles form one class and count as links of each
other; repeated rows with the same id are one document; a null id links with nothing and is its own
class (null); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, components, joined, written

WORDS, THRESHOLD = 5, 0.8
#: Trees, values of a label, and the recall to reach at the threshold.
TREES, DEPTH, RECALL = 24, 7, 0.9999
#: Rows of a prefix that meet at once in one task: by labels, and by shingles (as many as that on the whole).
LABEL_BLOCK, BLOCK, BLOCK_SHINGLES = 4096, 256, 400_000
#: Rows whose partners are counted among all rows to measure recall; those with more shingles are not asked.
ASKED, ASKED_SHINGLES = 400, 2_000
#: Ids of rows to look up or leave out are sent to all tasks up to so many rows; beyond, they are joined by key.
SENT_ROWS = 500_000
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class _Hashes(dict):
    """64-bit hashes of words, remembered for a while."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def shingles(text: str | None, hashes: dict, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``n``-word shingles (lower case, parted by white space)."""
    words = (text or "").lower().encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(n, len(h))
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = _mix(out) + h[i : len(h) - k + 1 + i]
    return np.unique(_mix(out + np.uint64(k)))


def labels_of(sh: np.ndarray, trees: int = TREES) -> np.ndarray:
    """A label for each tree: ``DEPTH`` MinHash values of one byte, the first on top, and the tree's number below."""
    seeds = _mix(np.arange(1, trees * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    flip, odd = (seeds >> np.uint64(32)).astype(np.uint32), seeds.astype(np.uint32) | np.uint32(1)
    short = (sh >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(seeds), np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(short), 256):
        np.minimum(least, ((short[i : i + 256, None] ^ flip) * odd).min(axis=0), out=least)
    values = (_mix(least.astype(np.uint64) + seeds) >> np.uint64(56)).astype(np.uint8).reshape(trees, DEPTH)
    whole = np.concatenate([values, np.arange(trees, dtype=np.uint8)[:, None]], axis=1)
    return np.ascontiguousarray(whole).view(">u8").ravel().astype(np.uint64).view(np.int64)


def cut(label: Column, depth: int) -> Column:
    """The prefix of ``depth`` values of a label, with its tree's number."""
    mask = (((1 << 8 * depth) - 1) << 8 * (DEPTH + 1 - depth)) | 0xFF
    return label.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def law(depth: int, threshold: float = THRESHOLD, trees: int = TREES) -> float:
    """Share of pairs at the threshold that have a prefix of ``depth`` values in common in some tree."""
    return 1 - (1 - threshold**depth) ** trees


def shortened(threshold: float, trees: int, recall: float, seen: list[float] | None = None) -> int:
    """The longest prefix that reaches the recall, by law and, where partners were ``seen``, as measured at each depth."""
    for depth in range(DEPTH, 1, -1):
        if law(depth, threshold, trees) >= recall and (seen is None or seen[depth] >= recall):
            return depth
    return 1


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


def _first_tree(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """For all rows of two label matrices: the first tree in which they share ``depth`` values (else the number of trees)."""
    shift = np.uint64(8 * (DEPTH + 1 - depth))
    a, b = a.view(np.uint64) >> shift, b.view(np.uint64) >> shift
    out = np.full((len(a), len(b)), a.shape[1], np.int16)
    for t in range(a.shape[1] - 1, -1, -1):
        out[a[:, t][:, None] == b[:, t]] = t
    return out


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of paired rows of labels: the share of equal values, less what chance makes equal."""
    trees = a.shape[1]
    same = (np.ascontiguousarray(a).view(np.uint8) == np.ascontiguousarray(b).view(np.uint8)).sum(axis=1)
    return ((same - trees) / (trees * DEPTH) - 1 / 256) / (1 - 1 / 256)


def _hopeful(a: np.ndarray, b: np.ndarray, tree: int, depth: int, loose: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that meet in this tree first and whose estimated similarity is at least ``loose``."""
    xs, ys = [np.zeros(0, int)], [np.zeros(0, int)]
    for i in range(0, len(a), BLOCK):
        for j in range(i if same else 0, len(b), BLOCK):
            meet = _first_tree(a[i : i + BLOCK], b[j : j + BLOCK], depth) == tree
            x, y = np.nonzero(np.triu(meet, 1) if same and i == j else meet)
            near = _alike(a[i + x], b[j + y]) >= loose
            xs.append(i + x[near])
            ys.append(j + y[near])
    return np.concatenate(xs), np.concatenate(ys)


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets, exact."""
    out = np.zeros((len(a), len(b)), np.float32)
    all_a, all_b = np.concatenate(a), np.concatenate(b)
    vocab = np.intersect1d(all_a, all_b)
    for lo in range(0, len(vocab), 8192):
        part = vocab[lo : lo + 8192]
        flags = []
        for rows, values in ((a, all_a), (b, all_b)):
            row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            spot = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[spot] == values
            m = np.zeros((len(rows), len(part)), np.float32)
            m[row[hit], spot[hit]] = 1
            flags.append(m)
        out += flags[0] @ flags[1].T
    return out


class Sample:
    """Shingles of the rows that are asked for partners, in one sorted array, and their labels."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, threshold: float):
        self.sizes, self.labels, self.threshold = np.array([len(s) for s in sets], np.int64), labels, threshold
        values = np.concatenate([np.zeros(0, np.uint64), *sets])
        of, order = np.repeat(np.arange(len(sets)), self.sizes), np.argsort(values, kind="stable")
        self.values, self.of = values[order], of[order]

    def partners(self, sets: list[np.ndarray], labels: list[np.ndarray | None]) -> list[list[int]]:
        """For each set: a code of every asked row that it is a partner of, and of the longest prefix in common."""
        out: list[list[int]] = [[] for _ in sets]
        if not len(self.values) or not sets:
            return out
        lengths = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        lo, hi = np.searchsorted(self.values, flat, "left"), np.searchsorted(self.values, flat, "right")
        hit = np.flatnonzero(hi > lo)
        n = (hi - lo)[hit]
        spots = np.repeat(lo[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())
        row = np.repeat(np.repeat(np.arange(len(sets)), lengths)[hit], n)
        pair, common = np.unique(row * len(self.sizes) + self.of[spots], return_counts=True)
        r, k = np.divmod(pair, len(self.sizes))
        either = lengths[r] + self.sizes[k] - common
        near = (common >= self.threshold * either - 1e-4) & (common < either)
        for r, k in zip(r[near].tolist(), k[near].tolist(), strict=True):
            same = (labels[r] ^ self.labels[k]).astype(">i8").view(np.uint8).reshape(-1, DEPTH + 1)[:, :DEPTH] == 0
            out[r].append(k * (DEPTH + 1) + int(np.minimum.accumulate(same, axis=1).sum(axis=1).max()))
        return out


def measured(classes: DataFrame) -> list[float] | None:
    """Recall at each depth on the asked rows: the lower of an average over pairs and one over rows. None if no row has a partner."""
    met = classes.select(F.explode("met").alias("m")).groupBy("m").agg(F.count("*").alias("n")).toPandas()
    if not len(met):
        return None
    row, depth = np.divmod(met["m"].to_numpy(), DEPTH + 1)
    n = met["n"].to_numpy(float)
    each = n / np.bincount(row, n)[row]
    return [float(min(x[depth >= d].sum() / x.sum() for x in (n, each))) for d in range(DEPTH + 1)]


def in_blocks(df: DataFrame, blocks: Column) -> DataFrame:
    """Deals the rows under each prefix to pairs ``(i, j)`` of blocks, so that all its rows meet in some pair."""
    df = df.withColumn("_n", F.greatest(blocks, F.lit(1)).cast("int"))
    df = df.withColumns({"own": F.pmod(F.xxhash64("class_id", "prefix"), "_n").cast("int"), "_other": F.explode(F.sequence(F.lit(0), F.col("_n") - 1))})
    return df.withColumns({"i": F.least("own", "_other"), "j": F.greatest("own", "_other")}).drop("_n", "_other")


def _sides(rows: pd.DataFrame, i: int, j: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    rows = rows.sort_values("class_id", ignore_index=True)
    if i == j:
        return rows, rows
    return rows[rows["own"] == i].reset_index(drop=True), rows[rows["own"] == j].reset_index(drop=True)


def _forest(u: np.ndarray, v: np.ndarray) -> dict[int, int]:
    """The smallest id that each id reaches by the links."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(u.tolist(), v.tolist(), strict=True):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def _different(rows: DataFrame) -> DataFrame:
    """One prefix of those that hold the same rows, the first tree's: there these rows meet first."""
    who = [F.bit_xor(F.xxhash64(F.lit(i), "class_id")).alias(f"_who{i}") for i in (0, 1)]
    crowds = rows.groupBy("prefix").agg(F.count("*").alias("members"), *who).where("members > 1")
    return crowds.groupBy("members", "_who0", "_who1").agg(F.min_by("prefix", F.col("prefix").bitwiseAND(0xFF)).alias("prefix"))


def sketches(docs: DataFrame, n: int, threshold: float, trees: int, rows: int) -> DataFrame:
    """``doc_id, key, labels, size, met`` of every row: a digest of its shingles, their labels and number, and partners in the sample."""
    draw = F.pmod(F.xxhash64(F.lit(21), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(draw, F.lit(1.0)) < ASKED / max(rows, 1)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            sets = [shingles(t, hashes, n) for t in batch["text"].to_pylist()]
            sets = [s.view(np.int64) for s in sets if 0 < len(s) <= ASKED_SHINGLES]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int64()))], ["sh"])

    # about ASKED sets of bounded size; an id with very many rows is cut, as copies tell nothing new
    asked = docs.where(share).select("text").mapInArrow(sampled, "sh array<long>").dropDuplicates(["sh"]).limit(4 * ASKED).toPandas()["sh"]
    asked = sorted((np.asarray(s, np.int64).view(np.uint64) for s in asked), key=lambda s: s.tolist())
    known = np.array([labels_of(s, trees) for s in asked], np.int64).reshape(-1, trees)
    sent = docs.sparkSession.sparkContext.broadcast((asked, known))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sample = _Hashes(), Sample(*sent.value, threshold)
        for batch in batches:
            sets = [shingles(t, hashes, n) for t in batch["text"].to_pylist()]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            labels = [labels_of(s, trees) if len(s) else None for s in sets]
            columns = [
                batch["doc_id"],
                pa.array(keys, pa.binary()),
                pa.array(labels, pa.list_(pa.int64())),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(sample.partners(sets, labels), pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "labels", "size", "met"])

    return docs.mapInArrow(sketch, "doc_id long, key binary, labels array<long>, size long, met array<int>")


def hopeful_rows(classes: DataFrame, rows: int, trees: int, depth: int, loose: float) -> DataFrame:
    """``class_id, prefix, size`` of rows that, by their labels, may be linked with a row that they meet there first."""
    spread = classes.select("class_id", F.explode("labels").alias("label")).select("class_id", cut(F.col("label"), depth).alias("prefix"))
    crowds = written(_different(spread).select("prefix", "members"), "crowds", rows)
    hot = crowds.where(F.col("members") > F.lit(max(HOT_SHARE * rows * trees, 8.0)))
    # all labels pass here: hot prefixes, at most 1 / HOT_SHARE numbers, are told by a filter
    known = [r["prefix"] for r in hot.select("prefix").collect()]
    met = joined(spread, crowds, hot, "prefix", keys=known).join(classes.select("class_id", "labels", "size"), "class_id")
    met = in_blocks(met, F.ceil(F.col("members") / LABEL_BLOCK)).drop("members")

    def look(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = _sides(rows, key[1], key[2])
        got = rows.iloc[:0]
        if len(a) and len(b):
            x, y = _hopeful(_matrix(a["labels"]), _matrix(b["labels"]), key[0] & 0xFF, depth, loose, a is b)
            got = pd.concat([a.iloc[np.unique(x)], b.iloc[np.unique(y)]])
        return got[["class_id", "prefix", "size"]].drop_duplicates("class_id")

    return met.groupBy("prefix", "i", "j").applyInPandas(look, "class_id long, prefix long, size long").distinct()


def jaccard_links(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """``(doc_id, class_id, n_links, component_id)`` for each distinct id of ``docs(doc_id, text)``.

    ``class_id`` is the smallest id with the same shingles, ``n_links`` the number of other documents at
    ``threshold`` or more, ``component_id`` the smallest id that links lead to.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.count()
    sketched = written(sketches(docs, n, threshold, trees, rows), "sketches")
    # one row a document, then one row a class: documents with the same shingles
    doc = sketched.where("doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("key"))
    # repeated rows of an id with different texts: the smallest key speaks for the id
    known = sketched.where("doc_id is not null and key is not null").groupBy("key")
    known = known.agg(F.first("labels").alias("labels"), F.first("size").alias("size"), F.first("met").alias("met"))
    classes = doc.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    classes = written(classes.join(known, "key"), "classes", rows)

    depth = shortened(threshold, trees, recall, measured(classes))
    # five deviations of the estimate below the threshold
    loose = threshold - 5 * (threshold * (1 - threshold) / (trees * DEPTH)) ** 0.5
    near = written(hopeful_rows(classes, rows, trees, depth, loose), "near", rows)
    wanted = classes.select("class_id", "key").join(near.select("class_id").distinct(), "class_id", "left_semi")
    wanted, n_near = written(wanted, "wanted", rows), near.count()
    known = F.broadcast(wanted) if wanted.count() <= SENT_ROWS else wanted

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            sets = [shingles(t, hashes, n) for t in batch["text"].to_pylist()]
            keys = batch["key"].to_pylist()
            hit = [i for i, s in enumerate(sets) if xxhash.xxh3_128_digest(s.tobytes()) == keys[i]]
            yield pa.RecordBatch.from_arrays(
                [batch["class_id"].take(pa.array(hit, pa.int64())), pa.array([sets[i].view(np.int64) for i in hit], pa.list_(pa.int64()))], ["class_id", "sh"]
            )

    texts = docs.join(known, docs["doc_id"] == known["class_id"]).select("class_id", "key", "text")
    sets = texts.mapInArrow(shingled, "class_id long, sh array<long>").dropDuplicates(["class_id"])
    sets = sets.join(classes.select("class_id", "copies", "labels"), "class_id")
    crowds = near.groupBy("prefix").agg(F.count("*").alias("members"), F.sum("size").alias("whole"))
    hot = crowds.where(F.col("members") > F.lit(max(HOT_SHARE * n_near, 8.0)))
    # a row gets its shingles once for each prefix, before it is dealt to blocks
    full = joined(near, crowds, hot, "prefix").drop("size").join(sets, "class_id")
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("whole") / BLOCK_SHINGLES))
    full = in_blocks(full, blocks).drop("members", "whole")

    def verify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = _sides(rows, key[1], key[2])
        sums: dict[int, int] = {}
        root: dict[int, int] = {}
        if len(a) and len(b):
            x, y = _hopeful(_matrix(a["labels"]), _matrix(b["labels"]), key[0] & 0xFF, depth, loose, a is b)
            use_a, use_b = np.unique(x), np.unique(y)
            if len(x):
                sets_a, sets_b = [a["sh"].iloc[i] for i in use_a], [b["sh"].iloc[i] for i in use_b]
                both = _common(sets_a, sets_b)[np.searchsorted(use_a, x), np.searchsorted(use_b, y)]
                size_a, size_b = (np.array([len(s) for s in side["sh"]]) for side in (a, b))
                linked = both >= threshold * (size_a[x] + size_b[y] - both) - 1e-4
                x, y = x[linked], y[linked]
                ids_a, ids_b = a["class_id"].to_numpy(), b["class_id"].to_numpy()
                for ids, copies, here, there in ((ids_a, b["copies"].to_numpy(), x, y), (ids_b, a["copies"].to_numpy(), y, x)):
                    got = np.bincount(here, weights=copies[there], minlength=len(ids))
                    for p in np.flatnonzero(got):
                        sums[ids[p]] = sums.get(ids[p], 0) + int(got[p])
                root = _forest(ids_a[x], ids_b[y])
        return pd.DataFrame({"class_id": list(sums), "links": list(sums.values()), "root": [root[c] for c in sums]}, dtype="int64")

    found = full.groupBy("prefix", "i", "j").applyInPandas(verify, "class_id long, links long, root long")
    found = written(found, "links", n_near, shuffled=False)
    sums = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("root").alias("u"), F.col("class_id").alias("v")), n_near)
    table = (
        classes.select("key", "class_id", "copies")
        .join(sums, "class_id", "left")
        .join(roots.withColumnRenamed("id", "class_id"), "class_id", "left")
        .withColumns({"n_links": F.col("copies") - 1 + F.coalesce("links", F.lit(0)), "component_id": F.coalesce("component", "class_id")})
        .select("key", "class_id", "copies", "n_links", "component_id")
    )
    hot = table.where(F.col("copies") > F.lit(max(HOT_SHARE * rows, 8.0)))
    out = joined(doc.where("key is not null"), table, hot, "key").select("doc_id", "class_id", "n_links", "component_id")
    alone = [F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id")]
    out = out.unionByName(doc.where("key is null").select("doc_id", *alone))
    return out.unionByName(sketched.where("doc_id is null").select("doc_id", *alone))


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the smallest id; rows without an id stay, as do all rows of a kept id."""
    drop = written(jaccard_links(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_id")), "copies", docs.count())
    if drop.count() <= SENT_ROWS:
        drop = F.broadcast(drop)
    return docs.join(drop, docs["doc_id"].cast("long") == drop["_id"], "left_anti")
