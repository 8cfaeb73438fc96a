"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a toxic probability, a logistic function of its words;
the document's is their noisy-or, one minus the product of their complements. Only documents carry
labels: the gradient of the noisy-or passes their error to the sentences. Sentences above one half are
the offending ones.

Edge cases: a null or empty text has no sentence and scores 0; null labels and labels without a document
are not learned from; of rows that repeat a labelled id, the greatest text is; repeated rows each get their row; without any labelled row every score is 0; other
columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder

#: The fit takes about so many labelled documents of each label at most, those with the smallest seeded hashes, with
#: texts up to so many characters.
SAMPLE_ROWS, SAMPLE_CHARS = 4_000, 200_000
#: Words of at least so many sampled documents get a weight; at most so many words.
LEAST_DOCS, MOST_WORDS = 4, 60_000
_SENTENCE = re.compile(r"[^.!?\n]+")
_TRIM = ".,;:!?\"'()[]{}<>|*#$%&-_/\\"


def features(word: str) -> tuple[str, ...]:
    """A word stands for itself and for its beginnings, which inflected forms share."""
    return (word, *(f"^{word[:k]}" for k in (4, 5, 6) if len(word) >= k))


class _Kept(dict):
    """Results of a function of words, remembered for a while."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, word: str):
        if len(self) > 50_000:
            self.clear()
        got = self[word] = self.compute(word)
        return got


def _trimmed(word: str) -> str:
    return word.strip(_TRIM)


def lowered(text: str | None) -> str:
    """The text in lower case; a letter that would become several stays, so that places stay the same."""
    low = (text or "").lower()
    if len(low) != len(text or ""):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low


def sentences(text: str | None, trimmed: dict | None = None) -> list[tuple[int, int, set[str]]]:
    """Start, end and distinct words of each sentence that has a word: what the fit and the score both see."""
    get = _trimmed if trimmed is None else trimmed.__getitem__
    out = []
    for m in _SENTENCE.finditer(lowered(text)):
        words = set(map(get, m[0].split()))
        words.discard("")
        if words:
            out.append((m.start(), m.end(), words))
    return out


class NoisyOr:
    """Feature weights and the sentence bias. A sentence adds up its distinct words, a word its features."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.trimmed = _Kept(_trimmed)
        self.words = _Kept(lambda word: sum(weights.get(f, 0.0) for f in features(word)))

    def score(self, text: str | None) -> tuple[float, int, list[tuple[int, int, float]]]:
        """The document's probability, its number of sentences, and spans of the offending ones."""
        get, bias = self.words.__getitem__, self.bias
        parts = [(s, e, bias + sum(map(get, words))) for s, e, words in sentences(text, self.trimmed)]
        if not parts:
            return 0.0, 0, []
        z = np.array([p[2] for p in parts])
        toxic = [(s, e, 1 / (1 + float(np.exp(-x)))) for s, e, x in parts if x > 0]
        return float(-np.expm1(-np.logaddexp(0.0, z).sum())), len(parts), toxic


def fit_noisy_or(texts: list[str], labels: np.ndarray, epochs: int = 30, l2: float = 2e-4, seed: int = 7) -> NoisyOr:
    """Fits weights by Adam on mini-batches of documents."""
    seen: Counter = Counter()
    for text in texts:
        seen.update({f for s in sentences(text) for word in s[2] for f in features(word)})
    words = sorted(w for w, c in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:MOST_WORDS] if c >= LEAST_DOCS)
    at = {w: i for i, w in enumerate(words)}
    if not len(labels) or not words:
        return NoisyOr({}, -30.0)
    # for each document: its sentences' features end to end, and how many each sentence has
    flats, sizes = [], []
    for text in texts:
        rows = [sorted(at[f] for word in s[2] for f in features(word) if f in at) for s in sentences(text)]
        flats.append(np.array([i for r in rows for i in r], dtype=np.int32))
        sizes.append(np.array([len(r) for r in rows], dtype=np.int32))
    rng = np.random.default_rng(seed)
    w, b = np.zeros(len(words)), -6.0
    l2 = max(l2, 0.5 / len(labels))
    m, v, mb, vb, step = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0
    rate = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    side = np.where(labels > 0, 0.5 / rate, 0.5 / (1 - rate))
    order = np.flatnonzero([len(x) > 0 for x in sizes])
    for epoch in range(epochs):
        rng.shuffle(order)
        lr = 0.15 if epoch < epochs // 2 else 0.05 if epoch < epochs * 4 // 5 else 0.015
        for part in np.array_split(order, max(1, len(order) // 128)):
            size = np.concatenate([sizes[i] for i in part])
            doc = np.repeat(np.arange(len(part)), [len(sizes[i]) for i in part])
            flat = np.concatenate([flats[i] for i in part])
            of = np.repeat(np.arange(len(size)), size)
            z = b + np.bincount(of, weights=w[flat], minlength=len(size))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            q = np.bincount(doc, weights=np.logaddexp(0.0, z), minlength=len(part))
            whole = -np.expm1(-q)
            y = labels[part]
            pull = np.where(y > 0, np.exp(-q) / np.maximum(whole, 1e-9), -1.0) * side[part]
            g = -pull[doc] * p
            gw = np.bincount(flat, weights=g[of], minlength=len(w)) / len(part) + l2 * w
            gb = g.sum() / len(part)
            step += 1
            m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
            w -= lr * (m / fix) / (np.sqrt(v / fix2) + 1e-4)
            b -= lr * (mb / fix) / (np.sqrt(vb / fix2) + 1e-4)
    return NoisyOr({x: float(w[i]) for x, i in at.items()}, float(b))


def train(docs: DataFrame, labels: DataFrame, seed: int = 7, sample_rows: int = SAMPLE_ROWS) -> NoisyOr:
    """Fits on a bounded seeded sample of the labelled documents outside the held-out fold."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(remainder("doc_id", 5) != 0)
    totals = {r["y"]: r["n"] for r in known.groupBy((F.col("toxic") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") > 0, sample_rows / max(totals.get(True, 0), 1)).otherwise(sample_rows / max(totals.get(False, 0), 1))
    picked = known.where(draw < share).withColumnRenamed("doc_id", "_id")
    # rows that lack a label never shuffle their texts: the picked ids are few by construction, and each gives one text
    rows = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS)
    rows = rows.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).groupBy("_id", "toxic").agg(F.max("text").alias("text"))
    rows = rows.toPandas().sort_values("_id", ignore_index=True)
    return fit_noisy_or(rows["text"].tolist(), (rows["toxic"].to_numpy() > 0).astype(float))


def score_documents(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """``doc_id, score, n_sentences, offending`` (spans and probabilities of toxic sentences) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = NoisyOr(*sent.value)
        for batch in batches:
            rows = [model.score(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([r[0] for r in rows], pa.float64()),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([[{"start": s, "end": e, "p": p} for s, e, p in r[2]] for r in rows], pa.list_(span)),
                ],
                ["doc_id", "score", "n_sentences", "offending"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        score, "doc_id long, score double, n_sentences int, offending array<struct<start:int,end:int,p:double>>"
    )


def clean_documents(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """``docs`` without those that score ``at`` or more."""
    model = train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = NoisyOr(*sent.value)
        for batch in batches:
            yield batch.filter(pa.array([model.score(t)[0] < at for t in batch["text"].to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
