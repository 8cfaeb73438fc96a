"""Importance resampling towards a target distribution.

Words and runs of up to three words are hashed to buckets. A bucket's gain is the logarithm of its smoothed share in
the target over its share in the corpus; a document's weight is the sum of its features' gains. With Gumbel noise from
a hash of its id, the highest scores are a draw without replacement in proportion to the exponential of the weights.

Weights are scored by array: a document's features are one array of bucket numbers, which indexes the array of all
gains. The k-th key among all rows is found by radix selection: counts of one key digit a pass, among the rows that
share the digits found so far. Only rows up to that key are sorted by range and ranked.

Edge cases: null and empty texts have no words; texts need not be valid UTF-8; a null id draws the noise of an empty id
and comes after all others among equal scores; rows that repeat an id are rows of their own, those with fewer features
first; an empty table gives an empty result. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, range_sorted, written

BUCKETS = 10_000
#: Runs of one to so many words are features.
LONGEST = 3
#: Documents with fewer words are scored and never drawn.
LEAST_WORDS = 20
#: Scores are in thousandths.
SCALE = 1000
SEED = 42

#: Letters in lower case; all other bytes below 0x80 but digits are blanks, so that ``split`` gives the words.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _hashed(text: bytes | None) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every feature.

    The checksum of a longer run goes on from that of the run without its last word.
    """
    words = (text or b"").translate(_PLAIN).split()
    runs = hashes = list(map(crc32, words))
    spaced = [b" " + w for w in words]
    for n in range(1, LONGEST):
        runs = list(map(crc32, spaced[n:], runs))
        hashes = hashes + runs
    return len(words), np.array(hashes, np.int64) % BUCKETS


def feature_counts(texts: DataFrame) -> np.ndarray:
    """Features of all texts in each bucket; the driver gets one number a bucket, summed before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(_hashed(text.as_py())[1], minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    parts = texts.select(F.col("text").cast("binary")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths, rounded down."""
    every, wanted = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    share = [float(t + 1) * every / (float(s + 1) * wanted) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(SCALE * math.log(x)) for x in share], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the sum of the gains of a document's features."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words, buckets = _hashed(text.as_py())
                rows.append((words, len(buckets), int(gain[buckets].sum())))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


# --- radix selection

#: Bits of a key digit: a pass counts at most 2 ** DIGIT of them.
DIGIT = 16


def key() -> list[Column]:
    """The order of a draw: whole numbers without nulls, each ascending. Bitwise not turns the score around."""
    doc_id = F.col("doc_id")
    return [F.bitwise_not("score"), doc_id.isNull().cast("long"), F.coalesce(doc_id, F.lit(0)), F.col("n_features"), F.col("_row")]


@dataclass
class Border:
    """The key of the last row that is taken, as far as it decides."""

    values: list[int]

    def takes(self) -> Column:
        """Whether a row's key is no higher."""
        inner = lambda rest, at: (at[0] < at[1]) | ((at[0] == at[1]) & rest)
        return reduce(inner, reversed([*zip(key(), self.values)]), F.lit(True))


def _digits(rows: DataFrame, part: Column, low: int, high: int, k: int) -> tuple[int, int]:
    """The k-th smallest key (k from 1) between the least and the greatest one, and how many are below it."""
    # signed numbers ascend as unsigned ones when the highest bit is turned over; shifts act on these
    turned = part.bitwiseXOR(F.lit(-(1 << 63)))
    low, high = low + (1 << 63), high + (1 << 63)
    below, bits = 0, (low ^ high).bit_length()
    unsigned = low >> bits  # the leading bits that all keys share
    while bits:
        step = min(DIGIT, bits)
        bits -= step
        at = rows if bits + step == 64 else rows.where(F.shiftrightunsigned(turned, bits + step) == unsigned)
        digit = F.shiftrightunsigned(turned, bits).bitwiseAND((1 << step) - 1)
        for d, n in sorted(at.groupBy(digit.alias("d")).agg(F.count("*")).collect()):
            if below + n >= k:
                unsigned = unsigned << step | d
                break
            below += n
    return unsigned - (1 << 63), below


def border(rows: DataFrame, k: int) -> Border:
    """Where to cut ``rows`` so that exactly ``k`` remain (0 < k <= rows)."""
    found: list[int] = []
    for part in key():
        low, high, n = rows.agg(F.min(part), F.max(part), F.count("*")).first()
        if n == k:
            break
        value, below = _digits(rows, part, low, high, k) if low != high else (low, 0)
        found.append(value)
        rows, k = rows.where(part == value), k - below
    return Border(found)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank``; of the documents with enough words, ``percent`` of 100 get a rank."""
    gain = gains(feature_counts(docs), feature_counts(target))
    scored = weighed(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = written(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    long = F.col("n_words") >= LEAST_WORDS
    k = percent * scored.where(long).count() // 100
    taken = long & border(scored.where(long), k).takes() if k else F.lit(False)
    ranked = numbered(range_sorted(scored.where(taken), key(), "drawn"), "rank").withColumn("rank", F.col("rank") + 1)
    rest = scored.where(~taken).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rest.select(*columns))
