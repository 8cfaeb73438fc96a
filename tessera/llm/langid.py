"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram is bound by multiplying its letters'
vectors, each permuted (rolled) by its place; a text bundles, that is adds, the vectors of all its
n-grams; a language's prototype bundles its training texts, scaled to length one. The prototype nearest by
cosine gives the language.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; rows with a null language are
not learned from; if nothing can be learned, every text is ``und``; repeated rows each get their row;
other columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder

DIMENSIONS, GRAM = 1024, 3
#: Letters are their code points; 0 stands for a run of all that is no letter.
POINTS = 0x110000
#: Up to so many possible n-grams are counted in a table, more are sorted.
TABLE = 1 << 22
#: About so many rows of each language at most, those with the smallest seeded hashes, form its prototype.
SAMPLE_ROWS = 6_000
#: Rows and letters that a task bundles at once.
ROWS, LETTERS = 256, 2_000_000


class Profiles:
    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 3):
        self.dimensions, self.seed = dimensions, seed
        self.letter = np.fromiter((chr(c).isalpha() for c in range(POINTS)), dtype=bool, count=POINTS)
        self.place = np.zeros(POINTS, dtype=np.int64)
        self.vectors: dict[int, np.ndarray] = {}

    def vector(self, code: int) -> np.ndarray:
        """The letter's own random vector, of any script."""
        if code not in self.vectors:
            self.vectors[code] = np.random.default_rng([self.seed, code]).choice(np.array([-1, 1], dtype=np.int8), size=self.dimensions)
        return self.vectors[code]

    def codes(self, text: str | None) -> np.ndarray:
        """Code points of the text's letters in lower case; a run of other characters is one 0."""
        got = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        got = np.where(self.letter[got], got, 0)
        if not got.any():
            return got[:0].astype(np.int64)
        got = np.concatenate([[0], got, [0]])
        return got[np.concatenate([[True], (got[1:] != 0) | (got[:-1] != 0)])].astype(np.int64)

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """A vector for each text, zero for texts without a letter."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        lo = 0
        while lo < len(texts):
            rows: list[np.ndarray] = []
            while lo + len(rows) < len(texts) and len(rows) < ROWS and sum(map(len, rows)) < LETTERS:
                rows.append(self.codes(texts[lo + len(rows)]))
            self._add(rows, out[lo : lo + len(rows)])
            lo += len(rows)
        return out

    def _add(self, rows: list[np.ndarray], out: np.ndarray) -> None:
        """Adds the bundles of some texts' n-grams."""
        seen = np.zeros(POINTS, dtype=bool)
        for c in rows:
            seen[c] = True
        letters = np.flatnonzero(seen)
        size = len(letters)
        if not size:
            return
        self.place[letters] = np.arange(size)
        table = np.stack([self.vector(int(c)) for c in letters])
        placed = [np.roll(table, GRAM - 1 - i, axis=1) for i in range(GRAM)]
        grams = []
        for c in rows:
            d = self.place[c]
            grams.append(d[:-2] * size * size + d[1:-1] * size + d[2:] if len(d) >= GRAM else d[:0])
        flat, row = np.concatenate(grams), np.repeat(np.arange(len(rows)), list(map(len, grams)))
        if size**GRAM <= TABLE:
            kinds = np.flatnonzero(np.bincount(flat, minlength=size**GRAM))
            number = np.zeros(size**GRAM, np.int64)
            number[kinds] = np.arange(len(kinds))
            flat = number[flat]
        else:
            kinds, flat = np.unique(flat, return_inverse=True)
        for at in range(0, len(kinds), 16384):
            part = kinds[at : at + 16384]
            vectors = (placed[0][part // size**2] * placed[1][part // size % size] * placed[2][part % size]).astype(np.float32)
            here = (flat >= at) & (flat < at + len(part)) if len(kinds) > 16384 else slice(None)
            counts = np.bincount(row[here] * len(part) + flat[here] - at, minlength=len(rows) * len(part))
            out += counts.reshape(len(rows), len(part)).astype(np.float32) @ vectors


_profiles: list[Profiles] = []


def profiles() -> Profiles:
    """One set of letter vectors for each Python worker."""
    if not _profiles:
        _profiles.append(Profiles())
    return _profiles[0]


def _scaled(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def prototypes(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 9) -> dict[str, np.ndarray]:
    """The bundled vector of each language, from a bounded seeded sample of its ``rows(doc_id, text, lang)``; all rows of a rare one."""
    rows = rows.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    # one row a language
    counts = F.broadcast(rows.groupBy("lang").agg(F.count("*").alias("_n")))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.join(counts, "lang").where(F.coalesce(draw, F.lit(0.0)) < F.lit(float(sample_rows)) / F.col("_n"))

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            vectors = _scaled(profiles().bundle(batch["text"].to_pylist()))
            for lang, v in zip(batch["lang"].to_pylist(), vectors, strict=True):
                sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["lang", "v"])

    parts = rows.select("text", "lang").mapInArrow(bundled, "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    table = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v")).orderBy("lang").collect()
    out = {r["lang"]: np.array([p["x"] for p in r["v"]]) for r in table}
    return {k: v / np.linalg.norm(v) for k, v in out.items() if np.linalg.norm(v) > 0}


def identify(docs: DataFrame, known: dict[str, np.ndarray]) -> DataFrame:
    """``doc_id, lang_pred, score, margin`` for every row: the nearest prototype, its cosine, and the lead over the next."""
    names = sorted(known)
    sent = docs.sparkSession.sparkContext.broadcast((names, np.stack([known[n] for n in names]).astype(np.float32) if names else None))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = sent.value
        for batch in batches:
            n = batch.num_rows
            lang, score, margin = ["und"] * n, np.zeros(n), np.zeros(n)
            if names and n:
                vectors = _scaled(profiles().bundle(batch["text"].to_pylist()))
                cos = vectors @ table.T
                best = cos.argmax(axis=1)
                some = np.abs(vectors).sum(axis=1) > 0
                lang = [names[b] if s else "und" for b, s in zip(best, some, strict=True)]
                ranked = np.sort(cos, axis=1)
                score = np.where(some, np.clip(ranked[:, -1], 0.0, 1.0), 0.0).astype(float)
                margin = np.where(some, ranked[:, -1] - ranked[:, -2], 0.0).astype(float) if len(names) > 1 else margin
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(lang, pa.string()), pa.array(score), pa.array(margin)], ["doc_id", "lang_pred", "score", "margin"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double, margin double")


def held_out(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", remainder("doc_id", 4) == 2)
