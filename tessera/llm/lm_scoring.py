"""LM scoring by subword lattice likelihood.

A fixed subword vocabulary with unigram scores spans a lattice over every word; the forward
recursion in log space adds up all segmentations, so a word's probability is marginal over them.
The scores start from the vocabulary's own ranks and are re-estimated by expectation maximisation on
all training words, by their counts. Any character may also be spelled, at a cost that all characters share,
so every word has a probability, and those of all words add up to one; so do those of all documents.

``score`` is this marginal probability. ``score_words`` mixes each word's with its absolutely discounted
training count: what the discount frees goes to the lattice.

Edge cases: a null text counts as empty (one end token); a null id as the empty id text; repeated
rows each get their row; characters outside the vocabulary are spelled; an empty table gives
an empty result; without training rows, only the vocabulary's own scores weigh.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, written

MARK = "▁"
#: Words with at least this share of all tokens, held out or not, go to every task; there are at most 1/share.
HEAVY_SHARE = 2e-6
#: Characters that a word can hold: all but surrogates, six kinds of white space, and A to Z, which are lowered.
CHARACTERS = 0x110000 - 0x800 - 6 - 26
_NEVER = set("\x20\t\n\v\f\rABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: A task hands on its word counts whenever it holds so many distinct words.
HELD_WORDS = 300_000
_B = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """Pieces that words can hold, and log weights of a sentencepiece model; ranks become weights by Zipf's law."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    out = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        plain = not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        if plain and MARK not in piece[1:] and _NEVER.isdisjoint(piece):
            out.append((piece, -math.log(i + 3)))
    return out


class Lattice:
    """Log weights of pieces, found by rolling hashes; whole batches of words at once.

    ``first`` holds pieces that begin a word (their mark dropped), ``rest`` those inside one. A word is a first
    piece, then rest pieces or spelled characters, then a stop; or a bare mark, and at least one of the latter before
    the stop. So all words' probabilities add up to one. ``spell`` is the log weight of one spelled character.
    """

    def __init__(self, pieces: list[str], weights: np.ndarray, spell: float, stop: float, characters: int = CHARACTERS):
        self.pieces, self.weights, self.spell, self.stop, self.characters = pieces, weights, spell, stop, characters
        self.longest = max([1, *(len(p.removeprefix(MARK)) for p in pieces)])
        self.tables = []
        for first in (True, False):
            ids = np.array([i for i, p in enumerate(pieces) if p.startswith(MARK) == first and p != MARK], dtype=np.int64)
            hashes = np.array([self._hash(pieces[i].removeprefix(MARK)) for i in ids], dtype=np.uint64)
            order = np.argsort(hashes)
            sieve = np.zeros(1 << 20, dtype=bool)
            sieve[hashes >> np.uint64(44)] = True
            self.tables.append((hashes[order], ids[order], sieve))
        self.mark = pieces.index(MARK) if MARK in pieces else None

    @classmethod
    def start(cls, vocab: list[tuple[str, float]], characters: int = CHARACTERS) -> Lattice:
        pieces = [p for p, _ in vocab]
        if MARK not in pieces:
            pieces.append(MARK)
        weights = np.array([w for _, w in vocab] + [-math.log(len(pieces) + 3)] * (len(pieces) - len(vocab)))
        return cls(pieces, *cls._normalised(pieces, np.exp(weights), 1e-4, 0.3, characters), characters)

    @staticmethod
    def _normalised(pieces: list[str], mass: np.ndarray, spelled: float, words: float, characters: int) -> tuple[np.ndarray, float, float]:
        first = np.array([p.startswith(MARK) for p in pieces])
        top = mass[first].sum()
        rest = mass[~first].sum() + spelled + words
        return np.log(np.where(first, mass / top, mass / rest)), math.log(spelled / rest / characters), math.log(words / rest)

    def refitted(self, counts: np.ndarray, spelled: float, words: float) -> Lattice:
        """The model with weights in proportion to expected counts, every piece smoothed a little."""
        fitted = self._normalised(self.pieces, counts + 0.01, spelled + 0.1, words + 1.0, self.characters)
        return Lattice(self.pieces, *fitted, self.characters)

    @staticmethod
    def _mix(codes: np.ndarray) -> np.ndarray:
        x = codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
        x = (x ^ (x >> np.uint64(15))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)

    @classmethod
    def _hash(cls, piece: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in cls._mix(np.array([ord(x) for x in piece], dtype=np.uint64)):
            h = h * _B + c
        return h[0]

    def _find(self, hashes: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Where ``hashes`` holds pieces, and which."""
        known, ids, sieve = self.tables[table]
        at = np.flatnonzero(sieve[hashes >> np.uint64(44)])
        if not len(at) or not len(known):
            return at[:0], at[:0]
        spot = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
        hit = known[spot] == hashes[at]
        return at[hit], ids[spot[hit]]

    def _arcs(self, codes: np.ndarray) -> tuple[list, list]:
        """Log weights [length][word, start] of all arcs, with what each arc is, for words of one length.

        The second list holds those that follow a bare mark. Arcs of one character add up its piece and its spelling.
        """
        n, size = codes.shape
        mixed = self._mix(codes)
        arcs, h = [], None
        for k in range(1, min(self.longest, size) + 1):
            h = mixed.copy() if h is None else h[:, : size - k + 1] * _B + mixed[:, k - 1 :]
            w = np.full(h.shape, -np.inf)
            ids = np.full(h.shape, -1, dtype=np.int32)
            at, which = self._find(h[:, 1:].ravel(), 1)
            if len(at):
                r, c = np.divmod(at, h.shape[1] - 1)
                w[r, c + 1], ids[r, c + 1] = self.weights[which], which
            at, which = self._find(np.ascontiguousarray(h[:, 0]), 0)
            w[at, 0], ids[at, 0] = self.weights[which], which
            arcs.append((w, ids))
        # behind a bare mark, the word's first character begins a rest piece; the stop can't be next
        bare = []
        if self.mark is not None:
            begin = self.weights[self.mark] - math.log1p(-math.exp(self.stop))
            h = None
            for k in range(1, min(self.longest, size) + 1):
                h = mixed[:, 0].copy() if h is None else h * _B + mixed[:, k - 1]
                w, ids = np.full(n, -np.inf), np.full(n, -1, dtype=np.int32)
                at, which = self._find(h, 1)
                w[at], ids[at] = self.weights[which] + begin, which
                bare.append((w, ids))
            bare[0] = (np.logaddexp(bare[0][0], begin + self.spell), bare[0][1])
        arcs[0][0][:, 1:] = np.logaddexp(arcs[0][0][:, 1:], self.spell)
        return arcs, bare

    def _spelled(self, ids: np.ndarray) -> np.ndarray:
        """Share of an arc of one character that is its spelling."""
        known = np.where(ids >= 0, self.weights[np.maximum(ids, 0)], -np.inf)
        return np.exp(self.spell - np.logaddexp(known, self.spell))

    @staticmethod
    def _logsum(terms: np.ndarray) -> np.ndarray:
        top = terms.max(axis=0)
        safe = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            return np.log(np.exp(terms - safe).sum(axis=0)) + safe

    def _forward(self, arcs: list, bare: list, n: int, size: int) -> np.ndarray:
        alpha = np.full((size + 1, n), -np.inf)
        alpha[0] = 0.0
        for j in range(1, size + 1):
            terms = [alpha[j - k] + arcs[k - 1][0][:, j - k] for k in range(1, min(len(arcs), j) + 1)]
            if j <= len(bare):
                terms.append(bare[j - 1][0])
            alpha[j] = self._logsum(np.array(terms))
        return alpha

    def _batches(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        begins = np.concatenate([[0], np.cumsum(lengths)])
        order = np.argsort(lengths, kind="stable")
        for size, group in zip(*_runs(lengths[order], order), strict=True):
            for part in np.array_split(group, max(1, len(group) * size // 200_000)):
                if size:
                    yield part, codes[begins[part][:, None] + np.arange(size)]

    def score(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's marginal probability; 0 for the empty word."""
        out = np.zeros(len(words))
        for part, codes in self._batches(words):
            arcs, bare = self._arcs(codes)
            out[part] = self._forward(arcs, bare, *codes.shape)[-1] + self.stop
        return out

    def expected(self, words: list[str], times: np.ndarray | None = None) -> tuple[np.ndarray, float, float]:
        """Expected uses of each piece, of spellings and of words over all segmentations of ``words``, each taken ``times``."""
        times = np.ones(len(words)) if times is None else times
        counts, spelled, total = np.zeros(len(self.pieces)), 0.0, 0.0
        for part, codes in self._batches(words):
            n, size = codes.shape
            arcs, bare = self._arcs(codes)
            alpha = self._forward(arcs, bare, n, size)
            beta = np.full((size + 1, n), -np.inf)
            beta[size] = 0.0
            for i in range(size - 1, 0, -1):
                beta[i] = self._logsum(np.array([beta[i + k] + arcs[k - 1][0][:, i] for k in range(1, min(len(arcs), size - i) + 1)]))
            whole, c = alpha[size], times[part]
            for k, (w, ids) in enumerate(arcs, 1):
                post = np.exp(alpha[: size - k + 1].T + w + beta[k:].T - whole[:, None]) * c[:, None]
                if k == 1:
                    spelling = self._spelled(ids)
                    spelling[:, 0] = 0.0
                    spelled += float((post * spelling).sum())
                    post = post * (1 - spelling)
                known = ids >= 0
                counts += np.bincount(ids[known], weights=post[known], minlength=len(counts))
            for k, (w, ids) in enumerate(bare, 1):
                post = np.exp(w + beta[k] - whole) * c
                counts[self.mark] += post.sum()
                if k == 1:
                    spelling = self._spelled(ids)
                    spelled += float((post * spelling).sum())
                    post = post * (1 - spelling)
                known = ids >= 0
                counts += np.bincount(ids[known], weights=post[known], minlength=len(counts))
            total += c.sum()
        return counts, spelled, float(total)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Batches of words joined to larger ones, so that the lattice works on many words at once."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _runs(values: np.ndarray, order: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    cuts = np.flatnonzero(np.diff(values)) + 1
    groups = np.split(order, cuts) if len(order) else []
    return [int(values[i]) for i in [0, *cuts]] if len(order) else [], groups


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, c, u)``: all distinct words (UTF-8) and the end (empty), with their counts in training rows and in all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, other = Counter(), Counter()

        def flushed() -> pa.RecordBatch:
            names = [*train, *(w for w in other if w not in train)]
            columns = [pa.array(names, pa.binary()), pa.array([train[w] for w in names], pa.int64()), pa.array([train[w] + other[w] for w in names], pa.int64())]
            train.clear()
            other.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "c", "u"])

        for batch in batches:
            for text, held in zip(batch["text"], batch["held_out"], strict=True):
                here = other if held.as_py() else train
                here.update((text.as_buffer().to_pybytes() if text.is_valid else b"").lower().split())
                here[b""] += 1
                if len(train) + len(other) > HELD_WORDS:
                    yield flushed()
        yield flushed()

    rows = docs.select(F.col("text").cast("binary").alias("text"), "held_out")
    return rows.mapInArrow(count, "word binary, c long, u long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("u").alias("u"))


def fit(words: DataFrame, vocab: list[tuple[str, float]], rounds: int = 3) -> Lattice:
    """Re-estimates the vocabulary's scores on all training words; a distinct one is segmented once, and counts as often as it occurs.

    Each round sums expected piece counts per task in Spark; only one row a piece comes to the driver.
    """
    spark, model = words.sparkSession, Lattice.start(vocab)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((model.pieces, model.weights, model.spell, model.stop))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(*sent.value)
            total = np.zeros(len(lattice.pieces) + 2)
            for batch in _gathered(batches):
                texts = [w.decode() for w in batch["word"].to_pylist()]
                counts, spelled, n = lattice.expected(texts, batch["c"].to_numpy().astype(float))
                total += np.concatenate([counts, [spelled, n]])
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.float64())], ["piece", "uses"])

        got = words.where("c > 0 and length(word) > 0").select("word", "c").mapInArrow(expect, "piece int, uses double")
        rows = got.groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
        total = np.zeros(len(model.pieces) + 2)
        total[rows["piece"].to_numpy(dtype=np.int64)] = rows["uses"].to_numpy()
        if total[-1] == 0:
            break
        model = model.refitted(total[:-2], total[-2], total[-1])
    return model


def score_documents(docs: DataFrame, model_path: str, rounds: int = 3) -> DataFrame:
    """Every document's log10 probability (``score`` and ``score_words``) and its add-one base score.

    ``docs`` needs ``doc_id``, ``text`` and ``held_out``; other columns are ignored. Frequent words (at
    most ``1 / HEAVY_SHARE``) are scored where the document is read; the rest meet the table of all
    distinct words in one join, whose keys are rare by construction.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "held_out")
    words = written(word_counts(docs), "words")
    n, v, every, ends, ones, twos = (
        x or 0
        for x in words.agg(
            F.sum("c"), F.count_if(F.col("c") > 0), F.sum("u"), F.sum(F.when(F.length("word") == 0, F.col("c"))), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
        ).first()
    )
    model = fit(words, vocab=vocabulary(model_path), rounds=rounds)
    sent = spark.sparkContext.broadcast((model.pieces, model.weights, model.spell, model.stop))
    tokens, types = n - ends, v - (ends > 0)
    discount = min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones else 0.5
    free = math.log(discount * types / tokens) if tokens else 0.0
    end = (ends + 0.5) / (n + 1)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*sent.value)
        for batch in _gathered(batches):
            sub = lattice.score([w.decode() for w in batch["word"].to_pylist()])
            c = batch["c"].to_numpy()
            with np.errstate(divide="ignore"):
                full = np.logaddexp(sub + free, np.log(np.maximum(c - discount, 0.0) / max(tokens, 1)))
            is_end = np.array([not w for w in batch["word"].to_pylist()], dtype=bool)
            logs = [pa.array(np.where(is_end, math.log(end), x + math.log1p(-end)) / math.log(10)) for x in (sub, full)]
            yield pa.RecordBatch.from_arrays([batch["word"], batch["c"], batch["u"], *logs], ["word", "c", "u", "logp", "logw"])

    table = written(words.mapInArrow(weigh, "word binary, c long, u long, logp double, logw double"), "weights")
    heavy = table.where((F.length("word") == 0) | (F.col("u") >= F.lit(HEAVY_SHARE * every))).drop("u").toPandas()
    below = math.log10(n + v + 1)
    index = {bytes(w): i for i, w in enumerate(heavy["word"])}
    dense = np.stack([(heavy["c"] > 0).to_numpy(float), np.log10(heavy["c"].to_numpy(float) + 1) - below, heavy["logp"].to_numpy(float), heavy["logw"].to_numpy(float)])
    shared = spark.sparkContext.broadcast((index, dense))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document (its word holds a space, so it meets none), one for each rare word in it."""
        index, dense = shared.value
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc, text, held in zip(batch["doc_id"].to_pylist(), batch["text"], batch["held_out"].to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                key = xxhash.xxh3_64_intdigest(raw) >> 1
                if not text.is_valid:
                    key = -1
                tokens = raw.lower().split()
                tokens.append(b"")
                spots = list(map(index.get, tokens))
                found = np.array([s for s in spots if s is not None], dtype=np.int64)
                known, base, score, by_words = dense[:, found].sum(axis=1)
                rare = Counter(t for t, s in zip(tokens, spots, strict=True) if s is None)
                k = 1 + len(rare)
                for col, values in zip(
                    cols,
                    (
                        [doc] * k, [key] * k, [held] * k, [b"%d %d" % (key, doc or 0), *rare], [0, *rare.values()],
                        [len(tokens)] + [0] * (k - 1), [int(known)] + [0] * (k - 1), [1] + [0] * (k - 1),
                    ),
                    strict=True,
                ):
                    col.extend(values)
                cols_extra[0].extend([float(base)] + [0.0] * (k - 1))
                cols_extra[1].extend([float(score)] + [0.0] * (k - 1))
                cols_extra[2].extend([float(by_words)] + [0.0] * (k - 1))
                if len(cols[0]) > 50_000:
                    yield packed(cols)
                    cols = [[] for _ in range(8)]
            yield packed(cols)

    cols_extra: list[list] = [[], [], []]
    names = ["doc_id", "key", "held_out", "word", "times", "n_tokens", "n_known", "copies", "base", "score", "words"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def packed(cols: list[list]) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*cols, *cols_extra], kinds, strict=True)], names)
        for c in cols_extra:
            c.clear()
        return out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), "held_out").mapInArrow(
        spread,
        "doc_id long, key long, held_out boolean, word binary, times long, n_tokens long, n_known long, copies long, base double, score double, words double",
    )
    # words that tasks already know meet nothing, and no rare word is hot
    met = rows.join(table.drop("u").withColumnsRenamed({"c": "count_", "logp": "logp_", "logw": "logw_"}), "word", "left")
    per = met.groupBy("doc_id", "key", "held_out").agg(
        F.sum("copies").alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("count_") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.coalesce(F.col("times") * (F.log10(F.col("count_") + 1.0) - below), F.lit(0.0))).alias("base"),
        F.sum(F.col("score") + F.coalesce(F.col("times") * F.col("logp_"), F.lit(0.0))).alias("score"),
        F.sum(F.col("words") + F.coalesce(F.col("times") * F.col("logw_"), F.lit(0.0))).alias("words"),
    )
    return per.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id",
        "held_out",
        F.expr("n_tokens div copies").alias("n_tokens"),
        F.expr("n_known div copies").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("score") / F.col("copies")).alias("score"),
        (F.col("words") / F.col("copies")).alias("score_words"),
    )


def held_out(docs: DataFrame) -> DataFrame:
    """Marks the rows that are not learned from."""
    return docs.withColumn("held_out", remainder("doc_id", 7) == 2)
