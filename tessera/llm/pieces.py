"""SentencePiece encoding (merge type) by a prefix table, and decoding.

For every prefix of a text there is exactly one last token: the token that ends there, found by an
automaton over all pieces, whose own encoding is itself and which may follow the last token of what stands
before it. Two tokens may follow each other if merging their joined text gives just these two. The table
is filled from left to right, and ids are read off it from the end. As no piece holds the space mark
behind another character, texts fall into pieces of spaces and word that are encoded alone.

Edge cases: a null text counts as empty (only the end id); characters outside the vocabulary become
bytes; repeated rows each get their row; other columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Encodings of words that a Python worker remembers, and their longest length.
KEPT_WORDS, KEPT_LENGTH = 120_000, 64
KEPT_PAIRS = 500_000
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Texts that other settings than those assumed here would encode otherwise.
_PROBES = ("a  b", " a b ", "a\tb\n", "\uff46\ufb01 \u212b", "e\u0301 \u00e9", "A \u3000b", "", "low lower")


class _Chunks(dict):
    """Joined ids and decoded text of chunks; of two generations, the older goes when the younger is full."""

    def __init__(self, compute: Callable[[str], tuple[str, str]]):
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, chunk: str) -> tuple[str, str]:
        got = self.older.get(chunk) or self.compute(chunk)
        if len(chunk) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.older = dict(self)
                self.clear()
            self[chunk] = got
        return got


class PieceCodec:
    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.end, self.unknown = sp.eos_id(), sp.unk_id()
        self.rank: dict[str, tuple[float, int]] = {}
        self.byte: dict[int, int] = {}
        self.text: list[str | int] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text.append(int(piece[3:5], 16))
            elif sp.is_control(i) or sp.is_unused(i):
                self.text.append("")
            elif sp.is_unknown(i):
                self.text.append(" ⁇ ")
            else:
                self.text.append(piece.replace(MARK, " "))
                self.rank[piece] = (-sp.get_score(i), i)
        self.split = all(MARK not in p.lstrip(MARK) for p in self.rank)
        self.letters = {c for p in self.rank for c in p}
        #: Tokens by id, only those that their own text is encoded as; and which may follow which.
        self.token = {i: p for p, (_, i) in self.rank.items() if self.merged(p) == [p]}
        self.pairs: dict[int, bool] = {}
        self.machine = ahocorasick.Automaton()
        for i, p in self.token.items():
            self.machine.add_word(p, (len(p), i))
        self.machine.make_automaton()
        self.chunks = _Chunks(self._chunk)
        # texts are taken as they are, with a mark in front and for each space; a model that changes them is refused
        for probe in _PROBES:
            if self.encode(probe) != sp.encode(probe, add_eos=True):
                raise ValueError(f"the model of {model_path} is not of merge type, or normalises texts")

    def merged(self, text: str) -> list[str]:
        """Merges of a short text, best score first, the leftmost of equals; used to test pairs."""
        parts, rank = list(text), self.rank
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r[0] < best):
                    best, at = r[0], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` in an encoding."""
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        a, b = self.token[left], self.token[right]
        known = self.pairs[left << 32 | right] = self.merged(a + b) == [a, b]
        return known

    def ids_of(self, text: str) -> list[int]:
        """Ids of a text whose characters are all in the vocabulary."""
        n = len(text)
        last, pairs = [0] * (n + 1), self.pairs
        sizes = [0] * (n + 1)
        done = 0
        for at, (size, token) in self.machine.iter(text):
            if at < done:  # the last token of this prefix is known
                continue
            start = at + 1 - size
            if start:
                before = last[start]
                known = pairs.get(before << 32 | token)
                if not (self._fits(before, token) if known is None else known):
                    continue
            done = at + 1
            last[done], sizes[done] = token, size
        out = []
        while n:
            out.append(last[n])
            n -= sizes[n]
        return out[::-1]

    def chunk_ids(self, text: str) -> list[int]:
        """Ids of a chunk; characters outside the vocabulary part it and become bytes."""
        if self.letters.issuperset(text):
            return self.ids_of(text)
        out: list[int] = []
        for part in re.split("(" + "|".join(map(re.escape, sorted(set(text) - self.letters))) + ")", text):
            if self.letters.issuperset(part):
                out += self.ids_of(part)
            elif self.byte:
                out += [self.byte[b] for b in part.encode()]
            else:
                out.append(self.unknown)
        return out

    def _chunk(self, text: str) -> tuple[str, str]:
        ids = self.chunk_ids(text)
        return " ".join(map(str, ids)), self.decoded(ids)

    def decoded(self, ids: list[int]) -> str:
        """Text of ids, with the mark in front of the first piece; bytes that are no UTF-8 become U+FFFD."""
        parts = [self.text[i] for i in ids]
        if str in set(map(type, parts)) and int not in set(map(type, parts)):
            return "".join(parts)
        return b"".join(bytes([t]) if isinstance(t, int) else t.encode() for t in parts).decode(errors="replace")

    def whole(self, text: str) -> tuple[str, int, str]:
        """Decimal ids joined by spaces (with the end id), their number, and the decoded text."""
        if not text:
            return str(self.end), 1, ""
        marked = MARK + text.replace(" ", MARK)
        got = list(map(self.chunks.__getitem__, _CHUNK.findall(marked) if self.split else [marked]))
        joined = " ".join([ids for ids, _ in got])
        return f"{joined} {self.end}", joined.count(" ") + 2, "".join([back for _, back in got])[1:]

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.whole(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        """Text of any ids; bytes that are no UTF-8 become U+FFFD."""
        out = self.decoded(ids)
        return out[1:] if out.startswith(" ") else out


@lru_cache(maxsize=2)
def codec(model_path: str) -> PieceCodec:
    """One codec for each Python worker, kept between tasks."""
    return PieceCodec(model_path)


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """Adds ``ids`` (decimal, joined by spaces), ``n_tokens`` and ``decoded`` to ``doc_id``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec_ = codec(model_path)
        for batch in batches:
            rows = [codec_.whole(t or "") for t in batch["text"].to_pylist()]
            ids, counts, back = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(ids, pa.string()), pa.array(counts, pa.int64()), pa.array(back, pa.string())],
                ["doc_id", "ids", "n_tokens", "decoded"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, ids string, n_tokens long, decoded string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: the number of ids, and sha256 of the ids and of the decoded text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec_ = codec(model_path)
        for batch in batches:
            rows = [codec_.whole(t or "") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([n for _, n, _ in rows], pa.int64()),
                    pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids, _, _ in rows], pa.string()),
                    pa.array([hashlib.sha256(back.encode()).hexdigest() for _, _, back in rows], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
