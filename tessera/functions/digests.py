"""md5 over many short texts at once, for orders that a digest deals."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np

_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Texts of one block of md5; columns that stay in a core's cache.
ONE_BLOCK, COLUMNS = 55, 8192


class Digests:
    """md5 of ``head + tail`` for each of the tails; ``of`` gives both halves of each digest as whole numbers."""

    def __init__(self, tails: Sequence[bytes]) -> None:
        self.tails = tails
        self.sizes = np.fromiter(map(len, tails), np.int64, len(tails))
        self.longest = int(self.sizes.max(initial=0))
        self._laid: dict[int, np.ndarray] = {}

    def _words(self, head: int) -> np.ndarray:
        """The words of all blocks, with room for a head of so many bytes."""
        if head not in self._laid:
            n, rows = len(self.tails), np.zeros((len(self.tails), 64), np.uint8)
            if self.longest:
                rows[:, head : head + self.longest] = np.array(self.tails, f"S{self.longest}").view(np.uint8).reshape(n, -1)
            rows[np.arange(n), head + self.sizes] = 0x80
            words = np.ascontiguousarray(rows.view("<u4").T)
            words[14] = 8 * (head + self.sizes)
            self._laid[head] = words
        return self._laid[head]

    def of(self, head: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Halves that are ordered as the digests' hex digits are."""
        n = len(self.tails)
        if len(head) + self.longest > ONE_BLOCK:
            both = np.frombuffer(b"".join(hashlib.md5(head + t).digest() for t in self.tails), ">u8").reshape(n, 2)
            return both[:, 0].astype(np.uint64), both[:, 1].astype(np.uint64)
        words, lead = self._words(len(head)), np.frombuffer(head.ljust(64, b"\0"), "<u4")
        out = np.empty((4, n), np.uint32)
        for at in range(0, n, COLUMNS):
            block = words[:, at : at + COLUMNS] | lead[:, None]
            out[:, at : at + COLUMNS] = _md5(block)
        high, low = (out[i].byteswap().astype(np.uint64) << np.uint64(32) | out[i + 1].byteswap() for i in (0, 2))
        return high, low


def _md5(words: np.ndarray) -> list[np.ndarray]:
    filled = words.any(1)
    a, b, c, d = (np.full(words.shape[1], x) for x in _START)
    for i, (shift, sine) in enumerate(zip(_SHIFTS, _SINES)):
        if i < 16:
            f, g = ((c ^ d) & b) ^ d, i
        elif i < 32:
            f, g = ((b ^ c) & d) ^ c, (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += sine
        if filled[g]:
            f += words[g]
        a, d, c, b = d, c, b, b + (f << np.uint32(shift) | f >> np.uint32(32 - shift))
    return [x + s for x, s in zip((a, b, c, d), _START)]
