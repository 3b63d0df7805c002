"""Vectorised hashes of words and word runs over a batch of texts."""

from __future__ import annotations

import numpy as np

from .common import MULT, mix64

_BASE = np.uint64(0x100000001B3)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to ``n``; the base is odd."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) <= n:
        size = 1 << int(n + 1).bit_length()
        pair = []
        for b in (int(base), pow(int(base), -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            pair.append(np.cumprod(steps, dtype=np.uint64))
        have = _powers[int(base)] = tuple(pair)
    return have


class Words:
    """Words of some texts, one after the other: ``h`` their hashes, ``row`` the text of each.

    ``first`` has the index of each text's first word, and the number of words at its end.
    """

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = _IS_SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
        start, end = edge[0::2], edge[1::2]
        up, down = powers(_BASE, len(data))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])])
        self.h = mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * MULT)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(start, begins)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def sums(self, salt: int) -> np.ndarray:
        """Running sums from which ``run`` has the hash of any run of words."""
        up, _ = powers(_WORD_BASE, len(self.h))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(self.h ^ np.uint64(salt)) * up[:len(self.h)])])

    @staticmethod
    def run(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        _, down = powers(_WORD_BASE, len(sums))
        return mix64((sums[stop] - sums[start]) * down[start])

    def grams(self, k: int, salt: int) -> np.ndarray:
        """Hashes of all runs of k words, those over the ends of texts too."""
        n = max(0, len(self.h) - k + 1)
        at = np.arange(n)
        return self.run(self.sums(salt), at, at + k)
