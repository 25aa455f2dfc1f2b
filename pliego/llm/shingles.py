"""Word shingles of whole texts as 64-bit hashes, vectorised over blocks of documents (numpy)."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2 ** 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 2 ** 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """Words (runs without ASCII white space, A-Z lower-cased) of a block of texts.

    ``hash`` has one 64-bit hash per word, ``first[i]`` the index of text i's first word.
    """

    powers = np.ones(1, np.uint64)
    inverse = np.ones(1, np.uint64)

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").encode() for t in texts]
        buf = np.frombuffer(b" ".join([*parts, b""]) or b" ", np.uint8)
        n = len(buf)
        if len(Words.powers) < n + 1:
            size = max(n + 1, 2 * len(Words.powers))
            with np.errstate(over="ignore"):
                Words.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _BASE)]), dtype=np.uint64)
                Words.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _INV)]), dtype=np.uint64)
        space = _SPACE[buf]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        start, end = edge[0::2], edge[1::2]
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[_LOWER[buf]] * Words.powers[:n], out=total[1:])
            self.hash = mix((total[end] - total[start]) * Words.inverse[start] + (end - start).astype(np.uint64))
        limits = np.cumsum([0] + [len(p) + 1 for p in parts])
        self.first = np.searchsorted(start, limits)

    def sets(self, n: int):
        """Sorted distinct hashes of each text's n-word shingles (the whole text if it has fewer words)."""
        h = self.hash
        with np.errstate(over="ignore"):
            gram = np.zeros(max(len(h) - n + 1, 0), np.uint64)
            for j in range(n):
                gram = mix(gram * np.uint64(0xD6E8FEB86659FD93) + h[j:len(h) - n + 1 + j] + np.uint64(j + 1))
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            if b - a >= n:
                s = np.sort(gram[a:b - n + 1])
                new = s[1:] != s[:-1]
                yield s if new.all() else np.concatenate([s[:1], s[1:][new]])
            elif b > a:
                with np.errstate(over="ignore"):
                    whole = np.array([n * 1000 + b - a], np.uint64)
                    for j in range(a, b):
                        whole = mix(whole * np.uint64(0xA0761D6478BD642F) + h[j:j + 1])
                yield whole
            else:
                yield np.empty(0, np.uint64)
