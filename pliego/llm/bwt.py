"""Merging shard Burrows-Wheeler transforms by iterative interleave refinement (numpy).

The strings are byte strings read in symbols of ``width`` bytes. A string of m
bytes is ``width`` phase strings (one for each first byte), so that every byte
starts exactly one suffix. Each shard sorts its own suffixes once and keeps its
transform: for each suffix in order, the symbol before it. Shards are merged
without sorting suffixes again: after round t the interleave (which shard the
next suffix comes from) is right for the first t symbols, and round t + 1 is a
stable distribution of the current interleave by the transforms' symbols. The
places where neighbours first differ are the common prefix lengths; runs that
still agree after t rounds are the intervals of suffixes with t equal symbols.
"""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every position (zeros follow the end) as one integer."""
    n = len(buf)
    pad = np.concatenate([buf, np.zeros(16, np.uint8)]).tobytes()
    out = np.empty(n, np.uint64)
    for j in range(min(8, n)):
        part = out[j::8]
        part[:] = np.frombuffer(pad, "<u8", len(part), j)
    return out


def block_hash(u: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """64-bit hash of the ``width`` bytes (a multiple of 8) from every position that has so many."""
    n = max(len(u) - width + 1, 0)
    h = np.full(n, np.uint64(width + seed))
    for j in range(0, width, 8):
        h = (h ^ u[j:j + n]) * _M1
        h ^= h >> np.uint64(32)
    h *= _M2
    return h ^ (h >> np.uint64(29))


def _symbols(buf: np.ndarray, width: int) -> np.ndarray:
    """Symbol of the block at every position, from 1; equal symbols have equal bytes (checked)."""
    u, seed = lanes(buf), 0
    while True:
        h = block_hash(u, width, seed)
        _, first, sym = np.unique(h, return_index=True, return_inverse=True)
        at = first[sym]
        if all(np.array_equal(u[j:j + len(h)], u[at + j]) for j in range(0, width, 8)):
            return sym.astype(np.int32) + 1
        seed += 1  # two blocks share a hash: take another hash


class Shard:
    """Sorted suffixes of some strings and their transform."""

    def __init__(self, sym: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, width: int):
        """sym: symbols of the bucket; this shard's strings lie at offsets with lengths (in bytes)."""
        pos = np.concatenate([np.arange(o, o + m - width + 1) for o, m in zip(offsets, lengths)])
        last = np.repeat(offsets + lengths - width, lengths - width + 1)  # last block of the string
        start = np.repeat(offsets, lengths - width + 1)
        keys, p = [], pos
        deep = int((lengths.max() - 1) // width + 1)
        phase = start * np.int64(width) + (pos - start) % width  # terminators differ by phase string
        for j in range(deep):
            p = pos + j * width
            keys.append(np.where(p <= last, sym[np.minimum(p, last)], 0))
        order = np.lexsort([phase, *keys[::-1]])
        self.suffix = pos[order]
        before = np.where(pos - width >= start, sym[np.maximum(pos - width, start)], 0)[order]
        # suffixes that are a terminator alone come first, in the order of the phase strings
        ends = pos[last - pos < width]
        ends = ends[np.argsort(phase[last - pos < width], kind="stable")]
        self.n_ends = len(ends)
        self.transform = np.concatenate([sym[ends], before])
        self.suffix = np.concatenate([np.full(len(ends), -1), self.suffix])


def merge(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix positions in merged order, block number of each, first round in which it differs from the one before).

    Suffixes in one block have ``rounds`` equal symbols.
    """
    z = np.concatenate([np.full(len(s.transform), i, np.uint8) for i, s in enumerate(shards)])
    ends = np.concatenate([np.full(s.n_ends, i, np.uint8) for i, s in enumerate(shards)])
    block = np.zeros(len(z), np.int64)
    lcp = np.full(len(z), rounds, np.int16)
    seq = np.empty(len(z), np.int32)
    for t in range(rounds):
        for i, s in enumerate(shards):
            seq[z == i] = s.transform
        real = np.flatnonzero(seq)
        order = real[np.argsort(seq[real], kind="stable")]
        c, b = seq[order], block[order]
        new = np.ones(len(z), bool)  # every terminator differs from every other
        m = len(ends)
        new[m + 1:] = (c[1:] != c[:-1]) | (b[1:] != b[:-1])
        lcp[new & (lcp == rounds)] = t
        z = np.concatenate([ends, z[order]])
        block = np.cumsum(new) - 1
    suffix = np.empty(len(z), np.int64)
    for i, s in enumerate(shards):
        suffix[z == i] = s.suffix
    return suffix, block, lcp


def repeated_starts(strings: list[bytes], weights: np.ndarray, length: int, width: int,
                    shard_bytes: int) -> list[np.ndarray]:
    """For each string: which of its starts begin ``length`` bytes that occur twice or more, weights counted."""
    sizes = np.array([len(s) for s in strings], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    buf = np.frombuffer(b"".join(strings), np.uint8)
    sym = _symbols(buf, width)
    cut = np.minimum(offsets // max(shard_bytes, int(sizes.sum()) // 250 + 1), 255)
    shards = [Shard(sym, offsets[cut == c], sizes[cut == c], width) for c in np.unique(cut)]
    suffix, block, _ = merge(shards, length // width)
    owner = np.searchsorted(offsets, np.maximum(suffix, 0), side="right") - 1
    whole = (suffix >= 0) & (suffix + length <= offsets[owner] + sizes[owner])
    total = np.bincount(block, weights=np.where(whole, weights[owner], 0))
    twice = suffix[whole & (total[block] >= 2)]
    mark = np.zeros(len(buf), bool)
    mark[twice] = True
    return [np.flatnonzero(mark[o:o + m - length + 1]) for o, m in zip(offsets, sizes)]
