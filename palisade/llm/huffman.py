"""Canonical Huffman codes of limited length, and bit streams cut into independent blocks."""

from __future__ import annotations

from functools import cached_property

import numpy as np

LIMIT = 20
BLOCK = 512


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code length of every id by package-merge; 0 for ids that never occur.

    A single id gets one bit. Raises ValueError if the ids that occur can't have distinct
    codes of ``limit`` bits.
    """
    lengths = np.zeros(counts.size, np.uint8)
    used = np.flatnonzero(counts)
    if used.size == 0:
        return lengths
    if used.size > 1 << limit:
        raise ValueError(f"{used.size} ids do not fit into codes of {limit} bits")
    if used.size == 1:
        lengths[used] = 1
        return lengths
    leaves = used[np.argsort(counts[used], kind="stable")]
    weight = counts[leaves].astype(np.int64)
    # From the longest codes up: the leaves, merged with the pairs of the level below.
    levels, pairs = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([weight, pairs])
        order = np.argsort(both, kind="stable")
        levels.append(order < weight.size)
        both = both[order]
        both = both[: both.size // 2 * 2]
        pairs = both[0::2] + both[1::2]
    take = 2 * leaves.size - 2
    for is_leaf in reversed(levels):
        chosen = int(np.count_nonzero(is_leaf[:take]))
        lengths[leaves[:chosen]] += 1
        take = 2 * (take - chosen)
    return lengths


class Code:
    """The canonical code of given lengths: shorter codes first, equal lengths by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        self.order = used[np.argsort(lengths[used], kind="stable")]
        sizes = self.lengths[self.order]
        self.width = int(sizes[-1]) if sizes.size else 0
        self.codes = np.zeros(lengths.size, np.uint64)
        # Left-aligned, a code is the sum of the room that the codes before it take.
        room = np.left_shift(1, self.width - sizes)
        start = np.cumsum(room) - room
        self.codes[self.order] = (start >> (self.width - sizes)).astype(np.uint64)
        self._room = room

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(id, length) for every possible next ``width`` bits; length 0 where no code begins."""
        ids = np.zeros(1 << self.width, np.int64)
        sizes = np.zeros(1 << self.width, np.int64)
        n = int(self._room.sum()) if self.order.size else 0
        ids[:n] = np.repeat(self.order, self._room)
        sizes[:n] = np.repeat(self.lengths[self.order], self._room)
        return ids, sizes

    def encode(self, ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
        """(bits, bit offset of every ``block``-th id). Big-endian bits, padded with zeros to 8 bytes."""
        if not ids.size:
            return b"", np.zeros(0, np.uint64)
        sizes = self.lengths[ids]
        if not sizes.all():
            raise ValueError("an id has no code")
        end = np.cumsum(sizes)
        start = end - sizes
        word = start >> 6
        free = 64 - (start & 63) - sizes
        code = self.codes[ids]
        fits = free >= 0
        part = np.where(
            fits,
            code << np.maximum(free, 0).astype(np.uint64),
            code >> np.maximum(-free, 0).astype(np.uint64),
        )
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out = np.zeros(int(end[-1] - 1 >> 6) + 1, np.uint64)
        out[word[first]] = np.bitwise_or.reduceat(part, first)
        # At most one code crosses into each word.
        over = np.flatnonzero(~fits)
        out[word[over] + 1] |= code[over] << (64 + free[over]).astype(np.uint64)
        return out.astype(">u8").tobytes(), start[::block].astype(np.uint64)

    def decode(self, bits: bytes, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
        """The ``n`` ids. Each block is decoded from its own offset, all of them side by side."""
        if not n:
            return np.zeros(0, np.int64)
        ids, sizes = self.table
        # One more word lets a window reach past the end.
        words = np.concatenate([np.frombuffer(bits, ">u8").astype(np.uint64), np.zeros(1, np.uint64)])
        halves = np.empty(words.size * 2, np.uint64)
        halves[0::2], halves[1::2] = words >> np.uint64(32), words & np.uint64(0xFFFFFFFF)
        # Every 32 bits with the 32 that follow.
        wide = (halves[:-1] << np.uint64(32)) | halves[1:]
        at = offsets.astype(np.int64)
        out = np.zeros((block, at.size), np.int64)
        drop = np.uint64(64 - self.width)
        for k in range(min(block, n)):
            live = at.size if (at.size - 1) * block + k < n else at.size - 1
            here = at[:live]
            window = (wide[here >> 5] << (here & 31).astype(np.uint64)) >> drop
            out[k, :live] = ids[window]
            at[:live] = here + sizes[window]
        return out.T.reshape(-1)[:n]
