"""Packed bit vectors with a directory of popcounts: rank and select beside one bit for each place."""

from __future__ import annotations

import numpy as np

WORDS = 8
#: Bits of a block, of which the directory holds the ones before it.
BLOCK = 64 * WORDS
U64 = np.uint64


class Bits:
    """From bytes packed little end first (np.packbits, bitorder="little"); places beyond them are zeros."""

    def __init__(self, packed: np.ndarray):
        blocks = len(packed) // (8 * WORDS) + 1
        whole = np.zeros(blocks * 8 * WORDS, dtype=np.uint8)
        whole[: len(packed)] = packed
        self.words = whole.view(U64).reshape(blocks, WORDS)
        self.before = np.zeros(blocks + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words).sum(axis=1, dtype=np.int64), out=self.before[1:])

    def total(self) -> int:
        return int(self.before[-1])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block, within = np.divmod(np.asarray(places, dtype=np.int64), BLOCK)
        bits = np.clip(within[:, None] - 64 * np.arange(WORDS), 0, 64)
        full = bits == 64
        mask = np.where(full, ~U64(0), (U64(1) << np.where(full, 0, bits).astype(U64)) - U64(1))
        return self.before[block] + np.bitwise_count(self.words[block] & mask).sum(axis=1, dtype=np.int64)

    def select(self, numbers: np.ndarray) -> np.ndarray:
        """The place of each one by its number from 0; numbers lie below total()."""
        numbers = np.asarray(numbers, dtype=np.int64)
        block = np.searchsorted(self.before, numbers, side="right") - 1
        left = numbers - self.before[block]
        ends = np.cumsum(np.bitwise_count(self.words[block]), axis=1, dtype=np.int64)
        word = (ends <= left[:, None]).sum(axis=1)
        row = np.arange(len(numbers))
        left -= np.where(word > 0, ends[row, word - 1], 0)
        ones = (self.words[block, word][:, None] >> np.arange(64, dtype=U64)) & U64(1)
        return BLOCK * block + 64 * word + (np.cumsum(ones, axis=1, dtype=np.int64) > left[:, None]).argmax(axis=1)
