"""A compressed full-text index over integer symbols: suffix order, Burrows-Wheeler symbols in a wavelet matrix.

All searches are vectorised: one call moves many patterns one symbol to the left.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols in a sequence, kept as one packed bit row per bit of a symbol."""

    def __init__(self, values: np.ndarray, symbols: int) -> None:
        self.levels = max(1, int(symbols - 1).bit_length())
        self.rows: list[tuple[np.ndarray, np.ndarray, int]] = []
        current = values
        for level in range(self.levels - 1, -1, -1):
            bits = (current >> level & 1).astype(bool)
            padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
            padded[:len(bits)] = bits
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.zeros(len(packed), np.int64)
            np.cumsum(np.bitwise_count(packed[:-1]), out=before[1:])
            zeros = int(len(bits) - bits.sum())
            self.rows.append((packed, before, zeros))
            current = np.concatenate([current[~bits], current[bits]])
        self.begin = self.descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (packed, before, zeros) in enumerate(self.rows):
            word = at >> 6
            low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(packed[word] & low)
            at = np.where(symbol >> (self.levels - 1 - k) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self.descend(symbol, at) - self.begin[symbol]


def suffix_order(symbols: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in order of their symbols up to the first 0, ties by position; no run without 0 exceeds ``longest``."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    depth = 1
    # What follows a 0 must not count: its rank is its position's tie break alone.
    while depth <= longest:
        following = np.zeros(n, np.int64)
        following[:max(n - depth, 0)] = rank[depth:] + 1
        following[ended(symbols, depth)] = 0
        key = rank * (int(rank.max(initial=0)) + 2) + following
        order = np.argsort(key, kind="stable")
        changed = np.ones(n, np.int64)
        if n:
            changed[0] = 0
            changed[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(changed)
        depth *= 2
    return order


def ended(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes that reach their 0 within ``depth`` symbols."""
    n = len(symbols)
    zero = np.where(symbols == 0, np.arange(n), n)
    following = np.minimum.accumulate(zero[::-1])[::-1]
    return following - np.arange(n) < depth


class FmIndex:
    """Index over texts of symbols from 1 up, each closed by a 0."""

    def __init__(self, symbols: np.ndarray, longest: int) -> None:
        self.size = len(symbols)
        kinds = int(symbols.max(initial=0)) + 1
        self.order = suffix_order(symbols, longest)
        transform = symbols[self.order - 1] if self.size else symbols
        self.wavelet = WaveletMatrix(transform.astype(np.int64), kinds)
        self.first = np.cumsum(np.bincount(symbols, minlength=kinds)) - np.bincount(symbols, minlength=kinds)

    def left(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals of the patterns with ``symbol`` put before them."""
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) \
            + np.concatenate([self.first[symbol]] * 2)
        return both[:len(symbol)], both[len(symbol):]
