"""Byte-pair encoding of many words in step, and a cache of encoded words.

All words of a batch take their best merge at the same time: a round finds the
lowest rank, leftmost first, within each word by one segmented minimum.  That
is the order in which a priority queue would merge a single word.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from docframe.llm.textbytes import ragged

NONE = np.int64(1) << 62
_PLACE = 20  # bits of a place in a word


class Merges:
    """Pairs of symbols, the rank of each pair (lowest first) and the symbol that it makes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, result: np.ndarray):
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.result = keys[order], rank[order].astype(np.int64), result[order].astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no such merge) and result of each pair; negative symbols never merge."""
        keys = (left << 32) | right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        ok = (self.keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(ok, self.rank[at], NONE), self.result[at]

    def encode(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left in each word when no pair can merge, and their numbers."""
        symbols, lengths = symbols.astype(np.int64), lengths.astype(np.int64)
        word = np.arange(len(lengths))
        out_word, out_symbols, out_lengths = [], [], np.zeros(len(lengths), np.int64)
        rank = np.full(len(symbols), NONE)
        made = np.zeros(len(symbols), np.int64)
        if len(symbols) > 1:
            rank[:-1], made[:-1] = self.find(symbols[:-1], symbols[1:])
        ends = np.cumsum(lengths)
        rank[ends[lengths > 0] - 1] = NONE
        keep = lengths > 0
        word, lengths = word[keep], lengths[keep]
        while len(word):
            starts = np.cumsum(lengths) - lengths
            place = np.arange(len(symbols)) - np.repeat(starts, lengths)
            best = np.minimum.reduceat(np.where(rank == NONE, NONE, (rank << _PLACE) | place), starts)
            done = best == NONE
            if done.any():
                of_done = np.repeat(done, lengths)
                out_word.append(word[done])
                out_symbols.append(symbols[of_done])
                out_lengths[word[done]] = lengths[done]
                symbols, rank, made = symbols[~of_done], rank[~of_done], made[~of_done]
                word, lengths, best = word[~done], lengths[~done], best[~done]
                if not len(word):
                    break
                starts = np.cumsum(lengths) - lengths
            at = starts + (best & ((1 << _PLACE) - 1))
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, rank, made = symbols[keep], rank[keep], made[keep]
            at -= np.arange(len(at))  # one symbol has gone from each word before
            lengths = lengths - 1
            starts = np.cumsum(lengths) - lengths
            last = at == starts + lengths - 1
            rank[at[last]] = NONE
            inner = at[~last]
            rank[inner], made[inner] = self.find(symbols[inner], symbols[inner + 1])
            inner = at[at > starts] - 1
            rank[inner], made[inner] = self.find(symbols[inner], symbols[inner + 1])
        if not out_word:
            return np.zeros(0, np.int64), out_lengths
        order = np.concatenate(out_word)
        flat, counts = np.concatenate(out_symbols), out_lengths[order]
        starts = np.zeros(len(out_lengths), np.int64)
        starts[order] = np.cumsum(counts) - counts
        return flat[ragged(starts, out_lengths)], out_lengths


class WordCache:
    """Encoded words by hash, at most about `limit` of them: beyond it the cache starts anew, at no loss."""

    def __init__(self, limit: int = 600_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def look_up(self, hashes: np.ndarray, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths in self.ids of ascending distinct hashes; encode() gets the indices of the unknown ones."""
        if len(self.hashes) + len(hashes) > max(self.limit, len(hashes)):
            self.clear()
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        if len(new):
            ids, lengths = encode(new)
            first = len(self.lengths)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            merged = np.concatenate([self.hashes, hashes[new]])
            order = np.argsort(merged, kind="stable")
            self.hashes = merged[order]
            self.slot = np.concatenate([self.slot, np.arange(first, first + len(new))])[order]
            at = np.searchsorted(self.hashes, hashes)
        slot = self.slot[at]
        return self.starts[slot], self.lengths[slot]
