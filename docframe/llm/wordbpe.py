"""Token ids of whole texts by a lower-casing word BPE in the `tokenizers` format.

Texts of ASCII, Latin-1 and common punctuation are cut into words and encoded
in NumPy, each distinct word once; texts that hold any other character, and
words of more than LONG bytes, go to the `tokenizers` library itself.  Both
ways give the library's ids.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from docframe.llm.bpe import Merges, WordCache
from docframe.llm.textbytes import LOWER, hash_spans, ragged, slices, text_bytes

LONG = 96
#: Bytes of texts that are encoded at once; what is made of them takes some fifty times their room.
SLICE = 1 << 19
_SPACE, _LETTER, _NUMBER, _OTHER = 1, 2, 3, 4


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: visible Latin-1 characters stand for
    themselves, the others for the characters from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


def _classes() -> np.ndarray:
    """Classes of the code points below 0x2100 that the fast path takes; 0: it doesn't."""
    import unicodedata

    table = np.zeros(0x2100, np.uint8)
    for c in [*range(0x80), *range(0xA0, 0x100), *range(0x2010, 0x2020), 0x2022, 0x2026, 0x20AC]:
        kind = unicodedata.category(chr(c))[0]
        table[c] = _SPACE if c in (9, 10, 11, 12, 13, 32, 0xA0) else _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    return table


class WordBpe:
    """Encoder with a cache; one per Python worker and task."""

    def __init__(self, path: str, cache: int = 600_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if spec["model"]["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not spec["model"]["end_of_word_suffix"]:
            raise ValueError("a lower-casing byte-level BPE with an end-of-word suffix is needed")
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        self.merges = Merges(left, right, np.arange(len(pairs)), made)
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.table = _classes()
        self.cache = WordCache(cache)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and their number for each row (null: none)."""
        buf, offsets = text_bytes(texts)
        ids, counts = [], []
        for a, b in slices(offsets, SLICE):
            part = offsets[a : b + 1] - offsets[a]
            x, n = self._slice(buf[offsets[a] : offsets[b]], part)
            ids.append(x)
            counts.append(n)
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _slice(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        buf = LOWER[raw]
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        lead = raw[at]
        points = lead.astype(np.int32)
        two = np.flatnonzero((lead >= 0xC0) & (lead < 0xE0))
        points[two] = ((lead[two] & 0x1F).astype(np.int32) << 6) | (raw[at[two] + 1] & 0x3F)
        three = np.flatnonzero((lead >= 0xE0) & (lead < 0xF0))
        points[three] = ((lead[three] & 0x0F).astype(np.int32) << 12) | ((raw[at[three] + 1] & 0x3F).astype(np.int32) << 6) | (raw[at[three] + 2] & 0x3F)
        points[lead >= 0xF0] = 0x10000
        kind = np.zeros(len(points), np.uint8)
        inside = points < len(self.table)
        kind[inside] = self.table[points[inside]]
        upper = two[(points[two] >= 0xC0) & (points[two] <= 0xDE) & (points[two] != 0xD7)]
        buf[at[upper] + 1] += 0x20
        row = np.searchsorted(offsets, at, side="right") - 1
        odd = np.zeros(n, bool)
        odd[row[kind == 0]] = True
        for text in self.special:
            odd |= self._holding(raw, offsets, text.encode())
        fresh = np.ones(len(at), bool)
        fresh[1:] = (kind[1:] != kind[:-1]) | (row[1:] != row[:-1]) | (kind[1:] == _NUMBER)
        first = np.flatnonzero(fresh)
        stop = np.append(at[first[1:]], len(raw))
        begin, kinds, rows = at[first], kind[first], row[first]
        good = (kinds != _SPACE) & ~odd[rows]
        begin, stop, kinds, rows = begin[good], stop[good], kinds[good], rows[good]
        begin, stop, rows = self._contractions(buf, begin, stop, kinds, rows)
        hashes, first, inverse = np.unique(hash_spans(buf, begin, stop), return_index=True, return_inverse=True)
        starts, lengths = self.cache.look_up(hashes, lambda new: self._words(buf, begin[first[new]], stop[first[new]]))
        per_word = lengths[inverse]
        flat = self.cache.ids[ragged(starts[inverse], per_word)]
        counts = np.bincount(rows, per_word, n).astype(np.int64)
        if not odd.any():
            return flat, counts
        ends = np.cumsum(counts)
        parts = []
        for i in range(n):
            if odd[i]:
                got = self.library.encode(raw[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids
                parts.append(np.array(got, np.int32))
                counts[i] = len(got)
            else:
                parts.append(flat[ends[i] - counts[i] : ends[i]])
        return np.concatenate(parts), counts

    @staticmethod
    def _holding(raw: np.ndarray, offsets: np.ndarray, sought: bytes) -> np.ndarray:
        found = np.zeros(len(offsets) - 1, bool)
        data, at = raw.tobytes(), -1
        while (at := data.find(sought, at + 1)) >= 0:
            found[np.searchsorted(offsets, at, side="right") - 1] = True
        return found

    @staticmethod
    def _contractions(buf, begin, stop, kinds, rows):
        """'s 't 'm 'd 're 've 'll are tokens of their own, if the apostrophe is a token of its own."""
        here = np.flatnonzero((stop - begin == 1) & (buf[begin] == 39))
        here = here[here + 1 < len(begin)]
        here = here[(kinds[here + 1] == _LETTER) & (rows[here + 1] == rows[here]) & (begin[here + 1] == stop[here])]
        if not len(here):
            return begin, stop, rows
        a = begin[here + 1]
        x = buf[a]
        long_enough = stop[here + 1] - a >= 2
        y = buf[np.minimum(a + 1, len(buf) - 1)]
        take = np.where(np.isin(x, np.frombuffer(b"stmd", np.uint8)), 1, 0)
        pair = long_enough & (((x == 114) & (y == 101)) | ((x == 118) & (y == 101)) | ((x == 108) & (y == 108)))
        take = np.where(pair, 2, take)
        begin, stop = begin.copy(), stop.copy()
        stop[here] += take
        begin[here + 1] += take
        kept = begin < stop
        return begin[kept], stop[kept], rows[kept]

    def _words(self, buf, begin, stop) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words and their numbers."""
        lengths = stop - begin
        symbols = self.inner[buf[ragged(begin, lengths)]]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.last[buf[stop - 1]]
        long = lengths > LONG
        if not long.any():
            return self.merges.encode(symbols, lengths)
        ids, counts = self.merges.encode(symbols[np.repeat(~long, lengths)], lengths[~long])
        out_counts = np.zeros(len(lengths), np.int64)
        out_counts[~long] = counts
        far = [np.array(self.library.encode(buf[begin[i] : stop[i]].tobytes().decode(), add_special_tokens=False).ids, np.int64) for i in np.flatnonzero(long)]
        out_counts[long] = [len(x) for x in far]
        starts = np.zeros(len(lengths), np.int64)
        starts[~long] = np.cumsum(counts) - counts
        starts[long] = len(ids) + np.cumsum(out_counts[long]) - out_counts[long]
        return np.concatenate([ids, *far])[ragged(starts, out_counts)], out_counts
