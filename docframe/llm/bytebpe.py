"""Token ids of whole texts by a byte-level BPE in the `tokenizers` format, special tokens' strings being plain text.

Texts of ASCII, Latin-1 and common punctuation are cut by the byte-level
pattern in NumPy and encoded a distinct token at a time; texts that hold any
other character, and tokens of more than LONG bytes, go to the `tokenizers`
library.  Both ways give the library's ids.
"""

from __future__ import annotations

import json

import numpy as np

from docframe.llm.bpe import Merges, WordCache
from docframe.llm.textbytes import hash_spans, ragged
from docframe.llm.wordbpe import _LETTER, _OTHER, _SPACE, LONG, _byte_symbols, _classes


class ByteBpe:
    """Encoder with a cache; one per task."""

    def __init__(self, path: str, cache: int = 500_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError("a byte-level BPE with the usual pattern and no normaliser is needed")
        vocab = model["vocab"]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        self.merges = Merges(left, right, np.arange(len(pairs)), made)
        symbols = _byte_symbols()
        self.symbol = np.array([vocab[s] for s in symbols], np.int64)
        byte_of = {s: b for b, s in enumerate(symbols)}
        #: What each id stands for.
        self.tokens = [b""] * (1 + max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]))
        for x in spec["added_tokens"]:
            self.tokens[x["id"]] = x["content"].encode()
        for s, i in vocab.items():
            self.tokens[i] = bytes(byte_of[c] for c in s)
        self.kinds = _classes()
        self.cache = WordCache(cache)

    def encode_slice(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice of texts, and their number for each."""
        n = len(offsets) - 1
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        kind = self._kinds(raw, at)
        row = np.repeat(np.arange(n), np.diff(np.searchsorted(at, offsets)))
        odd = np.zeros(n, bool)
        odd[row[kind == 0]] = True
        fresh = self._token_starts(raw, at, kind, row)
        first = np.flatnonzero(fresh)
        begin, stop, rows = at[first], np.append(at[first[1:]], len(raw)), row[first]
        if odd.any():
            good = ~odd[rows]
            begin, stop, rows = begin[good], stop[good], rows[good]
        hashes, one, inverse = np.unique(hash_spans(raw, begin, stop), return_index=True, return_inverse=True)
        starts, lengths = self.cache.look_up(hashes, lambda new: self._tokens(raw, begin[one[new]], stop[one[new]]))
        each = lengths[inverse]
        ids = self.cache.ids[ragged(starts[inverse], each)].astype(np.int64)
        counts = np.bincount(rows, each, n).astype(np.int64)
        if not odd.any():
            return ids, counts
        ends, parts = np.cumsum(counts), []
        for i in range(n):
            if odd[i]:
                parts.append(np.array(self.library.encode(raw[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.int64))
                counts[i] = len(parts[-1])
            else:
                parts.append(ids[ends[i] - counts[i] : ends[i]])
        return np.concatenate(parts), counts

    def _kinds(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Class of the character at each place; 0: not one of those that are cut here."""
        lead = raw[at]
        points = lead.astype(np.int32)
        two = np.flatnonzero((lead >= 0xC0) & (lead < 0xE0))
        points[two] = ((lead[two] & 0x1F).astype(np.int32) << 6) | (raw[at[two] + 1] & 0x3F)
        three = np.flatnonzero((lead >= 0xE0) & (lead < 0xF0))
        points[three] = ((lead[three] & 0x0F).astype(np.int32) << 12) | ((raw[at[three] + 1] & 0x3F).astype(np.int32) << 6) | (raw[at[three] + 2] & 0x3F)
        points[lead >= 0xF0] = len(self.kinds)
        kind = np.zeros(len(points), np.uint8)
        inside = points < len(self.kinds)
        kind[inside] = self.kinds[points[inside]]
        return kind

    @staticmethod
    def _token_starts(raw: np.ndarray, at: np.ndarray, kind: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Characters at which a token starts.

        A run of letters, of numbers or of other characters is a token, with one space before it.  Of white space that
        a text goes on after, the last character is left over: a space goes to what follows, another one stands alone.
        After a lone apostrophe without a space before it s, t, m, d, re, ve and ll end the token."""
        n = len(at)
        change = np.ones(n, bool)
        change[1:] = (kind[1:] != kind[:-1]) | (row[1:] != row[:-1])
        fresh = change.copy()
        blank = kind == _SPACE
        inner = np.zeros(n, bool)  # another kind of character of the same text follows
        inner[:-1] = change[1:] & (row[1:] == row[:-1])
        last = np.flatnonzero(blank & inner)
        fresh[last] = True
        joined = last[raw[at[last]] == 0x20]
        fresh[joined + 1] = False
        quote = np.flatnonzero((raw[at] == 39) & fresh & inner & (kind == _OTHER))
        quote = quote[(kind[quote + 1] == _LETTER)]
        if len(quote):
            x = raw[at[quote + 1]]
            far = np.minimum(quote + 2, n - 1)
            y = np.where((kind[far] == _LETTER) & (row[far] == row[quote]) & (far == quote + 2), raw[at[far]], 0)
            two = ((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108)
            take = np.where(np.isin(x, np.frombuffer(b"stmd", np.uint8)), 1, np.where(two, 2, 0))
            quote, take = quote[take > 0], take[take > 0]
            fresh[quote + 1] = False
            after = quote + 1 + take
            after = after[after < n]
            same = after[(row[after] == row[after - 1]) & (kind[after] == _LETTER)]
            fresh[same] = True
        return fresh

    def _tokens(self, raw: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct tokens of the pattern, and their numbers."""
        lengths = stop - begin
        long = lengths > LONG
        symbols = self.symbol[raw[ragged(begin[~long], lengths[~long])]]
        ids, counts = self.merges.encode(symbols, lengths[~long])
        if not long.any():
            return ids, counts
        out = np.zeros(len(lengths), np.int64)
        out[~long] = counts
        far = [np.array(self.library.encode(raw[begin[i] : stop[i]].tobytes().decode(), add_special_tokens=False).ids, np.int64) for i in np.flatnonzero(long)]
        out[long] = [len(x) for x in far]
        starts = np.zeros(len(lengths), np.int64)
        starts[~long] = np.cumsum(counts) - counts
        starts[long] = len(ids) + np.cumsum(out[long]) - out[long]
        return np.concatenate([ids, *far])[ragged(starts, out)], out
