"""Encoding and decoding with a SentencePiece BPE model, with byte spans of every piece.

Normalisation takes, at each place, the longest prefix that the model's
compiled character map replaces, and records for each byte of the outcome the
byte of the text that it comes from; the pieces' own lengths are laid over the
outcome, and their spans are projected through that.  A model without a map
needs no search, so its texts are normalised by index arithmetic.  Pieces never hold a space after another character, so the
normalised text is cut before runs of spaces (and around characters that occur
in no longer piece), each distinct segment is encoded once, and the ids are
laid out by index arithmetic.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docframe.llm.arrowmap import add_columns, list_array
from docframe.llm.bpe import Merges, WordCache
from docframe.llm.textbytes import hash_spans, ragged, slices, text_bytes

SPACE = "▁".encode()
#: Segments of more bytes than this go to the library, as a round a merge would be slow for them.
LONG = 256


class CharacterMap:
    """A compiled character map: a double array of prefixes, and their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes of the longest mapped prefix at a place, and what replaces it."""
        units, found = self.units, None
        if not units:
            return None
        node = self._base(units[0])
        for n in range(at, len(text)):
            node ^= text[n]
            unit = units[node]
            if unit & 0x800000FF != text[n]:
                break
            node ^= self._base(unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = (n + 1 - at, self.texts[value : self.texts.index(b"\0", value)])
        return found

    @staticmethod
    def _base(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Normalizer:
    """Text to normalised text, as the model's normaliser spec says, with the source of each byte."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    @property
    def plain(self) -> bool:
        """Nothing but the leading space is added, and each space takes one place."""
        return not self.map.units and not self.squeeze and self.escape

    def __call__(self, text: bytes) -> tuple[bytes, list[int]]:
        """The normalised bytes, and for each of them, and the end, its place in the text."""
        parts, at = [], 0
        while at < len(text):
            got = self.map.longest(text, at)
            if got is None:
                lead = text[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                got = n, text[at : at + n]
            parts.append((at, got[0], got[1]))
            at += got[0]
        if self.squeeze:
            while parts and parts[0][2] == b" ":
                parts.pop(0)
        out, source = bytearray(), []
        space = SPACE if self.escape else b" "
        if not parts:
            return b"", [0]
        if self.prefix:
            out += space
            source += [parts[0][0]] * len(space)
        was_space = self.squeeze
        for place, _, text_of in parts:
            for byte_at in range(len(text_of)):
                b = text_of[byte_at : byte_at + 1]
                if b == b" ":
                    if was_space and self.squeeze:
                        continue
                    out += space
                    source += [place] * len(space)
                    was_space = True
                else:
                    out += b
                    source.append(place)
                    was_space = False
        end = parts[-1][0] + parts[-1][1]
        if self.squeeze:
            while out.endswith(space) and len(out) > 0:
                end = source[len(out) - len(space)]
                del out[-len(space) :]
                del source[-len(space) :]
        return bytes(out), [*source, end]


class PieceBpe:
    """Encoder and decoder of one model; one per task."""

    def __init__(self, path: str, cache: int = 500_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            blob = f.read()
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(blob)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.normalize = Normalizer(proto.normalizer_spec)
        names = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        usual = {n: i for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if k == 1}
        byte_ids = [i for i, k in enumerate(kinds) if k == 6]
        #: Other models go to the library text by text.
        self.fast = proto.trainer_spec.model_type == 2 and len(byte_ids) == 256 and not {4, 5} & {*kinds} and self.normalize.escape and not proto.trainer_spec.treat_whitespace_as_suffix and not any("▁" in n.lstrip("▁") for n in usual)
        self.byte_ids = np.array(byte_ids, np.int64)
        self.pieces = [bytes([int(n[3:5], 16)]) if k == 6 else b"" if k == 3 else n.replace("▁", " ").encode() if k != 2 else b" \xe2\x81\x87 " for n, k in zip(names, kinds, strict=True)]
        self.piece_bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.piece_lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.piece_starts = np.cumsum(self.piece_lengths) - self.piece_lengths
        #: Bytes of normalised text, where the space mark is one byte, that a piece stands for.
        self.piece_covers = self.piece_lengths.copy()
        self.piece_covers[byte_ids] = 1
        digits = [f"{i},".encode() for i in range(len(names))]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.digit_lengths = np.array([len(d) for d in digits], np.int64)
        self.digit_starts = np.cumsum(self.digit_lengths) - self.digit_lengths
        if self.fast:
            self.symbol = np.full(0x110000, -1, np.int64)
            for n, i in usual.items():
                if len(n) == 1:
                    self.symbol[ord(n)] = i
            inner = {c for n in usual if len(n) > 1 for c in n}
            self.alone = np.array([chr(b) not in inner and b != 0x20 for b in range(0x80)] + [False] * 0x80)
            rows = [(usual[n[:k]], usual[n[k:]], i) for n, i in usual.items() for k in range(1, len(n)) if n[:k] in usual and n[k:] in usual]
            left, right, made = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            scores = np.array([p.score for p in proto.pieces])
            rank = np.unique(-scores, return_inverse=True)[1]
            self.merges = Merges(left, right, rank[made], made)
            self.cache = WordCache(cache)

    def encode_slice(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice of texts, and their number for each."""
        return self.encode_aligned(raw, offsets)[:2]

    def encode_aligned(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a slice of texts, their number for each, and the pieces' begins and ends in bytes of their text."""
        n = len(offsets) - 1
        none = np.zeros(0, np.int64)
        if not len(raw):
            return none, np.zeros(n, np.int64), none, none
        if not self.fast:
            texts = [raw[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            got = [np.array(x, np.int64) for x in self.library.encode([t.decode() for t in texts], num_threads=1)]
            spans = [self.spans_of(t, x) for t, x in zip(texts, got, strict=True)]
            return np.concatenate(got), np.array([len(x) for x in got], np.int64), *(np.concatenate([x[k] for x in spans]) for k in (0, 1))
        buf, lengths, source, stops = self._normalised(raw, offsets)
        if not len(buf):
            return none, np.zeros(n, np.int64), none, none
        ids, counts = self._ids(buf, lengths)
        # The pieces of a row cover its normalised text from end to end.
        ends = np.cumsum(self.piece_covers[ids])
        begins = ends - self.piece_covers[ids]
        if not np.array_equal(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])], np.concatenate([[0], np.cumsum(lengths)])):
            raise ValueError("pieces that don't cover the normalised text")
        until = source[np.minimum(ends, len(source) - 1)]
        last = (np.cumsum(counts) - 1)[counts > 0]
        until[last] = stops[counts > 0]
        return ids, counts, source[begins], until

    def _normalised(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Normalised texts end to end, a space standing for the space mark, and their lengths; the place in its text
        of each byte, and of each text's end."""
        if self.normalize.plain:
            lengths = np.diff(offsets)
            data, stops = raw, lengths
            lead = np.where((raw & 0xC0) != 0x80, np.arange(len(raw)), 0)
            source = np.maximum.accumulate(lead) - np.repeat(offsets[:-1] - offsets[0], lengths)
        else:
            made = [self.normalize(raw[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            data = np.frombuffer(b"".join(x for x, _ in made), np.uint8)
            lengths = np.array([len(x) for x, _ in made], np.int64)
            stops = np.array([x[-1] for _, x in made], np.int64)
            source = np.concatenate([np.array(x[:-1], np.int64) for _, x in made])
        # One byte in place of the mark's three; literal marks become spaces likewise.
        marks = np.flatnonzero((data[:-2] == SPACE[0]) & (data[1:-1] == SPACE[1]) & (data[2:] == SPACE[2])) if len(data) > 2 else []
        if len(marks):
            keep = np.ones(len(data), bool)
            keep[marks + 1] = keep[marks + 2] = False
            data = data.copy()
            data[marks] = 0x20
            lengths = np.diff(np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(lengths)])])
            data, source = data[keep], source[keep]
        if not (self.normalize.plain and self.normalize.prefix):
            return data, lengths, source, stops
        lead = lengths > 0
        place = np.arange(len(data)) + np.repeat(np.cumsum(lead), lengths)
        buf, of = np.full(len(data) + int(lead.sum()), 0x20, np.uint8), np.zeros(len(data) + int(lead.sum()), np.int64)
        buf[place], of[place] = data, source
        return buf, lengths + lead, of, stops

    def _ids(self, buf: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised texts, and their number for each."""
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        space = buf == 0x20
        fresh = np.zeros(len(buf), bool)
        fresh[0] = True
        fresh[1:] = space[1:] & ~space[:-1]
        alone = self.alone[buf]
        fresh |= alone
        fresh[1:] |= alone[:-1]
        fresh[bounds[:-1][lengths > 0]] = True
        begin = np.flatnonzero(fresh)
        stop = np.append(begin[1:], len(buf))
        rows = np.searchsorted(bounds, begin, side="right") - 1
        hashes, first, inverse = np.unique(hash_spans(buf, begin, stop), return_index=True, return_inverse=True)
        starts, counts = self.cache.look_up(hashes, lambda new: self._segments(buf, begin[first[new]], stop[first[new]]))
        per_segment = counts[inverse]
        ids = self.cache.ids[ragged(starts[inverse], per_segment)].astype(np.int64)
        return ids, np.bincount(rows, per_segment, len(lengths)).astype(np.int64)

    def _segments(self, buf: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct segments and their numbers."""
        lengths = stop - begin
        data = buf[ragged(begin, lengths)]
        at = np.flatnonzero((data & 0xC0) != 0x80)
        lead = data[at].astype(np.int64)
        width = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        points = np.where(width == 1, lead, lead & (0xFF >> (width + 1)))
        for k in range(1, 4):
            more = np.flatnonzero(width > k)
            points[more] = (points[more] << 6) | (data[at[more] + k] & 0x3F)
        points[lead == 0x20] = ord("▁")
        symbols = self.symbol[points]
        missing = symbols < 0
        symbols[missing] = -points[missing] - 1
        of = np.searchsorted(np.cumsum(lengths), at, side="right")
        many = np.bincount(of, minlength=len(lengths))
        long = (many > LONG) & self.normalize.plain  # the library would normalise a second time
        if long.any():
            ids, counts = self.merges.encode(symbols[~long[of]], many[~long])
        else:
            ids, counts = self.merges.encode(symbols, many)
        if (ids < 0).any():  # characters without a piece are spelt in bytes
            spelt = [self.byte_ids[np.frombuffer(chr(-i - 1).encode(), np.uint8)] if i < 0 else np.array([i]) for i in ids.tolist()]
            owner = np.repeat(np.arange(len(counts)), counts)
            counts = np.bincount(owner, [len(x) for x in spelt], len(counts)).astype(np.int64)
            ids = np.concatenate(spelt)
        if not long.any():
            return ids, counts
        out = np.zeros(len(lengths), np.int64)
        out[~long] = counts
        far = [np.array(self._long(buf[begin[i] : stop[i]].tobytes()), np.int64) for i in np.flatnonzero(long)]
        out[long] = [len(x) for x in far]
        starts = np.zeros(len(lengths), np.int64)
        starts[~long] = np.cumsum(counts) - counts
        starts[long] = len(ids) + np.cumsum(out[long]) - out[long]
        return np.concatenate([ids, *far])[ragged(starts, out)], out

    def _long(self, segment: bytes) -> list[int]:
        """Ids of one long segment: the library adds the leading space itself, so one is taken away, or marked off by a line end."""
        text = segment.decode()
        if not self.normalize.prefix:
            return self.library.encode(text)
        if text.startswith(" "):
            return self.library.encode(text[1:]) if len(text) > 1 else self.library.encode("\n")[:1]
        lead = len(self.library.encode("\n"))
        return self.library.encode("\n" + text)[lead:]

    def spans_of(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends, in bytes of the text, of the pieces of its encoding."""
        normal, source = self.normalize(text)
        table = np.where(np.isin(np.arange(len(self.pieces)), self.byte_ids), 1, [len(p) + 2 * p.count(b" ") for p in self.pieces])
        ends = np.minimum(np.cumsum(table[ids]), len(normal))
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ids) else ends
        source = np.array(source, np.int64)
        return source[begins], source[ends]

    def decode_bytes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The decoded texts of rows of ids, end to end, and their lengths: pieces with the leading space taken off."""
        sizes = self.piece_lengths[ids]
        data = self.piece_bytes[ragged(self.piece_starts[ids], sizes)]
        firsts = (np.cumsum(counts) - counts)[counts > 0]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        lengths = np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])
        if self.normalize.prefix and len(data):
            at = ends[firsts]
            at = at[(at < len(data)) & (sizes[firsts] > 0)]
            keep = np.ones(len(data), bool)
            keep[at[data[at] == 0x20]] = False
            lengths = np.diff(np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(lengths)])])
            data = data[keep]
        return data, lengths

    def digit_text(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's ids in decimal, with a comma after each, end to end, and the bounds of the rows."""
        sizes = self.digit_lengths[ids]
        data = self.digits[ragged(self.digit_starts[ids], sizes)]
        return data, np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]


_FIELDS = {
    "n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "begins": T.ArrayType(T.IntegerType()), "ends": T.ArrayType(T.IntegerType()),
    "decoded": T.StringType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(), "spans_sha256": T.StringType(),
}


def encode(df: DataFrame, model: str, text_col: str = "text", columns: tuple[str, ...] = ("n_tokens", "ids", "begins", "ends", "decoded")) -> DataFrame:
    """df with the named columns: n_tokens, ids, begins and ends (byte spans of the pieces), decoded (the text that
    the ids decode to), and the digests ids_sha256 (decimal ids joined by commas), decoded_sha256 and spans_sha256
    (begin and end of each piece in turn, as little-endian numbers of 4 bytes).

    Cases: null and empty texts have no ids and decode to ''; columns of these
    names are replaced, all others pass through; one row out for each row in;
    an empty table stays empty.  Texts of any length are taken whole.
    """
    out = T.StructType([T.StructField(c, _FIELDS[c]) for c in columns])

    def make():
        coder = PieceBpe(model)

        def run(batch: pa.RecordBatch) -> list:
            buf, offsets = text_bytes(batch.column(0))
            made: dict[str, list] = {c: [] for c in columns}
            for a, b in slices(offsets, 1 << 20):
                raw, part = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                ids, counts, begins, ends = coder.encode_aligned(raw, part)
                for c in columns:
                    if c == "n_tokens":
                        made[c].append(pa.array(counts))
                    elif c == "ids":
                        made[c].append(list_array(ids, counts, pa.int32()))
                    elif c == "ids_sha256":
                        data, bounds = coder.digit_text(ids, counts)
                        made[c].append(_hashes(data, bounds, 1))
                if {"decoded", "decoded_sha256"} & made.keys():
                    data, lengths = coder.decode_bytes(ids, counts)
                    bounds = np.concatenate([[0], np.cumsum(lengths)])
                    if "decoded" in made:
                        made["decoded"].append(pa.array([bytes(data[i:j]).decode(errors="replace") for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.string()))
                    if "decoded_sha256" in made:
                        made["decoded_sha256"].append(_hashes(data, bounds, 0))
                if "begins" in made:
                    made["begins"].append(list_array(begins, counts, pa.int32()))
                if "ends" in made:
                    made["ends"].append(list_array(ends, counts, pa.int32()))
                if "spans_sha256" in made:
                    both = np.stack([begins, ends], 1).astype("<i4").view(np.uint8).ravel()
                    made["spans_sha256"].append(_hashes(both, np.concatenate([[0], np.cumsum(counts * 8)]), 0))
            return [pa.concat_arrays(made[c]) for c in columns]

        return run

    return add_columns(df, [text_col], out, make)


def _hashes(data: np.ndarray, bounds: np.ndarray, less: int) -> pa.Array:
    view = memoryview(np.ascontiguousarray(data))
    return pa.array([hashlib.sha256(view[i : max(i, j - less)]).hexdigest() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string())
