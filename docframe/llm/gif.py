"""GIF columns: texts stored as animated GIFs and read back as timed frames with colour histograms.

The reader takes any GIF 87a or 89a: global and local palettes, interlaced
images, transparency, the four ways of disposal, delays, and LZW code streams
with clear codes, growing widths and full tables, which may stay in use for as long
as the encoder likes.  Code streams are unpacked a run between clear codes at a
time, as the width of each code follows from its place in the run; a run that
goes on with a full table is unpacked in blocks of codes of 12 bits.

Cases: null and empty texts are stored as 64 zero bytes; texts of any length
are stored whole, in frames of at most FRAME_ROWS rows; equal texts give equal
files; a damaged file raises ValueError; columns of the same names are
replaced, others pass through; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docframe.llm.arrowmap import add_columns, list_array
from docframe.llm.textbytes import text_bytes

WIDTH = 64
FRAME_ROWS = 0xFFFF
DELAY = 10  # hundredths of a second
#: Levels of each colour channel in a histogram.
LEVELS = 4


def _run_layout(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Width of each code of a run after a clear code, and its first bit; a code more than a full table has, at least.

    A reader adds an entry with every code but the first, and reads wider codes once the table has 2 ** width."""
    first = (1 << size) + 2
    entries = first + np.maximum(np.arange(1 << 13) - 1, 0)
    widths = np.minimum(np.floor(np.log2(entries + 0.5)).astype(np.int64) + 1, 12)
    return widths, np.cumsum(widths) - widths


#: Codes that are read at once with a full table that stays in use.
_BLOCK = 1 << 13
_LAYOUTS = {size: _run_layout(size) for size in range(2, 9)}


def lzw_pack(data: bytes, size: int = 8) -> bytes:
    """The LZW code stream of samples."""
    clear, first = 1 << size, (1 << size) + 2
    widths, _ = _LAYOUTS[size]
    runs: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    get, n, prefix = table.get, first, -1
    for b in data:
        if prefix < 0:
            prefix = b
            continue
        key = prefix << 8 | b
        code = get(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        prefix = b
        if n < 4095:
            table[key] = n
            n += 1
        else:
            codes.append(clear)
            runs.append(codes)
            codes, n = [], first
            table.clear()
    if prefix >= 0:
        codes.append(prefix)
    codes.append(clear + 1)
    runs.append(codes)
    values = np.array([clear] + [c for run in runs for c in run], np.int64)
    bits = np.concatenate([[size + 1], *(widths[: len(run)] for run in runs)])
    places = np.arange(12)
    return np.packbits(((values[:, None] >> places) & 1)[places < bits[:, None]].astype(np.uint8), bitorder="little").tobytes()


class _Table:
    """Strings of the codes: the last sample, the code of what stands before it, and the length."""

    def __init__(self, parent: np.ndarray, last: np.ndarray, length: np.ndarray, first: int):
        self.parent, self.last, self.length, self.first = parent, last, length, first

    def write(self, codes: np.ndarray) -> np.ndarray:
        """The samples that codes stand for."""
        ends = np.cumsum(self.length[codes])
        out = np.empty(int(ends[-1]), np.uint8)
        place, at = ends - 1, codes
        while len(at):
            out[place] = self.last[at]
            more = at >= self.first
            place, at = place[more] - 1, self.parent[at[more]]
        return out


def _run(codes: np.ndarray, clear: int) -> tuple[np.ndarray, _Table]:
    """The samples of a run of codes after a clear code, and the table that it leaves.

    Each code but the first adds an entry: the string of the code before it and
    one sample more, the first of its own string.  So entries form a forest with
    the samples as roots; lengths and roots come from pointer doubling, and the
    strings are written from their ends, one place of all codes at a time.
    """
    first = clear + 2
    entries = min(len(codes) - 1, 4096 - first)
    known = np.minimum(first + np.arange(len(codes)), 4096)
    known[0] = clear
    if (codes >= known).any():
        raise ValueError("damaged LZW stream")
    parent = np.arange(first + max(entries, 0))
    parent[first:] = codes[:entries] if entries > 0 else []
    root = parent.copy()
    steps = (np.arange(len(parent)) >= first).astype(np.int64)
    while (root >= first).any():
        steps += steps[root]
        root = root[root]
    length = steps + 1
    last = root.copy()
    last[first:] = root[codes[1 : entries + 1]] if entries > 0 else []
    table = _Table(parent, last, length, first)
    return table.write(codes), table


def _codes(raw: np.ndarray, at: np.ndarray, widths: np.ndarray | int) -> np.ndarray:
    """The codes of these widths that begin at these bits."""
    return (raw[at >> 3] | raw[(at >> 3) + 1] << 8 | raw[(at >> 3) + 2] << 16) >> (at & 7) & (1 << widths) - 1


def lzw_unpack(stream: bytes, size: int, most: int) -> bytes:
    """The samples of a code stream, `most` at the most."""
    clear, end = 1 << size, (1 << size) + 1
    widths, places = _LAYOUTS[size]
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    limit, bit, made, out = len(stream) * 8, 0, 0, []
    table = None  # a full table that stays in use
    while made < most and bit + (12 if table else size + 1) <= limit:
        if table:
            n = min(_BLOCK, (limit - bit) // 12)
            at = bit + 12 * np.arange(n)
            codes = _codes(raw, at, 12)
            stops = np.flatnonzero((codes == clear) | (codes == end))
            stop = int(stops[0]) if len(stops) else n
            if stop:
                out.append(table.write(codes[:stop]).tobytes())
                made += len(out[-1])
            if stop < n and codes[stop] == end:
                break
            bit += 12 * min(n, stop + 1)
            if stop < n:
                table = None
            continue
        # A run from here to the next clear code (which itself may come first).
        n = int(np.searchsorted(places, limit - bit - widths[0], side="right"))
        while n and bit + int(places[n - 1] + widths[n - 1]) > limit:
            n -= 1
        at = bit + places[:n]
        codes = _codes(raw, at, widths[:n])
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else n
        if stop:
            samples, left = _run(codes[:stop], clear)
            out.append(samples.tobytes())
            made += len(out[-1])
        if stop == n:
            if n < len(places):
                break
            table, bit = left, bit + int(places[-1] + widths[-1])
            continue
        if codes[stop] == end:
            break
        bit = int(at[stop] + widths[stop])
    return b"".join(out)[:most]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(part)]) + part for i in range(0, len(data), 255) if (part := data[i : i + 255])) + b"\0"


_GREYS = bytes(v for v in range(256) for _ in range(3))


def encode(payload: bytes) -> bytes:
    """A GIF whose samples are the payload's bytes (a positive multiple of WIDTH), in frames of FRAME_ROWS rows."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), _GREYS]
    for top in range(0, rows, FRAME_ROWS):
        n = min(FRAME_ROWS, rows - top)
        part = payload[top * WIDTH : (top + n) * WIDTH]
        out += [b"!\xf9\x04", struct.pack("<BHB", 1 << 2, DELAY, 0), b"\0", b",", struct.pack("<HHHHB", 0, 0, WIDTH, n, 0), b"\x08", _blocks(lzw_pack(part))]
    return b"".join([*out, b";"])


@dataclass
class Frame:
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    canvas: np.ndarray  # rows, columns, 4: red, green, blue and whether anything is there (255 or 0)

    @property
    def drawn(self) -> np.ndarray:
        """The part of the canvas that this frame's image covers."""
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]


def decode(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF as they are shown."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13
    palette = None
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        palette, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, hidden = 0, 0, None
    while at < len(data):
        mark = data[at]
        at += 1
        if mark == 0x3B:
            return
        if mark == 0x21:
            label = data[at]
            body, at = _read_blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, hidden = packed >> 2 & 7, index if packed & 1 else None
        elif mark == 0x2C:
            left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at)
            at += 9
            colours = palette
            if packed & 0x80:
                n = 3 << (packed & 7) + 1
                colours, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
            if colours is None:
                raise ValueError("no palette")
            size = data[at]
            if not 2 <= size <= 8:
                raise ValueError("a code size from 2 to 8 is needed")
            body, at = _read_blocks(data, at + 1)
            samples = np.frombuffer(lzw_unpack(body, size, w * h).ljust(w * h, b"\0"), np.uint8).reshape(h, w)
            if packed & 0x40:
                order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                plain = np.empty_like(samples)
                plain[order] = samples
                samples = plain
            kept = canvas.copy() if disposal == 3 else None
            # An image that stands out over the screen is cut off there.
            part = canvas[top : top + h, left : left + w]
            samples = samples[: part.shape[0], : part.shape[1]]
            table = np.zeros((256, 4), np.uint8)
            table[: len(colours), :3] = colours
            table[:, 3] = 255
            drawn = table[samples]
            if hidden is None:
                part[:] = drawn
            else:
                shown = samples != hidden
                part[shown] = drawn[shown]
            yield Frame(delay * 10, left, top, part.shape[1], part.shape[0], canvas.copy() if disposal in (0, 1) and at < len(data) and data[at] != 0x3B else canvas)
            if disposal == 2:
                canvas = canvas.copy()
                canvas[top : top + h, left : left + w] = 0
            elif disposal == 3:
                canvas = kept
            delay, disposal, hidden = 0, 0, None
        else:
            raise ValueError("damaged GIF")


def _read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def histogram(canvas: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """How many shown pixels fall in each of levels ** 3 colour boxes (red, then green, then blue)."""
    shift = 9 - levels.bit_length()  # levels is a power of two
    shown = canvas.reshape(-1, 4)
    if not (shown[:, 3] > 0).all():
        shown = shown[shown[:, 3] > 0]
    red, green, blue = (shown[:, k] >> shift for k in range(3))
    box = (red.astype(np.uint16) * levels + green) * levels + blue
    return np.bincount(box, minlength=levels**3)


_FRAME = T.StructType(
    [T.StructField("frame", T.IntegerType()), T.StructField("delay_ms", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("rgba", T.BinaryType()), T.StructField("histogram", T.ArrayType(T.LongType()))]
)


def frames(df: DataFrame, media_col: str, id_col: str) -> DataFrame:
    """A row per frame of each GIF: id, frame (from 0), delay_ms, width, height, rgba (the canvas) and histogram. Null: no frames."""
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *_FRAME.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, media in enumerate(batch.column(1)):
                if not media.is_valid:
                    continue
                for k, f in enumerate(decode(media.as_py())):
                    own = batch.column(0).slice(i, 1)
                    size = f.canvas.shape
                    bins = histogram(f.canvas)
                    columns = [own, pa.array([k], pa.int32()), pa.array([f.delay_ms], pa.int32()), pa.array([size[1]], pa.int32()), pa.array([size[0]], pa.int32()), pa.array([f.canvas.tobytes()]), list_array(bins, np.array([len(bins)]), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=[x.name for x in out])

    return df.select(id_col, media_col).mapInArrow(work, out)


_STORED = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_bytes", "payload_bytes")] + [T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("n_frames", T.IntegerType()), T.StructField("duration_ms", T.LongType()), T.StructField("histogram", T.ArrayType(T.LongType()))]
)


def store_texts(df: DataFrame, text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """df with its texts as GIFs, and what is read back from these: n_bytes (of the text), payload_bytes, payload_sha256
    and tail_crc32 (of the samples read back), media_bytes, media_sha256, n_frames, duration_ms, the colour histogram of
    all drawn pixels, and on request the GIF itself as media."""
    out = T.StructType(_STORED.fields + ([T.StructField("media", T.BinaryType())] if keep_media else []))

    def make():
        def run(batch: pa.RecordBatch) -> list:
            buf, offsets = text_bytes(batch.column(0))
            rows = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                n = b - a
                media = encode(buf[a:b].tobytes() + b"\0" * (WIDTH if not n else -n % WIDTH))
                digest, size, tail, count, duration, bins = hashlib.sha256(), 0, b"", 0, 0, np.zeros(LEVELS**3, np.int64)
                for f in decode(media):
                    samples = np.ascontiguousarray(f.drawn[:, :, 0]).tobytes()
                    digest.update(samples)
                    size, tail, count, duration = size + len(samples), samples[-64:], count + 1, duration + f.delay_ms
                    bins += histogram(f.drawn)
                rows.append((n, size, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), count, duration, bins, media))
            columns = [list(c) for c in zip(*rows, strict=True)]
            made = [*columns[:8], list_array(np.concatenate(columns[8]), np.full(len(rows), LEVELS**3), pa.int64())]
            return made + ([columns[9]] if keep_media else [])

        return run

    return add_columns(df, [text_col], out, make)
