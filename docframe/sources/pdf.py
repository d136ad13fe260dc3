"""PDF files: searchable pages are written, and the text of pages is read.

Written are pages of a gray image with the recognised words as invisible text over it.  Read are files whose pages and
content streams stand as plain or deflated objects (also in object streams), with text in simple or two-byte fonts that map
to Unicode; drawing pages is left to adapters.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.operators.geometry import png_decode

_TO_UNICODE = b"""/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /Plain def /CMapType 2 def
1 begincodespacerange <0000> <FFFF> endcodespacerange
1 beginbfrange <0000> <FFFF> <0000> endbfrange
endcmap CMapName currentdict /CMap defineresource pop end end"""


def _stream(data: bytes, more: str = "") -> bytes:
    packed = zlib.compress(data, 6)
    return f"<< /Length {len(packed)} /Filter /FlateDecode {more}>>\nstream\n".encode() + packed + b"\nendstream"


def searchable(pages: list[tuple[np.ndarray, list[tuple[str, float, float, float, float]]]], dpi: int = 300) -> bytes:
    """A file of pages: gray images, and words (text, x, y, w, h in pixels) as invisible text at their places.

    A word's baseline lies 0.82 of its height below its top, its size is 0.78 of its height, 2.5 points at least; its width is
    that of its box."""
    scale = 72 / dpi
    objects: list[bytes] = [b"", b"", b"<< /Type /Font /Subtype /Type0 /BaseFont /Plain /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>", b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Plain /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /FontDescriptor 6 0 R /DW 500 >>", _stream(_TO_UNICODE), b"<< /Type /FontDescriptor /FontName /Plain /Flags 4 /FontBBox [0 0 500 1000] /ItalicAngle 0 /Ascent 800 /Descent -200 /CapHeight 700 /StemV 80 >>"]
    kids = []
    for gray, words in pages:
        height, width = gray.shape
        w, h = width * scale, height * scale
        lines = [f"q {w:.2f} 0 0 {h:.2f} 0 0 cm /Page Do Q BT 3 Tr"]
        for text, x, y, ww, hh in words:
            size = max(2.5, 0.78 * hh * scale)
            coded = text.encode("utf-16-be").hex().upper()
            stretch = max(1.0, ww * scale / (len(coded) / 4 * 0.5 * size) * 100) if text else 100.0
            lines.append(f"/F {size:.2f} Tf {stretch:.2f} Tz 1 0 0 1 {x * scale:.2f} {h - (y + 0.82 * hh) * scale:.2f} Tm <{coded}> Tj")
        objects.append(_stream(np.ascontiguousarray(gray).tobytes(), f"/Type /XObject /Subtype /Image /Width {width} /Height {height} /ColorSpace /DeviceGray /BitsPerComponent 8 "))
        objects.append(_stream(("\n".join(lines) + "\nET").encode()))
        n = len(objects)
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {w:.2f} {h:.2f}] /Contents {n} 0 R /Resources << /Font << /F 3 0 R >> /XObject << /Page {n - 1} 0 R >> >> >>".encode())
        kids.append(f"{n + 1} 0 R")
    objects[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>".encode()
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    end = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{end}\n%%EOF\n".encode())


_REF = rb"(\d+)\s+\d+\s+R"


def _data(body: bytes) -> bytes:
    """The content of a stream object, inflated if it is deflated; empty if it has another filter."""
    head, _, rest = body.partition(b"stream")
    data = rest[2:] if rest[:2] == b"\r\n" else rest[1:]
    length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
    data = data[: int(length[1])] if length else data.rpartition(b"endstream")[0]
    if b"/FlateDecode" in head:
        try:
            return zlib.decompressobj().decompress(data)
        except zlib.error:
            return b""
    return b"" if b"/Filter" in head else data


def _objects(data: bytes) -> dict[int, bytes]:
    found: dict[int, bytes] = {}
    begins, at = re.compile(rb"(\d+)\s+\d+\s+obj\b"), 0
    while match := begins.search(data, at):
        begin = match.end()
        stream, end = data.find(b"stream", begin), data.find(b"endobj", begin)
        if 0 <= stream < end:  # its bytes may hold anything, so they are passed over
            length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", data[begin:stream])
            over = stream + 6 + int(length[1]) if length else data.find(b"endstream", stream)
            end = data.find(b"endobj", over)
        if end < 0:
            break
        found[int(match[1])] = data[begin:end]
        at = end + 6
    for body in list(found.values()):
        if b"/ObjStm" in body[:400]:
            first, count = (int(re.search(rb"/" + k + rb"\s+(\d+)", body)[1]) for k in (b"First", b"N"))
            inner = _data(body)
            numbers = [int(x) for x in inner[:first].split()[: 2 * count]]
            stops = [*numbers[3::2], len(inner) - first]
            for n, a, b in zip(numbers[::2], numbers[1::2], stops, strict=True):
                found.setdefault(n, inner[first + a : first + b])
    return found


def _pages(objects: dict[int, bytes]) -> list[int]:
    """Numbers of the page objects in order."""
    root = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog", b)), None)
    top = re.search(rb"/Pages\s+" + _REF, root or b"")
    if not top:
        return sorted(n for n, b in objects.items() if re.search(rb"/Type\s*/Page\b(?!s)", b))
    out, waiting, seen = [], [int(top[1])], set()
    while waiting:
        n = waiting.pop(0)
        if n in seen or n not in objects:
            continue
        seen.add(n)
        kids = re.search(rb"/Kids\s*\[(.*?)\]", objects[n], re.DOTALL)
        if kids:
            waiting = [int(m) for m in re.findall(_REF, kids[1])] + waiting
        else:
            out.append(n)
    return out


class _Codes:
    """What the codes of a font stand for: single ones, and ranges (low, high, first character), of which the last counts."""

    def __init__(self, single: dict[int, str] | None = None, ranges: list[tuple[int, int, int]] | None = None):
        self.single, self.ranges = single or {}, ranges or []
        self.met: dict[int, str | None] = {}

    def get(self, code: int, default: str) -> str:
        if code not in self.met:
            at = (to + code - low for low, high, to in reversed(self.ranges) if low <= code <= high)
            self.met[code] = next((chr(v) for v in at if not 0xD800 <= v <= 0xDFFF), self.single.get(code))
        found = self.met[code]
        return default if found is None else found


def _unicode(cmap: bytes) -> _Codes:
    """What the codes of a font stand for; a range stays one, as it may take in all codes."""
    out = _Codes()
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.DOTALL):
        out.single |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.DOTALL):
        out.ranges += [(int(a, 16), int(b, 16), int(c, 16)) for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)]
    return out


_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\([^()]*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()]+|\[|\]|[-+.\d]+|[A-Za-z'\"*]+", re.DOTALL)


def _bytes_of(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    one = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1])
    return re.sub(rb"\\([0-7]{1,3}|.)", one, token[1:-1], flags=re.DOTALL)


def _shown(content: bytes, fonts: dict[bytes, tuple[bool, _Codes]]) -> str:
    """Text that a content stream shows: a line for each height, a space between pieces of a line."""
    out: list[str] = []
    wide, codes, last_y, y = False, _Codes(), None, 0.0
    stack: list[bytes] = []

    def show(piece: bytes) -> None:
        nonlocal last_y
        values = [int.from_bytes(piece[i : i + 2], "big") for i in range(0, len(piece) - 1, 2)] if wide else list(piece)
        text = "".join(codes.get(v, "" if wide else bytes([v]).decode("cp1252", "replace")) for v in values)
        if text:
            if out and not out[-1].endswith(("\n", " ")):
                out.append(" " if last_y is not None and abs(last_y - y) < 2 else "\n")
            out.append(text)
            last_y = y

    for token in _TOKEN.findall(content):
        if token[:1].isalpha() or token in (b"'", b'"', b"T*"):
            if token == b"Tf" and len(stack) >= 2:
                wide, codes = fonts.get(stack[-2][1:], (False, _Codes()))
            elif token in (b"Td", b"TD") and len(stack) >= 2:
                y += float(stack[-1])
            elif token == b"Tm" and len(stack) >= 6:
                y = float(stack[-1])
            elif token in (b"T*", b"'", b'"'):
                y -= 12
            if token in (b"Tj", b"'", b'"') and stack and stack[-1][:1] in b"(<":
                show(_bytes_of(stack[-1]))
            elif token == b"TJ":
                show(b"".join(_bytes_of(t) for t in stack if t[:1] in b"(<"))
            elif token == b"BT":
                y = 0.0
            stack = []
        else:
            stack.append(token)
    return "\n".join(line.strip() for line in "".join(out).split("\n")).strip()


def page_texts(data: bytes) -> list[str]:
    """The text of each page, empty where a page shows none."""
    objects = _objects(data)

    def value(body: bytes, key: bytes) -> bytes:
        """What a key holds: an object that it refers to, or the dictionary or array that follows."""
        match = re.search(rb"/" + key + rb"\s*(?:" + _REF + rb"|(<<|\[))", body)
        if not match:
            return b""
        return objects.get(int(match[1]), b"") if match[1] else body[match.start(2) :]

    @functools.cache
    def font(n: int) -> tuple[bool, _Codes]:
        body = objects.get(n, b"")
        cmap = re.search(rb"/ToUnicode\s+" + _REF, body)
        return b"/Type0" in body, _unicode(_data(objects.get(int(cmap[1]), b""))) if cmap else _Codes()

    out = []
    for n in _pages(objects):
        page = objects[n]
        resources, parent = value(page, b"Resources"), page
        while not resources and (up := re.search(rb"/Parent\s+" + _REF, parent)) and int(up[1]) in objects:
            parent = objects[int(up[1])]
            resources = value(parent, b"Resources")
        fonts = {name: font(int(ref)) for name, ref in re.findall(rb"/([^\s/<>\[\]()]+)\s+" + _REF, value(resources, b"Font").split(b">>")[0])}
        own = re.search(rb"/Contents\s*(?:\[(.*?)\]|" + _REF + rb")", page, re.DOTALL)
        parts = [int(x) for x in re.findall(_REF, own[1])] if own and own[1] is not None else [int(own[2])] if own else []
        out.append(_shown(b"\n".join(_data(objects.get(p, b"")) for p in parts), fonts))
    return out


def text_pages(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Pages of PDF files that show text: key, page (from 1), text, and the number of pages of the file."""
    kind = dict(files.dtypes)[key]

    def work(batches):
        for batch in batches:
            rows = []
            for k, data in zip(batch[key], batch[content], strict=True):
                texts = page_texts(bytes(data))
                rows += [(k, i, t, len(texts)) for i, t in enumerate(texts, 1) if t]
            yield pd.DataFrame(rows, columns=[key, "page", "text", "pages"])

    return files.select(key, content).mapInPandas(work, f"{key} {kind}, page int, text string, pages int")


def markdown_of(data: bytes, empty: str = "_No text layer_") -> str:
    """A heading and the text of each page, or a note where a page has none."""
    return "\n\n".join(f"## Page {i}\n\n{t or empty}" for i, t in enumerate(page_texts(data), 1))


def markdown(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Markdown of PDF files."""

    @F.pandas_udf(T.StringType())
    def read(data: pd.Series) -> pd.Series:
        return data.map(lambda v: markdown_of(bytes(v)))

    return files.select(key, read(content).alias("markdown"))


def searchable_files(pages: DataFrame, words: DataFrame, by: str = "document_id", dpi: int = 300) -> DataFrame:
    """A searchable PDF of each document from its pages (page, content as PNG) and words (page, text, x, y, w, h).

    A document's pages meet in one task, as the file is one; documents are dealt by their ids."""
    word = F.struct("y", "x", "text", "w", "h")
    on_page = words.where((F.trim("text") != "") & (F.col("w") > 0) & (F.col("h") > 0)).groupBy(by, "page").agg(F.array_sort(F.collect_list(word)).alias("words"))
    grouped = pages.select(by, "page", "content").join(on_page, [by, "page"], "left").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("page", "content", "words"))).alias("pages"))
    kind = dict(grouped.dtypes)[by]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for document in batch.column(1).to_pylist():
                made.append(searchable([(png_decode(p["content"]), [(w["text"], w["x"], w["y"], w["w"], w["h"]) for w in p["words"] or ()]) for p in document], dpi))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=[by, "content"])

    return grouped.mapInArrow(work, f"{by} {kind}, content binary")
