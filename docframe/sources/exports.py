"""Exports: Markdown and HTML by expressions, office files by an Arrow pass that writes one archive a document."""

from __future__ import annotations

import io
import json
import math
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from functools import lru_cache
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions import text as X

#: Files in archives bear one date, so that equal documents give equal files.
_DATE = (1980, 1, 1, 0, 0, 0)
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def markdown(docs: DataFrame) -> DataFrame:
    """docs (title, engine, pages: texts) with markdown: title, engine, and a heading and the text of each page."""
    page = F.transform("pages", lambda p, i: F.concat(F.lit("## Page "), (i + 1).cast("string"), F.lit("\n\n"), F.regexp_replace(F.coalesce(p, F.lit("")), r"^\s+|\s+$", "")))
    return docs.withColumn("markdown", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n> "), F.col("engine"), F.lit("\n\n"), F.array_join(page, "\n\n"), F.lit("\n")))


def html(docs: DataFrame) -> DataFrame:
    """docs with html: each page's paragraphs, escaped."""
    part = F.transform("pages", lambda p, i: F.concat(F.lit("<h3>Page "), (i + 1).cast("string"), F.lit("</h3>"), F.array_join(F.transform(F.filter(F.split(F.coalesce(p, F.lit("")), "\n"), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("<p>"), X.escape_html(x), F.lit("</p>"))), "")))
    return docs.withColumn("html", F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), X.escape_html("title"), F.lit("</title></head><body>"), F.array_join(part, ""), F.lit("</body></html>")))


def paragraphs(fused: Column, regions: Column, word_lines: Column, text: Column) -> Column:
    """The first layer that has anything: fused regions, regions, lines of words, lines of the text."""
    has = lambda a: F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0
    return F.when(has(fused), fused).when(has(regions), regions).when(has(word_lines), word_lines).otherwise(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != ""))


def content_score(text: str) -> float:
    """How much width a cell asks for: numbers little, long texts by the root of their length and their longest word (fixed values)."""
    text = " ".join(text.split())
    if not text:
        return 4.0
    longest = max(map(len, text.split(" ")))
    if re.fullmatch(r"[\s\d.,%+\-–—/()№]+", text):
        return 3.0 if len(text) <= 8 else 4.5
    if len(text) <= 6 and longest <= 6:
        return 4.0
    return min(22.0, 4.5 + math.sqrt(min(len(text), 500)) * 0.8 + min(longest, 30) * 0.18)


def column_widths(scores: list[float], total: float) -> list[float]:
    """Widths that sum up to the total: a least width each, the rest in proportion to the scores up to a greatest width.

    The greatest factor for which the bounded widths fit is found over the columns in the order in which they reach
    their bound; what no column may take goes to the last one."""
    n = len(scores)
    if not n:
        return []
    low = 0.28 if n > 20 else 0.38 if n > 10 else 0.55
    high = min(total - low * (n - 1), max(total / n * 1.6, min(3.5, max(1.25, total * 0.24))))
    room, rest, open_ = max(0.0, high - low), max(0.0, total - low * n), sum(scores)
    widths = [low] * n
    for i in sorted(range(n), key=lambda i: -scores[i]):
        more = min(room, rest * scores[i] / open_) if open_ > 0 else 0.0
        widths[i] += more
        rest -= more
        open_ -= scores[i]
    widths[-1] += max(0.0, rest)
    return widths


#: Parts up to this size are kept packed, as most are the same in all files of a kind; archives beyond the second are zipfile's work.
_SMALL, _PLAIN = 4096, 1 << 30


def _packed(name: str, data: str | bytes, stored: bool) -> tuple[bytes, bytes, bytes]:
    """A part in an archive: its header with its data, and its entry in the directory before and behind its place."""
    raw, path = data.encode() if isinstance(data, str) else data, name.encode()
    body = raw
    if not stored:
        deflate = zlib.compressobj(-1, zlib.DEFLATED, -15)
        body = deflate.compress(raw) + deflate.flush()
    (year, month, day, *_), utf8 = _DATE, 0 if name.isascii() else 0x800
    head = struct.pack("<5H3L2H", 20, utf8, 0 if stored else 8, 0, (year - 1980) << 9 | month << 5 | day, zlib.crc32(raw), len(body), len(raw), len(path), 0)
    return b"PK\3\4" + head + path + body, b"PK\1\2\x14\3" + head + struct.pack("<3HL", 0, 0, 0, 0o600 << 16), path


_packed_small = lru_cache(maxsize=256)(_packed)


def _zip(files: list[tuple[str, str | bytes]], stored: str | None = None) -> bytes:
    """An archive of files by name, as zipfile writes it."""
    if len(files) > 60_000 or sum(len(d) for _, d in files) * 4 > _PLAIN:
        return _large_zip(files, stored)
    parts, entries, at = [], [], 0
    for name, data in files:
        part, entry, path = (_packed_small if len(data) <= _SMALL else _packed)(name, data, name == stored)
        entries.append(b"".join((entry, struct.pack("<L", at), path)))
        parts.append(part)
        at += len(part)
    size = sum(map(len, entries))
    return b"".join([*parts, *entries, struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, len(files), len(files), size, at, 0)])


def _large_zip(files: list[tuple[str, str | bytes]], stored: str | None = None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files:
            info = zipfile.ZipInfo(name, _DATE)
            info.compress_type = zipfile.ZIP_STORED if name == stored else zipfile.ZIP_DEFLATED
            z.writestr(info, data)
    return out.getvalue()


def _types(parts: dict[str, str]) -> tuple[str, str]:
    over = "".join(f'<Override PartName="{k}" ContentType="{v}"/>' for k, v in parts.items())
    return "[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{over}</Types>'


def _rels(name: str, targets: list[tuple[str, str]]) -> tuple[str, str]:
    return name, f'<Relationships xmlns="{_REL}">' + "".join(f'<Relationship Id="rId{i + 1}" Type="{_OFFICE}/{kind}" Target="{to}"/>' for i, (kind, to) in enumerate(targets)) + "</Relationships>"


@lru_cache(maxsize=1)
def _docx_styles() -> str:
    """Headings by size, items and code, on a plain text style."""
    style = lambda key, name, run, para="": f'<w:style w:type="paragraph" w:styleId="{key}"><w:name w:val="{name}"/>{"" if key == "Normal" else "<w:basedOn w:val=" + chr(34) + "Normal" + chr(34) + "/>"}<w:pPr>{para}</w:pPr><w:rPr>{run}</w:rPr></w:style>'
    size = lambda n: f'<w:sz w:val="{n}"/>'
    heads = "".join(style(f"Heading{i}", f"heading {i}", "<w:b/>" + size(34 - 3 * i), f'<w:keepNext/><w:outlineLvl w:val="{i - 1}"/>') for i in range(1, 7))
    others = style("Normal", "Normal", size(22)) + style("ListBullet", "List Bullet", "", '<w:ind w:left="360"/>') + style("Code", "Code", '<w:rFonts w:ascii="Courier New" w:hAnsi="Courier New"/>' + size(18))
    return f'<w:styles xmlns:w="{_W}">{others}{heads}</w:styles>'


def _table_xml(rows: list[list[tuple[str, int, int]]], widths: list[float], text) -> str:
    """A table of cells (text, rows and columns that it covers): covered places below are continued, those beside are left out."""
    n, down = len(widths), {}
    body = []
    for row in rows:
        cells, x, own = [], 0, iter(row)
        while x < n:
            if down.get(x, (0, 0))[0] > 0:
                left, wide = down[x]
                down[x] = (left - 1, wide)
                cells.append((x, "", wide, '<w:vMerge/>'))
                x += wide
                continue
            value, tall, wide = next(own, ("", 1, 1))
            wide = min(wide, n - x)
            if tall > 1:
                down[x] = (tall - 1, wide)
            cells.append((x, value, wide, '<w:vMerge w:val="restart"/>' if tall > 1 else ""))
            x += wide
        parts = []
        for x, value, wide, merge in cells:
            span = f'<w:gridSpan w:val="{wide}"/>' if wide > 1 else ""
            parts.append(f'<w:tc><w:tcPr><w:tcW w:w="{int(sum(widths[x : x + wide]))}" w:type="dxa"/>{span}{merge}</w:tcPr><w:p>{text(value)}</w:p></w:tc>')
        body.append("<w:tr>" + "".join(parts) + "</w:tr>")
    edge = "".join(f'<w:{side} w:val="single" w:sz="4"/>' for side in ("top", "left", "bottom", "right", "insideH", "insideV"))
    return f"<w:tbl><w:tblPr><w:tblBorders>{edge}</w:tblBorders></w:tblPr><w:tblGrid>" + "".join(f'<w:gridCol w:w="{int(w)}"/>' for w in widths) + "</w:tblGrid>" + "".join(body) + "</w:tbl>"


def docx(title: str, blocks: list[tuple[str, list]], width: float = 10.0) -> bytes:
    """Blocks (kind, lines): headings, paragraphs, items and code are paragraphs with their styles; a table's lines are rows of
    cells, and of kind "cells" lists of (text, rowspan, colspan).  Wide tables turn the page, very wide ones take a larger one."""
    body = []
    text = lambda t: f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    wide = 0
    for kind, lines in blocks:
        if kind in ("table", "cells"):
            rows = lines if kind == "cells" else [[(c.strip(), 1, 1) for c in x.strip().strip("|").split("|")] for x in lines]
            n = max(sum(c[2] for c in r) for r in rows)
            wide = max(wide, n)
            scores = [max(4.0, *(content_score(r[i][0]) for r in rows if i < len(r) and r[i][2] == 1), 4.0) for i in range(n)]
            body.append(_table_xml(rows, [900 * w for w in column_widths(scores, width)], text))
            continue
        name = {"bullet_item": "ListBullet", "code": "Code"}.get(kind) or (f"Heading{kind[-1]}" if kind.startswith("heading") else "")
        style = f'<w:pPr><w:pStyle w:val="{name}"/></w:pPr>' if name else ""
        body += [f"<w:p>{style}{text(x)}</w:p>" for x in (lines if kind == "code" else [" ".join(lines)])]
    size = ("23811", "16838") if wide > 12 else ("16838", "11906") if wide > 7 else ("11906", "16838")
    turned = ' w:orient="landscape"' if wide > 7 else ""
    doc = f'<w:document xmlns:w="{_W}"><w:body>{"".join(body)}<w:sectPr><w:pgSz w:w="{size[0]}" w:h="{size[1]}"{turned}/></w:sectPr></w:body></w:document>'
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    parts = {"/word/document.xml": f"{kind}.document.main+xml", "/word/styles.xml": f"{kind}.styles+xml"}
    return _zip([_types(parts), _rels("_rels/.rels", [("officeDocument", "word/document.xml")]), ("word/document.xml", doc), ("word/styles.xml", _docx_styles()), _rels("word/_rels/document.xml.rels", [("styles", "styles.xml")])])


def _column(i: int) -> str:
    name = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        name = chr(65 + r) + name
    return name


#: Two cell styles: plain, and white bold letters on blue for heads.
_XLSX_STYLES = (
    f'<styleSheet xmlns="{_S}"><fonts count="2"><font><sz val="11"/><name val="Arial"/></font><font><b/><sz val="11"/><color rgb="FFFFFFFF"/><name val="Arial"/></font></fonts>'
    '<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF2F5597"/></patternFill></fill></fills>'
    '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf xfId="0"/><xf xfId="0" fontId="1" fillId="2" applyFont="1" applyFill="1"/></cellXfs></styleSheet>'
)


def xlsx(sheets: list[tuple[str, list[list[str]]]]) -> bytes:
    """Sheets (name, rows of texts); an empty workbook gets one empty sheet."""
    sheets = sheets or [("Sheet1", [])]
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {"/xl/workbook.xml": f"{kind}.sheet.main+xml", "/xl/styles.xml": f"{kind}.styles+xml"}
    files = []
    for i, (_, table) in enumerate(sheets, 1):
        parts[f"/xl/worksheets/sheet{i}.xml"] = f"{kind}.worksheet+xml"
        n = max(map(len, table), default=0)
        cols = "".join(f'<col min="{k + 1}" max="{k + 1}" width="{min(62, max((len(r[k]) for r in table if k < len(r)), default=0) + 2)}" customWidth="1"/>' for k in range(n))
        data = "".join(f'<row r="{y}">' + "".join(f'<c r="{_column(x)}{y}" s="{int(y == 1)}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for x, v in enumerate(r)) + "</row>" for y, r in enumerate(table, 1))
        files.append((f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{_S}"><sheetViews><sheetView showGridLines="0" workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>{f"<cols>{cols}</cols>" if cols else ""}<sheetData>{data}</sheetData></worksheet>'))
    book = "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, (name, _) in enumerate(sheets, 1))
    files = [_types(parts), _rels("_rels/.rels", [("officeDocument", "xl/workbook.xml")]), ("xl/workbook.xml", f'<workbook xmlns="{_S}" xmlns:r="{_OFFICE}"><sheets>{book}</sheets></workbook>'), _rels("xl/_rels/workbook.xml.rels", [*(("worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(sheets) + 1)), ("styles", "styles.xml")]), ("xl/styles.xml", _XLSX_STYLES), *files]
    return _zip(files)


def odt(title: str, lines: list[str]) -> bytes:
    """A text document; the media type comes first and isn't compressed."""
    ns = "urn:oasis:names:tc:opendocument:xmlns"
    body = "".join(f"<text:p>{escape(x)}</text:p>" for x in lines)
    content = f'<office:document-content xmlns:office="{ns}:office:1.0" xmlns:text="{ns}:text:1.0" office:version="1.2"><office:body><office:text><text:h text:outline-level="1">{escape(title)}</text:h>{body}</office:text></office:body></office:document-content>'
    kind = "application/vnd.oasis.opendocument.text"
    listed = f'<manifest:manifest xmlns:manifest="{ns}:manifest:1.0"><manifest:file-entry manifest:full-path="/" manifest:media-type="{kind}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>'
    return _zip([("mimetype", kind), ("content.xml", content), ("META-INF/manifest.xml", listed)], "mimetype")


def pptx(slides: list[tuple[str, list[str]]]) -> bytes:
    """Slides (title, lines) as the plain shapes of a presentation."""
    a, p = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
    para = lambda t: f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>"
    shape = lambda i, kind, body: f'<p:sp><p:nvSpPr><p:cNvPr id="{i}" name="{kind}"/><p:cNvSpPr/><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:spPr/><p:txBody><a:bodyPr/>{body or "<a:p/>"}</p:txBody></p:sp>'
    kind = "application/vnd.openxmlformats-officedocument.presentationml"
    parts = {"/ppt/presentation.xml": f"{kind}.presentation.main+xml"} | {f"/ppt/slides/slide{i}.xml": f"{kind}.slide+xml" for i in range(1, len(slides) + 1)}
    files = [(f"ppt/slides/slide{i}.xml", f'<p:sld xmlns:a="{a}" xmlns:p="{p}"><p:cSld><p:spTree><p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>{shape(2, "title", para(t))}{shape(3, "body", "".join(map(para, x)))}</p:spTree></p:cSld></p:sld>') for i, (t, x) in enumerate(slides, 1)]
    listed = "".join(f'<p:sldId id="{255 + i}" r:id="rId{i}"/>' for i in range(1, len(slides) + 1))
    show = f'<p:presentation xmlns:p="{p}" xmlns:r="{_OFFICE}"><p:sldIdLst>{listed}</p:sldIdLst></p:presentation>'
    return _zip([_types(parts), _rels("_rels/.rels", [("officeDocument", "ppt/presentation.xml")]), ("ppt/presentation.xml", show), _rels("ppt/_rels/presentation.xml.rels", [("slide", f"slides/slide{i}.xml") for i in range(1, len(slides) + 1)]), *files])


def archive(files: list[tuple[str, bytes]]) -> bytes:
    """A package's files by name, compressed."""
    return _zip(sorted(files))


def write_files(blocks: DataFrame, kind: str, by: str = "doc_id") -> DataFrame:
    """A row per document: id and content of its docx, xlsx, odt or pptx, from blocks (block, kind, lines).

    The blocks of a document meet in one task; a document is bounded, unlike
    the blocks of all of them, and is dealt by its id.
    """
    return write_packed(blocks.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("block", "kind", "lines"))).alias("blocks")), kind, by)


def write_packed(docs: DataFrame, kind: str, by: str = "doc_id") -> DataFrame:
    """As write_files(), from rows that hold their document's blocks (an array of structures of kind and lines) in order: no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, blocks = batch.column(1), batch.column(1).flatten()
            kinds, texts = blocks.field("kind").to_pylist(), blocks.field("lines")
            sizes, flat, lines, i = pc.list_value_length(texts).to_pylist(), texts.flatten().to_pylist(), [], 0
            for n in sizes:
                lines.append(None if n is None else flat[i : i + n])
                i += n or 0
            made, i = [], 0
            for title, n in zip(batch.column(0).to_pylist(), pc.list_value_length(lists).fill_null(0).to_pylist(), strict=True):
                made.append(_file(kind, str(title), list(zip(kinds[i : i + n], lines[i : i + n], strict=True))))
                i += n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=[by, "content"])

    return docs.select(by, "blocks").mapInArrow(work, f"{by} {dict(docs.dtypes)[by]}, content binary")


def _file(kind: str, title: str, blocks: list[tuple[str, list[str]]]) -> bytes:
    cells = lambda lines: [[c.strip() for c in x.strip().strip("|").split("|")] for x in lines]
    if kind == "docx":
        return docx(title, blocks)
    if kind == "xlsx":
        return xlsx([(f"Table_{i}", cells(lines)) for i, lines in enumerate([x for k, x in blocks if k == "table"], 1)])
    if kind == "odt":
        return odt(title, [" ".join(x) for _, x in blocks])
    slides: list[tuple[str, list[str]]] = []
    for k, lines in blocks:
        if k.startswith("heading"):
            slides.append((" ".join(lines).lstrip("# "), []))
        elif k != "table" and slides:
            slides[-1][1].extend(lines)
    return pptx(slides)


#: What each export format is called and made of, in the order in which formats are written; the archive holds the others.
FORMATS = ("docx", "html", "json", "md", "odt", "pptx", "xlsx")


def exported(packages: DataFrame, wanted: list[str]) -> DataFrame:
    """Exports of document packages (document_id, title, engine, blocks of kind and lines): a row per document and format with the
    file's name, content and hash; with "zip" an archive of the others last.  Unknown formats are passed over; none is json.

    A document's files are made in one task, documents are dealt by their ids."""
    formats = [f for f in FORMATS if f in wanted] or ["json"]
    kind = "document_id string, format string, name string, content binary, place int"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p in batch.to_pylist():
                blocks = [(b["kind"], b["lines"]) for b in p["blocks"]]
                made = [(f, f"{p['document_id']}.{f}", _export(f, p, blocks)) for f in formats]
                if "zip" in wanted:
                    made.append(("zip", f"{p['document_id']}.zip", archive([(n, c) for _, n, c in made])))
                rows += [{"document_id": p["document_id"], "format": f, "name": n, "content": c, "place": i} for i, (f, n, c) in enumerate(made)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("document_id", pa.string()), ("format", pa.string()), ("name", pa.string()), ("content", pa.binary()), ("place", pa.int32())]))

    return packages.select("document_id", "title", "engine", "blocks").mapInArrow(work, kind).withColumn("sha256", F.sha2("content", 256))


def _export(kind: str, package: dict, blocks: list[tuple[str, list[str]]]) -> bytes:
    if kind in ("docx", "xlsx", "odt", "pptx"):
        return _file(kind, package["title"], blocks)
    if kind == "json":
        return (json.dumps({"document_id": package["document_id"], "title": package["title"], "blocks": [{"kind": k, "lines": x} for k, x in blocks]}, ensure_ascii=False, indent=2) + "\n").encode()
    lines = {"table": lambda x: "\n".join(x), "bullet_item": lambda x: "- " + " ".join(x)}
    body = "\n\n".join(lines.get(k, " ".join)(x) for k, x in blocks)
    if kind == "md":
        return f"# {package['title']}\n\n> {package['engine']}\n\n{body}\n".encode()
    paragraphs = "".join(f"<p>{escape(' '.join(x))}</p>" for _, x in blocks)
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(package["title"])}</title></head><body>{paragraphs}</body></html>'.encode()


def export_history(exports: DataFrame) -> DataFrame:
    """What was written for each document, in order: an array of format, name and hash."""
    entry = F.struct("place", "format", "name", "sha256")
    return exports.groupBy("document_id").agg(F.array_sort(F.collect_list(entry)).alias("h")).select("document_id", F.transform("h", lambda x: F.struct(x["format"].alias("format"), x["name"].alias("name"), x["sha256"].alias("sha256"))).alias("history"))


def audited_xlsx(tables: list[list[list[str]]], audit: list[list[str]]) -> bytes:
    """A workbook of a document's tables, one sheet each, and the audit sheet last."""
    head = ["page", "engine", "first_status", "first_numbers", "second_status", "second_numbers", "replaced", "review", "confidence"]
    return xlsx([*((f"Page_{i}", rows) for i, rows in enumerate(tables, 1)), ("OCR Audit", [head, *audit])])
