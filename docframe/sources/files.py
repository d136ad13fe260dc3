"""File scans: lists of files with their hashes, text files, office files to Markdown, JSON lines, document packages."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from functools import lru_cache
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.functions.udf import read_text
from docframe.sources.pdf import markdown_of as pdf_markdown

SCANS = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "webp", "bmp")
OFFICE = ("docx", "pptx", "xlsx", "pdf", "html", "htm", "txt", "csv", "md")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def scan(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SCANS, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Files under a folder by suffix: path, rel, size, sha256, document_id and content; not those of excluded top folders.

    The suffix is tested on the path, before any content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = re.escape(re.sub(r"^[a-z0-9]+:/*", "/", folder).rstrip("/"))
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), f"^{root}/", "")
    chosen = files.where(suffix(F.col("path")).isin(*suffixes)).withColumn("rel", rel)
    if excluded:
        chosen = chosen.where(~F.lower(F.split_part("rel", F.lit("/"), F.lit(1))).isin(*[e.lower() for e in excluded]))
    sha = F.sha2("content", 256)
    return chosen.select("path", "rel", F.col("length").alias("size"), sha.alias("sha256"), F.left(sha, F.lit(24)).alias("document_id"), "content")


def first_of(files: DataFrame) -> DataFrame:
    """The first file by its lower-cased relative path."""
    return files.orderBy(F.lower("rel")).limit(1)


def output_path(rel: Column, new: str) -> Column:
    from docframe.operators.control import relative_path

    return F.concat(F.regexp_replace(relative_path(rel), r"\.[^./]+$", ""), F.lit(f".{new}"))


def texts(files: DataFrame) -> DataFrame:
    """files with text: UTF-8, else code page 1251, else Latin-1."""
    return files.withColumn("text", read_text("content"))


def _table(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    n = max(map(len, rows))
    cell = lambda v: str(v).replace("\r", " ").replace("\n", " ").strip().replace("|", "\\|")
    lines = ["| " + " | ".join(cell(v) for v in [*r, *[""] * (n - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * n) + " |", *lines[1:]])


@lru_cache(maxsize=1024)
def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


_BREAKS = {"t": "", "tab": "\t", "br": "\n"}


def _runs(node) -> str:
    return "".join([_BREAKS[name] or x.text or "" for x in node.iter() if (name := _name(x.tag)) in _BREAKS])


_ENTRY = struct.Struct("<4s6H3L5H2L")


class _Parts:
    """The parts of an office archive: plain ones are found by its directory, all others (comments, 64 bits, encryption, other
    methods, damage) by zipfile, which also says what is wrong."""

    def __init__(self, data: bytes):
        self.data = data
        self.places = self._directory()
        if self.places is None:
            self._zip().close()

    def _zip(self) -> zipfile.ZipFile:
        return zipfile.ZipFile(io.BytesIO(self.data))

    def _directory(self) -> dict[str, tuple] | None:
        data, end, places = self.data, len(self.data) - 22, {}
        if end < 0 or data[end : end + 4] != b"PK\5\6":
            return None
        disk, of, here, total, size, at, note = struct.unpack_from("<4H2LH", data, end + 4)
        if disk or of or here != total or note or at + size != end:
            return None
        while at + 46 <= end:
            sign, _, _, flags, method, _, _, crc, packed, full, n, extra, note, _, _, _, start = _ENTRY.unpack_from(data, at)
            path = data[at + 46 : at + 46 + n]
            if sign != b"PK\1\2" or flags & ~0x80E or method not in (0, 8) or extra or note or b"\0" in path or not path.isascii():
                return None
            places[path.decode()] = (start, path, method, crc, packed, full)
            at += 46 + n
            total -= 1
        return None if total or at != end else places

    def names(self) -> list[str]:
        if self.places is not None:
            return list(self.places)
        with self._zip() as z:
            return z.namelist()

    def read(self, name: str) -> bytes:
        if self.places is not None and name in self.places:
            start, path, method, crc, packed, full = self.places[name]
            sign, n, extra = self.data[start : start + 4], *struct.unpack("<2H", self.data[start + 26 : start + 30].ljust(4, b"\0"))
            at = start + 30 + n + extra
            out = self.data[at : at + packed]
            if sign == b"PK\3\4" and self.data[start + 30 : start + 30 + n] == path and len(out) == packed:
                try:
                    out = zlib.decompress(out, -15, max(full, 1)) if method else out
                except zlib.error:
                    out = b""
                if len(out) == full and zlib.crc32(out) == crc:
                    return out
        with self._zip() as z:
            return z.read(name)


def docx_markdown(data: bytes) -> str:
    """Paragraphs and tables in body order; headings by style, list paragraphs as items, rows filled up to the first."""
    body = ET.fromstring(_Parts(data).read("word/document.xml"))[0]
    out = []
    for node in body:
        if _name(node.tag) == "p":
            text = _runs(node).strip()
            if text:
                marks = [x for x in node.iter() if _name(x.tag) in ("pStyle", "numPr")]
                style = next((v for x in marks if _name(x.tag) == "pStyle" for v in x.attrib.values()), "")
                level = re.match(r"(?i)heading\s*([1-6])", style)
                out.append("#" * int(level[1]) + " " + text if level else "- " + text if "list" in style.lower() or any(_name(x.tag) == "numPr" for x in marks) else text)
        elif _name(node.tag) == "tbl":
            rows = [[" ".join(_runs(c).split()) for c in r if _name(c.tag) == "tc"] for r in node if _name(r.tag) == "tr"]
            out.append(_table([(r + [""] * len(rows[0]))[: len(rows[0])] for r in rows] if rows else []))
    return "\n\n".join(x for x in out if x)


def pptx_markdown(data: bytes) -> str:
    """A heading for each slide; a shape of one line as it is, of several as items."""
    parts = _Parts(data)
    names = sorted((n for n in parts.names() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out = []
    for i, n in enumerate(names, 1):
        out.append(f"## Slide {i}")
        for shape in (x for x in ET.fromstring(parts.read(n)).iter() if _name(x.tag) == "txBody"):
            lines = [t for p in shape if _name(p.tag) == "p" and (t := _runs(p).strip())]
            out.append("\n".join(lines) if len(lines) == 1 else "\n".join(f"- {x}" for x in lines))
    return "\n\n".join(x for x in out if x)


def _sheets(book: bytes, rels: bytes) -> list[tuple[str, str]]:
    """Name and part of each sheet."""
    links = {x.attrib["Id"]: x.attrib["Target"] for x in ET.fromstring(rels)}
    sheets = [x for x in ET.fromstring(book).iter() if _name(x.tag) == "sheet"]
    return [(x.attrib["name"], "xl/" + links[next(v for k, v in x.attrib.items() if _name(k) == "id")].lstrip("/").removeprefix("xl/")) for x in sheets]


#: Small lists of sheets are alike in many files.
_sheets_small = lru_cache(maxsize=256)(_sheets)


@lru_cache(maxsize=1024)
def _column_number(letters: str) -> int:
    at = 0
    for ch in letters:
        at = at * 26 + ord(ch) - 64
    return at


def xlsx_markdown(data: bytes) -> str:
    """A heading and a table for each sheet, without its empty rows."""
    parts = _Parts(data)
    shared = [_runs(x) for x in ET.fromstring(parts.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in parts.names() else []
    book, rels = parts.read("xl/workbook.xml"), parts.read("xl/_rels/workbook.xml.rels")
    out = []
    for name, target in (_sheets_small if len(book) + len(rels) <= 4096 else _sheets)(book, rels):
        rows = []
        for r in (x for x in ET.fromstring(parts.read(target)).iter() if _name(x.tag) == "row"):
            row: list[str] = []
            for c in r:
                letters = re.match(r"[A-Z]+", c.attrib.get("r", ""))
                at = _column_number(letters[0]) if letters else 0
                value = next((x.text or "" for x in c.iter() if _name(x.tag) == "v"), None)
                text = shared[int(value)] if c.attrib.get("t") == "s" and value else _runs(c) if value is None else value
                row += [""] * ((at or len(row) + 1) - 1 - len(row)) + [text]
            if any(v.strip() for v in row):
                rows.append(row)
        out += [f"## {name}", _table(rows) or "_Empty sheet_"]
    return "\n\n".join(out)


def _converted(kind: str, data: bytes) -> tuple[bool, str]:
    try:
        return True, {"docx": docx_markdown, "pptx": pptx_markdown, "xlsx": xlsx_markdown, "pdf": pdf_markdown}[kind](data)
    except KeyError:
        return False, f"unsupported: {kind}"
    except (zipfile.BadZipFile, ET.ParseError, StopIteration, IndexError, ValueError) as e:
        return False, f"{type(e).__name__}: {e}"


def convert(files: DataFrame) -> DataFrame:
    """files with ok and markdown (or what is wrong): office archives by an Arrow pass, text formats by expressions."""
    from docframe.functions.text import html_to_text
    from docframe.operators.markdown import csv_table

    kind = suffix(F.col("path"))

    @F.pandas_udf("ok boolean, markdown string")
    def office(kinds: pd.Series, data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_converted(k, bytes(d)) for k, d in zip(kinds, data, strict=True)], columns=["ok", "markdown"])

    zipped = files.where(kind.isin("docx", "pptx", "xlsx", "pdf")).withColumn("_r", office(kind, "content"))
    plain = texts(files.where(kind.isin("html", "htm", "csv", "txt", "md")))
    text = F.when(kind == "csv", csv_table(F.col("text"))).when(kind.isin("html", "htm"), html_to_text("text")).otherwise(F.col("text"))
    other = files.where(~kind.isin(*OFFICE))
    name = files.columns
    return (
        zipped.select(*name, "_r.ok", "_r.markdown").unionByName(plain.withColumn("ok", F.lit(True)).withColumn("markdown", text).select(*name, "ok", "markdown"))
        .unionByName(other.select(*name, F.lit(False).alias("ok"), F.concat(F.lit("unsupported: "), kind).alias("markdown")))
    )


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object a line, with the schema given; blank lines are no rows."""
    return spark.read.schema(schema).json(path)


def line_ends(files: DataFrame) -> DataFrame:
    """Script files with their numbers of CRLF, LF and CR line ends, and whether they are UTF-8, with or without a mark."""
    h = F.hex("content")
    pairs = F.regexp_replace(h, "(..)", "$1 ")
    count = lambda p: F.regexp_count(pairs, F.lit(p))
    crlf = count("0D 0A ")
    return files.select("path", crlf.alias("crlf"), (count("0A ") - crlf).alias("lf"), (count("0D ") - crlf).alias("cr"), h.startswith("EFBBBF").alias("mark"), F.is_valid_utf8(F.col("content").cast("string")).alias("utf8"))


def package(sources: DataFrame, pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Document packages: a row per source with its pages and their regions as nested arrays, and as JSON.

    Pages and regions are grouped by document, whose size is bounded; document_id deals them out evenly."""
    per_page = regions.groupBy("document_id", "page").agg(F.array_sort(F.collect_list(F.struct("region", "kind", "text", "box"))).alias("regions"))
    joined = pages.join(per_page, ["document_id", "page"], "left").withColumn("regions", F.coalesce("regions", F.array().cast("array<struct<region:int,kind:string,text:string,box:array<int>>>")))
    nested = joined.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", "text", "regions"))).alias("pages"))
    out = sources.join(nested, "document_id", "left").withColumn("pages", F.coalesce("pages", F.array().cast(nested.schema["pages"].dataType)))
    return out.withColumn("json", F.to_json(F.struct(F.lit("1.1").alias("version"), "document_id", "pages")))
