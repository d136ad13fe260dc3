"""WARC archives of pages, compressed record by record with a Zstandard dictionary of their own.

Each archive starts with a skippable frame that holds the dictionary, trained
on records spread over the archive; every record is a Zstandard frame.  Pages
with equal payloads of at least a given size are stored once: the one with the
smallest id as response, the others as revisit records that refer to it.

Tasks write archives into the shared folder under names that are used once and
report them; the reader takes reported names only, so a repeated or lost task
leaves at most a file that nobody reads.

Cases: a null html is an empty payload; a null url is left out; rows with a
null id are responses of their own, with a null id when read back; of repeated
rows with the smallest id each is a response; an empty table gives no archive
and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.arrowmap import counted, written
from docframe.llm.store import Store

#: Uncompressed bytes of an archive, of its dictionary's samples at most, and of the dictionary.
ARCHIVE_BYTES = 32 << 20
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
#: Bytes of ids and keys of revisits that are sent to all executors, so that payloads stay where they were read; if there are
#: more, the rows are merged, payloads included.
SIDE_BYTES = 32 << 20
#: Archives are read by so many tasks a core, or by one for so many of their bytes if that is more.
READERS, READ_BYTES = 16, 1 << 30
MAGIC = 0x184D2A5D
DATE = "2000-01-01T00:00:00Z"


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}') if page_id is not None else uuid.uuid4()}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """A response, or with refers_to a revisit, as WARC 1.1. The ids stand in extension fields."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", "sha1:" + digest(payload)))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to)), ("WARC-Truncated", "length")]
    block = http + (payload if refers_to is None else b"")
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], level: int = 3) -> bytes:
    """Records as one archive, which begins with a dictionary trained on them.

    Few records are too few samples for the trainer: then short pieces of theirs are the samples."""
    data = b"".join(records)
    every = max(1, len(data) // SAMPLE_BYTES)
    size = max(256, min(DICTIONARY_BYTES, len(data) // 32))
    samples, segment = [r[: 64 << 10] for r in records[::every]], 1024
    for piece in (32, 16, None):
        try:
            trained = zstandard.train_dictionary(size, samples, k=segment, d=8)
            break
        except zstandard.ZstdError:
            if piece is None:
                raise
            samples, segment = [data[i : i + piece] for i in range(0, min(len(data), SAMPLE_BYTES), piece)], 16
    held = trained.as_bytes()
    trained.precompute_compress(level=level)
    pack = zstandard.ZstdCompressor(level=level, dict_data=trained)
    return b"".join([struct.pack("<II", MAGIC, len(held)) + held, *(pack.compress(r) for r in records)])


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-cased names) and block of each record of an archive."""
    trained, at = None, 0
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == MAGIC:
        n = struct.unpack_from("<I", data, 4)[0]
        held = data[8 : 8 + n]
        if held[:4] == b"\x28\xb5\x2f\xfd":  # dictionaries may be compressed themselves
            held = zstandard.ZstdDecompressor().decompress(held)
        trained, at = zstandard.ZstdCompressionDict(held), 8 + n
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=trained).stream_reader(memoryview(data)[at:], read_across_frames=True), 1 << 20)
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is cut off")
        yield fields, block


def _side(table: DataFrame, size: int | None) -> DataFrame:
    """The lesser side of a join, of so many bytes: sent to all executors up to SIDE_BYTES, merged beyond."""
    return F.broadcast(table) if (size or 0) <= SIDE_BYTES else table.hint("merge")


def write(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all pages into archives in the shared folder; a row per archive: name, layout, records, bytes."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    # The key says that payloads are equal. Only ids and keys are moved; hot keys are summed up before they are.
    key = F.unhex(F.sha2(F.encode("html", "utf-8"), 256)).alias("key")
    keys = written(rows.where((F.octet_length("html") >= least) & F.col("id").isNotNull()).select("id", key), folder, "keys")
    size = lambda *ids: F.sum(32 + sum(F.octet_length(F.col(c).cast("string")) for c in ids))
    firsts = keys.groupBy("key").agg(F.min("id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1").select("key", "refers_to")
    firsts, told = counted(firsts, folder, "firsts", bytes=size("refers_to"))
    again = keys.distinct().join(_side(firsts, told["bytes"]), "key").where(F.col("id") != F.col("refers_to"))
    again, told = counted(again, folder, "again", bytes=size("id", "refers_to"))
    known = rows.select("*", key).join(_side(again, told["bytes"]), ["id", "key"], "left").select("id", "url", "html", "refers_to")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def put() -> pa.RecordBatch:
            data = archive(held)
            name, layout = Store(f"{folder}/warc").write("pages.warc.zst", {"data": np.frombuffer(data, np.uint8)})
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([layout]), pa.array([len(held)], pa.int64()), pa.array([len(data)], pa.int64())], names=["name", "layout", "records", "bytes"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(row[0], row[1], row[2].encode(), row[3]))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield put()
                    held, size = [], 0
        if held:
            yield put()

    return written(known.mapInArrow(work, "name string, layout string, records long, bytes long"), folder, "archives")


def read(archives: DataFrame, folder: str, id_kind: str = "long") -> DataFrame:
    """A row per record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html (null
    in revisits). The payloads of responses are checked against their digests.  id_kind: the type of the ids."""
    n, size = archives.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(n, max(READERS * archives.sparkSession.sparkContext.defaultParallelism, size // READ_BYTES)))
    kind = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, html binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("html", pa.binary())])
        store = Store(f"{folder}/warc")
        for batch in batches:
            for name, layout in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for fields, block in records_of(store.read(name, layout)["data"].tobytes()):
                    head, _, body = block.partition(b"\r\n\r\n")
                    told = fields["warc-payload-digest"].removeprefix("sha1:")
                    response = fields["warc-type"] == "response"
                    if response and digest(body) != told:
                        raise ValueError(f"{name}: a payload differs from its digest")
                    size = int(re.search(rb"(?i)content-length: (\d+)", head)[1])
                    ids = [fields.get("x-page-id"), fields.get("x-refers-to-page-id")]
                    rows.append((ids[0], fields.get("warc-target-uri"), size, told, fields["warc-type"], ids[1], body if response else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    found = archives.select("name", "layout").repartition(tasks).mapInArrow(work, kind)
    return found.withColumns({c: F.col(c).cast(id_kind) for c in ("page_id", "refers_to")})
