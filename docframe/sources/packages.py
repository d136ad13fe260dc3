"""Document packages as a Spark data source: spark.read and df.write with format("docpackage").

A package is a row: document_id, version, pages with regions, the engines'
candidates and side files (page images, exports).  Tasks write bundles, ZIP
files of about BUNDLE bytes, below `bundles/`; they count once a commit file in
`_commits/` names them, which the driver writes last and in one move.  So a task
that fails, or runs twice, leaves nothing that is read.  What it left is removed
with the commit or the abort; a task that Spark kills after the abort may leave a
file that nothing reads, which vacuum() removes.  A bundle is one partition of a
scan.

    packages.register(spark)
    df.write.format("docpackage").mode("append").save(folder)
    spark.read.format("docpackage").load(folder)

The folder is a URI or an absolute path that driver and executors share.  Option
`ids` (comma-separated) reads these documents only: bundles whose ids lie
elsewhere aren't opened.  Null columns are written as null; a null or empty list
of files is a package without files.  File names may be any text, also twice.
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "docpackage"
KIND = (
    "document_id string, version string, pages array<struct<page:int,text:string,regions:array<struct<region:int,kind:string,text:string,box:array<int>>>>>, "
    "candidates array<struct<page:int,engine:string,text:string,confidence:double>>, files array<struct<name:string,content:binary>>"
)
COLUMNS = ("document_id", "version", "pages", "candidates", "files")
#: Bytes of text and files after which a task starts another bundle.
BUNDLE = 64 << 20


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Packages)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path).rstrip("/"))


def vacuum(path: str, hours: float = 24.0) -> list[str]:
    """Removes bundles that no commit names and that are older than any write that may still run; their paths."""
    files, root = opened(path)
    named = {f"{root}/{b['name']}" for c in commits(files, root) for b in c["bundles"]}
    before = datetime.now(UTC) - timedelta(hours=hours)
    found = files.get_file_info(fs.FileSelector(f"{root}/bundles", recursive=True, allow_not_found=True))
    gone = [f.path for f in found if f.type == fs.FileType.File and f.path not in named and f.mtime <= before]
    for name in gone:
        files.delete_file(name)
    return gone


class Packages(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return KIND

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options["path"], self.options.get("ids"))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if missing := [c for c in COLUMNS if c not in schema.names]:
            raise ValueError(f"a package needs the columns {missing}")
        return Writer(self.options["path"], overwrite)


def commits(files: fs.FileSystem, root: str) -> list[dict]:
    """The commits that count, in order: from the last one that replaced everything."""
    found = files.get_file_info(fs.FileSelector(f"{root}/_commits", allow_not_found=True))
    names = sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(".json") and not f.base_name.startswith("."))
    read = []
    for name in names:
        with files.open_input_stream(name) as f:
            read.append(json.loads(f.read()) | {"file": name})
    start = max((i for i, c in enumerate(read) if c["replaces"]), default=0)
    return read[start:]


@dataclass
class Bundle(InputPartition):
    name: str


class Reader(DataSourceReader):
    def __init__(self, path: str, ids: str | None):
        self.path, self.ids = path, None if ids is None else {i.strip() for i in ids.split(",")}

    def partitions(self) -> list[InputPartition]:
        found = [b for c in commits(*opened(self.path)) for b in c["bundles"]]
        if self.ids is not None:
            found = [b for b in found if b["first"] is not None and any(b["first"] <= i <= b["last"] for i in self.ids)]
        return [Bundle(b["name"]) for b in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not isinstance(partition, Bundle):  # a folder without bundles has one partition of nothing
            return
        files, root = opened(self.path)
        with files.open_input_file(f"{root}/{partition.name}") as source, zipfile.ZipFile(source) as bundle:
            for n in range(int(bundle.comment)):
                row = json.loads(bundle.read(f"{n}/document.json"))
                if self.ids is not None and row["document_id"] not in self.ids:
                    continue
                held = row["files"] and [(name, None if absent else bundle.read(f"{n}/files/{i}")) for i, (name, absent) in enumerate(row["files"])]
                pages = row["pages"] and [p and (p["page"], p["text"], p["regions"] and [r and (r["region"], r["kind"], r["text"], r["box"]) for r in p["regions"]]) for p in row["pages"]]
                candidates = row["candidates"] and [c and (c["page"], c["engine"], c["text"], c["confidence"]) for c in row["candidates"]]
                yield row["document_id"], row["version"], pages, candidates, held


@dataclass
class Written(WriterCommitMessage):
    bundles: list[dict] = field(default_factory=list)


class Writer(DataSourceArrowWriter):
    """Two phases: tasks write bundles, the driver names them in a commit."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = opened(self.path)
        done, task = Written(), uuid.uuid4().hex
        rows = (row for batch in iterator for row in batch.select(list(COLUMNS)).to_pylist())
        row = next(rows, None)
        while row is not None:
            name = f"bundles/{self.job}/{task}-{len(done.bundles)}.zip"
            files.create_dir(f"{root}/bundles/{self.job}", recursive=True)
            size, n, ids = 0, 0, []
            with files.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as bundle:
                while row is not None and size < BUNDLE:
                    size += self._add(bundle, n, row)
                    ids.append(row["document_id"])
                    n, row = n + 1, next(rows, None)
                bundle.comment = str(n).encode()
            known = [i for i in ids if i is not None]
            done.bundles.append({"name": name, "rows": n, "bytes": size, "first": min(known, default=None), "last": max(known, default=None)})
        return done

    @staticmethod
    def _add(bundle: zipfile.ZipFile, n: int, row: dict) -> int:
        held = row["files"]
        text = json.dumps(row | {"files": held and [(f["name"], f["content"] is None) for f in held]}, ensure_ascii=False).encode()
        bundle.writestr(f"{n}/document.json", text)
        for i, f in enumerate(held or ()):
            if f["content"] is not None:
                bundle.writestr(f"{n}/files/{i}", f["content"])
        return len(text) + sum(len(f["content"] or b"") for f in held or ())

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = opened(self.path)
        before = commits(files, root)
        bundles = [b for m in messages if m is not None for b in m.bundles]
        self._drop(files, f"{root}/bundles/{self.job}", {f"{root}/{b['name']}" for b in bundles})
        number = 1 + max((int(re.search(r"(\d+)-\w+\.json$", c["file"])[1]) for c in before), default=0)
        name = f"{number:08d}-{self.job}.json"
        files.create_dir(f"{root}/_commits", recursive=True)
        with files.open_output_stream(f"{root}/_commits/.{name}") as out:
            out.write(json.dumps({"replaces": self.overwrite, "bundles": bundles}).encode())
        files.move(f"{root}/_commits/.{name}", f"{root}/_commits/{name}")
        if self.overwrite:
            for c in before:
                files.delete_file(c["file"])
                for b in c["bundles"]:
                    files.delete_file(f"{root}/{b['name']}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = opened(self.path)
        self._drop(files, f"{root}/bundles/{self.job}", set())

    @staticmethod
    def _drop(files: fs.FileSystem, folder: str, but: set[str]) -> None:
        """Removes a job's files that no finished task has reported."""
        for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.path not in but:
                files.delete_file(f.path)
        if not but and files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)
