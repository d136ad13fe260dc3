"""Scans of image files by page: an index of frames first, then the frames that are wanted, spread over tasks.

A file is no unit of work: index() reads a file's directory of frames by ranged
reads (some hundred bytes a frame), so that pages are chosen before anything is
decoded, and frames() deals ranges of `together` frames of a file to tasks, which
read these frames' bytes only.  A file of a thousand pages is read by many tasks.

TIFF with uncompressed strips (8 bits a sample, grey or RGB) has as many frames as
directories; a PNG is one frame.  Other files raise an error, naming the file.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.operators.geometry import PNG_MARK, png_decode, png_encode, tiff_directory, tiff_order, tiff_pixels
from docframe.sources.packages import opened

#: Frames of one file that a task reads one after another.
TOGETHER = 32


def listed(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("png", "tif", "tiff")) -> DataFrame:
    """Paths and sizes of image files; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).isin(*suffixes)).select("path", F.col("length").alias("size"))


def _ranged(path: str):
    """An open file and a function that reads a range of it."""
    files, name = opened(path)
    file = files.open_input_file(name)

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    return file, read


def _named(path: str, call: Callable):
    try:
        return call()
    except (ValueError, KeyError, struct.error) as error:
        raise ValueError(f"{path}: {error}") from error


def index(files: DataFrame) -> DataFrame:
    """A row per frame of the files (path): path, frame (from 0), frames of the file, and place (that of its directory)."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path in part["path"]:
                file, read = _ranged(path)
                with file:
                    places = [0] if read(0, 8) == PNG_MARK else _named(path, lambda read=read: list(_places(read)))
                yield pd.DataFrame({"path": path, "frame": range(len(places)), "frames": len(places), "place": places})

    return files.select("path").mapInPandas(work, "path string, frame int, frames int, place long")


def _places(read: Callable[[int, int], bytes]) -> Iterator[int]:
    order, at = tiff_order(read)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise ValueError("directories in a circle")
        seen.add(at)
        yield at
        n = struct.unpack(order + "H", read(at, 2))[0]
        at = struct.unpack(order + "I", read(at + 2 + 12 * n, 4))[0]


def frames(chosen: DataFrame, together: int = TOGETHER, tasks: int | None = None) -> DataFrame:
    """Rows of an index() with the frame as a PNG page: path, frame, content.

    tasks: among how many the ranges are dealt, by default the session's shuffle partitions; a fixed number, as Spark would
    put the index's small rows together in one task, though there is much to read behind each."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, rows in part.groupby("path", sort=False):
                file, read = _ranged(path)
                with file:
                    for frame, place in zip(rows["frame"], rows["place"], strict=True):
                        yield pd.DataFrame({"path": [path], "frame": [frame], "content": [_named(path, lambda read=read, place=place: _page(read, file.size(), place))]})

    tasks = tasks or int(chosen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chosen.select("path", "frame", "place").repartition(tasks, F.col("path"), F.floor(F.col("frame") / together))
    return dealt.mapInPandas(work, "path string, frame int, content binary")


def _page(read: Callable[[int, int], bytes], size: int, place: int) -> bytes:
    if not place:
        return png_encode(png_decode(read(0, size)))
    order, _ = tiff_order(read)
    return png_encode(tiff_pixels(read, tiff_directory(read, order, place)[0]))
