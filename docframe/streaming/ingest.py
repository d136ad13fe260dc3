"""Streams: new files as they arrive, and process output whose encoding changes from chunk to chunk.

An extension: the operators are the batch ones, run on each micro-batch; the
decoder keeps half characters of a stream between its chunks as state.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from docframe.functions.udf import decoded, high_bytes, looks_utf16


def watch(spark: SparkSession, folder: str, glob: str = "*", per_batch: int = 100) -> DataFrame:
    """New files of a folder, with their content."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).load(folder)


def run_each(stream: DataFrame, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Applies a batch operator to every micro-batch; a batch that is run again replaces its own folder, so each counts once."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ChunkDecoder:
    """Text of chunks that end at line-feed bytes; UTF-16 is cut in mid-character by that, so its rest is kept."""

    def __init__(self, rest: bytes = b"", wide: str = ""):
        self.rest, self.wide = rest, wide

    def feed(self, chunk: bytes) -> str:
        data = self.rest + chunk
        if self.wide and (self.rest or looks_utf16(data)) or looks_utf16(data):
            big = data[:2] == b"\xfe\xff" or (data[:2] != b"\xff\xfe" and high_bytes(data[0::2]) > high_bytes(data[1::2]))
            self.wide = self.wide or ("utf-16-be" if big else "utf-16-le")
            whole = len(data) // 2 * 2
            self.rest = data[whole:]
            return codecs.decode(data[:whole], self.wide, "replace").lstrip("﻿")
        self.rest, self.wide = b"", ""
        return decoded(data)


def decode_stream(chunks: DataFrame) -> DataFrame:
    """Lines of text of streams (stream, chunk, data), with each stream's rest as state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        decoder = ChunkDecoder(*state.get) if state.exists else ChunkDecoder()
        out = []
        for frame in frames:
            for number, data in frame.sort_values("chunk")[["chunk", "data"]].itertuples(index=False):
                out.append((key[0], int(number), decoder.feed(bytes(data))))
        state.update((decoder.rest, decoder.wide))
        yield pd.DataFrame(out, columns=["stream", "chunk", "text"])

    return chunks.groupBy("stream").applyInPandasWithState(step, "stream string, chunk long, text string", "rest binary, wide string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by time window; later ones than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
