"""Adding columns by Arrow batches, and the shared folder of a session."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import types as T

#: Makes, once per task, a function from a batch's input columns to its new columns.
Maker = Callable[[], Callable[[pa.RecordBatch], list]]


def release() -> None:
    """Gives memory that is no longer used back to the system: workers are kept from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the C library of Linux has it
        ctypes.CDLL(None).malloc_trim(0)


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts, as what is made of a text takes several times its room; what a part took is given back before the next."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
            release()


def add_columns(df: DataFrame, needs: list[str], out: T.StructType, make: Maker) -> DataFrame:
    """df with the columns of `out`, one row per row; a column of the same name is replaced.

    Rows stay where they are: no shuffle, and lost tasks are simply run again.
    """
    new = {f.name for f in out}
    kept = [f for f in df.schema if f.name not in new]
    schema = T.StructType(kept + list(out))
    names = [f.name for f in kept]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, wanted = None, None
        for batch in batches:
            if run is None:
                run, wanted = make(), to_arrow(out)
            made = run(batch.select(needs)) if batch.num_rows else [[] for _ in out]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            made = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, wanted, strict=True)]
            yield pa.RecordBatch.from_arrays(columns + made, names=names + [f.name for f in wanted])
            del batch, made, columns
        run = None
        release()

    return df.mapInArrow(work, schema)


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Only where that setting is absent (a single machine, as in tests) a local one is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif context.master.startswith("local"):
            root = "/tmp/checkpoints/docframe"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/docframe-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df written as Parquet in a shared folder and read again: cuts the lineage, and survives lost executors."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def counted(df: DataFrame, folder: str, name: str, **figures) -> tuple[DataFrame, dict]:
    """As written(), with aggregates that are taken while the rows are written, so that no further job is needed."""
    seen = Observation()
    df.observe(seen, *[c.alias(k) for k, c in figures.items()]).write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}"), seen.get


def drop_dir(spark: SparkSession, folder: str) -> None:
    """Removes a folder made by shared_dir."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
