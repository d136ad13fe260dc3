"""Whitening of embeddings by the principal components of their covariance.

An entry c becomes the whole number floor(256 * c); all statistics are taken
over the fit list, each distinct vector of whole numbers once.

1. The distinct vectors are written to the shared folder, packed in the fewest
   bytes an entry (a vector that many rows repeat is one row a task before the
   shuffle).
2. First pass: exact sums of each dimension as whole numbers, which give the mean.
3. Second pass: vectors are centred (the whole part of the mean as whole
   numbers, then its fraction), and sums of their outer products are taken by
   matrix products, a partial matrix a task, merged by treeAggregate.
4. The driver solves the symmetric eigenproblem of the one matrix by LAPACK; the
   components are broadcast.  Both are bounded by the dimension alone.
5. A third pass measures the covariance of the whitened vectors.
6. Rows are projected where they are, without a shuffle.

Cases: rows whose vector is null or holds null, NaN or infinite entries, or
entries whose whole number isn't a long, are dropped; so are those of another
length than most distinct vectors have (of lengths that are as frequent, the
greater counts).  Repeated rows and null ids are projected like all others.  A
component whose variance is zero to double precision (a single vector, constant
dimensions) has a null `whitened`; without any variance `explained` and
`identity_error` are null too.  `deviation` is null beyond 38 digits.  Vectors
of no dimension and empty tables give no rows.  Other columns are ignored, so
their names can't clash.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.llm.arrowmap import shared_dir, to_arrow, written
from docframe.llm.textbytes import ragged

SCALE = 256
#: Vectors that are multiplied at once.
BLOCK = 4096
#: Levels of the trees that merge partial sums.
DEPTH = 4
_SMALL = 1 << 62
_LIMB = 21  # bits; sums of products of two stay whole numbers of 63 bits for up to 2 million dimensions


def whole(column: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Lengths of a list column's rows (-1: dropped), and by length the row numbers and whole numbers of the valid rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    offsets = np.asarray(column.offsets).astype(np.int64)
    lengths = np.where(np.asarray(column.is_valid()), np.diff(offsets), -1)
    entries = column.values
    flat = np.asarray(entries.cast(pa.float64()).fill_null(np.nan))
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(flat * SCALE)
        bad = ~(np.abs(flat) < 2.0**63)  # null, NaN, infinite or beyond a long
    if bad.any():
        owner = np.searchsorted(offsets, np.flatnonzero(bad), side="right") - 1
        owner = owner[(owner >= 0) & (owner < n)]
        lengths[owner] = -1
    out = []
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        values = flat[ragged(offsets[rows], np.full(len(rows), d))]
        out.append((rows, values.astype(np.int64).reshape(len(rows), d)))
    return lengths, out


def pack(x: np.ndarray) -> list[bytes]:
    """Each row as a byte with the width of an entry (1, 2, 4 or 8) and the entries, in the least width that holds them all."""
    low, high = x.min(1), x.max(1)
    width = np.full(len(x), 8)
    for w in (4, 2, 1):
        info = np.iinfo(f"<i{w}")
        width[(low >= info.min) & (high <= info.max)] = w
    out: list[bytes] = [b""] * len(x)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        data = x[rows].astype(f"<i{w}").view(np.uint8).reshape(len(rows), -1)
        for i, row in zip(rows.tolist(), np.insert(data, 0, w, axis=1), strict=True):
            out[i] = row.tobytes()
    return out


def unpack(packed: pa.Array, d: int) -> np.ndarray:
    """The rows that pack() has made of vectors of d entries."""
    packed = packed.cast(pa.large_binary())
    offsets = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
    data = np.frombuffer(packed.buffers()[2], np.uint8)
    width = data[offsets[:-1]]
    out = np.empty((len(packed), d), np.int64)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        out[rows] = data[ragged(offsets[rows] + 1, np.full(len(rows), w * d))].view(f"<i{w}").reshape(len(rows), d)
    return out


def centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """x - sums / n as doubles: the whole part of the mean is taken off exactly."""
    low, rest = [s // n for s in sums], np.array([s % n / n for s in sums])
    if len(x) and max(int(x.max()), -int(x.min())) >= _SMALL // 2:
        return (x.astype(object) - np.array(low, object)).astype(np.float64) - rest
    return (x - np.array(low, np.int64)) - rest


def deviations(x: np.ndarray, sums: list[int], n: int) -> list[int]:
    """The exact sum over dimensions of (n * x - sums) ** 2 of each row."""
    largest = n * max(int(x.max()), -int(x.min())) + max(map(abs, sums)) if x.size else 0
    if largest >= _SMALL:
        t = x.astype(object) * n - np.array(sums, object)
        return (t * t).sum(1).tolist()
    t = np.abs(x * n - np.array(sums, np.int64))
    if largest**2 * x.shape[1] < 1 << 63:
        return (t * t).sum(1).tolist()
    limbs = [t >> (_LIMB * k) & ((1 << _LIMB) - 1) for k in range(3)]
    total = np.zeros(len(x), object)
    for i in range(3):
        for j in range(i, 3):
            total += (limbs[i] * limbs[j]).sum(1).astype(object) * ((1 + (i < j)) << (_LIMB * (i + j)))
    return total.tolist()


@dataclass
class Whitener:
    """What projecting needs; all of it bounded by the dimension."""

    n: int
    sums: list[int]
    #: Columns are the components over the root of their eigenvalues (0 where there is no variance).
    project: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: list[float | None]
    identity_error: float | None


def _merged(vectors: DataFrame, d: int, one: Callable[[np.ndarray], object], add: Callable) -> object:
    """add() over one(block) of all blocks of the written vectors: a partial result a task, merged in a tree."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = unpack(batch.column(0), d)
            for i in range(0, len(x), BLOCK):
                part = one(x[i : i + BLOCK])
                total = part if total is None else add(total, part)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["part"])

    parts = vectors.select("_x").mapInArrow(work, "part binary").rdd.map(lambda r: pickle.loads(r.part))
    both = lambda a, b: b if a is None else a if b is None else add(a, b)
    return parts.treeAggregate(None, both, both, depth=DEPTH)


def _plus(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def fit(df: DataFrame, vector: str = "embedding", components: int = 4) -> Whitener | None:
    """The components of df's distinct vectors; None if there are none."""
    schema = T.StructType([T.StructField("_d", T.IntegerType()), T.StructField("_x", T.BinaryType())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in whole(batch.column(0))[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(pack(x), pa.binary())], schema=to_arrow(schema))

    distinct = df.select(F.col(vector).alias("_v")).mapInArrow(packed, schema).distinct()
    vectors = written(distinct, shared_dir(df.sparkSession), "vectors")
    most = vectors.groupBy("_d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("_d")).first()
    if most is None:
        return None
    d, n = most["_d"], most["n"]
    vectors = vectors.where(F.col("_d") == d)

    def sums_of(x: np.ndarray) -> tuple:
        exact = x if not x.size or max(int(x.max()), -int(x.min())) < _SMALL // BLOCK else x.astype(object)
        return (np.array([int(s) for s in exact.sum(0)], object),)

    sums = [int(s) for s in _merged(vectors, d, sums_of, _plus)[0]]

    def outer(x: np.ndarray) -> tuple:
        z = centred(x, sums, n)
        return (z.T @ z,)

    covariance = _merged(vectors, d, outer, _plus)[0] / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[: min(components, d)]
    values, axes = values[order], axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0)
    trace = float(np.trace(covariance))
    good = values > d * np.finfo(float).eps * max(trace, 0.0)
    project = np.where(good, axes / np.sqrt(np.where(good, values, 1.0)), 0.0)

    def whitened(x: np.ndarray) -> tuple:
        w = centred(x, sums, n) @ project[:, good]
        return (w.T @ w,)

    error = float(np.abs(_merged(vectors, d, whitened, _plus)[0] / n - np.eye(int(good.sum()))).max()) if good.any() else None
    explained = [max(float(v), 0.0) / trace if good.any() else None for v in values]
    return Whitener(n, sums, project, axes, values, explained, error)


def whiten(df: DataFrame, model: Whitener | None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per valid row of df and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    made = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.DecimalType(38, 0)), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *[T.StructField(c, t) for c, t in made]])
    rows = df.select(F.col(id_col), F.col(vector).alias("_v"))
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, kinds = sent.value, to_arrow(schema)
        d, k = m.project.shape
        flat = [not m.project[:, i].any() for i in range(k)]
        for batch in batches:
            for at, x in whole(batch.column(1))[1]:
                if x.shape[1] != d:
                    continue
                far = [None if v >= 10**38 else v for v in deviations(x, m.sums, m.n)]
                ids = batch.column(0).take(pa.array(np.repeat(at, k)))
                w = pa.array((centred(x, m.sums, m.n) @ m.project).ravel(), mask=np.tile(flat, len(at)))
                apart = pa.array(far, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(at)), k)))
                of = pa.array(list(m.explained) * len(at), pa.float64())
                error = pa.array([m.identity_error] * (len(at) * k), pa.float64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(at) * k, m.n)), apart, w, of, error], schema=kinds)

    return rows.mapInArrow(work, schema)
