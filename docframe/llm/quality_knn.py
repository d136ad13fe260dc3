"""Quality by votes of the nearest labelled documents in a latent-semantic space.

A text's terms are its byte pairs (hashed) and, in a block of their own, the
style of its words: how each begins and ends and whether it repeats the word
before.  Counts are damped, weighted by inverse document frequency in the
labelled sample, and projected on the leading singular vectors of that sample.
The labelled vectors, at most 2 * SAMPLE of them, are broadcast; every document
gets its exact cosines with all of them by blocked matrix products, and the
labels of its nearest ones vote, weighted by a power of the similarity and by
how many labels of its class each sampled label stands for.

Cases: null and empty texts have a zero vector, all labels are equally near,
and the score is the weighted share of good ones; ids may be null or repeat;
without labels the score is 1 (nothing speaks against a document); columns of
the same names are replaced, others pass through; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docframe.llm import labelled
from docframe.llm.arrowmap import add_columns, release, to_arrow
from docframe.llm.textbytes import hash_spans, slices, spans, text_bytes

PAIRS = 4096
STYLES = 256
DIMENSIONS = 48
NEIGHBOURS = 40
POWER = 32
#: Labelled documents of each class that vote at most.
SAMPLE = 2048
#: The parts of a model.
NAMES = ["idf", "basis", "vectors", "good", "weight"]


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 7, np.uint8)
    kind[97:123] = 0
    kind[65:91] = 1
    kind[48:58] = 2
    kind[[33, 46, 63]] = 3
    kind[[44, 58, 59]] = 4
    kind[[45, 95, 124]] = 5
    kind[[35, 36, 37, 38, 42, 60, 62]] = 6
    return kind


_CLASS = _byte_classes()


def terms(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log(1 + count) of the terms of each text, as float32 rows of PAIRS + STYLES."""
    n = len(offsets) - 1
    out = np.zeros((n, PAIRS + STYLES), np.float32)
    if not len(raw):
        return out
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    pair = ((raw[:-1].astype(np.uint32) << np.uint32(8)) | raw[1:]) * np.uint32(2654435761) >> np.uint32(20)
    same = row[1:] == row[:-1]
    out[:, :PAIRS] = np.bincount(row[:-1][same].astype(np.int64) * PAIRS + pair[same], minlength=n * PAIRS).reshape(n, PAIRS)
    begin, stop, of = spans(raw, offsets)
    if len(begin):
        h = hash_spans(raw, begin, stop)
        again = np.zeros(len(h), np.int64)
        again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        style = (again * 2 + (stop - begin > 12)) * 64 + _CLASS[raw[begin]] * 8 + _CLASS[raw[stop - 1]]
        out[:, PAIRS:] = np.bincount(of * STYLES + style, minlength=n * STYLES).reshape(n, STYLES)
    return np.log1p(out, out=out)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts * idf
    for block in (x[:, :PAIRS], x[:, PAIRS:]):
        block /= np.linalg.norm(block, axis=1, keepdims=True) + 1e-12
    return x


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    good: np.ndarray
    weight: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        return self.projected(_weighted(counts, self.idf))

    def projected(self, weighted: np.ndarray) -> np.ndarray:
        z = weighted @ self.basis
        return z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-12)

    def score(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and the similarity of the nearest labelled document."""
        n = len(self.good)
        if not n:
            return np.ones(len(counts)), np.zeros(len(counts))
        cosine = self.project(counts) @ self.vectors.T
        k = min(NEIGHBOURS, n)
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        close = np.take_along_axis(cosine, near, 1)
        vote = np.maximum(close, 1e-3).astype(np.float64) ** POWER * self.weight[near]
        blank = ~counts.any(1)
        score = (vote * self.good[near]).sum(1) / vote.sum(1)
        score[blank] = (self.weight * self.good).sum() / self.weight.sum()
        return np.clip(score, 0, 1), np.where(blank, 0, close.max(1))


def fit_terms(counts: np.ndarray, good: np.ndarray, totals: tuple[int, int], seed: int = 7) -> Model:
    """Weights and basis from the sample's term rows; totals: labels of class 0 and 1 in all."""
    n = len(counts)
    if not n:
        return Model(np.zeros(counts.shape[1], np.float32), np.zeros((counts.shape[1], 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0))
    idf = np.log((n + 1) / ((counts > 0).sum(0) + 0.5)).clip(0.1).astype(np.float32)
    x = _weighted(counts, idf)
    # Leading right singular vectors by subspace iteration from a fixed start.
    q = np.random.default_rng(seed).standard_normal((x.shape[1], min(DIMENSIONS + 16, n, x.shape[1]))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ v.T)[:, :DIMENSIONS]
    model = Model(idf, basis.astype(np.float32), np.zeros((0, 1), np.float32), good.astype(np.float64), np.ones(n))
    model.vectors = model.projected(x).astype(np.float32)
    have = np.array([(good == 0).sum(), (good == 1).sum()])
    model.weight = (np.array(totals) / np.maximum(have, 1))[good.astype(int)]
    return model


def _fitted(sample: DataFrame, totals: tuple[int, int]) -> Model:
    """As fit_terms(), in a task: the sample's terms take some hundred megabytes, which the driver needs not have; SAMPLE bounds
    them. sample: id, label and the terms as bytes."""
    kinds = to_arrow(sample.schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, kinds).sort_by(kinds.names[0])
        counts = np.empty((len(table), PAIRS + STYLES), np.float32)
        for i in range(len(table)):
            counts[i] = np.frombuffer(table.column(2)[i].as_buffer(), np.float16)
        good = table.column(1).to_numpy()
        del table
        model = fit_terms(counts, good, totals)
        del counts
        parts = (model.idf, model.basis, model.vectors, model.good, model.weight)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=NAMES)
        del model, parts
        release()

    made = sample.repartition(1).mapInArrow(work, ", ".join(f"{x} binary" for x in NAMES)).collect()
    if not made or not made[0].good:  # an empty sample may have no task
        return fit_terms(np.zeros((0, PAIRS + STYLES), np.float32), np.zeros(0, np.int64), totals)
    idf, basis, vectors, good, weight = (np.frombuffer(x, kind) for x, kind in zip(made[0], (np.float32, np.float32, np.float32, np.float64, np.float64), strict=True))
    return Model(idf, basis.reshape(PAIRS + STYLES, -1), vectors.reshape(len(good), -1), good, weight)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> Model:
    rows, totals = labelled.sample(docs, labels, label, most, id_col, text_col)
    out = T.StructType([T.StructField("_terms", T.BinaryType())])

    def make():
        def run(batch: pa.RecordBatch) -> list:
            buf, offsets = text_bytes(batch.column(0))
            made = []
            for a, b in slices(offsets, 1 << 20):
                made += [x.astype(np.float16).tobytes() for x in terms(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
            return [pa.array(made, pa.binary())]

        return run

    # At most 2 * most rows of 2 * (PAIRS + STYLES) bytes.
    return _fitted(add_columns(rows, ["_text"], out, make).select("_id", "_label", "_terms"), totals)


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with score (0 to 1, higher: better) and nearest (the best cosine). One pass over the texts, no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("nearest", T.DoubleType())])

    def make():
        def run(batch: pa.RecordBatch) -> list:
            buf, offsets = text_bytes(batch.column(0))
            made = []
            for a, b in slices(offsets, 1 << 20):
                for c in range(a, b, 512):
                    d = min(b, c + 512)
                    made.append(shared.value.score(terms(buf[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c])))
            return [np.concatenate(x).astype(np.float64) for x in zip(*made, strict=True)]

        return run

    return add_columns(df, [text_col], out, make)
