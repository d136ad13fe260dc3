"""Toxicity by class-conditional Kneser-Ney models.

Each class, toxic and ordinary, has a model of how words are spelt: the next
byte given up to ORDER bytes before it in the word, with absolute discounting.
A class's counts back off to one shared model of all training words
(interpolated Kneser-Ney with continuation counts), with a fixed strength, so
that an expression which is rare in a class is judged alike by both and adds
little evidence; letters that neither class has seen together add none.  A toxic document is a mixture: a share of its words come from
the toxic model, the rest are ordinary; the toxic model is refitted a few
times with each word weighted by its share in that mixture.  A document's two
log-likelihoods are compared per word, and by the root of the number of words,
and a logistic curve fitted on labelled documents that the counts have not
seen, and moved so that the best F1 on them lies at 0.5, turns that into a score.

Cases: null and empty texts score as texts without evidence; ids may be null
or repeat (each row is scored alike); without labels of both classes the score
is the share of toxic labels; columns of the same names are replaced, others
pass through; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.llm import labelled
from docframe.llm.arrowmap import add_columns, release, shared_dir, written
from docframe.llm.bpe import WordCache
from docframe.llm.textbytes import LOWER, hash_spans, mix, ragged, slices, spans, text_bytes

ORDER = 6
DISCOUNT = 0.75
STRENGTH = 20.0
TOXIC_SHARE = 0.03
REFITS = 2
#: Labelled documents of each class that are used at most.
SAMPLE = 4000

_START = np.uint64(300)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _contexts(text: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """A hash of the `order` bytes before each byte of its word, with a mark for the word's start."""
    h = np.full(len(text), order, np.uint64)
    for back in range(order, 0, -1):
        before = np.zeros(len(text), np.uint64)
        before[back:] = text[: len(text) - back] + np.uint64(1)
        before[place < back] = 0
        before[place == back - 1] = _START
        h = h * _STEP + before
    return mix(h)


def _spell(buf: np.ndarray, begin: np.ndarray, lengths: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every byte of the words: its context, its gram, its value and its place."""
    text = buf[ragged(begin, lengths)].astype(np.uint64)
    place = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    context = _contexts(text, place, order)
    return context, mix(context * np.uint64(31) + text), text, place


@dataclass
class Model:
    grams: np.ndarray
    evidence: np.ndarray  # log ratio of either class's probability of the gram; grams that neither has seen say nothing
    order: int
    share: float
    weights: tuple[float, float, float]  # of the two normalised log-likelihood ratios, and the constant

    def words(self, buf: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """log P(word | toxic mixture) - log P(word | ordinary) of each word."""
        lengths = stop - begin
        if not len(self.grams):
            return np.zeros(len(lengths), np.float32)
        _, gram, _, _ = _spell(buf, begin, lengths, self.order)
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        value = np.where(self.grams[at] == gram, self.evidence[at], 0)
        ratio = np.add.reduceat(value, np.cumsum(lengths) - lengths)
        return np.log1p(self.share * np.expm1(np.minimum(ratio, 40))).astype(np.float32)

    def score(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        a, b, c = self.weights
        n = np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(a * total / n + b * total / np.sqrt(n) + c, -40, 40)))


def fit_words(words: list[bytes], ordinary: np.ndarray, toxic: np.ndarray, order: int = ORDER, share: float = TOXIC_SHARE) -> Model:
    """The two models from the distinct training words and their numbers in either class."""
    buf = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.array([len(w) for w in words], np.int64)
    if not len(buf) or not toxic.sum() or not ordinary.sum():
        return Model(np.zeros(0, np.uint64), np.zeros(0), order, share, (0.0, 0.0, 0.0))
    begin = np.cumsum(lengths) - lengths
    both = np.repeat((ordinary + toxic).astype(np.float32), lengths)

    def level(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Context numbers and gram numbers of all bytes at order k, and the context of each gram."""
        context, gram, _, _ = _spell(buf, begin, lengths, k)
        _, c = np.unique(context, return_inverse=True)
        _, first, g = np.unique(gram, return_index=True, return_inverse=True)
        return c.astype(np.int32), g.astype(np.int32), c[first]

    def discounted(counts: np.ndarray, c: np.ndarray, g: np.ndarray, of: np.ndarray, low: np.ndarray, strength: float) -> np.ndarray:
        total, kinds = np.bincount(of, counts), np.bincount(of, counts > 0)
        total, kinds = total[c], kinds[c]
        mass = strength + DISCOUNT * kinds
        return np.where(total + strength > 0, (np.maximum(counts[g] - DISCOUNT, 0) + mass * low) / np.maximum(total + strength, 1e-9), low)

    low = np.full(len(buf), 1 / 256)
    c, g, of = level(0)
    for k in range(order):
        c_next, g_next, of_next = level(k + 1)
        first = np.zeros(len(of_next), np.int64)
        first[g_next] = np.arange(len(buf))
        continued = np.bincount(g[first], minlength=len(of)).astype(float)  # distinct longer grams that end so
        low = discounted(continued, c, g, of, low, 0.0)
        c, g, of = c_next, g_next, of_next
    shared = discounted(np.bincount(g, both), c, g, of, low, 0.0)
    first = np.zeros(len(of), np.int64)
    first[g] = np.arange(len(buf))
    shared_of = shared[first]

    def fit(weight: np.ndarray) -> np.ndarray:
        """log probability of each gram in a class: its own counts over the shared model's."""
        counts = np.bincount(g, np.repeat(weight.astype(np.float32), lengths), len(of))
        total, kinds = np.bincount(of, counts), np.bincount(of, counts > 0)
        return np.log((np.maximum(counts - DISCOUNT, 0) + (STRENGTH + DISCOUNT * kinds[of]) * shared_of) / (total[of] + STRENGTH))

    mine = np.ones(len(words))
    for again in range(REFITS + 1):
        evidence = fit(toxic * mine) - fit(ordinary + toxic * (1 - mine if again else 0))
        ratio = np.add.reduceat(evidence[g], begin)
        odds = share * np.exp(np.minimum(ratio, 40))
        mine = odds / (1 - share + odds)
    grams = _spell(buf, begin, lengths, order)[1][first]
    by_hash = np.argsort(grams)
    return Model(grams[by_hash], evidence[by_hash].astype(np.float32), order, share, (0.0, 0.0, 0.0))


def _fitted(counts: DataFrame, order: int = ORDER, share: float = TOXIC_SHARE) -> Model:
    """As fit_words(), in a task: the fit takes some hundred megabytes, which the driver needs not have; the sample bounds the words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, schema)
        model = fit_words(table["word"].to_pylist(), table["ordinary"].to_numpy(), table["toxic"].to_numpy(), order, share)
        del table
        yield pa.RecordBatch.from_arrays([pa.array(model.grams.view(np.int64)), pa.array(model.evidence, pa.float32())], names=["gram", "evidence"])
        del model
        release()

    schema = pa.schema([("word", pa.binary()), ("ordinary", pa.int64()), ("toxic", pa.int64())])
    made = counts.repartition(1).mapInArrow(work, "gram long, evidence float").toArrow().combine_chunks()
    grams, evidence = made["gram"].to_numpy().view(np.uint64), made["evidence"].to_numpy()
    by_hash = np.argsort(grams, kind="stable")  # as they come, unless batches were put in another order
    return Model(grams[by_hash], evidence[by_hash], order, share, (0.0, 0.0, 0.0))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a slight ridge, by Newton's method; the last column of x is the constant."""
    scale = np.maximum(x.std(0), 1e-9)
    scale[-1] = 1
    z = x / scale
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1e-2)
    ridge[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (weight * (p - y)) + ridge * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w / scale


def totals(batch_text: pa.Array, model: Model, cache: WordCache) -> tuple[np.ndarray, np.ndarray]:
    """Each row's log-likelihood ratio and number of words."""
    buf, offsets = text_bytes(batch_text)
    total, n = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
    for a, b in slices(offsets):
        part = LOWER[buf[offsets[a] : offsets[b]]]
        begin, stop, row = spans(part, offsets[a : b + 1] - offsets[a])
        if not len(begin):
            continue
        hashes, first, inverse = np.unique(hash_spans(part, begin, stop), return_index=True, return_inverse=True)

        def fresh(new, part=part, begin=begin, stop=stop, first=first):
            return model.words(part, begin[first[new]], stop[first[new]]).view(np.int32), np.ones(len(new), np.int64)

        at, _ = cache.look_up(hashes, fresh)
        value = cache.ids[at].view(np.float32)[inverse]
        total[a:b] = np.bincount(row, value, b - a)
        n[a:b] = np.bincount(row, minlength=b - a)
    return total, n


def _word_counts(rows: DataFrame) -> DataFrame:
    """Distinct words of labelled rows, with their numbers in ordinary and toxic ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            buf, offsets = text_bytes(batch.column(0))
            for a, b in slices(offsets):
                part = LOWER[buf[offsets[a] : offsets[b]]]
                begin, stop, row = spans(part, offsets[a : b + 1] - offsets[a])
                if not len(begin):
                    continue
                _, first, inverse = np.unique(hash_spans(part, begin, stop), return_index=True, return_inverse=True)
                is_toxic = label[a:b][row] == 1
                words = [part[i:j].tobytes() for i, j in zip(begin[first], stop[first], strict=True)]
                counts = [np.bincount(inverse, mask, len(first)).astype(np.int64) for mask in (~is_toxic, is_toxic)]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *map(pa.array, counts)], names=["word", "ordinary", "toxic"])

    counted = rows.select("_text", "_label").mapInArrow(work, "word binary, ordinary long, toxic long")
    return counted.groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> Model:
    """The model of labelled documents outside fold 0: counts from folds 2 to 4, the curve from fold 1."""
    spark = docs.sparkSession
    rows, (n_ordinary, n_toxic) = labelled.sample(docs, labels, label, most, id_col, text_col)
    rows = written(rows, shared_dir(spark), "labelled")
    model = _fitted(_word_counts(rows.where("_fold <> 1")))
    shared = spark.sparkContext.broadcast(model)
    seen = rows.where("_fold = 1").select("_text", "_label")
    out = T.StructType([T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])
    tried = add_columns(seen, ["_text"], out, lambda: (lambda batch, cache=WordCache(): list(totals(batch.column(0), shared.value, cache)))).select("_label", "total", "n").toPandas()
    prior = np.log((n_toxic + 0.5) / (n_ordinary + 0.5))
    y = tried["_label"].to_numpy().astype(float)
    if not len(model.grams) or not 0 < y.sum() < len(y):
        model.weights = (4.0, 0.0, float(prior))
        return model
    n = np.maximum(tried["n"].to_numpy(), 1)
    total = tried["total"].to_numpy()
    x = np.stack([total / n, total / np.sqrt(n), np.ones(len(n))], 1)
    weight = np.where(y == 1, n_toxic / y.sum(), n_ordinary / (len(y) - y.sum()))
    w = fit_curve(x, y, weight * len(y) / weight.sum())
    w[2] -= best_cut(x @ w, y, weight)
    model.weights = tuple(float(v) for v in w)
    release()
    return model


def best_cut(value: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The value at which cutting gives the best F1 of class 1: there the score is to be 0.5."""
    order = np.argsort(-value, kind="stable")
    hit = np.cumsum((weight * y)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + (weight * y).sum())
    best = int(np.argmax(f1))
    after = value[order[best + 1]] if best + 1 < len(value) else value[order[best]] - 1
    return float((value[order[best]] + after) / 2)


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with score (0 to 1), llr (the log-likelihood ratio per word) and n_words.

    The model is bounded by the fitting sample and broadcast; the texts are read once and nothing is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("llr", T.DoubleType()), T.StructField("n_words", T.LongType())])

    def make():
        cache = WordCache()

        def run(batch: pa.RecordBatch) -> list:
            total, n = totals(batch.column(0), shared.value, cache)
            return [shared.value.score(total, n), total / np.maximum(n, 1), n]

        return run

    return add_columns(df, [text_col], out, make)
