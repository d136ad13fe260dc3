"""Interpolated modified Kneser-Ney language model, counted in Spark and memory-mapped by the workers that score.

The model is a trigram model over words and an end mark.  Four counting jobs
make it, each with counts summed in the task before they are dealt out as
compressed blobs of sorted keys, a few bytes an n-gram:

1. word hashes with their counts, dealt by ranges of the hash.  A range's
   sorted hashes are one file; a word's id is its rank among all hashes.
2. triples of ids, dealt by ranges of their first two (the context).  The
   borders follow from the word counts, and a frequent first word is split by
   its second word, so that no range holds many more tokens than another.  A
   range is one file: its sorted contexts, and for each the sorted words that
   follow it with their counts.
3. for each pair of words the number of different words before it (for pairs
   at the start of a text, where none can be, their count), from the files of
   2, dealt by the same ranges.  As every pair but those with the end mark is a
   context too, a range's numbers stand beside its contexts; with them stand,
   for each first word, the numbers of its second words by kind.
4. for each word, its number of different words before it.

Scoring maps these files: memory that the operating system shares among the
workers of a machine and drops when it is short; a worker keeps them open from
task to task.  What the driver holds is a line for each file.  The files hold
all of the training corpus: nothing is pruned, so they grow with its distinct
pairs (9 bytes each) and triples (5 bytes), which the shared folder has to hold.

Cases: null and empty texts are an end mark only; ids may repeat (each row
counts and is scored); rows with a null id are scored, and not learnt from;
very long texts are counted and scored whole; with nothing to learn from, every
token has the probability of an unknown one (1: the only event); columns of the
same names are replaced, others pass through; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docframe.llm.arrowmap import add_columns, drop_dir, release, written
from docframe.llm.store import Store, grow, grow_sorted, shrink, shrink_sorted, sum_by_key
from docframe.llm.textbytes import LOWER, SLICE_BYTES, hash_spans, ragged, slices, spans, text_bytes

#: The end mark's place among the word hashes (a fixed value: no word's hash but by a chance of 2**-64).
END = np.uint64(0x8F1BBCDC5A827999)
#: Input bytes for a range of words, and tokens for a range of contexts.
WORD_BYTES = 8 << 20
PAIR_TOKENS = 2_000_000
#: Distinct words, or triples, that a task holds before it deals them out.
HOLD = 2_000_000
#: Contexts with more following words have their sums stored, others have them added up when asked for.
WIDE = 8
#: Bytes of text that are scored at once: each slice asks every file it needs once.
SCORED_BYTES = 4 << 20
_BLOB = "bucket int, keys binary, counts binary"
_LOW = np.uint64(0xFFFFFFFF)
_SHIFT = np.uint64(32)


def _words(batch_text: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of rows: first and last row, distinct hashes, and the number of each token's hash, with an end mark after each row,
    and the bounds of the rows' tokens."""
    buf, offsets = text_bytes(batch_text)
    for a, b in slices(offsets, most):
        part = LOWER[buf[offsets[a] : offsets[b]]]
        begin, stop, row = spans(part, offsets[a : b + 1] - offsets[a])
        n = np.bincount(row, minlength=b - a)
        hashes = np.full(len(begin) + b - a, END)
        hashes[np.arange(len(begin)) + row] = hash_spans(part, begin, stop)
        yield a, b, hashes, np.concatenate([[0], np.cumsum(n + 1)])


def _deal(keys: np.ndarray, counts: np.ndarray, borders: np.ndarray) -> pa.RecordBatch:
    """A row for each range that sorted keys fall in; borders: the first keys of all ranges."""
    at = np.append(np.searchsorted(keys, borders), len(keys))
    rows = [(i, shrink_sorted(keys[a:b]), shrink(counts[a:b])) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "keys", "counts"])


def _gathered(table: pa.Table, dtype=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Keys and summed counts of all blobs of a range."""
    keys = [grow_sorted(x.as_py(), dtype) for x in table["keys"]]
    counts = [grow(x.as_py(), np.int64) for x in table["counts"]]
    return sum_by_key(np.concatenate(keys), np.concatenate(counts))


class _Summer:
    """Sums counts by key, and says when it is full."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts))
        self.size += len(keys)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        return sum_by_key(keys, counts.astype(np.int64))


class _Triples:
    """Holds contexts and words of tokens until it is full, and sums them."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, contexts: np.ndarray, words: np.ndarray) -> None:
        self.parts.append((contexts, words.astype(np.uint32)))
        self.size += len(words)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        contexts, words = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        return _sum_triples(contexts, words, None)


def _sum_triples(contexts: np.ndarray, words: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, word), ascending, and their counts (None: each entry is one)."""
    distinct, place = np.unique(contexts, return_inverse=True)
    keys = (place.astype(np.uint64) << _SHIFT) | words
    if counts is None:
        keys, counts = np.unique(keys, return_counts=True)
    else:
        keys, counts = sum_by_key(keys, counts)
    return distinct[(keys >> _SHIFT).astype(np.int64)], (keys & _LOW).astype(np.uint32), counts.astype(np.int64)


def _small(counts: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Counts in a byte each, and those of 255 and more beside them."""
    big = np.flatnonzero(counts >= 255)
    return {name: np.minimum(counts, 255).astype(np.uint8), f"{name}_big_at": big.astype(np.int64), f"{name}_big": counts[big].astype(np.int64)}


def _large(x: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    """Counts at some places of arrays made by _small()."""
    n = x[name][at].astype(np.int64)
    big = np.flatnonzero(n == 255)
    if len(big):
        n[big] = x[f"{name}_big"][np.searchsorted(x[f"{name}_big_at"], at[big])]
    return n


def _find(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted values in the ascending slices values[low:high], one slice each; -1 where there is none."""
    low, high, end = low.copy(), high.copy(), high
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            break
        middle = (low[open_] + high[open_]) >> 1
        less = values[middle] < wanted[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
    out = np.full(len(low), -1, np.int64)
    inside = np.flatnonzero(low < end)
    hit = inside[values[low[inside]] == wanted[inside]]
    out[hit] = low[hit]
    return out


def _kinds(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For runs that begin at `at` (ascending, none empty): the sum of the counts, and how many are 1, 2, and more."""
    return np.stack([np.add.reduceat(c.astype(np.int64), at) for c in (counts, counts == 1, counts == 2, counts > 2)], 1)


@dataclass
class Model:
    """Where the arrays are, and the constants.  Word ids reach up to the number of words; that number itself is the start
    mark, and the next one stands for what is before it."""

    folder: str
    word_files: list[tuple[str, str]]
    word_borders: np.ndarray  # first hash of each range
    word_base: np.ndarray  # first id of each range, and the number of words
    tokens: int
    documents: int
    borders: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # first pair of each range
    triple_files: dict[int, tuple[str, str]] = field(default_factory=dict)
    pair_files: dict[int, tuple[str, str]] = field(default_factory=dict)
    first_files: list[tuple[str, str]] = field(default_factory=list)
    shared_firsts: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)  # first words that aren't whole in the range of their lowest key: sums over ranges
    pairs: int = 0
    triples: int = 0
    triple_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    pair_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    word_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    word_rest: float = 1.0  # mass left to the uniform distribution

    @property
    def words(self) -> int:
        return int(self.word_base[-1]) if len(self.word_base) else 0


class Reader:
    """Looks up in the mapped arrays; files are opened when first asked for."""

    _held: dict[str, Reader] = {}

    def __init__(self, model: Model):
        self.model, self.store = model, Store(model.folder)
        self.opened: dict[str, dict[str, np.ndarray]] = {}

    @classmethod
    def of(cls, model: Model) -> Reader:
        """The reader of this worker, kept from task to task (with the files that it has mapped)."""
        if model.folder not in cls._held:
            cls._held.clear()
            cls._held[model.folder] = cls(model)
        held = cls._held[model.folder]
        held.model = model
        return held

    def _open(self, file: tuple[str, str]) -> dict[str, np.ndarray]:
        if file[0] not in self.opened:
            self.opened[file[0]] = self.store.read(*file)
        return self.opened[file[0]]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of ascending hashes."""
        m = self.model
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for i, a, b in _ranges(hashes, m.word_borders):
            x = self._open(m.word_files[i])
            at = np.minimum(np.searchsorted(x["keys"], hashes[a:b]), max(0, len(x["keys"]) - 1))
            found = np.flatnonzero(x["keys"][at] == hashes[a:b]) if len(x["keys"]) else []
            ids[a:b][found] = m.word_base[i] + at[found]
            counts[a:b][found] = x["counts"][at[found]]
        return ids, counts

    def followed(self, ids: np.ndarray) -> np.ndarray:
        """Number of different words before each of ascending ids."""
        m = self.model
        out = np.zeros(len(ids), np.int64)
        for i, a, b in _ranges(ids, m.word_base[:-1]):
            out[a:b] = self._open(m.first_files[i])["before"][ids[a:b] - m.word_base[i]]
        return out

    def pairs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For ascending pairs: how many words are before each; as contexts, the sum and kinds of what follows (rows of four);
        and where they are: range and place (-1: no context)."""
        m = self.model
        before, after = np.zeros(len(keys), np.int64), np.zeros((len(keys), 4), np.int64)
        ranges, places = np.full(len(keys), -1, np.int64), np.full(len(keys), -1, np.int64)
        for i, a, b in _ranges(keys, m.borders):
            part = keys[a:b]
            at = np.full(b - a, -1, np.int64)
            if i in m.triple_files:
                x = self._open(m.triple_files[i])
                first = np.searchsorted(x["firsts"], part >> _SHIFT)
                known = np.flatnonzero(first < len(x["firsts"]))
                known = known[x["firsts"][first[known]] == part[known] >> _SHIFT]
                at[known] = _find(x["seconds"], x["first_at"][first[known]], x["first_at"][first[known] + 1], (part[known] & _LOW).astype(np.uint32))
                hit = np.flatnonzero(at >= 0)
                ranges[a:b][hit], places[a:b][hit] = i, at[hit]
                after[a + hit] = self._sums(x, at[hit])
            if i in m.pair_files:
                y = self._open(m.pair_files[i])
                hit = np.flatnonzero((at >= 0) & (at < len(y["before"])))
                before[a + hit] = _large(y, "before", at[hit])
                other = np.flatnonzero(at < 0)
                if len(y["others"]) and len(other):
                    near = np.minimum(np.searchsorted(y["others"], part[other]), len(y["others"]) - 1)
                    found = y["others"][near] == part[other]
                    before[a + other[found]] = y["others_before"][near[found]]
        return before, after, ranges, places

    @staticmethod
    def _sums(x: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
        """Sum and kinds of the counts that follow contexts (ascending places)."""
        if not len(at):
            return np.zeros((0, 4), np.int64)
        low = x["at"][at].astype(np.int64)
        n = x["at"][at + 1].astype(np.int64) - low
        out = np.zeros((len(at), 4), np.int64)
        narrow, wide = np.flatnonzero(n <= WIDE), np.flatnonzero(n > WIDE)
        if len(narrow):
            counts = _large(x, "counts", ragged(low[narrow], n[narrow]))
            out[narrow] = _kinds(counts, np.cumsum(n[narrow]) - n[narrow])
        if len(wide):
            out[wide] = x["wide"].reshape(-1, 4)[np.searchsorted(x["wide_at"], at[wide])]
        return out

    def triples(self, ranges: np.ndarray, places: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Counts of words after contexts (as pairs() gives them, ascending)."""
        out = np.zeros(len(words), np.int64)
        bounds = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1], [True]])) if len(ranges) else []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            x = self._open(self.model.triple_files[int(ranges[a])])
            at = places[a:b]
            found = _find(x["words"], x["at"][at].astype(np.int64), x["at"][at + 1].astype(np.int64), words[a:b].astype(np.uint32))
            hit = np.flatnonzero(found >= 0)
            out[a + hit] = _large(x, "counts", found[hit])
        return out

    def successors(self, firsts: np.ndarray) -> np.ndarray:
        """For ascending ids: the sum of the numbers of their pairs, and how many of these are 1, 2, and more (rows of four)."""
        m = self.model
        out = np.zeros((len(firsts), 4), np.int64)
        for i, a, b in _ranges(firsts.astype(np.uint64) << _SHIFT, m.borders):
            if i in m.pair_files:
                x = self._open(m.pair_files[i])
                at = np.minimum(np.searchsorted(x["firsts"], firsts[a:b]), len(x["firsts"]) - 1)
                found = x["firsts"][at] == firsts[a:b]
                out[a:b] = np.where(found[:, None], x["sums"].reshape(-1, 4)[at], 0)
        if m.shared_firsts:
            known = np.array(sorted(m.shared_firsts))
            at = np.minimum(np.searchsorted(known, firsts), len(known) - 1)
            for i in np.flatnonzero(known[at] == firsts):
                out[i] = m.shared_firsts[int(firsts[i])]
        return out


def _ranges(keys: np.ndarray, borders: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Ranges that ascending keys fall in, with the keys' bounds; keys below the first border belong to the first range."""
    if not len(borders):
        return
    at = np.searchsorted(keys, borders[1:])
    at = np.concatenate([[0], at, [len(keys)]])
    for i in np.flatnonzero(at[1:] > at[:-1]).tolist():
        yield i, int(at[i]), int(at[i + 1])


def discounts_of(n: np.ndarray) -> tuple[float, float, float]:
    """Discounts for counts of 1, 2, and 3 and more, from the numbers of n-grams that are seen 1 to 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9)
    return tuple(min(max(x, 0.05), k - 0.05) for x, k in zip(d, (1, 2, 3), strict=True))


def _take_off(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array((0.0, *d))[np.minimum(counts, 3)], 0)


def _size(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def train(docs: DataFrame, folder: str, text_col: str = "text") -> Model:
    """The model of all rows' texts; its files go to the shared folder."""
    texts = docs.select(text_col)
    spark = docs.sparkSession
    n_ranges = max(1, min(1 << 20, _size(texts) // WORD_BYTES))
    word_borders = np.array([(i << 64) // n_ranges for i in range(n_ranges)], np.uint64)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Summer()
        for batch in batches:
            for _, _, hashes, _ in _words(batch.column(0)):
                held.add(hashes)
                if held.size > HOLD:
                    yield _deal(*held.take(), word_borders)
        if held.parts:
            yield _deal(*held.take(), word_borders)

    def keep_words(key, table):
        keys, counts = _gathered(table)
        name, layout = Store(folder).write("words", {"keys": keys, "counts": counts})
        ends = counts[keys == END].sum()
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "name": [name], "layout": [layout], "n": [len(keys)], "total": [int(counts.sum())], "ends": pa.array([int(ends)], pa.int64())})

    made = texts.mapInArrow(count_words, _BLOB).groupBy("bucket").applyInArrow(keep_words, "bucket int, name string, layout string, n long, total long, ends long")
    rows = sorted(written(made, folder, "word-files").collect())  # a row a file
    model = Model(folder, [(r["name"], r["layout"]) for r in rows], word_borders[[r["bucket"] for r in rows]] if rows else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([r["n"] for r in rows])]).astype(np.int64), sum(r["total"] for r in rows), sum(r["ends"] for r in rows))
    if not rows:
        return model
    model.borders = _pair_borders(spark, model, [r["total"] for r in rows])
    shared = spark.sparkContext.broadcast(model)

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, held = shared.value, _Triples()
        reader, start = Reader.of(m), np.uint64(m.words)
        for batch in batches:
            for _, _, hashes, bounds in _words(batch.column(0)):
                distinct, inverse = np.unique(hashes, return_inverse=True)
                word = reader.ids(distinct)[0].astype(np.uint64)[inverse]
                first, second = np.empty_like(word), np.empty_like(word)
                second[1:], first[2:] = word[:-1], word[:-2]
                second[bounds[:-1]], first[bounds[:-1]] = start, start + np.uint64(1)
                later = bounds[:-1] + 1
                first[later[later < bounds[1:]]] = start
                held.add((first << _SHIFT) | second, word)
                if held.size > HOLD:
                    yield _deal_triples(*held.take(), m.borders)
        if held.parts:
            yield _deal_triples(*held.take(), m.borders)
        release()

    def keep_triples(key, table):
        contexts, words, counts = (np.concatenate(x) for x in zip(*[(grow_sorted(c.as_py()), grow(w.as_py(), np.uint32), grow(n.as_py(), np.int64)) for c, w, n in zip(table["keys"], table["words"], table["counts"], strict=True)], strict=True))
        contexts, words, counts = _sum_triples(contexts, words, counts)
        own, at = np.unique(contexts, return_index=True)
        firsts, first_at = np.unique(own >> _SHIFT, return_index=True)
        sums = _kinds(counts, at)
        wide = np.flatnonzero(np.diff(at, append=len(words)) > WIDE)
        arrays = {"firsts": firsts, "first_at": np.append(first_at, len(own)).astype(np.int64), "seconds": (own & _LOW).astype(np.uint32), "at": np.append(at, len(words)).astype(np.uint32), "words": words}
        name, layout = Store(folder).write("triples", arrays | _small(counts, "counts") | {"wide_at": wide.astype(np.uint32), "wide": sums[wide].ravel()})
        real = counts[contexts >> _SHIFT <= np.uint64(shared.value.words)]
        columns = {"range": pa.array([key[0].as_py()], pa.int32()), "name": [name], "layout": [layout], "triples": pa.array([len(real)], pa.int64()), "of_counts": [np.bincount(np.minimum(real, 5), minlength=6)[1:5].tolist()]}
        return pa.table(columns)

    blob = _BLOB + ", words binary"
    kind = "range int, name string, layout string, triples long, of_counts array<long>"
    made = written(texts.mapInArrow(count_triples, blob).groupBy("bucket").applyInArrow(keep_triples, kind), folder, "triple-files")
    _collect_garbage(spark)
    files = sorted(made.collect())
    model.triple_files = {r["range"]: (r["name"], r["layout"]) for r in files}
    model.triples = sum(r["triples"] for r in files)
    model.triple_discounts = discounts_of(np.sum([r["of_counts"] for r in files], 0))
    shared = spark.sparkContext.broadcast(model)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                x = Reader.of(m)._open(m.triple_files[i])
                n = np.diff(x["at"].astype(np.int64))
                keys = (np.repeat(x["seconds"].astype(np.uint64), n) << _SHIFT) | x["words"]
                first = np.repeat(x["firsts"], np.add.reduceat(n, x["first_at"][:-1]))
                opening = first > np.uint64(m.words)  # pairs at the start of a text: no word is before them, so their count is taken
                yield _deal(*sum_by_key(keys, np.where(opening, _large(x, "counts", np.arange(len(keys))), 1)), m.borders)
        release()

    def keep_pairs(key, table):
        m, i = shared.value, key[0].as_py()
        keys, before = _gathered(table)
        own, others = np.zeros(0, np.int64), np.ones(len(keys), bool)
        if i in m.triple_files:
            x = Reader.of(m)._open(m.triple_files[i])
            contexts = (np.repeat(x["firsts"], np.diff(x["first_at"])) << _SHIFT) | x["seconds"]
            at = np.minimum(np.searchsorted(contexts, keys), len(contexts) - 1)
            others = contexts[at] != keys
            own = np.zeros(len(contexts), np.int64)
            own[at[~others]] = before[~others]
        firsts, begin = np.unique((keys >> _SHIFT).astype(np.int64), return_index=True)
        sums = _kinds(before, begin)
        name, layout = Store(folder).write("pairs", _small(own, "before") | {"others": keys[others], "others_before": before[others], "firsts": firsts, "sums": sums.ravel()})
        edges = [int(v) for j in sorted({0, len(firsts) - 1}) for v in (firsts[j], *sums[j])]
        seconds = _deal(*sum_by_key(keys & _LOW, np.ones(len(keys), np.int64)), m.word_base[:-1].astype(np.uint64))
        n = seconds.num_rows
        columns = {"range": pa.array([i] * n, pa.int32()), "name": [name] * n, "layout": [layout] * n, "pairs": pa.array([len(keys)] * n, pa.int64()), "of_counts": [np.bincount(np.minimum(before, 5), minlength=6)[1:5].tolist()] * n, "edges": [edges] * n}
        return pa.table(columns | {c: seconds.column(c) for c in ("bucket", "keys", "counts")})

    kind = "range int, name string, layout string, pairs long, of_counts array<long>, edges array<long>, " + _BLOB
    spread = made.select("range").repartition(max(1, len(files)), "range")
    counted = written(spread.mapInArrow(count_pairs, _BLOB).groupBy("bucket").applyInArrow(keep_pairs, kind), folder, "pair-files")
    _collect_garbage(spark)
    files = sorted(counted.select("range", "name", "layout", "pairs", "of_counts", "edges").distinct().collect())
    model.pair_files = {r["range"]: (r["name"], r["layout"]) for r in files}
    model.pairs = sum(r["pairs"] for r in files)
    model.pair_discounts = discounts_of(np.sum([r["of_counts"] for r in files], 0))
    sums: dict[int, list[np.ndarray]] = {}
    apart: set[int] = set()  # words with a file other than that of the range that their lowest key falls in
    for r in files:
        for e in np.array(r["edges"]).reshape(-1, 5):
            k = int(e[0])
            sums.setdefault(k, []).append(e[1:])
            if max(0, int(np.searchsorted(model.borders, np.uint64(k << 32), side="right")) - 1) != r["range"]:
                apart.add(k)
    model.shared_firsts = {k: tuple(int(x) for x in np.sum(v, 0)) for k, v in sums.items() if k in apart}
    base = shared.value.word_base

    def keep_befores(key, table):
        i = key[0].as_py()
        low, before = _gathered(table)
        dense = np.zeros(base[i + 1] - base[i], np.int64)
        dense[low.astype(np.int64) - base[i]] = before
        name, layout = Store(folder).write("befores", {"before": dense.astype(np.int32) if dense.max(initial=0) < 2**31 else dense})
        return pa.table({"bucket": pa.array([i], pa.int32()), "name": [name], "layout": [layout], "of_counts": [np.append(np.bincount(np.minimum(dense, 5), minlength=6)[1:5], (dense > 2).sum()).tolist()]})

    befores = counted.select("bucket", "keys", "counts").groupBy("bucket").applyInArrow(keep_befores, "bucket int, name string, layout string, of_counts array<long>")
    files = sorted(written(befores, folder, "before-files").collect())
    model.first_files = [(r["name"], r["layout"]) for r in files]
    n = np.sum([r["of_counts"] for r in files], 0)
    d = model.word_discounts = discounts_of(n[:4])
    model.word_rest = float((d[0] * n[0] + d[1] * n[1] + d[2] * n[4]) / model.pairs)
    drop_dir(spark, f"{folder}/pair-files")
    return model


def _deal_triples(contexts: np.ndarray, words: np.ndarray, counts: np.ndarray, borders: np.ndarray) -> pa.RecordBatch:
    """A row for each range that sorted contexts fall in."""
    at = np.append(np.searchsorted(contexts, borders), len(contexts))
    rows = [(i, shrink_sorted(contexts[a:b]), shrink(counts[a:b]), shrink(words[a:b])) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "keys", "counts", "words"])


def _collect_garbage(spark) -> None:
    """Shuffle files go when the driver finds that nothing refers to them: at its next collection, which is asked for."""
    spark.sparkContext._jvm.System.gc()


def _pair_borders(spark, model: Model, totals: list[int]) -> np.ndarray:
    """First keys of ranges of about PAIR_TOKENS tokens, from the word counts; a first word with more is cut by its second word."""
    shared, words = spark.sparkContext.broadcast(model), model.words
    rows = [(i, int(x)) for i, x in enumerate(np.cumsum(totals) - totals)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader = Reader.of(m)
        for batch in batches:
            for i, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = reader._open(m.word_files[i])["counts"]
                ends = before + np.cumsum(counts)
                many = ends // PAIR_TOKENS - (ends - counts) // PAIR_TOKENS  # borders within each word's tokens
                out = []
                for k in np.flatnonzero(many):
                    parts = int(counts[k]) // PAIR_TOKENS + 1
                    out += [((int(m.word_base[i]) + int(k)) << 32) + words * j // parts for j in range(parts)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(out, np.uint64).view(np.int64), pa.int64())], names=["border"])

    # A border for every PAIR_TOKENS tokens comes to the driver, and as many for frequent words.
    inner = [r[0] for r in spark.createDataFrame(rows, "i int, before long").mapInArrow(cut, "border long").collect()]
    starts = model.documents // PAIR_TOKENS + 1  # the start mark is a first word as frequent as documents
    inner += [(words << 32) + words * j // starts for j in range(starts)]
    return np.unique(np.array([0, *inner], np.int64).view(np.uint64))


_OUT = T.StructType([T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known")] + [T.StructField(n, T.DoubleType()) for n in ("base_score", "score")])


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with n_tokens, n_known (tokens seen in training), base_score (add-one unigram) and score, both log10 of the text's probability.

    Perplexity is 10 ** (-score / n_tokens)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        reader = Reader.of(m)
        uniform, off = 1 / (m.words + 1), [np.array(d) for d in (m.word_discounts, m.pair_discounts, m.triple_discounts)]
        start = np.int64(m.words)

        def part(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            distinct, inverse = np.unique(hashes, return_inverse=True)
            ids, counts = reader.ids(distinct)
            base = np.log10((counts + 1) / (m.tokens + m.words + 1))
            known = ids >= 0
            sums = lambda x: np.add.reduceat(x, bounds[:-1])
            out = [np.diff(bounds), sums((counts > 0)[inverse].astype(np.int64)), sums(base[inverse])]
            word = np.full(len(ids), m.word_rest * uniform)
            if not m.pairs:
                return np.stack([*out, sums(np.log10(word[inverse]))])
            word[known] += _take_off(reader.followed(ids[known]), m.word_discounts) / m.pairs
            after = np.zeros((len(ids) + 1, 4), np.int64)  # of each word, and of the start mark
            after[:-1][known] = reader.successors(ids[known])
            after[-1] = reader.successors(np.array([start]))[0]
            before = np.empty(len(inverse), np.int64)  # the word before, as a place in `after`
            before[1:] = inverse[:-1]
            before[bounds[:-1]] = len(ids)
            p = word[inverse]
            keys = (np.append(ids, start)[before].astype(np.uint64) << _SHIFT) | ids[inverse].astype(np.uint64)
            whole = np.flatnonzero((np.append(ids, start)[before] >= 0) & known[inverse])
            seen, at = np.unique(keys[whole], return_inverse=True)
            n_before, follows, ranges, places = reader.pairs(seen)
            pair = np.full(len(keys), -1, np.int64)
            pair[whole] = at
            n = after[before, 0]
            taken = np.zeros(len(keys))
            taken[whole] = _take_off(n_before, m.pair_discounts)[at]
            p = np.where(n > 0, (taken + (after[:, 1:] @ off[1])[before] * p) / np.maximum(n, 1), p)
            # The pair that ends before a token is its context; a text's first token has none but the start mark.
            context = np.full(len(keys), -1, np.int64)
            context[1:] = pair[:-1]
            context[bounds[:-1]] = -1
            told = np.flatnonzero((context >= 0) & (follows[context, 0] > 0)) if len(seen) else np.zeros(0, np.int64)
            c = context[told]
            taken, sure = np.zeros(len(told)), known[inverse[told]]
            asked, back = np.unique((c[sure].astype(np.uint64) << _SHIFT) | ids[inverse[told[sure]]].astype(np.uint64), return_inverse=True)
            row = (asked >> _SHIFT).astype(np.int64)
            taken[sure] = _take_off(reader.triples(ranges[row], places[row], asked & _LOW), m.triple_discounts)[back]
            p[told] = (taken + (follows[c, 1:] @ off[2]) * p[told]) / follows[c, 0]
            return np.stack([*out, sums(np.log10(p))])

        def run(batch: pa.RecordBatch) -> list:
            x = np.concatenate([part(hashes, bounds) for _, _, hashes, bounds in _words(batch.column(0), SCORED_BYTES)], axis=1)
            return [x[0].astype(np.int64), x[1].astype(np.int64), x[2], x[3]]

        return run

    return add_columns(df, [text_col], _OUT, make)
