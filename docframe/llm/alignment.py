"""Alignment of two tokenizers' tokens by the bytes at which they end.

Tokenizer A is a byte-level BPE that gets a space and the text, B a piece model
that adds the space itself, so both spell the same bytes.  Within a slice of
texts the tokens' ends are running sums of their lengths; the ends that both
have (intersect1d) cut them into groups, searchsorted gives each token's group,
and repeats expand the tokens of A and of B that end together into links.  A
token stands for at least a byte, so links are no more than groups; an end that
several tokens have (of no bytes) would link each with each.

Pairs of ids: of two tokens that end together one is an end of the other's
bytes, so the pairs that can be linked follow from the vocabularies alone
(`Pairs`, some hundred thousand whatever the corpus).  The table of counts is
therefore bounded, and is broadcast.

1. Texts are encoded and aligned once and written: counts, the groups' digest,
   and the links as numbers of pairs.
2. Tasks count the pairs of the written links, a row for each pair and task;
   these are added up by (pair, salt), then by pair.
3. Each document's links are looked up in the counts.

Cases: texts that are null, empty, or whose tokens of A or B don't spell the
space and the text (a literal space mark, for one) have no tokens: all numbers
are 0 and the digest is ''.  Repeated rows and null ids count like all others;
of pairs that are linked as often, all are a B id's best.  Columns that aren't
in `keep` are dropped, so their names can't clash; of those the operator's own
names are refused.  An empty table stays empty.  Texts are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.llm.arrowmap import list_array, release, shared_dir, to_arrow, written
from docframe.llm.bytebpe import ByteBpe
from docframe.llm.piecebpe import PieceBpe
from docframe.llm.textbytes import ragged, slices, text_bytes

#: Bytes of text that are aligned at once.
SLICE = 1 << 20
#: Words that each encoder of a task remembers.
CACHE = 250_000
#: Parts into which the counts of a pair are dealt first.
SALTS = 16

ALIGNED = [("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType())]
COUNTED = ["n_best", "count_sum"]


class Aligned:
    """Groups and links of the tokens of texts whose bytes both tokenizers spell alike.

    lengths: bytes of each token; rows: the texts' numbers, ascending."""

    def __init__(self, length_a: np.ndarray, row_a: np.ndarray, length_b: np.ndarray, row_b: np.ndarray):
        # A place for the border of each text, so that no end of one text equals an end of another.
        end_a, end_b = np.cumsum(length_a) + row_a, np.cumsum(length_b) + row_b
        cuts = np.intersect1d(_once(end_a), _once(end_b), assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        self.row_of_group = row_a[np.searchsorted(end_a, cuts)] if len(cuts) else np.zeros(0, np.int64)
        last_a, last_b = self._at(cuts, end_a, self.group_a), self._at(cuts, end_b, self.group_b)
        of_a, of_b = self.group_a[last_a], self.group_b[last_b]
        many_b = np.bincount(of_b, minlength=len(cuts))
        each = many_b[of_a]
        #: Places of the linked tokens.
        self.link_a = np.repeat(last_a, each)
        self.link_b = last_b[ragged((np.cumsum(many_b) - many_b)[of_a], each)]

    @staticmethod
    def _at(cuts: np.ndarray, ends: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Places of the tokens that end at a cut."""
        inside = group < len(cuts)
        hit = np.zeros(len(ends), bool)
        hit[inside] = cuts[group[inside]] == ends[inside]
        return np.flatnonzero(hit)


def _once(ends: np.ndarray) -> np.ndarray:
    """Distinct values of ascending ones."""
    return ends[np.concatenate([[True], ends[1:] != ends[:-1]])] if len(ends) else ends


class Digits:
    """Decimal ids with a mark after each."""

    def __init__(self, most: int):
        made = [f"{i},".encode() for i in range(most)]
        self.bytes = np.frombuffer(b"".join(made), np.uint8)
        self.lengths = np.array([len(x) for x in made], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def text(self, ids_a: np.ndarray, ids_b: np.ndarray, found: Aligned, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """`a,a|b;a|b,b;` of each text, end to end, and the bounds of the texts."""
        groups = len(found.row_of_group)
        many_a, many_b = np.bincount(found.group_a, minlength=groups), np.bincount(found.group_b, minlength=groups)
        before_a, before_b = np.cumsum(many_a), np.cumsum(many_b) - many_b
        ids = np.empty(len(ids_a) + len(ids_b), np.int64)
        ids[np.arange(len(ids_a)) + before_b[found.group_a]] = ids_a
        ids[np.arange(len(ids_b)) + before_a[found.group_b]] = ids_b
        sizes = self.lengths[ids]
        out = self.bytes[ragged(self.starts[ids], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        done_b = np.cumsum(many_a + many_b)
        out[ends[done_b - many_b] - 1] = ord("|")
        out[ends[done_b] - 1] = ord(";")
        of_row = np.searchsorted(found.row_of_group, np.arange(rows + 1))
        return out, ends[np.concatenate([[0], done_b])[of_row]]


class Pairs:
    """All pairs of ids that can end together, as ascending keys; a pair's number is its place."""

    def __init__(self, tokens_a: list[bytes], tokens_b: list[bytes]):
        self.width = len(tokens_b)
        keys: set[int] = set()
        of_a, of_b = _by_bytes(tokens_a), _by_bytes(tokens_b)
        for one, other, left in ((of_a, of_b, True), (of_b, of_a, False)):
            for text, ids in one.items():
                for k in range(len(text)):
                    for j in other.get(text[k:], ()):
                        keys.update(i * self.width + j if left else j * self.width + i for i in ids)
        self.keys = np.array(sorted(keys), np.int64)
        # An open table of the keys' numbers, a quarter full at most: a step of a look-up is two gathers for all pairs at once.
        self.bits = max(4, int(4 * len(self.keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(self.keys), dtype=np.int32)
        at = self._slot(self.keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        at = self._slot(key)
        found = self.slots[at]
        wrong = np.flatnonzero((found < 0) | (self.keys[found] != key)) if len(self.keys) else np.arange(len(key))
        while len(wrong):
            if not len(self.keys) or (found[wrong] < 0).any():
                raise ValueError("tokens that end together without one being an end of the other")
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            found[wrong] = self.slots[at[wrong]]
            wrong = wrong[(found[wrong] < 0) | (self.keys[found[wrong]] != key[wrong])]
        return found

    @property
    def of_b(self) -> np.ndarray:
        return self.keys % self.width


def _by_bytes(tokens: list[bytes]) -> dict[bytes, list[int]]:
    found: dict[bytes, list[int]] = {}
    for i, t in enumerate(tokens):
        if t:
            found.setdefault(t, []).append(i)
    return found


class Both:
    """The two encoders of a task."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteBpe(path_a, CACHE), PieceBpe(path_b, CACHE)
        self.spelt = [_Bytes(self.a.tokens), _Bytes(self.b.pieces)]
        self.digits = Digits(max(len(self.a.tokens), len(self.b.pieces)))

    def align(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[Aligned, list[np.ndarray], list[np.ndarray]]:
        """A slice of texts: groups and links, the ids of A and B and their texts, of texts that both spell alike."""
        size = np.diff(offsets)
        lead = size > 0
        bounds = np.concatenate([[0], np.cumsum(size + lead)])
        data = np.full(int(bounds[-1]), 0x20, np.uint8)
        data[np.arange(len(raw)) + np.repeat(np.cumsum(lead), size)] = raw
        coded = [self.a.encode_slice(data, bounds), self.b.encode_slice(raw, offsets)]
        good = lead.copy()
        for spelt, (ids, counts) in zip(self.spelt, coded, strict=True):
            good &= spelt.equal(ids, counts, data, bounds)
        ids, rows = [], []
        for x, counts in coded:
            row = np.repeat(np.arange(len(counts)), counts)
            keep = good[row]
            ids.append(x[keep] if not keep.all() else x)
            rows.append(row[keep] if not keep.all() else row)
        lengths = [s.lengths[x] for s, x in zip(self.spelt, ids, strict=True)]
        return Aligned(lengths[0], rows[0], lengths[1], rows[1]), ids, rows


class _Bytes:
    """What the ids of a vocabulary spell."""

    def __init__(self, tokens: list[bytes]):
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def equal(self, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Whether the ids of each row spell the row's bytes."""
        sizes = self.lengths[ids]
        made = self.bytes[ragged(self.starts[ids], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        if np.array_equal(ends, bounds):
            wrong = np.flatnonzero(made != data)
            out = np.ones(len(counts), bool)
            out[np.searchsorted(bounds, wrong, side="right") - 1] = False
            return out
        return np.array([np.array_equal(made[a:b], data[c:d]) for a, b, c, d in zip(ends[:-1], ends[1:], bounds[:-1], bounds[1:], strict=True)], bool)


def align(df: DataFrame, path_a: str, path_b: str, pairs: Pairs, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), groups: bool = False) -> DataFrame:
    """keep, n_a, n_b, n_groups, n_links, groups_sha256 and links (numbers in `pairs`) of each row; with groups=True
    the text of the groups as well.  A row out for each row in, no shuffle."""
    spark = df.sparkSession
    own = [T.StructField(c, t) for c, t in ALIGNED] + [T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.ArrayType(T.IntegerType()))]
    own += [T.StructField("groups", T.StringType())] * groups
    if clash := {f.name for f in own}.union(COUNTED) & set(keep):
        raise ValueError(f"names that the alignment makes itself: {sorted(clash)}")
    schema = T.StructType([df.schema[c] for c in keep] + own)
    sent = spark.sparkContext.broadcast(pairs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, kinds, known = None, to_arrow(schema), sent.value
        for batch in batches:
            coder = coder or Both(path_a, path_b)
            buf, offsets = text_bytes(batch.column(len(keep)))
            for i, j in slices(offsets, SLICE):
                n = j - i
                found, (a, b), (row_a, row_b) = coder.align(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                text, bounds = coder.digits.text(a, b, found, n)
                view = memoryview(np.ascontiguousarray(text))
                spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                row_of_link = row_a[found.link_a]
                many = [np.bincount(x, minlength=n) for x in (row_a, row_b, found.row_of_group, row_of_link)]
                numbers = known.numbers(a[found.link_a], b[found.link_b])
                made = [pa.array(x, pa.int64()) for x in many] + [pa.array([hashlib.sha256(view[x : y - 1]).hexdigest() if y > x else "" for x, y in spans], pa.string()), list_array(numbers, many[3], pa.int32())]
                if groups:
                    made.append(pa.array([bytes(view[x : max(x, y - 1)]).decode() for x, y in spans], pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(i, n) for k in range(len(keep))] + made, schema=kinds)
            del buf, batch
            release()

    # The text goes last and under a name of its own, so that it may be kept as well.
    return df.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(work, schema)


def pair_counts(aligned: DataFrame, pairs: Pairs, salts: int = SALTS) -> DataFrame:
    """(pair, links): how often each pair is linked in the column `links`."""
    size = len(pairs.keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            total = np.zeros(size, np.int64) if total is None else total
            total += np.bincount(np.asarray(batch.column(0).flatten()), minlength=size)
        if total is not None:
            at = np.flatnonzero(total)
            salt = TaskContext.get().partitionId() % salts
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), salt)), pa.array(total[at])], names=["pair", "salt", "links"])

    seen = aligned.select("links").mapInArrow(work, "pair long, salt long, links long")
    return seen.groupBy("pair", "salt").agg(F.sum("links").alias("links")).groupBy("pair").agg(F.sum("links").alias("links"))


def linked(df: DataFrame, path_a: str, path_b: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_a, n_b, n_groups, n_links, groups_sha256, and of each row's links n_best (those whose pair is linked
    as often in the whole table as any pair of its B id) and count_sum (the sum of their pairs' counts)."""
    spark = df.sparkSession
    pairs = Pairs(ByteBpe(path_a).tokens, PieceBpe(path_b).pieces)
    aligned = written(align(df, path_a, path_b, pairs, text_col, keep), shared_dir(spark), "aligned")
    counts = np.zeros(len(pairs.keys), np.int64)
    for row in pair_counts(aligned, pairs).toLocalIterator():  # at most as many rows as the vocabularies have pairs
        counts[row["pair"]] = row["links"]
    best = np.zeros(pairs.width, np.int64)
    np.maximum.at(best, pairs.of_b, counts)
    sent = spark.sparkContext.broadcast((counts, counts == best[pairs.of_b]))
    names = [*keep, *[c for c, _ in ALIGNED], "groups_sha256"]
    schema = T.StructType([aligned.schema[c] for c in names] + [T.StructField(c, T.LongType()) for c in COUNTED])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, is_best = sent.value
        for batch in batches:
            links = batch.column(len(names))
            number = np.asarray(links.flatten())
            bounds = np.concatenate([[0], np.cumsum(np.asarray(batch.column(names.index("n_links"))))])
            made = [pa.array(np.diff(np.concatenate([[0], np.cumsum(x[number])])[bounds]).astype(np.int64)) for x in (is_best, count)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + made, schema=to_arrow(schema))

    return aligned.select(*names, "links").mapInArrow(work, schema)
