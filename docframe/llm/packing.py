"""Packing of token sequences by fitted few-document patterns (pattern packing by non-negative least squares).

Lengths are whole numbers up to `capacity`, so the whole problem is its
histogram of at most `capacity` counts, however many documents there are.  In
one task, all patterns of one to three lengths that fill a sequence exactly
are enumerated (for lengths that have none, the fullest), their repeat counts are
fitted to the histogram by non-negative least squares with an active set and
rounded, the largest first, as far as there are documents.  What rounding left
over is fitted again, until a fit places next to nothing; patterns that the
residue still fills come last.  What is left then is too short for three to fill a sequence, so the same is done for a half
of a sequence, a quarter and so on: blocks of these sizes stand one after another,
the larger ones first, and never cross a sequence's border.  The residue that no
pattern takes is packed best fit, longest first, many equal sequences at a time:
after each size of block what is too long for the next one, as long as there are
short documents to go with it.
The plan is a short list of ranges of ranks within each length; a document finds
its place from its length and its rank.

Cases: null or empty text is one document of the end id only; repeated rows
are packed once each; an empty table gives an empty result; other columns of
the input are ignored, so their names can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.llm.arrowmap import in_parts, release, shared_dir, to_arrow, written
from docframe.llm.wordbpe import WordBpe

CAPACITY = 4096
END_ID = 1
#: The fit: patterns join the active set this many times at most, each time its counts are gone through so often one by one and
#: so often together; it ends earlier once that lowers the sum of squares by less than this share.
ROUNDS = 40
SWEEPS = 2
STEPS = 150
GAIN = 0.005
#: What rounding leaves over is fitted again as long as this many more such fits would place it.
AGAIN = 16


@dataclass
class Plan:
    """Rows ascending by (length, rank): documents of `length` with ranks from `rank` on, `each` of them side by side at
    `place`, the next ones `stride` further; places count tokens over all sequences.  fitted: documents placed by rounded counts
    of the fit; filled: by patterns that the residue still filled."""

    capacity: int
    length: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    at: np.ndarray
    stride: np.ndarray
    sequences: int
    fitted: int
    filled: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of documents given by length and rank."""
        step = np.int64(1) << 48
        row = np.searchsorted(self.length * step + self.rank, length * step + rank, side="right") - 1
        nth = rank - self.rank[row]
        position = self.at[row] + nth // self.each[row] * self.stride[row] + nth % self.each[row] * length
        return position // self.capacity, position % self.capacity


def patterns(histogram: np.ndarray, target: int | None = None) -> np.ndarray:
    """Rows of three lengths (0: none), longest first, that add up to the target (the capacity) and occur in the histogram.

    Of whole sequences, lengths over half of them that are in no such row get their fullest pair and triple."""
    whole = not target or target == len(histogram) - 1
    target = target or len(histogram) - 1
    present = histogram[: target + 1] > 0
    present[0] = False
    lengths = np.flatnonzero(present)
    found = [np.array([[target, 0, 0]])] if target and present[target] else []
    a = lengths[(lengths * 2 >= target) & (lengths < target)]
    a = a[present[target - a]]
    found.append(np.stack([a, target - a, np.zeros_like(a)], 1))
    for a in lengths[lengths * 3 >= target]:
        b = lengths[(lengths <= a) & (2 * lengths >= target - a) & (lengths < target - a)]
        b = b[present[target - a - b]]
        found.append(np.stack([np.full_like(b, a), b, target - a - b], 1))
    if whole:
        covered = np.zeros(target + 1, bool)
        for rows in found:
            covered[rows[:, 0]] = True
        for a in lengths[(lengths * 2 > target) & ~covered[lengths]]:
            b = lengths[lengths <= target - a]
            if len(b):
                near = np.searchsorted(b, np.minimum(b, target - a - b), side="right") - 1
                c = np.where(near >= 0, b[near], 0)
                k = int(np.argmax(b + c))
                found.append(np.array([[a, b[-1], 0], [a, b[k], c[k]]])[: 2 if c[k] else 1])
    return np.concatenate(found).astype(np.int16 if target < 1 << 15 else np.int64)


def nnls(rows: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the tokens used, length by length, closest to those of the histogram: non-negative least
    squares on || W (A x - h) ||^2 with W the lengths over the longest, by an active set.

    The set starts with the patterns of one and two lengths; of all patterns, those with the steepest gradient among the ones of equal longest length join it. Its counts are
    fitted one by one, the longest first, which leaves most at nought, and then together by accelerated projected gradient;
    those at nought go again. So few patterns have a count (some one to four a length), and a count is seldom a small
    fraction, which rounding would lose."""
    x = np.zeros(len(rows))
    if not len(rows):
        return x
    weight = (np.arange(len(histogram)) / (len(histogram) - 1)) ** 2
    weight[0] = 0
    w = weight.tolist()
    over = histogram.astype(float)  # documents that the counts don't use yet
    order = np.argsort(rows[:, 0], kind="stable")
    by_longest = rows[order].astype(np.intp)
    firsts = np.flatnonzero(np.diff(by_longest[:, 0], prepend=-1))
    sizes = np.diff(firsts, append=len(rows))
    least, before = 1e-9 * float((weight * over).max()), np.inf
    short = np.flatnonzero(rows[:, 2] == 0)
    for nth in range(rounds):
        pull = weight * over
        gradient = pull[by_longest].sum(1)
        steepest = np.repeat(np.maximum.reduceat(gradient, firsts), sizes)
        hits = np.flatnonzero((gradient == steepest) & (gradient > least))
        joined = order[hits[np.diff(by_longest[hits, 0], prepend=-1) > 0]]
        active = np.union1d(joined, np.flatnonzero(x)) if nth or not len(short) else short
        if not len(active):
            break
        active = active[np.argsort(-rows[active, 0], kind="stable")]
        parts, counts, left = rows[active].tolist(), x[active].tolist(), over.tolist()
        squares = [sum(w[p] * three.count(p) ** 2 for p in set(three)) for three in parts]
        for _ in range(SWEEPS):
            for k, (a, b, c) in enumerate(parts):
                step = max((w[a] * left[a] + w[b] * left[b] + w[c] * left[c]) / squares[k], -counts[k])
                if step:
                    counts[k] += step
                    left[a] -= step
                    left[b] -= step
                    left[c] -= step
        x[active] = together(rows[active].astype(np.intp), np.array(counts), histogram, weight)
        over = histogram - used(rows[active], x[active], len(histogram))
        cost = float((weight * over * over).sum())
        if cost > before * (1 - GAIN):
            break
        before = cost
    return x


def used(rows: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Documents by length that counts x of patterns use."""
    return np.bincount(rows.ravel(), np.repeat(x, rows.shape[1]), n)


def together(rows: np.ndarray, x: np.ndarray, histogram: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Counts of the patterns given, from x on, by steps of accelerated projected gradient."""
    back = lambda over: (weight * over)[rows].sum(1)
    v = np.ones(len(rows))
    for _ in range(15):  # the largest eigenvalue, for the step
        v = back(used(rows, v / np.linalg.norm(v), len(weight)))
    step, y, t = 1 / (1.1 * np.linalg.norm(v)), x, 1.0
    for _ in range(STEPS):
        new = np.maximum(0, y + step * back(histogram - used(rows, y, len(weight))))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, x = new + (last - 1) / t * (new - x), new
    return x


def rounded(rows: np.ndarray, x: np.ndarray, left: np.ndarray) -> Iterator[tuple[list[int], int]]:
    """Patterns with their counts rounded to whole numbers, the largest first, as far as there are documents; `left` (documents
    by length) goes down as they are taken."""
    some = np.flatnonzero(x >= 0.5)
    for i in some[np.argsort(-x[some], kind="stable")].tolist():
        parts = [int(n) for n in rows[i] if n]
        n = min(int(x[i] + 0.5), *(int(left[p]) // parts.count(p) for p in parts))
        if n > 0:
            for p in parts:
                left[p] -= n
            yield parts, n


def residual(rows: np.ndarray, x: np.ndarray, left: np.ndarray, chunk: int = 8192) -> Iterator[tuple[list[int], int]]:
    """Patterns that what rounding left over still fills, the longest document first and in the order of x."""
    order = np.lexsort((-x, -rows[:, 0]))
    for at in range(0, len(order), chunk):
        some = order[at : at + chunk]
        for i in some[((left[rows[some]] > 0) | (rows[some] == 0)).all(1)].tolist():
            parts = [int(n) for n in rows[i] if n]
            n = min(int(left[p]) // parts.count(p) for p in parts)
            if n > 0:
                for p in parts:
                    left[p] -= n
                yield parts, n


def make_plan(histogram: np.ndarray) -> Plan:
    """The plan of a histogram (index: length) of documents."""
    histogram = histogram.astype(np.int64)
    capacity = len(histogram) - 1
    left, taken = histogram.copy(), np.zeros_like(histogram)
    steps: list[tuple[int, int, int, int, int]] = []
    end = 0  # tokens of all blocks so far

    def put(length: int, n: int, each: int, at: int, stride: int) -> None:
        steps.append((length, int(taken[length]), each, at, stride))
        taken[length] += n

    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by tokens left: (first sequence, number)

    def best_fit(opens: int) -> None:
        """Documents into the fullest sequences that take them, longest first; those of at least `opens` tokens may open new ones."""
        nonlocal end
        for length in range(capacity, 0, -1):
            free = length
            while left[length]:
                n = int(left[length])
                while free <= capacity and not room[free]:
                    free += 1
                if free <= capacity:
                    first, many = room[free].pop()
                    each, used = free // length, capacity - free
                elif length >= opens:
                    if end % capacity:
                        room[capacity - end % capacity].append((end // capacity, 1))
                        end += -end % capacity
                        free = length
                        continue
                    each, used = capacity // length, 0
                    first, many = end // capacity, -(-n // each)
                    end += many * capacity
                else:
                    break
                full = min(many, n // each)
                if full:
                    put(length, full * each, each, first * capacity + used, capacity)
                    left[length] -= full * each
                    room[capacity - used - each * length].append((first, full))
                    first, many, n = first + full, many - full, n - full * each
                if many and 0 < n < each:
                    put(length, n, n, first * capacity + used, capacity)
                    left[length] -= n
                    room[capacity - used - n * length].append((first, 1))
                    first, many, n = first + 1, many - 1, 0
                if many:
                    room[capacity - used].append((first, many))

    def blocks(target: int, found: Iterator[tuple[list[int], int]]) -> int:
        """Blocks of patterns, one after another; the number of documents in them."""
        nonlocal end
        documents = 0
        for parts, n in found:
            inner = 0
            for p in parts:
                put(p, n, 1, end + inner, target)
                inner += p
            if inner < target:
                room[target - inner].append((end // capacity, n))
            end += n * target
            documents += n * len(parts)
        return documents

    target, fitted, filled = capacity, 0, 0
    while left.any():
        placed = left.sum()
        while placed * AGAIN >= left.sum() > 0:
            rows = patterns(left, target)
            x = nnls(rows, left[: target + 1])
            placed = blocks(target, rounded(rows, x, left))
            fitted += placed
        filled += blocks(target, residual(rows, x, left))
        # What is too long for the shorter blocks is residue; it comes before them, as they would use up what goes with it.
        best_fit(0 if target % 2 else target // 2 + 1)
        if target % 2:
            break
        target //= 2
    steps.sort()
    columns = [np.array(x, np.int64) for x in zip(*steps, strict=True)] if steps else [np.zeros(0, np.int64)] * 5
    return Plan(capacity, *columns, -(-end // capacity), fitted, filled)


def _planned(counts: DataFrame, capacity: int) -> Plan:
    """As make_plan(), in a task: the patterns take some hundred megabytes, which the driver needs not have. counts: length and
    number of documents, at most `capacity` rows; the plan's rows come to the driver."""
    columns = ["length", "rank", "each", "at", "stride", "sequences", "fitted", "filled"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        histogram = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            histogram[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
        plan = make_plan(histogram)
        n = len(plan.length)
        made = [plan.length, plan.rank, plan.each, plan.at, plan.stride, *(np.full(n, x, np.int64) for x in (plan.sequences, plan.fitted, plan.filled))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=columns)
        del plan, made
        release()

    made = counts.repartition(1).mapInArrow(work, ", ".join(f"{c} long" for c in columns)).toArrow().sort_by([("length", "ascending"), ("rank", "ascending")])
    found = [made[c].to_numpy() for c in columns]
    return Plan(capacity, *found[:5], *(int(x[0]) if len(x) else 0 for x in found[5:]))


def pieces(df: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece of at most `capacity` ids: id, piece, start, length, ids_crc32, and for ranking the task and
    the number of pieces of that length before it in the task."""
    out = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("piece", T.IntegerType())] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "task", "nth")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, schema, seen, task = WordBpe(tokenizer), to_arrow(out), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in in_parts(batches):
            ids, counts = encoder.encode(batch.column(1))
            ends = np.cumsum(counts)
            made: list[list] = [[] for _ in range(4)]
            parents = []
            for i, (end, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                own = np.append(ids[end - n : end], end_id).astype("<u4")
                for k, start in enumerate(range(0, n + 1, capacity)):
                    part = own[start : start + capacity]
                    parents.append(i)
                    for column, value in zip(made, (k, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(value)
            length = np.array(made[2], np.int64)
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            nth = np.empty(len(length), np.int64)
            nth[order] = seen[ranked] + np.arange(len(ranked)) - np.searchsorted(ranked, ranked)
            seen += np.bincount(length, minlength=capacity + 1)
            columns = [batch.column(0).take(pa.array(parents, pa.int64())), *(pa.array(x, f.type) for x, f in zip([*made, np.full(len(length), task), nth], list(schema)[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            del batch, ids, counts, ends, made, parents, length, order, ranked, nth, columns
        del encoder
        release()

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(work, out)


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    The texts are read once; the small table of pieces is written to the
    shared folder, so lost executors cost a task's work at most, and later
    steps move some tens of bytes a piece.
    """
    spark = df.sparkSession
    rows = written(pieces(df, tokenizer, id_col, text_col, capacity, end_id), shared_dir(spark), "pieces")
    by_task = rows.groupBy("task", "length").agg(F.count("*").alias("n"))
    plan = spark.sparkContext.broadcast(_planned(by_task.groupBy("length").agg(F.sum("n").alias("n")), capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rows.join(base, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    out = T.StructType([*ranked.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow(out)
        for batch in batches:
            sequence, offset = plan.value.place(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], schema=schema)

    return ranked.mapInArrow(work, out)
