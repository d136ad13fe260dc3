"""Similarity join of documents by word n-grams, with adaptive multi-match prefixes.

A document's set is its distinct 5-word shingles (with fewer words the whole
sequence as one); two documents link if their Jaccard similarity is at least
0.8.  The result is each document's class: the least id that links reach.

1. One pass takes each set's size and fingerprint, and counts all shingles in a
   table of CELLS counters, merged in a tree.  The counters' classes (a byte
   each) are broadcast: they put all shingles in one order, rarest class first,
   by hash within a class.  Any order gives the same result; this one keeps
   passages that many documents share out of the prefixes.
2. Prefixes.  Of a set of n, a partner shares T = ceil(0.8 n) at least, so the
   first shingle that both share is among the first n - T + 1 of either, and at
   least `need` shared ones are among the first n - T + need.  For each document
   the need is chosen that costs least by the counters: what its partners cost
   if prefixes of that length are compared, and what is left to be compared in
   full (a partner is met by each shared shingle, but counted once in `need`).
3. Copies are one class by their fingerprint from here on.  The first n - T + 1
   shingles are the keys of a join.  A key of two members is one pair, known from
   the aggregate alone; up to SMALL members meet in pairs, as the sizes and the
   places of the key allow; of larger keys a member meets only a star's centre.
4. A candidate pair is verified if its odd sketches allow a link and the prefixes
   share the lesser of both needs; the full sets decide.  Links are merged into
   components.
5. Large keys whose members are in several components, and whose sizes and places
   still allow a link between two of them, get a new centre round by round (each
   member is tried with the nearest one).  Once a round finds few links, members
   outside a key's largest component meet the members of other components and of
   similar size in a join, under the same bounds and that of odd sketches; none
   of these bounds loses a link.  Work is then the product of both, within a key
   and a class of sizes, spread by Spark's skew join.

Cases: null and empty texts (or of white space) have an empty set and are linked
with nothing; repeated rows of one id are one document each time it is listed
(they share the component); rows with a null id get a null component and link
nothing; an empty table gives an empty result; other columns are ignored, so
their names can't clash.  Texts are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.llm.arrowmap import counted, drop_dir, in_parts, list_array, release, shared_dir, to_arrow, written
from docframe.llm.neardup import SKETCH, _merged, _set_arrays, _with_suffix, checked, shingles, together
from docframe.llm.store import grow, shrink

#: Similarity of at least 80 / 100.
LEAST = (80, 100)
#: Counters of shingles, a power of two.
CELLS = 1 << 23
#: Counters that are packed and added up at once.
BLOCK = 1 << 18
#: Classes of counters to the octave.
STEPS = 8
#: A prefix is lengthened by at most so many shingles less one.
NEED = 16
#: Neighbouring classes of sizes hold all sets that can link: more than 100 / 80 by a margin for rounding.
SIZES = 1.27
#: Stars are drawn anew until a round finds less than one link for so many members; this decides on cost only.
SETTLED = 1000
#: Keys of at most so many members are compared pair by pair; this decides on cost only.
SMALL = 16
DEPTH = 4
#: Sets whose sketches are broadcast at most, some MB.
SKETCHES = 20_000
#: Bits of a sum of sizes, below the number of members.
_SUM = 40


def required(n):
    """Shingles that a set of n shares with any partner at least (a number or a column)."""
    return F.ceil(n * LEAST[0] / LEAST[1]).cast("int") if isinstance(n, Column) else -(-LEAST[0] * n // LEAST[1])


def _levels(counts: np.ndarray) -> np.ndarray:
    """The counters' classes, made in blocks to keep what is held small."""
    out = np.empty(len(counts), np.uint8)
    for i in range(0, len(out), 1 << 18):
        out[i : i + (1 << 18)] = np.minimum(255, np.round(STEPS * np.log2(1.0 + counts[i : i + (1 << 18)])))
    return out


class Prefixes:
    """Cuts sets into prefixes by the classes of the counters."""

    def __init__(self, levels: np.ndarray, mean: float):
        self.levels = levels
        #: Documents beyond the first that have a shingle of each class, by estimate: what a counter holds by chance isn't counted.
        self.others = np.maximum(0.0, 2.0 ** (np.arange(256) / STEPS) - 1 - max(1.0, mean + 3 * mean**0.5))

    def cut(self, hashes: np.ndarray) -> tuple[np.ndarray, int, int]:
        """The prefix of a set (ascending distinct hashes), the number of its keys, and the need."""
        n = len(hashes)
        level = self.levels[(hashes & np.uint64(len(self.levels) - 1)).astype(np.int64)]
        order = np.argsort(level, kind="stable")
        least = required(n)
        keys = n - least + 1
        most = min(NEED, least)
        met = np.cumsum(self.others[level[order[: keys - 1 + most]]])
        needs = np.arange(1, most + 1)
        cost = met[keys - 1] * (keys - 1 + needs) + n * met[keys - 1 :] / needs
        need = int(cost.argmin()) + 1
        return hashes[order[: keys - 1 + need]], keys, need


def _marked(df: DataFrame, cells: int) -> DataFrame:
    """_id, n_shingles and _print of each row, and a row a task with the shingles that it has counted in cells."""
    schema = T.StructType([df.schema["_id"], T.StructField("n_shingles", T.LongType()), T.StructField("_print", T.BinaryType()), T.StructField("_cells", T.ArrayType(T.BinaryType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        kinds, total = to_arrow(schema), None
        for batch in in_parts(batches):
            sets = shingles(batch.column(1))
            prints = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
            total = np.zeros(cells, np.uint32) if total is None else total
            np.add.at(total, (np.concatenate([np.zeros(0, np.uint64), *sets]) & np.uint64(cells - 1)).astype(np.int64), np.uint32(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), prints, pa.nulls(len(sets), kinds[3].type)], schema=kinds)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kinds[0].type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([_blocks(total)], kinds[3].type)], schema=kinds)
        del total
        release()

    return df.select("_id", "_text").mapInArrow(work, schema)


def _small(counts: np.ndarray) -> bytes:
    """Counters as compressed bytes, in 4 bytes each as long as sums of two can't be larger, then in 8."""
    if counts.dtype == np.uint32 and counts.max(initial=0) < 1 << 31:
        return b"4" + shrink(counts)
    return b"8" + shrink(counts.astype(np.uint64))


def _large(blob: bytes) -> np.ndarray:
    return grow(blob[1:], np.uint32 if blob[:1] == b"4" else np.uint64)


def _blocks(counts: np.ndarray) -> list[bytes]:
    """Counters in packed blocks, so that adding up two tables never holds a whole one."""
    return [_small(counts[i : i + BLOCK]) for i in range(0, len(counts), BLOCK)]


def _sum(a: list[bytes], b: list[bytes]) -> list[bytes]:
    return [_small(_large(x) + _large(y)) for x, y in zip(a, b, strict=True)]


def _counters(marked: DataFrame, cells: int) -> np.ndarray:
    """The counters of all tasks; a partial result is a few MB, whatever the input."""
    add = lambda a, b: b if a is None else a if b is None else _sum(a, b)
    total = marked.where("_cells is not null").select("_cells").rdd.map(lambda r: [bytes(x) for x in r[0]]).treeAggregate(None, add, add, depth=DEPTH)
    out = np.zeros(cells, np.uint64 if total and any(x[:1] == b"8" for x in total) else np.uint32)
    at = 0
    for block in map(_large, total or []):
        out[at : at + len(block)] = block
        at += len(block)
    return out


def _cut(df: DataFrame, prefixes) -> DataFrame:
    """_id, _print, n, need, _prefix and _first (the number of keys) of each row with a set."""
    schema = T.StructType([df.schema["_id"], *[T.StructField(c, t) for c, t in (("_print", T.BinaryType()), ("n", T.IntegerType()), ("need", T.IntegerType()), ("_first", T.IntegerType()), ("_prefix", T.ArrayType(T.LongType())))]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        kinds, cutter = to_arrow(schema), prefixes.value
        for batch in in_parts(batches):
            sets = shingles(batch.column(1))
            full = [i for i, s in enumerate(sets) if len(s)]
            made = [cutter.cut(sets[i]) for i in full]
            hashes = np.concatenate([np.zeros(0, np.uint64), *[m[0] for m in made]]).view(np.int64)
            arrays = [batch.column(0).take(pa.array(full, pa.int64())), pa.array([xxhash.xxh3_128_digest(sets[i].tobytes()) for i in full], pa.binary())]
            arrays += [pa.array([len(sets[i]) for i in full], pa.int32()), pa.array([m[2] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.int32())]
            yield pa.RecordBatch.from_arrays([*arrays, list_array(hashes, np.array([len(m[0]) for m in made], np.int64), pa.int64())], schema=kinds)
        release()

    return df.select("_id", "_text").mapInArrow(work, schema)


def _overlap(n, m):
    """Shingles that two sets of these sizes share at least, if they link (columns)."""
    return F.ceil((n + m) * LEAST[0] / (LEAST[0] + LEAST[1])).cast("int")


def _allowed(other: str):
    """What holds for a linked pair at the first key that it shares: room is the number of a set's shingles from the
    key on in the common order, all that can still be shared."""
    return _overlap(F.col("n"), F.col(f"n{other}")) <= F.least("room", f"room{other}")


def _similar(one: str, other: str):
    """What holds for every linked pair, from sizes and odd sketches; and the sketches' distance."""
    n, m = F.col(f"n{one}"), F.col(f"n{other}")
    apart = sum((F.bit_count(F.col(c + one).bitwiseXOR(F.col(c + other))) for c in SKETCH), F.lit(0))
    sizes = F.least(n, m) * LEAST[1] >= F.greatest(n, m) * LEAST[0]
    return sizes & (apart * (LEAST[1] + LEAST[0]) <= (n + m) * (LEAST[1] - LEAST[0])), apart


def _both(pairs: DataFrame, table: DataFrame, ids: int, *columns: str) -> DataFrame:
    """pairs (a, b) with the columns of both from a table by _id; only the rows that they name are moved."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
    needed = table.select("_id", *columns).join(checked(named, ids), "_id", "left_semi")
    if ids <= SKETCHES and set(columns) <= {"n", *SKETCH}:
        needed = F.broadcast(needed)
    for side in ("a", "b"):
        pairs = pairs.join(needed.select(F.col("_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


def _confirmed(candidates: DataFrame, about: DataFrame, prefixes: DataFrame, sets: DataFrame, folder: str, tag: str) -> tuple[DataFrame, int]:
    """Candidate pairs that link, and their number: those whose sketches allow it and whose prefixes share enough are compared in full."""
    candidates, tried = counted(candidates, folder, f"candidates-{tag}", n=F.count(F.lit(1)))
    candidates = together(candidates, tried["n"])
    near = _both(candidates, about, 2 * tried["n"], "n", *SKETCH)
    near, left = counted(near.where(_similar("_a", "_b")[0]).select("a", "b").distinct(), folder, f"near-{tag}", n=F.count(F.lit(1)))
    match = _both(together(near, left["n"]), prefixes, 2 * left["n"], "_prefix", "need")
    enough = F.size(F.array_intersect("_prefix_a", "_prefix_b")) >= F.least("need_a", "need_b")
    match, kept = counted(match.where(enough).select("a", "b").distinct(), folder, f"matched-{tag}", n=F.count(F.lit(1)))
    full = _both(together(match, kept["n"]), sets, 2 * kept["n"], "_set")
    same = F.size(F.array_intersect("_set_a", "_set_b"))
    linked = same * LEAST[1] >= (F.size("_set_a") + F.size("_set_b") - same) * LEAST[0]
    links, found = counted(full.where(linked).select("a", "b").distinct(), folder, f"links-{tag}", n=F.count(F.lit(1)))
    return links, found["n"]


def _open(members: DataFrame, roots: DataFrame | None, folder: str, tag: str) -> DataFrame:
    """Members, with their roots, of the keys that join several components, without those that no member of their key can link with."""
    if roots is None:
        rows = members.withColumn("root", F.col("id"))
    else:
        rows = members.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    about = rows.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.min("n").alias("_least"), F.max("room").alias("_most")).where("_low <> _high")
    several, found = counted(about.select("key", "_least", "_most"), folder, f"several-{tag}", n=F.count(F.lit(1)))
    return rows.join(checked(several, found["n"]), "key").where(_possible()).select("key", "id", "n", "room", "root")


def _possible():
    """Whether a member can link with any other of its key, by the key's least size and most room."""
    least = F.greatest(F.col("_least"), required(F.col("n")))
    return _overlap(F.col("n"), least) <= F.least("room", "_most")


def _links(docs: DataFrame, cut: DataFrame, folder: str, repeated: bool) -> DataFrame | None:
    """(node, root) of all ids that are linked with another one. repeated: some ids have a set several times."""
    rows = cut.select(F.col("_id").alias("id"), "n", F.posexplode(F.slice("_prefix", F.lit(1), F.col("_first"))).alias("_at", "key")).select("key", "id", "n", (F.col("n") - F.col("_at")).alias("room"))
    # A key of two members is a pair, and all that its bound needs comes with the aggregate, the number of members above the sum of sizes.
    sums = (F.min("id").alias("centre"), F.max("id").alias("_far"), F.sum(F.col("n") + F.lit(1 << _SUM)).alias("_sum"), F.min("room").alias("_room"))
    keys = written(rows.groupBy("key").agg(*sums).where("centre <> _far").withColumn("size", F.shiftright("_sum", _SUM)), folder, "keys")
    sizes = F.col("_sum").bitwiseAND(F.lit((1 << _SUM) - 1))
    twos = keys.where((F.col("size") == 2) & (_overlap(sizes, 0) <= F.col("_room"))).select(F.col("centre").alias("a"), F.col("_far").alias("b"))
    more, many = counted(keys.where("size > 2").select("key", "centre", "size"), folder, "more", n=F.count(F.lit(1)))
    members = written(rows.join(checked(more, many["n"]), "key").select("key", "id", "n", "room", "centre", "size"), folder, "members")
    # Keys of some members more: pairs, in proportion to the members.
    few = members.where(F.col("size") <= SMALL).select("key", "id", "n", "room")
    few = few.join(_with_suffix(few, "_o", "key"), "key").where((F.col("id") < F.col("id_o")) & _allowed("_o")).select(F.col("id").alias("a"), F.col("id_o").alias("b"))
    # All others: the first stars. A member is tried with the centre, the least id, that it shares most keys with.
    members = members.where(F.col("size") > SMALL)
    shared = members.where("id <> centre").groupBy("id", "centre").agg(F.count(F.lit(1)).alias("keys"))
    stars = shared.groupBy("id").agg(F.max(F.struct("keys", "centre")).alias("best")).select(F.col("best.centre").alias("a"), F.col("id").alias("b"))
    members = members.drop("centre", "size")
    candidates, seen = counted(twos.unionByName(few).unionByName(stars).distinct(), folder, "first", n=F.count(F.lit(1)))
    if not seen["n"]:
        return None
    met = candidates.select(F.explode(F.array("a", "b")).alias("_id")).unionByName(members.select(F.col("id").alias("_id")))
    met, several = counted(met.distinct(), folder, "met", n=F.count(F.lit(1)))
    prefixes = written(cut.select("_id", "_prefix", "need").join(checked(met, several["n"]), "_id", "left_semi"), folder, "prefixes")
    sets = _set_arrays(docs.join(checked(met, several["n"]), "_id", "left_semi"), "_text").where(F.size("_set") > 0)
    if repeated:
        sets = sets.withColumn("_h", F.xxhash64("_set")).dropDuplicates(["_id", "_h"])
    sets = written(sets.select("_id", F.size("_set").alias("n"), "_set", *SKETCH), folder, "sets")
    tables = sets.select("_id", "n", *SKETCH), prefixes, sets
    about = sets.select(F.col("_id").alias("id"), "n", *SKETCH)
    merged, step = None, 1
    while True:
        links, found = _confirmed(candidates, *tables, folder, str(step))
        if found:
            merged = _merged(merged, links, found, folder, f"round-{step}")
        roots = merged and merged[0]
        step += 1
        still, left = counted(_open(members, roots, folder, str(step)), folder, f"left-{step}", n=F.count(F.lit(1)))
        if not left["n"]:
            return roots
        members = still.drop("root")
        # An id that is listed with several texts has several sets and sizes: a member goes with its own.
        placed = still.join(about, ["id", "n"])
        if step > 2 and found * SETTLED < left["n"]:
            break
        # Another star in each key: a member is tried with the nearest centre of its keys, by the sketches.
        drawn = still.groupBy("key").agg(F.min_by(F.struct("id", "n", "room", "root"), F.xxhash64("key", "id", F.lit(step))).alias("c")).select("key", "c.*")
        similar, apart = _similar("", "_c")
        pairs = placed.join(_with_suffix(drawn.join(about, ["id", "n"]), "_c", "key"), "key").where((F.col("root") != F.col("root_c")) & _allowed("_c") & similar)
        nearest = pairs.groupBy("id").agg(F.min(F.struct(apart.alias("apart"), F.col("id_c"))).alias("best"))
        candidates = nearest.select(F.col("best.id_c").alias("a"), F.col("id").alias("b"))
    # What is left: members outside a key's largest component, with every member of another component.
    most = still.groupBy("key", "root").agg(F.count(F.lit(1)).alias("many")).groupBy("key").agg(F.max(F.struct("many", "root")).alias("_m"))
    rest = written(placed.join(most.select("key", F.col("_m.root").alias("main")), "key").withColumn("class", F.floor(F.log("n") / math.log(SIZES)).cast("int")), folder, "rest")
    near = F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1))
    outer = _with_suffix(rest.where("root <> main").drop("main").withColumn("class", near), "_o", "key", "class")
    similar, _ = _similar("", "_o")
    once = (F.col("root") != F.col("root_o")) & ((F.col("root") == F.col("main")) | (F.col("id_o") < F.col("id")))
    pairs = rest.join(outer, ["key", "class"]).where(once & _allowed("_o") & similar).select(F.col("id_o").alias("a"), F.col("id").alias("b")).distinct()
    links, found = _confirmed(pairs, *tables, folder, "rest")
    return _merged(merged, links, found, folder, "round-rest")[0] if found else roots


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """A row per row of df: id, n_shingles and component_id (the least id that links reach)."""
    spark: SparkSession = df.sparkSession
    folder = shared_dir(spark)
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    marked = written(_marked(docs, cells), folder, "marked")
    counts = _counters(marked, cells)
    prefixes = spark.sparkContext.broadcast(Prefixes(_levels(counts), float(counts.mean())))
    del counts  # the driver needs its memory in the rounds that follow
    release()
    rows = marked.where("_cells is null").select("_id", "n_shingles", "_print")
    filled = rows.where("_print is not null and _id is not null")
    by_id = filled.groupBy("_print", "_id").agg(F.count(F.lit(1)).alias("_rows"))
    copies, many = counted(by_id.groupBy("_print").agg(F.min("_id").alias("rep"), F.max("_rows").alias("_rows")), folder, "copies", n=F.count(F.lit(1)), most=F.max("_rows"))
    repeated = (many["most"] or 0) > 1
    first = checked(copies.select("_print", F.col("rep").alias("_id")), many["n"])
    cut = _cut(docs.where("_id is not null"), prefixes).join(first, ["_print", "_id"], "left_semi")
    cut = written(cut.dropDuplicates(["_print", "_id"]) if repeated else cut, folder, "links/cut")
    roots = _links(docs.where("_id is not null"), cut, f"{folder}/links", repeated)
    roots = copies.withColumn("root", F.col("rep")) if roots is None else copies.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("_print", F.coalesce("root", "rep").alias("root"))
    roots = written(roots.select("_print", "root"), folder, "roots")
    drop_dir(spark, f"{folder}/links")
    without = rows.where("_print is null").withColumn("root", F.col("_id"))
    joined = rows.where("_print is not null").join(roots, "_print", "left").select("_id", "n_shingles", "_print", "root").unionByName(without)
    return joined.select(F.col("_id").alias(id_col), "n_shingles", F.when(F.col("_id").isNotNull(), F.coalesce("root", "_id")).alias("component_id"))
