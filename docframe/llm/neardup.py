"""Near-duplicate groups by one-permutation MinHash with optimal densification.

A document's set is its distinct 5-word shingles (with fewer words the whole
sequence as one).  Two documents are linked if their sets have a Jaccard
similarity of at least 0.75; groups are the connected components of all links.

1. Copies: documents with the same set are one class, with the smallest id as
   representative.  All that follows handles representatives only, so a group
   of thousands of copies costs one row each.
2. Signatures: one hash of each shingle, dealt to BANDS * ROWS bins, each bin's
   least value; an empty bin borrows from a bin found by hashing (bin, attempt)
   until one isn't empty, which keeps every bin an unbiased sample however
   short the text.  A band of ROWS bins is a bucket key.  At a similarity of
   0.75 a pair misses all 48 bands of 5 with probability (1 - 0.75**5)**48 =
   2e-6, at 0.8 with 6e-9.
3. Stars: a bucket links its members to one centre, never all pairs.  First the
   centre is the least id, and each member is tried with the centre that it
   shares most buckets with.  Then, in the buckets whose members still belong to
   several components, centres are drawn anew round by round, and each member is
   tried with the nearest centre of another component: one candidate a member
   and round, so a round's edges never outnumber the members.  Candidates are
   confirmed on the full sets and joined into components.
4. The rest: once a round finds few links, each member that is outside its
   bucket's largest component meets the bucket's members of other components in
   a join whose condition is the bound of an odd sketch (PARITIES parities of the
   set).  Two sketches never differ in more bits than the sets in elements, so
   the bound loses no link, and as similar sets differ in few elements it lets
   little else through.  So every pair that shares a bucket is in one component,
   excluded by its size, by the bound, or compared in full.  The join's keys are the
   bucket and a class of sizes, so outsiders meet members of similar size only;
   within these it compares sketches: work, not rows, that is the product of both.
5. Components by alternating large and small stars, with tables written to the
   shared folder between the rounds.

Cases: null and empty texts (or of white space) have an empty set, are linked
with nothing and are kept; repeated rows of one id are one document each time
it is listed (they share the component); rows with a null id get a null
component and are kept; an empty table gives an empty result; other columns
are ignored, so their names can't clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.llm.arrowmap import add_columns, counted, drop_dir, list_array, shared_dir, written
from docframe.llm.textbytes import LOWER, hash_spans, mix, slices, spans, text_bytes

WORDS = 5
#: Similarity of at least 75 / 100.
LEAST = (75, 100)
BANDS, ROWS = 48, 5
#: Bits of an odd sketch.
PARITIES = 2048
SKETCH = [f"o{i}" for i in range(PARITIES // 64)]
#: Sets of similar sizes are in the same or in neighbouring classes, each so many times as large as the one before: more than
#: 100 / 75 by a margin for rounding.
SIZES = 1.34
#: Ids that are broadcast at most, some tens of MB.
BROADCAST = 2_000_000
#: Rows of a table of pairs that stay in one task at most, a few MB: small tables aren't dealt out to all shuffle partitions.
TOGETHER = 100_000
#: Stars are drawn anew until a round finds less than one link for so many bucket members; this decides on cost only.
SETTLED = 1000

#: Bytes of texts whose shingles are made at once.
SLICE = 1 << 19

_STEPS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(64)]


def shingles(column: pa.Array, width: int = WORDS) -> list[np.ndarray]:
    """The ascending distinct 64-bit hashes of each text's shingles."""
    buf, offsets = text_bytes(column)
    out: list[np.ndarray] = []
    for a, b in slices(offsets, SLICE):
        part = LOWER[buf[offsets[a] : offsets[b]]]
        begin, stop, row = spans(part, offsets[a : b + 1] - offsets[a])
        word = hash_spans(part, begin, stop)
        bounds = np.searchsorted(row, np.arange(b - a + 1))
        joined = np.zeros(max(0, len(word) - width + 1), np.uint64)
        for k in range(width):
            joined += word[k : k + len(joined)] * _STEPS[k]
        joined = mix(joined)
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if j - i >= width:
                out.append(np.unique(joined[i : j - width + 1]))
            elif j > i:
                short = np.array([j - i], np.uint64)
                for k in range(j - i):
                    short += word[i + k : i + k + 1] * _STEPS[k + width]
                out.append(mix(short))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


class Signer:
    """One-permutation signatures with optimal densification, cut into bands."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, probes: int = 64):
        self.bands, self.rows, self.bins, self.probes = bands, rows, bands * rows, probes
        self.tables: list[np.ndarray] = []

    def _table(self, k: int) -> np.ndarray:
        """The bins that empty bins try at attempts k * probes and on: independent hashes of bin and attempt."""
        while len(self.tables) <= k:
            n = len(self.tables)
            attempt = np.arange(n * self.probes, (n + 1) * self.probes, dtype=np.uint64)
            cell = np.arange(self.bins, dtype=np.uint64)[:, None] << np.uint64(32) | attempt
            self.tables.append((mix(cell * _STEPS[0] + np.uint64(1)) % np.uint64(self.bins)).astype(np.int32))
        return self.tables[k]

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """Least value of each bin, from ascending distinct hashes (at least one): bins are equal ranges of the hash."""
        where = ((hashes >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        least = np.zeros(self.bins, np.uint64)
        full = np.zeros(self.bins, bool)
        at = where[first].astype(np.int64)
        least[at], full[at] = hashes[first], True
        out, empty, k = least.copy(), np.flatnonzero(~full), 0
        while len(empty):
            tried = self._table(k)[empty]
            hit = full[tried]
            found = hit.any(1)
            donor = tried[found, hit[found].argmax(1)]
            out[empty[found]] = least[donor]
            empty, k = empty[~found], k + 1
        return out

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band."""
        values = signature.reshape(self.bands, self.rows)
        key = np.arange(self.bands, dtype=np.uint64)
        for r in range(self.rows):
            key = mix(key * _STEPS[1] + values[:, r])
        return key


def _signed(df: DataFrame, text: str) -> DataFrame:
    """df with n_shingles, a 128-bit fingerprint of the set and its band keys (null or none: empty set)."""
    out = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("_print", T.BinaryType()), T.StructField("_keys", T.ArrayType(T.LongType()))])

    def make():
        import xxhash

        signer = Signer()

        def run(batch: pa.RecordBatch) -> list:
            sets = shingles(batch.column(0))
            none = np.zeros(0, np.int64)
            keys = [signer.keys(signer.signature(s)).view(np.int64) if len(s) else none for s in sets]
            lists = list_array(np.concatenate([none, *keys]), np.array([len(x) for x in keys], np.int64), pa.int64())
            return [[len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], lists]

        return run

    return add_columns(df, [text], out, make)


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes in each of PARITIES cells, as 64-bit words.

    Sketches of two sets differ in at most as many bits as the sets have elements that only one of them has."""
    cells = np.bincount((hashes & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES)
    return np.packbits((cells & 1).astype(np.uint8)).view(np.int64)


def _set_arrays(df: DataFrame, text: str) -> DataFrame:
    """df with each text's set and the words of its odd sketch."""
    out = T.StructType([T.StructField("_set", T.ArrayType(T.LongType()))] + [T.StructField(c, T.LongType()) for c in SKETCH])

    def make():
        def run(batch: pa.RecordBatch) -> list:
            sets = shingles(batch.column(0))
            words = np.stack([odd_sketch(s) for s in sets])
            return [list_array(np.concatenate(sets).view(np.int64), np.array([len(s) for s in sets]), pa.int64()), *words.T]

        return run

    return add_columns(df, [text], out, make)


def together(pairs: DataFrame, n: int) -> DataFrame:
    """A table of n narrow rows: up to TOGETHER as one partition, so that groups and joins among such tables need no shuffle."""
    return pairs.coalesce(1) if n <= TOGETHER else pairs


def components(edges: DataFrame, folder: str, tag: str) -> DataFrame:
    """(node, root) of every node of the edges (a, b), root the least id of its component, by alternating stars.

    Each round is two shuffles of at most the number of edges; the rounds grow with the logarithm of a
    component's width.  Tables are written to the shared folder, so nothing is held on one machine.
    """
    mark = {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs, before = counted(pairs, folder, f"{tag}-0", **mark)
    n = 0
    while True:
        n += 1
        pairs = together(pairs, before["n"])
        # Large star: every larger neighbour of a node, to the least of the node and its neighbours.
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: every smaller neighbour, and the node itself, to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))
        pairs, after = counted(joined.select(ends.alias("e")).select("e.u", "e.v").where("u <> v").distinct(), folder, f"{tag}-{n}", **mark)
        if before == after:
            pairs = together(pairs, after["n"])
            roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = after


def checked(ids: DataFrame, n: int) -> DataFrame:
    """A table of n ids as the lesser side of a join: sent to all executors up to BROADCAST rows, beyond them merged."""
    return F.broadcast(ids) if n <= BROADCAST else ids.hint("merge")


def _confirmed(candidates: DataFrame, sets: DataFrame, folder: str, tag: str) -> tuple[DataFrame, int]:
    """Candidate pairs (a, b) whose sets are similar enough, written, and their number; only the sets that they name are moved."""
    candidates, tried = counted(candidates, folder, f"candidates-{tag}", n=F.count(F.lit(1)))
    named = candidates.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
    needed = sets.select("_id", "_set").join(checked(named, 2 * tried["n"]), "_id", "left_semi")
    both = candidates.join(needed.select(F.col("_id").alias("a"), F.col("_set").alias("_sa")), "a").join(needed.select(F.col("_id").alias("b"), F.col("_set").alias("_sb")), "b")
    same = F.size(F.array_intersect("_sa", "_sb"))
    union = F.size("_sa") + F.size("_sb") - same
    links, found = counted(both.where(same * LEAST[1] >= union * LEAST[0]).select("a", "b"), folder, f"links-{tag}", n=F.count(F.lit(1)))
    return links, found["n"]


def _merged(known: tuple[DataFrame, int] | None, links: DataFrame, found: int, folder: str, tag: str) -> tuple[DataFrame, int]:
    """(node, root) of what is known and so many links, written, and their number."""
    edges = links if known is None else links.unionByName(known[0].where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    edges = together(edges, found + (known[1] if known else 0))
    roots, many = counted(components(edges, folder, f"{tag}-star"), folder, f"{tag}-roots", n=F.count(F.lit(1)))
    return roots, many["n"]


def _can_be_similar(other: str):
    """What holds for every two sets that are similar enough, from their sizes and sketches (columns of the second
    set end in `other`): at a similarity of t, (1 - t) / (1 + t) of the summed sizes are elements of only one set."""
    n, m = F.col("n"), F.col(f"n{other}")
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(c + other))) for c in SKETCH), F.lit(0))
    sizes = F.least(n, m) * LEAST[1] >= F.greatest(n, m) * LEAST[0]
    return sizes & (apart * (LEAST[1] + LEAST[0]) <= (n + m) * (LEAST[1] - LEAST[0])), apart


def _unresolved(members: DataFrame, roots: DataFrame | None, folder: str, tag: str) -> DataFrame:
    """Members (key, id, root) of the buckets whose members belong to more than one component."""
    rows = members.select("key", "id")
    if roots is None:
        rows = rows.withColumn("root", F.col("id"))
    else:
        rows = rows.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    several = rows.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("key")
    several, found = counted(several, folder, f"several-{tag}", n=F.count(F.lit(1)))
    return rows.join(checked(several, found["n"]), "key").select("key", "id", "root")


def _with_suffix(df: DataFrame, suffix: str, *keys: str) -> DataFrame:
    return df.select([F.col(c) if c in keys else F.col(c).alias(c + suffix) for c in df.columns])


def _links(docs: DataFrame, signed: DataFrame, folder: str) -> DataFrame | None:
    """(node, root) of all representatives that are linked with another one."""
    rows = signed.select(F.explode("_keys").alias("key"), F.col("_id").alias("id"))
    centres = rows.groupBy("key").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "centre")
    members, seen = counted(rows.join(centres, "key").select("key", "id", "centre"), folder, "members", n=F.count(F.lit(1)))
    if not seen["n"]:
        return None
    met, several = counted(members.select(F.col("id").alias("_id")).distinct(), folder, "met", n=F.count(F.lit(1)))
    texts = docs.join(checked(met, several["n"]), "_id", "left_semi").withColumn("_h", F.xxhash64("_text")).dropDuplicates(["_id", "_h"]).select("_id", "_text")
    sets = written(_set_arrays(texts, "_text").where(F.size("_set") > 0).select("_id", "_set", *SKETCH), folder, "sets")
    about = sets.select(F.col("_id").alias("id"), F.size("_set").alias("n"), *SKETCH)
    # The first stars: a member is tried with the centre that it shares most buckets with.
    shared = members.where("id <> centre").groupBy("id", "centre").agg(F.count(F.lit(1)).alias("bands"))
    candidates = shared.groupBy("id").agg(F.max(F.struct("bands", "centre")).alias("best")).select(F.col("best.centre").alias("a"), F.col("id").alias("b"))
    merged, step = None, 1
    while True:
        links, found = _confirmed(candidates, sets, folder, str(step))
        if found:
            merged = _merged(merged, links, found, folder, f"round-{step}")
        roots = merged and merged[0]
        step += 1
        members, left = counted(_unresolved(members, roots, folder, str(step)), folder, f"left-{step}", n=F.count(F.lit(1)))
        if not left["n"]:
            return roots
        if step > 2 and found * SETTLED < left["n"]:
            break
        # Another star in each bucket: a member is tried with the nearest centre of its buckets, by the sketches.
        drawn = members.groupBy("key").agg(F.min_by(F.struct("id", "root"), F.xxhash64("key", "id", F.lit(step))).alias("c")).select("key", "c.id", "c.root")
        possible, apart = _can_be_similar("_c")
        pairs = members.join(about, "id").join(_with_suffix(drawn.join(about, "id"), "_c", "key"), "key").where((F.col("root") != F.col("root_c")) & possible)
        nearest = pairs.groupBy("id").agg(F.min(F.struct(apart.alias("apart"), F.col("id_c"))).alias("best"))
        candidates = nearest.select(F.col("best.id_c").alias("a"), F.col("id").alias("b"))
    # What is left: members outside a bucket's largest component, with every member of another component.
    most = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("many")).groupBy("key").agg(F.max(F.struct("many", "root")).alias("_m"))
    placed = members.join(about, "id").join(most.select("key", F.col("_m.root").alias("main")), "key")
    rest = written(placed.withColumn("class", F.floor(F.log("n") / math.log(SIZES)).cast("int")), folder, "rest")
    near = F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1))
    outer = _with_suffix(rest.where("root <> main").drop("main").withColumn("class", near), "_o", "key", "class")
    possible, _ = _can_be_similar("_o")
    once = (F.col("root") != F.col("root_o")) & ((F.col("root") == F.col("main")) | (F.col("id_o") < F.col("id")))
    pairs = rest.join(outer, ["key", "class"]).where(once & possible).select(F.col("id_o").alias("a"), F.col("id").alias("b")).distinct()
    links, found = _confirmed(pairs, sets, folder, "rest")
    return _merged(merged, links, found, folder, "round-rest")[0] if found else roots


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """A row per row of df: id, n_shingles, component_id (the least id that is reachable) and kept (it is its own).

    keep: further columns of df to hand on, by the names that they get."""
    spark, folder = df.sparkSession, shared_dir(df.sparkSession)
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    more = {f"_keep{i}": name for i, name in enumerate(keep or {})}
    wide = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *[F.col((keep or {})[name]).alias(c) for c, name in more.items()])
    marked = written(_signed(wide, "_text").select("_id", "n_shingles", "_print", "_keys", *more), folder, "signed")
    filled = marked.where("_print is not null and _id is not null")
    classes = written(filled.groupBy("_print").agg(F.min("_id").alias("rep")), folder, "classes")
    one = filled.select("_print", "_id", "_keys").join(classes.select("_print", F.col("rep").alias("_id")), ["_print", "_id"], "left_semi").dropDuplicates(["_print", "_id"])
    roots = _links(docs.where("_id is not null"), one, f"{folder}/links")
    if roots is None:
        classes = classes.withColumn("root", F.col("rep"))
    else:
        classes = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("_print", F.coalesce("root", "rep").alias("root"))
    classes = written(classes.select("_print", "root"), folder, "roots")
    drop_dir(spark, f"{folder}/links")
    rows = marked.select("_id", "n_shingles", "_print", *more)
    without = rows.where("_print is null").withColumn("root", F.col("_id"))
    joined = rows.where("_print is not null").join(classes, "_print", "left").select("_id", "n_shingles", "_print", *more, "root").unionByName(without)
    component = F.when(F.col("_id").isNotNull(), F.coalesce("root", "_id"))
    kept = F.coalesce(F.col("_id") == component, F.lit(True))
    return joined.select(F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"), kept.alias("kept"), *[F.col(c).alias(name) for c, name in more.items()])
