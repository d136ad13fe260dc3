"""Text fusion: which of two or three readings of a region or cell is taken, and why.

The cheap rules are built-in expressions; the similarity that the others need
is computed only for rows that these leave open: a function inside a CASE would
run for all rows, so it gets nulls for the others, or they are filtered out first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docframe.functions import text as X
from docframe.functions.udf import seq_ratio

TAKEN = ("primary_empty", "numeric_agreement", "preferred_candidate", "coordinate_consensus", "physical_only")
#: Reasons that put a region on the review list.
REVIEWED = ("numeric_disagreement", "trusted_cell_coordinates_missing", "merged_cell_coordinate_review", "anchored_text_incomplete", "anchored_text_edge_mismatch", "anchored_text_mismatch", "physical_numeric_disagreement", "physical_text_disagreement")


def _tokens(normal: str) -> Column:
    return F.array_distinct(F.filter(F.split(normal, " "), lambda t: t != ""))


def overlap(a: Column, b: Column) -> Column:
    """Common tokens over those of the smaller set."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


def _with_similarity(df: DataFrame, *pairs: tuple[str, str, str]) -> DataFrame:
    return reduce(lambda d, p: d.withColumn(p[0], seq_ratio(p[1], p[2])), pairs, df)


def decide(df: DataFrame, primary: str = "primary", other: str = "candidate", anchored: bool = False) -> DataFrame:
    """df with selected and reason; anchored asks for more, as the place itself was found by text."""
    marked = df.withColumn("reason", X.prefix_conditions(F.col(primary), F.col(other)))
    ask = F.col("reason").isNull() if not anchored else F.col("reason").isNull() | F.col("reason").isin("primary_empty", "numeric_agreement")
    # One pass over all rows: those that are settled have null texts here, whose similarity takes no time.
    open_ = marked.withColumn("_ask", ask).withColumn("_a", F.when(F.col("_ask"), X.semantic_normal(F.col(primary)))).withColumn("_b", F.when(F.col("_ask"), X.semantic_normal(F.col(other))))
    rated = _with_similarity(open_, ("_s", "_a", "_b"))
    share = overlap(_tokens("_a"), _tokens("_b"))
    reason = F.coalesce("reason", F.when((F.col("_s") < 0.50) & (share < 0.35), "semantic_mismatch").otherwise("preferred_candidate"))
    if anchored:
        rated = rated.withColumn("_a1", F.split_part("_a", F.lit(" "), F.lit(1))).withColumn("_b1", F.split_part("_b", F.lit(" "), F.lit(1)))
        rated = rated.withColumn("_a2", F.substring_index("_a", " ", -1)).withColumn("_b2", F.substring_index("_b", " ", -1))
        rated = _with_similarity(rated, ("_s1", "_a1", "_b1"), ("_s2", "_a2", "_b2"))
        strict = (
            F.when((F.col("_a") == "") | (F.col("_b") == ""), "anchored_text_incomplete").when((F.col("_s1") < 0.65) | (F.col("_s2") < 0.65), "anchored_text_edge_mismatch")
            .when((F.col("_s") < 0.76) | (share < 0.50), "anchored_text_mismatch").otherwise("coordinate_consensus")
        )
        reason = F.when(reason == "semantic_mismatch", reason).otherwise(strict)
    done = rated.withColumn("reason", F.when(F.col("_ask"), reason).otherwise(F.col("reason"))).select(*marked.columns)
    return done.withColumn("selected", F.col("reason").isin(*TAKEN))


def decide_physical(df: DataFrame, primary: str = "primary", other: str = "candidate", third: str = "third") -> DataFrame:
    """As decide(), for cells of a grid found in the image, with a third reading as umpire: two that agree decide."""
    cleaned = df.withColumn("_o", X.physical_cell(F.col(other))).withColumn("_t", X.physical_cell(F.col(third)))
    p, o, t = F.col(primary), F.col("_o"), F.col("_t")
    normal = cleaned.withColumns({"_pn": X.semantic_normal(p), "_on": X.semantic_normal(o), "_tn": X.semantic_normal(t), "_pd": X.canonical_numbers(p), "_od": X.canonical_numbers(o), "_td": X.canonical_numbers(t)})
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    numeric = (F.size("_pd") + F.size("_od") + F.size("_td") > 0) & reduce(lambda a, b: a & b, [blank(c) | c.rlike(X.NUMERIC_ONLY) for c in (p, o, t)])
    early = (
        F.when(F.col("_on") == "", "physical_candidate_empty")
        .when(numeric, F.when((F.size("_td") > 0) & (F.col("_od") == F.col("_td")), "physical_numeric_consensus").when(X.near_equal_numbers(F.col("_od"), F.col("_td")), "physical_numeric_near_consensus")
              .when((F.size("_pd") > 0) & (F.col("_od") == F.col("_pd")), "physical_numeric_primary_agreement").otherwise("physical_numeric_disagreement"))
    )
    marked = normal.withColumn("reason", early)
    settled, open_ = marked.where("reason IS NOT NULL"), marked.where("reason IS NULL")
    rated = _with_similarity(open_, ("_s3", "_on", "_tn"), ("_s1", "_pn", "_on"))
    late = (
        F.when((F.col("_tn") != "") & (F.col("_s3") >= 0.45), "physical_consensus").when(F.col("_pn") == "", "physical_only").when(F.col("_s1") >= 0.62, "physical_primary_consensus").otherwise("physical_text_disagreement")
    )
    both = settled.unionByName(rated.withColumn("reason", late).select(*settled.columns))
    agreed = F.col("reason").isin("physical_numeric_consensus", "physical_numeric_near_consensus", "physical_consensus", "physical_primary_consensus")
    chosen = (F.col("reason") == "physical_only") | (agreed & (F.col("_pn") != F.col("_on")))
    return both.withColumn("selected", chosen).withColumn(other, F.col("_o")).select(*df.columns, "reason", "selected")


def fused_text(decisions: DataFrame, primary: str = "primary", other: str = "candidate") -> DataFrame:
    return decisions.withColumn("text", F.when(F.col("selected"), F.col(other)).otherwise(F.col(primary)))


def counters(decisions: DataFrame, *by: str) -> DataFrame:
    """How many items were replaced and how many need review."""
    return decisions.groupBy(*by).agg(F.count_if("selected").alias("replaced"), F.count_if(F.col("reason").isin(*REVIEWED)).alias("review_items"), F.count("*").alias("decisions"))


def _valid(words: DataFrame) -> DataFrame:
    return words.where((F.trim("text") != "") & (F.col("w") >= 0) & (F.col("h") >= 0))


def _texts(found: DataFrame, *keys: str) -> DataFrame:
    """The text of each key's words: their lines from top to bottom, words from left to right."""
    from docframe.operators.words import group_lines

    words = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "y", "w", "h", "text"))).alias("ws"))
    numbered = words.select(*keys, F.struct(*keys).alias("_key"), F.posexplode("ws").alias("_no", "_w")).select(*keys, "_key", "_no", "_w.*")
    lines = group_lines(numbered, "_key", "_no").groupBy(*keys, "line_no").agg(F.array_sort(F.collect_list(F.struct("x", "_no", "text"))).alias("ws"))
    line = F.array_join(F.transform("ws", lambda w: w["text"]), " ")
    texts = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", line.alias("line")))).alias("ls"))
    return texts.select(*keys, F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("candidate"))


def fuse_regions(regions: DataFrame, words: DataFrame, by: str = "doc_id", region: str = "region_id") -> DataFrame:
    """Regions (x, y, w, h, text) with the words of another engine that lie in them as candidate, decided.

    The words of a region are joined to it by page and band, put in line order, and compared.
    """
    from docframe.operators.words import words_in

    rects = regions.select(by, region, F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("w").alias("rw"), F.col("h").alias("rh"))
    found = words_in(_valid(words), rects, by)
    texts = _texts(found, by, region)
    joined = regions.withColumnRenamed("text", "primary").join(texts, [by, region], "left").withColumn("candidate", F.coalesce("candidate", F.lit("")))
    return fused_text(decide(joined))


#: Pages of about this many words are matched at a time, and pairs of words and regions are looked at in runs of this many.
_WORDS = 200_000


def _line_texts(region: np.ndarray, n: int, word: pa.StructArray) -> pa.Array:
    """The text of each of n regions from its words, of which each stands beside its region's number; as _texts() gives it."""
    x, y, w, h = (np.asarray(word.field(c).to_numpy(zero_copy_only=False)) for c in ("x", "y", "w", "h"))
    text = word.field("text")
    order = np.lexsort((h, w, y, x, region))
    if len(order) and np.logical_and.reduce([np.diff(c[order]) == 0 for c in (h, w, y, x, region)]).any():
        # Only boxes that are equal are put in order by their texts.
        order = np.lexsort((pc.rank(text, tiebreaker="dense").to_numpy(), h, w, y, x, region))
    region, cy, h = region[order], (y + h / 2.0)[order], h[order]
    counts = np.bincount(region, minlength=n)
    starts = np.concatenate([[0], np.cumsum(counts)])
    # Words by their centres; a region whose centres are all near its first one is one line.
    down = np.lexsort((cy, region))
    tall = h[np.lexsort((h, region))]
    some = np.flatnonzero(counts)
    tolerance = np.zeros(n)
    tolerance[some] = tall[starts[some] + counts[some] // 2] * 0.6
    first, last = np.zeros(n), np.zeros(n)
    first[some], last[some] = cy[down[starts[some]]], cy[down[starts[some + 1] - 1]]
    line = np.zeros(len(region), np.int64)
    for r in np.flatnonzero(last - first > tolerance):
        base, no = None, -1
        for i in down[starts[r] : starts[r + 1]]:
            if base is None or cy[i] - base > tolerance[r]:
                base, no = cy[i], no + 1
            line[i] = no
    put = np.lexsort((line, region))
    region, line = region[put], line[put]
    new = np.ones(len(put), bool)
    new[1:] = (region[1:] != region[:-1]) | (line[1:] != line[:-1])
    at = np.append(np.flatnonzero(new), len(put)).astype(np.int32)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at), text.take(pa.array(order[put]))), " ")
    ends = np.concatenate([[0], np.cumsum(np.bincount(region[new], minlength=n))]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), joined), "\n")


def _candidates(at: np.ndarray, regions: pa.StructArray, of: np.ndarray, words: pa.StructArray) -> pa.Array:
    """The text of the words whose centres each region holds; at and of: the pages of regions and words, ascending."""
    valid = pc.and_(pc.not_equal(pc.utf8_trim(words.field("text"), " "), ""), pc.and_(pc.greater_equal(words.field("w"), 0), pc.greater_equal(words.field("h"), 0)))
    valid = pc.and_(valid, pc.and_(pc.is_valid(words.field("x")), pc.is_valid(words.field("y"))))
    kept = np.flatnonzero(valid.fill_null(False).to_numpy(zero_copy_only=False))
    words, of = words.take(pa.array(kept)), of[kept]
    x, y, w, h = (np.asarray(words.field(c).to_numpy(zero_copy_only=False)) for c in ("x", "y", "w", "h"))
    left, top, wide, high = (regions.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y", "w", "h"))
    cx, cy = x + w / 2.0, y + h / 2.0
    by = np.lexsort((cy, of))
    # Bounds stand among the words by page and height: before the words as high for the upper one, after them for the lower one.
    n, m = len(at), len(by)
    place = np.lexsort((np.repeat([0, 1, 2], [n, m, n]), np.concatenate([top, cy[by], top + high]), np.concatenate([at, of[by], at])))
    before = np.empty(n + m + n, np.int64)
    before[place] = np.cumsum((place >= n) & (place < n + m))
    low, up = before[:n], np.maximum(before[:n], before[n + m :])
    up = np.where(np.isnan(left + top + wide + high), low, up)
    # A page's words are those of its own, so bounds of no height or on other pages hold none.
    region, word = [], []
    ends = np.cumsum(up - low)
    r = 0
    while r < n:
        to = max(r + 1, int(np.searchsorted(ends, (ends[r - 1] if r else 0) + _WORDS, "right")))
        size = up[r:to] - low[r:to]
        rows = np.repeat(np.arange(r, to), size)
        found = by[np.arange(len(rows)) + np.repeat(low[r:to] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)]
        inside = (cx[found] >= left[rows]) & (cx[found] <= left[rows] + wide[rows])
        region.append(rows[inside])
        word.append(found[inside])
        r = to
    chosen = words.take(pa.array(np.concatenate(word) if word else np.zeros(0, np.int64)))
    return _line_texts(np.concatenate(region) if region else np.zeros(0, np.int64), n, chosen)


def fuse_pages(pages: DataFrame, by: str = "doc_id", region: str = "region_id") -> DataFrame:
    """What fuse_regions() gives, for pages whose lists stand in their rows: regions (an array of structures of region, x, y, w, h
    and text, of which region is unique on its page) and words (of text, x, y, w and h).

    Nothing is shuffled: a page's words are matched and put in lines where the page was read, in an Arrow pass."""
    lists = {f.name: f.dataType.elementType for f in pages.select("regions", "words").schema}
    fields = [region, "x", "y", "w", "h", "text"]
    schema = T.StructType([pages.schema[by], *[T.StructField({"text": "primary"}.get(f, f), lists["regions"][f].dataType) for f in fields], T.StructField("candidate", T.StringType())])
    kinds = to_arrow_schema(schema)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.cumsum(pc.list_value_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False))
            i = 0
            while i < batch.num_rows:
                to = max(i + 1, int(np.searchsorted(n, (n[i - 1] if i else 0) + _WORDS, "right")))
                yield batch.slice(i, to - i)
                i = to

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            pages_of = lambda c: np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(c)).fill_null(0).to_numpy(zero_copy_only=False))  # noqa: B023, E731
            at, regions = pages_of(1), batch.column(1).flatten()
            found = _candidates(at, regions, pages_of(2), batch.column(2).flatten())
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([batch.column(0).take(pa.array(at)), *[regions.field(f) for f in fields], found], kinds, strict=True)], schema=kinds)

    return fused_text(decide(pages.select(by, "regions", "words").mapInArrow(work, schema)))


def fuse_tables(tables: DataFrame, cells: DataFrame, words: DataFrame, third: DataFrame, by: str = "doc_id", region: str = "region_id") -> DataFrame:
    """Decisions on the cells of tables (rows, cols): a row per trusted cell, with the words of two other engines in its
    box as candidate and third, or one row of kind table where no cell's place may be trusted.

    cells: row, col, rowspan, colspan, text, box (x, y, width, height), coordinate_source, coordinate_confidence and
    coordinate_anchor_count.  The source of its place says how a cell is decided; merged cells whose place was found
    by text always go to review.  Cells outside the grid have no decision, nor have tables without rows or columns.
    """
    from docframe.operators.words import cell_is_trusted, words_in

    rect = ["rx", "ry", "rw", "rh"]
    trusted = cell_is_trusted(F.col("box"), F.col("coordinate_source"), F.col("coordinate_confidence"), F.col("coordinate_anchor_count"))
    whole = {k: F.coalesce(F.col(k).cast("int"), F.lit(0)) for k in ("row", "col")} | {k: F.greatest(F.lit(1), F.coalesce(F.col(k).cast("int"), F.lit(1))) for k in ("rowspan", "colspan")}
    boxes = {k: F.get("box", i).cast("int") for i, k in enumerate(rect)}
    sized = tables.where((F.col("rows") >= 1) & (F.col("cols") >= 1)).select(by, region, F.col("rows").alias("_rows"), F.col("cols").alias("_cols"))
    marked = cells.select(by, region, *[c.alias(k) for k, c in whole.items()], F.coalesce("text", F.lit("")).alias("primary"), "coordinate_source", trusted.alias("_trusted"), *[c.alias(k) for k, c in boxes.items()])
    held = sized.join(marked, [by, region], "left")
    placed = held.where(F.col("_trusted") & (F.col("row") < F.col("_rows")) & (F.col("col") < F.col("_cols"))).drop("_rows", "_cols", "_trusted")
    rects = placed.select(by, *rect).distinct()
    for name, of in (("candidate", words), ("third", third)):
        texts = _texts(words_in(_valid(of), rects, by, 1.0), by, *rect).withColumnRenamed("candidate", name)
        placed = placed.join(texts, [by, *rect], "left").withColumn(name, F.coalesce(name, F.lit("")))
    source = F.col("coordinate_source")
    physical, aligned = source == "physical_grid_verified", source == "tesseract_native_alignment"
    merged = (F.col("rowspan") > 1) | (F.col("colspan") > 1)
    parts = [
        decide_physical(placed.where(physical)).withColumn("third", X.physical_cell("third")),
        placed.where(aligned & merged).withColumn("reason", F.lit("merged_cell_coordinate_review")).withColumn("selected", F.lit(False)),
        decide(placed.where(aligned & ~merged), anchored=True),
        decide(placed.where(~physical & ~aligned)),
    ]
    decided = fused_text(reduce(lambda a, b: a.unionByName(b), parts)).withColumn("kind", F.lit("table_cell")).withColumn("box", F.array(*rect)).drop(*rect, "coordinate_source")
    none = held.groupBy(by, region).agg(F.count("_trusted").alias("cells"), F.count_if("_trusted").alias("_n")).where("_n = 0").drop("_n")
    missing = none.withColumns({"kind": F.lit("table"), "reason": F.lit("trusted_cell_coordinates_missing"), "selected": F.lit(False)})
    return decided.unionByName(missing, allowMissingColumns=True)
