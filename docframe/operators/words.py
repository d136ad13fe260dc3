"""Word boxes: lines, columns, grids, words in rectangles, anchors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.functions import text as X

BAND = 256  # height of the bands by which words and rectangles are matched


def medians(words: DataFrame, by: str = "doc_id") -> DataFrame:
    """Upper medians of heights and widths of each page, from the numbers of words of each size: a page has few sizes,
    so what is sorted is small however many words it has."""
    out = None
    for size in ("w", "h"):
        counts = words.groupBy(by, size).agg(F.count("*").alias("n"))
        w = Window.partitionBy(by)
        ranked = counts.withColumn("_to", F.sum("n").over(w.orderBy(size).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_half", F.floor(F.sum("n").over(w) / 2))
        middle = ranked.where("_to > _half").groupBy(by).agg(F.min(size).alias(f"median_{size}"))
        out = middle if out is None else out.join(middle, by)
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _sticky(centres: pd.Series, tolerance: pd.Series) -> pd.Series:
    """Line numbers of ascending centres: a line goes on while they are near the centre of its first word."""

    def one(ys, most):
        out, base, n = np.empty(len(ys), np.int32), None, 0
        for i, y in enumerate(ys):
            if base is None or abs(y - base) > most:
                base, n = y, n + 1
            out[i] = n
        return out

    return pd.Series([one(ys, most) for ys, most in zip(centres, tolerance, strict=True)])


def group_lines(words: DataFrame, by: str = "doc_id", order: str = "word_no", tolerance: float = 0.6) -> DataFrame:
    """Words with line_no: sorted by centre, a word joins the line if it is near the centre of the line's first word.

    That first word moves only when a line ends, so this is a fold over a page's words, not a lag; one pass in an Arrow function.
    """
    middle = F.col("y") + F.col("h") / 2.0
    pages = words.withColumn("_cy", middle).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_cy", order, "h"))).alias("ws"))
    pages = pages.withColumn("tol", F.element_at(F.array_sort(F.transform("ws", lambda w: w["h"])), (F.floor(F.size("ws") / 2) + 1).cast("int")) * tolerance)
    folded = pages.withColumn("nos", _sticky(F.transform("ws", lambda w: w["_cy"].cast("double")), F.col("tol").cast("double")))
    placed = folded.select(by, F.explode(F.arrays_zip(F.transform("ws", lambda w: w[order]).alias("id"), F.col("nos").alias("no"))).alias("p"))
    return words.join(placed.select(by, F.col("p.id").alias(order), F.col("p.no").alias("line_no")), [by, order])


def column_bounds(words: DataFrame, by: str = "doc_id", factor: float = 1.5) -> DataFrame:
    """Middles of the gaps between neighbouring word starts that are wider than `factor` median widths.

    Equal starts make no gap, so only the distinct ones are sorted."""
    starts = words.select(by, "x").distinct()
    gaps = starts.select(by, "x", F.lag("x").over(Window.partitionBy(by).orderBy("x")).alias("before"))
    return gaps.join(medians(words, by).select(by, "median_w"), by).where(F.col("x") - F.col("before") > F.col("median_w") * factor).select(by, ((F.col("x") + F.col("before")) / 2.0).alias("bound"))


def grid(words: DataFrame, line: str = "line_pos", by: str = "doc_id", factor: float = 1.5) -> DataFrame:
    """Cells (page, line, column) with their words joined by spaces; the column is the number of bounds at or left of the word."""
    bounds = column_bounds(words, by, factor).groupBy(by).agg(F.array_sort(F.collect_set("bound")).alias("bounds"))
    col = F.coalesce(F.size(F.filter("bounds", lambda b: F.col("x") >= b)), F.lit(0))
    placed = words.join(bounds, by, "left").withColumn("col", F.when(F.col("bounds").isNull(), 0).otherwise(col))
    cells = placed.groupBy(by, line, "col").agg(F.array_sort(F.collect_list(F.struct("x", "text"))).alias("ws"))
    return cells.select(by, line, "col", F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("cell"))


def line_boxes(words: DataFrame, *by: str) -> DataFrame:
    """The box around all words of each line."""
    right, bottom = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return words.groupBy(*by).agg(F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("w"), (bottom - F.min("y")).alias("h"), F.count("*").alias("n"))


def words_in(words: DataFrame, rects: DataFrame, by: str = "doc_id", inset: float = 0.0, band: int = BAND) -> DataFrame:
    """Rectangles with the words whose centre they hold (borders included): page and horizontal band are the join's keys,
    so a page of many words is spread over its bands."""
    cy = F.col("y") + F.col("h") / 2.0
    points = words.withColumn("cx", F.col("x") + F.col("w") / 2.0).withColumn("cy", cy).withColumn("band", F.floor(cy / band))
    top, bottom = F.col("ry") + inset, F.col("ry") + F.col("rh") - inset
    bands = rects.where(bottom >= top).withColumn("band", F.explode(F.sequence(F.floor(top / band), F.floor(bottom / band))))
    inside = F.col("cx").between(F.col("rx") + inset, F.col("rx") + F.col("rw") - inset) & F.col("cy").between(top, bottom)
    return points.join(bands, [by, "band"]).where(inside).drop("band", "cx", "cy")


def unique_anchors(words: DataFrame, by: str = "doc_id", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Words whose folded token occurs once on the page: counted with partial sums; of a token that occurs once the least
    values are its own.  keep: the columns wanted (all); if they are numbers, nothing is sorted."""
    tokens = words.withColumn("token", X.anchor_token("text")).where("token <> ''")
    own = [c for c in tokens.columns if c not in (by, "token")] if keep is None else keep
    return tokens.groupBy(by, "token").agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in own]).where("_n = 1").drop("_n")


def anchor_cells(cells: DataFrame, words: DataFrame, by: str = "doc_id", cell: str = "cell_id") -> DataFrame:
    """Boxes of cells from the unique words that they name: two at least, or one of ten characters; padded."""
    named = cells.select(by, cell, F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[0-9A-Za-zА-Яа-яЁё]+"), F.lit(0)), X.anchor_token))).alias("token"))
    found = named.join(unique_anchors(words, by, ("x", "y", "w", "h")), [by, "token"])
    boxes = found.groupBy(by, cell).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"), F.count("*").alias("anchors"), F.max(F.length("token")).alias("_long"))
    pad_x, pad_y = F.greatest(F.lit(3.0), (F.col("x1") - F.col("x0")) * 0.03), F.greatest(F.lit(3.0), (F.col("y1") - F.col("y0")) * 0.12)
    box = [F.greatest(F.lit(0.0), F.col("x0") - pad_x).cast("int").alias("x"), F.greatest(F.lit(0.0), F.col("y0") - pad_y).cast("int").alias("y")]
    box += [(F.col("x1") - F.col("x0") + pad_x * 2).cast("int").alias("w"), (F.col("y1") - F.col("y0") + pad_y * 2).cast("int").alias("h")]
    return boxes.where("anchors >= 2 OR _long >= 10").select(by, cell, *box, "anchors")


def cell_is_trusted(box: Column, source: Column, confidence: Column, anchors: Column) -> Column:
    """Whether a cell's place may decide on its text."""
    valid = (F.size(box) == 4) & (F.get(box, 2) >= 0) & (F.get(box, 3) >= 0)
    known = (source == "provider_native") | ((source == "physical_grid_verified") & (confidence >= 0.70)) | ((source == "tesseract_native_alignment") & (confidence >= 0.90) & (anchors >= 1))
    return F.coalesce(valid & known, F.lit(False))


def confidence_stats(words: DataFrame, *by: str) -> DataFrame:
    """Word metrics: number, mean confidence, share under 0.70."""
    return words.groupBy(*by).agg(F.count("*").alias("n_words"), X.rounded(F.avg("confidence"), 4).alias("mean_confidence"), X.rounded(F.avg((F.col("confidence") < 0.70).cast("double")), 4).alias("low_share"))


def matrix(cells: DataFrame, table: str = "table_id") -> DataFrame:
    """Dense rows of each table from sparse cells; of cells in one place the last counts, gaps are empty, a table has a row and a column at least."""
    last = cells.groupBy(table, "row", "col").agg(F.max_by("text", "cell_no").alias("text"))
    size = cells.groupBy(table).agg(F.greatest(F.lit(1), F.max("row") + 1).alias("rows"), F.greatest(F.lit(1), F.max("col") + 1).alias("cols"))
    slots = size.select(table, "cols", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row")).select(table, "row", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    full = slots.join(last, [table, "row", "col"], "left").groupBy(table, "row").agg(F.array_sort(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("text")))).alias("c"))
    return full.select(table, "row", F.transform("c", lambda x: x["text"]).alias("texts"))
