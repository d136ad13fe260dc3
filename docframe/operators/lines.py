"""Line analytics: running line numbers, coordinate rows, review items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docframe.functions import text as X

LOW_CONFIDENCE = 70.0


def numbered(lines: DataFrame, by: str = "doc_id", position: str = "line_pos", line: str = "line") -> DataFrame:
    """Squeezed lines that aren't blank, with their running number in the document."""
    squeezed = lines.withColumn(line, X.squeeze(line)).where(F.length(line) > 0)
    return squeezed.withColumn("line_no", F.row_number().over(Window.partitionBy(by).orderBy(position)))


def coordinate_rows(numbered_lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines with coordinates, and their numbers."""
    return numbered_lines.where(X.is_coordinate_like(line)).withColumn("numbers", X.numbers(line))


def review_items(numbered_lines: DataFrame, width: int = 180, shown: int = 500, line: str = "line") -> DataFrame:
    """Wide lines that look like a table and hold no coordinates, cut for display."""
    return numbered_lines.where(X.is_wide_line(line, width)).withColumn("shown", F.substring(line, 1, shown))


def stats(numbered_lines: DataFrame, by: str = "source", line: str = "line") -> DataFrame:
    """Counts of lines, coordinate rows, table-like lines and review items of each group."""
    flag = lambda c: F.count_if(c)
    return numbered_lines.groupBy(by).agg(
        F.count("*").alias("lines"), flag(X.is_coordinate_like(line)).alias("coordinate_rows"), flag(X.is_table_like(line)).alias("table_like"), flag(X.is_wide_line(line)).alias("reviews"), F.sum(F.length(line)).alias("chars")
    )


def low_confidence(words: DataFrame, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """Words whose confidence (0 to 100) is known and under the threshold."""
    return words.where((F.col("confidence") >= 0) & (F.col("confidence") < threshold))


def resolver_queue(items: DataFrame, limit: int, by: str = "run_id", order: str = "item_id") -> DataFrame:
    """Status of review items before the resolver: only items with a crop, and not of a missing engine, count towards the limit (negative: none)."""
    eligible = F.col("has_crop") & (F.col("kind") != "ocr_engine_missing")
    place = F.sum(F.when(eligible, 1).otherwise(0)).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    status = F.when(~F.col("has_crop"), "manual_review_no_crop").when(F.col("kind") == "ocr_engine_missing", "manual_review_needs_local_ocr")
    status = status.when(F.lit(limit < 0) | (place <= limit), "attempt").otherwise("queued_by_limit")
    return items.withColumn("status", status)


def workbench(pages: DataFrame, words: DataFrame, by: str = "source", threshold: float = LOW_CONFIDENCE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages (source, page, text) and words (source, page, text, confidence) as coordinate rows, review items and figures of each source.

    Lines that aren't blank are numbered over all pages of a source; wide lines and words of low confidence are reviewed."""
    split = pages.select(by, "page", F.posexplode(F.split("text", "\n")).alias("_pos", "line")).withColumn("line", X.squeeze("line")).where(F.length("line") > 0)
    lines = split.withColumn("line_no", F.row_number().over(Window.partitionBy(by).orderBy("page", "_pos"))).drop("_pos")
    found = coordinate_rows(lines).select(by, "page", "line_no", "numbers", F.col("line").alias("raw"))
    weak = low_confidence(words, threshold).select(by, "page", F.lit("low_confidence_word").alias("kind"), "text")
    wide = review_items(lines).select(by, "page", F.lit("wide_line").alias("kind"), F.col("shown").alias("text"))
    reviews = wide.unionByName(weak)
    figures = stats(lines, by).drop("reviews", "chars").join(reviews.groupBy(by).agg(F.count("*").alias("reviews")), by, "left").join(pages.groupBy(by).agg(F.count_distinct("page").alias("pages")), by)
    return found, reviews, figures.withColumn("reviews", F.coalesce("reviews", F.lit(0)))
