"""Markdown structure: headings, tables, blocks, slides; text tables of CSV and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions import text as X
from docframe.operators.scan import scanned


def is_table_line(x: Column) -> Column:
    t = F.trim(x)
    return t.startswith("|") & t.endswith("|")


def table_blocks(lines: DataFrame, by: str = "doc_id", no: str = "line_no", line: str = "line") -> DataFrame:
    """Runs of table lines: first and last line, rows, and the headings that hold when the run has ended.

    A run is an island of line number minus rank.  As the context is taken on
    the line after it, a heading there counts already.  A heading of the second
    level ends that of the third, so the last heading of both gives the third.
    """
    h2 = F.trim(F.nullif(F.regexp_extract(line, r"^##\s+(.+)$", 1), F.lit("")))
    h3 = F.trim(F.nullif(F.regexp_extract(line, r"^###\s+(.+)$", 1), F.lit("")))
    head = F.when(h2.isNotNull() | h3.isNotNull(), F.struct(h2.alias("h2"), h3.alias("h3")))
    marked = lines.select(by, no, head.alias("_head"), is_table_line(F.col(line)).alias("_table"))
    marked = scanned(marked, by, no, {"_rank": F.col("_table").cast("int")}, {"_h2": F.col("_head.h2"), "_last": F.col("_head")}, after={"_next": F.col("_head")})
    end = F.struct(F.coalesce("_next.h2", "_h2").alias("h2"), F.when(F.col("_next").isNotNull(), F.col("_next.h3")).otherwise(F.col("_last.h3")).alias("h3"))
    rows = marked.where("_table").select(by, no, (F.col(no) - F.col("_rank")).alias("_island"), end.alias("_end"))
    blocks = rows.groupBy(by, "_island").agg(F.min(no).alias("start_line"), F.max(no).alias("end_line"), F.count("*").alias("rows"), F.max_by("_end", no).alias("_c"))
    return blocks.select(by, "start_line", "end_line", "rows", F.col("_c.h2").alias("h2"), F.col("_c.h3").alias("h3"))


def headings(lines: DataFrame, line: str = "line") -> DataFrame:
    """Headings of the second and third level."""
    level = F.length(F.regexp_extract(line, r"^(##|###)\s+.+$", 1))
    return lines.withColumn("level", level).where("level > 0").withColumn("title", F.trim(F.regexp_extract(line, r"^#{2,3}\s+(.+)$", 1)))


ORDERED = r"^\d+[.)]\s+"


def line_kinds(line: Column) -> Column:
    """What a source line begins; a table line with three dashes anywhere is a separator, as it is for all builders."""
    x = F.regexp_replace(F.rtrim(line), r"^_+|_+$", "")
    x = F.trim(x)
    return (
        F.when(x.startswith("|"), F.when(x.contains("---"), "table_separator").otherwise("table"))
        .when(x == "", "blank").when(x.startswith("# "), "heading1").when(x.startswith("## "), "heading2").when(x.startswith("### "), "heading3")
        .when(x.rlike(ORDERED), "ordered_item").when(x.startswith("- ") | x.startswith("* "), "bullet_item").otherwise("paragraph")
    )


def blocks(lines: DataFrame, by: str = "doc_id", no: str = "line_no", line: str = "line") -> DataFrame:
    """Blocks in order: kind and source lines. Paragraph and table lines run together; separators are dropped within tables."""
    kind = line_kinds(F.col(line))
    kinds = lines.withColumn("_raw", kind).withColumn("kind", F.when(F.col("_raw") == "table_separator", "table").otherwise(F.col("_raw")))
    runs = F.col("kind").isin("paragraph", "table") & (F.col("_before") == F.col("kind"))
    numbered = scanned(scanned(kinds, by, no, before={"_before": F.col("kind")}), by, no, {"block": F.when(F.coalesce(runs, F.lit(False)), 0).otherwise(1)})
    kept = numbered.where((F.col("kind") != "blank") & (F.col("_raw") != "table_separator"))
    parts = kept.groupBy(by, "block").agg(F.first("kind").alias("kind"), F.array_sort(F.collect_list(F.struct(no, line))).alias("_l"))
    return parts.select(by, "block", "kind", F.transform("_l", lambda x: F.trim(x[line])).alias("lines"))


def slides(lines: DataFrame, by: str = "doc_id", no: str = "line_no", line: str = "line") -> DataFrame:
    """Lines with the slide they stand on: a heading starts one; tables and blank lines are left out."""
    kind = F.regexp_extract(line, r"^(#{1,3})\s", 1)
    placed = scanned(lines.withColumn("level", F.length(kind)), by, no, {"slide": F.when(F.length(kind) > 0, 1).otherwise(0)})
    return placed.where((F.trim(line) != "") & ~F.trim(line).startswith("|"))


def fenced(lines: DataFrame, by: str = "doc_id", no: str = "line_no", line: str = "line") -> DataFrame:
    """Lines with is_code: between two fences, which themselves are left out."""
    fence = F.trim(line).startswith("```")
    return scanned(lines, by, no, {"is_code": F.when(fence, 1).otherwise(0)}).withColumn("is_code", F.col("is_code") % 2 == 1).where(~fence)


def csv_table(text: Column) -> Column:
    """A pipe table of comma-separated lines: no quoting, short rows filled up, the first row as head."""
    rows = F.transform(F.filter(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(x) != ""), lambda x: F.split(x, ","))
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), X.escape_cell_plain), " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.lit(1), F.size(lines)))), "\n")).otherwise("")
