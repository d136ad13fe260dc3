"""Numeric identifiers: candidate lines, resolver results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.functions import text as X

NEAR = 8


def candidates(lines: DataFrame, least: int = 8, most: int = 6, by: str = "doc_id") -> DataFrame:
    """The lines of a page (text, y) that most likely hold identifiers: with rank, kind and digits.

    Lines with enough digits, or four and a keyword, are ranked by keyword, kind
    and digits; one is taken unless a taken one is within NEAR of it, until
    there are enough.  That is a fold over the ranked lines of a page.
    """
    digits, keyword = X.digit_count("text"), F.col("text").rlike(X.ID_KEYWORDS)
    rated = lines.withColumn("digits", digits).withColumn("kind", X.line_kind("text"))
    rated = rated.where((F.col("digits") >= 4) & ((F.col("digits") >= least) | keyword))
    score = F.when(keyword, 100).otherwise(0) + F.when(F.col("kind") != "long_number", 50).otherwise(0) + F.col("digits")
    ranked = rated.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(score.desc(), F.col("digits").desc(), "y")))
    pages = ranked.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("place", "y"))).alias("c"))

    def step(kept: Column, c: Column) -> Column:
        taken = F.exists(kept, lambda k: F.abs(k["y"] - c["y"]) < NEAR) | (F.size(kept) >= most)
        return F.when(taken, kept).otherwise(F.concat(kept, F.array(c)))

    start = F.filter("c", lambda x: F.lit(False))
    kept = pages.select(by, F.explode(F.aggregate("c", start, step)).alias("k")).select(by, F.col("k.place").alias("place"))
    return ranked.join(kept, [by, "place"])


def resolver_result(raw: DataFrame) -> DataFrame:
    """Visible text, confidence in 0 to 1 (percentages divided), and whether a repair is safe."""
    n = X.safe_float("confidence", 0.0)
    visible = F.nullif(X.squeeze("visible"), F.lit(""))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when((n > 1) & (n <= 100), n / 100).otherwise(n)))
    safe = F.col("safe") & F.col("visible").isNotNull() & (F.col("confidence") >= 0.85) & (F.col("kind") != "ocr_engine_missing")
    return raw.withColumns({"visible": visible, "confidence": confidence}).withColumn("safe", safe)
