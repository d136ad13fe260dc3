"""Tables derived from the documents, alike in Spark and in DuckDB: lines, words with boxes, and a second engine's text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, source, line_pos and line of every line of every text."""
    return docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_pos", "line"))


def words(docs: DataFrame) -> DataFrame:
    """Words between single spaces, with a box on a synthetic page (60 by 30 a cell) and a confidence."""
    parts = lines(docs).select("doc_id", "line_pos", F.posexplode(F.split("line", " ")).alias("word_pos", "text")).where("text <> ''")
    place = word(F.col("text"), F.col("word_pos"))
    return parts.select("doc_id", "line_pos", "word_pos", "text", *[c.alias(k) for k, c in place.items()])


def word(text, no, line_pos=None) -> dict:
    """Box and confidence of the word with this number in its line, from the columns doc_id and line_pos (or the line's number given)."""
    line_pos = F.col("line_pos") if line_pos is None else line_pos
    return {
        "x": no * 60,
        "y": line_pos * 30 + no * 7 % 5,
        "w": F.length(text) * 8,
        "h": F.lit(20),
        "confidence": ((F.col("doc_id") * 31 + line_pos * 17 + no * 7) % 101) / 100.0,
    }


def second_text(column: str = "text"):
    """What a second engine reads: digits and letters that look alike exchanged."""
    return F.translate(column, "0O1l8", "O0l1B")


LINES = "(SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_pos, unnest(string_split(text, chr(10))) AS line FROM documents)"
WORDS = f"""(SELECT doc_id, line_pos, word_pos, text, word_pos * 60 AS x, line_pos * 30 + word_pos * 7 % 5 AS y, length(text) * 8 AS w, 20 AS h,
  ((doc_id * 31 + line_pos * 17 + word_pos * 7) % 101) / 100.0 AS confidence
  FROM (SELECT doc_id, line_pos, generate_subscripts(string_split(line, ' '), 1) - 1 AS word_pos, unnest(string_split(line, ' ')) AS text FROM {LINES}) WHERE text <> '')"""
SECOND = "translate(text, '0O1l8', 'O0l1B')"
