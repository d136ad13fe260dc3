"""A training-data pipeline over the documents table.

Toxic documents go, then documents of low quality, then all but one of each
group of near-duplicates; the rest is packed into sequences.  Each stage works
on all that its predecessor kept and is written before the next one starts.

Cases, for every stage: null and empty texts are scored, kept apart from all
groups and packed as the end id only; rows with a null id are handled like all
others but never learnt from; repeated rows are scored and packed once each, and
one of them stays where copies go; ties of a score with its limit are toxic
(score >= TOXIC) and good (score >= GOOD); very long texts are read whole;
further columns are passed on, whatever their names; an empty table stays empty
(with its columns).
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm import neardup, packing, quality_knn, toxicity
from docframe.llm.arrowmap import counted, shared_dir, written
from docframe.session import ship

TOXIC = 0.5
GOOD = 0.3


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _aside(docs: DataFrame) -> DataFrame:
    """The whole rows in one column, so that no column's name can clash, and the text."""
    return docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under TOXIC."""
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    return toxicity.score(_aside(docs), model, "_text").where(F.col("score") < TOXIC).select("_row.*")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least GOOD."""
    model = quality_knn.fit(docs, _labels(spark, sf_dir))
    return quality_knn.score(_aside(docs), model, "_text").where(F.col("score") >= GOOD).select("_row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the least id (null ids last).

    Decided row by row: rows are numbered in a table of their own, so that of rows that repeat an id (with the same text
    or another) and of rows without an id one stays as well."""
    ship(spark)
    folder = shared_dir(spark)
    rows = written(docs.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_nth")), folder, "rows")
    marks = written(neardup.groups(rows, "_nth", "_row.text", keep={"_doc": "_row.doc_id"}), folder, "marks")
    several = marks.where(~F.col("kept")).select("component_id").distinct()
    group = marks.join(several, "component_id", "left_semi")
    first = group.groupBy("component_id").agg(F.min(F.struct(F.col("_doc").isNull(), "_doc", "_nth")).alias("first")).select(F.col("first._nth").alias("_nth"))
    gone, n = counted(group.select("_nth").join(first, "_nth", "left_anti"), folder, "gone", n=F.count(F.lit(1)))
    return rows.join(neardup.checked(gone, n["n"]), "_nth", "left_anti").select("_row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row per piece of a document."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_good),
    ("near-duplicates", drop_copies),
    ("packing", pack),
]

#: Models that are learnt can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), folder, f"stage-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
