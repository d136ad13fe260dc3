"""A bounded sample of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`."""
    return F.crc32(F.col(id_col).cast("string")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> tuple[DataFrame, tuple[int, int]]:
    """At most `most` labelled documents of each class, chosen by a hash of the id, none of fold 0; and how many
    labels each class has.  Rows: id, text, label, fold.

    An id with several labels counts as 1 if any is 1; ids that are null or have
    a null label are left out.  The chosen ids are at most 2 * most rows, which
    bounds the broadcast; of documents that repeat an id one text is taken (that
    with the least hash), so that the sample has at most as many rows too.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("_label"))
    known = known.withColumn("_fold", fold(id_col, folds)).where("_fold <> 0")
    counts = dict(known.groupBy("_label").count().collect())
    picked = None
    for c in (0, 1):
        some = known.where(F.col("_label") == c).orderBy(F.xxhash64(id_col), id_col).limit(most)
        picked = some if picked is None else picked.unionByName(some)
    picked = picked.select(F.col(id_col).alias("_id"), "_label", "_fold")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = texts.join(F.broadcast(picked), "_id").withColumn("_h", F.xxhash64("_text"))
    one = found.groupBy("_id", "_label", "_fold").agg(F.min(F.struct("_h", "_text")).alias("_t"))
    return one.select("_id", F.col("_t._text").alias("_text"), "_label", "_fold"), (counts.get(0, 0), counts.get(1, 0))
